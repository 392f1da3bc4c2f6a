"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation is searched from left to right over a window of the longest piece's length. Whenever the
backpointer paths of all boundaries from which a piece could still start run through one boundary, the ids before
it are final and leave. Segments between boundaries that no piece crosses are such places by themselves; short
ones are remembered.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ragframe.llm.common import arrow_map

SPACE = "▁"
# Fixed value: what an uncovered character costs below the least score of the pieces.
UNKNOWN_PENALTY = 10.0
# Segments up to this length are remembered, twice this many at most.
MEMO_CHARS = 40
MEMO_SEGMENTS = 150_000
# Uncommitted characters between two looks for a common boundary.
LOOK = 64
FEED = 1 << 16


class Pieces:
    """A SentencePiece model's pieces with their scores, in the order of the file at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = [-1] * 256
        self.text: list[str] = [""] * n
        self.byte_of = [-1] * n
        self.unknown = model.unk_id()
        scores: dict[str, tuple[float, int]] = {}
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                self.bytes[int(name[1:-1], 16)] = i
                self.byte_of[i] = int(name[1:-1], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                scores[name] = (model.get_score(i), i)
                self.text[i] = name.replace(SPACE, " ")
        self.longest = max(map(len, scores), default=1)
        self.worst = min((s for s, _ in scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.scores = scores
        # No piece crosses between two characters that stand side by side in none.
        self.side_by_side = {name[i : i + 2] for name in scores for i in range(len(name) - 1)}
        # Boundaries before a space are final if no piece has a space behind another character.
        self.splits = not any(b == SPACE and a != SPACE for name in scores for a, b in zip(name, name[1:], strict=False))
        self.line_alone = not any("\n" in name for name in scores)
        # What was looked up lately, and before that.
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    @cached_property
    def root(self) -> list:
        """A trie of the pieces: nodes are [next nodes by character, score and id of the piece that ends here]."""
        top: list = [{}, None, -1]
        for name, entry in self.scores.items():
            node = top
            for char in name:
                node = node[0].setdefault(char, [{}, None, -1])
            node[1:] = entry
        return top

    def char_ids(self, char: str) -> list[int]:
        ids = [self.bytes[b] for b in char.encode("utf-8")]
        return ids if min(ids) >= 0 else [self.unknown]

    # ---- search ----

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the best segmentation of the concatenated ``chunks``, in lists that are final when they leave."""
        root, longest, worst = self.root, self.longest, self.worst
        text, at = "", 0  # text from the last common boundary on; start being extended
        best: list[float | None] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]
        done, looked = False, 0
        chunks = iter(chunks)
        while True:
            while not done and len(text) - at < longest:
                more = next(chunks, None)
                done = more is None
                text += more or ""
            if at >= len(text):
                break
            if len(best) < len(text) + 1:
                best += [None] * (len(text) + 1 - len(best))
                back += [(0, -1)] * (len(text) + 1 - len(back))
            stop = len(text) if done else len(text) - longest + 1
            while at < stop:
                base = best[at]
                single = False
                node, to = root, at
                for char in text[at : at + longest]:
                    node = node[0].get(char)
                    if node is None:
                        break
                    to += 1
                    if node[1] is not None:
                        single = single or to == at + 1
                        total = base + node[1]
                        if best[to] is None or total > best[to]:
                            best[to], back[to] = total, (at, node[2])
                if not single:
                    total = base + worst
                    if best[at + 1] is None or total > best[at + 1]:
                        best[at + 1], back[at + 1] = total, (at, -1)
                at += 1
                if at - looked >= LOOK:
                    common = self._common(at, best, back)
                    if common:
                        yield self._ids(text, common, back)
                        zero = best[common]
                        text, at = text[common:], at - common
                        best = [None if b is None else b - zero for b in best[common:]]
                        back = [(a - common, i) for a, i in back[common:]]
                        stop -= common
                    looked = at
        if at:
            yield self._ids(text, len(text), back)

    def _common(self, at: int, best: list, back: list) -> int:
        """Last boundary on the paths of all boundaries from ``at`` on that are reached already."""
        live = {i for i in range(at, min(len(best), at + self.longest)) if best[i] is not None}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last][0])
        return live.pop()

    def _ids(self, text: str, end: int, back: list) -> list[int]:
        out = []
        while end > 0:
            start, piece = back[end]
            out += [piece] if piece >= 0 else self.char_ids(text[start])[::-1]
            end = start
        return out[::-1]

    def segment(self, part: str) -> list[int]:
        if len(part) > MEMO_CHARS:
            feed = (part[i : i + FEED] for i in range(0, len(part), FEED))
            return [i for ids in self.stream(feed) for i in ids]
        found = self.memo.get(part) or self.older.get(part)
        if found is None:
            # Letters after the first sign: few such words hold a pair that no piece has, so none is looked for.
            if not part[1:].isalpha() and not all(part[i : i + 2] in self.side_by_side for i in range(len(part) - 1)):
                cuts = [0, *(i + 1 for i in range(len(part) - 1) if part[i : i + 2] not in self.side_by_side), len(part)]
                found = [i for a, b in zip(cuts, cuts[1:], strict=False) for i in self.segment(part[a:b])]
            else:
                found = self.window(part)
        if len(self.memo) >= MEMO_SEGMENTS:
            self.memo, self.older = {}, self.memo
        self.memo[part] = found
        return found

    def window(self, text: str) -> list[int]:
        """The search over a text that lies between final boundaries and fits one window: ids leave at its end."""
        n, root, longest = len(text), self.root, self.longest
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            base, to = best[at], at
            kids, single = root[0], False
            for char in text[at : at + longest]:
                node = kids.get(char)
                if node is None:
                    break
                kids, score, piece = node
                to += 1
                if score is not None:
                    if to == at + 1:
                        single = True
                    if base + score > best[to]:
                        best[to], back[to] = base + score, (at, piece)
            if not single and base + self.worst > best[at + 1]:
                best[at + 1], back[at + 1] = base + self.worst, (at, -1)
        return self._ids(text, n, back)

    def encode(self, text: str) -> list[int]:
        """Ids of a text, which is not normalised but for a leading space and the space mark; none for no text."""
        if not text:
            return []
        if not self.splits:
            return self.segment(SPACE + text.replace(" ", SPACE))
        out: list[int] = []
        lines = text.split("\n") if self.line_alone else [text]
        line_end = self.char_ids("\n")
        for k, line in enumerate(lines):
            if k:
                out += line_end
            words = line.split(" ")
            held = ""
            head = SPACE if k == 0 else ""
            for w in words:
                if w:
                    part = held + head + w if held else head + w
                    out += self.memo.get(part) or self.segment(part)
                    held = ""
                else:
                    held += head
                head = SPACE
            if held:
                out += self.segment(held)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters, unknown and control ids nothing."""
        out, held = [], bytearray()
        text, byte_of = self.text, self.byte_of
        for i in ids:
            b = byte_of[i]
            if b >= 0:
                held.append(b)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        joined = "".join(out)
        return joined[1:] if joined.startswith(" ") else joined


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """One model per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids array<int>`` after its own columns (one of that name is replaced).

    Null and empty texts have no ids. Only ``text`` is read, row by row; other columns pass through.
    """
    names = [c for c in docs.columns if c != "ids"]
    base = docs.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("text")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(path)
        found = [np.array(model.encode(t or ""), np.int32) for t in batch.column(at).to_pylist()]
        offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))
        return pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*names, "ids"])

    more = StructField("ids", ArrayType(IntegerType()))
    return arrow_map(base, rows, StructType([*base.schema.fields, more]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded string`` after its own columns; null ids decode to the empty text."""
    names = [c for c in encoded.columns if c != "decoded"]
    base = encoded.select(*(F.col(f"`{c}`") for c in names))
    at = names.index("ids")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = loaded(path)
        texts = pa.array([model.decode(i or ()) for i in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*names, "decoded"])

    return arrow_map(base, rows, StructType([*base.schema.fields, StructField("decoded", StringType())]))
