"""Token ids as compressed binary files: a data source that Spark writes and reads in parallel.

A folder holds one file per task and MANIFEST.json, which names the files that were committed, in order; files of
lost or repeated attempts are never read. A file is

    magic | block payloads | index, deflated | index size (u32) | index crc32 (u32) | magic

with an index of block table (ids, bytes, crc32 of the ids as little-endian u32) and document table (id, whether it
has one, ids). Blocks hold BLOCK ids whatever the documents are, and decode independently (see ``mixing``).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ragframe.llm.mixing import BLOCK, decode_blocks, encode_blocks

FORMAT = "token_blocks"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
MAGIC = b"TKBLK1\r\n"
LANES = 2048
MEMO_WORDS = 400_000
END_ID = 2
BATCH_IDS = 1 << 20
BATCH_BYTES = 16 << 20


def _store(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "hdfs:")) else os.path.abspath(path))


# ---- text to ids --------------------------------------------------------------------------------


class Words:
    """Ids of white-space separated words, each encoded once while it is remembered.

    Right for tokenizers that drop white space and never look across it. A word's letters and the ASCII marks after
    them are remembered apart, since such tokenizers cut between them; a mark that starts a contraction is left on.
    """

    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.memo: dict[bytes, list[int]] = {}
        self.parts: dict[bytes, list[int]] = {}

    def _split(self, word: bytes) -> tuple[bytes, bytes]:
        core = word.rstrip(self.MARKS)
        if core and core.isalpha():
            return core.lower(), word[len(core) :]
        return word, b""

    def _learn(self, words: list[bytes]) -> None:
        if len(self.memo) > MEMO_WORDS:
            self.forget()
        cut = {w: self._split(w) for w in words if w not in self.memo}
        unknown = list({p for pair in cut.values() for p in pair if p and p not in self.parts})
        for at in range(0, len(unknown), 10_000):
            part = unknown[at : at + 10_000]
            encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in part], add_special_tokens=False)
            self.parts.update((p, e.ids) for p, e in zip(part, encoded, strict=True))
        for w, (core, marks) in cut.items():
            self.memo[w] = self.parts[core] + self.parts[marks] if marks else self.parts[core]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null texts have none."""
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))
        coded = lists.flatten().dictionary_encode()
        words = [w.encode() for w in coded.dictionary.to_pylist()]
        self._learn([w for w in words if w])
        found = [self.memo[w] if w else () for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        index = np.asarray(coded.indices)
        lengths = sizes[index]
        ends = np.cumsum(lengths)
        firsts = (np.cumsum(sizes) - sizes)[index]
        flat = pool[np.repeat(firsts - (ends - lengths), lengths) + np.arange(len(lengths) and ends[-1])]
        sums = np.r_[0, ends]
        offsets = np.asarray(lists.offsets)
        return flat, sums[offsets[1:] - offsets[0]] - sums[offsets[:-1] - offsets[0]]


_LOADED: dict[str, Words] = {}


def loaded(path: str) -> Words:
    """One tokenizer, with the words it remembers, per worker process."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


# ---- writing ------------------------------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES, so that a batch's words repeat."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@dataclass
class Shard(WriterCommitMessage):
    order: int
    file: str
    docs: int
    tokens: int


class ShardWriter:
    """One file, written block group by block group."""

    def __init__(self, stream, vocabulary: int):
        self.stream, self.vocabulary = stream, vocabulary
        self.held, self.n = [], 0
        self.blocks, self.ids, self.valid, self.lengths = [], [], [], []
        stream.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= LANES * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        while len(flat) >= (1 if last else LANES * BLOCK):
            part, flat = flat[: LANES * BLOCK], flat[LANES * BLOCK :]
            lengths = np.full(-(-len(part) // BLOCK), BLOCK)
            lengths[-1] = len(part) - BLOCK * (len(lengths) - 1)
            grid = np.zeros((len(lengths), BLOCK), np.uint32)
            grid.ravel()[: len(part)] = part
            for row, n, payload in zip(grid, lengths, encode_blocks(grid, lengths, self.vocabulary), strict=True):
                self.blocks.append((int(n), len(payload), zlib.crc32(row[:n].astype("<u4").tobytes())))
                self.stream.write(payload)
        self.held, self.n = [flat], len(flat)

    def close(self) -> None:
        self.flush(True)
        head = struct.pack("<QQQ", len(self.blocks), len(self.lengths), self.vocabulary)
        body = [np.array(self.blocks, "<u4").tobytes(), np.array(self.ids, "<i8").tobytes(),
                np.array(self.valid, "u1").tobytes(), np.array(self.lengths, "<u8").tobytes()]
        index = zlib.compress(head + b"".join(body))
        self.stream.write(index + struct.pack("<II", len(index), zlib.crc32(index)) + MAGIC)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.tokenizer = options["path"], options["tokenizer"]
        self.end = int(options.get("end_id", END_ID))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        words = loaded(self.tokenizer)
        order = TaskContext.get().partitionId()
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"{order:06d}-{uuid.uuid4().hex}.tok"
        docs = tokens = 0
        with store.open_output_stream(f"{root}/{name}") as stream:
            out = ShardWriter(stream, words.tokenizer.get_vocab_size())
            for batch in _gathered(iterator):
                ids, counts = words.ids(batch.column(1))
                ends = np.cumsum(counts)
                out.add(np.insert(ids, ends, np.uint32(self.end)))
                keys = batch.column(0)
                out.ids += [k or 0 for k in keys.to_pylist()]
                out.valid += keys.is_valid().to_pylist()
                out.lengths += (counts + 1).tolist()
                docs += len(counts)
                tokens += int(counts.sum()) + len(counts)
            out.close()
        return Shard(order, name, docs, tokens)

    def commit(self, messages: list[Shard | None]) -> None:
        done = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.order)
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        rows = [{"file": m.file, "docs": m.docs, "tokens": m.tokens} for m in done]
        with store.open_output_stream(f"{root}/MANIFEST.json") as out:
            out.write(json.dumps({"format": FORMAT, "shards": rows}).encode())

    def abort(self, messages: list[Shard | None]) -> None:
        """Nothing names the files of an aborted write, so nothing reads them."""


# ---- reading ------------------------------------------------------------------------------------


@dataclass
class ShardPart(InputPartition):
    file: str
    start: int

    def __post_init__(self):
        super().__init__(self.file)


class CorruptFile(ValueError):
    pass


def read_shard(source) -> tuple[int, np.ndarray, list[tuple], np.ndarray]:
    """(vocabulary, block table, documents as (id, length), offsets of the payloads) of a random-access file."""
    size = source.size()
    tail = source.read_at(16, size - 16) if size >= 24 else b""
    if len(tail) < 16 or tail[8:] != MAGIC or source.read_at(8, 0) != MAGIC:
        raise CorruptFile("not a token block file, or cut short")
    n, crc = struct.unpack("<II", tail[:8])
    packed = source.read_at(n, size - 16 - n)
    if zlib.crc32(packed) != crc:
        raise CorruptFile("the index does not match its checksum")
    index = zlib.decompress(packed)
    blocks, docs, vocabulary = struct.unpack_from("<QQQ", index)
    at = 24
    table = np.frombuffer(index, "<u4", 3 * blocks, at).reshape(-1, 3)
    at += 12 * blocks
    ids = np.frombuffer(index, "<i8", docs, at)
    valid = np.frombuffer(index, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
    offsets = len(MAGIC) + np.r_[0, np.cumsum(table[:, 1].astype(np.int64))]
    return vocabulary, table, (ids, valid, lengths), offsets


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[ShardPart]:
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/MANIFEST.json") as source:
            shards = json.loads(source.read())["shards"]
        parts, start = [], 0
        for s in shards:
            parts.append(ShardPart(s["file"], start))
            start += s["tokens"]
        return parts or [ShardPart("", 0)]

    def read(self, partition: ShardPart) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as source:
            vocabulary, table, (ids, valid, lengths), offsets = read_shard(source)
            ends = np.cumsum(lengths)
            flat, done, at = np.zeros(0, "<u4"), 0, 0  # ids at hand, documents returned, ids returned
            for b in range(0, len(table), LANES):
                flat = np.concatenate([flat, self._decode(source, table[b : b + LANES], offsets[b : b + LANES + 1], vocabulary)])
                to = int(np.searchsorted(ends, at + len(flat), "right"))
                while done < to:
                    step = max(done + 1, int(np.searchsorted(ends, at + BATCH_IDS, "right")))
                    step = min(step, to)
                    used = int(ends[step - 1]) - at
                    yield self._rows(ids[done:step], valid[done:step], lengths[done:step], partition.start + at, flat[:used])
                    flat, at, done = flat[used:], at + used, step

    def _decode(self, source, table, offsets, vocabulary) -> np.ndarray:
        data = source.read_at(int(offsets[-1] - offsets[0]), int(offsets[0]))
        cut = (offsets - offsets[0]).tolist()
        payloads = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        grid = decode_blocks(payloads, table[:, 0].astype(np.int64), vocabulary).astype("<u4")
        rows = [row[:n] for row, n in zip(grid, table[:, 0], strict=True)]
        for row, crc in zip(rows, table[:, 2], strict=True):
            if zlib.crc32(np.ascontiguousarray(row).tobytes()) != crc:
                raise CorruptFile("a block does not match its checksum")
        return np.concatenate(rows)

    def _rows(self, ids, valid, lengths, start, flat) -> pa.RecordBatch:
        offsets = pa.array((4 * np.r_[0, np.cumsum(lengths)]).astype(np.int32))
        binary = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())])
        keys = pa.array(ids, mask=valid == 0)
        starts = start + np.cumsum(lengths) - lengths
        return pa.RecordBatch.from_arrays([keys, pa.array(starts), pa.array(lengths), binary], names=["doc_id", "start", "n_tokens", "ids"])


class TokenBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def registered(spark: SparkSession) -> str:
    """The data source's name in ``spark``, a name for each session.

    Spark looks a name up in the session of the table and in the one that is active, so both must know it, and a session
    is refused a name that only the other one knows.
    """
    name = getattr(spark, "_token_blocks", None) or f"{FORMAT}_{uuid.uuid4().hex}"
    spark._token_blocks = name
    source = type(TokenBlocks.__name__, (TokenBlocks,), {"name": classmethod(lambda cls: name)})
    for session in (spark, SparkSession.active()):
        session.dataSource.register(source)
    return name


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_column: str = "doc_id") -> None:
    """Encode every whole text and write ids, each text followed by ``end_id``, in ascending id order.

    Null ids come first and null texts are empty; rows that repeat an id follow each other, ordered by text.
    """
    source = registered(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    (ordered.write.format(source).mode("append").option("path", path).option("tokenizer", tokenizer)
     .option("end_id", end_id).save())


def read_tokens(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of a written folder; ``ids`` are little-endian unsigned 32-bit integers.

    A file or block that does not match its checksum fails the read.
    """
    return spark.read.format(registered(spark)).option("path", path).load()
