"""Conversation repair against the cheapest of all edit sequences, pieces against the whole, defined cases."""

import hashlib
import itertools
import random
import re

import pytest

from ragframe.llm import repair

SOUND = re.compile(r"(s?(ua)+)?")


def cheapest(symbols, most_inserts=3):
    """(cost, audit) by trying every edit sequence."""
    best = None
    options = [["D"] if s == "x" else ["K", "R", "D"] for s in symbols]
    for edits in itertools.product(*options):
        for inserts in range(most_inserts + 1):
            for places in itertools.combinations_with_replacement(range(len(edits) + 1), inserts):
                audit = "".join("I" * places.count(i) + (edits[i] if i < len(edits) else "") for i in range(len(edits) + 1))
                open_roles, cost, at = [], 0, 0
                for e in audit:
                    if e == "I":
                        open_roles.append("ua")
                        cost += 2
                        continue
                    s, at = symbols[at], at + 1
                    cost += {"K": 0, "R": 2, "D": 3}[e] + (s.isupper() and e != "D")
                    if e != "D":
                        open_roles.append("ua" if e == "R" else s.lower())
                if any(SOUND.fullmatch("".join(r)) for r in itertools.product(*open_roles)):
                    best = min(best, (cost, audit)) if best else (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(12):
        symbols = "".join(rng.choice("suaSUAoOx") for _ in range(rng.randint(0, 5)))
        assert repair.lightest(symbols) == cheapest(symbols), symbols


def test_pieces_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(60):
        symbols = "".join(rng.choice("suuaaUAox") for _ in range(rng.randint(0, 24)))
        now = [(0, ""), None, None, None]
        for at in range(0, len(symbols), 5):
            part = symbols[at : at + 5]
            now = repair.joined(now, [repair.ways(part, s) for s in range(repair.STATES)])
        assert min(now[s] for s in repair.FINAL if now[s]) == repair.lightest(symbols)


SCHEMA = "conv_id long, turn long, role string, text string, code int, kind string"


def plain(rows):
    """Report and repaired lines of each conversation, one at a time."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, symbols, counts = set(), "", dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            initial = role[:1] if role[:1] in list("sua") else "o"
            trimmed = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = repair.lightest(symbols)
        lines, at, expected = [], 0, "user"
        for e in audit:
            line = (expected, "") if e == "I" else None
            if e != "I":
                _, role, text = own[at]
                at += 1
                line = {"K": (role, text), "R": (expected, text), "D": None}[e]
            if line:
                lines.append(line)
                expected = "assistant" if line[0][0] == "u" else "user"
        turns = [r[0] for r in own if r[0] is not None]
        roles = [r[1][:1] for r in own]
        out[conv] = dict(
            counts, gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, cost=cost, audit=audit, lines=lines,
            illegal=sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(roles)),
        )
    return out


def check(spark, rows, piece):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    expected = plain(rows)
    got = {r["conv"]: r for r in repair.repair_digests(df, piece=piece).collect()}
    assert set(got) == set(expected)
    for conv, want in expected.items():
        row = got[conv].asDict()
        body = "\n".join(f"{role}:{text}" for role, text in want["lines"])
        assert row.pop("repaired_sha256") == hashlib.sha256(body.encode()).hexdigest()
        row.pop("conv")
        assert row == {k: v for k, v in want.items() if k != "lines"}, conv
    mended = {}
    for r in repair.repaired(df, piece=piece).orderBy("conv", "position").collect():
        mended.setdefault(r["conv"], []).append((r["role"], r["text"]))
    assert mended == {c: w["lines"] for c, w in expected.items() if w["lines"]}


def test_conversations_like_plain_python(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((conv, turn if rng.random() < 0.9 else rng.choice([None, turn + 3]), role, rng.choice(["Hi.", "Well", "", " \n", "So? ", f"{turn} x!"])))
    rows += [(None, 0, "user", "One."), (None, None, None, None), (None, 1, "assistant", "Two\n"), (-7, None, "user", None)]
    rows += [(99, 1, "user", "Again."), (99, 1, "user", "Again."), (99, 1, "assistant", "Long " * 50_000), (99, 2, "assistant", "Yes.")]
    check(spark, rows, repair.PIECE)
    check(spark, rows, 3)


def test_a_long_conversation_is_cut_in_pieces(spark):
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", f"{t}", "", "Same."])) for t in range(700)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{t}.") for c in (4, 6) for t in range(4)]
    rng.shuffle(rows)
    check(spark, rows, 64)


def test_no_rows(spark):
    assert repair.repair_digests(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).collect() == []
