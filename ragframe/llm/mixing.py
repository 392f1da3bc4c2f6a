"""Adaptive context-mixing range coder for token ids.

A block of ids starts from an empty model and is coded by itself. Two predictors name the id that last followed the
previous two ids and the previous one; adaptive confidences of both are mixed by a weight that learns which of them
to trust, and the mixed probability codes whether the named id comes. An id that neither names is coded by order 0:
its group of 256 under adaptive frequencies, then whether it is the group's latest id, then the place in the group.
Encoder and decoder run the same integer model. Many blocks are coded side by side, one per lane of the arrays.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
SLOTS = 2048
BITS = 12
LIMIT = 32
SURE = 7
FULL = 1 << 15
GROUP = 256


class Encoder:
    """32-bit range coder whose carries are settled when a block ends; one output row per lane."""

    def __init__(self, lanes: int, length: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, (1 << 32) - 1, np.int64)
        self.out = np.zeros((lanes, length + 8), np.int32)
        self.at = np.zeros(lanes, np.int64)

    def _narrow(self, on, start, size, bits):
        m = len(on)
        step = self.range[:m] >> bits
        self.low[:m] += step * start * on
        self.range[:m] = np.where(on, step * size, self.range[:m])
        need = np.flatnonzero(self.range[:m] < (1 << 16))
        if len(need):
            low = self.low[need]
            if self.at.max() + 8 > self.out.shape[1]:
                self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
            self.out[need, self.at[need]] = low >> 16
            self.at[need] += 1
            self.low[need] = (low & 0xFFFF) << 16
            self.range[need] <<= 16

    def flag(self, on, chance, bit):
        start = chance * ~bit
        self._narrow(on, start, np.where(bit, chance, (1 << BITS) - chance), BITS)
        return bit

    def symbol(self, on, table, value):
        rows = np.arange(len(on))
        start = table[rows, value]
        self._narrow(on, start, table[rows, value + 1] - start, 15)
        return value

    def place(self, on, value):
        self._narrow(on, value, 1, 8)
        return value

    def payloads(self) -> list[bytes]:
        rows = np.arange(len(self.at))
        self.out[rows, self.at] = self.low >> 16
        self.out[rows, self.at + 1] = self.low & 0xFFFF
        for k in range(int(self.at.max()) + 1, 0, -1):
            self.out[:, k - 1] += self.out[:, k] >> 16
            self.out[:, k] &= 0xFFFF
        return [self.out[i, : n + 2].astype(">u2").tobytes() for i, n in enumerate(self.at)]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        words = [np.frombuffer(p, ">u2") for p in payloads]
        self.words = np.zeros((len(words), max(map(len, words)) + 4), np.int64)
        for i, w in enumerate(words):
            self.words[i, : len(w)] = w
        self.code = (self.words[:, 0] << 16) | self.words[:, 1]
        self.range = np.full(len(words), (1 << 32) - 1, np.int64)
        self.at = np.full(len(words), 2, np.int64)

    def _narrow(self, on, step, start, size):
        m = len(on)
        self.code[:m] -= step * start * on
        self.range[:m] = np.where(on, step * size, self.range[:m])
        need = np.flatnonzero(self.range[:m] < (1 << 16))
        if len(need):
            at = np.minimum(self.at[need], self.words.shape[1] - 1)
            self.code[need] = (self.code[need] << 16) | self.words[need, at]
            self.at[need] += 1
            self.range[need] <<= 16

    def flag(self, on, chance, _):
        m = len(on)
        step = self.range[:m] >> BITS
        bit = on & (self.code[:m] < step * chance)
        self._narrow(on, step, chance * ~bit, np.where(bit, chance, (1 << BITS) - chance))
        return bit

    def symbol(self, on, table, _):
        m = len(on)
        step = self.range[:m] >> 15
        aim = np.minimum(self.code[:m] // step, FULL - 1)
        value = (table[:, 1:] <= aim[:, None]).sum(1)
        value = np.where(on, np.minimum(value, table.shape[1] - 2), 0)
        rows = np.arange(m)
        start = table[rows, value]
        self._narrow(on, step, start, table[rows, value + 1] - start)
        return value

    def place(self, on, _):
        m = len(on)
        step = self.range[:m] >> 8
        value = np.where(on, np.minimum(self.code[:m] // step, 255), 0)
        self._narrow(on, step, value, 1)
        return value


class Chances:
    """Adaptive probabilities of a yes, one row of contexts per lane."""

    def __init__(self, lanes: int, contexts: int):
        start = np.linspace(400, 3000, contexts).astype(np.int32)
        self.p, self.base = np.tile(start, lanes), np.arange(lanes) * contexts

    def look(self, context: np.ndarray) -> np.ndarray:
        self.slot = self.base[: len(context)] + context
        self.seen = self.p.take(self.slot)
        return self.seen

    def learn(self, on: np.ndarray, goal: np.ndarray) -> None:
        """Move towards ``goal``, 4095 for a yes and 0 for a no."""
        self.p[self.slot] = self.seen + ((goal - self.seen) >> 4) * on


class Followers:
    """Per lane, the id that last followed a hashed context and how often in a row it did, as 8 * id + times."""

    def __init__(self, lanes: int):
        self.packed = np.zeros(lanes * SLOTS, np.int32)
        self.base = np.arange(lanes) * SLOTS

    def look(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.slot = self.base[: len(context)] + (context & (SLOTS - 1))
        self.seen = self.packed.take(self.slot)
        self.named, self.sure = self.seen >> 3, self.seen & SURE
        return self.named, self.sure

    def learn(self, came: np.ndarray) -> None:
        """A hit strengthens, a miss halves the times; at nought the new id moves in."""
        packed = self.seen - self.sure + (self.sure >> 1)
        packed = np.where(self.sure < 2, 8 * came + 1, packed)
        hit = (self.named == came) & (self.sure > 0)
        self.packed[self.slot] = np.where(hit, self.seen + (self.sure < SURE), packed)


def _run(coder, lengths: np.ndarray, groups: int, ids: np.ndarray | None) -> np.ndarray:
    """Code lanes of ``lengths`` ids, longest first; the encoder is given ``ids``, the decoder returns them."""
    lanes, longest = len(lengths), int(lengths.max())
    result = np.zeros((longest, lanes), np.int32)
    two, one = Followers(lanes), Followers(lanes)
    by_two, by_one = Chances(lanes, 16), Chances(lanes, 16)
    latest, again = np.zeros(lanes * groups, np.int32), Chances(lanes, 1)
    trust = np.full(lanes, 1 << 11, np.int32)
    counts = np.ones((lanes, groups), np.int32)
    live = (lengths[:, None] > np.arange(longest)).sum(0)
    given = None if ids is None else np.ascontiguousarray(ids.T.astype(np.int32))
    blank = np.zeros(lanes, np.int32)
    for t in range(longest):
        m = int(live[t])
        if t % 64 == 0 or t in (8, 16, 32):
            sums = np.cumsum(counts, axis=1, dtype=np.int64)
            table = np.zeros((lanes, groups + 1), np.int32)
            table[:, 1:] = sums * (FULL - groups) // sums[:, -1:] + np.arange(1, groups + 1)
            table = table[:m]
        table = table if len(table) == m else table[:m]
        prev = result[t - 1, :m] if t else blank[:m]
        prev2 = result[t - 2, :m] if t > 1 else blank[:m]
        came = None if given is None else given[t, :m]
        n2, s2 = two.look((prev * 40503 + prev2 * 30011 + (prev2 >> 5)) >> 1)
        n1, s1 = one.look(prev * 40503 >> 3)
        # Order 2 names an id if it can, else order 1; both say how likely it is.
        named = np.where(s2 > 0, n2, n1)
        on = (s2 | s1) > 0
        agree = n2 == n1
        a, b = by_two.look(2 * s2 + agree), by_one.look(2 * s1 + agree)
        weight = trust[:m]
        mixed = b + (weight * (a - b) >> 12)
        np.minimum(np.maximum(mixed, LIMIT, out=mixed), (1 << BITS) - LIMIT, out=mixed)
        hit = coder.flag(on, mixed, None if came is None else on & (named == came))
        goal = hit * np.int32(4095)
        by_two.learn(on, goal)
        by_one.learn(on, goal)
        weight = weight + np.where(hit, a - b, b - a) // 8 * on
        trust[:m] = np.minimum(np.maximum(weight, 128), 3968)
        # Order 0: the group, then its latest id or another.
        on0 = ~hit
        group = coder.symbol(on0, table, None if came is None else (came >> 8) * on0)
        slot = np.arange(m) * groups + group
        old = latest.take(slot)
        on_old = on0 & (old > 0)
        chance = np.maximum(again.look(blank[:m]), LIMIT)
        hit0 = coder.flag(on_old, chance, None if came is None else on_old & (old == (came & 255) + 1))
        again.learn(on_old, hit0 * np.int32(4000))
        rest = on0 & ~hit0
        place = coder.place(rest, None if came is None else (came & 255) * rest)
        if came is None:
            came = np.where(hit, named, group * GROUP + np.where(hit0, old - 1, place)).astype(np.int32)
        own = came >> 8
        slot = np.arange(m) * groups + own
        latest[slot] = (came & 255) + 1
        counts.ravel()[slot] += 24
        two.learn(came)
        one.learn(came)
        result[t, :m] = came
    return result.T


def encode_blocks(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> list[bytes]:
    """``ids``: lanes by longest; ``lengths`` fall. Payload of each lane."""
    coder = Encoder(len(lengths), int(lengths.max()))
    _run(coder, lengths, -(-vocabulary // GROUP), ids)
    return coder.payloads()


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    return _run(Decoder(payloads), lengths, -(-vocabulary // GROUP), None)
