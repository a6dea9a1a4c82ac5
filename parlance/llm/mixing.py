"""A bitwise language model of texts: context bit predictors mixed by gated logistic weights.

A text is its tokens, each closed by a blank, and one line feed. A token is met in a state: which
letter beyond ASCII the text showed last before it, in 16 classes, or none so far. Every byte is
eight binary decisions, the highest bit first. For each decision six predictors look up how often
either bit followed: by the bits of the byte so far, up to six bytes of the text before it, across
the limits of tokens, and, for half of them, the state. Their log odds are added with weights
picked by a gate, the confidence of the two longest predictors. An adaptive map then corrects the
mixed probability by what really followed such probabilities.

So all that bears on a place is its byte, the six bytes before and the state: eight bytes, its
``place`` (``places``). ``Contexts`` are the decisions of places whose counts ``lm`` has found in the
whole corpus, exactly and by context. ``Decisions`` are those of single tokens over one hashed table in
memory, for trials in one process.
"""

from __future__ import annotations

import numpy as np

#: Bytes looked back on, and whether the state counts too.
PREDICTORS = ((1, False), (1, True), (2, True), (3, False), (4, True), (6, False))
#: Weights before anything is learned.
PRIOR = (0.15, 0.22, 0.28, 0.28, 0.32, 0.25)
PAD = max(order for order, _ in PREDICTORS)
STATES = 17
TABLE_BITS = 21  # slots of each of the two tables: for up to 4 bytes, and for 6
SLOTS = 2 << TABLE_BITS
GATES = 25
STEPS = 24  # of the adaptive map, over log odds from -12 to 12
END = b"\n"
BATCH = 16_384  # places worked on at once
SUMS = len(PREDICTORS) * (1 + len(PREDICTORS)) + 1  # by gate: slope, curve, and what was met
FLOOR = 2.0**-20

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD6E8FEB86659FD93)


class Decisions:
    """All binary decisions of some keys: bits, table slots by predictor, and owners."""

    def __init__(self, keys: list[bytes]):
        closed = [k[1:] if k[1:] == END else k[1:] + b" " for k in keys]
        lengths = np.array([len(t) for t in closed], dtype=np.int64)
        begin = np.cumsum(lengths + PAD) - lengths
        flat = np.zeros(int((lengths + PAD).sum()), np.uint64)
        head = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) - np.repeat(head, lengths) + np.repeat(begin, lengths)
        flat[at] = np.frombuffer(b"".join(closed), dtype=np.uint8)
        flat[begin - 1] = 0x20
        self.owner = np.repeat(np.arange(len(keys)), lengths)
        state = np.array([k[0] + 1 for k in keys], dtype=np.uint64)[self.owner]
        byte = flat[at]
        shift = np.arange(8, dtype=np.uint64)
        self.bit = ((byte[:, None] >> (np.uint64(7) - shift)) & np.uint64(1)).astype(np.float32)
        self.node = (np.uint64(1) << shift) | (byte[:, None] >> (np.uint64(8) - shift))
        context, self.slot = np.zeros(len(at), np.uint64), np.empty((len(PREDICTORS), len(at), 8), np.int32)
        back = 0
        for i, (order, with_state) in enumerate(PREDICTORS):
            while back < order:
                back += 1
                context = context << np.uint64(8) | flat[at - back]
            seed = (context + np.uint64(order << 48) + (state << np.uint64(52) if with_state else np.uint64(0))) * _MULTIPLY
            seed ^= seed >> np.uint64(29)
            mixed = (seed[:, None] + self.node * _NODE) * _MULTIPLY
            mixed = (mixed ^ (mixed >> np.uint64(32))) * _MULTIPLY
            self.slot[i] = (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int32) + (0 if order <= 4 else 1 << TABLE_BITS)

    def counts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        zeros, ones = COUNT[codes[0][self.slot]], COUNT[codes[1][self.slot]]
        bit = self.bit > 0
        return np.where(bit, ones, zeros), np.where(bit, zeros, ones)


def tally(tokens: list[bytes], counts: np.ndarray, table: np.ndarray) -> None:
    """Adds the decisions of the tokens, each ``counts`` times, to ``table`` (bit, slot)."""
    seen = Decisions(tokens)
    weight = np.repeat(counts[seen.owner], 8).astype(np.float64)
    side = (seen.bit.reshape(-1) > 0) * SLOTS
    for slots in seen.slot:
        np.add.at(table.reshape(-1), slots.reshape(-1) + side, weight)


def gate_of(four: np.ndarray, six: np.ndarray) -> np.ndarray:
    """Five steps of confidence for each of the two longest predictors."""
    step = lambda n: (n >= 1).astype(np.int32) + (n >= 4) + (n >= 32) + (n >= 512)
    return step(four) * 5 + step(six)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


STEPS_AN_OCTAVE = 1000


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts in two bytes each: exact up to some hundreds, within 0.04 percent beyond, up to 2**65."""
    return np.rint(STEPS_AN_OCTAVE * np.log2(1.0 + counts)).astype(np.uint16)


#: What a packed count stands for.
COUNT = np.rint(2 ** (np.arange(1 << 16) / STEPS_AN_OCTAVE) - 1).astype(np.float32)


def places(flat: np.ndarray, states: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes of each place: those before it, the next one on top, then its own, then the state."""
    key = flat[at].astype(np.uint64) << np.uint64(8) | states.astype(np.uint64)
    for back in range(1, PAD + 1):
        key |= flat[at - back].astype(np.uint64) << np.uint64(64 - 8 * back)
    return key


def grouped_sums(groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of ``n`` over each run of equal ``groups``, at every place of the run."""
    heads = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.repeat(np.add.reduceat(n, heads), np.diff(np.append(heads, len(groups))))


def context_of(key: np.ndarray, order: int) -> np.ndarray:
    """The bytes of the text before a place that a predictor of this order sees."""
    return key >> np.uint64(64 - 8 * order)


def followers(key: np.ndarray, n: np.ndarray, order: int, with_state: bool) -> np.ndarray:
    """(place, 9): how often the predictor's context was left at each bit of the byte, and how often the byte came.

    ``key`` holds all places of its contexts, each with its count.
    """
    state = key & np.uint64(255) if with_state else np.zeros(len(key), np.uint64)
    byte = key >> np.uint64(8) & np.uint64(255)
    # context, state, byte: at most 8 * 4 + 16 bits with the state, 8 * 6 + 8 without
    merged = context_of(key, order) << np.uint64(16 if with_state else 8) | (state << np.uint64(8) if with_state else np.uint64(0)) | byte
    sort = np.argsort(merged, kind="stable")
    merged, n = merged[sort], n[sort]
    out = np.empty((len(key), 9), np.int64)
    upper = grouped_sums(merged >> np.uint64(8), n)
    for bit in range(8):
        lower = grouped_sums(merged >> np.uint64(7 - bit), n)
        out[sort, bit] = upper - lower
        upper = lower
    out[sort, 8] = upper
    return out


class Contexts:
    """All decisions of some places, with the counts of their predictors (``followers``, packed)."""

    def __init__(self, key: np.ndarray, codes: np.ndarray):
        byte, shift = (key >> np.uint64(8) & np.uint64(255))[:, None], np.arange(8, dtype=np.uint64)
        self.owner = np.arange(len(key))
        self.bit = ((byte >> (np.uint64(7) - shift)) & np.uint64(1)).astype(np.float32)
        self.node = (np.uint64(1) << shift) | (byte >> (np.uint64(8) - shift))
        counts = COUNT[codes.reshape(len(key), len(PREDICTORS), 9).transpose(1, 0, 2)]
        self.other = counts[:, :, :8]
        self.same = np.cumsum(counts[:, :, :0:-1], axis=2)[:, :, ::-1]

    def counts(self, codes: None) -> tuple[np.ndarray, np.ndarray]:
        """How often the bit and how often the other one followed, by predictor."""
        return self.same, self.other


class Model:
    """Weights and adaptive map; a table of counts only for ``Decisions``."""

    def __init__(self, table: np.ndarray | None = None):
        self.codes = None if table is None else packed(table)
        self.weights = np.tile(PRIOR, (GATES, 1))
        self.map = np.zeros((256, STEPS + 1, 2), np.float64)

    def inputs(self, seen: Contexts | Decisions, left_out: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log odds by predictor and the gate of each decision.

        ``left_out``: as they would be without one occurrence of the place itself, so that a
        learned place is met as a new text would meet it.
        """
        same, other = seen.counts(self.codes)
        if left_out:
            same = np.maximum(same - 1, 0)
        odds = np.log((same + np.float32(0.4)) / (other + np.float32(0.4)))
        total = same[-2:] + other[-2:]
        return np.where(seen.bit > 0, odds, -odds), gate_of(total[0], total[1])

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights = self.weights.astype(np.float32)
        out = np.zeros(gate.shape, np.float32)
        for i in range(len(PREDICTORS)):
            out += weights[gate, i] * odds[i]
        return np.clip(out, -12, 12)

    def slopes(self, seen: Contexts | Decisions, counts: np.ndarray) -> np.ndarray:
        """By gate: slope and curve of the loss over these decisions, and how much was met; sums can be added up."""
        odds, gate, p, weight = self._left_out(seen, counts)
        flat = gate.reshape(-1)
        error, bend = ((seen.bit - p) * weight).reshape(-1), (np.maximum(p * (1 - p), 0.002) * weight).reshape(-1)
        inputs = odds.reshape(len(PREDICTORS), -1)
        out = np.zeros((GATES, SUMS))
        for i in range(len(PREDICTORS)):
            out[:, i] = np.bincount(flat, error * inputs[i], GATES)
            bent = bend * inputs[i]
            for j in range(i + 1):
                sums = np.bincount(flat, bent * inputs[j], GATES)
                out[:, len(PREDICTORS) * (1 + i) + j] = out[:, len(PREDICTORS) * (1 + j) + i] = sums
        out[:, -1] = np.bincount(flat, bend, GATES)
        return out

    def step(self, sums: np.ndarray) -> None:
        """A Newton step by gate."""
        n = len(PREDICTORS)
        damped = sums[:, n:-1].reshape(GATES, n, n) + (0.01 * sums[:, -1] + 1.0)[:, None, None] * np.eye(n)
        self.weights = self.weights + np.linalg.solve(damped, sums[:, :n, None])[:, :, 0]

    def followed(self, seen: Contexts | Decisions, counts: np.ndarray) -> np.ndarray:
        """For the adaptive map: which bit followed which mixed probability."""
        _, _, p, weight = self._left_out(seen, counts)
        mixed = np.log(p / (1 - p))
        step = np.clip(np.rint((mixed + 12) * (STEPS / 24)), 0, STEPS).astype(np.int64)
        cell = ((seen.node.astype(np.int64) * (STEPS + 1) + step) * 2 + seen.bit.astype(np.int64)).reshape(-1)
        return np.bincount(cell, np.broadcast_to(weight, p.shape).reshape(-1), self.map.size).reshape(self.map.shape)

    def _left_out(self, seen: Contexts | Decisions, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        odds, gate = self.inputs(seen, True)
        return odds, gate, squash(self.mixed(odds, gate)), counts[seen.owner].astype(np.float32)[:, None]

    def learn(self, tokens: list[bytes], counts: np.ndarray) -> None:
        """One step on tokens of the table in memory, and the adaptive map after it."""
        seen = Decisions(tokens)
        self.step(self.slopes(seen, counts))
        self.map = self.map + self.followed(seen, counts)

    def log10(self, seen: Contexts) -> np.ndarray:
        """log10 probability of the byte of each place."""
        odds, gate = self.inputs(seen, False)
        mixed = self.mixed(odds, gate)
        place = (mixed + 12) * (STEPS / 24)
        low = np.minimum(place.astype(np.int64), STEPS - 1)
        part, node = place - low, seen.node.astype(np.int64)
        corrected = self._corrections()
        adapted = corrected[node, low] * (1 - part) + corrected[node, low + 1] * part
        p = np.clip((squash(mixed) + 3 * adapted) / 4, FLOOR, 1 - FLOOR)
        return np.log10(np.where(seen.bit > 0, p, 1 - p)).sum(axis=1)

    def _corrections(self) -> np.ndarray:
        """Probability of a one by node and step, drawn to the step's own where little was seen."""
        own = squash(np.arange(STEPS + 1) * (24 / STEPS) - 12)
        return (self.map[:, :, 1] + 8 * own) / (self.map.sum(axis=2) + 8)
