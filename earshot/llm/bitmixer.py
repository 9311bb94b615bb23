"""Logistic mixing of hashed-context bit predictors over token spellings.

A token is spelled by its bytes and a terminator, each byte by eight binary
decisions.  ``ORDERS`` contexts (the last bytes inside the token) each predict a
decision from the counts of zeros and ones in their hashed slot.  The predictions,
in the logistic domain, are combined with weights chosen by a gate (the number of
contexts that have been seen, and the bit's place), learnt by gradient steps over all
tokens, and the result is refined by an adaptive probability map.

``repeats`` mixes predictors of one more decision along a running text: whether the next
token is the one that followed the last two, or three, tokens before.
"""

from __future__ import annotations

import numpy as np

ORDERS = (1, 2, 3, 4, 6)
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
RATE, STEP = 0.002, 1024
CELLS, SPAN = 24, 12.0
_END = 10
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def spell(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bytes with terminators, the start of each token, and the contexts of each byte."""
    x = np.frombuffer(b"\n".join(tokens) + b"\n", np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(x == _END)[:-1] + 1])
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(x)]])))
    context, out = np.zeros(len(x), np.uint64), []
    for k in range(1, max(ORDERS) + 1):
        before = np.zeros(len(x), np.uint64)
        before[k:] = x[:-k] if k < len(x) else 0
        before[place < k] = 0
        context = context | before << np.uint64(8 * (k - 1))
        if k in ORDERS:
            out.append(context * _C[len(out)] + np.uint64(k))
    return x, starts, out


#: Of bit and byte, the hash of the bits before.
_NODES = np.array([[(1 << j) | b >> (8 - j) for b in range(256)] for j in range(8)], np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def slots(context: np.ndarray, x: np.ndarray, j: int) -> np.ndarray:
    h = context ^ _NODES[j][x]
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h >>= np.uint64(64 - SLOT_BITS)
    return h.view(np.int64)


def chunks(tokens: list[bytes], size: int = 1 << 16):
    for i in range(0, len(tokens), size):
        yield tokens[i : i + size]


def count_bits(tokens: list[bytes], counts: np.ndarray) -> None:
    """Add the spellings' decisions to ``counts`` (orders, slots, 2)."""
    flat = counts.reshape(len(ORDERS), -1)
    for part in chunks(tokens):
        x, _, contexts = spell(part)
        for j in range(8):
            bit = (x >> (7 - j) & 1).astype(np.int64)
            for k, c in enumerate(contexts):
                flat[k] += np.bincount(slots(c, x, j) * 2 + bit, minlength=2 * SLOTS).astype(counts.dtype)


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class BitMixer:
    def __init__(self, counts: np.ndarray):
        self.counts = counts
        n = len(ORDERS)
        self.weights = np.full(((n + 1) * 8, n), 0.4)
        centre = (np.arange(CELLS) + 0.5) * 2 * SPAN / CELLS - SPAN
        self.map = np.repeat(_squash(centre)[None], 8, axis=0)
        self._stretched: np.ndarray | None = None
        #: The same without a decision of zero, or of one: by slot and decision.
        self._without: list[np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_stretched": None, "_seen": None, "_without": None}

    def inputs(self, x: np.ndarray, contexts: list[np.ndarray], j: int, left_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decisions, stretched predictions (orders, bytes) and gates."""
        if self._stretched is None:  # one a process
            self._stretched, self._seen = self._read(*(self.counts[..., i].astype(np.float32) for i in (0, 1)))
        if left_out and self._without is None:
            zeros, ones = (self.counts[..., i].astype(np.float32) for i in (0, 1))
            less = [self._read(np.maximum(zeros - (1 - b), 0), np.maximum(ones - b, 0)) for b in (np.float32(0), np.float32(1))]
            self._without = [np.stack([x[i] for x in less], axis=-1).reshape(len(ORDERS), -1) for i in range(2)]
        stretched, known = self._without if left_out else (self._stretched, self._seen)
        bit = (x >> (7 - j) & 1).astype(np.int64)
        ins = np.empty((len(ORDERS), len(x)), np.float32)
        seen = np.zeros(len(x), np.int64)
        for k, c in enumerate(contexts):
            at = slots(c, x, j)
            if left_out:
                at = 2 * at + bit
            ins[k] = stretched[k][at]
            seen += known[k][at]
        return bit, ins, seen * 8 + j

    @staticmethod
    def _read(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions of slots, and which of them have been seen."""
        return np.log((ones + np.float32(0.3)) / (zeros + np.float32(0.3))), zeros + ones > 0

    def _mixed(self, gate: np.ndarray, ins: np.ndarray) -> np.ndarray:
        """Predictions times the weights of their gates, summed order by order."""
        z = np.zeros(len(gate))
        for w, v in zip(np.ascontiguousarray(self.weights.T), ins, strict=True):
            z += w[gate] * v
        return z

    def _cell(self, z: np.ndarray) -> np.ndarray:
        return np.clip(((z + SPAN) * CELLS / (2 * SPAN)).astype(int), 0, CELLS - 1)

    def learn(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Weights by gradient steps in the order of the tokens; gives for every cell of
        the map its decisions and its ones.  A token's own decisions are left out of the
        counts."""
        cells = np.zeros((2, 8 * CELLS))
        for part in chunks(tokens, 1 << 12):
            x, _, contexts = spell(part)
            parts = [self.inputs(x, contexts, j, True) for j in range(8)]
            bit, gate = (np.stack([p[i] for p in parts], axis=1).ravel() for i in (0, 2))
            ins = np.stack([p[1] for p in parts], axis=2).reshape(len(ORDERS), -1)
            for i in range(0, len(bit), STEP):
                g, v, y = gate[i : i + STEP], ins[:, i : i + STEP], bit[i : i + STEP]
                error = RATE * (y - _squash(self._mixed(g, v)))
                for k in range(len(ORDERS)):
                    self.weights[:, k] += np.bincount(g, error * v[k], len(self.weights))
            at = np.tile(np.arange(8), len(x)) * CELLS + self._cell(self._mixed(gate, ins))
            cells += np.stack([np.bincount(at, minlength=8 * CELLS), np.bincount(at, bit, 8 * CELLS)])
        return cells

    def refine(self, cells: np.ndarray) -> None:
        """The map from the decisions and ones of its cells."""
        n, ones = cells.reshape(2, 8, CELLS)
        self.map = (ones + 20 * self.map) / (n + 20)

    def log10(self, tokens: list[bytes]) -> np.ndarray:
        """log10 probability of each token's spelling."""
        out = []
        for part in chunks(tokens, 1 << 13):
            x, starts, contexts = spell(part)
            total = np.zeros(len(x))
            for j in range(8):
                bit, ins, gate = self.inputs(x, contexts, j, False)
                z = self._mixed(gate, ins)
                p = 0.5 * (_squash(z) + self.map[j][self._cell(z)])
                p = np.clip(p, 1e-6, 1 - 1e-6)
                total += np.log10(np.where(bit == 1, p, 1 - p))
            out.append(np.add.reduceat(total, starts))
        return np.concatenate(out) if out else np.zeros(0)


#: Tokens after which the weights of ``repeats`` move, and how far.
TURN, PACE = 32, 0.02


def _follow(at: np.ndarray, context: np.ndarray, then: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts into ``out``, for each place, what followed (``then``) the last earlier place of
    equal context.  ``at`` ascends where contexts are equal.  Gives the places by context
    and which of them equal the one before."""
    order = np.argsort(context, kind="stable")
    by, context = at[order], context[order]
    same = context[1:] == context[:-1]
    out[by[1:][same]] = then[by[:-1][same]]
    return by, same


def _adapted(text: np.ndarray, gate: np.ndarray, bit: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Stretched share of ones among the earlier decisions of each decision's gate in its text, begun
    with two decisions at the prior."""
    key = text * len(prior) + gate
    order = np.argsort(key, kind="stable")
    g, y = key[order], bit[order].astype(np.int64)
    place = np.arange(len(g))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), place, 0))
    before = np.cumsum(y) - y
    p = (before - before[first] + 2 * prior[gate[order]]) / (place - first + 2)
    out = np.empty(len(bit))
    out[order] = np.log(p / (1 - p))
    return out


_RUN = 1 - 0.9 / (1 + 2 * np.arange(16))
_AGREE = np.array([0.2, 0.05, 0.8])


def repeats(token: np.ndarray, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of a text whose last two tokens stood there before, whether the next one
    did follow as the last time, and the probability given to that.

    Two predictors, of hits by the length of the present run of hits and of hits by what
    the last three tokens say, adapt along the text, as do the weights they are mixed by.
    ``text`` (ascending, one text after the other) has each token's text; each text is for itself."""
    text = np.zeros(len(token), np.int64) if text is None else text
    # Places of which the two tokens before are of the same text.
    own = np.flatnonzero(text[2:] == text[:-2])
    none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
    if not len(own):
        return none
    wide, then, of = int(token.max()) + 1, token[2:], text[own]
    two, three = np.full((2, len(then)), -1, np.int64)
    # Contexts are named by number, so that texts and tokens together stay within a long.
    name = np.unique(token[own] * wide + token[own + 1], return_inverse=True)[1]
    by, same = _follow(own, of * (int(name.max()) + 1) + name, then, two)
    if not same.any():
        return none
    # Three tokens can repeat only where two do.
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    pair = np.cumsum(np.concatenate([[True], ~same]))[again]
    by = by[again]
    first = (by == 0) | (text[by] != text[np.maximum(by, 1) - 1])
    _follow(by[~first], (pair * wide + token[by - 1])[~first], then, three)
    at = np.flatnonzero(two >= 0)
    hit = two == then
    place = np.arange(len(two))
    begin = np.searchsorted(text, text[at])
    missed = np.maximum.accumulate(np.where(hit, -1, place))
    run = np.minimum(np.where(at > 0, at - 1 - np.concatenate([[-1], missed[:-1]])[at], 0), at - begin)
    said = np.where(three[at] < 0, 0, np.where(three[at] == two[at], 2, 1))
    bit, of = hit[at], text[at]
    ins = np.stack([_adapted(of, np.minimum(run, 15), bit, _RUN), _adapted(of, said, bit, _AGREE)], axis=1)
    # The turns of all texts go side by side.
    start = np.searchsorted(of, of)
    turn = (np.arange(len(of)) - start) // TURN
    order = np.argsort(turn, kind="stable")
    cuts = np.searchsorted(turn[order], np.arange(int(turn[order[-1]]) + 2))
    names, line = np.unique(of, return_inverse=True)
    weights, p = np.full((len(names), 2), 0.6), np.empty(len(at))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        now = order[a:b]
        mine, v = line[now], ins[now]
        p[now] = _squash((v * weights[mine]).sum(axis=1))
        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        weights[mine[heads]] += PACE * np.add.reduceat((bit[now] - p[now])[:, None] * v, heads, axis=0)
    return at + 2, bit, np.clip(p, 1e-5, 1 - 1e-5)
