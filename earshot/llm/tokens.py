"""Vectorised token hashing over UTF-8 buffers."""

from __future__ import annotations

import re

import numpy as np

#: Punctuation and blanks beyond ASCII, which part tokens, and scripts without blanks,
#: of which each character is a token.
_PARTING = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\ufe10-\ufe6f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_DENSE = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PIECE = 1 << 20
_MIX = np.uint64(0xFF51AFD7ED558CCD)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POW = _powers(_PIECE + 1, _BASE)
_INV = _powers(_PIECE + 1, pow(_BASE, -1, 1 << 64))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        _POW, _INV = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
    return _POW, _INV


_SPACED = np.ones(256, bool)
_SPACED[[*range(9, 14), 32]] = False


def _hash_piece(x: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word[x], [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    pow_, inv = _tables(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * pow_[: len(x)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, starts


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts in a row, and the index of each token's
    text.  Tokens are lower-cased runs of letters and digits (and of what else is beyond
    ASCII but punctuation); a character of a script without blanks is a token."""

    def plain(t: str) -> str:
        return t if t.isascii() else _DENSE.sub(r" \1 ", _PARTING.sub(" ", t))

    return _hashes([plain((t or "").lower()).encode("utf-8", "replace") for t in texts], _WORD)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The same of words parted by ASCII white space, A-Z lower-cased."""
    return _hashes([(t or b"").lower() for t in texts], _SPACED)


def _hashes(raw: list[bytes], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    hashes, starts, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + _PIECE)
        while end < len(buf) and word[buf[end]] and word[buf[end - 1]]:  # no token is cut
            end += 1
        h, s = _hash_piece(buf[at:end], word)
        hashes.append(h)
        starts.append(s + at)
        at = end
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(first, s, side="right") - 1


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` tokens."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    return out


def slices_of(texts: list, limit: int = 1 << 22):
    """Index ranges of texts of about ``limit`` characters together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
