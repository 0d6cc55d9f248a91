"""Words, lines and their hashes for a batch of texts at once, in numpy.

The texts of a batch are joined with newlines into one byte buffer; word bounds come from a table of
word bytes, and hashes from sums of bytes times powers of an odd constant, modulo 2^64. No Python
loop runs over words. Work goes through the buffer in pieces, so a very long text costs a few times
its own size and no more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECE = 1 << 21
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)


def table(pattern: str) -> np.ndarray:
    """Which of the 256 bytes are word bytes; "ascii_space": all but space and \\t to \\r; "alnum":
    0-9, a-z and every byte of a character past ASCII (texts have A-Z lowered before)."""
    out = np.zeros(256, dtype=bool)
    if pattern == "ascii_space":
        out[:] = True
        out[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        out[0x30:0x3A] = out[0x61:0x7B] = True
        out[0x80:] = True
    else:
        raise ValueError(pattern)
    return out


SPACED = table("ascii_space")
ALNUM = table("alnum")
#: Bytes that begin a character.
FIRST = (np.arange(256) & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (finalizer with two odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        base = np.full(max(n, 1 << 12), _BASE, dtype=np.uint64)
        base[0] = 1
        _powers = np.cumprod(base, dtype=np.uint64)
    return _powers[:n]


def _hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run [start, end) of the buffer; runs are disjoint, ordered and not empty."""
    out = np.empty(len(starts), dtype=np.uint64)
    lens = ends - starts
    total = np.concatenate([[0], np.cumsum(lens)])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, side="right")) - 1)
        n, first = lens[at:to], total[at:to] - total[at]
        inside = np.arange(int(total[to] - total[at])) - np.repeat(first, n)
        values = buf[np.repeat(starts[at:to], n) + inside].astype(np.uint64) + np.uint64(1)
        values *= powers(int(n.max()))[inside]
        out[at:to] = mix(np.add.reduceat(values, first) + n.astype(np.uint64))
        at = to
    return out


@dataclass
class Batch:
    buf: np.ndarray  #: bytes of all texts, each followed by a newline
    doc_at: np.ndarray  #: where each text starts, and the end
    starts: np.ndarray  #: of words
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray  #: index of the text of each word

    @property
    def n(self) -> int:
        return len(self.doc_at) - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked in mask."""
        return np.add.reduceat(mask, self.doc_at[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def words_in(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n).astype(np.int64)


def pack(texts: list[bytes], word: np.ndarray, hashed: bool = True) -> Batch:
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    doc_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = np.empty(len(buf) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = word[buf]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[::2], turns[1::2]
    doc = np.searchsorted(doc_at, starts, side="right") - 1
    return Batch(buf, doc_at, starts, ends, _hash_runs(buf, starts, ends) if hashed else np.zeros(0, np.uint64), doc)


def lines(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc, hash) of each line with a word in it."""
    ends = np.flatnonzero(b.buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    # a line has a word if a word starts in it
    has = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
    starts, ends = starts[has], ends[has]
    return starts, ends, np.searchsorted(b.doc_at, starts, side="right") - 1, _hash_runs(b.buf, starts, ends)


def grams(b: Batch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each window of n words of one text; rolls on from word hashes."""
    m = len(b.hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = powers(n)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h += b.hashes[k : k + m] * p[k]
    at = np.flatnonzero(b.doc[:m] == b.doc[n - 1 :])
    return at, mix(h[at])


def repeated(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (text, hash) pairs: whether the pair occurs twice or more, and whether it occurred before."""
    key = mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    twice, before = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    twice[order] = same[1:] | same[:-1]
    before[order] = same[:-1]
    return twice, before


def slices(texts: list[bytes], limit: int = PIECE) -> list[tuple[int, int]]:
    """Runs of texts of about `limit` bytes together, each of one text at least."""
    out, at, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            out.append((at, i))
            at, size = i, 0
        size += len(t) + 1
    return out + ([(at, len(texts))] if at < len(texts) else [])
