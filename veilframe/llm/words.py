"""Words of whole Arrow batches as 64-bit hashes, by numpy on the text's bytes.

A byte table says which bytes separate words and folds case. A word's hash is a
polynomial over its bytes, taken from running sums, so cost is linear in the
bytes and no Python object is made per word. Texts are taken up in pieces of
about ``PIECE`` bytes, cut between texts or, within a long text, at a separator:
memory is bounded by the piece (or by one word that is longer than that) plus 8
bytes per word of the texts in hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_SPACE = 0x20
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # 5 modulo 8
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def byte_table(separators: bytes, lower: bool = True) -> bytes:
    """Separators to a space, A-Z to a-z; all other bytes stay."""
    table = bytearray(range(256))
    if lower:
        for a, b in zip(_UPPER, _LOWER, strict=True):
            table[a] = b
    for b in separators:
        table[b] = _SPACE
    return bytes(table)


#: Words are runs without white space.
BLANKS = byte_table(b" \t\n\x0b\x0c\r")
#: Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALNUM = byte_table(
    bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
)


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if n <= 2 * PIECE:
            _powers[kind] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(raw: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words in ``raw``; no word crosses a break."""
    a = np.frombuffer(raw, dtype=np.uint8)
    n = len(a)
    inside = a != _SPACE
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[(breaks >= 0) & (breaks < n)]
    first[breaks] = inside[breaks]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), none, none
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = breaks[breaks > 0] - 1
    last[inner] = inside[inner]
    ends = np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[a] * _power("up", _BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power("down", _INVERSE, n)[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts, ends


def _cuts(raw: bytes, bounds: np.ndarray) -> list[int]:
    """Where to cut: after about PIECE bytes, at a text's start or a separator."""
    cuts, at, total = [0], 0, len(raw)
    while total - at > PIECE:
        k = int(np.searchsorted(bounds, at + PIECE, side="right")) - 1
        if bounds[k] > at:
            at = int(bounds[k])
        else:  # inside one long text
            gap = raw.rfind(b" ", at + 1, at + PIECE)
            if gap < 0:
                gap = raw.find(b" ", at + PIECE)
                after = int(bounds[min(k + 1, len(bounds) - 1)])
                gap = after if gap < 0 or gap > after else gap
            at = gap
        cuts.append(at)
    if cuts[-1] != total:
        cuts.append(total)
    return cuts


class Words:
    """The words of ``count`` texts: ``hashes`` and where each text's begin."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, spans=None):
        self.hashes, self.offsets, self.spans = hashes, offsets, spans

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]

    def owner(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))


def _buffers(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of an Arrow text column, null as empty, and where texts begin."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return b"", np.zeros(len(texts) + 1, dtype=np.int64)
    return memoryview(data)[bounds[0] : bounds[-1]].tobytes(), bounds - bounds[0]


def words(texts: pa.Array, table: bytes, spans: bool = False) -> Words:
    """All words of an Arrow text column."""
    raw, bounds = _buffers(texts)
    raw = raw.translate(table)
    hashes, starts, ends = [], [], []
    cuts = _cuts(raw, bounds)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        b = bounds[np.searchsorted(bounds, lo) : np.searchsorted(bounds, hi)] - lo
        h, s, e = _piece(raw[lo:hi], b)
        hashes.append(h)
        starts.append(s + lo)
        ends.append(e + lo)
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    offsets = np.searchsorted(s, bounds)
    return Words(h, offsets, (s, np.concatenate(ends), raw) if spans and ends else None)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
            texts.offset : texts.offset + len(texts) + 1
        ] if len(texts) else np.zeros(1, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def shingles(doc: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text is one run, none has none."""
    n = len(doc)
    if n == 0:
        return doc
    width = min(size, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + doc[i : n - width + 1 + i]
    return mixed(out + np.uint64(width))
