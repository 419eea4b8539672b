"""Finding the terms of a long list in texts, batch by batch, in linear time.

An index of terms is a few flat arrays. Every term is represented by its run of
characters (``WIDTHS``) that is rarest in the list. A text's runs are hashed by
running sums, and a bit table lets through those that may be some term's; for
these few places the index gives the lengths and offsets of the terms with that
run, and a hash of the whole candidate tells whether a term stands there. Each hit
is then compared character by character, so hashes never decide. The cost is
linear in the text, whatever the number of terms and however many share a
beginning.

Letters are compared as a pattern that ignores case does: by the lower case of
their upper case, one character for one character, so that offsets are those of
the original text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTHS = (1, 2, 3, 4, 8)
_WINDOW = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BETWEEN = 0x110000  # stands between texts; no character
_CASED = 0x20000  # no letter from here on has a case
_tables: dict[str, np.ndarray] = {}


def _fold_table() -> np.ndarray:
    """By code point: the lower case of the upper case, where both are one character."""
    if "fold" not in _tables:
        table = np.arange(_BETWEEN + 1, dtype=np.uint32)
        for code in range(_CASED):
            c = chr(code)
            upper = c.upper()
            lower = (upper if len(upper) == 1 else c).lower()
            if len(lower) == 1:
                table[code] = ord(lower)
        table[0x130] = ord("i")  # its lower case is two characters, but it equals one i
        _tables["fold"] = table
    return _tables["fold"]


def folded(text: str) -> np.ndarray:
    """Code points of a text without regard to case."""
    return _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _tables.get(kind)
    if have is None or len(have) < n:
        have = np.full(n, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _tables[kind] = have
    return have[:n]


def _sums(codes: np.ndarray) -> np.ndarray:
    """Running sums from which every run's hash follows."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(codes)), out=out[1:])
    return out


def _hash(sums: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hashes of runs by start and length (one length, or one per run)."""
    down = _powers("down", _INVERSE, len(sums))
    x = (sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and count: owner and index of every element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return owner, first + np.arange(len(owner))


@dataclass(frozen=True)
class TermIndex:
    """Terms as arrays, in order of length (longest first) and then of characters."""

    codes: np.ndarray  # all terms' folded characters
    starts: np.ndarray  # where each term begins there, and the end
    hashes: np.ndarray  # sorted hashes of whole terms
    of_hash: np.ndarray  # the term of each
    widths: tuple[int, ...]
    runs: np.ndarray  # sorted distinct hashes of the representing runs
    shapes_at: np.ndarray  # where each run's shapes begin, and the end
    shapes: np.ndarray  # (offset of the run in the term, length of the term)
    bits: np.ndarray  # one bit per value of a run's leading hash bits
    shift: int

    @classmethod
    def of(cls, terms: Iterable[str]) -> TermIndex:
        """Index of the distinct terms; empty ones never match."""
        plain = [t for t in terms if t]
        every = np.append(np.cumsum([len(t) for t in plain], dtype=np.int64), 0)
        raw = folded("".join(plain)).astype(">u4").tobytes()  # in this order bytes sort as characters do
        keys = {raw[4 * every[i - 1] : 4 * every[i]] for i in range(len(plain))}
        found = sorted(keys, key=lambda k: (-len(k), k))
        lengths = np.array([len(k) // 4 for k in found], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.frombuffer(b"".join(found), ">u4").astype(np.uint32)
        sums = _sums(codes) if len(codes) else np.zeros(1, dtype=np.uint64)
        whole = _hash(sums, starts[:-1], lengths) if found else np.zeros(0, dtype=np.uint64)
        order = np.argsort(whole, kind="stable")
        wide = np.array(WIDTHS)[np.searchsorted(WIDTHS, lengths, side="right") - 1] if found else lengths
        owner, at = _spread(starts[:-1], lengths - wide + 1)
        run = _hash(sums, at, wide[owner]) if found else np.zeros(0, dtype=np.uint64)
        _, inverse, often = np.unique(run, return_inverse=True, return_counts=True)
        # each term's rarest run, the first of equals
        pick = np.lexsort((at, often[inverse], owner))
        pick = pick[np.flatnonzero(np.diff(owner[pick], prepend=-1))]
        shapes = np.stack([at[pick] - starts[:-1], lengths], axis=1) if found else np.zeros((0, 2), np.int64)
        table = np.stack([run[pick].view(np.int64), shapes[:, 0], shapes[:, 1]], axis=1)
        table = table[np.lexsort((shapes[:, 1], shapes[:, 0], run[pick]))]
        table = table[(np.diff(table, axis=0, prepend=-1) != 0).any(axis=1)] if len(table) else table
        runs, firsts = np.unique(table[:, 0].copy().view(np.uint64), return_index=True)
        size = max(10, (16 * max(1, len(runs)) - 1).bit_length())
        shift = 64 - size
        bits = np.zeros(1 << size, dtype=bool)
        bits[runs >> np.uint64(shift)] = True
        return cls(
            codes, starts, whole[order], order, tuple(sorted(set(wide.tolist()))), runs,
            np.append(firsts, len(table)), table[:, 1:],
            np.packbits(bits, bitorder="little"), shift,
        )

    def _places(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of candidates: where a representing run stands, by its terms' shapes."""
        out_start, out_length, n = [], [], len(sums) - 1
        for width in self.widths:
            if n < width:
                continue
            hashes = _hash(sums, np.arange(n - width + 1), width)
            slot = hashes >> np.uint64(self.shift)
            passed = np.flatnonzero(self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            at = np.searchsorted(self.runs, hashes[passed])
            known = at < len(self.runs)
            known[known] = self.runs[at[known]] == hashes[passed][known]
            passed, at = passed[known], at[known]
            owner, shape = _spread(self.shapes_at[at], self.shapes_at[at + 1] - self.shapes_at[at])
            start, length = passed[owner] - self.shapes[shape, 0], self.shapes[shape, 1]
            inside = (start >= 0) & (start + length <= n)
            out_start.append(start[inside])
            out_length.append(length[inside])
        if not out_start:
            none = np.zeros(0, dtype=np.int64)
            return none, none
        return np.concatenate(out_start), np.concatenate(out_length)

    def _same(self, codes: np.ndarray, start: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether a term stands at a start, character by character."""
        good = np.zeros(len(start), dtype=bool)
        lengths = self.starts[term + 1] - self.starts[term]
        for length in np.unique(lengths):
            these, step = np.flatnonzero(lengths == length), max(1, (1 << 20) // int(length))
            places = np.arange(length)
            for lo in range(0, len(these), step):
                some = these[lo : lo + step]
                here = codes[start[some][:, None] + places]
                there = self.codes[self.starts[term[some]][:, None] + places]
                good[some] = (here == there).all(axis=1)
        return good

    def _window(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = _sums(codes)
        start, length = self._places(sums)
        hashes = _hash(sums, start, length)
        at = np.searchsorted(self.hashes, hashes)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == hashes[hit]
        start, length, at = start[hit], length[hit], at[hit]
        # terms of one hash, if there are several, are tried in turn
        ends = np.searchsorted(self.hashes, self.hashes[at], side="right")
        owner, which = _spread(at, ends - at)
        start, length, term = start[owner], length[owner], self.of_hash[which]
        fits = self.starts[term + 1] - self.starts[term] == length
        start, term = start[fits], term[fits]
        good = self._same(codes, start, term)
        return start[good], term[good]

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, term) of all occurrences in folded characters, in order of term and start."""
        if not len(self.hashes) or not len(codes):
            none = np.zeros(0, dtype=np.int64)
            return none, none
        longest = int(self.starts[1] - self.starts[0])
        starts, terms = [], []
        for lo in range(0, len(codes), _WINDOW):
            start, term = self._window(codes[lo : lo + _WINDOW + longest - 1])
            own = start < _WINDOW
            starts.append(start[own] + lo)
            terms.append(term[own])
        start, term = np.concatenate(starts), np.concatenate(terms)
        pairs = np.unique(np.stack([term, start], axis=1), axis=0)
        return self._apart(pairs[:, 1], pairs[:, 0])

    def _apart(self, start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each term that do not overlap, from the left."""
        length = self.starts[term + 1] - self.starts[term]
        close = np.zeros(len(start), dtype=bool)
        close[1:] = (term[1:] == term[:-1]) & (start[1:] < start[:-1] + length[1:])
        if not close.any():
            return start, term
        keep = np.ones(len(start), dtype=bool)
        free = 0
        for i in np.flatnonzero(close | np.append(close[1:], False)):
            if not close[i]:
                free = start[i] + length[i]  # the first of a chain of touching ones
            elif start[i] < free:
                keep[i] = False
            else:
                free = start[i] + length[i]
        return start[keep], term[keep]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Bits of a filter: at least, at most (128 MB), and per term in between.
LEAST_BITS, MOST_BITS, BITS_A_TERM = 16, 30, 16
_WHOLES = 4
BUCKET = 1 << 15  # bits that go together while a filter is built


@dataclass(frozen=True)
class TermFilter:
    """A bit table that lets through where a term of a list may stand, whatever the list's length.

    A term has a bit by its last run of characters (``WIDTHS``), one by that and its
    length, and ``_WHOLES`` by all its characters. No term is missed; what else passes
    is for a join with the list to tell. Its size is bounded: beyond ``MOST_BITS`` it lets
    more through.
    """

    lengths: tuple[int, ...]  # of terms, sorted
    size: int  # two to this power are the bits
    bits: np.ndarray

    @staticmethod
    def size_for(terms: int) -> int:
        return min(MOST_BITS, max(LEAST_BITS, (BITS_A_TERM * terms).bit_length()))

    @staticmethod
    def of_run(run: np.ndarray, size: int) -> np.ndarray:
        return (run >> np.uint64(64 - size)).astype(np.int64)

    @staticmethod
    def of_length(run: np.ndarray, lengths, size: int) -> np.ndarray:
        more = np.asarray(lengths).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (_mixed(run ^ more) >> np.uint64(64 - size)).astype(np.int64)

    @staticmethod
    def of_whole(whole: np.ndarray, i: int, size: int) -> np.ndarray:
        more = np.uint64((0xA0761D6478BD642F * (i + 1)) % 2**64)
        return (_mixed(whole + more) >> np.uint64(64 - size)).astype(np.int64)

    @classmethod
    def buckets(cls, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        """Folded terms to ``bucket, bits``: the parts of the bit table that they set."""
        table = np.zeros(1 << (size - 3), dtype=np.uint8)
        for batch in _slices(batches, "term", 4 << 20):
            plain = batch.column(batch.schema.get_field_index("term")).to_pylist()
            lengths = np.array([len(t) for t in plain], dtype=np.int64)
            starts = np.cumsum(lengths) - lengths
            sums = _sums(np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32))
            wide = np.array(WIDTHS)[np.searchsorted(WIDTHS, lengths, side="right") - 1]
            run, whole = _hash(sums, starts + lengths - wide, wide), _hash(sums, starts, lengths)
            for at in (cls.of_run(run, size), cls.of_length(run, lengths, size),
                       *(cls.of_whole(whole, i, size) for i in range(_WHOLES))):
                np.bitwise_or.at(table, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        parts = table.reshape(-1, BUCKET >> 3)
        used = np.flatnonzero(parts.any(axis=1))
        for lo in range(0, len(used), 1024):
            some = used[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array([parts[b].tobytes() for b in some], pa.binary())], names=["bucket", "bits"]
            )

    def _set(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def _window(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, n, out = _sums(codes), len(codes), []
        of_width: dict[int, list[int]] = {}
        for length in self.lengths:
            of_width.setdefault(max(w for w in WIDTHS if w <= length), []).append(length)
        for width, lengths in of_width.items():
            if n < width:
                continue
            runs = _hash(sums, np.arange(n - width + 1), width)
            at = np.flatnonzero(self._set(self.of_run(runs, self.size)))
            runs = runs[at]
            for length in lengths:
                some = self._set(self.of_length(runs, length, self.size)) & (at + width >= length)
                start = at[some] + width - length
                whole = _hash(sums, start, length)
                for i in range(_WHOLES):
                    fits = self._set(self.of_whole(whole, i, self.size))
                    start, whole = start[fits], whole[fits]
                out.append((start, np.full(len(start), length)))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([none, *(o[i] for o in out)]) for i in (0, 1))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of all places that pass, by start."""
        starts, lengths = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo in range(0, len(codes) if self.lengths else 0, _WINDOW):
            start, length = self._window(codes[lo : lo + _WINDOW + self.lengths[-1] - 1])
            own = start < _WINDOW
            starts.append(start[own] + lo)
            lengths.append(length[own])
        start, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(start, kind="stable")
        return start[order], length[order]

    def candidates(
        self, batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20
    ) -> Iterator[tuple[pa.RecordBatch, list[int], list[tuple[str, int, int, str]]]]:
        """Batches with the row and (folded, start, end, value) of what may be a term.

        Those of equal characters do not overlap: they are taken from the left.
        """
        between = np.array([_BETWEEN], dtype=np.uint32)
        for batch in _slices(batches, column, most):
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            parts, bounds = [], [0]
            for text in texts:
                codes = folded(text) if text else np.zeros(0, dtype=np.uint32)
                parts += [codes, between]
                bounds.append(bounds[-1] + len(codes) + 1)
            codes, begins = np.concatenate(parts), np.array(bounds, dtype=np.int64)
            start, length = self.find(codes)
            row = np.searchsorted(begins, start, side="right") - 1
            inside = start + length < begins[row + 1]  # before what stands between texts
            rows, found, free = [], [], {}
            for r, at, n in zip(row[inside].tolist(), start[inside].tolist(), length[inside].tolist(), strict=True):
                term = codes[at : at + n].astype("<u4").tobytes().decode("utf-32-le")
                if free.get((r, term), 0) <= at:
                    free[r, term] = at + n
                    here = at - bounds[r]
                    rows.append(r)
                    found.append((term, here, here + n, texts[r][here : here + n]))
            yield batch, rows, found


_SPAN = pa.struct(
    [
        ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
        ("confidence", pa.float64()), ("detector_name", pa.string()),
    ]
)
SPANS = pa.list_(_SPAN)


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()))
        ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def span_arrays(
    index: TermIndex, batches: Iterator[pa.RecordBatch], column: str, type_: str, detector: str,
    most: int = 4 << 20,
) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Batches with an array of spans per row; the texts of a batch are searched in one go."""
    for batch in _slices(batches, column, most):
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        parts, bounds = [], [0]
        between = np.array([_BETWEEN], dtype=np.uint32)
        for text in texts:
            codes = folded(text) if text else np.zeros(0, dtype=np.uint32)
            parts += [codes, between]
            bounds.append(bounds[-1] + len(codes) + 1)
        begins = np.array(bounds[:-1], dtype=np.int64)
        start, term = index.find(np.concatenate(parts))
        row = np.searchsorted(begins, start, side="right") - 1
        order = np.lexsort((start, term, row))
        row, start, term = row[order], start[order] - begins[row[order]], term[order]
        end = start + index.starts[term + 1] - index.starts[term]
        counts = np.bincount(row, minlength=len(texts))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        values = [texts[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
        n = len(values)
        spans = pa.StructArray.from_arrays(
            [
                pa.array([type_] * n, pa.string()), pa.array(start.astype(np.int32)),
                pa.array(end.astype(np.int32)), pa.array(values, pa.string()),
                pa.array(np.ones(n)), pa.array([detector] * n, pa.string()),
            ],
            fields=list(_SPAN),
        )
        yield batch, pa.ListArray.from_arrays(pa.array(offsets), spans).cast(SPANS)
