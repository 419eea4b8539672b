"""Token ids in binary files, with document boundaries as Elias-Fano codes.

Documents are range-sorted by id, encoded in the tasks that hold them and written
as files of at most ``most_ids`` ids (or one document). A file holds one block:

====================  ======================================================
header (72 bytes)     magic, partition, number in the partition, documents,
                      bytes per id, ids, and the lengths of the five sections
ids                   all ids, little-endian, 2 bytes each (4 for vocabularies
                      over 65,536), documents one after another
high, low, samples    the boundaries: Elias-Fano code and its select structure
names                 the documents' ids, Elias-Fano too if they are integers,
                      else as an Arrow stream
====================  ======================================================

Files in order of (partition, number) are the corpus in ascending order of id. A
block is written by Spark's text writer, one row a file, and read by its
binary-file reader, so any store that Spark reaches will do; the writer ends a
file with a line feed, which is not part of the block. Spark commits whole tasks,
so a lost executor leaves no half-written file.

**Elias-Fano.** A rising sequence of n numbers up to u: the low log2(u / n) bits
of each are packed, the rest is unary in a bit vector with one 1 per number, in
all at most 2 + log2(u / n) bits a number. ``select(i)`` starts at the sampled
position of every 256th 1 (4 bytes each) and counts bits from there.

**Encoding.** A text is cut before white space that follows something else. No
token of a byte-level vocabulary reaches over such a place, so the ids of the
pieces, one after another, are the ids of the whole text. Each distinct piece of
a slice goes to the tokenizers library once, words many at a time with line feeds
between them; the first pieces that a worker meets are remembered.

Defined results: null text is empty, an empty text is the end id alone; rows
whose id is null come first; rows equal in id are ordered by their text's hash and
text; bytes that are not UTF-8 count as U+FFFD; an empty table gives no documents;
other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import ordering
from veilframe.llm.words import slices
from veilframe.sources.workdir import materialise

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"VFIDS\x00\x01\n"
_HEADER = struct.Struct("<8s4I6Q")
_EVERY = 256
_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


# --- Elias-Fano -----------------------------------------------------------


class EliasFano:
    """A rising sequence of non-negative numbers; ``select`` gives the i-th."""

    def __init__(self, count: int, low_bits: int, high: bytes, low: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.high, self.low = np.frombuffer(high, np.uint8), np.frombuffer(low, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        bits[ones] = 1
        places = np.arange(width, dtype=np.uint64)
        low = ((values[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(
            n, width, np.packbits(bits, bitorder="little").tobytes(),
            np.packbits(low, bitorder="little").tobytes(), ones[::_EVERY].astype("<u4").tobytes(),
        )

    def _low(self, i: int) -> int:
        at, w = i * self.low_bits, self.low_bits
        raw = int.from_bytes(self.low[at >> 3 : (at + w + 7) >> 3].tobytes(), "little")
        return (raw >> (at & 7)) & ((1 << w) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // _EVERY]), i % _EVERY
        byte = at >> 3
        now = int(self.high[byte]) & (0xFF << (at & 7)) & 0xFF
        while left >= int(_BITS[now]):
            left -= int(_BITS[now])
            byte += 1
            now = int(self.high[byte])
        for _ in range(left):
            now &= now - 1
        one = byte * 8 + (now & -now).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        n, w = self.count, self.low_bits
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:n]
        out = (ones - np.arange(n)).astype(np.uint64) << np.uint64(w)
        if w:
            bits = np.unpackbits(self.low, bitorder="little")[: n * w].reshape(n, w).astype(np.uint64)
            out |= bits @ (np.uint64(1) << np.arange(w, dtype=np.uint64))
        return out

    def parts(self) -> tuple[bytes, bytes, bytes]:
        return self.high.tobytes(), self.low.tobytes(), self.samples.tobytes()


def _code(values: np.ndarray) -> bytes:
    """An Elias-Fano code with its own lengths in front."""
    ef = EliasFano.of(values)
    parts = ef.parts()
    return struct.pack("<5I", ef.count, ef.low_bits, *map(len, parts)) + b"".join(parts)


def _decode(raw: bytes) -> np.ndarray:
    count, width, *lengths = struct.unpack_from("<5I", raw)
    at, parts = 20, []
    for n in lengths:
        parts.append(raw[at : at + n])
        at += n
    return EliasFano(count, width, *parts).all()


# --- blocks -----------------------------------------------------------------


def _pack_names(names: pa.Array) -> bytes:
    if pa.types.is_integer(names.type):
        nulls, known = names.null_count, names.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        base = int(known[0]) if len(known) else 0
        return struct.pack("<BIq", 0, nulls, base) + _code((known - base).view(np.uint64))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("id", names.type)])) as out:
        out.write_batch(pa.record_batch([names], names=["id"]))
    return b"\x01" + sink.getvalue().to_pybytes()


def _unpack_names(raw: bytes, kind: pa.DataType) -> pa.Array:
    if raw[0] == 0:
        _, nulls, base = struct.unpack_from("<BIq", raw)
        known = _decode(raw[struct.calcsize("<BIq") :]).view(np.int64) + base
        return pa.concat_arrays([pa.nulls(nulls, pa.int64()), pa.array(known, pa.int64())]).cast(kind)
    with pa.ipc.open_stream(raw[1:]) as stream:
        return stream.read_all().column(0).combine_chunks().cast(kind)


def pack(part: int, piece: int, names: pa.Array, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: documents' ids, where each document ends, and all token ids."""
    ef = EliasFano.of(ends)
    sections = [ids.tobytes(), *ef.parts(), _pack_names(names)]
    head = _HEADER.pack(
        MAGIC, part, piece, len(ends), ids.dtype.itemsize << 8 | ef.low_bits, len(ids), *map(len, sections)
    )
    return head + b"".join(sections)


class Block:
    """A block as read: any document's ids by its place, without a table of offsets."""

    def __init__(self, raw: bytes):
        magic, self.part, self.piece, self.count, widths, self.n_ids, *lengths = _HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at, parts = _HEADER.size, []
        for n in lengths:
            parts.append(raw[at : at + n])
            at += n
        self.ids = np.frombuffer(parts[0], f"<u{widths >> 8}")
        self.ends = EliasFano(self.count, widths & 0xFF, *parts[1:4])
        self._names = parts[4]

    def names(self, kind: pa.DataType) -> pa.Array:
        return _unpack_names(self._names, kind)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, end id included."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


# --- encoding ---------------------------------------------------------------

_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_REMEMBERED, _JOINED, _WINDOW = 400_000, 200, 8 << 20


def _unsure(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place may be white space beyond ASCII."""
    one, two, three = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    return (one >= 0x80) & (
        ((two == 0xC2) & ((one == 0x85) | (one == 0xA0)))
        | ((three == 0xE2) & ((two == 0x80) | (two == 0x81)))
        | ((three == 0xE1) & (two == 0x9A))
        | ((three == 0xE3) & (two == 0x80))
    )


class Encoder:
    """Token ids of texts, by a byte-level vocabulary of the tokenizers library."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(file)
        self._tokenizer.no_padding()
        self._tokenizer.no_truncation()
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # what stands between two words of one call: it never merges with a word
        line = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._line = line[0] if len(line) == 1 else None
        # known pieces by number, and where the ids of each begin in one array
        self._known: dict[bytes, int] = {}
        self._flat = array(self.dtype.char)
        self._begins = array("q", [0])

    def _numbers(self, distinct: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each distinct piece, and the pieces that were new."""
        known = self._known
        new = [p for p in distinct if p not in known]
        texts = [p.decode("utf-8", "replace") for p in new]
        words = [i for i, t in enumerate(texts) if t[:1] == " " and t.split() == [t[1:]]] if self._line else []
        joined = [words[lo : lo + _JOINED] for lo in range(0, len(words), _JOINED)]
        held = set(words)
        single = [[i] for i in range(len(texts)) if i not in held]
        while joined or single:
            groups, joined = joined or single, []
            if groups is single:
                single = []
            for lo in range(0, len(groups), 2_000):
                some = groups[lo : lo + 2_000]
                found = self._tokenizer.encode_batch_fast(
                    ["\n".join(map(texts.__getitem__, g)) for g in some], add_special_tokens=False
                )
                for group, e in zip(some, found, strict=True):
                    ids = np.array(e.ids, dtype=self.dtype)
                    if len(group) == 1:
                        sizes = [len(ids)]
                    else:
                        marks = np.flatnonzero(ids == self._line)
                        sizes = (np.diff(marks, prepend=-1, append=len(ids)) - 1).tolist()
                        ids = np.delete(ids, marks)
                    if len(sizes) != len(group):  # a vocabulary that joins line feeds: one by one
                        single += [[i] for i in group]
                        continue
                    for i, size in zip(group, sizes, strict=True):
                        known[new[i]] = len(self._begins) - 1
                        self._begins.append(self._begins[-1] + size)
                    self._flat.frombytes(ids.tobytes())
        return np.fromiter(map(known.__getitem__, distinct), dtype=np.int64, count=len(distinct)), new

    def _forget(self, new: list[bytes]) -> None:
        """Keep the first pieces seen, and no long ones."""
        if len(self._known) <= _REMEMBERED and len(self._flat) <= _REMEMBERED * 8:
            return
        first = len(self._begins) - 1 - len(new)
        for piece in new:
            del self._known[piece]
        del self._flat[self._begins[first] :]
        del self._begins[first + 1 :]

    def _window(self, raw: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces between cuts, and how many ids lie before each cut."""
        if len(cuts) < 2:
            return np.zeros(0, dtype=self.dtype), np.zeros(len(cuts), dtype=np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(raw)]
        ).dictionary_encode()
        numbers, new = self._numbers(pieces.dictionary.to_pylist())
        # views of growing arrays would lock them
        flat = np.array(self._flat, dtype=self.dtype)
        begins = np.array(self._begins, dtype=np.int64)
        which = numbers[pieces.indices.to_numpy()]
        each = np.diff(begins)[which]
        before = np.zeros(len(each) + 1, dtype=np.int64)
        np.cumsum(each, out=before[1:])
        ids = flat[np.repeat(begins[which] - before[:-1], each) + np.arange(before[-1])]
        self._forget(new)
        return ids, before

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and where each text's end."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = b"" if data is None else memoryview(data)[bounds[0] : bounds[-1]].tobytes()
        bounds = bounds - bounds[0]
        a = np.frombuffer(raw, np.uint8)
        gap = _GAP[a]
        cut = np.zeros(len(a) + 1, dtype=bool)
        if len(a) > 1:
            at = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
            cut[at[~_unsure(a, at)]] = True
        cut[bounds] = True
        cuts = np.flatnonzero(cut)
        ids, before, total = [], [np.zeros(1, dtype=np.int64)], 0
        lo = 0
        while lo < len(cuts) - 1:
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + _WINDOW, side="right")) - 1)
            found, inner = self._window(raw, cuts[lo : hi + 1])
            ids.append(found)
            before.append(inner[1:] + total)
            total += len(found)
            lo = hi
        ends = np.concatenate(before)[np.searchsorted(cuts, bounds)]
        return np.concatenate(ids) if ids else np.zeros(0, dtype=self.dtype), ends[1:]


_encoders: dict[str, Encoder] = {}


def _encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def vocabulary_file(name: str = VOCABULARY) -> str:
    """The file of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _task_blocks(
    batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, most_ids: int
) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of one partition's documents, in their order."""
    encoder = _encoder(vocabulary_file(vocabulary))
    part, piece, held, names, lengths = TaskContext.get().partitionId(), 0, 0, [], []
    texts: list[np.ndarray] = []

    def block() -> bytes:
        return pack(
            part, piece, pa.concat_arrays(names), np.cumsum(np.concatenate(lengths)),
            np.concatenate(texts),
        )

    for batch in slices(batches, "text", _WINDOW):
        ids, ends = encoder.encode(batch.column(batch.schema.get_field_index("text")))
        name = batch.column(batch.schema.get_field_index("id"))
        ids = np.insert(ids, ends, end_id)
        ends = ends + np.arange(1, len(ends) + 1)
        at = 0
        while at < len(ends):
            begin = int(ends[at - 1]) if at else 0
            to = int(np.searchsorted(ends, begin + most_ids - held, side="right"))
            if to <= at:  # the next document does not fit
                if not held:
                    to = at + 1
                else:
                    yield part, piece, block()
                    piece, held, names, lengths, texts = piece + 1, 0, [], [], []
                    continue
            names.append(name.slice(at, to - at))
            lengths.append(np.diff(ends[at:to], prepend=begin))
            texts.append(ids[begin : int(ends[to - 1])].astype(encoder.dtype))
            held += int(ends[to - 1]) - begin
            at = to
    if held:
        yield part, piece, block()


def write_ids(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    most_ids: int = 4 << 20,
) -> None:
    """Encode all documents and write their ids below ``path`` in ascending order of id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spot = F.monotonically_increasing_id()  # so that copies of one row can be dealt out as well
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("spot", spot)
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("text").asc_nulls_first()]
    by_range = rows.repartitionByRange(*order[:2], F.col("spot")).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, raw in _task_blocks(batches, vocabulary, end_id, most_ids):
            yield pa.record_batch([pa.array([raw], pa.large_binary())], names=["block"])

    found = by_range.select("id", "text").mapInArrow(blocks, "block binary")
    # the text writer puts the bytes out as they are
    found.select(F.col("block").cast("string")).write.option("maxRecordsPerFile", 1).text(path)


def _task_documents(raws: Iterator[bytes], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for raw in raws:
        block = Block(raw)
        ends = block.ends.all().astype(np.int64)
        starts = np.concatenate([[0], ends[:-1]])
        words = block.ids.astype("<u4")
        sums = [zlib.crc32(words[a:b]) for a, b in zip(starts, ends, strict=True)]
        n = len(ends)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, block.part, dtype=np.int32)),
                pa.array(np.full(n, block.piece, dtype=np.int32)),
                block.names(kind),
                pa.array(starts), pa.array(ends - starts), pa.array(np.array(sums, dtype=np.int64)),
            ],
            names=["part", "piece", "id", "inner", "n_tokens", "ids_crc32"],
        )


def read_documents(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Per document in the files below ``path``: id, start, n_tokens, ids_crc32.

    ``start`` counts all ids before it in the corpus; the checksum is over its ids
    as little-endian unsigned 32-bit numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = id_type or T.LongType()
    arrow = to_arrow_type(kind)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _task_documents((x.as_py() for x in batch.column(0)), arrow)

    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()),
            T.StructField("id", kind), T.StructField("inner", T.LongType()),
            T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
        ]
    )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    found = materialise(files.select("content").mapInArrow(documents, schema), "token-ids")
    # ids before a file: those of lower partitions, then of lower files of its own
    pieces = found.groupBy("part", "piece").agg(F.sum("n_tokens").alias("ids"))
    inner = ordering.Window.partitionBy("part").orderBy("piece")
    pieces = pieces.withColumn("__in_part", F.sum("ids").over(inner) - F.col("ids"))
    starts = pieces.join(ordering.part_starts(pieces, "part", "ids"), "part").select(
        "part", "piece", (F.col("__start") + F.col("__in_part")).alias("__start")
    )
    return found.join(starts, ["part", "piece"]).select(
        "id", (F.col("__start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )
