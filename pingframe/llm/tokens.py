"""Token ids in binary files: one concatenated id array a file, document boundaries as Elias-Fano codes with select structures.

A file, little-endian: the id array (2 bytes an id if the vocabulary allows, else 4), the boundaries' code, the doc_ids' code, and a tail of
fixed size that says where they are. The ids come first, so a writer streams them and holds the lengths of one file's documents only.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.llm._shared import small_batches
from pingframe.plans.tables import shared_dir, written
from pingframe.sources.pages import Pages

TOKENIZER = "byte_bpe_50k.json"
#: The id that ends every document.
END = 0
#: Bytes of text that a file has, about; documents of a span that one call reads, and ids that it holds of them at once.
FILE_BYTES, SPAN_DOCS, SPAN_IDS = 40 << 20, 4_096, 4_000_000
#: Pieces of text of a generation whose ids a worker keeps, and characters of the longest one that it keeps.
KEPT_PIECES, KEPT_CHARS = 500_000, 32

#: Bytes of texts and keys that are encoded at once, about.
LOT_BYTES = 8 << 20

#: Every SAMPLE-th one bit of a code's high half has its place stored.
SAMPLE = 256
MAGIC = b"PFTOKEF1"
#: Magic, bytes of an id, ids, documents, those without a doc_id, smallest doc_id, then where each code starts and how many bytes it has.
TAIL = "<8sIQQQqQQQQ"

MANIFEST = "file int, path string, n_docs long, n_ids long"
DOCUMENTS = "file int, doc_id long, start long, n_tokens long, ids binary"


class EliasFano:
    """A rising sequence of n numbers of 0 or more, at most 2 + log2(last / n) bits each beside the samples.

    The low bits of each number are stored as they are; the high halves as a bit string in which number i sets bit high(i) + i. select, the
    place of the i-th one bit, gives the number back: stored for every SAMPLE-th one, found from there for the others.
    """

    HEAD = "<QBQ"

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.n, self.low_bits, self._low, self._high, self._samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        x = np.asarray(numbers, np.uint64)
        n = len(x)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        low_bits = max(0, (int(x[-1]) // n).bit_length() - 1)
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        low = np.packbits((x[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8), bitorder="little")
        return cls(n, low_bits, low.tobytes(), high.tobytes(), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack(self.HEAD, self.n, self.low_bits, len(self._high)) + self._samples.astype("<u4").tobytes() + self._high + self._low

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, wide = struct.unpack_from(cls.HEAD, raw)
        at, k = struct.calcsize(cls.HEAD), -(-n // SAMPLE)
        return cls(n, low_bits, raw[at + 4 * k + wide :], raw[at + 4 * k : at + 4 * k + wide], np.frombuffer(raw, "<u4", k, at))

    def select(self, first: int, end: int) -> np.ndarray:
        """Places of the one bits first to end - 1: bits are unpacked between the samples around them only."""
        a, b = first // SAMPLE, -(-end // SAMPLE)
        start = int(self._samples[a]) >> 3
        stop = (int(self._samples[b]) >> 3) + 1 if b < len(self._samples) else len(self._high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self._high, np.uint8, stop - start, start), bitorder="little")) + 8 * start
        ones = ones[np.searchsorted(ones, int(self._samples[a])) :]
        return ones[first - a * SAMPLE : end - a * SAMPLE]

    def numbers(self, first: int = 0, end: int | None = None) -> np.ndarray:
        """The numbers first to end - 1."""
        end = self.n if end is None else end
        if first >= end:
            return np.zeros(0, np.int64)
        high = (self.select(first, end) - np.arange(first, end)) << self.low_bits
        if not self.low_bits:
            return high
        start = first * self.low_bits >> 3
        bits = np.unpackbits(np.frombuffer(self._low, np.uint8, (end * self.low_bits + 7 >> 3) - start, start), bitorder="little")[first * self.low_bits - 8 * start :]
        low = bits[: (end - first) * self.low_bits].reshape(end - first, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return high | low


def _classes() -> np.ndarray:
    """What a byte of UTF-8 is, as bits: LETTER and MARK of ASCII, the GRAPHIC ones of ASCII, or the START of a character that is no white space."""
    out = np.zeros(256, np.uint8)
    for c in range(256):
        letter, graphic = 65 <= c <= 90 or 97 <= c <= 122, 33 <= c <= 126
        mark = graphic and not letter and not 48 <= c <= 57 and c != ord("'")
        # White space beyond ASCII starts with C2, E1, E2 or E3.
        out[c] = LETTER * letter | MARK * mark | GRAPHIC * graphic | START * (graphic or 0xC3 <= c <= 0xDF or c >= 0xE4)
    return out


LETTER, MARK, GRAPHIC, START = 1, 2, 4, 8
CLASSES = _classes()
#: A piece that has white space at its start at most, and that a space.
_PLAIN = re.compile(r" ?[!-~\u00c0-\u024f]+").fullmatch


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes where a byte-level tokenizer surely starts a piece, whatever lies around: true for the byte that starts it.

    Its pieces are a contraction, or letters, digits or other marks with one space before them at most, or white space without the space that
    the next piece takes. So one starts at a space before a character that is no white space; between an ASCII letter and an ASCII character
    that is none; between an ASCII mark other than the apostrophe and a letter; and on both sides of a line break that stands alone.
    """
    out = np.zeros(len(raw), bool)
    if len(raw) > 1:
        kind, ascii_ = CLASSES[raw], raw < 128
        out[:-1] = (raw[:-1] == 32) & (kind[1:] & START > 0)
        out[1:] |= (kind[:-1] & LETTER > 0) & ascii_[1:] & (kind[1:] & LETTER == 0)
        out[1:] |= (kind[:-1] & MARK > 0) & (kind[1:] & LETTER > 0)
        out[1:] |= (kind[:-1] & GRAPHIC > 0) & (raw[1:] == 10)
        out[2:] |= (kind[:-2] & GRAPHIC > 0) & (raw[1:-1] == 10) & (kind[2:] & START > 0)
    return out


class Encoder:
    """A tokenizer of the library over Arrow columns of texts.

    Texts are cut where a piece surely starts, and the library encodes each distinct piece of a batch once. A worker keeps the ids of short pieces.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.kind = np.dtype("<u2") if self._tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.dtype("<u4")
        self._break = self._tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _apart(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _as_lines(self, pieces: list[str]) -> list[bytes]:
        """The ids of plain pieces: a line break that stands alone is a piece of its own, so they go to the library as lines of one text."""
        ids = np.array(self._tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.append(np.flatnonzero(ids == self._break), len(ids))
        if len(ends) != len(pieces):
            return self._apart(pieces)
        raw, wide = ids.tobytes(), self.kind.itemsize
        return [raw[a * wide : b * wide] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces. Those met in this generation of KEPT_PIECES pieces or in the one before are kept."""
        found = list(map(self._young.get, pieces))
        plain, odd = [], []
        for i in [i for i, x in enumerate(found) if x is None]:
            p = pieces[i]
            found[i] = self._old.get(p)
            if found[i] is not None:
                self._young[p] = found[i]
            else:
                (plain if _PLAIN(p) else odd).append(i)
        for several, coded in ((plain, self._as_lines), (odd, self._apart)):
            for k in range(0, len(several), 1_000):
                lot = several[k : k + 1_000]
                for i, x in zip(lot, coded([pieces[i] for i in lot]), strict=True):
                    found[i] = x
                    if len(pieces[i]) <= KEPT_CHARS:
                        self._young[pieces[i]] = x
        if len(self._young) > KEPT_PIECES:
            self._old, self._young = self._young, {}
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as bytes, END appended (null: END alone)."""
        end = np.array([END], self.kind).tobytes()
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if not len(column) or bounds[0] == bounds[-1]:
            return [end] * len(texts)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        heads = np.append(cuts(raw), True)
        heads[bounds] = True
        starts = np.flatnonzero(heads)
        pieces = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)).dictionary_encode()
        ids = self._ids(pieces.dictionary.to_pylist())
        place = np.asarray(pieces.indices)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        flat = np.frombuffer(b"".join(ids), self.kind)
        first = np.cumsum(lengths) - lengths
        n = lengths[place]
        upto = np.append(0, np.cumsum(n))
        every = flat[np.arange(upto[-1]) + np.repeat(first[place] - upto[:-1], n)]
        at = upto[np.searchsorted(starts, bounds)]
        return [every[a:b].tobytes() + end for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's encoder, with what it keeps, serves all tasks of that worker."""
    return Encoder(path)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have LOT_BYTES, as a piece is looked up once a lot."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= LOT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary file is; the same on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:(?://(?=/))?)?(/.*)", path)
    return (fs.LocalFileSystem(), local.group(1)) if local else fs.FileSystem.from_uri(path)


class Writer:
    """One file of documents in ascending order; it takes its name only when it is whole, so a task that is lost leaves none of that name."""

    def __init__(self, folder: str, file: int, width: int) -> None:
        self._system, name = _store(folder)
        self._system.create_dir(name, recursive=True)
        self.path, self._name = f"{folder}/{file:08d}.tok", f"{name}/{file:08d}.tok"
        self._part = f"{self._name}.{uuid.uuid4().hex}"
        self._out, self._width = self._system.open_output_stream(self._part), width
        self._lengths: list[np.ndarray] = []
        self._docs: list[np.ndarray] = []
        self._nulls = 0

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        self._out.write(b"".join(ids))
        self._lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)) // self._width)
        self._docs.append(np.asarray(doc_ids.drop_null()).astype(np.int64))
        self._nulls += doc_ids.null_count

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        bounds = np.cumsum(np.concatenate([[0], *self._lengths]))
        docs = np.concatenate([np.zeros(0, np.int64), *self._docs])
        least = int(docs[0]) if len(docs) else 0
        parts = [EliasFano.of(bounds).to_bytes(), EliasFano.of(docs.astype(np.uint64) - np.uint64(least % (1 << 64))).to_bytes()]
        at = int(bounds[-1]) * self._width
        self._out.write(parts[0] + parts[1])
        self._out.write(struct.pack(TAIL, MAGIC, self._width, int(bounds[-1]), len(bounds) - 1, self._nulls, least, at, len(parts[0]), at + len(parts[0]), len(parts[1])))
        self._out.close()
        self._system.move(self._part, self._name)
        return len(bounds) - 1, int(bounds[-1])


class Reader:
    """Random access to one file: a document's place costs a select, its ids one read."""

    def __init__(self, path: str) -> None:
        self._raw = Pages(path)
        wide = struct.calcsize(TAIL)
        magic, self.width, self.n_ids, self.n_docs, self._nulls, self._least, at, n, at_docs, n_docs = self._raw.unpack(TAIL, self._raw.size - wide)
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self._bounds = EliasFano.from_bytes(self._raw.take(at, n))
        self._docs = EliasFano.from_bytes(self._raw.take(at_docs, n_docs))

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *error: object) -> None:
        self._raw.__exit__(*error)

    def bounds(self, first: int, end: int) -> np.ndarray:
        """Where the documents first to end - 1 start, and where the last of them ends."""
        return self._bounds.numbers(first, end + 1)

    def doc_ids(self, first: int, end: int) -> list[int | None]:
        known = self.n_docs - self._nulls
        found = self._docs.numbers(min(first, known), min(end, known)).astype(np.uint64) + np.uint64(self._least % (1 << 64))
        return [*found.astype(np.int64).tolist(), *[None] * (max(end, known) - max(first, known))]

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._raw.take(start * self.width, (end - start) * self.width), f"<u{self.width}")


def written_files(docs: DataFrame, folder: str, tokenizer: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode docs and write them in ascending doc_id order (null last, then by text hash); returns (file, path, n_docs, n_ids).

    Texts are dealt by ranges of that order, about file_bytes of text each, so a doc_id that a third of the rows share is spread over many
    files; equal rows go by their place in docs. A task encodes the texts of one range and writes its file, the same one if it is repeated, so
    the ids are stored nowhere else. The result is stored, so files are written once. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    text = F.col("text").cast("string")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, file, writer = _encoder(path), TaskContext.get().partitionId(), None
        for b in _lots(batches):
            writer = writer or Writer(folder, file, encoder.kind.itemsize)
            writer.add(b["doc_id"], encoder.encode(b["text"]))
        if writer is not None:
            docs, ids = writer.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "path": writer.path, "n_docs": docs, "n_ids": ids}], pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("key"), F.col("row")]
    dealt = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return written(dealt.mapInArrow(run, MANIFEST), "token-files")


def _spans(files: DataFrame, span_docs: int) -> DataFrame:
    """Spans of at most span_docs documents of each file, dealt over all tasks, with the ids of all files before."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = files.withColumn("before", before).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(span_docs).cast("long"))))
    return spans.select("file", "path", "n_docs", "before", "first").repartition("file", "first")


def _read(path: str, first: int, end: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of the documents first to end - 1, some SPAN_IDS ids at a time."""
    with Reader(path) as r:
        bounds, docs = r.bounds(first, end), r.doc_ids(first, end)
        k = 0
        while k < len(docs):
            m = max(k + 1, int(np.searchsorted(bounds, bounds[k] + SPAN_IDS, "right")) - 1)
            ids = r.ids(int(bounds[k]), int(bounds[m]))
            for i in range(k, m):
                yield docs[i], int(bounds[i]), ids[bounds[i] - bounds[k] : bounds[i + 1] - bounds[k]]
            k = m


def read_documents(files: DataFrame, span_docs: int = SPAN_DOCS) -> DataFrame:
    """(file, doc_id, start, n_tokens, ids) of every document of the files, from the files: start counts the ids of all documents before."""
    names = [f.split()[0] for f in DOCUMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                found, held = [], 0
                for doc, start, ids in _read(s["path"], s["first"], min(s["first"] + span_docs, s["n_docs"])):
                    found.append((s["file"], doc, s["before"] + start, len(ids), ids.tobytes()))
                    held += len(ids)
                    if held > SPAN_IDS:
                        yield _batch(found, names)
                        found, held = [], 0
                if found:
                    yield _batch(found, names)

    return _spans(files, span_docs).mapInArrow(run, DOCUMENTS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reported(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, file_bytes: int = FILE_BYTES, span_docs: int = SPAN_DOCS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of docs, read back from the files that it is written to.

    start: ids of all documents before, in ascending doc_id order (null last; rows that share a doc_id by a hash of their text). n_tokens
    counts the end id, so null and empty texts have 1. ids_crc32 is of the ids as little-endian 32-bit numbers. Extra columns are not read. An
    empty table has no files and no rows. folder: where the files stay (a folder of the application in the shared one, if none is given).
    """
    files = written_files(docs, folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", tokenizer, file_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                found = [(d, s["before"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in _read(s["path"], s["first"], min(s["first"] + span_docs, s["n_docs"]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _spans(files, span_docs).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
