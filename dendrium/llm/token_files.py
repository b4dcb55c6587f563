"""Token ids in binary files of patched frame-of-reference blocks.

A file is a run of segments, each followed by one line feed (the row separator of Spark's writer). A segment holds
whole documents, about SEGMENT ids, and is little-endian:

    header     magic "PFORseg1", length of the segment, part, number in the part, documents, ids, blocks, exceptions
    documents  id (int64), whether the id is null (uint8), ids (uint32)
    index      by block: where its bits start (uint32), minimum (uint32), width (uint8), exceptions (uint16)
    exceptions place in the block (uint8), high bits (uint32)
    bits       by block: BLOCK ids less the minimum, their low `width` bits packed

A block's width is the bit length of the PERCENTILE-th percentile of what is left after its minimum is subtracted; of the
few larger ids the bits beyond the width go to the exceptions. Blocks start at whole bytes and the index says where,
so any range of ids can be read without what stands before it.

Documents are dealt out by ranges of the id and sorted within each, encoded where they lie, and written by Spark's own
writer with its commit protocol, to any file system that Spark can write to. What is gathered in one place is a row a
file and a row a range of documents. Positions over all files come from the segments' totals after writing.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrium.llm.common import lean, remove, shared_dir, table, written
from dendrium.llm.packing import byte_letters, slices
from dendrium.llm.shingles import GAP

END_ID = 0
BLOCK, PERCENTILE = 256, 90
#: Ids after which a segment ends, segments in a file, characters of text in a slice, chunks whose ids a worker keeps and
#: characters beyond which a chunk's ids are not kept.
SEGMENT, SEGMENTS_A_FILE, SLICE_CHARS, KEPT, LONG_CHUNK = 1 << 19, 16, 6_000_000, 700_000, 64
MAGIC, HEADER = b"PFORseg1", struct.Struct("<8sQIIIQII")
#: Bytes of ASCII letters, and of marks that no token of the pattern joins to a letter before them.
LETTER, MARK = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?"))
#: Words that the pattern takes as one token: Latin letters behind a blank.
PLAIN = re.compile(" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_POWERS = np.uint64(1) << np.arange(33, dtype=np.uint64)


def _kind(width: int) -> str:
    """Unsigned integers that have so many bits."""
    return "<u2" if width <= 16 else "<u4"



def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- blocks


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """starts, minima, widths, exception counts, exception places, exception highs and bits of the blocks of ids."""
    n_blocks = -(-len(ids) // BLOCK)
    x = np.empty(n_blocks * BLOCK, np.uint32)
    x[: len(ids)] = ids
    x[len(ids) :] = ids[-1] if len(ids) else 0
    x = x.reshape(n_blocks, BLOCK)
    low = x.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = x - low[:, None]
    rank = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.searchsorted(_POWERS[:32], np.partition(rest, rank, axis=1)[:, rank], side="right").astype(np.uint8)
    large = rest > (_POWERS[width] - 1).astype(np.uint32)[:, None]
    row, place = np.nonzero(large)
    high = (rest[row, place].astype(np.uint64) >> width[row].astype(np.uint64)).astype("<u4")
    start = np.cumsum(width.astype(np.int64) * (BLOCK // 8)) - width.astype(np.int64) * (BLOCK // 8)
    bits = np.zeros(int(width.astype(np.int64).sum()) * (BLOCK // 8), np.uint8)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if w:
            kind = _kind(w)
            each = np.unpackbits(rest[rows].astype(kind).view(np.uint8), bitorder="little").reshape(len(rows), BLOCK, -1)[:, :, :w]
            bits[start[rows][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(each.reshape(len(rows), -1), axis=1, bitorder="little")
    counts = np.bincount(row, minlength=n_blocks).astype("<u2")
    return start.astype("<u4"), low.astype("<u4"), width, counts, place.astype(np.uint8), high, bits


def unpack_blocks(start, low, width, counts, places, highs, bits, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last (exclusive) of the n that were packed; only their blocks are looked at."""
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    out = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[a:b]).tolist():
        rows = np.flatnonzero(width[a:b] == w)
        if w:
            packed = bits[start[a:b][rows].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
            each = np.zeros((len(rows), BLOCK, 8 * np.dtype(_kind(w)).itemsize), np.uint8)
            each[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            out[rows] = np.packbits(each.reshape(-1), bitorder="little").view(_kind(w)).reshape(len(rows), BLOCK)
    upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    row = np.repeat(np.arange(b - a), counts[a:b])
    wide = highs[upto[a] : upto[b]].astype(np.uint64) << width[a:b][row].astype(np.uint64)
    out[row, places[upto[a] : upto[b]]] += wide.astype(np.uint32)
    out += low[a:b, None]
    return out.reshape(-1)[first - a * BLOCK : last - a * BLOCK]


# --- segments


def segment(part: int, number: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    start, low, width, counts, places, highs, bits = pack_blocks(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    body = b"".join(
        x.tobytes() for x in (np.array([d or 0 for d in doc_ids], "<i8"), null, np.array(lengths, "<u4"), start, low, width, counts, places, highs, bits)
    )
    return HEADER.pack(MAGIC, HEADER.size + len(body), part, number, len(doc_ids), len(ids), len(width), len(places)) + body


class Segment:
    """A segment's arrays, as views of the bytes that hold it."""

    def __init__(self, raw, at: int):
        magic, self.size, self.part, self.number, docs, self.n, blocks, exceptions = HEADER.unpack_from(raw, at)
        if magic != MAGIC or at + self.size > len(raw):
            raise ValueError(f"no segment at byte {at}, or a part of one")
        self.at = at
        at += HEADER.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.lengths = take("<i8", docs), take(np.uint8, docs), take("<u4", docs)
        self.index = take("<u4", blocks), take("<u4", blocks), take(np.uint8, blocks), take("<u2", blocks), take(np.uint8, exceptions), take("<u4", exceptions)
        self.bits = take(np.uint8, int(self.index[2].astype(np.int64).sum()) * (BLOCK // 8))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        return unpack_blocks(*self.index, self.bits, self.n, first, last)


def segments(raw):
    """The segments of a file."""
    at = 0
    while at < len(raw):
        s = Segment(raw, at)
        yield s
        at += s.size + 1


# --- encoding


def chunks_of(texts):
    """All texts of a contiguous large_string array in chunks that can be encoded apart, and how many each has. A chunk ends
    before ASCII white space that follows a printable ASCII character or a Latin-1 letter, and before a mark that follows a
    letter: the tokenizer's pattern always ends a match there, and what it then matches does not depend on what stands before."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = np.asarray(pc.binary_length(texts), np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(size) else 0
    if not total:
        return pa.array([], pa.large_string()), np.zeros(len(size), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[:total]
    firm = (raw > 0x20) & (raw < 0x7F)
    latin = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80)
    firm[1:] |= latin
    letter = LETTER[raw]
    letter[1:] |= latin & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    begins = GAP[raw]
    begins[1:] &= firm[:-1]
    begins[1:] |= MARK[raw[1:]] & letter[:-1]
    begins[(ends - size)[size > 0]] = True
    at = np.flatnonzero(begins)
    offsets = np.append(at, total).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), texts.buffers()[2])
    return chunks, np.searchsorted(at, ends) - np.searchsorted(at, ends - size)


class Encoder:
    """Ids of many texts at once; each different chunk is encoded once while it is kept. Plain words go to the model itself,
    if that gives what the whole tokenizer gives."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.known = Tokenizer.from_file(path), kept, {}
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters(0xC0)
        sample = [" a", " The", " zyxwvutsrq", " Internationalization", *(f" {a}{chr(c)}{b}" for c in self.letters if c not in (0xD7, 0xF7) for a, b in (("", ""), ("st", "rn")))]
        self.direct = [self._model(w) for w in sample] == self._whole(sample)

    def _model(self, word: str) -> bytes:
        word = "\u0120" + (word[1:] if word.isascii() else word[1:].translate(self.letters))  # how the vocabulary writes a blank
        return array("I", [t.id for t in self.tokenize(word)]).tobytes()

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learned(self, chunks: list[str]) -> list[bytes]:
        plain = PLAIN.fullmatch
        out = [self._model(c) if self.direct and plain(c) else None for c in chunks]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._whole([chunks[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For an Arrow string array (null: empty): all ids, and where each text's ids end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
        chunks, per_text = chunks_of(texts)
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pc.dictionary_encode(chunks)
        codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        if len(self.known) + len(names) > self.kept:
            self.known = {}
        ids = list(map(self.known.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self._learned([names[i] for i in new]), strict=True):
            ids[i] = x
            if len(names[i]) <= LONG_CHUNK:
                self.known[names[i]] = x
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(lengths) - lengths
        per = lengths[codes]
        upto = np.cumsum(per)
        every = flat[np.arange(upto[-1]) + np.repeat(begin[codes] - upto + per, per)]
        return every, np.concatenate(([0], upto))[np.cumsum(per_text)]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder for a tokenizer; later tasks of that worker go on with what it keeps."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- files


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of whole texts, each followed by end_id, as files below path, in ascending order of doc_id.

    A null or empty text is the end id alone. Null ids come first. Rows that share an id are written one by one, by hash of
    the text, then in the order of the input, so that a frequent id is no hot range. No rows give no segments; columns
    besides doc_id and text are not looked at.
    """
    model = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = ["doc_id", F.xxhash64("text").alias("k1"), F.monotonically_increasing_id().alias("k2")]
    ordered = rows.select("text", *keys).repartitionByRange("doc_id", "k1", "k2").sortWithinPartitions("doc_id", "k1", "k2").select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, encoder = TaskContext.get().partitionId(), 0, encoder_of(model)
        doc_ids, lengths, held = [], [], []

        def close():
            nonlocal number
            out = pa.RecordBatch.from_arrays([pa.array([segment(part, number, doc_ids, lengths, np.concatenate(held))], pa.binary())], names=["segment"])
            number += 1
            for x in (doc_ids, lengths, held):
                x.clear()
            return out

        for batch in batches:
            for piece in slices(batch, "text", SLICE_CHARS):
                ids, ends = encoder.encode(piece.column("text"))
                begins = np.concatenate(([0], ends[:-1]))
                ids = np.insert(ids, ends, np.uint32(end_id))
                doc_ids += piece.column("doc_id").to_pylist()
                lengths += (ends - begins + 1).tolist()
                held.append(ids)
                if sum(map(len, held)) >= SEGMENT:
                    yield close()
        if doc_ids:
            yield close()

    made = ordered.mapInArrow(lean(run), "segment binary").select(F.col("segment").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", SEGMENTS_A_FILE).option("compression", "none").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the files below path: part and number of its segment, place (from 0) in it, doc_id, within
    (ids of the segment before it), n_tokens, ids_crc32 and, if asked for, ids."""
    names = ["part", "number", "place", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                for s in segments(content.as_buffer()):
                    ids = s.ids().astype("<u4", copy=False)
                    ends = np.cumsum(s.lengths, dtype=np.int64)
                    begins = ends - s.lengths
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    k = len(ends)
                    columns = [pa.array(np.full(k, s.part, np.int64)), pa.array(np.full(k, s.number, np.int64)), pa.array(np.arange(k)), pa.array(s.doc_ids, mask=s.null == 1), pa.array(begins), pa.array(s.lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return _files(spark, path).mapInArrow(lean(run), "part long, number long, place long, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def starts(totals: DataFrame) -> DataFrame:
    """For (part, number, n), a row a segment: (part, number, base), the ids of all segments before it. The parts are summed
    up first, so that one task sees a row a part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").select("part", "number", (F.col("ahead") + F.col("own")).alias("base"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where segments start: path, at (byte in the file), part, number, documents, n (ids) and base (ids before it)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = [(s.at, s.part, s.number, len(s.lengths), s.n) for s in segments(content.as_buffer())]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5))], names=["path", "at", "part", "number", "documents", "n"])

    found = _files(spark, path).mapInArrow(lean(run), "path string, at long, part long, number long, documents long, n long")
    return found.join(starts(found.select("part", "number", "n")), ["part", "number"])


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads the files below path: doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document.
    The rows are read once and kept in the shared folder, so the files may go afterwards."""
    found = written(read(spark, path).select("part", "number", "doc_id", "within", "n_tokens", "ids_crc32"))
    base = starts(found.groupBy("part", "number").agg(F.sum("n_tokens").alias("n")))
    return found.join(base, ["part", "number"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    out = documents(spark, path)
    remove(spark, path)
    return out
