"""Packing by power-of-two decomposition.

A document of n tokens is cut into the pieces of n's binary form: as many pieces of the full length (a power of
two) as fit, then one piece for each lower bit, longest first. Every piece is a sequence of its own and its length
a power of two, so sequences of one length form a bucket, no sequence crosses documents, and nothing is padded.

Documents are tokenized chunk by chunk: white space never lies inside a token of this tokenizer, so Arrow splits a
batch of texts at ASCII white space, each different chunk is encoded once, and numpy gathers the ids. Texts with
U+001C to U+001F, or what could be a special token, are encoded whole; ASCII letters are lower-cased before, as
the tokenizer would. Nothing is shuffled; a
task holds one slice of texts at a time, and one very long text is a slice of its own.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import lean, table

END_ID = 2
SEQUENCE = 4096
#: Characters of text in a slice, and chunks whose ids a worker keeps.
SLICE_CHARS, KEPT = 4_000_000, 600_000
#: Lower-case Latin letters that normalization leaves alone, and marks that may follow them.
PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([.,!?;:|]*)")


PLAIN_BEYOND = [c for c in range(0xDF, 0x100) if c != 0xF7]


def byte_letters(first: int = 0xDF) -> dict[int, str]:
    """For each Latin-1 letter from `first` on: its UTF-8 bytes in the letters that byte-level vocabularies use for them
    (a printable byte is itself, the others are numbered from U+0100)."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(first, 0x100)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(n: int, longest: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest is a power of two."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the sequence length must be a power of two")
    out = [(i * longest, longest) for i in range(n // longest)]
    at, bit = n // longest * longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


class ChunkEncoder:
    """Ids of many texts at once; the ids of chunks are kept up to a bound."""

    def __init__(self, path: str, kept: int = KEPT):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.known = Tokenizer.from_file(path), kept, {}
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()
        # Lower-case Latin words can go to the model itself if that gives what the whole tokenizer gives.
        self.direct = all(self._model(w) == self._whole([w])[0] for w in ("a", "the", "zyxwvutsrq", "internationalization", *map(chr, PLAIN_BEYOND), *(f"st{chr(c)}r{chr(c)}n" for c in PLAIN_BEYOND)))

    def _model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(word if word.isascii() else word.translate(self.letters))]).tobytes()

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = self.known[word] = self._model(word)
        return ids

    def _learn(self, chunks: list[str]) -> None:
        """Adds the chunks' ids to those known. A word, or a word and one run of marks, needs no pre-tokenizer."""
        rest = []
        for c in chunks:
            m = PLAIN.fullmatch(c) if self.direct else None
            if m is None:
                rest.append(c)
            elif not m[2]:
                self.known[c] = self._model(c)
            else:
                marks = self.known.get(m[2])
                if marks is None:
                    marks = self.known[m[2]] = self._whole([m[2]])[0]
                self.known[c] = self._word(m[1]) + marks
        if rest:
            self.known.update(zip(rest, self._whole(rest), strict=True))

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """For an Arrow string array without nulls: all ids, and where each text's ids end."""
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]|<\\|").to_numpy(zero_copy_only=False)
        if odd.any():
            return self._with_odd(texts, odd)
        texts = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))  # ascii_lower goes wrong on a slice
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = np.asarray(chunks.offsets)[1:].astype(np.int64) - chunks.offsets[0].as_py()
        coded = pc.dictionary_encode(chunks.flatten())
        codes, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.known) + len(names) > self.kept:
            self.known = {}
        self._learn([w for w in names if w not in self.known])
        ids = [self.known[w] for w in names]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(lengths) - lengths
        per = lengths[codes]
        upto = np.cumsum(per)
        every = flat[np.arange(upto[-1]) + np.repeat(begin[codes] - upto + per, per)]
        return every, np.concatenate(([0], upto))[ends]

    def _with_odd(self, texts, odd) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa

        parts = []
        for text, is_odd in zip(texts.to_pylist(), odd, strict=True):
            whole = self.tokenizer.encode(text, add_special_tokens=False).ids if is_odd else None
            parts.append(np.array(whole, np.uint32) if is_odd else self.encode(pa.array([text], pa.large_string()))[0])
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


def slices(batch, column: str, chars: int = SLICE_CHARS) -> Iterator:
    """A record batch in slices whose texts have about so many bytes; at least one row in each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0), np.int64)
    group = np.cumsum(sizes) // chars
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), sequence_id,
    offset (0) and, if asked for, ids.

    A null or empty text is the end id alone. Repeated rows and repeated ids are packed each on their own. sequence_id
    is different for every piece: the task's number in the high bits, a running number below. No rows give no rows;
    columns besides doc_id and text are not looked at.
    """
    path = tokenizer or default_tokenizer()
    pieces(1, longest)  # rejects lengths that are no power of two

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder, names = None, {}
        for batch in batches:
            for part in slices(batch, "text"):
                encoder = encoder or ChunkEncoder(path)
                ids, ends = encoder.encode(pc.fill_null(part.column("text"), "").cast(pa.large_string()))
                out = {k: [] for k in ("row", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                begin = 0
                for row, end in enumerate(ends.tolist()):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin, n = end, len(own)
                    cut = names.get(n)
                    if cut is None:
                        cut = names[n] = pieces(n, longest)
                        if len(names) > 50_000:
                            names.clear()
                    for start, length in cut:
                        piece = own[start : start + length]
                        out["row"].append(row)
                        out["start"].append(start)
                        out["length"].append(length)
                        out["ids_crc32"].append(zlib.crc32(piece))
                        out["doc_tokens"].append(n)
                        if with_ids:
                            out["ids"].append(piece)
                columns = [part.column("doc_id").take(pa.array(out["row"], pa.int64())), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens"))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(out["ids"], pa.list_(pa.int64()))] if with_ids else []), names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema)
    return rows.select(
        *[c for c in rows.columns if c != "ids"], F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )


def op2_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
