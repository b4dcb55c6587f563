"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

fit() gathers the statistics of a bounded sample of labelled documents on the driver, cuts each statistic into at
most 64 bins, and grows trees of a fixed depth on the bins' gradient histograms (logistic loss, second order). The
trees are flattened into arrays (heap order), so that a batch of documents walks down all of them with a few numpy
gathers a level. The model is some tens of kB, whatever the corpus, and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dendrium.llm.common import held_out, lean, table
from dendrium.llm.packing import slices

#: Bound on the labelled rows that are learned from. Fitting is the only step that may sample.
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 3, 64, 0.2, 1.0, 8.0
THRESHOLD = 0.7
SLICE_BYTES = 2_000_000
STATISTICS = (
    "chars", "words", "word_length", "lower", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "beyond_ascii", "lines",
    "repeated_words", "top_word", "doubled_words", "repeated_trigrams", "repeated_line_chars", "short_words",
)
_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\x0b\x0c\r", ".,;:?", "!", "|")


def _byte_classes() -> np.ndarray:
    """0 to 6: the classes above; 7: other ASCII; 8: a byte that begins a character beyond ASCII; 9: one that goes on."""
    out = np.full(256, 7, np.uint8)
    out[128:192], out[192:] = 9, 8
    for k, chars in enumerate(_CLASSES):
        out[[ord(c) for c in chars]] = k
    return out


BYTE_CLASS = _byte_classes()


def _shares(owner: np.ndarray, key: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By owner: the weight of items that repeat an earlier one, and the count of the most frequent item."""
    again, top = np.zeros(n), np.zeros(n)
    if len(key):
        order = np.lexsort((key, owner))
        o, k = owner[order], key[order]
        same = (o[1:] == o[:-1]) & (k[1:] == k[:-1])
        w = np.ones(len(k)) if weight is None else weight[order]
        np.add.at(again, o[1:][same], w[1:][same])
        start = np.flatnonzero(np.concatenate(([True], ~same)))
        np.maximum.at(top, o[start], np.diff(np.append(start, len(k))))
    return again, top


def statistics(texts) -> np.ndarray:
    """The statistics of each text of an Arrow string array; a null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    n = len(texts)
    ends = np.asarray(pc.cumulative_sum(pc.binary_length(texts)), np.int64)
    size = np.diff(ends, prepend=0)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
    by = np.bincount(np.repeat(np.arange(n) * 10, size) + BYTE_CLASS[raw], minlength=n * 10).reshape(n, 10).astype(float)
    chars = by[:, :9].sum(axis=1)
    words = pc.ascii_split_whitespace(texts)
    flat = words.flatten()
    count = np.asarray(pc.list_value_length(words), np.int64)
    owner = np.repeat(np.arange(n), count)
    lengths = np.asarray(pc.utf8_length(flat), np.int64)
    codes = np.asarray(pc.dictionary_encode(flat).indices, np.int64)
    owner, codes, lengths = owner[lengths > 0], codes[lengths > 0], lengths[lengths > 0]
    n_words = np.bincount(owner, minlength=n).astype(float)
    again, top = _shares(owner, codes, n)
    doubled = np.bincount(owner[1:][(owner[1:] == owner[:-1]) & (codes[1:] == codes[:-1])], minlength=n)
    _, pair = np.unique(codes[:-1] * (codes.max(initial=0) + 1) + codes[1:], return_inverse=True)  # numbered, so that three fit into 64 bits
    tri, tri_owner = pair[:-1] * (codes.max(initial=0) + 1) + codes[2:], owner[:-2]
    whole = tri_owner == owner[2:]
    tri_again, _ = _shares(tri_owner[whole], tri[whole], n)
    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten()
    line_size = np.asarray(pc.utf8_length(line), np.float64)
    line_owner = np.repeat(np.arange(n), np.asarray(pc.list_value_length(lines), np.int64))
    line_again, _ = _shares(line_owner, np.asarray(pc.dictionary_encode(line).indices, np.int64), n, line_size)
    c, w = np.maximum(chars, 1), np.maximum(n_words, 1)
    columns = [
        np.log1p(chars), np.log1p(n_words), np.bincount(owner, lengths, n) / w, *(by[:, k] / c for k in range(9)), np.log1p(np.bincount(line_owner, minlength=n)),
        again / w, top / w, doubled / w, tri_again / w, line_again / c, np.bincount(owner[lengths <= 3], minlength=n) / w,
    ]
    return np.column_stack(columns)


@dataclass
class Model:
    """feature and threshold: trees x inner nodes in heap order; leaf: trees x leaves; base: log-odds before any tree."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def constant(score: float) -> Model:
    p = min(max(score, 1e-9), 1 - 1e-9)
    none = np.zeros((0, 2**DEPTH - 1))
    return Model(float(np.log(p / (1 - p))), none.astype(np.int64), none, np.zeros((0, 2**DEPTH)))


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees for labels 0 and 1. Without both, a constant: (ones + 1) / (rows + 2), a half without labels."""
    if not len(y) or y.min() == y.max():
        return constant((y.sum() + 1) / (len(y) + 2))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    n_features, inner = x.shape[1], 2**DEPTH - 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            at = (node - first) * BINS
            best = np.full(width, 1e-6)
            for j in range(n_features):
                key = at + binned[:, j]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST / 8) | (ht - hl < LEAST / 8)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                for i in np.flatnonzero(better):
                    best[i], feature[first + i], threshold[first + i] = gain[i, k[i]], j, edges[j][k[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + RIDGE)
        f += leaf[leaf_of]
        trees.append((feature, threshold, leaf))
    return Model(base, *(np.array(t) for t in zip(*trees, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns labels.quality (0 or 1; other values are ignored) from whole texts of labelled documents that are not held
    out: the fit_rows labels (of whatever number) with the smallest hash of the id, then the smallest id and label. Of
    documents that share an id, the one with the smallest statistics counts, so reruns and repeats give one model."""
    known = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    known = known.distinct().withColumn("h", F.pmod(F.xxhash64(F.lit("fit"), "l_id"), F.lit(1_000_000_007)))
    share = 2 * fit_rows / max(1, known.count())
    if share < 1:  # so that few rows are sorted; twice as many as are wanted
        known = known.where(F.col("h") < int(share * 1_000_000_007))
    known = known.orderBy("h", "l_id", "quality").limit(fit_rows).drop("h")
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).select("l_id", "text", "quality")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = statistics(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("l_id"), part.column("quality")], names=["x", "l_id", "quality"])

    kind = labels.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(lean(run), f"x array<double>, l_id {kind}, quality int").groupBy("l_id", "quality").agg(F.min("x").alias("x")).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(STATISTICS))
    y = np.array([r.quality for r in rows], float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return boost(x[order], y[order])


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Returns doc_id, held_out, score (0 to 1) and predicted (1 from THRESHOLD on), a row for each row of docs. Only the
    text is looked at, as a whole; a null text is scored as an empty one."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                p = shipped.value.score(statistics(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least THRESHOLD."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield part.filter(pa.array(shipped.value.score(statistics(part.column("text"))) >= THRESHOLD))

    return docs.mapInArrow(lean(run), docs.schema)


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
