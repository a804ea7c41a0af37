"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features of a text are the distinct hashes of its words, word pairs, pairs with a word between
(skip-grams), and each word's leading letters, which carry over to forms of a word that the labels
don't show. Weights are learned per coordinate with L1 sparsity, so those that stay are few and are
sent to the executors as two short arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, delete_path, filter_text, gathered, letters_and_digits, map_text, mixed, new_path, only, row_ids, word_hashes, written

STEMS = (3, 4, 5, 6)
#: Bytes of text whose features are made at once: there are some 8 a word, of 16 bytes while they are sorted.
SLICE = 2 << 20


def features(texts: pa.Array, bits: int, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text, sorted, and where each text's begin. Null or empty: none.

    A word is a run of letters and digits; the case of A-Z doesn't matter. With ``used``, a flag for
    each feature number, only those features are made out."""
    codes, offsets, words = ascii_words(letters_and_digits(texts))
    h, rows, counts = word_hashes(words, 1), row_ids(offsets), np.diff(offsets)
    value, row = [], []

    def add(hashes: np.ndarray, at: np.ndarray | None = None) -> None:
        number, in_text = (hashes >> np.uint64(64 - bits)).astype(np.int64), rows if at is None else rows[at]
        if used is not None:
            keep = used[number]
            number, in_text = number[keep], in_text[keep]
        value.append(number)
        row.append(in_text)

    add(mixed(h, 1)[codes])
    left, right = h * np.uint64(3), mixed(h, 5)
    for gap in (1, 2):
        at = gathered(offsets[:-1], np.maximum(counts - gap, 0))
        add(mixed(left[codes[at]] + right[codes[at + gap]], 1 + gap), at)
    length = np.asarray(pc.utf8_length(words), dtype=np.int64)
    for n in STEMS:
        stems = pc.utf8_slice_codeunits(words, 0, n).dictionary_encode()
        stem = mixed(word_hashes(stems.dictionary, 2), 10 + n)[np.asarray(stems.indices)]
        at = np.flatnonzero(length[codes] > n)
        add(stem[codes[at]], at)
    joined = (np.concatenate(row).astype(np.int64) << bits) | np.concatenate(value)
    joined.sort()
    fresh = np.ones(len(joined), bool)
    fresh[1:] = joined[1:] != joined[:-1]
    joined = joined[fresh]
    return (joined & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(joined, np.arange(len(counts) + 1) << bits)


class FTRL:
    """Per-coordinate FTRL-proximal for binary features; weight 0 is the bias, which has no L1."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, x: np.ndarray, label: float, weight: float = 1.0) -> float:
        at = np.concatenate(([0], x.astype(np.int64) + 1))
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = (p - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Sorted feature numbers with weights that aren't 0, those weights, the bias."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[1:])
        return at.astype(np.int64), w[1:][at], float(w[0])


#: Letters of training text in a shard; the driver holds the features of one shard at a time, some 15 bytes a letter.
SHARD_LETTERS = 1 << 21


def training_rows(docs: DataFrame, labels: DataFrame, max_rows_per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", hold_out: bool = False) -> DataFrame:
    """Written table (doc_id, label, text, key) of at most max_rows_per_label documents of either label:
    those with the least hashes of the id among labelled ids that docs holds.

    With hold_out only ids with crc32(id as text) mod 5 not 0. Of several labels of one id the greatest
    counts, of several texts the least. Null ids, labels and texts take no part. Only ids meet in a
    shuffle; the chosen ones, bounded by the parameter, are broadcast to one scan of the texts.
    """
    ids = only(docs, doc_id=id_col).where("doc_id is not null").select(F.col("doc_id").cast("long"))
    rows = only(labels, doc_id=label_id_col, label=label_col).where("doc_id is not null and label is not null")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    if hold_out:
        rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rows = rows.join(ids, "doc_id", "left_semi").withColumn("key", F.xxhash64("doc_id"))
    chosen = None
    for label in (0, 1):
        some = rows.where(F.col("label") == label).orderBy("key", "doc_id").limit(max_rows_per_label)
        chosen = some if chosen is None else chosen.union(some)
    texts = only(docs, doc_id=id_col, text=text_col).where("text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    return written(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "key").agg(F.min("text").alias("text")), "training", 2 * max_rows_per_label)


def train(rows: DataFrame, epochs: int = 4, bits: int = 22, **options) -> tuple[np.ndarray, np.ndarray, float]:
    """Learns from a table of ``training_rows`` (doc_id, label, text, key): sorted numbers of features with
    weights that aren't 0, those weights, and the bias.

    Features are made by tasks and written in shards by the key's hash; the driver reads one shard after
    the other, epochs times, each in the order of a hash. Without rows of both labels all
    weights are 0 and the bias tells the one label there is (none: the bias is 0).
    """
    spark = rows.sparkSession
    found = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(F.length("text")).alias("n")).collect()}
    if len(found) < 2:
        return np.empty(0, np.int64), np.empty(0), 5.0 if 1 in found else -5.0 if found else 0.0
    shards = max(1, -(-sum(found.values()) // SHARD_LETTERS))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, offsets = features(batch.column("text"), bits)
        raw, ends = x.astype("<i4").tobytes(), (4 * offsets).tolist()
        parts = pa.array([raw[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("shard"), parts], ["doc_id", "label", "shard", "x"])

    dealt = rows.select("doc_id", "label", F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard"), "text")
    path = new_path(spark, "features")
    map_text(dealt, run, "doc_id long, label int, shard int, x binary", slice_bytes=SLICE).repartition("shard").write.partitionBy("shard").parquet(path)
    model = FTRL(bits, **options)
    for _ in range(epochs):
        for shard in range(shards):
            table = spark.read.schema("doc_id long, label int, x binary, shard int").parquet(path).where(F.col("shard") == shard).select("doc_id", "label", "x").toArrow()
            doc_id, label = np.asarray(table["doc_id"]), np.asarray(table["label"])
            order = np.argsort(mixed(doc_id.astype(np.uint64) * np.uint64(2) + label.astype(np.uint64), 77), kind="stable")
            for i in order.tolist():
                model.learn(np.frombuffer(table["x"][i].as_buffer(), "<i4"), float(label[i]))
    delete_path(spark, path)
    return model.sparse()


def _scores(sent, bits: int):
    """Scores of a slice's texts by the broadcast model."""

    def run(texts: pa.Array) -> np.ndarray:
        at, weights, bias = sent.value
        table = np.zeros(1 << bits, np.float32)
        table[at] = weights
        x, offsets = features(texts, bits, table != 0)
        sums = np.concatenate(([0.0], np.cumsum(table[x], dtype=np.float64)))
        return 1 / (1 + np.exp(-np.clip(bias + sums[offsets[1:]] - sums[offsets[:-1]], -35, 35)))

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = 22) -> DataFrame:
    """(doc_id, score), a row for each row of docs; null and empty texts score as the bias says. Null and repeated ids
    stay, a row each; an empty table gives none; other columns play no part. No shuffle."""
    scores = _scores(docs.sparkSession.sparkContext.broadcast(model), bits)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")))], ["doc_id", "score"])

    return map_text(only(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, score double", slice_bytes=SLICE)


def clean_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", bits: int = 22) -> DataFrame:
    """The rows of docs, with all their columns, that score below threshold. No shuffle."""
    scores = _scores(docs.sparkSession.sparkContext.broadcast(model), bits)
    return filter_text(docs, lambda batch: scores(batch.column("text")) < threshold, text_col, id_col, SLICE)
