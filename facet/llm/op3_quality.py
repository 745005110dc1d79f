"""Quality by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled bad. A text that is like the bad ones takes fewer bytes with the
bad dictionary. The features of a text are sizes alone:

    d = (size with good - size with bad) / size with neither      the normalised difference
    r = size with neither / bytes                                  how far the text repeats itself

taken over its fixed-size slices as well as over the whole, so that the difference is not drowned in a long text. A logistic function of them, fitted on labelled texts that
the dictionaries were not built from, makes the calibrated score.

The sample: at most sample_docs labelled documents of each label, the first by a hash of doc_id, and at most dictionary_bytes of each label go into its dictionary. Both bounds hold at any
size of the corpus; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, one_thread

SLICE = 4096


def dictionaries(good: list[bytes], bad: list[bytes], dictionary_bytes: int) -> tuple[bytes, bytes]:
    """Raw-content dictionaries: slices of the labelled texts, in turn, up to dictionary_bytes; both of one size, so that neither
    has the larger window."""
    out = []
    for texts in (good, bad):
        parts, size, k = [], 0, 0
        while size < dictionary_bytes and any(len(t) > k * 512 for t in texts):
            for t in texts:
                if (x := t[k * 512 : (k + 1) * 512]) and size < dictionary_bytes:
                    parts.append(x)
                    size += len(x)
            k += 1
        out.append(b"".join(parts))
    least = max(8, min(map(len, out)))
    return tuple(x[:least].ljust(8) for x in out)


class Sizes:
    """Compressed sizes of slices with neither dictionary, the good and the bad one."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        import zstandard as z

        one_thread()
        plain = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = z.ZstdCompressor(**plain)
        self.with_ = []
        for d in (good, bad):
            held = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            self.with_.append(z.ZstdCompressor(dict_data=held, **plain))

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return [0.0, 1.0, 0.0, 0.0]
        ds, n = [], len(raw)
        total = np.zeros(3)
        for k in range(0, n, SLICE):
            x = raw[k : k + SLICE]
            s = np.array([len(c.compress(x)) for c in (self.plain, *self.with_)], dtype=float)
            total += s
            ds.append((s[1] - s[2]) / s[0] * len(x))
        # a few bytes tell little: their features are drawn towards those of no text
        sure = n / (n + 40)
        d = (total[1] - total[2]) / total[0]
        return [sure * d, 1 + sure * (float(total[0]) / n - 1), sure * float(sum(ds)) / n, sure * float(total[1]) / n]


def expanded(f: np.ndarray) -> np.ndarray:
    """Features of the logistic function: the sizes' ratios, squares and the product of difference and repetition."""
    d, r, m, g = f.T
    return np.stack([np.ones_like(d), d, r, m, g, d * d, r * r, d * r, g * g, g * d], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features: (weights, mean, deviation)."""
    mean, dev = x.mean(axis=0), x.std(axis=0) + 1e-9
    mean[0], dev[0] = 0.0, 1.0
    z = (x - mean) / dev
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


class Model:
    """What fit() learns; small, and sent to the tasks as it is."""

    def __init__(self, good: bytes, bad: bytes, logistic, base: float):
        self.good, self.bad, self.logistic, self.base = good, bad, logistic, base

    def scores(self, texts) -> np.ndarray:
        """0 to 1, higher: label 1 likelier. Without both labels in the sample every text has the base score."""
        if self.logistic is None:
            return np.full(len(texts), self.base)
        sizes = Sizes(self.good, self.bad)
        f = np.array([sizes.features(t) for t in texts], dtype=float).reshape(-1, 4)
        w, mean, dev = self.logistic
        return 1 / (1 + np.exp(-np.clip((expanded(f) - mean) / dev @ w, -30, 30)))


def fit(sample: list[tuple[int, str | None, int]], dictionary_bytes: int = 110_000) -> Model:
    """sample: (doc_id, text, label). Even positions of each label build the dictionaries, odd ones calibrate."""
    by = {label: [(t or "").encode("utf-8", "surrogatepass") for _, t, y in sample if y == label] for label in (0, 1)}
    if min(map(len, by.values())) < 4:
        ones, n = len(by[1]), len(by[0]) + len(by[1])
        return Model(b"", b"", None, (ones + 1) / (n + 2) if n else 0.5)
    good, bad = dictionaries(by[1][::2], by[0][::2], dictionary_bytes)
    sizes = Sizes(good, bad)
    rest = [(t.decode("utf-8", "surrogatepass"), label) for label in (0, 1) for t in by[label][1::2]]
    x = expanded(np.array([sizes.features(t) for t, _ in rest]))
    y = np.array([label for _, label in rest], dtype=float)
    return Model(good, bad, fit_logistic(x, y), 0.5)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> list[tuple[int, str | None, int]]:
    """At most sample_docs rows of each label, of rows that may be learnt from (held_out is false), with their texts."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    some = [marked.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (0, 1)]
    chosen = {r["doc_id"]: r["label"] for s in some for r in s.collect()}
    if not chosen:
        return []
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen))).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: (zlib.crc32(b"s%d" % r["doc_id"]), r["doc_id"]))
    return [(r["doc_id"], r["text"], chosen[r["doc_id"]]) for r in rows]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_column(model: Model):
    """A column function: the score of a column of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        for texts in batches:
            yield pd.Series(model.scores(texts.tolist()), dtype="float64")

    return F.pandas_udf(run, "double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score at least 0.5, with their columns."""
    score = fresh(docs, "quality_score")
    return docs.withColumn(score, score_column(model)(F.col("text"))).where(F.col(score) >= 0.5).drop(score)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = 1500) -> Model:
    return fit(labelled_sample(docs, labels, sample_docs))


def op3_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_docs: int = 1500) -> DataFrame:
    """Per document (doc_id, text): doc_id, held_out, score, predicted.

    The model learns from labels of documents that are not held out alone; labels and doc_id are never inputs of a score. Nulls: a null text scores as an empty one; a null label is no label; a
    null doc_id is not held out. Without four labels of each kind every score is the labels' base rate. Repeated rows score alike. Empty table: no rows.
    """
    model = learn(docs, labels, sample_docs)
    out = docs.select("doc_id", score_column(model)(F.col("text")).alias("quality_score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
