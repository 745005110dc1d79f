"""Masked pseudo-likelihood: a bidirectional window network predicts every word from both sides.

Words are lower-cased runs between ASCII white space. The `vocabulary` most frequent words of the whole corpus, by exact counts, have a number of their own; every other word falls into one of `spare` classes by its
last three bytes, and its probability is that of its class times its share of the class, count(word) / count(class), by the exact counts over the corpus: probabilities are of words, never of classes. The counts of the
`known` commonest words go to the tasks; those of all others, a table that grows with the corpus, are joined in Spark. Words are numbered by frequency and dealt to clusters of CLUSTER numbers each, so that a word's probability is that of its cluster times that within the cluster, two small softmaxes
instead of a large one.

The network: embeddings of the `reach` words at either side are joined, pass one hidden layer (tanh), and that gives both softmaxes, whose biases start as the words' frequencies. It never sees the word itself. A document's score is the sum over its words of
log P(word | both sides), with the number of words, the mean, and how many of its words occur nowhere else in the corpus (none in a document that occurs twice).

Training takes the windows at all positions of all documents once: documents are dealt by a hash of doc_id and text to `rounds` rounds and, within them, to parts of about `part_words` words, whose windows are taken in a fixed random order. Each part trains a copy of the shared
parameters, and the copies are averaged in a tree of shuffles, weighted by windows; the driver only gets the last average. Parts depend on the rows alone, not on how the input lies in files or tasks, so that scores are the same up to rounding.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, one_thread

CLUSTER = 64
#: Texts are split in slices of about so many bytes.
SLICE_BYTES = 24_000_000


class Split:
    """The words of some texts: `words` different ones as bytes, `codes` of all in order, `bounds` of each text's codes."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
        coded = lists.flatten().dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), lists.offsets.to_numpy()
        bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, np.int64)
        self.column = coded.dictionary.cast(pa.binary())
        self.words = self.column.to_numpy(zero_copy_only=False).tolist()
        if b"" in self.words:  # what lies before white space at a text's start, or behind it at its end
            real = codes != self.words.index(b"")
            bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
            codes = codes[real]
        self.codes, self.bounds = codes, bounds.astype(np.int64)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(column).nbytes)))
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def word_counts(docs: DataFrame, hold: int = 400_000) -> DataFrame:
    """(word, n) over the whole corpus. A task adds up before the shuffle, in a table of at most about `hold` words and those of one slice."""

    def made(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        held: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                s = Split(part.column(0))
                n = np.bincount(s.codes, minlength=len(s.words))
                held.update({w: k for w, k in zip(s.words, n.tolist()) if k})
                if len(held) > hold:
                    yield made(held)
                    held.clear()
        if held:
            yield made(held)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Numbers of words: frequent ones in order, then `spare` classes of the rest; 0 is the place beyond a text's ends. Counts of the commonest words and of all numbers."""

    def __init__(self, words: list[bytes], counts: list[int], numbered: int, spare: int):
        self.number = {w: k + 1 for k, w in enumerate(words[:numbered])}
        self.first_spare = len(self.number) + 1
        self.spare = spare
        self.size = self.first_spare + spare
        self.count = dict(zip(words, counts))
        self.total = np.zeros(self.size, np.int64)
        self.total[1 : self.first_spare] = counts[: len(self.number)]

    def of(self, words: list[bytes]) -> np.ndarray:
        get, first, spare, crc = self.number.get, self.first_spare, self.spare, zlib.crc32
        return np.array([get(w) or first + crc(w[-3:]) % spare for w in words], dtype=np.int32)


class Network:
    """Parameters as one dictionary of float32 arrays."""

    def __init__(self, total: np.ndarray, reach: int, embed: int = 8, hidden: int = 12, seed: int = 5):
        """total: how often each number occurs; the outputs start from it."""
        r = np.random.default_rng(seed)
        size = len(total)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.reach, self.size = reach, size
        self.clusters = -(-size // CLUSTER)
        often = np.zeros(self.clusters * CLUSTER)
        often[:size] = total + 0.5
        often = often.reshape(self.clusters, CLUSTER)
        whole = often.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            within = np.maximum(np.log(often / whole), -30)
        self.p = {
            "e": (0.3 * r.standard_normal((size, embed))).astype(np.float32), "w": g(2 * reach * embed, hidden), "b": np.zeros(hidden, np.float32),
            "c": g(hidden, self.clusters) * 0.1, "cb": np.log(whole[:, 0] / whole.sum()).astype(np.float32),
            "o": g(self.clusters, hidden, CLUSTER) * 0.1, "ob": within.astype(np.float32),
        }

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def padded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of some texts with `reach` zeros before, between and behind them, and the place of each."""
        lengths = np.diff(bounds)
        at = np.arange(len(ids), dtype=np.int64) + np.repeat((np.arange(len(lengths)) + 1) * self.reach, lengths)
        out = np.zeros(len(ids) + (len(lengths) + 1) * self.reach, np.int32)
        out[at] = ids
        return out, at

    def contexts(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The numbers at either side of places."""
        return np.stack([padded[at + k] for k in range(-self.reach, self.reach + 1) if k], axis=1)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.p["e"][x].reshape(len(x), -1) @ self.p["w"] + self.p["b"])

    def log_probabilities(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """log P(y | contexts x), by log-sum-exp."""
        p = self.p
        h = self._hidden(x)
        k, within = y // CLUSTER, y % CLUSTER
        bounded, within_bounded = _bounded(p["c"], p["cb"]), _bounded(p["o"], p["ob"])
        out = _log_softmax_at(h @ p["c"] + p["cb"], k, bounded)
        for c, rows in _by_cluster(k, self.clusters):
            out[rows] += _log_softmax_at(h[rows] @ p["o"][c] + p["ob"][c], within[rows], within_bounded[c])
        return out

    def step(self, x: np.ndarray, y: np.ndarray, sums: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step."""
        p, n = self.p, len(y)
        ex = p["e"][x].reshape(n, -1)
        h = np.tanh(ex @ p["w"] + p["b"])
        k, within = y // CLUSTER, y % CLUSTER
        bounded, within_bounded = _bounded(p["c"], p["cb"]), _bounded(p["o"], p["ob"])
        q = _softmax_less_one(h @ p["c"] + p["cb"], k, n, bounded)
        dh = q @ p["c"].T
        g = {"c": h.T @ q, "cb": q.sum(axis=0), "o": np.zeros_like(p["o"]), "ob": np.zeros_like(p["ob"])}
        for c, rows in _by_cluster(k, self.clusters):
            hr = h[rows]
            q = _softmax_less_one(hr @ p["o"][c] + p["ob"][c], within[rows], n, within_bounded[c])
            dh[rows] += q @ p["o"][c].T
            g["o"][c], g["ob"][c] = hr.T @ q, q.sum(axis=0)
        d = dh * (1 - h * h)
        g["w"], g["b"] = ex.T @ d, d.sum(axis=0)
        de = (d @ p["w"].T).reshape(n * x.shape[1], -1)
        size, embed = p["e"].shape
        flat = x.ravel()
        order = np.argsort(flat.astype(np.uint16) if size <= 1 << 16 else flat, kind="stable")
        sorted_x = flat[order]
        first = np.flatnonzero(np.diff(sorted_x, prepend=-1))
        g["e"] = np.zeros_like(p["e"])
        g["e"][sorted_x[first]] = np.add.reduceat(de[order], first, axis=0)
        for name, v in g.items():
            sums[name] += v * v
            p[name] -= rate * v / (np.sqrt(sums[name]) + 1e-6)


def _by_cluster(k: np.ndarray, clusters: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(k.astype(np.int16), kind="stable")
    cuts = np.searchsorted(k[order], np.arange(clusters + 1))
    for c in range(clusters):
        if cuts[c + 1] > cuts[c]:
            yield c, order[cuts[c] : cuts[c + 1]]


def _bounded(w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether outputs tanh(..) @ w + b stay, whatever the hidden layer, where exponentials neither overflow nor all vanish, so that their maximum need not be taken off first."""
    reach = np.abs(w).sum(axis=-2)
    return ((b + reach).max(axis=-1) < 60) & ((b - reach).max(axis=-1) > -60)


def _log_softmax_at(z: np.ndarray, at: np.ndarray, bounded: bool) -> np.ndarray:
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    out = z[np.arange(len(at)), at]
    return out - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def _softmax_less_one(z: np.ndarray, at: np.ndarray, n: int, bounded: bool) -> np.ndarray:
    """Gradient of the mean loss with respect to z."""
    if not bounded:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= (1 / (z @ np.full(z.shape[1], n, z.dtype)))[:, None]
    z[np.arange(len(at)), at] -= z.dtype.type(1 / n)
    return z


class Scorer:
    """A trained network with its vocabulary; sent to the tasks as it is. Its size is fixed by the parameters."""

    def __init__(self, vocabulary: Vocabulary, network: Network):
        self.vocabulary, self.network = vocabulary, network

    def scores(self, texts: pa.Array, at_once: int = 16_384):
        """Of each text: the number of words, the sum of log P (of rare words: of their classes alone), the words that occur nowhere else so far as the counts at hand tell; and
        of words whose counts are not at hand: (text, word, times, class)."""
        s, v, net = Split(texts), self.vocabulary, self.network
        n = len(texts)
        number = v.of(s.words)
        ids = number[s.codes]
        text_of = np.repeat(np.arange(n), np.diff(s.bounds))
        padded, at = net.padded(ids, s.bounds)
        total = np.zeros(n)
        for k in range(0, len(ids), at_once):
            lp = net.log_probabilities(net.contexts(padded, at[k : k + at_once]), ids[k : k + at_once])
            total += np.bincount(text_of[k : k + at_once], weights=lp, minlength=n)
        count = np.fromiter(map(v.count.get, s.words, repeat(0)), np.int64, len(s.words))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where((number >= v.first_spare) & (count > 0), np.log(count / np.maximum(1, v.total[number])), 0.0)
        total += np.bincount(text_of, weights=share[s.codes], minlength=n)
        # times of each word in each text, of words that need it: without a count at hand, or with all their occurrences here
        asked = count <= np.bincount(s.codes, minlength=len(s.words))
        some = asked[s.codes]
        key = np.sort(text_of[some] * max(1, len(s.words)) + s.codes[some])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        text, word = key[first] // max(1, len(s.words)), key[first] % max(1, len(s.words))
        alone = np.bincount(text, weights=np.where(count[word] == times, times, 0), minlength=n)
        rest = count[word] == 0
        return np.diff(s.bounds), total, alone, (text[rest], s.column.take(pa.array(word[rest])), times[rest], number[word[rest]])


def _average(copies: DataFrame, stage: Stage, fan: int = 8) -> np.ndarray:
    """Weighted mean of (part, n, flat) in a tree: groups of about `fan` copies are averaged until one is left."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")  # sums in the same order each time
        n = pdf["n"].to_numpy(dtype=np.float64)
        total = sum(np.frombuffer(f, "<f4").astype(np.float64) * w for f, w in zip(pdf["flat"], n))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "n": [n.sum()], "flat": [(total / n.sum()).astype("<f4").tobytes()]})

    while (left := copies.count()) > 1:
        groups = -(-left // fan)
        spread = copies.withColumn("g", F.pmod(F.xxhash64("part"), F.lit(groups)))
        copies = stage.write(spread.groupBy("g").applyInPandas(mean, "part long, n double, flat binary"), "mean")
    row = copies.first()
    return np.frombuffer(bytes(row["flat"]), "<f4") if row is not None else None


def _vocabulary(counts: DataFrame, numbered: int, spare: int, known: int) -> Vocabulary:
    """Numbers and counts of the commonest words, ties by the word; the totals of the classes come from the rest of the table in one aggregation.

    The commonest are those at or above the least count that at most `known` words reach: found by how many words have each count, in steps of a sixteenth, so that no task sends more than its share of them."""
    bucket = F.floor(F.log2("n") * 16)
    least, held = math.inf, 0
    for r in counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect():  # 16 rows a doubling
        held += r["words"]
        if held > known:
            break
        least = r["least"]
    top = sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"]))) if least < math.inf else []
    words = Vocabulary([bytes(r["word"]) for r in top], [r["n"] for r in top], numbered, spare)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words.size, np.int64)
        for batch in batches:
            number = words.of(batch.column(0).to_pylist())
            np.add.at(total, number, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words.size)), pa.array(total)], names=["number", "n"])

    for r in counts.select("word", "n").mapInArrow(classes, "number long, n long").where("n > 0").groupBy("number").agg(F.sum("n").alias("n")).collect():  # one row a number
        words.total[r["number"]] = r["n"]
    return words


def _fitting(words: Vocabulary, start: np.ndarray, reach: int, batch: int, rate: float):
    """Trains a copy of the network on the windows of one part: a task's rows (h, text)."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        table, part = pa.Table.from_batches(held).combine_chunks(), TaskContext.get().partitionId()
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        texts = table.column("text").combine_chunks()
        padded, places, used = [], [], 0
        net = Network(words.total, reach)
        net.load(start)
        step = max(1, int(len(order) * SLICE_BYTES / max(1, texts.nbytes)))
        for k in range(0, len(order), step):
            s = Split(texts.take(pa.array(order[k : k + step])))
            p, at = net.padded(words.of(s.words)[s.codes], s.bounds)
            padded.append(p)
            places.append(at + used)
            used += len(p)
        padded, places = np.concatenate(padded), np.concatenate(places)
        places = places[np.random.default_rng(part).permutation(len(places))]
        sums = {k: np.full_like(v, 1e-4) for k, v in net.p.items()}
        for k in range(0, len(places), batch):
            at = np.sort(places[k : k + batch])  # one step whatever the order; neighbours lie together
            net.step(net.contexts(padded, at), padded[at], sums, rate * min(1.0, len(at) / batch))
        if len(places):
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [float(len(places))], "flat": [net.flat().astype("<f4").tobytes()]})

    return fit


def train(
    docs: DataFrame, stage: Stage, counts: DataFrame | None = None, vocabulary: int = 3968, spare: int = 127, known: int = 150_000, reach: int = 2,
    rounds: int = 2, part_words: int = 2_000_000, batch: int = 8192, rate: float = 0.5,
) -> Scorer:
    """docs: (doc_id, text)."""
    counts = stage.write(word_counts(docs), "counts") if counts is None else counts
    words = _vocabulary(counts, vocabulary, spare, known)
    network = Network(words.total, reach)
    all_words = int(words.total.sum())
    parts = max(1, round(all_words / (rounds * part_words)))
    hashed = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    for turn in range(rounds if all_words else 0):
        mine = hashed.where(F.pmod("h", F.lit(rounds)) == turn).repartitionById(parts, F.pmod(F.xxhash64("h"), F.lit(parts)).cast("int"))
        copies = stage.write(mine.mapInArrow(_fitting(words, network.flat(), reach, batch, rate), "part long, n double, flat binary"), "copies")
        flat = _average(copies, stage)
        if flat is not None:
            network.load(flat)
    return Scorer(words, network)


SCORED = "doc_id long, row long, n_words long, log_likelihood double, n_alone long, rest array<struct<word:binary,times:long,number:long>>"
_REST = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64()), ("number", pa.int64())]))


def scored(docs: DataFrame, scorer: Scorer, stage: Stage, counts: DataFrame) -> DataFrame:
    """Scores of docs, with counts (word, n) of the corpus. A word that the corpus doesn't hold counts as held once."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # fixed size: set by vocabulary and layers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1):
                n, total, alone, (text, word, times, number) = sent.value.scores(part.column(1))
                rest = pa.StructArray.from_arrays([word, pa.array(times), pa.array(number.astype(np.int64))], names=["word", "times", "number"])
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)), rest)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.arange(row, row + len(n))), pa.array(n), pa.array(total), pa.array(alone.astype(np.int64)), rest], names=["doc_id", "row", "n_words", "log_likelihood", "n_alone", "rest"])
                row += len(n)

    out = stage.write(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCORED), "scores")
    totals = scorer.vocabulary.total  # one number a class
    of_class = docs.sparkSession.createDataFrame([(k, int(totals[k])) for k in range(scorer.vocabulary.first_spare, len(totals))], "number long, whole long")
    rest = out.select("row", F.inline("rest")).join(counts, "word", "left").join(F.broadcast(of_class), "number")
    n = F.coalesce("n", F.lit(1))
    more = rest.groupBy("row").agg(F.sum(F.col("times") * F.log(n / F.greatest("whole", F.lit(1)))).alias("more"), F.sum(F.when(n <= F.col("times"), F.col("times")).otherwise(0)).alias("others"))
    out = out.drop("rest").join(more, "row", "left")
    ll = F.col("log_likelihood") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_words", ll.alias("log_likelihood"), F.when(F.col("n_words") > 0, ll / F.col("n_words")).otherwise(0.0).alias("mean_log_likelihood"), (F.col("n_alone") + F.coalesce("others", F.lit(0))).alias("n_nowhere_else"))


def op7_lm_score(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text): doc_id, n_words, log_likelihood, mean_log_likelihood, n_nowhere_else, by a network trained on windows of all of them.

    Nulls: a null text is an empty one, with 0 words and score 0; a null doc_id stays null, and others keep all their digits beside it. Repeated rows score alike. A corpus without words leaves the network as it starts. Empty table: no rows.
    Further columns are ignored.
    """
    stage = Stage(spark, "lm-score")
    counts = stage.write(word_counts(docs), "counts")
    return scored(docs, train(docs.select("doc_id", "text"), stage, counts), stage, counts)
