"""LM scores against plain computations."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from facet.llm.common import Stage, table
from facet.llm.op7_lm_score import Network, Scorer, Split, Vocabulary, _average, op7_lm_score, scored, train, word_counts

from .conftest import odd, prose, rows

SF = "/root/testdata/sf0.01"


def words(text):
    return (text or "").encode().lower().split()


def test_words_are_split_as_bytes_split_them():
    r = random.Random(3)
    texts = [None, "", " ", "A b", *("".join(r.choice(" \t\n\x0b\x0c\r\x1c\xa0aÉ.　") for _ in range(r.randint(0, 30))) for _ in range(300))]
    s = Split(pa.array(["gone away", *texts], pa.string()).slice(1))
    assert [[s.words[k] for k in s.codes[a:b]] for a, b in zip(s.bounds, s.bounds[1:])] == [words(t) for t in texts]
    assert len(Split(pa.array([], pa.string())).codes) == 0


def test_probabilities_add_up_and_gradients_hold():
    n = Network(np.arange(100), 2, embed=4, hidden=6)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    x = np.random.default_rng(0).integers(0, 100, (5, 4))
    total = sum(np.exp(n.log_probabilities(x, np.full(5, k))) for k in range(100))
    assert np.allclose(total, 1, atol=1e-6)
    y = np.arange(5) * 17
    loss = lambda: -n.log_probabilities(x, y).mean()
    before, sums = loss(), {k: np.full_like(v, 1.0) for k, v in n.p.items()}
    # a step's gradients against differences
    kept = {k: v.copy() for k, v in n.p.items()}
    n.step(x, y, sums, 1e-9)
    moved = {k: (kept[k] - n.p[k]) / 1e-9 for k in kept}
    n.p = {k: v.copy() for k, v in kept.items()}
    for name, at in (("e", (x[0, 0], 1)), ("w", (3, 2)), ("c", (1, 0)), ("o", (0, 2, 17)), ("ob", (1, 4)), ("cb", (1,)), ("b", (0,))):
        n.p[name][at] += 1e-5
        d = (loss() - before) / 1e-5
        n.p[name][at] -= 1e-5
        assert moved[name][at] * math.sqrt(1 + d * d) == pytest.approx(d, rel=0.02, abs=1e-5)
    sums = {k: np.full_like(v, 1e-2) for k, v in n.p.items()}
    for _ in range(60):
        n.step(x, y, sums, 0.2)
    assert loss() < 0.3 * before


def test_large_outputs_do_not_overflow():
    n = Network(np.ones(100), 2)
    n.p["cb"] += np.float32(200) * np.arange(n.clusters, dtype=np.float32)
    assert np.isfinite(n.log_probabilities(np.zeros((3, 4), np.int32), np.array([1, 70, 99]))).all()


def brute(scorer, counts, text):
    """Sum of log P by loops over words, without slices, batches or joins."""
    v, p, r = scorer.vocabulary, scorer.network.p, scorer.network.reach
    w = words(text)
    number = [v.number.get(x) or v.first_spare + zlib.crc32(x[-3:]) % v.spare for x in w]
    whole = Counter()
    for x, n in counts.items():
        if x not in v.number:
            whole[v.first_spare + zlib.crc32(x[-3:]) % v.spare] += n
    total = 0.0
    for k, y in enumerate(number):
        around = [number[j] if 0 <= j < len(w) else 0 for j in range(k - r, k + r + 1) if j != k]
        h = np.tanh(np.concatenate([p["e"][i] for i in around]).astype(np.float64) @ p["w"] + p["b"])
        z = h @ p["c"] + p["cb"]
        total += z[y // 64] - np.log(np.exp(z - z.max()).sum()) - z.max()
        z = h @ p["o"][y // 64] + p["ob"][y // 64]
        total += z[y % 64] - np.log(np.exp(z - z.max()).sum()) - z.max()
        if w[k] not in v.number:
            total += math.log(counts[w[k]] / whole[y])
    return total


def test_scores_equal_a_plain_computation(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choice(["often", "Seen", "rare" + str(min(r.randrange(90), r.randrange(90)))]) for _ in range(r.randint(0, 60)))) for i in range(50)]
    texts += [(50, "once only"), (51, "twice here"), (52, "twice here"), (54, None), (None, "often seen"), (2**60 + 1, " often"), (2**60 + 2, "twice")]
    docs, stage = odd(spark, texts), Stage(spark, "t")
    counts = stage.write(word_counts(docs, hold=3), "counts")
    plain = Counter(x for _, t in texts for x in words(t))
    assert {bytes(c["word"]): c["n"] for c in counts.collect()} == plain
    for known in (0, 2, 20, 60_000):  # counts of rare words joined, some of them, none
        scorer = train(docs.select("doc_id", "text"), stage, counts, vocabulary=2, spare=3, known=known, part_words=300, batch=64)
        got = {(g[0], g[1]): g for g in rows(scored(docs, scorer, stage, counts), "doc_id", "n_words", "log_likelihood", "mean_log_likelihood", "n_nowhere_else")}
        assert len({g[0] for g in got}) == len({i for i, _ in texts})
        for i, t in texts:
            mine, want = Counter(words(t)), brute(scorer, plain, t)
            g = got[i, len(words(t))]
            assert g[2] == pytest.approx(want, rel=1e-4, abs=1e-4) and g[3] == pytest.approx(want / max(1, len(words(t))), rel=1e-4, abs=1e-4)
            assert g[4] == sum(n for x, n in mine.items() if plain[x] == n)


def test_averages(spark):
    parts = [(k, float(k + 1), np.array([k, 1.0], dtype="<f4").tobytes()) for k in range(9)]
    got = _average(spark.createDataFrame(parts, "part long, n double, flat binary"), Stage(spark, "t"), fan=2)
    assert got == pytest.approx([sum(k * (k + 1) for k in range(9)) / 45, 1.0])


def test_scores_tell_word_order(spark, edge, empty):
    r = random.Random(4)
    chain = ["alpha", "beta", "gamma", "delta"]
    texts = [(i, " ".join(chain[(i + k) % 4] for k in range(60))) for i in range(600)] + [(1000, " ".join(r.choice(chain) for _ in range(60)))]
    docs, stage = odd(spark, texts), Stage(spark, "t")
    counts = stage.write(word_counts(docs), "counts")
    got = {g["doc_id"]: g["mean_log_likelihood"] for g in scored(docs, train(docs.select("doc_id", "text"), stage, counts, batch=64), stage, counts).collect()}
    assert min(got[i] for i in range(600)) > got[1000] + 0.3
    odd_rows = op7_lm_score(spark, edge).collect()
    assert len(odd_rows) == edge.count() and all(g["log_likelihood"] == 0 for g in odd_rows if g["n_words"] == 0) and all(math.isfinite(g["log_likelihood"]) for g in odd_rows)
    assert op7_lm_score(spark, empty).count() == 0


def test_every_position_is_trained_once(spark):
    """The windows of all parts of all rounds are as many as the words, by the weights the copies bring to the average."""
    r = random.Random(6)
    docs = odd(spark, [(i, prose(r, r.choice([1, 2, 3, 90]))) for i in range(60)])
    seen = []

    class Watched(Stage):
        def write(self, df, name="t"):
            out = super().write(df, name)
            if name == "copies":
                seen.append(out.agg({"n": "sum"}).first()[0])
            return out

    train(docs.select("doc_id", "text"), Watched(spark, "t"), part_words=200)
    assert len(seen) == 2 and sum(seen) == sum(len(words(t)) for (t,) in rows(docs, "text"))


def test_scores_do_not_depend_on_partitions(spark):
    docs = table(spark, SF, "documents").where("doc_id < 200")
    one = dict(rows(op7_lm_score(spark, docs.coalesce(1)), "doc_id", "log_likelihood"))
    other = dict(rows(op7_lm_score(spark, docs.repartition(7)), "doc_id", "log_likelihood"))
    assert one.keys() == other.keys() and all(other[i] == pytest.approx(x, rel=1e-5) for i, x in one.items())


def test_held_out_documents_score_above_their_frequencies(spark):
    """Nats a word of documents that took no part, against the frequencies of the same numbers."""
    docs = table(spark, SF, "documents")
    here, there = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    scorer = train(here.select("doc_id", "text"), Stage(spark, "t"), batch=1024)
    v = scorer.vocabulary
    texts = pa.array([t for (t,) in rows(there, "text")])
    s = Split(texts)
    ids = v.of(s.words)[s.codes]
    plain = -np.log((v.total + 0.5) / (v.total + 0.5).sum())[ids].mean()
    padded, at = scorer.network.padded(ids, s.bounds)
    nats = -scorer.network.log_probabilities(scorer.network.contexts(padded, at), ids).mean()
    print(f"held-out words: {nats:.3f} nats, by frequency {plain:.3f}")
    assert nats < plain - 0.3
    bare = Scorer(v, Network(v.total, 2))
    assert bare.network.log_probabilities(scorer.network.contexts(padded, at[:500]), ids[:500]).mean() < scorer.network.log_probabilities(scorer.network.contexts(padded, at[:500]), ids[:500]).mean()
    assert isinstance(v, Vocabulary)
