import math
import random

import numpy as np
import pytest

from facet.llm import op8_topk, queries
from facet.llm.common import Stage
from facet.llm.op8_topk import Tree, top_k
from tests.conftest import TABLES, compare

from .conftest import odd, prose, rows

SF = "/root/testdata/sf0.001"


def test_topk_equals_sql(spark):
    compare(spark, queries.op8_topk, op8_topk.ORACLE_SQL, TABLES)


def brute(vectors, k, every):
    out = []
    for q, x in vectors.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q and len(y) == len(x))
            out += [(q, r + 1, i, -s_) for r, (s_, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, query_rows", [(10, 3), (50, 7), (10_000, 10_000)])
def test_shards_and_blocks_lose_nothing(spark, shard_rows, query_rows):
    r = random.Random(shard_rows)
    vectors = {i: [r.randint(-9, 9) for _ in range(4)] if i % 3 else [1, 2, 3, 4] for i in range(120)}  # a third are one hot vector
    vectors[7] = [1, 2]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, v array<double>")
    got = top_k(df, 5, 4, Stage(spark, "t"), shard_rows, query_rows, leaf_rows=4)
    assert sorted(rows(got, "query_id", "rank", "vec_id", "score")) == brute(vectors, 5, 4)


def test_trees_with_large_numbers_and_floors():
    r = np.random.default_rng(1)
    x = r.integers(-5, 6, (300, 3)).astype(float)
    ids = np.arange(300)
    for (s, i), q, own in zip(Tree(ids, x, 8).search(x[:20], 4, ids[:20], [None] * 20), x[:20], ids[:20]):
        want = sorted((-float(v @ q), k) for k, v in enumerate(x) if k != own)[:4]
        assert [(-a, b) for a, b in zip(s, i)] == want
    big = np.array([[int(v) * 10**17 for v in row] for row in x], dtype=object)
    s, i = next(Tree(ids, big, 8).search(big[:1], 4, ids[:1], [None]))
    assert list(s) == sorted((int(v @ big[0]) for v in big[1:]), reverse=True)[:4]


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), math.inf
    data = [(0, [1.0, 0.5]), (1, [nan, 1.0]), (2, None), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [-0.01, 1.0]), (5, [-0.01, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (20, []), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "vec_id long, embedding array<float>, shard int, v string")
    got = sorted(rows(op8_topk.op8_topk(spark, df, k=20, query_every=20), "query_id", "rank", "vec_id", "score"))
    assert got == [(0, 1, 5, 64 * -1 + 32 * 64), (0, 2, 40, 0), (40, 1, 0, 0), (40, 2, 5, 0)]
    assert op8_topk.op8_topk(spark, df.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(2)
    good = [prose(r, r.randint(40, 120)) for _ in range(60)]
    item = prose(r, 50)
    texts = [(i, t) for i, t in enumerate(good)] + [(100 + i, "BAD!! " * r.randint(20, 80) + str(i)) for i in range(40)]
    texts += [(200, good[3]), (201, good[5] + " " + item), (202, good[7] + " mail joe.doe7@mail.example.com or 4111111111111111 5500000000000004"), (203, None), (204, "")]
    docs = odd(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i, _ in texts if i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = {}
    now = docs
    for name, f in corpus_pipeline.STAGES:
        now = f(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/out-{name}")
        now = spark.read.parquet(f"{tmp_path}/out-{name}")
        held[name] = {x["doc_id"]: x for x in now.collect()}
    assert {i for i in held["quality"] if i and 100 <= i < 200} == set() and len([i for i in held["quality"] if i < 60]) >= 57
    assert 200 not in held["near_dedup"] and (3 in held["near_dedup"]) == (3 in held["quality"])
    assert 201 not in held["decontaminate"] and len(held["decontaminate"]) == len(held["near_dedup"]) - (201 in held["near_dedup"])
    if 202 in held["pii"]:
        assert held["pii"][202]["text"].endswith("mail <EMAIL> or <CARD> <CARD>") and held["pii"][202]["n_chars"] == len(held["pii"][202]["text"])
    assert set(held["packing"]) == set(held["pii"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_near_copies_of_the_pipeline_by_exact_similarity(spark, edge, empty, tmp_path):
    import corpus_pipeline
    from facet.llm.near_copies import links, one_of_each, shingle_set, signatures
    from facet.llm.op10_simhash import fingerprint
    from pyspark.sql import functions as F

    r = random.Random(11)
    texts, near, apart, far_bits = [], [], [], 0
    for k in range(40):
        w = prose(r, 150).split()
        changed, cut = list(w), list(w)
        for at in r.sample(range(5, 145), 2):
            changed[at] = f"new{k}"
        for at in range(10, 140, 12):
            cut[at] = f"other{k}"
        texts += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(changed)), (3 * k + 2, " ".join(cut))]
        far_bits += (fingerprint(" ".join(w)) ^ fingerprint(" ".join(changed))).bit_count() > 3
    assert far_bits > 20
    sets = {i: set(shingle_set(t).tolist()) for i, t in texts}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = {x: root[i] if y == root[j] else y for x, y in root.items()}
    want = sorted(set(root.values()))
    assert 60 < len(want) < 100
    docs = odd(spark, texts)
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == want
    # blocks lose no link
    many = odd(spark, [(i, " ".join(["same words of all copies in this text"] * 1 + [f"w{k}" for k in range(100)] + [f"end{i}"])) for i in range(60)])
    d = signatures(many).groupBy("f").agg(F.min(F.struct("doc_id", "copy")).alias("row"), F.first("buckets").alias("buckets"))
    joined = links(d, many, Stage(spark, "t"), block_rows=7).collect()
    nodes = {x for e in joined for x in e}
    seen, todo = set(), [next(iter(nodes))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b if a == x else a for a, b in joined if x in (a, b)]
    assert len(seen) == 60
    kept = one_of_each(edge, Stage(spark, "t"))
    assert kept.columns == edge.columns and one_of_each(empty, Stage(spark, "t")).count() == 0
    ids = [x["doc_id"] for x in kept.collect()]
    assert 0 in ids and 1 not in ids and 2 not in ids and 4 in ids and 5 not in ids and ids.count(7) == 1 and None in ids


def test_near_copies_of_the_pipeline_meet_at_anchors_of_simhash(spark):
    from pyspark.sql import functions as F

    from facet.llm.near_copies import FLIPS, PARTS, PLACE, alike, met, places, signature, signatures, visits
    from facet.llm.op10_simhash import MASK, anchors

    r = np.random.default_rng(4)
    halves = lambda w: np.stack([w & MASK, w >> np.uint64(32) & MASK], axis=1).ravel()
    close, both = [], np.array([0, 1])
    for _ in range(500):  # 320 of 400 shingles are shared
        x = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (signature(np.sort(s))[1] for s in (x[:360], np.r_[x[:320], x[360:]]))
        assert alike(np.stack([a, b]), both, both).all() and not alike(np.stack([a, ~b]), both[:1], both[1:]).any()
        a, b = halves(a), halves(b)
        assert len(a) == PARTS
        close.append(np.bitwise_count(a ^ b) <= 1)
    assert 0.5 < np.mean(close) < 0.7 and np.any(close, axis=1).all()
    # halves within a bit of each other meet at a home, and visits are those of op10
    w = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    v = w ^ (np.uint64(1) << r.integers(0, 31, 300).astype(np.uint64))
    (i, x), (j, y) = places(w, 1), places(v, 1)
    row, name, home = anchors(w)
    assert (i == row).all() and (x >> PLACE == (name | np.uint64(1 << 33)).view(np.int64)).all() and ((x & (1 << PLACE) - 1 < 32) == home).all()
    assert (FLIPS[x & (1 << PLACE) - 1] ^ (name & MASK) == (w[row] >> (name >> np.uint64(32) << np.uint64(5)) & MASK)).all()
    for k in range(300):
        both = np.sort(np.r_[x[i == k], y[j == k]])
        assert met(both).sum() >= 2
    assert not met(np.sort(x[i == 0])).any()
    # visits of an anchor are compared whole, whatever the batches
    texts = [(k, " ".join(f"w{n}" for n in range(60)) + f" end{k}") for k in range(40)] + [(100 + k, prose(random.Random(k), 60)) for k in range(20)]
    d = signatures(odd(spark, texts)).groupBy("f").agg(F.first("buckets").alias("buckets")).localCheckpoint()
    whole = sorted(map(tuple, visits(d).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert whole and sorted(map(tuple, visits(d).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_the_pipeline_drops_items_short_of_a_word(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    item = [f"w{k}" for k in range(59)]
    cut = lambda *at: " ".join(w for k, w in enumerate(item) if k not in at)
    texts = [(0, cut(58)), (1, cut(0)), (2, cut(29)), (3, cut(56, 57, 58)), (4, " ".join(item)), (5, cut(*range(20, 59))), (6, cut(29, 12)), (7, prose(r, 20)), (8, "w0"), (9, None), (10, "")]
    spark.createDataFrame([(1, " ".join(item)), (2, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sh = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    alike = lambda t: len(sh(t.split()) & sh(item)) >= 0.8 * len(sh(t.split()) | sh(item))
    want = [i for i, t in texts if not alike(t or "")]
    assert not {0, 1, 2, 3, 4} & set(want) and {5, 6, 7, 8, 9, 10} <= set(want)
    docs = odd(spark, texts)
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == want


def test_the_pipeline_sends_few_bytes_to_python_at_once(spark, monkeypatch):
    import corpus_pipeline
    from facet.llm import op4_pii, op6_packing
    from facet.llm.common import BATCHES
    from facet.llm.queries import vocabulary

    docs = spark.range(0, 40, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 60000) as text")  # about 8 MB in one task

    class Checked:
        def encode(self, texts, end_id):
            assert sum(b.size for b in texts.buffers() if b) < 4_000_000, "the whole batch"
            return np.full(len(texts), end_id, np.uint32), np.ones(len(texts), np.int64)

    def checked(texts):
        assert sum(map(len, texts)) < 4_000_000
        return [texts]

    own = spark.conf.get(BATCHES, None)
    spark.conf.unset(BATCHES)
    try:
        with monkeypatch.context() as m:
            m.setattr(op6_packing, "column_encoder", lambda path, drops_space: Checked())
            assert op6_packing.op6_packing(spark, docs, vocabulary("byte_bpe_50k.json")).count() == 40
        assert spark.conf.get(BATCHES, None) is None
        with monkeypatch.context() as m:
            m.setattr(op4_pii, "slices", checked)
            assert corpus_pipeline.mask_personal_data(spark, docs, "").agg({"text": "max"}).count() == 1
    finally:
        spark.conf.unset(BATCHES) if own is None else spark.conf.set(BATCHES, own)
