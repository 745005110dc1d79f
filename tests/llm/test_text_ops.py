"""Licences, quality, personal data, LM scores, decontamination and near-duplicates."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from facet.llm import op2_licences, op9_decontaminate
from facet.llm.common import Stage, table
from facet.llm.op3_quality import fit, held_out, op3_quality
from facet.llm.op4_pii import EMAIL, FULL, KINDS, STRIDE, WINDOW, all_spans, base_spans, cards_within, joined, luhn, masked, op4_pii, spans_of, trained, valid
from facet.llm.op10_simhash import anchors, fingerprint, forest, links, one_of_each, op10_simhash
from facet.llm.tagger import Tagger
from tests.conftest import TABLES, compare

from .conftest import odd, prose, rows

SF = "/root/testdata/sf0.001"


# licences


def test_licences_equal_sql(spark):
    from facet.llm import queries

    compare(spark, queries.op2_licences, op2_licences.ORACLE_SQL, TABLES)


def test_inheritance_from_the_nearest_directory(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code"), ("a/b/c/COPYING.txt", "Licensed under CC BY-NC 4.0."), ("a/b/c/d/y.py", None), ("a/b/c/z.py", "x\nLicensed under the Apache License, Version 2.0.\ny\nz\nw"), ("e/f.py", ""), ("top.py", "some words"), ("ab/q.py", "words")]
    got = {r["path"]: (r["licence"], r["origin"], r["directory"]) for r in op2_licences.scan(spark.createDataFrame(files, "path string, text string"), Stage(spark, "t")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/x.py": ("MIT", "inherited", "a"), "a/b/c/COPYING.txt": ("CC-BY-NC-4.0", "own", None), "a/b/c/d/y.py": ("CC-BY-NC-4.0", "inherited", "a/b/c"),
        "a/b/c/z.py": ("Apache-2.0", "own", None), "e/f.py": (None, "none", None), "top.py": (None, "none", None), "ab/q.py": (None, "none", None),
    }


def test_licences_of_odd_rows(spark, edge, empty):
    assert op2_licences.op2_licences(spark, edge).count() == edge.count()
    assert op2_licences.op2_licences(spark, empty).count() == 0


# quality


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r for r in op3_quality(spark, docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    y, s = zip(*[(r["quality"], got[r["doc_id"]]["score"]) for r in labels.collect() if got[r["doc_id"]]["held_out"]])
    y, s = np.array(y), np.array(s)
    auc = np.mean([(s[y == 1] > x).mean() + 0.5 * (s[y == 1] == x).mean() for x in s[y == 0]])
    assert auc > 0.97 and ((s >= 0.5) == y).mean() > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_never_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(rows(op3_quality(spark, docs, labels), "doc_id", "score")) == sorted(rows(op3_quality(spark, docs, flipped), "doc_id", "score"))


def test_quality_of_odd_rows(spark, edge, empty):
    labels = table(spark, SF, "labels")
    assert op3_quality(spark, edge, labels).count() == edge.count()
    assert {r[0] for r in rows(op3_quality(spark, edge, labels.limit(0)), "score")} == {0.5}
    assert op3_quality(spark, empty, labels).count() == 0
    a, b = fit([(i, prose(random.Random(i), 60), 1) for i in range(20)] + [(i, "X!! " * 90, 0) for i in range(20, 40)]).scores([prose(random.Random(99), 60), "X!! " * 50])
    assert a > 0.5 > b


# personal data


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    bits = ["a", "Z", "1", "4111111111111111", "+1 (376) 555-0199", "1.2.3.4", "300.1.1.1", "x@y.zz", "@", ".", "-", " ", "  ", "é", "12", "+", "a.b-c@d-e.f.g", "0" * 13, "%"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 12)))
        assert base_spans(t) == [(k, m.start(), m.end()) for k, p in enumerate(FULL) for m in p.finditer(t) if valid(k, m.group())], t
    assert base_spans("a" * 200_000 + "@") == [] and EMAIL.fullmatch("a@b.c")
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert valid(1, "0" * 5000 + "1.2.3.255") and not valid(1, "9" * 5000 + ".1.1.1")


def test_gradients_of_the_network():
    r = np.random.default_rng(0)
    m = Tagger(5, 3, 4, 3)
    x, y = r.integers(0, 5, (2, 6)), r.integers(0, 3, (2, 6))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    _, g = m.gradients(x, y)
    for k, v in m.p.items():
        i = tuple(r.integers(0, s) for s in v.shape)
        was = v[i]
        v[i] = was + 1e-3
        up = m.gradients(x, y)[0]
        v[i] = was - 1e-3
        down = m.gradients(x, y)[0]
        v[i] = was
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-3, k


def test_the_network_finds_spans_and_adds_what_greed_loses():
    model = trained()
    found = wanted = 0
    from facet.llm.op4_pii import network_spans

    docs = [t for t in _documents("/root/testdata/sf0.1") if "@" in t or re.search("[0-9]{4}", t)]
    for t, net in zip(docs, network_spans(docs, model)):
        base = set(base_spans(t))
        wanted += len(base)
        found += len(base & {s for _, s in net})
    assert found > 0.9 * wanted
    t = "pay 4111111111111111 5500000000000004 now"
    base, spans = all_spans([t], model)[0]
    assert base == [] and [t[a:b] for _, a, b in spans] == ["4111111111111111", "5500000000000004"]
    assert masked(t, spans) == "pay <CARD> <CARD> now"


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("x 4111 1111 1111 1111 4111 1111 1111 1111 y", "card", ["4111 1111 1111 1111"] * 2),
        ("call (017) 555-7713 now", "phone", ["(017) 555-7713"]),
        ("ip 2001:0db8:85a3:0000:0000:8a2e:0370:7334 end", "ip", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
        ('API_TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', "secret", ["9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]),
        ("commit 9fceb02d0ae598e95dc970b74767f19372d61af8 was", "secret", []),
        ("a number 4111111111111112 that no check passes", "card", []),
        ("2024-01-02 12:30 v1.2.3 page 1234 of 123456", "card", []),
    ],
)
def test_what_no_pattern_finds(text, kind, span):
    base, spans = all_spans([text], trained())[0]
    assert base == [] and [text[a:b] for _, a, b in spans] == span and all(KINDS[k] == kind for k, _, _ in spans)


def test_masking_holds_little_at_once():
    import tracemalloc

    from facet.llm.op4_pii import N_CLASSES, network_spans, slices

    model = trained()
    x = np.random.default_rng(3).integers(0, N_CLASSES, (2048, WINDOW))
    assert np.allclose(model.emissions(x[:50]), model._forward(x[:50])[0], atol=1e-4)
    tracemalloc.start()
    model.emissions(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # inputs to all gates of all steps would take 126 MB
    texts = ["a" * 10, None, "b" * 25, "", "c" * 9, "d" * 9, None]
    assert list(slices(texts, 20)) == [texts[:2], texts[2:3], texts[3:]] and list(slices([])) == []
    assert [x for part in slices(texts, 1) for x in part] == texts
    lines = ["mail joe.doe7@mail.example.com or 4111111111111111 5500000000000004"] * 3
    assert network_spans(lines, model, at_once=2) == network_spans(lines, model)


def test_secrets_of_documents_are_found_and_others_left_alone():
    texts = _documents("/root/testdata/sf0.1")
    got = [x for k in range(0, len(texts), 1000) for x in all_spans(texts[k : k + 1000], trained())]
    wanted = found = 0
    for t, (base, spans) in zip(texts, got):
        secrets = {m.span(1) for m in re.finditer('(?i)token = "([0-9a-f]{40})"', t)}
        mine = {(a, b) for k, a, b in spans if KINDS[k] == "secret"}
        assert set(base) <= set(spans) and mine <= secrets
        wanted, found = wanted + len(secrets), found + len(mine)
    assert wanted > 100 and found > 0.95 * wanted


def test_windows_are_joined_for_spans_of_any_length():
    """Windows cut from known tags, as the decoder would give them, give the spans of the whole, however long."""
    r = np.random.default_rng(8)
    for _ in range(200):
        n = int(r.integers(1, 700))
        tags, spans, at = np.zeros(n, np.int8), [], 0
        while (at := at + int(r.integers(0, 30))) < n:
            end, kind = min(n, at + int(r.integers(1, 300))), int(r.integers(0, len(KINDS)))
            tags[at:end] = 2 + 2 * kind
            tags[at] = 1 + 2 * kind
            spans.append((kind, 7 + at, 7 + end))
            at = end
        windows, start = [], 0
        while True:
            end = min(n, start + WINDOW)
            windows.append((start, tags[start:end], np.ones(end - start)))
            if end == n:
                break
            start += STRIDE
        whole, sure = joined(windows)
        assert (whole == tags).all() and [s for _, s in spans_of(whole, sure, 7)] == spans


def test_card_numbers_in_runs_against_all_cuts():
    r = random.Random(9)

    def card(n=16):
        d = "".join(r.choice("0123456789") for _ in range(n - 1))
        return next(d + c for c in "0123456789" if luhn(d + c))

    for _ in range(200):
        cards = [card() for _ in range(r.randint(2, 4))]
        for text in (" ".join(cards), " ".join(" ".join(c[k : k + 4] for k in range(0, 16, 4)) for c in cards), "".join(cards)):
            got = [text[a:b].replace(" ", "") for a, b in cards_within(text)]
            assert got == cards
    assert cards_within("4111111111111112") == [] == cards_within("1" * 31)


def _documents(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()


def test_personal_data_of_odd_rows(spark, edge, empty):
    for docs in (edge, table(spark, SF, "documents")):
        texts = docs.collect()
        got = op4_pii(spark, docs).collect()
        assert len(got) == len(texts)
        want = sorted((str(r["doc_id"]), hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in base_spans(r["text"])).encode()).hexdigest()) for r in texts)
        assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in got) == want
    assert op4_pii(spark, empty).count() == 0
    big = spark.createDataFrame([(2**60 + 1, "a"), (2**60 + 2, "b@c.de"), (None, "c")], "doc_id long, text string").coalesce(1)
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in op4_pii(spark, big).collect()) == [(0, 0), (2**60 + 1, 0), (2**60 + 2, 1)]


# decontamination


def test_decontamination_equals_sql(spark):
    from facet.llm import queries

    compare(spark, queries.op9_decontaminate, op9_decontaminate.ORACLE_SQL, TABLES)


def test_passages_with_small_changes_are_found(spark, edge, empty):
    r = random.Random(9)
    item = [prose(r, 60), prose(r, 45), "three word item", prose(r, 40), None, " "]
    w = item[0].split()
    texts = [
        (10, prose(r, 80) + " " + item[0].upper().replace(" ", ", ") + " " + prose(r, 80)), (11, " ".join([*w[:30], "changed", *w[31:]])), (12, " ".join(w[:30])), (13, "A Three, WORD\nitem!"), (14, item[1]), (14, prose(r, 90)), (15, prose(r, 400)),
        (16, " ".join([item[3]] * 3)),
    ]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(0, item[0])], "item_id long, text string")
    got = rows(op9_decontaminate.op9_decontaminate(spark, odd(spark, texts), items), "doc_id", "item_id", "similarity", "start")
    assert {g[:2] for g in got} == {(10, 0), (11, 0), (13, 2), (14, 1), (16, 3)}
    assert {(d, i): (s, a) for d, i, s, a in got}[10, 0] == (1.0, 80) and {(d, i): s for d, i, s, _ in got}[11, 0] < 1
    kept = op9_decontaminate.clean(odd(spark, texts), items, Stage(spark, "t"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted(t for k, t in enumerate(texts) if k in (2, 5, 6)) and kept.columns == odd(spark, texts).columns
    assert op9_decontaminate.op9_decontaminate(spark, edge, items).count() == 0
    assert op9_decontaminate.op9_decontaminate(spark, empty, items).count() == 0
    assert op9_decontaminate.op9_decontaminate(spark, edge, items.limit(0)).count() == 0
    assert op9_decontaminate.clean(edge, items.limit(0), Stage(spark, "t")).count() == edge.count()


def test_blocks_meet_all_pairs_within_the_radius(spark):
    """Against all pairs: each within the radius is met once, none beyond it; and few random pairs meet in any block."""
    r = random.Random(12)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    items = [(k, 10 + k % 2, signed(r.getrandbits(64))) for k in range(12)]
    prints = {(10 + k % 2, signed(r.getrandbits(64))) for k in range(500)}
    for _, n, f in items:
        for bits in range(0, 24):
            x = f % 2**64
            for b in r.sample(range(64), bits):
                x ^= 1 << b
            prints.add((n, signed(x)))
        # as unlike as the radius allows, spread over the blocks
        prints.add((n, signed(f % 2**64 ^ 0x7000F000F000F)))
    prints = sorted(prints)
    differ = lambda a, b: ((a ^ b) % 2**64).bit_count()
    want = sorted((n, wf, i) for n, wf in prints for i, m, f in items if n == m and differ(wf, f) <= op9_decontaminate.RADIUS)
    got = op9_decontaminate.met(spark.createDataFrame(prints, "n int, wf long"), spark.createDataFrame(items, "item_id long, n int, f long"))
    assert sorted(rows(got, "n", "wf", "item_id")) == want
    share = sum(any(((a >> 16 * k ^ b >> 16 * k) & 0xFFFF).bit_count() <= op9_decontaminate.NEAR for k in range(4)) for a, b in ((r.getrandbits(64), r.getrandbits(64)) for _ in range(20_000))) / 20_000
    print(f"random pairs that meet: {share:.3f}")
    assert share < 0.05


@pytest.mark.parametrize("size", [16, 24, 35, 58])
def test_changed_items_are_found_by_size(spark, size):
    """Items with words replaced, near the ends of short ones, similarity 0.8 or more by the exact shingles: at least 95 of 100 are found."""
    r = random.Random(size)
    items = [(k, prose(r, size)) for k in range(30)]
    texts, want = [], set()
    for k, t in items:
        for _ in range(25):
            w = t.split()
            edge_words = [0, 1, size - 2, size - 1]
            for at in r.sample(range(size) if size > 30 else edge_words, r.randint(1, max(1, size // 20))):
                w[at] = f"new{r.randrange(10**6)}"
            old, new = ([tuple(x[j : j + 5]) for j in range(size - 4)] for x in (t.split(), w))
            same = sum(a == b for a, b in zip(old, new))
            texts.append((len(texts), prose(r, 30) + " " + " ".join(w) + " " + prose(r, 30)))
            if same / (2 * len(old) - same) >= 0.8:
                want.add((len(texts) - 1, k))
    got = set(rows(op9_decontaminate.op9_decontaminate(spark, odd(spark, texts), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id"))
    print(f"{size} words: {len(want & got)} of {len(want)} found")
    assert len(want) > 9 and len(want & got) >= 0.95 * len(want)


def test_fingerprints_count_bits(spark):
    from pyspark.sql import functions as F

    r = random.Random(0)
    arrays = [[r.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 31, 127, 300, 600)]
    got = rows(spark.createDataFrame([(a,) for a in arrays], "h array<long>").select(op9_decontaminate.simhash(F.col("h")).alias("f")), "f")
    for a, (f,) in zip(arrays, got):
        assert f % 2**64 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in a) > len(a))


# near-duplicates


def slow_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(pairs):
    """component ids of (doc_id, fingerprint)."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_fingerprints_equal_the_contract():
    for t in ["", None, "a", "A b", "a b c", "É a  b\tc\x0bd\x1ce f", " x ", "a b c d a b c d a b c d", "x\xa0y z w"]:
        assert fingerprint(t) == slow_fingerprint(t), t


def test_every_linked_pair_meets():
    r = np.random.default_rng(0)
    f = r.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 400, dtype=np.uint64)
    g = f.copy()
    for k in range(len(g)):
        for b in r.choice(64, k % 4, replace=False):
            g[k] ^= np.uint64(1) << np.uint64(b)
    (ra, a, ha), (rb, b, hb) = anchors(f), anchors(g)
    for i in range(len(f)):
        assert set(a[(ra == i) & ha].tolist()) & set(b[rb == i].tolist()) and set(b[(rb == i) & hb].tolist()) & set(a[ra == i].tolist())
    assert forest(f[:1], f[:1]) == []


@pytest.mark.parametrize("block_rows", [2, 2000])
def test_hot_anchors_lose_no_link(spark, block_rows):
    """A chain and a ball of fingerprints around few anchors, compared in blocks of any size."""
    from facet.llm.components import components

    r = random.Random(1)
    fs = {0, 7, 2**64 - 1}
    for _ in range(60):
        fs.add((7 << 40) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    x = 12345
    for _ in range(30):
        x ^= 1 << r.randrange(64)
        fs.add(x)
    fs = sorted(fs)
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fs], "f long")
    stage = Stage(spark, "t")
    got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links(frame, stage, block_rows=block_rows), stage).collect()}
    group = lambda name: {frozenset(i for i in range(len(fs)) if name(i) == k) for k in {name(i) for i in range(len(fs))}}
    want = brute([(i, f) for i, f in enumerate(fs)])
    assert group(lambda i: got.get(fs[i], fs[i])) == group(lambda i: want[i])


def test_near_duplicates_equal_brute_force(spark, edge, empty):
    for docs in (edge, table(spark, SF, "documents")):
        held = [(r["doc_id"], slow_fingerprint(r["text"])) for r in docs.collect()]
        want = sorted((str(d), f"{f:016x}", c) for (d, f), c in zip(held, brute(held)))
        assert sorted((str(r[0]), r[1], r[2]) for r in rows(op10_simhash(spark, docs), "doc_id", "fingerprint", "component_id")) == want
    assert op10_simhash(spark, empty).count() == 0


def test_one_of_each_group_stays(spark, edge, empty):
    kept = one_of_each(edge, Stage(spark, "t"))
    held = [(r["doc_id"], slow_fingerprint(r["text"])) for r in edge.collect()]
    assert kept.count() == len({f: 0 for _, f in held}) and kept.columns == edge.columns
    assert 0 in {r["doc_id"] for r in kept.collect()} and {1, 2} & {r["doc_id"] for r in kept.collect()} == set()
    assert one_of_each(empty, Stage(spark, "t")).count() == 0
