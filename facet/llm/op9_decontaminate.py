"""Benchmark decontamination with DataFrame functions alone.

Texts become words: lower-cased runs of letters and digits. An item of n words is looked for in windows of n words, by the 5-word shingles of both (an item of
fewer words has one shingle, all of it):

1. Windows are taken wherever they hold a shingle of an item of their size. Others share no shingle with an item and have similarity 0. Which documents hold a
   shingle at all is found first, in one pass over all texts, so that arrays of hashes are built for those alone.
2. Each window and item gets a 64-bit SimHash of its shingles.
3. Multi-index Hamming blocks: the fingerprint is cut into BLOCKS blocks. Two fingerprints within RADIUS differ in at most NEAR bits of at least one of them, since more in each would be more than RADIUS in all. Items are few, so that each is put
   down under every value within NEAR bits of its own, block by block; different fingerprints of windows meet them on (size, block, value), and pairs beyond RADIUS go. Of random pairs 4.2 % meet.
4. The exact weighted similarity decides: sum of weight * min(count) over sum of weight * max(count), at least `similarity`. A shingle's weight is the rounded
   1000 * ln(1 + items / items that hold it); a shingle that the item doesn't hold weighs as one held by a single item.

Of windows at similarity 0.80 to 0.83 to an item 0.3 to 1.7 %, by size of item, differ from it in more than RADIUS bits and are lost; of all at 0.8 or more 0.1 to 1.3 % (simulated for equal weights, 9 to 59 words, words replaced at random).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fresh

SHINGLE = 5
BLOCKS, BLOCK_BITS = 4, 16
#: Bits in which an item's block and a window's may differ, and the radius that this covers: NEAR + 1 in each block would be RADIUS + 1.
NEAR = 3
RADIUS = (NEAR + 1) * BLOCKS - 1
#: A SimHash counts the bits of its hashes seven at a time, in lanes of 9 bits of a long.
LANE, LANES = 9, 7
SPREAD = sum(1 << (8 * j) for j in range(LANES))
LANE_ONES = sum(1 << (LANE * j) for j in range(LANES))
LANE_MOST = (1 << LANE) - 1


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: Column, m: int) -> Column:
    """Hashes of the m-word shingles of an array of words, in order; none if there are fewer words."""
    at = F.when(F.size(w) >= m, F.sequence(F.lit(0), F.size(w) - m)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(m)]))


def simhash(h: Column) -> Column:
    """SimHash of an array of hashes: a bit is 1 if set in more than half of them."""
    groups = range(0, 64, LANES)
    spread = lambda x, g: (F.shiftrightunsigned(x, g).bitwiseAND(F.lit((1 << LANES) - 1)) * F.lit(SPREAD)).bitwiseAND(F.lit(LANE_ONES))
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{g}") for g in groups])
    step = lambda acc, x: F.struct(*[(acc[f"c{g}"] + spread(x, g)).alias(f"c{g}") for g in groups])
    half = F.size(h).cast("long")

    def bits(counted: Column) -> Column:
        def bit(b: int) -> Column:
            g = b - b % LANES
            n = F.shiftright(counted[f"c{g}"], LANE * (b % LANES)).bitwiseAND(F.lit(LANE_MOST))
            return F.shiftleft((n * 2 > half).cast("long"), b)

        return reduce(lambda a, b: a.bitwiseOR(b), [bit(b) for b in range(64)])

    few = F.aggregate(h, zero, step, bits)
    # lanes hold counts to 511; longer arrays are counted bit by bit
    one = lambda b: F.size(F.filter(h, lambda x: F.shiftrightunsigned(x, b).bitwiseAND(F.lit(1)) == 1)).cast("long") * 2 > half
    many = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(one(b).cast("long"), b) for b in range(64)])
    return F.when(half <= LANE_MOST, few).otherwise(many)


def _block(f: Column, k: int) -> Column:
    return F.shiftrightunsigned(f, BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _blocks(f: Column) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), _block(f, k).alias("value")) for k in range(BLOCKS)])


def met(fingerprints: DataFrame, targets: DataFrame, small=lambda d: d) -> DataFrame:
    """(n, wf, item_id, f) of all pairs of different window fingerprints (n, wf) and items (item_id, n, f) within RADIUS, each once."""
    near = F.lit([x for x in range(1 << BLOCK_BITS) if x.bit_count() <= NEAR])
    probes = targets.select("item_id", "n", "f", F.inline(_blocks(F.col("f")))).select("item_id", "n", "f", "k", "value", F.explode(near).alias("x"))
    probes = probes.select("item_id", "n", "f", "k", F.col("value").bitwiseXOR(F.col("x").cast("long")).alias("value"))
    pairs = fingerprints.select("n", "wf", F.inline(_blocks(F.col("wf")))).join(small(probes), ["n", "k", "value"])
    differ = F.col("wf").bitwiseXOR(F.col("f"))
    first = reduce(lambda c, k: c.when(F.bit_count(_block(differ, k)) <= NEAR, k), range(BLOCKS), F.when(F.lit(False), -1))
    return pairs.where((F.bit_count(differ) <= RADIUS) & (F.col("k") == first)).select("n", "wf", "item_id", "f")


def _item_table(items: DataFrame) -> DataFrame:
    """item_id, n words, m words in a shingle, h (hashes in order); items without words are left out."""
    w = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("n", F.size("w")).withColumn("m", F.least(F.col("n"), F.lit(SHINGLE)))
    h = reduce(lambda c, m: c.when(F.col("m") == m, _shingles(F.col("w"), m)), range(1, SHINGLE + 1), F.when(F.lit(False), F.array().cast("array<long>")))
    return w.select("item_id", "n", "m", h.alias("h")).distinct()


def contaminated(docs: DataFrame, items: DataFrame, stage: Stage, similarity: float = 0.8, broadcast_shingles: int = 1_000_000, short: bool = False) -> DataFrame:
    """(doc_id, copy, item_id, similarity, start, n): per text and item the best window; copy is the text's xxhash64, start in words from 0.
    With short, a text of fewer words than the item is one window, all of it; ORACLE_SQL has no window there, so that the query leaves it out.

    The items' shingles are broadcast while they number at most broadcast_shingles (about 24 MB), and joined by a shuffle beyond that; so are the items' probes, up to a quarter as many."""
    table = stage.write(_item_table(items), "items")
    shingles = stage.write(table.select("item_id", "n", "m", F.explode("h").alias("h")), "shingles")
    total = shingles.count()
    small = (lambda d: F.broadcast(d)) if total <= broadcast_shingles else (lambda d: d)
    kinds = [r["m"] for r in shingles.select("m").distinct().collect()]
    docs = docs.select("doc_id", "text")

    # 1. documents that hold a shingle of any item; rows of neighbouring words instead of arrays of hashes
    n_items = table.agg(F.countDistinct("item_id")).first()[0]
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    hits = None
    for m in kinds:
        zipped = F.arrays_zip(*[(F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(1))) if k else F.col("w")).alias(f"w{k}") for k in range(m)])
        rows = w.select("doc_id", F.inline(zipped)).where(F.col(f"w{m - 1}").isNotNull())
        known = shingles.where(F.col("m") == m).select("h").distinct()
        found = rows.select("doc_id", F.xxhash64(*[f"w{k}" for k in range(m)]).alias("h")).join(small(known), "h", "left_semi").select("doc_id").distinct()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, copy long, item_id long, similarity double, start int, n int")
    hits = stage.write(hits.distinct(), "hits")

    # their shingles' hashes; the documents are read again and joined to the hits, broadcast while they are few
    few = hits.count() <= broadcast_shingles
    same = F.col("doc_id").eqNullSafe(F.col("hit_id"))
    hit_ids = hits.select(F.col("doc_id").alias("hit_id"))
    held = docs.join(F.broadcast(hit_ids) if few else hit_ids, same, "left_semi").withColumn("w", words(F.col("text")))
    held = held.select("doc_id", F.xxhash64("text").alias("copy"), F.size("w").alias("size"), *[_shingles(F.col("w"), m).alias(f"h{m}") for m in kinds])
    held = stage.write(held.dropDuplicates(["doc_id", "copy"]), "hashes")

    # windows that hold a shingle of an item of their size
    windows = None
    for m in kinds:
        at = held.select("doc_id", "copy", "size", F.posexplode(f"h{m}").alias("pos", "h"))
        sizes = shingles.where(F.col("m") == m).select("h", "n").distinct()
        first = F.greatest(F.lit(0), F.col("pos") - (F.col("n") - m))
        beyond = F.col("size") - F.col("n")
        last = F.least(F.col("pos"), F.greatest(F.lit(0), beyond) if short else beyond)
        starts = at.join(small(sizes), "h").where(first <= last).select("doc_id", "copy", "n", F.explode(F.sequence(first, last)).alias("start"))
        starts = starts.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("n", "start")).alias("starts"))
        key = held.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), F.col(f"h{m}").alias("h"))
        here = starts.join(key, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("copy").eqNullSafe(F.col("c"))).select("doc_id", "copy", "h", F.explode("starts").alias("s"))
        part = here.select("doc_id", "copy", F.col("s.n").alias("n"), F.lit(m).alias("m"), F.col("s.start").alias("start"), F.slice("h", F.col("s.start") + 1, F.col("s.n") - m + 1).alias("wh"))
        windows = part if windows is None else windows.unionByName(part)

    # 2. and 3.
    marked = stage.write(windows.withColumn("wf", simhash(F.col("wh"))), "windows")
    df = shingles.groupBy("h").agg(F.countDistinct("item_id").alias("df"))
    per = shingles.groupBy("item_id", "n", "m", "h").agg(F.count(F.lit(1)).cast("int").alias("c")).join(df, "h")
    weight = F.round(1000 * F.log(1 + F.lit(float(n_items)) / F.col("df"))).cast("long")
    per = per.groupBy("item_id", "n", "m").agg(F.collect_list(F.struct("h", "c", weight.alias("w"))).alias("entries"))
    target = table.select("item_id", "n", "m", simhash(F.col("h")).alias("f")).join(per, ["item_id", "n", "m"])
    target = stage.write(target, "targets")
    probed = table.count() * BLOCKS * sum(math.comb(BLOCK_BITS, j) for j in range(NEAR + 1))
    # copies of a window have one fingerprint, so that a hot text is no hot key of the first join; adaptive execution splits it in the second
    pairs = stage.write(met(marked.select("n", "wf").distinct(), target.select("item_id", "n", "f"), F.broadcast if 4 * probed <= broadcast_shingles else lambda d: d), "pairs")
    pairs = pairs.join(small(target.select("item_id", "n", "f", "entries")), ["item_id", "n", "f"])
    few = pairs.count() * SHINGLE * 8 <= broadcast_shingles
    met_windows = marked.select("doc_id", "copy", "n", "start", "wh", "wf").join(F.broadcast(pairs) if few else pairs, ["n", "wf"])

    # 4.
    alone = F.lit(round(1000 * math.log(1 + n_items))).cast("long")
    entry = lambda e: F.struct(e["c"].alias("c"), e["w"].alias("w"), F.size(F.filter("wh", lambda x: x == e["h"])).alias("in_w"))
    out = met_windows.select("doc_id", "copy", "item_id", "n", "start", F.size("wh").alias("shingles"), F.transform("entries", entry).alias("e"))
    total_of = lambda f: F.aggregate("e", F.lit(0).cast("long"), lambda acc, e: acc + f(e))
    both = total_of(lambda e: F.least(e["c"], e["in_w"]) * e["w"])
    either = total_of(lambda e: F.greatest(e["c"], e["in_w"]) * e["w"]) + (F.col("shingles") - total_of(lambda e: e["in_w"].cast("long"))) * alone
    out = out.select("doc_id", "copy", "item_id", "n", "start", (both / either).alias("similarity")).where(F.col("similarity") >= similarity)
    return _best(out, ["doc_id", "copy", "item_id"])


def _best(windows: DataFrame, by: list[str]) -> DataFrame:
    """The best window by the given columns: the most similar, then the first, then the longest."""
    best = windows.groupBy(*by).agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("b"))
    return best.select(*by, F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("start"), F.col("b.n").alias("n"))


def clean(docs: DataFrame, items: DataFrame, stage: Stage, similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs that hold no item, and are none but for a few words, with their columns. Texts of one doc_id are judged each by itself."""
    found = stage.write(contaminated(docs, items, stage, similarity, short=True).select("doc_id", "copy").distinct(), "found")
    few = found.count() <= broadcast_rows
    name, copy = fresh(docs, "found_id"), fresh(docs, "found_copy")
    found = found.select(F.col("doc_id").alias(name), F.col("copy").alias(copy))
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(copy))
    return docs.join(F.broadcast(found) if few else found, same, "left_anti")


def op9_decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row for each document and benchmark item that the document holds: doc_id, item_id, similarity, start, n_words.

    Nulls: a null text, or one without words, holds nothing; an item without words or without item_id is never looked for; a null doc_id is kept as such. Repeated rows of
    one doc_id count as one document. Rows of one item_id with different texts are different items of one name. Empty tables: no rows. Further columns are ignored.
    """
    found = contaminated(docs, items, Stage(spark, "decontaminate"), similarity)
    return _best(found, ["doc_id", "item_id"]).withColumnRenamed("n", "n_words")


ORACLE_SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, w, len(w) AS n, least(len(w), 5) AS m FROM iw WHERE len(w) > 0),
ish AS (
  SELECT item_id, n, m, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT item_id, w, n, m, unnest(range(1, n - m + 2)) AS p FROM i)),
total AS (SELECT count(DISTINCT item_id) AS items FROM i),
df AS (SELECT m, s, count(DISTINCT item_id) AS df FROM ish GROUP BY m, s),
ic AS (
  SELECT item_id, n, m, s, count(*) AS c, any_value(CAST(round(1000 * ln(1 + items / df)) AS BIGINT)) AS wt
  FROM ish JOIN df USING (m, s), total GROUP BY item_id, n, m, s),
d AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (
  SELECT doc_id, size, m, p - 1 AS pos, array_to_string(w[p:p + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, len(w) AS size, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM i))),
hit AS (SELECT doc_id, size, item_id, n, m, pos, s FROM ds JOIN (SELECT DISTINCT item_id, n, m, s FROM ish) USING (m, s)),
win AS (
  SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(0, pos - (n - m)), least(pos, size - n) + 1)) AS start FROM hit),
inside AS (
  SELECT win.doc_id, win.item_id, win.n, win.m, win.start, hit.s, count(*) AS cw
  FROM win JOIN hit ON win.doc_id = hit.doc_id AND win.item_id = hit.item_id AND win.n = hit.n AND hit.pos BETWEEN win.start AND win.start + win.n - win.m
  GROUP BY ALL),
sums AS (
  SELECT doc_id, item_id, n, m, start, sum(least(c, cw) * wt) AS both_w, sum(greatest(c, cw) * wt - c * wt) AS over_w, sum(cw) AS known
  FROM inside JOIN ic USING (item_id, n, m, s) GROUP BY ALL),
scored AS (
  SELECT doc_id, item_id, n, start,
    CAST(both_w AS DOUBLE) / CAST(own + over_w + ((n - m + 1) - known) * CAST(round(1000 * ln(1 + items)) AS BIGINT) AS DOUBLE) AS similarity
  FROM sums JOIN (SELECT item_id, n, m, sum(c * wt) AS own FROM ic GROUP BY ALL) USING (item_id, n, m), total)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n DESC) AS r FROM scored WHERE similarity >= 0.8)
WHERE r = 1
"""
