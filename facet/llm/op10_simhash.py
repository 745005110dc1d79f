"""SimHash near-duplicates by anchor points of a covering code.

A 64-bit fingerprint is read as two halves of 32 bits. Two fingerprints that differ in at most 3 bits differ in at most 1 bit in
one half. The anchors of a half are the 2**26 words of the Hamming code of length 31 over its first 31 bits, a covering
code of radius 1. Each fingerprint is at home at its nearest anchor (within the covering radius, 1) and visits every anchor
within the radius plus the threshold left for the half (1 + 1 = 2): its home and, where it is no code word itself, 15 more. So for every linked pair
each member visits the other's home in one half, and it is enough to compare visitors with those at home, anchor by anchor.

Only different fingerprints take part; documents are joined to them at the end. The pairs of an anchor with more than block_rows homes or visitors
are split into a grid of blocks. Of a block's links only a spanning forest leaves the task, so that a group of copies gives no
more links than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fresh, one_thread, shuffle_partitions
from .components import components

THRESHOLD = 3
#: Parity-check columns of the Hamming code: bit j of a half (0 to 30) has the number j + 1, so that the XOR of the numbers of the set
#: bits (the syndrome) names the bit to flip for the nearest code word, 0 for none.
HALF_BITS = 31
MASK = np.uint64((1 << HALF_BITS) - 1)
#: Bits at which number bit k is set, for k = 0 to 4.
CHECKS = [np.uint64(sum(1 << j for j in range(HALF_BITS) if (j + 1) >> k & 1)) for k in range(5)]


def fingerprint(text: str | None, words_per: int = 3) -> int:
    """64-bit SimHash of the words' shingles, repeats included: A-Z lower-cased, words parted by ASCII white space, XXH64 with seed 42;
    a bit is 1 if set in more than half of the hashes. Fewer words than a shingle: the whole sequence; none: 0."""
    import xxhash

    w = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space alone
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    if len(w) <= words_per:
        return digest(join(w), 42)
    if words_per == 3:
        hashes = [digest(join(x), 42) for x in zip(w, w[1:], w[2:])]
    else:
        hashes = [digest(join(w[k : k + words_per]), 42) for k in range(len(w) - words_per + 1)]
    total = np.zeros(64, dtype=np.int64)
    h = np.array(hashes, dtype=np.uint64).view(np.uint8)
    for k in range(0, len(h), 1 << 20):
        total += np.unpackbits(h[k : k + (1 << 20)].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words_per: int = 3) -> DataFrame:
    """(doc_id, copy, f): copy is the text's xxhash64, f the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words_per) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", F.xxhash64("text").alias("copy"), F.pandas_udf(run, "long")(F.col("text")).alias("f"))


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), dtype=np.uint64)
    for k, check in enumerate(CHECKS):
        out |= (np.bitwise_count(half & check).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def anchors(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every visit. An anchor's number holds the half it belongs to in bit 32."""
    rows, names, homes = [], [], []
    one = np.uint64(1)
    every = np.arange(len(f))
    for part in (0, 1):
        half = (f >> np.uint64(32 * part)) & MASK
        tag = np.uint64(part << 32)
        s = _syndrome(half)
        near = np.where(s == 0, half, half ^ (one << (np.maximum(s, one) - one)))
        rows.append(every)
        names.append(near | tag)
        homes.append(np.ones(len(f), dtype=bool))
        off = s != 0
        x, sx, r = half[off], s[off], every[off]
        # code words at distance 2 from a word with syndrome s: flip bits i and j with numbers i ^ j = s
        for i in range(1, HALF_BITS + 1):
            j = sx ^ np.uint64(i)
            ok = (j > i) & (j <= HALF_BITS)
            rows.append(r[ok])
            names.append((x[ok] ^ (one << np.uint64(i - 1)) ^ (one << (j[ok] - one))) | tag)
            homes.append(np.zeros(int(ok.sum()), dtype=bool))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(homes)


def visits(distinct: DataFrame) -> DataFrame:
    """(anchor, f, home) of every fingerprint in distinct (f)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["f"].to_numpy().view(np.uint64)
            for k in range(0, len(f), 4096):
                part = f[k : k + 4096]
                r, a, h = anchors(part)
                yield pd.DataFrame({"anchor": a.view(np.int64), "f": part[r].view(np.int64), "home": h})

    return distinct.select("f").mapInPandas(run, "anchor long, f long, home boolean")


def forest(homes: np.ndarray, guests: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and guests (each may hold members of the other)."""
    nodes = np.unique(np.concatenate([homes, guests]))
    parent = np.arange(len(nodes))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    at_home, at_guest = np.searchsorted(nodes, homes), np.searchsorted(nodes, guests)
    step = max(1, (1 << 20) // max(1, len(guests)))
    for k in range(0, len(homes), step):
        near = np.bitwise_count(homes[k : k + step, None] ^ guests[None, :]) <= threshold
        a, b = np.nonzero(near)
        for x, y in zip(at_home[k + a].tolist(), at_guest[b].tolist()):
            if x != y and (p := find(x)) != (q := find(y)):
                parent[max(p, q)] = min(p, q)
                out.append((int(nodes[x]), int(nodes[y])))
    return out


LINKS = "u long, v long"


def links(distinct: DataFrame, stage: Stage, threshold: int = THRESHOLD, block_rows: int = 500) -> DataFrame:
    """Links (u, v) that connect what links at the threshold connects, over the different fingerprints in distinct (f).

    Anchors are counted first; anchors without a home or with one fingerprint alone go no further."""
    seen = stage.write(visits(distinct), "visits")
    counts = seen.groupBy("anchor").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count(F.lit(1)).alias("n")).where("homes > 0 and n > 1")
    size = lambda c: F.ceil(F.col(c) / block_rows).cast("int")
    busy = seen.join(counts.select("anchor", size("homes").alias("h"), size("n").alias("g")), "anchor")
    # the pairs of an anchor are a grid of h blocks of homes by g blocks of visitors; a home also visits
    busy = busy.withColumn("at_h", F.pmod(F.xxhash64("f"), F.col("h")).cast("int")).withColumn("at_g", F.pmod(F.hash("f"), F.col("g")).cast("int"))
    cell = lambda h, g: F.struct(h.alias("h"), g.alias("g"))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda h: cell(h, F.col("at_g")))
    as_home = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda g: cell(F.col("at_h"), g))
    cells = F.when(F.col("h") * F.col("g") == 1, F.array(cell(F.col("at_h"), F.col("at_g"))))
    cells = cells.when(F.col("home"), F.array_union(as_guest, as_home)).otherwise(as_guest)
    dealt = busy.select("anchor", "f", "home", "at_h", "at_g", F.explode(cells).alias("cell")).select(
        "anchor", F.col("cell.h").alias("h"), F.col("cell.g").alias("g"), "f", (F.col("home") & (F.col("at_h") == F.col("cell.h"))).alias("home"), (F.col("at_g") == F.col("cell.g")).alias("guest")
    )

    def compared(pdf: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        """Links of whole cells that begin at cuts."""
        f, home, guest = pdf["f"].to_numpy().view(np.uint64), pdf["home"].to_numpy(), pdf["guest"].to_numpy()
        ends = np.r_[cuts[1:], len(pdf)]
        two = ends - cuts == 2
        # most cells hold two fingerprints: compare those at once
        a = cuts[two]
        ok = (home[a] & guest[a + 1] | home[a + 1] & guest[a]) & (np.bitwise_count(f[a] ^ f[a + 1]) <= threshold)
        out = [np.stack([f[a[ok]], f[a[ok] + 1]], axis=1)]
        for x, y in zip(cuts[~two].tolist(), ends[~two].tolist()):
            if y - x > 2 and (pairs := forest(f[x:y][home[x:y]], f[x:y][guest[x:y]], threshold)):
                out.append(np.array(pairs, dtype=np.uint64))
        p = np.concatenate(out).view(np.int64)
        return pd.DataFrame({"u": p[:, 0], "v": p[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells lie together, in order; one may run over several batches, and holds about 2 * block_rows rows."""
        one_thread()
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["anchor", "h", "g"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            held = pdf.iloc[cuts[-1] :]
            if len(cuts) > 1:
                yield compared(pdf.iloc[: cuts[-1]], cuts[:-1])
        if held is not None and len(held):
            yield compared(held, np.zeros(1, dtype=np.int64))

    n = shuffle_partitions(distinct.sparkSession)
    found = dealt.repartition(n, "anchor", "h", "g").sortWithinPartitions("anchor", "h", "g").mapInPandas(run, LINKS)
    out = stage.write(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    stage.drop(seen)
    return out


def classes(docs: DataFrame, stage: Stage, threshold: int = THRESHOLD, words_per: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, f) of every document, and (f, component_id, keep) of every fingerprint; keep is (doc_id, copy) of the component's first row."""
    marked = stage.write(fingerprints(docs, words_per), "fingerprints")
    # one row for each fingerprint: copies never meet each other
    distinct = stage.write(marked.groupBy("f").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "copy")).alias("row")), "distinct")
    return marked, named_components(distinct, links(distinct, stage, threshold), stage)


def named_components(distinct: DataFrame, found: DataFrame, stage: Stage) -> DataFrame:
    """(f, component_id, keep) of every f in distinct (f, low, row), over the links found."""
    rooted = components(found, stage)
    named = stage.write(rooted.join(distinct, rooted["node"] == distinct["f"]).select("node", "root", "low", "row"), "named")
    least = named.groupBy("root").agg(F.min("low").alias("least"), F.min("row").alias("first"))
    linked = named.join(least, "root").select(F.col("node").alias("f"), "least", "first", F.lit(True).alias("linked"))
    chosen = distinct.join(linked, "f", "left")
    per = chosen.select("f", F.when(F.col("linked"), F.col("least")).otherwise(F.col("low")).alias("component_id"), F.when(F.col("linked"), F.col("first")).otherwise(F.col("row")).alias("keep"))
    return stage.write(per, "components")


def one_of_each(docs: DataFrame, stage: Stage, threshold: int = THRESHOLD) -> DataFrame:
    """One row of docs for each component, with its columns: the least (doc_id, hash of the text), a null doc_id first."""
    _, per = classes(docs, stage, threshold)
    return keep_first(docs, per)


def keep_first(docs: DataFrame, per: DataFrame) -> DataFrame:
    """The rows of docs that per names in keep, one of each."""
    name, copy, mine = fresh(docs, "keep_id"), fresh(docs, "keep_copy"), fresh(docs, "own_copy")
    kept = per.select(F.col("keep.doc_id").alias(name), F.col("keep.copy").alias(copy)).distinct()
    here = docs.withColumn(mine, F.xxhash64("text"))
    out = here.join(kept, F.col("doc_id").eqNullSafe(F.col(name)) & (F.col(mine) == F.col(copy)), "left_semi")
    return out.dropDuplicates(["doc_id", mine]).drop(mine)


def op10_simhash(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Per document (doc_id, text): doc_id, fingerprint (16 lowercase hex digits), component_id (least doc_id reachable over links of at most
    threshold differing bits).

    Nulls: a null text is an empty one, fingerprint zero, linked like any other; a null doc_id never names a component unless it has no other
    member (then component_id is null). Repeated rows stay, in one component. Empty table: no rows. Further columns are ignored.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover differences of 0 to {THRESHOLD} bits")
    marked, per = classes(docs, Stage(spark, "simhash"), threshold)
    return marked.select("doc_id", "f").join(per.select("f", "component_id"), "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
