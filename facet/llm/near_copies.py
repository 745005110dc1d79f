"""Near copies for the pipeline: texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8, and what such links connect.

Words are those of op10's fingerprints; a text of fewer words has one shingle, all of it, and one without words has none. Texts with the same set are one row from the start.

1. Each set gets a fingerprint of PARTS halves of 31 bits: SimHashes in which a shingle weighs u**-4, u a hash in (0, 1] of the shingle, another for each quarter of a word. With equal weights, sets at similarity
   0.8 differ in 15 % of the bits, beyond what a covering code of radius 1 can reach; with these, few shingles rule a quarter. Halves then differ in at most 1 bit with probability 0.61 at 0.8, 0.69 at 0.85, 0.01 at 0.1. A pair
   is missed if all halves differ in more: 1.4e-5 at 0.8 and 7e-7 at 0.85, by those shares (simulated).
2. Each half visits op10's anchors, those of the Hamming code of length 31: its home and, where it is no code word itself, those within distance 2. Of two halves that differ in at most 1 bit each visits the other's home.
   At anchors the halves are compared; sets that are within 1 bit of no other, at a home of one of both, go no further, nor do anchors with the same members as others. Crowded anchors become grids of blocks. There whole fingerprints are
   compared: sets with LEAST quarters within 1 bit of no other's go no further.
3. The sets of what is left are made again from the texts, and compared exactly. Of a block's links only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, one_thread, shuffle_partitions
from .op10_simhash import LINKS, MASK, anchors, keep_first, named_components

SHINGLE = 5
SIMILARITY = 0.8
WORDS = 6  # of 64 bits, each of two halves, as op10's fingerprints are
PARTS = 2 * WORDS
QUARTERS = 2 * PARTS  # of 16 bits; a quarter has weights of its own
_random = np.random.default_rng(8)
FACTORS = _random.integers(0, 1 << 63, 3 * WORDS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
SHIFTS = _random.integers(0, 1 << 63, 3 * WORDS, dtype=np.uint64)
#: A visit is its anchor's number, then PLACE bits for the bits (at most two, by number) in which the half differs from the anchor, so that homes come first.
PLACE = 10
FLIPS = np.array([sum(1 << (b - 1) for b in {k >> 5, k & 31} if b) for k in range(1 << PLACE)], dtype=np.uint32)
HOME = 32  # places below are at home: one bit at most
CROWDED = 256
LEAST = 8  # quarters within 1 bit: 11 to 24 for 2500 simulated pairs at similarity 0.8, 2 in the mean at 0.1
CELLS = "bucket long, h int, k int, at int, f long"


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted different hashes of the text's shingles."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(w) < SHINGLE:
        return np.array([digest(join(w), 42)] if w else [], dtype=np.uint64)
    return np.unique(np.array([digest(join(x), 42) for x in zip(w, w[1:], w[2:], w[3:], w[4:])], dtype=np.uint64))


def signature(held: np.ndarray) -> tuple[int, np.ndarray]:
    """(f, words) of a set: a hash of the whole set, and its fingerprint, two halves to a word."""
    import xxhash

    total, weight = np.zeros((QUARTERS, 16)), np.zeros((QUARTERS, 1))
    for k in range(0, len(held), 1024):
        m = held[k : k + 1024, None] * FACTORS + SHIFTS
        m = (m ^ m >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(m[:, :WORDS]).view(np.uint8), axis=1, bitorder="little").reshape(len(m), QUARTERS, 16)
        u = (np.ascontiguousarray(m[:, WORDS:]).view("<u4") + 0.5) * 2.0**-32
        w = 1 / np.square(np.square(u))
        total += (w.T[:, None, :] @ bits.transpose(1, 0, 2).astype(np.float64))[:, 0]
        weight += w.sum(axis=0)[:, None]
    words = np.packbits(2 * total > weight, axis=1, bitorder="little").reshape(-1).view("<u8")
    return xxhash.xxh64_intdigest(held.tobytes(), 42), words


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, f, buckets) of every row; copy is the text's xxhash64, buckets the fingerprint's words. A set without shingles has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one_thread()
        for pdf in batches:
            f, buckets = [], []
            for t in pdf["text"]:
                held = shingle_set(t)
                whole, words = signature(held)
                f.append(whole)
                buckets.append(words.view(np.int64) if len(held) else np.array([], dtype=np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "copy": pdf["copy"], "f": np.array(f, dtype=np.uint64).view(np.int64), "buckets": buckets})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").mapInPandas(run, "doc_id long, copy long, f long, buckets array<long>")


def places(words: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, visit) of every anchor that the halves of the fingerprints' words of that number visit."""
    row, name, _ = anchors(words)
    off = (words[row] >> (name >> np.uint64(32) << np.uint64(5)) & MASK) ^ name & MASK
    low = off & (~off + np.uint64(1))
    bit = lambda x: np.where(x > 0, np.bitwise_count(x - (x > 0)) + 1, 0).astype(np.uint64)
    return row, ((np.uint64(number << 33) | name) << np.uint64(PLACE) | bit(off ^ low) << np.uint64(5) | bit(low)).view(np.int64)


def met(visit: np.ndarray) -> np.ndarray:
    """Which of sorted visits, whole anchors, lie within 1 bit of another, one of both at home; at crowded anchors all."""
    flips = FLIPS[visit & (1 << PLACE) - 1]
    home = (visit & (1 << PLACE) - 1) < HOME
    anchor = visit >> PLACE
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(visit)])
    size, start = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    out = size > CROWDED
    at = np.flatnonzero(home & (size > 1) & ~out)
    for k in range(0, len(at), 4096):
        one = at[k : k + 4096]
        n = size[one]
        left = np.repeat(one, n)
        right = np.arange(len(left)) + np.repeat(start[one] - (np.cumsum(n) - n), n)
        near = (left != right) & (np.bitwise_count(flips[left] ^ flips[right]) <= 1)
        out[left[near]] = out[right[near]] = True
    return out


def visits(distinct: DataFrame) -> DataFrame:
    """(bucket, f) for every anchor at which the set f in distinct (f, buckets) meets another that differs in at most 1 bit of the half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            lists = batch.column(1)
            held = np.flatnonzero(lists.value_lengths().to_numpy())
            f, words = batch.column(0).to_numpy()[held], lists.flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
            for k in range(0, len(f), 4096):
                for j in range(WORDS):
                    row, visit = places(words[k : k + 4096, j], j)
                    yield pa.RecordBatch.from_arrays([pa.array(visit), pa.array(f[k + row])], names=["visit", "f"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Visits of an anchor lie together, in order, and may run over several batches."""
        one_thread()
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # of the last anchor so far
        empty = np.array([], dtype=np.int64)
        for visit, f in chain(((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows), [(empty, empty)]):
            anchor = visit >> PLACE
            last = len(visit) and int(np.searchsorted(anchor, anchor[-1]))
            if len(visit) and not last and parts and parts[-1][0][-1] >> PLACE == anchor[0]:
                parts.append((visit, f))
                continue
            v, whole = (np.concatenate([*(p[i] for p in parts), x[:last]]) for i, x in enumerate((visit, f)))
            parts = [(visit[last:], f[last:])] if len(visit) else []
            if len(v):
                ok = met(v)
                yield pa.RecordBatch.from_arrays([pa.array(v[ok] >> PLACE), pa.array(whole[ok])], names=["bucket", "f"])

    n = shuffle_partitions(distinct.sparkSession)
    seen = distinct.select("f", "buckets").mapInArrow(run, "visit long, f long")
    return seen.repartition(n, F.shiftright("visit", PLACE)).sortWithinPartitions("visit").mapInArrow(compare, "bucket long, f long")


def alike(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of some fingerprints (rows of words) among left have one among right, or the other way round, with LEAST quarters within 1 bit."""
    q = np.ascontiguousarray(words).view(np.uint16)
    out = np.zeros(len(q), dtype=bool)
    for i in left.tolist():
        near = right[(np.bitwise_count(q[i] ^ q[right]) <= 1).sum(axis=1) >= LEAST]
        near = near[near != i]
        out[near] = True
        out[i] |= len(near) > 0
    return out


def whole_fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of CELLS and buckets that are like another of their cell. Cells lie together, in order; one may run over several batches."""
    one_thread()
    held = None
    for pdf in chain(batches, [None]):
        if pdf is not None:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if held is None or not len(held):
            continue
        key = held[["bucket", "h", "k"]].to_numpy()
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        cuts = np.r_[cuts, len(held)] if pdf is None else cuts
        at, words = held["at"].to_numpy(), np.stack(held["buckets"].tolist()).view(np.uint64)
        ok = np.zeros(len(held), dtype=bool)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                ok[a:b] = alike(words[a:b], np.flatnonzero(at[a:b] == key[a, 1]), np.flatnonzero(at[a:b] == key[a, 2]))
        yield held.loc[ok, ["bucket", "h", "k", "at", "f"]]
        held = held.iloc[cuts[-1] :]


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of left and those of right (positions in sets)."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.array([len(s) for s in sets])
    different, number = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    to = np.concatenate([number[starts[j] : starts[j + 1]] for j in right])
    cuts = np.r_[0, np.cumsum(sizes[right])[:-1]]
    mark = np.zeros(len(different), dtype=np.int64)
    out = []
    for i in left.tolist():
        own = number[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[to], cuts)
        mark[own] = 0
        for j in right[both >= similarity * (sizes[i] + sizes[right] - both) - 1e-9].tolist():
            if i != j and (p := find(i)) != (q := find(j)):
                parent[max(p, q)] = min(p, q)
                out.append((i, j))
    return out


def links(distinct: DataFrame, docs: DataFrame, stage: Stage, similarity: float = SIMILARITY, block_rows: int = 200) -> DataFrame:
    """Links (u, v) that connect what links at the similarity connects, over the different sets in distinct (f, row, buckets)."""
    seen = stage.write(visits(distinct), "visits")
    counts = seen.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("f")).alias("members")).where("n > 1")
    counts = counts.groupBy("n", "members").agg(F.min("bucket").alias("bucket"))
    busy = stage.write(seen.join(counts.select("bucket", F.ceil(F.col("n") / block_rows).cast("int").alias("g")), "bucket"), "busy")

    at = F.pmod(F.xxhash64("f"), F.col("g")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda o: F.struct(F.least(F.col("at"), o).alias("h"), F.greatest(F.col("at"), o).alias("k")))
    dealt = busy.withColumn("at", at).select("bucket", "f", "at", F.explode(others).alias("cell")).select("bucket", "f", "at", F.col("cell.h").alias("h"), F.col("cell.k").alias("k"))

    n = shuffle_partitions(distinct.sparkSession)
    cells = dealt.join(distinct.select("f", "buckets"), "f").select("bucket", "h", "k", "at", "f", "buckets").repartition(n, "bucket", "h", "k").sortWithinPartitions("bucket", "h", "k")
    close = stage.write(cells.mapInPandas(whole_fingerprints, CELLS), "close")

    # the sets are made from the texts again: stored for all texts they would be larger than those
    wanted = distinct.join(close.select("f").distinct(), "f", "left_semi").select("f", F.col("row.doc_id").alias("row_id"), F.col("row.copy").alias("row_copy"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("copy") == F.col("row_copy"))).select("f", "text")

    def make(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one_thread()
        for part in batches:
            yield pd.Series([shingle_set(t).tobytes() for t in part])

    sets = stage.write(texts.select("f", F.pandas_udf(make, "binary")(F.col("text")).alias("held")).dropDuplicates(["f"]), "sets")

    def compared(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        """Links of one whole cell."""
        f, at, h, k = pdf["f"].to_numpy(), pdf["at"].to_numpy(), pdf["h"].iloc[0], pdf["k"].iloc[0]
        left, right = np.flatnonzero(at == h), np.flatnonzero(at == k)
        if not len(left) or not len(right) or len(pdf) < 2:
            return []
        return [(int(f[a]), int(f[b])) for a, b in forest([np.frombuffer(x, "<u8") for x in pdf["held"]], left, right, similarity)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells lie together, in order; one may run over several batches, and holds about 2 * block_rows rows."""
        one_thread()
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            key = pdf[["bucket", "h", "k"]].to_numpy()
            cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            held = pdf.iloc[cuts[-1] :]
            out = [p for a, b in zip(cuts[:-1], cuts[1:]) for p in compared(pdf.iloc[a:b])]
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
        if held is not None and len(held) and (out := compared(held)):
            yield pd.DataFrame(out, columns=["u", "v"])

    rows = close.join(sets, "f").repartition(n, "bucket", "h", "k").sortWithinPartitions("bucket", "h", "k")
    found = rows.select("bucket", "h", "k", "at", "f", "held").mapInPandas(run, LINKS)
    out = stage.write(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for t in (seen, busy, close, sets):
        stage.drop(t)
    return out


def one_of_each(docs: DataFrame, stage: Stage, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each component of near copies, with its columns: the least (doc_id, hash of the text), a null doc_id first."""
    marked = stage.write(signatures(docs), "signatures")
    distinct = stage.write(marked.groupBy("f").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "copy")).alias("row"), F.first("buckets").alias("buckets")), "distinct")
    stage.drop(marked)
    return keep_first(docs, named_components(distinct.select("f", "low", "row"), links(distinct, docs, stage, similarity), stage))
