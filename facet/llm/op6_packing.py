"""Packing of documents into token sequences of fixed length.

The plan is made on the histogram of piece lengths, which has at most `room` entries however many documents there are:

1. Linear grouping: pieces over half or a third of the room are grouped, by length, into groups of equal cardinality, and every length counts as
   the largest of its group.
2. Configurations: a linear programme over "which groups fill one sequence" is solved by column generation (the
   pricing problem is a knapsack). Its whole parts are taken; the few pieces left over are packed one sequence at a time, largest first
   with the best completion by exact length.
3. Substitution: actual lengths replace the rounded ones. A run of equal sequences is cut where a length runs out.
4. Best fit: small pieces, longest first, go to the sequences with the least room that holds them, a whole run at once.

What results are runs: "pieces of length l with ranks a to b go to sequences s, s+1, ... at offset o". A piece's rank among those
of its length is found by a window over (length, salt) and a table of counts; each piece then looks its place up.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, one_thread, release_unused, shuffle_partitions, small_batches
from .tokens import column_encoder

ROOM = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Texts are encoded in slices of about so many bytes, so that the ids of a slice fit a task's memory.
SLICE_BYTES = 4_000_000


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = ROOM, drops_space: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document. One longer than room is cut into pieces of exactly room ids
    but for the first, which may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        enc = column_encoder(tokenizer_path, drops_space)
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.column(1).nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, sizes = enc.encode(part.column(1), end_id)
                raw, done = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 0
                row, rows = [], []
                for i, n in enumerate(sizes.tolist()):
                    first = n % room or room
                    a, k = 0, 0
                    while a < n:
                        b = a + (room if k else first)
                        row.append(i)
                        rows.append((k, a, b - a, zlib.crc32(raw[4 * (done + a) : 4 * (done + b)])))
                        a, k = b, k + 1
                    done += n
                made = np.array(rows, dtype=np.int64).reshape(-1, 4)
                names = part.column(0).take(pa.array(row, pa.int64()))  # never through floating point
                columns = [names, pa.array(made[:, 0].astype(np.int32)), *(pa.array(np.ascontiguousarray(made[:, j])) for j in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes within room: its value and how often it has each. sizes fall."""
    up_sizes, up_values = sizes[::-1].tolist(), values[::-1].tolist()
    least = up_sizes[0]
    best, took = [0.0] * (room + 1), [-1] * (room + 1)
    up, vals = np.array(up_sizes), np.array(up_values)
    table = np.zeros(room + 1)
    fit = np.searchsorted(up, np.arange(room + 1), side="right").tolist()
    for c in range(least, room + 1):
        v = table[c - up[: fit[c]]] + vals[: fit[c]]
        k = int(v.argmax())
        if v[k] > best[c - 1] + 1e-12:
            best[c], took[c] = float(v[k]), k
        else:
            best[c], took[c] = best[c - 1], -2
        table[c] = best[c]
    counts = np.zeros(len(sizes), dtype=np.int64)
    c = room
    while c > 0 and took[c] != -1:
        if took[c] == -2:
            c -= 1
        else:
            counts[len(sizes) - 1 - took[c]] += 1
            c -= up_sizes[took[c]]
    return best[room], counts


def configurations(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Columns of the linear programme's solution and their amounts. sizes must be different; demand positive."""
    k = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    for _ in range(rounds):
        amount = np.linalg.solve(basis, demand.astype(float))
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = _knapsack(sizes, np.maximum(price, 0), room)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = column
    amount = np.linalg.solve(basis, demand.astype(float))
    return [(np.rint(basis[:, j]).astype(np.int64), float(amount[j])) for j in range(k)]


def _complete(left: dict[int, int], room: int) -> list[int]:
    """Lengths, of those left, that fill the room best: subset sums as bits of a whole number."""
    reach, layers = 1, []
    whole = (1 << (room + 1)) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        for _ in range(min(left[length], room // length)):
            new = (reach | reach << length) & whole
            if new == reach:
                break
            layers.append((length, reach))
            reach = new
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    out = []
    for length, was in reversed(layers):
        if not was >> at & 1:
            out.append(length)
            at -= length
    return out


def plan(counts: dict[int, int], room: int = ROOM, groups: int = 64) -> list[tuple[int, tuple[int, ...]]]:
    """Runs of equal sequences: (how many, lengths in each). counts: pieces by length, 1 to room.

    Where large ends and small begins decides how much rounding costs and how much best fit must mend; a half and a third of the room are both tried, and the plan with fewer sequences is kept."""
    return min((plan_above(counts, room, limit, groups) for limit in (room // 2, room // 3)), key=lambda runs: sum(t for t, _ in runs))


def plan_above(counts: dict[int, int], room: int, limit: int, groups: int = 64) -> list[tuple[int, tuple[int, ...]]]:
    """The plan in which pieces longer than limit are large."""
    counts = {int(k): int(v) for k, v in counts.items() if v}
    runs: list[tuple[int, list[int]]] = []
    if n := counts.pop(room, 0):
        runs.append((n, [room]))
    large = sorted((x for x in counts if x > limit), reverse=True)
    left = {x: counts[x] for x in large}
    if large:
        total = sum(left.values())
        queues: list[deque] = []
        sizes: list[int] = []
        per = max(1, -(-total // groups))
        seen = 0
        for x in large:  # a length is never split between groups
            if not queues or seen >= per:
                queues.append(deque())
                sizes.append(x)
                seen = 0
            queues[-1].append([x, left[x]])
            seen += left[x]
        demand = np.array([sum(c for _, c in q) for q in queues])
        for column, amount in configurations(np.array(sizes), demand, room):
            m = int(np.floor(amount + 1e-9))
            m = min([m, *(sum(c for _, c in queues[g]) // int(q) for g, q in enumerate(column) if q)]) if column.any() else 0
            while m > 0:
                take, t = [], m
                for g, q in enumerate(column):
                    if q and queues[g][0][1] >= q:
                        t = min(t, queues[g][0][1] // int(q))
                    elif q:
                        t = 1
                for g, q in enumerate(column):
                    need = int(q) * t
                    while need:
                        head = queues[g][0]
                        x = min(need, head[1])
                        take += [head[0]] * (x // t if x >= t and x % t == 0 else x)
                        head[1] -= x
                        left[head[0]] -= x
                        need -= x
                        if not head[1]:
                            queues[g].popleft()
                runs.append((t, take))
                m -= t
        left = {x: c for x, c in left.items() if c}
        while left:
            x = max(left)
            left[x] -= 1
            rest = {k: c for k, c in left.items() if c}
            take = [x, *_complete(rest, room - x)]
            for y in take[1:]:
                left[y] -= 1
            t = 1 + min((left[y] // take.count(y) for y in set(take)), default=0)
            for y in set(take):
                left[y] -= (t - 1) * take.count(y)
            runs.append((t, take))
            left = {k: c for k, c in left.items() if c}
    # best fit of what is small
    by_room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for t, take in runs:
        by_room[room - sum(take)].append((t, take))
    open_rooms = np.zeros(room + 1, dtype=bool)
    for r in by_room:
        open_rooms[r] = True
    for length in sorted((x for x in counts if x <= limit), reverse=True):
        n = counts[length]
        while n:
            fits = np.flatnonzero(open_rooms[length:])
            if len(fits):
                r = int(fits[0]) + length
                t, take = by_room[r].pop()
                if not by_room[r]:
                    open_rooms[r] = False
                if t > n:
                    by_room[r].append((t - n, take))
                    open_rooms[r] = True
                    t = n
                by_room[r - length].append((t, [*take, length]))
                open_rooms[r - length] = True
                n -= t
            else:
                q = room // length
                t, q = (n // q, q) if n >= q else (1, n)
                by_room[room - q * length].append((t, [length] * q))
                open_rooms[room - q * length] = True
                n -= t * q
    return [(t, tuple(take)) for r in sorted(by_room) for t, take in by_room[r]]


def places(runs: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a lookup: length << 40 | first rank, in order, with the first sequence and the offset of each."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for t, take in runs:
        at = 0
        for length in take:
            rows.append((length << 40 | used[length], first, at))
            used[length] += t
            at += length
        first += t
    rows.sort()
    a = np.array(rows, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def pack(staged: DataFrame, room: int = ROOM, groups: int = 64) -> DataFrame:
    """Adds sequence_id and offset to staged pieces (doc_id, piece, start, length, ids_crc32), which must read the same each time."""
    spark = staged.sparkSession
    salts = max(16, shuffle_partitions(spark))
    salted = staged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in staged.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    keys, firsts, offsets = places(plan(histogram, room, groups))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    mine = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("mine", mine).join(per, ["length", "salt"]).withColumn("rank", F.col("mine") - 1 + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(3).to_numpy() << 40 | batch.column(5).to_numpy()
            k = np.searchsorted(keys, key, side="right") - 1
            placed = [pa.array(firsts[k] + (key - keys[k])), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *placed], names=[*NAMES, "sequence_id", "offset"])

    ranked = ranked.select(*NAMES, F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, room: int = ROOM) -> DataFrame:
    """Packs all documents (doc_id, text): a row per piece with its place.

    Nulls: a null text is an empty one (the end id alone); a null doc_id stays null, and others keep all their digits beside it. Ties and repeated rows: pieces of equal length are
    interchangeable, each gets a place of its own. Empty table: no rows. Further columns are ignored.
    """
    with small_batches(spark):
        staged = Stage(spark, "packing").write(pieces(docs, tokenizer_path, end_id, room), "pieces")
    return pack(staged, room)
