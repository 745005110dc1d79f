"""Collections as versioned Parquet: segments named by a manifest, one manifest for each commit.

A commit writes new segments and then one manifest, created exclusively under the next number; whoever loses that race has written nothing that anyone reads. Every earlier manifest stays a readable snapshot until
vacuum(). Updates and deletes append a segment and name the ids it replaces; reading folds newer segments over older ones by anti-joins, and compaction folds them for good.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import Schema, SchemaError

ID = "_id"


class StoreError(Exception):
    pass


class CollectionExists(StoreError):
    pass


class NoSuchCollection(StoreError):
    pass


class RecordExists(StoreError):
    pass


class UniqueViolation(StoreError):
    pass


class Conflict(StoreError):
    pass


#: Working columns of a read.
_SEGMENT, _GONE = "_facet_segment", "_facet_gone"


def _among(df: DataFrame, ids: Iterable[int]) -> DataFrame:
    """The rows of some ids: a pushed filter while they are few, a join beyond that."""
    ids = list(ids)
    if len(ids) <= 100:
        return df.where(F.col(ID).isin(ids))
    return df.join(df.sparkSession.createDataFrame([(i,) for i in ids], f"{ID} long").distinct(), ID, "left_semi")


class Files:
    """The few file operations the store needs, through Hadoop's file systems, so that a path may lie anywhere Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, data: str) -> bool:
        """Creates a file with its whole content, or returns False if it is there: written aside, then renamed. Two writers can't both win where a rename fails if its target is there, as on HDFS and local folders;
        an object store without such a rename needs a single writer."""
        if self.fs.exists(self.path(name)):
            return False
        aside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(aside), False)
        out.write(bytearray(data.encode()))
        out.close()
        try:
            if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(aside), self.path(name)):
                self.fs.delete(self.path(aside), False)
                return False
        except Exception:
            with contextlib.suppress(Exception):
                self.fs.delete(self.path(aside), False)
            return False
        return True

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def ages(self, folder: str) -> list[tuple[str, float]]:
        """(name, seconds since it was last written)."""
        p = self.path(folder)
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def copy(self, name: str, to: Files) -> None:
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(name), to.fs, to.path(name), False, True, self.conf)


class Store:
    """create_collection, insert, update (an upsert), delete, get, scan, transactions, snapshots, unique constraints."""

    def __init__(self, spark: SparkSession, root: str, compact_after: int = 32):
        """compact_after: a commit that leaves a collection with so many segments compacts it."""
        self.spark, self.files, self.compact_after = spark, Files(spark, root), compact_after
        if not self.files.names("manifests"):
            self.files.create("manifests/0.json", json.dumps({"version": 0, "collections": {}}))

    # versions

    def version(self) -> int:
        return max(int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        try:
            return json.loads(self.files.read(f"manifests/{v}.json"))
        except Exception as e:
            raise StoreError(f"no version {v}") from e

    def _publish(self, manifest: dict) -> int:
        v = manifest["version"] + 1
        if not self.files.create(f"manifests/{v}.json", json.dumps(manifest | {"version": v})):
            raise Conflict(f"version {v} was committed by another writer")
        return v

    def _of(self, manifest: dict, name: str) -> dict:
        if name not in manifest["collections"]:
            raise NoSuchCollection(name)
        return manifest["collections"][name]

    # definition

    def create_collection(self, name: str, schema: Schema | None = None) -> None:
        m = self.manifest()
        if name in m["collections"]:
            raise CollectionExists(name)
        m["collections"][name] = {"schema": (schema or Schema()).to_json(), "spark": None, "segments": [], "next_id": 0, "epoch": 0, "unique": [], "cluster": None}
        self._publish(m)

    def drop_collection(self, name: str) -> None:
        m = self.manifest()
        self._of(m, name)
        del m["collections"][name]
        self._publish(m)

    def collections(self) -> list[str]:
        return sorted(self.manifest()["collections"])

    def schema(self, name: str) -> Schema:
        return Schema.from_json(self._of(self.manifest(), name)["schema"])

    def epoch(self, name: str) -> int:
        return self._of(self.manifest(), name)["epoch"]

    def alter_schema(self, name: str, new: Schema) -> None:
        """Adds nullable fields at the end or drops some from the end without touching data; any other change rewrites what is stored, and is refused if a row doesn't fit."""
        m = self.manifest()
        c = self._of(m, name)
        old = Schema.from_json(c["schema"])
        if not old.accepts_evolution(new) and c["segments"]:
            df = self.scan(name)
            shown = [F.col(f"`{x.name}`").cast(x.type.spark()).alias(x.name) if x.name in df.columns else F.lit(None).cast(x.type.spark()).alias(x.name) for x in new.columns]
            df = df.select(ID, *shown) if new.columns else df
            new.check_frame(df)
            c["segments"] = [self._segment(name, df, [])]
            c["spark"] = df.drop(ID).schema.jsonValue()
        c["schema"], c["epoch"] = new.to_json(), c["epoch"] + 1
        self._publish(m)

    def freeze_schema(self, name: str) -> Schema:
        from .schema import infer

        new, old = infer(self.scan(name)), self.schema(name)
        if new.rigidity <= old.rigidity:
            raise SchemaError("nothing to freeze: rigidity would not rise")
        self.alter_schema(name, new)
        return new

    def add_unique(self, name: str, field: str) -> None:
        m = self.manifest()
        c = self._of(m, name)
        self._check_unique(self.scan(name), [field])
        c["unique"] = sorted({*c["unique"], field})
        self._publish(m)

    # reading

    def scan(self, name: str, version: int | None = None) -> DataFrame:
        """All live rows with their _id; order is the reader's to ask for."""
        return self._read(self._of(self.manifest(version), name))

    def _read(self, c: dict) -> DataFrame:
        spark = self.spark
        stored = T.StructType.fromJson(c["spark"]) if c["spark"] else T.StructType([])
        declared = Schema.from_json(c["schema"])
        have = {f.name: f for f in stored.fields}
        # declared fields first; a strict schema hides stored fields that it has dropped
        fields = T.StructType([have.get(f.name, f) for f in declared.spark().fields])
        if declared.mode in ("dynamic", "declared"):
            names = {f.name for f in fields.fields}
            fields = T.StructType([*fields.fields, *[f for f in stored.fields if f.name not in names]])
        schema = T.StructType([T.StructField(ID, T.LongType(), False), *[T.StructField(f.name, f.dataType, True) for f in fields.fields]])
        # a row lives unless a later segment names its id among those it replaced: one join, however many segments there are
        out = gone = None
        for k, seg in enumerate(c["segments"]):
            if seg["data"]:
                df = spark.read.schema(schema).parquet(f"{self.files.root}/{seg['data']}").withColumn(_SEGMENT, F.lit(k))
                out = df if out is None else out.unionByName(df)
            if seg["replaced"]:
                ids = spark.read.schema(f"{ID} long").parquet(f"{self.files.root}/{seg['replaced']}").withColumn(_GONE, F.lit(k))
                gone = ids if gone is None else gone.unionByName(ids)
        if out is None:
            return spark.createDataFrame([], schema)
        if gone is not None:
            out = out.join(gone.groupBy(ID).agg(F.max(_GONE).alias(_GONE)), ID, "left").where(F.col(_GONE).isNull() | (F.col(_GONE) <= F.col(_SEGMENT)))
        return out.select(*[f"`{f.name}`" for f in schema.fields])

    def count(self, name: str) -> int:
        return self.scan(name).count()

    def ids(self, name: str) -> list[int]:
        return [r[0] for r in self.scan(name).select(ID).orderBy(ID).collect()]

    def get(self, name: str, id: int, version: int | None = None) -> dict | None:
        row = self.scan(name, version).where(F.col(ID) == id).first()
        return None if row is None else _record(row)

    def get_projected(self, name: str, id: int, fields: Iterable[str]) -> dict | None:
        df = self.scan(name)
        row = df.where(F.col(ID) == id).select(ID, *[f"`{f}`" for f in fields if f in df.columns]).first()
        return None if row is None else _record(row)

    def peek_field(self, name: str, id: int, field: str) -> tuple[bool, object]:
        """(whether the record is there, its value or None)."""
        got = self.get_projected(name, id, [field])
        return (False, None) if got is None else (True, got.get(field))

    # writing

    def insert(self, name: str, id: int, record: dict) -> None:
        self.insert_batch(name, [(id, record)])

    def insert_auto(self, name: str, record: dict) -> int:
        id = self._of(self.manifest(), name)["next_id"]
        self.insert(name, id, record)
        return id

    def insert_batch(self, name: str, rows: Iterable[tuple[int, dict]] | DataFrame) -> None:
        """All or nothing: rows as (id, record) pairs or as a DataFrame with _id."""
        with self.begin() as t:
            t.insert_batch(name, rows)

    def update(self, name: str, id: int, record: dict) -> bool:
        """Puts the record in place of what is there, or inserts it; whether there was one."""
        with self.begin() as t:
            return t.update(name, id, record)

    def delete(self, name: str, id: int) -> bool:
        with self.begin() as t:
            return t.delete(name, id)

    def begin(self, strict: bool = False) -> Transaction:
        return Transaction(self, strict)

    def snapshot(self) -> int:
        return self.version()

    def _segment(self, name: str, df: DataFrame | None, replaced: DataFrame | list[int], cluster: str | None = None) -> dict:
        tag = uuid.uuid4().hex
        out = {"data": None, "replaced": None}
        if df is not None:
            out["data"] = f"data/{name}/{tag}"
            if cluster:
                df = df.repartitionByRange(cluster).sortWithinPartitions(cluster)
            df.write.parquet(f"{self.files.root}/{out['data']}")
        if not isinstance(replaced, list) or replaced:
            ids = self.spark.createDataFrame([(i,) for i in replaced], f"{ID} long") if isinstance(replaced, list) else replaced.select(ID)
            out["replaced"] = f"data/{name}/{tag}-replaced"
            ids.write.parquet(f"{self.files.root}/{out['replaced']}")
        return out

    def _check_unique(self, df: DataFrame, fields: list[str]) -> None:
        for f in fields:
            if f in df.columns and df.where(F.col(f"`{f}`").isNotNull()).groupBy(f"`{f}`").count().where("count > 1").limit(1).count():
                raise UniqueViolation(f)

    # upkeep

    def cluster_by(self, name: str, field: str | None) -> None:
        """New segments, and those that compaction writes, are sorted by the field. A hint: it never changes an answer."""
        m = self.manifest()
        self._of(m, name)["cluster"] = field
        self._publish(m)

    def compact(self, name: str) -> None:
        m = self.manifest()
        c = self._of(m, name)
        if len(c["segments"]) > 1 or c["cluster"]:
            c["segments"] = [self._segment(name, self._read(c), [], c["cluster"])]
            self._publish(m)

    def backup_to(self, root: str, version: int | None = None) -> int:
        """Copies one version's manifest, as version 0 of a new store, with the segments it names."""
        m, to = self.manifest(version), Files(self.spark, root)
        for c in m["collections"].values():
            for s in c["segments"]:
                for p in (s["data"], s["replaced"]):
                    if p:
                        self.files.copy(p, to)
        to.create("manifests/0.json", json.dumps(m | {"version": 0}))
        return m["version"]

    def restore(self, version: int) -> int:
        """Makes an earlier version's content the newest."""
        old, now = self.manifest(version), self.manifest()
        return self._publish(old | {"version": now["version"]})

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> int:
        """Deletes all but the newest `keep` manifests and the segments that no kept one names; how many segments went. A segment that was written less than older_than seconds ago stays: it may be that of a commit which has yet to publish its manifest."""
        versions = sorted(int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json"))
        held = {p for v in versions[-keep:] for c in self.manifest(v)["collections"].values() for s in c["segments"] for p in (s["data"], s["replaced"]) if p}
        gone = 0
        for v in versions[:-keep]:
            self.files.delete(f"manifests/{v}.json")
        for name in self.files.names("data"):
            for tag, age in self.files.ages(f"data/{name}"):
                if f"data/{name}/{tag}" not in held and age >= older_than:
                    self.files.delete(f"data/{name}/{tag}")
                    gone += 1
        return gone


def _record(row) -> dict:
    """Null and absent are the same: a record has no null fields."""
    return {k: v for k, v in row.asDict().items() if k != ID and v is not None}


class Transaction:
    """A write-set over a snapshot. First committer wins: commit fails if another has written one of the same ids since. A strict transaction also fails if a record it read, or a collection it scanned, has changed.
    One without writes always commits."""

    def __init__(self, store: Store, strict: bool = False):
        self.store, self.strict = store, strict
        self.start = store.manifest()
        self.writes: dict[str, dict[int, dict | None]] = {}
        self.frames: dict[str, list[DataFrame]] = {}
        self.read_ids: dict[str, set[int]] = {}
        self.scanned: set[str] = set()
        self.done = False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self.done:
            return
        if kind is None:
            self.commit()
        else:
            self.abort()

    def _collection(self, name: str) -> dict:
        return self.store._of(self.start, name)

    def get(self, name: str, id: int) -> dict | None:
        if id in self.writes.get(name, {}):
            return self.writes[name][id]
        self.read_ids.setdefault(name, set()).add(id)
        return self.store.get(name, id, self.start["version"]) if name in self.start["collections"] else self._collection(name)

    def scan(self, name: str) -> list[tuple[int, dict]]:
        """Own writes included, ascending by id."""
        self.scanned.add(name)
        rows = {r[ID]: _record(r) for r in self.store._read(self._collection(name)).collect()}
        for id, rec in self.writes.get(name, {}).items():
            rows.pop(id, None)
            if rec is not None:
                rows[id] = rec
        return sorted(rows.items())

    def insert(self, name: str, id: int, record: dict) -> None:
        if self.get(name, id) is not None:
            raise RecordExists(f"{name} {id}")
        self._put(name, id, record)

    def insert_batch(self, name: str, rows) -> None:
        if isinstance(rows, DataFrame):
            self._collection(name)
            self.frames.setdefault(name, []).append(rows)
            return
        rows = [(i, dict(r)) for i, r in rows]
        seen = [i for i, _ in rows]
        there = {r[0] for r in _among(self.store._read(self._collection(name)), seen).select(ID).collect()} if seen else set()
        writes = self.writes.get(name, {})
        taken = {i for i, r in writes.items() if r is not None} | {i for i in there if i not in writes}
        for i in seen:
            if i in taken:
                raise RecordExists(f"{name} {i}")
            taken.add(i)
        schema = Schema.from_json(self._collection(name)["schema"])
        for _, r in rows:
            schema.check(r)
        for i, r in rows:
            self._put(name, i, r)

    def update(self, name: str, id: int, record: dict) -> bool:
        existed = self.get(name, id) is not None
        self._put(name, id, record)
        return existed

    def delete(self, name: str, id: int) -> bool:
        existed = self.get(name, id) is not None
        if existed:
            self.writes.setdefault(name, {})[id] = None
        return existed

    def _put(self, name: str, id: int, record: dict) -> None:
        record = {k: v for k, v in record.items() if v is not None}
        Schema.from_json(self._collection(name)["schema"]).check(record)
        self.writes.setdefault(name, {})[id] = record

    def abort(self) -> None:
        self.done = True

    def commit(self) -> int:
        self.done = True
        if not self.writes and not self.frames:
            return self.start["version"]
        now = self.store.manifest()
        self._validate(now)
        for name in {*self.writes, *self.frames}:
            c = self.store._of(now, name)
            schema = Schema.from_json(c["schema"])
            before = self.store._read(c)
            df, replaced, top = self._delta(name, c, schema, before)
            c["next_id"] = max(c["next_id"], top + 1)
            if c["unique"]:
                kept = before.join(self.store.spark.createDataFrame([(i,) for i in replaced], f"{ID} long"), ID, "left_anti") if replaced else before
                self.store._check_unique(kept.unionByName(df, allowMissingColumns=True) if df is not None else kept, c["unique"])
            c["segments"].append(self.store._segment(name, df, replaced, c["cluster"]))
            c["epoch"] += 1
        version = self.store._publish(now)
        for name in {*self.writes, *self.frames}:
            if len(now["collections"][name]["segments"]) >= self.store.compact_after:
                with contextlib.suppress(Conflict):  # another writer came first; a later commit will do it
                    self.store.compact(name)
        return version

    def _validate(self, now: dict) -> None:
        for name in {*self.writes, *self.frames, *(self.read_ids if self.strict else ()), *(self.scanned if self.strict else ())}:
            was, is_ = self.start["collections"].get(name), now["collections"].get(name)
            if is_ is None or was is None:
                raise Conflict(name)
            if was["segments"] == is_["segments"]:
                continue
            if self.strict and name in self.scanned:
                raise Conflict(f"{name} was scanned and has changed")
            ids = {*self.writes.get(name, {}), *(self.read_ids.get(name, ()) if self.strict else ())}
            new = [s for s in is_["segments"] if s not in was["segments"]]
            for s in new:
                for part in (s["data"], s["replaced"]):
                    if part and ids and self.store.spark.read.parquet(f"{self.store.files.root}/{part}").where(F.col(ID).isin(list(ids))).limit(1).count():
                        raise Conflict(f"{name}: a record was written by another transaction")

    def _delta(self, name: str, c: dict, schema: Schema, before: DataFrame) -> tuple[DataFrame | None, list[int], int]:
        spark, writes = self.store.spark, self.writes.get(name, {})
        rows = [{ID: i, **r} for i, r in writes.items() if r is not None]
        top = max([-1, *writes])
        df = None
        if rows:
            fields = _fields_of(rows, schema, c)
            df = spark.createDataFrame([tuple(r.get(f.name) for f in fields.fields) for r in rows], fields)
        for frame in self.frames.get(name, []):
            schema.check_frame(frame)
            if frame.join(before, ID, "left_semi").limit(1).count() or frame.groupBy(ID).count().where("count > 1").limit(1).count():
                raise RecordExists(name)
            top = max(top, frame.agg(F.max(ID)).first()[0] or -1)
            df = frame if df is None else df.unionByName(frame, allowMissingColumns=True)
        replaced = [r[0] for r in _among(before, writes).select(ID).collect()] if writes else []
        if df is not None:
            c["spark"] = _merged(c["spark"], T.StructType([f for f in df.schema.fields if f.name != ID])).jsonValue()
        return df, replaced, top


def _fields_of(rows: list[dict], schema: Schema, c: dict) -> T.StructType:
    """Declared types first, then stored ones, then those that the values have."""
    known = {f.name: f.dataType for f in schema.spark().fields}
    if c["spark"]:
        known |= {f.name: f.dataType for f in T.StructType.fromJson(c["spark"]).fields if f.name not in known}
    out = [T.StructField(ID, T.LongType(), False)]
    for n in dict.fromkeys(k for r in rows for k in r if k != ID):
        t = known.get(n) or T._infer_type(next(r[n] for r in rows if r.get(n) is not None))
        out.append(T.StructField(n, t, True))
    return T.StructType(out)


def _merged(old: dict | None, new: T.StructType) -> T.StructType:
    fields = list(T.StructType.fromJson(old).fields) if old else []
    have = {f.name: f.dataType for f in fields}
    for f in new.fields:
        if f.name not in have:
            fields.append(f)
        elif have[f.name] != f.dataType:
            raise SchemaError(f"field {f.name!r} holds {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
