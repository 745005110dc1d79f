"""Field types, the four modes of a schema, validation, inference and evolution."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = ("dynamic", "declared", "strict", "fixed")


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class FieldType:
    """name: bool, i64, u64, f64, decimal, timestamp, str, char, bytes, fixed_bytes, list, map or any. size: bytes for text and bytes, scale for decimals."""

    name: str
    size: int | None = None
    of: FieldType | None = None

    @property
    def fixed_width(self) -> bool:
        return self.name in ("bool", "i64", "u64", "f64", "decimal", "timestamp", "char", "fixed_bytes")

    @property
    def capacity(self) -> int | None:
        """Bytes of content. char and fixed_bytes keep the length in front of the content."""
        if self.name in ("char", "fixed_bytes"):
            prefix = 1 if self.size <= 0xFF else 2 if self.size <= 0xFFFF else 4
            return self.size - prefix
        return self.size if self.name in ("str", "bytes") else None

    def spark(self) -> T.DataType:
        if self.name == "list":
            return T.ArrayType(self.of.spark() if self.of else T.StringType(), True)
        return {
            "bool": T.BooleanType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "decimal": T.DecimalType(38, self.size or 0), "timestamp": T.TimestampNTZType(), "str": T.StringType(),
            "char": T.StringType(), "bytes": T.BinaryType(), "fixed_bytes": T.BinaryType(), "map": T.MapType(T.StringType(), T.StringType()), "any": T.VariantType(),
        }[self.name]

    def problem(self, v) -> str | None:
        """What is wrong with a value that isn't None; None if it fits."""
        whole = isinstance(v, int) and not isinstance(v, bool)
        n = self.name
        if n == "any":
            return None
        ok = {
            "bool": isinstance(v, bool), "i64": whole and -(2**63) <= v < 2**63, "u64": whole and 0 <= v < 2**64, "f64": (whole or isinstance(v, float)),
            "timestamp": isinstance(v, datetime.datetime), "str": isinstance(v, str), "char": isinstance(v, str), "bytes": isinstance(v, (bytes, bytearray)), "fixed_bytes": isinstance(v, (bytes, bytearray)),
            "list": isinstance(v, (list, tuple)), "map": isinstance(v, dict), "decimal": whole or isinstance(v, Decimal),
        }[n]
        if not ok:
            return f"expected {n}, got {type(v).__name__}"
        if n == "decimal" and isinstance(v, Decimal) and v != v.quantize(Decimal(1).scaleb(-(self.size or 0))):
            return f"{v} does not fit scale {self.size or 0} exactly"
        if (most := self.capacity) is not None:
            size = len(v.encode()) if isinstance(v, str) else len(v)
            if size > most:
                return f"{size} bytes, at most {most} fit"
        if n == "list" and self.of:
            return next((p for x in v if x is not None and (p := self.of.problem(x))), None)
        return None


@dataclass(frozen=True)
class Column:
    name: str
    type: FieldType
    required: bool = False


@dataclass(frozen=True)
class Schema:
    mode: str = "dynamic"
    columns: tuple[Column, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if self.mode not in MODES:
            raise SchemaError(f"no mode {self.mode!r}")
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise SchemaError("a field is declared twice")
        if self.mode != "dynamic" and not names:
            raise SchemaError("only a dynamic schema may be empty")
        for c in self.columns:
            if self.mode == "fixed" and not c.type.fixed_width:
                raise SchemaError(f"{c.name}: {c.type.name} has no fixed width")
            if c.type.name in ("char", "fixed_bytes", "str", "bytes") and c.type.size is not None and c.type.capacity <= 0:
                raise SchemaError(f"{c.name}: no room for content")

    @property
    def rigidity(self) -> int:
        return MODES.index(self.mode)

    def check(self, record: dict) -> None:
        """Raises SchemaError unless the record may be stored."""
        known = {c.name: c for c in self.columns}
        if self.mode in ("strict", "fixed") and (extra := [k for k, v in record.items() if k not in known and v is not None]):
            raise SchemaError(f"unknown field {extra[0]!r}")
        for name, c in known.items():
            v = record.get(name)
            if v is None:
                if c.required:
                    raise SchemaError(f"missing field {name!r}")
            elif p := c.type.problem(v):
                raise SchemaError(f"field {name!r}: {p}")

    def check_frame(self, df: DataFrame) -> None:
        """The same for a whole DataFrame, in one aggregation."""
        known = {c.name: c for c in self.columns}
        names = [c for c in df.columns if c != "_id"]
        if self.mode in ("strict", "fixed") and (extra := [n for n in names if n not in known]):
            raise SchemaError(f"unknown field {extra[0]!r}")
        tests = []
        for n, c in known.items():
            if c.required:
                tests.append((f"missing field {n!r}", F.col(f"`{n}`").isNull() if n in names else F.lit(True)))
            if n in names and (most := c.type.capacity) is not None:
                tests.append((f"field {n!r}: too wide", F.octet_length(f"`{n}`") > most))
            if n in names and c.type.name == "u64":
                tests.append((f"field {n!r}: negative", F.col(f"`{n}`") < 0))
        if tests:
            row = df.agg(*[F.max(F.when(t, 1).otherwise(0)).alias(f"t{k}") for k, (_, t) in enumerate(tests)]).first()
            for (message, _), bad in zip(tests, row):
                if bad:
                    raise SchemaError(message)

    def spark(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type.spark(), not c.required) for c in self.columns])

    def to_json(self) -> dict:
        ft = lambda t: {"name": t.name, "size": t.size, "of": ft(t.of) if t.of else None}
        return {"mode": self.mode, "columns": [{"name": c.name, "type": ft(c.type), "required": c.required} for c in self.columns]}

    @staticmethod
    def from_json(d: dict) -> Schema:
        ft = lambda t: FieldType(t["name"], t["size"], ft(t["of"]) if t["of"] else None)
        return Schema(d["mode"], tuple(Column(c["name"], ft(c["type"]), c["required"]) for c in d["columns"]))

    def accepts_evolution(self, new: Schema) -> bool:
        """Whether data written under self reads under new without a rewrite: fields are added at the end, nullable, or dropped from the end, and no type changes."""
        n = min(len(self.columns), len(new.columns))
        same = all(a.name == b.name and a.type == b.type and (a.required or not b.required) for a, b in zip(self.columns[:n], new.columns[:n]))
        return same and not any(c.required for c in new.columns[n:])


def infer(df: DataFrame, slack: int = 16) -> Schema:
    """The strictest schema that all rows fit, in one aggregation: fixed if every field settles, declared if some do, else dynamic. Text and bytes get room for the longest value and slack more;
    nested fields, decimals and times don't settle; a field that is always there is required."""
    fields = [f for f in df.schema.fields if f.name != "_id"]
    if not fields:
        return Schema()
    aggs = [F.count(F.lit(1)).alias("rows")]
    for k, f in enumerate(fields):
        aggs.append(F.count(f"`{f.name}`").alias(f"n{k}"))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            aggs.append(F.max(F.octet_length(f"`{f.name}`")).alias(f"w{k}"))
    row = df.agg(*aggs).first()
    columns = []
    for k, f in enumerate(fields):
        n = row[f"n{k}"]
        t = f.dataType
        if not n:
            continue
        if isinstance(t, T.BooleanType):
            ft = FieldType("bool")
        elif isinstance(t, T.IntegralType):
            ft = FieldType("i64")
        elif isinstance(t, (T.DoubleType, T.FloatType)):
            ft = FieldType("f64")
        elif isinstance(t, T.StringType):
            ft = FieldType("char", row[f"w{k}"] + slack)
        elif isinstance(t, T.BinaryType):
            ft = FieldType("fixed_bytes", row[f"w{k}"] + slack)
        else:
            continue
        columns.append(Column(f.name, ft, n == row["rows"]))
    if not columns:
        return Schema()
    return Schema("fixed" if len(columns) == len(fields) else "declared", tuple(columns))
