"""A small shell: SQL, .tables, .layouts, .explain SQL, .quit.

    python -m facet.cli FOLDER      every name.parquet in FOLDER is a collection; its first column is the id if that is a whole number
"""

from __future__ import annotations

import sys
from pathlib import Path

from .engine import Engine
from .operators.relational import Unsupported
from .plans.sql import SqlError
from .sources.store import StoreError


def load(engine: Engine, folder: str) -> None:
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    for p in sorted(Path(folder).glob("*.parquet")):
        df = engine.spark.read.parquet(str(p))
        first = df.schema.fields[0]
        if isinstance(first.dataType, T.IntegralType):
            engine.register(p.stem, df, id=first.name)
        else:
            engine.register(p.stem, df.withColumn("_id", F.monotonically_increasing_id()))


def run_line(engine: Engine, line: str) -> str:
    line = line.strip()
    try:
        if line == ".tables":
            return "\n".join(sorted({*engine.frames, *(engine.store.collections() if engine.store else [])}))
        if line in (".layouts", ".indexes"):
            return "\n".join(f"{x.collection}: {x.name}" for x in engine.layouts) or "none"
        if line.startswith(".explain "):
            return engine.explain(line[len(".explain ") :])
        if line.startswith("."):
            return f"no command {line.split()[0]}"
        rows = engine.collect(line)
        return "\n".join(["\t".join(rows[0].__fields__)] + ["\t".join("" if v is None else str(v) for v in r) for r in rows] if rows else ["no rows"])
    except (SqlError, Unsupported, StoreError) as e:
        return f"error: {e}"


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    engine = Engine(SparkSession.builder.appName("facet").getOrCreate())
    load(engine, folder)
    for line in sys.stdin:
        if line.strip() in (".quit", ".exit"):
            break
        if line.strip():
            print(run_line(engine, line))


if __name__ == "__main__":
    main(sys.argv[1])
