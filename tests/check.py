"""Compare registered queries with their SQL twins: ``python -m tests.check [sf] [name…]``."""

from __future__ import annotations

import math
import sys
import time
import traceback

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def make_spark(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = canonical(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 500_000 else []
        lost = [r for r in want if r not in set(got)][:3] if len(got) < 500_000 else []
        return f"{len(got)} rows vs {len(want)}; only spark {extra}; only sql {lost}"
    if not got:
        return "no rows"
    return None


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as err:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(err))[:500]
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {time.time() - start:6.2f}s {'sql ' if name in oracles else 'rows'} {name} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
