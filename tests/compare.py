"""Run registered queries against their oracle SQL and compare whole results.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


_SHARED = tempfile.TemporaryDirectory(prefix="weftaudit-tests-", ignore_cleanup_errors=True)


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("weftaudit-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", _SHARED.name)
        .config("spark.sql.warehouse.dir", f"{_SHARED.name}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value)


def kind_of(type_name: str) -> str:
    t = type_name.lower()
    if t.startswith("timestamp"):
        return "timestamp"
    if t in ("string", "varchar"):
        return "text"
    if t in ("bigint", "int", "integer", "smallint", "tinyint", "hugeint"):
        return t if t != "integer" else "int"
    return t.split("(")[0]


def compare(spark, con, name: str, query, oracle: str, sf_dir: str) -> list[str]:
    problems: list[str] = []
    frame = query(spark, sf_dir)
    order = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in frame.collect())
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    if sorted(columns) != order:
        return [f"columns {order} != {sorted(columns)}"]
    at = [columns.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rows)
    spark_types = {f.name: kind_of(f.dataType.simpleString()) for f in frame.schema.fields}
    duck_types = {d[0]: kind_of(str(d[1])) for d in cursor.description}
    for c in order:
        if spark_types[c] != duck_types[c]:
            problems.append(f"type of {c}: {spark_types[c]} != {duck_types[c]}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        gs, ws = set(got), set(want)
        only_got = sorted(gs - ws)[:2]
        only_want = sorted(ws - gs)[:2]
        problems.append(f"{len(gs - ws)} rows only in Spark, {len(ws - gs)} only in SQL")
        for g in only_got:
            problems.append("  spark " + str(dict(zip(order, g)))[:1500])
        for w in only_want:
            problems.append("  sql   " + str(dict(zip(order, w)))[:1500])
    if not want:
        problems.append("empty result")
    return problems


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.001"
    wanted = [a for a in argv if not a.startswith("/")]
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, name, queries[name], oracles[name], sf_dir)
            else:
                problems = [] if queries[name](spark, sf_dir).count() >= 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        took = time.time() - start
        mark = "ok  " if not problems else "FAIL"
        print(f"{mark} {name} {took:.1f}s", flush=True)
        for p in problems:
            bad += 1
            print("   ", p, flush=True)
    print(f"{len(names)} queries, {bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
