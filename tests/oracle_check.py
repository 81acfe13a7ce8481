"""Run registered queries next to their SQL in DuckDB and compare schema and values exactly.

    python tests/oracle_check.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("bigint", "hugeint")):
        return "long"
    if name.startswith("int"):
        return "int"
    if name.startswith(("varchar", "string")):
        return "string"
    return name


def compare(df, con, sql: str) -> str | None:
    """None when equal, else the first difference."""
    rel = con.sql(sql)
    names = sorted(rel.columns)
    if names != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {names}"
    spark_types = {f.name: kind(f.dataType.typeName()) for f in df.schema}
    duck_types = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    names_map = {"long": "long", "integer": "int"}
    for c in names:
        a = names_map.get(spark_types[c], spark_types[c])
        if a != duck_types[c]:
            return f"type of {c}: {a} against {duck_types[c]}"
    rows = rel.fetchall()
    order = [rel.columns.index(c) for c in names]
    want = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    if len(want) != len(got):
        return f"{len(got)} rows against {len(want)}"
    clean = lambda r: tuple(0.0 if v == 0 and isinstance(v, float) else v for v in r)
    bad = [(g, w) for g, w in zip(got, want) if clean(g) != clean(w)]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from demandlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql, failed, con = entry.oracle_sql(), 0, duck(sf)
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name in sql:
                problem = compare(fn(spark, sf), con, sql[name])
            else:
                problem = None if fn(spark, sf).count() > 0 else "no rows"
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += problem is not None
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - t:.1f}s {'' if name in sql else '(rows only)'} {problem or ''}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
