"""Compare the checkable queries with their SQL on the same parquet tables."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from wayline.plans.catalog import ORACLE, QUERIES


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return v
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    return str(v)


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def check(spark: SparkSession, sf_dir: str, name: str) -> dict:
    import duckdb

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    out = {"name": name, "rows": len(got), "seconds": round(took, 2)}
    if name not in ORACLE:
        return {**out, "ok": True, "how": "rows"}
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    res = con.execute(ORACLE[name])
    names = [c[0] for c in res.description]
    types = {c[0]: str(c[1]) for c in res.description}
    want = res.fetchall()
    out["sql_seconds"] = round(time.time() - start - took, 2)
    if sorted(names) != sorted(df.columns):
        return {**out, "ok": False, "why": f"columns {sorted(df.columns)} against {sorted(names)}"}
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        return {**out, "ok": False, "why": f"{len(got)} against {len(want)} rows; only here {list((a - b).items())[:2]}; only SQL {list((b - a).items())[:2]}"}
    return {**out, "ok": True, "how": "sql", "types": {n: (t, types[n]) for n, t in df.dtypes}}


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def main(argv: list[str]) -> int:
    from wayline.session import build_session

    sf_dir, wanted = argv[0], argv[1:]
    unknown = [w for w in wanted if not any(name.startswith(w) for name in QUERIES)]
    if unknown:
        print("no such query:", *unknown)
        return len(unknown)
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            r = check(spark, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        odd = {k: v for k, v in (r.pop("types", None) or {}).items() if SAME.get(v[0]) != v[1]}
        bad += not r["ok"]
        print("ok " if r["ok"] else "BAD", r, odd or "", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
