"""Run registered queries beside their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent


def plain(x):
    """A hashable form in which both engines' values agree."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "item"):
        return plain(x.item())
    if type(x).__name__ == "Decimal":
        return plain(float(x)) if x % 1 else int(x)
    return x


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, name, query, sql, sf_dir, con) -> str:
    began = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.select(*cols).collect())
    took = time.time() - began
    if sql is None:
        return f"{name}: {sum(got.values())} rows, no SQL ({took:.1f} s)"
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"{name}: FAIL columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return f"{name}: ok, {sum(got.values())} rows ({took:.1f} s)"
    more, less = got - want, want - got
    return f"{name}: FAIL {sum(got.values())} rows against {sum(want.values())}; only Spark {list(more.items())[:3]}; only SQL {list(less.items())[:3]}"


def main(args: list[str]) -> int:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from grovelake.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, con = entry.queries(), entry.oracle_sql(), connect(args[0])
    bad = 0
    for name in args[1:] or queries:
        try:
            line = compare(spark, name, queries[name], sql.get(name), args[0], con)
        except Exception as e:  # one broken query must not hide the others
            line = f"{name}: FAIL {type(e).__name__} {str(e)[:600]}"
        bad += "FAIL" in line
        print(line, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
