"""Running a query beside its SQL on the driver's tables."""

from __future__ import annotations

import os

DATA = os.environ.get("LIAME_TESTDATA", "/root/testdata/sf0.001")
TABLES = "persons docs doc_persons doc_candidates terms doc_terms phrases graph_terms documents eval_items mix_targets".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def differences(spark, name, queries, sql) -> tuple[int, int]:
    """Rows only in Spark's result and only in DuckDB's."""
    import duckdb

    df = queries[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(sql[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cur.fetchall())
    if ours == theirs:
        return 0, 0
    from collections import Counter

    a, b = Counter(ours), Counter(theirs)
    return sum((a - b).values()), sum((b - a).values())
