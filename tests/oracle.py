"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sql: str, sf_dir: str = SF_DIR):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def compare(spark, query, sql: str, sf_dir: str = SF_DIR) -> None:
    df = query(spark, sf_dir)
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([plain(r[names.index(c)]) for c in order] for r in rows), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert a == b, (order, a, b)
