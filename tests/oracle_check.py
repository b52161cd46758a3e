"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    return float(v) + 0.0 if isinstance(v, float) else v


def differences(con, df, sql: str) -> str | None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    got_rows = df.collect()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    pos = [names.index(n) for n in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(_plain(r[i]) for i in pos) for r in want_rows), key=key)
    got = sorted((tuple(_plain(r[n]) for n in order) for r in got_rows), key=key)
    if len(want) != len(got):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    types = {
        n: (type(g).__name__, type(w).__name__)
        for r in zip(got, want)
        for n, g, w in zip(order, *r)
        if g is not None and w is not None and type(g) is not type(w)
    }
    if types:
        return f"types differ: {types}"
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else None
