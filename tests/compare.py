"""Comparison of a Spark result with DuckDB's for the same tables."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(names, found):
    return sorted((tuple(plain(r[n]) for n in names) for r in found), key=repr)


def duck(sf, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def same(df, sf, sql):
    names, want = duck(sf, sql)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert rows(order, df.collect()) == rows(order, want)
