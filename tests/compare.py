"""Row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(row) for row in df.select(*columns).collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    names = [field[0] for field in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    rows = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    return [names[i] for i in order], rows


SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "double": "DOUBLE", "date": "DATE",
}


def type_differences(df, con, sql):
    duck = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    return {
        name: (dtype, duck.get(name)) for name, dtype in df.dtypes
        if SAME_TYPE.get(dtype) != duck.get(name)
    }
