"""Comparison of a Spark result with another engine's, order aside."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def engine(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(names, records):
    """Rows with columns in name order, as sortable tuples; missing sorts first."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return (0, "")
        return (1, x) if isinstance(x, (int, float)) else (2, str(x))

    return sorted(tuple(cell(r[i]) for i in order) for r in records)


SAME_TYPE = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_frame, relation):
    """What differs, as a list of texts; empty if nothing does."""
    found = []
    here = {f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_frame.schema}
    there = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if here != there:
        found.append(f"schema {here} against {there}")
        if set(here) != set(there):
            return found
    ours = rows(list(here), [tuple(r) for r in spark_frame.collect()])
    theirs = rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    if not theirs:
        found.append("no rows to compare")
    unequal = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if unequal:
        found.append(f"{len(unequal)} rows differ, first {unequal[0]}")
    return found
