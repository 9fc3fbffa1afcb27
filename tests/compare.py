"""Run a query on Spark and its SQL on DuckDB and compare the rows as a multiset."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def kinds_of(names, types):
    known = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
             "boolean": "BOOLEAN"}
    return {n: known.get(str(t), str(t)) for n, t in zip(names, types)}


def compare(frame, connection, sql):
    """The differences found, as text; empty when both sides agree."""
    oracle = connection.sql(sql)
    left_kinds = kinds_of(*zip(*frame.dtypes))
    right_kinds = kinds_of(oracle.columns, oracle.types)
    problems = []
    if left_kinds != right_kinds:
        problems.append(f"columns: {set(left_kinds.items()) ^ set(right_kinds.items())}")
    if set(left_kinds) == set(right_kinds):
        left = rows_of(frame.columns, frame.collect())
        right = rows_of(oracle.columns, oracle.fetchall())
        if left != right:
            problems.append(
                f"rows {sum(left.values())}/{sum(right.values())}; only Spark "
                f"{list((left - right).items())[:2]}; only SQL {list((right - left).items())[:2]}")
    return "; ".join(problems)
