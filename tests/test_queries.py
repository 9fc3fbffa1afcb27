"""Each registered query against its SQL."""

import glob
import os

import pytest

import __spark_entry__ as contract
from compare import compare, duck
from conftest import SF_CHECK, SF_TINY
from quizlens.sources.listing import list_files, read_bytes

QUERIES, ORACLES = contract.QUERIES, contract.ORACLES


@pytest.fixture(scope="module")
def connection():
    return duck(SF_CHECK)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_CHECK), connection, ORACLES[name]) == ""


def test_entry_has_the_rows_of_its_sql(spark):
    assert compare(contract.entry(spark), duck(SF_TINY), ORACLES["accuracy_by_dataset"]) == ""


def test_listing_and_bytes_agree_with_the_files(spark):
    files = {f"./dataset/{os.path.basename(p)}": open(p, "rb").read()
             for p in glob.glob(f"{SF_TINY}/*.parquet")}
    listed = list_files(spark, SF_TINY, "*.parquet", prefix="./dataset/").collect()
    assert {r.path: r.length for r in listed} == {p: len(content) for p, content in files.items()}
    read = read_bytes(spark, SF_TINY, "*.parquet", prefix="./dataset/").collect()
    assert {r.path: bytes(r.content) for r in read} == files
