"""What the physical plans of the registered queries may and may not hold."""

import re

import pytest

import __spark_entry__ as contract
from conftest import SF_TINY

QUERIES = contract.QUERIES
NO_SHUFFLE = [
    "parse_path", "exclude_paths", "strip_text", "collapse_ws", "drop_newlines", "cut_at_marker",
    "remove_echo", "drop_prefix", "flag_ok_2q", "picture_key", "combine_graded", "lookup_catalogue",
    "build_requests", "dialogue_turn1", "dialogue_turn2", "answer_rows", "tile_grid", "tile_boxes",
    "gallery_filter", "gallery_labels",
]
# Windows without a partition see one sheet of 40 rows, or one row per partition.
BOUNDED_WINDOWS = {"combined_sorted", "gallery_grid", "indexed_table", "roundtrip_table"}
# The responder, a numeric model, and bytes of files read at any place.
WITH_PYTHON = {"answer_stub", "predict_shapes", "scan_ranges"}


@pytest.fixture(scope="module")
def plans(spark):
    found = {}

    def plan(name):
        if name not in found:
            found[name] = QUERIES[name](spark, SF_TINY)._jdf.queryExecution().executedPlan().toString()
        return found[name]

    return plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_other_python(plans, name):
    text = plans(name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = re.findall(r"(?:Arrow|Batch)EvalPython|InPandas|MapInArrow", text)
    assert bool(python) == (name in WITH_PYTHON)
    assert ("Window [" in text and "windowspecdefinition(" in text) == (
        name in BOUNDED_WINDOWS - {"roundtrip_table"} | {"two_turn_pivot"})
    assert "Scan ExistingRDD" not in text


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_wise_queries_do_not_shuffle(plans, name):
    assert "Exchange hashpartitioning" not in plans(name)
    assert "Exchange rangepartitioning" not in plans(name)


@pytest.mark.parametrize("name", ["accuracy_by_dataset", "outcome_counts", "map_display_name", "audit_nulls"])
def test_one_aggregation_combines_before_its_shuffle(plans, name):
    text = plans(name)
    joins = 2 if "SortMergeJoin" in text else 0
    assert text.count("Exchange hashpartitioning") == 1 + joins
    assert "partial_" in text.split("Exchange hashpartitioning")[1]


def test_scans_read_only_what_they_need(plans):
    assert "l_extendedprice" not in plans("accuracy_by_dataset")
    assert "l_partkey" not in plans("accuracy_by_dataset")
    assert "text" not in re.search(r"ReadSchema: (.*)", plans("audit_nulls")).group(1)
    assert "content" not in plans("scan_listing") and "content" in plans("scan_bytes")
    assert "PushedFilters: [In(role" in plans("two_turn_pivot")


def test_gallery_limits_before_its_window(plans):
    text = plans("gallery_grid")
    assert text.index("Window [") < text.index("TakeOrderedAndProject")
