"""The driver contract, and one query of each kind against its SQL at the smallest scale.

``python -m workload.check`` compares all queries at any scale.
"""

import os

import pytest

import __spark_entry__ as driver
from workload.check import compare, connect
from workload.oracle import ORACLE
from workload.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ONE_OF_EACH = ["scope_default", "scan_order", "classify_pages", "dup_rejects", "dup_report", "plan_preview",
               "resolve_names", "resolve_names_cascade", "ops_append", "history_lines", "review_plan",
               "undo_inventory"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_sql():
    # Queries of the training-data operators, where present, need none.
    assert set(QUERIES) == set(ORACLE) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    assert tuple(driver.entry(spark).first()) == (10, 21, 29443)


@pytest.mark.parametrize("name", ONE_OF_EACH)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(FOLDER), FOLDER, name) == ""
