"""Queries against their SQL on the smallest tables, and a smoke run of those without SQL."""

import glob
import os

import duckdb
import pytest

from paperloom.plans.oracle import ORACLE
from paperloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.astype(object).where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, db, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(db.sql(ORACLE[name]).df())


def test_nearly_all_have_sql():
    """Those without are clusters of Ward and what is made of them, and captions (no look-ahead in the SQL's patterns); test_analyses holds them against plain Python."""
    ward = {"method_clusters", "method_paragraphs", "intro_clusters", "intro_members", "problem_clusters", "problem_matrix", "problem_items", "figure_groups", "figure_items", "figure_stats", "discussion_patterns", "question_clusters", "question_items", "question_stats", "gap_groups", "report_summary", "overview_metrics", "chart_method_clusters", "chart_open_questions"}
    assert set(QUERIES) - set(ORACLE) == ward | {"figure_captions", "table_captions"}


def test_labels_of_the_matrix_are_not_joined_to_its_cells(spark):
    plan = QUERIES["chart_similarity"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan
