"""Registered queries against their SQL. A few run by default; BOUTLINE_ALL=1 runs every one."""

import os

import pytest

from boutline.plans import load_all, registry
from tests.check import compare, connect

load_all()
FOLDER = "/root/testdata/sf0.001"
QUICK = ("wasted_input", "moment_cluster", "habit_metrics", "match_outcome", "damage_resets", "moves", "combos", "template_match", "fuzzy_snap",
         "parse_combo", "ref_integrity", "matchup", "doc_signature", "progress_levels", "session_counts")
NAMES = sorted(registry.QUERIES) if os.environ.get("BOUTLINE_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    error, _, _, _ = compare(con, spark, name, registry.QUERIES[name], registry.ORACLES.get(name), FOLDER)
    assert error is None, error


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert len(registry.QUERIES) > 100


def test_most_queries_are_checked_by_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"page_blocks", "tier_list", "page_sections"}
