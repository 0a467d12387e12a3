"""Registered queries against their oracles on the small tables; ``ALL_QUERIES=1`` runs all of them."""

import os

import pytest

from checks.all import ORACLES, QUERIES
from checks.compare import run

SMALL = "/root/testdata/sf0.001"
SOME = ["D1_hardcoded_secret", "D9_copilot_insecure_suggestion", "D23_sector_rules", "D24_license_detected_pages", "D28_W3_one_batch",
        "A2_A9_batch_verdict", "J7_J8_L3_review_comments", "W4_diff_lines", "A3_summary", "J13_latest_resolution", "T2_audit_trend_stream"]
NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert run(spark, SMALL, [name]) == []


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n in QUERIES if "pipeline" in n]


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["batch_id", "policy", "override_allowed", "files_scanned"]
