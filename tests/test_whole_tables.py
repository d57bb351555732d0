"""Queries that must answer for every row of their tables."""

from pathlib import Path

import pytest

from hiresift.plans import all_queries
from hiresift.plans.recruiting import matches

DATA = Path("/root/testdata/sf0.001")


def test_every_match_has_a_heuristic_score(spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    ids = [sorted(r.id for r in rows.select("id").collect()) for rows in (all_queries()["heuristic_scores"](spark, str(DATA)), matches(spark, str(DATA)))]
    assert ids[0] == ids[1]
