"""Registered queries against their SQL on the smallest tables, and the entry contract."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SLOW = {"d14_random_forest", "m3_train_forest", "f7_run_preset", "f9_survey_to_detections", "r13_horizon", "r14_vat", "d5_sky_view_factor"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n[0] in "gjpstu" and n not in SLOW))
def test_matches_sql(spark, name):
    verdict, _ = compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "ok"
