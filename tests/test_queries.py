"""Registered queries against their SQL on the smallest tables; RARECLASS_ALL=1 runs every one."""

import os

import pytest

from compare import compare, duck
from suite import all_oracles, all_queries

SF = os.environ.get("RARECLASS_SF", "/root/testdata/sf0.001")
QUICK = ("m3_best_f1_threshold", "m11_tuned_metrics", "t1_impute_medians", "d3_partition_dirichlet", "g1_knn_join", "o1_smote",
         "o2_adasyn", "e11_stability_guarded", "r5_average_by_accuracy", "l14_migrate_summary", "s12_scan_ledger")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(all_queries()) if os.environ.get("RARECLASS_ALL") else QUICK)
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, all_queries()[name], all_oracles().get(name))
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())
