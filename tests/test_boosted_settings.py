"""The registered boosted queries train with the full settings of the operator."""

import pytest

from rareclass.operators import trees as t
from suite.groups import QUERIES


class Stop(Exception):
    pass


@pytest.mark.parametrize("name, want", [
    ("r11_r12_best_booster", (100, 6, 1.0)), ("r16_r17_stacked_trees", (50, 6, 0.8)), ("r18_pooled_boosted", (100, 6, 1.0)),
    ("r25_standalone_clients", (100, 6, 1.0))])
def test_full_settings(spark, monkeypatch, name, want):
    made = []

    def watched(df, client, vec, label, row_id, settings, task_cells):
        made.append(settings)
        raise Stop

    monkeypatch.setattr(t, "fit_forest", watched)
    with pytest.raises(Stop):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert (made[0].trees, made[0].depth, made[0].subsample) == want and made[0].rate == 0.1
