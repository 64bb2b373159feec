"""The bootstrap queries resample as often as the reference: 4000 times, by clusters 2000 times."""

import pytest

from loomwork.functions import traces
from loomwork.queries import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name, draws", [("q_bootstrap", 4000), ("q_bootstrap_clustered", 2000)])
def test_draws(spark, monkeypatch, name, draws):
    seen, plain = [], traces.bootstrap

    def spy(*a, **b):
        seen.append(b.get("draws"))
        return plain(*a, **b)

    monkeypatch.setattr(traces, "bootstrap", spy)
    rows = QUERIES[name](spark, SF).collect()
    assert seen == [draws] and rows and all(r["low"] <= r["high"] for r in rows)
