"""Results that must not depend on sizes or rounding."""

import random

import pytest

from ratelantern.operators.charges import _packed_order
from ratelantern.operators.matching import MatchConfig
from ratelantern.operators.quantiles import exact_quantiles


def test_quantiles_agree_for_all_group_sizes(spark):
    rng = random.Random(7)
    rows = [(i % 60, rng.uniform(0, 1e5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, v double")
    wanted = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    small = sorted(map(tuple, exact_quantiles(df, ["g"], "v", wanted).collect()))
    large = sorted(map(tuple, exact_quantiles(df, ["g"], "v", wanted, small_group=1).collect()))
    assert small == large


def test_negative_weights_are_refused():
    with pytest.raises(ValueError):
        MatchConfig(weights={"issuer": -1.0})


@pytest.mark.parametrize("position", [(1 << 27, 0, 0), (0, 1 << 18, 0), (0, 0, 1 << 18)])
def test_positions_beyond_the_packed_order_fail(spark, position):
    packed = _packed_order("item", "charge", "payer")
    fits = spark.createDataFrame([(1, 2, None), (1, 2, 3)], "item long, charge int, payer int").select(packed)
    assert [r[0] for r in fits.collect()] == [(1 << 36) + (2 << 18), (1 << 36) + (2 << 18) + 3]
    with pytest.raises(Exception, match="more items"):
        spark.createDataFrame([position], "item long, charge int, payer int").select(packed).collect()
