"""Exact quantiles against numpy, on data that is awkward to bracket."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from datavitals.plans.facts import table_facts
from datavitals.plans.options import ScanOptions

PROBS = tuple(i / 10 for i in range(11)) + (0.25, 0.75)


def check(spark, values, **options):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    facts = table_facts(df, options=ScanOptions(**options), unique="none", probs=PROBS, fences=False)
    for p in PROBS:
        assert facts.quantiles[0][p] == pytest.approx(np.quantile(np.asarray(values, dtype=float), p), rel=1e-12, abs=1e-300), p


@pytest.mark.parametrize("name", ["uniform", "hot", "heavy", "two", "wide", "ints"])
def test_shapes(spark, name):
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.uniform(-5, 5, 3000),
        "hot": np.concatenate([np.full(1500, 3.25), rng.normal(3.25, 1e-6, 1000), rng.uniform(0, 9, 500)]),
        "heavy": np.exp(rng.uniform(-300, 300, 3000)),
        "two": np.array([1.0] * 900 + [2.0] * 100),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0] * 60),
        "ints": rng.integers(0, 40, 3000).astype(float),
    }[name]
    check(spark, values, walk_limit=20, sketch_k=64)
    check(spark, values)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(spark, values, walk_limit=3, sketch_k=16)


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "v double")
    facts = table_facts(df, unique="all")
    assert facts.quantiles[0][0.5] == 2.5 and facts.values[0]["missing"] == 2 and facts.values[0]["n_unique"] == 2
