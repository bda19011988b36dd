"""Numeric drift read off counted values: exact, and in few passes over the rows."""

from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from datavitals import compare_datasets
from datavitals.operators.drift import DECILES, MOST_BINS, binned, psi_edges
from datavitals.plans.numbers import number_counts, range_sums, values_at
from datavitals.plans.options import ScanOptions


def test_numeric_drift_reads_the_rows_twice(spark):
    """Once for the plain facts and once to count values, though the quantiles of 200,000 distinct values are asked for."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        read.add(1)
        return x * x * 0.5

    n = 200_000
    base, new = (spark.range(k, n + k).select(seen(F.col("id").cast("double")).alias("v")) for k in (0, 100))
    report = compare_datasets(base, new, options=ScanOptions(walk_limit=1_000))
    issues = report.issues.collect()
    assert read.value <= 2 * 2 * n and not issues
    row = report.numeric_table.first()
    assert row["baseline_median"] == round(float(np.median(np.arange(n) ** 2.0 * 0.5)), 4)


def test_quantiles_bins_and_distinct_counts_of_both_sides(spark):
    draw = np.random.default_rng(7)
    sides, values = [], []
    for side, n in ((0, 3000), (1, 1700)):
        v = {
            "heavy": (np.exp(draw.normal(0, 9, n)) * draw.choice([-1, 1], n)).tolist(), "few": draw.integers(0, 4, n).tolist(),
            "price": [Decimal(int(x)) / 100 for x in draw.integers(-500, 900 + 300 * side, n)], "code": draw.integers(0, 50, n).tolist()}
        v["few"][:5] = [None] * 5
        v["heavy"][:4] = [None, float("nan"), float("inf"), -0.0]
        values.append(v)
        kinds = f"heavy double, few int, price decimal(9,2), code {'double' if side else 'int'}"
        v["code"] = [float(x) for x in v["code"]] if side else v["code"]
        sides.append(spark.createDataFrame(list(zip(*v.values(), strict=True)), kinds).repartition(5))
    report = compare_datasets(*sides)
    table = {r["column"]: r for r in report.pairs(numeric=True, uniques=True).collect()}
    edges = {}
    for name in report.numeric:
        plain = [np.array([float(x) for x in v[name] if x is not None and float(x) == float(x)]) for v in values]
        for side, prefix in enumerate(("baseline", "new")):
            for p, k in ((0.25, "p25"), (0.5, "median"), (0.75, "p75")):
                assert np.isclose(table[name][f"{prefix}_{k}"], np.quantile(plain[side], p), rtol=1e-12)
            assert table[name][f"{prefix}_unique"] == len(set(plain[side].tolist()))
        fields = [report.counted[side].values[report.fields[side][name].ord] for side in (0, 1)]
        edges[name] = psi_edges(*fields, [report.facts[0].quantiles[report.fields[0][name].ord][p] for p in DECILES])
    counted = {(r["side"], r["place"]): r["n"] for r in binned(report.sides, report.fields, edges).collect()}
    for i, name in enumerate(edges):
        for side in (0, 1):
            assert report.bins[name][side] == [counted.get((side, MOST_BINS * i + k), 0) for k in range(len(edges[name]) + 1)]


def test_ranks_across_ranges(spark):
    """Every rank of a column that lies in many ranges, some of them empty on one side."""
    base = spark.range(500).selectExpr("id % 200 AS v")
    new = spark.range(90).selectExpr("CAST(1000 + id AS double) AS v")
    report = compare_datasets(base, new)
    counts = number_counts(report.sides, report.fields, ["v"])
    counts = counts.withColumn("part", F.floor(F.col("v") / 7).cast("int"))
    sums = range_sums(counts)
    assert len(sums[0]) > 40 and sum(r["ub"] for r in sums[0]) == 200 and sum(r["uc"] for r in sums[0]) == 90
    got = values_at(counts, sums, {(0, 0): list(range(500)), (0, 1): list(range(90))})
    assert [got[0, 0][k] for k in range(500)] == sorted(float(i % 200) for i in range(500))
    assert [got[0, 1][k] for k in range(90)] == [1000.0 + k for k in range(90)]


def test_a_number_on_one_side_alone_keeps_its_quantiles(spark):
    base = spark.range(101).selectExpr("id AS a", "CAST(id AS string) AS b", "id * 2 AS gone")
    new = spark.range(11).selectExpr("id AS a", "id AS b", "CAST(NULL AS double) AS none")
    rows = {r["column"]: r for r in compare_datasets(base, new).pairs(numeric=True, shifts=True, uniques=True).collect()}
    assert (rows["a"]["baseline_median"], rows["a"]["new_median"], rows["b"]["new_median"], rows["gone"]["baseline_p75"]) == (50.0, 5.0, 5.0, 150.0)
    assert (rows["a"]["baseline_unique"], rows["a"]["new_unique"], rows["b"]["new_unique"], rows["none"]["new_median"]) == (101, 11, 11, None)
