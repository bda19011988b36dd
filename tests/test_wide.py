"""Wide tables, nested cells, long labels and repeated keys: what the plans do as well as what they find."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datavitals import Scan, compare_datasets, simulate_cleaning
from datavitals.functions.cells import fields_of, positional
from datavitals.operators.chartdata import correlations
from datavitals.operators.drift import bin_of, binned
from datavitals.operators.profile import category_shares, modes, top_values
from datavitals.operators.remediation import apply_issue_fix, repeated_key_rows
from datavitals.plans.comoments import comoments
from datavitals.plans.facts import without_repeats
from datavitals.plans.labels import keyed

# correlations


def plain_corr(a, b):
    both = np.isfinite(a) & np.isfinite(b)
    a, b = a[both], b[both]
    if not len(a) or (a == a[0]).all() or (b == b[0]).all():
        return None
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum() / math.sqrt((a * a).sum()) / math.sqrt((b * b).sum()))


def check_correlations(spark, values: dict):
    names = list(values)
    rows = list(zip(*[[None if math.isnan(x) else float(x) for x in v] for v in values.values()], strict=True))
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.DoubleType()) for n in names])).repartition(3)
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in correlations(df).collect()}
    assert set(found) == set(itertools.product(names, names))
    for (a, b), r in found.items():
        want = plain_corr(np.asarray(values[a], float), np.asarray(values[b], float))
        assert (r is None) == (want is None), (a, b, r, want)
        assert want is None or abs(r - want) < 1e-9, (a, b)


def test_correlations_of_constants_and_gaps(spark):
    rng = np.random.default_rng(1)
    n, gap = 300, np.nan
    x = rng.normal(size=n)
    mask = np.arange(n) % 3 == 0
    check_correlations(spark, {
        "x": x, "same": np.full(n, 0.1), "nothing": np.full(n, gap), "gappy": np.where(mask, gap, x + rng.normal(size=n)),
        "other_gaps": np.where(mask, x, gap), "far": 1e9 + x, "one": np.where(np.arange(n) == 7, 1.0, gap),
        "same_where_gappy": np.where(mask, x, 0.3), "endless": np.where(np.arange(n) == 5, np.inf, x), "tiny": 1e-120 * x, "huge": 1e150 * x,
    })
    assert correlations(spark.createDataFrame([(1, 2), (1, 3), (1, 5)], "a int, b int")).where("corr IS NOT NULL").count() == 1
    assert correlations(spark.createDataFrame([(1, "x")], "a int, s string")).count() == 0
    empty = correlations(spark.createDataFrame([], "a int, b int")).collect()
    assert len(empty) == 4 and all(r["corr"] is None for r in empty)


def test_correlations_of_many_columns_in_one_pass(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=(40, 40))
    df = spark.createDataFrame([tuple(map(float, r)) for r in values], [f"v{i}" for i in range(40)])
    correlations(df).count()
    start = time.perf_counter()
    found = {(r["column_a"], r["column_b"]): r["corr"] for r in correlations(df).collect()}
    assert time.perf_counter() - start < 4
    want = np.corrcoef(values.T)
    assert all(abs(found[f"v{i}", f"v{j}"] - want[i, j]) < 1e-12 for i in range(40) for j in range(40))
    wide = spark.range(500).select(*[((F.col("id") * (i + 3)) % (i + 7)).cast("double").alias(f"v{i}") for i in range(200)])
    plan = comoments(wide)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Range (") == 1  # one scan
    assert correlations(wide).count() == 200 * 200


def test_comoments_merge_over_partitions(spark):
    df = spark.range(1000).selectExpr("1e8D + id AS a", "CASE WHEN id % 2 = 0 THEN id * 0.5D END AS b").repartition(7)
    row = comoments(df).where("i = 0 AND j = 1").first()
    even = np.arange(0, 1000, 2)
    assert row["n"] == 500 and abs(row["mean_i"] - (1e8 + even.mean())) < 1e-6
    assert abs(row["c_ij"] / ((even - even.mean()) * (even * 0.5 - even.mean() * 0.5)).sum() - 1) < 1e-9


# nested cells

NESTED = T.StructType([
    T.StructField("k", T.IntegerType()), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("a", T.ArrayType(T.DoubleType())),
    T.StructField("s", T.StructType([T.StructField("x.y", T.MapType(T.IntegerType(), T.ArrayType(T.StringType()))), T.StructField("z", T.FloatType())])),
])
NAN = float("nan")
NESTED_ROWS = [
    (1, {"a": 1.0, "b": 2.0}, [1.0, None], Row({1: ["p"]}, 0.5)),
    (1, {"b": 2.0, "a": 1.0}, [1.0, NAN], Row({1: ["p"]}, 0.5)),     # the same: entries in other order, NaN for null
    (1, {"a": 1.0, "b": 2.0}, [None, 1.0], Row({1: ["p"]}, 0.5)),    # another order of elements
    (2, {}, [], Row({}, -0.0)), (2, {}, [], Row({}, 0.0)),           # the same: zeros
    (2, None, [], Row({}, 0.0)), (2, {}, None, Row({}, 0.0)), (2, {}, [], None), (2, {}, [], Row(None, 0.0)), (2, {}, [], Row({}, NAN)),
    (2, {"a": None}, [], Row({}, 0.0)), (2, {"a": NAN}, [], Row({}, 0.0)),  # these two are the same
]


def test_nested_rows_are_counted_and_dropped_alike(spark):
    df = spark.createDataFrame([tuple(r) for r in NESTED_ROWS], NESTED).repartition(4)
    scan = Scan(df)
    assert scan.facts.duplicate_rows == 3
    issue = scan.issues.where("issue_type = 'duplicate_rows'").first()
    assert issue["severity"] == "critical"
    cleaned = simulate_cleaning(df)
    assert cleaned.dropped_rows == 3 and cleaned.df.count() == 9 and cleaned.df.schema["m"].dataType == NESTED["m"].dataType
    fixed, actions = apply_issue_fix(df, {"issue_type": "duplicate_rows", "column": "dataset"})
    assert fixed.count() == 9 and actions == ["duplicate rows dropped"]
    assert Scan(fixed).facts.duplicate_rows == 0
    assert repeated_key_rows(df, ["m"]).count() == 3 + 6 + 2 and repeated_key_rows(df, ["s", "k"]).count() == 3 + 6
    assert compare_datasets(df, df).summary.first()["issue_count"] == 0


def test_map_columns_without_a_unique_column(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 1}), (2, {"b": 1})], "a int, m map<string,int>")
    assert Scan(df).facts.duplicate_rows == 1 and without_repeats(df).count() == 2
    both = spark.createDataFrame([(1, {"a": {"b": 1, "c": 2}}), (1, {"a": {"c": 2, "b": 1}})], "a int, m map<string,map<string,int>>")
    assert without_repeats(both).count() == 1
    other = spark.sql("SELECT * FROM VALUES (parse_json('{\"a\":1,\"b\":2}'), X'00'), (parse_json('{\"b\":2,\"a\":1}'), X'00') AS t(v, b)")
    assert without_repeats(other).count() == 1


# long labels

LONG = ["license " * 20 + tail for tail in ("b", "a", "c", "d")]


def test_long_labels_are_counted_by_digest(spark):
    base = spark.createDataFrame([(x,) for x in [LONG[0]] * 3 + [LONG[1]] * 3 + ["short"] * 2 + [None]], "s string")
    new = spark.createDataFrame([(x,) for x in [LONG[2]] * 2 + [LONG[3]] * 2 + ["short"] + [f"{i:02d}" * 50 for i in range(12)] + [LONG[0]]], "s string")
    row = compare_datasets(base, new).categorical_table.first()
    assert row["baseline_dominant"] == LONG[1] and row["new_dominant"] == LONG[2]
    assert row["new_categories"] == ", ".join(f"{i:02d}" * 50 for i in range(10))
    assert (row["new_category_count"], row["removed_category_count"], row["baseline_dominant_share"]) == (14, 1, 0.375)
    same = compare_datasets(base, base).categorical_table.first()
    assert same["new_category_count"] == 0 and same["max_frequency_change"] == 0 and same["new_categories"] == ""


def test_no_long_text_is_shuffled_to_count_labels(spark):
    texts = spark.range(400).selectExpr("repeat(concat('text ', id % 7), 40) AS s")
    counts = texts.selectExpr("s AS value").selectExpr(*keyed("value")).groupBy("long", "key", "head").count()
    plan = counts._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "value" not in exchange and counts.agg(F.max(F.octet_length("key")), F.max(F.octet_length("head"))).first() == (32, 16)
    assert [(r["value"], r["n"]) for r in top_values(texts, "s", 3).collect()] == [("text 0" * 40, 58), ("text 1" * 40, 57), ("text 2" * 40, 57)]
    assert top_values(texts.where("s IS NULL"), "s", 3).count() == 0


def test_top_labels_break_ties_by_the_whole_label(spark):
    rng = np.random.default_rng(3)
    for limit in (1, 2, 5, 40):
        labels = [str(rng.choice(["same head, long " * 6, "x", ""])) + str(rng.integers(0, 12)) for _ in range(300)]
        df = spark.createDataFrame([(x,) for x in [*labels, None]], "s string").repartition(3)
        want = sorted(((-labels.count(x), x) for x in set(labels)))[:limit]
        assert [(-r["n"], r["value"]) for r in top_values(df, "s", limit).collect()] == want
        assert modes(df, ["s"]).first()["mode"] == want[0][1]
        assert abs(category_shares(df, "s", limit).first()["share"] + want[0][0] / 300) < 1e-12


# PSI bins


@pytest.mark.parametrize("edges", [[], [1.0], [0.0, 1.0], [-5.0, -1.5, 0.0, 0.25, 3.0, 4.0, 5.0, 6.0, 7.0]])
def test_bins_are_closed_on_the_right(spark, edges):
    values = [*edges, *[e + 0.1 for e in edges], -1e300, 1e300, 0.2]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    found = positional(df).selectExpr("c0", f"CASE WHEN c0 IS NOT NULL THEN {bin_of('c0', edges)} END AS bin").collect()
    assert all(r["bin"] == (None if r["c0"] is None else sum(e < r["c0"] for e in edges)) for r in found)


def test_bins_of_a_thousand_columns_take_one_shuffle(spark):
    df = spark.range(60).select(*[(F.col("id") * (i + 1)).alias(f"v{i}") for i in range(1000)])
    sides, fields = (df, df), tuple({f.name: f for f in fields_of(df)} for _ in (0, 1))
    counted = binned(sides, fields, {f"v{i}": [float(10 * (i + 1) * k) for k in range(1, 6)] for i in range(1000)})
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = counted.collect()
    assert len(rows) == 2 * 1000 * 6 and {r["n"] for r in rows if r["place"] % 11 == 0} == {11} and sum(r["n"] for r in rows) == 2 * 60_000


# repeated keys


def test_keys_below_the_bar_are_shuffled_and_those_above_stay(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id < 3000 THEN -1 WHEN id < 3018 THEN -2 ELSE id END AS k", "id").repartition(6)
    for bar in (10, 100, 1_000_000):
        found = repeated_key_rows(df, ["k"], task_rows=bar)
        assert found.count() == 3018 and {r["k"] for r in found.select("k").distinct().collect()} == {-1, -2}
    nulls = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (None, 4)], "k int, v int")
    assert repeated_key_rows(nulls, ["k"], task_rows=2).count() == 3


def test_repeats_beyond_the_broadcast_bound(spark):
    df = spark.range(3000).selectExpr("id % 900 AS a", "CAST(id % 900 AS string) AS s").repartition(5)
    assert without_repeats(df, most=10).count() == 900 == without_repeats(df).count()


# scans after a fix

FIXED = [
    ("missing_values", "gaps"), ("missing_values", "word"), ("constant_column", "same"), ("numeric_outliers_iqr", "gaps"), ("likely_id_column", "row_id"),
    ("imbalanced_categorical", "word"), ("possible_wrong_dtype", "digits"), ("suspicious_timestamp_granularity", "made_date"), ("duplicate_rows", "dataset"),
    ("target_quality_risk", "word"),
]


ROLES = {"entity_id": "word", "timestamp": "made_date", "target": "gaps"}


@pytest.mark.parametrize("kind, column, roles", [*[(k, c, None) for k, c in FIXED], *[(k, c, ROLES) for k, c in FIXED[1:3]]])
def test_a_scan_after_a_fix_reads_only_what_it_touched(spark, monkeypatch, kind, column, roles):
    from datavitals.operators.remediation import touched_columns
    from datavitals.plans import facts

    df = spark.range(60).selectExpr(
        "id DIV 2 AS row_id", "CASE WHEN id % 8 > 1 THEN (id DIV 2) * 1.5D END AS gaps", "CASE WHEN id % 10 > 1 THEN concat('w', id DIV 2 % 3) END AS word",
        "'x' AS same", "concat('1,', 100 + id DIV 2) AS digits", "concat('2024-01-', 1 + id DIV 2) AS made_date")
    before = Scan(df, roles)
    before.facts
    issue = {"issue_type": kind, "column": column}
    fixed, _ = apply_issue_fix(df, issue)
    read = []
    whole = facts.table_facts
    monkeypatch.setattr(facts, "table_facts", lambda part, *a, **k: read.append(part.columns) or whole(part, *a, **k))
    after = before.after(fixed, touched_columns(df, fixed, issue))
    got = [tuple(r) for r in after.metrics.orderBy("col_ord").collect()]
    assert got == [tuple(r) for r in Scan(fixed, roles).metrics.orderBy("col_ord").collect()]
    assert [tuple(r) for r in after.issues.collect()] == [tuple(r) for r in Scan(fixed, roles).issues.collect()]
    if kind != "duplicate_rows":
        assert all(set(c) <= {column, "made_date_dayofweek", "made_date_hour"} for c in read)
