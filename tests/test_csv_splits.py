"""CSV records over line and split ends, byte validity, ways to write times, and sources that change between passes."""

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from datavitals import Scan
from datavitals.functions.cells import positional
from datavitals.functions.times import mask, time_formats
from datavitals.operators.remediation import apply_issue_fix
from datavitals.plans.facts import table_facts
from datavitals.plans.options import ScanOptions
from datavitals.plans.quantiles import SourceChanged, rank_values
from datavitals.sources.readers import read_csv
from datavitals.sources import records as sources_records
from datavitals.sources.records import ends_open, spanning_records, survey


def plain_open(line, sep=","):
    """Whether a line that starts outside quotes ends inside them, letter by letter."""
    at, n = 0, len(line)
    while True:
        if at < n and line[at] == '"':
            at += 1
            while True:
                if at >= n:
                    return True
                if line[at] == '"' and line[at + 1:at + 2] == '"':
                    at += 2
                elif line[at] == '"':
                    break
                else:
                    at += 1
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


@pytest.mark.parametrize("sep", [",", "\t", "||"])
def test_lines_that_end_inside_quotes(spark, sep):
    draw = random.Random(1)
    lines = ["".join(draw.choice(['"', '"', sep, "a", " ", "'", "\r", "\\"]) for _ in range(draw.randrange(14))) for _ in range(600)]
    lines += ['"' * 20_001, '""' * 20_000, ('"a""b",' * 9000) + '"open', "x" * 100_000 + '"', f'5" pipe{sep}3" pipe']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    found = [r["o"] for r in df.selectExpr("line", f"{ends_open('line', sep)} AS o").collect()]
    assert found == [plain_open(x, sep) for x in lines]


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size, end", [(40, "\n"), (133, "\r\n"), (1 << 20, "\n")])
def test_records_span_lines_and_splits(spark, tmp_path, size, end):
    draw = random.Random(size)
    parts = ["a", "b\nc", "\n\n", 'say ""', "x,y", '"', "é\r\nü", "", "5 in", "long " * 12]
    tables = []
    for k in range(3):
        rows = [[f"{k}-{i}", "".join(draw.choice(parts) for _ in range(draw.randrange(4))) or "z", draw.choice(["p", "q\n", '"r"'])] for i in range(60)]
        tables.append(rows)
        (tmp_path / f"part{k}.csv").write_bytes(written([["id", "text", "more"], *rows], end).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1 if size < 10_000 else size)
    try:
        found = spanning_records(spark, str(tmp_path), ",").collect()
        df = read_csv(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.collect())
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sum(r["header"] for r in found) == 3
    records = sorted(next(csv.reader(io.StringIO(r["record"], newline=""))) for r in found if not r["header"])
    assert records == sorted(row for rows in tables for row in rows)
    blank = lambda t: t.strip() or None
    assert got == sorted((i, blank(t), blank(m)) for rows in tables for i, t, m in rows)
    assert ("FileScan csv" in plan) == (size > 10_000)  # files of several splits are not read whole


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_lines_of_a_split_are_dealt_by_chunk(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(sources_records, "CHUNK_BITS", bits)
    draw = random.Random(bits)
    rows = [[str(i), "".join(draw.choice(["a", "b\nc", "\n\n\n\n\n", '"', ",", "\n\"\n"]) for _ in range(draw.randrange(5))) or "z"] for i in range(200)]
    for k in range(2):
        (tmp_path / f"part{k}.csv").write_text(written([["id", "two\nlines"], *rows[k::2]]))
    for size in (200, 1 << 20):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = spanning_records(spark, str(tmp_path), ",").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert [r["record"] for r in found if r["header"]] == ['id,"two\nlines"'] * 2
        assert sorted(next(csv.reader(io.StringIO(r["record"], newline=""))) for r in found if not r["header"]) == sorted(rows)


def test_a_stray_inch_mark_changes_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('size,n\n5" pipe,3\nflat 6",4\n')
    df = read_csv(spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == [('5" pipe', 3), ('flat 6"', 4)]
    assert survey(spark, str(tmp_path), ",")["open"] == 0
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_replacement_characters_are_text_and_broken_bytes_are_not(spark, tmp_path):
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.csv").write_bytes("k,v\n1,a�b\n2,ü\n".encode())
    assert [r["v"] for r in read_csv(spark, str(tmp_path / "good")).orderBy("k").collect()] == ["a�b", "ü"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_bytes(b"k,v\n1,a\n2,\xff\xfe\n3,\xfc\n")
    with pytest.raises(ValueError, match="line 3 of .*a.csv"):
        read_csv(spark, str(tmp_path / "bad"))
    assert read_csv(spark, str(tmp_path / "bad"), strict=False).count() == 3
    latin = read_csv(spark, str(tmp_path / "bad"), encoding="ISO-8859-1").orderBy("k").collect()
    assert latin[2]["v"] == "ü"


# ways to write times

WRITTEN = {
    "us": ["3/14/2024", "12/01/2024", "1/2/2024", "x"], "eu": ["14/3/2024", "01/12/2024", "31/12/2024", "12/31/2024"],
    "either": ["03/04/2024", "05/06/2024", "01/02/2024", "07/08/2024"], "dots": ["3.2.2024 10:00", "24.12.2024 9:30", "1.1.2024 0:00", None],
    "named": ["3 Feb 2024", "24 Dec 2024", "1 Jan 2024", "Jan 1, 2024"], "iso": ["2024-02-03", "2024-02-03T10:00:00", "2024-12-24 01:02:03.5", "3/14/2024"],
    "digits": ["20240203", "20241224", "20240101", "1234"], "nothing": ["a", "b", "c", "9" * 40],
}


def test_one_way_of_writing_a_column(spark):
    df = spark.createDataFrame(list(zip(*WRITTEN.values(), strict=True)), list(WRITTEN))
    found = time_formats(positional(df), [f"c{i}" for i in range(len(WRITTEN))])
    assert list(found.values()) == ["M/d/yyyy", "d/M/yyyy", "M/d/yyyy", "M.d.yyyy H:mm", "d MMM yyyy", "ISO", "yyyyMMdd", "ISO"] or \
        list(found.values()) == ["M/d/yyyy", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy H:mm", "d MMM yyyy", "ISO", "yyyyMMdd", "ISO"]
    assert found["c3"] == "d.M.yyyy H:mm"  # three of three against two


def test_masks_take_no_regular_expressions(spark):
    texts = ["3/14/2024", "12/1/24 5:06", "2024-1-2 03:04:05.123456", "Jan 5, 2024", "1", "12", "123", "1234", "1234567", "12345678", "é1Ä²x", "\x019-\x02-\x03", "", None]
    got = [r["m"] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(f"{mask('t')} AS m").collect()]
    plain = lambda t: re.sub("(?<!9)9(?!9)", "99", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[\x01-\x03]", "?", t)))))
    assert got == [None if t is None else plain(t) for t in texts]
    assert "regexp" not in mask("t")


def test_dates_in_other_orders_raise_the_issue_and_are_fixed(spark):
    df = spark.range(40).selectExpr("concat(id % 12 + 1, '/', id % 28 + 1, '/', 2000 + id) AS created_at", "id % 3 AS k")
    issue = Scan(df).issues.where("issue_type = 'suspicious_timestamp_granularity'").first()
    assert issue["column"] == "created_at" and issue["metric_value"] == 1.0
    fixed, actions = apply_issue_fix(df, issue)
    assert fixed.columns == ["k", "created_at_dayofweek", "created_at_hour"] and fixed.where("created_at_dayofweek IS NULL").count() == 0
    assert fixed.where("k = 0").orderBy("k").count() == 14
    one = apply_issue_fix(spark.createDataFrame([("03/04/2024",)], "created_at string"), issue)[0].first()
    assert one["created_at_dayofweek"] == 0  # the fourth of March 2024 is a Monday; the third of April is not


# sources that change


@pytest.mark.parametrize("said, there", [(5000, 40), (5000, 0), (300, 4000)])
def test_quantiles_stop_when_the_source_changes(spark, said, there):
    cells = spark.range(there).selectExpr("pow(id, 9) AS c0")
    ends = {"c0": (0.0, float(said) ** 9)}
    with pytest.raises(SourceChanged):
        rank_values(cells, {"c0": [said // 3, said - 2]}, ends, {"c0": said}, ScanOptions(walk_limit=10, sketch_k=64))


def test_the_changed_column_is_named(spark, monkeypatch):
    def moved(cells, wanted, *rest):
        raise SourceChanged(next(iter(wanted)))

    monkeypatch.setattr("datavitals.plans.facts.rank_values", moved)
    with pytest.raises(ValueError, match="column height: the source changed"):
        table_facts(spark.createDataFrame([("a", 1.0)], "k string, height double"), unique="none", fences=False)
