"""Loading, exporting, run history, contracts, monitored streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from datavitals import Roles, Scan, data_contract
from datavitals.functions.names import monitor_name
from datavitals.operators.cleaning import compare_cleaning, simulate_cleaning
from datavitals.operators.contract import contract_document
from datavitals.sources import history, readers, writers
from datavitals.streaming.monitor import monitor_stream


def csv(tmp_path, text, name="in.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_and_nulls(spark, tmp_path):
    path = csv(tmp_path, 'n,x,flag,gap,day,s,empty\n1,1.5,True,True,2026-01-02,"a, b",\n2, N/A ,False,,2026-01-03, None ,\n#N/A,3e2,true,False,2026-01-04,None,null\n')
    df = readers.read_csv(spark, path)
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "gap": "string", "day": "string", "s": "string", "empty": "double"}
    rows = df.collect()
    assert [r["n"] for r in rows] == [1, 2, None] and [r["x"] for r in rows] == [1.5, None, 300.0]
    assert [r["s"] for r in rows] == ["a, b", "None", None]   # only the bare word is a null word
    typed = readers.read_csv(spark, path, schema="n int, x float, flag string, gap string, day date, s string, empty string")
    assert dict(typed.dtypes)["day"] == "date" and typed.first()["n"] == 1


def test_csv_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="too many fields"):
        readers.read_csv(spark, csv(tmp_path, "a,b\n1,2\n1,2,3\n", "many.csv"))
    short = readers.read_csv(spark, csv(tmp_path, "a,b\n1,2\n3\n", "short.csv"))
    assert [tuple(r) for r in short.collect()] == [(1, 2), (3, None)]
    staged = readers.read_csv(spark, csv(tmp_path, "A,a \n1,x\n", "staged.csv"), staged=True)
    assert staged.columns == ["A", "a "] and staged.dtypes[0][1] == "bigint"
    with pytest.raises(ValueError, match="empty"):
        readers.read_csv(spark, csv(tmp_path, "", "empty.csv"))
    with pytest.raises(ValueError, match="UTF-8"):
        readers.read_csv(spark, csv(tmp_path, "a,b\ncafé,2\n", "latin.csv", "latin-1"))
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "absent.csv"))


def test_csv_records_that_span_lines(spark, tmp_path):
    path = csv(tmp_path, 'id,note,v\n1,"line one\nline two",5\n2,ok,6\n3,"a ""b"" c",7\n', "broken_lines.csv")
    df = readers.read_csv(spark, path)
    assert [tuple(r) for r in df.collect()] == [(1, "line one\nline two", 5), (2, "ok", 6), (3, 'a "b" c', 7)]
    assert dict(df.dtypes) == {"id": "bigint", "note": "string", "v": "bigint"}
    assert readers.read_csv(spark, path, multiLine=True).count() == 3


def test_csv_files_with_other_headers(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    csv(folder, "a,b\nx,1\n", "1.csv")
    csv(folder, "b,a\n2,y\n", "2.csv")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_csv(spark, str(folder))
    csv(folder, "a,b\nz,3\n", "2.csv")
    assert sorted(tuple(r) for r in readers.read_csv(spark, str(folder)).collect()) == [("x", 1), ("z", 3)]


def test_wide_csv(spark, tmp_path):
    path = csv(tmp_path, ",".join(f"n{i}" for i in range(400)) + "\n" + ",".join(str(i) if i % 2 else f"t{i}" for i in range(400)) + "\n", "wide.csv")
    df = readers.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["string", "bigint"] * 200


def test_load_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, " x "), (2, "NULL")], "a int, s string")
    writers.write_parquet(df, str(tmp_path / "t.parquet"))
    assert [r["s"] for r in readers.load(spark, str(tmp_path / "t.parquet")).orderBy("a").collect()] == ["x", None]
    writers.write_csv(df, str(tmp_path / "t.csv"))
    assert readers.read_csv(spark, str(tmp_path / "t.csv")).count() == 2
    assert readers.preview(spark.range(50)).count() == 10


def test_cleaning_record(spark, tmp_path):
    df = spark.createDataFrame([(i // 2, 1.0 if i % 3 else None) for i in range(20)], "k int, v double")
    record = writers.cleaning_record(compare_cleaning(df, simulate_cleaning(df).df), "conservative")
    writers.write_json(record, str(tmp_path / "record"))
    row = spark.read.json(str(tmp_path / "record")).first()
    assert row["label"] == "conservative" and row["original"]["rows"] == 20 and row["cleaned_preview"]["rows"] < 20


def test_contract_document(spark, tmp_path):
    df = spark.createDataFrame([(i, "ab"[i % 2], None if i == 3 else i / 2) for i in range(30)], "id int, s string, v double")
    contract = data_contract(df, Roles(entity_id="id"))
    document = contract_document(contract, Roles(entity_id="id"), "2026-01-01T00:00:00+00:00")
    writers.write_contract(document, str(tmp_path / "contract"))
    read = json.loads(spark.read.text(str(tmp_path / "contract")).first()[0])
    assert read["contract_version"] == "0.1" and read["required_columns"] == ["id", "s", "v"]
    assert read["roles"]["entity_id_column"] == "id" and read["roles"]["target_column"] is None
    assert read["columns"]["id"]["unique"] and "allowed_values" not in read["columns"]["id"]
    assert read["columns"]["s"]["allowed_values"] == ["a", "b"] and "min_value" not in read["columns"]["s"]
    assert read["columns"]["v"]["nullable"] and read["columns"]["v"]["max_value"] == 14.5


def test_history(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert history.recent_runs(spark, path).count() == 0
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "a int, b int")
    scan = Scan(df)
    assert history.save_run(history.run_record(scan, "m", timestamp="2026-01-01T00:00:00+00:00"), path)
    assert not history.save_run(history.run_record(scan, "m", timestamp="2026-01-02T00:00:00+00:00"), path)
    worse = Scan(df.withColumn("c", F.lit(1)))
    assert history.save_run(history.run_record(worse, "m", timestamp="2026-01-03T00:00:00+00:00"), path)
    assert history.save_run(history.run_record(scan, "other", timestamp="2026-01-04T00:00:00+00:00"), path)
    runs = history.runs_for_dataset(spark, path, "m").collect()
    assert [r["timestamp"][:10] for r in runs] == ["2026-01-01", "2026-01-03"]
    assert runs[1]["critical_count"] == 1 and runs[1]["issue_summaries"][-1]["display_name"]
    assert history.runs_for_dataset(spark, path, "m", schema_fingerprint=history.fingerprint(["a", "b"])).count() == 1
    assert [r["dataset_name"] for r in history.recent_runs(spark, path, 1).collect()] == ["other"]


def test_history_reads_files_without_newer_columns(spark, tmp_path):
    path = str(tmp_path / "old")
    old = history.run_record(Scan(spark.range(20).toDF("a")), "m").drop("schema_fingerprint", "run_signature")
    old.write.partitionBy("dataset_name").parquet(path)
    row = history.recent_runs(spark, path).first()
    assert row["schema_fingerprint"] == "" and row["run_signature"] == "" and row["row_count"] == 20


def test_monitor_name(spark):
    paths = ["/x/baseline_sales.csv", "prod_new_y.v1.csv", "s3://b/k/broken_z.parquet", ".profile", "production_q"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(monitor_name(F.col("p"))).collect()
    assert [r[0] for r in got] == ["sales", "new_y.v1", "z", ".profile", "q"]


def test_monitored_stream(spark, tmp_path):
    for day in (1, 2):
        spark.range(40).selectExpr("id", f"CAST(IF(id < {day * 10}, NULL, 1.0 + id % 5) AS double) AS v").write.parquet(str(tmp_path / f"in/d={day}"))
    stream = spark.readStream.schema("id bigint, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path, state = str(tmp_path / "runs"), str(tmp_path / "state")
    for _ in range(2):   # a second start finds nothing new
        monitor_stream(stream, "feed", path, state).awaitTermination()
    runs = history.runs_for_dataset(spark, path, "feed").collect()
    assert sum(r["row_count"] for r in runs) == 80 and len({r["run_id"] for r in runs}) == len(runs)


def test_two_sides_of_drift_cover_their_table(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from suite import sources as S

    kinds = {"int": pa.int64(), "float": pa.float64(), "str": pa.string(), "ts": pa.timestamp("us")}
    days = [datetime.datetime(1998, 1, 1), datetime.datetime(1999, 1, 1), datetime.datetime(2024, 3, 1), None]
    for (before, after), key, values in (
        ((S.EVENTS_BEFORE, S.EVENTS_AFTER), "ts", days), ((S.ITEMS_BEFORE, S.ITEMS_AFTER), "l_shipdate", days),
        ((S.DOCS_EN, S.DOCS_OTHER), "lang", ["en", "de", "fr", None]),
    ):
        held = {n: pa.nulls(len(values), kinds[k]) for n, k in before.columns}
        held[key] = pa.array(values, held[key].type)
        if key == "ts":
            held["event_id"] = pa.array(range(len(values)), pa.int64())
        pq.write_table(pa.table(held), f"{tmp_path}/{before.tables[0]}.parquet")
        assert before.frame(spark, str(tmp_path)).count() + after.frame(spark, str(tmp_path)).count() == len(values), key
