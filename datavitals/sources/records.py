"""CSV records that span lines, read from files that stay split.

Whether a line starts inside quotes depends on every line before it, but only through one bit. A line is therefore a function of that bit:
most keep it, some set it, some turn it over. The functions of the lines of a chunk, a short stretch of a split, are composed in order,
giving one function a chunk; those are composed over a split's chunks and a file's splits, and then every chunk knows how it starts and
where its first record begins. Lines of a record that began in an earlier chunk go to it.

Quotes count where the format lets them: a field is quoted if a quote is its first character, a doubled quote stands for one, and a
quote inside an unquoted field is an ordinary character (a stray inch mark opens nothing)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from datavitals.session import stage

BROADCAST_CHUNKS = 100_000
CHUNK_BITS = 11   # a chunk has up to 2,048 lines of a split


def raw_lines(spark: SparkSession, path) -> DataFrame:
    """(line, file, split, id): every line in file order within its split. A carriage return before the line feed stays."""
    return spark.read.option("lineSep", "\n").text(path).selectExpr(
        "value AS line", "_metadata.file_path AS file", "_metadata.file_block_start AS split", "monotonically_increasing_id() AS id")


def ends_open(line: str, sep: str) -> str:
    """SQL: whether a line that starts outside quotes ends inside them. Every loop of the pattern is possessive, so that neither
    long lines nor many quotes cost more than one pass."""
    s = "".join("\\" + ch if not ch.isalnum() else ch for ch in sep)
    other = f"(?:(?!{s})[^\"])" if len(sep) > 1 else f'[^"{s}]'
    rest = f"(?:(?!{s}).)*+" if len(sep) > 1 else f"[^{s}]*+"
    inside = r'"[^"]*+(?:""[^"]*+)*+'
    pattern = rf'(?s)^(?:(?:{inside}"{rest}|{other}{rest}|){s})*+{inside}\z'
    return f"(contains({line}, '\"') AND rlike({line}, r'{pattern}'))"


def survey(spark: SparkSession, path, sep: str) -> dict:
    """One pass over the lines: how many end inside quotes if they start outside, how many different header lines the
    files have, the place of the first line that is not UTF-8, and whether any file has several splits."""
    lines = raw_lines(spark, path)
    splits = lines.groupBy("file", "split").agg(
        F.expr(f"count_if({ends_open('line', sep)})").alias("open"), F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"),
        F.expr("min(CASE WHEN NOT is_valid_utf8(line) THEN id END)").alias("broken"))
    splits = stage(splits, "splits")
    total = splits.agg(F.sum("open").alias("open"), F.count_distinct("file").alias("files"), F.count("broken").alias("broken"), F.max("split").alias("last")).first()
    out = {"open": total["open"] or 0, "headers": 1, "broken": None, "split": bool(total["last"])}
    if (total["files"] or 0) > 1:
        heads = splits.where("split = 0").select("first")
        out["headers"] = lines.join(heads, F.col("id") == F.col("first"), "left_semi").selectExpr("rtrim('\r', line) AS line").distinct().limit(2).count()
    if total["broken"]:
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        place = splits.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).where("broken IS NOT NULL")
        out["broken"] = place.orderBy("file", "split").selectExpr("file", "before + broken - first + 1 AS line").first()
    return out


def _state(start: str, const: str, flips: str) -> str:
    """The bit before a line or split: that of the last one that set it (or the start), turned over by each flip since."""
    return f"(coalesce({const}.bit, {start}) <> ((coalesce({flips}, 0) - coalesce({const}.flips, 0)) % 2 = 1))"


def _composed(rows: DataFrame, by: list[str], order: str, from_out: str, from_in: str) -> DataFrame:
    """Add `const` and `flips`: what the rows before have made of the bit, for rows whose functions end in `from_out` or `from_in`."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("flips", F.coalesce(F.sum(F.expr(f"CAST({from_out} AND NOT {from_in} AS int)")).over(before), F.lit(0)))
    setting = F.when(F.expr(f"{from_out} = {from_in}"), F.struct(F.expr(from_out).alias("bit"), F.col("flips").alias("flips")))
    return rows.withColumn("const", F.last(setting, ignorenulls=True).over(before))


def spanning_records(spark: SparkSession, path, sep: str) -> DataFrame:
    """(record, header): every record of the files, line breaks included; `header` marks the first one of a file.

    Lines are dealt by chunk, so that no task has a whole split, let alone several; only records of several lines, and
    lines at the ends of chunks, are gathered a second time."""
    lines = raw_lines(spark, path).selectExpr("*", f"{ends_open('line', sep)} AS o", f"shiftright(id, {CHUNK_BITS}) AS chunk")
    # starting inside quotes is like starting outside with a quote put first
    quoted = "'\"' || line"
    lines = lines.selectExpr("*", f"CASE WHEN contains(line, '\"') THEN {ends_open(quoted, sep)} ELSE true END AS i")
    by = ["file", "split", "chunk"]
    lines = _composed(lines, by, "id", "o", "i")
    lines = lines.selectExpr("*", f"{_state('false', 'const', 'flips')} AS in0", f"{_state('true', 'const', 'flips')} AS in1")
    within = Window.partitionBy(*by).orderBy("id")
    lines = lines.withColumns({
        "rec0": F.sum(F.expr("CAST(NOT in0 AS bigint)")).over(within), "rec1": F.sum(F.expr("CAST(NOT in1 AS bigint)")).over(within),
        "one0": F.expr("NOT in0") & F.coalesce(F.lead(F.expr("NOT in0")).over(within), F.lit(False)),
        "one1": F.expr("NOT in1") & F.coalesce(F.lead(F.expr("NOT in1")).over(within), F.lit(False)),
        "end0": F.expr("CASE WHEN in0 THEN i ELSE o END"), "end1": F.expr("CASE WHEN in1 THEN i ELSE o END")})
    lines = stage(lines.select("line", *by, "id", "rec0", "rec1", "one0", "one1", "end0", "end1"), "lines")
    chunks = stage(_chunk_starts(lines, by), "chunks")
    few = chunks.count() <= BROADCAST_CHUNKS
    lines = lines.join(F.broadcast(chunks) if few else chunks, by)
    lines = lines.selectExpr(
        "line", *by, "id", "last", "CASE WHEN inside THEN rec1 ELSE rec0 END AS number", "CASE WHEN inside THEN one1 ELSE one0 END AS one", "first")
    whole = lines.where("one").selectExpr("line AS record", "first AND number = 1 AS header")
    parts = lines.where("NOT one").selectExpr(
        "line", *by, "id", "CASE WHEN number > 0 THEN struct(split, chunk, number) ELSE last END AS home", "first AND number = 1 AS header")
    gathered = parts.groupBy("file", "home").agg(
        F.array_sort(F.collect_list(F.struct("split", "id", "line"))).alias("lines"), F.bool_or("header").alias("header"))
    joined = gathered.selectExpr("array_join(transform(lines, x -> x.line), '\n') AS record", "header")
    return whole.unionByName(joined).selectExpr("rtrim('\r', record) AS record", "header").where("record <> ''")


def _chunk_starts(lines: DataFrame, by: list[str]) -> DataFrame:
    """(file, split, chunk, inside, last, first): whether each chunk starts inside quotes, the last record that began before it, and
    whether it is its file's first. Chunks are composed over their split, splits over their file; no texts are read."""
    chunks = lines.groupBy(*by).agg(
        F.max_by("end0", "id").alias("end0"), F.max_by("end1", "id").alias("end1"), F.max("rec0").alias("rec0"), F.max("rec1").alias("rec1"))
    chunks = _composed(chunks, ["file", "split"], "chunk", "end0", "end1")
    chunks = chunks.selectExpr(*by, "end0", "end1", "rec0", "rec1", f"{_state('false', 'const', 'flips')} AS in0", f"{_state('true', 'const', 'flips')} AS in1")
    ends = {f"end{k}": F.max_by(F.expr(f"CASE WHEN in{k} THEN end1 ELSE end0 END"), "chunk") for k in (0, 1)}
    # the last record that began in the split, if the split starts outside or inside
    began = {f"last{k}": F.max(F.expr(f"CASE WHEN CASE WHEN in{k} THEN rec1 ELSE rec0 END > 0 THEN struct(split, chunk, CASE WHEN in{k} THEN rec1 ELSE rec0 END AS number) END"))
             for k in (0, 1)}
    splits = chunks.groupBy("file", "split").agg(*[e.alias(n) for n, e in (ends | began).items()])
    splits = _composed(splits, ["file"], "split", "end0", "end1").selectExpr("*", f"{_state('false', 'const', 'flips')} AS split_inside")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("split_last", F.last(F.expr("CASE WHEN split_inside THEN last1 ELSE last0 END"), ignorenulls=True).over(before))
    chunks = chunks.join(splits.select("file", "split", "split_inside", "split_last"), ["file", "split"])
    chunks = chunks.withColumn("inside", F.expr("CASE WHEN split_inside THEN in1 ELSE in0 END"))
    chunks = chunks.withColumn("held", F.expr("CASE WHEN inside THEN rec1 ELSE rec0 END"))
    of_split = Window.partitionBy("file", "split").orderBy("chunk")
    own = F.last(F.expr("CASE WHEN held > 0 THEN struct(split, chunk, held AS number) END"), ignorenulls=True).over(
        of_split.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumns({"last": F.coalesce(own, "split_last"), "first": (F.col("split") == 0) & (F.row_number().over(of_split) == 1)}).select(
        *by, "inside", "last", "first")
