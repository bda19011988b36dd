"""Inputs of the registered queries: whole tables with deterministic defects.

A source's SQL runs unchanged on Spark and DuckDB; every row of its tables takes part. Defects
follow from the data itself (errors carry no value, views carry a null word, and so on)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from datavitals.functions.normalize import normalize_values
from datavitals.roles import Roles
from suite import duck


@dataclass(frozen=True)
class Source:
    tables: tuple[str, ...]
    sql: str
    columns: tuple[tuple[str, str], ...]     # (name, kind): int, float, str, ts, bool
    normalize: bool = False
    roles: Roles = Roles()

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.sql(self.sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})
        return normalize_values(df) if self.normalize else df

    @property
    def duck(self) -> str:
        sql = self.sql.format(**{t: t for t in self.tables})
        if not self.normalize:
            return sql
        cells = [f'{duck.normalized(f"{chr(34)}{n}{chr(34)}") if k == "str" else chr(34) + n + chr(34)} AS "{n}"' for n, k in self.columns]
        return f"SELECT {', '.join(cells)} FROM ({sql})"

    @property
    def duck_issues(self) -> str:
        r = self.roles
        return duck.issues(self.duck, list(self.columns), r.target, r.timestamp, r.entity_id, r.protected, r.excluded)

    @property
    def duck_metrics(self) -> str:
        return duck.metrics(self.duck, list(self.columns))


def _cols(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((n, k) for n, k in (item.split(":") for item in text.split()))


EVENTS = Source(
    ("events",), "SELECT event_id, ts, user_id, event_type, value, props FROM {events}",
    _cols("event_id:int ts:ts user_id:int event_type:str value:float props:str"),
)
EVENTS_DIRTY = Source(
    ("events",),
    """SELECT event_id, ts AS event_time, user_id,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
         CASE WHEN event_type = 'view' THEN ' N/A ' ELSE concat('  ', event_type, ' ') END AS event_type,
         CASE WHEN event_type = 'signup' THEN 'null' ELSE props END AS props,
         cast(user_id AS string) AS user_text, 'v1' AS source_version
       FROM {events}""",
    _cols("event_id:int event_time:ts user_id:int value:float event_type:str props:str user_text:str source_version:str"),
    normalize=True,
)
EVENTS_ROLES = Source(
    EVENTS_DIRTY.tables, EVENTS_DIRTY.sql, EVENTS_DIRTY.columns, True,
    Roles(target="event_type", timestamp="event_time", entity_id="user_id", protected=("props",), excluded=("event_id",)),
)
EVENTS_SHORT = Source(
    ("events",),
    """SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS props,
         CASE WHEN event_type = 'error' THEN NULL ELSE cast(floor(value / 10) AS double) END AS tens, 'v1' AS source_version
       FROM {events}""",
    _cols("user_id:int event_type:str props:str tens:float source_version:str"),
)
# Numbers that never change, are all missing, miss where a flag says so, or stand far from zero.
LINEITEM_GAPS = Source(
    ("lineitem",),
    """SELECT l_quantity, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN l_discount END AS gappy,
         CASE WHEN l_returnflag <> 'R' THEN l_tax END AS other_gaps, CAST(7.1 AS double) AS same, CAST(NULL AS double) AS nothing,
         CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE CAST(0.5 AS double) END AS partly, 1000000 + l_tax AS far
       FROM {lineitem}""",
    _cols("l_quantity:float l_extendedprice:float gappy:float other_gaps:float same:float nothing:float partly:float far:float"),
)
EVENTS_TEXT_TIME = Source(
    ("events",), "SELECT event_id, cast(ts AS string) AS created_at, user_id FROM {events}",
    _cols("event_id:int created_at:str user_id:int"),
)
LINEITEM = Source(
    ("lineitem",), "SELECT * FROM {lineitem}",
    _cols("l_orderkey:int l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float "
          "l_discount:float l_tax:float l_returnflag:str l_linestatus:str l_shipdate:ts"),
)
LINEITEM_KEY = Source(LINEITEM.tables, LINEITEM.sql, LINEITEM.columns, False, Roles(entity_id="l_orderkey", timestamp="l_linenumber"))
LINEITEM_FLAGS = Source(
    ("lineitem",), "SELECT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}",
    _cols("l_returnflag:str l_linestatus:str l_linenumber:int"),
)
LINEITEM_NAMES = Source(
    ("lineitem",),
    "SELECT l_orderkey, l_tax AS post_rate, l_discount AS after_discount, l_returnflag AS outcome_flag, l_shipdate FROM {lineitem}",
    _cols("l_orderkey:int post_rate:float after_discount:float outcome_flag:str l_shipdate:ts"),
    roles=Roles(target="outcome_flag"),
)
LINEITEM_TARGET = Source(
    ("lineitem",),
    """SELECT l_orderkey, l_quantity, l_extendedprice,
         CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL WHEN l_discount >= 0.1 THEN 1 ELSE 0 END AS deep_discount,
         CASE WHEN l_discount >= 0.1 THEN 'deep' ELSE 'usual' END AS tier
       FROM {lineitem}""",
    _cols("l_orderkey:int l_quantity:float l_extendedprice:float deep_discount:int tier:str"),
    roles=Roles(target="deep_discount"),
)
CUSTOMER = Source(
    ("customer",), "SELECT * FROM {customer}",
    _cols("c_custkey:int c_name:str c_nationkey:int c_acctbal:float c_mktsegment:str"),
)
CUSTOMER_SERIAL = Source(
    ("customer",), "SELECT c_custkey + 100000000 AS serial_no, c_nationkey + 0 AS nation_no, c_acctbal FROM {customer}",
    _cols("serial_no:int nation_no:int c_acctbal:float"),
)
ORDERS = Source(
    ("orders",), "SELECT * FROM {orders}",
    _cols("o_orderkey:int o_custkey:int o_orderstatus:str o_totalprice:float o_orderdate:ts o_orderpriority:str"),
)
PART_TEXT = Source(
    ("part",),
    """SELECT p_partkey, concat(p_name, ' ', p_type, ' ', cast(p_size AS string)) AS description, p_brand,
         cast(p_size AS string) AS size_text, p_retailprice FROM {part}""",
    _cols("p_partkey:int description:str p_brand:str size_text:str p_retailprice:float"),
)
DOCUMENTS = Source(
    ("documents",), "SELECT * FROM {documents}",
    _cols("doc_id:int text:str lang:str source:str n_chars:int"),
)
CONVERSATIONS = Source(
    ("conversations",), "SELECT * FROM {conversations}", _cols("conv_id:int turn:int role:str text:str"),
)
PAGES = Source(("pages",), "SELECT * FROM {pages}", _cols("page_id:int url:str html:str"))
BENCHMARK = Source(("benchmark",), "SELECT * FROM {benchmark}", _cols("item_id:int text:str"))
LABELS = Source(("labels",), "SELECT * FROM {labels}", _cols("doc_id:int quality:int toxic:int"), roles=Roles(target="toxic", entity_id="doc_id"))
LABELS_RARE = Source(
    ("labels",),
    """SELECT doc_id, quality, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN toxic = 1 AND quality = 1 AND doc_id % 2 = 0 THEN 1 ELSE 0 END AS toxic
       FROM {labels}""",
    LABELS.columns, roles=Roles(target="toxic"),
)
NATION = Source(("nation",), "SELECT * FROM {nation}", _cols("n_nationkey:int n_name:str n_regionkey:int"), roles=Roles(entity_id="n_nationkey"))
SUPPLIER = Source(("supplier",), "SELECT * FROM {supplier}", _cols("s_suppkey:int s_name:str s_nationkey:int s_acctbal:float"))
REGION = Source(("region",), "SELECT * FROM {region}", _cols("r_regionkey:int r_name:str"))

# Pairs of sides for drift; the two sides of a pair cover their table.
EVENTS_BEFORE = Source(
    ("events",),
    "SELECT event_id, ts, user_id, event_type, value, props, user_id AS code FROM {events} WHERE ts < cast('2024-01-16' AS date)",
    _cols("event_id:int ts:ts user_id:int event_type:str value:float props:str code:int"),
)
EVENTS_AFTER = Source(
    ("events",),
    """SELECT ts, user_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type,
         CASE WHEN event_type = 'view' THEN NULL ELSE value * 1.5 END AS value,
         concat(props, cast(event_id AS string)) AS props, cast(user_id AS double) AS code, 'b2' AS batch
       FROM {events} WHERE ts >= cast('2024-01-16' AS date) OR ts IS NULL""",
    _cols("ts:ts user_id:int event_type:str value:float props:str code:float batch:str"),
)
_ITEM = """SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
             CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_a, l_returnflag, l_linestatus
           FROM {lineitem} WHERE l_shipdate """
_ITEM_COLS = _cols("l_orderkey:int l_shipdate:ts l_partkey:int l_suppkey:int l_linenumber:int l_quantity:float l_extendedprice:float l_discount:float "
                   "l_tax:float is_a:int l_returnflag:str l_linestatus:str")
ITEMS_BEFORE = Source(("lineitem",), _ITEM + "< cast('1998-06-01' AS date)", _ITEM_COLS)
ITEMS_AFTER = Source(("lineitem",), _ITEM + ">= cast('1998-06-01' AS date) OR l_shipdate IS NULL", _ITEM_COLS)
_DOC_COLS = _cols("doc_id:int text:str source:str n_chars:int lang:str")
DOCS_EN = Source(("documents",), "SELECT doc_id, text, source, n_chars, lang FROM {documents} WHERE lang = 'en'", _DOC_COLS)
DOCS_OTHER = Source(("documents",), "SELECT doc_id, text, source, n_chars, lang FROM {documents} WHERE lang IS DISTINCT FROM 'en'", _DOC_COLS)

# Inputs of single fixes and of the run history.
PART_COMMA = Source(
    ("part",),
    """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_brand ELSE concat(' 1,', lpad(cast(p_size AS string), 3, '0'), ' ') END AS size_text,
         p_name FROM {part}""",
    _cols("p_partkey:int size_text:str p_name:str"),
)
ORDER_RUNS = Source(
    ("orders",),
    """SELECT concat(o_orderstatus, '-', cast(cast(date_trunc('month', o_orderdate) AS date) AS string)) AS run_id, o_orderstatus AS dataset_name,
         cast(cast(date_trunc('month', o_orderdate) AS date) AS string) AS timestamp, count(*) AS row_count,
         cast(count(DISTINCT o_orderpriority) AS bigint) AS column_count,
         cast(100 - floor(100.0 * count(CASE WHEN o_totalprice > 400000 THEN 1 END) / count(*)) AS int) AS health_score,
         count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS issue_count, count(CASE WHEN o_totalprice > 400000 THEN 1 END) AS critical_count,
         count(CASE WHEN o_totalprice > 200000 AND o_totalprice <= 400000 THEN 1 END) AS warning_count,
         count(CASE WHEN o_totalprice > 100000 AND o_totalprice <= 200000 THEN 1 END) AS minor_count,
         concat('fp-', o_orderstatus) AS schema_fingerprint
       FROM {orders} GROUP BY o_orderstatus, date_trunc('month', o_orderdate)""",
    _cols("run_id:str dataset_name:str timestamp:str row_count:int column_count:int health_score:int issue_count:int critical_count:int "
          "warning_count:int minor_count:int schema_fingerprint:str"),
)
MONITOR_FILES = Source(
    ("orders",),
    """SELECT concat('/data/in/', CASE o_orderstatus WHEN 'O' THEN 'production_' WHEN 'F' THEN 'baseline_' ELSE 'new_broken_' END,
         lower(o_orderpriority), '.v1.csv') AS path FROM {orders}""",
    _cols("path:str"),
)
# Two sides whose names differ in case, blanks and repeats; names are given when the frame is built.
ITEM_NAMES = ((" Income", "income ", "A.B", "INCOME"), ("income", "Income", "a.b ", "income"))
ITEM_SIDES = tuple(
    Source(("lineitem",), f"SELECT l_quantity AS n0, l_extendedprice AS n1, l_discount AS n2, l_tax{more} AS n3 FROM {{lineitem}} WHERE l_linestatus {sign} 'O'",
           _cols("n0:float n1:float n2:float n3:float"))
    for sign, more in (("=", ""), ("<>", " * 2")))
