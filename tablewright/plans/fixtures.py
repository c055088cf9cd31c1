"""Derived 'dirty' views over the driver tables.

Each view is one SQL text with ``{table}`` placeholders.  Spark runs it via
``spark.sql(text, table=DataFrame)`` (no global temp views); the DuckDB oracle
runs the same text with plain table names as a CTE, so both engines read the
very same derived rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "orders_dirty": """
select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end as price,
 case when o_orderkey % 11 = 0 then null else o_orderpriority end as priority, o_orderstatus as status, o_orderdate as odate from {orders}
 union all
 select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice end,
 case when o_orderkey % 11 = 0 then null else o_orderpriority end, o_orderstatus, o_orderdate from {orders} where o_orderkey % 50 = 0""",
    "corr_pair": """
select l_orderkey, l_linenumber, l_quantity as a, l_quantity * 2 + l_linenumber as b, cast(1 as double) as k,
 case when l_linenumber = 3 then null else l_tax end as t from {lineitem}""",
    "constants": """
select o_orderkey, 'x' as c_const, cast(null as string) as c_null,
 case when o_orderkey % 200 = 0 then 'b' else 'a' end as c_near, o_orderstatus as c_ok from {orders}""",
    "text_numbers": """
select p_partkey, case when p_partkey % 10 = 0 then 'n/a' when p_partkey % 2 = 0 then concat('$', cast(p_size as string), ',500.25')
 else concat(cast(p_size as string), ',000') end as amount from {part}""",
    "text_dates": """
select o_orderkey, case when o_orderkey % 9 = 0 then 'unknown' when o_orderkey % 3 = 1 then replace(d, '-', '/')
 when o_orderkey % 3 = 2 then concat(substr(d, 6, 2), '/', substr(d, 9, 2), '/', substr(d, 1, 4)) else d end as odate
 from (select o_orderkey, substr(cast(cast(o_orderdate as date) as string), 1, 10) as d from {orders}) q""",
    "messy_text": """
select p_partkey, case when p_partkey % 40 = 0 then concat(p_brand, 'x') when p_partkey % 3 = 0 then concat('  ', upper(p_brand))
 when p_partkey % 13 = 0 then null else concat(p_brand, ' ') end as brand from {part}""",
    "events_gaps": """
select event_id, user_id, ts, case when event_id % 4 = 0 then null else value end as value from {events}""",
    "part_gaps": """
select p_partkey, cast(p_size as double) as p_size, case when p_partkey % 20 = 0 then null else p_retailprice end as p_retailprice from {part}""",
    "part_holes": """
select p_partkey, case when p_partkey % 13 = 0 then null else cast(p_size as double) end as p_size,
 case when p_partkey % 20 = 0 then null else p_retailprice end as p_retailprice,
 case when p_partkey % 9 = 0 then null else cast(p_partkey % 100 as double) end as code from {part}""",
    "scored": """
select d.doc_id, l.quality as y, case when d.n_chars > 800 then 1 else 0 end as pred,
 round(cast(d.n_chars as double) / (d.n_chars + 1000), 6) as score from {documents} d join {labels} l on d.doc_id = l.doc_id""",
    "scored3": """
select o_orderkey, o_orderstatus as y, cast((o_orderkey * 37) % 1000 as double) / 1000 as p_f,
 cast((o_custkey * 13) % 1000 as double) / 1000 as p_o, cast((o_orderkey + o_custkey) % 1000 as double) / 1000 as p_p from {orders}""",
    "reg_scored": """
select l_orderkey, l_linenumber, l_extendedprice as y, l_quantity * 1500 as pred from {lineitem}""",
    "runs": """
select o_orderkey as id, o_orderkey % 300 as job_id, o_orderkey % 60 as pipeline_id, o_custkey as dataset_id,
 case when o_orderkey % 5 = 0 then null when o_orderkey % 3 = 0 then 'default_user' else concat('s', cast(o_custkey % 4 as string)) end as session_id,
 case o_orderstatus when 'F' then 'completed' when 'O' then 'queued' else 'running' end as status, o_orderdate as created_at,
 case when o_orderkey % 13 = 0 then null else cast((o_orderkey * 37) % 1000 as double) / 1000 end as accuracy, cast(o_orderkey % 101 as double) as progress from {orders}""",
    "doc_labels": """
select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from {documents} d join {labels} l on d.doc_id = l.doc_id""",
}


def _tables_in(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table as a DataFrame (Parquet scan: pushdown + pruning)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Derived view ``name`` as a lazy DataFrame."""
    text = VIEWS[name]
    frames = {t: load(spark, sf_dir, t) for t in _tables_in(text)}
    return spark.sql(text, **frames)


def view_sql(name: str) -> str:
    """The same view for DuckDB (plain table names)."""
    text = VIEWS[name]
    return text.format(**{t: t for t in TABLES})


def with_views(*names: str) -> str:
    """``WITH`` prefix defining the named derived views for an oracle query."""
    return "with " + ",\n".join(f"{n} as ({view_sql(n)})" for n in names) + "\n"
