"""Registered source / sink / profile-assembly / streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import readers as RD
from ..sources import sinks as SK
from .fixtures import load, view, with_views
from .profile_plan import column_stats, findings, profile
from .registry import register


def scratch(spark) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{uuid.uuid4().hex}"


@register("csv_roundtrip", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
 strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') as o_orderdate, o_orderpriority from orders""")
def q_csv_roundtrip(spark, sf):
    path = scratch(spark) + "/orders_csv"
    SK.write_csv(load(spark, sf, "orders"), path)  # a time comes back as text
    return RD.read_table(spark, path, "csv")


@register("json_roundtrip", "select p_partkey, p_name, p_brand, p_type, cast(p_size as bigint) as p_size, p_retailprice from part")
def q_json_roundtrip(spark, sf):
    path = scratch(spark) + "/part_json"
    load(spark, sf, "part").write.mode("overwrite").json(path)
    return RD.read_table(spark, path, "jsonl").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("infer_types", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, c_mktsegment from customer")
def q_infer_types(spark, sf):
    df = load(spark, sf, "customer")
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    return RD.infer_types(text)


@register("ingest_summary", "select count(*) as row_count, cast(5 as bigint) as column_count from customer")
def q_ingest_summary(spark, sf):
    df = load(spark, sf, "customer")
    RD.validate_ingest(df)
    return RD.ingest_summary(df)


@register("preview", with_views("scored") + "select * from scored order by doc_id limit 100")
def q_preview(spark, sf):
    return SK.preview(view(spark, sf, "scored"), ["doc_id"], 100)


@register("column_stats", with_views("orders_dirty") + """, n as (select count(*) as n from orders_dirty),
u as (select 'o_orderkey' as column_name, cast(o_orderkey as double) as v from orders_dirty union all select 'price', price from orders_dirty),
s as (select column_name, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max,
  round(quantile_cont(v, 0.25), 6) as p25, round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.75), 6) as p75,
  round(case when count(v) < 3 then null when stddev_pop(v) = 0 then 0 else skewness(v) end, 6) as skewness,
  round(case when count(v) < 4 then null when stddev_pop(v) = 0 then 0 else kurtosis(v) end, 6) as kurtosis from u where v is not null group by column_name),
c as (select 'o_orderkey' as column_name, 1 as ordinal_position, 'bigint' as dtype, true as is_numeric, false as is_categorical,
        count(*) - count(o_orderkey) as mc, 0 as uc from orders_dirty
  union all select 'price', 2, 'double', true, false, count(*) - count(price), 0 from orders_dirty
  union all select 'priority', 3, 'string', false, true, count(*) - count(priority), count(distinct priority) from orders_dirty
  union all select 'status', 4, 'string', false, true, count(*) - count(status), count(distinct status) from orders_dirty
  union all select 'odate', 5, 'timestamp_ntz', false, false, count(*) - count(odate), 0 from orders_dirty)
select c.column_name, cast(ordinal_position as integer) as ordinal_position, dtype, is_numeric, is_categorical,
 cast(mc as bigint) as missing_count, case when mc > 0 then round(mc / n, 4) else 0.0 end as missing_ratio, cast(uc as bigint) as unique_count,
 mean, std, min, max, p25, p50, p75, skewness, kurtosis from c cross join n left join s on s.column_name = c.column_name""")
def q_column_stats(spark, sf):
    return column_stats(view(spark, sf, "orders_dirty"))


@register("findings")
def q_findings(spark, sf):
    return profile(load(spark, sf, "events"), ["event_id"])["findings"]


@register("report")
def q_report(spark, sf):
    df = view(spark, sf, "orders_dirty")
    from ..operators import profile as P
    return SK.report_frame({"shape": P.shape(df), "missingness": P.missingness(df), "snapshot": P.snapshot(df)})


@register("stream_predict")
def q_stream_predict(spark, sf):
    from ..operators.score import Bundle
    from ..operators import train as TR
    from ..streaming.scoring import stream_predict
    from .q_prepare import _doc_prep

    p = _doc_prep(spark, sf)
    feats = p.model.feature_names()
    m = TR.fit("logistic_regression", p.train, feats, "classification")
    base = scratch(spark)
    src = base + "/incoming"
    view(spark, sf, "doc_labels").write.mode("overwrite").parquet(src)
    q = stream_predict(spark, src, Bundle(p.model, m, feats, "quality"), base + "/scored", base + "/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(base + "/scored")
