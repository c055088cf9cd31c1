"""Registered preparation queries (P1-P36, M11, M15/M16) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FeatureSelectionConfig, PipelineConfig, SplitConfig
from ..operators import prepare as PR
from ..operators import score as SC
from ..operators import split as SP
from .fixtures import load, view, with_views
from .prepare import prepare
from .q_clean import _round_doubles
from .registry import register

LINE4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _ptype_row(table, c, kind):
    if kind == "text":
        return (f"select '{c}' as column_name, count(distinct {c}) as k, false as ai, 'text' as kind from {table}")
    if kind == "int":
        return f"select '{c}', count(distinct {c}), true, 'num' from {table}"
    return f"select '{c}', count(distinct {c}), coalesce(bool_and({c} = floor({c})), true), 'num' from {table}"


@register("problem_type", "with u as (" + " union all ".join([
    _ptype_row("orders", "o_orderstatus", "text"), _ptype_row("orders", "o_totalprice", "double"),
    _ptype_row("orders", "o_custkey", "int"), _ptype_row("orders", "o_orderpriority", "text")]) + """)
select column_name, cast(k as bigint) as unique_count, ai as all_integer,
 case when k < 2 then 'invalid' when kind = 'text' then 'classification'
      when k <= 20 and ai then 'classification' else 'regression' end as problem_type from u""")
def q_problem_type(spark, sf):
    return PR.problem_type_table(load(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority"])


@register("class_balance", """select cast(quality as varchar) as label, count(*) as count,
 round(count(*) / (select count(*) from labels), 4) as percent from labels where quality is not null group by quality""")
def q_class_balance(spark, sf):
    return PR.class_balance(load(spark, sf, "labels"), "quality")[0]


@register("class_balance_summary", """with c as (select cast(quality as varchar) as label, count(*) as c from labels where quality is not null group by 1),
n as (select count(*) as n from labels)
select (select label from c order by c desc, label limit 1) as majority_class,
 (select label from c order by c asc, label desc limit 1) as minority_class,
 round(max(c) / max(n), 4) as majority_pct, round(min(c) / max(n), 4) as minority_pct,
 coalesce(round((max(c) / max(n)) / (min(c) / max(n)), 4), 999.0) as imbalance_ratio,
 (max(c) / max(n)) / (min(c) / max(n)) > 2.0 as is_imbalanced, cast(count(*) as bigint) as class_count from c cross join n""")
def q_class_balance_summary(spark, sf):
    return PR.class_balance(load(spark, sf, "labels"), "quality")[1]


_TSP = ("coalesce(try_strptime(odate, '%Y-%m-%d %H:%M:%S'), try_strptime(odate, '%Y-%m-%d'), try_strptime(odate, '%Y-%m-%dT%H:%M:%S'), "
        "try_strptime(odate, '%Y/%m/%d'), try_strptime(odate, '%m/%d/%Y'), try_strptime(odate, '%d-%m-%Y'))")


@register("datetime_columns", with_views("text_dates") + f""", f as (select odate from text_dates where odate is not null),
p as (select count(*) as n, count({_TSP}) as ok from f)
select 'odate' as column_name, case when n > 0 and n = ok then 'parses as datetime' else 'name hint' end as reason from p""")
def q_datetime_columns(spark, sf):
    return PR.datetime_columns(view(spark, sf, "text_dates"), ["o_orderkey"])


@register("impute", with_views("orders_dirty") + """, m as (select quantile_cont(o_orderkey, 0.5) as mk, quantile_cont(price, 0.5) as mp from orders_dirty),
mo as (select priority as v from (select priority, count(*) as c from orders_dirty where priority is not null group by priority) t order by c desc, priority limit 1),
ms as (select status as v from (select status, count(*) as c from orders_dirty where status is not null group by status) t order by c desc, status limit 1)
select o_orderkey, round(coalesce(price, mp), 6) as price, coalesce(priority, mo.v) as priority, coalesce(status, ms.v) as status, odate
from orders_dirty cross join m cross join mo cross join ms""")
def q_impute(spark, sf):
    df = view(spark, sf, "orders_dirty")
    values = PR.fit_imputer(df, "median", "all")
    return _round_doubles(PR.apply_imputer(df, values))


@register("one_hot", "select p_partkey, " + ", ".join(
    f"case when p_type = '{v}' then cast(1.0 as double) else cast(0.0 as double) end as p_type_{v}"
    for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " from part")
def q_one_hot(spark, sf):
    df = load(spark, sf, "part")
    levels = PR.fit_one_hot(df, ["p_type"])
    return df.select("p_partkey", *PR.one_hot_columns(levels))


@register("target_mean", with_views("doc_labels") + """, m as (select source, avg(quality) as e from doc_labels where source is not null group by source),
g as (select avg(quality) as g from doc_labels)
select d.doc_id, round(coalesce(m.e, g.g), 6) as source from doc_labels d left join m on d.source = m.source cross join g""")
def q_target_mean(spark, sf):
    df = view(spark, sf, "doc_labels")
    coded = PR.encode_label(df, "quality", PR.label_dictionary(df, "quality"), "__y")
    m, g, rows = PR.fit_target_mean(coded, "source", F.col("__y"))
    out = PR.apply_map(df, "source", m, rows, "__e", g)
    return out.select("doc_id", F.round("__e", 6).alias("source"))


@register("frequency", """with m as (select p_brand, count(*) as c from part where p_brand is not null group by p_brand)
select p.p_partkey, cast(coalesce(m.c, 0) as double) as __freq_enc_p_brand from part p left join m on p.p_brand = m.p_brand""")
def q_frequency(spark, sf):
    df = load(spark, sf, "part")
    m, rows = PR.fit_frequency(df, "p_brand")
    return PR.apply_map(df, "p_brand", m, rows, "__freq_enc_p_brand", 0.0).select("p_partkey", "__freq_enc_p_brand")


@register("label_index", """select label, cast(row_number() over (order by label) - 1 as integer) as index
from (select distinct o_orderpriority as label from orders where o_orderpriority is not null) t""")
def q_label_index(spark, sf):
    return PR.label_index(load(spark, sf, "orders"), "o_orderpriority")


@register("label_index_many", """select o_orderkey, cast(dense_rank() over (order by 'order ' || cast(o_orderkey as varchar)) - 1 as double)
 as code, 'order ' || cast(o_orderkey as varchar) as decoded from orders""")
def q_label_index_many(spark, sf):
    """As many classes as orders: numbered, encoded and decoded by joins."""
    df = load(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("y"))
    labels = PR.label_dictionary(df, "y")
    coded = PR.encode_label(df, "y", labels, "code").select("o_orderkey", "code", F.col("code").alias("decoded"))
    return SC.decode_labels(coded, "decoded", labels)


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        exprs = [f"round((cast({c} as double) - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) as {c}" for c in LINE4]
    elif kind == "minmax":
        exprs = [f"round((cast({c} as double) - min({c}) over ()) / coalesce(nullif(max({c}) over () - min({c}) over (), 0), 1), 6) as {c}" for c in LINE4]
    else:
        exprs = [f"round((cast({c} as double) - q.m_{c}) / coalesce(nullif(q.h_{c} - q.l_{c}, 0), 1), 6) as {c}" for c in LINE4]
    src = "lineitem"
    if kind == "robust":
        qs = ", ".join(f"quantile_cont({c}, 0.5) as m_{c}, quantile_cont({c}, 0.25) as l_{c}, quantile_cont({c}, 0.75) as h_{c}" for c in LINE4)
        src = f"lineitem cross join (select {qs} from lineitem) q"
    return f"select l_orderkey, l_linenumber, {', '.join(exprs)} from {src}"


def _scale_query(kind):
    def fn(spark, sf):
        df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE4)
        return _round_doubles(PR.scale(df, LINE4, kind))
    return fn


for _k in ("standard", "minmax", "robust"):
    register(f"scale_{_k}", _scale_sql(_k))(_scale_query(_k))


@register("scale_auto", """with q as (select quantile_cont(n_chars, 0.25) as q1, quantile_cont(n_chars, 0.5) as med, quantile_cont(n_chars, 0.75) as q3,
  avg(n_chars) as mu, stddev_pop(n_chars) as sd, count(*) as n from documents),
o as (select count(*) as c from documents cross join q where n_chars < q1 - 1.5 * (q3 - q1) or n_chars > q3 + 1.5 * (q3 - q1)),
robust as (select c > 0 and round(c / n, 4) > 0.05 as r from o cross join q)
select doc_id, round(case when (select r from robust) then (n_chars - med) / coalesce(nullif(q3 - q1, 0), 1)
 else (n_chars - mu) / coalesce(nullif(sd, 0), 1) end, 6) as n_chars from documents cross join q""")
def q_scale_auto(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "n_chars")
    return _round_doubles(PR.scale(df, ["n_chars"], "auto"))


_CP = ["l_orderkey", "l_linenumber", "a", "b", "k", "t"]


def _lowvar_sql():
    parts = [f"select '{c}' as column_name, count({c}) as n, var_samp({c}) as v, max({c}) - min({c}) as r from corr_pair" for c in _CP]
    return with_views("corr_pair") + ", s as (" + " union all ".join(parts) + """)
select column_name, round(v, 6) as variance, printf('variance=%.6f below threshold=0.01', v) as reason from s
where n >= 2 and (v < 0.01 or r < 1e-8)"""


@register("low_variance", _lowvar_sql())
def q_low_variance(spark, sf):
    return PR.low_variance(view(spark, sf, "corr_pair"), 0.01)


def _corrdrop_sql(threshold=0.95):
    pairs = []
    for i, a in enumerate(_CP):
        for b in _CP[i + 1:]:
            pairs.append(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, var_samp({a}) as va, var_samp({b}) as vb from corr_pair")
    return with_views("corr_pair") + ", p as (" + " union all ".join(pairs) + f""")
select distinct case when coalesce(va, 0) <= coalesce(vb, 0) then a else b end as column_name,
 'high correlation (|r|>{threshold}) with another feature' as reason from p where not isnan(r) and abs(r) > {threshold}"""


@register("drop_correlated", _corrdrop_sql())
def q_drop_correlated(spark, sf):
    return PR.correlated_drops(view(spark, sf, "corr_pair"), 0.95)


@register("select_features", _lowvar_sql().replace("\nselect column_name, round(v, 6) as variance, printf(", ", lv as (select column_name, printf(", 1)
          .replace("where n >= 2 and (v < 0.01 or r < 1e-8)", "where n >= 2 and (v < 0.01 or r < 1e-8))", 1)
          + ", hc as (" + _corrdrop_sql().split("\nselect distinct", 1)[0].split(", p as (", 1)[1].rsplit(")", 1)[0] + ")"
          + """, hc2 as (select distinct case when coalesce(va, 0) <= coalesce(vb, 0) then a else b end as column_name,
 'high correlation (|r|>0.95) with another feature' as reason from hc where not isnan(r) and abs(r) > 0.95)
select 'near_zero_variance' as kind, column_name, reason from lv union all select 'high_correlation', column_name, reason from hc2""")
def q_select_features(spark, sf):
    return PR.select_features(view(spark, sf, "corr_pair"))[0]


@register("quick_matrix", """select o_orderkey, o_custkey, o_totalprice,
 coalesce(cast(dense_rank() over (order by o_orderpriority) - 1 as bigint) + case when o_orderpriority is null then null else 0 end, -1) as o_orderpriority
from orders""")
def q_quick_matrix(spark, sf):
    return PR.quick_matrix(load(spark, sf, "orders"))


def _label(train, test):
    return train.select("o_orderkey", F.lit("train").alias("split")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("split")))


@register("split_random", """select o_orderkey, case when row_number() over (order by md5(cast(o_orderkey as varchar) || ':42'))
 <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from orders""")
def q_split_random(spark, sf):
    return _label(*SP.split(load(spark, sf, "orders"), 0.2, 42, ["o_orderkey"]))


@register("split_stratified", """with o as (select o_orderkey, o_orderstatus as s from orders),
n as (select count(*) as n, cast(ceil(0.2 * count(*)) as bigint) as nt from o),
c as (select s, count(*) as c from o group by s),
q as (select s, (nt * c) // n as base, (nt * c) % n as rem from c cross join n),
r as (select *, row_number() over (order by rem desc, s) as rk from q),
lft as (select max(nt) - sum(base) as l from q cross join n),
quota as (select s, base + case when rk <= (select l from lft) then 1 else 0 end as quota from r)
select o_orderkey, case when row_number() over (partition by o.s order by md5(cast(o_orderkey as varchar) || ':42')) <= quota
 then 'test' else 'train' end as split from o join quota on o.s = quota.s""")
def q_split_stratified(spark, sf):
    return _label(*SP.split(load(spark, sf, "orders"), 0.2, 42, ["o_orderkey"], "o_orderstatus"))


@register("split_stratified_many", """with o as (select l_orderkey, l_linenumber, l_partkey, l_orderkey as s, cast(l_orderkey as varchar) || '|' ||
  cast(l_partkey as varchar) || '|' || cast(l_suppkey as varchar) || '|' || cast(l_linenumber as varchar) as k from lineitem),
n as (select count(*) as n, cast(ceil(0.2 * count(*)) as bigint) as nt from o),
c as (select s, count(*) as c from o group by s),
q as (select s, (nt * c) // n as base, (nt * c) % n as rem from c cross join n),
r as (select *, row_number() over (order by rem desc, cast(s as varchar)) as rk from q),
lft as (select max(nt) - sum(base) as l from q cross join n),
quota as (select s, base + case when rk <= (select l from lft) then 1 else 0 end as quota from r),
m as (select o.s, row_number() over (partition by o.s order by md5(k || ':42')) <= quota as test from o join quota on o.s = quota.s)
select s as l_orderkey, count(*) as n_rows, count(*) filter (test) as n_test from m group by s""")
def q_split_stratified_many(spark, sf):
    """As many classes as orders: one grouped cut-off for all."""
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    train, test = SP.split(df, 0.2, 42, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "l_orderkey")
    both = train.withColumn("t", F.lit(0)).unionByName(test.withColumn("t", F.lit(1)))
    return both.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("t").alias("n_test"))


@register("split_chronological_text_key", """select k, case when row_number() over (order by o_orderdate, k)
 <= floor(count(*) over () * (1 - 0.2)) then 'train' else 'test' end as split
from (select cast(o_orderkey as varchar) || 'x' as k, o_orderdate from orders) t""")
def q_split_chronological_text_key(spark, sf):
    df = load(spark, sf, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("x")).alias("k"), "o_orderdate")
    train, test = SP.split_chronological(df, "o_orderdate", 0.2, "k")
    return train.select("k", F.lit("train").alias("split")).unionByName(test.select("k", F.lit("test").alias("split")))


@register("split_chronological", with_views("text_dates") + f"""select o_orderkey, case when row_number() over (order by {_TSP} asc nulls last, o_orderkey)
 <= floor(count(*) over () * (1 - 0.2)) then 'train' else 'test' end as split from text_dates""")
def q_split_chronological(spark, sf):
    return _label(*SP.split_chronological(view(spark, sf, "text_dates"), "odate", 0.2, "o_orderkey"))


@register("split_all_train", "select o_orderkey, 'train' as split from orders")
def q_split_all_train(spark, sf):
    return _label(*SP.split(load(spark, sf, "orders"), 0.0, 42, ["o_orderkey"]))


@register("smote_counts", with_views("doc_labels") + """, c as (select quality, count(*) as c from doc_labels group by quality)
select quality, cast((select max(c) from c) as bigint) as count from c""")
def q_smote_counts(spark, sf):
    df = view(spark, sf, "doc_labels")
    out = SP.smote(df, "quality", ["n_chars", "toxic"], "doc_id", k=5, seed=42)
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("count"))


@register("class_weights", """with c as (select cast(quality as varchar) as label, count(*) as c from labels where quality is not null group by 1)
select label, round((select sum(c) from c) / ((select count(*) from c) * c), 6) as weight from c""")
def q_class_weights(spark, sf):
    return SP.class_weights(load(spark, sf, "labels"), "quality")


@register("kfold", with_views("doc_labels") + """select doc_id, cast((row_number() over (partition by quality order by md5(cast(doc_id as varchar) || ':42')) - 1) % 5 as integer) as fold from doc_labels""")
def q_kfold(spark, sf):
    return SP.assign_folds(view(spark, sf, "doc_labels"), 5, ["doc_id"], 42, "quality").select("doc_id", "fold")


def _doc_prep(spark, sf):
    cfg = PipelineConfig(target_column="quality", key_columns=("doc_id",),
                         feature_selection=FeatureSelectionConfig(enabled=True, drop_near_zero_variance=True))
    return prepare(view(spark, sf, "doc_labels"), cfg)


@register("prepare")
def q_prepare(spark, sf):
    return _doc_prep(spark, sf).train


@register("column_mapping")
def q_column_mapping(spark, sf):
    return _doc_prep(spark, sf).column_mapping


@register("prep_summary")
def q_prep_summary(spark, sf):
    return _doc_prep(spark, sf).summary


@register("transform_new")
def q_transform_new(spark, sf):
    p = _doc_prep(spark, sf)
    new = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.lit(0).alias("toxic"))
    return p.model.transform(new, keep=["doc_id"])


@register("describe_target", """with c as (select quality, count(*) as c from labels where quality is not null group by quality),
n as (select count(*) as n from labels)
select 'quality' as target_column, case when count(*) < 2 then 'invalid' when count(*) <= 20 then 'classification' else 'regression' end as problem_type,
 cast(count(*) as bigint) as unique_values, 'int' as dtype, (max(c) / max(n)) / (min(c) / max(n)) > 2.0 as is_imbalanced,
 round((max(c) / max(n)) / (min(c) / max(n)), 4) as imbalance_ratio, '' as datetime_columns from c cross join n""")
def q_describe_target(spark, sf):
    return PR.describe_target(load(spark, sf, "labels"), "quality", ["doc_id"])


@register("suggest_encodings", """with c as (select 'p_name' as column_name, count(distinct p_name) as cardinality from part
 union all select 'p_brand', count(distinct p_brand) from part union all select 'p_type', count(distinct p_type) from part)
select column_name, cardinality, case when cardinality <= 10 then 'one_hot' else 'target' end as binary_class,
 case when cardinality <= 50 then 'one_hot' else 'target' end as classes,
 case when cardinality <= 50 then 'one_hot' else 'frequency' end as number from c""")
def q_suggest_encodings(spark, sf):
    from ..functions.cardinality import distinct_counts

    card = distinct_counts(load(spark, sf, "part"), ["p_name", "p_brand", "p_type"])
    kinds = (("classification", 2), ("classification", 5), ("regression", 0))
    return spark.createDataFrame([(c, n, *[PR.suggest_encoding(n, *k) for k in kinds]) for c, n in card.items()],
                                 "column_name string, cardinality bigint, binary_class string, classes string, number string")


@register("suggest_pipeline", """select 'quality' as column_name, cast(count(distinct quality) as bigint) as cardinality,
 'target' as suggested_role, null as suggested_encoding from labels
union all select 'toxic', count(distinct toxic), 'target', null from labels
union all select 'doc_id', count(distinct doc_id), 'feature', null from labels""")
def q_suggest_pipeline(spark, sf):
    return PR.suggest_pipeline(load(spark, sf, "labels")).select("column_name", "cardinality", "suggested_role",
                                                                 "suggested_encoding")


@register("splits_roundtrip", """select o_orderkey, case when row_number() over (order by md5(cast(o_orderkey as varchar) || ':42'))
 <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split, cast(1 as bigint) as in_csv from orders""")
def q_splits_roundtrip(spark, sf):
    """Splits written as Parquet, read back, exported to CSV."""
    from types import SimpleNamespace

    from ..sources.sinks import export_splits
    from .prepare import read_splits, write_splits
    from .q_io import scratch

    path = scratch(spark)
    train, test = SP.split(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 0.2, 42, ["o_orderkey"])
    write_splits(SimpleNamespace(train=train, test=test), f"{path}/splits")
    both = _label(*read_splits(spark, f"{path}/splits", "o_orderstatus"))
    export_splits(spark, f"{path}/splits", f"{path}/csv")
    csv = [spark.read.csv(f"{path}/csv/{n}_preprocessed", header=True, schema="o_orderkey long, o_orderstatus string")
           .select("o_orderkey", F.lit(n).alias("split")) for n in ("train", "test")]
    seen = csv[0].unionByName(csv[1]).groupBy("o_orderkey", "split").agg(F.count(F.lit(1)).alias("in_csv"))
    return both.join(seen, ["o_orderkey", "split"], "left")


@register("target_distribution", """select o_orderstatus as value, count(*) as count from orders where o_orderstatus is not null group by 1""")
def q_target_distribution(spark, sf):
    from ..operators.profile import class_distribution

    return class_distribution(load(spark, sf, "orders"), "o_orderstatus")


@register("scan_parquet", "select event_id, user_id, event_type, value from events")
def q_scan_parquet(spark, sf):
    from ..sources.readers import read_table

    return read_table(spark, f"{sf.rstrip('/')}/events.parquet").select("event_id", "user_id", "event_type", "value")
