"""Registered profiling queries (E*) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .fixtures import load, view, with_views
from .registry import register, unpivot_sql

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
DIRTY_COLS = ["o_orderkey", "price", "priority", "status", "odate"]
CORR_COLS = ["l_orderkey", "l_linenumber", "a", "b", "k", "t"]
PART_TEXT = ["p_name", "p_brand", "p_type"]


def _summary_sql(source: str, cols: list[str], prefix: str = "") -> str:
    return f"""{prefix}, u as ({unpivot_sql(source, cols)})
select column_name, count(v) as count, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as median,
 round(stddev_samp(v), 6) as std, round(min(v), 6) as min, round(max(v), 6) as max,
 round(quantile_cont(v, 0.25), 6) as q1, round(quantile_cont(v, 0.75), 6) as q3,
 round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) as iqr,
 round(case when count(v) < 3 then null when stddev_pop(v) = 0 then 0 else skewness(v) end, 6) as skewness,
 round(case when count(v) < 4 then null when stddev_pop(v) = 0 then 0 else kurtosis(v) end, 6) as kurtosis
from u where v is not null group by column_name having count(v) > 0"""


def _outliers_sql(source: str, cols: list[str], prefix: str = "with x as (select 1)") -> str:
    return f"""{prefix}, u as ({unpivot_sql(source, cols)}),
n as (select count(*) as n from {source}),
q as (select column_name, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med, quantile_cont(v, 0.75) as q3,
      min(v) as mn, max(v) as mx from u where v is not null group by column_name),
f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
select f.column_name, cast(count(case when u.v < f.lo or u.v > f.hi then 1 end) as bigint) as count,
 round(count(case when u.v < f.lo or u.v > f.hi then 1 end) / max(n.n), 4) as percent,
 round(f.lo, 6) as lower_bound, round(f.hi, 6) as upper_bound, round(f.mn, 6) as min, round(f.q1, 6) as q1,
 round(f.med, 6) as median, round(f.q3, 6) as q3, round(f.mx, 6) as max
from f join u on u.column_name = f.column_name cross join n
group by f.column_name, f.lo, f.hi, f.mn, f.q1, f.med, f.q3, f.mx"""


def _corr_sql(source: str, cols: list[str], prefix: str, high: bool = False) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                if high:
                    continue
                r = f"case when coalesce(stddev_pop(cast({a} as double)), 0) > 0 then 1.0 else 0.0 end"
            else:
                if high and j <= i:
                    continue
                r = (f"coalesce(case when isnan(corr(cast({a} as double), cast({b} as double))) then 0.0 "
                     f"else corr(cast({a} as double), cast({b} as double)) end, 0.0)")
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, {r} as r from {source}")
    body = "\nunion all ".join(parts)
    if high:
        return f"{prefix}, m as ({body}) select col_a, col_b, round(r, 4) as value from m where abs(r) > 0.85"
    return f"{prefix}, m as ({body}) select col_a, col_b, round(r, 6) as r from m"


@register("shape", "select count(*) as rows, cast(6 as bigint) as columns from orders")
def q_shape(spark, sf):
    return P.shape(load(spark, sf, "orders"))


@register("size_profile", """
with s as (select cast(count(o_orderkey) * 8 + count(o_custkey) * 8 + coalesce(sum(strlen(o_orderstatus)), 0)
  + count(o_totalprice) * 8 + count(o_orderdate) * 8 + coalesce(sum(strlen(o_orderpriority)), 0) as bigint) as total_bytes from orders)
select total_bytes, case when total_bytes < 1024 then printf('%.1f', round(total_bytes, 1)) || ' B'
 when total_bytes < 1024 * 1024 then printf('%.1f', round(total_bytes / 1024, 1)) || ' KB'
 when total_bytes < 1024 * 1024 * 1024 then printf('%.1f', round(total_bytes / (1024 * 1024), 1)) || ' MB'
 when total_bytes < 1024 * 1024 * 1024 * 1024 then printf('%.1f', round(total_bytes / (1024 * 1024 * 1024), 1)) || ' GB'
 else printf('%.1f', round(total_bytes / (1024 * 1024 * 1024 * 1024), 1)) || ' TB' end as formatted from s""")
def q_size_profile(spark, sf):
    return P.size_profile(load(spark, sf, "orders"))


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
           ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


@register("columns", "\nunion all ".join(
    f"select '{c}' as column_name, '{t}' as dtype, cast({i} as integer) as ordinal_position, "
    f"cast(count(*) as bigint) as row_count, cast(count({c}) as bigint) as value_count from orders"
    for i, (c, t) in enumerate(_ORDERS, 1)))
def q_columns(spark, sf):
    df = load(spark, sf, "orders")
    return P.columns(df).join(P.value_presence(df), "column_name")


@register("head", "select * from orders order by o_orderkey limit 10")
def q_head(spark, sf):
    return P.head(load(spark, sf, "orders"), ["o_orderkey"], 10)


@register("tail", "select * from (select * from orders order by o_orderkey desc limit 5) t order by o_orderkey")
def q_tail(spark, sf):
    return P.tail(load(spark, sf, "orders"), ["o_orderkey"], 5)


_MISS_U = "\nunion all ".join(
    f"select '{c}' as column_name, count(*) - count({c}) as c from orders_dirty" for c in DIRTY_COLS)


@register("missingness", with_views("orders_dirty") + f""", n as (select count(*) as n from orders_dirty),
u as ({_MISS_U})
select column_name, cast(c as bigint) as count, round(c / n, 4) as percent from u cross join n where c > 0""")
def q_missingness(spark, sf):
    return P.missingness(view(spark, sf, "orders_dirty"))


@register("missingness_matrix", with_views("orders_dirty") + f"""
select cast(row_number() over (order by o_orderkey) as bigint) as row_idx,
 {", ".join(f"cast({c} is null as integer) as {c}" for c in DIRTY_COLS)}
from (select * from orders_dirty order by o_orderkey limit 1000) t""")
def q_missingness_matrix(spark, sf):
    return P.missingness_matrix(view(spark, sf, "orders_dirty"), ["o_orderkey"], 1000)


@register("duplicates", with_views("orders_dirty") + """
select cast(coalesce(sum(c - 1), 0) as bigint) as count, round(coalesce(sum(c - 1), 0) / sum(c), 4) as percent
from (select count(*) as c from orders_dirty group by all) g""".replace("group by all", "group by " + ", ".join(DIRTY_COLS)))
def q_duplicates(spark, sf):
    return P.duplicates(view(spark, sf, "orders_dirty"))


@register("snapshot", with_views("orders_dirty") + f""", d as (
 select cast(coalesce(sum(c - 1), 0) as bigint) as dc, sum(c) as dn from (select count(*) as c from orders_dirty group by {", ".join(DIRTY_COLS)}) g),
m as (select count(*) as row_count, cast({" + ".join(f"(count(*) - count({c}))" for c in DIRTY_COLS)} as bigint) as total_missing from orders_dirty)
select cast(row_count as bigint) as row_count, cast(5 as bigint) as column_count, total_missing,
 round(total_missing / greatest(row_count * 5, 1), 4) as total_missing_pct, dc as duplicate_count,
 round(dc / dn, 4) as duplicate_pct from m cross join d""")
def q_snapshot(spark, sf):
    return P.snapshot(view(spark, sf, "orders_dirty"))


@register("numeric_summary", _summary_sql("lineitem", LINE_NUM, "with x as (select 1)"))
def q_numeric_summary(spark, sf):
    return P.numeric_summary(load(spark, sf, "lineitem"), LINE_NUM)


@register("numeric_summary_events", _summary_sql("events", ["event_id", "user_id", "value"], "with x as (select 1)"))
def q_numeric_summary_events(spark, sf):
    return P.numeric_summary(load(spark, sf, "events"))


@register("outliers", _outliers_sql("events", ["event_id", "user_id", "value"]))
def q_outliers(spark, sf):
    return P.outliers(load(spark, sf, "events"))


@register("outliers_documents", _outliers_sql("documents", ["doc_id", "n_chars"]))
def q_outliers_documents(spark, sf):
    return P.outliers(load(spark, sf, "documents"))


@register("correlation_matrix", _corr_sql("corr_pair", CORR_COLS, with_views("corr_pair")[:-1]))
def q_correlation_matrix(spark, sf):
    return P.correlation_matrix(view(spark, sf, "corr_pair"))


@register("high_correlations", _corr_sql("corr_pair", CORR_COLS, with_views("corr_pair")[:-1], high=True))
def q_high_correlations(spark, sf):
    return P.high_correlations(view(spark, sf, "corr_pair"))


@register("histogram", """
with p as (select min(o_totalprice) as lo, max(o_totalprice) as hi, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders),
b as (select least(29, cast(floor((o_totalprice - lo) / w) as integer)) as bin, count(*) as c from orders cross join p
      where o_totalprice is not null group by 1)
select cast(g.i as integer) as bin, round(lo + g.i * w, 6) as lower,
 round(case when g.i = 29 then hi else lo + (g.i + 1) * w end, 6) as upper, cast(coalesce(c, 0) as bigint) as count
from range(30) g(i) cross join p left join b on b.bin = g.i""")
def q_histogram(spark, sf):
    return P.histogram(load(spark, sf, "orders"), "o_totalprice")


@register("kde", """
with s as (select count(value) as n, min(value) as lo, max(value) as hi, stddev_pop(value) as sd from events),
p as (select n, lo, hi, sd * pow(n, -0.2) as bw from s),
q as (select n, bw, lo - 3 * bw as x0, hi + 3 * bw as x1 from p),
g as (select cast(i as integer) as point, case when i = 199 then x1 else x0 + i * ((x1 - x0) / 199) end as x, bw, n
      from q cross join range(200) t(i))
select point, round(x, 6) as x,
 round(sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) / (bw * sqrt(2 * pi())) / n, 10) as density
from g cross join (select value as v from events where value is not null) e group by point, x, bw, n""")
def q_kde(spark, sf):
    return P.kde(load(spark, sf, "events"), "value")


@register("plot_sample", "select * from events order by md5(cast(event_id as varchar) || ':42') limit 2000")
def q_plot_sample(spark, sf):
    return P.plot_sample(load(spark, sf, "events"), ["event_id"], 2000, 42)


@register("categorical_summary", f"""
with u as ({unpivot_sql("part", PART_TEXT, "varchar", "value")}),
vc as (select column_name, value, count(*) as c from u where value is not null group by column_name, value),
card as (select column_name, count(*) as cardinality from vc group by column_name),
r as (select *, row_number() over (partition by column_name order by c desc, value asc) as rk from vc)
select r.column_name, cast(cardinality as bigint) as cardinality, cardinality > 50 as high_cardinality,
 cast(rk as integer) as rank, value, cast(c as bigint) as count from r join card on r.column_name = card.column_name where rk <= 10""")
def q_categorical_summary(spark, sf):
    return P.categorical_summary(load(spark, sf, "part"))


@register("constant_columns", with_views("constants") + f""",
u as ({unpivot_sql("constants", ["o_orderkey", "c_const", "c_null", "c_near", "c_ok"], "varchar", "value")}),
vc as (select column_name, value, count(*) as c from u where value is not null group by column_name, value),
per as (select column_name, count(*) as d, sum(c) as n from vc group by column_name),
top as (select column_name, value, c from (select *, row_number() over (partition by column_name order by c desc, value) as rk from vc) t where rk = 1)
select per.column_name, top.value as unique_value,
 case when d <= 1 then 1.0 else round(top.c / n, 4) end as percent_same
from per join top on per.column_name = top.column_name where d <= 1 or (d = 2 and top.c / n > 0.99)""")
def q_constant_columns(spark, sf):
    return P.constant_columns(view(spark, sf, "constants"))


def _targets_sql(source: str, text_cols: list[str], int_cols: list[str], prefix: str = "with x as (select 1)") -> str:
    cols = text_cols + int_cols
    return f"""{prefix}, u as ({unpivot_sql(source, cols, "varchar", "value")}),
vc as (select column_name, value, count(*) as c from u where value is not null group by column_name, value),
per as (select column_name, count(*) as k, sum(c) as total, max(c) as mx, min(c) as mn from vc group by column_name),
z as (select *, mx / total as maj, mn / total as mino, case when mn / total > 0 then (mx / total) / (mn / total) else 999.0 end as ratio from per)
select column_name, case when column_name in ({", ".join(f"'{c}'" for c in int_cols) or "''"}) then 'numeric_class' else 'categorical_class' end as type,
 cast(k as bigint) as class_count, round(maj, 4) as majority_pct, round(mino, 4) as minority_pct,
 case when ratio < 999 then round(ratio, 4) else 999.0 end as imbalance_ratio, ratio > 2.0 as is_imbalanced
from z where k between 2 and 50"""


@register("potential_targets", _targets_sql("orders", ["o_orderstatus", "o_orderpriority"], ["o_orderkey", "o_custkey"]))
def q_potential_targets(spark, sf):
    return P.potential_targets(load(spark, sf, "orders"))


@register("potential_targets_labels", _targets_sql("labels", [], ["doc_id", "quality", "toxic"]))
def q_potential_targets_labels(spark, sf):
    return P.potential_targets(load(spark, sf, "labels"))


_TS_SQL = ("coalesce(try_strptime(odate, '%Y-%m-%d %H:%M:%S'), try_strptime(odate, '%Y-%m-%d'), "
           "try_strptime(odate, '%Y-%m-%dT%H:%M:%S'), try_strptime(odate, '%Y/%m/%d'), "
           "try_strptime(odate, '%m/%d/%Y'), try_strptime(odate, '%d-%m-%Y'))")


@register("dtype_issues", with_views("text_dates") + f""",
s as (select count(odate) as n, count(case when not isnan(try_cast(odate as double)) then 1 end) as num,
      count({_TS_SQL}) as dt from text_dates),
anyv as (select string_agg(odate, ' | ' order by o_orderkey) as sv from (select o_orderkey, odate from text_dates where odate is not null order by o_orderkey limit 5) t),
badv as (select string_agg(odate, ' | ' order by o_orderkey) as sv from (select o_orderkey, odate from text_dates where odate is not null and (try_cast(odate as double) is null or isnan(try_cast(odate as double))) order by o_orderkey limit 5) t)
select 'odate' as column_name, 'mostly numbers, some values do not parse' as issue, badv.sv as sample_values
 from s cross join badv where n >= 5 and num / n > 0.7 and num < n
union all select 'odate', 'numbers kept as text', anyv.sv from s cross join anyv where n >= 5 and num / n > 0.7 and num = n
union all select 'odate', 'dates kept as text', anyv.sv from s cross join anyv where n >= 5 and dt / n > 0.7""")
def q_dtype_issues(spark, sf):
    return P.dtype_issues(view(spark, sf, "text_dates"), ["o_orderkey"])
