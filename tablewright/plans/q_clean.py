"""Registered cleaning queries (C*) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CleaningConfig, MissingStrategy, OutlierStrategy
from ..functions.neighbors import knn_impute
from ..operators import clean as C
from .cleaning import clean
from .fixtures import load, view, with_views
from .registry import register

DIRTY = ["o_orderkey", "price", "priority", "status", "odate"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


def _round_doubles(df, digits=6):
    from pyspark.sql import types as T
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


@register("drop_duplicates", with_views("orders_dirty") + "select distinct * from orders_dirty")
def q_drop_duplicates(spark, sf):
    return C.remove_duplicates(view(spark, sf, "orders_dirty"))[0]


@register("drop_column", with_views("orders_dirty") + "select o_orderkey, priority, status, odate from orders_dirty")
def q_drop_column(spark, sf):
    return C.drop_missing_column(view(spark, sf, "orders_dirty"), "price")[0]


@register("drop_row", with_views("orders_dirty") + "select * from orders_dirty where price is not null")
def q_drop_row(spark, sf):
    return C.drop_missing_rows(view(spark, sf, "orders_dirty"), "price")[0]


@register("fill_mean", with_views("orders_dirty") + """, m as (select avg(price) as v from orders_dirty)
select o_orderkey, round(coalesce(price, v), 6) as price, priority, status, odate from orders_dirty cross join m""")
def q_fill_mean(spark, sf):
    return _round_doubles(C.fill_statistic(view(spark, sf, "orders_dirty"), "price", "mean")[0])


@register("fill_median", with_views("orders_dirty") + """, m as (select quantile_cont(price, 0.5) as v from orders_dirty)
select o_orderkey, round(coalesce(price, v), 6) as price, priority, status, odate from orders_dirty cross join m""")
def q_fill_median(spark, sf):
    return _round_doubles(C.fill_statistic(view(spark, sf, "orders_dirty"), "price", "median")[0])


@register("fill_mode", with_views("orders_dirty") + """, m as (
 select priority as v from (select priority, count(*) as c from orders_dirty where priority is not null group by priority) t
 order by c desc, priority limit 1)
select o_orderkey, price, coalesce(priority, v) as priority, status, odate from orders_dirty cross join m""")
def q_fill_mode(spark, sf):
    return C.fill_statistic(view(spark, sf, "orders_dirty"), "priority", "mode")[0]


@register("ffill", with_views("events_gaps") + """
select event_id, user_id, ts, last_value(value ignore nulls) over (partition by user_id order by ts, event_id
 rows between unbounded preceding and current row) as value from events_gaps""")
def q_ffill(spark, sf):
    return C.directional(view(spark, sf, "events_gaps"), "value", "ffill", ["ts", "event_id"], ["user_id"])[0]


@register("bfill", with_views("events_gaps") + """
select event_id, user_id, ts, first_value(value ignore nulls) over (partition by user_id order by ts, event_id
 rows between current row and unbounded following) as value from events_gaps""")
def q_bfill(spark, sf):
    return C.directional(view(spark, sf, "events_gaps"), "value", "bfill", ["ts", "event_id"], ["user_id"])[0]


_PG = ["p_partkey", "p_size", "p_retailprice"]
_NANE = (" + ".join(f"(case when r.{c} is not null and d.{c} is not null then 1 else 0 end)" for c in _PG),
         " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0.0)" for c in _PG))


@register("knn_impute", with_views("part_gaps") + f""",
r as (select * from part_gaps where p_retailprice is null), d as (select * from part_gaps where p_retailprice is not null),
pairs as (select r.p_partkey as qid, d.p_partkey as did, d.p_retailprice as dv,
  case when ({_NANE[0]}) > 0 then sqrt(3.0 / ({_NANE[0]}) * ({_NANE[1]})) end as dist from r cross join d),
top as (select qid, dv, row_number() over (partition by qid order by dist, did) as rn from pairs where dist is not null),
f as (select qid, avg(dv) as fill from top where rn <= 5 group by qid),
m as (select avg(p_retailprice) as mean from part_gaps)
select p.p_partkey, round(p.p_size, 6) as p_size, round(coalesce(p.p_retailprice, f.fill, m.mean), 6) as p_retailprice
from part_gaps p left join f on p.p_partkey = f.qid cross join m""")
def q_knn_impute(spark, sf):
    return _round_doubles(knn_impute(view(spark, sf, "part_gaps"), "p_retailprice", "p_partkey")[0])


_HOLES = ["p_size", "code"]
_BOTH = " + ".join(f"cast(r.{c} is not null and d.{c} is not null as int)" for c in _HOLES)
_GAP = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0)" for c in _HOLES)


@register("knn_impute_gaps", with_views("part_holes") + f""",
pairs as (select r.p_partkey as qid, d.p_partkey as did, d.p_retailprice as dv,
  case when ({_BOTH}) > 0 then sqrt(3.0 / ({_BOTH}) * ({_GAP})) end as dist
  from part_holes r cross join part_holes d where r.p_retailprice is null and d.p_retailprice is not null),
top as (select qid, dv, row_number() over (partition by qid order by dist, did) as rn from pairs where dist is not null),
f as (select qid, avg(dv) as fill from top where rn <= 5 group by qid),
m as (select avg(p_retailprice) as mean from part_holes)
select p_partkey, round(p_size, 6) as p_size, round(coalesce(p_retailprice, f.fill, m.mean), 6) as p_retailprice,
 round(code, 6) as code from part_holes p left join f on p.p_partkey = f.qid cross join m""")
def q_knn_impute_gaps(spark, sf):
    """No numeric column is complete."""
    return _round_doubles(knn_impute(view(spark, sf, "part_holes"), "p_retailprice", "p_partkey",
                                     ["p_size", "p_retailprice", "code"])[0])


_FENCE = """, f as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events),
b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from f)"""


@register("winsorize", "with x as (select 1)" + _FENCE + """
select event_id, ts, user_id, event_type, round(case when value is null then null else greatest(lo, least(hi, value)) end, 6) as value, props
from events cross join b""")
def q_winsorize(spark, sf):
    return _round_doubles(C.winsorize(load(spark, sf, "events"), "value")[0])


@register("remove_outliers", "with x as (select 1)" + _FENCE + """
select event_id, ts, user_id, event_type, value, props from events cross join b where not coalesce(value < lo or value > hi, false)""")
def q_remove_outliers(spark, sf):
    return C.remove_outliers(load(spark, sf, "events"), ["value"])[0]


@register("fix_numeric_text", with_views("text_numbers") + """, c as (
 select p_partkey, try_cast(regexp_replace(regexp_replace(amount, '^[$€£¥₹]', ''), ',', '', 'g') as double) as v from text_numbers)
select p_partkey, case when isnan(v) then null else v end as amount from c""")
def q_fix_numeric_text(spark, sf):
    return C.fix_dtypes(view(spark, sf, "text_numbers"))[0]


@register("fix_datetime_text", with_views("text_dates") + """
select o_orderkey, coalesce(try_strptime(odate, '%Y-%m-%d %H:%M:%S'), try_strptime(odate, '%Y-%m-%d'),
 try_strptime(odate, '%Y-%m-%dT%H:%M:%S'), try_strptime(odate, '%Y/%m/%d'), try_strptime(odate, '%m/%d/%Y'),
 try_strptime(odate, '%d-%m-%Y')) as odate from text_dates""")
def q_fix_datetime_text(spark, sf):
    return C.fix_dtypes(view(spark, sf, "text_dates"))[0]


@register("trim_lower", with_views("messy_text") + r"""
select p_partkey, lower(regexp_replace(brand, '^\s+|\s+$', '', 'g')) as brand from messy_text""")
def q_trim_lower(spark, sf):
    return C.standardize_text(view(spark, sf, "messy_text"))[0]


@register("near_duplicate_values", with_views("messy_text") + r""",
v as (select distinct lower(regexp_replace(brand, '^\s+|\s+$', '', 'g')) as v from messy_text where brand is not null),
p as (select a.v as value_a, b.v as value_b, 1 - levenshtein(a.v, b.v) / greatest(length(a.v), length(b.v), 1) as s
      from v a join v b on a.v < b.v)
select value_a, value_b, round(s, 4) as similarity from p where s > 0.8""")
def q_near_duplicate_values(spark, sf):
    std = C.standardize_text(view(spark, sf, "messy_text"))[0]
    return C.near_duplicate_values(std, "brand")


@register("drop_constant", with_views("constants") + "select o_orderkey, c_ok from constants")
def q_drop_constant(spark, sf):
    return C.drop_constant(view(spark, sf, "constants"))[0]


def _suggestions_sql() -> str:
    dtypes = {"o_orderkey": "bigint", "price": "double", "priority": "string", "status": "string", "odate": "timestamp_ntz"}
    numeric = ["o_orderkey", "price"]
    text = ["priority", "status"]
    parts = []
    for c in DIRTY:
        isnum = c in numeric
        if isnum:
            oc = (f"(select count(*) from orders_dirty cross join (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 "
                  f"from orders_dirty) q where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))")
        else:
            oc = "cast(null as bigint)"
        parts.append(f"""select '{c}' as column_name, '{dtypes[c]}' as dtype, {str(isnum).lower()} as is_numeric,
 {str(c in text).lower()} as is_categorical, count(*) - count({c}) as missing_count,
 round((count(*) - count({c})) / greatest(count(*), 1), 4) as missing_pct, {oc} as outlier_count,
 count(distinct {c}) as unique_count, {str(isnum).lower()} as isnum, {str(c in text).lower()} as istext, count(*) as n from orders_dirty""")
    body = "\nunion all ".join(parts)
    return with_views("orders_dirty") + f""", s as ({body}),
t as (select *, case when outlier_count is null then null else round(outlier_count / greatest(n, 1), 4) end as outlier_pct from s)
select column_name, dtype, is_numeric, is_categorical, cast(missing_count as bigint) as missing_count, missing_pct,
 cast(outlier_count as bigint) as outlier_count, outlier_pct, cast(unique_count as bigint) as unique_count,
 case when missing_pct > 0.5 then 'drop_column' when missing_pct < 0.01 then (case when istext then 'mode' else 'median' end)
      when isnum then (case when missing_pct < 0.3 then 'median' else 'knn' end) else 'mode' end as suggested_missing_strategy,
 case when coalesce(outlier_pct, 0) > 0.2 then 'leave' else 'winsorize' end as suggested_outlier_strategy from t"""


@register("cleaning_suggestions", _suggestions_sql())
def q_cleaning_suggestions(spark, sf):
    return C.cleaning_suggestions(view(spark, sf, "orders_dirty"))


@register("cleaning_plan", _suggestions_sql().replace("\nselect column_name, dtype", ", z as (select column_name, dtype", 1)
          + """)
select 'missing' as kind, column_name, suggested_missing_strategy as strategy from z where missing_count > 0
union all select 'outlier', column_name, suggested_outlier_strategy from z where outlier_count > 0""")
def q_cleaning_plan(spark, sf):
    return C.plan_cleaning(C.cleaning_suggestions(view(spark, sf, "orders_dirty")))


def _planned_config(plan_rows) -> CleaningConfig:
    miss = tuple(MissingStrategy(r["column_name"], r["strategy"]) for r in plan_rows if r["kind"] == "missing")
    outl = tuple(OutlierStrategy(r["column_name"], r["strategy"]) for r in plan_rows if r["kind"] == "outlier")
    return CleaningConfig(missing_strategies=miss, outlier_strategies=outl)


def _clean_orders(spark, sf):
    df = view(spark, sf, "orders_dirty")
    plan = C.plan_cleaning(C.cleaning_suggestions(df)).collect()
    return clean(df, _planned_config(plan), key="o_orderkey")


@register("clean_run", with_views("orders_dirty") + """, d as (select distinct * from orders_dirty),
m as (select quantile_cont(price, 0.5) as med from d),
mo as (select priority as v from (select priority, count(*) as c from d where priority is not null group by priority) t order by c desc, priority limit 1)
select o_orderkey, round(coalesce(price, med), 6) as price, lower(coalesce(priority, v)) as priority, lower(status) as status, odate
from d cross join m cross join mo""")
def q_clean_run(spark, sf):
    return _round_doubles(_clean_orders(spark, sf).data)


_CLEANED = with_views("orders_dirty") + """, d as (select distinct * from orders_dirty),
n as (select (select count(*) from orders_dirty) as rows_in, (select count(*) from d) as rows_left,
  (select count(*) filter (price is null) from orders_dirty) as price_in, (select count(*) filter (priority is null) from orders_dirty) as priority_in),
m as (select quantile_cont(price, 0.5) as med, count(*) filter (price is null) as no_price, count(*) filter (priority is null) as no_priority from d),
mo as (select priority as v from (select priority, count(*) as c from d where priority is not null group by priority) t order by c desc, priority limit 1),
f as (select coalesce(priority, v) as priority, status from d cross join mo),
l as (select count(*) filter (lower(priority) <> priority) as p, count(distinct priority) as p1, count(distinct lower(priority)) as p2,
  count(*) filter (lower(status) <> status) as s, count(distinct status) as s1, count(distinct lower(status)) as s2 from f),
w as (select 'lowered=' || p || ' distinct=' || p1 || '->' || p2 as priority, 'lowered=' || s || ' distinct=' || s1 || '->' || s2 as status from l)
"""


@register("clean_log", _CLEANED + """select 1 as seq, 'remove_duplicates' as step, 'duplicates' as description, '' as columns_affected,
 rows_in - rows_left as rows_affected, (rows_in - rows_left) * 5 as cells_affected,
 'rows=' || (rows_in - rows_left) || ' width=5' as details from n
union all select 2, 'missing_values', 'filled: median', 'price', no_price, no_price,
 'missing=' || no_price || ' by=median value=' || printf('%.4f', med) from m
union all select 3, 'missing_values', 'filled: mode', 'priority', no_priority, no_priority, 'missing=' || no_priority || ' by=mode' from m
union all select 4, 'categorical_clean', 'values unified', 'priority', 0, p, w.priority from l cross join w
union all select 5, 'categorical_clean', 'values unified', 'status', 0, s, w.status from l cross join w""")
def q_clean_log(spark, sf):
    return _clean_orders(spark, sf).log


@register("column_changes", _CLEANED + """select 'o_orderkey' as column_name, 'bigint' as before_dtype, 'bigint' as after_dtype,
 0 as before_missing, 0 as after_missing, cast(0 as double) as before_missing_pct, cast(0 as double) as after_missing_pct, '' as changes
union all select 'price', 'double', 'double', price_in, 0, round(price_in / rows_in, 4), cast(0 as double), 'nulls ' || price_in || '->0' from n
union all select 'priority', 'string', 'string', priority_in, 0, round(priority_in / rows_in, 4), cast(0 as double),
 w.priority || '; nulls ' || priority_in || '->0' from n cross join w
union all select 'status', 'string', 'string', 0, 0, cast(0 as double), cast(0 as double), status from w
union all select 'odate', 'timestamp_ntz', 'timestamp_ntz', 0, 0, cast(0 as double), cast(0 as double), ''""")
def q_column_changes(spark, sf):
    return _clean_orders(spark, sf).column_changes


@register("cleaning_runs", with_views("orders_dirty") + """, n as (select count(*) as c,
  count(*) filter (price is null) as no_price, count(*) filter (priority is null) as no_priority,
  cast(bool_or(priority <> lower(priority)) as int) + cast(bool_or(status <> lower(status)) as int) as lowered from orders_dirty),
d as (select count(*) as c from (select distinct * from orders_dirty) t)
select id, n.c as before_rows, d.c as after_rows, cast((n.c > d.c)::int + lowered
  + case when id = 2 then (no_price > 0)::int + (no_priority > 0)::int else 0 end as int) as step_count,
 cast(3 - id as int) as newest from n cross join d cross join (values (1), (2)) r(id)""")
def q_cleaning_runs(spark, sf):
    """C26 over two runs on the dirty orders view: their written reports, newest
    first."""
    from .cleaning import cleaning_runs
    from .manifest import write_cleaning_report
    from .q_io import scratch

    df, path = view(spark, sf, "orders_dirty"), scratch(spark) + "/cleaning_reports"
    plan = C.plan_cleaning(C.cleaning_suggestions(df)).collect()
    for i, cfg in enumerate([CleaningConfig(), _planned_config(plan)]):
        write_cleaning_report(clean(df, cfg, key="o_orderkey"), path, i + 1)
    runs = cleaning_runs(spark.read.parquet(path))
    newest = Window.orderBy(F.col("created_at").desc(), F.col("id").desc())  # one row per run
    return runs.withColumn("newest", F.row_number().over(newest)).drop("created_at")
