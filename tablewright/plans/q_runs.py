"""Registered run-registry queries (M19-M24, R1-R8) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as RU
from .fixtures import load, view, with_views
from .registry import register

RUN_COLS = "id, job_id, pipeline_id, dataset_id, session_id, status, created_at, accuracy, progress"


@register("leaderboard", with_views("runs") + f"""select {RUN_COLS}, coalesce(rn = 1, false) as is_best from
 (select *, row_number() over (partition by job_id order by accuracy desc nulls last, id) as rn from runs) t""")
def q_leaderboard(spark, sf):
    return RU.leaderboard(view(spark, sf, "runs"))


def _job_ids(runs, job):
    return runs.where(F.col("job_id") == job).select("id")


@register("compare", with_views("runs") + f"""select {RUN_COLS}, coalesce(accuracy = (select max(accuracy) from runs where job_id = 7), false) as is_best
 from runs where job_id = 7""")
def q_compare(spark, sf):
    runs = view(spark, sf, "runs")
    return RU.compare(runs, _job_ids(runs, 7))


@register("set_best", with_views("runs") + f""", lb as (select {RUN_COLS}, coalesce(rn = 1, false) as is_best from
 (select *, row_number() over (partition by job_id order by accuracy desc nulls last, id) as rn from runs) t),
c as (select job_id as j from runs where id = (select min(id) from runs where job_id = 7))
select {RUN_COLS}, case when job_id = (select j from c) then id = (select min(id) from runs where job_id = 7) else is_best end as is_best from lb""")
def q_set_best(spark, sf):
    runs = view(spark, sf, "runs")
    first = runs.where(F.col("job_id") == 7).agg(F.min("id")).collect()[0][0]
    return RU.set_best(RU.leaderboard(runs), first)


@register("rank_runs", with_views("runs") + "select * from runs where pipeline_id = 5 order by accuracy desc nulls last, id")
def q_rank_runs(spark, sf):
    return RU.rank_runs(view(spark, sf, "runs"), "accuracy", pipeline_id=5)


@register("report_leaderboard", with_views("runs") + "select * from runs where job_id = 7 and status = 'completed' order by accuracy desc nulls last, id")
def q_report_leaderboard(spark, sf):
    return RU.report_leaderboard(view(spark, sf, "runs"), 7)


@register("best_run", with_views("runs") + """select pipeline_id, first(id order by accuracy desc, id) as best_id, max(accuracy) as best_accuracy
 from runs where accuracy is not null group by pipeline_id""")
def q_best_run(spark, sf):
    return RU.best_run(view(spark, sf, "runs"), "accuracy", "pipeline_id")


@register("list_runs", with_views("runs") + "select * from runs order by created_at desc nulls last, id desc")
def q_list_runs(spark, sf):
    return RU.list_runs(view(spark, sf, "runs"))


@register("visible", with_views("runs") + "select * from runs where session_id is null or session_id = 's1' or session_id = 'default_user'")
def q_visible(spark, sf):
    return RU.visible(view(spark, sf, "runs"), "s1")


@register("paginate", with_views("runs") + """select *, (select count(*) from runs) as total from runs
 order by created_at desc nulls last, id desc limit 20 offset 40""")
def q_paginate(spark, sf):
    return RU.paginate(view(spark, sf, "runs"), 3, 20)


@register("cascade", with_views("runs") + """select * from runs where dataset_id not in (select c_custkey from customer where c_nationkey = 0)""")
def q_cascade(spark, sf):
    deleted = load(spark, sf, "customer").where(F.col("c_nationkey") == 0)
    return RU.cascade(view(spark, sf, "runs"), deleted, "dataset_id", "c_custkey")[1]


@register("cascade_removed", with_views("runs") + """select * from runs where dataset_id in (select c_custkey from customer where c_nationkey = 0)""")
def q_cascade_removed(spark, sf):
    deleted = load(spark, sf, "customer").where(F.col("c_nationkey") == 0)
    return RU.cascade(view(spark, sf, "runs"), deleted, "dataset_id", "c_custkey")[0]


def _versions(runs):
    upd = (runs.where(F.col("status") == "running")
           .withColumn("status", F.lit("completed")).withColumn("progress", F.lit(100.0))
           .withColumn("updated_at", F.col("created_at") + F.expr("interval 1 day")))
    return runs.withColumn("updated_at", F.col("created_at")).unionByName(upd)


@register("latest", with_views("runs") + f""", v as (select *, created_at as updated_at from runs
 union all select id, job_id, pipeline_id, dataset_id, session_id, 'completed', created_at, accuracy, 100.0, created_at + interval 1 day from runs where status = 'running')
select {RUN_COLS}, updated_at from (select *, row_number() over (partition by id order by updated_at desc) as rn from v) t where rn = 1""")
def q_latest(spark, sf):
    return RU.latest(_versions(view(spark, sf, "runs")), "id", "updated_at").select(*RUN_COLS.split(", "), "updated_at")


@register("expired", with_views("runs") + """select * from runs where created_at is null or
 floor((epoch_us((select max(created_at) from runs)) - epoch_us(created_at)) / 86400000000) >= 7""")
def q_expired(spark, sf):
    runs = view(spark, sf, "runs")
    now = runs.agg(F.max("created_at")).collect()[0][0]
    return RU.expired(runs, now)


@register("status_counts", with_views("runs") + """select case when status = 'completed' then 'completed' when status in ('running', 'queued') then 'active'
 when status = 'failed' then 'failed' else 'other' end as bucket, count(*) as count from runs group by 1""")
def q_status_counts(spark, sf):
    return RU.status_counts(view(spark, sf, "runs"))


_DATASETS = "select c_custkey as id, case when c_custkey % 3 = 0 then c_custkey - 1 end as source_dataset_id, c_name as name from {customer}"


@register("cleaned_inputs", f"""with d as ({_DATASETS.format(customer="customer")})
select * from d where source_dataset_id is not null and source_dataset_id in (select id from d)""")
def q_cleaned_inputs(spark, sf):
    d = spark.sql(_DATASETS, customer=load(spark, sf, "customer"))
    return RU.cleaned_inputs(d)
