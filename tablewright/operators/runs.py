"""Queries over run records (M19-M24, R1-R8): ordinary relational work on a
flat runs DataFrame (id, job_id, pipeline_id, dataset_id, session_id, status,
created_at, metric columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWER_IS_BETTER = ("rmse", "mae", "mape")
DEFAULT_USER = "default_user"


def _metric_order(metric: str, id_col: str = "id"):
    """Sort key: missing metrics last, best first, ties by id."""
    m = F.col(metric)
    best = m if metric in LOWER_IS_BETTER else -m
    return F.struct(m.isNull().alias("a"), best.alias("b"), F.col(id_col).alias("c"))


def leaderboard(runs: DataFrame, metric: str = "accuracy", group: str = "job_id") -> DataFrame:
    """Flag the best run per group by ``metric`` (lower-better for
    rmse/mae/mape).  Aggregate + join, so a huge group is pre-aggregated
    per map task instead of windowed in one task."""
    best = runs.groupBy(group).agg(F.min_by("id", _metric_order(metric)).alias("__best"))
    return (runs.join(best, group, "left")
            .withColumn("is_best", F.coalesce(F.col("id") == F.col("__best"), F.lit(False))).drop("__best"))


def compare(runs: DataFrame, ids, metric: str = "accuracy") -> DataFrame:
    """Selected runs sorted by metric (desc; asc for error metrics),
    best flag for runs reaching the best value.  ``ids`` is a short list or a
    DataFrame with an ``id`` column (semi join, nothing collected)."""
    if isinstance(ids, DataFrame):
        sel = runs.join(ids.select("id").distinct(), "id", "left_semi")
    else:
        sel = runs.where(F.col("id").isin(list(ids)))
    agg = F.min(metric) if metric in LOWER_IS_BETTER else F.max(metric)
    top = sel.agg(agg.alias("__top")).collect()[0]["__top"]
    flag = F.coalesce(F.col(metric) == F.lit(top), F.lit(False)) if top is not None else F.lit(False)
    order = F.col(metric).asc_nulls_last() if metric in LOWER_IS_BETTER else F.col(metric).desc_nulls_last()
    return sel.withColumn("is_best", flag).orderBy(order, F.col("id"))


def set_best(runs: DataFrame, run_id, group: str = "job_id") -> DataFrame:
    """The chosen run becomes best, its siblings (same group) not."""
    g = runs.where(F.col("id") == run_id).select(group).limit(1).collect()
    if not g:
        raise ValueError(f"run {run_id} not found")
    sib = F.col(group) == F.lit(g[0][0])
    return runs.withColumn("is_best", F.when(sib, F.col("id") == F.lit(run_id)).otherwise(F.col("is_best")))


def rank_runs(runs: DataFrame, metric: str, descending: bool = True, pipeline_id=None) -> DataFrame:
    """Order by any metric with missing values last, optional pipeline filter."""
    r = runs if pipeline_id is None else runs.where(F.col("pipeline_id") == pipeline_id)
    o = F.col(metric).desc_nulls_last() if descending else F.col(metric).asc_nulls_last()
    return r.orderBy(o, F.col("id"))


def report_leaderboard(runs: DataFrame, job_id, metric: str = "accuracy") -> DataFrame:
    """Completed siblings of a job by metric."""
    return rank_runs(runs.where((F.col("job_id") == job_id) & (F.col("status") == "completed")), metric)


def best_run(runs: DataFrame, metric: str = "accuracy", group: str | None = None) -> DataFrame:
    """Id of the best run (per group) by metric."""
    g = [group] if group else []
    return runs.where(F.col(metric).isNotNull()).groupBy(*g).agg(
        F.min_by("id", _metric_order(metric)).alias("best_id"),
        (F.min(metric) if metric in LOWER_IS_BETTER else F.max(metric)).alias(f"best_{metric}"))


def list_runs(runs: DataFrame) -> DataFrame:
    """Newest first (created_at desc, id desc)."""
    return runs.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def visible(runs: DataFrame, session: str) -> DataFrame:
    """R2: own, shared (default user) or unowned records; the default user sees all."""
    if session == DEFAULT_USER:
        return runs
    s = F.col("session_id")
    return runs.where(s.isNull() | (s == session) | (s == DEFAULT_USER))


def paginate(df: DataFrame, page: int, per_page: int = 20, order_by=None) -> DataFrame:
    """Page ``page`` (1-based) of ``per_page`` rows plus the total count."""
    order_by = order_by or [F.col("created_at").desc_nulls_last(), F.col("id").desc()]
    total = df.count()
    return df.orderBy(*order_by).offset((page - 1) * per_page).limit(per_page).withColumn("total", F.lit(total).cast("bigint"))


def cascade(runs: DataFrame, deleted: DataFrame, key: str, deleted_key: str | None = None):
    """(removed, kept) for records whose ``key`` is in ``deleted``."""
    d = deleted.select(F.col(deleted_key or key).alias(key)).distinct()
    return runs.join(d, key, "left_semi"), runs.join(d, key, "left_anti")


def latest(records: DataFrame, id_col: str = "id", ts: str = "updated_at") -> DataFrame:
    """Last record per id wins (aggregate, not a window: a hot id is
    combined map-side)."""
    cols = [c for c in records.columns if c != id_col]
    return (records.groupBy(id_col).agg(F.max_by(F.struct(*cols), F.struct(F.col(ts).isNotNull(), F.col(ts))).alias("__r"))
            .select(id_col, "__r.*"))


def expired(runs: DataFrame, now, days: int = 7, ts: str = "created_at") -> DataFrame:
    """Records whose age in whole days is >= ``days`` or have no timestamp."""
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) -
                   F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(86400 * 1_000_000))
    return runs.where(F.col(ts).isNull() | (age >= days))


def status_counts(runs: DataFrame) -> DataFrame:
    """Completed / active (running + queued) / failed counts."""
    b = (F.when(F.col("status") == "completed", "completed")
         .when(F.col("status").isin("running", "queued"), "active")
         .when(F.col("status") == "failed", "failed").otherwise("other"))
    return runs.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def cleaned_inputs(datasets: DataFrame) -> DataFrame:
    """Datasets produced by a cleaning run whose source still exists,
    with the source -> cleaned edge."""
    src = datasets.select(F.col("id").alias("source_dataset_id"))
    return datasets.where(F.col("source_dataset_id").isNotNull()).join(src, "source_dataset_id", "left_semi")
