"""Registered model queries: training, CV, tuning, explanation and scoring
(M1-M48).  Model fits are not SQL-expressible (rows-only); closed-form parts
(OLS, k-NN vote, baseline, waterfall, row lookup, schema check, decoding,
layout) have DuckDB oracles."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import explain as EX
from ..operators import prepare as PR
from ..operators import score as SC
from ..operators import split as SP
from ..operators import train as TR
from ..operators.profile import value_presence
from ..config import PipelineConfig
from .fixtures import load, view, with_views
from .prepare import prepare
from .q_prepare import _doc_prep
from .registry import register

_METRICS = "algorithm string, accuracy double, precision double, recall double, f1_score double, roc_auc double"


def _fit_doc(spark, sf, algo="logistic_regression", hp=None):
    p = _doc_prep(spark, sf)
    feats = p.model.feature_names()
    m = TR.fit(algo, p.train, feats, "classification", hp)
    return p, feats, m


@register("train_model")
def q_train_model(spark, sf):
    p, feats, m = _fit_doc(spark, sf)
    met = TR.evaluate(m.transform(p.test), "classification")
    return spark.createDataFrame([("logistic_regression", met.get("accuracy"), met.get("precision"), met.get("recall"),
                                   met.get("f1_score"), met.get("roc_auc"))], _METRICS)


@register("train_random_forest")
def q_train_random_forest(spark, sf):
    p, feats, m = _fit_doc(spark, sf, "random_forest")
    met = TR.evaluate(m.transform(p.test), "classification")
    return spark.createDataFrame([("random_forest", met.get("accuracy"), met.get("precision"), met.get("recall"),
                                   met.get("f1_score"), met.get("roc_auc"))], _METRICS)


@register("cross_validate")
def q_cross_validate(spark, sf):
    p = _doc_prep(spark, sf)
    cv = TR.cross_validate("logistic_regression", p.train, p.model.feature_names(), "classification", 5, ["doc_id"])
    return spark.createDataFrame([(cv["accuracy"], cv["f1_weighted"])], "accuracy double, f1_weighted double")


@register("tune")
def q_tune(spark, sf):
    p, feats, m = _fit_doc(spark, sf)
    base = TR.evaluate(m.transform(p.test), "classification")
    t = TR.tune("logistic_regression", p.train, p.test, feats, "classification", base, "f1_score", ["doc_id"])
    return spark.createDataFrame([(json.dumps(t["hp"]), t["metrics"]["f1_score"], base["f1_score"], t["improved"])],
                                 "best_params string, tuned_f1 double, baseline_f1 double, improved boolean")


@register("ols", """select round(regr_slope(l_extendedprice, l_quantity), 4) as coefficient,
 round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem""")
def q_ols(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    m = TR.fit("linear_regression", df, ["l_quantity"], "regression")
    st = m.stages[-1]
    return spark.createDataFrame([(float(st.coefficients[0]), float(st.intercept))], "coefficient double, intercept double") \
        .select(F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


def _emb_cols(df, d=64):
    return df.select("vec_id", F.col("label").cast("double").alias("label"),
                     *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(d)])


@register("knn_classify", """with e as (select vec_id, label, embedding from embeddings),
te as (select * from e order by md5(cast(vec_id as varchar) || ':42') limit (select cast(ceil(0.2 * count(*)) as bigint) from e)),
tr as (select * from e where vec_id not in (select vec_id from te)),
d as (select te.vec_id as qid, tr.vec_id as did, tr.label as dl,
  sqrt(list_sum(list_transform(list_zip(te.embedding, tr.embedding), lambda x: (cast(x[1] as double) - cast(x[2] as double)) * (cast(x[1] as double) - cast(x[2] as double))))) as dist
  from te cross join tr),
nn as (select qid, dl from (select *, row_number() over (partition by qid order by dist, did) as rn from d) t where rn <= 5),
v as (select qid, dl, count(*) as c from nn group by qid, dl)
select qid as vec_id, cast(first(dl order by c desc, dl) as double) as prediction from v group by qid""")
def q_knn_classify(spark, sf):
    emb = _emb_cols(load(spark, sf, "embeddings")).withColumn("__row_id", F.col("vec_id"))
    train, test = SP.split(emb, 0.2, 42, ["vec_id"])
    feats = [f"e{i}" for i in range(64)]
    m = TR.KnnClassifier(feats, 5, "__row_id").fit(train)
    return m.transform(test).select("vec_id", F.col("prediction").cast("double").alias("prediction"))


@register("feature_importance")
def q_feature_importance(spark, sf):
    p, feats, m = _fit_doc(spark, sf, "random_forest")
    return EX.feature_importance(m, feats, 15)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    p, feats, m = _fit_doc(spark, sf)
    return EX.permutation_importance(m, p.test, feats, "classification", ["doc_id"], 2, 42)


@register("learning_curve")
def q_learning_curve(spark, sf):
    p = _doc_prep(spark, sf)
    return EX.learning_curve("logistic_regression", p.train, p.model.feature_names(), "classification", ["doc_id"])


_PART_NUM = ["p_partkey", "p_size", "p_retailprice"]
_PART_TXT = ["p_name", "p_brand", "p_type"]


@register("baseline_row", "select " + ", ".join(f"cast(quantile_cont({c}, 0.5) as double) as {c}" for c in _PART_NUM) + ", "
          + ", ".join(f"(select {c} from (select {c}, count(*) as n from part where {c} is not null group by {c}) t order by n desc, {c} limit 1) as {c}"
                      for c in _PART_TXT) + " from part")
def q_baseline_row(spark, sf):
    return EX.baseline_row(load(spark, sf, "part"))


_W = {"p_size": 0.5, "p_retailprice": 0.01}


@register("waterfall", """with b as (select quantile_cont(cast(p_size as double), 0.5) as b1, quantile_cont(p_retailprice, 0.5) as b2 from part),
s as (select p_partkey, cast(p_size as double) as x1, p_retailprice as x2,
  1.0 + 0.5 * b1 + 0.01 * b2 as s0, 1.0 + 0.5 * cast(p_size as double) + 0.01 * b2 as s1,
  1.0 + 0.5 * cast(p_size as double) + 0.01 * p_retailprice as s2 from part cross join b)
select p_partkey, 1 as step, 'p_size' as feature, x1 as value, round(s1 - s0, 6) as contribution from s
union all select p_partkey, 2, 'p_retailprice', x2, round(s2 - s1, 6) from s""")
def q_waterfall(spark, sf):
    df = load(spark, sf, "part")
    base = EX.baseline_row(df, ["p_size", "p_retailprice"]).collect()[0].asDict()
    out = EX.waterfall(df, ["p_size", "p_retailprice"], base, ["p_partkey"], EX.linear_score(_W, 1.0))
    return out.withColumn("contribution", F.round("contribution", 6))


@register("row_at", "select * from orders order by o_orderkey limit 1 offset 100")
def q_row_at(spark, sf):
    return EX.row_at(load(spark, sf, "orders"), "o_orderkey", 100)


@register("predict")
def q_predict(spark, sf):
    p, feats, m = _fit_doc(spark, sf)
    bundle = SC.Bundle(p.model, m, feats, "quality")
    new = view(spark, sf, "doc_labels")
    return SC.predict(bundle, new)


_EXPECTED = ["o_orderkey", "o_custkey", "o_totalprice", "o_comment"]


@register("check_features", f"""with have as (select column_name from information_schema.columns where table_name = 'orders'),
want as (select unnest([{", ".join(f"'{c}'" for c in _EXPECTED)}]) as column_name),
n as ({" union all ".join(f"select '{c}' as column_name, cast(count({c}) as bigint) as value_count from orders"
                          for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))})
select coalesce(h.column_name, w.column_name) as column_name, n.value_count,
 case when h.column_name is not null and w.column_name is not null then 'ok' when w.column_name is not null then 'missing' else 'extra' end as status
from have h full join want w on h.column_name = w.column_name
left join n on n.column_name = h.column_name""")
def q_check_features(spark, sf):
    df = load(spark, sf, "orders")
    present = value_presence(df).select("column_name", "value_count")
    return SC.check_features(df, _EXPECTED).join(present, "column_name", "left").select("column_name", "value_count", "status")


@register("decode_labels", """with l as (select label, cast(row_number() over (order by label) - 1 as integer) as idx
  from (select distinct o_orderpriority as label from orders where o_orderpriority is not null) t)
select o.o_orderkey, l.label as prediction from orders o left join l on cast(o.o_orderkey % 5 as integer) = l.idx""")
def q_decode_labels(spark, sf):
    orders = load(spark, sf, "orders")
    labels = PR.label_index(orders, "o_orderpriority")
    pred = orders.select("o_orderkey", (F.col("o_orderkey") % 5).alias("prediction"))
    return SC.decode_labels(pred, "prediction", labels)


@register("predict_layout", with_views("scored") + 'select doc_id, y, pred as "y(predicted)", score from scored')
def q_predict_layout(spark, sf):
    return SC.layout_predictions(view(spark, sf, "scored"), "y", "pred")


def _line_xy(spark, sf):
    return load(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))


def _fitted(spark, df, algo, hp, digits):
    m = TR.fit(algo, df, ["l_quantity"], "regression", hp).stages[-1]
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "coefficient double, intercept double") \
        .select(F.round("coefficient", digits).alias("coefficient"), F.round("intercept", digits).alias("intercept"))


_XY = """with m as (select avg(l_quantity) as mx, avg(l_extendedprice) as my, count(*) as n from lineitem),
s as (select sum((l_quantity - mx) * (l_extendedprice - my)) as sxy, sum((l_quantity - mx) * (l_quantity - mx)) as sxx from lineitem, m),
"""


@register("ridge", _XY + """b as (select sxy / (sxx + 10.0) as b from s)
select round(b, 1) as coefficient, round(my - b * mx, 1) as intercept from b, m""")
def q_ridge(spark, sf):
    return _fitted(spark, _line_xy(spark, sf), "ridge", {"alpha": 10.0}, 1)


@register("lasso", _XY + """b as (select sign(sxy) * greatest(abs(sxy) / n - 1.0, 0) / (sxx / n) as b from s, m)
select round(b, 1) as coefficient, round(my - b * mx, 1) as intercept from b, m""")
def q_lasso(spark, sf):
    return _fitted(spark, _line_xy(spark, sf), "lasso", {"alpha": 1.0}, 1)


@register("replay_run", with_views("doc_labels") + "select doc_id, true as same from doc_labels")
def q_replay_run(spark, sf):
    """A run is written, read back and replayed on the raw rows; its
    predictions equal those of the run itself."""
    from ..config import CleaningConfig
    from .cleaning import clean
    from .manifest import replay, write_manifest
    from .q_io import scratch

    raw = view(spark, sf, "doc_labels")
    cfg = CleaningConfig(drop_constant_columns=False)
    p = prepare(clean(raw, cfg, key="doc_id").data, PipelineConfig(target_column="quality", key_columns=("doc_id",)))
    feats = p.model.feature_names()
    m = TR.fit("logistic_regression", p.train, feats, "classification")
    bundle, path = SC.Bundle(p.model, m, feats, "quality"), scratch(spark) + "/run"
    write_manifest(spark, path, cfg, "doc_id", bundle, raw.columns, {"algorithm": "logistic_regression"})
    own = SC.predict(bundle, clean(raw, cfg, key="doc_id").data).select("doc_id", F.col("quality(predicted)").alias("a"))
    again = replay(spark, path, raw).select("doc_id", F.col("quality(predicted)").alias("b"))
    return own.join(again, "doc_id", "full").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"))
