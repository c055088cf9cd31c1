"""Registered evaluation queries (M25-M35) with DuckDB oracles."""

from __future__ import annotations

from ..operators import evaluate as EV
from .fixtures import view, with_views
from .registry import register

_PC = with_views("scored") + """, pairs as (select cast(y as varchar) as a, cast(pred as varchar) as p, count(*) as c from scored group by 1, 2),
sup as (select a as label, sum(c) as support from pairs group by 1), prd as (select p as label, sum(c) as predicted from pairs group by 1),
tpc as (select a as label, sum(c) as tp from pairs where a = p group by 1),
pc as (select coalesce(sup.label, prd.label) as label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted
       from sup full join prd on sup.label = prd.label),
pc2 as (select pc.*, coalesce(tpc.tp, 0) as tp from pc left join tpc on tpc.label = pc.label),
s as (select *, case when predicted > 0 then tp / predicted else 0.0 end as prec, case when support > 0 then tp / support else 0.0 end as rec from pc2),
f as (select *, case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0.0 end as f1 from s)
"""

_SCORES = with_views("scored") + """, t as (select score, sum(case when y = 1 then 1 else 0 end) as pos, sum(case when y = 1 then 0 else 1 end) as neg
 from scored where score is not null group by score)
"""


@register("classification_metrics", _PC + """select round(sum(tp) / sum(support), 4) as accuracy,
 round(sum(prec * support) / sum(support), 4) as precision, round(sum(rec * support) / sum(support), 4) as recall,
 round(sum(f1 * support) / sum(support), 4) as f1_score from f""")
def q_classification_metrics(spark, sf):
    return EV.classification_metrics(view(spark, sf, "scored"))


@register("confusion_matrix", with_views("scored") + """, l as (select distinct cast(y as varchar) as v from scored union select distinct cast(pred as varchar) from scored),
c as (select cast(y as varchar) as actual, cast(pred as varchar) as predicted, count(*) as n from scored group by 1, 2)
select a.v as actual, b.v as predicted, cast(coalesce(c.n, 0) as bigint) as count from l a cross join l b
 left join c on c.actual = a.v and c.predicted = b.v""")
def q_confusion_matrix(spark, sf):
    return EV.confusion_matrix(view(spark, sf, "scored"))


@register("classification_report", _PC + """, tot as (select sum(support) as n, sum(tp) as tp, avg(prec) as mp, avg(rec) as mr, avg(f1) as mf,
 sum(prec * support) as wp, sum(rec * support) as wr, sum(f1 * support) as wf from f)
select label, round(prec, 4) as precision, round(rec, 4) as recall, round(f1, 4) as f1_score, cast(support as bigint) as support from f
union all select 'accuracy', null, null, round(tp / n, 4), cast(n as bigint) from tot
union all select 'macro avg', round(mp, 4), round(mr, 4), round(mf, 4), cast(n as bigint) from tot
union all select 'weighted avg', round(wp / n, 4), round(wr / n, 4), round(wf / n, 4), cast(n as bigint) from tot""")
def q_classification_report(spark, sf):
    return EV.classification_report(view(spark, sf, "scored"))


@register("roc_auc", _SCORES + """, c as (select *, sum(neg) over (order by score rows between unbounded preceding and current row) as cum_neg from t)
select round(sum(pos * (cum_neg - neg + neg * 0.5)) / (sum(pos) * sum(neg)), 4) as roc_auc from c""")
def q_roc_auc(spark, sf):
    return EV.roc_auc(view(spark, sf, "scored"))


_OVR = with_views("scored3") + """, l as (select 'F' as cls, cast(y = 'F' as int) as yb, p_f as score from scored3
 union all select 'O', cast(y = 'O' as int), p_o from scored3 union all select 'P', cast(y = 'P' as int), p_p from scored3),
t as (select cls, score, sum(yb) as pos, sum(1 - yb) as neg from l group by cls, score),
c as (select *, sum(pos) over w as cp, sum(neg) over w as cn, sum(pos) over (partition by cls) as p, sum(neg) over (partition by cls) as n
 from t window w as (partition by cls order by score desc rows between unbounded preceding and current row))
"""
_CLASSES = {"F": "p_f", "O": "p_o", "P": "p_p"}


def _ovr(spark, sf):
    return EV.one_vs_rest(view(spark, sf, "scored3"), "y", _CLASSES)


@register("roc_curve_ovr", _OVR + """select cls, score as threshold, round(cn / n, 6) as fpr, round(cp / p, 6) as tpr from c
union all select distinct cls, null, 0.0, 0.0 from l""")
def q_roc_curve_ovr(spark, sf):
    return EV.roc_curve(_ovr(spark, sf), "yb", "score", 1, ["cls"])


@register("pr_curve_ovr", _OVR + """select cls, score as threshold, round(cp / (cp + cn), 6) as precision, round(cp / p, 6) as recall from c
union all select distinct cls, null, 1.0, 0.0 from l""")
def q_pr_curve_ovr(spark, sf):
    return EV.pr_curve(_ovr(spark, sf), "yb", "score", 1, ["cls"])


@register("average_precision_ovr", _OVR + "select cls, round(sum(pos * cp / (cp + cn)) / sum(pos), 4) as average_precision from c group by cls")
def q_average_precision_ovr(spark, sf):
    return EV.average_precision(_ovr(spark, sf), "yb", "score", 1, ["cls"])


@register("roc_auc_ovr", _OVR + """, a as (select cls, round(sum(pos * (n - cn + neg * 0.5)) / (max(p) * max(n)), 4) as auc, max(p) as support from c group by cls)
select round(sum(auc * support) / sum(support), 4) as roc_auc from a""")
def q_roc_auc_ovr(spark, sf):
    return EV.roc_auc_ovr(view(spark, sf, "scored3"), "y", _CLASSES)


@register("roc_curve", _SCORES + """, c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cp,
 sum(neg) over (order by score desc rows between unbounded preceding and current row) as cn from t),
tot as (select sum(pos) as p, sum(neg) as n from t)
select score as threshold, round(cn / n, 6) as fpr, round(cp / p, 6) as tpr from c cross join tot
union all select null, 0.0, 0.0""")
def q_roc_curve(spark, sf):
    return EV.roc_curve(view(spark, sf, "scored"))


@register("pr_curve", _SCORES + """, c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cp,
 sum(neg) over (order by score desc rows between unbounded preceding and current row) as cn from t),
tot as (select sum(pos) as p from t)
select score as threshold, round(cp / (cp + cn), 6) as precision, round(cp / p, 6) as recall from c cross join tot
union all select null, 1.0, 0.0""")
def q_pr_curve(spark, sf):
    return EV.pr_curve(view(spark, sf, "scored"))


@register("average_precision", _SCORES + """, c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cp,
 sum(neg) over (order by score desc rows between unbounded preceding and current row) as cn from t)
select round(sum(pos * cp / (cp + cn)) / sum(pos), 4) as average_precision from c""")
def q_average_precision(spark, sf):
    return EV.average_precision(view(spark, sf, "scored"))


@register("is_imbalanced", with_views("scored") + """, c as (select y, count(*) as c from scored where y is not null group by y)
select round(max(c) / min(c), 4) as ratio, count(*) >= 2 and max(c) / min(c) > 2.0 as is_imbalanced from c""")
def q_is_imbalanced(spark, sf):
    return EV.is_imbalanced(view(spark, sf, "scored"))


@register("regression_metrics", with_views("reg_scored") + """, e as (select cast(y as double) as y, cast(y as double) - cast(pred as double) as e from reg_scored),
a as (select avg(e * e) as mse, avg(abs(e)) as mae, sum(e * e) as ss_res, var_pop(y) * count(*) as ss_tot,
 avg(abs(e) / greatest(abs(y), 2.220446049250313e-16)) as mape from e)
select round(sqrt(mse), 4) as rmse, round(mae, 4) as mae,
 round(case when ss_tot > 0 then 1 - ss_res / ss_tot when ss_res = 0 then 1.0 else 0.0 end, 4) as r2, round(mape, 4) as mape from a""")
def q_regression_metrics(spark, sf):
    return EV.regression_metrics(view(spark, sf, "reg_scored"))


@register("residuals", with_views("reg_scored") + """select l_orderkey, l_linenumber, cast(y as double) as actual,
 cast(pred as double) as predicted, cast(y as double) - cast(pred as double) as residual from reg_scored""")
def q_residuals(spark, sf):
    return EV.residuals(view(spark, sf, "reg_scored"), keys=["l_orderkey", "l_linenumber"])


@register("residual_histogram", with_views("reg_scored") + """, r as (select y - pred as r from reg_scored),
p as (select min(r) as lo, max(r) as hi, (max(r) - min(r)) / 20 as w from r),
b as (select least(19, cast(floor((r - lo) / w) as integer)) as bin, count(*) as c from r cross join p where r is not null group by 1)
select cast(g.i as integer) as bin, round((lo + g.i * w + case when g.i = 19 then hi else lo + (g.i + 1) * w end) / 2.0, 6) as center,
 cast(coalesce(c, 0) as bigint) as count from range(20) g(i) cross join p left join b on b.bin = g.i""")
def q_residual_histogram(spark, sf):
    return EV.residual_histogram(view(spark, sf, "reg_scored"))
