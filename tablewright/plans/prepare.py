"""Assemble a feature matrix: split, impute, select, encode, scale
(all fitted on the train split only), optional SMOTE; plus the fitted
preprocessor that scores new data and can be saved / loaded."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions.columns import dtype_of, is_measure, is_text
from ..functions.cardinality import distinct_counts
from ..operators import prepare as PR
from ..operators import split as SP


@dataclass
class FittedPreprocessor:
    target: str
    problem_type: str
    labels: DataFrame | None = None  # (label, index) of a classification
    impute: dict = field(default_factory=dict)
    dropped: list = field(default_factory=list)
    one_hot: dict = field(default_factory=dict)
    target_maps: dict = field(default_factory=dict)     # col -> (DataFrame, global, rows)
    freq_maps: dict = field(default_factory=dict)       # col -> (DataFrame, rows)
    scaler_kind: str = "standard"
    scaler: dict = field(default_factory=dict)
    passthrough: list = field(default_factory=list)
    after_drop: list = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    def feature_names(self) -> list:
        names = [f"{c}_{v}" for c, vals in self.one_hot.items() for v in vals]
        names += [c if self.problem_type == "classification" else f"__target_enc_{c}" for c in self.target_maps]
        names += list(self.scaler)
        names += [f"__freq_enc_{c}" for c in self.freq_maps]
        names += list(self.passthrough)
        return [n for n in names if n not in self.after_drop]

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """One projection (+ a lookup join per map encoder)."""
        keep = [c for c in (keep or []) if c in df.columns]
        w = PR.apply_imputer(df, self.impute) if self.impute else df
        for c, (m, g, rows) in self.target_maps.items():
            out = c if self.problem_type == "classification" else f"__target_enc_{c}"
            w = PR.apply_map(w, c, m, rows, f"__enc_{c}", g).withColumnRenamed(f"__enc_{c}", f"__t_{out}")
        for c, (m, rows) in self.freq_maps.items():
            w = PR.apply_map(w, c, m, rows, f"__f_{c}", 0.0)
        cols = PR.one_hot_columns(self.one_hot)
        cols += [F.col(f"__t_{c if self.problem_type == 'classification' else f'__target_enc_{c}'}")
                 .alias(c if self.problem_type == "classification" else f"__target_enc_{c}") for c in self.target_maps]
        cols += PR.scaled_columns(self.scaler)
        cols += [F.col(f"__f_{c}").alias(f"__freq_enc_{c}") for c in self.freq_maps]
        cols += [F.col(c) for c in self.passthrough]
        extra = []
        if self.target in df.columns:
            extra.append(F.col(self.target))
            if self.problem_type == "classification":
                w = PR.encode_label(w, self.target, self.labels, "__label_code")
                extra.append(F.col("__label_code").alias("label"))
            else:
                extra.append(F.col(self.target).cast("double").alias("label"))
        out = w.select(*[F.col(k) for k in keep], *cols, *extra)
        return out.drop(*self.after_drop) if self.after_drop else out

    def save(self, path: str) -> None:
        """K7: JSON spec + one Parquet file per fitted map (cluster paths)."""
        spark = None
        spec = {k: getattr(self, k) for k in ("target", "problem_type", "impute", "dropped", "one_hot",
                                                "scaler_kind", "scaler", "passthrough", "after_drop", "notes")}
        spec["labelled"] = self.labels is not None
        if self.labels is not None:
            spark = self.labels.sparkSession
            self.labels.write.mode("overwrite").parquet(f"{path}/labels")
        spec["target_globals"] = {c: g for c, (_, g, _) in self.target_maps.items()}
        spec["freq_cols"] = list(self.freq_maps)
        for c, (m, _, _) in self.target_maps.items():
            spark = m.sparkSession
            m.write.mode("overwrite").parquet(f"{path}/target_map/{c}")
        for c, (m, _) in self.freq_maps.items():
            spark = m.sparkSession
            m.write.mode("overwrite").parquet(f"{path}/freq_map/{c}")
        spark = spark or SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(spec, default=str),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedPreprocessor":
        spec = json.loads(spark.read.text(f"{path}/spec").collect()[0][0])
        fp = FittedPreprocessor(spec["target"], spec["problem_type"],
                                spark.read.parquet(f"{path}/labels") if spec["labelled"] else None, spec["impute"], spec["dropped"],
                                spec["one_hot"], {}, {}, spec["scaler_kind"],
                                {k: tuple(v) for k, v in spec["scaler"].items()}, spec["passthrough"],
                                spec["after_drop"], spec["notes"])
        for c, g in spec["target_globals"].items():
            m = spark.read.parquet(f"{path}/target_map/{c}")
            fp.target_maps[c] = (m, g, m.count())
        for c in spec["freq_cols"]:
            m = spark.read.parquet(f"{path}/freq_map/{c}")
            fp.freq_maps[c] = (m, m.count())
        return fp


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    model: FittedPreprocessor
    column_mapping: DataFrame
    summary: DataFrame
    selection_report: DataFrame | None = None
    balance: DataFrame | None = None


def prepare(df: DataFrame, cfg: PipelineConfig, fit_on: str = "train") -> Prepared:
    """Split -> impute -> select -> encode -> scale -> (SMOTE)."""
    spark = df.sparkSession
    y = cfg.target_column
    if y not in df.columns:
        raise ValueError(f"Target column '{y}' not found in dataset")
    problem = cfg.problem_type or PR.detect_problem_type(df, y)
    if problem == "invalid":
        raise ValueError(f"Target column '{y}' has fewer than 2 unique values")
    key = list(cfg.key_columns)
    balance = PR.class_balance(df, y)[1] if problem == "classification" else None

    # split first so every statistic below is fitted on train rows only
    sc = cfg.split
    if sc.test_size <= 0:
        train, test = df, df.limit(0)
    elif sc.strategy == "chronological" and sc.datetime_column and sc.datetime_column in df.columns:
        train, test = SP.split_chronological(df, sc.datetime_column, sc.test_size, key[0])
    else:
        strat = y if (problem == "classification" and sc.stratify) else None
        train, test = SP.split(df, sc.test_size, sc.random_seed, key, strat)
    train = train.persist()
    fit_df = df if fit_on == "all" else train

    features = [c for c in df.columns if c != y and c not in key]
    imp = cfg.imputation
    if imp.strategy in (None, "none"):
        PR.assert_no_missing(df, features)
        values = {}
    else:
        values = PR.fit_imputer(fit_df.select(*features), imp.strategy, imp.scope)
    fit_x = PR.apply_imputer(fit_df, values) if values else fit_df

    fs = cfg.feature_selection
    dropped, report = [], None
    if fs.enabled:
        parts = []
        if fs.drop_near_zero_variance:
            parts.append(PR.low_variance(fit_x.select(*features), fs.variance_threshold)
                         .select(F.lit("near_zero_variance").alias("kind"), "column_name", "reason"))
        if fs.drop_high_correlation:
            parts.append(PR.correlated_drops(fit_x.select(*features), fs.correlation_threshold)
                         .select(F.lit("high_correlation").alias("kind"), "column_name", "reason"))
        if parts:
            report = parts[0]
            for p in parts[1:]:
                report = report.unionByName(p)
            dropped = sorted({r[0] for r in report.select("column_name").collect()})
    features = [c for c in features if c not in dropped]

    enc = cfg.encoding
    passthrough = [c for c in enc.passthrough_columns if c in features]  # P20: neither encoded nor scaled
    texts = [c for c in features if is_text(dtype_of(df, c)) and c not in passthrough]
    numeric = [c for c in features if is_measure(dtype_of(df, c))]
    scale_cols = [c for c in (enc.scale_columns if enc.scale_columns is not None else numeric)
                  if c in numeric and c not in passthrough]
    labels = PR.label_dictionary(fit_x, y) if problem == "classification" else None
    if labels is not None:
        fit_x = PR.encode_label(fit_x, y, labels, "__y")
    y_val = F.col("__y") if labels is not None else F.col(y).cast("double")
    card = distinct_counts(fit_x, texts) if texts else {}
    n_classes = labels.count() if labels is not None else 0
    strategies = {c: (PR.suggest_encoding(card[c], problem, n_classes) if enc.strategy == "auto" else enc.strategy)
                  for c in texts}
    notes = {c: f"{s} (cardinality={card[c]})" for c, s in strategies.items()}
    oh = PR.fit_one_hot(fit_x, [c for c in texts if strategies[c] == "one_hot"])
    tmaps, fmaps = {}, {}
    for c in texts:
        if strategies[c] == "target":
            tmaps[c] = PR.fit_target_mean(fit_x, c, y_val)
        elif strategies[c] == "frequency":
            fmaps[c] = PR.fit_frequency(fit_x, c)
            notes[c] = f"frequency-encoded into __freq_enc_{c}"
    kind = cfg.scaling
    if kind == "auto":
        kind = PR.auto_scaler(fit_x, scale_cols)
    scaler = PR.fit_scaler(fit_x, scale_cols, kind)
    notes.update({c: f"scaled ({cfg.scaling})" for c in scale_cols})
    model = FittedPreprocessor(y, problem, labels, values, dropped, oh, tmaps, fmaps, kind, scaler, passthrough, [], notes)

    tr = model.transform(train, keep=key)
    if fs.enabled and fs.drop_near_zero_variance:
        model.after_drop = PR.variance_threshold(tr, model.feature_names(), fs.variance_threshold)
        tr = tr.drop(*model.after_drop)
    te = model.transform(test, keep=key)
    if cfg.use_smote and problem == "classification":
        tr = SP.smote(tr, "label", model.feature_names(), key[0], seed=sc.random_seed).drop("synthetic")

    mapping = []  # P34: column roles
    for c in [c for c in df.columns if c != y]:
        if c in dropped:
            mapping.append((c, "dropped (feature selection)"))
        elif c in notes:
            mapping.append((c, notes[c]))
        elif c in passthrough:
            mapping.append((c, "passthrough"))
        elif c in key:
            mapping.append((c, "key"))
        else:
            mapping.append((c, "dropped (not routed)"))
    mapping_df = spark.createDataFrame(mapping, "column_name string, role string")
    n_tr, n_te = tr.count(), te.count()  # P35: summary
    summary = spark.createDataFrame([(y, problem, n_tr, n_te, len(model.feature_names()), kind)],
                                    "target_column string, problem_type string, train_rows bigint, test_rows bigint, "
                                    "feature_count int, scaler string")
    return Prepared(tr, te, model, mapping_df, summary, report, balance)


def write_splits(prep: Prepared, path: str) -> None:
    """K2: train / test as Parquet; an empty test split is a zero-row file
    that keeps the schema."""
    prep.train.write.mode("overwrite").parquet(f"{path}/train")
    prep.test.write.mode("overwrite").parquet(f"{path}/test")


def read_splits(spark: SparkSession, path: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Read back processed splits; the target must be present."""
    tr, te = spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")
    if target not in tr.columns:
        raise ValueError(f"target '{target}' missing from processed splits")
    return tr, te
