"""Validated configuration records (names, defaults and allowed values follow
the reference's request schemas)."""

from __future__ import annotations

from dataclasses import dataclass, field

MISSING_STRATEGIES = ("drop_row", "drop_column", "mean", "median", "mode", "knn", "ffill", "bfill")
OUTLIER_STRATEGIES = ("winsorize", "remove", "leave")


def _check(value, allowed, what):
    if value not in allowed:
        raise ValueError(f"{what} must be one of {allowed}, got {value!r}")


@dataclass(frozen=True)
class MissingStrategy:
    column: str
    strategy: str

    def __post_init__(self):
        _check(self.strategy, MISSING_STRATEGIES, "missing strategy")


@dataclass(frozen=True)
class OutlierStrategy:
    column: str
    strategy: str

    def __post_init__(self):
        _check(self.strategy, OUTLIER_STRATEGIES, "outlier strategy")


@dataclass(frozen=True)
class CleaningConfig:
    remove_duplicates: bool = True
    missing_strategies: tuple = ()
    outlier_strategies: tuple = ()
    fix_dtype_issues: bool = True
    standardize_categorical: bool = True
    drop_constant_columns: bool = True
    name: str | None = None
    # order keys for order-sensitive steps (ffill/bfill); partition keys optional
    order_by: tuple = ()
    partition_by: tuple = ()


@dataclass(frozen=True)
class EncodingConfig:
    strategy: str = "auto"
    passthrough_columns: tuple = ()
    scale_columns: tuple | None = None

    def __post_init__(self):
        _check(self.strategy, ("auto", "one_hot", "target", "frequency"), "encoding strategy")


@dataclass(frozen=True)
class ImputationConfig:
    strategy: str = "none"
    scope: str = "all"

    def __post_init__(self):
        _check(self.strategy, ("none", "mean", "median", "most_frequent"), "imputation strategy")
        _check(self.scope, ("all", "numeric", "categorical"), "imputation scope")


@dataclass(frozen=True)
class SplitConfig:
    test_size: float = 0.2
    random_seed: int = 42
    stratify: bool = True
    strategy: str = "random"
    datetime_column: str | None = None

    def __post_init__(self):
        if not 0 <= self.test_size <= 1:
            raise ValueError("test_size must be in [0, 1]")
        _check(self.strategy, ("random", "chronological"), "split strategy")


@dataclass(frozen=True)
class FeatureSelectionConfig:
    enabled: bool = False
    drop_near_zero_variance: bool = False
    variance_threshold: float = 0.01
    drop_high_correlation: bool = False
    correlation_threshold: float = 0.95


@dataclass(frozen=True)
class PipelineConfig:
    target_column: str
    problem_type: str | None = None
    encoding: EncodingConfig = field(default_factory=EncodingConfig)
    imputation: ImputationConfig = field(default_factory=ImputationConfig)
    scaling: str = "auto"
    split: SplitConfig = field(default_factory=SplitConfig)
    feature_selection: FeatureSelectionConfig = field(default_factory=FeatureSelectionConfig)
    use_smote: bool = False
    use_class_weight: bool = False
    key_columns: tuple = ()

    def __post_init__(self):
        _check(self.scaling, ("auto", "standard", "minmax", "robust"), "scaling")
        if self.problem_type is not None:
            _check(self.problem_type, ("classification", "regression"), "problem type")


@dataclass(frozen=True)
class TrainingConfig:
    target_column: str
    algorithms: tuple = ()
    cv_folds: int = 5
    primary_metric: str | None = None
    tuning_enabled: bool = True
    test_size: float = 0.2
    random_seed: int = 42
    hyperparameters: dict = field(default_factory=dict)

    def __post_init__(self):
        if not 2 <= self.cv_folds <= 10:
            raise ValueError("cv_folds must be between 2 and 10")
