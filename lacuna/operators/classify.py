"""Imputation by a trained classifier: decision tree, random forest, perceptron."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import Encoder, as_encoder, category_of, code_of

from .clean import feature_array, feature_width
from .missing import in_training_part

# How rows are chosen for training and imputing.
#   known:  train on all rows with a known target, impute all missing ones.
#   compat: train on 70 % of all rows, with "missing" as a class of its own
#           (code 0), and impute only the missing rows of the other 30 %.
MODES = ("known", "compat")
# Settings of the learners that results are compared at. They are
# the defaults below: depth 5, 32 bins, 10 trees; 5 hidden units, 145 iterations,
# blocks of 128 rows, seed 1234.


@dataclass(frozen=True)
class TrainingPlan:
    """Rows to learn from, rows to fill, and how labels map to codes."""

    train: DataFrame
    ask: DataFrame
    classes: int
    first_code: int
    width: int


def plan_training(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    codes: Mapping[str, int] | Encoder,
    mode: str = "known",
    split_seed: int = 1234,
    row_id: str = "line_id",
) -> TrainingPlan:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    encoder = as_encoder(codes)
    rows = feature_array(df, features, target, row_id).select(
        "line_id",
        "value",
        code_of(F.col("value"), encoder.encode).alias("code"),
        array_to_vector("features").alias("features"),
    )
    if mode == "known":
        train, ask, first_code = rows.where("code > 0"), rows.where("value IS NULL"), 1
    else:
        training = in_training_part(70, split_seed)
        train, ask, first_code = rows.where(training), rows.where(~training & (F.col("code") == 0)), 0
    classes = encoder.classes + 1 - first_code
    # Naming the classes in the column's metadata spares the learner a pass
    # over the data to count them.
    nominal = {"ml_attr": {"type": "nominal", "vals": [str(c + first_code) for c in range(classes)]}}
    label = (F.col("code") - first_code).alias("label", metadata=nominal)
    return TrainingPlan(train.select(label, "features"), ask.select("line_id", "features"), classes, first_code, feature_width(df, features))


def impute_by(estimator: Estimator, plan: TrainingPlan, codes: Mapping[str, int] | Encoder) -> DataFrame:
    """Fit on the training rows; ``line_id, imputed_value, imputed_code`` for the rest.

    A predicted code 0 (possible in compat mode) has no category and gives null.
    """
    predicted = estimator.fit(plan.train).transform(plan.ask)
    code = F.col("prediction") + plan.first_code
    return predicted.select(
        "line_id",
        category_of(code, as_encoder(codes).codes).alias("imputed_value"),
        code.alias("imputed_code"),
    )


def tree_impute(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    codes: Mapping[str, int] | Encoder,
    *,
    mode: str = "known",
    impurity: str = "gini",
    max_depth: int = 5,
    max_bins: int = 32,
    seed: int = 42,
    row_id: str = "line_id",
) -> DataFrame:
    """Decision-tree imputation; all features are continuous."""
    plan = plan_training(df, features, target, codes, mode, row_id=row_id)
    tree = DecisionTreeClassifier(impurity=impurity, maxDepth=max_depth, maxBins=max_bins, seed=seed)
    return impute_by(tree, plan, codes)


def forest_impute(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    codes: Mapping[str, int] | Encoder,
    *,
    mode: str = "known",
    num_trees: int = 10,
    feature_subset: str = "auto",
    bootstrap: bool = True,
    impurity: str = "gini",
    max_depth: int = 5,
    max_bins: int = 32,
    seed: int = 42,
    row_id: str = "line_id",
) -> DataFrame:
    """Random-forest imputation."""
    plan = plan_training(df, features, target, codes, mode, row_id=row_id)
    forest = RandomForestClassifier(
        numTrees=num_trees,
        featureSubsetStrategy=feature_subset,
        bootstrap=bootstrap,
        impurity=impurity,
        maxDepth=max_depth,
        maxBins=max_bins,
        seed=seed,
    )
    return impute_by(forest, plan, codes)


def perceptron_impute(
    df: DataFrame,
    features: Sequence[str] | str,
    target: str,
    codes: Mapping[str, int] | Encoder,
    *,
    mode: str = "known",
    layers: Sequence[int] | None = None,
    block_size: int = 128,
    max_iter: int = 145,
    standardize: bool = False,
    seed: int = 1234,
    row_id: str = "line_id",
) -> DataFrame:
    """Multilayer-perceptron imputation, by default with one hidden layer of 5."""
    plan = plan_training(df, features, target, codes, mode, row_id=row_id)
    layers = list(layers or (plan.width, 5, plan.classes))
    if layers[0] != plan.width or layers[-1] != plan.classes:
        raise ValueError(
            f"layers {layers} must start with {plan.width} (features) and end with {plan.classes} (classes)"
        )
    if standardize:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(plan.train)

        def scale(rows):
            return scaler.transform(rows).drop("features").withColumnRenamed("scaled", "features")

        plan = TrainingPlan(scale(plan.train), scale(plan.ask), plan.classes, plan.first_code, plan.width)
    perceptron = MultilayerPerceptronClassifier(layers=layers, blockSize=block_size, maxIter=max_iter, seed=seed)
    return impute_by(perceptron, plan, codes)
