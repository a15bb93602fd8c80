"""Training, comparison, calibration and scoring with Spark ML."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, ProbabilisticClassificationModel,
    RandomForestClassificationModel, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import SEARCH_TRIALS, SEED, THRESHOLD_GRID
from ..functions.digests import hash_rank_key
from ..functions.permute import with_permuted_position
from ..functions.vectors import argmax_index, cascade, literal_array, threshold_argmax, top_by_magnitude
from ..sources.tables import dealt, share_sizes
from .cleaning import impute, mask_outliers, severity
from .distributed import HASH_BUCKET_CHARS, null_safe_join, running_totals
from .gate import anchor_flag
from .metrics import class_weights, confusion, multiclass_metrics, per_class_f1

Builder = Callable[[int, int], Estimator]


# --- pipelines ---------------------------------------------------------------------------------
def prepared(df: DataFrame, features: list[str], label: str, classes: list[str], unknown: str = "error") -> DataFrame:
    """Add ``features`` and a numeric ``label`` whose order is that of ``classes``.

    A label that is null or not among them fails the job, so fits take ``known_labels`` and report
    ``label_rejects``. For an evaluation, ``unknown="keep"`` gives such rows a label that no model
    predicts: they count, as wrong.
    """
    return indexed(assembled(df, features), label, classes, unknown)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def indexed(df: DataFrame, label: str, classes: list[str], unknown: str = "error") -> DataFrame:
    return StringIndexerModel.from_labels(classes, inputCol=label, outputCol="label", handleInvalid=unknown).transform(df)


def known_labels(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    return df.where(F.coalesce(F.col(label).isin(*classes), F.lit(False)))


def label_rejects(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """(label, n): rows that no fit uses, because their label is null or not among ``classes``."""
    bad = df.where(~F.coalesce(F.col(label).isin(*classes), F.lit(False)))
    return bad.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def with_balanced_weight(df: DataFrame, label: str) -> DataFrame:
    """Attach n / (k * n_c) per class; a null label is a class of its own.

    The weights, one row per class, go to the rows. A join that moved the rows would deal them by class, and every fit
    would run in as many tasks as there are classes.
    """
    weights = class_weights(df, label).select(label, "weight")
    return null_safe_join(df, F.broadcast(weights), [label])


@contextmanager
def held_rows(df: DataFrame, features: list[str], label: str, classes: list[str]) -> Iterator[DataFrame]:
    """The columns and rows that a fit reads, kept while it runs.

    A fit asks its table four times for rows: its log and its summary too, and each of them would deal the table anew.
    """
    kept = known_labels(df, label, classes).select(*dict.fromkeys([label, *features])).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def weighted_shares(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """Rows with a known label and their balanced ``weight``, in shares of bounded size, since learners hold a whole share in memory.

    One pass over the labels gives the size of the shares and the weights, one per class, which are literals of the rows' plan.
    """
    known = known_labels(df, label, classes)
    per_share = known.groupBy(F.spark_partition_id().alias("_share")).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(classes)])
    found = per_share.agg(*share_sizes(), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(classes))]).first()
    counts = {c: found[f"_n{i}"] for i, c in enumerate(classes)}
    return dealt(known, found["_parts"], found["_rows"], found["_largest"]).withColumn("weight", class_weight(F.col(label), counts))


def class_weight(label: Column, counts: dict) -> Column:
    """n / (k * n_c) as literals, from the rows of every class; null for a class that is not among them."""
    present = {c: n for c, n in counts.items() if n}
    weight = F.lit(None).cast("double")
    for c, n in present.items():
        weight = F.when(label == c, F.lit(sum(present.values()) / float(len(present) * n))).otherwise(weight)
    return weight


def fitting_rows(df: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """The rows of a fit: ``weighted_shares``, prepared."""
    out = prepared(weighted_shares(df, label, classes), features, label, classes)
    return out.select(*[c for c in out.columns if c != "weight"], "weight")


# Gradient boosting in Spark ML is binary, so one-vs-rest stands in for multiclass boosting.
BUILDERS: dict[str, Builder] = {
    "logreg": lambda n_features, n_classes: Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled"),
        LogisticRegression(featuresCol="scaled", weightCol="weight", maxIter=50, family="multinomial"),
    ]),
    "randomforest": lambda n_features, n_classes: RandomForestClassifier(
        weightCol="weight", numTrees=20, maxDepth=6, seed=SEED),
    "boosted_ovr": lambda n_features, n_classes: OneVsRest(
        classifier=GBTClassifier(maxIter=10, maxDepth=4, seed=SEED), weightCol="weight", parallelism=2),
    "mlp": lambda n_features, n_classes: Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
        MultilayerPerceptronClassifier(featuresCol="scaled", layers=[n_features, 16, n_classes], maxIter=30, seed=SEED),
    ]),
}


def fit_forest(train: DataFrame, features: list[str], label: str, classes: list[str]) -> RandomForestClassificationModel:
    with held_rows(train, features, label, classes) as kept:
        return BUILDERS["randomforest"](len(features), len(classes)).fit(fitting_rows(kept, features, label, classes))


def predictions(scored: DataFrame, model: str, classes: list[str], truth: str, keep: list[str] | None = None) -> DataFrame:
    names = literal_array(classes)
    return scored.select(
        *(keep or []), F.lit(model).alias("model"), F.col(truth).alias("y_true"), F.get(names, F.col("prediction").cast("int")).alias("y_pred")
    )


class CascadeModel:
    """Detector and namer fitted separately; their probabilities compose into one distribution."""

    def __init__(self, detector: Transformer, namer: Transformer, classes: list[str], benign: str):
        self.detector, self.namer, self.classes, self.benign = detector, namer, classes, benign

    def transform(self, df: DataFrame) -> DataFrame:
        first = self.detector.transform(df).withColumn("_attack", F.get(vector_to_array("probability"), F.lit(1)))
        second = self.namer.transform(first.drop("rawPrediction", "probability", "prediction"))
        prob = cascade(F.col("_attack"), vector_to_array("probability"), self.classes, self.benign)
        out = second.withColumn("prob", prob).drop("rawPrediction", "probability", "prediction", "_attack")
        return out.withColumn("prediction", argmax_index(F.col("prob")).cast("double"))


def fit_cascade(train: DataFrame, label: str, classes: list[str], benign: str, builder: Builder | None = None) -> CascadeModel:
    """Stage A: attack or benign over all rows. Stage B: the class, over attack rows only.

    One count gives the weights of both stages; as literals they cost a fit, which asks for its rows several times, no join.
    """
    make = builder or BUILDERS["randomforest"]
    attack_classes = [c for c in classes if c != benign]
    is_attack = F.when(F.col(label) == benign, 0.0).otherwise(1.0)
    found = train.agg(
        F.count_if(is_attack == 0.0).alias("_benign"), F.count_if(is_attack == 1.0).alias("_attacks"),
        *[F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(attack_classes)]).first()
    sides = class_weight(is_attack, {0.0: found["_benign"], 1.0: found["_attacks"]})
    detector = make(0, 2).fit(train.withColumn("label", is_attack).withColumn("weight", sides))
    index = F.array_position(literal_array(attack_classes), F.col(label)) - 1
    named = class_weight(F.col(label), {c: found[f"_n{i}"] for i, c in enumerate(attack_classes)})
    attacks = train.where(F.col(label) != benign).withColumn("label", index.cast("double")).withColumn("weight", named)
    namer = make(0, len(attack_classes)).fit(attacks)
    return CascadeModel(detector, namer, classes, benign)


def predicted_together(models: dict[str, Transformer], df: DataFrame) -> DataFrame:
    """``df`` with the prediction of every model in ``_y_<name>``, and none of the other columns that they add."""
    for name, model in models.items():
        out = labels_only(model).transform(df)
        df = out.select(*df.columns, F.col("prediction").alias(f"_y_{name}"))
    return df


def compare_models(
    train: DataFrame, test: DataFrame, features: list[str], label: str, classes: list[str], benign: str,
    builders: dict[str, Builder] | None = None,
) -> DataFrame:
    """Fit every builder plus the cascade and rank by macro-F1 on ``test``.

    What the fits share is kept as the plain columns that they read, which leaves more memory to what a fit keeps for itself than
    rows with vectors would. One pass over ``test`` has the predictions of all models.
    """
    kept = weighted_shares(train.select(*dict.fromkeys([label, *features])), label, classes).persist()
    fit_on = prepared(kept, features, label, classes).select("features", *dict.fromkeys([label, "label", "weight"]))
    try:
        models = {n: b(len(features), len(classes)).fit(fit_on) for n, b in (builders or BUILDERS).items()}
        models["cascade"] = fit_cascade(fit_on, label, classes, benign)
    finally:
        kept.unpersist()
    rows = assembled(test, features).select(F.col(label).alias("y_true"), "features")
    pairs = predicted_together(models, rows).groupBy("y_true", *[f"_y_{name}" for name in models]).agg(F.count("*").alias("n"))
    return multiclass_metrics(voted(pairs, list(models), classes), classes, ["model"])


def voted(pairs: DataFrame, models: list[str], classes: list[str]) -> DataFrame:
    """Confusion cells (model, y_true, y_pred, n) from counts by ``y_true`` and the models' predictions ``_y_<name>``."""
    names = literal_array(classes)
    votes = F.array(*[
        F.struct(F.lit(name).alias("model"), F.get(names, F.col(f"_y_{name}").cast("int")).alias("y_pred")) for name in models
    ])
    return confusion(pairs.select("y_true", "n", F.inline(votes)), weight=F.col("n"), by=["model"])


def feature_importance(train: DataFrame, features: list[str], label: str, classes: list[str]) -> DataFrame:
    """Impurity importance of a forest, one row per feature."""
    model = fit_forest(train, features, label, classes)
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return train.sparkSession.createDataFrame(rows, "feature string, importance double")


def permutation_importance(
    model: Transformer, df: DataFrame, row_id: str, features: list[str], label: str, classes: list[str],
    repeats: int = 5, seed: int = SEED,
) -> DataFrame:
    """(feature, importance): mean accuracy lost when one column is shuffled.

    Rows are ranked once, by a seeded hash of their id, in buckets, so that no task sorts the table. A repeat pairs every
    rank with the one that a keyed permutation of all ranks puts there (``functions.permute``): an exact shuffle without
    another ranking. A row goes to its own place and to the ``repeats`` places where its values stand in, all in one
    shuffle; ``repeats + 1`` rows meet at a place, whatever the table. Every variant of a row is scored once.
    """
    truth = indexed(df, label, classes, "keep").select(row_id, "label", *features)
    one = truth.withColumn("_one", F.lit(1).cast("long")).withColumn("_h", hash_rank_key(F.col(row_id), seed - 1))
    ranked = running_totals(one, "_h", ["_one"], bucket=F.substring("_h", 1, HASH_BUCKET_CHARS))
    # repeat 0 is the row itself, the others lend their values
    lent = ranked.select("label", *features, "_one_before", "_one_total", F.explode(F.sequence(F.lit(0), F.lit(repeats))).alias("repeat"))
    placed = with_permuted_position(lent, "_one_before", "_one_total", F.col("repeat") + F.lit(seed - 1), "_lent_to")
    sent = placed.withColumn("_at", F.when(F.col("repeat") == 0, F.col("_one_before")).otherwise(F.col("_lent_to")))
    met = sent.withColumn("_own", F.first(F.struct("label", *features)).over(W.partitionBy("_at").orderBy("repeat")))

    def variant(shuffled: str) -> Column:
        return F.struct(F.lit(shuffled).alias("feature"), *[(F.col(f) if f == shuffled else F.col("_own")[f]).alias(f) for f in features])

    variants = F.when(F.col("repeat") == 0, F.array(variant(""))).otherwise(F.array(*[variant(f) for f in features]))
    scored = labels_only(model).transform(assembled(met.select("repeat", F.col("_own.label"), F.inline(variants)), features))
    hits = scored.groupBy("repeat", "feature").agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    # one row per repeat and feature is left
    lost = F.max(F.when(F.col("repeat") == 0, F.col("accuracy"))).over(W.partitionBy()) - F.col("accuracy")
    return hits.withColumn("_lost", lost).where("repeat > 0").groupBy("feature").agg(F.avg("_lost").alias("importance"))


def labels_only(model: Transformer) -> Transformer:
    """A classifier without its columns of votes and probabilities, where only its predictions are read."""
    if not isinstance(model, ProbabilisticClassificationModel):
        return model
    return model.copy().setRawPredictionCol("").setProbabilityCol("")


def selected_vs_full(
    train: DataFrame, test: DataFrame, selected: list[str], full: list[str], label: str, classes: list[str]
) -> DataFrame:
    """Per-class F1 of a model on the selected features next to one on all features.

    One pass over ``test`` has the predictions of both. Each fit holds the columns that it reads and no more: how a table is
    dealt, and with it the draws of a forest, depends on the columns.
    """
    sets, scored = {"selected": selected, "full": full}, test
    for name, features in sets.items():
        only = labels_only(fit_forest(train, features, label, classes)).setFeaturesCol(f"_x_{name}").setPredictionCol(f"_y_{name}")
        vector = VectorAssembler(inputCols=features, outputCol=f"_x_{name}", handleInvalid="keep")
        scored = only.transform(vector.transform(scored))
    pairs = scored.groupBy(F.col(label).alias("y_true"), *[f"_y_{name}" for name in sets]).agg(F.count("*").alias("n"))
    cells = voted(pairs, list(sets), classes)
    table = per_class_f1(cells, classes, ["model"]).groupBy("class").agg(
        *[F.max(F.when(F.col("model") == name, F.col("f1"))).alias(name) for name in ("full", "selected")])
    return table.withColumn("delta", F.col("selected") - F.col("full"))


def hyper_search(
    train: DataFrame, features: list[str], label: str, classes: list[str], trials: int = SEARCH_TRIALS, seed: int = SEED
) -> DataFrame:
    """Seeded random draws over forest settings, scored on a held-out part; (trial, settings, f1)."""
    draw = random.Random(seed)
    forest = RandomForestClassifier(weightCol="weight", seed=seed)
    grid = [{
        forest.numTrees: draw.randrange(5, 25, 5), forest.maxDepth: draw.randint(3, 7),
        forest.minInstancesPerNode: draw.choice([1, 5, 20, 50]), forest.subsamplingRate: round(draw.uniform(0.6, 1.0), 3),
    } for _ in range(trials)]
    data = fitting_rows(train, features, label, classes).persist()
    try:
        search = TrainValidationSplit(
            estimator=forest, estimatorParamMaps=grid, trainRatio=0.8, seed=seed, parallelism=2,
            evaluator=MulticlassClassificationEvaluator(metricName="f1"),
        ).fit(data)
    finally:
        data.unpersist()
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(g.items(), key=lambda kv: kv[0].name)), float(m))
        for i, (g, m) in enumerate(zip(grid, search.validationMetrics))
    ]
    return train.sparkSession.createDataFrame(rows, "trial bigint, settings string, f1 double")


# --- thresholds and calibration ----------------------------------------------------------------
def fit_thresholds(
    df: DataFrame, prob: str, truth: str, classes: list[str], grid: list[float] | None = None, rounds: int = 3
) -> tuple[list[float], float]:
    """Per-class thresholds by coordinate ascent on macro-F1.

    One job per class and round tries all candidates of the grid together; only confusion cells
    (candidates x classes x classes) reach the driver.
    """
    grid = grid or THRESHOLD_GRID
    data = df.select(F.col(truth).alias("y_true"), F.col(prob).alias("_p")).persist()

    def score(candidates: list[list[float]]) -> list[float]:
        rows = F.array(*[
            F.struct(F.lit(i).alias("candidate"), threshold_argmax(F.col("_p"), tau, classes).alias("y_pred"))
            for i, tau in enumerate(candidates)
        ])
        cells = confusion(data.select("y_true", F.inline(rows)), by=["candidate"])
        table = multiclass_metrics(cells, classes, ["candidate"]).select("candidate", "f1_macro").collect()
        return [f for _, f in sorted((r["candidate"], r["f1_macro"]) for r in table)]

    try:
        tau = [1.0] * len(classes)
        best = score([tau])[0]
        for _ in range(rounds):
            improved = False
            for j in range(len(classes)):
                options = [[*tau[:j], g, *tau[j + 1:]] for g in grid]
                value, option = max(zip(score(options), options), key=lambda x: x[0])
                if value > best + 1e-6:
                    best, tau, improved = value, option, True
            if not improved:
                break
        return tau, best
    finally:
        data.unpersist()


def _per_score(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One weighted row per distinct score: same fit, far less data for the calibrator."""
    return df.select(F.col(score).cast("double").alias("s"), positive.cast("double").alias("y")).groupBy("s").agg(
        F.avg("y").alias("label"), F.count("*").cast("double").alias("weight"))


def fit_isotonic(df: DataFrame, score: str, positive: Column) -> IsotonicRegressionModel:
    return IsotonicRegression(featuresCol="s", labelCol="label", weightCol="weight").fit(_per_score(df, score, positive))


def apply_isotonic(model: IsotonicRegressionModel, df: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
    """Linear between the fitted borders and clipped outside; evaluated by the fitted model."""
    named = model.copy().setFeaturesCol(score).setPredictionCol(out)
    return named.transform(df).withColumn(out, F.least(F.greatest(F.col(out), F.lit(0.0)), F.lit(1.0)))


def fit_platt(df: DataFrame, score: str, positive: Column) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the scores, without regularisation."""
    parts = df.select(F.col(score).cast("double").alias("s"), positive.cast("double").alias("label")).groupBy("s", "label").agg(
        F.count("*").cast("double").alias("weight"))
    data = VectorAssembler(inputCols=["s"], outputCol="features").transform(parts)
    model = LogisticRegression(weightCol="weight", regParam=0.0, maxIter=100).fit(data)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(slope: float, intercept: float, score: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * score + F.lit(intercept))))


# --- scoring -----------------------------------------------------------------------------------
def with_attack_score(
    df: DataFrame, model: Transformer, features: list[str], classes: list[str], medians: DataFrame, benign: str, out: str
) -> DataFrame:
    """Cleaned and scored rows: ``prob`` by class, and in ``out`` the probability that a row is not ``benign``."""
    clean = impute(mask_outliers(df, features), features, medians)
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(clean)
    scored = model.transform(vector)
    prob = F.col("prob") if "prob" in scored.columns else vector_to_array("probability")
    return scored.withColumn("prob", prob).withColumn(out, 1.0 - F.get("prob", F.lit(classes.index(benign))))


def fit_calibrator(
    df: DataFrame, model: Transformer, features: list[str], label: str, classes: list[str], medians: DataFrame, benign: str
) -> IsotonicRegressionModel:
    """The calibrator that ``score_batch`` takes, from labelled rows that the model was not fitted on, cleaned as it cleans them."""
    scored = with_attack_score(known_labels(df, label, classes), model, features, classes, medians, benign, "_raw")
    return fit_isotonic(scored, "_raw", F.col(label) != benign)


def score_batch(
    df: DataFrame, model: Transformer, features: list[str], classes: list[str], thresholds: list[float], tau: float,
    medians: DataFrame, benign: str, calibrator: IsotonicRegressionModel | None = None,
) -> DataFrame:
    """Clean, score, decide, calibrate, gate. Row-local apart from the one-row medians lookup."""
    out = with_attack_score(df, model, features, classes, medians, benign, "_raw")
    out = apply_isotonic(calibrator, out, "_raw", "confidence") if calibrator else out.withColumnRenamed("_raw", "confidence")
    predicted = threshold_argmax(F.col("prob"), thresholds, classes)
    return out.withColumns({
        "predicted_class": predicted, "severity": severity(predicted), "anchor": anchor_flag(F.col("confidence"), tau),
    }).drop("features", "rawPrediction", "probability", "prediction", "_raw")


def occlusion_attributions(
    df: DataFrame, model: ProbabilisticClassificationModel, features: list[str], classes: list[str],
    medians: dict[str, float], k: int = 5,
) -> DataFrame:
    """Add ``predicted_class`` and ``attributions``: the probability of the chosen class that is lost
    when a feature is replaced by its train median.

    Each variant is one more score column of the same row, so nothing is exploded or shuffled.
    """

    def scored(frame: DataFrame, inputs: list[str], tag: str) -> DataFrame:
        vector = VectorAssembler(inputCols=inputs, outputCol=f"_x{tag}", handleInvalid="keep").transform(frame)
        variant = model.copy().setFeaturesCol(f"_x{tag}").setProbabilityCol(f"_p{tag}").setRawPredictionCol("").setPredictionCol("")
        return variant.transform(vector).withColumn(f"_p{tag}", vector_to_array(f"_p{tag}")).drop(f"_x{tag}")

    out = scored(df, features, "")
    for i, f in enumerate(features):
        out = out.withColumn("_median", F.lit(float(medians[f])))
        out = scored(out, ["_median" if g == f else g for g in features], str(i)).drop("_median")
    out = out.withColumn("_chosen", argmax_index(F.col("_p")))
    items = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 (F.get("_p", F.col("_chosen")) - F.get(f"_p{i}", F.col("_chosen"))).alias("shap"))
        for i, f in enumerate(features)
    ])
    return out.withColumns({
        "predicted_class": F.get(literal_array(classes), F.col("_chosen")), "attributions": top_by_magnitude(items, "shap", k),
    }).drop("_p", "_chosen", *[f"_p{i}" for i in range(len(features))])
