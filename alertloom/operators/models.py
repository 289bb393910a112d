"""Classifiers per target on one feature matrix: fit, predict, explain, validate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators import labels as label_ops
from alertloom.operators import metrics as metric_ops
from alertloom.operators.boosting import BoostedModel, Booster, fit_boosted, run_boosted
from alertloom.operators.clean import CleaningFit, present
from alertloom.operators.splits import kfold
from alertloom.operators.vectors import FittedFeatures, assemble, fit_features, fit_fold_features, sparse_entries
from alertloom.session import broadcast_if_small, is_small, ship_sources, stored
from alertloom.spec import ACCURACY_THRESHOLD, F1_THRESHOLD, FeatureSpec, ModelParams

FEATURES = "features"


# --- Registry ---------------------------------------------------------------


#: Most classes of a target; tree classifiers and class lists are held on the driver.
MOST_CLASSES = 10_000


class SoftmaxBooster:
    """A boosted classifier that is fitted on (features, label[, weight])."""

    def __init__(self, params: ModelParams, classes: int):
        self.params, self.classes, self.weight = params, classes, None

    def setWeightCol(self, name: str) -> SoftmaxBooster:
        self.weight = name
        return self

    def fit(self, rows: DataFrame) -> BoostedModel:
        given = rows.select(
            F.lit(0).alias("group"), FEATURES, F.array(F.col("label").cast("int")).alias("labels"),
            F.array(F.col(self.weight) if self.weight else F.lit(1.0)).alias("weights"),
        )
        size = given.agg(F.max(vector_size(FEATURES))).first()[0] or 0
        return fit_boosted(given, [Booster(0, 0, self.classes)], {0: size}, self.params)[0]


def vector_size(vectors: str) -> Column:
    entries = F.unwrap_udt(vectors)
    return F.coalesce(entries["size"], F.size(entries["values"]))


def _forest(p: ModelParams) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol="label", numTrees=p.rounds, maxDepth=p.depth,
        subsamplingRate=p.subsample, minInstancesPerNode=p.min_rows_per_leaf, seed=p.seed,
    )


# Name -> which classifier. The first three names are aliases of the default.
_REGISTRY: dict[str, str] = {
    "hierarchical_boosting": "boosted",
    "multi_target_boosting": "boosted",
    "tfidf_boosting": "boosted",
    "boosted": "boosted",
    "forest": "forest",
}


def available_classifiers() -> list[str]:
    return list(_REGISTRY)


def make_classifier(name: str, **params) -> Callable[[int], object]:
    """Number of classes -> an unfitted classifier. Names ignore case."""
    kind = _REGISTRY.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown model type {name!r}; known: {', '.join(_REGISTRY)}")
    return lambda classes: classifier_for(ModelParams(kind=kind, **params), classes)


def classifier_for(params: ModelParams, classes: int):
    """The learner that `params.kind` names.

    Boosting grows a tree for each class in every round: for targets of very many classes
    the caller may choose a forest, target by target.
    """
    return _forest(params) if params.kind == "forest" else SoftmaxBooster(params, classes)


# --- Fitting ----------------------------------------------------------------


@dataclass
class TargetModel:
    """A fitted classifier and the class numbers its outputs stand for."""

    target: str
    model: object
    classes: list[int]
    train_accuracy: float | None = None


@dataclass
class AlertModel:
    spec: FeatureSpec
    features: FittedFeatures
    labels: DataFrame
    targets: dict[str, TargetModel] = field(default_factory=dict)
    selector: VectorSlicer | None = None
    feature_count: int = 0
    sample_count: int = 0
    #: How training cleaned its table, and sketches of its numbers; scoring cleans rows the same way.
    cleaning: CleaningFit | None = None
    sketches: DataFrame | None = None

    @property
    def is_trained(self) -> bool:
        return bool(self.targets)

    def class_names(self, target: str) -> list[str]:
        """Fitted class of each output position of the target's classifier."""
        rows = label_ops.target_classes(self.labels, target).collect()
        names = {r["idx"]: r["class"] for r in rows}
        return [names[i] for i in self.targets[target].classes]


def _class_sums(batches) -> Iterator[pa.RecordBatch]:
    """Sum and sum of squares of each (feature, class) with entries in a batch."""
    for batch in batches:
        feature, sizes, value = sparse_entries(batch.column(1))
        label = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes)
        there, at = np.unique(np.stack([feature, label], axis=1), axis=0, return_inverse=True)
        sums = [np.bincount(at.ravel(), x, len(there)) for x in (value, value * value)]
        yield pa.record_batch([pa.array(there[:, 0]), pa.array(there[:, 1]), *map(pa.array, sums)], ["feature", "label", "s", "q"])


def anova_f(matrix: DataFrame, target: str) -> DataFrame:
    """(feature, f): the ANOVA F of every feature with entries against the classes of `target`.

    Sums and sums of squares of the entries that are not zero are aggregated once by (feature, class); zeros only
    count through the class sizes. A feature without spread inside its classes has an infinite F, or none if it is constant.
    """
    ship_sources(matrix.sparkSession)
    sizes = matrix.groupBy(F.col(target).cast("long").alias("label")).agg(F.count("*").alias("n")).where("label IS NOT NULL")
    # One row per class.
    classes, rows = sizes.agg(F.count("*"), F.sum("n")).first()
    known = matrix.where(F.col(target).isNotNull()).select(F.col(target).cast("long").alias("label"), F.unwrap_udt(FEATURES).alias("v"))
    sums = known.mapInArrow(_class_sums, "feature long, label long, s double, q double")
    sums = sums.groupBy("feature", "label").agg(F.sum("s").alias("s"), F.sum("q").alias("q")).join(broadcast_if_small(sizes), "label")
    each = sums.groupBy("feature").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") * F.col("s") / F.lit(rows or 1)
    between, within = F.greatest(F.col("between") - mean, F.lit(0.0)), F.greatest(F.col("q") - F.col("between"), F.lit(0.0))
    # What is left of a difference of sums that should be 0.
    tiny = F.col("q") * 1e-12
    share = (between / max((classes or 0) - 1, 1)) / (within / max((rows or 0) - (classes or 0), 1))
    return each.select("feature", F.when(within > tiny, share).when(between > tiny, F.lit(float("inf"))).alias("f"))


def select_k_best(matrix: DataFrame, target: str, k: int) -> VectorSlicer:
    """Keep the `k` features with the largest ANOVA F against one target (ties: smaller index), in their order."""
    size = matrix.agg(F.max(vector_size(FEATURES))).first()[0] or 0
    # At most k rows.
    best = anova_f(matrix, target).where("f IS NOT NULL").orderBy(F.desc("f"), "feature").limit(k).collect()
    chosen = [r.feature for r in best]
    # Features without spread or entries come last.
    chosen += [i for i in range(size) if i not in set(chosen)][: max(0, min(k, size) - len(chosen))]
    return VectorSlicer(inputCol=FEATURES, outputCol="_selected", indices=sorted(chosen))


def _apply_selector(matrix: DataFrame, selector) -> DataFrame:
    if selector is None:
        return matrix
    return selector.transform(matrix).drop(FEATURES).withColumnRenamed("_selected", FEATURES)


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight, scale): n / (k * count), and for two classes negatives / positives."""
    counts = df.groupBy(F.col(target).alias("class")).agg(F.count("*").alias("n"))
    # One row per class below, so the unpartitioned windows are small.
    everything = Window.partitionBy()
    rows, classes = F.sum("n").over(everything), F.count("*").over(everything)
    low = F.min_by("n", "class").over(everything)
    high = F.max_by("n", "class").over(everything)
    return counts.select(
        "class",
        "n",
        (rows / (classes * F.col("n"))).alias("weight"),
        F.when(classes == 2, low / high).alias("scale"),
    )


def fit_targets(
    train: DataFrame, spec: FeatureSpec, labels: DataFrame, k_best: int | None = None,
    balance: bool = False, features: FittedFeatures | None = None,
) -> AlertModel:
    """One classifier per target, all on the same matrix; targets of one class are skipped.

    `features` is what `fit_features` found on `train`, if it was asked before.
    """
    targets = present(train, spec.targets)
    features = features or fit_features(train, spec)
    encoded = label_ops.encode_labels(train, labels, targets, suffix="__y")
    codes = [f"{t}__y" for t in targets]
    # The matrix is read by every booster of every target.
    matrix = assemble(encoded, features, codes).persist()
    model = AlertModel(spec, features, labels)
    model.sample_count = matrix.count()
    model.feature_count = len(features.names())
    if k_best and model.feature_count:
        k = min(k_best, model.feature_count)
        model.selector = select_k_best(matrix, codes[0], k)
        selected = _apply_selector(matrix, model.selector).persist()
        matrix.unpersist()
        matrix, model.feature_count = selected, k
    jobs = [
        Fit(0, t, codes.index(c), spec.model_params(t), known)
        for t, c, known in zip(targets, codes, _classes_of(matrix, codes))
        if len(known) > 1
    ]
    rows = matrix.withColumn("group", F.lit(0))
    fitted = _fit_all(rows, codes, jobs, {0: model.feature_count}, balance)
    model.targets = {j.target: TargetModel(j.target, m, j.classes) for j, m in zip(jobs, fitted)}
    right = {}
    scored = run_classifiers(rows, [m.model for m in model.targets.values()])
    for i, (j, m) in enumerate(zip(jobs, model.targets.values())):
        right[j.target] = F.avg((F.col(f"_pred{i}") == class_place(codes[j.code], m.classes)).cast("double"))
    if right:
        shares = scored.agg(*[x.alias(t) for t, x in right.items()]).first()
        for t, m in model.targets.items():
            m.train_accuracy = shares[t]
    matrix.unpersist()
    return model


@dataclass
class Fit:
    """One classifier to fit: on the rows of a group, for the target whose code is the `code`-th."""

    group: int
    target: str
    code: int
    params: ModelParams
    classes: list[int]


def _classes_of(matrix: DataFrame, codes: Sequence[str]) -> list[list[int]]:
    """The class numbers present, target by target."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("long").alias("code")) for i, c in enumerate(codes)])
    found = matrix.select(F.inline(pairs)).where("code IS NOT NULL").distinct()
    # Bounded by MOST_CLASSES for each target.
    rows = found.limit(MOST_CLASSES * len(codes) + 1).collect() if codes else []
    classes: list[list[int]] = [sorted(r.code for r in rows if r.i == i) for i in range(len(codes))]
    if any(len(c) > MOST_CLASSES for c in classes):
        raise ValueError(f"a target has more than {MOST_CLASSES} classes")
    return classes


def class_place(code: str, classes: Sequence[int]) -> Column:
    """The place of a row's class among `classes`, from 0; -1 where it is not one of them."""
    known = F.split(F.lit(",".join(map(str, classes))), ",")
    return F.coalesce(F.array_position(known, F.col(code).cast("long").cast("string")), F.lit(0)).cast("int") - 1


def _fit_all(rows: DataFrame, codes: Sequence[str], jobs: Sequence[Fit], sizes: dict[int, int], balance: bool = False) -> list:
    """Fit every job on `rows` (group, features, the codes; `used` where rows are left out).

    Boosted jobs of equal settings grow in lockstep; the others run side by side, and beside them.
    """
    used = F.col("used") if "used" in rows.columns else F.lit(True)
    out: list = [None] * len(jobs)

    def forest(i: int):
        j = jobs[i]
        own = rows.where(used & (F.col("group") == j.group)).select(FEATURES, codes[j.code])
        # The number of classes is told to Spark ML, which otherwise guesses it, up to 100.
        about = {"ml_attr": {"type": "nominal", "num_vals": len(j.classes)}}
        own = own.withColumn("label", class_place(codes[j.code], j.classes).cast("double").alias("label", metadata=about))
        classifier = classifier_for(j.params, len(j.classes))
        if balance:
            classifier.setWeightCol("weight")
            own = own.withColumn("weight", _class_weight(own, codes[j.code]))
        # Every task sends statistics of all nodes of a pass, however few rows it has.
        return classifier.fit(own.where("label >= 0").coalesce(rows.sparkSession.sparkContext.defaultParallelism))

    others = [i for i, j in enumerate(jobs) if j.params.kind == "forest"]
    with ThreadPoolExecutor(max(1, min(len(others), max([1, *(jobs[i].params.parallelism for i in others)])))) as pool:
        # They use the cores between the levels of boosting, which are short jobs.
        forests = [pool.submit(inheritable_thread_target(rows.sparkSession)(forest), i) for i in others]
        for params in dict.fromkeys(j.params for j in jobs if j.params.kind != "forest"):
            mine = [i for i, j in enumerate(jobs) if j.params == params]
            boosters, labels, weights = [], [], []
            for place, i in enumerate(mine):
                j = jobs[i]
                boosters.append(Booster(j.group, place, len(j.classes)))
                labels.append(F.when(used & (F.col("group") == j.group), class_place(codes[j.code], j.classes)).otherwise(-1))
                weights.append(_class_weight(rows.where(used & (F.col("group") == j.group)), codes[j.code]) if balance else F.lit(1.0))
            given = rows.select("group", FEATURES, F.array(*labels).alias("labels"), F.array(*weights).alias("weights"))
            for i, model in zip(mine, fit_boosted(given, boosters, sizes, params)):
                out[i] = model
        for i, model in zip(others, forests):
            out[i] = model.result()
    return out


def _class_weight(rows: DataFrame, code: str) -> Column:
    """The balanced weight of a row's class; classes are bounded, so their weights are one literal."""
    found = {r["class"]: r["weight"] for r in balanced_weights(rows, code).collect() if r["class"] is not None}
    weight = F.element_at(F.split(F.lit(",".join(map(repr, found.values()))), ","), class_place(code, list(found)) + 1)
    return F.when(F.col(code).isNotNull(), weight.cast("double")).otherwise(1.0)


def train_accuracy(rows: DataFrame, fitted) -> float:
    """Share of rows whose predicted position equals their `label`."""
    right = (F.col("_pred0") == F.col("label")).cast("double")
    return run_classifiers(rows, [fitted]).agg(F.avg(right)).first()[0]


# --- Scoring ----------------------------------------------------------------


def run_classifiers(rows: DataFrame, fitted: Sequence) -> DataFrame:
    """Add `_pred{i}` (position of the class) and `_prob{i}` (array of probabilities) for each classifier."""
    boosted = [(i, m) for i, m in enumerate(fitted) if isinstance(m, BoostedModel)]
    if boosted:
        rows = run_boosted(rows, boosted, FEATURES)
    for i, m in enumerate(fitted):
        if not isinstance(m, BoostedModel):
            model = m.copy().setPredictionCol(f"_pred{i}").setRawPredictionCol("").setProbabilityCol(f"_vec{i}")
            rows = model.transform(rows).withColumn(f"_prob{i}", vector_to_array(f"_vec{i}")).drop(f"_vec{i}")
    return rows


def predict(
    df: DataFrame, model: AlertModel, key: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """(key..., keep..., target, level, pred_idx, predicted_class, probabilities).

    One row per input row and fitted target. The features are built once, and the
    long form is unfolded within the row; nothing is shuffled.
    """
    if not model.is_trained:
        raise ValueError("the model has no fitted target")
    rows = assemble(df, model.features, [*key, *keep])
    return unfolded(run_classifiers(_apply_selector(rows, model.selector), [t.model for t in model.targets.values()]), model, [*key, *keep])


def unfolded(rows: DataFrame, model: AlertModel, keep: Sequence[str]) -> DataFrame:
    """One row per target from rows that every classifier has scored."""
    cells = []
    for i, (target, fitted) in enumerate(model.targets.items()):
        names = model.class_names(target)
        place = F.col(f"_pred{i}").cast("int") + 1
        name_array = F.array(*[F.lit(n) for n in names])
        cells.append(
            F.struct(
                F.lit(target).alias("target"),
                F.lit(model.spec.level_of(target)).alias("level"),
                F.element_at(F.array(*[F.lit(c).cast("bigint") for c in fitted.classes]), place).alias("pred_idx"),
                F.element_at(name_array, place).alias("predicted_class"),
                F.map_from_arrays(name_array, F.col(f"_prob{i}")).alias("probabilities"),
            )
        )
    return rows.select(*keep, F.inline(F.array(*cells)))


def truth_pairs(df: DataFrame, model: AlertModel, key: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """(row_id, target, level, y_true, y_pred) for rows that carry their own labels.

    Truth travels through scoring with its row, so no join is needed.
    """
    encoded = label_ops.encode_labels(df, model.labels, targets, suffix="__y")
    return _with_truth(predict(encoded, model, key, keep=[f"{t}__y" for t in targets]), key, targets)


def _with_truth(scored: DataFrame, key: Sequence[str], targets: Sequence[str]) -> DataFrame:
    truth = F.lit(None).cast("bigint")
    for t in targets:
        truth = F.when(F.col("target") == t, F.col(f"{t}__y")).otherwise(truth)
    return scored.where(F.col("target").isin(*targets)).select(
        F.struct(*key).alias("row_id"), "target", "level",
        truth.alias("y_true"), F.col("pred_idx").alias("y_pred"),
    )


def enough_truth(spec: FeatureSpec, available: Sequence[str]) -> bool:
    return bool(available) and len(available) >= len(spec.targets) // 2


# --- Explaining and checking ------------------------------------------------


def _importances(fitted) -> list[float]:
    if isinstance(fitted, BoostedModel):
        return fitted.importances.tolist()
    return [float(x) for x in fitted.featureImportances.toArray()]


def feature_importance(model: AlertModel) -> DataFrame:
    """(target, feature, importance): one row per feature of the bounded matrix."""
    names = model.features.names()
    if model.selector is not None:
        names = [names[i] for i in model.selector.getIndices()]
    rows = [
        (t, n, float(v))
        for t, fitted in model.targets.items()
        for n, v in zip(names, _importances(fitted.model))
    ]
    spark = model.labels.sparkSession
    return spark.createDataFrame(rows, "target string, feature string, importance double")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """First `n` features per target with their place, and the sums of all and of those."""
    by_target = Window.partitionBy("target")
    place = F.row_number().over(by_target.orderBy(F.desc("importance"), F.asc("feature")))
    totals = importance.groupBy("target").agg(
        F.count("*").alias("total_features"), F.sum("importance").alias("importance_sum")
    )
    top = importance.withColumn("place", place).where(F.col("place") <= n)
    return top.withColumn("top_importance_sum", F.sum("importance").over(by_target)).join(
        totals, "target"
    )


def cross_validate(
    df: DataFrame, spec: FeatureSpec, labels: DataFrame, key: Sequence[str],
    k: int = 5, seed: int = 42,
) -> DataFrame:
    """Weighted F1 per target over stratified folds: mean, population deviation, min, max.

    All folds are fitted on one table of (fold, row), where a fold's own rows are only scored. Fitted
    statistics are kept per fold and taken from the whole, so the texts are read once.
    """
    targets = present(df, spec.targets)
    codes = [f"{t}__y" for t in targets]
    folded = stored(kfold(df, key, k, seed, targets[0], "_fold"), "folds")
    encoded = label_ops.encode_labels(folded, labels, targets, suffix="__y")
    stacked, models = None, []
    for fold, features in enumerate(fit_fold_features(folded, spec, "_fold", k)):
        part = assemble(encoded, features, [*key, "_fold", *codes]).withColumn("group", F.lit(fold))
        stacked = part if stacked is None else stacked.unionByName(part)
        models.append(AlertModel(spec, features, labels, feature_count=len(features.names())))
    rows = stored(stacked.withColumn("used", F.col("_fold") != F.col("group")), "fold-matrix")
    jobs = []
    for fold in range(k):
        known = _classes_of(rows.where((F.col("group") == fold) & F.col("used")), codes)
        jobs += [Fit(fold, t, i, spec.model_params(t), known[i]) for i, t in enumerate(targets) if len(known[i]) > 1]
    for j, m in zip(jobs, _fit_all(rows, codes, jobs, {f: m.feature_count for f, m in enumerate(models)})):
        models[j.group].targets[j.target] = TargetModel(j.target, m, j.classes)
    pairs = None
    for fold, model in enumerate(models):
        held = rows.where((F.col("group") == fold) & ~F.col("used"))
        scored = unfolded(run_classifiers(held, [t.model for t in model.targets.values()]), model, [*key, *codes])
        part = _with_truth(scored, key, targets).withColumn("target", F.concat(F.lit(f"{fold}|"), "target"))
        pairs = part if pairs is None else pairs.unionByName(part)
    scores = metric_ops.macro_weighted(pairs).select(
        F.substring_index("target", "|", -1).alias("target"), F.substring_index("target", "|", 1).cast("int").alias("fold"),
        F.col("weighted_f1").alias("score"),
    )
    return scores.groupBy("target").agg(
        F.sort_array(F.collect_list(F.struct("fold", "score"))).alias("_scores"),
        F.avg("score").alias("mean_score"),
        F.stddev_pop("score").alias("std_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    ).select(
        "target", F.col("_scores.score").alias("cv_scores"),
        "mean_score", "std_score", "min_score", "max_score",
    )


def model_requirements(
    df: DataFrame, model: AlertModel, key: Sequence[str],
    f1: float = F1_THRESHOLD, accuracy: float = ACCURACY_THRESHOLD,
) -> DataFrame:
    """(check, met, detail): trained, able to predict, good enough."""
    checks: list[tuple[str, bool, str]] = [("model_trained", model.is_trained, "")]
    usable = False
    if model.is_trained:
        try:
            usable = is_small(predict(df.limit(5), model, key), 10_000)
            checks.append(("has_predictions", usable, ""))
        except Exception as error:  # reported, not raised: this is a check
            checks.append(("has_predictions", False, str(error).splitlines()[0]))
    if usable:
        pairs = truth_pairs(df, model, key, [t for t in model.targets if t in df.columns])
        row = metric_ops.overall(metric_ops.evaluate(pairs, model.spec)).first()
        checks.append(("meets_f1_threshold", row["avg_weighted_f1"] >= f1, f"{row['avg_weighted_f1']:.6f}"))
        checks.append(("meets_accuracy_threshold", row["avg_accuracy"] >= accuracy, f"{row['avg_accuracy']:.6f}"))
    return df.sparkSession.createDataFrame(checks, "check string, met boolean, detail string")


MODEL_READERS = {"boosted": BoostedModel, "forest": RandomForestClassificationModel}


def kind_of(fitted) -> str:
    return next(name for name, cls in MODEL_READERS.items() if isinstance(fitted, cls))
