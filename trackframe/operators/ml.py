"""Route classifiers on coordinate and picture features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as a
from ..functions.hashing import uniform
from ..storage import drop_tables, materialize
from . import images
from .metrics import overall_scores
from .routes import feature_vector

KINDS = ("perceptron", "forest", "logistic", "one_vs_rest")
INPUTS = ("coordinates", "pixels")
#: Parameters of each family that :func:`select_model` may vary.
DEFAULTS = {"perceptron": {"maxIter": 40, "hidden": 32}, "forest": {"numTrees": 30, "maxDepth": 8}, "logistic": {"maxIter": 40, "regParam": 0.01}, "one_vs_rest": {"maxIter": 8, "regParam": 0.01}}


def _classifier(kind: str, classes: int, features: int, seed: int, params: dict):
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if unknown := params.keys() - DEFAULTS[kind].keys():
        raise ValueError(f"{kind} has no parameters {sorted(unknown)}")
    common, p = {"featuresCol": "features", "labelCol": "class_index"}, DEFAULTS[kind] | params
    if kind == "perceptron":
        return MultilayerPerceptronClassifier(layers=[features, p["hidden"], classes], maxIter=p["maxIter"], seed=seed, **common)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, weightCol="weight", **p, **common)
    if kind == "logistic":
        return LogisticRegression(weightCol="weight", **p, **common)
    return OneVsRest(classifier=LinearSVC(**p), weightCol="weight", parallelism=4, **common)


def features_of(routes: DataFrame, n: int = 64, inputs: str = "coordinates") -> DataFrame:
    """``routes`` with ``features``: n points as coordinates, or what a convolution sees in the picture."""
    if inputs == "coordinates":
        return feature_vector(routes, n)
    if inputs != "pixels":
        raise ValueError(f"inputs must be one of {INPUTS}")
    return routes.join(images.image_features(images.route_images(routes)), "route_id")


def class_weights(routes: DataFrame) -> DataFrame:
    """``weight`` of each class: rows / (classes * rows of the class), so weights average to 1."""
    counts = routes.groupBy("route_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    return counts.crossJoin(F.broadcast(total)).select("route_type", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row by a row for each class


def resampled(rows: DataFrame, key: str = "route_id", seed: int = 42) -> DataFrame:
    """Each row as often as its ``weight`` says: the whole part, and once more with the chance of the rest, by hash of the key.

    For learners that take no weights.
    """
    whole = F.floor("weight")
    times = whole + (uniform("resample", key, seed=seed) < F.col("weight") - whole).cast("long")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).where("_copy > 0").drop("_copy")


def train_classifier(routes: DataFrame, kind: str, classes: list[str], n: int = 64, balanced: bool = False, seed: int = 42, inputs: str = "coordinates", **params) -> Model:
    """M1, M6: a model of one of four families; classes have the fixed order given.

    ``balanced`` weighs rows by class rarity: by weights, or, for the perceptron,
    which takes none, by resampling.  ``inputs="pixels"`` learns from pictures.
    """
    index = StringIndexerModel.from_labels(classes, inputCol="route_type", outputCol="class_index", handleInvalid="skip")
    rows = features_of(routes, n, inputs)
    size = 2 * n if inputs == "coordinates" else images.N_FEATURES
    classifier = _classifier(kind, len(classes), size, seed, params)
    rows = rows.join(F.broadcast(class_weights(routes)), "route_type") if balanced else rows.withColumn("weight", F.lit(1.0))  # a row for each class
    rows = materialize((resampled(rows) if balanced and kind == "perceptron" else rows).select("route_type", "features", "weight"), "training-rows")  # iterations read it again
    back = IndexToString(inputCol="prediction", outputCol="pred", labels=classes)
    try:
        return Pipeline(stages=[index, classifier, back]).fit(rows)
    finally:
        drop_tables(rows)


def predict(model: Model, routes: DataFrame, classes: list[str], n: int = 64, top_n: int = 3, inputs: str = "coordinates") -> DataFrame:
    """M3: ``pred``, ``confidence`` and the ``top_n`` classes of each route (models without probabilities: softmax of scores)."""
    rows = features_of(routes, n, inputs).withColumn("weight", F.lit(1.0))
    stages = [s for s in model.stages if not isinstance(s, StringIndexerModel)]
    out = reduce(lambda df, s: s.transform(df), stages, rows)
    scores = vector_to_array("probability") if "probability" in out.columns else a.softmax(vector_to_array("rawPrediction"))
    out = out.withColumn("_p", scores).withColumn("top", a.top_classes(F.col("_p"), classes, top_n))
    return out.withColumn("confidence", F.element_at("top", 1)["probability"]).drop("_p", "features", "weight", "rawPrediction", "probability", "prediction")


def evaluate(models: dict[str, Model], routes: DataFrame, classes: list[str], n: int = 64) -> DataFrame:
    """M5: accuracy and F1 of each model on the same routes."""
    parts = [predict(m, routes, classes, n).select(F.lit(name).alias("model"), F.col("route_type").alias("label"), "pred") for name, m in models.items()]
    return overall_scores(reduce(DataFrame.unionByName, parts), by=("model",))


def best_of(scores: DataFrame, metric: str = "accuracy") -> str:
    """The best model's name; ties by name."""
    return scores.orderBy(F.desc(metric), "model").first()["model"]


def search(split: DataFrame, grid: Sequence[tuple[str, dict]], classes: list[str], n: int = 64, metric: str = "accuracy", balanced: bool = False, seed: int = 42) -> tuple[Model, DataFrame]:
    """M2: the model of ``grid`` (kind, parameters) with the best ``metric`` on the validation part, and the scores of all.

    ``split`` has a column ``split`` with train and val; every model sees the same
    rows.  Varying ``maxIter`` keeps the best number of iterations.  Scores have
    the columns of :func:`evaluate`, ``kind``, ``params`` and ``chosen``; ties
    go to the earlier one.
    """
    train, val = split.where("split = 'train'"), split.where("split = 'val'")
    named = {f"{k:03d}": (kind, params) for k, (kind, params) in enumerate(grid)}
    models = {name: train_classifier(train, kind, classes, n, balanced, seed, **params) for name, (kind, params) in named.items()}
    scores = materialize(evaluate(models, val, classes, n), "model-scores")
    chosen = best_of(scores, metric)
    kind = F.create_map(*(F.lit(x) for name, (kind, _) in named.items() for x in (name, kind)))
    shown = F.create_map(*(F.lit(x) for name, (_, p) in named.items() for x in (name, ", ".join(f"{c}={p[c]}" for c in sorted(p)))))
    out = scores.withColumns({"kind": F.element_at(kind, F.col("model")), "params": F.element_at(shown, F.col("model")), "chosen": F.col("model") == chosen})
    return models[chosen], out


def predict_videos(model: Model, routes: DataFrame, classes: list[str], top_n: int = 1) -> DataFrame:
    """Share of each class in each video and its weight, from the likeliest classes of its routes."""
    from .metrics import route_distribution

    ranked = predict(model, routes, classes, top_n=max(1, top_n)).select(F.col("video_id").alias("video"), F.explode("top").alias("t"))
    weight = F.lit(1.0) if top_n == 1 else F.col("t.probability")
    return route_distribution(ranked.select("video", F.col("t.name").alias("class"), weight.alias("weight")))
