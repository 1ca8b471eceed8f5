"""Supervised check and projection of the fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.config import DEFAULT
from netquarry.functions.storage import materialize
from netquarry.functions.vectors import array_of
from netquarry.operators.ranking import ranked_by_bucket


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_share: float = 0.2, seed: int = DEFAULT.seed):
    """Exact per-label split by rank of a seeded hash: (train, test).

    The rank is taken over (label, hash) buckets, so a label holding most rows
    is never sorted in one task.
    """
    slot = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    hashed = df.withColumn("_h", slot)
    order = [F.col("_h"), *[F.col(c) for c in key]]
    ranked = ranked_by_bucket(hashed, F.shiftright("_h", 52), order, "_rank", within=[label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranked.join(sizes, label).withColumn("_test", F.col("_rank") < F.round(F.col("_size") * test_share))
    placed = materialize(placed, "split")  # both sides read one ranking
    extra = ("_h", "_rank", "_size", "_test")
    return placed.filter(~F.col("_test")).drop(*extra), placed.filter("_test").drop(*extra)


def train_forest(
    train: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 100, seed: int = DEFAULT.seed
) -> RandomForestClassificationModel:
    """Random forest on the matrix columns; labels must be of at least two kinds."""
    data = train.select(array_to_vector(array_of(list(columns))).alias("_v"), F.col(label).cast("double").alias("_y"))
    return RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(data)


def has_two_labels(df: DataFrame, label: str = "label") -> bool:
    ends = df.agg(F.min(label).alias("low"), F.max(label).alias("high")).first()
    return ends["low"] is not None and ends["low"] != ends["high"]


def predict(model: RandomForestClassificationModel, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    scored = model.transform(df.withColumn("_v", array_to_vector(array_of(list(columns)))))
    return scored.withColumn("prediction", F.col("prediction").cast("int")).drop("_v", "rawPrediction", "probability")


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    cells = confusion_matrix(scored, label, prediction)
    side = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("cls"), F.col("rows").alias("actual"), F.lit(0).cast("bigint").alias("claimed"),
                         F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0).alias("hit")),
                F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("bigint").alias("actual"),
                         F.col("rows").alias("claimed"), F.lit(0).cast("bigint").alias("hit")),
            )
        ).alias("c")
    ).select("c.*")
    sums = side.groupBy("cls").agg(F.sum("actual").alias("support"), F.sum("claimed").alias("c"), F.sum("hit").alias("h"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))

    p, r = share(F.col("h"), F.col("c")), share(F.col("h"), F.col("support"))
    f1 = F.coalesce(F.try_divide(2 * p * r, F.nullif(p + r, F.lit(0.0))), F.lit(0.0))
    return sums.select(
        F.col("cls").alias("label"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(f1, 4).alias("f1"), "support",
    )


def feature_importances(model: RandomForestClassificationModel, columns: Sequence[str], like: DataFrame) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(columns, model.featureImportances.toArray())]
    return like.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def project_2d(df: DataFrame, features: str = "features", dims: int | None = None):
    """Two leading principal components of an array column: (rows, explained variance).

    The column is centred first, since the fitted model does not centre.
    """
    d = dims if dims is not None else len(df.select(features).first()[0])
    means = df.agg(F.array(*[F.avg(F.col(features)[i]) for i in range(d)]).alias("m")).scalar()
    centred = (
        df.withColumn("_m", means)
        .withColumn("_v", array_to_vector(F.zip_with(F.col(features), F.col("_m"), lambda x, m: x - m)))
        .drop("_m")
    )
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(centred)
    xy = vector_to_array("_p")
    out = model.transform(centred).withColumn("pc1", xy[0]).withColumn("pc2", xy[1]).drop("_v", "_p")
    return out, [float(v) for v in model.explainedVariance.toArray()]
