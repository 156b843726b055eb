"""Prediction views: a decision tree or random forest learnt from labelled rows, applied to every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, IndexToString, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.constants import ML_SEED
from fathom.errors import require

METHODS = {
    ("classification", "decision_tree"): DecisionTreeClassifier, ("classification", "random_forest"): RandomForestClassifier,
    ("regression", "decision_tree"): DecisionTreeRegressor, ("regression", "random_forest"): RandomForestRegressor,
}


#: Numbers of four bytes that a task of a fit reads, however few files the source has, and those of a row beside its
#: features: how often each of a forest's 20 trees takes it, and headers (316 bytes were measured where features are 36).
TASK_NUMBERS, ROW_NUMBERS = 1 << 23, 44


def view(
    rows: DataFrame, key: Sequence[str], target: str, features: Sequence[str], *, task: str = "classification", using: str = "random_forest",
    version: int = 1, most: int | None = None,
) -> DataFrame:
    """(key, features, actual, prediction, confidence, refresh_version) of every row; confidence is null for regression.

    Numbers that are missing become the median, categories the most frequent; unknown categories count as none. The
    rows must have both labelled and unlabelled targets. ``most`` is a strict limit of rows, off by default: trees are
    fitted by distributed histograms, so the source may be any size.
    """
    require((task, using) in METHODS, "ml_method", f"no {using} for {task}")
    require(bool(key), "ml_source", "the source needs a primary key")
    require(target not in features and len(set(features)) == len(features) > 0, "ml_features", "features are distinct columns beside the target")
    counted = rows.agg(F.count("*").alias("n"), F.count(target).alias("known")).head()
    require(most is None or counted.n <= most, "ml_source", f"at most {most} rows")
    require(0 < counted.known < counted.n, "ml_source", "the source needs labelled and unlabelled rows")
    kind = {f: rows.schema[f].dataType for f in features}
    numbers = [f for f in features if isinstance(kind[f], (T.NumericType, T.BooleanType))]
    words = [f for f in features if isinstance(kind[f], T.StringType)]
    require(len(numbers) + len(words) == len(features), "ml_features", "features are numbers, booleans or text")
    require(task == "classification" or isinstance(rows.schema[target].dataType, T.NumericType), "ml_target", "a regression's target is a number")
    given = rows.withColumns({f"_n_{f}": F.col(f).cast("double") for f in numbers})
    labelled = given.where(F.col(target).isNotNull())
    for f in words:
        common = labelled.where(F.col(f).isNotNull()).groupBy(f).count().orderBy(F.desc("count"), f).head()
        given = given.withColumn(f"_c_{f}", F.coalesce(f, F.lit(common[0] if common else "")))
    labelled = given.where(F.col(target).isNotNull())
    # trees are learnt from one number a feature and a category of each row, which a task holds whole
    width = len(numbers) + sum(labelled.agg(*[F.approx_count_distinct(f) + 2 for f in words]).head()) if words else len(numbers)
    if (tasks := -(-counted.known * (width + ROW_NUMBERS) // TASK_NUMBERS)) > 1:
        labelled = labelled.repartition(tasks, *key).sortWithinPartitions(*key)
    stages = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=[f"_n_{f}" for f in numbers], outputCols=[f"_m_{f}" for f in numbers]))
    if words:
        stages.append(StringIndexer(inputCols=[f"_c_{f}" for f in words], outputCols=[f"_i_{f}" for f in words], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"_i_{f}" for f in words], outputCols=[f"_o_{f}" for f in words], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[f"_m_{f}" for f in numbers] + [f"_o_{f}" for f in words], outputCol="_features"))
    method = METHODS[task, using]
    if task == "classification":
        labels = StringIndexer(inputCol="_target", outputCol="_label").fit(labelled.withColumn("_target", F.col(target).cast("string")))
        labelled = labels.transform(labelled.withColumn("_target", F.col(target).cast("string")))
        stages.append(method(featuresCol="_features", labelCol="_label", predictionCol="_predicted", seed=ML_SEED))
        stages.append(IndexToString(inputCol="_predicted", outputCol="_shown", labels=labels.labels))
        found = Pipeline(stages=stages).fit(labelled).transform(given)
        answer = F.col("_shown").cast(rows.schema[target].dataType), F.array_max(vector_to_array("probability"))
    else:
        stages.append(method(featuresCol="_features", labelCol="_label", predictionCol="_predicted", seed=ML_SEED))
        labelled = labelled.withColumn("_label", F.col(target).cast("double"))
        found = Pipeline(stages=stages).fit(labelled).transform(given)
        answer = F.col("_predicted"), F.lit(None).cast("double")
    return found.select(*key, *[f for f in features if f not in key], F.col(target).alias("actual"), answer[0].alias("prediction"), answer[1].alias("confidence"), F.lit(version).alias("refresh_version"))
