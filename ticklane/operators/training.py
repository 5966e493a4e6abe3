"""Training tables, boosted trees, walk-forward and grid runs, on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions.scalar import nan_to_null
from ticklane.operators.evaluate import backtest_report, prediction_flags, prediction_scores
from ticklane.session import stored

FEATURES = "features"
PREDICTION = "prediction"


# --- tables --------------------------------------------------------------------------------

def join_factors(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Outer join of factor tables on their keys; all sides are partitioned the same way once."""
    return reduce(lambda left, right: left.join(right, keys, "full"), tables)


def base_training_table(factors: list[DataFrame], bars: DataFrame, keys: list[str],
                        as_float: bool = True) -> DataFrame:
    """Factors next to prices and returns of the same bar, as float columns."""
    table = join_factors([*factors, bars], keys)
    if not as_float:
        return table
    return table.select(*keys, *[
        F.col(f.name).cast("float") if f.dataType.simpleString() in ("double", "bigint", "int") else F.col(f.name)
        for f in table.schema.fields if f.name not in keys])


def add_columns(table: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Append columns by key, keeping the rows of the table."""
    return table.join(extra, keys, "left")


def keep_rows_of(table: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key survives in another table."""
    return table.join(kept.select(*keys), keys, "left_semi")


def stack_products(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all products with a product column."""
    return reduce(lambda a, b: a.unionByName(b),
                  [table.withColumn("product", F.lit(product)) for product, table in tables.items()])


def label_products(table: DataFrame, column: str, products: list[str], other: str = "other") -> DataFrame:
    """The stacked table of products that lie in one table: their name as a column, in one scan."""
    return table.withColumn("product", F.when(F.col(column).isin(products), F.col(column)).otherwise(F.lit(other)))


def mirror_rows(table: DataFrame, unchanged: list[str]) -> DataFrame:
    """Append every row with the sign of all but the listed columns turned."""
    turned = [F.col(c) if c in unchanged else (-F.col(c)).alias(c) for c in table.columns]
    return table.unionByName(table.select(*turned))


def split_by_date(table: DataFrame, split, moment: str = "datetime") -> tuple[DataFrame, DataFrame]:
    """Rows before the split and rows from it on."""
    return table.where(F.col(moment) < F.lit(split)), table.where(F.col(moment) >= F.lit(split))


def prediction_detail(predictions: DataFrame, start, end, moment: str = "datetime") -> DataFrame:
    return predictions.where(F.col(moment).between(F.lit(start), F.lit(end)))


def part_correlations(predictions: DataFrame, label: str, split, days: int = 10, date: str = "date") -> DataFrame:
    """Correlation on the training and test part, each also on its first trading days."""
    part = F.when(F.col(date) < F.lit(split), "train").otherwise("test")
    tagged = predictions.withColumn("part", part)
    # distinct dates of two parts
    dates = tagged.select("part", date).distinct()
    early = dates.withColumn("_n", F.row_number().over(Window.partitionBy("part").orderBy(date))) \
        .where(F.col("_n") <= days).drop("_n")
    whole = tagged.groupBy("part").agg(F.corr(PREDICTION, label).alias("correlation"))
    first = tagged.join(early, ["part", date], "left_semi").groupBy("part").agg(
        F.corr(PREDICTION, label).alias("first_days_correlation"))
    return whole.join(first, "part")


# --- models --------------------------------------------------------------------------------

@dataclass(frozen=True)
class BoostConfig:
    """Settings of the boosted trees."""

    max_iter: int = 20
    max_depth: int = 5
    step_size: float = 0.1
    subsample: float = 1.0
    seed: int = 42


def numeric_pipeline(features: list[str], label: str, config: BoostConfig = BoostConfig()) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol=FEATURES, handleInvalid="skip"),
        GBTRegressor(featuresCol=FEATURES, labelCol=label, predictionCol=PREDICTION, maxIter=config.max_iter,
                     maxDepth=config.max_depth, stepSize=config.step_size, subsamplingRate=config.subsample,
                     seed=config.seed)])


def tabular_pipeline(numeric: list[str], categorical: list[str], label: str, strategy: str = "mean",
                     config: BoostConfig = BoostConfig()) -> Pipeline:
    """Impute numbers, encode categories (last level dropped) and fit boosted trees."""
    imputed = [f"{c}_filled" for c in numeric]
    indexed = [f"{c}_index" for c in categorical]
    encoded = [f"{c}_vector" for c in categorical]
    return Pipeline(stages=[
        Imputer(strategy=strategy, inputCols=numeric, outputCols=imputed),
        StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        *numeric_pipeline([*imputed, *encoded], label, config).getStages()])


def fit(table: DataFrame, features: list[str], label: str, config: BoostConfig = BoostConfig()) -> PipelineModel:
    clean = table.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in [*features, label]})
    return numeric_pipeline(features, label, config).fit(clean.na.drop(subset=[*features, label]))


def predict(model: PipelineModel, table: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(table.na.drop(subset=features)).drop(FEATURES)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def standardize(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scale to zero mean and unit population deviation with the statistics of the training rows."""
    # one row
    row = train.agg(*[F.avg(c).alias(f"_mean_{c}") for c in features], *[F.stddev_pop(c).alias(f"_std_{c}") for c in features])
    scale = lambda c: F.when(F.col(f"_std_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_std_{c}"))

    def scaled(df: DataFrame) -> DataFrame:
        return df.crossJoin(F.broadcast(row)).withColumns(
            {c: (F.col(c) - F.col(f"_mean_{c}")) / scale(c) for c in features}).select(*df.columns)

    return scaled(train), scaled(test)


def impute(table: DataFrame, means: list[str] = (), modes: list[str] = ()) -> DataFrame:
    """Fill nulls with the mean or the most frequent value of the column (smallest one on ties)."""
    statistics = [F.avg(c).alias(f"_s_{c}") for c in means] + [F.mode(c, True).alias(f"_s_{c}") for c in modes]
    # one row
    row = table.agg(*statistics)
    return table.crossJoin(F.broadcast(row)).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_s_{c}")) for c in [*means, *modes]}).select(*table.columns)


def one_hot(table: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """One 0/1 column per level, and ``other`` for values that are none of them."""
    other = F.when(F.col(column).isin(levels), 0).when(F.col(column).isNotNull(), 1).otherwise(0)
    return table.withColumns({
        **{f"{column}__{level}": F.when(F.col(column) == level, 1).otherwise(0) for level in levels},
        f"{column}__other": other}).drop(column)


# --- many models over one training set -------------------------------------------------------

def binned_set(table: DataFrame, features: list[str], bins: int = 32) -> DataFrame:
    """The table with ``features`` as a vector of band numbers, written once for all models that are fitted on it.

    A band is a range between neighbouring quantiles (to 1/10,000 of the rows) of the whole table, so trees of up to
    ``bins`` bands need not look for split points again. Rows with a missing feature are left out.
    """
    shares = [i / bins for i in range(1, bins)]
    clean = table.withColumns({f"_f_{i}": nan_to_null(F.col(c).cast("double")) for i, c in enumerate(features)})
    # one row
    edges = clean.agg(*[F.percentile_approx(f"_f_{i}", shares, 10_000).alias(f"_e_{i}") for i in range(len(features))])
    band = lambda i: F.size(F.filter(f"_e_{i}", lambda edge: edge < F.col(f"_f_{i}"))).cast("double")
    placed = clean.na.drop(subset=[f"_f_{i}" for i in range(len(features))]).crossJoin(F.broadcast(edges))
    return stored(placed.select(*table.columns, array_to_vector(F.array(*[band(i) for i in range(len(features))])).alias(FEATURES)))


def _fit_and_predict(train: DataFrame, test: DataFrame, label: str, config: BoostConfig) -> DataFrame:
    """Stored predictions of the test rows by a model of the training rows that have a label."""
    known = train.withColumn("_label", nan_to_null(F.col(label).cast("double"))).where(F.col("_label").isNotNull())
    model = GBTRegressor(featuresCol=FEATURES, labelCol="_label", predictionCol=PREDICTION, maxIter=config.max_iter, maxDepth=config.max_depth,
                         stepSize=config.step_size, subsamplingRate=config.subsample, seed=config.seed).fit(known)
    return stored(model.transform(test).drop(FEATURES))


def _together(runs: list[Callable[[], DataFrame]], parallel: int) -> list[DataFrame]:
    """Runs whose jobs share the cluster, ``parallel`` at a time; the driver only waits."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(lambda run: run(), runs))


def walk_forward(table: DataFrame, features: list[str], label: str, splits: list, moment: str = "date",
                 config: BoostConfig = BoostConfig(), parallel: int = 4) -> DataFrame:
    """Fit on everything before each split, predict up to the next one, merge the predictions.

    The expanding spans are cut from one binned and stored set; ``parallel`` models are fitted at a time.
    """
    rows = binned_set(table, features)

    def run(start, end) -> DataFrame:
        train, span = split_by_date(rows, start, moment)
        if end is not None:
            span = span.where(F.col(moment) < F.lit(end))
        return _fit_and_predict(train, span, label, config).withColumn("trained_before", F.lit(str(start)))

    parts = _together([lambda s=s, e=e: run(s, e) for s, e in zip(splits, [*splits[1:], None])], parallel)
    return reduce(lambda a, b: a.unionByName(b), parts)


RUN = ("label", "split", "max_depth", "max_iter", "step_size")


def grid_predictions(table: DataFrame, features: list[str], labels: list[str], splits: list, configs: list[BoostConfig],
                     moment: str = "date", parallel: int = 4) -> list[tuple[tuple, DataFrame]]:
    """The predictions of every label, split and setting, each with its run (the fields of ``RUN``).

    All models are fitted on one binned and stored set, ``parallel`` at a time.
    """
    rows = binned_set(table, features)
    runs = [(label, split, config) for label in labels for split in splits for config in configs]
    found = _together([lambda r=r: _fit_and_predict(*split_by_date(rows, r[1], moment), r[0], r[2]) for r in runs], parallel)
    return [((label, str(split), c.max_depth, c.max_iter, c.step_size), made) for (label, split, c), made in zip(runs, found)]


def grid_search(table: DataFrame, features: list[str], labels: list[str], splits: list, configs: list[BoostConfig],
                product: str = "product", keys: list[str] = ("product",), length: int = 4800, width: float = 2.0,
                moment: str = "date", evaluator: Callable[[DataFrame, str, str], DataFrame] = prediction_scores, parallel: int = 4) -> DataFrame:
    """Fit every label, split and setting; one scored and backtested row (the total) per run.

    ``evaluator`` makes one row of scores from predictions and the names of prediction and label.
    """
    rows = []
    for run, predictions in grid_predictions(table, features, labels, splits, configs, moment, parallel):
        scores = evaluator(predictions, PREDICTION, run[0])
        flags = prediction_flags(predictions, PREDICTION, run[0], list(keys), length, width)
        total = backtest_report(flags, product).where(F.col(product) == "all").drop(product)
        rows.append(scores.crossJoin(F.broadcast(total)).select(*[F.lit(value).alias(name) for name, value in zip(RUN, run)], "*"))
    return reduce(lambda a, b: a.unionByName(b), rows)
