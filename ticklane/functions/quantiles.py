"""Exact linear-interpolation quantiles at any size, by narrowing.

A pass counts values in bins (partial counts within tasks) and keeps, of each wanted rank, only the bin that holds it;
the next pass reads values of those bins only, in finer bins. The first bins are powers of two, so an outlier costs
nothing; later ones divide a bin evenly between its smallest and largest value. A bin of few rows, or of one value
however often it stands there, is done. No pass shuffles more than bins, and the last one sorts at most ``most_rows``
rows of a bin, so neither a huge key nor a frequent value lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.session import BROADCAST_ROWS, stored

MOST_ROWS = 50_000
BINS = 4096
VALUE = "_v"
RANGE = ["_n", "_before", "_low", "_high"]


def _octave(value: Column) -> Column:
    """Number of a bin per sign and power of two; grows with the value, NaN last."""
    power = F.greatest(F.least(F.floor(F.log2(F.abs(value))), F.lit(1100)), F.lit(-1100)) + 1200
    return F.when(F.isnan(value), F.lit(5000)).when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * power)


def _ranks(probabilities: list[float]) -> Column:
    """The ranks next to each quantile, of ``_n`` values."""
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    return F.array_distinct(F.concat(F.array(*[F.floor(x) for x in place]), F.array(*[F.ceil(x) for x in place])))


def _holding_ranks(bins: DataFrame, group: list[str], keys: list[str], probabilities: list[float], most_rows: int) -> DataFrame:
    """Of counted bins in groups those that hold a wanted rank; at most BINS (or the powers of two) rows a group."""
    so_far = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.withColumn("_end", F.col("_start") + F.sum("_rows").over(so_far)).withColumn("_before", F.col("_end") - F.col("_rows"))
    if "_n" not in placed.columns:
        placed = placed.withColumn("_n", F.sum("_rows").over(Window.partitionBy(*group)))
    held = F.exists(_ranks(probabilities), lambda rank: (rank >= F.col("_before")) & (rank < F.col("_end")))
    is_open = (F.col("_rows") > most_rows) & (F.col("_low") < F.col("_high"))
    return placed.where(held).select(*keys, *RANGE, "_rows", is_open.alias("_open"))


def _within(values: DataFrame, ranges: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The values that lie in a range of their key, with the range."""
    value = F.col(VALUE)
    if not keys:
        # two ranges at most for each quantile
        found = F.lit(None).cast("struct<_n:long,_before:long,_low:double,_high:double>")
        for row in ranges.select(*RANGE).collect():
            own = F.struct(*[F.lit(row[name]).alias(name) for name in RANGE])
            found = F.when(value.between(row["_low"], row["_high"]), own).otherwise(found)
        return values.select(VALUE, found.alias("_range")).where(F.col("_range").isNotNull()).select(VALUE, *[f"_range.{name}" for name in RANGE])
    names = {key: f"{key}_of_range" for key in keys}
    ranges = ranges.select(*keys, *RANGE).withColumnsRenamed(names)
    same = value.between(F.col("_low"), F.col("_high"))
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return values.join(F.broadcast(ranges) if count <= BROADCAST_ROWS else ranges, same).drop(*names.values())


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], keys: list[str] | None = None,
                    output: str = "quantiles", most_rows: int = MOST_ROWS, reread: bool = False) -> DataFrame:
    """One row per key with an array of the quantiles, in the order of ``probabilities``.

    Null values do not count; a key without values has no row. NaN counts as the largest value. Null keys are a key.
    Passes read the values again: they are stored first, unless ``reread`` says that ``df`` is a plain scan.
    """
    keys = keys or []
    values = df.where(F.col(column).isNotNull()).select(*keys, (F.col(column).cast("double") + F.lit(0.0)).alias(VALUE))
    if not reread:
        values = stored(values)
    counted = [F.count(F.lit(1)).alias("_rows"), F.min(VALUE).alias("_low"), F.max(VALUE).alias("_high")]
    bins = values.groupBy(*keys, _octave(F.col(VALUE)).alias("_bin")).agg(*counted).withColumn("_start", F.lit(0).cast("long"))
    ranges = stored(_holding_ranks(bins, keys, keys, probabilities, most_rows))
    done = None
    while True:
        count, wide = ranges.agg(F.count(F.lit(1)), F.count(F.when(F.col("_open"), 1))).first()
        if not wide:
            break
        closed = ranges.where(~F.col("_open"))
        done = closed if done is None else done.unionByName(closed)
        inside = _within(values, ranges.where("_open"), keys, wide)
        share = (F.col(VALUE) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        group = [*keys, "_n", "_start", "_from"]
        bins = inside.withColumns({"_bin": F.least(F.floor(share * BINS), F.lit(BINS - 1)), "_start": F.col("_before"), "_from": F.col("_low")}).groupBy(
            *group, "_bin").agg(*counted)
        ranges = stored(_holding_ranks(bins, group, keys, probabilities, most_rows))
    ranges = ranges if done is None else done.unionByName(ranges)
    several = F.col("_low") < F.col("_high")
    total = ranges.count() if done is not None else count
    inside = _within(values, ranges.where(several), keys, total).groupBy(*keys, *RANGE, VALUE).agg(F.count(F.lit(1)).alias("_rows"))
    # at most most_rows rows of a range
    so_far = Window.partitionBy(*keys, *RANGE).orderBy(VALUE).rowsBetween(Window.unboundedPreceding, 0)
    sorted_values = inside.withColumn("_end", F.col("_before") + F.sum("_rows").over(so_far)).select(
        *keys, "_n", VALUE, (F.col("_end") - F.col("_rows")).alias("_begin"), "_end")
    single = ranges.where(~several | F.isnan("_low")).select(*keys, "_n", F.col("_low").alias(VALUE), F.col("_before").alias("_begin"),
                                                             (F.col("_before") + F.col("_rows")).alias("_end"))
    runs = sorted_values.unionByName(single)
    at_rank = lambda rank: F.max(F.when((F.col("_begin") <= rank) & (rank < F.col("_end")), F.col(VALUE)))
    parts = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        parts += [at_rank(F.floor(place)).alias(f"_lo{i}"), at_rank(F.ceil(place)).alias(f"_hi{i}")]
    if keys:
        picked = runs.groupBy(*keys, "_n").agg(*parts)
    else:
        picked = runs.agg(F.max("_n").alias("_n"), *parts).where(F.col("_n").isNotNull())
    exact = []
    for i, p in enumerate(probabilities):
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high, share = F.col(f"_lo{i}"), F.col(f"_hi{i}"), place - F.floor(place)
        # no difference of equal infinite values
        exact.append(F.when((share == 0) | (low == high), low).otherwise(low + (high - low) * share))
    result = picked.select(*keys, F.array(*exact).alias(output))
    return F.broadcast(result) if total <= BROADCAST_ROWS else result
