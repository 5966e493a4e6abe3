"""Windows over long ordered series, without one task per series.

A series (one contract, say) may hold a large share of all rows. Three helpers keep its work
spread over many tasks:

* ``with_position`` numbers the rows of a series bucket by bucket (a trading day is a bucket) and
  adds the number of rows in earlier buckets;
* ``SeriesColumns`` records window columns together with how far back each one looks, cuts the
  series into chunks of ``chunk_rows`` rows, gives each chunk the earlier rows its windows need,
  and drops those rows again afterwards;
* ``running_total`` adds up within buckets and carries the totals of earlier buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_ROWS = 20_000


def with_position(df: DataFrame, keys: list[str], order: list[str], bucket: str, name: str = "pos") -> DataFrame:
    """Add the 0-based row number within each series. ``bucket`` must not decrease along ``order``.

    The input is read twice (bucket sizes, then rows): pass a stored or persisted table.
    """
    sizes = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, bucket, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.join(starts, [*keys, bucket])
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_start")
    )


def running_totals(df: DataFrame, keys: list[str], order: list[str], bucket: str,
                   values: dict[str, Column | str]) -> DataFrame:
    """Cumulative sums along each series, carried over buckets; ``values`` maps result names to what is
    added up. Nulls count as zero."""
    summed = {f"_value_{name}": F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0))
              for name, value in values.items()}
    df = df.withColumns(summed)
    sums = df.groupBy(*keys, bucket).agg(*[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in values])
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, bucket, *[
        F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_carry_{name}") for name in values])
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(carried, [*keys, bucket])
        .withColumns({name: F.col(f"_carry_{name}") + F.sum(f"_value_{name}").over(within) for name in values})
        .drop(*[f"{part}_{name}" for name in values for part in ("_carry", "_value")])
    )


def running_total(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: Column | str,
                  name: str) -> DataFrame:
    """One cumulative sum along each series."""
    return running_totals(df, keys, order, bucket, {name: value})


def _order_key(order: list[str]) -> Column:
    # a single fixed-width column keeps min_by and max_by in a hash aggregate
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def previous_value(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str,
                   name: str) -> DataFrame:
    """Value of the row before, across buckets: the first row of a bucket takes the last earlier one."""
    lasts = df.groupBy(*keys, bucket).agg(F.max_by(value, _order_key(order)).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(bucket)
    carried = lasts.select(*keys, bucket, F.lag("_last").over(earlier).alias("_carry"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    is_first = F.row_number().over(within) == 1
    return (
        df.join(carried, [*keys, bucket])
        .withColumn(name, F.when(is_first, F.col("_carry")).otherwise(F.lag(value).over(within)))
        .drop("_carry")
    )


class SeriesColumns:
    """Named window columns of ordered series and how many earlier rows each one needs.

    Columns are recorded with :meth:`add` and friends (a name is recorded once, so operators that
    share an intermediate share its column) and computed by :meth:`apply`.
    """

    def __init__(self) -> None:
        self._steps: dict[str, tuple[str, object]] = {}
        self._inputs: dict[str, list[str]] = {}
        self._own: dict[str, tuple[int, int]] = {}
        # columns of one level need only earlier levels and are added in one projection
        self._level: dict[str, int] = {}

    # recording ---------------------------------------------------------------------------

    def _record(self, kind: str, name: str, detail: object, inputs: Iterable[str], back: int = 0, ahead: int = 0) -> str:
        if name not in self._steps:
            self._inputs[name] = list(inputs)
            self._level[name] = 1 + max((self._level.get(i, 0) for i in self._inputs[name]), default=0)
            self._own[name] = (back, ahead)
            self._steps[name] = (kind, detail)
        return name

    def add(self, name: str, build: Callable[[WindowSpec], Column], inputs: Iterable[str] = (),
            back: int = 0, ahead: int = 0) -> str:
        return self._record("window", name, build, inputs, back, ahead)

    def within_blocks(self, name: str, build: Callable[[WindowSpec], Column], rows: int, inputs: Iterable[str] = (),
                      reverse: bool = False) -> str:
        """A window column whose series is cut into blocks of ``rows`` positions, forwards or backwards.

        A backwards column is complete on rows whose block has ended before the rows that use it.
        """
        return self._record("blocks", name, (build, rows, reverse), inputs, 0 if reverse else rows - 1)

    def value(self, name: str, column: Column, inputs: Iterable[str] = ()) -> str:
        """A row-wise column."""
        return self.add(name, lambda w: column, inputs)

    def lag(self, column: str, rows: int = 1) -> str:
        return self.add(f"{column}__lag{rows}", lambda w: F.lag(column, rows).over(w), [column], back=rows)

    def lead(self, column: str, rows: int = 1) -> str:
        return self.add(f"{column}__lead{rows}", lambda w: F.lead(column, rows).over(w), [column], ahead=rows)

    def rolling(self, kind: str, column: str, rows: int, aggregate: Callable[[Column], Column] | None = None) -> str:
        """Aggregate over the last ``rows`` rows; null until all of them hold a value."""
        aggregate = aggregate or ROLLING[kind]

        def build(w: WindowSpec) -> Column:
            frame = w.rowsBetween(1 - rows, 0)
            return F.when(F.count(column).over(frame) == rows, aggregate(F.col(column)).over(frame))

        return self.add(f"{column}__{kind}{rows}", build, [column], back=rows - 1)

    def smooth(self, column: str, span: int) -> str:
        """Recursive smoothing y = αx + (1−α)y₋₁ with α = 2/(span+1), from the first value of the series on."""
        return self._record("smooth", f"{column}__ema{span}", (column, span), [column])

    def in_arrow(self, column: str, rows: int, function: Callable[[np.ndarray], np.ndarray], name: str) -> str:
        """A numpy function from the values of a chunk, in order, to one number for each; it looks back ``rows`` - 1 rows."""
        return self._record("arrow", name, (column, function), [column], rows - 1)

    def rolling_apply(self, column: str, rows: int, function: Callable, name: str) -> str:
        """Arbitrary numpy function of the last ``rows`` values."""
        return self.in_arrow(column, rows, lambda values: pd.Series(values).rolling(rows).apply(function, raw=True).to_numpy(), name)

    def rolling_quantile(self, column: str, rows: int, share: float, name: str) -> str:
        """Quantile of the last ``rows`` values by a sorted structure that each row enters and leaves in logarithmic time."""
        return self.in_arrow(column, rows, lambda values: pd.Series(values).rolling(rows).quantile(share).to_numpy(), name)

    # computing ---------------------------------------------------------------------------

    def _needed(self, names: Iterable[str], given: set[str]) -> set[str]:
        """The recorded columns that these need, themselves included, without given ones."""
        found, left = set(), [n for n in names]
        while left:
            name = left.pop()
            if name in self._steps and name not in given and name not in found:
                found.add(name)
                left += self._inputs[name]
        return found

    def _reach(self, names: Iterable[str], given: set[str]) -> tuple[int, int]:
        """Rows back and ahead that these columns look."""
        ends: dict[str, tuple[int, int]] = {}
        for name in sorted(self._needed(names, given), key=self._level.get):
            inputs = [ends.get(i, (0, 0)) for i in self._inputs[name]]
            ends[name] = tuple(max((i[side] for i in inputs), default=0) + self._own[name][side] for side in (0, 1))
        return max((b for b, _ in ends.values()), default=0), max((a for _, a in ends.values()), default=0)

    def _windows(self, df: DataFrame, keys: list[str], position: str, chunk_rows: int, names: Iterable[str], given: set[str],
                 more_back: int = 0) -> DataFrame:
        """Chunks (``_chunk``) with the earlier and later rows that the columns need, and the columns."""
        names = self._needed(names, given)
        back, ahead = self._reach(names, given)
        first = F.floor((F.col(position) - ahead) / chunk_rows)
        last = F.floor((F.col(position) + back + more_back) / chunk_rows)
        chunked = df.withColumn("_chunk", F.explode(F.sequence(first, last)) if back + more_back + ahead else first)
        window = Window.partitionBy(*keys, "_chunk").orderBy(position)
        for level in sorted({self._level[name] for name in names}):
            added = {}
            for name in (n for n in self._steps if n in names and self._level[n] == level):
                kind, detail = self._steps[name]
                if kind == "window":
                    added[name] = detail(window)
                else:
                    build, rows, reverse = detail
                    place = F.col(position)
                    added[name] = build(Window.partitionBy(*keys, "_chunk", F.floor(place / rows)).orderBy(place.desc() if reverse else place))
            chunked = chunked.withColumns(added)
        return chunked

    def apply(self, df: DataFrame, keys: list[str], position: str = "pos", chunk_rows: int = CHUNK_ROWS,
              keep: Iterable[str] | None = None) -> DataFrame:
        """Compute all recorded columns. ``position`` numbers the rows of each series without holes.

        Windows count rows and chunks are cut by position, so a hole in the numbers would lose rows at a
        chunk's edge: number them with :func:`with_position`.

        Columns that Spark's windows cannot express run in Python on keys, position and their inputs alone and are
        joined back by position. ``keep`` lists the recorded columns to return besides the input columns (default: all).
        """
        source = df.columns
        added = [n for n in (self._steps if keep is None else keep) if n not in source]
        chunk_rows = max(chunk_rows, 1)
        needed, given = self._needed(added, set(source)), set(source)
        outside = [name for name in needed if self._steps[name][0] in ("smooth", "arrow")]
        for level in sorted({self._level[name] for name in outside}):
            for kind, compute in (("arrow", _arrow_columns), ("smooth", _smoothed_columns)):
                steps = {n: self._steps[n][1] for n in self._steps if n in outside and self._level[n] == level and self._steps[n][0] == kind}
                if steps:
                    inputs = list(dict.fromkeys(i for n in steps for i in self._inputs[n]))
                    more = max(self._own[n][0] for n in steps)
                    chunks = self._windows(df, keys, position, chunk_rows, inputs, given, more)
                    narrow = chunks.select(*keys, position, F.col("_chunk").cast("long").alias("_chunk"), *[F.col(i).cast("double").alias(i) for i in inputs])
                    df = _joined_by_position(df, compute(narrow, keys, position, chunk_rows, steps), keys, position)
                    given |= set(steps)
        left = self._needed(added, given)
        if left:
            df = self._windows(df, keys, position, chunk_rows, left, given)
            if any(self._reach(left, given)):
                df = df.where(F.floor(F.col(position) / chunk_rows) == F.col("_chunk"))
        return df.select(*source, *added)


ROLLING: dict[str, Callable[[Column], Column]] = {
    "avg": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def _joined_by_position(df: DataFrame, found: DataFrame, keys: list[str], position: str) -> DataFrame:
    names = {name: f"_{name}_found" for name in [*keys, position]}
    found = found.withColumnsRenamed(names)
    same = F.col(position) == F.col(names[position])
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(names[key]))
    return df.join(found, same, "left").drop(*names.values())


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[name] for name in names]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, null as NaN."""
    return table[name].cast(pa.float64()).to_numpy()


def _arrow_columns(narrow: DataFrame, keys: list[str], position: str, chunk_rows: int, steps: dict[str, tuple]) -> DataFrame:
    """The rows of each chunk with the columns, computed from a chunk's values in order."""
    schema = T.StructType([*_fields(narrow, [*keys, position]), *[T.StructField(name, T.DoubleType()) for name in steps]])

    def compute(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(position)
        own = _numbers(chunk, position) >= chunk["_chunk"][0].as_py() * chunk_rows
        result = chunk.select([*keys, position])
        for name, (column, function) in steps.items():
            result = result.append_column(name, pa.array(np.asarray(function(_numbers(chunk, column)), dtype="float64"), from_pandas=True))
        return result.filter(pa.array(own))

    return narrow.groupBy(*keys, "_chunk").applyInArrow(compute, schema)


def _recursion(values: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(values).ewm(span=span, adjust=False).mean().to_numpy()


def _smoothed_columns(narrow: DataFrame, keys: list[str], position: str, chunk_rows: int, steps: dict[str, tuple]) -> DataFrame:
    """Smoothing as a scan over chunks.

    From its first value on, a chunk is an affine map of the smoothed value there. The maps of a series (a row for each
    chunk) are composed one after the other; then each chunk runs from the value that its own first row has in the whole
    series. After g rows without a value the older part weighs (1−α) to the power g+1 against α.
    """
    doubles = [f"{part}_{i}" for i in range(len(steps)) for part in ("first", "lead", "decay", "local", "trail")]
    maps = T.StructType([*_fields(narrow, keys), T.StructField("_chunk", T.LongType()), T.StructField("_rows", T.DoubleType()),
                         *[T.StructField(name, T.DoubleType()) for name in doubles]])
    starts = [f"{part}_{i}" for i in range(len(steps)) for part in ("carry", "start")]
    carried = T.StructType([*maps.fields[:len(keys) + 1], *[T.StructField(name, T.DoubleType()) for name in starts]])
    result = T.StructType([*_fields(narrow, [*keys, position]), *[T.StructField(name, T.DoubleType()) for name in steps]])
    column_of = lambda values: pa.array(np.asarray(values, dtype="float64"), from_pandas=True)

    def to_map(chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(position)
        row = chunk.select([*keys, "_chunk"]).slice(0, 1).append_column("_rows", column_of([len(chunk)]))
        for i, (column, span) in enumerate(steps.values()):
            values = _numbers(chunk, column)
            there = np.nonzero(~np.isnan(values))[0]
            parts = [np.nan, len(values), np.nan, np.nan, len(values)]
            if len(there):
                rest = values[there[0]:]
                unit, local = np.where(np.isnan(rest), np.nan, 0.0), rest.copy()
                unit[0], local[0] = 1.0, 0.0
                parts = [rest[0], there[0], _recursion(unit, span)[-1], _recursion(local, span)[-1], len(values) - 1 - there[-1]]
            for name, part in zip(doubles[5 * i:5 * i + 5], parts):
                row = row.append_column(name, column_of([part]))
        return row

    def compose(series: pa.Table) -> pa.Table:
        series = series.sort_by("_chunk")
        found = series.select([*keys, "_chunk"])
        for i, (_, span) in enumerate(steps.values()):
            alpha = 2 / (span + 1)
            rows, parts = _numbers(series, "_rows"), [_numbers(series, name) for name in doubles[5 * i:5 * i + 5]]
            value, weight, before, at_start = np.nan, 1.0, [], []
            for count, first, lead, decay, local, trail in zip(rows, *parts):
                before.append(value)
                if np.isnan(first):
                    at_start.append(np.nan)
                    weight *= (1 - alpha) ** count
                    continue
                weight *= (1 - alpha) ** (lead + 1)
                start = first if np.isnan(value) else (weight * value + alpha * first) / (weight + alpha)
                at_start.append(start)
                value, weight = decay * start + local, (1 - alpha) ** trail
            found = found.append_column(f"carry_{i}", column_of(before)).append_column(f"start_{i}", column_of(at_start))
        return found

    def run(chunk: pa.Table, start: pa.Table) -> pa.Table:
        chunk = chunk.sort_by(position)
        rows = chunk.select([*keys, position])
        for i, (name, (column, span)) in enumerate(steps.items()):
            values = _numbers(chunk, column)
            there = np.nonzero(~np.isnan(values))[0]
            smoothed = np.full(len(values), _numbers(start, f"carry_{i}")[0])
            if len(there):
                values = values.copy()
                values[there[0]] = _numbers(start, f"start_{i}")[0]
                smoothed[there[0]:] = _recursion(values[there[0]:], span)
            rows = rows.append_column(name, column_of(smoothed))
        return rows

    # neighbours of a chunk have done their work for the inputs
    own = narrow.where(F.floor(F.col(position) / chunk_rows) == F.col("_chunk"))
    chunks = own.groupBy(*keys, "_chunk")
    composed = chunks.applyInArrow(to_map, maps).groupBy(*keys).applyInArrow(compose, carried)
    return chunks.cogroup(composed.groupBy(*keys, "_chunk")).applyInArrow(run, result)


def last_value(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """The last value of the series on each of its rows, carried back over buckets: rows meet it on keys and bucket."""
    ends = df.groupBy(*keys, bucket).agg(F.max_by(value, _order_key(order)).alias("_end"))
    series = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = ends.select(*keys, bucket, F.last("_end").over(series).alias(name))
    return df.join(carried, [*keys, bucket])


def next_value(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, name: str) -> DataFrame:
    """Value of the row after, across buckets: the last row of a bucket takes the first later one."""
    firsts = df.groupBy(*keys, bucket).agg(F.min_by(value, _order_key(order)).alias("_next"))
    later = Window.partitionBy(*keys).orderBy(bucket)
    carried = firsts.select(*keys, bucket, F.lead("_next").over(later).alias("_carry"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order)
    is_last = F.lead(F.lit(1)).over(within).isNull()
    return (
        df.join(carried, [*keys, bucket])
        .withColumn(name, F.when(is_last, F.col("_carry")).otherwise(F.lead(value).over(within)))
        .drop("_carry")
    )
