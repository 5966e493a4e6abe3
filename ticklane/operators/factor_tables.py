"""Factor tables: lookup by name, build over products and contracts, cut to main spans, organize."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklane.functions.scalar import parse_parameters
from ticklane.operators.calendar import main_spans
from ticklane.operators.cross_section import SPOT_FACTORS, SpotFactor, align_to_bars, spot_factors
from ticklane.operators.price_volume import FACTORS, OBV_CODE, PriceVolumeFactor, factor_columns
from ticklane.session import with_key_rows

Handler = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FactorRequest:
    """A factor with its lengths, resolved from its configured name."""

    code: str
    version: str
    params: tuple[int, ...]

    @property
    def is_spot(self) -> bool:
        return self.code in SPOT_FACTORS

    @property
    def keys(self) -> list[str]:
        if self.code == OBV_CODE or not self.params:
            return [self.code]
        return [f"{self.code}__{p}" for p in self.params]


def all_factors() -> dict[str, PriceVolumeFactor | SpotFactor]:
    """Every factor by full name ``code_version``."""
    return {f.full_name: f for f in [*FACTORS.values(), *SPOT_FACTORS.values()]}


def resolve_factor(full_name: str, parameter: str | None = None) -> FactorRequest:
    """Look a factor up by full name; ``parameter`` is a list such as ``20|50|100``."""
    if full_name == f"{OBV_CODE}_1.0":
        return FactorRequest(OBV_CODE, "1.0", ())
    known = all_factors()
    if full_name not in known:
        raise KeyError(f"no factor named {full_name}")
    factor = known[full_name]
    params = tuple(int(p) for p in parameter.split("|")) if parameter else tuple(factor.params)
    return FactorRequest(factor.code, factor.version, params)


def factor_config(spark) -> DataFrame:
    """The registry as a configuration table."""
    rows = [(f.code, f.version, f.code[4:6], f.code[7:10], "|".join(map(str, f.params)), f.full_name)
            for f in all_factors().values()]
    return spark.createDataFrame(
        rows, "code string, version string, type string, number string, parameter string, full_name string")


def select_factors(config: DataFrame, full_names: list[str] | None = None) -> DataFrame:
    chosen = config if full_names is None else config.where(F.col("full_name").isin(full_names))
    return chosen.withColumn("params", F.when(F.col("parameter") != "", parse_parameters("parameter")))


def cut_to_main_span(table: DataFrame, contracts: DataFrame) -> DataFrame:
    """Rows of a contract between its first and last date as main contract.

    Must follow the windows: cutting earlier would change the first values.
    """
    spans = main_spans(contracts).select("instrument", "start_date", "end_date")
    return with_key_rows(table, spans, ["instrument"]).where(
        F.col("date").between(F.col("start_date"), F.col("end_date"))).drop("start_date", "end_date")


def build_factor_table(bars: DataFrame, requests: list[FactorRequest], contracts: DataFrame | None = None,
                       ticks: DataFrame | None = None, constituents: DataFrame | None = None,
                       invalid: DataFrame | None = None, finished: DataFrame | None = None,
                       series_keys: list[str] | None = None, chunk_rows: int = 20_000,
                       size: float | None = None) -> DataFrame:
    """Bars of all products and contracts with all requested factors, in one job.

    ``finished`` lists contracts to skip. Spot factors need ticks and constituents and bars with a
    product; they are joined to the bars on product and datetime.
    """
    if finished is not None:
        bars = bars.join(finished.select("instrument").distinct(), "instrument", "left_anti")
    price = {r.code: list(r.params) for r in requests if not r.is_spot}
    spot = {r.code: r.params for r in requests if r.is_spot}
    table = factor_columns(bars, price, series_keys or ["instrument"], chunk_rows=chunk_rows) if price else bars
    if spot:
        table = align_to_bars(table, spot_factors(ticks, constituents, spot, invalid, size))
    return table if contracts is None else cut_to_main_span(table, contracts)


# --- organizing ----------------------------------------------------------------------------

def excluding_dates(dates: DataFrame) -> Handler:
    """Drop rows on the given dates."""
    return lambda table: table.join(dates.select("date").distinct(), "date", "left_anti")


def zero_missing_on(dates: DataFrame, columns: list[str]) -> Handler:
    """Missing values become 0 on the given dates."""
    def handle(table: DataFrame) -> DataFrame:
        marked = table.join(dates.select("date").distinct().withColumn("_listed", F.lit(True)), "date", "left")
        return marked.withColumns({
            c: F.when(F.col("_listed") & F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c)) for c in columns}) \
            .select(*table.columns)

    return handle


def replacing_cells(recomputed: DataFrame, keys: list[str], columns: list[str]) -> Handler:
    """Take recomputed values where the keys match, and keep the rest."""
    def handle(table: DataFrame) -> DataFrame:
        fresh = recomputed.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns])
        return table.join(fresh, keys, "left").withColumns(
            {c: F.coalesce(F.col(f"_n_{c}"), F.col(c)) for c in columns}).select(*table.columns)

    return handle


def organize(table: DataFrame, code: str, handlers: list[tuple[set[str] | None, Handler]]) -> DataFrame:
    """Run the handlers that apply to a factor, in order. A handler without codes applies to all."""
    chosen = [handle for codes, handle in handlers if codes is None or code in codes]
    return reduce(lambda df, handle: df.transform(handle), chosen, table)


def recompute_dates(table: DataFrame, rebuilt: DataFrame, dates: DataFrame) -> DataFrame:
    """Replace all rows of some dates by a rebuilt version."""
    listed = dates.select("date").distinct()
    return table.join(listed, "date", "left_anti").unionByName(
        rebuilt.join(listed, "date", "left_semi").select(*table.columns))


def adjustment_factors(raw: DataFrame, adjusted: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Adjusted over raw open per date and its change from the date before."""
    both = raw.select(*keys, date, F.col("open").alias("_raw")).join(
        adjusted.select(*keys, date, F.col("open").alias("_adjusted")), [*keys, date])
    value = F.try_divide(F.col("_adjusted"), F.col("_raw"))
    day = Window.partitionBy(*keys).orderBy(date)
    return both.withColumn("value", value).withColumn("change", F.col("value") - F.lag("value").over(day)) \
        .drop("_raw", "_adjusted")


