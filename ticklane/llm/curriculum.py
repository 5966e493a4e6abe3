"""Mixing sources along a curriculum: weight schedules over training time decide how much and when each source is read.

The weight of a source is a piecewise linear function of training time from 0 to 1. Its integral is the share of the
source in the whole mix; shares become targets in words, a target stops at a few times the words that the source has,
and the excess goes to the others by weight until none is above. A source reads its documents in an order of hashes,
again from the start when they are used up. The word at which a document begins is so much of the source's demand, and
the time at which the cumulative schedule reaches that demand is the document's training position: one inversion of a
quadratic, no simulation. A source ends with the word that fills its target, so the last document may be read in part.

Everything is column expressions. A source may hold any share of the documents: it is cut into ranges of the hash,
sums of ranges are carried, and equal rows are one counted row, so no task holds a source or a group of equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklane.llm.shared import small, stored

# knots (time, weight) of the schedules, dealt to the sources in turn; they integrate to 5, 2 and 1
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)))
MOST_REPEATS = 3
SPACES = r"[\x20\x09-\x0D]+"
RANGE_ROWS = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACES), "")), F.lit(0)).cast("long")


def integral(knots: tuple) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))


def time_of_demand(share: Column, knots: tuple) -> Column:
    """The time at which a schedule has asked for this share of all it asks for."""
    area = share * F.lit(integral(knots))
    pieces, done = [], 0.0
    for (a, v), (b, w) in zip(knots, knots[1:]):
        if b > a:
            pieces.append((done, a, v, (w - v) / (b - a)))
            done += (b - a) * (v + w) / 2
    result = None
    for before, start, weight, slope in pieces:
        rest = area - F.lit(before)
        root = F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * rest, F.lit(0.0)))
        at = F.when(rest > 0, F.lit(start) + F.lit(2.0) * rest / (F.lit(weight) + root)).otherwise(F.lit(start))
        result = at if result is None else F.when(area >= before, at).otherwise(result)
    return result


def by_schedule(schedules: tuple, turn: Column, value) -> Column:
    """``value`` of the schedule that a source has in turn."""
    result = value(schedules[-1])
    for i in range(len(schedules) - 1):
        result = F.when(turn == i, value(schedules[i])).otherwise(result)
    return result


def targets(sizes: DataFrame, schedules: tuple = SCHEDULES, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``rank``, ``source``, ``source_size``, ``turn`` (number of its schedule), ``target`` in words (double) and ``demand`` (whole words).

    ``sizes`` has one row per source with its words. Sources are ranked by code point, null last; this takes one task
    over the rows of ``sizes``, which are sources, not documents.
    """
    weight = by_schedule(schedules, F.col("turn"), lambda knots: F.lit(integral(knots)))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = stored(ranked.withColumn("turn", F.col("rank") % len(schedules)).withColumn("weight", weight)
                    .withColumn("most", F.col("source_size") * most_repeats))
    words, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, full = words, -1
    while True:  # a round fills at least one more source, or is the last
        above = F.lit(float(left)) * F.col("weight") > F.col("most") * F.lit(float(weights))
        filled, given, open_weights = ranked.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)),
                                                 F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if filled == full or not open_weights:
            break
        left, weights, full = words - given, open_weights, filled
    target = F.when(above, F.col("most").cast("double")).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(weights or 1.0)))
    return ranked.withColumn("target", target).select("rank", "source", "source_size", "turn", "target",
                                                      F.floor(F.col("target") + 0.5).alias("demand"))


def mix_sources(docs: DataFrame, schedules: tuple = SCHEDULES, most_repeats: int = MOST_REPEATS, id_column: str = "doc_id",
                text_column: str = "text", source_column: str = "source", seed: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words that the
    mix takes, repeats counted) and ``positions`` (training times from 0 to 1 at which it is read, one for each pass).

    ``schedules`` are knots (time, weight) from time 0 to 1, dealt to the sources in turn by code point, null last.
    Texts that are null or have no words have size 0 and are never read; a source of such texts only has target 0.
    Rows with equal ids follow each other by size, rows equal in id, size and source are read one after another; a null
    id counts as the empty one. Other columns are left out; an empty table gives no rows.
    """
    sized = stored(docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
                               word_count(F.col(text_column)).alias("size")))
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), schedules, most_repeats))
    digits = max(2, math.ceil(math.log(max(sized.count(), 1) / RANGE_ROWS, 16)))
    key = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16)
    entries = (sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
               .join(small(sources), sized["source"].eqNullSafe(sources["source"]))
               .select("rank", "doc_id", "size", "copies", key.alias("key")).withColumn("range", F.substring("key", 1, digits)))
    entries = stored(entries)
    words = F.col("size") * F.col("copies")
    sums = entries.groupBy("rank", "range").agg(F.sum(words).alias("words"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("rank", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("carry"))
    within = Window.partitionBy("rank", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(
        Window.unboundedPreceding, 0)
    placed = (entries.join(carried, ["rank", "range"])
              .withColumn("begin", F.col("carry") + F.sum(words).over(within) - words)
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
              .withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")))
    placed = placed.join(small(sources), "rank")
    starts = [F.col("begin") + F.lit(i) * F.col("source_size") for i in range(most_repeats)]
    read = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("demand") - start)) for start in starts]
    time = by_schedule(schedules, F.col("turn"), lambda knots: F.transform(
        F.filter(F.array(*starts), lambda start: start < F.col("demand")),
        lambda start: time_of_demand(start.cast("double") / F.col("demand").cast("double"), knots)))
    positions = F.when(F.col("size") > 0, time).otherwise(F.array().cast("array<double>"))
    return placed.select("doc_id", "source", "size", "source_size", "target", sum(read[1:], read[0]).cast("long").alias("taken"),
                         positions.alias("positions"))


def in_training_order(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      source_column: str = "source") -> DataFrame:
    """The documents in the order in which training reads them: sorted by ``position``, one row for each pass, with ``words`` read.

    ``mixed`` is the result of :func:`mix_sources` on the same documents. All columns of ``docs`` are kept (columns of the
    result's names are replaced); documents that the mix does not take are left out.
    """
    names = ["mix_id", "mix_source", "mix_size", "mix_copy"]
    own = docs.drop("position", "words", *names).withColumn("mix_id", F.col(id_column)).withColumn("mix_source", F.col(source_column)).withColumn(
        "mix_size", word_count(F.col(text_column)))
    # copies are only told apart among rows of one id, size and source
    equal = Window.partitionBy("mix_id", "mix_source", "mix_size")
    own = own.withColumn("mix_copy", F.row_number().over(equal.orderBy(F.xxhash64(text_column))))
    wanted = (mixed.select(F.col("doc_id").alias("at_id"), F.col("source").alias("at_source"), F.col("size").alias("at_size"), "taken", "positions")
              .withColumn("at_copy", F.row_number().over(Window.partitionBy("at_id", "at_source", "at_size").orderBy("positions"))))
    same = (F.col("mix_id").eqNullSafe(F.col("at_id")) & F.col("mix_source").eqNullSafe(F.col("at_source"))
            & (F.col("mix_size") == F.col("at_size")) & (F.col("mix_copy") == F.col("at_copy")))
    passes = own.join(wanted, same).select(*own.columns, "taken", F.posexplode("positions").alias("mix_pass", "position"))
    passes = passes.withColumn("words", F.least(F.col("mix_size"), F.col("taken") - F.col("mix_pass") * F.col("mix_size")))
    return (passes.drop("taken", "mix_pass", *names).repartitionByRange("position").sortWithinPartitions("position"))
