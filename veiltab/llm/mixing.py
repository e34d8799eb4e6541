"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies: target words / source words, at most the repeat
limit. Documents of a source are laid out in an order that has every size in it, expected copies are summed along
it, one random offset per source is added, and a document is emitted once for each integer that its stretch crosses.

The order: a source is cut into slots of about ``SLOT_ROWS`` documents by a hash of the id; inside a slot documents
stand by size (odd slots downwards, so neighbours at a border are alike). A slot is a window of bounded size, so a
source with a third of all rows is spread over many tasks; slot totals give each slot its place.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a source without
words has target 0 and gives nothing; equal sizes stand in order of id; rows with equal id and size are interchangeable;
an empty table gives no rows. Other columns pass through unchanged in :func:`mix`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.common import attach, draw, text_of, written

WEIGHTS = (1.0, 2.0, 3.0)  # repeating over the sources in code point order
REPEAT_LIMIT = 3
SLOT_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = REPEAT_LIMIT, share: float = 1.0) -> DataFrame:
    """One row per source of ``sizes(source, size)``: rows, words, target and copies expected of each document.

    Targets are weight x level, stopped at ``limit`` x words. Sources sorted by limit / weight are stopped one after the other;
    the level that spreads the rest over the sources not yet stopped is right for the first source it does not stop; later
    levels are lower, so it is the greatest level not above its own source's ratio.
    """
    per_source = sizes.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    # one row per source from here on: the pre-aggregated table is what the global order is taken of
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = (per_source.withColumn("_place", place)
                .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int")))
                .withColumn("_cap", F.col("source_size") * F.lit(limit)).withColumn("_ratio", F.col("_cap") / F.col("weight")))
    order = Window.orderBy("_ratio", "_place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = (weighted.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
                .withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything)))
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.coalesce("_final", F.col("_ratio")))
    return levelled.select("source", "source_rows", "source_size", target.alias("target"),
                           F.when(F.col("source_size") > 0, F.least(F.lit(float(limit)), target / F.col("source_size"))).otherwise(F.lit(0.0)).alias("copies_each"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with its ``size, source_size, target, copies``."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("_source"), F.col(id_col).cast("long").alias("_id"), word_count(text).alias("_size"),
                       F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_key"))
    targets = written(source_targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size")), **options).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_key"), F.col("source_rows").alias("_source_rows"),
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("copies_each").alias("_each")), "mix-targets")
    placed = attach(rows, targets, ["_key"], "inner", salt_by=F.struct("_id", "_size"))
    slots = F.ceil(F.col("_source_rows") / SLOT_ROWS)
    placed = placed.withColumn("_slot", F.floor(draw(f"{seed}/slot", F.col("_id"), F.col("_size")) * slots))
    counted = placed.groupBy("_key", "_slot").agg(F.count("*").alias("_in_slot"))
    first = (F.sum("_in_slot").over(Window.partitionBy("_key").orderBy("_slot")) - F.col("_in_slot")).alias("_first")
    starts = counted.select("_key", "_slot", first)
    turned = F.when(F.col("_slot") % 2 == 0, F.col("_size")).otherwise(-F.col("_size"))
    ranked = (placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_slot").orderBy(turned, "_id")))
              .join(starts, ["_key", "_slot"]))
    offset = draw(f"{seed}/offset", F.col("_source"))
    reached = lambda k: F.floor((F.col("_first") + F.col("_rank") - 1 + k) * F.col("_each") + offset)
    return ranked.select("row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (reached(1) - reached(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as it is drawn, with its own columns."""
    drawn = with_copies(docs, id_col, text, source, seed, **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
