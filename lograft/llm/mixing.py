"""Operator 6: mix sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lograft.llm.common import WORD, unit_hash
from lograft.session import stored

# Rows of one source that are sorted together; sources are cut into so many key ranges.
ROWS_PER_RANGE = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 1 for plain prose down towards 0 as more of a text is markup or shouting."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>!]+", ""))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(20.0) * marks / (F.length(text) + 1))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """Targets of sources (``source``, ``source_size``) that share all sizes by weight.

    Sources in code point order, NULL last, take the weights in turn. A target stops at
    ``most_epochs`` times its source's size; what is over goes to the others by
    weight, until none is above. That ends where every target is the smaller of
    its stop and ``weight * level`` with one level for all; so order the sources by
    stop per weight: those that stop come first, and the sums before a
    source tell whether it does. One row a source, in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), turn).cast("long"))
    ranked = ranked.withColumn("stop", F.col("source_size") * most_epochs)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(every) - earlier("stop")).alias("left_size"),
        (F.sum("weight").over(every) - earlier("weight")).alias("left_weight"),
    )
    # stop <= weight * level, in whole numbers
    ranked = ranked.withColumn("stops", F.col("stop") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
    open_weight = F.when(~F.col("stops"), F.col("weight")).otherwise(0)
    stopped_size = F.when(F.col("stops"), F.col("stop")).otherwise(0)
    level_size = F.sum("source_size").over(every) - F.sum(stopped_size).over(every)
    share = (F.col("weight") * level_size).cast("double") / F.sum(open_weight).over(every).cast("double")
    target = F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most_epochs: int = 3,
    quality: Column | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` to every row.

    Needs ``doc_id``, ``text`` and ``source``; further columns are kept, and columns of
    the five names are replaced. ``size`` is the number of words. A source's
    target (:func:`source_targets`) holds so many complete epochs of it, which come first; the
    rest is a sample without replacement: documents in the order of
    ``-ln(u) / quality``, with u from the id (from the text where it is missing), as long as the middle of the
    document lies within the rest. So a source is off its target by half a document
    at most, ``taken = copies * size``, and reruns agree. Documents are taken whole. NULL texts and
    texts without words have size 0 and take nothing; a NULL source is a source.
    Repeated rows count each; such with equal id and text get equal copies, so a source whose rest falls among these
    is off by as many of them as there are.

    Nothing sorts a whole source: its keys are cut into ranges of a few thousand
    rows, sizes are summed by range before the shuffle, and only the range in
    which the target falls is sorted. What comes back to the documents is one row a source.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken")
    weight = quality if quality is not None else quality_weight(docs["text"])
    keyed = docs.withColumns(
        {
            "size": n_words(docs["text"]),
            # Rows without an id are told apart by their texts.
            "__key": -F.ln(unit_hash(F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.md5(docs["text"])))) / weight,
            "__weight": weight,
            "__text": F.xxhash64(docs["text"]),
        }
    )
    slim = stored(keyed.select("doc_id", "source", "size", "__key", "__weight", "__text"), "mix")
    sums = slim.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("__rows"), F.avg("__weight").alias("__mean")
    )
    targets = source_targets(sums.select("source", "source_size"), weights, most_epochs)
    epochs = F.when(
        F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))
    )
    plan = (
        targets.withColumn("__epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
        .withColumn("__rest", F.col("target") - F.col("__epochs") * F.col("source_size"))
        .withColumnRenamed("source", "__source")
        .join(sums.drop("source_size"), F.col("source").eqNullSafe(F.col("__source")))
        .drop("source")
        .withColumn("__ranges", F.ceil(F.col("__rows") / ROWS_PER_RANGE))
    )
    plan = stored(plan, "mix-targets")

    def ranged(rows: DataFrame) -> DataFrame:
        """Rows with their source's plan and the range of their key, about even by the mean weight."""
        at = F.floor((F.lit(1.0) - F.exp(-F.col("__key") * F.col("__mean"))) * F.col("__ranges"))
        joined = rows.join(plan, rows["source"].eqNullSafe(plan["__source"]), "left")
        return joined.withColumn("__range", F.least(at, F.col("__ranges") - 1))

    by_range = ranged(slim).groupBy("__source", "__range", "__rest").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("__source").orderBy("__range")
    before = F.sum("range_size").over(upto) - F.col("range_size")
    crossing = (
        by_range.withColumn("__before", before)
        .where("__before <= __rest")
        .groupBy("__source")
        .agg(F.max(F.struct("__range", "__before")).alias("last"))
        .select("__source", F.col("last.__range").alias("__cross"), F.col("last.__before").alias("__before"))
    )
    within = ranged(slim).join(
        crossing.withColumnRenamed("__source", "__at"),
        F.col("__source").eqNullSafe(F.col("__at")) & (F.col("__range") == F.col("__cross")),
    )
    order = Window.partitionBy("__at").orderBy("__key", "doc_id", "size", "__text")
    upto_row = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    cut = (
        within.withColumn("__middle", F.col("__before") + upto_row - F.col("size") / 2)
        .where("__middle <= __rest")
        .groupBy("__at")
        .agg(F.max(F.struct("__key", "doc_id", "size", "__text")).alias("__cut"))
    )
    # One row a source, read back with its true size, so that Spark knows whether it may be broadcast.
    limits = stored(
        crossing.join(cut, F.col("__source").eqNullSafe(F.col("__at")), "left").select(
            F.col("__source").alias("__of"), "__cross", "__cut"
        ),
        "mix-limits",
    )
    mixed = ranged(keyed).join(limits, F.col("__source").eqNullSafe(F.col("__of")), "left")
    taken_once = (F.col("__range") < F.col("__cross")) | (
        (F.col("__range") == F.col("__cross"))
        & F.coalesce(F.struct("__key", "doc_id", "size", "__text") <= F.col("__cut"), F.lit(False))
    )
    copies = F.when(
        F.col("source_size") > 0, F.col("__epochs") + F.coalesce(taken_once, F.lit(False)).cast("long")
    ).otherwise(F.lit(0))
    # No document more often than the stop allows, even where rounding leaves a rest beyond whole epochs.
    copies = F.least(copies, F.lit(most_epochs).cast("long"))
    return mixed.select(
        *(docs[c] for c in docs.columns),
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, in its own columns."""
    columns = docs.columns
    mixed = mix(docs, **options)
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), "copies"))).select(*columns)
