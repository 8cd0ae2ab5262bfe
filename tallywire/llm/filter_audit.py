"""How filters interact: what each removes in every order they can be applied in.

A document comes down to the set of filters it fails, a mask of one bit per filter, and the
documents of a part with one mask are one cell. A recursive query then extends every sequence
of filters by each filter it has not used yet, carries the bits applied so far, and says at
each level of the recursion what the new filter does to each cell: passes it, removes it, or
comes too late. It runs over masks alone, so its size depends on the number of filters and on
nothing else; the cells of all parts are joined to what it says by their mask.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywire.llm.tables import join_groups
from tallywire.plans.sizes import settled

SEPARATORS = "[\\x20\\x09-\\x0D]+"
LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of all words
MOST_CAPITALS = 5  # percent of all characters
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEATS = "E"  # the filter that needs the whole table


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The conditions that a text alone decides, true where the text fails."""
    count = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": count < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < count * LEAST_DISTINCT,
        "C": capitals * 100 > F.length(text) * MOST_CAPITALS,
        "D": text.rlike(SYMBOLS),
    }


def mask_of(filters: Mapping[str, Column], letters: str) -> Column:
    """The failed filters as bits, in the order of ``letters``; a null condition passes."""
    bits = [
        F.when(condition, F.lit(1 << letters.index(letter))).otherwise(F.lit(0))
        for letter, condition in filters.items()
    ]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def failed_filters(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, ``part`` and ``mask``, the filters A to E that it fails.

    A null text is empty and a null source the empty string. A document fails E if the same
    text stands in a row with a smaller doc_id, in any part; a row without doc_id has no
    smaller one and is none, so it passes, and rows that repeat a doc_id do not fail for each
    other. Texts are compared by their SHA-256.
    """
    letters = "ABCD" + REPEATS
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", SEPARATORS), "")
    rows = rows.withColumn("words", words).select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        mask_of(text_filters(F.col("text"), F.col("words")), letters).alias("mask"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = settled(rows, "masks")
    groups = rows.groupBy("sha").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("held")
    )
    groups = settled(groups.filter("held > 1"), "repeated-texts")
    found = join_groups(rows, groups, ["sha"], "held", "row")
    repeats = mask_of({REPEATS: F.col("doc_id") > F.col("first_id")}, letters)
    return found.select("doc_id", "part", F.col("mask").bitwiseOR(repeats).alias("mask"))


def mask_cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Cells ``part``, ``mask`` with the counts ``docs``, ``good`` and ``toxic``.

    A document is good if some label of its doc_id has quality 1, and toxic likewise; without
    a label it is neither. Rows are counted by doc_id before they meet the labels, so that a
    doc_id which many rows share, or lack, is a few rows.
    """
    rows = failed.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("docs"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"),
    )
    rows = rows.join(marks.filter("doc_id IS NOT NULL"), "doc_id", "left")
    nothing = F.lit(0).cast("bigint")
    return rows.groupBy("part", "mask").agg(
        F.sum("docs").alias("docs"),
        F.sum(F.when(F.col("is_good"), F.col("docs")).otherwise(nothing)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("docs")).otherwise(nothing)).alias("toxic"),
    )


def walk(spark: SparkSession, letters: str) -> DataFrame:
    """Every sequence of different filters against every mask, by recursion.

    One row per sequence (``prefix``) and ``mask``, with its length ``step``, its last filter
    ``letter`` and what that filter does to the cell: exactly one or none of ``keeps``,
    ``removes`` and ``late`` (fails it, but an earlier filter has removed it), and ``alone``,
    whether it is the only filter that the cell fails. For five filters 325 times 32 rows.
    """
    filters = ", ".join(
        f"named_struct('letter', '{letter}', 'bit', {1 << i})" for i, letter in enumerate(letters)
    )
    return spark.sql(
        f"""
        WITH RECURSIVE walk (prefix, letter, step, before, applied, mask) AS (
            SELECT '', '', 0, 0, 0, CAST(id AS INT) FROM range({1 << len(letters)})
            UNION ALL
            SELECT concat(prefix, next.letter), next.letter, step + 1, applied,
                applied | next.bit, mask
            FROM walk LATERAL VIEW
                explode(filter(array({filters}), f -> (applied & f.bit) = 0)) unused AS next)
        SELECT prefix, letter, step, mask,
            (mask & applied) = 0 AS keeps,
            (mask & before) = 0 AND (mask & applied) <> 0 AS removes,
            (mask & before) <> 0 AND (mask & (applied ^ before)) <> 0 AS late,
            mask = (applied ^ before) AS alone
        FROM walk WHERE step > 0
        """
    )


def audit_orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row per ``part``, order of all filters (``filter_order``) and ``step``.

    ``cells`` holds one row per part and mask, as mask_cells makes them. ``kept`` is what is
    left after the step, ``removed`` what it takes, ``redundant`` what it fails that was gone
    already, ``unique_fails`` what fails no other filter, ``good_lost`` and ``toxic_lost`` the
    good and toxic documents among the removed, and ``shapley`` the removed of this filter
    summed over all orders. Zeros are rows, too; without cells there are none. Grouped by
    part, sequence and filter, so one part may hold any share of the documents: it is as many
    cells as any other.
    """
    steps = settled(walk(cells.sparkSession, letters), "filter-orders")

    def total(condition: str, column: str = "docs") -> Column:
        return F.sum(F.when(F.col(condition), F.col(column)).otherwise(F.lit(0)))

    metrics = cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step", "letter")
    metrics = metrics.agg(
        total("keeps").alias("kept"),
        total("removes").alias("removed"),
        total("late").alias("redundant"),
        total("alone").alias("unique_fails"),
        total("removes", "good").alias("good_lost"),
        total("removes", "toxic").alias("toxic_lost"),
    )
    # Sequences of full length are the orders; each has its first steps in common with others.
    whole = steps.filter((F.col("step") == len(letters)) & (F.col("mask") == 0))
    orders = whole.select(
        F.col("prefix").alias("filter_order"),
        F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("length"),
    )
    orders = orders.select(
        "filter_order", F.expr("substring(filter_order, 1, length)").alias("prefix")
    )
    rows = metrics.join(F.broadcast(orders), "prefix")
    each = Window.partitionBy("part", "letter")
    return rows.select(
        "part",
        "filter_order",
        "step",
        "letter",
        "kept",
        "removed",
        "redundant",
        "unique_fails",
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(each).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters A to E over whole documents, in all 120 orders, by source.

    See text_filters, failed_filters and audit_orders. Reads doc_id, source and text of
    ``docs`` and doc_id, quality and toxic of ``labels``. No documents give no rows; empty
    texts fail A alone of the filters on texts. Rows that repeat a doc_id count each.
    """
    cells = mask_cells(failed_filters(docs), labels)
    return audit_orders(cells, "ABCD" + REPEATS)
