"""Operator 9: mixing sources to target weights by capped water-filling.

Targets share a budget by weight; a source whose share passes its cap is
clamped there and the excess goes to the others by weight, until none is
above. Each source then repeats all its documents as often as its target holds
it whole, and a seeded draw of documents once more for what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Slots a source's documents are dealt to by their draw; only one slot a source is ever sorted.
SLOTS = 4096


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def drawn(docs: DataFrame, seed: int, *keep) -> DataFrame:
    """doc_id, source, _size, and _draw and _slot, a document's seeded place among its source's; and the columns to keep."""
    rows = docs.select("doc_id", "source", word_count().alias("_size"), F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_draw"), *keep)
    return rows.withColumn("_slot", F.shiftright("_draw", 52).cast("int"))


def targets(sizes: DataFrame, weights: list[float], share: float, epochs: float) -> DataFrame:
    """source, source_size, target of sizes(source, source_size), which has a row for each source.

    Weights repeat over the sources in code point order, null last. Each round
    sums what is clamped and the weights of the rest; the level only rises, so
    it ends. Sources without words have the target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sizes = sizes.withColumn("_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights)) + 1))
    sizes = sizes.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    sizes = common.stored(sizes, "mix-sources")
    level, clamped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        got = sizes.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("_cap")).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_w"))).alias("open"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        if not got["open"] or got["n"] == clamped:
            break
        clamped = got["n"]
        level = max(level, (share * got["all"] - got["held"]) / got["open"])
    return sizes.select("source", "source_size", F.least("_cap", F.col("_w") * F.lit(level)).alias("target"))


def repeats(rows: DataFrame, weights: list[float], share: float, epochs: float, sized: DataFrame | None = None) -> DataFrame:
    """rows (see drawn()) with source_size, target and _times, how often the mix takes each.

    sized: the same documents' source, _size and _slot, where they are cheaper
    to read. The slots below what a source still lacks are taken whole; only
    the slot in which that ends is sorted, so a source of any size is spread.
    """
    slots = (sized if sized is not None else rows).groupBy("source", "_slot").agg(F.sum("_size").alias("_in"))
    slots = common.stored(slots, "mix-slots")
    goal = targets(slots.groupBy("source").agg(F.sum("_in").alias("source_size")), weights, share, epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("_whole", F.floor(ratio)).withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size"))
    ahead = Window.partitionBy("source").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_in").over(ahead), F.lit(0)))
    g = goal.withColumnRenamed("source", "_g")
    slots = slots.join(g, F.col("source").eqNullSafe(F.col("_g"))).drop("_g")
    slots = slots.withColumn("_left", F.col("_want") - F.col("_before")).drop("_want", "_before")
    s = slots.withColumnsRenamed({"source": "_s", "_slot": "_k"})
    both = rows.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slot") == F.col("_k"))).drop("_s", "_k")
    edge = (F.col("_left") > 0) & (F.col("_left") < F.col("_in"))
    plain = both.where(~edge).withColumn("_times", F.col("_whole") + F.when((F.col("_left") >= F.col("_in")) & (F.col("_in") > 0), 1).otherwise(0))
    upto = Window.partitionBy("source", "_slot").orderBy("_draw", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    run = both.where(edge).withColumn("_run", F.sum("_size").over(upto))
    # a document comes in when more than half of it fits
    last = run.withColumn("_times", F.col("_whole") + F.when(F.col("_run") * 2 - F.col("_size") < F.col("_left") * 2, 1).otherwise(0)).drop("_run")
    return plain.unionByName(last).drop("_in", "_whole", "_left")


def mix_sizes(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: float = 2, seed: int = 9) -> DataFrame:
    """doc_id, size, source_size, target, taken of docs(doc_id, source, text).

    A null text has no words, a null source is a source of its own (the last),
    an empty table gives an empty result. Rows that repeat a doc_id are drawn
    by their text, and equal rows stand side by side in the draw. Further
    columns are left out.
    """
    sized = drawn(docs, seed)
    sized = common.stored(sized, "mix-documents")
    out = repeats(sized, list(weights), share, epochs)
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).cast("bigint").alias("taken"))


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, epochs: float = 2, seed: int = 9) -> DataFrame:
    """The mix itself: docs' rows with all their columns, whatever their names, each as often as it is taken.

    Nulls, repeated rows and ties are as in mix_sizes(); a document without
    words is never in a fractional draw, and stays as often as its source is
    taken whole. An empty table stays empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = drawn(docs, seed, whole)
    sized = common.stored(rows.select("source", "_size", "_slot"), "mix-documents")
    out = repeats(rows, list(weights), share, epochs, sized).where("_times > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(common.table(spark, sf_dir, "documents"))
