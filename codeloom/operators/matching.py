"""Matching joins, anti joins and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(producers: DataFrame, workers: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that are both produced and worked on."""
    return producers.select(*keys).distinct().join(workers.select(*keys).distinct(), keys)


def unmatched(producers: DataFrame, workers: DataFrame, keys: list[str], wildcards: DataFrame | None = None, queue: str = "queue") -> DataFrame:
    """Kind (producer, worker) and keys of what has no partner; producers to a wildcard queue have one."""
    p, w = producers.select(*keys).distinct(), workers.select(*keys).distinct()
    left = p.join(w, keys, "left_anti")
    if wildcards is not None:
        left = left.join(wildcards.select(queue).distinct(), queue, "left_anti")
    return left.withColumn("kind", F.lit("producer")).unionByName(w.join(p, keys, "left_anti").withColumn("kind", F.lit("worker")))


def nearest_ancestor(items: DataFrame, owners: DataFrame, path: str = "path", prefix: str = "prefix") -> DataFrame:
    """Items with the owner of the longest prefix that holds them; none where two owners tie.

    Each item is joined with its own prefixes by equality, so owners are looked
    up and never paired with all items. Prefixes end in / or are empty.
    """
    parts = F.split(F.col(path), "/")
    own = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    each = items.select(path).distinct().withColumn("_p", F.explode(own)).join(owners.withColumnRenamed(prefix, "_p"), "_p")
    best = each.withColumn("_r", F.rank().over(Window.partitionBy(path).orderBy(F.length("_p").desc()))).where("_r = 1")
    return best.groupBy(path).agg(F.min("owner").alias("owner"), F.count("*").alias("_n")).where("_n = 1").drop("_n").join(items, path)


def duplicates(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """A5: every row but the first of its group, with the first one's `order` columns as first_*."""
    w = Window.partitionBy(*by).orderBy(*order)
    firsts = {f"first_{c}": F.first(c).over(w) for c in order}
    return rows.withColumns({"_n": F.row_number().over(w), **firsts}).where("_n > 1").drop("_n")


def occurrences_of_repeats(rows: DataFrame, by: list[str]) -> DataFrame:
    """All rows of the groups of two or more; counted first, so a hot group is not gathered."""
    often = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(often, by, "left_semi")


def set_difference(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """Value, side: missing (in the left alone) or extra (in the right alone)."""
    a, b = left.select(value).distinct(), right.select(value).distinct()
    return a.join(b, value, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, value, "left_anti").withColumn("side", F.lit("extra")))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Key, change (added, removed, changed) by the sets of values a key has."""
    sets = lambda df, name: df.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*values))).alias(name))
    both = sets(old, "_old").join(sets(new, "_new"), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return both.withColumn("change", change).where("change is not null").select(key, "change")


def strict_prefixes(rows: DataFrame, group: list[str], columns: str, name: str) -> DataFrame:
    """Name, covered_by: rows whose columns are a strict prefix of another's of the group, the least of those.

    Every row offers its own strict prefixes; a prefix keeps the least of its
    offers before it is joined by equality. The arrays are made here, so the size
    that a plan expects of either side says little; neither may be broadcast for it.
    """
    cols = F.col(columns)
    offers = rows.where(F.size(cols) > 1).select(*group, F.explode(F.transform(F.sequence(F.lit(1), F.size(cols) - 1), lambda n: F.slice(cols, F.lit(1), n))).alias(columns), F.col(name).alias("covered_by"))
    least = offers.groupBy(*group, columns).agg(F.min("covered_by").alias("covered_by"))
    return rows.join(least.hint("merge"), [*group, columns]).groupBy(name).agg(F.min("covered_by").alias("covered_by"))


def last_before(events: DataFrame, by: list[str], at: str, is_query: Column, is_source: Column) -> DataFrame:
    """Query events with the latest time before theirs of a source event of their group."""
    strict = Window.partitionBy(*by).orderBy(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{at}`)")).rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn("prior", F.max(F.when(is_source, F.col(at))).over(strict)).where(is_query)


def fnv1a(column: Column) -> Column:
    """The 64-bit FNV-1a hash of the text's bytes, as an unsigned decimal.

    The state is two halves of 32 bits, so no product leaves a long: the prime
    2**40 + 0x1B3 multiplies both halves by 0x1B3 and moves the lower one up by 8.
    """
    pairs = F.transform(F.regexp_extract_all(F.hex(F.encode(column, "utf-8")), F.lit("(..)"), 1), lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h: Column, b: Column) -> Column:
        lo = h["lo"].bitwiseXOR(b)
        up = h["hi"] * 0x1B3 + F.shiftright(lo * 0x1B3, 32) + F.shiftleft(lo, 8)
        return F.struct(up.bitwiseAND(F.lit(0xFFFFFFFF)).alias("hi"), (lo * 0x1B3).bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))

    return F.aggregate(pairs, start, step, lambda h: (h["hi"].cast("decimal(10,0)") * F.lit(1 << 32).cast("decimal(10,0)") + h["lo"]).cast("decimal(20,0)"))


def lookup_ignoring_case(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Name, found, status: the exact name, else the only one that differs in case, else none (ambiguous or missing)."""
    names = known.select("name").distinct()
    folded = names.groupBy(F.lower("name").alias("_k")).agg(F.count("*").alias("_n"), F.min("name").alias("_one"))
    rows = wanted.select("name").distinct().join(names.withColumn("_exact", F.lit(True)), "name", "left").withColumn("_k", F.lower("name")).join(folded, "_k", "left")
    status = F.when(F.col("_exact"), "exact").when(F.col("_n") == 1, "ignoring-case").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return rows.withColumn("status", status).select("name", F.when(F.col("_exact"), F.col("name")).when(F.col("_n") == 1, F.col("_one")).alias("found"), "status")


def stable_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of the least hashes of their keys, sorted by key."""
    return rows.withColumn("_h", fnv1a(F.col(key))).orderBy("_h", key).limit(n).drop("_h").orderBy(key)
