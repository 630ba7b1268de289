"""Mix sources to target weights with nested hash thresholds; nothing is sorted.

Sizes are summed by source and by the leading bits of a document's hash.  Where
the running sum of a source crosses its budget, only that bucket is split by the
next bits, and so on; what remains is one threshold per source, and a document is
taken when its hash lies below it.  Every step is an aggregate over a table of
(document, source, size, hash), which is written once.

Results for odd rows: a NULL source is a source of its own and comes last; NULL or
empty texts have size 0 and are returned with nothing taken; rows with the same id
have the same hash and are taken or left together; an empty table gives an empty
result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwatch.llm.text import blank_words
from millwatch.session import stored

HASH_BITS, LEVEL_BITS = 48, 12
MOST_PASSES = 3


def document_hash(doc_id: Column) -> Column:
    """The first 48 bits of the md5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(by_source: DataFrame, source: str = "source", cycle: int = 3, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size) -> target: shares by weight, none above ``most`` times its size.

    Sources in code point order, NULL last, weigh 1, 2, ... ``cycle``, repeating.
    Resharing the excess until no source is above its limit ends where every source
    gets min(limit, weight * level) with one level; ordered by limit / weight, the
    sources at their limit come first, so the level follows from running sums.
    One row per source: the only windows without a key in this module.
    """
    big = lambda c: c.cast("decimal(38,0)")
    ranked = by_source.withColumn("_weight", (F.row_number().over(
        Window.orderBy(F.col(source).asc_nulls_last())) - 1) % cycle + 1)
    ranked = ranked.withColumn("_limit", most * F.col("source_size"))
    order = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col(source).asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns({
        "_left": F.sum("source_size").over(every) - F.coalesce(F.sum("_limit").over(before), F.lit(0)),
        "_weights": F.sum("_weight").over(after),
    })
    ranked = ranked.withColumn("_full", big(F.col("_limit")) * F.col("_weights") <= big(F.col("_left")) * F.col("_weight"))
    full, free = F.col("_full"), ~F.col("_full")
    ranked = ranked.withColumns({
        "_rest": F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(full, F.col("_limit"))).over(every), F.lit(0)),
        "_free": F.sum(F.when(free, F.col("_weight"))).over(every),
    })
    target = F.when(full, F.col("_limit").cast("double")).otherwise(
        F.col("_weight").cast("double") * F.col("_rest").cast("double") / F.col("_free").cast("double"))
    return ranked.select(source, "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Adds to each source its whole passes and the hash below which a document is taken once more.

    ``sizes``: (source, size, hash).  A source's budget is its target as a whole number of words.
    """
    budget = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    state = targets.select("*", passes.alias("passes")).select(
        "*", (budget - F.col("passes") * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        rows = sizes.select(F.col(source).alias("_source"), "size", F.shiftrightunsigned("hash", shift).alias("_bucket"))
        inside = rows.join(
            state.select(F.col(source).alias("_of"), "_prefix", "_left"),
            F.col("_source").eqNullSafe(F.col("_of")) & (F.shiftrightunsigned("_bucket", LEVEL_BITS) == F.col("_prefix")))
        sums = inside.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_left").alias("_budget"))
        run = Window.partitionBy("_source").orderBy("_bucket")
        sums = sums.withColumn("_upto", F.sum("_sum").over(run))
        # The bucket in which the running sum passes the budget; what comes before it is taken whole.
        crossing = sums.filter((F.col("_upto") > F.col("_budget")) & (F.col("_upto") - F.col("_sum") <= F.col("_budget"))).select(
            "_source", "_bucket", (F.col("_budget") - F.col("_upto") + F.col("_sum")).alias("_rest"), "_sum")
        joined = state.join(crossing, F.col(source).eqNullSafe(F.col("_source")), "left")
        state = joined.select(
            source, "source_size", "target", "passes",
            F.coalesce("_rest", F.lit(0).cast("long")).alias("_left"),
            F.coalesce("_bucket", F.lit(0).cast("long")).alias("_prefix"),
            F.coalesce("_sum", F.lit(0).cast("long")).alias("_leaf"))
    # The last bucket holds one hash: it is taken if that brings the sum nearer to the budget.
    below = F.col("_prefix") + F.when(2 * F.col("_left") > F.col("_leaf"), 1).otherwise(0)
    return state.select(source, "source_size", "target", "passes", below.cast("long").alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", stored_sizes: bool = True) -> DataFrame:
    """One row per document: size, its source's size and target, and the words taken."""
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.size(blank_words(F.col(text))).cast("long").alias("size"),
        document_hash(F.col(id_col)).alias("hash"))
    if stored_sizes:
        sizes = stored(sizes, "mixing-sizes")
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    # One row a source: written, so that the result is one pass over the documents.
    limits = stored(thresholds(sizes, targets), "mixing-thresholds").withColumnRenamed("source", "_of")
    taken = F.col("size") * (F.col("passes") + (F.col("hash") < F.col("below")).cast("long"))
    return sizes.join(limits, F.col("source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
