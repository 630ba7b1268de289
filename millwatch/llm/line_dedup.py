"""Remove boilerplate lines: lines that many distinct sites carry.

For every line (by its hash, outer spaces aside) a HyperLogLog sketch gathers
the sites it occurs on; sketches merge map-side and across the shuffle, so a line
on a third of all documents costs one small sketch a task.  Lines whose estimate
lies within the sketch's error of the threshold are counted exactly.  Of a line that
reaches ``min_sites``, the document with the smallest id keeps it, so nothing
disappears from the corpus altogether; all others lose it.

Results for odd rows: a NULL or empty text has no lines and stays as it is; blank
lines are never removed nor counted; a NULL site counts as one more site; a line
that only documents without an id carry stays; rows that share an id lose the same
lines; an empty table gives an empty result; texts of any length are read whole.  Other
columns pass unchanged; one named ``n_lines`` or ``n_removed`` comes back as ``<name>_of_table``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.text import put_back, set_apart

#: The sketch has 2 ** LG_K registers; three times its relative error bounds "near the threshold".
LG_K = 12
NEAR = 3 * 1.04 / 2 ** (LG_K / 2)


def _line(text: Column) -> Column:
    return F.xxhash64(F.trim(text))


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_spread(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(line, doc, site): one row per line with a word."""
    each = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.coalesce(F.col(site).cast("string"), F.lit("\0"))).alias("site"),
                       F.explode(F.filter(_lines(F.col(text)), _has_word)).alias("line"))
    return each.select(_line(F.col("line")).alias("line"), "doc", "site")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(line, owner) of the lines on at least ``min_sites`` sites; owner is the smallest document id."""
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc").alias("owner"))
    spread = spread.select("line", "owner", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = spread.filter(F.col("sites") >= min_sites * (1 - NEAR) - 1)
    near = F.col("sites") <= min_sites * (1 + NEAR) + 1
    # Distinct pairs first: a frequent line is then no longer than its sites when it is joined.
    pairs = lines.select("line", "site").distinct()
    exact = pairs.join(spread.filter(near).select("line"), "line", "left_semi").groupBy("line").agg(
        F.count(F.lit(1)).alias("exact"))
    return spread.filter(~near).select("line", "owner").unionByName(
        spread.filter(near).join(exact.filter(F.col("exact") >= min_sites), "line").select("line", "owner"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10) -> DataFrame:
    """The documents without boilerplate lines, with ``n_lines`` (with a word) and ``n_removed``."""
    lines = line_spread(docs, id_col, text, site)
    owned = lines.join(boilerplate(lines, min_sites), "line").filter(~F.col("doc").eqNullSafe(F.col("owner")))
    # A document's own set of lines: no larger than the document.
    drop = owned.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("line").alias("_drop"))
    out = set_apart(docs, id_col, text, site).join(drop, F.col(id_col).eqNullSafe(F.col("_doc")), "left").withColumn("_lines", _lines(F.col(text)))
    kept = F.filter("_lines", lambda line: ~(_has_word(line) & F.array_contains("_drop", _line(line))))
    words = lambda lines: F.size(F.filter(lines, _has_word)).cast("long")
    out = out.withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept).otherwise(F.col("_lines")))
    out = out.withColumns({
        "n_lines": words("_lines"),
        "n_removed": (F.size("_lines") - F.size("_kept")).cast("long"),
        text: F.when(F.col("_drop").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text)),
    })
    return put_back(out, docs.columns, [id_col, text, site], ["n_lines", "n_removed"])
