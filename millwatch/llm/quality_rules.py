"""Weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Every rule looks at counts of one document and votes for keeping it, against it,
or not at all.  How often each combination of votes occurs over ALL documents is
the only thing the estimation sees: at most 3 ** len(RULES) rows, however many
documents there are.  Expectation-maximisation over that table gives each rule's
accuracy on good and on bad documents and the share of good ones; the posterior
of a combination then holds for every document that shows it.

Results for odd rows: NULL and empty texts have no words, fail the base check and
are not kept; equal rows are judged alike and all returned; an empty table gives
an empty result.  Five-word windows are compared by their 64-bit hash.
"""

from collections.abc import Callable
from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.text import blank_words
from millwatch.session import stored

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


def _vote(bad: Column, good: Column) -> Column:
    """0 against, 1 abstains, 2 for."""
    return F.when(bad, 0).when(good, 2).otherwise(1)


def _rules() -> dict[str, Column]:
    """Kinds of junk get two rules each, so that agreement can tell EM which ones to trust."""
    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "symbols": _vote(100 * F.col("n_symbols") > 8 * chars, 100 * F.col("n_symbols") < chars),
        "symbol_runs": _vote(100 * F.col("n_symbol_runs") > 20 * words, 100 * F.col("n_symbol_runs") < 4 * words),
        "repeats": _vote(100 * F.col("n_repeat_words") > 15 * words, 100 * F.col("n_repeat_words") < 5 * words),
        "lines": _vote(4 * F.col("n_dup_lines") > lines, F.col("n_dup_lines") == 0),
        "capitals": _vote(100 * F.col("n_upper") > 40 * chars, 100 * F.col("n_upper") < 12 * chars),
        "shouts": _vote(100 * F.col("n_shouts") > 20 * words, 100 * F.col("n_shouts") < 4 * words),
        "word_length": _vote((chars < 2 * words) | (chars > 12 * words), chars.between(3 * words, 9 * words)),
        "line_length": _vote(2 * words < 3 * lines, words >= 5 * lines),
    }


RULES = ("symbols", "symbol_runs", "repeats", "lines", "capitals", "shouts", "word_length", "line_length")


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts the rules look at; a document never leaves its row."""
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "_words": blank_words(F.col(text)),
        "_lines": F.filter(F.split(whole, "\n"), has_word),
        "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("long"),
        "n_symbol_runs": F.regexp_count(whole, F.lit(SYMBOLS + "+")).cast("long"),
        "n_shouts": F.regexp_count(whole, F.lit("!{2,}")).cast("long"),
        "n_upper": F.regexp_count(whole, F.lit("[A-Z]")).cast("long"),
    }).withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(
            F.size("_words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (WINDOW - 1), F.lit(1))),
                        lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    })
    # Few texts repeat a window; only they are sorted.
    out = out.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
        F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = lambda k: F.get("_sorted", k)["h"]
    out = out.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(
        F.filter("_sorted", lambda e, k: e["h"].eqNullSafe(at(k - 1)) | e["h"].eqNullSafe(at(k + 1))), lambda e: e["i"]))))
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.drop("_words", "_lines", "_hashes", "_sorted", "_starts")


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The posterior probability of "good" for each combination of votes, by EM.

    Given the class, each rule votes on its own and an abstention says nothing.  The
    start takes a document for bad if any rule speaks against it; rates are smoothed
    by one vote each.  A vote against never raises the odds, one in favour never
    lowers them, whatever the rates say.
    """
    total = sum(n for _, n in patterns)
    post = {votes: 0.1 if 0 in votes else 0.9 for votes, _ in patterns}
    for _ in range(rounds if total else 0):
        good = sum(n * post[v] for v, n in patterns)
        prior = min(max(good / total, 1e-6), 1 - 1e-6)
        weights = []
        for j in range(len(patterns[0][0])):
            of_bad, of_good = [1.0, 0.0, 1.0], [1.0, 0.0, 1.0]
            for votes, n in patterns:
                if votes[j] != 1:
                    of_bad[votes[j]] += n * (1 - post[votes])
                    of_good[votes[j]] += n * post[votes]
            against, favour = (log(of_good[v] / sum(of_good)) - log(of_bad[v] / sum(of_bad)) for v in (0, 2))
            weights.append((min(0.0, against), 0.0, max(0.0, favour)))
        for votes, _ in patterns:
            odds = log(prior / (1 - prior)) + sum(weights[j][v] for j, v in enumerate(votes))
            post[votes] = 1 / (1 + exp(-max(-60.0, min(60.0, odds))))
    return post


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_from: float = 0.5,
          base_failed: Callable[[], Column] | None = None) -> DataFrame:
    """One row per document: its counts, votes, posterior and verdict.

    The counts are stored once in the shared scratch folder (a few numbers a
    document) and read for the estimation and for the result.
    """
    spark = docs.sparkSession
    counts = stored(document_counts(docs.select(id_col, text), text).drop(text).withColumns(_rules()), "quality-counts")
    seen = counts.groupBy(*RULES).count().collect()  # at most 3 ** len(RULES) rows
    post = estimate([(tuple(r[name] for name in RULES), r["count"]) for r in sorted(seen)])
    schema = ", ".join(f"{name} int" for name in RULES) + ", posterior double"
    table = spark.createDataFrame([(*votes, p) for votes, p in sorted(post.items())], schema)
    failed = base_failed() if base_failed else default_base_failed()
    return counts.join(F.broadcast(table), list(RULES)).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("posterior") >= keep_from)).alias("kept"),
        F.round("posterior", 6).alias("posterior"), *RULES)


def default_base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
