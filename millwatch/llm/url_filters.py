"""URL filtering: hand-written host/path rules, then token rules mined by FP-growth.

URLs become sets of tokens (labels of the host, pieces of path and query).  Spark's
FP-growth finds the token combinations that are frequent among labelled pages; those
with enough support and confidence for a low-quality page become blocking rules.
They are matched through an inverted index, token -> rules: a page shows a rule when
as many of its tokens point to the rule as the rule has.

Results for odd rows: a NULL url or one without ``://`` has empty host and path, no
tokens, and is allowed; pages with equal urls, repeated rows included, get equal
verdicts and all rows are returned; without labelled pages nothing is mined and only
the hand-written rules block; an empty table gives an empty result.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.text import LOWER, UPPER
from millwatch.session import stored

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
Rule = tuple[str, str, str]
LOW = "label:low"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def hand_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; NULL where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column) -> Column:
    """Distinct host labels and pieces of path and query; numbers alone are no tokens."""
    pieces = F.split(F.lower(F.regexp_replace(_rest(url), r"^[^/?#]*", "")), r"[^a-z0-9]+")
    named = F.concat(
        F.transform(F.filter(F.split(url_host(url), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(pieces, lambda x: ~x.rlike("^[0-9]*$")), lambda x: F.concat(F.lit("part:"), x)))
    return F.array_distinct(F.coalesce(named, F.array().cast("array<string>")))


def mine_rules(tokens: DataFrame, min_support: float, min_confidence: float, min_pages: int) -> DataFrame:
    """(rule, token, n_tokens) of the combinations that foretell a low label.

    ``tokens``: one row per labelled page, (tokens array, low boolean).  A combination
    needs at least ``min_support`` of the labelled pages and ``min_pages`` of them
    together with the low label.
    """
    spark = tokens.sparkSession
    items = stored(tokens.select(F.when(F.col("low"), F.array_append("tokens", F.lit(LOW))).otherwise(F.col("tokens")).alias("items")), "url-items")
    n = items.count()
    empty = spark.createDataFrame([], "rule bigint, token string, n_tokens int")
    if not n:
        return empty
    support = max(min_support, min_pages / n)
    if support > 1:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.filter(F.element_at("consequent", 1) == LOW).select(F.array_sort("antecedent").alias("tokens"))
    return found.select(F.xxhash64("tokens").alias("rule"), F.explode("tokens").alias("token"), F.size("tokens").alias("n_tokens"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls that show all tokens of some rule; ``urls``: (url, tokens array), no url twice."""
    postings = urls.select("url", F.explode("tokens").alias("token"))
    hits = postings.join(rules, "token").groupBy("url", "rule").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_tokens").alias("n_tokens"))
    return hits.filter(F.col("n") == F.col("n_tokens")).select("url").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url",
                label_id: str = "doc_id", quality: str = "quality", min_support: float = 0.002,
                min_confidence: float = 0.5, min_pages: int = 20) -> DataFrame:
    """One row per page: host, path, the hand-written rule that fits, and the verdict.

    The label of a page is the smallest quality among its rows in ``labels``.
    """
    low = labels.filter(F.col(quality).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(quality).alias("_quality"))
    known = pages.join(low, F.col(page_id) == F.col("_id")).select(
        url_tokens(F.col(url)).alias("tokens"), (F.col("_quality") == 0).alias("low"))
    mined = stored(mine_rules(known, min_support, min_confidence, min_pages), "url-rules")
    urls = pages.filter(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct()
    blocked = matched(urls.withColumn("tokens", url_tokens(F.col("url"))), mined).select(F.col("url").alias("_blocked"))
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rule, verdict = hand_rule(F.col("host"), F.col("path"), rules)
    found = pages.select(page_id, url, host.alias("host"), path.alias("path")).join(blocked, F.col(url) == F.col("_blocked"), "left")
    return found.select(
        page_id, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("_blocked").isNotNull(), "block").otherwise("allow")).alias("verdict"))
