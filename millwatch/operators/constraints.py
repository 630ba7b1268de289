"""Table constraints as reports: which rule is broken, by which key, how often."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch import fixed_values as fv
from millwatch.sources import key_index
from millwatch.sources.tables import append_batch


@dataclass(frozen=True)
class Rules:
    """Constraints of one table."""

    table: str
    primary_key: str | None = None
    unique: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)


FEED_RULES = Rules("machine_feed", primary_key="machine_id")
WORK_ORDER_RULES = Rules(
    "work_orders", primary_key="id",
    not_null=["machine_id", "issue_description", "priority", "reporter_name", "timestamp", "created_at", "status"],
    allowed={"priority": fv.PRIORITIES, "status": fv.ORDER_STATUSES},
    max_length=fv.MAX_LENGTHS["work_orders"],
)
EMPLOYEE_RULES = Rules(
    "employees", primary_key="id", unique=["email"], not_null=["first_name", "last_name"],
    max_length=fv.MAX_LENGTHS["employees"],
)


def _row_conditions(rules: Rules) -> dict[str, object]:
    """Rule -> condition of a violating row.  NULL passes every rule but NOT NULL."""
    missing = [rules.primary_key] if rules.primary_key else []
    conditions = {f"{c} not null": F.col(c).isNull() for c in missing + rules.not_null}
    for c, values in rules.allowed.items():
        conditions[f"{c} allowed"] = ~F.col(c).isin(*values)
    for c, length in rules.max_length.items():
        conditions[f"{c} length"] = F.length(c) > length
    return conditions


def _keys(rules: Rules) -> list[str]:
    return [k for k in [rules.primary_key] if k] + rules.unique


def _broken_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rule, key, count`` of the row rules, all in one pass."""
    conditions = _row_conditions(rules)
    return (
        rows.agg(*[F.count_if(condition).alias(rule) for rule, condition in conditions.items()])
        .select(F.explode(F.array(*[
            F.struct(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("key"), F.col(rule).alias("count"))
            for rule in conditions
        ])).alias("r"))
        .select("r.*")
    )


def _repeated(counted: DataFrame, column: str) -> DataFrame:
    return counted.filter("n > 1").select(F.lit(f"{column} unique").alias("rule"), "key", F.col("n").alias("count"))


def check_constraints(rows: DataFrame, rules: Rules) -> DataFrame:
    """``table, rule, key, count``: one row per broken row rule and per repeated key.

    All row rules share one pass; each uniqueness rule is a map-side combined count.
    """
    broken = _broken_rows(rows, rules)
    for c in _keys(rules):
        broken = broken.unionByName(_repeated(key_index.counted(rows, c), c))
    return broken.filter(F.col("count") > 0).select(F.lit(rules.table).alias("table"), "rule", "key", "count")


def check_batch(rows: DataFrame, rules: Rules, root: str, batch_id: int) -> None:
    """Check a batch by itself and its keys against all earlier batches; add its keys to the indexes.

    Violations go below ``root``; a key's count is that of all batches so far.  A batch reads, of the
    history, the index buckets that may hold its keys, and a replay leaves all as it was.
    """
    broken = _broken_rows(rows, rules)
    for c in _keys(rules):
        counted, path = key_index.counted(rows, c).persist(), f"{root}/{rules.table}/{c}"
        try:
            known = key_index.held(counted, path, batch_id).withColumnsRenamed({"key": "_key", "n": "_n"})
            together = counted.join(known, F.col("key") == F.col("_key"), "left").select(
                "key", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
            append_batch(_repeated(together, c), f"{root}/repeated/{rules.table}/{c}", batch_id)
            key_index.add(counted, path, batch_id)
        finally:
            counted.unpersist()
    append_batch(broken, f"{root}/broken/{rules.table}", batch_id)


def violations_so_far(spark: SparkSession, rules: Rules, root: str) -> DataFrame:
    """What ``check_constraints`` of all batches together would give."""
    schema = "rule string, key string, count bigint"
    broken = spark.read.schema(schema).parquet(f"{root}/broken/{rules.table}").groupBy("rule", "key").agg(F.sum("count").alias("count"))
    for c in _keys(rules):
        repeated = spark.read.schema(schema).parquet(f"{root}/repeated/{rules.table}/{c}")
        broken = broken.unionByName(repeated.groupBy("rule", "key").agg(F.max("count").alias("count")))
    return broken.filter(F.col("count") > 0).select(F.lit(rules.table).alias("table"), "rule", "key", "count")


def violating_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """The rows that break a row rule or share a unique key, with the rules they break."""
    marks = [F.when(condition, rule) for rule, condition in _row_conditions(rules).items()]
    for i, c in enumerate(_keys(rules)):
        # rows without the key go round the join, where they would all meet in one task
        keyed, bare = rows.filter(F.col(c).isNotNull()), rows.filter(F.col(c).isNull())
        repeated = keyed.groupBy(F.col(c).alias(f"_key{i}")).count().filter(F.col("count") > 1).drop("count")
        rows = keyed.join(repeated, F.col(c) == F.col(f"_key{i}"), "left").unionByName(bare, allowMissingColumns=True)
        marks.append(F.when(F.col(f"_key{i}").isNotNull(), f"{c} unique"))
    names = [c for c in rows.columns if not c.startswith("_key")]
    return (
        rows.withColumn("broken_rules", F.array_compact(F.array(*marks)))
        .filter(F.size("broken_rules") > 0).select(*names, "broken_rules")
    )
