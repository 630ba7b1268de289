"""Which keys a growing table holds, and how often: an index in buckets by hash.

A batch adds its keys with their counts, partitioned by bucket, and bitmaps of a Bloom
filter, sorted by bucket.  Another batch asks for its own keys: the filters tell which of them may be held,
and only the buckets of those are read.  A batch of new keys so reads the bitmaps of its
segments and next to no keys, however long the history is.  Everything a batch adds lies
in folders of its own, which a replay replaces; a batch asks batches before it only.

A bucket's filter has ``SEGMENTS`` bitmaps of 32,768 bits; a key has three bits in one of
them.  At about 3,000 keys a segment one new key in a hundred is read for nothing, so the
two constants serve some fifty million keys; raise ``SEGMENTS`` for more, before the first
batch.  Nothing but reading depends on it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.session import exists

BUCKETS, SEGMENTS, BITS = 64, 256, 32_768
_SEEDS = (1, 2, 3)


def _hash(seed: int) -> Column:
    return F.xxhash64("key", F.lit(seed))


def _bits(seed: int) -> Column:
    return F.pmod(_hash(seed), F.lit(BITS))


def _placed(keys: DataFrame) -> DataFrame:
    return keys.withColumns({
        "bucket": F.pmod(F.hash("key"), F.lit(BUCKETS)), "segment": F.pmod(_hash(0), F.lit(SEGMENTS)).cast("int")})


def counted(keys: DataFrame, key: str) -> DataFrame:
    """``key`` as text and its count ``n``; NULL is no key."""
    return keys.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))


def add(keys: DataFrame, path: str, batch_id: int) -> None:
    """Add the counted keys of one batch."""
    placed = _placed(keys.select("key", "n"))
    placed.drop("segment").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={batch_id}")
    spread = placed.select("bucket", "segment", F.explode(F.array(*[_bits(s) for s in _SEEDS])).alias("bit"))
    filters = spread.groupBy("bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))
    filters.hint("rebalance", "bucket").sortWithinPartitions("bucket", "segment").write.mode("overwrite").parquet(f"{path}/filters/batch={batch_id}")


def _before(spark: SparkSession, path: str, batch_id: int, schema: str, buckets: list[int]) -> DataFrame:
    """What earlier batches left in some buckets."""
    rows = spark.read.schema(f"{schema}, bucket int, batch bigint").parquet(path)
    return rows.filter((F.col("batch") < batch_id) & F.col("bucket").isin(buckets))


def _is_set(seed: int) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(bits, int(_bit{seed} div 8) + 1, 1)")), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr(f"shiftleft(1, int(_bit{seed} % 8))")) != 0


def _touched(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS numbers


def may_hold(keys: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Those of the keys that the filters of earlier batches do not rule out, with their bucket."""
    asked = _placed(keys.select("key"))
    filters = _before(keys.sparkSession, f"{path}/filters", batch_id, "segment int, bits binary", _touched(asked)) \
        .groupBy("bucket", "segment").agg(F.bitmap_or_agg("bits").alias("bits"))
    # Bitmaps are large for their number: all of them, broadcast, are over 100 MB of the driver.
    tested = asked.withColumns({f"_bit{s}": _bits(s) for s in _SEEDS}).join(filters.hint("merge"), ["bucket", "segment"])
    for seed in _SEEDS:
        tested = tested.filter(_is_set(seed))
    return tested.select("key", "bucket")


def held(keys: DataFrame, path: str, batch_id: int) -> DataFrame:
    """(key, n): how often earlier batches hold those of the ``keys`` (distinct) that they hold at all."""
    spark = keys.sparkSession
    if not exists(spark, f"{path}/keys"):
        return spark.createDataFrame([], "key string, n bigint")
    maybe = may_hold(keys, path, batch_id).persist()
    try:
        buckets = _touched(maybe)
    finally:
        maybe.unpersist()
    known = _before(spark, f"{path}/keys", batch_id, "key string, n bigint", buckets)
    return known.join(maybe.select("key"), "key", "left_semi").groupBy("key").agg(F.sum("n").alias("n"))
