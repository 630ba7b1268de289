"""The text pipeline: documents in, a mix of clean and distinct documents out.

Five stages, each applied to all rows that the one before it kept, written as Parquet
in between.  All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier predicts to be toxic go.
2. line dedup: boilerplate lines go; a document that has no line left goes.
3. n-gram Jaccard join: of each group of near copies the smallest id stays.  Near copies
   share 80 % of their five-word shingles; op2_ngram_jaccard has four words and 85 %.
4. benchmark decontamination: documents with a test passage go.
5. mixing: how many words of each document the mix takes; documents stay in the
   result with 0 taken where the budget of their source leaves them out.

A table without any of the columns ``lang``, ``source`` or ``n_chars`` is not accepted;
extra columns pass through the first four stages unchanged, whatever their names: they
travel in one struct that no stage looks into.  NULL and empty texts are kept by
all stages: they are not toxic, have no lines, no copies and no test passages.
"""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import decontamination, line_dedup, mixing, ngram_jaccard, toxicity
from millwatch.session import scratch_dir

#: Near copies of the pipeline: words a shingle, and the percentage of shingles in common.
SHINGLE, SIMILAR = 5, 80

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_EXTRA = "extra_columns"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def passing_extras(stage: Stage) -> Stage:
    """The stage, for tables with columns of any name beside those of ``documents``."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        if set(names) <= set(COLUMNS):
            return stage(spark, docs, sf_dir)
        plain = [c if c in COLUMNS else f"{_EXTRA}_{i}" for i, c in enumerate(names)]
        extra = [c for c in plain if c not in COLUMNS]
        out = stage(spark, docs.toDF(*plain).select(*COLUMNS, F.struct(*extra).alias(_EXTRA)), sf_dir)
        return out.select(*[c if c in COLUMNS else F.col(_EXTRA)[c] for c in plain]).toDF(*names)
    return run


@passing_extras
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row is scored where it is: no join, no shuffle."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.score_toxicity(docs, model, keep=keep)
    return scored.filter(F.col("score") < toxicity.PREDICT_FROM).select(*docs.columns)


@passing_extras
def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    return out.filter(~changed | (F.col("n_removed") < F.col("n_lines"))).withColumn(
        "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@passing_extras
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose id is their component's, and of those without any id the text with the smallest signature.

    Rows are dropped by id and text, so another text of the same id stays.
    """
    groups = ngram_jaccard.jaccard_components(docs.select("doc_id", "text"), shingle=SHINGLE, similar=SIMILAR, signed=True)
    second = F.col("doc_id").isNull() & (F.col("sign") != F.col("component_sign"))
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) | second).select(
        F.col("doc_id").alias("_gone"), F.col("sign").alias("_sign")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & (ngram_jaccard.signature("text") == F.col("_sign"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)


@passing_extras
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_contamination(docs, items).filter(~F.col("contaminated")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: A trained classifier is the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
