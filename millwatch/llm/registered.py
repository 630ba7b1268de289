"""All queries that the entry module adds: the ten operators and the pipeline."""

import corpus_pipeline
from millwatch.llm import oracle, queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE = dict(oracle.SQL)
