"""What ``__spark_entry__`` adds: the queries of this folder and the pipeline."""

import corpus_pipeline
from tablab.llm.queries import ORACLE, QUERIES

QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLE = {**ORACLE, "pipeline": corpus_pipeline.ORACLE_SQL}

__all__ = ["ORACLE", "QUERIES"]
