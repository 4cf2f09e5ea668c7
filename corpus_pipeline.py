"""A training corpus from raw documents: five stages, each over all that the one before kept.

Stages take (spark, docs, sf_dir), `docs` with the columns of `documents`, and return such
a table again; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import mixing, packing, parity_join, secret_scan, toxicity
from loomgraph.llm.common import stash, table
from loomgraph.llm.queries import tokenizer_files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores at 0.5 or more go."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)).clean(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return parity_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its credentials replaced by a mark; n_chars follows."""
    cleaned = secret_scan.redacted(docs, secret_scan.scan(docs))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs, weights=[5, 2, 1])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    return packing.pack_documents(docs, *tokenizer_files())


STAGES = [
    ("toxicity", drop_toxic),
    ("n_gram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL cannot train the models; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs)
    return docs
