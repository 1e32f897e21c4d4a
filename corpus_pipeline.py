"""From raw documents to token ids: five stages, each over all that the one before kept.

1. toxicity: documents that the network scores as toxic go.
2. near copies: of each component of the n-gram Jaccard join the smallest id stays.
3. benchmark: contaminated documents go.
4. secrets: every found span is replaced, the documents stay.
5. tokens: the ids of each text, their digest, and that of the bytes they decode to, in place of the text.

``STAGES`` are called with the documents that the stage before left, written as Parquet and read
again; ``run`` does so itself, and deletes what a stage was given, and what writing it has shuffled, once its
result is written.

Defined cases: very long texts go through every stage whole; a null or empty text is no copy of another and stays to the end, with no ids; of rows
that repeat id and text one stays; rows that repeat only an id are documents of their own; a null id
stays and is never learnt from; an empty table gives no rows; other columns go through the stages as
they are, whatever their names, but for those that the last stage itself names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import bpe_matrix, decontaminate, jaccard_join, secret_ledger, toxicity
from loomline.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_ledger.redact(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_matrix.digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("byte_level_bpe", to_tokens),
]

#: A trained network decides in the first stage, so SQL cannot give these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Scratch(spark, "pipeline", tidy=True)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = kept.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if i:
            kept.remove(f"{i - 1}-{STAGES[i - 1][0]}")
    return docs
