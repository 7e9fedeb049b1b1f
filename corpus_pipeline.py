"""A corpus pipeline: documents in, packed training sequences out.

Stages, each over all rows that the one before kept: language identification (texts without
letters go, and those mostly in scripts of no learned language), toxicity (texts predicted toxic go), exact de-duplication, near-duplicates (one document of
each group stays) and best-fit packing. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm import exact, langid, minhash, packing, toxicity
from ruleweave.llm.common import materialize, may_match, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, at least half of them in scripts of learned languages."""
    return langid.keep_known(docs, langid.fit(docs, ~langid.held_out()))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _chosen(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs with (or, how="left_anti", without) the ids."""
    ids = ids.select(F.col("doc_id").alias("chosen_"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["chosen_"]), how)


def _without(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of docs but for ids of which told keeps no row. Rows that a fixed-size filter tells from those are not shuffled."""
    dropped = materialize(told.groupBy("doc_id").agg(F.max("kept").alias("kept_")).filter("not kept_").select(F.col("doc_id").alias("dropped_")), "pipeline-dropped")
    met = may_match(docs.select(F.struct("*").alias("row_"), F.col("doc_id").alias("match_")), F.col("match_"), dropped, F.col("dropped_"))
    some = met.filter("maybe_").join(dropped, F.col("match_").eqNullSafe(F.col("dropped_")), "left_anti")
    return met.filter("not maybe_").select("row_.*").unionByName(some.select("row_.*"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    told = materialize(exact.exact_groups(docs, exact.half_snapshot()), "pipeline-exact")
    kept = _without(docs, told)
    again = told.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1")
    if not again.take(1):
        return kept
    # Some id has several rows: those are told apart by their text, and of equal ones one stays.
    digest = next(n for k in range(len(docs.columns) + 1) if (n := f"digest_{k}") not in docs.columns)
    some = _chosen(docs, again).withColumn(digest, F.sha2(exact.normalised(F.col("text")), 256)).dropDuplicates(["doc_id", digest])
    sure = told.filter("kept").select(F.col("doc_id").alias("chosen_"), F.col("text_sha256").alias("sure_")).distinct()
    some = some.join(sure, some["doc_id"].eqNullSafe(sure["chosen_"]) & (some[digest] == sure["sure_"]), "left_semi").drop(digest)
    return _chosen(kept, again, "left_anti").unionByName(some)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return _without(docs, minhash.near_duplicates(docs, percent=80))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("exact", one_of_equal),
    ("near", one_of_near),
    ("packing", packed),
]

#: None of the classifying stages can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
