"""The corpus pipeline: language filter, toxicity filter, near-duplicate removal, mixing to target weights, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next one's ``docs``. All but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows and empty tables pass through every stage as its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rareclass.llm import jaccard, langid, mixing, packing, toxicity
from rareclass.llm.shared import stored

#: A document stays when one language holds at least this share of its letters.
LEAST_LANGUAGE = 0.25
#: A document goes when its toxicity reaches this score.
TOXIC = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: drops documents without a language: null or no letter, or no language with a quarter of the letters.

    Languages are learned from all rows with a text and a ``lang``; where there is none, every text with a letter stays.
    """
    known = langid.train(docs)
    if not known.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.with_language(docs, known)
    return judged.filter((F.col("_llm_lang") != langid.UNKNOWN) & (F.col("_llm_share") >= LEAST_LANGUAGE)).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drops documents scored toxic. The model is learned from labels that have a document here, about 20,000 rows of each label at most
    (``sample`` of :func:`toxicity.learn`); without labels of both kinds all stay. Null texts count as empty; repeated rows are judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.with_toxicity(docs, toxicity.learn(docs.select("doc_id", "text"), labels))
    return judged.filter(F.col("_llm_toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: of each group of linked documents the one with the smallest id stays.

    Rows that share a ``doc_id`` are one document, of which the first by text stays; rows without an id are linked with nothing and stay.
    """
    gone = jaccard.near_texts(docs).filter("doc_id IS NOT NULL AND NOT kept").select("doc_id")
    left = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    order = W.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    return left.withColumn("_llm_rank", F.row_number().over(order)).filter("_llm_rank = 1").select(*docs.columns) \
        .unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents as often as the mix takes them; the last pass over a source cuts one document and leaves out the rest."""
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of all sequences of 2048 ids. A document that the mix repeats has pieces for each copy."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", keep_languages), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("mixing", mix_sources),
          ("packing", pack_sequences)]

#: Learned filters and hashed candidates have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
