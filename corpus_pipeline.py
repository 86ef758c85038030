"""Corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir), where docs is what the stage before kept, reread from Parquet.
All stages but the last return the columns of ``documents``, and keep further columns that docs may have, whatever their
names. An empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import exact_dedup, jaccard, language, mixing, packing
from pointloom.llm.common import fold, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a mean probability of at least ``language.LEAST``; those without letters go.

    The verdict is made beside the row it is about, so nothing is joined. Null texts and those without letters go; rows
    without ``lang`` are judged like any other; repeated rows are judged alike; with no ``lang`` at all nothing is kept.
    """
    model = language.fit(docs, trains=fold(F.col("doc_id"), language.FOLDS) != 0)
    return language.keep(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space the row with the smallest id stays; null counts as empty, and a null id stays only
    where no other has the text; of rows equal in id and text one stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more; the smallest id of a component stays, a null id only where there is no
    other; texts without words are linked with nothing, but of those equal in id and text one stays; rows are judged one by
    one where ids are null or repeated."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix; one taken twice is two rows. Null texts have no words, a null source is a source of its
    own, a source without words gives nothing; rows equal in id and text are taken or left together."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; a null text is empty and one piece (its end); rows that are repeated, or share or
    lack an id, are packed as rows of their own."""
    return packing.packed(docs)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A trained network and a tokenizer take part: not expressible in SQL, tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
