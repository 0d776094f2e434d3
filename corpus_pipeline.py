"""From raw documents to a training mix, as stages that each call one operator of tickloom.llm.

Every stage but the last returns the columns of documents; each works on all that the one before kept.

In every stage texts are taken whole, an empty table gives an empty one, further columns pass through and
rows that repeat are judged alike. What each does with nulls, empty texts and ties stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontaminate import decontaminated
from tickloom.llm.language import UNKNOWN, held_out, language_prototypes, with_language
from tickloom.llm.mixing import mix
from tickloom.llm.near_dedup import one_of_each
from tickloom.llm.suffix_dedup import without_repeats
from tickloom.llm.tables import new_path, written

#: Words that texts may share in a row; a passage of more is a repeat, however many bytes it has.
MAX_WORDS = 50
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def domain_of(source: str) -> Column:
    """The domain of a source: the tables have none, so the number in its name gives one of four."""
    return F.concat(F.lit("d"), (F.expr(f"try_cast(regexp_extract({source}, '([0-9]+)$', 1) AS BIGINT)") % 4).cast("string"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, with lang as predicted; null and empty texts and those without letters go.

    Rows with a null id or a null lang are judged by their text like others, but not learned from.
    """
    learned = language_prototypes(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = with_language(docs, learned).where(F.col("lang_pred") != UNKNOWN)
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; null and empty texts are copies of nothing.

    Rows that share an id are one document and stay or go together. A row with a null id goes if a named
    document of its group stays; else rows with the text that comes first by a hash stay.
    """
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes or more that stand elsewhere too go from all texts; n_chars follows.

    Texts of which nothing but spaces is left go; null and shorter texts stay as they are. Null ids count like others.
    """
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of more than MAX_WORDS words that stand elsewhere too go from all texts, then strings as in cut_repeats; n_chars follows.

    Texts of which nothing but white space is left go. The rest as in cut_repeats.
    """
    return cut_repeats(spark, written(without_repeats(docs, length=MAX_WORDS + 1, words=True), "without_runs"), sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim match of the benchmark, whatever their ids; null and empty texts and items match nothing."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by epoch so that tokens meet the target weights; a null domain, language or source is a leaf of its own.

    A null or empty text has no tokens. Ties in the seeded order go by id.
    """
    return mix(docs.withColumn("domain", domain_of("source")), LEVELS, WEIGHTS)


STAGES = [
    ("language_id", identify),
    ("near_dedup", dedupe),
    ("suffix_dedup", remove_repeats),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL cannot express the language profiles; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
