"""A corpus pipeline: documents in, a mixed and shuffled training set out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import decontaminate, language_id, mixing, simhash, substring_dedup
from quillwork.storage import only_kept, remove, written
from quillwork.session import bound, ship
from quillwork.tables import table


def prepare(spark: SparkSession) -> None:
    ship(spark)
    bound(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the model is sure of go: null and empty texts and those without a letter, too.

    Repeated rows, null ids and very long texts are judged like any other; without labelled rows all go; an empty table
    stays empty. All stages keep all columns, whatever their names.
    """
    prepare(spark)
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the first by id, null last, then by text.

    Rows that repeat id and text are one document, and so are all texts without a word; different texts that share an
    id are documents of their own.
    """
    prepare(spark)
    return simhash.keep_representatives(docs, one_per_id=False)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut; a document of which nothing is left goes.

    Null and empty texts stay; n_chars follows the text where it is cut; ids have any type, and null ids are a document
    for each text.
    """
    prepare(spark)
    cut = substring_dedup.deduplicate(docs)
    cut = cut.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.filter("_n_removed = 0 or _n_removed < _n_words").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go. Null and empty texts hold none; an empty benchmark drops nothing."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to equal weights and shuffled; a null source is a source, a row without id draws by itself."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_sources),
]

#: The stages learn a model and hash fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. Of what they write, the last table stays; others go as soon as the next is whole."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept: list[DataFrame] = []
        with only_kept(kept):
            kept.append(written(stage(spark, before, sf_dir), f"pipeline-{name}"))
        if before is not docs:
            remove(before)
        before = kept[0]
    return before
