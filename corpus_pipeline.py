"""The corpus pipeline: five stages, each of which works on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder
and reread as the next stage's input; all but the last return the columns of `documents`. Rows with nulls, empty
texts, repeated rows and repeated ids go the way that each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataloom.llm import decontamination, mixing, passages, quality, simhash
from dataloom.llm.common import keyed, shared_folder, table, unused


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, for low quality or toxicity, go."""
    scorers = quality.fit(docs, table(spark, sf_dir, "labels"))
    names = tuple(unused(docs, x) for x in ("row_quality", "row_toxicity", "row_keep"))
    return quality.classify(docs, scorers, names=names).where(F.col(names[2])).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the least id."""
    return simhash.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat a passage of a document of lesser id are cut; documents left without words go."""
    cut = passages.cut_repeated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.where(F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `repetitions` (whole and fractional ones drawn), size, target and taken.

    Rows are told apart by their id or, where ids repeat or are null, by a number; a column of `docs` with the name of
    one that is added stays, and the added one gets underscores behind it.
    """
    row, of = unused(docs, "mix_row"), unused(docs, "mix_of")
    rows = keyed(docs, row)
    added = {c: unused(docs, c) for c in ("size", "target", "repetitions", "taken")}
    mixed = mixing.mix(rows, row_col=row).where("repetitions > 0").select(F.col(row).alias(of), *[F.col(c).alias(f"mix_of_{c}") for c in added])
    both = rows.join(mixed, F.col(row) == F.col(of))
    return both.select(*[rows[c] for c in docs.columns], *[F.col(f"mix_of_{c}").alias(name) for c, name in added.items()])


STAGES = [
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: SQL cannot express the classifier, fingerprint links and passages; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
