"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. `run` writes each
one's result as Parquet to the shared folder and reads it again as the next
one's input. All but the last return the columns of documents; the last adds
``epoch`` (with underscores behind it if documents have such a column), and a
document stands in its result once for each epoch it is in.

Defined cases: columns of documents keep their names and values, whatever they
are called, but that text, and n_chars with it, change where personal data do;
null, empty and wordless texts are clean, link to nothing, hold no benchmark
window, stay as they are, and the mix, which takes no words from them, takes
them as often as their source's documents on the whole; repeated rows are near
duplicates with one document between them and stay or go together; an empty
table gives an empty result; very long texts are read whole in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.llm import decontamination, mixing, near_duplicates, pii, toxicity
from tonemill.llm.common import fresh_name, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the text classifier rejects go."""
    return toxicity.filter_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; shingles of five words."""
    return near_duplicates.dedupe(docs, size=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates."""
    return pii.replace(docs, pii.configured_key(spark), fresh_name("n_entities", docs)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    name, epoch = fresh_name("mix", docs), fresh_name("epoch", docs)
    repeats = F.col(name)["repeats"]
    mixed = mixing.with_repeats(docs, name).filter(repeats > 0)
    return mixed.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("long"), repeats))).select(*docs.columns, epoch)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("mixing", mix_sources),
]

#: SQL can't express the first stage, a trained classifier, nor the fourth, keyed
#: surrogates; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
