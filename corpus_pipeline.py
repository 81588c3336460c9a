"""Training-data pipeline over ``documents``. Counted as part of the subpackage llm.

Each stage reads what its predecessor kept, from Parquet. Texts that the classifier rejects go; of each
group of near duplicates the document with the smallest doc_id stays; secrets are replaced by their kind;
what is left is tokenised and packed. All but the last return the columns of their input, whatever these are
called. Texts of null count as empty; an empty table passes every stage and gives no sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.common import table, written
from evidra.llm.jaccard import one_of_each
from evidra.llm.packing import pack_documents
from evidra.llm.quality import keep_good
from evidra.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects.

    Null text is scored as empty; repeated rows go or stay together; without trusted positives all stay; rows of
    a null doc_id are scored like others; columns named like the classifier's keep their own values.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that of the smallest doc_id.

    Texts without words (null, empty) are in no group and stay; rows that repeat a kept doc_id stay too, as do
    rows of a null doc_id.
    """
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; ``n_chars``, where there is one, is counted anew.

    Null text stays null; overlapping secrets are replaced together; very long texts are scanned whole.
    """
    out = redact_secrets(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, with the ids.

    Null and empty text are the end id alone; repeated rows are packed as often as they occur.
    """
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]
#: A trained model and a tokenizer have no SQL form; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
