"""From raw documents to packed sequences: the operators of ``strata.llm`` as one pipeline.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all
that the stage before it kept, and returns a DataFrame, which :func:`run` writes as
Parquet and reads again for the next.  All but the last return the columns of
``documents``.  Each stage is defined on null texts and ids, empty tables, repeated rows and
extra columns as its operator is; null texts do not pass the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import store, table
from strata.llm.decontaminate import leaks
from strata.llm.fertility import VOCABULARY as PIECES
from strata.llm.fertility import fertility_rules
from strata.llm.jaccard_join import jaccard_classes
from strata.llm.line_dedup import dedup_lines, free_name
from strata.llm.packing import RANKS
from strata.llm.packing import VOCABULARY as BYTES
from strata.llm.packing import pack, pieces_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their language's fertility band go."""
    import public_tokenizers

    rejected = fertility_rules(docs, public_tokenizers.path(PIECES)).filter("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return without(docs, rejected)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing is left."""
    removed = free_name("n_removed_lines", docs.columns)
    out = dedup_lines(docs).filter((F.col(removed) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8 or more) one document stays: the
    least (doc_id, text key), any id before a null one.  Documents without words stay."""
    # a class is keyed by its root set, so null and repeated ids don't split or join classes
    classes = store(jaccard_classes(docs, size=5, percent=80, roots=True), "pipeline-classes")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    least = classes.groupBy("root").agg(F.min(place).alias("least"))
    gone = classes.join(least, "root").filter(~place.eqNullSafe(F.col("least")))
    kept = without(docs, gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))
    # rows that repeat whole are one document; texts are grouped only if there are any
    again = classes.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if again else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = leaks(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences."""
    import public_tokenizers

    return pieces_digest(pack(docs, public_tokenizers.path(BYTES), ranks=public_tokenizers.path(RANKS)))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rejected (doc_id, text key) pairs, which are few columns and never texts."""
    gone = rejected.distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_key"]), "left_anti")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("packing", packing)]

# The stages need tokenisers, content-defined chunks and hashes that SQL hasn't got; the tests hold each
# stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
