"""The corpus pipeline: five stages, each over all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.bpe import default_vocabulary
from quillmesh.llm.common import checkpoint_dir, settled
from quillmesh.llm.line_dedup import line_dedup
from quillmesh.llm.packing import pack
from quillmesh.llm.quality import classify
from quillmesh.llm.secret_scan import secret_scan
from quillmesh.llm.similar import similar_groups


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.filter("_keep").select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of windows that stand earlier go, and with its last line a document; n_chars follows the text."""
    out = line_dedup(docs, keep_columns=docs.columns).filter("n_removed = 0 OR n_removed < n_units")
    return _with_text(out, docs, F.col("kept_text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row stays: that of the smallest id.

    Documents are near duplicates if their sets of five-word shingles have a Jaccard similarity of 0.8
    or more.  No limit on differing SimHash bits finds all of these, so operator 4's links are candidates
    beside those of banded minima, and every pair is held against the whole sets.
    Null ids come after all others; among rows of one id the smallest hash of the row decides, and of
    rows that are equal throughout one stays.
    """
    own = [F.xxhash64(F.lit(seed), *docs.columns).alias(f"h{seed}") for seed in (0, 1)]
    keyed = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), *own))
    groups = similar_groups(keyed, shingle=5, id_col="_row")
    first = settled(groups.filter("component_id = _row").groupBy("_row").agg((F.count("*") > 1).alias("_many")))
    kept = keyed.join(first, "_row")
    once = kept.filter("NOT _many").select(docs.columns)
    if first.filter("_many").isEmpty():
        return once
    return once.unionByName(kept.filter("_many").dropDuplicates(["_row"]).select(docs.columns))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind; n_chars follows the text."""
    out = secret_scan(docs, redact=True)
    return _with_text(out, docs, F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return pack(docs, default_vocabulary())


def _with_text(out: DataFrame, docs: DataFrame, text) -> DataFrame:
    changed = {"text": text.alias("text"), "n_chars": F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return out.select(*[changed.get(c, F.col(c)) for c in docs.columns])


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", repeated_lines),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", packed),
]

#: trained models and tokens have no SQL; tests/llm holds the parts of the stages against brute force: line
#: dedup against SQL, near-dedup against all pairs, secrets against plain regexes, packing against the
#: library's ids, the classifier's posterior against plain sums and its models against held-out rows
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
