"""The corpus pipeline: documents are sifted by language, quality, near duplicates and benchmark leaks, and what stays is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
documents. `run` writes each stage's result as Parquet in the shared folder and reads it again.

Texts that are null or empty have no language and go in the first stage. Of the rows of a group of near duplicates, repeats of a row included, that of the
smallest doc_id stays, rows without doc_id last, then the first in the table (files in order of their paths, if docs is
a table as it was read). Rows without doc_id are sifted like any other.
"""

from __future__ import annotations

from urllib.parse import unquote

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmentry.llm import decontam, langid, minhash, packing, quality
from segmentry.llm.shared import cut, filtered, fresh, hinted, scratch

#: The main language of a document has at least this share of its words.
LEAST_SHARE = 1 / 3
#: Least probability of the best grade.
LEAST_QUALITY = 0.5
#: Files whose names are broadcast at most, and a bound of the rows of one.
FILES, ROWS_OF_FILE = 100_000, 1 << 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: likely enough in the known ones, and with a main one."""
    model = spark.sparkContext.broadcast(langid.learned_from(docs))

    def keeps(texts: list[bytes]) -> np.ndarray:
        shares, known = model.value.judged([t.decode() for t in texts])
        return known & (shares.max(axis=1, initial=0) >= LEAST_SHARE)

    return filtered(docs, keeps)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are neither toxic nor of low quality, as the labels of those that are left teach it."""
    model = spark.sparkContext.broadcast(quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return filtered(docs, lambda texts: model.value.tails(texts)[:, -1] >= LEAST_QUALITY)


def is_table(docs: DataFrame) -> bool:
    """Whether docs is a file or a folder of Parquet files as it was read, nothing done to it; where that isn't sure, it is not."""
    files = [unquote(x) for x in docs.inputFiles()[:1]]
    paths = [y for x in files for y in (x.rsplit("/", 1)[0], x)]
    read = docs.sparkSession.read.schema(docs.schema)
    try:
        return any(docs.sameSemantics(read.parquet(x)) for path in paths for x in dict.fromkeys((path, path.removeprefix("file://"))))
    except PySparkException:
        return False


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row that stays the row's, and the name of the number.

    Rows of a table have one without being written again: their file's number, in order of its path, and their place in it. All others are written with a number.
    """
    name, file, at = (fresh(docs, x) for x in ("_row", "_file", "_file_number"))
    if not is_table(docs):
        return cut(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    meta = docs.metadataColumn("_metadata")
    placed = docs.withColumns({file: meta["file_path"], name: meta["row_index"]})
    files = placed.select(file).distinct().withColumn(at, F.row_number().over(Window.orderBy(file)).cast("long"))  # a row a file
    files = cut(files, "files", keep=True)
    return placed.join(hinted(files, FILES), file).withColumn(name, F.col(at) * F.lit(ROWS_OF_FILE) + F.col(name)).select(*docs.columns, name), name


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts with four fifths of their five-word shingles in common."""
    rows, row = numbered(docs)
    with scratch(spark):
        gone = cut(minhash.superfluous(rows, row, words=5, percent=80), "gone", keep=True)
    return rows.join(gone.withColumnRenamed("key", row), row, "left_anti").select(docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    rows, row = numbered(docs)
    with scratch(spark):
        found = cut(decontam.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select(F.col("doc_id").alias(row)).distinct(), "leaks", keep=True)
    return rows.join(hinted(found, decontam.BROADCAST_ROWS), row, "left_anti").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, 4096)


STAGES = [("language", language), ("quality", good), ("near_duplicates", unique), ("decontamination", clean), ("packing", packed)]

#: Two stages are learned and one is encoded by a tokenizer; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (last, final) = STAGES
    with scratch(spark):
        for name, stage in first:
            with scratch(spark):
                docs = cut(stage(spark, docs, sf_dir), name, keep=True)
        return cut(final(spark, docs, sf_dir), last, keep=True)
