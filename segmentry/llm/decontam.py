"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles. DataFrame operations only.

Documents are far longer than test items, so their Jaccard similarity says nothing; containment of the item is sought. Items
are partitioned by size. Of each item the k least hashes of its distinct shingles are kept (a bottom-k MinHash), k following from
the largest size s of its partition: k = s - ceil(t * s) + 1 for containment t. A document that contains t of an item's shingles
misses too few of them to miss all k minima, so a lookup of each document shingle among the kept minima
loses no pair. The candidates are confirmed on whole shingle sets. No document shingle is shuffled: the minima
are broadcast after their number is counted, or joined by shuffle where they are too many.

Words are runs of letters and digits, lower-cased. Items with fewer words than the shingle width are one shingle, looked up among
the documents' shingles of that width. Null or wordless items and texts meet nothing. Rows that repeat
an item or a document are found each; ids may be null. Columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import cut, hinted, scratch

#: Rows of kept minima, and of benchmark shingles, up to which they are broadcast (some 20 bytes a row).
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of `width` words."""
    last = F.size(words) - width
    at = lambda i, k: F.get(words, i + k)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(at(i, k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def item_minima(items: DataFrame, words: int, percent: int) -> DataFrame:
    """(item, width, shingles, minima) of items (item, text): distinct shingle hashes, and the least k of them in ascending order of a second hash."""
    split = items.select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    by_width = [
        split.where(F.size("w") == n if n < words else F.size("w") >= words).select("item", F.lit(n).alias("width"), F.array_distinct(shingle_hashes(F.col("w"), n)).alias("shingles"))
        for n in range(1, words + 1)
    ]
    rows = by_width[0]
    for x in by_width[1:]:
        rows = rows.unionByName(x)
    size = F.size("shingles")
    # Partitions are powers of two of the size; k is that of the partition's largest size, and all of a smaller item's shingles at most.
    top = F.pow(F.lit(2), F.floor(F.log2(size)) + 1).cast("int") - 1
    k = top - F.ceil(top * percent / 100).cast("int") + 1
    scattered = F.array_sort(F.transform("shingles", lambda x: F.struct(F.xxhash64(x).alias("r"), x.alias("x"))))
    return rows.withColumn("minima", F.transform(F.slice(scattered, F.lit(1), k), lambda s: s["x"]))


def _exploded(texts: DataFrame, widths: list[int], *keep: str) -> DataFrame:
    """A row for each distinct shingle hash `g` of each of these widths of each text, split into words once."""
    words = texts.select(*keep, words_of(F.col("text")).alias("w"))  # a column of its own, so that it is computed once a row

    def of(n: int) -> Column:
        return F.array_distinct(shingle_hashes(F.col("w"), n))

    def tagged(n: int) -> Column:
        return F.transform(of(n), lambda g: F.struct(F.lit(n).alias("width"), g.alias("g")))

    if len(widths) == 1:
        return words.select(*keep, F.lit(widths[0]).alias("width"), F.explode(of(widths[0])).alias("g"))
    return words.select(*keep, F.explode(F.concat(*map(tagged, widths))).alias("s")).select(*keep, "s.width", "s.g")


def contaminated(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of each document and item with at least percent of the item's distinct shingles in the document."""
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    items = items.select(items[item_col].cast("long").alias("item"), items[item_text].cast("string").alias("text"))
    with scratch(docs.sparkSession):
        tests = cut(item_minima(items, words, percent).withColumn("n", F.monotonically_increasing_id()), "items")
        widths = sorted(r[0] for r in tests.select("width").distinct().collect())  # at most `words` of them
        if not widths:
            return rows.select(F.col("doc").alias("doc_id"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_shared"), F.lit(0).alias("n_item")).limit(0)
        minima = tests.select(F.explode("minima").alias("g"), "width").distinct()
        whole = tests.select("n", "item", "width", F.size("shingles").alias("n_item"), F.explode("shingles").alias("g"))
        # A document with any of the minima is a candidate; its text's whole shingle set then meets the items.
        candidates = cut(_exploded(rows, widths, "doc").join(hinted(minima, broadcast_rows), ["width", "g"]).select("doc").distinct(), "candidates")
        chosen = rows.join(hinted(candidates.withColumnRenamed("doc", "found"), broadcast_rows), F.col("doc").eqNullSafe(F.col("found")), "left_semi")
        chosen = cut(chosen, "chosen").withColumn("r", F.monotonically_increasing_id())  # of a written table: a task that runs again numbers its rows alike
        met = _exploded(chosen, widths, "doc", "r").join(hinted(whole, broadcast_rows), ["width", "g"])
        shared = met.groupBy("doc", "r", "n", "item", "n_item").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        return cut(shared.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_shared").cast("int"), "n_item"), "found", keep=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold to four fifths of their five-word shingles."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
