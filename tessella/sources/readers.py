"""Readers of submissions, labelled records, pair lists and other tools' reports. All go through Spark's sources, so a
path may be in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of source files, and their languages.
LANGUAGES = {"py": "python", "java": "java", "c": "c", "cpp": "cpp", "js": "javascript", "ts": "typescript", "go": "go"}
RECORDS = "code string, label string, problem_id string, source string"
LABELS = "1|true|yes|ai|generated|clone|plagiarized"


def _files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, value of every file below a folder; files that are not UTF-8 go."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.try_validate_utf8(F.col("content").cast("string")).alias("value")).filter("value IS NOT NULL")


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """sub_id, path, language, content of every source file below a folder. The key is the whole path, so that files of
    one name in two folders stay two submissions."""
    files = _files(spark, path, "*.{" + ",".join(LANGUAGES) + "}")
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    p = F.col("path")
    return files.select(F.sha2(p, 256).alias("sub_id"), p.alias("path"), names[F.lower(F.regexp_extract(p, r"\.(\w+)$", 1))].alias("language"), F.col("value").alias("content"))


def _labelled(df: DataFrame) -> DataFrame:
    """Labels become 0 or 1, null if missing; rows without code go."""
    label = F.lower(F.trim("label"))
    return df.filter("code IS NOT NULL AND code <> ''").withColumn("label", F.when(label.isNull() | (label == ""), None).otherwise(F.regexp_like(label, F.lit(f"^({LABELS})$")).cast("int")))


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    return _labelled(spark.read.csv(path, schema=RECORDS, header=True, multiLine=True, escape='"'))


def labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return _labelled(spark.read.json(path, schema=RECORDS))


def labelled_folders(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``ai`` and ``human``; the folder is the label."""
    side = F.regexp_extract("path", r"/(ai|human)/", 1)
    return _files(spark, path).select(F.col("value").alias("code"), F.when(side == "ai", 1).when(side == "human", 0).alias("label"), F.col("path").alias("source")).filter("label IS NOT NULL")


def first_of_each(df: DataFrame, text_col: str, order: list[str]) -> DataFrame:
    """Of equal texts the first row by ``order``; aggregated, so that a frequent text is summed before the shuffle."""
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in df.columns if c not in order]]])
    return df.groupBy(F.sha2(F.col(text_col), 256).alias("_digest")).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in df.columns])


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """file_a, file_b, label of a CSV; a pair has one order and, if listed again, its greatest label."""
    rows = spark.read.csv(path, schema="file_a string, file_b string, label int", header=True)
    return rows.groupBy(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b")).agg(F.max("label").alias("label"))


def moss_report(spark: SparkSession, path: str) -> DataFrame:
    """file_a, file_b, percent_a, percent_b, lines of a result page."""
    row = r"(?is)<tr>\s*<td>\s*<a[^>]*>([^<]+?)\s*\((\d+)%\)</a>\s*<td>\s*<a[^>]*>([^<]+?)\s*\((\d+)%\)</a>\s*<td[^>]*>\s*(\d+)"
    pages = _files(spark, path)
    hits = pages.select(F.explode(F.regexp_extract_all("value", F.lit(row), F.lit(0))).alias("r"))
    part = lambda k: F.regexp_extract("r", row, k)
    return hits.select(part(1).alias("file_a"), part(3).alias("file_b"), part(2).cast("int").alias("percent_a"), part(4).cast("int").alias("percent_b"), part(5).cast("int").alias("lines"))


def jplag_report(spark: SparkSession, path: str) -> DataFrame:
    """file_a, file_b, score of JSON comparison files."""
    rows = spark.read.json(path, schema="firstSubmissionId string, secondSubmissionId string, similarity double", multiLine=True)
    return rows.select(F.col("firstSubmissionId").alias("file_a"), F.col("secondSubmissionId").alias("file_b"), F.col("similarity").alias("score"))


def clone_report(spark: SparkSession, path: str) -> DataFrame:
    """class_id, similarity, file, first, last of clone classes in XML."""
    rows = spark.read.format("xml").option("rowTag", "class").schema("_classid long, _similarity double, source array<struct<_file:string,_startline:int,_endline:int>>").load(path)
    return rows.select("_classid", "_similarity", F.explode("source").alias("s")).select(F.col("_classid").alias("class_id"), F.col("_similarity").alias("similarity"), F.col("s._file").alias("file"), F.col("s._startline").alias("first"), F.col("s._endline").alias("last"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """hash, author, email, ts, message of a log written with the format "%H%x09%an%x09%ae%x09%at%x09%s"."""
    part = lambda i: F.get(F.split("value", "\t", 5), F.lit(i))
    return spark.read.text(path).filter("value <> ''").select(part(0).alias("hash"), part(1).alias("author"), part(2).alias("email"), F.timestamp_seconds(part(3).cast("long")).alias("ts"), part(4).alias("message"))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """One row of counts: pairs, bad labels, empty sides, pairs with themselves, repeated pairs."""
    c = F.count_if
    same = pairs.groupBy(F.least("file_a", "file_b"), F.greatest("file_a", "file_b")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    every = pairs.agg(F.count(F.lit(1)).alias("pairs"), c(F.coalesce(~F.col("label").isin(0, 1, 2, 3, 4), F.lit(True))).alias("bad_labels"), c(F.col("file_a").isNull() | F.col("file_b").isNull()).alias("empty"), c(F.col("file_a") == F.col("file_b")).alias("selves"))
    return every.join(F.broadcast(same))  # one row each
