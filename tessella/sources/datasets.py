"""Readers of labelled corpora of code pairs into one record: dataset, pair_id, code_a, code_b, label (0 or 1), clone_type
(0 to 4, null if unknown), language. Corpora that are kept as columnar dumps are read from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.sources.readers import LABELS, _files

PAIR = ["dataset", "pair_id", "code_a", "code_b", "label", "clone_type", "language"]
METADATA = "name string, version string, language string, clone_types array<int>, difficulty string, size long, source string, license string, ground_truth_format string, description string"


def _binary(label: Column) -> Column:
    """0 or 1 of a flag, a word, or a grade from 0 to 4 of which 2 and more are clones."""
    text = F.lower(F.trim(label.cast("string")))
    grade = text.try_cast("double")
    return F.when(text.isNull() | (text == ""), None).when(grade.isNotNull() & (grade > 1), (grade >= 2).cast("int")).otherwise(F.regexp_like(text, F.lit(f"^({LABELS})$")).cast("int"))


def _pairs(rows: DataFrame, name: str, language: Column, clone_type: Column | None = None) -> DataFrame:
    pair = F.coalesce(F.col("pair_id").cast("string"), F.substr(F.sha2(F.concat_ws("\x00", "code_a", "code_b"), 256), F.lit(1), F.lit(16)))
    kind = F.lit(None).cast("int") if clone_type is None else clone_type.cast("int")
    return rows.select(F.lit(name).alias("dataset"), pair.alias("pair_id"), "code_a", "code_b", _binary(F.col("label")).alias("label"), kind.alias("clone_type"), language.alias("language"))


def pair_table(spark: SparkSession, path: str, name: str, language: str, columns: dict[str, str], fmt: str = "csv") -> DataFrame:
    """A CSV, JSON-lines or Parquet table that holds both codes; ``columns`` maps code_a, code_b, label and, if there are
    any, pair_id and clone_type to its own names."""
    read = spark.read.option("header", True).option("multiLine", fmt == "csv").option("escape", '"')
    rows = read.format(fmt).load(path)
    have = {k: F.col(f"`{v}`") for k, v in columns.items() if v in rows.columns}
    rows = rows.select(*[have.get(k, F.lit(None).cast("string")).alias(k) for k in ("pair_id", "code_a", "code_b", "label", "clone_type")])
    return _pairs(rows, name, F.lit(language), F.col("clone_type"))


def file_pairs(spark: SparkSession, folder: str, truth: DataFrame, name: str, language: str, pattern: str = "*") -> DataFrame:
    """Files below a folder, paired by a list (file_a, file_b, label) of names relative to it."""
    files = _files(spark, folder, pattern).select(F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "").alias("file"), F.col("value").alias("code"))
    both = truth.join(files.toDF("file_a", "code_a"), "file_a").join(files.toDF("file_b", "code_b"), "file_b")
    return _pairs(both.select(F.concat_ws("|", "file_a", "file_b").alias("pair_id"), "code_a", "code_b", "label"), name, F.lit(language))


def truth_json(spark: SparkSession, path: str) -> DataFrame:
    """file_a, file_b, label of a JSON array of pairs."""
    return spark.read.json(path, schema="file_a string, file_b string, label string", multiLine=True).filter("file_a IS NOT NULL AND file_b IS NOT NULL")


def folders_as_groups(spark: SparkSession, folder: str, name: str, language: str, pattern: str = "*", each: int = 2) -> DataFrame:
    """Pairs from a tree with a folder for each task: a file with the ``each`` next ones of its folder in hash order are
    clones, and with as many of the next folder none. Linear in the files."""
    files = _files(spark, folder, pattern).select("path", F.element_at(F.split("path", "/"), -2).alias("task"), F.col("value").alias("code"))
    of = files.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    ring = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("task")) - 1
    tasks = of.select("task", "n", ring.alias("at"))  # a row for each folder
    last = tasks.agg(F.max("at").alias("last"))
    following = tasks.join(F.broadcast(last)).select("task", "n", F.when(F.col("at") == F.col("last"), 0).otherwise(F.col("at") + 1).alias("at")).join(tasks.select(F.col("task").alias("other"), F.col("n").alias("m"), "at"), "at").select("task", "n", "other", "m")
    numbered = files.withColumn("i", F.row_number().over(Window.partitionBy("task").orderBy(F.xxhash64("path"), "path")) - 1)
    step = F.explode(F.sequence(F.lit(1), F.lit(each)))
    left = numbered.join(following, "task").withColumn("step", step)
    same = left.select("path", "code", F.col("task").alias("to"), ((F.col("i") + F.col("step")) % F.col("n")).alias("j"), F.lit("1").alias("label"), "step")
    cross = left.filter("other <> task").select("path", "code", F.col("other").alias("to"), ((F.col("i") + F.col("step")) % F.col("m")).alias("j"), F.lit("0").alias("label"), "step")
    right = numbered.select(F.col("task").alias("to"), F.col("i").alias("j"), F.col("path").alias("path_b"), F.col("code").alias("code_b"))
    met = same.unionByName(cross).join(right, ["to", "j"]).filter("path <> path_b")
    one = met.select(F.concat_ws("|", F.least("path", "path_b"), F.greatest("path", "path_b")).alias("pair_id"), F.col("code").alias("code_a"), "code_b", "label").dropDuplicates(["pair_id"])
    return _pairs(one, name, F.lit(language))


def single_records(spark: SparkSession, path: str, name: str, code: str, key: str, label: str | None = None, fmt: str = "parquet") -> DataFrame:
    """dataset, record_id, code, label of a table of single programs: solutions, defects, functions."""
    rows = spark.read.format(fmt).load(path)
    return rows.select(F.lit(name).alias("dataset"), F.col(f"`{key}`").cast("string").alias("record_id"), F.col(f"`{code}`").alias("code"), (_binary(F.col(f"`{label}`")) if label else F.lit(None).cast("int")).alias("label")).filter("code IS NOT NULL")


def union_of(parts: list[DataFrame]) -> DataFrame:
    """Several datasets, or raw tables of them, one below the other; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Loaders by the name of the corpus: (spark, path) to pairs or, for the last ones, single records.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "big_clone_bench": lambda spark, path: folders_as_groups(spark, path, "big_clone_bench", "java", "*.java"),
    "poj104": lambda spark, path: folders_as_groups(spark, path, "poj104", "c"),
    "code_similarity": lambda spark, path: pair_table(spark, path, "code_similarity", "python", {"code_a": "code1", "code_b": "code2", "label": "similar", "pair_id": "id"}),
    "clone_detection": lambda spark, path: pair_table(spark, path, "clone_detection", "java", {"code_a": "func1", "code_b": "func2", "label": "label", "pair_id": "id"}, "parquet"),
    "labelled_java": lambda spark, path: pair_table(spark, path, "labelled_java", "java", {"code_a": "code_a", "code_b": "code_b", "label": "label", "clone_type": "clone_type"}),
    "code_jam": lambda spark, path: file_pairs(spark, f"{path}/submissions", truth_json(spark, f"{path}/ground_truth.json"), "code_jam", "python", "*.py"),
    "student_code": lambda spark, path: file_pairs(spark, f"{path}/files", spark.read.csv(f"{path}/pairs.csv", schema="file_a string, file_b string, label string", header=True), "student_code", "python"),
    "assignments": lambda spark, path: file_pairs(spark, f"{path}/submissions", truth_json(spark, f"{path}/ground_truth.json"), "assignments", "java", "*.java"),
    "defects": lambda spark, path: single_records(spark, path, "defects", "func", "id", "target"),
    "solutions": lambda spark, path: single_records(spark, path, "solutions", "canonical_solution", "task_id"),
    "small_problems": lambda spark, path: single_records(spark, path, "small_problems", "code", "task_id"),
    "functions": lambda spark, path: single_records(spark, path, "functions", "whole_func_string", "func_code_url"),
}


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"no such dataset: {name}; known are {sorted(LOADERS)}")
    return LOADERS[name](spark, path)


def validate(pairs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row: pairs, empty codes, missing labels, bad clone types, clone types that contradict labels, repeated ids, texts
    that two ids share, the balance of labels, and whether the metadata's size holds."""
    c = F.count_if
    kind = F.col("clone_type")
    texts = F.sha2(F.concat_ws("\x00", F.least("code_a", "code_b"), F.greatest("code_a", "code_b")), 256)
    repeats = lambda key: pairs.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    out = pairs.agg(
        F.count(F.lit(1)).alias("pairs"), c((F.coalesce(F.trim("code_a"), F.lit("")) == "") | (F.coalesce(F.trim("code_b"), F.lit("")) == "")).alias("empty"), c(F.col("label").isNull()).alias("unlabelled"),
        c(~kind.between(0, 4)).alias("bad_types"), c((F.col("label") == 1) & (kind == 0) | (F.col("label") == 0) & (kind > 0)).alias("contradictions"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("positive_share"),
    )
    out = out.join(F.broadcast(repeats(F.col("pair_id")).toDF("repeated_ids"))).join(F.broadcast(repeats(texts).toDF("repeated_texts")))  # one row each
    size = metadata.agg(F.max("size").alias("size")) if metadata is not None else None
    return out.join(F.broadcast(size)).withColumn("size_holds", F.col("pairs") == F.col("size")).drop("size") if size is not None else out
