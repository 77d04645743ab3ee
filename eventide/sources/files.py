"""Datasets in CSV, probability files and packages."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATES = 100


def discover_datasets(spark: SparkSession, folder: str) -> list[str]:
    """Sorted child folders that hold train.csv and test.csv, in any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    has = lambda p, name: fs.exists(jvm.org.apache.hadoop.fs.Path(p, name))
    return sorted(str(s.getPath()) for s in fs.listStatus(top) if s.isDirectory() and has(s.getPath(), "train.csv") and has(s.getPath(), "test.csv"))


def chosen(spark: SparkSession, folder: str, names: list[str] | None = None, done: str | None = None, most: int | None = None) -> list[str]:
    """The datasets to work on: those named, or all, without those that have a finished result under ``done``, at most ``most``."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = [d for d in discover_datasets(spark, folder) if names is None or d.rstrip("/").rpartition("/")[2] in names]
    if names is not None and (missing := set(names) - {d.rstrip("/").rpartition("/")[2] for d in found}):
        raise ValueError(f"no datasets {sorted(missing)} in {folder}")
    if done is not None:
        mark = lambda d: jvm.org.apache.hadoop.fs.Path(f"{done}/{d.rstrip('/').rpartition('/')[2]}/_SUCCESS")
        found = [d for d in found if not mark(d).getFileSystem(conf).exists(mark(d))]
    return found[:most]


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, time) of a CSV with a header that has these columns; others are not read."""
    raw = spark.read.csv(path, header=True)
    if missing := {"src", "dst", "time"} - set(raw.columns):
        raise ValueError(f"{path} lacks columns {sorted(missing)}")
    return raw.select(*(F.col(c).cast("bigint") for c in ("src", "dst", "time")))


def read_test_queries(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """(src, time, candidates) of a CSV that begins with src, time and has CANDIDATES more columns."""
    raw = spark.read.csv(path, header=True)
    if raw.columns[:2] != ["src", "time"] or len(raw.columns) != 2 + CANDIDATES:
        raise ValueError(f"{path} must have src, time and {CANDIDATES} candidates")
    out = raw.select(F.col("src").cast("bigint"), F.col("time").cast("bigint"), F.array(*(F.col(f"`{c}`").cast("bigint") for c in raw.columns[2:])).alias("candidates"))
    return out.limit(max_rows) if max_rows is not None else out


def write_probabilities(scores: DataFrame, path: str) -> None:
    """One line per query in the order of qid, its scores in the order of pos, exact to the last bit, without a header. Files come in order of their names."""
    rows = scores.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"].cast("string")), ",").alias("value"))
    rows.repartitionByRange("qid").sortWithinPartitions("qid").select("value").write.text(path)


def validate_probabilities(lines: DataFrame, rows: int, width: int = CANDIDATES) -> DataFrame:
    """(n_rows, right_rows, right_width, in_range) of a probability file read as text."""
    parts = F.split("value", ",")
    inside = F.forall(F.transform(parts, lambda x: x.try_cast("double")), lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False)))
    return lines.select(F.size(parts).alias("w"), inside.alias("ok")).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) == rows).alias("right_rows"), F.bool_and(F.col("w") == width).alias("right_width"), F.bool_and("ok").alias("in_range")
    )


def package(members: dict[str, bytes], path: str) -> str:
    """A ZIP of the members with a manifest of their SHA-256; an existing file is not overwritten. Returns the archive's SHA-256."""
    if Path(path).exists():
        raise FileExistsError(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(members.items()):
            z.writestr(name, data)
        z.writestr("manifest.json", json.dumps({n: hashlib.sha256(d).hexdigest() for n, d in sorted(members.items())}))
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def verify_package(path: str) -> bool:
    """Whether every member has the SHA-256 that the manifest gives."""
    with zipfile.ZipFile(path) as z:
        listed = json.loads(z.read("manifest.json"))
        return set(z.namelist()) == {*listed, "manifest.json"} and all(hashlib.sha256(z.read(n)).hexdigest() == h for n, h in listed.items())


def cached_features(features: DataFrame, folder: str, key: dict) -> DataFrame:
    """The features from Parquet named by the hash of what they depend on; written there at the first call."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:32]
    path, spark = f"{folder}/{name}", features.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        features.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def node_ids(events: DataFrame) -> DataFrame:
    """(role, raw, id): dense ids from 0 per role in the order of the raw ids; numbers run over ranges first, so no task sorts a whole role."""
    raw = events.select(F.lit("src").alias("role"), F.col("src").alias("raw")).union(events.select(F.lit("dst"), "dst")).distinct()
    ranged = raw.repartitionByRange("role", "raw").withColumn("part", F.spark_partition_id())
    within = ranged.withColumn("k", F.row_number().over(Window.partitionBy("role", "part").orderBy("raw")))
    starts = within.groupBy("role", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("role").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return within.join(F.broadcast(starts.select("role", "part", "first")), ["role", "part"]).select("role", "raw", (F.col("first") + F.col("k") - 1).alias("id"))
