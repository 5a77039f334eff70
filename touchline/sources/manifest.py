"""File manifest: hash every file, compare with what was recorded, fingerprint the dataset."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, path, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of every file below ``path``, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def check_manifest(manifest: DataFrame, hashed: DataFrame) -> DataFrame:
    """Manifest rows (match_id, key, path, sha256) with status ok, changed or missing.

    A manifest path is relative: it has to match the end of the path read. Every file is offered under each end of its
    path, so files of one name in many folders meet their own rows only.
    """
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    found = hashed.select(F.col("sha256").alias("_found"), F.explode(ends).alias("_end"))
    joined = manifest.join(found, manifest["path"] == found["_end"], "left")
    status = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "changed").otherwise("ok")
    return joined.select("match_id", "key", "path", "sha256", status.alias("status"))


def require_manifest(checked: DataFrame) -> DataFrame:
    bad = checked.filter("status <> 'ok'").select("match_id", "key", "status")
    first = bad.limit(20).collect()
    if first:
        raise ValueError(f"{bad.count()} files: " + "; ".join(f"{r['match_id']}: {r['key']} {r['status']}" for r in first))
    return checked


def fingerprint(manifest: DataFrame) -> DataFrame:
    """One hash over every file hash, in a stable order.

    The list of files (not their content) meets in one row: a manifest has a few files per match.
    """
    entry = F.concat_ws(":", "match_id", "key", "sha256")
    return manifest.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256), 1, 16).alias("fingerprint"))
