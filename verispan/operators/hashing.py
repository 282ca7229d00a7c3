"""Digests that do not depend on the order of rows, content keys, caches and locks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_row(*columns: Column) -> Column:
    """One text of the values, null apart from empty; values are escaped so that no two rows share a text."""
    return F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))), F.lit("~")) for c in columns))


def digest(df: DataFrame, row: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n and digest: the same for the same rows in any order and partitioning, repeated rows counted.

    Four sums of 60-bit pieces of the rows' SHA-256, hashed together with the
    number of rows: they combine on the map side, nothing is gathered or sorted.
    """
    h = F.sha2(row, 256)
    pieces = [F.sum(F.conv(F.substring(F.col("_h"), 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"_s{i}") for i in range(4)]
    g = df.select(*keys, h.alias("_h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *pieces)
    return g.select(*keys, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.coalesce(F.col(f"_s{i}").cast("string"), F.lit("0")) for i in range(4))), 256).alias("digest"))


def content_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|'; a null part counts as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def lookup(requests: DataFrame, cache: DataFrame, key: str, synthetic: str = "is_synthetic") -> DataFrame:
    """requests with ``hit`` and the cached ``value``: an entry without value is a miss, and real requests never get synthetic entries."""
    c = cache.where(F.col("value").isNotNull()).groupBy(key, synthetic).agg(F.min("value").alias("value"))
    same = (F.col(f"r.{key}") == F.col(f"c.{key}")) & (F.col(f"r.{synthetic}") == F.col(f"c.{synthetic}"))
    return requests.alias("r").join(c.alias("c"), same, "left").select("r.*", F.col("c.value").alias("value"), F.col("c.value").isNotNull().alias("hit"))


def split_digests(assigned: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Per split: number of distinct ids and their digest."""
    d = assigned.select(F.col(split).alias("split"), F.col(column).cast("string").alias("_id")).where("_id is not null").distinct()
    return digest(d, canonical_row(F.col("_id")), ["split"])


def split_isolation(assigned: DataFrame, column: str, split: str = "split") -> DataFrame:
    """(split_a, split_b, n_shared) of ids that two splits hold; no row where all are apart."""
    from verispan.operators.audits import shared_keys

    return shared_keys(assigned, F.col(split), F.col(column)).toDF("split_a", "split_b", "n_shared")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and SHA-256 of every file of a folder."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


# Words that name results, which a lock of inputs must not hold.
RESULT_WORDS = frozenset("accuracy precision recall f1 auroc auc brier ece log_loss metric metrics score".split())


def write_lock(spark: SparkSession, folder: str, target: str, meta: dict | None = None) -> dict:
    """Seal the files of a folder: names, digests and one digest over all, as JSON. Keys that name results are refused."""
    bad = {str(k).lower() for k in (meta or {})} & RESULT_WORDS
    if bad:
        raise ValueError(f"a lock must not hold results: {sorted(bad)}")
    files = {r["name"]: r.sha256 for r in file_digests(spark, folder).collect()}  # a row per file of a manifest folder
    body = {"files": dict(sorted(files.items())), "meta": meta or {}}
    lock = body | {"lock": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}
    Path(target).write_text(json.dumps(lock, indent=1, sort_keys=True))
    return lock


def verify_lock(spark: SparkSession, folder: str, path: str) -> list[str]:
    """What no longer agrees with a lock; an empty list where all does."""
    lock = json.loads(Path(path).read_text())
    body = {k: v for k, v in lock.items() if k != "lock"}
    out = [] if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest() == lock.get("lock") else ["the lock itself was changed"]
    now = {r["name"]: r.sha256 for r in file_digests(spark, folder).collect()}
    was = lock["files"]
    return out + [f"{n} is missing" for n in sorted(was.keys() - now.keys())] + [f"{n} is new" for n in sorted(now.keys() - was.keys())] + [f"{n} was changed" for n in sorted(was.keys() & now.keys()) if was[n] != now[n]]


def save_parameters(parameters: dict, path: str) -> str:
    """Write fitted parameters as JSON with their checksum, which is returned."""
    body = json.dumps(parameters, sort_keys=True)
    check = hashlib.sha256(body.encode()).hexdigest()
    Path(path).write_text(json.dumps({"parameters": parameters, "checksum": check}, sort_keys=True))
    return check


def load_parameters(path: str) -> dict:
    """Read parameters back; an error where they do not agree with their checksum."""
    x = json.loads(Path(path).read_text())
    if hashlib.sha256(json.dumps(x["parameters"], sort_keys=True).encode()).hexdigest() != x["checksum"]:
        raise ValueError("the checksum does not agree")
    return x["parameters"]
