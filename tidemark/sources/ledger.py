"""Records kept in hash chains: canonical JSON, appending with idempotence, reading and verifying."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "chain string, number long, kind string, payload string, payload_hash string, parent_hash string, record_hash string"


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no blanks; decimals as fixed-point text, -0 as 0; no NaN, no infinity, text keys only."""

    def plain(x: Any) -> Any:
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a finite number")
            return x + 0.0
        if isinstance(x, Decimal):
            if not x.is_finite():
                raise ValueError("not a finite number")
            return format(abs(x) if x == 0 else x, "f")
        if isinstance(x, dict):
            if any(not isinstance(k, str) for k in x):
                raise ValueError("keys must be text")
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else sorted(x) if isinstance(x, (set, frozenset)) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def content_id(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def record_hash(parent: F.Column, payload_hash: F.Column, kind: F.Column) -> F.Column:
    """Hash of a record: its kind, its payload's hash and the record before."""
    return F.sha2(F.concat_ws("|", F.coalesce(parent, F.lit("GENESIS")), payload_hash, kind), 256)


def append(spark: SparkSession, path: str, records: DataFrame, batch: str) -> None:
    """Append ``records`` (chain, number, kind, payload as JSON text) as ``batch``.

    Each batch is a folder of its own, written over when it is run again after a failure, so a record
    is there exactly once. ``number`` orders a chain; the parents' hashes are those of the payloads
    before, so that any row of the chain can be checked beside its neighbour, without walking it.
    """
    d = records.select("chain", F.col("number").cast("long").alias("number"), "kind", "payload", F.sha2("payload", 256).alias("payload_hash"))
    last = _heads(spark, path, batch)
    w = Window.partitionBy("chain").orderBy("number")
    d = d.withColumn("_before", F.lag("payload_hash").over(w))
    d = d.join(last, "chain", "left") if last is not None else d.withColumn("_head", F.lit(None).cast("string"))
    d = d.withColumn("parent_hash", F.coalesce("_before", "_head")).drop("_before", "_head")
    d.withColumn("record_hash", record_hash(F.col("parent_hash"), F.col("payload_hash"), F.col("kind"))).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _heads(spark: SparkSession, path: str, batch: str) -> DataFrame | None:
    try:
        d = read(spark, path).filter(F.col("batch") < batch)
    except Exception:  # nothing has been appended yet
        return None
    return d.groupBy("chain").agg(F.max_by("payload_hash", "number").alias("_head"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records with their batch."""
    return spark.read.schema(SCHEMA + ", batch string").option("basePath", path).parquet(path)


def verify(ledger: DataFrame) -> DataFrame:
    """Per chain: records, and how many have a payload, a parent or a record hash that does not fit."""
    w = Window.partitionBy("chain").orderBy("number")
    d = ledger.withColumn("_before", F.lag("payload_hash").over(w))
    bad_payload = F.col("payload_hash") != F.sha2("payload", 256)
    bad_parent = ~F.col("parent_hash").eqNullSafe(F.col("_before"))
    bad_record = F.col("record_hash") != record_hash(F.col("parent_hash"), F.col("payload_hash"), F.col("kind"))
    return d.groupBy("chain").agg(F.count("*").alias("records"), *[F.count(F.when(b, 1)).alias(n) for n, b in (("bad_payloads", bad_payload), ("bad_parents", bad_parent), ("bad_records", bad_record))])
