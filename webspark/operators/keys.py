"""API keys: hashes, listing, activity, transitions and the check of tokens."""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions import dates

#: The marker of a key; tokens without it are never looked up.
PREFIX = "wfc-"


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def new_key() -> tuple[str, str, str]:
    """(token, id, prefix) of a new key. Random, so made on the driver and never in a column."""
    token = PREFIX + secrets.token_urlsafe(32)
    return token, f"key_{secrets.token_hex(8)}", token[:12]


def is_active(now: int) -> Column:
    return F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def listed(keys: DataFrame) -> DataFrame:
    """Keys as readers see them: ISO times, no hash, newest first."""
    when = lambda c: dates.iso(F.col(c)).alias(c)
    return keys.orderBy(F.desc("created_at"), F.desc("id")).select("id", "prefix", "name", when("created_at"), when("last_used_at"), when("expires_at"), when("revoked_at"))


def authorize(tokens: DataFrame, keys: DataFrame, now: int, masters: list[str] | None = None) -> DataFrame:
    """(token, allowed, key_id): whether each bearer token opens the interface.

    Without a master secret everything does; a master secret does; else a key does whose hash equals
    the token's and that is neither revoked nor expired. Digests are joined, never tokens compared.
    """
    masters = [m for m in (masters or []) if m and m.strip()]
    hashed = tokens.withColumn("ws_h", F.when(F.startswith("token", F.lit(PREFIX)), token_hash(F.col("token"))))
    live = keys.where(is_active(now)).select(F.col("key_hash").alias("ws_k"), F.col("id").alias("key_id"))
    joined = hashed.join(live, F.col("ws_h") == F.col("ws_k"), "left")
    master = token_hash(F.col("token")).isin(*[hashlib.sha256(m.strip().encode()).hexdigest() for m in masters]) if masters else F.lit(True)
    return joined.select("token", (F.coalesce(master, F.lit(False)) | F.col("key_id").isNotNull()).alias("allowed"), "key_id")


def revoke(keys: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """``keys`` with the given ids revoked; keys revoked before keep their time, unknown ids do nothing."""
    hit = ids.select(F.col("id").alias("ws_id")).distinct()
    return keys.join(hit, F.col("id") == F.col("ws_id"), "left").withColumn("revoked_at", F.when(F.col("ws_id").isNotNull(), F.coalesce("revoked_at", F.lit(now).cast("bigint"))).otherwise(F.col("revoked_at"))).drop("ws_id")


def touched(keys: DataFrame, uses: DataFrame) -> DataFrame:
    """``keys`` with last_used_at moved on to their latest use. uses: id, used_at."""
    last = uses.groupBy(F.col("id").alias("ws_id")).agg(F.max("used_at").alias("ws_at"))
    return keys.join(last, F.col("id") == F.col("ws_id"), "left").withColumn("last_used_at", F.greatest("last_used_at", "ws_at")).drop("ws_id", "ws_at")
