"""Problem 4: duplicates hidden by formatting differences.

The key of a record is canonicalised inside code generation (characters, case, white space,
punctuation, order of fields), hashed to 128 bits and counted with map-side combining. A second,
independent 64-bit hash is the collision check: groups are keyed by both, so two canonical forms
that share a 128-bit hash still make two groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.io import materialize

#: White space, controls, format characters, variation selectors and blank-looking letters.
INVISIBLE = (
    r"[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{2800}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}\x{E0100}-\x{E01EF}]+"
)


def _runs(text: Column) -> Column:
    """The runs of letters and digits, in order, joined by single hyphens."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "-"), "^-|-$", "")


def canonical_url(url: Column) -> Column:
    """The canonical form of an address; null stays null.

    Scheme, host, path and query fields are kept apart; in each only runs of letters and digits
    count, so quotes or brackets around an address don't. The query starts at the first ``?``; its
    fields have no order and empty ones vanish. Percent escapes are left alone. Parts and fields
    are first set off by control characters, which the cleaned text cannot hold, so that one pass
    finds the runs of all of them.
    """
    clean = F.lower(F.regexp_replace(url, INVISIBLE, ""))
    head = F.substring_index(clean, "?", 1)
    query = F.translate(F.substr(clean, F.length(head) + 2), "&", "\x02")
    parts = F.regexp_replace(head, r"^(?:([^:/?#]*)://)?([^/#]*)", "$1\x01$2\x01")
    runs = F.regexp_replace(F.concat(parts, F.lit("\x01"), query), r"[^\p{L}\p{N}\x01\x02]+", "-")
    tidy = F.regexp_replace(runs, "^-|-(?=[\x01\x02])|(?<=[\x01\x02])-|-$", "")
    fields = F.filter(F.split(F.substring_index(tidy, "\x01", -1), "\x02"), lambda x: x != "")
    return F.concat(F.substring_index(tidy, "\x01", 3), F.lit("\x01"), F.array_join(F.array_sort(fields), "\x02"))


def canonical_record(*fields: Column) -> Column:
    """Canonical form of a record of any text fields: case, white space, punctuation and the order
    of the fields don't count. Null fields are left out; all null gives null."""
    runs = [F.when(f.isNotNull(), _runs(F.lower(F.regexp_replace(f.cast("string"), r"[\p{Cf}]", "")))) for f in fields]
    parts = F.array_sort(F.filter(F.array(*runs), lambda x: x.isNotNull()))
    return F.when(F.size(parts) > 0, F.array_join(parts, "\x02"))


def _keyed(df: DataFrame, scope: list[str], canon: Column, id_col: str) -> DataFrame:
    """(scope..., id, hash, check) of every row, canonicalised once and written: both the counting
    and the join back read these narrow rows. Hashes are null where the canonical form is."""
    scoped = [F.col(c).alias(f"ws_scope_{i}") for i, c in enumerate(scope)]
    rows = df.select(*scoped, F.col(id_col).alias("ws_id"), canon.alias("ws_canon"))
    hashes = [F.when(F.col("ws_canon").isNotNull(), h).alias(n) for h, n in ((F.unhex(F.md5("ws_canon")), "ws_hash"), (F.xxhash64("ws_canon"), "ws_check"))]
    return materialize(rows.select(*[f"ws_scope_{i}" for i in range(len(scope))], "ws_id", *hashes), "p4-keys")


def collapse(df: DataFrame, scope: list[str], canon: Column, id_col: str = "id") -> DataFrame:
    """One row per group of copies: scope columns, ``key`` (hex), ``first_id``, ``n_copies``.

    ``scope`` are columns inside which copies are sought (null matches null there). Rows whose
    canonical form is null name nothing and are no copies of anything: each stays a group of one,
    with a null key. ``n_copies`` counts all rows of the group, exact repeats too. An empty table
    gives an empty result; further columns of ``df`` are ignored whatever their names. Two forms
    that share the 128-bit hash differ in the check hash, which is part of the group's key.
    """
    rows = _keyed(df, scope, canon, id_col)
    s = [f"ws_scope_{i}" for i in range(len(scope))]
    key = F.lower(F.concat(F.hex("ws_hash"), F.lit("-"), F.hex("ws_check")))
    groups = (
        rows.where("ws_hash is not null").groupBy(*s, "ws_hash", "ws_check")
        .agg(F.count(F.lit(1)).alias("n_copies"), F.min("ws_id").alias("first_id"))
        .select(*s, key.alias("key"), "first_id", "n_copies")
    )
    single = rows.where("ws_hash is null").select(*s, F.lit(None).cast("string").alias("key"), F.col("ws_id").alias("first_id"), F.lit(1).cast("bigint").alias("n_copies"))
    return groups.unionByName(single).select(*[F.col(f"ws_scope_{i}").alias(c) for i, c in enumerate(scope)], "key", "first_id", "n_copies")


def copies(df: DataFrame, scope: list[str], canon: Column, id_col: str = "id") -> DataFrame:
    """One row for each copy: scope columns, ``first_id``, ``id`` (of a row that repeats another).

    Groups are found by aggregation, so a group holding a third of all rows costs each map task one
    row; the copies then meet their group by an equi-join whose hot keys adaptive execution splits.
    Rows that share the smallest id itself are not reported against themselves. Null and unnamed
    rows are no copies; an empty table gives no rows.
    """
    rows = _keyed(df, scope, canon, id_col).where("ws_hash is not null")
    s = [f"ws_scope_{i}" for i in range(len(scope))]
    # the check hash is part of the key, so a collision of the 128 bits cannot join two forms
    groups = rows.groupBy(*s, "ws_hash", "ws_check").agg(F.count(F.lit(1)).alias("n"), F.min("ws_id").alias("first_id")).where("n > 1")
    g = groups.select(*[F.col(c).alias(f"{c}_g") for c in [*s, "ws_hash", "ws_check"]], "first_id")
    cond = (F.col("ws_hash") == F.col("ws_hash_g")) & (F.col("ws_check") == F.col("ws_check_g"))
    for c in s:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_g"))
    return (
        rows.join(g, cond)
        .where(F.col("ws_id") != F.col("first_id"))
        .select(*[F.col(f"ws_scope_{i}").alias(c) for i, c in enumerate(scope)], "first_id", F.col("ws_id").alias("id"))
    )
