"""Robots files: parsing into the group that applies, and the paths it allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webspark.functions import urls

#: The error of a page that a robots file forbids.
DISALLOWED = "robots.txt disallowed"


def directives(files: DataFrame) -> DataFrame:
    """(origin, pos, name, value) of every directive; comments, blank lines and lines without a colon
    are none. files: origin, body; a null body has no directives."""
    line = F.trim(F.regexp_replace("line", r"#.*$", ""))
    return (
        files.where("body is not null")
        .select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
        .select("origin", "pos", line.alias("line"))
        .where(F.contains("line", F.lit(":")))
        .select("origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("name"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    )


def groups(files: DataFrame) -> DataFrame:
    """(origin, grp, agents, allow, disallow, crawl_delay): the groups of each file in order.

    Agent lines in a row share a group, one after a rule opens a new one; rules before the first
    agent belong to none; empty values set nothing; of several valid delays the last holds.
    """
    in_file = W.partitionBy("origin").orderBy("pos")
    opens = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(in_file), F.lit("")) != "user-agent")
    numbered = directives(files).withColumn("grp", F.sum(opens.cast("int")).over(in_file)).where("grp > 0")
    number = F.regexp_extract("value", r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")

    def listed(name: str, value: Column) -> Column:
        pairs = F.collect_list(F.when((F.col("name") == name) & (F.col("value") != ""), F.struct("pos", value.alias("v"))))
        return F.transform(F.sort_array(pairs), lambda x: x["v"])

    delay = F.max_by(number, F.when((F.col("name") == "crawl-delay") & (number >= 0), F.col("pos")))
    return numbered.groupBy("origin", "grp").agg(
        listed("user-agent", F.lower("value")).alias("agents"), listed("allow", F.col("value")).alias("allow"), listed("disallow", F.col("value")).alias("disallow"), delay.alias("crawl_delay")
    )


def rules_for(files: DataFrame, user_agent: str = "") -> DataFrame:
    """(origin, allow, disallow, crawl_delay): the rules an agent must follow, by file.

    The first group that names the agent (whole, or its product up to a blank or slash), else the
    first for all agents; a file with neither allows everything. Files without a body give no row,
    which means the same.
    """
    wanted = user_agent.strip().lower()
    names = {wanted, *([p] if (p := wanted.replace("/", " ").split(" ")[0]) else [])} - {"", "*"}
    exact = F.exists("agents", lambda a: a.isin(*names)) if names else F.lit(False)
    parsed = groups(files).withColumn("fit", F.when(exact, 0).when(F.array_contains("agents", "*"), 1)).where("fit is not null")
    chosen = parsed.groupBy("origin").agg(F.min_by(F.struct("allow", "disallow", "crawl_delay"), F.struct("fit", "grp")).alias("r"))
    none = F.array().cast("array<string>")
    return (
        files.where("body is not null").select("origin").distinct().join(chosen, "origin", "left")
        .select("origin", F.coalesce("r.allow", none).alias("allow"), F.coalesce("r.disallow", none).alias("disallow"), F.col("r.crawl_delay").alias("crawl_delay"))
    )


def rule_pattern(rule: Column) -> Column:
    """The regular expression of a rule: a prefix, in which a star stands for anything and a dollar
    sign at the end for the end."""
    body = F.regexp_replace(rule, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([.+^${}()|\[\]\\?])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), escaped, F.when(F.endswith(rule, F.lit("$")), "$").otherwise(""))


def is_allowed(path: Column, allow: Column, disallow: Column) -> Column:
    """Whether rules allow a path with its query: the longest rule that matches decides, of equally
    long ones the one that allows; without any it is allowed."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))

    def hits(rules: Column, allows: bool) -> Column:
        return F.transform(F.filter(rules, lambda r: F.regexp_like(full, rule_pattern(r))), lambda r: F.struct(F.length(r).alias("n"), F.lit(allows).alias("ok")))

    best = F.array_max(F.concat(hits(F.coalesce(allow, F.array().cast("array<string>")), True), hits(F.coalesce(disallow, F.array().cast("array<string>")), False)))
    return F.coalesce(best["ok"], F.lit(True))


def with_permission(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``allowed`` and ``crawl_delay`` by the rules of the address's origin; an origin
    without rules allows everything."""
    keyed = rows.withColumn("ws_origin", urls.origin(F.col(url)))
    joined = keyed.join(rules.select(F.col("origin").alias("ws_o"), "allow", "disallow", "crawl_delay"), F.col("ws_origin") == F.col("ws_o"), "left")
    return joined.withColumn("allowed", is_allowed(urls.request_path(F.col(url)), F.col("allow"), F.col("disallow"))).drop("ws_origin", "ws_o", "allow", "disallow")
