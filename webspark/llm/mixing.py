"""Problem 8: mixing sources to target weights.

Every source gets its share of a token budget. A source whose documents must be used r times on
average gives floor(r) certain whole copies of each; the rest is a Pareto order sample with unequal
odds: a document's inclusion probability grows with its size, those that reach one are certain, and
the others are ranked by random odds divided by inclusion odds. The sample's size is fixed in
tokens: the smallest ranks are taken until the source's remaining tokens are met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webspark.io import materialize

#: Rank buckets per source; the cut falls into one of them, the only one that is ordered.
BUCKETS = 4096
#: Rounds in which documents may become certain; each takes the largest ones, so a few suffice.
ROUNDS = 12


def _uniform(*key: Column, seed: int) -> Column:
    """A fixed pseudo-random number in (0, 1) for a key: the first 12 digits of its MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in key])), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def plan_shares(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, wanted, weight): what each source gives.

    ``weight`` is the source's share among the sources that have tokens, ``wanted`` its tokens.
    ``total`` tokens are asked for; without it, the most that keeps every share within its cap.
    A cap below the wanted tokens is kept (the source then gives all it may). Sources of the list
    without documents want nothing; null shares or caps count as 0. Repeated rows of a source in
    the list are added up (the largest cap holds).
    """
    have = sizes.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    listed = (
        targets.where("source is not null")
        .groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
        .join(have, "source", "left").na.fill(0, ["n_docs", "tokens"])
        .withColumn("usable", (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    )
    sums = listed.where("usable").agg(F.sum("target_share"), F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share")).alias("t")).first()
    share = sums[0] or 1.0
    budget = float(total) if total is not None else (sums[1] or 0.0) * share
    weight = F.when(F.col("usable"), F.col("target_share") / F.lit(share)).otherwise(0.0)
    return listed.withColumn("weight", weight).withColumn("wanted", F.least(F.lit(budget) * F.col("weight"), (F.col("max_repeats") * F.col("tokens")).cast("double"))).drop("usable")


def inclusion_scale(docs: DataFrame) -> DataFrame:
    """(source, scale): a document of s tokens is included with probability min(1, scale * s), so that
    the expected tokens of a source are its ``rest``. docs: source, n_tokens, rest.

    Documents whose probability reaches one are certain; their tokens come off the rest and the scale
    of the others is taken anew, until no more become certain. A round is one aggregation to a row a
    source; the rounds end after ROUNDS at the latest, with the sums of the last.
    """
    s = F.col("n_tokens").cast("double")
    first = docs.groupBy("source").agg(F.first("rest").alias("rest"), F.sum(s * s).alias("square"))
    scale = materialize(first.select("source", F.when(F.col("square") > 0, F.col("rest") / F.col("square")).otherwise(0.0).alias("scale"), F.lit(0).cast("bigint").alias("n_sure")), "p8-scale")
    for _ in range(ROUNDS):
        certain = F.col("scale") * s >= 1
        sums = docs.join(scale, "source").groupBy("source").agg(
            F.first("rest").alias("rest"), F.sum(F.when(certain, s).otherwise(0.0)).alias("sure"), F.sum(F.when(certain, 0.0).otherwise(s * s)).alias("square"),
            F.count_if(certain).alias("now"), F.first("scale").alias("old"), F.first("n_sure").alias("before"),
        )
        fresh = F.when(F.col("square") > 0, F.greatest(F.col("rest") - F.col("sure"), F.lit(0.0)) / F.col("square")).otherwise(1e300)
        # what is certain stays so: the scale never falls
        scale = materialize(sums.select("source", F.greatest(fresh, "old").alias("scale"), F.col("now").alias("n_sure"), (F.col("now") > F.col("before")).alias("moved")), "p8-scale")
        if not scale.where("moved").limit(1).count():
            break
        scale = scale.drop("moved")
    return scale.select("source", "scale")


def sample_uses(sizes: DataFrame, plan: DataFrame, seed: int = 8) -> DataFrame:
    """(doc_id, source, n_tokens, probability, uses): the chosen documents.

    Expected uses r of each document of a source are wanted/tokens; floor(r) copies are certain. For
    the remaining tokens a document of s tokens has inclusion probability p = min(1, scale * s); its
    rank is (u/(1-u)) / (p/(1-p)), and documents are taken in rank order until the remaining tokens
    are met as nearly as a document allows. Ranks are bucketed (rank/(1+rank) in 4096 steps), buckets
    added up, and only the bucket where the sum crosses the target is put in order, so no source,
    however large, is sorted by one task. Equal ranks (repeated rows) fall in doc_id order.
    """
    docs = (
        sizes.where("n_tokens > 0").select("doc_id", "source", "n_tokens")
        .join(plan.where("wanted > 0").select("source", "wanted", "tokens"), "source")
        .withColumn("certain", F.floor(F.col("wanted") / F.col("tokens") + 1e-12).cast("int"))
        .withColumn("rest", F.greatest(F.col("wanted") - F.col("certain") * F.col("tokens"), F.lit(0.0)))
    )
    docs = (
        docs.join(inclusion_scale(docs.select("source", "n_tokens", "rest")), "source")
        .withColumn("probability", F.least(F.col("scale") * F.col("n_tokens"), F.lit(1.0)))
        .withColumn("u", _uniform(F.col("doc_id"), seed=seed))
        .withColumn("odds", F.col("probability") / F.greatest(1 - F.col("probability"), F.lit(1e-300)))
        .withColumn("rank", F.when(F.col("probability") >= 1, 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / F.greatest("odds", F.lit(1e-300))))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    )
    buckets = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(upto), F.lit(0)))
    placed = docs.join(starts, ["source", "bucket"])
    whole = placed.where("before + bucket_tokens <= rest").withColumn("extra", F.lit(1))
    none = placed.where("before >= rest").withColumn("extra", F.lit(0))
    inside = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    cut = (
        placed.where("before < rest and before + bucket_tokens > rest")
        .withColumn("sum", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .withColumn("extra", (F.col("sum") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
        .drop("sum")
    )
    return (
        whole.unionByName(none).unionByName(cut)
        .select("doc_id", "source", "n_tokens", "probability", (F.col("certain") + F.col("extra")).alias("uses"))
        .where("uses > 0")
    )


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 8) -> tuple[DataFrame, DataFrame]:
    """The chosen documents, and a report with the wanted and actual share of each source.

    sizes: doc_id, source, n_tokens; targets: source, target_share, max_repeats. Documents without
    source, without tokens or of a source without target are left out. Empty tables give no rows.
    """
    sizes = materialize(sizes.where("source is not null").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")), "p8-sizes")
    plan = materialize(plan_shares(sizes, targets, total), "p8-plan")
    chosen = materialize(sample_uses(sizes, plan, seed), "p8-chosen")
    used = chosen.groupBy("source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("used_tokens"), F.count(F.lit(1)).alias("used_docs"), F.max("uses").alias("most_uses"))
    everything = W.partitionBy(F.lit(0))  # one row a source of the list
    report = (
        plan.join(used, "source", "left").na.fill(0, ["used_tokens", "used_docs", "most_uses"])
        .withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(everything), F.lit(0.0)))
        .select("source", "target_share", "max_repeats", "n_docs", "tokens", "wanted", "used_docs", "used_tokens", "most_uses", "actual_share")
    )
    return chosen, report
