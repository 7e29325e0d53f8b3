"""Mixing sources to target weights by hash thresholds found in nested histograms."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

#: Bits of the hash, and bits per histogram: 4 levels resolve every single document.
HASH_BITS, LEVEL_BITS = 60, 15


#: Sources up to which a table of sources is sent to every task; beyond it is joined by the planner's choice.
MAX_SOURCES = 100_000


def _sent(sources: DataFrame) -> DataFrame:
    """A table with a row per source, marked for broadcast if it is small."""
    return F.broadcast(sources) if sources.count() <= MAX_SOURCES else sources


def mixture_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Budget of every source: source, target_share, max_repeats, available, budget, passes, rest.

    Targets are scaled to the sources that have tokens, a positive share and at least one allowed use; the others have
    the budget 0. With no ``total_tokens`` the mixture is the largest in which every such source meets its scaled
    target exactly. With a total, sources that cannot fill their share give all they may and the others take over in
    proportion of their shares, as far as they can. Sources without a target, NULL sources and NULL targets stay out;
    repeated target rows count once (the larger share, then the larger limit).
    """
    t = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)).alias("s"), F.coalesce("max_repeats", F.lit(0)).alias("r"))).alias("m"))
    t = t.select("source", F.col("m.s").alias("target_share"), F.col("m.r").alias("max_repeats"))
    supply = sizes.filter("source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"))
    p = t.join(supply, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    p = p.withColumn("most", (F.col("available") * F.greatest("max_repeats", F.lit(0))).cast("double"))
    p = p.withColumn("level", F.when((F.col("target_share") > 0) & (F.col("most") > 0), F.col("most") / F.col("target_share")))
    whole = W.partitionBy()
    if total_tokens is None:
        # budget = share * level of the scarcest source
        p = p.withColumn("budget", F.when(F.col("level").isNotNull(), F.least("most", F.min("level").over(whole) * F.col("target_share"))).otherwise(0.0))
    else:
        # water level x: sum(min(most, x * share)) = total; sorted by level, the sources below x give all they may
        before = W.orderBy(F.col("level").asc_nulls_last(), "source").rowsBetween(W.unboundedPreceding, -1)
        live = F.when(F.col("level").isNotNull(), F.col("target_share")).otherwise(0.0)
        p = p.withColumns({"full": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "open": F.sum(live).over(whole) - F.coalesce(F.sum(live).over(before), F.lit(0.0))})
        p = p.withColumn("x", (F.lit(float(total_tokens)) - F.col("full")) / F.col("open"))
        first = F.min(F.when(F.col("x") <= F.col("level"), F.struct("level", "source", "x"))).over(whole)
        p = p.withColumn("budget", F.when(F.col("level").isNull(), 0.0).otherwise(F.least(F.col("most"), F.coalesce(first["x"] * F.col("target_share"), F.col("most")))))
    passes = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available") + 1e-12)).otherwise(0).cast("int")
    p = p.withColumn("passes", passes).withColumn("rest", F.greatest(F.col("budget") - F.col("passes") * F.col("available"), F.lit(0.0)))
    return p.select("source", "target_share", "max_repeats", "available", "budget", "passes", "rest")


def thresholds(hashed: DataFrame, plan: DataFrame) -> DataFrame:
    """source and ``below``: the hash up to which (exclusive) a source's documents fill its ``rest``.

    Level by level the tokens are summed by source and the next bits of the hash; the first bucket that does not fit
    is the only one looked into at the next level. The document at the boundary is taken if that comes nearer.
    """
    state = plan.select("source", "rest", F.lit(0).cast("bigint").alias("prefix"))  # ``plan`` is written already
    closed = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - (level + 1) * LEVEL_BITS
        inside = hashed.join(_sent(state), "source").filter(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket"))
        over = hist.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        edge = over.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n", "rest")).alias("e"))
        state = cut(edge.select("source", (F.col("e.rest") - F.col("e.upto") + F.col("e.n")).alias("rest"), F.col("e.bucket").alias("prefix"), F.col("e.n").alias("n")))
        closed = state
        state = state.drop("n")
    near = F.when(F.col("rest") * 2 >= F.col("n"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return closed.select("source", near.alias("below"))


def mix(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, shares): n_copies of every document of a mixture, and what every source contributes.

    ``sizes`` has doc_id, source, n_tokens. Documents: doc_id, source, n_copies (at least 1, at most the source's
    limit). Shares: source, target_share, max_repeats, available_tokens, mixed_tokens, actual_share, n_documents.
    Documents without tokens or without a doc_id stay out. Selection is by hash of the id, so a document keeps its
    place when the corpus grows. ``targets`` is a table of sources, which is small by its nature.
    """
    hashed = sizes.select("doc_id", "source", "n_tokens").filter("n_tokens > 0 AND source IS NOT NULL AND doc_id IS NOT NULL")
    hashed = hashed.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 64 - HASH_BITS))
    plan = cut(mixture_plan(hashed, targets, total_tokens))
    below = thresholds(hashed, plan)
    per = cut(plan.join(below, "source", "left").select("source", "passes", F.coalesce("below", F.lit(0)).alias("below")))
    docs = hashed.join(_sent(per), "source").withColumn("n_copies", F.col("passes") + (F.col("h") < F.col("below")).cast("int"))
    docs = docs.filter("n_copies > 0")
    mixed = docs.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_copies")).alias("mixed_tokens"), F.count("*").alias("n_documents"))
    shares = plan.join(mixed, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(W.partitionBy())
    share = F.round(F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0), 6)
    shares = shares.select("source", "target_share", "max_repeats", F.col("available").alias("available_tokens"), "mixed_tokens", share.alias("actual_share"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
    return docs.select("doc_id", "source", "n_copies"), shares
