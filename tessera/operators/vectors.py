"""Arithmetic on vectors inside the engine, and relations between them."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import tasks

#: Persons of one block of the recognition.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column, least: float = 1e-8) -> Column:
    """The vector by its norm, which counts as ``least`` at least."""
    n = F.greatest(norm(a), F.lit(least))
    return F.transform(a, lambda x: x.cast("double") / n)


def within_person_pairs(vectors: DataFrame) -> DataFrame:
    """person_id, a, b (ranks and ids a before b by rank) and their cosine distance: all pairs of one person.

    Quadratic in the vectors of a person, so ``vectors`` has to be a candidate pool (``selection.pooled``).
    """
    v = vectors.select("person_id", "asset_id", "rank", normalised(F.col("embedding")).alias("v"))
    a, b = v.alias("a"), v.alias("b")
    j = a.join(b, (F.col("a.person_id") == F.col("b.person_id")) & (F.col("a.rank") < F.col("b.rank")))
    return j.select(F.col("a.person_id").alias("person_id"), F.col("a.asset_id").alias("asset_a"), F.col("b.asset_id").alias("asset_b"), F.col("a.rank").alias("rank_a"), F.col("b.rank").alias("rank_b"), (1 - dot(F.col("a.v"), F.col("b.v"))).alias("distance"))


def cluster_count(n: Column, target: int) -> Column:
    """Clusters to seed for n candidates: a quarter of the target, five at least, a third of n at most."""
    return F.least(F.greatest(F.lit(5), F.lit(target // 4)), F.greatest(F.lit(1), F.floor(n / 3)), n, F.lit(target))


def hard_weight(confidence: Column, hard: float = 0.85) -> Column:
    """Weight of a candidate: above 1 the less confident it is below ``hard``; NULL counts as confident."""
    return F.when(confidence < hard, F.lit(1.0) + (F.lit(hard) - confidence) * 2).otherwise(1.0)


def recognise(probes: DataFrame, gallery: DataFrame, steepness: float = 10.0, middle: float = 0.5) -> DataFrame:
    """asset_id, match, score of each probe: the gallery person with the nearest mean vector, score by a sigmoid."""
    e = gallery.select("person_id", F.posexplode(normalised(F.col("embedding"))).alias("i", "x"))
    means = e.groupBy("person_id", "i").agg(F.avg("x").alias("x")).groupBy("person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    means = means.select(F.col("person_id").alias("match"), normalised(F.col("centre")).alias("centre"))
    asked = probes.select("asset_id", normalised(F.col("embedding")).alias("v"))
    # blocks of persons meet slices of probes; every meeting is one matrix product
    blocks, slices = max(1, -(-means.count() // BLOCK)), tasks(probes.sparkSession)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kind, who = dict(asked.dtypes)["asset_id"], dict(means.dtypes)["match"]
    p = asked.select(part("asset_id", slices).alias("slice"), every(blocks).alias("block"), "asset_id", F.lit(None).cast(who).alias("match"), "v")
    m = means.select(every(slices).alias("slice"), part("match", blocks).alias("block"), F.lit(None).cast(kind).alias("asset_id"), "match", F.col("centre").alias("v"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["match"].isna()], pdf[pdf["match"].notna()].sort_values("match")
        if not len(one) or not len(two):
            return pd.DataFrame({"asset_id": [], "match": [], "cosine": []})
        c = np.stack(two["v"].to_numpy())
        out = []
        for at in range(0, len(one), 1024):
            some = one.iloc[at : at + 1024]
            cos = np.stack(some["v"].to_numpy()) @ c.T
            best = cos.argmax(1)
            out.append(pd.DataFrame({"asset_id": some["asset_id"], "match": two["match"].to_numpy()[best], "cosine": cos[np.arange(len(some)), best]}))
        return pd.concat(out)

    j = p.union(m).groupBy("slice", "block").applyInPandas(nearest, f"asset_id {kind}, match {who}, cosine double")
    best = j.groupBy("asset_id").agg(F.max(F.struct("cosine", (-F.col("match")).alias("m"))).alias("b"))
    score = 1 / (1 + F.exp(-(F.col("b.cosine") - middle) * steepness))
    return best.select("asset_id", (-F.col("b.m")).alias("match"), F.round(score, 4).alias("score"))
