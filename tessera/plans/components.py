"""Connected components by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Every node of ``edges`` with the smallest node of its component: id, comp.

    Large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014) rewire
    edges towards smaller neighbours until the edge set is a forest of stars. Each step takes minima with partial
    aggregation and joins them back, so a hub is never gathered. Self loops name isolated nodes, edges with a NULL end
    are ignored, repeats change nothing, no edges give no rows. The rounds are written to the shared folder, the only
    thing the driver sees is one checksum per round.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    loops = e.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("comp"))
    cur = cut(e.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    spark, seen = edges.sparkSession, None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = cut(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    out = cur.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    out = out.union(out.select(F.col("comp").alias("id"), "comp")).union(loops)
    return out.groupBy("id").agg(F.min("comp").alias("comp"))
