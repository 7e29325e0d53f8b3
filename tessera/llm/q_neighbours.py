"""Problem 3: queries and SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.neighbours import similar_pairs, similar_vectors
from tessera.sources import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(similar_vectors(read_table(spark, sf_dir, "embedding_cache"), k=10, min_cosine=0.8))


#: Searches ask for every vector whose id is divisible by 50.
ASKED = "vec_id % 50 = 0"


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten partners of every asked vector: along the curves among those of its face (cosine of 0.4
    and more); those with fewer than ten such partners against all rows in blocks."""
    s = similar_vectors(read_table(spark, sf_dir, "embedding_cache"), k=10, min_cosine=0.4, queries=ASKED, rest=True, margin=2)
    return s.select("vec_id", "other", F.round("cosine", 4).alias("cosine"), "rank")


QUERIES = {"p3_found": p3_found, "p3_knn": p3_knn}

USABLE_SQL = """
WITH usable AS (
  SELECT vec_id, any_value(e) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embedding_cache)
  WHERE vec_id IS NOT NULL AND len(e) = 512 AND len(list_filter(e, lambda x: isfinite(x))) = 512
    AND sqrt(list_sum(list_transform(e, lambda x: x * x))) >= 1e-6
  GROUP BY vec_id)
"""

SQL = {
    "p3_found": USABLE_SQL
    + """, c AS (SELECT a.vec_id AS v, b.vec_id AS o, list_cosine_similarity(a.e, b.e) AS cos FROM usable a JOIN usable b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY cos DESC, o) AS rn FROM c)
SELECT DISTINCT least(v, o) AS vec_a, greatest(v, o) AS vec_b FROM r WHERE rn <= 10 AND cos >= 0.8""",
    "p3_knn": USABLE_SQL
    + """, c AS (SELECT a.vec_id AS v, b.vec_id AS o, list_cosine_similarity(a.e, b.e) AS cos FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY v ORDER BY cos DESC, o) AS INT) AS rank FROM c)
SELECT v AS vec_id, o AS other, round(cos, 4) AS cosine, rank FROM r WHERE rank <= 10""",
}
