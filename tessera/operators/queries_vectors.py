"""Queries over vectors, selection and admission, with SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import policy as P
from tessera.operators import selection as S
from tessera.operators import vectors as V
from tessera.operators.registry import Registry
from tessera.params import CurationParams
from tessera.sources import read_table, views

R = Registry()
DUP, TARGET = 0.70, 8

AV = """av AS (SELECT v.vec_id AS asset_id, v.label AS person_id, e.value AS quality_score, CAST(e.props->>'$.k' AS INT) / 100.0::DOUBLE AS confidence,
  CAST(v.embedding AS DOUBLE[]) AS emb, CAST(row_number() OVER (PARTITION BY v.label ORDER BY e.value DESC, v.vec_id) AS INT) AS rank
  FROM embeddings v JOIN events e ON e.event_id = v.vec_id)"""
NV = "nv AS (SELECT *, list_transform(emb, lambda x: x / greatest(sqrt(list_inner_product(emb, emb)), 1e-8)) AS v FROM av)"
PAIRS = """pr AS (SELECT a.person_id, a.asset_id AS asset_a, b.asset_id AS asset_b, a.rank AS rank_a, b.rank AS rank_b, 1 - list_inner_product(a.v, b.v) AS distance
  FROM nv a JOIN nv b ON a.person_id = b.person_id AND a.rank < b.rank)"""
DIST = """ds AS (SELECT person_id, rank_a AS i, rank_b AS j, distance AS d FROM pr UNION ALL SELECT person_id, rank_b, rank_a, distance FROM pr
  UNION ALL SELECT person_id, rank, rank, 0.0::DOUBLE FROM nv)"""
SIZES = "sz AS (SELECT person_id, count(*) AS n FROM nv GROUP BY 1)"


@R.query("SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / greatest(sqrt(list_inner_product(e, e)), 1e-8), 6) AS first, round(e[64] / greatest(sqrt(list_inner_product(e, e)), 1e-8), 6) AS last FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    n = e.select("vec_id", V.norm(F.col("embedding")).alias("norm"), V.normalised(F.col("embedding")).alias("v"))
    return n.select("vec_id", F.round("norm", 6).alias("norm"), F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(63)), 6).alias("last"))


@R.query("SELECT DISTINCT vec_id FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embedding_cache) WHERE len(e) > 0 AND len(list_filter(e, lambda x: isfinite(x))) = len(e) AND sqrt(list_inner_product(e, e)) >= 1e-6")
def zero_norm_gate(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embedding_cache").filter(F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.filter(finite & (V.norm(F.col("embedding")) >= 1e-6)).select("vec_id").distinct()


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate pool of every person, which bounds whatever compares its members."""
    return S.pooled(views.asset_vec(spark, sf), CurationParams().pool_cap)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.within_person_pairs(_pool(spark, sf))


@R.query(f"WITH {AV}, {NV}, {PAIRS} SELECT asset_a, asset_b, round(distance, 6) AS distance FROM pr")
def cosine_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("asset_a", "asset_b", F.round("distance", 6).alias("distance"))


@R.query(f"WITH {AV}, {NV}, {PAIRS} SELECT person_id, asset_a, asset_b FROM pr WHERE distance < {DUP}")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).filter(F.col("distance") < DUP).select("person_id", "asset_a", "asset_b")


@R.query(f"WITH {AV}, {NV}, {PAIRS} SELECT person_id, count(*) AS n_pairs, round(min(distance), 6) AS least, round(avg(distance), 6) AS mean, round(max(distance), 6) AS largest FROM pr GROUP BY 1")
def distance_matrix(spark: SparkSession, sf: str) -> DataFrame:
    d = "distance"
    return _pairs(spark, sf).groupBy("person_id").agg(F.count("*").alias("n_pairs"), F.round(F.min(d), 6).alias("least"), F.round(F.avg(d), 6).alias("mean"), F.round(F.max(d), 6).alias("largest"))


@R.query(f"WITH {AV}, {NV}, {PAIRS} SELECT person_id, round(median(distance), 6) AS median_distance FROM pr GROUP BY 1")
def median_distance(spark: SparkSession, sf: str) -> DataFrame:
    return S.thresholds(_pool(spark, sf)).select("person_id", F.round("median_distance", 6).alias("median_distance"))


@R.query(f"WITH {AV}, {NV}, {PAIRS} SELECT person_id, round(greatest(0.05, 0.2 * median(distance)), 6) AS threshold FROM pr GROUP BY 1")
def adaptive_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return S.thresholds(_pool(spark, sf)).select("person_id", F.round("threshold", 6).alias("threshold"))


@R.query(f"WITH {AV}, {NV}, {SIZES} SELECT person_id, n, least(greatest(5, 40 // 4), greatest(1, n // 3), n, 40) AS k FROM sz")
def cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    n = views.asset_vec(spark, sf).groupBy("person_id").agg(F.count("*").alias("n"))
    return n.select("person_id", "n", V.cluster_count(F.col("n"), 40).alias("k"))


_DEDUP = f"""WITH RECURSIVE {AV}, {NV}, {PAIRS}, {SIZES}, near AS (SELECT person_id, rank_b AS i, list(rank_a) AS before FROM pr WHERE distance < {DUP} GROUP BY 1, 2),
k AS (SELECT person_id, 1 AS i, [1] AS kept FROM sz UNION ALL
  SELECT k.person_id, k.i + 1, CASE WHEN list_has_any(coalesce(near.before, []), k.kept) THEN k.kept ELSE list_append(k.kept, k.i + 1) END
  FROM k JOIN sz ON sz.person_id = k.person_id AND k.i < sz.n LEFT JOIN near ON near.person_id = k.person_id AND near.i = k.i + 1),
last AS (SELECT k.person_id, unnest(k.kept) AS rank FROM k JOIN sz ON sz.person_id = k.person_id AND k.i = sz.n)
SELECT nv.person_id, nv.asset_id, nv.rank FROM last JOIN nv USING (person_id, rank)"""


@R.query(_DEDUP)
def dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return S.dedup_grouped(_pool(spark, sf), DUP)


@R.query(_DEDUP)
def dedup_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return S.dedup_by_rounds(_pool(spark, sf), DUP)


_SEEDS = """seed AS (SELECT person_id, i AS first FROM (SELECT person_id, i, round(sum(d), 9) AS s FROM ds GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY s, i) = 1),
kk AS (SELECT person_id, least(greatest(5, {t} // 4), greatest(1, n // 3), n, {t}) AS k FROM sz),
s AS (SELECT person_id, 1 AS n, [first] AS taken FROM seed UNION ALL
  SELECT s.person_id, s.n + 1, list_append(s.taken, (SELECT g.i FROM (SELECT ds.i, min(ds.d) AS gap FROM ds WHERE ds.person_id = s.person_id AND list_contains(s.taken, ds.j) AND NOT list_contains(s.taken, ds.i) GROUP BY ds.i) g ORDER BY g.gap DESC, g.i LIMIT 1))
  FROM s JOIN kk USING (person_id) WHERE s.n < kk.k)"""


def _chosen(spark: SparkSession, sf: str, target: int | None, refine: bool) -> DataFrame:
    return S.select_representatives(_pool(spark, sf), target, refine)


@R.query(f"WITH RECURSIVE {AV}, {NV}, {PAIRS}, {DIST}, {SIZES}, {_SEEDS.format(t=TARGET)}, l AS (SELECT person_id, unnest(taken) AS rank, unnest(generate_series(1, len(taken))) AS pos FROM s JOIN kk USING (person_id) WHERE s.n = kk.k) SELECT nv.person_id, nv.asset_id, CAST(pos AS INT) AS pos FROM l JOIN nv USING (person_id, rank)")
def kmedoids_init(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, TARGET, False).filter("is_medoid").select("person_id", "asset_id", "pos")


_FPS = f"""f AS (SELECT s.person_id, s.n, s.taken FROM s JOIN kk USING (person_id) WHERE s.n = kk.k UNION ALL
  SELECT f.person_id, f.n + 1, list_append(f.taken, (SELECT g.i FROM (SELECT ds.i, min(ds.d) AS gap FROM ds WHERE ds.person_id = f.person_id AND list_contains(f.taken, ds.j) AND NOT list_contains(f.taken, ds.i) GROUP BY ds.i) g
    JOIN nv ON nv.person_id = f.person_id AND nv.rank = g.i ORDER BY g.gap * CASE WHEN nv.confidence < 0.85 THEN 1 + (0.85 - nv.confidence) * 2 ELSE 1 END DESC, g.i LIMIT 1))
  FROM f JOIN sz USING (person_id) WHERE f.n < least({TARGET}, sz.n))"""


@R.query(f"WITH RECURSIVE {AV}, {NV}, {PAIRS}, {DIST}, {SIZES}, {_SEEDS.format(t=TARGET)}, {_FPS}, l AS (SELECT person_id, unnest(taken) AS rank, unnest(generate_series(1, len(taken))) AS pos FROM f JOIN sz USING (person_id) WHERE f.n = least({TARGET}, sz.n)) SELECT nv.person_id, nv.asset_id, CAST(pos AS INT) AS pos FROM l JOIN nv USING (person_id, rank)")
def fps(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, TARGET, False).select("person_id", "asset_id", "pos")


@R.query(f"""WITH RECURSIVE {AV}, {NV}, {PAIRS}, {DIST}, {SIZES}, {_SEEDS.format(t=TARGET)}, m AS (SELECT person_id, unnest(taken) AS j FROM s JOIN kk USING (person_id) WHERE s.n = kk.k)
SELECT nv.asset_id, mv.asset_id AS medoid FROM (SELECT person_id, i, j FROM ds JOIN m USING (person_id, j) QUALIFY row_number() OVER (PARTITION BY person_id, i ORDER BY d, j) = 1) b
JOIN nv ON nv.person_id = b.person_id AND nv.rank = b.i JOIN nv mv ON mv.person_id = b.person_id AND mv.rank = b.j""")
def assign_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its nearest seed; ties go to the better rank."""
    v = _pool(spark, sf).select("person_id", "asset_id", "rank", V.normalised(F.col("embedding")).alias("v"))
    m = _chosen(spark, sf, TARGET, False).filter("is_medoid").select("asset_id").join(v, "asset_id").select("person_id", F.col("asset_id").alias("medoid"), F.col("rank").alias("mrank"), F.col("v").alias("mv"))
    j = v.join(m, "person_id").withColumn("d", F.when(F.col("asset_id") == F.col("medoid"), 0.0).otherwise(1 - V.dot(F.col("v"), F.col("mv"))))
    return j.groupBy("asset_id").agg(F.min_by("medoid", F.struct("d", "mrank")).alias("medoid"))


@R.query()
def kmedoids(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, TARGET, True).filter("is_medoid").select("person_id", "asset_id", "pos")


@R.query()
def cluster_select(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, TARGET, True)


@R.query()
def cluster_select_auto(spark: SparkSession, sf: str) -> DataFrame:
    return _chosen(spark, sf, None, True)


@R.query(f"""WITH {AV}, {NV}, c AS (SELECT person_id, i, avg(v[i]) AS x FROM nv, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
ce AS (SELECT person_id, list(x ORDER BY i) AS x FROM c GROUP BY 1), cn AS (SELECT person_id, list_transform(x, lambda y: y / greatest(sqrt(list_inner_product(x, x)), 1e-8)) AS c FROM ce),
b AS (SELECT asset_id, cn.person_id AS match, list_inner_product(v, c) AS cos FROM nv, cn QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY cos DESC, cn.person_id) = 1)
SELECT asset_id, match, round(1 / (1 + exp(-(cos - 0.5) * 10)), 4) AS score FROM b""")
def recognize(spark: SparkSession, sf: str) -> DataFrame:
    v = views.asset_vec(spark, sf)
    return V.recognise(v, v)


def _offered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Views are what a gallery holds, purchases are offered. Every fourth has no match score; by the number k some
    scores are for somebody else, some uploads fail and some files cannot be deleted."""
    e = read_table(spark, sf, "events").select("event_id", F.col("user_id").cast("int").alias("person"), "event_type", F.col("value").alias("blur"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    e = e.withColumns({"file_name": F.concat(F.col("event_id").cast("string"), F.lit(".jpg")), "score": F.when(F.col("event_id") % 4 != 0, F.col("k") / 100.0)})
    c = e.filter("event_type = 'purchase'").select("person", "file_name", "score", "blur", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("person").cast("string")).alias("match"), (F.col("k") % 5 != 0).alias("accepted"))
    return c, e.filter("event_type = 'view'").select("person", "file_name", "score", "blur", F.col("event_id").alias("seq"), (F.col("k") % 6 == 0).alias("locked"))


_ADMIT = """WITH RECURSIVE e AS (SELECT CAST(user_id AS INT) AS person, event_type, concat(event_id, '.jpg') AS file_name, CAST(props->>'$.k' AS INT) AS k, CASE WHEN event_id % 4 <> 0 THEN CAST(props->>'$.k' AS INT) / 100.0::DOUBLE END AS score, value AS blur, event_id AS seq FROM events),
c AS (SELECT person, file_name, CASE WHEN k % 7 <> 0 THEN score END AS score, blur, k % 5 <> 0 AS accepted, CAST(row_number() OVER (PARTITION BY person ORDER BY file_name) AS INT) AS i FROM e WHERE event_type = 'purchase'),
g AS (SELECT person, list(struct_pack(f := file_name, s := score, b := blur, q := seq, l := k % 6 = 0)) AS files FROM e WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT person, coalesce(files, []) AS files FROM (SELECT DISTINCT person FROM c) LEFT JOIN g USING (person)),
t AS (SELECT person, 0 AS i, files, CAST(len(files) AS BIGINT) AS cnt, len(files) > 0 AS started, len(list_filter(files, lambda x: x.s IS NOT NULL)) > 0 AS fs, NULL::DOUBLE AS floor_, []::VARCHAR[] AS refused,
   NULL::VARCHAR AS file_name, NULL::VARCHAR AS action, NULL::VARCHAR AS reason, NULL::VARCHAR AS target FROM p
 UNION ALL
 SELECT person, i, CASE WHEN gone THEN list_filter(files, lambda x: x.f <> target) ELSE files END,
   cnt - CAST(gone AS INT) + CAST(sent AND (accepted OR gone) AS INT), started,
   (CASE WHEN gone THEN len(list_filter(files, lambda x: x.s IS NOT NULL AND x.f <> target)) > 0 ELSE fs END) OR (sent AND accepted AND sc IS NOT NULL),
   CASE WHEN sent AND (accepted OR gone) THEN NULL ELSE floor_ END, CASE WHEN reason = 'delete failed' THEN list_append(refused, target) ELSE refused END, file_name,
   CASE WHEN NOT sent THEN 'skip' WHEN accepted THEN CASE WHEN gone THEN 'replace' ELSE 'add' END WHEN gone THEN 'lost' ELSE 'failed' END, reason, CASE WHEN gone OR reason = 'delete failed' THEN target END
 FROM (SELECT *, reason IN ('below capacity', 'less redundant', 'sharper') AS sent, reason IN ('less redundant', 'sharper') AS gone
 FROM (SELECT *, CASE
   WHEN blur < floor_ THEN 'below the freed slot'
   WHEN cnt < {cap} THEN CASE WHEN sc > bar THEN 'not novel' ELSE 'below capacity' END
   WHEN fs THEN CASE WHEN sc IS NULL THEN 'no score' WHEN top.f IS NULL THEN 'no target' WHEN NOT sc < top.s THEN 'not better' WHEN top.l THEN 'delete failed' ELSE 'less redundant' END
   ELSE CASE WHEN blur IS NULL THEN 'no score' WHEN low.f IS NULL THEN 'no target' WHEN NOT blur > low.b THEN 'not better' WHEN low.l THEN 'delete failed' ELSE 'sharper' END END AS reason,
   CASE WHEN fs THEN top.f ELSE low.f END AS target
 FROM (SELECT t.person, c.i, t.files, t.cnt, t.started, t.fs, t.floor_, t.refused, c.file_name, c.blur, c.accepted, CASE WHEN t.started AND (t.cnt < {cap} OR t.fs) THEN c.score END AS sc,
   list_max(list_transform(t.files, lambda x: x.s)) AS bar,
   list_sort(list_transform(list_filter(t.files, lambda x: x.s IS NOT NULL AND NOT list_contains(t.refused, x.f)), lambda x: struct_pack(n := -x.s, q := x.q, f := x.f, s := x.s, l := x.l)))[1] AS top,
   list_sort(list_transform(list_filter(t.files, lambda x: x.b IS NOT NULL AND NOT list_contains(t.refused, x.f)), lambda x: struct_pack(b := x.b, q := x.q, f := x.f, l := x.l)))[1] AS low
   FROM t JOIN c ON c.person = t.person AND c.i = t.i + 1))))
SELECT person, i AS seq, file_name, action, reason, target AS target_file FROM t WHERE i > 0"""


@R.query(_ADMIT.format(cap=16))
def admission_policy(spark: SparkSession, sf: str) -> DataFrame:
    candidates, gallery = _offered(spark, sf)
    return P.admit(candidates, gallery, capacity=16)
