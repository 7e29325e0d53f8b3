"""Queries over face boxes and pixel planes, with SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import geometry as G
from tessera.operators import quality as Q
from tessera.operators.assets import chosen_faces, has_box
from tessera.operators.registry import Registry
from tessera.sources import read_table, views

R = Registry()
WIDTH, HEIGHT = 1440, 1080

FACES = "fd AS (SELECT DISTINCT * FROM face_data)"
SCALED = f"""sc AS (SELECT face_id, asset_id, confidence,
  coalesce(x1, 0)::DOUBLE * fx AS x1, coalesce(y1, 0)::DOUBLE * fy AS y1, coalesce(x2, 0)::DOUBLE * fx AS x2, coalesce(y2, 0)::DOUBLE * fy AS y2
  FROM (SELECT *, CASE WHEN coalesce(image_width, 0) > 0 THEN {WIDTH}.0::DOUBLE / image_width ELSE 1.0::DOUBLE END AS fx,
                  CASE WHEN coalesce(image_height, 0) > 0 THEN {HEIGHT}.0::DOUBLE / image_height ELSE 1.0::DOUBLE END AS fy FROM fd))"""
CROP = f"""cr AS (SELECT *, greatest(0, floor(x1 - (x2 - x1) * 0.15::DOUBLE)::BIGINT) AS cx1, greatest(0, floor(y1 - (y2 - y1) * 0.15::DOUBLE)::BIGINT) AS cy1,
  least({WIDTH}, floor(x2 + (x2 - x1) * 0.15::DOUBLE)::BIGINT) AS cx2, least({HEIGHT}, floor(y2 + (y2 - y1) * 0.15::DOUBLE)::BIGINT) AS cy2 FROM sc)"""
_SIDE = "least(x2 - x1, y2 - y1)"
_OUTCOME = f"""CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'no face' WHEN {_SIDE} < 50 THEN 'face too small'
  WHEN least(cx2 - cx1, cy2 - cy1) < 30 THEN 'crop too small' ELSE 'crop' END"""


def _scaled(spark: SparkSession, sf: str) -> DataFrame:
    return G.scaled(views.faces(spark, sf), WIDTH, HEIGHT)


@R.query(f"WITH {FACES}, {SCALED} SELECT face_id, round(x1, 3) AS x1, round(y1, 3) AS y1, round(x2, 3) AS x2, round(y2, 3) AS y2 FROM sc")
def scale_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).select("face_id", *(F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")))


@R.query(f"WITH {FACES}, {SCALED}, {CROP} SELECT face_id, cx1, cy1, cx2, cy2 FROM cr")
def expand_crop_box(spark: SparkSession, sf: str) -> DataFrame:
    return G.crop_box(_scaled(spark, sf), 0.15, WIDTH, HEIGHT).select("face_id", "cx1", "cy1", "cx2", "cy2")


@R.query(f"WITH {FACES}, {SCALED} SELECT face_id FROM sc WHERE {_SIDE} >= 50")
def face_size_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled(spark, sf).filter(G.side() >= 50).select("face_id")


@R.query(f"WITH {FACES}, {SCALED}, {CROP} SELECT face_id FROM cr WHERE least(cx2 - cx1, cy2 - cy1) >= 30")
def crop_min_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = G.crop_box(_scaled(spark, sf), 0.15, WIDTH, HEIGHT)
    return c.filter(F.least(F.col("cx2") - F.col("cx1"), F.col("cy2") - F.col("cy1")) >= 30).select("face_id")


@R.query(f"WITH {FACES}, {SCALED}, {CROP} SELECT face_id, {_OUTCOME} AS outcome FROM cr")
def process_face(spark: SparkSession, sf: str) -> DataFrame:
    c = G.crop_box(_scaled(spark, sf), 0.15, WIDTH, HEIGHT)
    return c.select("face_id", G.crop_outcome(c, 50).alias("outcome"))


_IN_CROP = """sb AS (SELECT fd.asset_id, fd.person_id, sc.* EXCLUDE (asset_id, confidence) FROM sc JOIN fd USING (face_id)),
c AS (SELECT asset_id, person_id, face_id, greatest(0.0, x1 - (x2 - x1) * {m}::DOUBLE) AS l, least({w}.0, x2 + (x2 - x1) * {m}::DOUBLE) AS r, greatest(0.0, y1 - (y2 - y1) * {m}::DOUBLE) AS t, least({h}.0, y2 + (y2 - y1) * {m}::DOUBLE) AS b
  FROM sb JOIN (SELECT asset_id, person_id, min(face_id) AS face_id FROM fd WHERE asset_id IS NOT NULL AND person_id IS NOT NULL
    AND NOT (coalesce(x1, 0) = 0 AND coalesce(y1, 0) = 0 AND coalesce(x2, 0) = 0 AND coalesce(y2, 0) = 0) GROUP BY 1, 2) USING (asset_id, person_id, face_id)),
d AS (SELECT asset_id, face_id AS other, (x1 + x2) / 2 AS u, (y1 + y2) / 2 AS v FROM sb WHERE x2 > x1 AND y2 > y1),
hit AS (SELECT c.*, d.other, u - (l + r) / 2 AS dx, v - (t + b) / 2 AS dy FROM c JOIN d USING (asset_id) WHERE u BETWEEN l AND r AND v BETWEEN t AND b),
best AS (SELECT asset_id, person_id, face_id, other AS found FROM hit QUALIFY row_number() OVER (PARTITION BY asset_id, person_id, face_id ORDER BY round({d}, 6), other) = 1)
SELECT c.asset_id, c.person_id, c.face_id, best.found FROM c LEFT JOIN best USING (asset_id, person_id, face_id)"""


def _in_crop(spark: SparkSession, sf: str, margin: float, squared: bool) -> DataFrame:
    f = views.faces(spark, sf)
    chosen = chosen_faces(f.filter(has_box() & F.col("asset_id").isNotNull()))
    return G.in_crop(G.scaled(chosen, WIDTH, HEIGHT), G.scaled(f, WIDTH, HEIGHT), margin, WIDTH, HEIGHT, squared)


@R.query(f"WITH {FACES}, {SCALED}, " + _IN_CROP.format(m=0.25, w=WIDTH, h=HEIGHT, d="dx * dx + dy * dy"))
def embed_face(spark: SparkSession, sf: str) -> DataFrame:
    """The face to embed of each person in a photo: of the faces in the crop the one nearest to its centre."""
    return _in_crop(spark, sf, 0.25, True)


@R.query(f"WITH {FACES}, {SCALED}, " + _IN_CROP.format(m=0.5, w=WIDTH, h=HEIGHT, d="abs(dx) + abs(dy)"))
def redetect_face(spark: SparkSession, sf: str) -> DataFrame:
    """The face to align of each person in a photo, searched for in a wider crop."""
    return _in_crop(spark, sf, 0.5, False)


@R.query(f"WITH {FACES} SELECT face_id, round(CASE WHEN confidence < 0.85::DOUBLE THEN 1.0::DOUBLE + (0.85::DOUBLE - confidence) * 2 ELSE 1.0::DOUBLE END, 6) AS weight FROM fd WHERE confidence IS NULL OR NOT isnan(confidence)")
def hard_weight(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.vectors import hard_weight as weight

    return views.faces(spark, sf).filter("confidence IS NULL OR NOT isnan(confidence)").select("face_id", F.round(weight(F.col("confidence")), 6).alias("weight"))


@R.query(f"WITH {FACES} SELECT person_id, count(*) FILTER (WHERE confidence < 0.85 AND NOT isnan(confidence)) AS n_hard FROM fd WHERE person_id IS NOT NULL GROUP BY 1")
def hard_count(spark: SparkSession, sf: str) -> DataFrame:
    f = views.faces(spark, sf).filter("person_id IS NOT NULL")
    return f.groupBy("person_id").agg(F.count_if((F.col("confidence") < 0.85) & ~F.isnan("confidence")).alias("n_hard"))


# pixel planes: a vector of 64 entries is an 8 x 8 plane of grey levels; green and blue are shifted by fixed amounts
_PLANE = "list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor((x::DOUBLE + 0.5) * 255))) AS INT))"
PLANES = f"""pl AS (SELECT vec_id, r, list_transform(r, lambda x: (x + 3 * (vec_id % 4)) % 256) AS g, list_transform(r, lambda x: (x + 5 * (vec_id % 3)) % 256) AS b,
  (vec_id % 100) / 100.0::DOUBLE AS confidence, CAST(20 + vec_id % 90 AS INT) AS side FROM (SELECT vec_id, {_PLANE} AS r FROM embeddings))"""
_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_ROW, _COL = "(i // 8)", "(i % 8)"


def _cell(dr: int, dc: int) -> str:
    return f"grey[CAST(({_REFLECT.format(f'({_ROW} + {dr})')}) * 8 + ({_REFLECT.format(f'({_COL} + {dc})')}) + 1 AS INT)]"


GREY = """gr AS (SELECT *, list_transform(generate_series(1, 64), lambda i: (r[i] * 0.299::DOUBLE + g[i] * 0.587::DOUBLE) + b[i] * 0.114::DOUBLE) AS grey FROM pl)"""
LAP = f"""lp AS (SELECT *, list_transform(generate_series(0, 63), lambda i: {_cell(-1, 0)} + {_cell(1, 0)} + {_cell(0, -1)} + {_cell(0, 1)} - 4 * grey[i + 1]) AS lap FROM gr)"""
MEASURES = """ms AS (SELECT vec_id, confidence, side, list_sum(list_transform(lap, lambda x: x * x)) / 64 - power(list_sum(lap) / 64, 2) AS blur,
  greatest(abs(list_avg(r) - list_avg(g)), abs(list_avg(g) - list_avg(b)), abs(list_avg(r) - list_avg(b))) AS spread, list_avg(grey) AS brightness FROM lp)"""
ALL = f"WITH {PLANES}, {GREY}, {LAP}, {MEASURES}"
_WHY = """list_filter([CASE WHEN blur < 2500 THEN 'blurred' END, CASE WHEN spread < 5 THEN 'grey' END, CASE WHEN brightness < 120 THEN 'too dark' WHEN brightness > 134 THEN 'too bright' END,
  CASE WHEN confidence < 0.7 THEN 'low confidence' END, CASE WHEN side < 50 THEN 'small face' END], lambda x: x IS NOT NULL)"""


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, blur, spread, brightness, confidence, side of every plane."""
    e = read_table(spark, sf, "embeddings")
    level = F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 0.5) * 255))).cast("int"))
    p = e.select("vec_id", level.alias("r"))
    p = p.withColumns({"g": F.transform("r", lambda x: (x + 3 * (F.col("vec_id") % 4)) % 256), "b": F.transform("r", lambda x: (x + 5 * (F.col("vec_id") % 3)) % 256)})
    p = p.withColumn("grey", Q.grey(F.col("r"), F.col("g"), F.col("b")))
    return p.select(
        "vec_id",
        Q.laplacian_variance(F.col("grey"), 8, 8).alias("blur"),
        Q.colour_spread(F.col("r"), F.col("g"), F.col("b")).alias("spread"),
        Q.mean(F.col("grey")).alias("brightness"),
        ((F.col("vec_id") % 100) / 100.0).alias("confidence"),
        (20 + F.col("vec_id") % 90).cast("int").alias("side"),
    )


@R.query(f"{ALL} SELECT vec_id, round(blur, 3) AS blur FROM ms")
def laplacian_var(spark: SparkSession, sf: str) -> DataFrame:
    return measures(spark, sf).select("vec_id", F.round("blur", 3).alias("blur"))


@R.query(f"{ALL} SELECT vec_id FROM ms WHERE blur >= 2500")
def check_blur(spark: SparkSession, sf: str) -> DataFrame:
    return measures(spark, sf).filter("blur >= 2500").select("vec_id")


@R.query(f"{ALL} SELECT vec_id FROM ms WHERE spread >= 5")
def check_grayscale(spark: SparkSession, sf: str) -> DataFrame:
    return measures(spark, sf).filter("spread >= 5").select("vec_id")


@R.query(f"{ALL} SELECT vec_id FROM ms WHERE brightness BETWEEN 120 AND 134")
def check_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return measures(spark, sf).filter("brightness BETWEEN 120 AND 134").select("vec_id")


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    m = measures(spark, sf)
    why = Q.reasons(*(F.col(c) for c in ("blur", "spread", "brightness", "confidence", "side")), min_blur=2500, dark=120.0, bright=134.0)
    return m.select("vec_id", why.alias("why"))


_TOLD = """list_filter([CASE WHEN blur < 2500 THEN printf('Blurry (laplacian=%.1f, threshold=2500)', blur) END, CASE WHEN spread < 5 THEN printf('Grayscale/IR (channel diff=%.1f)', spread) END,
  CASE WHEN brightness < 120 THEN printf('Underexposed (brightness=%.1f, min=120.0)', brightness) WHEN brightness > 134 THEN printf('Overexposed (brightness=%.1f, max=134.0)', brightness) END,
  CASE WHEN confidence < 0.7 THEN printf('Low confidence (%.2f, min=0.7)', confidence) END, CASE WHEN side < 50 THEN printf('Face too small (%dx%d, min=50px)', side, side) END], lambda x: x IS NOT NULL)"""


@R.query(f"{ALL} SELECT vec_id, len({_WHY}) = 0 AS passed, coalesce(nullif(array_to_string({_TOLD}, '; '), ''), 'OK') AS reason FROM ms")
def assess_quality(spark: SparkSession, sf: str) -> DataFrame:
    m = measures(spark, sf)
    cols, limits = [F.col(c) for c in ("blur", "spread", "brightness", "confidence", "side")], {"min_blur": 2500, "dark": 120.0, "bright": 134.0}
    a = m.select("vec_id", Q.reasons(*cols, **limits).alias("why"), Q.described(*cols, **limits).alias("told"))
    return a.select("vec_id", (F.size("why") == 0).alias("passed"), F.when(F.size("why") == 0, "OK").otherwise(F.array_join("told", "; ")).alias("reason"))


@R.query(f"{ALL} SELECT reason, count(*) AS n FROM (SELECT unnest({_WHY}) AS reason FROM ms) GROUP BY 1")
def quality_removed(spark: SparkSession, sf: str) -> DataFrame:
    return _assessed(spark, sf).select(F.explode("why").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@R.query(f"""WITH {FACES}, l AS (SELECT person_id, confidence AS x FROM fd WHERE person_id IS NOT NULL AND confidence > 0 AND confidence <= 1)
SELECT person_id, round(median(x), 6) AS median, round(avg(x), 10) AS mean, min(x) AS least, round(quantile_cont(x, 0.95), 6) AS p95, round(1000 / median(x), 3) AS per_second FROM l GROUP BY 1""")
def bench_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Latency statistics; confidences stand for the measured times."""
    f = views.faces(spark, sf).filter("person_id IS NOT NULL AND confidence > 0 AND confidence <= 1")
    x = "confidence"
    return f.groupBy("person_id").agg(F.round(F.median(x), 6).alias("median"), F.round(F.avg(x), 10).alias("mean"), F.min(x).alias("least"), F.round(F.percentile(x, 0.95), 6).alias("p95"), F.round(1000 / F.median(x), 3).alias("per_second"))


