"""Queries over person records and photos, with SQL."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import assets as A
from tessera.operators import people as P
from tessera.operators.registry import Registry
from tessera.sources import read_table, views

R = Registry()
AS_OF = datetime(2025, 1, 1)
ALLOWED, DENIED = ["Person 1", " unknown", "FACE"], ["Stranger", "tbd "]

PEOPLE = "p AS (SELECT DISTINCT * FROM people)"
VALID = "v AS (SELECT * FROM p WHERE trim(name) <> '' AND person_id IS NOT NULL AND person_id <> '')"
SURVIVOR = """s AS (SELECT *, first_value(person_id) OVER (PARTITION BY trim(name) ORDER BY coalesce(asset_count, 0) DESC, person_id) AS survivor FROM v)"""
AP = """ap AS (SELECT DISTINCT asset_id, person_id, file_created_at FROM (
  SELECT asset_id, file_created_at, unnest(list_transform(people, lambda x: x.id)) AS person_id FROM asset) WHERE person_id IS NOT NULL)"""
FACES = "fd AS (SELECT DISTINCT * FROM face_data)"


@R.query(f"WITH {PEOPLE} SELECT person_id, name, asset_count FROM p")
def scan_people(spark: SparkSession, sf: str) -> DataFrame:
    return views.people(spark, sf)


@R.query(f"WITH {PEOPLE}, {VALID} SELECT person_id, name, asset_count FROM v")
def valid_people(spark: SparkSession, sf: str) -> DataFrame:
    return P.valid_people(views.people(spark, sf))


@R.query(f"WITH {PEOPLE} SELECT person_id, name FROM p WHERE lower(name) IN ('person 1', 'unknown', 'face')")
def only_people(spark: SparkSession, sf: str) -> DataFrame:
    return P.listed_people(views.people(spark, sf), ALLOWED).select("person_id", "name")


@R.query(f"WITH {PEOPLE} SELECT person_id, name FROM p WHERE name IS NULL OR lower(name) NOT IN ('stranger', 'tbd')")
def skip_people(spark: SparkSession, sf: str) -> DataFrame:
    return P.listed_people(views.people(spark, sf), DENIED, keep=False).select("person_id", "name")


@R.query(f"WITH {PEOPLE}, {VALID} SELECT trim(name) AS name, count(*) AS n FROM v GROUP BY 1 HAVING count(*) > 1")
def dup_people_groups(spark: SparkSession, sf: str) -> DataFrame:
    return P.duplicate_names(views.people(spark, sf))


@R.query(f"""WITH {PEOPLE}, {VALID}, {SURVIVOR} SELECT person_id, name, asset_count FROM s WHERE person_id = survivor
UNION ALL SELECT person_id, name, asset_count FROM p WHERE NOT coalesce(trim(name) <> '' AND person_id <> '', false)""")
def keep_largest(spark: SparkSession, sf: str) -> DataFrame:
    return P.keep_largest(views.people(spark, sf))


@R.query(f"WITH {PEOPLE}, {VALID}, {SURVIVOR} SELECT DISTINCT survivor, person_id AS merged FROM s WHERE person_id <> survivor")
def merge_survivor(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_map(views.people(spark, sf))


@R.query(f"""WITH {PEOPLE}, {VALID}, {SURVIVOR}, {AP}, m AS (SELECT DISTINCT survivor, person_id AS merged FROM s WHERE person_id <> survivor)
SELECT coalesce(survivor, person_id) AS person_id, count(*) AS n FROM ap LEFT JOIN m ON person_id = merged GROUP BY 1""")
def sink_merge_people(spark: SparkSession, sf: str) -> DataFrame:
    """Photos per person after the merges."""
    r = P.rekey(views.asset_person(spark, sf), P.merge_map(views.people(spark, sf)))
    return r.groupBy("person_id").agg(F.count("*").alias("n"))


@R.query(f"WITH {AP} SELECT person_id, asset_id FROM (SELECT DISTINCT person_id, asset_id FROM ap) QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY asset_id) <= 40")
def scan_assets_paged(spark: SparkSession, sf: str) -> DataFrame:
    return A.capped(views.asset_person(spark, sf).select("person_id", "asset_id").distinct(), 40)


@R.query("""SELECT DISTINCT asset_id, len(list_filter(people, lambda x: x.id IS NOT NULL)) AS n_people, (SELECT count(*) FROM asset) AS total_raw,
  (SELECT count(*) FROM asset WHERE asset_id IS NULL OR people IS NULL OR len(people) = 0) AS n_dropped FROM asset WHERE asset_id IS NOT NULL AND len(people) > 0""")
def drop_malformed(spark: SparkSession, sf: str) -> DataFrame:
    """Photos with an id and people, beside how many rows there were and how many were dropped."""
    a = read_table(spark, sf, "asset")
    good = F.col("asset_id").isNotNull() & (F.coalesce(F.size("people"), F.lit(0)) > 0)
    totals = a.agg(F.count("*").alias("total_raw"), F.count_if(~good).alias("n_dropped"))
    people = F.size(F.filter("people", lambda x: x["id"].isNotNull())).cast("bigint").alias("n_people")
    return a.filter(good).select("asset_id", people).distinct().crossJoin(F.broadcast(totals))


@R.query("SELECT DISTINCT run_id, unnest(asset_ids) AS item FROM frigate_uploaded_ids")
def coalesce_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The lists of responses in two shapes (every other run in each), read back."""
    t = read_table(spark, sf, "frigate_uploaded_ids").select("run_id", "asset_ids").distinct()
    flat, nested = F.struct(F.col("asset_ids").alias("assets")), F.struct(F.struct(F.col("asset_ids").alias("items")).alias("assets"))
    keep = {"ignoreNullFields": "false"}
    j = t.withColumn("body", F.when(F.col("run_id") % 2 == 0, F.to_json(flat, keep)).otherwise(F.to_json(nested, keep)))
    return j.select("run_id", F.explode(A.item_lists(j, "body")).alias("item")).distinct()


@R.query(f"""WITH {AP} SELECT DISTINCT person_id, asset_id FROM ap
WHERE regexp_full_match(file_created_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)')
  AND epoch_us(try_cast(file_created_at AS TIMESTAMPTZ)) > epoch_us(TIMESTAMP '2025-01-01' - INTERVAL 1095 DAY)""")
def recent_assets(spark: SparkSession, sf: str) -> DataFrame:
    return A.recent_assets(views.asset_person(spark, sf), 3, AS_OF).select("person_id", "asset_id").distinct()


@R.query(f"WITH {AP} SELECT person_id, count(*) AS n FROM (SELECT DISTINCT person_id, asset_id FROM ap) GROUP BY 1 HAVING count(*) >= 5")
def min_face_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.min_count(views.asset_person(spark, sf).select("person_id", "asset_id").distinct(), 5)


@R.query(f"""WITH {AP}, d AS (SELECT person_id, CASE WHEN regexp_matches(file_created_at, '^\\d{{4}}-\\d\\d-\\d\\d') THEN file_created_at[1:10] END AS d FROM ap)
SELECT person_id, count(*) AS n, coalesce(min(d), '—') AS first_day, coalesce(max(d), '—') AS last_day FROM d GROUP BY 1""")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return A.preview(views.asset_person(spark, sf))


@R.query("""WITH e AS (SELECT asset_id, people, unnest(list_distinct(list_transform(people, lambda x: x.id))) AS person_id FROM asset),
f AS (SELECT asset_id, person_id, list_filter(people, lambda x: x.id = person_id AND len(x.faces) > 0)[1].faces[1] AS f FROM e WHERE person_id IS NOT NULL)
SELECT DISTINCT asset_id, person_id, coalesce(f.x1, 0) AS x1, coalesce(f.y1, 0) AS y1, coalesce(f.x2, 0) AS x2, coalesce(f.y2, 0) AS y2 FROM f WHERE f IS NOT NULL""")
def first_face(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_faces(read_table(spark, sf, "asset")).drop("confidence").distinct()


@R.query("""WITH e AS (SELECT asset_id, people, unnest(list_distinct(list_transform(people, lambda x: x.id))) AS person_id FROM asset),
f AS (SELECT asset_id, person_id, list_filter(people, lambda x: x.id = person_id AND len(x.faces) > 0)[1].faces[1] AS f FROM e WHERE person_id IS NOT NULL)
SELECT DISTINCT asset_id, person_id, f.score AS confidence FROM f WHERE f IS NOT NULL""")
def face_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_faces(read_table(spark, sf, "asset")).select("asset_id", "person_id", "confidence").distinct()


@R.query(f"WITH {FACES} SELECT asset_id, person_id, min(face_id) AS face_id FROM fd WHERE person_id IS NOT NULL GROUP BY 1, 2")
def scan_face(spark: SparkSession, sf: str) -> DataFrame:
    return A.chosen_faces(views.faces(spark, sf)).select("asset_id", "person_id", "face_id")


@R.query(f"""WITH {AP}, {FACES}, c AS (SELECT asset_id, person_id, min(face_id) AS face_id FROM fd
  WHERE person_id IS NOT NULL AND NOT (coalesce(x1, 0) = 0 AND coalesce(y1, 0) = 0 AND coalesce(x2, 0) = 0 AND coalesce(y2, 0) = 0) GROUP BY 1, 2)
SELECT a.asset_id, a.person_id, c.face_id, fd.x1, fd.y1, fd.x2, fd.y2 FROM (SELECT DISTINCT asset_id, person_id FROM ap) a
LEFT JOIN c USING (asset_id, person_id) LEFT JOIN fd ON fd.face_id = c.face_id""")
def enrich_faces(spark: SparkSession, sf: str) -> DataFrame:
    return A.enriched(views.asset_person(spark, sf), views.faces(spark, sf)).drop("confidence")


@R.query(f"WITH {FACES} SELECT face_id FROM fd WHERE confidence IS NULL OR isnan(confidence) OR confidence >= 0.7")
def confidence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return A.confident(views.faces(spark, sf), 0.7).select("face_id")


@R.query(f"WITH {FACES} SELECT face_id FROM fd WHERE NOT (coalesce(x1, 0) = 0 AND coalesce(y1, 0) = 0 AND coalesce(x2, 0) = 0 AND coalesce(y2, 0) = 0)")
def zero_bbox_gate(spark: SparkSession, sf: str) -> DataFrame:
    return views.faces(spark, sf).filter(A.has_box()).select("face_id")


_SPREAD = """ap2 AS (SELECT person_id, asset_id, max(file_created_at) AS c FROM ap GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(c, ''), asset_id) - 1 AS slot, count(*) OVER (PARTITION BY person_id) AS n FROM ap2),
pos AS (SELECT DISTINCT person_id, CASE WHEN i = {k} - 1 THEN n - 1 ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / {k1})) AS BIGINT) END AS slot
  FROM (SELECT DISTINCT person_id, n FROM o WHERE n > {k}), (SELECT unnest(generate_series(0, {k} - 1)) AS i))
SELECT person_id, asset_id FROM o WHERE n <= {k} UNION ALL SELECT o.person_id, o.asset_id FROM o JOIN pos USING (person_id, slot)"""


def _spread(spark: SparkSession, sf: str, k: int) -> DataFrame:
    ap = views.asset_person(spark, sf).groupBy("person_id", "asset_id").agg(F.max("file_created_at").alias("c"))
    return A.time_spread(ap, "person_id", [F.coalesce("c", F.lit("")), F.col("asset_id")], k).select("person_id", "asset_id")


@R.query(f"WITH {AP}, " + _SPREAD.format(k=10, k1="9.0::DOUBLE"))
def time_spread(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(spark, sf, 10)


@R.query(f"WITH {AP}, " + _SPREAD.format(k=64, k1="63.0::DOUBLE"))
def pool_subsample(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate pool, with its cap scaled down so that it takes effect."""
    return _spread(spark, sf, 64)
