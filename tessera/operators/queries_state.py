"""Queries over the upload state, with SQL."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_uuid
from tessera.operators import assets as A
from tessera.operators import state as S
from tessera.operators.registry import Registry
from tessera.params import CurationParams
from tessera.operators.selection import embed_missing
from tessera.operators.vectors import norm
from tessera.plans.curate import curate as run_curation
from tessera.plans.curate import curate_smart as curate_smart_run
from tessera.sources.gallery import listed_files
from tessera.sources import read_table, views

R = Registry()
AS_OF = datetime(2025, 1, 1)
RESET = ["visitors unsorted"]
_GONE = "regexp_matches(file_name, '[05]\\.[a-z]+$')"

_HEX = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '^urn:uuid:', ''), '^\{{(.*)\}}$', '\1'), '^urn:uuid:|-', '', 'g')"""
_CANON = "CASE WHEN regexp_full_match(h, '[0-9a-f]{32}') THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END"
RUNS = r"runs AS (SELECT * REPLACE (lower(regexp_replace(person, '^\s+|\s+$', '', 'g')) AS person) FROM frigate_uploaded_ids)"
TA = f"""ta AS (SELECT person, asset_id, min(run_id) AS seq FROM (SELECT person, run_id, {_CANON} AS asset_id FROM (
  SELECT person, run_id, {_HEX.format("raw")} AS h FROM (SELECT person, run_id, unnest(asset_ids) AS raw FROM runs))) WHERE asset_id IS NOT NULL GROUP BY 1, 2)"""


def _scores(name: str, column: str) -> str:
    return f"""{name} AS (SELECT person, asset_id, round(max(struct_pack(s := run_id, v := score)).v, 4) AS score, max(run_id) AS seq FROM (
  SELECT person, run_id, score, {_CANON} AS asset_id FROM (SELECT person, run_id, e.value AS score, {_HEX.format("e.key")} AS h FROM (
    SELECT person, run_id, unnest(map_entries({column})) AS e FROM runs) WHERE e.value >= 0 AND NOT isnan(e.value))) WHERE asset_id IS NOT NULL GROUP BY 1, 2)"""


TS, TG = _scores("ts", "scores"), _scores("tg", "frigate_scores")
TF = f"""tf AS (SELECT person, file_name, max(struct_pack(s := run_id, a := asset_id)).a AS asset_id, max(run_id) AS seq FROM (
  SELECT person, run_id, file_name, {_CANON} AS asset_id FROM (SELECT person, run_id, e.key AS file_name, {_HEX.format("e.value")} AS h FROM (
    SELECT person, run_id, unnest(map_entries(frigate_files)) AS e FROM runs))) WHERE asset_id IS NOT NULL GROUP BY 1, 2)"""
_FIRST = "SELECT tf.person, tf.file_name, tf.asset_id, {s}.score, tf.seq FROM tf JOIN {s} USING (person, asset_id) QUALIFY row_number() OVER (PARTITION BY tf.person, tf.asset_id ORDER BY tf.seq, tf.file_name) = 1"
EVENTS = "ev AS (SELECT event_id, CAST(user_id AS VARCHAR) AS person, event_type, value, CAST(props->>'$.k' AS INT) AS k FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("person"), "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _live_files(spark: SparkSession, sf: str) -> DataFrame:
    """The gallery as it is: all files named by any run stand for its listing, whatever they are mapped to."""
    return views.runs(spark, sf).select("person", F.explode(F.map_keys("frigate_files")).alias("file_name")).distinct()


@R.query(f"WITH {RUNS} SELECT person, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT person, e FROM (SELECT person, unnest(map_keys(frigate_files)) AS e FROM runs)) WHERE person <> 'train' GROUP BY 1")
def gallery_counts(spark: SparkSession, sf: str) -> DataFrame:
    f = views.runs(spark, sf).select("person", F.explode("frigate_files").alias("file_name", "raw")).filter("person <> 'train'")
    return f.select("person", "file_name").distinct().groupBy("person").agg(F.count("*").alias("n"))


@R.query(f"WITH {RUNS} SELECT DISTINCT person, e AS file_name FROM (SELECT person, unnest(map_keys(frigate_files)) AS e FROM runs) WHERE person <> 'train'")
def scan_gallery_files(spark: SparkSession, sf: str) -> DataFrame:
    """Listings (a body per run, with the key ``train`` beside the person) read back."""
    r = views.runs(spark, sf).filter("person IS NOT NULL AND person <> 'train' AND frigate_files IS NOT NULL")
    body = F.create_map("person", F.map_keys("frigate_files"), F.lit("train"), F.array(F.lit("a.webp")))
    return listed_files(r.select(F.to_json(body).alias("value"))).distinct()


@R.query(f"WITH {RUNS} SELECT DISTINCT e AS file_name FROM (SELECT unnest(map_keys(frigate_files)) AS e FROM runs WHERE person = 'visitors unsorted')")
def gallery_person_files(spark: SparkSession, sf: str) -> DataFrame:
    return views.runs(spark, sf).filter(F.col("person") == RESET[0]).select(F.explode(F.map_keys("frigate_files")).alias("file_name")).distinct()


@R.query(f"WITH {RUNS}, {TA} SELECT DISTINCT asset_id FROM asset WHERE asset_id IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM ta)")
def exclude_seen(spark: SparkSession, sf: str) -> DataFrame:
    a = read_table(spark, sf, "asset").select(canonical_uuid(F.col("asset_id")).alias("asset_id")).filter("asset_id IS NOT NULL").distinct()
    return S.unseen(a, views.tracker_assets(spark, sf))


@R.query(f"WITH {RUNS}, {TA} SELECT DISTINCT asset_id FROM asset WHERE asset_id IN (SELECT asset_id FROM ta)")
def keep_new(spark: SparkSession, sf: str) -> DataFrame:
    """Photos of the library that are members of a given set of ids (here the recorded ones)."""
    a = read_table(spark, sf, "asset").select(canonical_uuid(F.col("asset_id")).alias("asset_id")).distinct()
    return S.seen_again(a, views.tracker_assets(spark, sf))


@R.query(f"WITH {RUNS}, {TA} SELECT DISTINCT asset_id FROM ta")
def distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    return views.tracker_assets(spark, sf).select("asset_id").distinct()


@R.query(f"WITH {RUNS} SELECT DISTINCT person AS name FROM runs UNION SELECT DISTINCT lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) FROM people WHERE trim(name) <> ''")
def names_union(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "people").filter(F.trim("name") != "").select(views.person_key("name").alias("name"))
    return views.runs(spark, sf).select(F.col("person").alias("name")).union(n).distinct()


@R.query(f"WITH {RUNS}, {TA} SELECT person, count(*) AS n FROM ta GROUP BY 1")
def tracked_count(spark: SparkSession, sf: str) -> DataFrame:
    return views.tracker_assets(spark, sf).groupBy("person").agg(F.count("*").alias("n"))


@R.query(f"WITH {RUNS}, {TA}, {TS}, {TG} SELECT person, asset_id, ts.score AS blur_score, tg.score AS gallery_score FROM ta LEFT JOIN ts USING (person, asset_id) LEFT JOIN tg USING (person, asset_id)")
def mark_uploaded(spark: SparkSession, sf: str) -> DataFrame:
    """The fold of all runs: every recorded asset with the last score of each kind."""
    base = views.tracker_assets(spark, sf).select("person", "asset_id", "seq", F.lit(None).cast("double").alias("blur_score"), F.lit(None).cast("double").alias("gallery_score"))
    log = base
    for column, name, other in (("scores", "blur_score", "gallery_score"), ("frigate_scores", "gallery_score", "blur_score")):
        s = views.tracker_scores(spark, sf, column).join(base.select("person", "asset_id"), ["person", "asset_id"], "left_semi")
        log = log.unionByName(s.select("person", "asset_id", "seq", F.col("score").alias(name), F.lit(None).cast("double").alias(other)))
    return S.fold_marks(log, ["blur_score", "gallery_score"]).select("person", "asset_id", "blur_score", "gallery_score")


@R.query(f"WITH {EVENTS} SELECT person, k AS asset_id, min(event_id) AS first_seq, max(event_id) AS last_seq FROM ev WHERE event_type = 'error' AND k IS NOT NULL GROUP BY 1, 2")
def mark_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Refused photos (the number k stands for one, which may be refused again), recorded and replayed."""
    log = _events(spark, sf).filter("event_type = 'error' AND k IS NOT NULL").select("person", F.col("k").alias("asset_id"), F.col("event_id").alias("seq"))
    return S.fold_marks(log.unionByName(log), []).select("person", "asset_id", "first_seq", "last_seq")


@R.query(f"WITH {RUNS}, {TF} SELECT person, file_name, asset_id FROM tf")
def record_files(spark: SparkSession, sf: str) -> DataFrame:
    return S.fold_files(views.tracker_files(spark, sf)).select("person", "file_name", "asset_id")


def _gone(spark: SparkSession, sf: str) -> DataFrame:
    return views.tracker_files(spark, sf).filter(F.col("file_name").rlike(r"[05]\.[a-z]+$"))


@R.query(f"WITH {RUNS}, {TF} SELECT person, file_name, asset_id FROM tf WHERE NOT {_GONE}")
def remove_files(spark: SparkSession, sf: str) -> DataFrame:
    return S.without_files(views.tracker_files(spark, sf), _gone(spark, sf)).select("person", "file_name", "asset_id")


@R.query(f"""WITH {RUNS}, {TF}, {TG}, l AS (SELECT DISTINCT person, asset_id FROM tf WHERE {_GONE} EXCEPT SELECT person, asset_id FROM tf WHERE NOT {_GONE})
SELECT tg.person, tg.asset_id, tg.score FROM tg ANTI JOIN l USING (person, asset_id)""")
def scores_after_removal(spark: SparkSession, sf: str) -> DataFrame:
    return S.scores_after_removal(views.tracker_scores(spark, sf, "frigate_scores"), views.tracker_files(spark, sf), _gone(spark, sf)).select("person", "asset_id", "score")


@R.query(f"WITH {RUNS} SELECT person, max(struct_pack(s := run_id, c := frigate_count)).c AS gallery_count FROM runs WHERE frigate_count IS NOT NULL GROUP BY 1")
def update_count(spark: SparkSession, sf: str) -> DataFrame:
    r = views.runs(spark, sf).filter("frigate_count IS NOT NULL")
    return r.groupBy("person").agg(F.max(F.struct("run_id", "frigate_count"))["frigate_count"].alias("gallery_count"))


@R.query(f"WITH {RUNS}, {TA} SELECT person, asset_id FROM ta WHERE person <> 'visitors unsorted'")
def reset_person(spark: SparkSession, sf: str) -> DataFrame:
    return S.without_people(views.tracker_assets(spark, sf), RESET).select("person", "asset_id")


@R.query(f"WITH {RUNS}, {TA}, {TF} SELECT person, coalesce(a.n, 0) AS assets_before, coalesce(f.n, 0) AS files_before, 0::BIGINT AS assets_after, 0::BIGINT AS files_after FROM (SELECT person, count(*) AS n FROM ta GROUP BY 1) a FULL JOIN (SELECT person, count(*) AS n FROM tf GROUP BY 1) f USING (person) WHERE person IS NOT NULL")
def reset_all(spark: SparkSession, sf: str) -> DataFrame:
    """What everybody had before and has after a reset of all."""
    a, f = views.tracker_assets(spark, sf), views.tracker_files(spark, sf)
    names = a.select("person").union(f.select("person")).filter("person IS NOT NULL").distinct()
    out = names
    for df, what in ((a, "assets_before"), (f, "files_before"), (S.emptied(a), "assets_after"), (S.emptied(f), "files_after")):
        out = out.join(df.groupBy("person").agg(F.count("*").alias(what)), "person", "left")
    return out.na.fill(0)


@R.query("""SELECT DISTINCT run_id, array_to_string(list_transform(coalesce(asset_ids, []), lambda x: coalesce(x, '-')), '|') AS ids, cardinality(coalesce(scores, MAP {}))::INT AS n_scores, cardinality(coalesce(frigate_scores, MAP {}))::INT AS n_gallery_scores,
  cardinality(coalesce(frigate_files, MAP {}))::INT AS n_files, cardinality(coalesce(crop_dims, MAP {}))::INT AS n_dims, scores IS NULL AND frigate_scores IS NULL AND frigate_files IS NULL AND crop_dims IS NULL AS legacy FROM frigate_uploaded_ids""")
def migrate_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the old form (a list only) filled up to the present one."""
    m = S.migrated(read_table(spark, sf, "frigate_uploaded_ids"))
    sizes = [F.size(c).alias(n) for c, n in (("scores", "n_scores"), ("frigate_scores", "n_gallery_scores"), ("frigate_files", "n_files"), ("crop_dims", "n_dims"))]
    return m.select("run_id", F.array_join("asset_ids", "|", "-").alias("ids"), *sizes, "legacy").distinct()


@R.query(f"""WITH {EVENTS} SELECT person, count(*) FILTER (WHERE event_type = 'purchase') AS n_uploaded, count(*) FILTER (WHERE event_type = 'error') AS n_rejected
FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY 1""")
def person_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    return S.summary(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"))


@R.query(f"WITH {RUNS}, {TF}, {TS} " + _FIRST.format(s="ts"))
def files_with_scores(spark: SparkSession, sf: str) -> DataFrame:
    return S.mapped_scores(views.tracker_files(spark, sf), views.tracker_scores(spark, sf, "scores")).select("person", "file_name", "asset_id", "score", "seq")


@R.query(f"WITH {RUNS}, {TF}, {TG}, t AS (SELECT DISTINCT person FROM tf) SELECT person, count(tg.score) > 0 AS has_scores FROM t LEFT JOIN (SELECT tf.person, tg.score FROM tf JOIN tg USING (person, asset_id)) tg USING (person) GROUP BY 1")
def has_scores(spark: SparkSession, sf: str) -> DataFrame:
    f = views.tracker_files(spark, sf)
    j = f.join(views.tracker_scores(spark, sf, "frigate_scores").select("person", "asset_id", "score"), ["person", "asset_id"], "left")
    return j.groupBy("person").agg(F.coalesce(F.bool_or(F.col("score").isNotNull()), F.lit(False)).alias("has_scores"))


@R.query(f"WITH {RUNS}, {TF}, {TS}, m AS ({_FIRST.format(s='ts')}) SELECT person, file_name, score FROM m QUALIFY row_number() OVER (PARTITION BY person ORDER BY score, seq, file_name) = 1")
def lowest_quality_file(spark: SparkSession, sf: str) -> DataFrame:
    return S.extreme_file(S.mapped_scores(views.tracker_files(spark, sf), views.tracker_scores(spark, sf, "scores")), largest=False)


@R.query(f"WITH {RUNS}, {TF}, {TG}, m AS ({_FIRST.format(s='tg')}) SELECT person, file_name, score FROM m QUALIFY row_number() OVER (PARTITION BY person ORDER BY score DESC, seq, file_name) = 1")
def most_redundant_file(spark: SparkSession, sf: str) -> DataFrame:
    return S.extreme_file(S.mapped_scores(views.tracker_files(spark, sf), views.tracker_scores(spark, sf, "frigate_scores")), largest=True)


@R.query(f"WITH {RUNS}, {TF}, {TG} SELECT DISTINCT person, file_name FROM tf ANTI JOIN (SELECT tf.person, tf.file_name FROM tf JOIN tg USING (person, asset_id)) l USING (person, file_name)")
def stale_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped files that a listing (here the files with a gallery score) does not hold."""
    f = views.tracker_files(spark, sf)
    live = f.join(views.tracker_scores(spark, sf, "frigate_scores").select("person", "asset_id"), ["person", "asset_id"], "left_semi")
    return S.without_files(f, live).select("person", "file_name")


@R.query(f"WITH {RUNS}, {TF}, l AS (SELECT DISTINCT person, e AS file_name FROM (SELECT person, unnest(map_keys(frigate_files)) AS e FROM runs)) SELECT person, file_name FROM l ANTI JOIN tf USING (person, file_name)")
def new_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the gallery that are mapped to no photo yet."""
    return S.without_files(_live_files(spark, sf), views.tracker_files(spark, sf))


@R.query(f"""WITH {EVENTS}, u AS (SELECT person, event_id AS asset_id, event_id AS pos FROM ev WHERE event_type = 'purchase'),
f AS (SELECT person, concat('f_', event_id, '.webp') AS file_name, event_id AS num FROM ev WHERE event_type = 'view'),
un AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY pos) AS i, count(*) OVER (PARTITION BY person) AS n FROM u),
fn AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY num, file_name) AS i, count(*) OVER (PARTITION BY person) AS n FROM f)
SELECT person, file_name, asset_id FROM un JOIN fn USING (person, i, n)""")
def positional_map(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    u = e.filter("event_type = 'purchase'").select("person", F.col("event_id").alias("asset_id"), F.col("event_id").alias("pos"))
    f = e.filter("event_type = 'view'").select("person", F.concat(F.lit("f_"), F.col("event_id"), F.lit(".webp")).alias("file_name"))
    return S.positional_map(u, f)


_DIMS = f"""dm AS (SELECT person, asset_id, max(struct_pack(s := run_id, w := w, h := hh)).w AS w, max(struct_pack(s := run_id, w := w, h := hh)).h AS h FROM (
  SELECT person, run_id, w, hh, {_CANON} AS asset_id FROM (SELECT person, run_id, e.value[1] AS w, e.value[2] AS hh, {_HEX.format("e.key")} AS h FROM (
    SELECT person, run_id, unnest(map_entries(crop_dims)) AS e FROM runs))) WHERE asset_id IS NOT NULL GROUP BY 1, 2)"""


@R.query(f"""WITH {RUNS}, {TF}, {TS}, {TG}, {_DIMS}, ff AS (SELECT person, asset_id, first(file_name ORDER BY seq, file_name) AS file_name FROM tf GROUP BY 1, 2)
SELECT dm.person, dm.asset_id, dm.w, dm.h, ts.score, tg.score AS gallery_score, ff.file_name FROM dm LEFT JOIN ts USING (person, asset_id) LEFT JOIN tg USING (person, asset_id)
LEFT JOIN ff USING (person, asset_id) WHERE dm.w = 112 OR dm.h = 112""")
def crop_trace(spark: SparkSession, sf: str) -> DataFrame:
    d = views.runs(spark, sf).select("person", "run_id", F.explode("crop_dims").alias("raw", "d")).withColumn("asset_id", canonical_uuid(F.col("raw"))).filter("asset_id IS NOT NULL")
    last = F.max(F.struct("run_id", F.get("d", F.lit(0)).alias("w"), F.get("d", F.lit(1)).alias("h")))
    d = d.groupBy("person", "asset_id").agg(last["w"].alias("w"), last["h"].alias("h"))
    return S.crop_trace(d, 112, views.tracker_scores(spark, sf, "scores"), views.tracker_scores(spark, sf, "frigate_scores"), views.tracker_files(spark, sf))


@R.query(f"""WITH {RUNS}, {TA}, t AS (SELECT person, count(*) AS tracked FROM ta GROUP BY 1), w AS (SELECT DISTINCT person FROM runs)
SELECT w.person, 20 - coalesce(tracked, 0) AS capacity FROM w LEFT JOIN t USING (person)""")
def capacity(spark: SparkSession, sf: str) -> DataFrame:
    t = tracked_count(spark, sf).withColumnRenamed("n", "tracked")
    return A.capacities(views.runs(spark, sf).select("person").distinct(), t, 20).select("person", "capacity")


@R.query(f"""WITH {RUNS}, {TA}, t AS (SELECT person, count(*) AS tracked FROM ta GROUP BY 1), w AS (SELECT DISTINCT person FROM runs), c AS (SELECT w.person, coalesce(tracked, 0) AS tr FROM w LEFT JOIN t USING (person))
SELECT person, CASE WHEN tr > 0 AND 20 - tr > 0 THEN 20 - tr END AS automatic, CASE WHEN 20 - tr > 0 THEN least(10, 20 - tr) ELSE 10 END AS fixed FROM c""")
def effective_limit(spark: SparkSession, sf: str) -> DataFrame:
    t = tracked_count(spark, sf).withColumnRenamed("n", "tracked")
    w = views.runs(spark, sf).select("person").distinct()
    auto = A.capacities(w, t, 20).select("person", F.col("effective_limit").alias("automatic"))
    return auto.join(A.capacities(w, t, 20, 10).select("person", F.col("effective_limit").alias("fixed")), "person")


@R.query("SELECT DISTINCT vec_id, sha256(concat(asset_id, ':', model_version))[1:16] = cache_key AS hit FROM embedding_cache WHERE asset_id IS NOT NULL AND model_version IS NOT NULL")
def scan_embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "embedding_cache").filter("asset_id IS NOT NULL AND model_version IS NOT NULL")
    key = F.substring(F.sha2(F.concat_ws(":", "asset_id", "model_version"), 256), 1, 16)
    return c.select("vec_id", (key == F.col("cache_key")).alias("hit")).distinct()


@R.query("""WITH c AS (SELECT cache_key, min(vec_id) AS v FROM embedding_cache WHERE len(embedding) > 0 GROUP BY 1), a AS (SELECT DISTINCT asset_id FROM asset WHERE asset_id IS NOT NULL),
f AS (SELECT vec_id, any_value(embedding[1]) AS x FROM embedding_cache GROUP BY 1)
SELECT a.asset_id, c.cache_key IS NOT NULL AS cached, CASE WHEN c.cache_key IS NULL THEN round(ascii(a.asset_id) / 256.0::DOUBLE, 5) WHEN isfinite(f.x) THEN round(f.x::DOUBLE, 5) + 0.0 END AS first
FROM a LEFT JOIN c ON c.cache_key = sha256(concat(a.asset_id, ':arcnet512-r3'))[1:16] LEFT JOIN f ON f.vec_id = c.v""")
def embed_cached(spark: SparkSession, sf: str) -> DataFrame:
    """The first number of every photo's vector: from the cache where it answers, else computed (by a stand-in for a model)."""
    c = read_table(spark, sf, "embedding_cache").filter("cache_key IS NOT NULL AND size(embedding) > 0")
    c = c.groupBy("cache_key").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    a = read_table(spark, sf, "asset").filter("asset_id IS NOT NULL").select("asset_id").distinct()
    a = a.withColumn("cache_key", F.substring(F.sha2(F.concat_ws(":", "asset_id", F.lit("arcnet512-r3")), 256), 1, 16))
    cache = a.join(c, "cache_key").select("asset_id", "embedding", F.lit(True).alias("cached"))
    got = embed_missing(a.select("asset_id", F.col("asset_id").alias("payload")), cache, lambda p: [[ord(x[0]) / 256.0] for x in p])
    first = F.get("embedding", F.lit(0)).cast("double")
    got = got.join(cache.select("asset_id", "cached"), "asset_id", "left")
    return got.select("asset_id", F.coalesce("cached", F.lit(False)).alias("cached"), F.when(~F.isnan(first) & (F.abs(first) < float("inf")), F.round(first, 5) + 0.0).alias("first"))


@R.query("SELECT p_brand, sha256(string_agg(concat(p_name, ':', p_size, ':', p_partkey), '|' ORDER BY concat(p_name, ':', p_size, ':', p_partkey)))[1:12] AS fingerprint FROM part GROUP BY 1")
def model_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free fingerprint of each model's files (name, size, time); brands with their parts stand for models."""
    f = read_table(spark, sf, "part").select("p_brand", F.concat_ws(":", "p_name", "p_size", "p_partkey").alias("f"))
    return f.groupBy("p_brand").agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "|"), 256), 1, 12).alias("fingerprint"))


_CURATE = f"""WITH {RUNS}, {TA}, p AS (SELECT DISTINCT person_id FROM people WHERE trim(name) <> '' AND person_id <> ''),
ap AS (SELECT asset_id, unnest(list_transform(people, lambda x: x.id)) AS person_id, file_created_at FROM asset),
r AS (SELECT person_id, asset_id, max(file_created_at) AS created FROM ap
  WHERE regexp_full_match(file_created_at, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d(:\\d\\d(\\.\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)')
    AND epoch_us(try_cast(file_created_at AS TIMESTAMPTZ)) > epoch_us(TIMESTAMP '2025-01-01' - INTERVAL 3650 DAY)
    AND person_id IN (SELECT person_id FROM p) AND asset_id NOT IN (SELECT asset_id FROM ta) GROUP BY 1, 2),
fd AS (SELECT DISTINCT * FROM face_data WHERE NOT (coalesce(x1, 0) = 0 AND coalesce(y1, 0) = 0 AND coalesce(x2, 0) = 0 AND coalesce(y2, 0) = 0)),
fc AS (SELECT * REPLACE (CASE WHEN NOT isnan(confidence) THEN confidence END AS confidence) FROM fd WHERE person_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asset_id, person_id ORDER BY face_id) = 1),
a AS (SELECT r.*, fc.confidence FROM r LEFT JOIN fc USING (asset_id, person_id) WHERE fc.confidence IS NULL OR fc.confidence >= 0.7),
o AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY coalesce(created, ''), asset_id) - 1 AS slot, count(*) OVER (PARTITION BY person_id) AS n FROM a),
pos AS (SELECT DISTINCT person_id, CASE WHEN i = 9 THEN n - 1 ELSE CAST(floor(CAST(i AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / 9.0::DOUBLE)) AS BIGINT) END AS slot
  FROM (SELECT DISTINCT person_id, n FROM o WHERE n > 10), (SELECT unnest(generate_series(0, 9)) AS i))
SELECT person_id, asset_id, confidence FROM o WHERE n <= 10 UNION ALL SELECT o.person_id, o.asset_id, o.confidence FROM o JOIN pos USING (person_id, slot)"""


@R.query(_CURATE)
def curate(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline from people and photos to the ten photos a run would take up of each person."""
    params = CurationParams()
    return run_curation(views.people(spark, sf), views.asset_person(spark, sf), views.faces(spark, sf), views.tracker_assets(spark, sf), params, AS_OF, 10)


@R.query()
def curate_smart(spark: SparkSession, sf: str) -> DataFrame:
    """The same with vectors: up to ten representatives of each person; the norm of a vector stands for its quality."""
    v = read_table(spark, sf, "embedding_cache").filter("asset_id IS NOT NULL").select("asset_id", "embedding").withColumn("quality", F.round(norm(F.col("embedding")), 6))
    return curate_smart_run(views.people(spark, sf), views.asset_person(spark, sf), views.faces(spark, sf), views.tracker_assets(spark, sf), v, CurationParams(), AS_OF, 10)
