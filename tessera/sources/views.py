"""The domain's relations over the supplied tables. Repeated rows are collapsed here."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_uuid
from tessera.plans.ranking import rank_in_group
from tessera.sources.tables import read_table


def people(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "people").distinct()


def asset_person(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, person_id, file_created_at: who is in which photo."""
    a = read_table(spark, sf, "asset").select("asset_id", "file_created_at", F.explode("people.id").alias("person_id"))
    return a.filter("person_id IS NOT NULL").distinct()


def faces(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "face_data").distinct()


def person_key(c: str = "person"):
    """A person's name without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Upload runs with the folded person name."""
    return read_table(spark, sf, "frigate_uploaded_ids").withColumn("person", person_key())


def tracker_assets(spark: SparkSession, sf: str) -> DataFrame:
    """person, asset_id (canonical), seq: uploads as they were first recorded (``seq`` is the run)."""
    t = runs(spark, sf).select("person", F.explode("asset_ids").alias("raw"), F.col("run_id").alias("seq"))
    t = t.withColumn("asset_id", canonical_uuid(F.col("raw"))).filter("asset_id IS NOT NULL")
    return t.groupBy("person", "asset_id").agg(F.min("seq").alias("seq"))


def tracker_scores(spark: SparkSession, sf: str, column: str) -> DataFrame:
    """person, asset_id, score, seq: valid scores of one of the score maps, rounded to four places, newest run first."""
    t = runs(spark, sf).select("person", F.col("run_id").alias("seq"), F.explode(column).alias("raw", "score"))
    t = t.filter("score >= 0 AND NOT isnan(score)").withColumn("asset_id", canonical_uuid(F.col("raw"))).filter("asset_id IS NOT NULL")
    return t.groupBy("person", "asset_id").agg(F.round(F.max(F.struct("seq", "score"))["score"], 4).alias("score"), F.max("seq").alias("seq"))


def tracker_files(spark: SparkSession, sf: str) -> DataFrame:
    """person, file_name, asset_id, seq: the file map; a name recorded again goes by its newest run."""
    t = runs(spark, sf).select("person", F.col("run_id").alias("seq"), F.explode("frigate_files").alias("file_name", "raw"))
    t = t.withColumn("asset_id", canonical_uuid(F.col("raw"))).filter("asset_id IS NOT NULL")
    newest = F.max(F.struct("seq", "asset_id"))
    return t.groupBy("person", "file_name").agg(newest["asset_id"].alias("asset_id"), newest["seq"].alias("seq"))


def asset_vec(spark: SparkSession, sf: str) -> DataFrame:
    """asset_id, person_id, quality_score, confidence, created, embedding, rank: the vectors with their events.

    ``rank`` orders a person's vectors by quality falling, ties by id.
    """
    e = read_table(spark, sf, "events").select("event_id", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    v = read_table(spark, sf, "embeddings").join(e, F.col("event_id") == F.col("vec_id"))
    v = v.select(F.col("vec_id").alias("asset_id"), F.col("label").alias("person_id"), F.col("value").alias("quality_score"), (F.col("k") / 100.0).alias("confidence"), F.col("ts").alias("created"), "embedding")
    return rank_in_group(v, "person_id", [F.col("quality_score").desc(), F.col("asset_id").asc()]).withColumn("rank", F.col("rank").cast("int"))
