"""References to records that do not exist: run-compressed parent keys and as-of matches."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ids import hex_to_long, refers_to_something, uuid_hex
from tessera.plans.lineage import cut

#: Keys per block: runs end at block borders, so that no window ever holds more than 2**20 distinct keys.
BLOCK_BITS = 20


def with_key(df: DataFrame, text_col: str) -> DataFrame:
    """Adds the 128-bit integer of a UUID as ``k_hi``, ``k_lo`` (order-preserving BIGINTs; NULL if not a UUID)."""
    h = uuid_hex(F.col(text_col))
    df = df.withColumn("_hex", h)
    return df.withColumns({"k_hi": hex_to_long(F.substring("_hex", 1, 16)), "k_lo": hex_to_long(F.substring("_hex", 17, 16))}).drop("_hex")


def key_runs(keys: DataFrame) -> DataFrame:
    """Contiguous runs of the integer keys ``k_hi, k_lo``: k_hi, block, run_start, run_end, n_keys.

    NULL keys and repeats count for nothing; an empty table has no runs. Runs are cut at block borders.
    """
    d = keys.filter("k_hi IS NOT NULL AND k_lo IS NOT NULL").select("k_hi", "k_lo").distinct()
    d = d.withColumn("block", F.shiftright("k_lo", BLOCK_BITS))
    w = W.partitionBy("k_hi", "block").orderBy("k_lo")
    inside = F.col("k_lo").bitwiseAND(F.lit(2**BLOCK_BITS - 1))
    d = d.withColumn("run_no", inside - F.row_number().over(w))
    return d.groupBy("k_hi", "block", "run_no").agg(F.min("k_lo").alias("run_start"), F.max("k_lo").alias("run_end"), F.count("*").alias("n_keys")).drop("run_no")


def match_runs(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct reference keys with ``held``: whether the preceding run start's run reaches the key.

    As-of match in one pass: run starts and reference keys are sorted together within a block and the last start
    before each key is carried forward. A key beyond the run's end, or before any start, is not held.
    """
    r = refs.filter("k_hi IS NOT NULL AND k_lo IS NOT NULL").select("k_hi", "k_lo").distinct()
    r = r.select("k_hi", F.shiftright("k_lo", BLOCK_BITS).alias("block"), F.col("k_lo").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("run_end"))
    s = runs.select("k_hi", "block", F.col("run_start").alias("at"), F.lit(0).alias("kind"), "run_end")
    w = W.partitionBy("k_hi", "block").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = s.unionByName(r).withColumn("_end", F.last("run_end", ignorenulls=True).over(w))
    return both.filter("kind = 1").select("k_hi", F.col("at").alias("k_lo"), F.coalesce(F.col("at") <= F.col("_end"), F.lit(False)).alias("held"))


def run_references(runs: DataFrame) -> DataFrame:
    """One row per distinct reference of an upload run: run_id, recorded_ts, field_name, item, ref.

    ``asset_ids`` gives its entries, ``frigate_files`` its file names with the map values as references. NULL and
    blank references refer to nothing and are left out; NULL lists and maps give no rows.
    """
    ids = runs.select("run_id", "recorded_ts", F.lit("asset_ids").alias("field_name"), F.explode("asset_ids").alias("item"))
    ids = ids.withColumn("ref", F.col("item"))
    files = runs.select("run_id", "recorded_ts", F.lit("frigate_files").alias("field_name"), F.explode("frigate_files").alias("item", "ref"))
    return ids.unionByName(files).filter(refers_to_something(F.col("ref"))).distinct()


def orphan_references(runs: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphan references with their state: run_id, recorded_ts, field_name, item, state.

    ``missing``: no parent row has the key (a text that is no UUID is never met). ``late``: every parent row was
    ingested after the run. ``deleted``: rows exist, but none was alive at ``recorded_ts``. A NULL ``ingested_ts``
    never makes a row alive nor late; with a NULL ``recorded_ts`` a held reference is ``deleted``. Repeated rows
    change nothing, empty tables give an empty result or all references as missing, other columns are ignored.

    Existence comes from the as-of match against key runs. The lifetimes are a running maximum over time: of the
    parent rows ingested up to a moment, the latest deletion decides. The running maximum is split by day (day
    totals, prefix over days, rows within a day), so a key that holds a third of all rows is no single group.
    """
    refs = cut(with_key(run_references(runs), "ref"))
    p = with_key(parents.select("asset_id", "ingested_ts", "deleted_ts"), "asset_id").filter("k_hi IS NOT NULL")
    p = p.select("k_hi", "k_lo", F.col("ingested_ts").alias("ts"), "deleted_ts").distinct()
    p = cut(p)

    held = match_runs(refs, key_runs(p))
    never, always = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    until = F.when(F.col("ts").isNull(), never).otherwise(F.coalesce(F.col("deleted_ts").cast("timestamp_ntz"), always))
    no_ref = {c: F.lit(None).cast(t) for c, t in dict(refs.select("run_id", "field_name", "item").dtypes).items()}
    p_rows = p.select("k_hi", "k_lo", F.coalesce(F.col("ts").cast("timestamp_ntz"), never).alias("ts"), F.lit(0).alias("kind"), until.alias("until"), *(v.alias(k) for k, v in no_ref.items()))
    r_rows = refs.filter("k_hi IS NOT NULL").select("k_hi", "k_lo", F.coalesce(F.col("recorded_ts").cast("timestamp_ntz"), never).alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("until"), "run_id", "field_name", "item", F.col("recorded_ts"))
    u = p_rows.withColumn("recorded_ts", F.lit(None).cast(dict(refs.dtypes)["recorded_ts"])).unionByName(r_rows).withColumn("day", F.col("ts").cast("date"))

    days = u.groupBy("k_hi", "k_lo", "day").agg(F.max("until").alias("d_until"), F.max("kind").alias("has_ref"))
    earlier = W.partitionBy("k_hi", "k_lo").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("before", F.max("d_until").over(earlier)).filter("has_ref = 1")
    days = days.join(held, ["k_hi", "k_lo"]).select("k_hi", "k_lo", "day", "before", "held")
    w = W.partitionBy("k_hi", "k_lo", "day").orderBy("ts", "kind").rangeBetween(W.unboundedPreceding, W.currentRow)
    u = u.join(days, ["k_hi", "k_lo", "day"]).withColumn("seen_until", F.greatest(F.max("until").over(w), F.col("before")))
    r = u.filter("kind = 1").withColumn(
        "state",
        F.when(~F.col("held"), "missing")
        .when(F.col("recorded_ts").isNull(), "deleted")
        .when(F.col("seen_until").isNull(), "late")
        .when(F.col("seen_until") <= F.col("ts"), "deleted"),
    )
    cols = ["run_id", "recorded_ts", "field_name", "item", "state"]
    unmet = refs.filter("k_hi IS NULL").withColumn("state", F.lit("missing")).select(*cols)
    return r.filter("state IS NOT NULL").select(*cols).unionByName(unmet)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per field, month of the run and state, with the runs concerned; NULL month for undated runs."""
    month = F.date_format(F.col("recorded_ts"), "yyyy-MM").alias("month")
    per_run = orphans.groupBy("field_name", month, "state", "run_id").agg(F.count("*").alias("n"))
    return per_run.groupBy("field_name", "month", "state").agg(F.sum("n").alias("n_references"), F.count("*").alias("n_runs"))
