"""Most similar vectors: shifted Hilbert orderings, window candidates, exact rerank.

1. Every usable vector is projected to a short int8 sketch and, per ordering, to a few dimensions whose shifted Hilbert
   index is its key. Exact copies are collapsed to their smallest id.
2. The rows of all orderings are range-partitioned by (ordering, key) and sorted. Within a partition the sketches of
   neighbouring key windows are compared; of those above a floor that leaves room for the sketch's error every row keeps
   the nearest as candidates.
3. The candidates of all orderings merge into components, whose vectors are compared with each other exactly, which
   also finds pairs that no window held. Components of more than ``TILE`` vectors are compared tile by tile.
"""

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.vectors import DIMS, candidates_of, groups_of, pack, packed_vectors, unit, unpack, usable_rows
from tessera.plans.components import connected_components
from tessera.plans.lineage import cut, release, tasks

ORDERINGS, SKETCH, CURVE_DIMS, CURVE_BITS, WINDOW, TILE, SEED = 10, 256, 15, 4, 256, 8192, 20240229
#: Candidates that a row keeps of its windows beyond the partners asked for, as sketches order them with errors.
MARGIN = 22
#: Queries and rows of one meeting of the exact search for what the curves leave open.
BLOCK_ASKS, SLICE_ROWS = 4096, 16384
#: A sketch estimate of a cosine c errs by (1 - c^2) / sqrt(SKETCH), 0.0225 at 0.8; the floor is this much lower.
SLACK = 0.06


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transposed-bits method; dims * bits must be below 64."""
    x = cells.T.astype(np.uint32).copy()
    m = len(x)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(m):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(high, p, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[m - 1] & np.uint32(1 << b), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key.astype(np.int64)


def sketches(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, digest (of the content), sketch (int8) and keys (one per ordering) of every usable row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        proj = rng.standard_normal((dims, SKETCH + ORDERINGS * CURVE_DIMS)).astype(np.float32)
        shift = rng.uniform(0, 1, (ORDERINGS, CURVE_DIMS)).astype(np.float32)
        for batch in batches:
            ids, x = usable_rows(batch, dims)
            y = unit(x) @ proj
            s = np.clip(np.rint(unit(y[:, :SKETCH]) * (127 * np.sqrt(SKETCH) / 5)), -127, 127).astype(np.int8)
            keys = np.empty((len(ids), ORDERINGS), np.int64)
            for o in range(ORDERINGS):
                z = y[:, SKETCH + o * CURVE_DIMS : SKETCH + (o + 1) * CURVE_DIMS]
                cells = np.clip((z + 3) / 6 * (1 << CURVE_BITS) + shift[o], 0, (1 << CURVE_BITS) - 1).astype(np.int64)
                keys[:, o] = hilbert_keys(cells, CURVE_BITS)
            digest = [blake2b(r.tobytes(), digest_size=16).digest() for r in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in s], pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, ORDERINGS, dtype=np.int32), keys.ravel())],
                ["vec_id", "digest", "sketch", "keys"],
            )

    return candidates_of(vectors, dims).mapInArrow(rows, "vec_id bigint, digest binary, sketch binary, keys array<bigint>")


def ordered_rows(reps: DataFrame) -> DataFrame:
    """One row per vector and ordering, range-partitioned and sorted along the curves."""
    rows = reps.select("vec_id", "sketch", F.posexplode("keys").alias("ordering", "key"))
    n = tasks(reps.sparkSession, 24)
    return rows.repartitionByRange(n, "ordering", "key").sortWithinPartitions("ordering", "key", "vec_id").select("vec_id", "sketch")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit sketches in consecutive windows of ``WINDOW`` rows."""
    ids, sk = np.empty(0, np.int64), np.empty((0, SKETCH), np.float32)
    for batch in batches:
        if not batch.num_rows:
            continue
        more = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.int8).reshape(-1, SKETCH).astype(np.float32)
        more /= np.sqrt(np.einsum("ij,ij->i", more, more))[:, None].clip(1e-9)
        ids, sk = np.concatenate([ids, batch.column("vec_id").to_numpy()]), np.concatenate([sk, more])
        full = len(ids) // WINDOW
        for at in (slice(i * WINDOW, (i + 1) * WINDOW) for i in range(full)):
            yield ids[at], sk[at]
        ids, sk = ids[full * WINDOW :], sk[full * WINDOW :]
    if len(ids):
        yield ids, sk


def window_pairs(ordered: DataFrame, floor: float, keep: int) -> DataFrame:
    """Distinct candidate pairs a < b: of every row the ``keep`` nearest sketches in its own and the last window that reach ``floor``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_ids, last = np.empty(0, np.int64), np.empty((0, SKETCH), np.float32)
        for ids, s in _windows(batches):
            all_ids, sims = np.concatenate([last_ids, ids]), s @ np.concatenate([last, s]).T
            sims[:, len(last_ids) :][np.diag_indices(len(ids))] = -2
            if sims.shape[1] > keep:
                least = -np.partition(-sims, keep - 1, axis=1)[:, keep - 1]
                sims[sims < least[:, None]] = -2
            i, j = np.nonzero(sims >= floor)
            a, b = np.minimum(ids[i], all_ids[j]), np.maximum(ids[i], all_ids[j])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            last_ids, last = ids, s

    return ordered.mapInArrow(rows, "a bigint, b bigint").distinct()


def _top_pairs(ids: np.ndarray, x: np.ndarray, other_ids: np.ndarray, y: np.ndarray, floor: float, k: int) -> pa.RecordBatch:
    """For every row of x its k best rows of y (other ids) with at least ``floor``, smaller ids first among ties.

    Cosines are those of the two rows alone, the same in a block of any shape.
    """
    out: list[tuple] = []
    for at in range(0, len(ids), 512):
        sims = x[at : at + 512] @ y.T
        sims[ids[at : at + 512, None] == other_ids[None, :]] = -2
        least = np.full(len(sims), floor)
        if sims.shape[1] > k:
            least = np.maximum(least, -np.partition(-sims, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(sims >= least[:, None] - 1e-5)
        v = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[at + i[p : p + 16384]], y[j[p : p + 16384]], dtype=np.float64) for p in range(0, len(i), 16384))])
        i, j, v = (z[v >= floor] for z in (i, j, v))
        order = np.lexsort((other_ids[j], -v, i))
        i, j, v = i[order], j[order], v[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        out.append((ids[at : at + 512][i[top]], other_ids[j[top]], v[top]))
    a, b, c = (np.concatenate(z) for z in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c.astype(np.float64))], ["vec_id", "other", "cosine"])


def exact_in_components(packed: DataFrame, comps: DataFrame, floor: float, k: int, dims: int = DIMS) -> DataFrame:
    """The k best partners inside its component of every query: vec_id, other, cosine (at least ``floor``).

    ``comps`` (id, comp, asks) sends each full vector to its component once; a component of more than ``TILE`` vectors
    is cut into tiles by a hash of the id, and every tile meets the queries of every tile as a group of its own.
    """
    wanted = comps.groupBy("comp").agg(F.bool_or("asks").alias("any"), F.count("*").alias("n")).filter("any")
    at = comps.join(wanted.select("comp", F.when(F.col("n") > TILE, F.ceil(F.col("n") / (TILE // 2))).otherwise(1).cast("int").alias("tiles")), "comp")
    at = at.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    full = packed.join(at, F.col("vec_id") == F.col("id")).drop("id")
    # tile t meets every tile: as rows (r) in groups (t, u), as columns in groups (u, t)
    meets = F.flatten(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.array(
        F.struct(F.col("tile").alias("t"), u.alias("u"), F.lit(1).alias("side")), F.struct(u.alias("t"), F.col("tile").alias("u"), F.lit(2).alias("side")))))
    one = F.array(F.struct(F.lit(0).alias("t"), F.lit(0).alias("u"), F.lit(3).alias("side")))
    full = full.withColumn("m", F.explode(F.when(F.col("tiles") == 1, one).otherwise(meets))).select("comp", "m.t", "m.u", "m.side", "asks", "vec_id", "vec")
    full = full.filter("asks OR side <> 1").withColumn("g", F.concat_ws(":", "comp", "t", "u")).drop("comp", "t", "u")
    n = tasks(packed.sparkSession, 24)
    full = full.repartition(n, "g").sortWithinPartitions("g", "vec_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "g"):
            table = table.combine_chunks()
            ids, side, asks = table["vec_id"].to_numpy(), table["side"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
            x = unit(unpack(table["vec"], dims))
            for rows_, cols in (((side == 3) & asks, side == 3), (side == 1, side == 2)):
                (r,), (c,) = np.nonzero(rows_), np.nonzero(cols)
                if len(r) and len(c):
                    r, c = r[np.unique(ids[r], return_index=True)[1]], c[np.unique(ids[c], return_index=True)[1]]
                    yield _top_pairs(ids[r], x[r], ids[c], x[c], floor, k)

    return full.mapInArrow(rows, "vec_id bigint, other bigint, cosine double")


def against_all(packed: DataFrame, asking: DataFrame, k: int, dims: int = DIMS) -> DataFrame:
    """The k best partners of every asking vector (``vec_id``) among all vectors: vec_id, other, cosine.

    The exact way for queries that the curves cannot serve. Blocks of ``BLOCK_ASKS`` queries meet slices of
    ``SLICE_ROWS`` rows; each meeting is a group that keeps k partners a query.
    """
    n, asks = packed.count(), asking.count()
    slices, blocks = max(1, -(-n // SLICE_ROWS)), max(1, -(-asks // BLOCK_ASKS))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    rows_ = packed.select(part("vec_id", slices).alias("slice"), F.explode(every(blocks)).alias("block"), F.lit(1).alias("side"), "vec_id", "vec")
    asks_ = packed.join(asking, "vec_id", "left_semi").select(F.explode(every(slices)).alias("slice"), part("vec_id", blocks).alias("block"), F.lit(0).alias("side"), "vec_id", "vec")
    both = rows_.union(asks_).withColumn("g", F.concat_ws(":", "slice", "block")).select("g", "side", "vec_id", "vec")
    both = both.repartition(tasks(packed.sparkSession, 24), "g").sortWithinPartitions("g", "side", "vec_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "g"):
            t = t.combine_chunks()
            side, ids = t["side"].to_numpy(), t["vec_id"].to_numpy()
            x = unit(unpack(t["vec"], dims))
            q, r = (np.flatnonzero(side == s) for s in (0, 1))
            q, r = (at[np.unique(ids[at], return_index=True)[1]] for at in (q, r))
            for i in range(0, len(q), 512):
                at = q[i : i + 512]
                sims = x[at] @ x[r].T
                sims[ids[at][:, None] == ids[r][None, :]] = -2
                top = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]
                m = top.shape[1]
                cols = [pa.array(np.repeat(ids[at], m)), pa.array(ids[r][top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel().astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "other", "cosine"])

    return both.mapInArrow(rows, "vec_id bigint, other bigint, cosine double").filter("cosine > -2")


def similar_vectors(vectors: DataFrame, k: int = 10, min_cosine: float = 0.8, dims: int = DIMS, queries: str = "true", rest: bool = False, margin: int = MARGIN) -> DataFrame:
    """The k most similar usable vectors of every query with a cosine of at least ``min_cosine``.

    Columns vec_id, other, cosine, rank; ties by the smaller ``other``. ``queries`` is a condition on vec_id, all
    vectors by default; they are compared with all vectors. With ``rest`` the queries that have fewer than k partners
    above ``min_cosine`` are compared with all vectors in blocks, exactly: below the floor lie unrelated vectors, whose
    order no index knows. That is for stated query sets only. ``margin`` candidates beyond k are kept of every window to
    join the components, inside which all pairs are compared whatever their size. Unusable vectors (NULL, other length, NULL or non-finite entries, no norm) and NULL ids
    take no part. Repeated rows change nothing; vectors of equal content are partners with cosine 1 and share their
    other partners, however many there are. An empty table gives no rows, other columns are ignored. Approximate: a
    pair is lost if no chain of candidates joins it; what comes out is exact.
    """
    spark = vectors.sparkSession
    base = cut(sketches(vectors, dims).withColumn("asks", F.expr(queries)))
    reps = base.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.min_by("sketch", "vec_id").alias("sketch"), F.min_by("keys", "vec_id").alias("keys"), F.bool_or("asks").alias("asks"))
    pairs = cut(window_pairs(ordered_rows(reps), min_cosine - SLACK, k + margin))
    release(spark)
    ids = reps.select(F.col("vec_id").alias("id"), "asks")
    comps, packed = cut(connected_components(pairs).join(ids, "id")), packed_vectors(vectors, dims)
    best = exact_in_components(packed, comps, min_cosine, k + 1, dims)
    w = W.partitionBy("vec_id").orderBy(F.col("cosine").desc(), "other")
    top = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1)
    best = cut(top(best))
    release(spark)
    if rest:
        served = best.groupBy("vec_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
        asking = cut(ids.filter("asks").select(F.col("id").alias("vec_id")).join(served, "vec_id", "left_anti"))
        packed = packed.join(reps.select("vec_id"), "vec_id", "left_semi")
        found = against_all(packed, asking, k + 1, dims)
        best = cut(top(best.drop("rank").union(found).groupBy("vec_id", "other").agg(F.max("cosine").alias("cosine"))))
        release(spark)

    # copies: members of a digest with more than one id share the list of their representative
    ids = base.select("digest", "vec_id", "asks").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    multi = base.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.max("vec_id").alias("top")).filter("top > rep").drop("top")
    members = cut(ids.join(multi, "digest").select("rep", "vec_id", "asks", "salt"))
    first = members.withColumn("r", F.row_number().over(W.partitionBy("rep", "salt").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    heads = first.groupBy("rep").agg(F.sort_array(F.collect_list("vec_id")).alias("heads"))
    spread = best.join(heads.withColumnRenamed("rep", "other"), "other", "left").select("vec_id", F.explode(F.coalesce("heads", F.array("other"))).alias("other"), "cosine")
    own = heads.select(F.col("rep").alias("vec_id"), F.explode("heads").alias("other"), F.lit(1.0).alias("cosine"))
    lists = spread.union(own).groupBy("vec_id").agg(F.collect_list(F.struct((-F.col("cosine")).alias("d"), "other")).alias("l"))
    lists = lists.select("vec_id", F.slice(F.array_sort("l"), 1, k + 1).alias("l"))
    as_rep = lists.join(members.select(F.col("rep").alias("vec_id"), F.col("vec_id").alias("member"), "asks"), "vec_id", "left")
    out = as_rep.filter(F.coalesce("asks", F.lit(True))).select(F.coalesce("member", "vec_id").alias("vec_id"), "l").filter(F.expr(queries))
    out = out.withColumn("l", F.slice(F.filter("l", lambda e: e["other"] != F.col("vec_id")), 1, k))
    out = out.select("vec_id", F.posexplode("l").alias("pos", "e"))
    return out.select("vec_id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("cosine"), (F.col("pos") + 1).alias("rank"))


def similar_pairs(similar: DataFrame) -> DataFrame:
    """Pairs vec_a < vec_b of which at least one is in the other's list."""
    return similar.select(F.least("vec_id", "other").alias("vec_a"), F.greatest("vec_id", "other").alias("vec_b")).distinct()
