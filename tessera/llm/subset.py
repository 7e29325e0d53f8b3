"""Choosing a varied subset: tournament-pivoted rank-revealing QR over vectors as feature rows.

Round by round, every partition nominates the rows that a row-pivoted QR takes first (largest residual against those
taken before), neighbouring partitions' nominees meet in pairs and are pivoted again, up a binary tree, until one node
holds the round's choice. The next round works on deflated rows: each row loses its component along the chosen row it
is most similar to, so shots of a chosen face have little left to offer, and the rank never runs out.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.ids import canonical_uuid
from tessera.llm.vectors import DIMS, groups_of, pack, unit, unpack, usable_mask
from tessera.plans.lineage import cut, release

#: Rows chosen per round (pass over the data) at most: half of the dimensions, where pivots are still far from each other's span.
PER_ROUND = 256
#: Rows pivoted at once inside a partition.
CHUNK = 8192
#: The chosen rows of all requests go to every task: that many at most (2 KB each).
MAX_CHOSEN = 65_536


def eligible_vectors(vectors: DataFrame, faces: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, vec and conf (best confidence in 0..1 of the asset's faces, NULL if none) of the usable vectors.

    NULL, NaN, negative and greater confidences do not count. Ids are compared in canonical spelling.
    """
    ok = faces.select(canonical_uuid(F.col("asset_id")).alias("asset"), "confidence").filter("confidence >= 0 AND confidence <= 1 AND NOT isnan(confidence)")
    best = ok.groupBy("asset").agg(F.max("confidence").alias("conf")).filter("asset IS NOT NULL")
    source = vectors.select("vec_id", canonical_uuid(F.col("asset_id")).alias("asset"), "embedding").filter((F.size("embedding") == dims) & F.col("vec_id").isNotNull())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = usable_mask(batch, dims)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(keep), batch.column("asset").filter(keep), pa.array(pack(x[ok]), pa.binary())], ["vec_id", "asset", "vec"])

    packed = source.mapInArrow(rows, "vec_id bigint, asset string, vec binary")
    return packed.join(best, "asset", "left").select("vec_id", "vec", "conf")


def deflate(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Unit rows without their component along the most similar chosen row."""
    if not len(chosen):
        return x.copy()
    out = np.empty_like(x)
    for i in range(0, len(x), 2048):
        sims = x[i : i + 2048] @ chosen.T
        best = np.abs(sims).argmax(1)
        out[i : i + 2048] = x[i : i + 2048] - sims[np.arange(len(sims)), best][:, None] * chosen[best]
    return out


def pivots(y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k rows that a row-pivoted QR takes from y, and their residual norms; ties go to the earlier row."""
    left = np.einsum("ij,ij->i", y, y)
    basis, order, size = np.zeros((min(k, len(y)), y.shape[1]), np.float32), [], []
    for n in range(min(k, len(y))):
        p = int(np.argmax(left))
        q = y[p] - basis[:n].T @ (basis[:n] @ y[p])
        norm = float(np.sqrt(q @ q))
        order.append(p), size.append(norm)
        left[p] = -1
        if norm > 1e-5:
            basis[n] = q / norm
            taken = left < 0
            left = np.maximum(left - (y @ basis[n]) ** 2, 0)
            left[taken] = -1
    return np.array(order, np.int64), np.array(size)


def _best(ids: np.ndarray, x: np.ndarray, chosen: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nominees among unit rows x: ids, rows and residuals; ids already chosen and repeats are left out."""
    ids, first = np.unique(ids, return_index=True)
    fresh = ~np.isin(ids, chosen[0])
    ids, x = ids[fresh], x[first[fresh]]
    order, size = pivots(deflate(x, chosen[1]), k)
    return ids[order], x[order], size


def _nominees(request: int, node: int, ids: np.ndarray, x: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    cols = [pa.array(np.full(n, request), pa.int32()), pa.array(np.full(n, node), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(size, pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["request_id", "node", "pos", "vec_id", "row", "residual"])


_SCHEMA = "request_id int, node int, pos int, vec_id bigint, row binary, residual double"


def varied_subsets(vectors: DataFrame, faces: DataFrame, requests: DataFrame, dims: int = DIMS, per_round: int = PER_ROUND) -> DataFrame:
    """For every request the chosen vectors: request_id, rank (order of choice), vec_id, residual.

    A vector is admitted to a request if its asset's best confidence reaches ``min_confidence``; without a valid
    confidence it is admitted only where nothing is demanded (NULL or at most 0). A request gets ``subset_size``
    vectors, or all admitted ones if they are fewer; NULL and negative sizes get none. Vectors of equal content are
    chosen only when nothing else is left. Repeated rows count once. Empty tables give no rows; other columns are
    ignored. What reaches the driver and every task are the requests and the chosen rows, ``MAX_CHOSEN`` at most: more are
    refused with an error. An asset's confidences all count for each of its vectors.
    """
    spark = vectors.sparkSession
    wanted = {r.request_id: (r.subset_size or 0, r.min_confidence or 0.0) for r in requests.select("request_id", "subset_size", "min_confidence").filter("request_id IS NOT NULL AND subset_size > 0").distinct().collect()}
    if sum(size for size, _ in wanted.values()) > MAX_CHOSEN:
        raise ValueError(f"requests for more than {MAX_CHOSEN} vectors have to be split")
    data = cut(eligible_vectors(vectors, faces, dims))
    nodes = data.rdd.getNumPartitions()
    chosen = {r: (np.empty(0, np.int64), np.empty((0, dims), np.float32)) for r in wanted}
    result: list[tuple[int, int, int, float]] = []
    while wanted:
        jobs = {r: (min(per_round, wanted[r][0] - len(chosen[r][0])), wanted[r][1], chosen[r]) for r in wanted}
        jobs = {r: j for r, j in jobs.items() if j[0] > 0}
        if not jobs:
            break
        shared = spark.sparkContext.broadcast(jobs)

        def nominate(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = {r: (np.empty(0, np.int64), np.empty((0, dims), np.float32), np.empty(0)) for r in shared.value}
            for batch in batches:
                for a in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(a, CHUNK)
                    ids, x = part.column("vec_id").to_numpy(), unit(unpack(part.column("vec"), dims))
                    conf = part.column("conf").to_numpy(zero_copy_only=False).astype(np.float64)
                    for r, (k, least, done) in shared.value.items():
                        ok = np.where(np.isnan(conf), least <= 0, conf >= least)
                        held[r] = _best(np.concatenate([held[r][0], ids[ok]]), np.concatenate([held[r][1], x[ok]]), done, k)
            node = TaskContext.get().partitionId()
            for r, h in held.items():
                if len(h[0]):
                    yield _nominees(r, node, *h)

        def meet(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for t in groups_of(batches, "g"):
                r, node = t["request_id"][0].as_py(), t["node"][0].as_py()
                k, _, done = shared.value[r]
                x = np.frombuffer(b"".join(t["row"].to_pylist()), np.float32).reshape(-1, dims)
                yield _nominees(r, node, *_best(t["vec_id"].to_numpy(), x, done, k))

        tree, width = data.mapInArrow(nominate, _SCHEMA), nodes
        while width > 1:
            width = (width + 1) // 2
            tree = tree.withColumn("node", F.floor(F.col("node") / 2).cast("int")).withColumn("g", F.concat_ws(":", "request_id", "node"))
            tree = tree.repartition(min(width * len(jobs), nodes), "g").sortWithinPartitions("g", "vec_id").mapInArrow(meet, _SCHEMA)
        got: dict[int, list] = {r: [] for r in jobs}
        for row in tree.collect():
            got[row.request_id].append(row)
        for r, rows in got.items():
            rows.sort(key=lambda row: row.pos)
            have = len(chosen[r][0])
            result += [(r, have + i + 1, row.vec_id, round(row.residual, 4)) for i, row in enumerate(rows)]
            ids = np.concatenate([chosen[r][0], np.array([row.vec_id for row in rows], np.int64)])
            x = np.concatenate([chosen[r][1], *(np.frombuffer(row.row, np.float32)[None] for row in rows)])
            chosen[r] = (ids, x)
            if len(rows) < jobs[r][0]:
                wanted.pop(r)
        release(spark)
    return spark.createDataFrame(result, "request_id int, rank int, vec_id bigint, residual double")
