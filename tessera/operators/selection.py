"""Near-duplicate removal and representative selection within a person's candidates."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.assets import time_spread
from tessera.operators.vectors import within_person_pairs
from tessera.plans.lineage import cut, release


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


def dedup_grouped(vectors: DataFrame, distance: float) -> DataFrame:
    """person_id, asset_id, rank of what a greedy pass by rank keeps: nothing nearer than ``distance`` to one kept.

    One group is one task, so ``vectors`` has to be a candidate pool (:func:`pooled`); :func:`dedup_by_rounds` keeps the
    same rows without that.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        x, kept = _matrix(pdf), []
        for i in range(len(x)):
            if not kept or (x[kept] @ x[i]).max() <= 1 - distance:
                kept.append(i)
        return pdf.loc[kept, ["person_id", "asset_id", "rank"]]

    return vectors.groupBy("person_id").applyInPandas(keep, "person_id int, asset_id bigint, rank int")


def dedup_by_rounds(vectors: DataFrame, distance: float, max_rounds: int = 100) -> DataFrame:
    """The rows of :func:`dedup_grouped` for groups of any size: rounds over the graph of near pairs.

    The greedy result is the first maximal independent set by rank. In a round every undecided row without an
    undecided better neighbour is kept and its neighbours are dropped; few rounds decide all. Rounds are written to
    the shared folder.
    """
    near = cut(within_person_pairs(vectors).filter(F.col("distance") < distance).select("person_id", "rank_a", "rank_b"))
    nodes = vectors.select("person_id", "asset_id", "rank")
    open_ = cut(near.select("person_id", F.explode(F.array("rank_a", "rank_b")).alias("rank")).distinct())
    edges, lost, key = near, None, ["person_id", "rank"]
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        worse = edges.select("person_id", F.col("rank_b").alias("rank")).distinct()
        keep = open_.join(worse, key, "left_anti")
        kept_a = keep.select("person_id", F.col("rank").alias("rank_a"))
        drop = cut(edges.join(kept_a, ["person_id", "rank_a"], "left_semi").select("person_id", F.col("rank_b").alias("rank")).distinct())
        lost = drop if lost is None else lost.union(drop)
        open_ = cut(open_.join(keep, key, "left_anti").join(drop, key, "left_anti"))
        alive = edges.join(open_.withColumnRenamed("rank", "rank_a"), ["person_id", "rank_a"], "left_semi")
        edges = cut(alive.join(open_.withColumnRenamed("rank", "rank_b"), ["person_id", "rank_b"], "left_semi").select("person_id", "rank_a", "rank_b"))
        release(vectors.sparkSession)
    else:
        raise RuntimeError("near-duplicate rounds did not end")
    return nodes if lost is None else nodes.join(lost, key, "left_anti")


def farthest_first(d: np.ndarray, k: int) -> list[int]:
    """The most central row, then again and again the row farthest from those taken; ties go to the first."""
    taken = [int(np.argmin(np.round(d.sum(1), 9)))]
    gap = d[taken[0]].copy()
    while len(taken) < min(k, len(d)):
        gap[taken] = -np.inf
        taken.append(int(np.argmax(gap)))
        gap = np.minimum(gap, d[taken[-1]])
    return taken


def swap_medoids(d: np.ndarray, medoids: list[int], rounds: int = 50, tries: int = 10, seed: int = 42) -> list[int]:
    """Swaps medoids for random other rows while the cost falls.

    A round goes through the medoids in order, draws up to ``tries`` other rows for each and takes the first that lowers
    the sum of the distances to the nearest medoid; then the next round begins. A round without such a row is the last,
    and so is number ``rounds``.
    """
    rng, now = np.random.default_rng(seed), list(medoids)
    cost = d[:, now].min(1).sum()
    for _ in range(rounds):
        others = np.setdiff1d(np.arange(len(d)), now)
        if not len(others):
            break
        for place in range(len(now)):
            drawn = rng.choice(others, size=min(tries, len(others)), replace=False)
            rest = d[:, now[:place] + now[place + 1 :]].min(1, initial=np.inf)
            costs = np.minimum(rest[:, None], d[:, drawn]).sum(0)
            better = np.flatnonzero(costs < cost)
            if len(better):
                now[place], cost = int(drawn[better[0]]), costs[better[0]]
                break
        else:
            break
    return now


def adaptive_threshold(x: np.ndarray, share: float = 0.2, floor: float = 0.05, sample: int = 200, seed: int = 42) -> tuple[float | None, float]:
    """The median pairwise distance of (a sample of) unit rows, None without pairs, and the threshold: a share of it, the floor at least."""
    if len(x) > sample:
        x = x[np.random.default_rng(seed).choice(len(x), sample, replace=False)]
    pairs = (1 - x @ x.T)[np.triu_indices(len(x), 1)]
    median = float(np.median(pairs)) if len(pairs) else None
    return median, floor if median is None else max(floor, share * median)


def pooled(vectors: DataFrame, cap: int) -> DataFrame:
    """The candidate pool: up to ``cap`` rows per person, evenly spread over ``created`` (ties by asset_id)."""
    return time_spread(vectors, "person_id", [F.col("created").asc_nulls_first(), F.col("asset_id").asc()], cap)


def thresholds(vectors: DataFrame) -> DataFrame:
    """person_id, median_distance, threshold of every person with two vectors or more, from 200 of its vectors at most."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        median, threshold = adaptive_threshold(_matrix(pdf.sort_values("rank")))
        return pd.DataFrame({"person_id": pdf["person_id"][:1], "median_distance": [median], "threshold": [threshold]})

    return vectors.groupBy("person_id").applyInPandas(one, "person_id int, median_distance double, threshold double").filter("median_distance IS NOT NULL")


def spread_out(d: np.ndarray, start: list[int], target: int, weight: np.ndarray, stop: float | None = None) -> list[int]:
    """Adds rows of the largest weighted distance to what is taken until ``target`` are; with ``stop`` ends when the
    row so chosen is nearer than that (unweighted)."""
    taken, gap = list(start), d[:, start].min(1)
    gap[taken] = -np.inf
    while len(taken) < min(target, len(d)):
        p = int(np.argmax(gap * weight))
        if stop is not None and gap[p] < stop:
            break
        taken.append(p)
        gap = np.minimum(gap, d[p])
        gap[taken] = -np.inf
    return taken


def representatives(x: np.ndarray, confidence: np.ndarray, target: int | None, refine: bool = True, max_auto: int = 5) -> tuple[list[int], int]:
    """Rows of x (unit vectors) that represent it, and how many of them, the first ones, are medoids.

    A few clusters give their medoids, then rows are added farthest first with weight on those of low confidence (NaN is
    confident). ``target`` None is automatic: ``max_auto`` rows at most, ending early when the next row is nearer than
    the adaptive threshold.
    """
    n, most = len(x), max_auto if target is None else target
    if n == 0 or most <= 0:
        return [], 0
    d = 1 - x @ x.T
    start = farthest_first(d, min(max(5, most // 4), max(1, n // 3), n, most))
    start = swap_medoids(d, start) if refine else start
    conf = np.nan_to_num(confidence, nan=1.0)
    weight = np.where(conf < 0.85, 1 + (0.85 - conf) * 2, 1.0)
    stop = adaptive_threshold(x)[1] if target is None else None
    return spread_out(d, start, most, weight, stop)[:most], len(start)


def select_representatives(vectors: DataFrame, target: int | None, refine: bool = True, max_auto: int = 5) -> DataFrame:
    """person_id, asset_id, pos, is_medoid: see :func:`representatives`. ``vectors`` has to be a candidate pool.

    Without ``refine`` the medoids are the farthest-first seeds. A target of 0 or less selects nothing.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        got, medoids = representatives(_matrix(pdf), pdf["confidence"].astype(float).to_numpy(), target, refine, max_auto)
        return pd.DataFrame({"person_id": pdf["person_id"][0], "asset_id": pdf["asset_id"].to_numpy()[got], "pos": np.arange(1, len(got) + 1), "is_medoid": np.arange(len(got)) < medoids})

    if target is not None and target <= 0:
        vectors = vectors.limit(0)
    return vectors.groupBy("person_id").applyInPandas(choose, "person_id int, asset_id bigint, pos int, is_medoid boolean")


def curated(pool: DataFrame, limit: int | None, distance: float, max_auto: int = 5) -> DataFrame:
    """person_id, asset_id of what smart selection takes of a candidate pool (person_id, asset_id, quality, confidence,
    embedding; no unusable vectors).

    Near duplicates (nearer than ``distance``) go first, the best quality stays (NULL counts as 0, ties by asset_id); of
    the rest the representatives are taken. A person with fewer vectors than ``limit`` before or after that keeps all it
    has; None is the automatic limit.
    """
    kinds = dict(pool.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["asset_id"].astype(str).to_numpy(), -pdf["quality"].astype(float).fillna(0.0).to_numpy()))
        pdf = pdf.iloc[order].reset_index(drop=True)
        if limit is None or len(pdf) >= limit:
            x, kept = _matrix(pdf), []
            for i in range(len(x)):
                if not kept or (x[kept] @ x[i]).max() <= 1 - distance:
                    kept.append(i)
            pdf, x = pdf.loc[kept].reset_index(drop=True), x[kept]
            if limit is None or len(pdf) >= limit:
                pdf = pdf.loc[representatives(x, pdf["confidence"].astype(float).to_numpy(), limit, True, max_auto)[0]]
        return pdf[["person_id", "asset_id"]]

    return pool.groupBy("person_id").applyInPandas(choose, f"person_id {kinds['person_id']}, asset_id {kinds['asset_id']}")


def embed_missing(items: DataFrame, cache: DataFrame, embed) -> DataFrame:
    """asset_id and embedding: from the cache where it holds the asset, else computed by ``embed``.

    ``items`` has asset_id and payload; ``embed`` turns a pandas Series of payloads into a list of vectors and runs in
    batches on the misses only.
    """
    hit = items.join(cache.select("asset_id", "embedding"), "asset_id").select("asset_id", "embedding")
    missing = items.join(cache.select("asset_id"), "asset_id", "left_anti").select("asset_id", "payload")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"asset_id": f["asset_id"], "embedding": list(embed(f["payload"]))})

    kind = dict(items.dtypes)["asset_id"]
    return hit.unionByName(missing.mapInPandas(run, f"asset_id {kind}, embedding array<float>"))
