"""Calls to a server from the executors, and the embedding cache as a sink."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.policy import failure_kind
from tessera.sources.state_store import StateStore

CACHE = "cache_key string, embedding array<float>"


def delivered(rows: DataFrame, key: str, send: Callable[[dict], tuple[int, str]], attempts: int = 3) -> DataFrame:
    """key, ok, kind, status, tries of sending every row (for uploads and deletes alike).

    ``send`` gets a row as a dict and gives (status, body); 200 is success. Everything else and any exception is tried
    again up to ``attempts`` times. kind is ``ok``, ``permanent`` (never to be offered again), ``transient`` or
    ``network`` for exceptions. A lost executor repeats its rows, so ``send`` has to be idempotent by the key; keep the
    result (a table or checkpoint) before anything reads it twice.
    """
    names = rows.columns
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for values in f.itertuples(index=False, name=None):
                row, kind, status, tries = dict(zip(names, values)), "network", None, 0
                while tries < attempts and kind != "ok":
                    tries += 1
                    try:
                        status, body = send(row)
                        kind = "ok" if status == 200 else failure_kind(status, body)
                    except Exception:
                        kind, status = "network", None
                out.append((row[key], kind == "ok", kind, status, tries))
            yield pd.DataFrame(out, columns=[key, "ok", "kind", "status", "tries"]).astype({"status": "Int32"})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, ok boolean, kind string, status int, tries int")


class EmbeddingCache:
    """Vectors by key in a versioned store: what is there stays, new keys are added, all of it can be cleared."""

    def __init__(self, store: StateStore):
        self.store = store

    def read(self) -> DataFrame:
        return self.store.read(CACHE)

    def put(self, vectors: DataFrame) -> None:
        """Adds the vectors (cache_key, embedding) whose key is new; of several with one key the least stays. NULL keys are left out."""
        fresh = vectors.filter("cache_key IS NOT NULL AND embedding IS NOT NULL")
        fresh = fresh.groupBy("cache_key").agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))
        self.store.update(CACHE, lambda old: old.unionByName(fresh.join(old.select("cache_key"), "cache_key", "left_anti")))

    def clear(self) -> None:
        self.store.update(CACHE, lambda old: old.limit(0))
