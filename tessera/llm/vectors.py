"""Usable vectors, their lossless compact form, and the arithmetic shared by the vector operators."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 512
MIN_NORM = 1e-6


def candidates_of(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id and embedding of the rows with an id and exactly ``dims`` entries; the rest of the test needs the values."""
    return df.select("vec_id", "embedding").filter((F.size("embedding") == dims) & F.col("vec_id").isNotNull())


def usable_mask(batch: pa.RecordBatch, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are finite (NULL entries are not) and not shorter than ``MIN_NORM``, and all rows as float32."""
    col = batch.column("embedding")
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(col), dims)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return np.isfinite(x).all(1) & (norm >= MIN_NORM), x


def usable_rows(batch: pa.RecordBatch, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of the usable ones, see :func:`usable_mask`."""
    ok, x = usable_mask(batch, dims)
    return batch.column("vec_id").to_numpy(zero_copy_only=False)[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, as float32."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
    return (x / np.maximum(norm, 1e-300)[:, None]).astype(np.float32)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in two bytes an entry where float16 holds it exactly, else in four; the length tells which."""
    with np.errstate(over="ignore"):
        half = x.astype(np.float16)
    exact = (half.astype(np.float32) == x).all(1)
    return [half[i].tobytes() if e else x[i].tobytes() for i, e in enumerate(exact)]


def unpack(col: pa.Array, dims: int = DIMS) -> np.ndarray:
    """The float32 rows of :func:`pack`."""
    out = np.empty((len(col), dims), np.float32)
    for i, b in enumerate(col.to_pylist()):
        out[i] = np.frombuffer(b, np.float16 if len(b) == 2 * dims else np.float32)
    return out


def packed_vectors(df: DataFrame, dims: int = DIMS) -> DataFrame:
    """Usable vectors as vec_id, vec (see :func:`pack`). Other rows, other columns and empty tables give nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = usable_rows(batch, dims)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pack(x), pa.binary())], ["vec_id", "vec"])

    return candidates_of(df, dims).mapInArrow(rows, "vec_id bigint, vec binary")


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows of equal ``key`` as tables, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
