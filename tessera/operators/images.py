"""Pixel work on decoded images: capped sharpness, aligned crops, crop files."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest side at which sharpness is measured.
MOST_PIXELS = 1440
#: Side of an aligned face, and (fixed values) where eyes, nose and mouth corners lie in it by public convention.
ALIGNED = 112
TEMPLATE = np.array([[38.2946, 51.6963], [73.5318, 51.5014], [56.0252, 71.7366], [41.5493, 92.3655], [70.7299, 92.2041]])


def pixels(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Grey levels or colours (blue, green, red order) of a decoded image as float64."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.float64)


def grey_plane(img: np.ndarray) -> np.ndarray:
    """Luma of a BGR(A) image; the plane of a single-channel one."""
    return img[..., 0] if img.shape[2] < 3 else img[..., :3] @ np.array([0.114, 0.587, 0.299])


def shrink(plane: np.ndarray, most: int = MOST_PIXELS) -> np.ndarray:
    """The plane at no more than ``most`` pixels a side, by averages of equal areas (an approximation of windowed resampling)."""
    for axis in (0, 1):
        n = plane.shape[axis]
        if max(plane.shape) > most and n > 1:
            target = max(1, round(n * most / max(plane.shape)) if axis == 0 else round(n * most / max(n, most)))
            edges = np.linspace(0, n, target + 1).astype(int)
            sums = np.add.reduceat(plane, edges[:-1], axis=axis)
            plane = sums / np.diff(edges).reshape((-1, 1) if axis == 0 else (1, -1))
    return plane


def laplacian_variance(plane: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian with mirrored borders."""
    p = np.pad(plane, 1, mode="reflect") if min(plane.shape) > 1 else np.pad(plane, 1, mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * plane).var())


def blur_scores(images: DataFrame) -> DataFrame:
    """origin and blur (sharpness at a capped size) of decoded images; NULL where the pixels cannot be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, h, w, c in zip(f["data"], f["height"], f["width"], f["n_channels"]):
                try:
                    out.append(laplacian_variance(shrink(grey_plane(pixels(d, h, w, c)))))
                except (ValueError, TypeError):
                    out.append(None)
            yield pd.DataFrame({"origin": f["origin"], "blur": pd.array(out, "Float64").to_numpy(object)})

    return images.select("origin", "height", "width", "n_channels", "data").mapInPandas(run, "origin string, blur double")


def similarity(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The 2 x 3 map (scale, rotation, shift) that takes points nearest to ``to`` in least squares (Umeyama 1991)."""
    a, b = points - points.mean(0), to - to.mean(0)
    u, s, vt = np.linalg.svd(b.T @ a / len(a))
    d = np.array([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    r = u @ np.diag(d) @ vt
    scale = (s * d).sum() / a.var(0).sum()
    return np.hstack([scale * r, (to.mean(0) - scale * r @ points.mean(0))[:, None]])


def aligned(img: np.ndarray, landmarks) -> np.ndarray | None:
    """The face of 5 x 2 landmarks warped to the public template (bilinear); None for other shapes or no extent."""
    fits = landmarks is not None and len(landmarks) == 5 and all(q is not None and len(q) == 2 for q in landmarks)
    p = np.array([list(q) for q in landmarks], np.float64) if fits else None
    if p is None or not np.isfinite(p).all() or p.var(0).sum() < 1e-9:
        return None
    m = similarity(p, TEMPLATE)
    back = np.linalg.inv(np.vstack([m, [0, 0, 1]]))
    y, x = np.mgrid[:ALIGNED, :ALIGNED]
    sx, sy = (back[i, 0] * x + back[i, 1] * y + back[i, 2] for i in (0, 1))
    h, w = img.shape[:2]
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    out = np.zeros((ALIGNED, ALIGNED, img.shape[2]))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = x0 + dx, y0 + dy
            inside = (xi >= 0) & (xi < w) & (yi >= 0) & (yi < h)
            weight = (1 - np.abs(sx - xi)) * (1 - np.abs(sy - yi)) * inside
            out += weight[..., None] * img[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def aligned_faces(images: DataFrame) -> DataFrame:
    """origin and crop (bytes of a 112 x 112 face, NULL if it cannot be aligned); images carry ``landmarks``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, h, w, c, lm in zip(f["data"], f["height"], f["width"], f["n_channels"], f["landmarks"]):
                face = aligned(pixels(d, h, w, c), lm)
                out.append(None if face is None else face.tobytes())
            yield pd.DataFrame({"origin": f["origin"], "crop": out})

    return images.select("origin", "height", "width", "n_channels", "data", "landmarks").mapInPandas(run, "origin string, crop binary")


def write_crops(crops: DataFrame, path: str) -> None:
    """Crops as a table partitioned by a hash of the person, so that no name becomes a path."""
    bucket = F.pmod(F.xxhash64("person"), F.lit(256)).alias("bucket")
    crops.select("*", bucket).write.mode("append").partitionBy("bucket").parquet(path)


def safe_name(c: Column) -> Column:
    """Whether a person's name may stand in a path: no separators, no step up, not blank, not hidden."""
    s = F.trim(c)
    return F.coalesce((s != "") & ~s.rlike(r"[/\\\x00]") & ~s.startswith("."), F.lit(False))


def version_at_least(c: Column, minimum: str) -> Column:
    """Whether a version text such as ``v1.132.3`` is not below a minimum, number by number; NULL for other texts."""
    numbers = F.transform(F.split(F.regexp_extract(c, r"(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))
    least = F.array(*(F.lit(int(x)) for x in minimum.split(".")))
    return F.when(c.rlike(r"\d"), numbers >= least)
