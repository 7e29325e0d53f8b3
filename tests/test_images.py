import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images as I
from tessera.sources.gallery import images


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + r.tobytes() for r in rgb)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_blur_scores_of_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    noisy, flat = rng.integers(0, 256, (40, 50, 3), dtype=np.uint8), np.full((40, 50, 3), 128, np.uint8)
    png(tmp_path / "noisy.png", noisy)
    png(tmp_path / "flat.png", flat)
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = {r.origin.rsplit("/", 1)[1]: r.blur for r in I.blur_scores(images(spark, str(tmp_path))).collect()}
    want = I.laplacian_variance(noisy.astype(float) @ np.array([0.299, 0.587, 0.114]))
    assert set(got) == {"noisy.png", "flat.png"}
    assert got["noisy.png"] == pytest.approx(want) and got["flat.png"] == pytest.approx(0, abs=1e-9)


def test_large_planes_are_shrunk():
    p = I.shrink(np.ones((3000, 100)))
    assert p.shape[0] == 1440 and np.allclose(p, 1)
    assert I.shrink(np.ones((100, 200))).shape == (100, 200)


def test_alignment_moves_landmarks_to_the_template():
    lm = I.TEMPLATE @ np.array([[0.0, 2.0], [-2.0, 0.0]]) + [300, 20]
    m = I.similarity(lm, I.TEMPLATE)
    assert np.allclose(np.hstack([lm, np.ones((5, 1))]) @ m.T, I.TEMPLATE)
    same = I.aligned(np.arange(112 * 112 * 3).reshape(112, 112, 3) % 251, I.TEMPLATE)
    assert np.array_equal(same, np.arange(112 * 112 * 3).reshape(112, 112, 3) % 251)
    assert I.aligned(same, None) is None and I.aligned(same, [[1, 1]] * 4) is None and I.aligned(same, [[1, 1]] * 5) is None


def test_aligned_faces_and_crops(spark, tmp_path):
    img = np.full((112, 112, 3), 9, np.uint8)
    rows = [("a", 112, 112, 3, bytearray(img.tobytes()), I.TEMPLATE.tolist()), ("b", 112, 112, 3, bytearray(img.tobytes()), None)]
    df = spark.createDataFrame(rows, "origin string, height int, width int, n_channels int, data binary, landmarks array<array<double>>")
    got = {r.origin: r.crop for r in I.aligned_faces(df).collect()}
    assert got["b"] is None and bytes(got["a"]) == img.tobytes()
    I.write_crops(spark.createDataFrame([("../x", bytearray(b"1"))], "person string, crop binary"), str(tmp_path / "crops"))
    assert spark.read.parquet(str(tmp_path / "crops")).count() == 1


def test_names_and_versions(spark):
    df = spark.createDataFrame([("Ann",), ("../up",), ("a/b",), (" ",), (None,), (".hid",)], "n string")
    assert [r.s for r in df.select(I.safe_name(F.col("n")).alias("s")).collect()] == [True, False, False, False, False, False]
    v = spark.createDataFrame([("v1.132.3",), ("1.9",), ("1.132",), ("none",), (None,)], "v string")
    assert [r.s for r in v.select(I.version_at_least(F.col("v"), "1.132").alias("s")).collect()] == [True, False, True, None, None]
