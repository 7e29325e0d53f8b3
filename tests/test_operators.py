"""Invariants of the curation operators on small tables, edge rows included."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import assets as A
from tessera.operators import geometry as G
from tessera.operators import people as P
from tessera.operators import policy
from tessera.operators import quality as Q
from tessera.operators import selection as S
from tessera.operators import state as T
from tessera.params import CurationParams, resolve_strategy
from tessera.plans.components import connected_components
from tessera.plans.curate import curate, curate_smart
from tessera.plans.ranking import rank_in_group


def test_people(spark):
    rows = [("a", " Ann ", 3), ("b", "Ann", 3), ("c", "Ann", None), ("d", "ann", 1), ("e", None, 2), ("f", "  ", 9), (None, "Bob", 1)]
    p = spark.createDataFrame(rows, "person_id string, name string, asset_count int")
    assert P.valid_people(p).count() == 4
    assert [(r.name, r.n) for r in P.duplicate_names(p).collect()] == [("Ann", 3)]
    assert {(r.survivor, r.merged) for r in P.merge_map(p).collect()} == {("a", "b"), ("a", "c")}
    assert {r.person_id for r in P.keep_largest(p).collect()} == {"a", "d", "e", "f", None}
    again = P.rekey(p, P.merge_map(p))
    assert sorted(r.person_id or "" for r in again.collect()) == ["", "a", "a", "a", "d", "e", "f"]
    assert P.listed_people(p, []).count() == 7 and P.listed_people(p, ["BOB"]).count() == 1 and P.listed_people(p, ["bob"], keep=False).count() == 6


def test_recency_needs_an_offset_and_is_strict(spark):
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.001Z", "2024-01-01T01:00:00+01:00", "2024-01-01", "2024-06-01T00:00:00", None, "not-a-date", "2024-13-01T00:00:00Z"]
    a = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "asset_id int, file_created_at string")
    kept = A.recent_assets(a, 1, datetime(2024, 12, 31)).collect()
    assert [r.asset_id for r in kept] == [1]
    assert A.recent_assets(a, 0, datetime(2024, 12, 31)).count() == len(times)


@pytest.mark.parametrize("n,k", [(0, 3), (1, 3), (3, 3), (4, 3), (50, 7), (97, 30), (5, 1), (5, 0)])
def test_time_spread_is_linspace(spark, n, k):
    df = spark.createDataFrame([("p", i) for i in range(n)], "g string, i int")
    got = sorted(r.i for r in A.time_spread(df, "g", [F.col("i")], k).collect())
    want = [] if k <= 0 else list(range(n)) if n <= k else sorted(set(np.linspace(0, n - 1, k, dtype=int).tolist()))
    assert got == want


def test_curate_spreads_over_all_photos_of_a_hot_person(spark):
    n = 5200  # ids run against time: a prefix of the ids would lose the oldest photos
    people = spark.createDataFrame([("p", "Ann")], "person_id string, name string")
    photos = spark.range(n).selectExpr("format_string('%05d', id) AS asset_id", "'p' AS person_id", "date_format(timestamp'2024-06-01' - make_interval(0, 0, 0, 0, 0, id), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS file_created_at")
    faces = spark.createDataFrame([], "face_id bigint, asset_id string, person_id string, x1 int, y1 int, x2 int, y2 int, confidence double")
    seen = spark.createDataFrame([], "person string, asset_id string, seq bigint")
    got = sorted(int(r.asset_id) for r in curate(people, photos, faces, seen, CurationParams(), datetime(2025, 1, 1), 10).collect())
    assert got == sorted(n - 1 - i for i in np.linspace(0, n - 1, 10, dtype=int).tolist())


def test_state_fold_is_idempotent(spark):
    log = spark.createDataFrame([("p", "a", 1, 0.5), ("p", "a", 3, None), ("p", "a", 2, 0.7), ("", "a", 1, 1.0), (None, "b", 1, 1.0)], "person string, asset_id string, seq bigint, score double")
    one, two = (sorted(map(tuple, T.fold_marks(x, ["score"]).collect())) for x in (log, log.union(log)))
    assert one == two == [("p", "a", 0.7, 1, 3)]


def test_files_and_targets(spark):
    f = spark.createDataFrame([("p", "p_1.webp", "a", 1), ("p", "p_2.webp", "a", 2), ("p", "p_3.webp", "b", 3), ("p", "p_4.webp", "c", 4)], "person string, file_name string, asset_id string, seq bigint")
    s = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("q", "z", 0.1)], "person string, asset_id string, score double")
    m = T.mapped_scores(f, s)
    assert {r.file_name for r in m.collect()} == {"p_1.webp", "p_3.webp"}
    assert T.extreme_file(m, largest=True).first().file_name == "p_1.webp"
    assert T.extreme_file(m, largest=False, exclude=["p_1.webp"]).first().file_name == "p_3.webp"
    gone = f.filter("file_name = 'p_1.webp' OR file_name = 'p_3.webp'")
    assert {r.asset_id for r in T.scores_after_removal(s, f, gone).collect()} == {"a", "z"}


def test_positional_map_orders_by_number_and_needs_equal_counts(spark):
    u = spark.createDataFrame([("p", "a", 1), ("p", None, 2), ("p", "c", 3), ("q", "d", 1)], "person string, asset_id string, pos int")
    f = spark.createDataFrame([("p", "p_10.webp"), ("p", "p_9.webp"), ("p", "nonumber.webp"), ("q", "q_1.webp"), ("q", "q_2.webp")], "person string, file_name string")
    assert {(r.file_name, r.asset_id) for r in T.positional_map(u, f).collect()} == {("p_9.webp", "a"), ("nonumber.webp", "c")}


def test_geometry(spark):
    b = spark.createDataFrame([(10, 10, 60, 60, 100, 100), (0, 0, 0, 0, 0, None), (None, 5, 40, 45, 100, 100)], "x1 int, y1 int, x2 int, y2 int, image_width int, image_height int")
    rows = G.crop_box(G.scaled(b, 200, 100), 0.5, 200, 100).collect()
    assert (rows[0].x1, rows[0].x2, rows[0].cx1, rows[0].cx2) == (20.0, 120.0, 0, 170)
    assert rows[1].x2 == 0.0 and rows[2].x1 == 0.0


def test_face_found_in_a_crop(spark):
    kind = "asset_id string, person_id string, face_id int, x1 double, y1 double, x2 double, y2 double"
    chosen = spark.createDataFrame([("a", "p", 1, 10.0, 10.0, 30.0, 30.0), ("b", "p", 2, 0.0, 0.0, 20.0, 20.0), ("c", "p", 3, None, 0.0, 9.0, 9.0), (None, "p", 4, 1.0, 1.0, 9.0, 9.0)], kind)
    boxes = [("a", 5, 12, 12, 30, 30), ("a", 6, 11, 13, 30, 30), ("a", 7, 60, 60, 90, 90), ("a", 8, 20, 20, 20, 20), ("b", 9, 8, 8, 20, 20), ("b", 10, 0, 0, 18, 22), (None, 11, 1, 1, 9, 9)]
    found = spark.createDataFrame([(a, f, *map(float, b)) for a, f, *b in boxes], "asset_id string, face_id int, x1 double, y1 double, x2 double, y2 double")
    got = {r.face_id: r.found for r in G.in_crop(chosen, found, 0.5, 100, 100, False).collect()}
    # 5 and 6 are two off in all: the smaller id; in the clipped crop of b the centre is (15, 15)
    assert got == {1: 5, 2: 9, 3: None, 4: None}
    assert {r.face_id: r.found for r in G.in_crop(chosen, found, 0.0, 100, 100, True).collect()}[2] == 10


def test_laplacian_and_reasons(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (8, 8)).astype(float)
    p = np.pad(img, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * img
    df = spark.createDataFrame([(img.ravel().tolist(),), ([7.0] * 64,)], "g array<double>")
    got = [r.v for r in df.select(Q.laplacian_variance(F.col("g"), 8, 8).alias("v")).collect()]
    assert got[0] == pytest.approx(lap.var()) and got[1] == 0
    m = spark.createDataFrame([(1.0, 1.0, 10.0, 0.1, 10), (None, None, None, None, None), (500.0, 50.0, 100.0, 0.9, 90)], "a double, b double, c double, d double, e int")
    why = [r.w for r in m.select(Q.reasons(*(F.col(c) for c in "abcde"), min_blur=100).alias("w")).collect()]
    assert why == [["blurred", "grey", "too dark", "low confidence", "small face"], [], []]


def _vectors(spark, x, person=0):
    rows = [(person, i, i + 1, 0.9, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "person_id int, asset_id bigint, rank int, confidence double, embedding array<double>")


def test_dedup_forms_agree_and_are_maximal(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 16))
    x[30:40] = x[:10] + 0.05 * rng.standard_normal((10, 16))
    v = _vectors(spark, x)
    kept = sorted(r.asset_id for r in S.dedup_grouped(v, 0.3).collect())
    assert kept == sorted(r.asset_id for r in S.dedup_by_rounds(v, 0.3).collect())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    assert all(d[i, j] >= 0.3 for i in kept for j in kept if i < j)
    assert all(any(k < i and d[i, k] < 0.3 for k in kept) for i in range(60) if i not in kept)


def test_selection_invariants(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 8))
    got = S.select_representatives(_vectors(spark, x), 12).collect()
    assert len(got) == 12 == len({r.asset_id for r in got})
    assert S.select_representatives(_vectors(spark, x), 0).count() == 0
    same = np.tile(x[:1], (10, 1)) + 1e-4 * rng.standard_normal((10, 8))
    assert S.select_representatives(_vectors(spark, same), None).count() <= 5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    seeds = S.farthest_first(d, 6)
    assert d[:, S.swap_medoids(d, seeds)].min(1).sum() <= d[:, seeds].min(1).sum() + 1e-9
    order = S.spread_out(d, seeds[:1], 15, np.ones(40))
    gaps = [d[p, order[:i]].min() for i, p in enumerate(order) if i]
    assert all(a >= b - 1e-12 for a, b in zip(gaps, gaps[1:]))


def test_swaps_follow_the_seeded_draws():
    rng = np.random.default_rng(7)
    for n, k in ((5, 2), (30, 5), (60, 7), (4, 4), (1, 1)):
        x = rng.standard_normal((n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - x @ x.T
        start = S.farthest_first(d, k)
        # the plain way: every drawn swap is tried by computing its whole cost
        draws, now, going = np.random.default_rng(42), list(start), 50
        total = lambda m: sum(min(d[i, j] for j in m) for i in range(n))
        while going:
            going -= 1
            rest = [i for i in range(n) if i not in now]
            found = None
            for place in range(k if rest else 0):
                for c in draws.choice(rest, size=min(10, len(rest)), replace=False):
                    new = now[:place] + [int(c)] + now[place + 1 :]
                    if found is None and total(new) < total(now) - 1e-12:
                        found = new
                if found:
                    break
            if not found:
                break
            now = found
        assert S.swap_medoids(d, start) == now


def test_threshold_of_a_sample(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((230, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    some = u[np.random.default_rng(42).choice(230, 200, replace=False)]
    want = np.median([1 - a @ b for i, a in enumerate(some) for b in some[:i]])
    got = S.thresholds(_vectors(spark, x)).first()
    assert got.median_distance == pytest.approx(want) and got.threshold == pytest.approx(max(0.05, 0.2 * want))
    assert S.adaptive_threshold(u[:1]) == (None, 0.05) and S.thresholds(_vectors(spark, x[:1])).count() == 0


def test_a_person_with_half_the_rows_changes_nothing(spark):
    rng = np.random.default_rng(11)
    rows = [(int(p), int(i)) for p, i in zip(np.where(rng.random(3000) < 0.5, 1, rng.integers(2, 60, 3000)), rng.permutation(3000))]
    df = spark.createDataFrame(rows, "person_id int, asset_id bigint").repartition(7)
    by = {}
    for p, i in rows:
        by.setdefault(p, []).append(i)
    got = {}
    for r in A.time_spread(df, "person_id", [F.col("asset_id")], 20).collect():
        got.setdefault(r.person_id, []).append(r.asset_id)
    want = {p: sorted(v) if len(v) <= 20 else [sorted(v)[j] for j in sorted(set(np.linspace(0, len(v) - 1, 20, dtype=int)))] for p, v in by.items()}
    assert {p: sorted(v) for p, v in got.items()} == want
    assert {(r.person_id, r.asset_id) for r in A.capped(df, 33).collect()} == {(p, i) for p, v in by.items() for i in sorted(v)[:33]}


def test_curate_smart(spark):
    rng = np.random.default_rng(5)
    when = lambda i: f"2024-01-{i % 28 + 1:02d}T00:00:{i % 60:02d}Z"
    photos = [(f"a{i:03d}", "ann", when(i)) for i in range(40)] + [(f"b{i}", "bob", when(i)) for i in range(3)] + [(f"c{i:02d}", "cy", when(i)) for i in range(20)] + [(f"d{i:02d}", "di", when(i)) for i in range(12)]
    x = rng.standard_normal((40, 8))
    x[20:] = x[:20] + 0.01 * rng.standard_normal((20, 8))  # every look twice, the second time sharper
    vecs = [(f"a{i:03d}", v.tolist(), 1.0 if i < 20 else 2.0) for i, v in enumerate(x)] + [("a000", [float("nan")] * 8, 9.0), ("b0", [1.0] * 8, 1.0), ("c00", [0.0] * 8, 1.0), ("c01", [1.0] * 9, 1.0), ("c02", None, 1.0)]
    vecs += [(f"d{i:02d}", rng.standard_normal(8).tolist(), 1.0) for i in range(4)]
    people = spark.createDataFrame([(p, p) for p in ("ann", "bob", "cy", "di")], "person_id string, name string")
    ap = spark.createDataFrame(photos, "asset_id string, person_id string, file_created_at string")
    faces = spark.createDataFrame([(1, "a039", "ann", 0, 0, 10, 10, float("nan"))], "face_id bigint, asset_id string, person_id string, x1 int, y1 int, x2 int, y2 int, confidence double")
    seen = spark.createDataFrame([], "person string, asset_id string, seq bigint")
    v = spark.createDataFrame(vecs, "asset_id string, embedding array<double>, quality double")
    run = lambda limit: curate_smart(people, ap, faces, seen, v, CurationParams(), datetime(2025, 1, 1), limit, dims=8).collect()
    got = {}
    for r in run(8):
        got.setdefault((r.person_id, r.way), set()).add(r.asset_id)
    assert got["bob", "all"] == {"b0", "b1", "b2"} and len(got["cy", "time"]) == 8
    assert got["di", "smart"] == {f"d{i:02d}" for i in range(4)}  # fewer vectors than wanted: all of them
    # the face of a039 is too small; of each look the sharper photo stays
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = [i for i in range(20, 39)] + list(range(20))
    kept = []
    for i in order:
        if all(u[i] @ u[j] <= 0.8 for j in kept):
            kept.append(i)
    want = S.representatives(u[kept], np.full(len(kept), np.nan), 8)[0]
    assert got["ann", "smart"] == {f"a{kept[i]:03d}" for i in want}
    assert len([r for r in run(None) if r.person_id == "ann"]) <= 5 and run(0) == []


def _admitted(spark, cand, held, **kw):
    c = spark.createDataFrame(cand, "person int, file_name string, score double, blur double, match string, accepted boolean")
    g = spark.createDataFrame(held, "person int, file_name string, score double, blur double, seq int, locked boolean")
    return {(r.person, r.file_name): (r.action, r.reason, r.target_file) for r in policy.admit(c, g, capacity=2, **kw).collect()}


def test_admission(spark):
    held = [(1, "g1", 0.8, 1.0, 1, False), (1, "g2", 0.6, 1.0, 2, False)]
    cand = [(1, "0.jpg", 0.2, 10.0, "1", None), (1, "1.jpg", 0.9, 10.0, None, None), (1, "10.jpg", None, 10.0, None, None), (1, "11.jpg", 0.1, 10.0, "2", None), (2, "0.jpg", 0.5, 5.0, None, None)]
    log = _admitted(spark, cand, held)
    assert log[1, "0.jpg"] == ("replace", "less redundant", "g1") and log[1, "1.jpg"] == ("skip", "not better", None)
    assert log[1, "10.jpg"] == ("skip", "no score", None) and log[1, "11.jpg"] == ("skip", "no score", None)
    assert log[2, "0.jpg"] == ("add", "below capacity", None)
    assert _admitted(spark, cand[:1], held, replacement=False)[1, "0.jpg"] == ("skip", "replacement off", None)
    assert _admitted(spark, cand[:1], held, scoring=False)[1, "0.jpg"] == ("replace", "sharper", "g1")
    assert policy.failure_kind(400, "No FACE found") == "permanent" and policy.failure_kind(500, "oops") == "transient"


def test_admission_after_an_upload_with_a_score_only_scores_count(spark):
    held = [(1, "g1", None, 1.0, 1, False)]
    log = _admitted(spark, [(1, "a", 0.5, 5.0, None, None), (1, "b", 0.1, 9.0, None, None)], held)
    assert log == {(1, "a"): ("add", "below capacity", None), (1, "b"): ("skip", "no target", None)}


def test_admission_with_failures(spark):
    held = [(1, "g1", None, 1.0, 1, True), (1, "g2", None, 2.0, 2, False)]
    cand = [(1, "a", None, 5.0, None, True), (1, "b", None, 5.0, None, False), (1, "c", None, 5.0, None, True), (2, "a", None, None, None, False), (2, "b", None, None, None, True)]
    log = _admitted(spark, cand, held)
    assert log[1, "a"] == ("skip", "delete failed", "g1") and log[1, "b"] == ("lost", "sharper", "g2") and log[1, "c"] == ("skip", "no target", None)
    assert log[2, "a"] == ("failed", "below capacity", None) and log[2, "b"] == ("add", "below capacity", None)


@pytest.mark.parametrize("args,want", [(("skip",), (0, "skip")), (("auto",), (None, "smart")), (("standard",), (30, "smart")), (("broad", "0"), (100, "smart")), (("what",), (None, "smart")), (("auto", "12"), (12, "smart")), (("auto", "x", False), (30, "time")), (("auto", 7, False), (7, "time"))])
def test_strategy(args, want):
    assert resolve_strategy(*args) == want


def test_components_and_ranks(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (200, 200), (None, 1)]
    got = {r.id: r.comp for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    rows = [("hot", i * 7919 % 1000) for i in range(1000)] + [("b", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int")
    ranked = rank_in_group(df, "g", [F.col("v").asc()]).collect()
    assert all(r.rank == r.v + 1 for r in ranked if r.g == "hot") and sorted(r.rank for r in ranked if r.g is None) == [1, 2]
