import numpy as np
import pytest

from tessera.llm import clusters as C
from tessera.llm import neighbours
from tessera.llm.neighbours import against_all, hilbert_keys, similar_pairs, similar_vectors
from tessera.llm.subset import pivots, varied_subsets
from tessera.llm.vectors import pack, packed_vectors, unpack

SCHEMA = "vec_id bigint, asset_id string, embedding array<float>, comp string, digest int"
rng = np.random.default_rng(4)


def near(x, cos):
    n = rng.standard_normal(x.shape)
    n -= (n * x).sum(-1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=-1, keepdims=True)
    return cos * x + np.sqrt(1 - cos**2) * n


def faces(people=12, shots=4, burst=3):
    rows = []
    for _ in range(people):
        centre = rng.standard_normal(512)
        centre /= np.linalg.norm(centre)
        for _ in range(shots):
            shot = near(centre, 0.78)
            rows += [near(shot, 0.97) for _ in range(burst)]
    return np.array(rows)


def table(spark, x, extra=()):
    rows = [(i, f"00000000-0000-0000-0000-{i:012d}", v.astype(np.float16).astype(float).tolist(), "x", 1) for i, v in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def unusable():
    ok = [0.1] * 512
    return [(9000, "a", None, "", 0), (9001, "a", [], "", 0), (9002, "a", ok[:-1], "", 0), (9003, "a", [float("nan")] + ok[1:], "", 0), (9004, "a", [float("inf")] + ok[1:], "", 0), (9005, "a", [0.0] * 512, "", 0), (9006, "a", [None] + ok[1:], "", 0), (None, "a", ok, "", 0)]


def test_pack_is_lossless():
    x = np.array([[0.5, 1.25], [0.1, 1e-9], [65504, -2.0]], np.float32)
    import pyarrow as pa

    assert (unpack(pa.array(pack(x), pa.binary()), 2) == x).all()


def test_hilbert_visits_every_cell_by_neighbours():
    g = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    k = hilbert_keys(g, 3)
    assert sorted(k) == list(range(512))
    path = g[np.argsort(k)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.fixture(scope="module")
def data(spark):
    x = faces()
    x = np.concatenate([x, np.repeat(x[:1], 14, 0), x[5:6] * 8])  # exact copies and a scaled one
    return x, table(spark, x, unusable()).unionAll(table(spark, x[:5])).cache()


def brute(x, k, floor):
    x = x.astype(np.float16).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:k]
        out |= {(min(i, j), max(i, j)) for j in order if s[i, j] >= floor}
    return out


def test_similar_vectors_against_brute_force(data):
    x, df = data
    got = {(r.vec_a, r.vec_b) for r in similar_pairs(similar_vectors(df, 10, 0.8)).collect()}
    want = brute(x, 10, 0.8)
    assert got == want


def test_candidates_of_large_components_are_reranked(data, monkeypatch):
    x, df = data
    monkeypatch.setattr(neighbours, "TILE", 2)  # every component counts as large
    got = {(r.vec_a, r.vec_b) for r in similar_pairs(similar_vectors(df, 10, 0.8)).collect()}
    want = brute(x, 10, 0.8)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_pairs_do_not_depend_on_the_size_of_components(data, monkeypatch):
    _, df = data
    found = lambda: {(r.vec_a, r.vec_b) for r in similar_pairs(similar_vectors(df, 10, 0.8, margin=-8)).collect()}
    small = found()  # windows keep two candidates a row, which join the components
    monkeypatch.setattr(neighbours, "TILE", 2)
    assert found() == small


def test_asked_vectors_get_k_partners(data):
    x, df = data
    rows = similar_vectors(df, 5, 0.4, queries="vec_id % 7 = 0", rest=True).collect()
    per = {}
    for r in rows:
        per.setdefault(r.vec_id, []).append(r.other)
    assert set(per) == set(range(0, len(x), 7)) and all(len(v) == 5 == len(set(v)) for v in per.values())


def test_exact_blocks(spark):
    x = rng.standard_normal((50, 512))
    packed = packed_vectors(table(spark, x))
    got = {}
    for r in against_all(packed, spark.createDataFrame([(0,), (7,)], "vec_id bigint"), 3).collect():
        got.setdefault(r.vec_id, set()).add(r.other)
    u = x.astype(np.float16).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T - 2 * np.eye(50)
    assert got == {i: set(np.argsort(-s[i])[:3].tolist()) for i in (0, 7)}


def test_clusters(data):
    x, df = data
    rows = C.similarity_clusters(df).collect()
    u = x.astype(np.float16).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.4
    want = {i: int(np.flatnonzero(s[i])[0]) for i in range(len(x))}
    got = {r.vec_id: r.cluster_id for r in rows}
    assert set(got) == set(want)
    assert got == want
    sizes = np.bincount(list(got.values()), minlength=len(x))
    assert all(r["size"] == sizes[r.cluster_id] for r in rows)
    prof = C.cluster_profiles(C.similarity_clusters(df)).collect()
    assert {p.cluster_id: p["size"] for p in prof} == {c: int(n) for c, n in enumerate(sizes) if n}
    assert all(len(p.typical) == min(3, p["size"]) for p in prof)


def test_loose_components_are_split(spark):
    a = rng.standard_normal(512)
    a /= np.linalg.norm(a)
    chain = [a]
    for _ in range(6):
        chain.append(near(chain[-1], 0.75))
    rows = C.similarity_clusters(table(spark, np.array(chain))).collect()
    assert len(rows) == 7 and all(r.cosine >= 0.4 or r.vec_id == r.medoid for r in rows)


def test_small_clusters_of_low_cosine_are_whole(spark):
    x = []
    for size in [3, 4, 5] * 8:
        q = np.linalg.qr(rng.standard_normal((512, size + 1)))[0].T
        x += [np.sqrt(0.43) * q[0] + np.sqrt(0.57) * v for v in q[1:]]  # every pair at 0.43
    rows = C.similarity_clusters(table(spark, np.array(x))).collect()
    first = np.repeat(np.cumsum([0, *([3, 4, 5] * 8)])[:-1], [3, 4, 5] * 8)
    assert {r.vec_id: r.cluster_id for r in rows} == dict(enumerate(first.tolist()))


def test_medoids_are_central(spark, monkeypatch):
    x = []
    for size in [4, 6] * 6:
        q = np.linalg.qr(rng.standard_normal((512, size + 1)))[0].T
        x += [0.75 * q[0] + np.sqrt(1 - 0.75**2) * v for v in q[1:]] + [q[0]]  # the last one is the centre
    ends = np.cumsum([5, 7] * 6) - 1
    want = dict(enumerate(np.repeat(ends, [5, 7] * 6).tolist()))
    df = table(spark, np.array(x))
    assert {r.vec_id: r.medoid for r in C.similarity_clusters(df).collect()} == want
    monkeypatch.setattr(C, "PIECE", 3)
    labels = spark.createDataFrame([(i, int(m)) for i, m in want.items()], "id bigint, comp bigint")
    large = C._settled(labels, packed_vectors(df).withColumnRenamed("vec_id", "id"), 0.4, 512, 25)
    assert {r.id: r.medoid for r in large.collect()} == want


def test_large_buckets_stream_to_their_leaders():
    import pyarrow as pa

    one = rng.integers(0, 2**63, C.MARK // 64).astype(np.uint64)
    mark = np.array([one, ~one, one ^ np.uint64(0x5555555555555555)])  # half of the bits apart at least, as unrelated rows are on average
    which = rng.integers(0, 3, 500)
    ids = np.arange(500)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + 90]), pa.array([mark[w].tobytes() for w in which[i : i + 90]], pa.binary()), pa.array(np.full(len(ids[i : i + 90]), 77))], ["id", "mark", "key"]) for i in range(0, 500, 90)]
    parent = {i: i for i in range(500)}
    for b in C.bucket_links(iter(batches)):
        for p, q in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            assert p > q and which[p] == which[q]
            parent[p] = min(parent[p], q)
    for i in range(500):
        while parent[i] != parent[parent[i]]:
            parent[i] = parent[parent[i]]
    assert len({parent[i] for i in range(500)}) == 3


def test_candidates_do_not_depend_on_the_size_of_the_table(spark):
    import pyarrow as pa

    r = np.random.default_rng(8)
    items, mark = r.integers(0, 128, (40, C.TOKENS)).astype(np.uint8), r.integers(0, 256, (40, C.MARK // 8)).astype(np.uint8)
    items[1::2, :240] = items[::2, :240]  # pairs share buckets for certain, their marks differ in 98 to 117 bits
    for i in range(0, 40, 2):
        flip = np.zeros(C.MARK, np.uint8)
        flip[r.permutation(C.MARK)[: 98 + i // 2]] = 1
        mark[i + 1] = mark[i] ^ np.packbits(flip)
    few = spark.createDataFrame([(i, bytearray(x), bytearray(m)) for i, (x, m) in enumerate(zip(items, mark))], "id bigint, items binary, mark binary")

    def others(batches):
        for b in batches:
            ids = b.column("id").to_numpy()
            g = np.random.default_rng(int(ids[0]))
            cols = ([z.tobytes() for z in g.integers(0, 256, (len(ids), n), np.uint8) & np.uint8(top)] for n, top in ((C.TOKENS, 127), (C.MARK // 8, 255)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, pa.binary()) for c in cols)], ["id", "items", "mark"])

    many = few.union(spark.range(100, 150_100).mapInArrow(others, few.schema))
    got = [{(p.a, p.b) for p in C.band_candidates(df, 8).filter("a < 40 AND b < 40").collect()} for df in (few, many)]
    assert got[0] == got[1] and {(i + 1, i) for i in range(0, 14, 2)} <= got[0]


def test_no_vectors(spark):
    none = spark.createDataFrame(unusable(), SCHEMA)
    f = spark.createDataFrame([], "asset_id string, confidence double")
    r = spark.createDataFrame([(1, 5, 0.0)], "request_id int, subset_size int, min_confidence double")
    assert similar_vectors(none).count() == 0 and C.similarity_clusters(none).count() == 0
    assert varied_subsets(none, f, r).count() == 0


def test_pivots_take_independent_rows_first():
    base = rng.standard_normal((6, 32))
    y = np.concatenate([base, base[:3] * 0.999, base[:1]]).astype(np.float32)
    order, size = pivots(y, 10)
    assert set(order[:6].tolist()) == set(range(6)) and (size[:6] > 0.5).all() and (size[6:] < 0.05).all()


def test_varied_subsets(spark):
    x = faces(people=30, shots=1, burst=4)
    df = table(spark, x, unusable()).unionAll(table(spark, x[:7]))
    conf = [0.9, None, float("nan"), -1.0, 5.0]
    fc = [(f"00000000-0000-0000-0000-{i:012d}".upper(), conf[i % 4 and 0] if i % 10 else conf[1 + i // 10 % 4], 1) for i in range(len(x))]
    fc += [(None, 0.9, 1), ("zz", 0.9, 1)]
    f = spark.createDataFrame(fc, "asset_id string, confidence double, conf int")
    r = spark.createDataFrame([(1, 30, 0.5), (2, 500, None), (3, 0, 0.1), (4, None, 0.1), (5, -3, 0.1), (None, 3, 0.0), (6, 40, 0.95), (1, 30, 0.5)], "request_id int, subset_size int, min_confidence double")
    got = {}
    for row in varied_subsets(df, f, r).collect():
        got.setdefault(row.request_id, []).append(row.vec_id)
    assert set(got) == {1, 2} and len(got[1]) == 30 == len(set(got[1])) and sorted(got[2]) == list(range(len(x)))
    assert all(v % 10 for v in got[1])
    assert len({v // 4 for v in got[1]}) >= 29  # hardly any face twice
