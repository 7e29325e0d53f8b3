import random
from datetime import datetime, timedelta
from uuid import UUID

import pytest

from tessera.operators.orphans import key_runs, match_runs, orphan_references, orphan_report, with_key

RUNS = "run_id bigint, recorded_ts timestamp_ntz, asset_ids array<string>, frigate_files map<string,string>, k_hi string, state string"
ASSETS = "asset_id string, ingested_ts timestamp_ntz, deleted_ts timestamp_ntz, ts string, held int"
T = datetime(2024, 1, 1)


def uid(n):
    return str(UUID(int=n))


def spell(u, how):
    return [u, u.upper(), u.replace("-", ""), "{" + u + "}", "urn:uuid:" + u, f"  {u}\t", "{" + u.upper().replace("-", "") + "}"][how % 7]


def expected(runs, assets):
    def canon(x):
        s = x.strip(" \t\n\x0b\f\r").lower()
        s = s.removeprefix("urn:uuid:")
        s = s[1:-1] if s.startswith("{") and s.endswith("}") else s
        s = s.removeprefix("urn:uuid:").replace("-", "")
        return s if len(s) == 32 and all(c in "0123456789abcdef" for c in s) else None

    life = {}
    for a, i, d, *_ in assets:
        if a is not None and canon(a):
            life.setdefault(canon(a), set()).add((i, d))
    out = set()
    for run, t, ids, files, *_ in runs:
        refs = [("asset_ids", x, x) for x in ids or []] + [("frigate_files", k, v) for k, v in (files or {}).items()]
        for field, item, ref in refs:
            if ref is None or not ref.strip():
                continue
            rows = life.get(canon(ref) or "", set())
            if any(i is not None and t is not None and i <= t and (d is None or d > t) for i, d in rows):
                continue
            state = "missing" if not rows else "late" if t is not None and all(i is not None and i > t for i, _ in rows) else "deleted"
            out.add((run, field, item, state))
    return out


def test_states_and_spellings_against_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(128) for _ in range(40)] + list(range(1 << 90, (1 << 90) + 30))
    day = lambda n: T + timedelta(days=n)
    assets = []
    for n in base[:50]:
        for _ in range(rnd.choice([1, 1, 2, 3])):
            i = day(rnd.randint(0, 30))
            assets.append((spell(uid(n), rnd.randint(0, 6)), rnd.choice([i, i, i, None]), rnd.choice([None, i + timedelta(days=rnd.randint(0, 9))]), "x", 1))
    assets += assets[:10] + [(None, day(1), None, "x", 1), ("no-uuid", day(1), None, "x", 1)]
    runs = []
    for r in range(60):
        ids = [spell(uid(rnd.choice(base)), rnd.randint(0, 6)) for _ in range(rnd.randint(0, 6))] + rnd.sample([None, "", "  ", "n/a", "no-uuid"], 2)
        files = {f"f_{j}.webp": rnd.choice([None, " ", "zz", uid(rnd.choice(base))]) for j in range(rnd.randint(0, 3))}
        runs.append((r, rnd.choice([day(rnd.randint(-2, 40)), None, day(15)]), rnd.choice([ids, ids, None]), rnd.choice([files, None]), "clash", "clash"))
    runs += runs[:5]
    got = orphan_references(spark.createDataFrame(runs, RUNS), spark.createDataFrame(assets, ASSETS))
    assert {(r.run_id, r.field_name, r.item, r.state) for r in got.collect()} == expected(runs, assets)


def test_hot_key_and_moments_of_a_day(spark):
    a = uid(7)
    assets = [(a, T + timedelta(hours=6), T + timedelta(hours=12), "x", 1), (a, T + timedelta(hours=18), None, "x", 1)]
    runs = [(h, T + timedelta(hours=h), [a], None, "", "") for h in range(-3, 30)]
    got = {(r.run_id, r.state) for r in orphan_references(spark.createDataFrame(runs, RUNS), spark.createDataFrame(assets, ASSETS)).collect()}
    assert got == {(h, "late") for h in range(-3, 6)} | {(h, "deleted") for h in range(12, 18)}


def test_empty_tables(spark):
    none_r, none_a = spark.createDataFrame([], RUNS), spark.createDataFrame([], ASSETS)
    one = spark.createDataFrame([(1, T, [uid(1)], None, "", "")], RUNS)
    assert orphan_references(none_r, none_a).count() == 0
    assert [r.state for r in orphan_references(one, none_a).collect()] == ["missing"]
    assert orphan_report(orphan_references(one, none_a)).collect()[0].month == "2024-01"


def test_runs_compress_and_match(spark):
    keys = [5, 6, 7, 9, 2**64 + 1, (1 << 20) - 1, 1 << 20]
    df = with_key(spark.createDataFrame([(uid(k),) for k in keys + keys[:2]], "u string"), "u")
    runs = key_runs(df)
    assert sorted((r.run_end - r.run_start + 1) for r in runs.collect()) == [1, 1, 1, 1, 3]
    asked = [4, 5, 7, 8, 9, 10, 2**64 + 1, 2**64 + 2]
    refs = with_key(spark.createDataFrame([(str(k), uid(k)) for k in asked], "n string, u string"), "u")
    held = match_runs(refs, runs).join(refs, ["k_hi", "k_lo"])
    assert {int(r.n): r.held for r in held.collect()} == {k: k in keys for k in asked}


@pytest.mark.parametrize("text", [None, "", "x" * 100000, "urn:uuid:", "{}"])
def test_odd_ids(spark, text):
    df = with_key(spark.createDataFrame([(text,)], "u string"), "u")
    assert df.first().k_hi is None
