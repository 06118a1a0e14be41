import numpy as np
import pytest

from gridloom.operators import outliers

DAY = 86_400


def ledger(seed=5):
    rng = np.random.default_rng(seed)
    rows, bad = [], set()

    def add(source, ts, u, k, event=None, case=False):
        i = len(rows) + 1
        rows.append((i, event or f"ev{i}", source, int(ts), None if u is None else int(u), None if k is None else int(k)))
        if case:
            bad.add(i)

    for s in range(12):
        level = float(np.exp(rng.uniform(4, 8)))
        for t in range(150):
            ts = 1_735_700_000 + t * DAY // 5 + s
            u = level * (1 + 0.4 * np.sin(t)) * float(np.exp(rng.normal(0, 0.2))) * (4 if s == 3 and t > 80 else 1)  # one lasting change of level
            if s == 4 and rng.random() < 0.2:
                u *= rng.uniform(5, 18)  # bursts are a habit
            if s == 5:
                u = 324  # constant load
            if s == 6 and rng.random() < 0.2:
                u = 0
            add(f"S{s}", ts, u, u * 700)
    for i, factor in ((20, 30), (400, 45)):
        r = rows[i]
        rows[i] = (*r[:4], r[4] * factor, r[5])
        bad.add(r[0])
    rows[1000] = (*rows[1000][:4], rows[1000][4], -5)
    bad.add(rows[1000][0])
    for i in range(1210, 1226):  # a stretch on one value
        rows[i] = (*rows[i][:4], rows[1210][4], rows[i][5])
        bad.add(rows[i][0])
    again = rows[400]
    rows.append((9_999, again[1], *again[2:]))  # a case delivered twice
    bad.add(9_999)
    rows += [(20_000 + k, f"few{k}", "few", 1_735_700_000 + k, -1, 1) for k in range(29)]
    rows += [(30_000, "n", None, 1, -1, -1), (30_001, None, "S1", 0, None, None)]
    return rows, bad


@pytest.mark.parametrize("chunk", [200_000, 40])
def test_planted_cases(spark, monkeypatch, chunk):
    monkeypatch.setattr(outliers, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(outliers, "BUFFER_ROWS", chunk)
    rows, bad = ledger()
    df = spark.createDataFrame(rows, "id bigint, event string, source string, ts bigint, u bigint, k bigint").withColumnRenamed("ts", "chunk")
    got = outliers.implausible_rows(df, "source", "chunk", "event", "id", ["u", "k"])
    found = {r["id"] for r in got.collect()}
    if chunk == 200_000:
        assert found == bad
    else:  # the same in chunks and pieces: nothing planted is lost, whatever the cuts
        assert bad <= found and len(found - bad) <= 3


@pytest.mark.parametrize("chunk", [200_000, 40])
@pytest.mark.parametrize("habit", [False, True])
def test_stuck_whatever_the_chunks(spark, monkeypatch, chunk, habit):
    monkeypatch.setattr(outliers, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(outliers, "BUFFER_ROWS", chunk)
    value = [1000 + k * 37 % 400 for k in range(400)]
    stuck = {*range(90, 110), *range(210, 230), *range(315, 325)}  # more than a chunk in all; the last one lies across an edge
    for k in stuck:
        value[k] = 2000 + k // 200
    value[315:325] = [2500] * 10
    if habit:  # a value that the source often has, in other chunks than its long stretch
        value[330:350], value[0:60:2] = [1500] * 20, [1500] * 30
    df = spark.createDataFrame([(k, f"e{k}", "a", 1_735_700_000 + k * 1000, v) for k, v in enumerate(value)], "id bigint, event string, source string, ts bigint, u bigint")
    got = outliers.implausible_rows(df, "source", "ts", "event", "id", ["u"]).filter("reason = 'stuck'").collect()
    assert {r["id"] for r in got} == (set() if habit else stuck)


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, event string, source string, ts bigint, u bigint")
    assert outliers.implausible_rows(df, "source", "ts", "event", "id", ["u"]).count() == 0


def test_drops_and_the_fitted_tail(spark):
    rng = np.random.default_rng(8)
    rows, spikes, drops = [], set(), set()
    for s, noise in enumerate([0.05] * 4 + [0.3] * 4):
        for t in range(400):
            i = len(rows) + 1
            u = 50_000 * float(np.exp(rng.normal(0, noise)))
            if s % 4 == 1 and t == 200:
                u *= 12
                spikes.add(i)
            if s % 4 == 2 and t == 200:
                u /= 12
                drops.add(i)
            if s % 4 == 3 and t % 9 == 0:
                u /= rng.uniform(6, 20)  # idle draws are a habit
            rows.append((i, f"e{i}", f"S{s}", 1_735_700_000 + t * 9_000, int(u)))
    df = spark.createDataFrame(rows, "id bigint, event string, source string, ts bigint, u bigint")
    got = outliers.implausible_rows(df, "source", "ts", "event", "id", ["u"], drops=True).collect()
    assert {r["id"] for r in got if r["reason"] == "spike"} == spikes and {r["id"] for r in got if r["reason"] == "drop"} == drops
    assert {r["id"] for r in outliers.implausible_rows(df, "source", "ts", "event", "id", ["u"]).collect()} == spikes
    cuts = {r["source"]: r for r in outliers.tail_cutoffs(outliers.scan_sources(df, "source", "ts", "event", "id", ["u"])).collect()}
    assert max(cuts[f"S{s}"]["cut"] for s in range(4)) < min(cuts[f"S{s}"]["cut"] for s in range(4, 8))  # steadier sources have lower cutoffs


def test_ticks_of_a_heavy_source_without_time_are_spread(spark, monkeypatch):
    monkeypatch.setattr(outliers, "CHUNK_ROWS", 100)
    df = spark.range(2_000).selectExpr("id", "'e' || id AS event", "'a' AS source", "CASE WHEN id % 2 = 0 THEN 1735700000 + id * 100 END AS ts", "1000 + id % 7 AS u")
    ticks = outliers.scan_sources(df, "source", "ts", "event", "id", ["u"]).filter(f"kind = {outliers.TICKS}").groupBy("chunk").sum("n").collect()
    assert len(ticks) == 20 and max(r[1] for r in ticks) < 200
