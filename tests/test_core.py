"""Feature table, skewed keys, deliveries against brute force."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.operators import features, skew
from gridloom.operators.deliveries import first_deliveries


def test_first_deliveries(spark):
    rows = [(2, "a", "x"), (1, "a", "y"), (3, None, "z"), (4, None, "z"), (5, "b", None), (6, "b", "w")]
    got = first_deliveries(spark.createDataFrame(rows, "id bigint, event_id string, rank string"))
    assert got.columns == ["id", "event_id", "rank"]
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5]
    assert first_deliveries(spark.createDataFrame([], "id bigint, event_id string")).count() == 0


@pytest.mark.parametrize("hot", [0, 3000])
def test_features(spark, monkeypatch, hot):
    monkeypatch.setattr(features, "SALT_ROWS", 500)
    rng = np.random.default_rng(2)
    rows = [("hot", "K0", int(rng.integers(1, 10**6)), 2**62, f"h{k}", k) for k in range(hot)]
    for k in range(400):
        rows.append((f"e{rng.integers(9)}", f"K{rng.integers(5)}", int(rng.integers(1, 10**6)) if k % 7 else None, int(rng.integers(-9, 9)) if k % 5 else None, f"v{rng.integers(300)}", 10_000 + k))
    rows += [(None, "K1", 5, 1, None, 20_000), ("e1", None, 5, 1, "n1", 20_001), ("e1", "K1", 5, 1, None, 20_002), ("e1", "K1", 5, 1, None, 20_003)]
    df = spark.createDataFrame(rows, "who string, what string, at bigint, much bigint, ev string, id bigint").withColumnRenamed("who", "entity")
    got = {(r["entity"], r["type"]): r for r in features.entity_features_long(df, "entity", "what", "at", "much", "ev", "id").collect()}
    wide = {(r["entity"], t): (n, s, x) for r in features.entity_features(df, "entity", "what", "at", "much", "ev", "id").collect() for t, n, s, x in zip(r["types"], r["counts"], r["seconds_since_last"], r["totals"])}
    assert wide == {k: (r["n"], r["seconds_since_last"], r["total"]) for k, r in got.items()}
    first = {}
    for e, k, t, v, ev, i in rows:
        key = ev if ev is not None else f"null{i}"
        if key not in first or i < first[key][0]:
            first[key] = (i, t, v, e, k)
    as_of = max(r[2] for r in rows if r[2] is not None)
    want = defaultdict(list)
    for _, t, v, e, k in first.values():
        want[e, k].append((t, v))
    entities, kinds = {r[3] for r in first.values()}, {r[1] for r in rows if r[1] is not None}
    assert len(got) == len(entities) * len(kinds)
    for e in entities:
        for k in kinds:
            own = want.get((e, k), [])
            times = [t for t, _ in own if t is not None]
            r = got[e, k]
            assert r["n"] == len(own) and int(r["total"]) == sum(v for _, v in own if v is not None)
            assert r["seconds_since_last"] == (as_of - max(times) if times else None)
    empty = spark.createDataFrame([], df.schema)
    assert features.entity_features(empty, "entity", "what", "at", "much", "ev", "id").count() == 0
    assert features.entity_features_long(empty, "entity", "what", "at", "much", "ev", "id").count() == 0
    with pytest.raises(ValueError):
        monkeypatch.setattr(features, "MAX_TYPES", 3)
        features.entity_features(df, "entity", "what", "at", "much", "ev", "id")
    few = features.entity_features(df, "entity", "what", "at", "much", "ev", "id", types=["K1", "none"], as_of=10**6).collect()
    assert all(r["types"] == ["K1", "none"] and r["counts"][1] == 0 and r["seconds_since_last"][1] is None for r in few)
    plain = features.entity_features_long(df, "entity", "what", "at", "much").collect()
    assert sum(r["n"] for r in plain) == sum(r[1] is not None for r in rows)


def exact(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = int(np.floor(at))
    hi = int(np.ceil(at))
    return float(values[lo]) + (float(values[hi]) - float(values[lo])) * (at - lo)


@pytest.mark.parametrize("split", [4096, 3])
def test_a_hot_key_with_close_values(spark, monkeypatch, split):
    monkeypatch.setattr(skew, "BAND_VALUES", 50)
    monkeypatch.setattr(skew, "SPLIT", split)
    values = [10**12 + k * k for k in range(1500)]
    rows = [("hot", v) for v in values for _ in range(1 + v % 3)] + [("hot", -(10**12) - k) for k in range(200)] + [("other", k) for k in range(30)] + [(None, 5)]
    df = spark.createDataFrame(rows, "a string, v bigint")
    got = {(r["key_value"], r["q"]): r["value"] for r in skew.weighted_percentiles(skew.value_frequencies(df, ["a"], "v"), (0.0, 0.03, 0.5, 0.9, 1.0)).collect()}
    for key in ("hot", "other", None):
        own = [v for k, v in rows if k == key]
        assert {q: got[key, q] for q in (0.0, 0.03, 0.5, 0.9, 1.0)} == {q: exact(own, q) for q in (0.0, 0.03, 0.5, 0.9, 1.0)}


def test_skewed_keys(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if k % 3 else f"k{rng.integers(20)}", f"o{rng.integers(3)}", int(rng.integers(-50, 50)) if k % 13 else None) for k in range(3000)]
    rows += [(None, "", None), ("wide", "o1", 2**63 - 1), ("wide", "o1", -(2**63)), ("wide", "o2", 2**63 - 2), ("wide", "o1", 7), *[("close", "o1", 10**9 + 3 * k * k) for k in range(300)]]
    df = spark.createDataFrame(rows, "a string, b string, v bigint")
    got = {(r["key_field"], r["key_value"]): r for r in skew.key_profiles(df, ["a", "b"], "v", (0.5, 0.9)).collect()}
    want = defaultdict(list)
    for a, b, v in rows:
        want["a", a].append(v)
        want["b", b].append(v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        there = [v for v in values if v is not None]
        r = got[key]
        mode = min(Counter(there).items(), key=lambda x: (-x[1], x[0]), default=(None, None))
        assert (r["rows"], r["distinct_values"], r["mode"], r["mode_rows"]) == (len(values), len(set(there)), *mode)
        assert r["p50"] == (exact(there, 0.5) if there else None) and r["p90"] == (exact(there, 0.9) if there else None)
    heavy = skew.heavy_keys(skew.key_counts(skew.value_frequencies(df, ["a", "b"], "v")), 0.3)
    assert {(r["key_field"], r["key_value"]) for r in heavy.collect()} == {k for k, v in want.items() if len(v) >= 0.3 * len(rows)}
    assert skew.key_profiles(df.limit(0), ["a", "b"], "v").count() == 0


def test_intermediate_tables_can_be_cleared(spark):
    from gridloom import shared

    table = shared.written(spark.range(5).toDF("x"), "some")
    assert table.count() == 5 and shared.clear(spark) >= 1 and shared.clear(spark) == 0
