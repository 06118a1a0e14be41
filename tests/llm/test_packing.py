import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import packing as P

needs_tokenizer = pytest.mark.skipif(not os.path.exists(P.TOKENIZER), reason="public tokenizer files not here")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([5, 11, 512]))
def test_plan_uses_every_item_once(sizes, classes):
    before, P.CLASSES = P.CLASSES, classes
    try:
        histogram = np.bincount(np.array(sizes, int), minlength=41)
        got = np.zeros(41, int)
        for repeats, content, way in P.packing_plan(histogram, 40):
            assert repeats > 0 and sum(s * k for s, k in content.items()) <= 40 and (way == "full") == (content == {40: 1})
            for s, k in content.items():
                got[s] += repeats * k
        assert (got == histogram).all()
    finally:
        P.CLASSES = before


def test_combinations_are_all_of_them():
    sizes = np.array([2, 3, 5, 7, 10])
    got = {tuple(sorted(c[c > 0].tolist())) for c in P.combinations(sizes, 10, 1)}
    want = set()
    for a in sizes:
        for combo in [(a,), *[(a, b) for b in sizes], *[(a, b, c) for b in sizes for c in sizes]]:
            if 9 <= sum(combo) <= 10:
                want.add(tuple(sorted(int(x) for x in combo)))
    assert got == want


def test_multiples_fill_the_capacity():
    sizes = np.array([2, 3, 7, 10])
    combos, copies = P.multiples(sizes, 30)
    total = combos[:, 0] * copies + combos[:, 1] + combos[:, 2]
    assert (total == 30).all() and (copies > 1).all() and set(combos.ravel().tolist()) <= {0, 2, 3, 7, 10}
    assert {(10, 3), (2, 15), (3, 10)} <= set(zip(combos[:, 0].tolist(), copies.tolist()))


def test_counts_solve_a_solvable_histogram():
    combos = P.combinations(np.array([10, 20, 30, 40, 50]), 60)
    truth = np.arange(len(combos)) % 3 * 100.0
    histogram = np.bincount(combos.ravel(), np.repeat(truth, 3), minlength=61)
    histogram[0] = 0
    x = P.repeat_counts(combos, histogram)
    fit = np.bincount(combos.ravel(), np.repeat(x, 3), minlength=61)
    fit[0] = 0
    assert (x >= 0).all() and np.abs(fit - histogram).max() < 1.0
    assert (x > 0).sum() <= 5  # a basic solution


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=12, max_size=12))
def test_no_other_counts_fit_better(numbers):
    histogram = np.array([0, *numbers], float)
    combos = P.combinations(np.flatnonzero(histogram), 12)
    x = P.repeat_counts(combos, histogram)
    weight = np.sqrt(np.arange(13) / 13)
    fit = np.zeros(13)
    np.add.at(fit, combos.ravel(), np.repeat(x, 3))
    fit[0] = 0
    gradient = (np.where(combos > 0, (weight**2 * (histogram - fit))[combos], 0)).sum(axis=1)
    assert (x >= 0).all() and (gradient <= 1e-5).all() and (np.abs(gradient[x > 1e-9]) <= 1e-5).all()  # the conditions of the least squares' minimum


@pytest.mark.parametrize("capacity, used", [(512, 0.998), (2048, 0.998), (65_536, 0.997)])  # classes of sizes leave about a class
def test_little_space_is_left(capacity, used):
    rng = np.random.default_rng(0)
    sizes = np.clip(np.exp(rng.normal(5, 0.8, 20_000)) * (capacity / 512), 1, capacity).astype(int)
    plan = P.packing_plan(np.bincount(sizes, minlength=capacity + 1), capacity)
    assert sizes.sum() / (capacity * sum(r for r, _, _ in plan)) > used
    placed = {way: sum(r * sum(c.values()) for r, c, w in plan if w == way) for way in ("solved", "greedy")}
    assert placed["solved"] > 0.9 * sum(placed.values())


@needs_tokenizer
def test_packed(spark):
    count = P.token_counter(P.TOKENIZER.replace(".tiktoken", ".json"))  # the same vocabulary by another library
    rng = np.random.default_rng(1)
    texts = [" ".join(["meter", "reads", "Zähler", "42"][rng.integers(4)] for _ in range(n)) for n in rng.integers(1, 60, 300)]
    texts += [None, "", "word " * 1000, "Same here.", "Same here.", "<|endoftext|>", " " * 40_000, "ж" * 60_000, "".join(chr(97 + k * k * 7919 % 26) for k in range(130_000))]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(0, texts[0], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string, tokens bigint")
    capacity = 64
    got = P.packed(df, capacity).collect()
    by_doc, by_container = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        if r["tokens"]:
            assert 0 <= r["offset"] and r["offset"] + r["tokens"] <= capacity
            by_container.setdefault(r["container"], []).append((r["offset"], r["tokens"]))
        else:
            assert r["container"] is None
    for places in by_container.values():
        places.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(places, places[1:]))
    assert sorted(by_container) == list(range(len(by_container)))
    assert by_doc.keys() == set(range(len(texts))) and len(by_doc[0]) == 2
    for k, t in enumerate(texts[:-1]):
        n = count(t or "") * (2 if k == 0 else 1)
        assert sum(r["tokens"] for r in by_doc[k]) == n
        assert len(by_doc[k]) == 1 or k == 0 or n > capacity
    report = P.packing_report(P.packed(df, capacity), capacity).first()
    assert report["containers"] == len(by_container)
    assert report["solved_share"] > 0.5
    assert tuple(P.packing_faults(P.packed(df.filter("doc_id > 0"), capacity), capacity).first()) == (len(texts) - 1, 0, 0, 0, 0)
    wrong = spark.createDataFrame([(1, 0, 0, 40, 0, 0, "greedy"), (2, 0, 0, 40, 0, 39, "greedy"), (3, 0, 0, 5, 1, 0, "greedy"), (3, 1, 9, 5, 1, 5, "greedy")], P.packed(df.limit(0), capacity).schema)
    assert tuple(P.packing_faults(wrong, capacity).first()) == (3, 1, 1, 1, 1)
    assert P.packed(df.limit(0), capacity).count() == 0 and P.packing_faults(P.packed(df.limit(0), capacity), capacity).first()["documents"] == 0
    with pytest.raises(ValueError):
        P.packed(df, 0)
    assert sum(r["tokens"] for r in P.packed(df, 100_000).collect()) == sum(r["tokens"] for r in got)
