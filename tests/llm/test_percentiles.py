from collections import defaultdict

import numpy as np

from gridloom.llm import percentiles


def exact(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = int(np.floor(at))
    hi = int(np.ceil(at))
    return float(values[lo]) + (float(values[hi]) - float(values[lo])) * (at - lo)


def test_percentiles_and_combined_states(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if k % 3 else f"g{rng.integers(6)}", 0 if rng.random() < 0.4 else int(rng.integers(-1000, 1000)), int(rng.integers(0, 5)) if k % 11 else None, k) for k in range(5000)]
    rows += [(None, 5, 6, -1), ("one", -(2**63), 2**63 - 1, -2), ("none", None, None, -3)]
    df = spark.createDataFrame(rows, "g string, a bigint, b bigint, id bigint").withColumnRenamed("g", "grp")
    want = defaultdict(list)
    for g, a, b, _ in rows:
        for m, v in (("a", a), ("b", b)):
            if v is not None:
                want[g, m].append(v)
    quantiles = (0.0, 0.1, 0.5, 0.99, 1.0)
    parts = [percentiles.sorted_runs(df.filter(f"id % 3 = {k} OR (id < 0 AND -id % 3 = {k})"), "grp", ["a", "b"], partitions=3) for k in range(3)]
    for got in (percentiles.group_percentiles(df, "grp", ["a", "b"], quantiles, spread="id", partitions=7), percentiles.percentiles_of_runs(percentiles.combine_runs(*parts, partitions=5), quantiles)):
        seen = got.collect()
        assert len(seen) == len(want) * len(quantiles)
        for r in seen:
            assert r["value"] == exact(want[r["grp"], r["metric"]], r["q"]) and r["n"] == len(want[r["grp"], r["metric"]])
    assert percentiles.group_percentiles(df.limit(0), "grp", ["a"], (0.5,)).count() == 0
