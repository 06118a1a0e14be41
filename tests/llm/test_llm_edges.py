"""Every registered text query over empty tables and over tables without any value."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from gridloom.llm import queries

DATA = "/root/testdata/sf0.001"
KEYS = {"id", "doc_id", "item_id", "sample_id"}
ONE_ROW = {"p6_packing_report", "p6_packing_faults", "p8_segment_faults"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not here")
@pytest.mark.parametrize("kind", ["empty", "nulls", "repeated"])
def test_queries_have_results(spark, tmp_path, kind):
    for f in ("utility_ticks", "documents", "eval_items", "lang_samples"):
        t = pq.read_table(f"{DATA}/{f}.parquet").slice(0, 0 if kind == "empty" else 40)
        if kind == "nulls":
            t = pa.table({c: t[c] if c in KEYS else pa.nulls(t.num_rows, t.schema.field(c).type) for c in t.column_names})
        if kind == "repeated":  # every row twice, with columns that other tables and results have
            t = pa.concat_tables([t, t])
            for c in ("term", "hash", "rank", "part", "container", "words", "grp", "m0"):
                t = t.append_column(c, pa.array([c] * t.num_rows))
        pq.write_table(t, tmp_path / f"{f}.parquet")
    got = {name: query(spark, str(tmp_path)).collect() for name, query in queries.QUERIES.items()}
    if kind == "empty":
        assert {name for name, rows in got.items() if rows} == ONE_ROW
    if kind == "nulls":
        assert len(got["p6_packing"]) == len(got["p8_label_codes"]) == 40 and not got["p7_found"] and not got["p8_segments"] and not got["p4_percentiles"]
    if kind == "repeated":
        assert len({r["doc_id"] for r in got["p6_packing"]}) == 40 and len(got["p6_packing"]) >= 80
        assert len(got["p8_label_codes"]) == 80 and len(got["p8_segments"]) % 2 == 0
