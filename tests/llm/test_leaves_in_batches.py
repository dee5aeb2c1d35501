"""Leaves are cut out of sorted partitions and vectors placed many at a time, wherever Arrow batches end."""

import numpy as np
import pyarrow as pa

from tidemark.llm import embeddings as E
from tidemark.llm.common import prepare


def test_batches_are_gathered(monkeypatch):
    monkeypatch.setattr(E, "GATHERED", 100)
    parts = [pa.RecordBatch.from_arrays([pa.array([bytes(30)] * n)], ["raw"]) for n in (1, 1, 1, 1, 9, 1)]
    found = list(E.gathered(iter(parts), "raw"))
    assert sum(b.num_rows for b in found) == 14 and len(found) == 3
    assert list(E.gathered(iter([]), "raw")) == []


def test_groups_that_span_batches(spark):
    prepare(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = np.random.default_rng(3)
        x = rng.standard_normal((120, 8)).astype("f4")
        x[60:] = x[:60] + 0.25 * rng.standard_normal((60, 8)).astype("f4")
        lists = [sorted({int(i % 5), 10 + int(i % 3), 20}) for i in range(120)]
        rows = [(32, leaf, 0, 0, 0, i, 1 + i % 2, x[i].tobytes(), lists[i]) for i in range(120) for leaf in lists[i]]
        df = spark.createDataFrame(rows, "bytes int, leaf int, i int, j int, b int, node long, weight long, raw binary, leaves array<int>")
        plan = E.compared(df, 0.9, "f4")
        assert "FlatMapGroups" not in plan._jdf.queryExecution().executedPlan().toString()
        met = plan.groupBy("node").sum("n").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    units = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    want = {i: int(sum(1 + j % 2 for j in np.flatnonzero(near[i]))) for i in range(120) if near[i].any()}
    assert {r[0]: r[1] for r in met if r[1]} == want
