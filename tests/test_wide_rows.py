"""Wide rows on their way to Python: no size check after every row; texts keep a bound; binned rows in pieces for every core."""

import datetime as dt

from tidemark.operators import forest as O
from tidemark.session import tune

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_only_texts_travel_in_batches_of_bounded_bytes(spark):
    from tidemark.llm.common import prepare

    before = {k: spark.conf.get(k) for k in (BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        tune(spark)
        assert spark.conf.get(BYTES) == "2147483647" and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
        prepare(spark)
        assert spark.conf.get(BYTES) == "64MB"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_binned_rows_are_dealt_out_in_pieces_of_days(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 200), float(i % 7), float(i)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "date date, x double, revenue_attributed double")
    data = O.binned(df, ["x"], "revenue_attributed", O.ForestConfig(trees=1), date="date")
    assert len(data.rows.inputFiles()) > spark.sparkContext.defaultParallelism
    assert data.rows.count() == 2_000
