"""Exports are parsed once, and a look at the separators loses no way of writing a day."""

from pyspark.sql import functions as F

from tidemark.operators.harmonize import harmonize_from_dir
from tidemark.sources.platforms import CONTRACTS, DATE_PATTERNS, parse_date

ODD = ["2024-02-30", "2024-1-5", "2024-01-05 7:00:00", "+12024-01-05", "-2024-01-05", "1/2/2024", "01/02/2024", "13/1/2024", "2024/1/2",
       "2024/01/02", "20240102", "2024010", "+20240102", "5 Jan 2024", "05 January 2024", "Jan 5, 2024", "Jan 5 2024", "Jan , 2024", "5 Jan, 2024",
       "2024-01-05T10:00:00", "2024-01-05T10:00:00Z", "2024-01-05 10:00", "", " ", "-", "/", "nonsense", "1/2/2024 10:00:00", "Sept 5, 2024", None]


def test_every_pattern_is_read_as_without_the_look(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2023-12-28', DATE'2024-03-02')) AS day")
    written = days.select(F.explode(F.array(*[F.date_format("day", p) for p in DATE_PATTERNS])).alias("raw"))
    raw = written.union(spark.createDataFrame([(x,) for x in ODD], "raw string"))
    plain = F.coalesce(*[F.try_to_timestamp("raw", F.lit(p)) for p in DATE_PATTERNS]).cast("date")
    assert raw.where(~parse_date(F.col("raw")).eqNullSafe(plain)).collect() == []


def test_checked_facts_do_not_read_the_exports_again(spark, tmp_path):
    rows = {"date": "2024-01-05", "bigint": "7", "double": "1.5", "string": "TM_Campaign_1"}
    for i, c in enumerate(CONTRACTS.values()):
        values = {n: str(i) if n == c.entity else rows[k] for n, k in c.types.items()}
        (tmp_path / c.filename).write_text(",".join(values) + "\n" + ",".join(values.values()) + "\n")
    facts = harmonize_from_dir(spark, str(tmp_path))
    assert facts.count() == 3 and not any(f.endswith(".csv") for f in facts.inputFiles())
