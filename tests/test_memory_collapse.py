"""What tasks hold does not grow with the rows of their input: collapsed lines."""

from reachforge import queries


def test_lines_are_collapsed_in_as_many_tasks_as_their_number_asks_for(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    before = queries.configuration_summary(spark, d).collect()
    monkeypatch.setattr(queries, "LINES_A_TASK", 500)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert queries.lines_with_keys(spark, d).rdd.getNumPartitions() == -(-lines // 500) > 4
    assert queries.configuration_summary(spark, d).collect() == before
