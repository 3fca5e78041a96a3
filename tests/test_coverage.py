"""Missing and extra articles: one aggregate."""

from quillspark.operators import audit


def test_coverage_is_one_aggregate(spark):
    table = lambda rows: spark.createDataFrame(rows, "law_tag string, num long")
    found = audit.coverage(table([("a", 1), ("a", 1), ("a", 2), (None, 3)]), table([("a", 2), ("a", 4), ("a", 4), (None, None)]))
    assert {(r.law_tag, r.num, r.status) for r in found.collect()} == {("a", 1, "missing"), (None, 3, "missing"), ("a", 4, "extra"), (None, None, "extra")}
    assert found.count() == 4 and found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
