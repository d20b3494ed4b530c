from quilldex.operators import postings
from quilldex.queries import posting_and_or


def test_intersect_and_ids(spark):
    ids = [-70_000, -5, 0, 1, 7, 32_768, 32_769, 100_000]
    rows = spark.createDataFrame([(i, n % 2, n % 3) for n, i in enumerate(ids)], "id long, a int, b int")
    lists = postings.build(rows, "id", "a", "b")
    one = lambda c, v: postings.union(lists.filter(f"column = '{c}' AND value = '{v}'"))
    assert sorted(r.id for r in postings.ids_of(postings.union(lists)).collect()) == ids
    assert sorted(r.id for r in postings.ids_of(postings.intersect(one("a", 1), one("b", 0))).collect()) == [i for n, i in enumerate(ids) if n % 2 == 1 and n % 3 == 0]


def test_query_reads_bitmaps(spark):
    plan = posting_and_or(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan.lower() and "bitmap_and_agg" in plan.lower()
