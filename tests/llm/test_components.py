import os
import random

from pyspark.sql import functions as F

from quilldex.llm.common import Work
from quilldex.llm.components import components


def plain(links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_chains_stars_and_random_links(spark):
    r = random.Random(4)
    chain = [(k, k + 1) for k in range(0, 40)]
    r.shuffle(chain)
    star = [(1000 - k, 1000) for k in range(1, 60)]
    loose = [(2000 + r.randrange(200), 2000 + r.randrange(200)) for _ in range(120)]
    links = [*chain, *star, *loose, (5, 5), (5, 6), (6, 5)]
    got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long"), Work(spark, "t")).collect()}
    want = {x: c for x, c in plain(links).items() if any(x in p and p[0] != p[1] for p in links)}
    assert got == want


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Work(spark, "t")).count() == 0


def rounds(work):
    return sum(name.endswith("-parents") for name in os.listdir(work.root.removeprefix("file:")))


def test_rounds_grow_with_the_logarithm(spark):
    n, work = 10_000, Work(spark, "t")
    got = components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), work)
    assert got.filter("component = 0").count() == n + 1 == got.count()
    assert rounds(work) <= 20, rounds(work)
    print('rounds', rounds(work))
    work = Work(spark, "t")
    star = components(spark.range(1, 500).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")), work)
    assert star.filter("component = 0").count() == 500 and rounds(work) == 1
    work = Work(spark, "t")
    hub = components(spark.range(500).select(F.lit(900).cast("long").alias("a"), F.col("id").alias("b")), work)
    assert hub.filter("component = 0").count() == 501 and rounds(work) <= 4
