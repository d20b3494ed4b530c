import re
from collections import defaultdict

from pyspark.sql import functions as F

from quilldex.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing step by step, until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - int(t + 1e-9)) <= 3, (s, taken[s], t)
    return want


def with_source(df, docs):
    return df.join(docs.select(F.col("doc_id").alias("d"), "source").distinct(), F.col("doc_id").eqNullSafe(F.col("d"))).collect()


def test_shares_and_exact_cuts(spark, docs, docs_rows):
    rows = [r for r in docs_rows if r[0] is not None]
    got = mixing.mix_sources(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]))
    check([*{r[0]: r for r in rows}.values()], with_source(got, docs.filter("doc_id is not null")))


def test_limits_are_reached_and_excess_reshared(spark):
    rows = [(k, "w " * 50, "x", s, 0) for k, s in enumerate(["big"] * 40 + ["a"] + ["c"] * 2 + [None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = check(rows, with_source(mixing.mix_sources(docs), docs))
    assert want["a"] == 150 and sum(want.values()) == 50 * 44


def test_reruns_agree_and_odd_rows_do_not_fail(spark, docs, no_docs):
    wide = docs.withColumns({"size": F.lit("x"), "key": F.lit(1), "target": F.lit(2)})
    first = sorted(map(str, mixing.mix_sources(wide).collect()))
    assert first == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert len(first) == docs.count()
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mix_documents(no_docs).count() == 0


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = [(k, "w " * (k % 17), "x", "abcd"[k % 4] if k % 3 else "a", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    check(rows, with_source(mixing.mix_sources(docs), docs))


def test_documents_stay_whole(spark, docs):
    wide = docs.withColumns({"epochs": F.lit(9), "key": F.lit("x"), "row": F.lit(1)})
    assert mixing.mix_documents(wide).count() == mixing.mix_documents(docs).count() > 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.exceptAll(docs).filter("text is not null").join(docs, ["doc_id", "text"], "left_anti").filter("doc_id is not null").count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
