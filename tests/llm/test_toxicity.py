import math
import random

import numpy as np
from pyspark.sql import functions as F

from quilldex.llm import toxicity
from quilldex.llm.common import Work, held_out


def make(spark, n=900):
    r = random.Random(3)
    plain, bad = [f"w{k}" for k in range(300)], ["Scum", "idiot,", "loser!"]
    rows, labels = [], []
    for k in range(n):
        toxic = k % 5 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 200))]
        if toxic:
            words[r.randrange(len(words))] = r.choice(bad)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    rows += [(None, "idiot"), (5000, None), (5001, ""), (5002, "..."), (5003, "w1 " * 30_000 + "idiot"), (3, rows[3][1])]
    labels += [(None, 1, 1), (7777, 0, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = make(spark)
    out = held_out(3, 1)
    model = toxicity.train(docs.filter(~out), labels.filter(~out), Work(spark, "t"))
    got = toxicity.score(docs.withColumn("score", F.lit("clash")), model)
    assert got.count() == docs.count()
    rows = got.join(labels.dropDuplicates(["doc_id"]), "doc_id").filter(out).collect()
    right = [r for r in rows if (r.score >= toxicity.THRESHOLD) == bool(r.toxic)]
    assert len(rows) > 200 and len(right) >= 0.98 * len(rows)
    assert len(model[0]) < 3000
    odd = {r.doc_id: r.score for r in got.filter("doc_id >= 5000").collect()}
    assert odd[5000] == odd[5001] == odd[5002] < 0.5 and odd[5003] >= 0.7
    assert all(0 <= s <= 1 for s in odd.values())


def test_nothing_to_learn_from(spark):
    docs, labels = make(spark, 20)
    model = toxicity.train(docs, labels.limit(0), Work(spark, "t"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_ftrl(rows):
    """The update as it is published, one coordinate after the other."""
    z, n = {}, {}
    bias = 1 << toxicity.BITS

    def weight(f):
        l1 = 0 if f == bias else toxicity.L1
        if abs(z.get(f, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for y, features in rows:
            w = {f: weight(f) for f in [*features, bias]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in w:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / toxicity.ALPHA * w[f]
                n[f] = before + g * g
    return {f: weight(f) for f in z if weight(f)}


def test_weights_against_plain_ftrl():
    r = random.Random(5)
    rows = [(y, sorted(r.sample(range(60), 6) + ([100, 101] if y else [102]))) for y in (int(r.random() < 0.3) for _ in range(200))]
    features, weights = toxicity.fit([(y, np.array(f, np.int32)) for y, f in rows])
    want = plain_ftrl(rows)
    assert dict(zip(features.tolist(), weights.tolist())).keys() == want.keys() and len(want) > 2
    assert all(abs(w - want[f]) < 1e-9 for f, w in zip(features.tolist(), weights.tolist()))


def test_features_against_plain_words():
    texts = ["a b a, c", "", "one", "x y x y x"]
    features, owner = toxicity.features_of([t.encode() for t in texts])
    words = [[w for w in "".join(c if c.isalnum() else " " for c in t).split()] for t in texts]
    for k, w in enumerate(words):
        distinct = len({("w", x) for x in w} | {("p", x[:5]) for x in w} | {(1, *p) for p in zip(w, w[1:])} | {(2, *p) for p in zip(w, w[2:])})
        assert len(set(features[owner == k].tolist())) == distinct


def test_sample_sorts_no_whole_label(spark, monkeypatch):
    known = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"), F.xxhash64("id", F.lit(3)).alias("order"))
    for label, most in ((0, 100), (1, 100), (1, 5000), (0, 1)):
        got = [r.doc_id for r in toxicity.lowest(known, label, most).collect()]
        assert got == [r.doc_id for r in known.filter(F.col("label") == label).orderBy("order", "doc_id").limit(most).collect()]
    plan = toxicity.lowest(known, 0, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Window" not in plan
    ties = known.withColumn("order", F.lit(7).cast("long"))
    assert [r.doc_id for r in toxicity.lowest(ties, 0, 3).collect()] == [1, 2, 3]


def test_repeated_documents_count_once(spark):
    docs, labels = make(spark, 60)
    many = docs.unionByName(docs.limit(30)).unionByName(docs.filter("doc_id = 10"))
    same = toxicity.train(docs.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id = 3")), labels, Work(spark, "t"))
    got = toxicity.train(many.withColumns({"label": F.lit("x"), "order": F.lit(1)}), labels.unionByName(labels), Work(spark, "t"))
    assert [a.tolist() for a in got] == [a.tolist() for a in same]
