import ast
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quilldex.llm import chosenpath as C

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = [shingles(r[1], width) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    out = [(r[0], len(sets[k]), least.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)]
    return sorted(str((*x, x[0] == x[2])) for x in out)


def family(n=40, seed=3):
    """Copies of a text with more and more words changed, so that similarities lie on both sides of the limit."""
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(k % 9):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words), "en", "a", 1))
    return rows


def test_against_all_pairs(spark, docs, docs_rows):
    for width, percent in ((3, 85), (5, 80)):
        got = C.near_duplicates(docs.withColumns({"id": F.lit(1), "n": F.lit(2), "digest": F.lit("x"), "node": F.lit(0)}), width, percent)
        assert sorted(str(tuple(r)) for r in got.collect()) == brute(docs_rows, width, percent)


def test_large_nodes_branch_and_are_compared_in_blocks(spark, docs, monkeypatch):
    rows = family()
    frame = spark.createDataFrame(rows, docs.schema)
    want = brute(rows, 3, 85)
    for members, levels in ((8, 4),):
        monkeypatch.setattr(C, "NODE_MEMBERS", members)
        monkeypatch.setattr(C, "NODE_SHINGLES", members * 120)
        monkeypatch.setattr(C, "LEVELS", levels)
        got = C.near_duplicates(frame, 3, 85)
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_selected_tokens_differ(spark):
    tokens = spark.createDataFrame([(1, np.arange(C.TOKENS, dtype="<u4").tobytes())], "id long, sketch binary")
    members = spark.range(20).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("n"))
    # one member, all of whose tokens differ: as many children as selections
    assert C.branch(members, tokens, C.TREES, True).count() == 20 * 2 * C.TREES


def test_recall_where_nodes_branch(spark, docs, monkeypatch):
    """Texts that share half of their words, so that nodes are far too large, and pairs planted among them."""
    r = random.Random(12)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows, pairs = [], []
    for k in range(150):
        words = [*base[:120], *(f"u{r.randrange(10**9)}" for _ in range(80))]
        near = list(words)
        for _ in range(r.randint(0, 6)):
            near[r.randrange(120, 200)] = f"v{r.randrange(10**9)}"
        rows += [(2 * k, " ".join(words), "en", "a", 1), (2 * k + 1, " ".join(near), "en", "a", 1)]
        a, b = shingles(rows[-2][1], 5), shingles(rows[-1][1], 5)
        if 100 * len(a & b) >= 80 * len(a | b):
            pairs.append((2 * k, 2 * k + 1))
    monkeypatch.setattr(C, "NODE_MEMBERS", 32)
    monkeypatch.setattr(C, "NODE_SHINGLES", 32 * 200)
    monkeypatch.setattr(C, "LEVELS", 3)
    got = {x.doc_id: x.component_id for x in C.near_duplicates(spark.createDataFrame(rows, docs.schema)).collect()}
    assert len(pairs) > 60
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert len(set(got.values())) >= 300 - len(pairs)


def test_one_of_each_group_stays(spark, docs, docs_rows, no_docs):
    clashing = docs.withColumns({"first": F.lit("clash"), "extra": F.lit(1), "digest": F.lit("x"), "row": F.lit(1)})
    kept = C.keep_one(clashing)
    assert kept.columns == [*docs.columns, "first", "extra", "digest", "row"]
    judged = [ast.literal_eval(x) for x in brute(docs_rows, 5, 80)]
    want = {component for _, n, component, _ in judged if n}
    blank = sum(not WORD.search(r[1] or "") for r in docs_rows)
    ids = [r.doc_id for r in kept.filter("text is not null and trim(both ' \t\n' from text) <> ''").collect()]
    assert sorted(map(str, ids)) == sorted(map(str, want)) and kept.count() == len(want) + blank
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, C.keep_one(clashing).collect())) == sorted(map(str, kept.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert C.keep_one(no_docs).count() == 0 and C.near_duplicates(no_docs).count() == 0


def test_exact_node_comparison():
    r = np.random.default_rng(5)
    for m in (2, 3, 40):
        base = r.integers(0, 1 << 60, 300, dtype=np.uint64)
        sets = [np.unique(np.concatenate([base[: 300 - int(r.integers(0, 60))], r.integers(0, 1 << 60, int(r.integers(0, 40)), dtype=np.uint64)])) for _ in range(m)]
        want = [[100 * len({*a.tolist()} & {*b.tolist()}) >= 85 * len({*a.tolist()} | {*b.tolist()}) for b in sets] for a in sets]
        got = C.near_by_sets(sets, 85)
        off = ~np.eye(m, dtype=bool)
        assert (got[off] == np.array(want)[off]).all()
