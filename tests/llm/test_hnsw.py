import numpy as np
from pyspark.sql import functions as F

from quilldex.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def make(n=900, seed=4):
    r = np.random.default_rng(seed)
    rows = []
    centre = r.standard_normal((6, 16))
    for k in range(n):
        v = centre[k % 6] + 0.12 * r.standard_normal(16) if k % 3 == 0 else r.standard_normal(16)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3 == 1)))
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (2001, rows[0][1], 0), (2002, rows[0][1], 1), (2003, rows[0][1], None), (2004, [2 * x for x in rows[3][1]], 0)]
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [float("nan")] * 16, 0), (3004, [None] * 16, 0), (3005, [1.0, 2.0], 0), (3006, [1.0, 2.0], 0), (None, rows[0][1], 0), (3007, [float("inf")] + [1.0] * 15, 0), (3008, [3e38] * 16, 0)]
    return rows


def brute(rows):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    unit = {k: np.array(rows[k][1], float) / max(map(abs, rows[k][1])) for k in good}
    unit = {k: v / np.sqrt(v @ v) for k, v in unit.items()}
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i].add(j)
                links[j].add(i)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((row[0], len(links[k]), min(ids) if ids else None))
    return out


def agree(got, want):
    found = sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got)))
    exact = sorted(map(str, want))
    assert len(found) == len(exact)
    links = sum(r.n_links for r in got)
    assert 0.99 * sum(w[1] for w in want) <= links <= sum(w[1] for w in want)
    assert len(set(exact) - set(found)) <= 0.02 * len(exact)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_links_and_components(spark):
    rows = make()
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "key": F.lit("x"), "shard": F.lit(0)})
    want = brute(rows)
    agree(hnsw.near_vectors(vectors).collect(), want)
    agree(hnsw.near_vectors(vectors, shard_rows=120).collect(), want)
    agree(hnsw.near_vectors(vectors, shard_rows=20, tile=3).collect(), want)
    assert hnsw.near_vectors(vectors.limit(0)).count() == 0


def test_graph_recall():
    r = np.random.default_rng(1)
    x = hnsw.unit(r.standard_normal((3000, 24)))
    g = hnsw.build(x.astype(np.float32), np.arange(3000))
    q = hnsw.unit(r.standard_normal((100, 24))).astype(np.float32)
    found, _ = g.beam(q, 0, g.descend(q, 0)[:, None], 64)
    exact = np.argsort(-(q @ x.T), 1)[:, :10]
    assert np.mean([len({*a[:10]} & {*b}) / 10 for a, b in zip(found.tolist(), exact.tolist())]) >= 0.9


def test_an_audit_that_fails_widens(monkeypatch):
    r = np.random.default_rng(2)
    x = hnsw.unit(r.standard_normal((400, 8)))
    g = hnsw.build(x.astype(np.float32), np.arange(400))
    g.levels[0][:] = -1  # a graph without links finds nothing
    a, b = hnsw.block_links(g, x, x, np.arange(400), True, 0.7)
    assert len(a) == int((np.triu(x @ x.T, 1) >= 0.7).sum())


def test_labels_with_commas_are_not_mixed_up(spark):
    rows = [(1, [1.0, 2.0], "x"), (2, [2.0], "x,1.0"), (3, [2.0], "1,x,1.0"), (4, [1.0, 2.0], "x"), (5, [4.0], "x,1.0")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, 3), 4: (1, 1), 5: (1, 2)}


def test_no_audit_is_empty_and_links_that_none_sampled_are_found(monkeypatch):
    r = np.random.default_rng(6)
    for dim in (2, 64, 300):
        x, q = (hnsw.unit(r.standard_normal((2000, dim))) for _ in range(2))
        where = r.permutation(2000)[:40]
        q[where] = hnsw.unit(x[where] + 0.2 / dim**0.5 * r.standard_normal((40, dim)))
        g = hnsw.build(x.astype(np.float32), np.arange(2000))
        monkeypatch.setattr(hnsw, "AUDITED", 0)
        audits = []
        a, b = hnsw.block_links(g, x, q, np.arange(2000), False, 0.93, audits)
        exact = int((q @ x.T >= 0.93).sum())
        assert audits and all(sown >= hnsw.PLANTED for *_, sown, _ in audits)
        assert audits[-1][4] >= hnsw.PLANTED_RECALL * audits[-1][3] or len(audits) > hnsw.WIDENED
        assert len(a) >= 0.999 * exact > 30
    one = np.ones((3, 1))
    assert len(hnsw.planted(one, 0.93)[0]) == 3 and np.isfinite(hnsw.planted(one, 0.93)[0]).all()
