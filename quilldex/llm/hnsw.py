"""Near-duplicate vectors by navigable small-world graphs, one per shard.

Equal vectors of a label are one class. The classes of a label are dealt to shards of
bounded size; each shard gets a hierarchical graph. Every shard is queried with the
classes of every shard of its label: a beam finds a query's surroundings, and from
there all neighbours above the threshold are walked. An audit compares some queries, and
queries planted at the threshold beside the graph's own nodes, with an exhaustive search;
where it misses links the beam and the walk's margin are widened and the block is queried
again, exhaustively in the end. Cosines are verified in double precision. Numpy carries
all queries of a block through the graph at once.

Graphs and blocks of queries meet in tiles: a task holds the graphs of TILE shards and
takes the queries of TILE shards past them, so each is shuffled once a tile, not once a
pair of shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work
from .components import components

THRESHOLD = 0.93
#: Classes of a shard on average; links of a node above the ground and on it; beams; queries audited.
SHARD_ROWS = 4096
LINKS, GROUND_LINKS, BUILD_BEAM, BEAM = 12, 24, 48, 32
#: Queries of a block that an audit looks up, and those that it plants, so that no audit is without links.
AUDITED, PLANTED = 512, 256
#: Shares of the audited and of the planted links that must be found, how far below the threshold the walk goes at
#: first, and how often beams are widened before a block is searched exhaustively, which then costs less.
AUDIT_RECALL, PLANTED_RECALL, MARGIN, WIDENED = 0.999, 0.995, 0.05, 2
#: Shards whose graphs a task holds at once.
TILE = 8
STRIDE, BATCH, QUERIES, WALK_PAIRS = 4, 128, 256, 1 << 20
SHARD = "label string, dim int, shard int, n int, ids binary, copies binary, vectors binary, entry int, levels array<binary>"
FOUND = "a long, b long, n long"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _similar(x: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cosines of queries (rows of q) with their own candidates (rows of at); -2 where there is none."""
    return np.where(at >= 0, np.matmul(x[at], q[:, :, None])[:, :, 0], np.float32(-2))


def _first_seen(flat: np.ndarray) -> np.ndarray:
    """Whether each entry is the first of its value in its row."""
    order = np.argsort(flat, 1, kind="stable")
    ordered = np.take_along_axis(flat, order, 1)
    new = np.ones(flat.shape, bool)
    new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    out = np.empty(flat.shape, bool)
    np.put_along_axis(out, order, new, 1)
    return out


class Graph:
    """Vectors (unit length, single precision) and for each level the links of every node, -1 for none."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray], entry: int):
        self.x, self.levels, self.entry = x, levels, entry

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """Greedy walk of every query from the top down to above level ``to``."""
        here = np.full(len(q), self.entry)
        near = np.einsum("ij,ij->i", self.x[here], q)
        for level in range(len(self.levels) - 1, to, -1):
            moving = np.arange(len(q))
            while len(moving):
                beside = self.levels[level][here[moving]]
                s = _similar(self.x, q[moving], beside)
                best = s.argmax(1)
                top = s[np.arange(len(moving)), best]
                better = top > near[moving]
                moving = moving[better]
                here[moving], near[moving] = beside[better, best[better]], top[better]
        return here

    def beam(self, q: np.ndarray, level: int, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes of a level that a beam of this width reaches: (ids, cosines), best first."""
        n = len(q)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.x) + 1), bool)
        ids = np.full((n, width), -1)
        ids[:, : start.shape[1]] = start
        cos = np.full((n, width), np.float32(-2))
        cos[:, : start.shape[1]] = _similar(self.x, q, start)
        seen[rows, start] = True
        seen[:, -1] = True  # stands for -1: no node
        done = ids < 0
        live = np.arange(n)
        while len(live):
            open_cos = np.where(done[live], np.float32(-3), cos[live])
            pick = np.argpartition(-open_cos, STRIDE - 1, 1)[:, :STRIDE]
            fresh = np.take_along_axis(open_cos, pick, 1) > -2
            on = fresh.any(1)
            live, pick, fresh = live[on], pick[on], fresh[on]
            if not len(live):
                break
            here = live[:, None]
            done[here, pick] = True
            nodes = np.where(fresh, ids[here, pick], -1)
            beside = self.levels[level][nodes]
            beside[nodes < 0] = -1
            beside = beside.reshape(len(live), -1)
            beside[seen[here, beside] | ~_first_seen(beside)] = -1
            seen[here, beside] = True
            s = _similar(self.x, q[live], beside)
            all_ids = np.concatenate([ids[live], beside], 1)
            all_cos = np.concatenate([cos[live], s], 1)
            all_done = np.concatenate([done[live], beside < 0], 1)
            best = np.argpartition(-all_cos, width - 1, 1)[:, :width]
            ids[live], cos[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_cos, all_done))
        order = np.argsort(-cos, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(cos, order, 1)


def choose(x: np.ndarray, ids: np.ndarray, cos: np.ndarray, most: int) -> np.ndarray:
    """Links from candidates (best first, -1 for none).

    The nearest fill half the places, so that dense groups hang together; then come those
    nearer to the node than to any chosen one, so that groups hang together with others;
    then what is nearest.
    """
    n, width = ids.shape
    between = np.matmul(x[ids], x[ids].transpose(0, 2, 1))
    chosen = np.zeros((n, width), bool)
    closest = np.full((n, width), np.float32(-2))
    for k in range(width):
        take = (ids[:, k] >= 0) & ((cos[:, k] > closest[:, k]) | (k < most // 2)) & (chosen.sum(1) < most)
        chosen[take, k] = True
        closest[take] = np.maximum(closest[take], between[take, k])
    rank = np.where(ids < 0, 2 * width, np.arange(width) + width * ~chosen)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.full((n, most), -1)
    out[:, : order.shape[1]] = np.take_along_axis(ids, order, 1)
    return out


def level_of(ids: np.ndarray) -> np.ndarray:
    """Levels with the usual geometric decline, from the class's number alone."""
    u = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    u ^= u >> np.uint64(23)
    u = (u * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)
    return np.floor(-np.log((u.astype(np.float64) + 1) / (1 << 53)) / np.log(LINKS)).astype(int)


def build(x: np.ndarray, ids: np.ndarray) -> Graph:
    """The graph of a shard, in batches: a batch searches what stands, and its own members."""
    n = len(x)
    level = level_of(ids)
    order = np.argsort(-level, kind="stable")  # the highest first: the entry stays, and upper levels exist
    level = level[order]
    levels = [np.full((n, GROUND_LINKS if k == 0 else LINKS), -1) for k in range(int(level[0]) + 1)]
    g = Graph(x[order], levels, 0)
    low = 0
    while low < n:
        high = min(n, low + max(1, min(BATCH, low)))
        new = np.arange(low, high)
        q = g.x[new]
        own = (q @ q.T).astype(np.float32)
        for k in range(int(level[low]), -1, -1):
            here = np.flatnonzero(level[new] >= k)
            stand = low > 0 and k <= level[0]
            cand, cos = np.full((len(here), 0), -1), np.full((len(here), 0), np.float32(-2))
            if stand:
                cand, cos = g.beam(q[here], k, g.descend(q[here], k)[:, None], BUILD_BEAM)
            inner = own[np.ix_(here, here)].copy()
            inner[np.arange(len(here)), np.arange(len(here))] = -2
            beside = np.where(inner > -2, new[here][None, :], -1)
            cand, cos = np.concatenate([cand, beside], 1), np.concatenate([cos, inner], 1)
            best = np.argsort(-cos, 1, kind="stable")[:, : BUILD_BEAM + 16]
            cand, cos = np.take_along_axis(cand, best, 1), np.take_along_axis(cos, best, 1)
            width = levels[k].shape[1]
            links = choose(g.x, cand, cos, width) if cand.shape[1] else np.full((len(here), width), -1)
            levels[k][new[here]] = links
            _link_back(g, k, new[here], links)
        low = high
    # back to the order of the ids
    back = np.empty(n, int)
    back[np.arange(n)] = order
    out = []
    for table in levels:
        moved = np.where(table >= 0, back[table], -1)
        full = np.empty_like(moved)
        full[back] = moved
        out.append(full.astype(np.int32))
    out[0] = _adopt(out[0])
    return Graph(x, out, int(order[0]))


def _adopt(ground: np.ndarray) -> np.ndarray:
    """Nodes that no link leads to (full nodes have dropped theirs) are added to a node that they link to, in columns of their own."""
    n = len(ground)
    orphans = np.flatnonzero(np.bincount(ground[ground >= 0], minlength=n) == 0)
    used = np.zeros(n, int)
    places = []
    for k in orphans.tolist():
        beside = ground[k][ground[k] >= 0]
        if len(beside):
            to = int(beside[used[beside].argmin()])
            places.append((to, used[to], k))
            used[to] += 1
    more = np.full((n, int(used.max(initial=0))), -1, ground.dtype)
    for to, at, k in places:
        more[to, at] = k
    return np.concatenate([ground, more], 1)


def _link_back(g: Graph, level: int, new: np.ndarray, links: np.ndarray) -> None:
    """Adds the other direction of new links; full nodes choose again."""
    source, target = np.repeat(new, links.shape[1]), links.ravel()
    keep = target >= 0
    source, target = source[keep], target[keep]
    if not len(target):
        return
    cos = np.einsum("ij,ij->i", g.x[source], g.x[target])
    order = np.lexsort((-cos, target))
    source, target, cos = source[order], target[order], cos[order]
    nodes, first = np.unique(target, return_index=True)
    nth = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
    table = g.levels[level]
    width = table.shape[1]
    few = nth < width
    extra = np.full((len(nodes), width), -1)
    extra[np.searchsorted(nodes, target[few]), nth[few]] = source[few]
    cand = np.concatenate([table[nodes], extra], 1)
    cand[~_first_seen(cand)] = -1
    s = _similar(g.x, g.x[nodes], cand)
    best = np.argsort(-s, 1, kind="stable")
    cand, s = np.take_along_axis(cand, best, 1), np.take_along_axis(s, best, 1)
    table[nodes] = choose(g.x, cand, s, width)


def walk(g: Graph, q: np.ndarray, threshold: float, width: int, margin: float, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) above the threshold, in single precision less a hair: a beam, then all that hangs together.

    ``inside``: the queries are the graph's own nodes, and each walk sets out from its own node too.
    """
    found_q, found_x = [], []
    ground = g.levels[0]
    for low in range(0, len(q), QUERIES):
        part = q[low : low + QUERIES]
        ids, cos = g.beam(part, 0, g.descend(part, 0)[:, None], min(width, len(g.x) + 1))
        rows, k = np.nonzero(cos >= threshold - margin)
        nodes = ids[rows, k]
        if inside:
            rows, nodes = np.append(rows, np.arange(len(part))), np.append(nodes, np.arange(low, low + len(part)))
            cos_of = np.append(cos[np.nonzero(cos >= threshold - margin)], np.ones(len(part), np.float32))
        else:
            cos_of = cos[rows, k]
        seen = np.zeros((len(part), len(g.x)), bool)
        seen[rows, nodes] = True
        hit = cos_of >= threshold - 1e-5
        found_q.append(rows[hit] + low)
        found_x.append(nodes[hit])
        while len(rows):
            next_rows, next_nodes = [], []
            step = max(1, WALK_PAIRS // ground.shape[1])
            for at in range(0, len(rows), step):
                beside = ground[nodes[at : at + step]]
                r = np.repeat(rows[at : at + step], beside.shape[1])
                b = beside.ravel()
                ok = b >= 0
                r, b = r[ok], b[ok]
                ok = ~seen[r, b]
                key = np.unique(r[ok] * len(g.x) + b[ok])
                r, b = key // len(g.x), key % len(g.x)
                seen[r, b] = True
                s = np.einsum("ij,ij->i", part[r], g.x[b])
                hit = s >= threshold - 1e-5
                found_q.append(r[hit] + low)
                found_x.append(b[hit])
                near = s >= threshold - margin
                next_rows.append(r[near])
                next_nodes.append(b[near])
            rows, nodes = np.concatenate(next_rows), np.concatenate(next_nodes)
    return np.concatenate(found_q), np.concatenate(found_x)


def planted(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries, nodes): beside some nodes a query each, at a cosine just above the threshold."""
    r = np.random.default_rng(len(x))
    nodes = np.arange(len(x)) if len(x) <= PLANTED else np.sort(r.choice(len(x), PLANTED, replace=False))
    aside = r.standard_normal((len(nodes), x.shape[1]))
    aside -= (aside * x[nodes]).sum(1, keepdims=True) * x[nodes]
    size = np.sqrt((aside * aside).sum(1, keepdims=True))
    near = min(1.0, threshold + 0.002)
    q = near * x[nodes] + (1 - near * near) ** 0.5 * np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0)
    return q / np.sqrt((q * q).sum(1, keepdims=True)), nodes


def _verified(x: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that double precision confirms, looked at a block at a time."""
    parts = [np.einsum("ij,ij->i", q[a[k : k + WALK_PAIRS]], x[b[k : k + WALK_PAIRS]]) >= threshold for k in range(0, max(1, len(a)), WALK_PAIRS)]
    true = np.concatenate(parts)
    return a[true], b[true]


def block_links(g: Graph, x: np.ndarray, q: np.ndarray, q_ids: np.ndarray, same: bool, threshold: float, audits: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (query, node) of a block; of a shard with itself each pair once.

    ``audits`` takes a row for every audit: beam, links wanted and found, planted links wanted and found.
    """
    audit = np.argsort(q_ids * 2654435761 % 4294967291, kind="stable")[:AUDITED]
    exact = q[audit] @ x.T >= threshold
    if same:
        exact[np.arange(len(audit)), audit] = False
    rows, nodes = np.nonzero(exact)
    rows = audit[rows]
    if same:
        rows, nodes = np.minimum(rows, nodes), np.maximum(rows, nodes)
    real = rows * len(x) + nodes
    probes, _ = planted(x, threshold)
    probe_rows, probe_nodes = np.nonzero(probes @ x.T >= threshold)
    sown = probe_rows * len(x) + probe_nodes
    width, margin, turn = BEAM, MARGIN, 0
    while True:
        if width >= len(x) or turn > WIDENED:
            found_q, found_x = [], []
            for low in range(0, len(q), 512):
                r, b = np.nonzero(q[low : low + 512] @ x.T >= threshold)
                found_q.append(r + low)
                found_x.append(b)
            a, b = np.concatenate(found_q), np.concatenate(found_x)
        else:
            a, b = _verified(x, q, *walk(g, q.astype(np.float32), threshold, width, margin, same), threshold)
        if same:
            a, b = np.minimum(a, b), np.maximum(a, b)
            key = np.unique((a * len(x) + b)[a != b])
            a, b = key // len(x), key % len(x)
        if width >= len(x) or turn > WIDENED:
            return a, b
        hits = np.isin(real, a * len(x) + b).sum()
        pa_, pb_ = _verified(x, probes, *walk(g, probes.astype(np.float32), threshold, width, margin), threshold)
        probed = np.isin(sown, pa_ * len(x) + pb_).sum()
        if audits is not None:
            audits.append((width, len(real), int(hits), len(sown), int(probed)))
        if hits >= AUDIT_RECALL * len(real) and probed >= PLANTED_RECALL * len(sown):
            return a, b
        width, margin, turn = width * 2, margin + 0.02, turn + 1


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id")
    raw = np.array(rows["embedding"].tolist(), np.float64)
    ids = rows["id"].to_numpy(np.int64)
    g = build(unit(raw).astype(np.float32), ids)
    # single precision where it holds the elements exactly
    narrow = raw.astype(np.float32, copy=True) if np.abs(raw).max() < 3e38 else raw
    stored = narrow if (narrow == raw).all() else raw
    one = rows.iloc[0]
    return pd.DataFrame([{"label": one["label"], "dim": one["dim"], "shard": one["shard"], "n": len(rows), "ids": ids.tobytes(), "copies": rows["copies"].to_numpy(np.int64).tobytes(), "vectors": stored.tobytes(), "entry": g.entry, "levels": [t.tobytes() for t in g.levels]}])


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    """Unit vectors of a shard, stored in single or double precision."""
    return unit(np.frombuffer(data, np.float32 if len(data) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest, other) with the same components as the links (a, b): labels halve until they settle."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        while (after[after] != after).any():
            after = after[after]
        after = after[root]
        if (after == root).all():
            break
        root = after
    other = root != np.arange(len(nodes))
    return nodes[root[other]], nodes[other]


def _query(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each tile, its graphs first: links as (a, b, null), and for each class the copies it is linked with as (id, null, n)."""
    tile, graphs = None, []
    for batch in batches:
        for k in range(batch.num_rows):
            r = {f.name: batch.column(i)[k].as_py() for i, f in enumerate(batch.schema)}
            if r["tile"] != tile:
                tile, graphs = r["tile"], []
            ids, copies = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64)
            x = _vectors(r["vectors"], len(ids), r["dim"])
            if r["levels"] is not None:
                levels = [np.frombuffer(t, np.int32).reshape(len(ids), -1).astype(np.int64) for t in r["levels"]]
                graphs.append((r["shard"], ids, copies, x, Graph(x.astype(np.float32), levels, r["entry"])))
                continue
            for shard, g_ids, g_copies, g_x, g in graphs:
                if shard > r["shard"]:
                    continue
                a, b = block_links(g, g_x, x, ids, shard == r["shard"], threshold)
                n = np.concatenate([np.bincount(a, g_copies[b], len(ids)), np.bincount(b, copies[a], len(g_ids))]).astype(np.int64)
                who = np.concatenate([ids, g_ids])
                linked = np.flatnonzero(n)
                root, other = _forest(ids[a], g_ids[b]) if len(a) else (np.empty(0, np.int64),) * 2
                none_l, none_n = [None] * len(root), [None] * len(linked)
                yield pa.RecordBatch.from_arrays([pa.array([*root.tolist(), *who[linked].tolist()], pa.int64()), pa.array([*other.tolist(), *none_n], pa.int64()), pa.array([*none_l, *n[linked].tolist()], pa.int64())], schema=_FOUND)


def _tiles(shards: DataFrame, per: DataFrame, tile: int) -> DataFrame:
    """Rows of every tile (i, j), i <= j, of a label: graphs of the shards of part i, then queries of the shards of part j.

    A shard goes as a graph to the tiles of its row and as queries to those of its column.
    Labels of few shards have smaller tiles, so that there are enough of them to share out.
    """
    side = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.col("shards") / 8)))
    part = F.floor(F.col("shard") / side).cast("int")
    last = F.floor((F.col("shards") - 1) / side).cast("int")
    known = shards.join(per, ["label", "dim"])
    name = lambda i, j: F.concat_ws(":", F.length("label").cast("string"), "label", F.col("dim").cast("string"), i.cast("string"), j.cast("string"))
    columns = ["dim", "shard", "ids", "copies", "vectors"]
    graphs = known.withColumn("j", F.explode(F.sequence(part, last))).select(name(part, F.col("j")).alias("tile"), F.lit(0).alias("role"), *columns, "entry", "levels")
    queries = known.withColumn("i", F.explode(F.sequence(F.lit(0), part))).select(name(F.col("i"), part).alias("tile"), F.lit(1).alias("role"), *columns, F.lit(None).cast("int").alias("entry"), F.lit(None).cast("array<binary>").alias("levels"))
    return graphs.unionByName(queries).repartition("tile").sortWithinPartitions("tile", "role", "shard")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, shard_rows: int = SHARD_ROWS, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal label and dimension are linked where the cosine is at least ``threshold``;
    component_id is the smallest vec_id that links reach, its own included. Rows with a null
    label, and vectors that are null, empty, zero or hold null or non-finite numbers, are
    linked with nothing: n_links 0, component their own vec_id. Equal vectors are linked,
    whatever their vec_ids; rows that repeat a vec_id count as rows. No rows give no rows;
    other columns, whatever their names, don't matter.
    """
    work = Work(vectors.sparkSession, "vectors")
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = good & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    label = F.col("label").cast("string")
    # the label's length comes first: no label can look like a shorter one and an element
    key = F.md5(F.concat_ws(",", F.length(label).cast("string"), label, F.col("embedding").cast("array<string>")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), "embedding", F.when(F.coalesce(good, F.lit(False)), key).alias("key"))
    rows = work.keep(rows, "rows")
    classes = rows.filter("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = work.keep(classes.withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "classes")
    per = work.keep(classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards")), "sizes")
    dealt = classes.join(per, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    shards = dealt.select("id", "label", "dim", "shard", "copies", "embedding").groupBy("label", "dim", "shard").applyInPandas(_build, SHARD)
    shards = work.keep(shards, "shards")
    found = work.keep(_tiles(shards, per, tile).mapInArrow(lambda x: _query(x, threshold), FOUND), "found")
    known = components(found.filter("b is not null").select("a", "b"), work)
    count = found.filter("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    named = classes.select("id", "key", "first", "copies").join(known, "id", "left").join(count, "id", "left")
    named = work.keep(named.withColumn("component", F.coalesce("component", "id")), "named")
    linked = named.filter("others is not null").groupBy("component").agg(F.min("first").alias("least"))
    final = named.join(linked, "component", "left").select(F.col("key").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("least", "first").alias("least"))
    out = rows.select("vec_id", "key").join(work.keep(final, "final"), F.col("key") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
"""
