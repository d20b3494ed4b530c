"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles; equal sets are one class. Every class is a sketch of
minwise tokens. A node of a tree is a set of classes; a branch keeps those that share one
selected token, so similar sets stay together with a probability of their similarity,
and others part quickly. Nodes small enough are compared exhaustively, larger ones branch
on, and independent trees are repeated to reach the target recall.

Comparing goes in two steps of the same exploration. Sketches first: what may be similar
falls into families. Then whole sets, gathered once for each family: links are confirmed
exactly. Tasks give a node's links as a forest of its components, as many rows as members
at most, so that no group of copies is expanded into its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .common import Work, trimmed
from .components import components
from .textvec import mix, texts_of, word_hashes

#: Independent trees, of which no two select the same token at the root: a pair of similarity 0.85 shares
#: none of their first nodes once in four million times, one of 0.80 once in 400,000.
TREES = 8
TOKENS = 64
#: Deviations below the expected number of agreeing tokens at which a pair is no candidate any more.
DEVIATIONS = 5
#: Nodes up to this many members and shingles are compared in one task.
NODE_MEMBERS, NODE_SHINGLES = 4096, 4_000_000
#: Large nodes branch this often before stars around a pivot join and prune them; and at most.
PLAIN_LEVELS, LEVELS = 3, 16
SLICE_ROWS = 500
_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), ("key", pa.binary())])
_SETS = pa.schema([("digest", pa.binary()), ("data", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles; shorter texts are one shingle, empty ones none."""
    words, counts, _ = word_hashes(texts)
    rolled = words[: max(0, len(words) - width + 1)].copy()
    for k in range(1, width):
        rolled = mix(rolled * _STEP + words[k : k + len(rolled)])
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            short = words[at : at + 1] ^ np.uint64(n)
            for k in range(1, n):
                short = mix(short * _STEP + words[at + k : at + k + 1])
            out.append(mix(short))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of sets that aren't empty, a row each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.empty((len(sets), TOKENS), "<u4")
    first = 0
    while first < len(sets):  # about a million shingles at a time, one set at least
        last = max(first + 1, int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 20)) + first)
        part, starts = np.concatenate(sets[first:last]), np.cumsum(sizes[first:last]) - sizes[first:last]
        for j in range(TOKENS):
            out[first:last, j] = np.minimum.reduceat(((part ^ _FLIP[j]) * _FACTOR[j]) >> np.uint64(32), starts)
        first = last
    return out


def digest_of(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            sets = shingle_sets(texts_of(part.column(1)), width)
            full = [s for s in sets if len(s)]
            lines = iter(sketches(full)) if full else iter(())
            digests = [digest_of(s) if len(s) else None for s in sets]
            sketch = [next(lines).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary()), part.column(2)], schema=_ROWS)


def _pick(batches: Iterator[pa.RecordBatch], width: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets whose digests the filter may hold, each once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            sets = [s for s in shingle_sets(texts_of(batch.column(0).slice(at, SLICE_ROWS)), width) if len(s)]
            digests, keys, data = [digest_of(s) for s in sets], [], []
            for k in np.flatnonzero(bloom.may_hold(bits, digests)).tolist():
                if digests[k] not in seen:
                    seen.add(digests[k])
                    keys.append(digests[k])
                    data.append(sets[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(data, pa.binary())], schema=_SETS)


def forest(near: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the lowest index that each index is connected with."""
    m = len(near)
    root = np.full(m, -1)
    for k in range(m):
        if root[k] >= 0:
            continue
        root[k] = k
        todo = np.flatnonzero(near[k] & (root < 0))
        while len(todo):
            root[todo] = k
            reached = near[todo].any(0) if len(todo) < 64 else np.logical_or.reduce(near[todo], 0)
            todo = np.flatnonzero(reached & (root < 0))
    return root


def near_by_sketch(sketch: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    agree = np.zeros((len(n), len(n)), np.int8)
    for column in sketch.T:
        agree += column[:, None] == column[None, :]
    share = percent / 100
    least = int(TOKENS * share - DEVIATIONS * (TOKENS * share * (1 - share)) ** 0.5)
    return (agree >= least) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))


def near_by_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Exact: 100 * intersection >= percent * union, for all pairs of a node.

    Shingles that many members share are columns of a matrix product, rarer ones are
    counted along their lists of members.
    """
    m = len(sets)
    n = np.fromiter(map(len, sets), np.int64, m)
    if m == 2:
        both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
        both[1] = both[1, ::-1]
    else:
        _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), n)
        both = np.zeros((m, m), np.float32 if n.max() < 1 << 24 else np.float64)
        common = df > max(8, m // 8)
        columns = np.cumsum(common) - 1
        for low in range(0, int(common.sum()), 2048):
            here = common[token] & (columns[token] >= low) & (columns[token] < low + 2048)
            block = np.zeros((m, 2048), both.dtype)
            block[owner[here], columns[token[here]] - low] = 1
            both += block @ block.T
        rare = np.flatnonzero((df[token] > 1) & ~common[token])
        if len(rare):
            order = rare[np.argsort(token[rare], kind="stable")]
            members, kinds = owner[order], token[order]
            start = np.searchsorted(kinds, token[rare], side="left")
            size = df[token[rare]]
            cuts = np.searchsorted(owner[rare], np.arange(m + 1))
            for i in range(m):
                s, z = start[cuts[i] : cuts[i + 1]], size[cuts[i] : cuts[i + 1]]
                if len(s):
                    at = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(int(z.sum()))
                    both[i] += np.bincount(members[at], minlength=m)
    return 100 * both >= percent * (n[:, None] + n[None, :] - both)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first column, which come together."""
    open_rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if open_rows and open_rows[0][0] != row[0]:
                yield open_rows
                open_rows = []
            open_rows.append(row)
    if open_rows:
        yield open_rows


def _near(data: list[bytes], n: list[int], percent: int, exact: bool) -> np.ndarray:
    if exact:
        return near_by_sets([np.frombuffer(x, "<u8") for x in data], percent)
    return near_by_sketch(np.frombuffer(b"".join(data), "<u4").reshape(len(data), TOKENS), np.array(n), percent)


def _compare_nodes(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links of each node (node, id, n, data): every member with the first one of its component."""
    a, b = [], []
    for rows in _groups(batches):
        _, ids, n, data = zip(*rows, strict=True)
        root = forest(_near(data, n, percent, exact)).tolist()
        for k, r in enumerate(root):
            if r != k:
                a.append(ids[r])
                b.append(ids[k])
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def _compare_pairs(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for x, y, nx, ny, dx, dy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if _near([dx, dy], [nx, ny], percent, exact)[0, 1]:
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)


def branch(members: DataFrame, tokens: DataFrame, trees: int, twice: bool) -> DataFrame:
    """Children of nodes: (node, id, n). Which tokens are selected depends on the node alone.

    Each tree selects one token, or two with ``twice`` so that enough paths go on; all
    tokens that a node selects differ.
    """
    each = 2 if twice else 1
    first, step = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS)), 2 * F.pmod(F.xxhash64("node", F.lit(2)), F.lit(TOKENS // 2)) + 1
    picks = [F.struct(F.lit(k // each).alias("t"), F.pmod(first + k * step, F.lit(TOKENS)).cast("int").alias("c")) for k in range(trees * each)]
    paths = members.join(tokens, "id").withColumn("p", F.explode(F.array(*picks)))
    child = F.xxhash64("node", "p.t", "p.c", F.expr("substring(sketch, 4 * p.c + 1, 4)"))
    return paths.select(child.alias("node"), "id", "n").distinct()


def explore(members: DataFrame, tokens: DataFrame, data: DataFrame, work: Work, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) found in nodes ``members`` (node, id, n), comparing ``data`` (id, data).

    Small nodes are compared; large ones branch. After PLAIN_LEVELS a large node's members
    are also compared with one pivot, and nodes that lie within one component are dropped:
    nothing in them can join anything any more. What is still large at the last level is
    compared in pairs of blocks.
    """
    found: list[DataFrame] = []
    for level in range(LEVELS + 1):
        last = level == LEVELS
        size = members.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("weight"), F.min("id").alias("pivot")).filter("m > 1")
        small = (F.col("m") <= NODE_MEMBERS) & (F.lit(not exact) | (F.col("weight") <= NODE_SHINGLES) | (F.col("m") == 2))
        # only what is in no node alone goes on; one written table serves both kinds of nodes
        sized = work.keep(members.join(size, "node").select("node", "id", "n", "pivot", small.alias("small")), "nodes")
        found.append(work.keep(_leaves(sized.filter("small").select("node", "id", "n"), data, percent, exact), "links"))
        large = sized.filter("not small").select("node", "id", "n", "pivot")
        if large.isEmpty():
            break
        if level >= PLAIN_LEVELS or last:
            stars = large.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
            one = data.select(F.col("id").alias("b"), F.col("data").alias("db"))
            pivot = data.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("data").alias("da"))
            pairs = stars.join(one, "b").join(pivot, "a").select("a", "b", "na", "nb", "da", "db")
            found.append(work.keep(pairs.mapInArrow(trimmed(lambda x: _compare_pairs(x, percent, exact)), "a long, b long"), "stars"))
            known = components(_all(found), work)
            label = F.coalesce("component", "id")
            large = large.join(known, "id", "left").withColumn("label", label)
            mixed = large.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("node")
            large = work.keep(large.join(mixed, "node", "left_semi").select("node", "id", "n"), "mixed")
            if large.isEmpty():
                break
        if last:
            found.append(work.keep(_leaves(_block_pairs(large.select("node", "id", "n"), exact), data, percent, exact), "links"))
            break
        members = work.keep(branch(large.select("node", "id", "n"), tokens, TREES if exact and not level else 1, True), "branches")
    return _all(found)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _leaves(members: DataFrame, data: DataFrame, percent: int, exact: bool) -> DataFrame:
    rows = members.join(data.select("id", "data"), "id").select("node", "id", "n", "data")
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(trimmed(lambda x: _compare_nodes(x, percent, exact)), "a long, b long")


def _block_pairs(members: DataFrame, exact: bool) -> DataFrame:
    """Nodes of two blocks each, so that every pair of a node's members meets in one."""
    half = NODE_SHINGLES // 4 if exact else NODE_MEMBERS // 4
    per = members.groupBy("node").agg((F.ceil((F.sum("n") if exact else F.count("*")) / half)).cast("int").alias("blocks"))
    rows = members.join(per, "node").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other)
    return rows.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "id", "n")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id reachable by links, its own included, and
    the row with that doc_id is kept. A text with fewer words is one shingle; one without
    words, null too, has none and is linked with nothing; a very long text is a set like any
    other, 8 bytes a shingle in the task that reads it. Equal sets are linked. Rows that
    repeat a doc_id are compared by their own texts; null doc_ids never name a component
    unless it has no other. No rows give no rows; other columns don't matter.
    """
    work = Work(docs.sparkSession, "near")
    rows, named = _classes(docs, work, width, percent)
    named = named.select(F.col("digest").alias("key"), "component_id")
    out = rows.select("doc_id", "n", "digest").join(named, F.col("digest") == F.col("key"), "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _key(text: str):
    return F.unhex(F.md5(text)).alias("key")


def _classes(docs: DataFrame, work: Work, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, digest, sketch, key) and classes (digest, component, first, component_id), both written.

    ``component`` numbers the components; ``first`` is the smallest doc_id of the class; ``key``
    tells a text by itself, so that it is found again without its shingles. Texts
    are read and shingled again where they are needed again: a written copy of them would cost
    more disk than the rest of the work.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _key("text"))
    rows = rows.mapInArrow(trimmed(lambda x: _rows(x, width)), "doc_id long, n long, digest binary, sketch binary, key binary")
    rows = work.keep(rows, "rows")
    full = rows.filter("digest is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = work.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("id", "sketch")
    roots = branch(classes.select(F.lit(0).cast("long").alias("node"), "id", "n"), tokens, TREES, False)
    maybe = explore(work.keep(roots, "roots"), tokens, classes.select("id", "n", F.col("sketch").alias("data")), work, percent, False)
    family = work.keep(components(maybe, work).join(classes.select("id", "n", "digest"), "id"), "families")
    sets = work.keep(_sets_of(docs, family, width), "sets", "none")
    links = explore(family.select(F.col("component").alias("node"), "id", "n"), tokens, sets, work, percent, True)
    known = components(links, work)
    named = classes.select("id", "digest", "first").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = work.keep(named, "named")
    # of a class alone its first is the component's; only linked classes meet their component's others
    linked = named.join(known.select(F.col("component").alias("of")).distinct(), F.col("component") == F.col("of"), "left_semi")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(least, "component", "left").select("digest", "component", "first", F.coalesce("least", "first").alias("component_id"))
    return rows, work.keep(named, "components")


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns as they are.

    It is a row of the class that holds the group's smallest doc_id, and of repeated rows
    there the first by text. Rows without words, null and empty texts too, are in no group
    and stay. Very long texts, null doc_ids and no rows are as in near_duplicates().
    """
    work = Work(docs.sparkSession, "keep")
    rows, named = _classes(docs, work, width, percent)
    # only texts of classes that lose rows take part in the join: those not kept, and kept ones with copies
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest"))
    winners = named.groupBy("component").agg(best.alias("w")).select("component", "w.digest")
    lost = named.join(winners.withColumnRenamed("digest", "winner"), "component").select("digest", "first", (F.col("digest") == F.col("winner")).alias("wins"))
    copies = rows.filter("digest is not null").select("doc_id", "digest").join(named.select(F.col("digest").alias("d"), "first"), F.col("digest") == F.col("d"))
    copies = copies.groupBy("digest").agg(F.count("*").alias("copies"), F.count_if(F.col("doc_id").eqNullSafe(F.col("first"))).alias("again"))
    losing = lost.join(copies, "digest").filter("not wins or copies > 1").select("digest", "first", "wins", "again")
    keys = rows.filter("digest is not null").select(F.col("key").alias("of"), "digest").distinct()
    plan = work.keep(keys.join(losing, "digest"), "plan")
    # a row's columns travel as one, so that none can clash with the plan's
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key("text"))
    # what the filter does not hold is in no such class and stays as it is; only the rest is shuffled to meet the plan
    told = bloom.with_hits(packed, "key", bloom.sent(plan, "of", plan.count()))
    met = told.filter("hit").join(plan, F.col("key") == F.col("of"), "left")
    joined = met.filter(F.col("of").isNull() | (F.col("wins") & F.col("row.doc_id").cast("long").eqNullSafe(F.col("first"))))
    out = told.filter("not hit").select("row.*").unionByName(joined.filter("of is null or again = 1").select("row.*"))
    if not plan.filter("wins and again > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("digest").orderBy("row.text"))
        out = out.unionByName(joined.filter("again > 1").withColumn("nth", nth).filter("nth = 1").select("row.*"))
    return out


def _sets_of(docs: DataFrame, family: DataFrame, width: int) -> DataFrame:
    """(id, n, data) of the classes in families.

    Texts are read and shingled once more. A Bloom filter of the families' digests, 16 MB at
    most, tells which sets go on; the join with the digests takes the few wrong ones out. No
    text is shuffled, and sets of other classes aren't either, as long as the filter isn't full.
    """
    key = family.select("id", "n", "digest")
    bits = bloom.sent(key, "digest", key.count())
    picked = docs.select("text").mapInArrow(trimmed(lambda x: _pick(x, width, bits.value)), "digest binary, data binary")
    return picked.join(key, "digest").groupBy("id").agg(F.first("n").alias("n"), F.first("data").alias("data"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM words),
shingles AS (SELECT DISTINCT doc_id, s FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON a = d.doc_id
"""
