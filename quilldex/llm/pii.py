"""Personal data: fixed patterns, and contextual extraction that bootstraps from them.

Spans of the fixed patterns are seeds, and so are long hexadecimal words, the seeds of the
kind ``secret``. The two words before and the two after a seed are lexical patterns; tokens
that look like identifiers are instances. Spark scores the graph of patterns and instances
in rounds: a pattern by the share of its slots, over the whole corpus, that confident
instances fill, an instance by its patterns. What stands in a slot of a pattern that is
confident in the end, and isn't a base span, is found too. A secret is found by its pattern
alone: a hexadecimal word elsewhere is none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, trimmed
from .textvec import mix, texts_of, word_hashes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SECRET = KINDS.index("secret")
# Fixed patterns
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
LIKE = re.compile(r"[0-9@]")
HEX = re.compile(r"(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+")
OUTER = ".,;:!?\"'()[]{}<>*%$#&|=/\\`~^"

#: Distinct seeds that a pattern needs, its share of filled slots, rounds of scoring, shortest identifier.
LEAST_SEEDS, CONFIDENT, ROUNDS, LEAST_CHARS = 5, 0.8, 3, 5
#: Patterns that a task holds in one pass over the texts (8 bytes each); more take more passes.
BLOCK_PATTERNS = 1_000_000
SLICE_ROWS = 500
SPAN = "struct<k:int,s:int,e:int>"
MENTION = "struct<k:int,s:int,e:int,before:bigint,after:bigint,inst:bigint>"
FOUND = f"rid long, doc_id long, base array<{SPAN}>, mentions array<{MENTION}>"
_SPAN = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
_MENTION = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("before", pa.int64()), ("after", pa.int64()), ("inst", pa.int64())])
_FOUND = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("mentions", pa.list_(_MENTION))])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48 << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @: the name reaches back as far as it can."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start. Matches that fail their test are dropped, without retries."""
    out = [(0, s, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text) is None:
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def places_of(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], list[int], list[int]]:
    """(kind or -1, start, end) of base spans and other identifiers, and where the words of the text start and end."""
    taken = sorted((s, e) for _, s, e in base)
    places, starts, ends = list(base), [], []
    nth = 0
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
        if LIKE.search(m[0]) is None:
            continue
        inner = m[0].strip(OUTER)
        start = m.start() + len(m[0]) - len(m[0].lstrip(OUTER))
        end = start + len(inner)
        while nth < len(taken) and taken[nth][1] <= start:
            nth += 1
        free = not any(s < end and start < e for s, e in taken[max(0, nth - 1) : nth + 4])
        if free and len(inner) >= LEAST_CHARS and LIKE.search(inner):
            places.append((SECRET if HEX.fullmatch(inner) else -1, start, end))
    return places, starts, ends


def _pairs(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = owner[1:] == owner[:-1]
    return mix(words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:])[near].view(np.int64), owner[1:][near]


class Mentions:
    """Base spans and other identifiers of some texts, with the numbers of their patterns: the words of a text
    are read once and hashed, so that contexts of whole words cost the same however long the words are.

    ``before`` and ``after`` number the two words there, 0 if there aren't two; they differ in their last bit.
    """

    def __init__(self, texts: list[str | None]):
        self.base, self.sizes = [], []
        self.k, self.s, self.e, names = [], [], [], []
        like, left, right = [], [], []
        n_words = 0
        for text in texts:
            base = base_spans(text) if text else []
            self.base.append(base)
            if not text or LIKE.search(text) is None:
                self.sizes.append(0)
                continue
            places, starts, ends = places_of(text, base)
            self.sizes.append(len(places))
            if not places:
                continue
            like.append(text.encode())
            low, high = n_words, n_words + len(starts)
            for k, s, e in places:
                first, last = bisect_right(starts, s) - 1 + low, bisect_right(starts, e - 1) - 1 + low
                left.append(first - 2 if first - 2 >= low else -1)
                right.append(last + 1 if last + 2 < high else -1)
                self.k.append(k)
                self.s.append(s)
                self.e.append(e)
                names.append(text[s:e].lower())
            n_words = high
        words = word_hashes(like)[0] if like else np.empty(0, np.uint64)
        pair = mix(words[:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:]).view(np.int64) & ~1 if len(words) > 1 else np.zeros(1, np.int64)
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        self.before = np.where(left >= 0, pair[np.maximum(left, 0)], 0)
        self.after = np.where(right >= 0, pair[np.maximum(right, 0)] | 1, 0)
        self.instances = _instance_ids(names)


def _list_of(fields: list[tuple[pa.Field, list | np.ndarray]], sizes: list[int]) -> pa.Array:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in fields]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays(arrays, fields=[f for f, _ in fields]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            found = Mentions(part.column(1).to_pylist())
            spans = [x for base in found.base for x in base]
            base = _list_of([(f, [x[k] for x in spans]) for k, f in enumerate(_SPAN)], [len(x) for x in found.base])
            sides = [pa.array(x, pa.int64(), mask=x == 0) for x in (found.before, found.after)]
            mentions = _list_of([*zip(_MENTION, (found.k, found.s, found.e, *sides, found.instances), strict=True)], found.sizes)
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + n), pa.int64()), part.column(0), base, mentions], schema=_FOUND)
            rid += n


def _instance_ids(texts: list[str]) -> list[int]:
    """One number for a whole identifier, blanks in it included."""
    words, counts, _ = word_hashes([t.replace(" ", "\x00").encode() for t in texts])
    out = np.zeros(len(texts), np.uint64)
    np.add.at(out, np.repeat(np.arange(len(texts)), counts), words)
    return out.view(np.int64).tolist()


def _count(batches: Iterator[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each wanted pattern's words occur."""
    total = np.zeros(len(wanted), np.int64)
    plain = np.unique(wanted & ~1)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            texts = texts_of(batch.slice(at, SLICE_ROWS).column(0))
            words, counts, _ = word_hashes(texts)
            ids, _ = _pairs(words, np.repeat(np.arange(len(texts)), counts))
            ids &= ~1
            place = np.minimum(np.searchsorted(plain, ids), len(plain) - 1)
            hits = np.bincount(place[plain[place] == ids], minlength=len(plain))
            total += hits[np.searchsorted(plain, wanted & ~1)]
    yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(total)], names=["pattern", "slots"])


def _blocks(patterns: DataFrame, work: Work) -> Iterator[np.ndarray]:
    """The distinct patterns in blocks that a task can hold, sorted."""
    n = patterns.count()
    parts = max(1, -(-n // (BLOCK_PATTERNS // 2)))
    for k in range(parts):
        block = patterns if parts == 1 else patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k)
        found = np.sort(np.array([r.pattern for r in block.select("pattern").distinct().collect()], np.int64))
        if len(found):
            yield found


def slots_of(docs: DataFrame, patterns: DataFrame, work: Work) -> DataFrame:
    """(pattern, slots) over all texts; one pass for each block of patterns."""
    out = None
    for wanted in _blocks(patterns, work):
        sent = docs.sparkSession.sparkContext.broadcast(wanted)  # at most 8 MB
        part = docs.select("text").mapInArrow(trimmed(lambda b, sent=sent: _count(b, sent.value)), "pattern long, slots long")
        part = part.filter("slots > 0").groupBy("pattern").agg(F.sum("slots").alias("slots"))
        out = part if out is None else out.unionByName(part)
    return out


def find(docs: DataFrame, work: Work) -> DataFrame:
    """Base spans and mentions of every row (FOUND's columns), written; rid numbers the rows."""
    return work.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(_find), FOUND), "found")


def learn(docs: DataFrame, found: DataFrame, work: Work) -> DataFrame:
    """(pattern, k): the confident patterns and the kind each finds; no rows if there are none."""
    mention = found.select(F.explode("mentions").alias("m")).select("m.*")
    sides = F.explode(F.array_compact(F.array("before", "after"))).alias("pattern")
    edges = work.keep(mention.select(sides, "inst", "k").groupBy("pattern", "inst", "k").agg(F.count("*").alias("n")), "edges")
    seeded = edges.filter("k >= 0").groupBy("pattern", "k").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS)
    seeded = work.keep(seeded, "seeded")
    nothing = seeded.select("pattern", "k")
    if seeded.isEmpty():
        return nothing
    slots = work.keep(slots_of(docs, seeded, work), "slots")
    # a pattern can't become confident unless identifiers fill that share of its slots at all
    filled = edges.groupBy("pattern").agg(F.sum("n").alias("filled"))
    able = seeded.join(slots, "pattern").join(filled, "pattern").filter(F.col("filled") >= CONFIDENT * (F.col("slots") + 1)).select("pattern", "k", "slots")
    able = work.keep(able, "able")
    if able.isEmpty():
        return nothing.limit(0)
    graph = work.keep(edges.join(able.select("pattern").distinct(), "pattern", "left_semi"), "graph")
    seeds = graph.filter("k >= 0").select("pattern", "k", F.col("n").cast("double").alias("v"))
    unknown = graph.filter("k < 0").select("pattern", "inst", "n")
    sure = seeds.groupBy("pattern", "k").agg(F.sum("v").alias("v"))
    scored = None
    for _ in range(ROUNDS):
        mass = sure if scored is None else sure.unionByName(
            unknown.join(
                unknown.join(scored, "pattern").groupBy("inst", "k").agg((1 - F.exp(F.sum(F.log1p(-F.least("score", F.lit(0.999)))))).alias("c")), "inst"
            ).groupBy("pattern", "k").agg(F.sum(F.col("n") * F.col("c")).alias("v"))
        ).groupBy("pattern", "k").agg(F.sum("v").alias("v"))
        scored = work.keep(mass.join(able, ["pattern", "k"]).select("pattern", "k", (F.col("v") / (F.col("slots") + 1)).alias("score")), "scored")
    best = scored.filter(F.col("score") >= CONFIDENT).groupBy("pattern").agg(F.max_by(F.struct("k"), F.struct("score", -F.col("k"))).alias("b"))
    return work.keep(best.select("pattern", "b.k"), "confident")


def extract(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, base and spans, arrays of (k, s, e).

    k counts KINDS, s and e are code points, e exclusive; both arrays are sorted by kind and
    start. ``spans`` are the base spans and those that confident patterns add, which never
    overlap a base span and have the kind of their pattern, ``secret`` perhaps. Null and empty
    texts have none; repeated rows are found alike, each row on its own; no rows give no rows,
    and other columns, whatever their names, don't matter. A text is read in time that grows
    with its length, words of any length included, within the task that holds it.
    """
    work = Work(docs.sparkSession, "pii")
    found = find(docs, work)
    confident = learn(docs, found, work)
    if confident.isEmpty():
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    free = found.select("rid", F.explode("mentions").alias("m")).select("rid", "m.*").filter(f"k < 0 or k >= {SECRET}").drop("k")
    slot = free.select("rid", "s", "e", F.explode(F.array_compact(F.array("before", "after"))).alias("pattern")).join(confident, "pattern")
    added = slot.groupBy("rid", "s", "e").agg(F.min("k").alias("k")).groupBy("rid").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    both = found.select("rid", "doc_id", "base").join(added, "rid", "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def spans_text(column: str):
    """kind:start:end of an array of spans, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", name(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return spans.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's kind in its place; of overlapping spans the first, then the longest."""
    out, at = [], 0
    for s, _, e, k in sorted((s, -e, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def _spans_by(found: Mentions, kind_of: dict[int, int]) -> list[list[tuple[int, int, int]]]:
    """For each text what stands in the slots of the patterns."""
    out, at = [], 0
    before, after = found.before.tolist(), found.after.tolist()
    for n in found.sizes:
        spans = []
        for k in range(at, at + n):
            if not 0 <= found.k[k] < SECRET and (hit := [kind_of[p] for p in (before[k], after[k]) if p in kind_of]):
                spans.append((min(hit), found.s[k], found.e[k]))
        out.append(spans)
        at += n
    return out


def _redact(batches: Iterator[pa.RecordBatch], patterns: np.ndarray, kinds: np.ndarray, name: str, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Adds what a block of patterns finds to the column ``name``; the last block masks the texts instead."""
    kind_of = dict(zip(patterns.tolist(), kinds.tolist(), strict=True))
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(low, SLICE_ROWS)
            place = part.schema.get_field_index("text")
            texts = part.column(place).to_pylist()
            found = Mentions(texts)
            spans = _spans_by(found, kind_of)
            if not first:
                at = part.schema.get_field_index(name)
                spans = [[*a, *((x["k"], x["s"], x["e"]) for x in b)] for a, b in zip(spans, part.column(at).to_pylist(), strict=True)]
                part = pa.RecordBatch.from_arrays([c for k, c in enumerate(part.columns) if k != at], schema=part.schema.remove(at))
            if last:
                masked = [mask(t, [*base, *more]) if base or more else t for t, base, more in zip(texts, found.base, spans, strict=True)]
                yield part.set_column(place, part.schema.field(place), pa.array(masked, pa.string()))
            else:
                flat = [x for more in spans for x in more]
                yield part.append_column(name, _list_of([(f, [x[k] for x in flat]) for k, f in enumerate(_SPAN)], [len(x) for x in spans]))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans that extract() finds masked by their kind; other columns as they are.

    Null, empty, repeated and very long texts and empty tables are as in extract(). Confident
    patterns go to the tasks in blocks; usually there is one block or none. Each block looks
    at the texts as they came, and the last one masks what all have found.
    """
    work = Work(docs.sparkSession, "redact")
    confident = learn(docs, find(docs, work), work)
    n = confident.count()
    parts = max(1, -(-n // BLOCK_PATTERNS))
    name = "_spans"
    while name in docs.columns:
        name = f"_{name}"
    schema = docs.schema
    more = T.StructType([*schema.fields, T.StructField(name, T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "kse"])))])
    for part in range(parts):
        rows = confident.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()
        sent = docs.sparkSession.sparkContext.broadcast((np.array([r.pattern for r in rows], np.int64), np.array([r.k for r in rows], np.int64)))
        ends = part == 0, part == parts - 1
        docs = docs.mapInArrow(trimmed(lambda b, sent=sent, ends=ends: _redact(b, *sent.value, name, *ends)), schema if ends[1] else more)
    return docs
