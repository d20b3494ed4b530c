"""Language by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cut greedily
into the longest phrases that occur in that labelled text; phrases times the logarithm
of the labelled text's length estimate the bits that the text takes in that language,
and the language that needs fewest wins.

An automaton keeps the transitions of a language's commonest letters in a dense table and
all others, of scripts with thousands of letters too, in a sorted list; which of them a
letter takes changes no result. All chunks of a batch of texts walk through an automaton in
lockstep, one character a step, each from the start of a phrase. Then the walk of every
chunk goes on into the next until it starts a phrase where that chunk's own walk started
one: from there on both agree, so the phrases are those of one walk over the whole text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, model, trimmed

UND = "und"
#: Bounds of the labelled sample: documents of a language, characters of a document, of a language, and of all
#: languages (beyond 80 each gets fewer), and languages, those of most labelled documents.
SAMPLE_DOCS, SAMPLE_CHARS, LANGUAGE_CHARS, TOTAL_CHARS, MOST_LANGS = 96, 1500, 50_000, 4_000_000, 2000
#: Bytes of the dense tables of a worker together, and their columns at most: a matter of speed alone.
TABLE_BYTES, DENSE = 160 << 20, 64
#: Chunks of a text that walk at the same time, characters that a walk goes on in lockstep to meet the next one's,
#: and texts that are parsed together: a matter of speed alone.
CHUNK, MEET = 1024, 64
SLICE_ROWS = 2000
#: A text of so many characters is in none of the languages if even the best one's phrases are shorter on average.
LEAST_CHARS, SHORTEST_PHRASE = 40, 2.0
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("phrase_chars", pa.float64())])
PREDICTED = "doc_id long, lang_pred string, score double, phrase_chars double"


def suffix_automaton(text: list[int], width: int) -> tuple[array, dict[int, dict[int, int]], int]:
    """(dense transitions, other transitions, number of states) of the automaton that reads every substring of ``text`` from state 0.

    Transitions of letters below ``width`` lie in one flat array, ``width`` to a state, -1 for
    none; those of others in a dictionary for each state that has any.
    """
    nxt = array("i", [-1]) * (width * (2 * len(text) + 2))
    more: dict[int, dict[int, int]] = {}
    link, length, last, size = [-1], [0], 0, 1
    for c in text:
        cur, size = size, size + 1
        length.append(length[last] + 1)
        link.append(0)
        p, q = last, -1
        while p >= 0:
            q = nxt[p * width + c] if c < width else more.get(p, {}).get(c, -1)
            if q >= 0:
                break
            if c < width:
                nxt[p * width + c] = cur
            else:
                more.setdefault(p, {})[c] = cur
            p = link[p]
        if p >= 0:
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone, size = size, size + 1
                nxt[clone * width : (clone + 1) * width] = nxt[q * width : (q + 1) * width]
                if q in more:
                    more[clone] = dict(more[q])
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and (nxt[p * width + c] if c < width else more.get(p, {}).get(c, -1)) == q:
                    if c < width:
                        nxt[p * width + c] = clone
                    else:
                        more[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt, more, size


class Automaton:
    """One language: its own numbering of letters, 0 for none, 1 for those that its labelled text lacks."""

    def __init__(self, classes: np.ndarray, n_classes: int, width: int):
        seen, times = np.unique(classes[classes > 1], return_counts=True)
        ordered = seen[np.lexsort((seen, -times))]
        self.letter = np.ones(n_classes, np.int32)
        self.letter[0] = 0
        self.letter[ordered] = np.arange(2, len(ordered) + 2)
        self.size, self.width = len(ordered) + 2, min(width, len(ordered) + 2)
        flat, more, states = suffix_automaton(self.letter[classes].tolist(), self.width)
        dense = np.full((states + 1, self.width), -1, np.int32)
        dense[:states] = np.frombuffer(flat, np.int32)[: states * self.width].reshape(states, self.width)
        # a character that the labelled text lacks is a phrase of its own: a last state that nothing leaves
        dense[0][dense[0] < 0] = states
        # a missing transition ends the phrase; what stands there is where the next one leads, inverted
        self.flat = np.where(dense >= 0, dense, ~dense[0][None, :]).astype(np.int32).ravel()
        self.sparse = self.size > self.width
        found = sorted((s * self.size + c, t) for s, to in more.items() for c, t in to.items())
        self.keys, self.to = np.array([k for k, _ in found], np.int64), np.array([t for _, t in found], np.int32)
        self.first = np.array([more.get(0, {}).get(c, states) for c in range(self.size)], np.int32)
        self.log2 = float(np.log2(max(2, len(classes))))

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after a character, -1 where it starts a phrase)."""
        if not self.sparse:
            found = self.flat[state * self.width + c]
        else:
            found = self.flat[state * self.width + np.minimum(c, self.width - 1)]
            rare = np.flatnonzero(c >= self.width)
            if len(rare):
                key = state[rare] * np.int64(self.size) + c[rare]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found[rare] = np.where(self.keys[at] == key, self.to[at], ~self.first[c[rare]])
        missed = found >> 31
        return found ^ missed, missed

    def misses(self, stream: np.ndarray, start: np.ndarray, length: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that start within each chunk of a stream of classes, but for one at the start of a text.

        Chunks come longest first; ``after`` gives the chunk before each in its text, -1 for none.
        """
        letters = self.letter[stream]
        n = len(start)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int64)
        deep = int(length[0]) if n else 0
        begins = np.zeros((deep, n), bool)
        for j, m in enumerate(np.searchsorted(-length, -np.arange(deep), side="left").tolist()):
            state[:m], missed = self.step(state[:m], letters[start[:m] + j])
            begins[j, :m] = missed
            count[:m] -= missed
        later = np.flatnonzero(after >= 0)
        if not len(later):
            return count
        exact, met, last = count.copy(), np.zeros(n, bool), np.ones(n, bool)
        last[after[later]] = False
        live, here = later, state[after[later]]
        gone, own = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(min(MEET, deep)):
            here, missed = self.step(here, letters[start[live] + j])
            gone[live] -= missed
            own[live] += begins[j, live]
            agree = (missed < 0) & (begins[j, live] | (j == 0))
            done = live[agree]
            exact[done], met[done] = gone[done] + count[done] - own[done], True
            on = ~agree & (length[live] > j + 1)
            ended = live[~agree & ~on & last[live]]
            exact[ended], met[ended] = gone[ended], True
            live, here = live[on], here[on]
            if not len(live):
                break
        if met[later].all():
            return exact
        self._on_one_by_one(letters, start, length, after, state, begins, count, exact, met)
        return exact

    def _on_one_by_one(self, letters, start, length, after, state, begins, count, exact, met) -> None:
        """Chunks that haven't met their forerunner's walk yet, in the order of their texts."""
        follows = np.full(len(after), -1)
        follows[after[after >= 0]] = np.flatnonzero(after >= 0)
        carried: dict[int, int] = {}
        todo = np.flatnonzero(~met & (after >= 0))
        for b in todo[np.argsort(start[todo], kind="stable")].tolist():
            while b >= 0 and (b in carried or not met[b]):
                here = carried.pop(b, int(state[after[b]]))
                missed = own = 0
                met[b] = True
                for j in range(int(length[b])):
                    to, miss = self.step(np.array([here]), letters[start[b] + j : start[b] + j + 1])
                    here, own = int(to[0]), own + int(begins[j, b])
                    missed -= int(miss[0])
                    if miss[0] and (begins[j, b] or j == 0):
                        exact[b] = missed + count[b] - own
                        break
                else:
                    exact[b] = missed
                    if follows[b] >= 0:
                        carried[int(follows[b])] = here
                b = int(follows[b])


class Parser:
    """Automata of all languages; classes of characters: 0 no letter, 1 letters that no labelled text has, others one each."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.points = np.array([ord(c) for c in letters], np.uint32)
        self.table = np.fromiter((chr(c).isalpha() for c in range(0x10000)), np.int32, 0x10000)
        low = self.points[self.points < 0x10000]
        self.table[low] = np.arange(2, len(low) + 2)
        most = min(LANGUAGE_CHARS, TOTAL_CHARS // max(1, len(self.langs)))
        parts = [self.classes(samples[lang])[0][:most] for lang in self.langs]
        width = max(2, min(DENSE, TABLE_BYTES // (8 * (sum(map(len, parts)) + 1))))
        self.automata = [Automaton(x, len(letters) + 2, width) for x in parts]
        self.log2 = np.array([a.log2 for a in self.automata])

    def classes(self, text: str) -> tuple[np.ndarray, bool]:
        """Classes of a text's characters, runs of no letters as one; whether it has a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        out = self.table[np.minimum(points, 0xFFFF)]
        far = np.flatnonzero(points > 0xFFFF)
        if len(far):
            at = np.minimum(np.searchsorted(self.points, points[far]), max(0, len(self.points) - 1))
            known = self.points[at] == points[far] if len(self.points) else np.zeros(len(far), bool)
            out[far] = np.where(known, at + 2, [chr(c).isalpha() for c in points[far].tolist()])
        keep = out != 0
        keep[1:] |= out[:-1] != 0
        return out[keep], bool(out.any())

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        stream = np.concatenate([*texts, np.zeros(1, np.int32)])
        begin = np.cumsum(sizes) - sizes
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        start = begin[owner] + nth * CHUNK
        length = np.minimum(sizes[owner] - nth * CHUNK, CHUNK)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        after = np.where(nth > 0, place[np.maximum(np.arange(len(order)) - 1, 0)], -1)[order]
        start, length, owner = start[order], length[order], owner[order]
        out = np.zeros((len(self.langs), len(texts)))
        for k, automaton in enumerate(self.automata):
            # the first phrase of a text starts without a miss
            out[k] = np.bincount(owner, weights=automaton.misses(stream, start, length, after), minlength=len(texts)) + (sizes > 0)
        return out.T

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, mean phrase length in it) of each text."""
        read = [self.classes(t or "") for t in texts]
        known = [k for k, (_, any_letter) in enumerate(read) if any_letter and self.langs]
        out: list[tuple[str, float, float]] = [(UND, 0.0, 0.0)] * len(texts)
        if known:
            got = self.phrases([read[k][0] for k in known])
            bits = got * self.log2
            best = bits.argmin(1)
            low = bits[np.arange(len(known)), best]
            rest = bits.copy()
            rest[np.arange(len(known)), best] = np.inf
            second = rest.min(1) if len(self.langs) > 1 else np.full(len(known), np.inf)
            score = np.where(np.isinf(second), 1.0, (second - low) / np.where(np.isinf(second), 1, second + low))
            for i, k in enumerate(known):
                out[k] = (self.langs[best[i]], float(score[i]), len(read[k][0]) / float(got[i, best[i]]))
        return out


def load(samples: dict[str, str]) -> Parser:
    """The parser of these samples, built once in each worker."""
    return model("langid:" + hashlib.sha1(repr(sorted(samples.items())).encode()).hexdigest(), lambda: Parser(samples))


def sample(labelled: DataFrame, work: Work) -> dict[str, str]:
    """Labelled text per language from ``labelled`` (doc_id, text, lang), the only rows learnt from.

    Per language the SAMPLE_DOCS documents with the lowest hashes of their doc_id (ties by
    doc_id; of rows that repeat one the first text counts), of each up to SAMPLE_CHARS
    characters; fewer characters where there are many languages, and MOST_LANGS languages,
    those of most documents: a bounded sample for fitting only. Null langs and texts don't
    count, and no rows give no languages. Other columns, whatever their names, don't matter.
    """
    labelled = labelled.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    langs = [r.lang for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()]
    if not langs:
        return {}
    chars = min(SAMPLE_CHARS, max(1, 3 * min(LANGUAGE_CHARS, TOTAL_CHARS // len(langs)) // SAMPLE_DOCS))
    if len(langs) == MOST_LANGS:
        labelled = labelled.filter(F.col("lang").isin(langs))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    rows = labelled.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(5)).alias("order"))
    chosen = rows.withColumn("k", first).filter(F.col("k") <= SAMPLE_DOCS).groupBy("doc_id", "lang").agg(F.min("k").alias("k"))
    chosen = work.keep(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "k"), "chosen")
    texts = labelled.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("of")))
    texts = texts.groupBy("of", "k").agg(F.min(F.substring("text", 1, chars)).alias("t"))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.of, r.k)):
        out.setdefault(r.of, []).append(r.t)
    return {lang: "\n".join(t) for lang, t in out.items()}


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred, score, phrase_chars (mean phrase length) for each row of ``docs`` (doc_id, text).

    Texts that are null or have no letter are ``und`` with score 0, all texts if there are no
    samples. Equal bits: the language first in code-point order. The score is the relative
    distance in bits of the two best languages, 1 if there is only one. Equal texts have equal
    results, repeated rows stay repeated, no rows give no rows; very long texts are parsed
    whole. Other columns, whatever their names, don't matter. One map, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = load(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                langs, scores, chars = zip(*parser.predict(part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(chars, pa.float64())], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), PREDICTED)


def keep_known(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` in a learnt language, all columns as they are; a null lang becomes the predicted one.

    Out go texts that are null or have no letter, and texts of LEAST_CHARS characters or more
    whose phrases are shorter than SHORTEST_PHRASE on average in every language; all rows
    without samples. Repeated rows, ties and long texts are as in predict(). One map.
    """
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = load(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                found = parser.predict(texts)
                gone = [lang == UND or (chars < SHORTEST_PHRASE and len(t) >= LEAST_CHARS) for (lang, _, chars), t in zip(found, texts, strict=True)]
                place = part.schema.get_field_index("lang")
                langs = [p if x is None else x for x, (p, _, _) in zip(part.column(place).to_pylist(), found, strict=True)]
                part = part.set_column(place, part.schema.field(place), pa.array(langs, pa.string()))
                yield part.filter(pa.array([not x for x in gone]))

    return docs.mapInArrow(trimmed(run), docs.schema)
