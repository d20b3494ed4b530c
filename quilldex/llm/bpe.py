"""BPE encoding by speculation and verification, and decoding.

A greedy longest match proposes the tokens of a word. Byte-pair merging yields exactly
these tokens if no merge can cross the border of two neighbours while both are being
merged, so every adjacent pair is tested, all pairs of a batch at once. Only words with
a pair that fails are merged step by step.

The test of a pair (a, b): while a is merged on its own, its last symbol changes a few
times, each one standing between the rank that made it and the rank that consumes it;
likewise the first symbol of b. The pair fails if some last and first symbol stand at
the same time and their merge ranks before either is consumed. Ties count as failures,
and so do tokens whose own merges don't come in rank order: exact merging settles them.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import model, trimmed

#: A worker's cache of words is thinned out when it holds this many.
CACHE_WORDS = 200_000
SLICE_ROWS = 500
FAR = 1 << 30
NONE = (1 << 17) - 1
#: Longer words are merged one by one; rows of the matrix for the others.
MATRIX_SYMBOLS, MATRIX_ROWS = 48, 4096
ENCODED = "doc_id long, ids binary, decoded string"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


@functools.cache
def byte_symbols() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, others for code points from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return [rest.get(b, chr(b)) for b in range(256)]


@functools.cache
def simple_pattern() -> tuple[re.Pattern, re.Pattern]:
    """For texts of U+0001 to U+024F, which NFC leaves alone: what is beyond, and the splitting pattern."""
    chars = [chr(c) for c in range(0x250)] + ["̇"]
    some = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    letters, numbers, blank = some("L"), some("N"), "\\t-\\r \\x85\\xa0"
    return re.compile("[^\\x01-ɏ]"), re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")


class WordBpe:
    """The tokenizer of a file, for texts as its library reads them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        conf = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.vocab: dict[str, int] = conf["model"]["vocab"]
        self.suffix: str = conf["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        parts = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_pattern = re.compile(f"({parts})") if parts else None
        self.names = [""] * (1 + max([*self.vocab.values(), *self.special.values()]))
        for t, k in [*self.vocab.items(), *self.special.items()]:
            self.names[k] = t
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in conf["model"]["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): (k, self.vocab[a + b]) for k, (a, b) in reversed([*enumerate(merges)])}
        keys = np.array([a << 17 | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array([r for r, _ in self.ranks.values()], np.int64)[order]
        self.made = np.zeros(len(merges), np.int64)
        self.made[[r for r, _ in self.ranks.values()]] = [m for _, m in self.ranks.values()]
        self._spines()
        self.words: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.pairs, self.pair_ok = np.empty(0, np.int64), np.empty(0, bool)
        self.symbols = byte_symbols()
        self.exact = self.speculated = 0

    def merge(self, ids: list[int], trace: list | None = None) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equal ones."""
        right, left = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        ids, queue = [*ids], []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (found := self.ranks.get((ids[i], ids[right[i]]))):
                heapq.heappush(queue, (found[0], i, ids[i], ids[right[i]], found[1]))

        for i in range(len(ids) - 1):
            offer(i)
        alive = [True] * len(ids)
        while queue:
            rank, i, a, b, made = heapq.heappop(queue)
            if not alive[i] or ids[i] != a or right[i] < 0 or ids[right[i]] != b:
                continue
            j = right[i]
            if trace is not None:
                trace.append((rank, i, j, made, right[j] < 0))
            ids[i], alive[j], right[i] = made, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def merge_many(self, words: list[list[int]]) -> list[list[int]]:
        """merge() of many words at once: words of like length are rows of a matrix, one merge a step."""
        out: list = [None] * len(words)
        short = [k for k, w in enumerate(words) if len(w) <= MATRIX_SYMBOLS]
        short.sort(key=lambda k: len(words[k]))
        for k in set(range(len(words))).difference(short):
            out[k] = self.merge(words[k])
        for at in range(0, len(short), MATRIX_ROWS):
            rows = np.array(short[at : at + MATRIX_ROWS])
            width = max(2, len(words[rows[-1]]))
            grid = np.full((len(rows), width), NONE, np.int64)
            for r, k in enumerate(rows.tolist()):
                grid[r, : len(words[k])] = words[k]
            ranks = self._ranks(grid[:, :-1], grid[:, 1:])
            while True:
                place = ranks.argmin(1)
                lines = np.arange(len(rows))
                going = ranks[lines, place] < FAR
                for k, line in zip(rows[~going].tolist(), grid[~going].tolist(), strict=True):
                    out[k] = [x for x in line if x != NONE]
                if not going.any():
                    break
                rows, grid, ranks, place = rows[going], grid[going], ranks[going], place[going]
                lines = np.arange(len(rows))
                grid[lines, place] = self.made[ranks[lines, place]]
                stay = np.ones(grid.shape, bool)
                stay[lines, place + 1] = False
                grid = grid[stay].reshape(len(rows), -1)
                # of the borders only the two beside the new symbol change
                grid = np.concatenate([grid, np.full((len(rows), 1), NONE)], 1) if grid.shape[1] < 2 else grid
                stay = np.ones(ranks.shape, bool)
                stay[lines, place] = False
                ranks = ranks[stay].reshape(len(rows), -1) if ranks.shape[1] > 1 else np.full((len(rows), 1), FAR)
                for step, here in ((-1, place > 0), (0, place < grid.shape[1] - 1)):
                    i, j = lines[here], place[here] + step
                    ranks[i, j] = self._ranks(grid[i, j], grid[i, j + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 17 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], FAR)

    def base(self, token: str) -> list[int]:
        """The symbols that merging of a token's text starts from; the last one carries the suffix."""
        body = token.removesuffix(self.suffix)
        ends = [*body[:-1], body[-1] + self.suffix] if token != body else [*body]
        return [self.vocab[c] for c in ends]

    def _spines(self) -> None:
        """Per token: its first and last symbols over time, as (symbol, made at, consumed at)."""
        firsts, lasts, self.regular = {}, {}, np.zeros(len(self.names), bool)
        self.reachable = set()
        for token, k in self.vocab.items():
            if not token.removesuffix(self.suffix):
                continue
            trace: list = []
            start = self.base(token)
            if self.merge(start, trace) != [k]:
                continue
            self.reachable.add(token)
            self.regular[k] = all(x[0] < y[0] for x, y in zip(trace, trace[1:], strict=False))
            first, last, made_f, made_l = start[0], start[-1], -1, -1
            firsts[k], lasts[k] = [], []
            for rank, i, _, made, at_end in trace:
                if i == 0:
                    firsts[k].append((first, made_f, rank))
                    first, made_f = made, rank
                if at_end:
                    lasts[k].append((last, made_l, rank))
                    last, made_l = made, rank
            firsts[k].append((first, made_f, FAR))
            lasts[k].append((last, made_l, FAR))
        self.first, self.last = (self._table(x) for x in (firsts, lasts))

    def _table(self, spines: dict) -> np.ndarray:
        deep = max(map(len, spines.values()))
        out = np.full((3, deep, len(self.names)), -2, np.int64)
        for k, entries in spines.items():
            for d, entry in enumerate(entries):
                out[:, d, k] = entry
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of neighbours: whether merging keeps their border."""
        ok = self.regular[a] & self.regular[b]
        for i in range(self.last.shape[1]):
            s, made_s, gone_s = self.last[:, i, a]
            if not (s >= 0).any():
                break
            for j in range(self.first.shape[1]):
                f, made_f, gone_f = self.first[:, j, b]
                both = np.flatnonzero((s >= 0) & (f >= 0) & ok)
                if not len(both):
                    break
                key = s[both] << 17 | f[both]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                gone = np.minimum(gone_s[both], gone_f[both])
                crossed = (self.keys[at] == key) & (self.key_ranks[at] <= gone) & (np.maximum(made_s[both], made_f[both]) <= gone)
                ok[both[crossed]] = False
        return ok

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """compatible() of packed pairs; each distinct pair is tested once."""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.pairs):
            new = self.pairs[np.minimum(at, len(self.pairs) - 1)] != distinct
        if new.any():
            fresh = distinct[new]
            self.pair_ok = np.insert(self.pair_ok, at[new], self.compatible(fresh >> 17, fresh & 0x1FFFF))
            self.pairs = np.insert(self.pairs, at[new], fresh)
        return self.pair_ok[np.searchsorted(self.pairs, distinct)][back]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match over a word of byte symbols."""
        out, at, n, reachable = [], 0, len(word), self.reachable
        while at < n:
            if n - at <= self.longest and (t := word[at:] + self.suffix) in reachable:
                out.append(self.vocab[t])
                return out
            # a token without the suffix must leave the last symbol to one that has it
            for stop in range(min(n - 1, at + self.longest), at, -1):
                if (t := word[at:stop]) in reachable:
                    out.append(self.vocab[t])
                    at = stop
                    break
            else:
                return None
        return out

    def learn(self, words: list[str], mapped: list[str]) -> None:
        """Puts the ids of new words (and their byte symbols) into the cache."""
        proposed = [self.propose(m) for m in mapped]
        sizes = np.array([len(p or ()) for p in proposed])
        flat = np.fromiter((x for p in proposed if p for x in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.empty(0, np.int64)
        good = np.array([p is not None for p in proposed], bool)
        good[owner[inner][~self._known(flat[inner] << 17 | flat[inner + 1])]] = False
        failed = [k for k, ok in enumerate(good.tolist()) if not ok]
        for k, ids in zip(failed, self.merge_many([self.base(mapped[k] + self.suffix) for k in failed]), strict=True):
            proposed[k] = ids
        packed = np.fromiter((x for p in proposed for x in p), "<u4").tobytes()
        at = 0
        for w, p in zip(words, proposed, strict=True):
            self.words[w] = packed[at : (at := at + 4 * len(p))]
        self.speculated += int(good.sum())
        self.exact += len(words) - int(good.sum())

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens.

        Words that the library has split are in byte symbols already, where no \\x00 is, and
        carry one in front; words split here have none, as texts with one are the library's.
        """
        beyond, pattern = simple_pattern()
        if beyond.search(text) is None:
            return pattern.findall(text.lower())
        # composed characters and other scripts: the library's own tables decide
        return ["\x00" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def to_symbols(self, word: str) -> str:
        return word[1:] if word[0] == "\x00" else "".join([self.symbols[b] for b in word.encode()])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, wanted = [], set()
        for text in texts:
            pieces = []
            for k, part in enumerate(self.special_pattern.split(text or "") if self.special_pattern and "<" in (text or "") else [text or ""]):
                if k % 2:
                    pieces.append((None, np.array([self.special[part]], "<u4").tobytes()))
                elif part:
                    words = self.split(part)
                    wanted.update(words)
                    pieces.append((words, b""))
            split.append(pieces)
        if len(self.words) > CACHE_WORDS:
            # words that came again stay, unless they alone are as many
            again = self.again if len(self.again) <= CACHE_WORDS // 2 else ()
            self.words, self.again = {w: self.words[w] for w in again}, set()
        new = [w for w in wanted if w not in self.words]
        self.again.update(wanted.difference(new))
        if new:
            self.learn(new, [self.to_symbols(w) for w in new])
        get = self.words.__getitem__
        return [b"".join([b"".join(map(get, words)) if words is not None else ids for words, ids in pieces]) for pieces in split]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does, special ones included."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(spec: str) -> WordBpe:
    return model("bpe:" + hashlib.sha1(spec.encode()).hexdigest(), lambda: WordBpe(spec))


def _round_trip(batches: Iterator[pa.RecordBatch], spec: str) -> Iterator[pa.RecordBatch]:
    bpe = load(spec)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            ids = bpe.encode_batch(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], schema=_ENCODED)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian uint32), decoded text for each row of ``docs`` (doc_id, text).

    Encoded and decoded as the library does with the tokenizer file at ``path``, which the
    driver reads and sends to the executors (1.7 MB). Null and empty texts have no ids and
    decode to the empty text; rows with the same text have the same ids, repeated rows stay
    repeated. No rows give no rows; other columns, whatever their names, don't matter. One map
    over the rows: no shuffle, memory for one slice of rows and a bounded cache of words; a
    very long text is encoded whole, in memory for itself and its ids.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    run = trimmed(lambda batches: _round_trip(batches, spec.value))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
