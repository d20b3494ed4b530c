import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilldex.llm import bpe

ODD = [
    "", "İstanbul ΣΑΣ naïve’s don't I'LL <|endoftext|>x<|startoftext|> 12½ \x1c\x1d á 日本語 🙂👍🏽 ﷺ ​\xa0 ''''s aaaaaaa", "\x00abc\x00", "\x00",
    "x" * 3000, "<|endoftext|", "é" * 50, "ß ẞ Ω Å ﬁ", "'s't're've'm'll'd", "á ë", "  x", "<|endoftext|><|endoftext|>", "thththththth inininin",
]


@pytest.fixture(scope="module")
def spec():
    with open(bpe.default_path(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def same(own, library, texts):
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:60]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_as_the_library(spec, library, docs_rows):
    own = bpe.load(spec)
    same(own, library, ODD)
    same(own, library, [r[1] or "" for r in docs_rows])
    r = random.Random(6)
    names = [t.replace("</w>", "") for t in list(own.vocab)[:8000]]
    same(own, library, ["".join(r.choice(names) for _ in range(r.randint(1, 5))) for _ in range(3000)])
    assert own.exact and own.speculated


def test_random_short_texts(spec, library):
    own = bpe.load(spec)
    r = random.Random(9)
    letters = "\x00\x00\x01!.,('\"- \n\t\x7f\x85\xa0aeZ0½ßé́İσς日ไ🙂\u200bĀā"
    same(own, library, ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(20_000)])


def test_pairs_that_pass_are_never_merged_across(spec):
    own = bpe.load(spec)
    r = random.Random(8)
    inner = [k for t, k in own.vocab.items() if not t.endswith("</w>") and t in own.reachable]
    last = [k for t, k in own.vocab.items() if t.endswith("</w>") and len(t) > 4 and t in own.reachable]
    a, b = np.array([r.choice(inner) for _ in range(4000)]), np.array([r.choice(last) for _ in range(4000)])
    ok = own.compatible(a, b)
    assert 0.02 < ok.mean() < 0.99
    for x, y in zip(a[ok].tolist(), b[ok].tolist()):
        assert own.merge(own.base(own.names[x]) + own.base(own.names[y])) == [x, y]


def test_many_words_at_once_as_one_by_one(spec):
    own = bpe.load(spec)
    r = random.Random(7)
    letters = [own.vocab[c] for c in "etaoinsh"]
    words = [[r.choice(letters) for _ in range(r.randint(1, 60))] for _ in range(400)]
    assert own.merge_many(words) == [own.merge(w) for w in words]
    assert own.merge_many([]) == []


def test_documents(spark, docs, docs_rows, no_docs, library):
    r = random.Random(10)
    odd = ["\x00!", "a\x00!", "\x00.", "!\x00(", *ODD, *("".join(r.choice("\x00!.a日é ") for _ in range(r.randint(1, 6))) for _ in range(300))]
    rows = [*docs_rows, *((2000 + k, t, None, None, None) for k, t in enumerate(odd))]
    frame = spark.createDataFrame(rows, docs.schema)
    encoded = bpe.encode_documents(frame.withColumns({"ids": F.lit(1), "decoded": F.lit(2)}), bpe.default_path())
    got = sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.digest(encoded).collect())
    want = []
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append(str((row[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))))
    assert got == sorted(want)
    assert bpe.encode_documents(no_docs, bpe.default_path()).count() == 0
