import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quilldex.llm import pii
from quilldex.llm.common import Work

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The fixed patterns as they are stated."""
    out = [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1]))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_as_stated():
    r = random.Random(5)
    for _ in range(8000):
        letters = r.choice(["a1.@ ", "1. ", "1-+ ().", "a@.-", "0123456789 -", "+1( )é.2", "a1.@ \n-+()é5"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == plain(text), text
    for text in ("4111 1111 1111 1111", "1" * 30_000, "x" * 30_000 + "@a.b", "1.2.3." * 5000, "🙂 a@b.c +1 (017) 555-7713"):
        assert pii.base_spans(text) == plain(text)


def test_documents(spark, docs, no_docs):
    extra = spark.createDataFrame([(800, "mail a.b@c.de, 1.2.3.4 and 4111 1111 1111 1111 or +1 (017) 555-7713", "en", "a", 1)], docs.schema)
    both = docs.unionByName(extra)
    got = pii.digest(pii.extract(both.withColumns({"k": F.lit(1), "rid": F.lit("x"), "base": F.lit(0)})))
    assert got.count() == both.count()
    one = got.filter("doc_id = 800").first()
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert one.spans.startswith("email:5:13,ip:15:22,card:27:46,phone:")
    assert pii.extract(no_docs).count() == 0 and pii.redact(no_docs).count() == 0
    masked = pii.redact(both)
    assert masked.columns == docs.columns
    assert masked.filter("doc_id = 800").first().text == "mail <EMAIL>, <IP> and <CARD> or <PHONE>"
    assert masked.filter("doc_id <> 800 or doc_id is null").exceptAll(docs).filter("not text rlike '<[A-Z]+>'").count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"some words here write me at user{k}@mail.com please now") for k in range(30)]
    rows += [(100, "again write me at weird@localhost please now"), (101, "no such words weird2@localhost in here")]
    rows += [(200 + k, f"the thing is user{k}@mail.com and so on") for k in range(3)] + [(300 + k, "the thing is a stone and so on") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    work = Work(spark, "t")
    found = pii.find(docs, work)
    assert pii.learn(docs, found, work).count() >= 1
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs)).collect()}
    assert got[100] == "email:18:33" and got[101] == "" and got[300] == ""
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()}[100] == "again write me at <EMAIL> please now"


def brute_spans(texts):
    """The method with plain Python: contexts are texts, the graph is a few dictionaries."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    mentions, slots = [], Counter()
    for n, text in enumerate(texts):
        base = plain(text or "")
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        folded = [w[0].translate(fold) for w in words]
        for pair in zip(folded, folded[1:]):
            slots[(0, *pair)] += 1
            slots[(1, *pair)] += 1
        places = [(k, s, e) for k, s, e in base]
        for w in words:
            inner = w[0].strip(pii.OUTER)
            s = w.start() + len(w[0]) - len(w[0].lstrip(pii.OUTER))
            if len(inner) >= pii.LEAST_CHARS and re.search("[0-9@]", inner) and not any(a < s + len(inner) and s < b for _, a, b in base):
                secret = re.fullmatch("[0-9A-Fa-f]{32,}", inner) and re.search("[0-9]", inner) and re.search("[A-Fa-f]", inner)
                places.append((4 if secret else -1, s, s + len(inner)))
        for k, s, e in places:
            i = next(i for i, w in enumerate(words) if w.start() <= s < w.end())
            j = next(j for j, w in enumerate(words) if w.start() <= e - 1 < w.end())
            patterns = [(0, *folded[i - 2 : i])] if i >= 2 else []
            patterns += [(1, *folded[j + 1 : j + 3])] if j + 2 < len(words) else []
            mentions.append((n, k, s, e, patterns, text[s:e].lower()))
    edges = Counter((p, inst, k) for _, k, _, _, patterns, inst in mentions for p in patterns)
    seeds, filled = Counter(), Counter()
    for (p, _, k), n in edges.items():
        filled[p] += n
        seeds[p, k] += k >= 0
    able = [(p, k) for (p, k), n in seeds.items() if k >= 0 and n >= pii.LEAST_SEEDS and filled[p] >= pii.CONFIDENT * (slots[p] + 1)]
    sure = Counter()
    for (p, _, k), n in edges.items():
        sure[p, k] += n if k >= 0 else 0
    score = {}
    for turn in range(pii.ROUNDS):
        known = defaultdict(float)
        for (p, inst, k), _ in edges.items():
            for kind in range(5):
                if k < 0 and (p, kind) in score:
                    known[inst, kind] += math.log1p(-min(score[p, kind], 0.999))
        mass = Counter(sure)
        for (p, inst, k), n in edges.items():
            for kind in range(5):
                if k < 0 and turn and (inst, kind) in known:
                    mass[p, kind] += n * (1 - math.exp(known[inst, kind]))
        score = {(p, k): mass[p, k] / (slots[p] + 1) for p, k in able}
    best = {}
    for (p, k), x in score.items():
        if x >= pii.CONFIDENT and (p not in best or (x, -k) > best[p][0]):
            best[p] = ((x, -k), k)
    out = [list(plain(t or "")) for t in texts]
    for n, k, s, e, patterns, _ in mentions:
        kinds = [best[p][1] for p in patterns if p in best]
        if kinds and not 0 <= k < 4:
            out[n].append((min(kinds), s, e))
    return [",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(x)) for x in out], best


def corpus():
    r = random.Random(8)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    word = lambda: "".join(r.choice("abcd") for _ in range(2))
    texts = []
    for k in range(240):
        words = [word() for _ in range(r.randint(3, 30))]
        at = r.randint(0, len(words))
        what = [["write", "to", f"{word()}{k}@{word()}.com", "or", "else"], ["Token", "=", f'"{hexes()}"'], ["call", "me", "+1 (017) 555-77" + str(10 + k % 80)], ["token", "=", f'"pw-{k}x"'], ["write", "to", f"root{k % 3}@localhost"], [hexes()], ["host", "at", f"10.0.{k}.7,"]][k % 7]
        if k % 7 != 3 or k % 28 == 3:
            words[at:at] = what
        texts.append(" ".join(words))
    return [*texts, None, "", "1.2.3.4," * 300, texts[0], texts[0]]


def test_scoring_against_plain_python(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, best = brute_spans(texts)
    assert {k for _, k in best.values()} >= {0, 2 + 2}
    got = {r.doc_id: r.spans for r in pii.digest(pii.extract(docs)).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert sum(x.count("secret") for x in want) > 30 and any("email" in w and "@localhost" in (t or "") for w, t in zip(want, texts))


def test_redact_masks_what_extract_finds_in_any_number_of_blocks(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, _spans long")
    spans = {r.doc_id: [(x.k, x.s, x.e) for x in r.spans] for r in pii.extract(docs).collect()}
    want = [pii.mask(t, spans[k]) if t else t for k, t in enumerate(texts)]
    for size in (pii.BLOCK_PATTERNS, 2):
        monkeypatch.setattr(pii, "BLOCK_PATTERNS", size)
        masked = pii.redact(docs)
        assert masked.columns == docs.columns
        assert [r.text for r in masked.orderBy("doc_id").collect()] == want


def test_secrets_of_a_test_table_are_discovered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pii.digest(pii.extract(docs)).filter("spans like '%secret:%'")
    held = docs.filter(F.col("text").rlike('token = "[0-9a-f]{40}"'))
    assert got.count() == held.count() > 5
    assert pii.redact(docs).filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0


def test_long_words_take_linear_time():
    began = time.perf_counter()
    for text in ("1.2.3.4," * 131_072, "a1@b.c;" * 100_000 + " x y", "9" * 1_000_000, " ".join(["q" * 100_000, "r" * 100_000, *["7" * 50] * 2000])):
        pii.Mentions([text])
    assert time.perf_counter() - began < 20
