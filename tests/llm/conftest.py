import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs(n: int = 60, seed: int = 1) -> list[tuple]:
    """Invented documents: two languages, copies near and exact, nulls, empty, one-word and repeated rows."""
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "er", "on", "wh", "and", "st", "re"], "de": ["sch", "ung", "ein", "ich", "der", "lich", "pf", "au"]}
    word = lambda lang: "".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3)))
    out = []
    for k in range(n):
        lang = "en" if k % 3 else "de"
        words = [word(lang) for _ in range(r.choice([3, 20, 60, 150]))]
        if out and k % 4 == 0:  # a near copy of an earlier one
            words = [x for x in (out[r.randrange(len(out))][1] or "a b c").split()]
            for _ in range(r.randint(0, 4)):
                words[r.randrange(len(words))] = word(lang)
        out.append((k, " ".join(words), lang, ("a", "b", "c", None)[k % 4 if k % 5 else 0], 1))
    out += [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "One", "en", "b", 3), (903, "one", None, None, 3), (904, " \t\n", "en", "a", 3)]
    out += [out[5], out[5], (None, out[7][1], "en", "a", 1), (None, "x1 y2", None, "z", 1), (905, "word " * 5000, "en", "c", 25000)]
    return out


@pytest.fixture(scope="session")
def docs_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
