"""Fixtures in code: documents with every odd case, and a small corpus with planted copies."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


def odd_documents(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, clashing extra columns."""
    long = "word " * 30000 + "password = hunter2hunter2"
    rows = [
        (1, "One line.\nTwo lines.\n", "en", "a", 5, 0.5, "x"),
        (1, "One line.\nTwo lines.\n", "en", "a", 5, 0.5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0.1, "y"),
        (None, "one LINE.\ntwo lines.\n", None, "b", 3, None, "z"),
        (4, "12 345 !!", "de", None, 9, 0.0, ""),
        (5, long, "en", "a", len(long), 1.0, "x"),
        (6, "Ünï çödé 😀 text", "fr", "b", 15, 0.2, "x"),
        (7, " \t\n\x0b\x0c\r", None, "c", 6, 0.2, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed=3, n=120):
    """(doc_id, text, lang, source): invented words of two languages, exact and near copies, shared lines."""
    rng = random.Random(seed)
    vocab = {"en": [f"{a}{b}" for a in "the ing tion er st".split() for b in "an or ed ly sh wh".split()], "es": [f"{a}{b}" for a in "ción ado ez ñ rr".split() for b in "os as ie mi ga".split()]}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "es"])
        words = [rng.choice(vocab[lang]) + rng.choice(["", "", rng.choice(vocab[lang])]) for _ in range(rng.randint(5, 90))]
        text = "\n".join(" ".join(words[k : k + 15]) + "." for k in range(0, len(words), 15))
        if rows and i % 5 == 1:
            _, text, lang, _ = rows[rng.randrange(len(rows))]
            if i % 2:
                w = text.split(" ")
                w[rng.randrange(len(w))] = "changed"
                text = " ".join(w)
            elif i % 3 == 0:
                text = text.upper()
        if i % 3 == 0:
            text = "A shared header line.\n" + text
        rows.append((i, text, lang, f"s{0 if i % 3 else i % 7}"))
    return rows


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
