"""Small documents with every edge: nulls, empty and long texts, ties, repeated rows, near copies, passages, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, sha string, size long, id long, target double, shard int, kept boolean"


def documents(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = words(70)
    texts = [" ".join(words(rng.randrange(5, 200))) for _ in range(60)]
    base = words(150)
    texts += [" ".join(base)] * 4 + ["\t".join(base), "  ".join(base) + " "]
    for i in range(25):  # near copies: one or two words changed
        copy = list(base)
        for _ in range(1 + i % 2):
            copy[rng.randrange(150)] = f"changed{i}"
        texts.append(" ".join(copy))
    for i in range(12):
        texts.append(" ".join(words(30) + passage + words(20)))
    texts += ["", "", None, None, " ", "\n\t ", "one", "one", "two words", "ä ü 😄 ▁ \x00 x", "x" * 5000, " ".join(words(6000)), "be " * 120, " ".join(passage), " ".join(passage[:50])]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, rng.choice(["en", None]), rng.choice(["a", "a", "a", "b", "ß", "Z", None]), None, "r", None, 5, 7, 1.0, 3, True))
    rows += [rows[3], rows[3], rows[61], (None, "no identifier", None, None, None, None, None, None, None, None, None, None), (None, texts[5], "en", "a", 1, None, None, None, None, None, None, None)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)
