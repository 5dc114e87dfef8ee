"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

WORDS = "the of and to in thtion anreou blehe ndon shewhat inoron estion".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = prose(rng, 200)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(450))
    return [
        base, base, base.replace("the", "a", 3), None, "", " \n\t ", "one", "two words", "x" * 3000, "ab " * 900, "é日本🎉 " * 120,
        prose(rng, 60) + passage + prose(rng, 60), passage + prose(rng, 30), prose(rng, 4000), "CAPS!! " * 60,
        "mail a.b@x.org or 1.2.3.4 or +1 (443) 555-5793 card 4111 1111 1111 1111", prose(rng, 40),
    ]


def documents(spark, rows=None):
    """doc_id, text and columns whose names the operators use inside."""
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame(
        [(i, t, i, "x", "y", [1], "k") for i, t in rows], "doc_id long, text string, id long, th string, row string, spans array<int>, count string"
    )
