"""Small tables with every odd case: nulls in any column, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, predicted int, word string"


def odd_docs(spark, n: int = 60, seed: int = 1):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "straße", "of", "the", "漢字", "x1", "12", "don't"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 120))), "en", f"s{k % 3}") for k in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "fr", "s0"), (None, "no id here", "en", None), (n + 2, " \t\n", None, "s1"), (n + 3, "one", "de", "s2"), (n + 4, "long " * 30_000, "en", "s0")]
    rows += [rows[0], rows[1], (n + 5, rows[5][1], "en", "s1"), (n + 6, rows[6][1] + " tail", "en", "s1"), (7, "same id, other text", "en", "s0")]
    return spark.createDataFrame([(*r, 1, 0.5, 9, 3, "w") for r in rows], DOCS)


def collected(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
