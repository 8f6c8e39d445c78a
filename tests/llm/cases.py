"""Small tables with everything that is odd in them, and plain-Python references."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names the operators use inside, on columns that must not matter.
CLASHING = {
    "text_hash": "5", "row": "'x'", "words": "array(1)", "pos": "1", "id": "3", "n_words": "9", "h1": "7",
    "kept_runs": "'y'", "component": "8", "region": "2", "part": "4", "held_out": "true", "score": "0.5",
    "n_dropped": "6", "ids": "'z'", "signature": "'s'", "lines": "'l'", "toxic": "1", "block": "0",
}

_PARTS = "al be cor dan est fi gul ho in jus kel lo mar ne ol pra qui ros sta tu".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = ["".join(rng.choices(_PARTS, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(out)


def near(text: str, seed: int, changed: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(words)), changed):
        words[i] = f"zz{seed}x{i}"
    return " ".join(words)


def odd_rows() -> list[tuple]:
    base, other = prose(1, 120), prose(2, 90)
    shared = "This very line stands in many documents."
    rows = [
        (1, base, "en", "a", 1),
        (2, near(base, 5, 2), "en", "a", 1),
        (3, base.upper(), "en", "b", None),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, "   \n\t ", "en", "a", 5),
        (7, "!!! ... 123 ___", "en", "a", 5),
        (8, "one two", None, "a", 7),
        (9, "One  two", None, "a", 8),
        (10, other, "de", "a", 7),
        (10, other, "de", "a", 7),
        (11, "Ünïcode É é ÇA 日本 語 text\r\nwith   runs of space " + other, "fr", None, 3),
        (None, "a text without an id " + base, "en", "a", 3),
        (None, None, "en", "a", 3),
        (12, prose(3, 30_000), "en", "a", 3),
        (13, "x" * 70_000, "en", "a", 3),
        (14, "\n".join(["same"] * 50), "en", "a", 3),
        (15, f"{shared}\n\n  {shared.upper()}\t\nlast", "en", "a", 3),
        (16, "\n\n", "en", "a", 2),
    ]
    rows += [(100 + i, f"{shared}\n{prose(50 + i, 25)}", "en", "hot", 9) for i in range(12)]
    return rows


def odd_documents(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    return docs.selectExpr("*", *[f"{v} AS {k}" for k, v in CLASHING.items()]).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced_words(text: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def folded(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def shingles(text: str | None, k: int) -> frozenset:
    words = spaced_words(folded(text or ""))
    return frozenset([tuple(words[j : j + k]) for j in range(len(words) - k + 1)] or ([tuple(words)] if words else []))


def linked(rows: list[tuple], k: int, percent: int) -> dict:
    """Component of every id that has shingles, by comparing all pairs."""
    sets: dict = {}
    for doc, text in rows:
        if doc is not None and shingles(text, k):
            sets.setdefault(doc, set()).add(shingles(text, k))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(
                100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]
            ):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}
