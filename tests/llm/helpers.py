"""Fixtures of hard rows and plain re-computations that the tests hold the operators against."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, lang_pred string, v long"


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows; columns that clash with operators' own names."""
    texts = [None, "", " ", "one", "one two", "A b c d e f g h", "a b c d e f g h", "a b c d e f g h", "é ü ß 漢字   end", "x" * 30_000, "word " * 9_000, "12 34 !! ??", "line\nline\nline"]
    rows = [(i, t, "en" if i % 2 else None, "src" if i % 3 else None, len(t or ""), 0.5, True, "q", 7) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "a null id with some words here", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))


def shingles(text: str | None, n: int) -> set:
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    sets = {k: shingles(t, n) for k, t in texts.items()}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k in ids}
