"""Rows that the operators must bear: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, row long, kept string, _row long, score string, component long, n long, _source string"


def words(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(count))


def texts() -> list[tuple]:
    base, other = words(1, 120), words(2, 200)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base, "en", "a"),
        (2, base.replace(" ", "\n", 3) + "  ", "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \n\t\r\x0b\x0c ", "fr", None),
        (7, other, None, "c"),
        (7, other, None, "c"),
        (8, words(3, 40_000), "fr", "a"),
        (9, "Ünïcödé wörds, éàü. " * 30, "de", "b"),
        (10, "!!! 123 ...", "de", "b"),
        (11, base, "en", "a"),
        (None, base, "en", "a"),
        (None, words(5, 60), "en", "a"),
        (12, "one", "en", "d"),
        (13, "One", "en", "d"),
        (14, words(4, 30) + "\n" + other, "fr", "c"),
        (15, "ab" * 400, "fr", "c"),
        (16, "\U0001f600 emoji \u65e5\u672c\u8a9e \x85 \x1f end", "de", "b"),
    ]


def rows() -> list[tuple]:
    return [(i, t, lang, src, len(t or ""), "x", 1, "y", 2, "z", 3, 4, "s") for i, t, lang, src in texts()]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
