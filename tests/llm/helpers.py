"""Small tables and plain versions for the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

# Texts that break careless code: null, empty, white, one word, other scripts, control and repeated characters.
ODD_TEXTS = [
    None, "", " ", "\n", "\t \x0b\x0c\r", "one", "ONE", "é", "日本語 テキスト", "a\x00b", "  x", "😀 😀 😀 😀 😀 😀", "x" * 3000, "no " * 400,
    "\n\n\n", "A b\nA b\na B \n", "ſ İ ß", "'s 'll 're", "﻿bom", "1 2 3 4 5",
]


def prose(seed: int, words: int) -> str:
    dice = random.Random(seed)
    out = [dice.choice(VOCABULARY) + dice.choice(["", "", "s", "ing", "ed"]) + str(dice.randint(0, 30)) for _ in range(words)]
    for i in range(9, len(out), 17):
        out[i] += "\n"
    return " ".join(out).replace("\n ", "\n")


def edited(text: str, seed: int, changes: int) -> str:
    dice, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[dice.randrange(len(words))] = f"edit{dice.randint(0, 999)}"
    return " ".join(words)


def corpus() -> list[tuple[int, str | None]]:
    """(doc_id, text): odd texts, long and short prose, copies, near copies, shared passages."""
    texts = list(ODD_TEXTS)
    texts += [prose(i, 30 + 7 * i) for i in range(30)]
    texts += [prose(3, 51)] * 12  # copies
    base = prose(77, 200)
    texts += [edited(base, i, 1 + i % 9) for i in range(40)]  # near copies
    passage = prose(88, 60)
    texts += [f"{prose(200 + i, 25)} {passage} {prose(300 + i, 25)}" for i in range(15)]
    texts += [f"{prose(400 + i, 12)}\nshared line\n{prose(500 + i, 8)}\n  Shared LINE \n" for i in range(12)]
    texts += [prose(9, 4000)]
    return [(7 * i + 3, text) for i, text in enumerate(texts)]


def frame(spark, rows, schema: str = "doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """The same documents with extra columns whose names operators use themselves."""
    wide = [(i, t, "src", i, i, "x", 1.0) for i, t in rows]
    return spark.createDataFrame(wide, "doc_id bigint, text string, source string, n bigint, key bigint, t string, score double")
