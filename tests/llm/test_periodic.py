"""Runs of words against all stretches of small texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from grapevine.llm import periodic, queries

from .helpers import ODD_TEXTS, clashing, corpus, frame

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def plain_runs(words: list, min_length: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period): for each period the maximal stretches; the smallest period of each stretch."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, end = i, j + q
            if end - start >= max(min_length, 2 * q):
                best.setdefault((start, end), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda run: (run[0], run[2]))


def plain_collapsed(words: list[str], runs) -> list[str]:
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def fibonacci(n: int) -> list[str]:
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def texts_of_many_kinds() -> list[list[str]]:
    dice = random.Random(5)
    out = [fibonacci(n) for n in (3, 12, 13, 40, 89, 300)]
    out += [["w"] * n for n in (1, 2, 11, 12, 13, 64, 200)]
    out += [["a", "b"] * n for n in (5, 6, 7, 50)]
    for _ in range(150):
        out.append([dice.choice("abc"[:dice.randint(1, 3)]) for _ in range(dice.randint(0, 90))])
    for _ in range(150):
        unit = [dice.choice("abcdefgh") for _ in range(dice.randint(1, 40))]
        inner = (unit * dice.randint(2, 6))[:dice.randint(1, 160)]
        words = [str(dice.randint(0, 9)) for _ in range(dice.randint(0, 20))] + inner + [str(dice.randint(0, 9)) for _ in range(dice.randint(0, 20))]
        out.append(words + words[:dice.randint(0, len(words))] if dice.random() < 0.4 else words)
    nested = ((["a"] * 9 + ["b"]) * 3 + ["c"]) * 4
    return out + [nested, nested + nested[:70] + ["d"] + nested]


@pytest.mark.parametrize("min_length", [2, 5, 12, 17])
def test_runs_of_a_chunk_of_texts(min_length):
    texts = texts_of_many_kinds()
    found, masks = periodic.runs_of_texts(texts, min_length)
    for words, runs, kept in zip(texts, found, masks, strict=True):
        assert runs == plain_runs(words, min_length)
        assert [w for w, k in zip(words, kept, strict=True) if k] == plain_collapsed(words, runs)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=70), min_size=1, max_size=4))
def test_runs_of_two_letters(texts):
    found, _ = periodic.runs_of_texts(texts, 12)
    assert found == [plain_runs(words) for words in texts]


def test_suffixes_and_successors():
    dice = np.random.default_rng(3)
    numbers = np.append(dice.integers(0, 3, 200), 9)
    suffixes = periodic.Suffixes(numbers)
    rows = [tuple(numbers[i:]) for i in range(len(numbers))]
    assert [rows[i] for i in suffixes.order] == sorted(rows)
    a, b = dice.integers(0, 100, 300), dice.integers(100, 200, 300)
    after, before = suffixes.common_after(a, b), suffixes.common_before(a, b)
    for i, j, x, y in zip(a, b, after, before, strict=True):
        assert (numbers[i:i + x] == numbers[j:j + x]).all() and numbers[i + x] != numbers[j + x]
        assert (numbers[i - y:i] == numbers[j - y:j]).all() and (y == i or numbers[i - y - 1] != numbers[j - y - 1])
    tree = periodic.WaveletTree(suffixes.order)
    low = dice.integers(0, 190, 400)
    high, least = low + dice.integers(1, 11, 400), dice.integers(0, 230, 400)
    got = tree.successor(low, high, least, 201)
    assert got.tolist() == [min([v for v in suffixes.order[x:y] if v >= z], default=201) for x, y, z in zip(low, high, least, strict=True)]


def test_every_period_has_a_block():
    for min_length in (2, 3, 12, 40):
        served = {}
        for level, least, most in periodic.distance_windows(4000, min_length):
            for q in range(least, most + 1):
                assert q not in served
                served[q] = 1 << level
        assert set(range(1, 2001)) <= set(served)
        assert all(q + 2 * size - 1 <= max(min_length, 2 * q) for q, size in served.items() if size > 1)


def plain_planted(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = plain_planted(doc_id, text)
    runs = plain_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(plain_collapsed(words, runs))))


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_on_odd_and_repetitive_texts(spark, tmp_path):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in corpus()]
    rows += [(1000 + i, " ".join(words)) for i, words in enumerate(texts_of_many_kinds())]
    rows += [(None, "a b " * 30), (5, rows[25][1]), (5, rows[25][1])]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    as_row = lambda r: (r.doc_id, *(r[c] for c in COLUMNS))
    assert sorted(map(as_row, got), key=repr) == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)


def test_empty_table_and_clashing_names(spark):
    docs = clashing(spark, list(enumerate(ODD_TEXTS)))
    got = periodic.find_runs(docs, "text", docs.columns).collect()
    assert len(got) == len(ODD_TEXTS)
    assert [len(r.runs) for r in sorted(got, key=lambda r: r.doc_id)] == [len(plain_runs(WORD.findall(t or ""))) for t in ODD_TEXTS]
    assert periodic.find_runs(docs.limit(0), "text", ["doc_id"]).count() == 0


def test_very_long_texts(spark):
    dice = random.Random(8)
    unit = [f"w{dice.randint(0, 10**6)}" for _ in range(70_001)]
    text = " ".join(["x", "y", *unit, *unit, "z", *["a", "b", "c"] * 40_000])
    row = periodic.find_runs(frame(spark, [(1, text)]), "text", ["doc_id"]).first()
    assert [tuple(r) for r in row.runs] == [(2, 140_002, 70_001), (140_005, 120_000, 3)]
    assert len(row.collapsed.split()) == 2 + 70_001 + 1 + 3
