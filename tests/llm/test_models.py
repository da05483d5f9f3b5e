"""Quality, language, decontamination, chat formatting, tokens and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
import tiktoken
from grapevine.llm import bpe, chat, decontaminate, language, quality, queries, signature_tree, textarrays

from .helpers import ODD_TEXTS, clashing, corpus, edited, frame, prose
from .test_text_operators import plain_components, plain_lines

TABLES = "/root/testdata/sf0.01"


# quality


def test_ratio_and_descent_on_a_small_problem():
    columns = np.array([0, 1, 0, 1, 0, 2, 2, 3, 2, 3, 2, 3])
    offsets = np.array([0, 2, 4, 6, 8, 10, 12])
    good = np.array([True, True, True, False, False, False])
    ratio = quality.log_count_ratio(columns, offsets, good, 4)
    p, q = np.array([4, 3, 2, 1]) / 10, np.array([1, 1, 4, 4]) / 10
    expected = np.log(p / q)
    expected[1] = 0.0  # in under three rows
    assert ratio == pytest.approx(expected)
    weights, intercept = quality.dual_coordinate_descent(columns, offsets, ratio, np.where(good, 1.0, -1.0))
    assert ((quality.margins(columns, offsets, ratio, weights, intercept) > 0) == good).all()


def test_descent_reaches_the_objective_of_a_plain_dual_solver():
    dice = np.random.default_rng(5)
    n, width, cost = 80, 25, 0.3
    rows = [np.sort(dice.choice(width, dice.integers(1, 8), replace=False)) for _ in range(n)]
    sign = np.where(np.array([r[0] for r in rows]) + dice.integers(0, 9, n) < 8, 1.0, -1.0)
    scale = dice.normal(0, 1, width)
    columns, offsets = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
    x = np.zeros((n, width + 1))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.sqrt((scale[r] ** 2).sum())
    x[:, width] = 1.0

    def objective(w):
        return 0.5 * (w @ w) + cost * np.maximum(0.0, 1.0 - sign * (x @ w)).sum()

    signed = x * sign[:, None]
    gram = signed @ signed.T
    alpha, step = np.zeros(n), 1.0 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(30_000):  # plain projected gradient on the dual
        alpha = np.clip(alpha + step * (1.0 - gram @ alpha), 0.0, cost)
    weights, intercept = quality.dual_coordinate_descent(columns, offsets, scale, sign, cost=cost, rounds=2000)
    assert objective(np.append(weights, intercept)) == pytest.approx(objective(alpha @ signed), rel=1e-3)


def test_held_out_quality(spark):
    got = {r.doc_id: r for r in queries.op4_quality(spark, TABLES).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93
    assert all((r.score >= 0.7) == (r.predicted == 1) and 0 <= r.score <= 1 for r in got.values())


def test_quality_of_odd_texts_and_labels(spark):
    docs = clashing(spark, list(enumerate(ODD_TEXTS)))
    labels = frame(spark, [(0, 1), (1, 0), (2, 1), (2, 0), (None, 1), (3, None), (4, 7), (99, 1)], "doc_id bigint, quality int")
    assert sorted((r.doc_id, r.good) for r in quality.sample_labels(labels, "doc_id", "quality").collect()) == [(0, True), (1, False), (99, True)]
    for own in (labels, labels.limit(0)):
        model = quality.fit_rows(docs, own, "doc_id", "text", "quality")
        got = quality.score(docs, "text", model, docs.columns, "_score").collect()
        assert len(got) == len(ODD_TEXTS) and all(0 <= r._score <= 1 for r in got)
    assert quality.score(docs.limit(0), "text", model, ["doc_id"]).count() == 0


def test_scores_do_not_depend_on_neighbours(spark):
    model = quality.fit(pa.array(["good text here"] * 6 + ["BAD!! BAD!!"] * 6), np.array([True] * 6 + [False] * 6))
    texts = [(i, t) for i, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])]
    got = {r.doc_id: r.score for r in quality.score(frame(spark, texts), "text", model, ["doc_id"]).collect()}
    assert all(got[i] == got[i + len(ODD_TEXTS)] for i in range(len(ODD_TEXTS)))


# language


def test_trigrams_of_a_text():
    columns, counts, offsets = language.trigram_counts(["Ab, ab!", "", "12", "a\U0001f600b"])
    assert np.diff(offsets).tolist() == [3, 0, 0, 3]  # " ab" and "ab " twice, "b a"; " a ", "a b", " b "
    assert sorted(counts[:3]) == [1, 2, 2] and counts[3:].tolist() == [1, 1, 1]


def test_mixture_by_plain_expectation_maximisation():
    dice = np.random.default_rng(3)
    table = dice.dirichlet(np.full(60, 0.2), size=3)
    grams = dice.multinomial(400, 0.7 * table[0] + 0.3 * table[2])
    columns, counts = np.flatnonzero(grams), grams[grams > 0]
    share, alive = language.mixtures(columns, counts, np.array([0, len(columns)]), np.maximum(table, 1e-9), rounds=60)
    plain = np.array([0.5, 0.0, 0.5])
    for _ in range(200):
        pull = plain[:, None] * np.maximum(table, 1e-9)[:, columns]
        plain = (pull / pull.sum(axis=0) * counts).sum(axis=1) / counts.sum()
    assert alive[0].tolist() == [True, False, True]
    assert share[0] == pytest.approx(plain, abs=0.02)


def test_held_out_languages(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    got = queries.op6_language(spark, TABLES).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.98


def test_language_of_odd_texts(spark):
    docs = frame(spark, [(i, t, ["en", "xx", None][i % 3]) for i, t in enumerate(ODD_TEXTS)], "doc_id bigint, text string, lang string")
    for rows in (docs, docs.limit(0)):
        model = language.learn(rows, "text", "lang")
        got = {r.doc_id: r for r in language.predict(docs, "text", model, ["doc_id"]).collect()}
        assert len(got) == len(ODD_TEXTS)
        for i, text in enumerate(ODD_TEXTS):
            letters = any(c.isalpha() for c in text or "")
            assert (got[i].lang_pred == "und") == (not letters or not model["languages"])
            assert 0 <= got[i].score <= 1


# decontamination


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_longest_common_subsequence():
    dice = random.Random(5)
    for _ in range(300):
        a, b = ([dice.choice("abcd") for _ in range(dice.randint(1, n))] for n in (70, 40))
        assert decontaminate.subsequence(a, b) == plain_subsequence(a, b)


def test_leaks_of_whole_and_reworded_items(spark):
    items = [(i, prose(900 + i, 18 + i)) for i in range(20)]
    docs = [(i, prose(i, 150)) for i in range(150)]
    reworded = [" ".join(w for j, w in enumerate(t.split()) if j % 9 != 4) for _, t in items]
    docs += [(1000 + i, f"{prose(2000 + i, 40)} {t} {prose(3000 + i, 40)}") for i, t in items[:10]]
    docs += [(2000 + i, f"{prose(4000 + i, 37)} {t.upper()}") for i, t in enumerate(reworded[:10])]
    docs += [(5000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None)]
    found = decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1000 + i, i) for i in range(10)} | {(2000 + i, i) for i in range(10)}


def test_all_planted_items_are_found(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").collect()
    items = {r.item_id: decontaminate.plain_words(r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()}
    truth = set()
    for row in docs:
        body = f" {' '.join(decontaminate.plain_words(row.text))} "
        truth |= {(row.doc_id, i) for i, words in items.items() if f" {' '.join(words)} " in body}
    got = {(r.doc_id, r.item_id) for r in queries.op3_decontamination(spark, TABLES).collect()}
    assert got == truth and truth


def test_short_items_in_repetitive_text(spark):
    items = [(i, prose(900 + i, 3 + i)) for i in range(20)]
    docs = [(i, prose(i, 150)) for i in range(150)]
    places = random.Random(3)
    for i, text in items:
        for n in range(5):
            filler = [places.choice(["no", "the,", "na na"])] * 90
            filler.insert(places.randint(0, 90), f'"{text}"')
            docs.append((1000 + 10 * i + n, " ".join(filler)))
    found = decontaminate.leaks(frame(spark, docs), frame(spark, items, "item_id bigint, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got == {(1000 + 10 * i + n, i) for i in range(20) for n in range(5)}
    assert all(r.common == r.item_words for r in found)


def test_decontamination_of_empty_tables(spark):
    docs, items = frame(spark, corpus()[:5]), frame(spark, [(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


# chat


def test_escapes_are_undone():
    dice = random.Random(1)
    parts = ["<", "|", "\\", "/s>", "s>", "[", "INST]", "/INST]", "<|im_end|>", "\n", "a", "</SYS>>"]
    for _ in range(20_000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(a + b in chat.escape(text) for a, b in chat.CONTROLS)


def test_spans_of_templates():
    turns = [("user", "x"), ("assistant", ""), ("user", "x")]
    closed = lambda own: "B" + "".join(f"[{r}:{t}]" for r, t in own) + "E"
    output, spans = chat.located(turns, closed)
    assert [output[a:b] for a, b, _, _ in spans] == ["[user:x]", "[assistant:]", "[user:x]"]
    assert [output[c:d] for _, _, c, d in spans] == ["x", "", "x"]
    counted = lambda own: f"{len(own)}:" + closed(own)
    assert chat.located(turns, counted)[1] is None
    trimmed = lambda own: closed(own[-2:])
    assert chat.located(turns, trimmed)[1] is None


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "<|im_end|>"), (1, 1, "assistant", None), (None, 0, "a\nb", "\\"), (2, None, "user", "")]
    docs = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(docs)).collect()}
    assert got == {1: [("", "<|im_end|>"), ("assistant", ""), ("assistant", "")], None: [("a\nb", "\\")], 2: [("user", "")]}
    assert chat.format_conversations(docs.limit(0)).count() == 0


# tokens


@pytest.fixture(scope="module")
def encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_of_odd_texts(spark, encoding):
    dice = random.Random(3)
    parts = ["\x1c", " ", " ", "a", "é", "'s", "'ll", "\n", "  ", "\t", "1", "²", "中文", "😀", "!!!!", "\u0085", "_", "=-=-=-=", "aaaaaaa", "\x00"]
    texts = ODD_TEXTS + ["".join(dice.choice(parts) for _ in range(dice.randint(0, 40))) for _ in range(200)] + ["=" * 500, "ab" * 200]
    docs = clashing(spark, list(enumerate(texts)))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect()}
    assert set(got) == set(range(len(texts))) and got[0].t == "x"
    for i, text in enumerate(texts):
        assert got[i].ids == encoding.encode_ordinary(text or ""), repr(text)
        assert bytes(got[i].decoded) == (text or "").encode()
    table = frame(spark, [(1, [262, 64, 11]), (2, [])], "i int, ids array<int>")
    assert [bytes(r.d) for r in table.orderBy("i").select(bpe.decode(F.col("ids"), path).alias("d")).collect()] == [
        encoding.decode_bytes([262, 64, 11]), b""]
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_by_fold_and_heap(encoding):
    ranks = {encoding.decode_single_token_bytes(i): i for i in range(encoding.n_vocab)}
    longest = max(map(len, ranks))
    dice = random.Random(4)
    for size in (1, 2, 9, 256, 257, 3000):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "é中a"):
            piece = "".join(dice.choice(letters) for _ in range(size)).encode()
            expected = [ranks[piece]] if piece in ranks else encoding._encode_single_piece(piece)
            assert ([ranks[piece]] if piece in ranks else bpe.heap_merged(piece, ranks, longest)) == expected


def test_bpe_plan_does_not_spell_out_the_ranks(spark):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pieces = spark.createDataFrame([("hello", None)], "piece string, ids array<int>")
    encoded = bpe.encoded_pieces(pieces, tokens)
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 100_000  # 1.9 million with a literal
    assert plan.count("scalar-subquery") == plan.count("Project [") - 1 == 1  # the map's own and one for the rows: no row carries the map
    assert b"".join(tokens[i] for i in encoded.first().ids) == b"hello"


def test_a_piece_of_a_million_bytes(spark, encoding):
    dice = random.Random(6)
    piece = "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    row = bpe.encode(frame(spark, [(1, f"so {piece}."), (2, "b" * 250)]), path, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert row[0].ids == encoding.encode_ordinary(f"so {piece}.") and row[1].ids == encoding.encode_ordinary("b" * 250)
    assert bytes(row[0].decoded) == f"so {piece}.".encode()


def test_stretches_are_cut_where_no_piece_reaches():
    find = regex.compile(public_tokenizers.PATTERN).findall
    dice = random.Random(9)
    parts = ["\x1c", " ", " ", "a", "é", "'s", "'ll", "\n", "  ", "\t", "1", "中文", "😀", "!", "\u0085", "\x00", "\u2003", "\u3000", "\xa0", "à", "\u180e", "\u2028"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 30))) for _ in range(2000)]
    data, offsets = textarrays.concatenated(pa.array(texts), np.uint8)
    for at_spaces in (True, False):
        numbers, ranges, pieces = bpe.numbered_pieces(data, offsets, find, at_spaces)
        for text, a, b in zip(texts, ranges[:-1], ranges[1:], strict=True):
            assert [pieces[i].decode() for i in numbers[a:b]] == find(text)
    planes = bpe.planes(numbers, ranges, 1 << 25)
    assert (bpe.joined_planes(planes)[0] == numbers).all() and (bpe.joined_planes(bpe.planes(numbers, ranges, len(pieces)))[0] == numbers).all()


def test_tokens_of_documents(spark, encoding):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, "/root/testdata/sf0.001").collect()}
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = encoding.encode_ordinary(row.text)
        assert got[row.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[row.doc_id].n_tokens == len(ids)
        assert got[row.doc_id].decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


# language sets against all sets


def test_language_sets_against_all_sets():
    alphabets = {"a": "abcdefgh", "b": "efghijkl", "c": "ijklmnop", "d": "mnopqrst"}
    dice = random.Random(12)

    def text(names, words):
        return " ".join("".join(dice.choice(alphabets[names[i * len(names) // words]]) for _ in range(5)) for i in range(words))

    table = np.full((4, 1 << 13), 0.5)
    for row, name in zip(table, alphabets, strict=True):
        columns, counts, _ = language.trigram_counts([text([name], 4000)])
        row[columns] += counts
    table /= table.sum(axis=1, keepdims=True)
    texts = [text(list(names), 120) for names in ("a", "b", "c", "d", "ab", "ac", "ad", "bd", "cd", "abd", "acd", "abcd")]
    columns, counts, offsets = language.trigram_counts(texts)
    _, alive = language.mixtures(columns, counts, offsets, table)
    for i, mine in enumerate(alive):
        part = slice(offsets[i], offsets[i + 1])
        n, likely = counts[part], table[:, columns[part]]
        best = (-np.inf, None)
        for members in range(1, 16):
            chosen = [k for k in range(4) if members >> k & 1]
            share = np.full(len(chosen), 1 / len(chosen))
            for _ in range(60):
                pull = share[:, None] * likely[chosen]
                share = (pull / pull.sum(axis=0) * n).sum(axis=1) / n.sum()
            value = 2 * (n * np.log((share[:, None] * likely[chosen]).sum(axis=0))).sum() - (len(chosen) - 1) * np.log(n.sum())
            best = max(best, (value, tuple(chosen)))
        assert tuple(np.flatnonzero(mine)) == best[1]


# decontamination against all pairs


def test_search_against_all_documents_and_items(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs += [(100_000 + i, edited(f"{prose(i, 50)} {t} {prose(50 + i, 50)}", i, 12)) for i, (_, t) in enumerate(items)]
    plain = {key: decontaminate.plain_words(t) for key, t in items}
    expected = set()
    for doc, text in docs:
        words = decontaminate.plain_words(text)
        have = set(words)
        for key, item in plain.items():
            if not item or len(set(item) & have) < 0.3 * len(set(item)):
                continue
            answer = item[-decontaminate.ANSWER:]
            for start in range(0, max(len(words) - 8, 1), 8):  # every window, whatever its cosine
                around = words[max(start - len(item), 0):start + decontaminate.PASSAGE + len(item)]
                common = decontaminate.subsequence(item, around)
                if common >= 0.75 * len(item) or (common >= 0.6 * len(item) and decontaminate.subsequence(answer, around) == len(answer)):
                    expected.add((doc, key))
                    break
    benchmark = frame(spark, items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, docs), benchmark).collect()}
    lost = sorted(expected - found)
    print(f"{len(expected)} pairs by brute force, {len(found)} found, lost {lost}")
    assert len(expected) >= len(items) / 2 and len(lost) <= 0.03 * len(expected)
    assert found <= expected


# pipeline


def test_pipeline_against_plain_stages(spark, tmp_path, encoding):
    rows = [(i, t) for i, t in corpus() if t and len(t) > 40]
    junk = [(10_000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(60)]
    items = [(i, prose(900 + i, 30)) for i in range(8)]
    leaky = [(20_000 + i, f"{prose(700 + i, 60)} {t}") for i, t in items]
    good = [(30_000 + i, prose(5000 + i, 90)) for i in range(200)]
    everything = rows + junk + leaky + good
    documents = frame(spark, [(i, t, "en", "s", len(t)) for i, t in everything], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labelled = [(i, 0, 0) for i, _ in junk[:50]] + [(i, 1, 0) for i, _ in good[:150]]
    frame(spark, labelled, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, kept = documents, dict(everything)
    docs = corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).cache()
    assert docs.columns == documents.columns
    left = {r.doc_id for r in docs.collect()}
    assert not left & {i for i, _ in junk} and left >= {i for i, _ in leaky + good}
    kept = {i: t for i, t in kept.items() if i in left}

    docs = corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).cache()
    plain = {i: mark for i, _, _, mark in plain_lines(list(kept.items()))}
    got = {r.doc_id: r for r in docs.collect()}
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == plain
    assert all(r.n_chars == len(r.text) for r in got.values())

    docs = corpus_pipeline.ngram_jaccard_join(spark, docs, str(tmp_path)).cache()
    groups = plain_components([(i, r.text) for i, r in got.items()])
    assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in groups.items() if c == i}

    before = {r.doc_id for r in docs.collect()}
    docs = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).cache()
    assert before - {r.doc_id for r in docs.collect()} == {i for i, _ in leaky} & before

    tokens = {r.doc_id: r.ids for r in corpus_pipeline.byte_level_bpe(spark, docs, str(tmp_path)).collect()}
    assert tokens == {r.doc_id: encoding.encode_ordinary(r.text) for r in docs.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in whole} == tokens


def test_stages_of_empty_and_repeated_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame(spark, [], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [(1, "x y z")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "a b c d e f", None, "s", 11), (3, "a b c d e f", "en", "s", 11)]
    for rows, left in ((odd, 3), ([], 0)):
        docs = frame(spark, rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == left
    assert signature_tree.PERCENT == 75 and signature_tree.SHINGLE == 5


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _file string, row string"


def as_documents(spark, rows):
    return frame(spark, [(i, t, "en", "s", len(t), "f", "r") for i, t in rows], SCHEMA)


def test_near_duplicates_of_rows_whose_ids_repeat_or_miss(spark, tmp_path):
    a, b, c, d = (prose(60 + i, 80) for i in range(4))
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, d), (None, d), (9, d), (None, ""), (None, ""), (None, edited(a, 1, 1)), (8, "few words")]
    docs = as_documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/written.parquet")
    for own in (docs, spark.read.parquet(f"{tmp_path}/written.parquet")):
        got = corpus_pipeline.ngram_jaccard_join(spark, own, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
            [(3, a), (5, b), (7, c), (9, d), (None, ""), (None, ""), (8, "few words")], key=repr)
    alone = as_documents(spark, [(None, d), (None, d)])
    assert [r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, alone, "").collect()] == [None]


def test_leaks_of_rows_whose_ids_repeat_or_miss(spark, tmp_path):
    item = prose(901, 40)
    frame(spark, [(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(i, prose(100 + i, 120)) for i in range(30)]
    leaky = [(None, f"{prose(1, 30)} {item}"), (4, f"{item} {prose(2, 30)}"), (None, item)]
    rows = clean + leaky + [(None, clean[0][1]), (4, clean[4][1])]
    got = corpus_pipeline.benchmark_decontamination(spark, as_documents(spark, rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([r for r in rows if r not in leaky], key=repr)
