"""Fingerprints, line dedup, near duplicates, substring and suffix dedup against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grapevine.llm import components, fingerprints, fm_index, line_runs, queries, repeats, signature_tree, suffix_blocks

from .helpers import LOWER, WORD, clashing, corpus, frame


@pytest.fixture(scope="module")
def rows():
    return corpus()


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def folder_of(spark, tmp_path, rows, **tables):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# fingerprints


def plain_sketch(text: str | None) -> list[int]:
    words = WORD.findall(text or "")
    if not words:
        return []
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    found = set()
    for i in range(max(len(words) - 4, 1)):
        seed = 42
        for h in hashes[i:i + 5]:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        if seed >> 61 == 0:
            found.add(seed)
    return sorted(found)


def test_sketch_keeps_every_low_hash(spark, rows):
    got = frame(spark, rows).select("text", fingerprints.sketch(F.col("text")).alias("s")).collect()
    assert all(row.s == plain_sketch(row.text) for row in got)


def test_edited_texts_and_likeness(spark, rows, tmp_path):
    got = {r.doc_id: r for r in queries.op1_fingerprints(spark, folder_of(spark, tmp_path, rows)).collect()}
    texts = {i: t or "" for i, t in rows}
    ids = sorted(texts, reverse=True)
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, k = texts[i], len(texts[i]) // 3
        new = text[:len(text) - k] + texts[after][:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), digest(new))
        for other, near in ((new, got[i].near_edited), (texts[after], got[i].near_next)):
            a, b = set(plain_sketch(text)), set(plain_sketch(other))
            expected = 1.0 if text == other else len(a & b) / len(a | b) if a | b else 0.0
            assert near == pytest.approx(expected)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (text == new)


def test_fingerprints_of_nothing_one_row_and_null_ids(spark, tmp_path):
    assert fingerprints.with_edits(frame(spark, [])).count() == 0
    one = fingerprints.with_edits(frame(spark, [(5, "abcdef")])).first()
    assert one.edited == "abcd" + "ab"
    many = fingerprints.with_edits(frame(spark, [(None, "abc"), (1, "xyz"), (1, "xyz"), (2, "uvw")])).collect()
    assert sorted((r.key is None, r.edited or "") for r in many) == [(False, "uvx"), (False, "xyu"), (False, "xyu"), (True, "")]


def test_union_of_sketches_is_the_sketch_of_the_union(spark, rows):
    table = frame(spark, rows).withColumn("s", fingerprints.sketch(F.col("text")))
    merged = table.agg(fingerprints.merged(F.col("s")).alias("s")).first().s
    assert merged == sorted(set().union(*(plain_sketch(t) for _, t in rows)), key=lambda h: h)


# line dedup


def plain_lines(rows, least=10):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    documents = Counter(k for _, t in rows for k in {key(line) for line in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [line for line in lines if not (key(line) and documents[key(line)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return sorted(out)


def test_line_dedup(spark, rows, tmp_path):
    got = queries.op2_line_dedup(spark, folder_of(spark, tmp_path, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_lines(rows)


def test_line_dedup_keeps_rows_and_columns(spark, rows):
    wide = clashing(spark, [*rows, *rows[:3], (None, "shared line"), (None, None)])
    got = line_runs.drop_repeated_lines(wide)
    assert set(wide.columns) < set(got.columns)
    assert got.count() == wide.count()
    assert line_runs.drop_repeated_lines(frame(spark, [])).count() == 0


def test_runs_are_levelled_and_find_unseen_keys(spark):
    runs = line_runs.LineRuns(spark, threshold=3, fan_out=2, buckets=2)
    key = lambda *names: spark.createDataFrame([(n, 0, 1) for n in names], "a bigint, b bigint, n_docs bigint")
    for batch in (key(1, 2), key(1, 3), key(1, 4), key(2)):
        runs.add(batch)
    assert [len(level) for level in runs.levels.values() if level] == [1]  # four batches, two compactions, one run
    assert sorted(r.a for r in runs.unseen(key(1, 4, 9)).collect()) == [9]
    assert [r.a for r in runs.repeated().collect()] == [1]
    runs.drop()


# near duplicates


def plain_components(rows, size=5, percent=75):
    sets = {}
    for i, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[j:j + size]) for j in range(max(len(words) - size + 1, 1))} if words else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [3, 1000])
def test_near_duplicates(spark, rows, block, monkeypatch):
    plain = signature_tree.class_components
    monkeypatch.setattr(signature_tree, "class_components", lambda *a: plain(*a, block=block))
    got = {r.doc_id: (r.n, r.component) for r in signature_tree.near_duplicates(frame(spark, rows)).collect()}
    assert got == plain_components(rows)


def test_near_duplicates_of_odd_tables(spark, rows):
    assert signature_tree.near_duplicates(frame(spark, [])).count() == 0
    repeated = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A B c d e f"), (None, None), (3, "")]
    got = signature_tree.near_duplicates(clashing(spark, [r for r in repeated if r[0]])).collect()
    assert sorted(r.component for r in got) == [1, 1, 1, 3]
    got = signature_tree.near_duplicates(frame(spark, repeated)).collect()
    assert sorted((r.doc_id or 0, r.component or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_tree_loses_no_pair():
    dice = np.random.default_rng(4)
    base = [np.unique(dice.integers(0, 1 << 48, dice.integers(3, 90)).astype(np.uint64)) for _ in range(30)]
    sets = [np.sort(b[dice.random(len(b)) < 0.95]) for b in base for _ in range(5)]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    tree = signature_tree.Tree(sets, sizes)
    found = set(zip(*(x.tolist() for x in signature_tree.leaf_pairs(tree, tree, 75)), strict=True))
    found = {tuple(sorted(p)) for p in found}
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if signature_tree.linked(sets[i], sets[j], sizes[i], sizes[j], 75)}
    assert true <= found
    assert len(found) < len(sets) * (len(sets) - 1) / 4


def test_components_of_a_long_path(spark):
    edges = frame(spark, [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components.components(frame(spark, [], "a bigint, b bigint")).count() == 0


# substring dedup


def plain_repeats(rows, window=20):
    seen, out = set(), []
    for i, t in sorted(rows):
        words, gone = WORD.findall(t or ""), set()
        for j in range(len(words) - window + 1):
            own = tuple(words[j:j + window])
            if own in seen:
                gone.update(range(j, j + window))
            seen.add(own)
        out.append((i, len(words), len(gone), digest(" ".join(w for j, w in enumerate(words) if j not in gone))))
    return out


@pytest.mark.parametrize("hot", [2, 4096])
def test_substring_dedup(spark, rows, tmp_path, hot, monkeypatch):
    monkeypatch.setattr("grapevine.llm.repeats.HOT_RUNS", hot)
    got = queries.op8_substring_dedup(spark, folder_of(spark, tmp_path, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_repeats(rows)


def test_substring_dedup_of_odd_tables(spark):
    assert fm_index.remove_repeats(frame(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(25))
    got = fm_index.remove_repeats(clashing(spark, [(1, text), (2, text), (3, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 25), (3, 0)]
    got = fm_index.remove_repeats(frame(spark, [(None, text), (1, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 25)]


def test_fm_index_counts_patterns():
    dice = np.random.default_rng(1)
    text = dice.integers(1, 5, 400)
    text[[100, 250, 399]] = 0
    index = fm_index.FMIndex(text, 8)
    for start in range(0, 390, 7):
        pattern = text[start:start + 5]
        if 0 in pattern:
            continue
        low, high = index.start(pattern[-1:])
        for symbol in pattern[-2::-1]:
            low, high = index.left(low, high, np.array([symbol]))
        places = sorted(index.order[low[0]:high[0]])
        assert places == [i for i in range(len(text) - 4) if (text[i:i + 5] == pattern).all()]


# suffix dedup


def plain_strings(rows, length=200):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[j:j + length] for _, b in bodies for j in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if counts[b[j:j + length]] > 1:
                gone[j:j + length] = b"\1" * length
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), digest(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return sorted(out)


@pytest.mark.parametrize("hot", [2, 4096])
def test_suffix_dedup(spark, rows, tmp_path, hot, monkeypatch):
    monkeypatch.setattr("grapevine.llm.repeats.HOT_RUNS", hot)
    got = queries.op9_suffix_dedup(spark, folder_of(spark, tmp_path, rows)).collect()
    assert sorted(tuple(r) for r in got) == plain_strings(rows)


def test_suffix_dedup_of_odd_tables(spark):
    assert suffix_blocks.remove_repeats(frame(spark, [])).count() == 0
    text = "".join(chr(97 + i * i % 23) for i in range(260))
    got = suffix_blocks.remove_repeats(clashing(spark, [(1, text), (1, text), (2, None)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 260), (1, 260), (2, 0)]


def exchanges_of(plan, name: str) -> list[set[str]]:
    """Types of the columns that each exchange of a plan moves."""
    found, open_nodes = [], [plan]
    while open_nodes:
        node = open_nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == name:
            found.append({node.output().apply(i).dataType().simpleString() for i in range(node.output().length())})
        if kind == "AdaptiveSparkPlanExec":
            open_nodes.append(node.executedPlan())
        children = node.children()
        open_nodes += [children.apply(i) for i in range(children.length())]
    return found


def test_suffix_dedup_moves_texts_once(spark, rows):
    docs = frame(spark, [(i, t) for i, t in rows] + [(1_000_000 + i, t) for i, t in rows[:20]])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spans = suffix_blocks.repeated_spans(repeats.keyed(docs, "doc_id", "text"))
        moved = exchanges_of(spans._jdf.queryExecution().executedPlan(), "ShuffleExchangeExec")
        assert moved and not any("string" in types for types in moved)
        assert spans.count() == spans.select("t", "u").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_sort_all_suffixes():
    dice = np.random.default_rng(2)
    text = np.concatenate([np.tile(dice.integers(97, 99, 50), 8), dice.integers(97, 100, 300), np.full(90, 97)]).astype(np.uint8)
    eights = suffix_blocks.eight_bytes(text)
    order = suffix_blocks.sorted_block(np.arange(len(text) - 32), eights, suffix_blocks.CoverRanks(eights, len(text)))
    body = text.tobytes()
    assert order.tolist() == sorted(range(len(text) - 32), key=lambda i: body[i:])


def test_cover_takes_every_pair_of_places():
    assert suffix_blocks.SHIFT.max() < suffix_blocks.PERIOD
    places = defaultdict(set)
    for a in range(31):
        for b in range(31):
            k = suffix_blocks.SHIFT[a, b]
            places[a, b] |= {(a + k) % 31, (b + k) % 31}
    assert all(p <= set(suffix_blocks.COVER.tolist()) for p in places.values())


def test_lines_are_counted_by_distinct_ids_as_in_sql(spark, tmp_path):
    rows = [(1, "a row\nof one id") for n in range(12)]  # a row that occurs twelve times
    rows += [(2, f"line of one id\nown {n}") for n in range(12)]  # an id with twelve texts
    rows += [(100 + n, f"Line of ten\nown {n}") for n in range(9)] + [(2, "line of ten")]
    rows += [(200 + n, "line of nine ids") for n in range(9)] + [(200, "line of nine ids"), (201, "line of nine ids\nmore")]
    rows += [(300 + n, "line of nine and null") for n in range(9)] + [(None, "line of nine and null")] * 3 + [(None, "line of ten")]
    docs = frame(spark, rows)
    lines = {}
    for i, t in rows:
        for line in t.split("\n"):
            lines.setdefault(line.lower(), set()).add(i)
    common = {k for k, ids in lines.items() if len(ids - {None}) >= 10}
    assert common == {"line of ten"}
    got = line_runs.drop_repeated_lines(docs, "text", 10).collect()
    expected = [(i, t, "\n".join(x for x in t.split("\n") if x.lower() not in common)) for i, t in rows]
    assert sorted(map(str, [(r.doc_id, r.text, r._kept) for r in got])) == sorted(map(str, expected))
