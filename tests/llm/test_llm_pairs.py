"""Operators that compare texts with each other, beside brute force, and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
import edges
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyworth.llm import components, jaccard, queries_three, repeats


def shingles(text, k):
    words = [w for w in edges.words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def expected_components(rows, k, num, den):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].add(n)
    for n, (i, s) in enumerate(sets):
        shared = Counter(m for x in s for m in holders[x] if m > n)
        for m, both in shared.items():
            j, other = sets[m]
            if den * both >= num * (len(s) + len(other) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return Counter((i, len(s), root(i)) for i, s in sets)


def got_components(docs, *settings_):
    return Counter(tuple(r) for r in jaccard.near_duplicates(docs, *settings_).collect())


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5)])
def test_components_of_documents(spark, folder, k, num, den):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_components(docs, k, num, den) == expected_components(rows, k, num, den)


def near_family(seed, count, length, edits):
    rng, base = random.Random(seed), edges.words(seed, length).split()
    out = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"w{rng.randint(0, 5)}"
        out.append((1000 * seed + i, " ".join(words[rng.randint(0, 3) :])))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
@pytest.mark.parametrize("open_hashes", [4_000_000, 1500])
def test_components_of_planted_families(spark, k, num, den, open_hashes):
    rows = near_family(1, 60, 150, 8) + near_family(2, 40, 30, 3) + near_family(3, 30, 9, 1) + near_family(4, 12, 900, 60)
    line = edges.words(77, 40)
    rows += [(90_000 + i, edges.words(500 + i, 15 + i) + "\n" + line) for i in range(60)]  # a passage that many share
    rows += [(95_000 + i, t) for i, t in enumerate(["a", "A", "b", "a b", "A  b\n", "", " ", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_components(docs, k, num, den, open_hashes) == expected_components(rows, k, num, den)


def test_components_on_edge_rows(spark):
    docs = edges.documents(spark)
    found = jaccard.near_duplicates(docs, 3, 90, 100).collect()
    known = [(i, t) for i, t, _, _ in edges.texts() if i is not None]
    expected = expected_components(known, 3, 90, 100)
    assert Counter(tuple(r) for r in found if r["doc_id"] is not None) == expected
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None, None]
    kept = jaccard.one_of_each(docs, 3, 90, 100)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in expected} | {None}
    assert jaccard.near_duplicates(edges.empty(spark)).collect() == []


@given(
    st.lists(st.sets(st.integers(0, 30), max_size=20), max_size=40), st.sampled_from([(90, 100), (4, 5), (1, 2)]), st.integers(1, 5), st.sampled_from([0, 10**6])
)
@settings(max_examples=300, deadline=None)
def test_opened_groups_give_all_links(sets, ratio, group, cells):
    num, den = ratio
    arrays = [np.array(sorted(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    labels = jaccard.linked([np.sort(a) for a in arrays], num, den, group, cells)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    assert len(set(map(root, range(len(sets))))) == len(set(labels.tolist()))
    assert all((labels[i] == labels[j]) == (root(i) == root(j)) for i in range(len(sets)) for j in range(i))


@given(st.integers(0, 10**6), st.integers(1, 400), st.sampled_from([(90, 100), (4, 5), (1, 2)]))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_signature(seed, size, ratio):
    num, den = ratio
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 1 << 64, 2 * size + 4, dtype=np.uint64))
    a = np.sort(rng.choice(pool, size, replace=False))
    drop, add = rng.integers(0, 1 + size // 4, 2)
    rest = np.setdiff1d(pool, a)
    b = np.union1d(rng.choice(a, max(1, size - drop), replace=False), rng.choice(rest, min(add, len(rest)), replace=False))
    both = len(np.intersect1d(a, b))
    if den * both < num * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    own = [{int(x) for _, found, _ in jaccard.signatures(s, num, den) for x in found} for s in (a, b)]
    assert own[0] & own[1]


def test_connected_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    pairs += [(9, 9), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(x, root(x)) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def expected_left(rows, length):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - length + 1):
            window = raw[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen[window] = True
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def got_left(docs, *settings_):
    return {r["doc_id"]: (*tuple(r)[1:5], bytes(r["kept"])) for r in repeats.without_repeats(docs, *settings_).collect()}


def candidates_of(sets, num=4, den=5):
    out = jaccard._Outgoing(1)
    for doc, tokens in enumerate(sets):
        out.add(doc, tokens, num, den)
    batches = jaccard._candidates(num, den)(iter([jaccard._blobs(out.rows())]))
    return [pair for batch in batches for pair in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]


def test_sets_without_a_shared_hash_are_no_candidates():
    rng = np.random.default_rng(12)
    for size in (60, 300, 3000, 6000):
        sets = [np.unique(rng.integers(0, 1 << 64, size + i % 7, dtype=np.uint64)) for i in range(1500 if size <= 300 else 150)]
        assert len(candidates_of(sets)) <= len(sets) // 50


@pytest.mark.parametrize("num,den", [(4, 5), (1, 2), (9, 10)])
def test_sets_that_link_are_candidates(num, den):
    rng = np.random.default_rng(num)
    sets, linked = [], []
    for size in [*range(1, 60), 150, 700, 2500, 6500]:
        own = rng.integers(0, 1 << 64, size, dtype=np.uint64)
        for share in (0.0, 0.02, 0.05, 0.1, 0.2):
            other = own.copy()
            gone = rng.permutation(size)[: int(share * size)]
            other[gone] = rng.integers(0, 1 << 64, len(gone), dtype=np.uint64)
            sets.append(np.unique(other if share < 0.1 else other[: max(1, int(0.95 * size))]))
    for i, a in enumerate(sets):
        for j in range(i - i % 5, i):
            both = len(np.intersect1d(a, sets[j]))
            if den * both >= num * (len(a) + len(sets[j]) - both) and len(a) + len(sets[j]) > 2 * both:
                linked.append((i, j))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in candidates_of(sets, num, den):
        parent[root(a)] = root(b)
    assert len(linked) > 50 and all(root(a) == root(b) for a, b in linked)
    # The groups of maps alone keep them, too, whatever the slices say.
    maps = np.array([jaccard.bit_map(tokens, 256) for tokens in sets])
    group = jaccard.group_by_maps(maps, np.array([len(tokens) for tokens in sets]), num, den)
    assert all(group[a] == group[b] for a, b in linked)


def test_repeats_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    expected = expected_left([(r["doc_id"], r["text"]) for r in docs.collect()], 100)
    found = {r["doc_id"]: tuple(r)[1:] for r in queries_three.op10_repeats(spark, folder).collect()}
    assert found == {d: v[:4] for d, v in expected.items()} and any(v[1] for v in expected.values())


@pytest.mark.parametrize("length,hot", [(100, 4096), (100, 2), (40, 3), (150, 4096)])
def test_repeats_of_planted_passages(spark, length, hot):
    rng = random.Random(8)
    passage = edges.words(9, 60)
    rows = [(i, edges.words(100 + i, rng.randint(0, 40)) + passage[rng.randint(0, 100) : rng.randint(150, 300)] + edges.words(300 + i, 9)) for i in range(70)]
    rows += [(100 + i, t) for i, t in enumerate(["a" * 350, "ab" * 200, "x" * 99, "x" * 100, "x" * 101, "é" * 120, "", None, "abc" * 100, passage, passage])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_left(docs, length, hot) == expected_left(rows, length)


def test_windows_of_hot_contexts_travel_as_hashes():
    texts = [edges.words(i, 9) * 3 + edges.words(9, 60)[:300] for i in range(4)]
    asks = np.array([(i, 7, at, 60, 1) for i in range(4) for at in (0, 70)], dtype=repeats.ASK)
    columns = [pa.array(range(4)), pa.array([t.encode() for t in texts]), pa.array([asks[asks["doc"] == i].tobytes() for i in range(4)])]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "asks"])
    (out,) = repeats._read_contexts(100, 3)(iter([batch]))
    sent = [np.frombuffer(b, repeats.ANCHOR) for k, b in zip(out.column("kind").to_pylist(), out.column("blob").to_pylist()) if k == repeats._ANCHORS]
    found = np.concatenate(sent)
    windows = {(int(a["doc"]), int(a["at"]) + i) for a in asks for i in range(61)}
    assert len(set(zip(found["key"].tolist(), found["same"].tolist()))) == len({texts[d].encode()[at : at + 100] for d, at in windows}) == len(found)
    assert repeats._CONTEXTS not in out.column("kind").to_pylist()


def test_only_contexts_with_an_equal_window_are_ranked():
    rng = np.random.default_rng(5)
    contexts = np.zeros(50, dtype=repeats.context_type(100))
    contexts["text"], contexts["span"], contexts["doc"] = rng.integers(1, 255, contexts["text"].shape), 30, np.arange(50)
    contexts["text"][7, 5:115] = contexts["text"][33, 20:130]
    assert repeats.with_equals(contexts, 100)["doc"].tolist() == [7, 33]
    assert set(map(tuple, repeats.covered_windows(contexts, 100).tolist())) == {(33, 20, 130)}


def test_repeats_on_edge_rows(spark):
    docs = edges.documents(spark)
    rows = [(i, t) for i, t, _, _ in edges.texts() if i is not None]
    found = repeats.without_repeats(docs).collect()
    assert len(found) == len(edges.texts())
    expected = expected_left(rows, 100)
    for r in found:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (*tuple(r)[1:5], bytes(r["kept"])) == expected[r["doc_id"]]
    assert repeats.without_repeats(edges.empty(spark)).collect() == []


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = None
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, folder)
        if number < 4:
            assert docs.columns == columns
            rows = [r["doc_id"] for r in docs.collect()]
            assert all(docs_text == texts[i] for i, docs_text in ((r["doc_id"], r["text"]) for r in docs.collect()))
        if number < 3:
            assert len(rows) == len(set(rows))
            if kept is not None:
                assert set(rows) <= kept
                if number == 2:
                    components_ = {c for _, _, c in expected_components([(i, texts[i]) for i in kept], 5, 4, 5)}
                    assert set(rows) == components_
            kept = set(rows)
        if number == 3:
            assert set(rows) == {i for i in kept if edges.words_of(texts[i])} and len(rows) >= len(kept)
            drawn = Counter(rows)
    pieces = Counter(r["doc_id"] for r in docs.filter("piece = 0").collect())
    assert pieces == drawn


def test_pipeline_on_edge_and_empty_rows(spark):
    for docs in (edges.documents(spark), edges.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
