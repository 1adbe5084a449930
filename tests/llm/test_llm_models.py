"""Operators that learn, mix, pack and archive, beside plain Python."""

import base64
import gzip
import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import edges
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyworth.llm import language, mixing, packing, queries_two, warc

PATH = public_tokenizers.path(packing.VOCABULARY)


def test_language_of_held_out_documents(spark, folder):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries_two.op7_language_id(spark, folder).collect()
    assert {r["doc_id"] for r in found} == set(docs)
    right = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in found if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert len(right) > 40 and np.mean(right) > 0.97
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1


def test_languages_of_a_mixed_text(spark):
    learn = [("the cat and the dog sat on the mat with a hat " * 20, "en"), ("der hund und die katze sitzen auf dem dach " * 20, "de")]
    model = language.train(spark.createDataFrame(learn, "text string, lang string"))
    assert list(model.proportions("the dog and the cat on the mat")) == ["en"]
    both = model.proportions("the dog and the cat sat with a hat on the mat " * 8 + "der hund und die katze auf dem dach " * 4)
    assert list(both) == ["en", "de"] and 0.5 < both["en"] < 0.8 and math.isclose(sum(both.values()), 1, abs_tol=1e-6)


def test_language_on_edge_rows(spark):
    docs = edges.documents(spark)
    model = language.train(language.learning_rows(docs))
    found = language.identify(docs, model)
    assert found.count() == len(edges.texts())
    no_letter = {4, 5, 6, 10}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in no_letter) for r in found.collect())
    kept = language.known_language(docs, model)
    assert kept.columns == docs.columns and not {r["doc_id"] for r in kept.collect()} & no_letter
    nothing = language.train(language.learning_rows(edges.empty(spark)))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(edges.empty(spark), model).collect() == []
    with pytest.raises(ValueError):
        language.train(docs, most_languages=1)


def test_weights_meet_their_target():
    tokens = {"big": 9000, "middle": 700, "small": 300}
    weights = mixing.mixing_weights(tokens, mixing.Target(entropy=0.9, repeats=100.0))
    assert math.isclose(sum(weights.values()), 1)
    assert math.isclose(mixing.entropy(list(weights.values())) / math.log(3), 0.9, rel_tol=1e-9)
    tight = mixing.Target(entropy=0.9, repeats=2.0, budget=1.0)
    limited = mixing.mixing_weights(tokens, tight)
    assert max(limited[s] * 10000 / tokens[s] for s in tokens) <= 2.0 + 1e-9
    assert mixing.mixing_weights({"one": 5}) == {"one": 1.0} and mixing.mixing_weights({}) == {}
    assert all(passes >= 1 for _, _, passes, _ in mixing.mixing_plan(tokens))


@pytest.mark.parametrize("budget", [None, 0.5, 1.0, 2.7])
def test_draws_fill_the_budget(spark, folder, budget):
    target = mixing.Target(budget=budget)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    count = {r["doc_id"]: (r["source"], len(edges.words_of(r["text"]))) for r in docs.collect()}
    totals, longest = Counter(), Counter()
    for source, n in count.values():
        totals[source] += n
        longest[source] = max(longest[source], n)
    plan = {name: passes * totals[name] + rest for name, _, passes, rest in mixing.mixing_plan(dict(totals), target)}
    drawn, times = Counter(), defaultdict(set)
    for r in mixing.mix(docs, target).collect():
        assert (r["source"], r["tokens"]) == count[r["doc_id"]]
        drawn[r["source"]] += r["tokens"]
        assert r["epoch"] not in times[r["doc_id"]]
        times[r["doc_id"]].add(r["epoch"])
    for source, goal in plan.items():
        assert goal - longest[source] < drawn[source] <= goal
        passes = {len(times[d]) for d, (s, n) in count.items() if s == source and n}
        assert max(passes) - min(passes) <= 1
    if budget is None:
        assert all(times[d] for d, (_, n) in count.items() if n)


def test_every_pass_has_an_order_of_its_own_and_the_last_is_cut_in_its_order(spark):
    rows = [(i, "big", "w " * 50) for i in range(300)] + [(1000 + i, None, f"one two three {'x ' * (i % 5)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    tokens = {i: len(t.split()) for i, _, t in rows}
    target = mixing.Target(entropy=0.99, repeats=50.0)
    totals = {"big": sum(tokens[i] for i, s, _ in rows if s), "": sum(tokens[i] for i, s, _ in rows if not s)}
    drawn = mixing.mix(docs, target).collect()
    for name, _, passes, rest in mixing.mixing_plan(totals, target):
        own = [r for r in drawn if (r["source"] or "") == name]
        ids = [i for i, s, _ in rows if (s or "") == name]
        orders = [[r["doc_id"] for r in sorted((r for r in own if r["epoch"] == e), key=lambda r: (r["block"], r["place"]))] for e in range(passes + 1)]
        assert all(sorted(order) == ids for order in orders[:passes])
        assert passes < 2 or len(set(map(tuple, orders[:passes]))) == passes
        assert sum(tokens[i] for i in orders[passes]) <= rest
        missing = set(ids) - set(orders[passes])
        assert not missing or sum(tokens[i] for i in orders[passes]) + max(tokens[i] for i in missing) * 1.0 > rest - max(tokens[i] for i in ids)
    assert Counter((r["doc_id"], r["epoch"], r["block"], r["place"]) for r in drawn) == Counter(
        (r["doc_id"], r["epoch"], r["block"], r["place"]) for r in mixing.mix(docs.repartition(1), target).collect()
    )


def test_mixing_on_edge_rows(spark):
    docs = edges.documents(spark)
    drawn = mixing.mixed(docs)
    assert drawn.columns == docs.columns
    found = Counter(r["doc_id"] for r in drawn.collect())
    assert not set(found) & {4, 5, 6} and found[7] >= 2 and found[None] >= 2
    assert mixing.mixed(edges.empty(spark)).collect() == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
@settings(max_examples=150, deadline=None)
def test_packings_hold_everything(counts):
    solution = packing.pack_counts(counts, 64, steps=300)
    used = Counter()
    for filling, times in solution:
        assert sum(filling) <= 64 and times > 0
        for size in filling:
            used[size] += times
    assert used == Counter(counts)
    sequences = sum(n for _, n in solution)
    assert packing.lower_bound(counts, 64) <= sequences <= sum(n for _, n in packing.best_fit(counts, 64))


def least_sequences(items, length):
    """Brute force on a few items."""
    best = [len(items)]

    def place(at, bins):
        if len(bins) >= best[0]:
            return
        if at == len(items):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[at] <= length:
                place(at + 1, [*bins[:i], bins[i] + items[at], *bins[i + 1 :]])
        place(at + 1, [*bins, items[at]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_small_packings_are_the_smallest(items):
    assert sum(n for _, n in packing.pack_counts(Counter(items), 20)) == least_sequences(sorted(items, reverse=True), 20)


def test_fillings_may_repeat_sizes():
    assert sum(n for _, n in packing.pack_counts({300: 4, 212: 4})) == 2
    assert sum(n for _, n in packing.pack_counts({300: 4_000, 212: 4_000})) == 2_000


@given(st.dictionaries(st.integers(1, 12), st.integers(0, 3), max_size=5), st.integers(1, 14), st.integers(0, 14))
@settings(max_examples=150, deadline=None)
def test_all_fillings_are_listed(counts, room, slack):
    sizes = sorted(counts, reverse=True)
    every = [tuple(s for s, k in zip(sizes, ks) for _ in range(k)) for ks in itertools.product(*(range(counts[s] + 1) for s in sizes))]
    want = sorted((f for f in every if 0 <= room - sum(f) <= slack), key=lambda f: (-sum(f), [-s for s in f]))
    assert list(packing.fillings(room, counts, slack)) == want
    for k, filling in enumerate(want):
        assert list(packing.fillings(room, counts, slack, filling)) == want[k + 1 :]


def test_best_fit_takes_the_fullest_sequence():
    assert sorted(packing.best_fit({7: 1, 6: 1, 3: 1, 4: 1}, 10)) == [((6, 4), 1), ((7, 3), 1)]
    assert sorted(packing.best_fit({6: 2, 5: 1, 4: 1, 2: 1}, 10)) == [((5,), 1), ((6, 2), 1), ((6, 4), 1)]


def check_packed(rows, texts):
    tokenizer = Tokenizer.from_file(PATH)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for doc, (text, copies) in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted(pieces[doc], key=lambda r: r["start"])[::copies]
        assert len(own) * copies == len(pieces[doc])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert sum(r["length"] for r in own) == len(ids) and (len(own) == 1) == (len(ids) <= 1024)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packed_documents(spark, folder):
    texts = {r["doc_id"]: (r["text"], 1) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries_two.op3_packing(spark, folder).collect()
    used = check_packed(rows, texts)
    lengths = Counter(r["length"] for r in rows)
    assert packing.lower_bound(lengths) <= used <= packing.lower_bound(lengths) + 2


def test_packing_on_edge_rows(spark):
    rows = [(i, t, "x") for i, t, _, _ in edges.texts() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    copies = Counter(i for i, *_ in rows)
    check_packed(packing.pack(docs, PATH).collect(), {i: (t, copies[i]) for i, t, _ in rows})
    assert packing.pack(edges.documents(spark), PATH).select("doc_id").distinct().count() == len(copies) + 1
    assert packing.pack(edges.empty(spark), PATH).collect() == []


PAGES = [
    (1, "http://a.b/ c", "same"), (2, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n"),
    (6, "ü", "é" * 100_000), (7, "u", "x" * 200_001), (8, "u", "x" * 200_001), (-9, "u", "minus"), (10, "u", "\x00\ud7ff\U0001f600\r\n"),
]


def check_archived(rows, pages):
    payload = {i: (html or "").encode() for i, html in pages}
    largest = {}
    for i, body in payload.items():
        largest[body] = max(largest.get(body, i), i)
    assert sorted(r["page_id"] for r in rows) == sorted(payload)
    for r in rows:
        body = payload[r["page_id"]]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = largest[body]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))


def test_pages_survive_their_archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "k", 1) for p in PAGES] + [(None, "u", "z", "k", 1)], "page_id long, url string, html string, payload string, name int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    check_archived([r for r in queries_two.op9_warc(spark, str(tmp_path)).collect() if r["page_id"] is not None], [(i, h) for i, _, h in PAGES])
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, segment=1000, file_rows=3)
    bodies = {r["name"]: bytes(r["payload"]) for r in warc.read_archives(spark, path).collect()}
    assert bodies == {f"urn:page:{i}": (h or "").encode() for i, _, h in PAGES} | {"urn:page:none": b"z"}


def test_rows_without_a_page_id_are_archived(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "v", "same"), (3, "u", "same"), (None, "u", "own"), (None, "u", "own"), (None, None, None), (4, "u", "x" * 100_000)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    found = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in queries_two.op9_warc(spark, str(tmp_path)).collect())
    want = [(None, 4, "revisit", 3)] * 2 + [(3, 4, "response", None)] + [(None, 3, "response", None)] * 2
    assert found == Counter([*want, (None, 0, "response", None), (4, 100_000, "response", None)])


def test_archives_of_many_members(spark, tmp_path):
    bodies = [b"first", b"x" * 3_000_000, b"", bytes(range(256)) * 3000]
    records = [warc.records_of(f"urn:page:{i}", "u", b, warc.digest_of(b), None, 1 << 16) for i, b in enumerate(bodies)]
    flat = [r + b"\r\n\r\n" for own in records for r in own]
    members = b"".join(gzip.compress(r) for r in flat)
    whole = [b for _, b in warc.parse_archive(b"".join(flat))]
    assert len(whole) == len(flat) and [b for _, b in warc.parse_archive(members)] == whole
    assert [b for _, b in warc.parse_archive(gzip.compress(b"".join(flat)))] == whole
    assert [b for _, b in warc.parse_archive(members + b"\0" * 20)] == whole
    for broken in (members[:-9], members[: len(members) // 2]):
        with pytest.raises(ValueError):
            list(warc.parse_archive(broken))
    (tmp_path / "part-0.gz").write_bytes(members)
    found = {r["name"]: bytes(r["payload"]) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert found == {f"urn:page:{i}": b for i, b in enumerate(bodies)}


def test_repeated_pages_have_records_of_their_own(spark, tmp_path):
    long, other = "x" * 200_001, "y" * 150_000
    pages = [(1, "u", long), (1, "u", long), (1, "u", long), (2, "u", "short"), (2, None, "short"), (2, "u", other), (2, "v", long), (0, "w", long)]
    pages += [(0, "w", other), (-3, "u", "short"), (-3, "u", "short"), (9, "u", "alone")]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5).write.parquet(str(tmp_path / "pages.parquet"))
    last = {html: max(i for i, _, h in pages if h == html) for _, _, html in pages}
    want = Counter()
    for i, _, html in pages:
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        want[(i, len(html), digest, *(("response", None) if last[html] == i else ("revisit", last[html])))] += 1
    assert Counter(tuple(r) for r in queries_two.op9_warc(spark, str(tmp_path)).collect()) == want
    path = str(tmp_path / "archives")
    warc.write_archives(spark.read.parquet(str(tmp_path / "pages.parquet")), path, segment=1000)
    found = warc.read_archives(spark, path).collect()
    assert len({r["name"] for r in found}) == len(pages)
    targets = Counter((r["name"].split(":")[2], r["target"], bytes(r["payload"]).decode()) for r in found)
    assert targets == Counter((str(i), u, h) for i, u, h in pages)


def test_pages_query(spark, folder):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    check_archived(queries_two.op9_warc(spark, folder).collect(), pages)


def test_no_pages_and_small_payloads(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none).collect() == []
    pages = spark.createDataFrame([(i, "u", h) for i, _, h in PAGES], "page_id long, url string, html string")
    types = {r["name"]: r["record_type"] for r in warc.archived(pages, least=5).collect()}
    assert types["urn:page:1"] == "response" and types["urn:page:7"] == "revisit"


def test_broken_archives_raise():
    body = warc.chunked(b"abc" * 10, 7)
    assert warc.unchunked(body) == b"abc" * 10
    with pytest.raises(ValueError):
        warc.unchunked(body[:-8])
    pieces = [(2, b"b"), (1, b"a"), (3, b"c")]
    assert warc.join_segments(pieces, 3) == b"abc"
    for bad, total in ((pieces, 4), (pieces, None), (pieces[:1], 1)):
        with pytest.raises(ValueError):
            warc.join_segments(bad, total)
    whole = warc.record([(b"WARC-Type", b"response")], b"abc") + b"\r\n\r\n"
    assert [b for _, b in warc.parse_archive(whole * 2)] == [b"abc"] * 2
    with pytest.raises(ValueError):
        list(warc.parse_archive(whole[:-1]))
