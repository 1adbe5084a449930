"""Token alignment beside plain Python over all pairs of tokens."""

import hashlib
from collections import Counter

import edges
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyworth.llm import alignment

FIRST, SECOND = public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND)
ODD = [
    " ",
    " a  b ",
    "\n\n x\ty ▁ z",
    "<s> </s> <|endoftext|> hi",
    "▁",
    "a \n b",
    "don't we're   I'll 's",
    "\x00 x\x00",
    "é ﬁ \xbd x　y   z",
    "a\xa0b c  d\x1c e",
    "x \x0b\x0c y\r\n z",
    "1234567 12,5 ...!? ##",
]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(FIRST)
    tokenizer.encode_special_tokens = True
    return tokenizer


def plain(whole, text):
    """Ids of A and B, groups and links of one text; None if the bytes of either differ."""
    pair = alignment._pair(FIRST, SECOND)
    if not text:
        return None
    raw, a, b = (" " + text).encode(), whole.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    a_ends, b_ends = np.cumsum([len(pair.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(pair.b_bytes[i]) for i in b]).tolist()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None
    a_spans, b_spans = list(zip([0, *a_ends], a_ends, a)), list(zip([0, *b_ends], b_ends, b))
    cuts = sorted(set(a_ends) & set(b_ends))
    groups = [
        ",".join(str(i) for x, _, i in a_spans if lo <= x < hi) + "|" + ",".join(str(i) for x, _, i in b_spans if lo <= x < hi)
        for lo, hi in zip([0, *cuts], cuts)
    ]
    links = Counter((i, j) for x, y, i in a_spans for u, v, j in b_spans if max(x, u) < min(y, v))
    return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def expected(whole, rows):
    found = [(doc, plain(whole, text)) for doc, text in rows]
    held = Counter(pair for _, x in found if x for pair in x[3])
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    out = Counter()
    for doc, x in found:
        if not x:
            out[doc, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        n_best = sum(n for pair, n in x[3].items() if held[pair] == best[pair[0]])
        out[doc, x[0], x[1], x[2], sum(x[3].values()), n_best, sum(n * held[pair] for pair, n in x[3].items()), x[4]] += 1
    return out


def short(rows):
    return [(doc, None if text is None else text[:400]) for doc, text in rows]


@pytest.mark.parametrize("sent", [0, alignment.SENT_PAIRS])
def test_rows_equal_all_pairs(spark, folder, whole, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = short([(r["doc_id"], r["text"]) for r in docs[:80]] + [(i, t) for i, t, *_ in edges.texts()]) + [(900 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1, "p", [1]) for i, t in rows], "doc_id long, text string, row int, pair string, times array<int>")
    found = alignment.alignment(df.repartition(3), FIRST, SECOND, piece=50)
    assert Counter(tuple(r) for r in found.collect()) == expected(whole, rows)


def test_no_rows_and_one_very_long_text(spark, whole):
    assert alignment.alignment(edges.empty(spark), FIRST, SECOND).collect() == []
    text = edges.words(3, 6000)
    (row,) = alignment.alignment(spark.createDataFrame([(1, text)], "doc_id long, text string"), FIRST, SECOND, piece=1000).collect()
    a = whole.encode(" " + text, add_special_tokens=False).ids
    assert (row["n_a"], row["n_b"]) == (len(a), len(alignment._pair(FIRST, SECOND).b.encode(text)))
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"]


ends = st.lists(st.integers(1, 60), min_size=1, max_size=40, unique=True).map(sorted)


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.integers(1, 9))
def test_pieces_of_any_size_give_the_merge(a, b, piece):
    a, b = np.array([*a, 61]), np.array([*b, 61])
    at = np.arange(len(a) + len(b) + 1)
    order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    assert alignment.diagonal(a, b, at).tolist() == [sum(side == 0 for _, side in order[:k]) for k in at]
    over_a, over_b, a_groups, b_groups = alignment.merged(a, b, piece)
    spans_a, spans_b = list(zip([0, *a], a)), list(zip([0, *b], b))
    links = {(i, j) for i, (x, y) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b) if max(x, u) < min(y, v)}
    assert len(over_a) == len(links) and set(zip(over_a.tolist(), over_b.tolist())) == links
    cuts = sorted(set(a.tolist()) & set(b.tolist()))
    assert a_groups.tolist() == [sum(c < x for c in cuts) for x in a]
    assert b_groups.tolist() == [sum(c < x for c in cuts) for x in b]


def test_few_remembered_chunks_change_nothing(monkeypatch):
    text = [edges.words(i, 300) for i in range(6)]
    pair = alignment._Pair(FIRST, SECOND)
    want = [x[:5] for x in alignment._block(pair, text, 64)]
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    few = alignment._Pair(FIRST, SECOND)
    assert [alignment._block(few, [t], 64)[0][:5] for t in text] == want and len(few.known) == 20
