"""Licence scans beside plain Python over all places of a text."""

from collections import Counter

import edges
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tallyworth.llm import licenses

EVERY = licenses.Index({})


def plain(text, templates=licenses.TEMPLATES):
    """The row of a text from every place of every template."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) > 127 else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    found = []
    for t in templates:
        for place in range(-len(t.words), len(words)):
            window = {i: words[i] for i in range(max(0, place), min(len(words), place + len(t.words)))}
            hits = sum(window.get(place + p) == w for p, w in enumerate(t.words))
            said = all(
                any(all(window.get(s + i) == w for i, w in enumerate(x)) for s in range(place, place + len(t.words) - len(x) + 1)) for x in t.phrases
            )
            if hits >= t.least and said:
                found.append((t, place, hits))
    places = [place for t, place, _ in found if t.base]
    base = sorted({t.label for t, _, _ in found if t.base})
    labels = sorted({t.label for t, _, _ in found})
    score = max((hits / len(t.words) for t, _, hits in found), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(labels), score


def notices():
    out = []
    for t in licenses.TEMPLATES:
        words = list(t.words)
        changed = [*words]
        changed[len(words) // 2] = "other"
        out += [" ".join(words).upper(), "x, " + "; ".join(words) + " y", " ".join(words[1:]), " ".join(words[:-2]), " ".join(changed), " ".join(words * 2)]
    return out


def test_notices_whole_cut_and_changed(spark):
    rows = [(i, t) for i, t in enumerate([*notices(), "GNU\ngeneral-public License", "cc by cc by", "mit licensé", "MİT license", "apache  license apache"])]
    rows += [(i and 1000 + i, t) for i, t, *_ in edges.texts() if len(t or "") < 5000]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, labels string").repartition(3)
    found = Counter(tuple(r) for r in licenses.licences(df).collect())
    assert found == Counter((i, *plain(t)) for i, t in rows)
    by_id = {r[0]: r for r in found}
    assert by_id[0][6] == "gpl" and all(by_id[6 * k][6].split(",").count(t.label) == 1 for k, t in enumerate(licenses.TEMPLATES))


vocabulary = sorted({w for t in licenses.TEMPLATES for w in t.words})


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from([*range(len(licenses.TEMPLATES))]), max_size=3),
    st.lists(st.sampled_from([*vocabulary, "und"]), max_size=30),
    st.randoms(use_true_random=False),
    st.dictionaries(st.sampled_from(vocabulary), st.integers(0, 50)),
)
def test_index_loses_no_place_whatever_the_frequencies(chosen, noise, rng, frequencies):
    words = list(noise)
    for k in chosen:
        own = [w if rng.random() > 0.12 else rng.choice(vocabulary) for w in licenses.TEMPLATES[k].words]
        at = rng.randint(0, len(words))
        words[at:at] = own
    text = " ".join(words)
    assert licenses._row(licenses.Index(frequencies), text) == plain(text)


@pytest.mark.parametrize("stretch", [1, 7, 100])
def test_stretches_change_nothing(monkeypatch, stretch):
    texts = [*notices()[:20], edges.words(1, 50) + " mit license " + edges.words(2, 50)]
    want = [licenses._row(EVERY, t) for t in texts]
    monkeypatch.setattr(licenses, "STRETCH", stretch)
    assert [licenses._row(EVERY, t) for t in texts] == want


def test_frequencies_count_documents_and_no_rows_give_no_rows(spark):
    df = spark.createDataFrame([(1, "mit mit license"), (2, "MIT x"), (3, None), (4, "")], "doc_id long, text string").repartition(2)
    assert licenses.document_frequencies(df) == {"mit": 2, "license": 1}
    assert licenses.licences(edges.empty(spark)).collect() == []
