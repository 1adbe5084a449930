"""Operators on single rows and on equal rows, beside plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import edges
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tallyworth.llm import exact_dedup, pii, quality, queries_one, url_filter


def expected_copies(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        digest = hashlib.sha256(norm.encode()).hexdigest()
        for k, member in enumerate(sorted(members)):
            out[(member[3], best[3], len(members), k == 0, digest)] += 1
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_copies_on_edge_rows(spark, ranges):
    found = exact_dedup.exact_duplicates(edges.documents(spark), ranges=ranges).collect()
    rows = [(i, t) for i, t, _, _ in edges.texts()]
    assert Counter(tuple(r) for r in found) == expected_copies(rows)


@pytest.mark.parametrize("ranges", [7, 64])
def test_one_group_spans_many_ranges(spark, ranges):
    rows = [(i, "the same text " * 20 + ("x" if i % 10 == 0 else "")) for i in range(400)] + [(7, "again")] * 200
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), ranges=ranges).collect()
    assert Counter(tuple(r) for r in found) == expected_copies(rows)


def test_dedup_keeps_all_columns_of_one_row_per_group(spark):
    docs = edges.documents(spark)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in edges.texts()})
    assert exact_dedup.exact_dedup(edges.empty(spark)).collect() == []


def plain_counts(text):
    words = edges.words_of(text)
    lines = [x for x in (text or "").split("\n") if edges.words_of(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, sum(n - 1 for n in Counter(lines).values()), len(covered))


def test_base_counts_of_every_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    samples = [r["text"] for r in docs] + [t for _, t, _, _ in edges.texts()] + ["a b c a b c a b c", "x\nx\n\n\nx y\nx y", "#*$ | <>&%"]
    for text in samples:
        assert quality.text_counts(text)[:5] == plain_counts(text)


def test_quality_rejects_planted_junk_and_keeps_clean_texts(spark):
    clean = [(i, edges.words(i, 80 + i % 300) + ".\n" + edges.words(i + 9999, 50), "en", f"s{i % 3}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in edges.words(i, 200).split()), "en", f"s{i % 3}") for i in range(6)]
    junk += [(2000 + i, edges.words(i, 200).upper().replace(" ", "!! "), "en", f"s{i % 3}") for i in range(6)]
    junk += [(3000 + i, "same words here " * 100, "en", "s0") for i in range(3)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i] for i, *_ in clean)
    assert not any(found[i] for i, *_ in junk)


def test_quality_on_edge_rows(spark):
    found = quality.quality_verdicts(edges.documents(spark), steps=2).collect()
    assert len(found) == len(edges.texts())
    plain = Counter((i, *plain_counts(t)) for i, t, _, _ in edges.texts())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in found) == plain
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_verdicts(edges.empty(spark), steps=2).collect() == []


def test_concentration_steps_leave_outliers_out(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("en", "a", *map(float, rng.normal(0, 1, 6))) for _ in range(900)] + [("en", "a", *([30.0] * 6)) for _ in range(100)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in quality.GROUP) + ", " + ", ".join(f"{c} double" for c in quality.VECTOR))
    fit = quality.minimum_covariance(table).collect()
    assert len(fit) == 1 and np.abs(fit[0]["center"]).max() < 0.3


def test_a_third_of_a_group_may_be_junk(spark):
    clean = [(i, edges.words(i, 80 + i % 300) + ".\n" + edges.words(i + 9999, 50), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in edges.words(i, 100 + i)), "en", "s") for i in range(200)]
    found = quality.quality_verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 396


@pytest.mark.parametrize("share, at", [(0.33, 30.0), (0.33, -30.0), (0.45, 300.0)])
def test_the_fit_withstands_large_groups_of_outliers(spark, share, at):
    import numpy as np

    rng, far = np.random.default_rng(1), int(1000 * share)
    rows = [("en", "a", *map(float, rng.normal(0, 1, 6))) for _ in range(1000 - far)]
    rows += [("en", "a", *map(float, rng.normal(at, 1, 6))) for _ in range(far)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in quality.GROUP) + ", " + ", ".join(f"{c} double" for c in quality.VECTOR))
    fit = quality.minimum_covariance(table).collect()
    assert len(fit) == 1 and np.abs(fit[0]["center"]).max() < 0.3
    inverse = np.array(fit[0]["inverse"]).reshape(6, 6)
    assert (np.full(6, at) @ inverse @ np.full(6, at)) > quality.CUT


URLS = [
    (1, "http://Blog.Example.COM/en/1?x#y"), (2, "https://www.example.com/en/"), (3, "x://a.net/es/1"), (4, "x://a.net/es"),
    (5, None), (6, "no scheme"), (7, "http://"), (8, "http://com"), (9, "http://com/"), (10, "http://a.org/x://b.com/"),
    (11, "http://notexample.com/en/"), (12, "http://h?q/"), (13, "http://ÄB.net/fr/é"), (13, "http://ÄB.net/fr/é"), (None, "http://a.org/"),
]


def judged_by_hand(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.rule), default=None)


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in URLS], "page_id long, url string, host string, bad int")
    found = url_filter.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found)
    want = Counter()
    for i, url in URLS:
        host, path, rule = judged_by_hand(url)
        want[(i, host, path, rule.rule if rule else None, rule.verdict if rule else "allow")] += 1
    assert got == want
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).collect() == []


def test_a_bad_host_is_blocked_and_a_rare_one_is_not(spark):
    rows = [(i, f"http://bad.example.org/{i}") for i in range(60)] + [(100 + i, f"http://good{i % 20}.example.org/{i}") for i in range(200)]
    rows += [(900, "http://once.example.org/1")]
    outcomes = [(i, 1) for i in range(0, 60)] + [(100 + i, 0) for i in range(200)] + [(900, 1)]
    found = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int"))
    by_host = {r["host"]: r["verdict"] for r in found.select("host", "verdict").distinct().collect()}
    assert by_host["bad.example.org"] == "block"
    assert by_host["once.example.org"] == "allow" and by_host["good3.example.org"] == "allow"


PRIVATE = [
    "write to a.b+c@mail-1.example.co.uk, or x@y", "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111111111111112",
    "call +1 (243) 555-5526 now, +12 no", "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"',
    "9b0b3c6a43eb78aa99cbd7049c572391524f37a8 alone", "", None, "é\U0001f600 7@a.bc", "٣٤ 4111-1111-1111-1111 \n 4111\n111111111111",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
    }
    for i, text in enumerate(PRIVATE):
        want = [(k, m.start(), m.end()) for k, (p, ok) in patterns.items() for m in re.finditer(p, text or "") if ok(m.group())]
        assert [s for s in found[i] if s[0] in pii.BASE_KINDS] == want
    kinds = {i: {s[0] for s in spans} for i, spans in found.items()}
    assert "iban" in kinds[4] and sum(s[0] == "iban" for s in found[4]) == 1
    assert "secret" in kinds[5] and "secret" not in kinds[6]


KEY = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"


@pytest.mark.parametrize(
    "text", ["password is: {}", "API token for prod: {}", "access_key_id={}", "{} is the secret", "{}\n(an api key)", "token" + " " * 35 + "{}"]
)
def test_secrets_with_words_anywhere_near(text):
    text = text.format(KEY)
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans_of(text)] == [("secret", KEY)]


def test_words_outside_the_window_do_not_count():
    assert pii.spans_of("token" + " " * 36 + KEY) == [] == pii.spans_of(KEY + " " * 36 + "token")


@pytest.mark.parametrize(
    "kind, text",
    [("email", "e-mail: {}|a@b.cd"), ("ip", "{} is the server|10.0.0.1"), ("card", "my visa is {}|4111111111111111"),
     ("phone", "{} (mobile)|+1 (243) 555-5526"), ("iban", "account {}|GB82 WEST 1234 5698 7654 32")],
)
def test_every_kind_has_its_words(kind, text):
    text, span = text.split("|")
    alone = {k: score for k, *_, score in pii.spans_of(f"- {span} -")}
    near = {k: score for k, *_, score in pii.spans_of(text.format(span))}
    assert alone[kind] < near[kind] <= 1


@pytest.mark.parametrize(
    "text, accounts",
    [
        ("AT61 1904 3002 3457 3201 BIC RLNWATWW", ["AT61 1904 3002 3457 3201"]),
        ("AT61 1904 3002 3457 3201 CODE 12", ["AT61 1904 3002 3457 3201"]),
        ("ES91 2100 0418 4502 0005 1332 A 5", ["ES91 2100 0418 4502 0005 1332"]),
        ("BE68 5390 0754 7034 EUR 10", ["BE68 5390 0754 7034"]),
        ("AT61 1904 3002 3457 3201 DE89 3704 0044 0532 0130 00 OK", ["AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00"]),
        ("AB12 CDEF GHIJ GB82 WEST 1234 5698 7654 32", ["GB82 WEST 1234 5698 7654 32"]),
        ("AT611904300234573201BIC", []),
    ],
)
def test_accounts_end_where_their_country_says(text, accounts):
    assert [text[a:b] for k, a, b, _ in pii.spans_of(text) if k == "iban"] == accounts


@given(st.text(alphabet="a1.@-+ %é", max_size=60))
@settings(max_examples=500, deadline=None)
def test_linear_matches_are_those_of_the_patterns(text):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    address = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    assert list(pii.emails(text)) == [m.span() for m in email.finditer(text)]
    assert list(pii.addresses(text)) == [m.span() for m in address.finditer(text)]


def test_very_long_runs_take_linear_time():
    for text in ("a" * 400_000 + " @", "1" * 400_000 + ".", "+1" + "(" * 400_000, "a@" * 100_000, "1." * 100_000, "-" * 400_000 + "1"):
        pii.spans_of(text)


def test_redaction_leaves_no_base_span(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(PRIVATE)], "doc_id long, text string, spans int")
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    assert all(not pii.spans_of(r["text"]) for r in clean.collect() if r["text"])
    assert pii.personal_data(edges.empty(spark)).collect() == []
    assert pii.personal_data(edges.documents(spark)).count() == len(edges.texts())


def test_personal_data_query(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in queries_one.op6_personal_data(spark, folder).collect():
        spans = pii.spans_of(texts[row["doc_id"]] or "")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in pii.BASE_KINDS)
        assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert row["n_email"] == sum(s[0] == "email" for s in spans)
        assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


SECRET = "a1B2" * 10


@pytest.mark.parametrize(
    "text, counts",
    [
        ("token: {}", True),
        ("tokenizer {}", False),
        ("Passwort: {}", True),
        ("contraseña: {}", True),
        ("la clé est {}", True),
        ("accessToken={}", True),
        ("access_key_id={}", True),
        ("commit {}", False),
        ("token of commit {}", True),
        ("{} is the API key", True),
        ("{}", False),
        ("tok en {}", False),
        ("token " + "x" * 45 + " {}", False),
    ],
)
def test_context_words_are_whole_and_in_four_languages(text, counts):
    spans = pii.spans_of(text.format(SECRET))
    assert [s[0] for s in spans] == (["secret"] if counts else [])


def test_context_moves_the_score_of_every_kind():
    near = {"email": "kontakt a.b@c.de", "ip": "serveur 10.0.0.1", "card": "Kreditkarte 4111111111111111", "phone": "teléfono +49 30 1234567"}
    against = {"email": "example a.b@c.de", "ip": "version 10.0.0.1", "card": "order 4111111111111111", "phone": "serial +49 30 1234567"}
    for kind, base in pii.RULES.items():
        if kind not in near:
            continue
        high, low = ({s[0]: s[3] for s in pii.spans_of(text)}[kind] for text in (near[kind], against[kind]))
        assert high == min(1.0, base.score + pii.LIFT) and low == pytest.approx(base.score - pii.LIFT)
    iban = "DE89370400440532013000"
    assert [s[0] for s in pii.spans_of(f"Konto {iban}")] == ["iban"] and pii.spans_of(f"serial {iban}") == []


@pytest.mark.parametrize(
    "host, domain, suffix",
    [
        ("www.a.example.com", "example.com", "com"),
        ("shop.owner.co.uk", "owner.co.uk", "co.uk"),
        ("co.uk", "co.uk", "co.uk"),
        ("me.github.io", "me.github.io", "github.io"),
        ("user:word@x.org:8080", "x.org", "org"),
        ("a.b.com.", "b.com", "com"),
        ("10.0.0.1:80", "10.0.0.1", ""),
        ("[::1]", "[::1]", ""),
        ("localhost", "localhost", "localhost"),
        ("", "", ""),
    ],
)
def test_levels_of_a_host(spark, host, domain, suffix):
    found = spark.createDataFrame([(host,)], "host string").select(*url_filter.levels(F.col("host"))).first()
    assert tuple(found) == (domain, suffix)


def test_owners_under_one_suffix_do_not_share_a_domain(spark):
    rows = [(i, f"http://bad{i % 4}.github.io/x") for i in range(200)] + [(900, "http://small.github.io/x"), (901, "http://fine.example.org/y")]
    outcomes = [(i, 1) for i in range(200)] + [(900, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame(outcomes, "page_id long, bad int")
    apart = {r["host"]: r["bad_rate"] for r in url_filter.judge_urls(pages, labelled).collect()}
    together = {r["host"]: r["bad_rate"] for r in url_filter.judge_urls(pages, labelled, suffixes=()).collect()}
    assert apart["small.github.io"] < together["small.github.io"] and apart["bad1.github.io"] > 0.9
