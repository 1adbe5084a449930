"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """The check of card numbers."""
    total = 0
    for place, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The check of international account numbers."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _is_card(match: str) -> bool:
    number = digits(match)
    return 13 <= len(number) <= 19 and luhn(number)


def _is_address(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _is_iban(match: str) -> bool:
    account = match.replace(" ", "")
    return 15 <= len(account) <= 34 and mod_97(account)


# Characters of an account number by country.
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC", 33: "RU",
}
_LENGTH = {country: n for n, countries in _LENGTHS.items() for country in countries.split()}
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers, leftmost and apart: of the length of their country, else the longest run of words that fits.

    A match may hold words that follow the number; these are left to the text, and so is all but the first character
    of a match without a number, so that a number in it is still found.
    """
    at = 0
    while match := _IBAN.search(text, at):
        start, whole = match.span()
        ends = [whole]
        places = [i for i in range(start, whole) if text[i] != " "]
        length = _LENGTH.get(text[start : start + 2])
        if length is None:
            ends += [i for i in range(whole - 1, start, -1) if text[i] == " "]
        elif length <= len(places) and (places[length - 1] + 1 == whole or text[places[length - 1] + 1] == " "):
            ends.insert(0, places[length - 1] + 1)
        end = next((e for e in ends if _is_iban(text[start:e])), None)
        if end is not None:
            yield start, end
        at = end or start + 1


# The patterns of the base kinds, in parts: a run of characters, and what has to follow it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile("[0-9]+")
_NUMBERS = re.compile(r"(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+ and _DOMAIN, leftmost and apart, in time linear in the text."""
    done = 0
    for domain in _DOMAIN.finditer(text):
        start = domain.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < domain.start():
            done = domain.end()
            yield start, done


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [0-9]+ and _NUMBERS, leftmost and apart, in time linear in the text."""
    done = 0
    for first in _NUMBER.finditer(text):
        if first.start() >= done and (rest := _NUMBERS.match(text, first.end())):
            done = rest.end()
            yield first.start(), done


def by_pattern(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


@dataclass(frozen=True)
class Kind:
    """What proposes spans, a character without which there are none, the check, and the contexts that move the score."""

    propose: Callable[[str], Iterator[tuple[int, int]]]
    hint: str
    check: Callable[[str], bool]
    score: float
    near: re.Pattern
    against: re.Pattern


_LETTER = "A-Za-z\u00c0-\u024f"


def whole_words(*lists: str) -> re.Pattern:
    """Any of the words of the lists (separated by `|`, a space also as `_` or `-` or nothing), whole and in any case.

    A word may also start with a capital inside a name such as accessToken.
    """
    words = [w.strip() for own in lists for w in own.split("|")]
    plain = "|".join(re.escape(w).replace("\\ ", "[ _-]?") for w in sorted(words, key=len, reverse=True))
    inner = "|".join(w.capitalize() for w in words if w.isascii() and w.isalpha())
    return re.compile(f"(?<![{_LETTER}])(?i:{plain})(?![{_LETTER}])|(?<=[a-z])(?:{inner})(?![a-z])")


# A proposed span counts from this score on. A word of its context that lies whole within so many characters before or
# after it adds LIFT, up to 1; without one, a word that speaks against it takes as much away. Base spans count whatever
# their score; a secret counts only with a word for it, and an account number unless it scores too low.
LEAST_SCORE, LIFT, WINDOW = 0.5, 0.4, 40

# Words of the context of each kind, in English, German, French and Spanish, and words against it.
CONTEXT = {
    "email": (
        ("email|e mail|mailto|mail|contact|write to|address", "kontakt|schreiben an|adresse", "courriel|contacter|\u00e9crire \u00e0", "correo|contacto|direcci\u00f3n"),
        "example|sample|noreply",
    ),
    "ip": (("ip|ipv4|address|host|server|gateway|subnet|dns|ping", "adresse|rechner", "adresse|serveur|h\u00f4te", "direcci\u00f3n|servidor"), "version|release|section|v|chapter|build"),
    "card": (
        ("card|visa|master|mastercard|amex|american express|credit|debit|cvv|cvc|expires|expiry", "karte|kreditkarte|g\u00fcltig bis", "carte|cr\u00e9dit|expire", "tarjeta|cr\u00e9dito|caduca"),
        "order|isbn|serial|tracking|invoice",
    ),
    "phone": (("phone|mobile|cell|tel|fax|call|whatsapp", "telefon|handy|anruf|mobil", "t\u00e9l\u00e9phone|portable|appeler", "tel\u00e9fono|m\u00f3vil|llamar"), "order|serial|isbn|tracking"),
    "iban": (("iban|account|bank|bic|swift|transfer", "konto|\u00fcberweisung", "compte|banque|virement", "cuenta|banco|transferencia"), "serial|tracking|order"),
    "secret": (
        (
            "token|tokens|secret|secrets|password|passwords|passwd|pwd|api key|access key|private key|credential|credentials|bearer",
            "passwort|kennwort|geheimnis|schl\u00fcssel|zugangsschl\u00fcssel",
            "mot de passe|jeton|cl\u00e9|secret",
            "contrase\u00f1a|clave|secreto|ficha",
        ),
        "commit|checksum|revision|sha1|sha256|md5|digest",
    ),
}


def _near(kind: str) -> tuple[re.Pattern, re.Pattern]:
    words, against = CONTEXT[kind]
    return whole_words(*words), whole_words(against)


RULES = {
    "email": Kind(emails, "@", lambda m: True, 0.9, *_near("email")),
    "ip": Kind(addresses, ".", _is_address, 0.6, *_near("ip")),
    "card": Kind(by_pattern(_CARD), "", _is_card, 0.9, *_near("card")),
    "phone": Kind(by_pattern(_PHONE), "+", lambda m: 9 <= len(digits(m)) <= 15, 0.6, *_near("phone")),
    "iban": Kind(accounts, "", _is_iban, 0.8, *_near("iban")),
    "secret": Kind(
        by_pattern(re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_-]{24,}(?![A-Za-z0-9])")),
        "",
        lambda m: any(c.isdigit() for c in m) and any(c.isalpha() for c in m),
        0.2,
        *_near("secret"),
    ),
}


def has_context(text: str, start: int, end: int, near: re.Pattern) -> bool:
    """Whether a word of the context lies whole within WINDOW before or after the span."""
    before, after = max(0, start - WINDOW), min(len(text), end + WINDOW)
    if before and text[before - 1].isalpha():  # a word that starts before the window does not lie in it
        while before < start and text[before].isalpha():
            before += 1
    if after < len(text) and text[after].isalpha():
        while after > end and text[after - 1].isalpha():
            after -= 1
    return bool(near.search(text[before:start]) or near.search(text[end:after]))


def scored(text: str, kind: Kind, start: int, end: int) -> float:
    """The score of a checked span: the words for it count before the words against it."""
    if has_context(text, start, end, kind.near):
        return min(1.0, kind.score + LIFT)
    if has_context(text, start, end, kind.against):
        return max(0.0, kind.score - LIFT)
    return kind.score


_HAS_DIGIT = re.compile("[0-9]")


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end (code points, end exclusive) and score, in the order of kinds, then start."""
    found = []
    if "@" not in text and not _HAS_DIGIT.search(text):
        return found
    for name, kind in RULES.items():
        if kind.hint not in text:
            continue
        for start, end in kind.propose(text):
            if not kind.check(text[start:end]):
                continue
            score = scored(text, kind, start, end)
            if name in BASE_KINDS or score >= LEAST_SCORE:
                found.append((name, start, end, score))
    return found


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    for batch in batches:
        ids, spans = batch.column(0), []
        for value in batch.column(1):
            text = value.as_py()
            spans.append([dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(text)] if text else [])
        yield pa.RecordBatch.from_arrays([ids, pa.array(spans, type=pa.list_(item))], ["doc_id", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of personal data of every row's whole text.

    Kinds are KINDS. Matches of one kind do not overlap and are the leftmost; one that fails its check is dropped
    without another try, but for account numbers (see `accounts`). Null and empty texts have no spans; repeated rows are each searched; an empty table gives an
    empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, f"doc_id long, spans {_SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows with every span of their text replaced by its kind in brackets; overlapping spans are merged."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(t.as_py()) for t in batch.column("text")]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, type=batch.schema.field("text").type))

    return docs.mapInArrow(clean, docs.schema)


def redact(text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]
