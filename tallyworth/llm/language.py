"""Language identification by mixture inference.

A language is a distribution over hashed byte trigrams. For each document, expectation-maximisation estimates the
proportions of the languages, and a penalised likelihood chooses how many of them the document really holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
# Hashed trigrams; together with MOST_LANGUAGES this bounds the model, whatever the size of the corpus.
BINS = 1 << 15
MOST_LANGUAGES = 200
SMOOTHING = 0.1
# Steps of the expectation-maximisation at most, and the change of a proportion at which it stops.
STEPS, SETTLED = 30, 1e-3
# Penalty per language, as a multiple of ln(number of trigrams): neighbouring trigrams are far from independent.
PENALTY = 3.0

_LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else 32 if i <= 32 else i for i in range(256))


def trigrams(text: str) -> np.ndarray:
    """The hashed trigrams of the UTF-8 bytes, A-Z in lower case, white space as one kind of character."""
    raw = np.frombuffer((" " + text + " ").encode("utf-8", "surrogatepass").translate(_LOWER), dtype=np.uint8).astype(np.uint32)
    code = raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class LanguageModel:
    """Names of the languages and the probability of every hashed trigram in each."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts.astype(np.float64) + SMOOTHING
        self.likelihood = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)

    def proportions(self, text: str) -> dict[str, float]:
        """The chosen languages of a text with their proportions, the largest first."""
        if not self.names:
            return {}
        grams, times = np.unique(trigrams(text), return_counts=True)
        table, times = self.likelihood[grams], times.astype(np.float64)
        total = times.sum()
        start = times @ np.log(table)
        full, _ = _mixture(table, times, _start(start, total))
        order = np.argsort(-full, kind="stable")
        best = None
        for size in range(1, len(order) + 1):
            chosen = order[:size]
            if size == 1:
                share, fit = np.ones(1), start[chosen[0]]
            elif full[chosen[-1]] < 0.01:
                break
            else:
                share, fit = _mixture(table[:, chosen], times, full[chosen] / full[chosen].sum())
            value = fit - PENALTY * (size - 1) * np.log(total + 1)
            if best is not None and value <= best[0]:
                break
            best = (value, chosen, share)
        _, chosen, share = best
        ranked = np.argsort(-share, kind="stable")
        return {self.names[chosen[i]]: float(share[i]) for i in ranked}


def _start(fits: np.ndarray, total: float) -> np.ndarray:
    """Proportions to start from: the single languages by their mean fit, none of them zero."""
    weight = np.exp(20 * (fits - fits.max()) / total) + 0.01
    return weight / weight.sum()


def _mixture(table: np.ndarray, times: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    total = times.sum()
    for _ in range(STEPS):
        mixed = table @ share
        after = share * ((times / mixed) @ table) / total
        moved = np.abs(after - share).max()
        share = after
        if moved < SETTLED:
            break
    return share, float(times @ np.log(table @ share))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and bin of one task: bounded by languages x BINS, whatever the task reads."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, value in zip(batch.column("lang").to_pylist(), batch.column("_text")):
            text = value.as_py()
            if has_letter(text):
                found = np.bincount(trigrams(text), minlength=0) if len(text) > BINS else None
                total = counts.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                if found is None:
                    np.add.at(total, trigrams(text), 1)
                else:
                    total[: len(found)] += found
    for lang, total in counts.items():
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(used), type=pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used])], ["lang", "bin", "n"]
        )


def train(labelled: DataFrame, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """A model from all rows (text, lang) with a language and a letter; nothing to learn from gives an empty model.

    Counts are summed per task, then per bin. At most languages x BINS rows come back; more languages raise.
    """
    rows = labelled.filter("lang IS NOT NULL").select(F.col("lang").cast("string"), F.col("text").alias("_text"))
    counts = rows.mapInArrow(_gram_counts, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))
    found = {r["lang"]: r["bins"] for r in packed.limit(most_languages + 1).collect()}
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    names = sorted(found)
    table = np.zeros((len(names), BINS), dtype=np.int64)
    for i, name in enumerate(names):
        cells = np.array(found[name], dtype=np.int64)
        table[i, cells[:, 0]] = cells[:, 1]
    return LanguageModel(names, table)


ADDED = ("lang_pred", "score", "languages")


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """Every row of `docs` with lang_pred, score (its proportion) and languages (all chosen, the largest first).

    Only the text is read. Null texts and texts without a letter are UNKNOWN with score 0, and so is every text under an empty
    model. Repeated rows are each judged; an empty table gives an empty result. Columns of those names are replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # bounded by MOST_LANGUAGES x BINS probabilities

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            found = []
            for value in batch.column("text"):
                text = value.as_py()
                shares = own.proportions(text) if has_letter(text) else {}
                first = next(iter(shares), UNKNOWN)
                found.append((first, min(1.0, shares.get(first, 0.0)), ",".join(shares)))
            out = batch
            for i, (name, kind) in enumerate(zip(names, (pa.string(), pa.float64(), pa.string()))):
                out = out.append_column(name, pa.array([f[i] for f in found], type=kind))
            yield out

    kept = docs.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(judge, f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` string")


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3: it parts learning from held-out documents. Null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: with a language, an id, and a remainder other than 1."""
    return docs.filter((remainder() != 1) & F.col("lang").isNotNull()).select("text", "lang")


def known_language(docs: DataFrame, model: LanguageModel, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose main language is known and makes up at least `least_score` of the text."""
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name of the table
    names = (f"{free}pred", f"{free}score", f"{free}all")
    judged = identify(docs, model, names)
    kept = (F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least_score)
    return judged.filter(kept).select(*(f"`{c}`" for c in docs.columns))
