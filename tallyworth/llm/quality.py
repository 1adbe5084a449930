"""Quality rules: base counts per text, and outliers by a minimum-covariance-determinant fit per language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
# Statistics of a text, each as ln(1 + per cent) but for the mean word length, which is a plain logarithm; with the
# least standard deviation that each is given, so that a group of very even texts does not reject small deviations.
FLOORS = {"symbols": 0.45, "dup_lines": 1.1, "repeats": 1.1, "word_length": 0.12, "upper": 0.45, "marks": 0.3}
VECTOR = tuple(FLOORS)
# Share of a group on which the determinant is smallest, tail beyond which rows have no weight in the final fit, tail of
# the chi-square cut, steps at most, smallest group.
KEPT_SHARE = 0.5
WEIGHT_TAIL = 0.025
TAIL = 1e-4
STEPS = 8
LEAST_GROUP = 50

_DELETE_SYMBOLS = {i: None for i in SYMBOLS}
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, upper-case words, ASCII marks."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at exactly the six ASCII white-space characters
    spaces = len(raw) - sum(map(len, words))
    lines = Counter(line for line in raw.split(b"\n") if line.strip())
    dup_lines = sum(lines.values()) - len(lines)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    counted = Counter(windows)
    if len(counted) < len(windows):
        covered = np.zeros(len(words), dtype=bool)
        at = np.fromiter((counted[w] > 1 for w in windows), dtype=bool, count=len(windows))
        for shift in range(3):
            covered[shift : shift + len(windows)] |= at
        repeated = int(covered.sum())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    upper = sum(map(str.isupper, text.split()))
    return (len(words), len(text) - spaces, symbols, dup_lines, repeated, sum(lines.values()), upper, marks)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([text_counts(t.as_py()) for t in batch.column("_text")], dtype=np.int64).reshape(-1, 8)
        n_words, chars, symbols, dup, repeat, lines, upper, marks = (found[:, i] for i in range(8))
        words, characters = np.maximum(n_words, 1), np.maximum(chars, 1)

        def share(part, whole):
            return np.log1p(100.0 * part / whole)

        vector = {
            "symbols": share(symbols, characters),
            "dup_lines": share(dup, np.maximum(lines, 1)),
            "repeats": share(repeat, words),
            "word_length": np.log(characters / words),
            "upper": share(upper, words),
            "marks": share(marks, characters),
        }
        columns = [batch.column(c) for c in ("doc_id", "lang", "source")]
        columns += [pa.array(x) for x in (n_words, chars, symbols, dup, repeat)]
        yield pa.RecordBatch.from_arrays(
            columns + [pa.array(vector[c]) for c in VECTOR], ["doc_id", "lang", "source", *BASE, *VECTOR]
        )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and the statistics of every text."""
    schema = "doc_id long, lang string, source string, "
    schema += ", ".join([f"{c} long" for c in BASE] + [f"{c} double" for c in VECTOR])
    source = docs.select(
        F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").alias("_text")
    )
    return source.mapInArrow(_count_batches, schema)


def _chi_square_above(x: float, half: int) -> float:
    """Tail of chi-square with 2 * half degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))


def _chi_square_cut(tail: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square_above(middle, half) > tail else (low, middle)
    return high


HALF = len(VECTOR) // 2
CUT = _chi_square_cut(TAIL, HALF)
WEIGHT_CUT = _chi_square_cut(WEIGHT_TAIL, HALF)


def _consistency(share: float) -> float:
    """A covariance of the innermost share of a normal distribution is too small by this factor."""
    return share / (1 - _chi_square_above(_chi_square_cut(1 - share, HALF), HALF + 1))


CONSISTENCY, WEIGHT_CONSISTENCY = _consistency(KEPT_SHARE), _consistency(1 - WEIGHT_TAIL)

GROUP = ("_lang", "_source")
# Stands for the group of all rows. Groups (some 400 bytes each) up to which their parameters are broadcast; tasks that solve.
_ALL = "\1"
MOST_BROADCAST, _SOLVERS = 10_000, 8
_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
_PARAMETERS = "_lang string, _source string, _start int, center array<double>, inverse array<double>, determinant double"


def _solve(frames: Iterator[pd.DataFrame], consistency: float) -> Iterator[pd.DataFrame]:
    """Center, inverse covariance (with the floors) and log determinant of every group's sums."""
    floors = np.diag([FLOORS[c] ** 2 for c in VECTOR])
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            n = row["n"]
            center = np.array([row[f"s{i}"] for i in range(len(VECTOR))]) / n
            cov = np.zeros((len(VECTOR),) * 2)
            for i, j in _PAIRS:
                cov[i, j] = cov[j, i] = row[f"p{i}_{j}"] / n - center[i] * center[j]
            full = consistency * cov + floors
            out.append((row["_lang"], row["_source"], row["_start"], center.tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.slogdet(full)[1])))
        yield pd.DataFrame(out, columns=["_lang", "_source", "_start", "center", "inverse", "determinant"])


def _distance() -> Column:
    d = [F.col(c) - F.col("center")[i] for i, c in enumerate(VECTOR)]
    terms = [d[i] * d[j] * F.col("inverse")[i * len(VECTOR) + j] * (1 if i == j else 2) for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _with(rows: DataFrame, parameters: DataFrame, groups: int) -> DataFrame:
    """Rows beside the parameters of their group. Up to MOST_BROADCAST counted groups are sent to all tasks, so that a
    group with a third of all rows stays where it is; more of them meet in a join that Spark can split."""
    return rows.join(F.broadcast(parameters) if groups <= MOST_BROADCAST else parameters, list(GROUP))


def _fit(rows: DataFrame, consistency: float) -> DataFrame:
    """Parameters per group and start from the given rows: sums per group, combined before they are shuffled."""
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(VECTOR)]
    sums += [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}_{j}") for i, j in _PAIRS]
    per_group = rows.groupBy(*GROUP, "_start").agg(F.count(F.lit(1)).alias("n"), *sums)
    return per_group.coalesce(_SOLVERS).mapInPandas(lambda frames: _solve(frames, consistency), _PARAMETERS)


def _starts(rows: DataFrame) -> DataFrame:
    """Parameters to start from, four per group: the medians with the floors as scale, and the medians, the lower and
    the upper quartiles with the scale that the quartiles show."""
    quartiles = rows.groupBy(*GROUP).agg(*(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(c) for c in VECTOR))

    def diagonal(variances: list[Column]) -> Column:
        return F.array(*(1 / v if i == j else F.lit(0.0) for i, v in enumerate(variances) for j in range(len(VECTOR))))

    floors = [F.lit(FLOORS[c] ** 2) for c in VECTOR]
    # the quartiles of a normal distribution lie 1.349 standard deviations apart
    spread = [f + F.pow((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(2.0)) for c, f in zip(VECTOR, floors)]
    starts = [
        F.struct(F.lit(n).alias("_start"), F.array(*(F.col(c)[at] for c in VECTOR)).alias("center"), diagonal(scale).alias("inverse"), F.lit(0.0).alias("determinant"))
        for n, (at, scale) in enumerate([(1, floors), (1, spread), (0, spread), (2, spread)])
    ]
    return quartiles.select(*GROUP, F.inline(F.array(*starts)))


def minimum_covariance(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Center and inverse covariance per group by concentration steps over all rows.

    All starts go together. A step keeps, in each group and for each start, the KEPT_SHARE of rows that are nearest, and
    fits them anew, which never raises the determinant. The fit with the smallest one wins: up to nearly half of a group
    may be outliers. The rows within its WEIGHT_CUT, most of the others, are then fitted once more.
    """
    now = written(_starts(rows), "covariance-start")
    groups = now.count()
    by_start = [*GROUP, "_start"]
    fits = []
    for _ in range(steps):
        distances = _with(rows, now, groups).select(*by_start, _distance().alias("_d"))
        limits = distances.groupBy(*by_start).agg(F.percentile_approx("_d", KEPT_SHARE, 1000).alias("_limit"))
        limited = written(now.join(limits, by_start), "covariance-limits")
        now = written(_fit(_with(rows, limited, groups).filter(_distance() <= F.col("_limit")), CONSISTENCY), "covariance")
        fits.append(now)
    # A handful of rows per group: the fits of all steps and starts, of which one stays.
    best = F.min_by(F.struct("_start", "center", "inverse"), F.struct("determinant", "_start")).alias("_b")
    raw = written(reduce(DataFrame.unionByName, fits).groupBy(*GROUP).agg(best).select(*GROUP, "_b.*"), "covariance-raw")
    weighted = _fit(_with(rows, raw, groups).filter(_distance() <= WEIGHT_CUT), WEIGHT_CONSISTENCY)
    return written(weighted.select(*GROUP, "center", "inverse"), "covariance-best")


def quality_verdicts(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and distance (squared Mahalanobis) of every row of `docs`.

    Needs doc_id, text, lang and source. Null texts have no words, so they fail the base rules. Null languages and
    sources are groups of their own. The fit uses the rows that pass the base rules. Groups with fewer than LEAST_GROUP such rows are judged by the fit over
    all of them. Repeated rows are each judged; an empty table gives an empty result.
    """
    rows = written(
        statistics(docs).withColumns(
            {
                "base_failed": (F.col("n_words") < LEAST_WORDS)
                | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
                "_lang": F.coalesce("lang", F.lit("\0")),
                "_source": F.coalesce("source", F.lit("\0")),
            }
        ),
        "quality-statistics",
    )
    passed = rows.filter("NOT base_failed").select(*GROUP, *VECTOR)
    sizes = passed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.filter(F.col("_n") >= LEAST_GROUP).select(*GROUP), "quality-groups")
    everything = passed.withColumns({c: F.lit(_ALL) for c in GROUP})
    fitted = minimum_covariance(_with(passed, large, large.count()).unionByName(everything), steps)
    own, pooled = fitted.filter(F.col("_lang") != _ALL), fitted.filter(F.col("_lang") == _ALL).first()
    found = rows.join(F.broadcast(own) if own.count() <= MOST_BROADCAST else own, list(GROUP), "left")
    if pooled is not None:
        for name in ("center", "inverse"):
            found = found.withColumn(name, F.coalesce(name, F.array(*(F.lit(x) for x in pooled[name]))))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return found.withColumn("distance", _distance()).select("doc_id", *BASE, "base_failed", kept.alias("kept"), "distance")
