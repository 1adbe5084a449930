"""CSV files without declared types: the types that their values have, and the lines that do not fit the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.schema import Field

BROKEN = "_broken"
# Types from the narrowest on, each with the form that a value must have beside the cast. A time of day alone is text, and so
# is a number with leading zeros: a cast would give today's time, and lose the zeros.
LATTICE = (
    ("int", r"^-?(0|[1-9][0-9]*)$"),
    ("bigint", r"^-?(0|[1-9][0-9]*)$"),
    ("double", r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"),
    ("boolean", r"^(?i:true|false)$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"),
)


def read_texts(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All lines of CSV files with one header, each column as text, and the whole line as `_broken` where it has more or fewer
    fields than the header. A file with another header stops the job."""
    options = {"header": "true", "delimiter": delimiter}
    names = spark.read.options(**options).csv(path).columns
    kinds = ", ".join(f"`{name}` string" for name in [*names, BROKEN])
    strict = {**options, "enforceSchema": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "columnPruning": "false"}
    return spark.read.options(**strict).schema(kinds).csv(path)


def _is_broken(texts: DataFrame) -> Column:
    """Whether a line is broken, asked in a way that reads another column too: Spark refuses plans that read this one alone."""
    other = F.length(F.coalesce(F.col(f"`{texts.columns[0]}`"), F.lit("")))
    return F.coalesce(F.length(BROKEN), -1 - other) >= 0


def whole_lines(texts: DataFrame) -> DataFrame:
    return texts.where(~_is_broken(texts)).drop(BROKEN)


def broken_lines(texts: DataFrame) -> DataFrame:
    """line and how often it stands in the files."""
    return texts.where(_is_broken(texts)).groupBy(F.col(BROKEN).alias("line")).agg(F.count("*").alias("times"))


def _fits(value: Column, kind: str, form: str) -> Column:
    return value.rlike(form) & value.try_cast(kind).isNotNull()


def inferred(texts: DataFrame) -> list[Field]:
    """The narrowest type that all values of each column have, from one aggregation over the whole lines.

    Nulls and empty fields fit every type; a column without any other value is text, and so is one whose values share no type.
    """
    rows = whole_lines(texts)
    counts = [F.count(F.col(f"`{name}`")).alias(f"n{i}") for i, name in enumerate(rows.columns)]
    for i, name in enumerate(rows.columns):
        counts += [F.count_if(_fits(F.col(f"`{name}`"), kind, form)).alias(f"n{i}_{kind}") for kind, form in LATTICE]
    if not rows.columns:
        return []
    found = rows.agg(*counts).first()

    def narrowest(i: int) -> str:
        values = found[f"n{i}"] or 0
        return next((kind for kind, _ in LATTICE if values and found[f"n{i}_{kind}"] == values), "string")

    return [Field(name, name, narrowest(i)) for i, name in enumerate(rows.columns)]


def typed(texts: DataFrame, fields: list[Field]) -> DataFrame:
    """The whole lines with the types of `fields`."""
    return whole_lines(texts).select(*(F.col(f"`{f.published}`").try_cast(f.type).alias(f.name) for f in fields))
