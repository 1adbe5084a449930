"""Which columns relate to a class label: one-way ANOVA and chi-square tests of independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.functions.tails import (
    chi_square_tail_any,
    chi_square_tail_even,
    f_tail_any,
    f_tail_three_groups,
)
from tallyworth.session import materialise

SIGNIFICANCE_LEVEL = 0.05


def _must_be(test: Column, value: Column, message: str) -> Column:
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)))


def anova_tests(df: DataFrame, label: str, columns: Sequence[str], classes: int | None = None) -> DataFrame:
    """F test of equal class means for each column, all columns in one pass over the data.

    What leaves the scan tasks is one row per class. With `classes=3` the probability has a closed form;
    else a continued fraction is evaluated on the result rows. Nulls are left out per column, `used_rows`
    tells how many rows remain. A constant column has no statistic and no probability; equal values within
    every class but not between them give probability 0.
    """
    numbers = {c: F.col(c).cast("double") for c in columns}
    moments = (
        df.filter(F.col(label).isNotNull())
        .groupBy(label)
        .agg(
            *(
                F.struct(
                    F.lit(c).alias("variable"),
                    F.count(x).alias("n"),
                    F.avg(x).alias("mean"),
                    F.var_pop(x).alias("variance"),
                    F.min(x).alias("low"),
                    F.max(x).alias("high"),
                ).alias(f"s{i}")
                for i, (c, x) in enumerate(numbers.items())
            )
        )
    )
    per_class = moments.select(F.inline(F.array(*(f"s{i}" for i in range(len(columns)))))).filter(F.col("n") > 0)
    # Merged partial means leave a trace of variance even where all values are equal.
    exact = F.when(F.col("low") < F.col("high"), F.col("variance")).otherwise(0.0)
    per_class = per_class.withColumn("variance", exact)
    # One row per class and column from here on.
    same = Window.partitionBy("variable")
    n, mean = F.col("n"), F.col("mean")
    grand = F.sum(n * mean).over(same) / F.sum(n).over(same)
    sums = (
        per_class.withColumn("grand", grand)
        .groupBy("variable")
        .agg(
            F.sum("n").alias("used_rows"),
            F.count(F.lit(1)).alias("groups"),
            F.sum(n * (mean - F.col("grand")) * (mean - F.col("grand"))).alias("between"),
            F.sum(n * F.col("variance")).alias("within"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .withColumns({"df_between": F.col("groups") - 1, "df_within": F.col("used_rows") - F.col("groups")})
    )
    tested = (F.col("df_between") > 0) & (F.col("df_within") > 0) & (F.col("low") < F.col("high"))
    between = F.try_divide(F.col("between"), F.col("df_between"))
    statistic = F.when(tested & (F.col("within") > 0), F.try_divide(between, F.try_divide(F.col("within"), F.col("df_within"))))
    with_f = sums.withColumn("statistic", statistic)
    if classes == 3:
        three = _must_be(F.col("df_between") == 2, F.lit(True), "classes=3 was given for another number of classes")
        tail = F.when(three, f_tail_three_groups(F.col("statistic"), F.col("df_within")))
    else:
        tail = f_tail_any("statistic", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    all_between = tested & (F.col("within") <= 0)
    p = F.when(F.col("statistic").isNotNull(), tail).when(all_between, F.lit(0.0))
    return with_f.select(
        "variable", F.lit("ANOVA").alias("test_used"), "statistic", p.alias("p_value"), "used_rows", "df_between", "df_within"
    )


def chi_square_tests(df: DataFrame, label: str, columns: Sequence[str], classes: int | None = None) -> DataFrame:
    """Chi-square test of independence of each column from the label, all columns in one pass.

    The contingency tables are counted together in long form; from then on only their cells are touched.
    With one degree of freedom the continuity correction applies. With `classes=3` the degrees of freedom
    are even and the probability has a closed form.
    """
    rows = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns))
    cells = materialise(
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).cast("string").alias("label"), F.inline(rows))
        .filter(F.col("value").isNotNull())
        .groupBy("variable", "value", "label")
        .agg(F.count(F.lit(1)).alias("n")),
        "contingency-cells",
    )
    by_value = cells.groupBy("variable", "value").agg(F.sum("n").alias("value_rows"))
    by_label = cells.groupBy("variable", "label").agg(F.sum("n").alias("label_rows"))
    n = F.col("n").cast("double")
    share = F.sum(n * n / F.col("value_rows") / F.col("label_rows")).alias("share")
    values = by_value.groupBy("variable").agg(
        F.count(F.lit(1)).alias("values"), F.sum("value_rows").alias("used_rows"), F.sum(1.0 / F.col("value_rows")).alias("per_value")
    )
    labels = by_label.groupBy("variable").agg(
        F.count(F.lit(1)).alias("labels"), F.sum(1.0 / F.col("label_rows")).alias("per_label")
    )
    sums = (
        cells.join(by_value, ["variable", "value"])
        .join(by_label, ["variable", "label"])
        .groupBy("variable")
        .agg(share)
        .join(values, "variable")
        .join(labels, "variable")
        .withColumn("df", (F.col("values") - 1) * (F.col("labels") - 1))
    )
    plain = F.greatest(F.col("used_rows") * (F.col("share") - 1.0), F.lit(0.0))
    # In a 2 x 2 table every cell is off by the same distance; the correction takes up to one half from it.
    inverse = F.col("used_rows") * F.col("per_value") * F.col("per_label")
    distance = F.sqrt(plain / inverse)
    corrected = F.pow(F.greatest(distance - 0.5, F.lit(0.0)), 2) * inverse
    statistic = F.when(F.col("df") == 0, F.lit(0.0)).when(F.col("df") == 1, corrected).otherwise(plain)
    with_x = sums.withColumn("statistic", statistic)
    x, freedom = F.col("statistic"), F.col("df")
    if classes == 3:
        even = _must_be(freedom % 2 == 0, F.lit(True), "classes=3 was given for another number of classes")
        tail = F.when(even, chi_square_tail_even(x, freedom))
    else:
        tail = chi_square_tail_any(x, freedom.cast("double"))
    p = F.when(freedom == 0, F.lit(1.0)).otherwise(tail)
    return with_x.select(
        "variable", F.lit("Chi-Square").alias("test_used"), "statistic", p.alias("p_value"), "used_rows", freedom.alias("df")
    )


def feature_tests(
    df: DataFrame,
    label: str,
    continuous: Sequence[str],
    categorical: Sequence[str],
    classes: int | None = None,
    level: float = SIGNIFICANCE_LEVEL,
) -> DataFrame:
    """Both kinds of test in one table, smallest probability first; without one a column is not significant."""
    columns = ("variable", "test_used", "p_value")
    both = anova_tests(df, label, continuous, classes).select(*columns).unionByName(
        chi_square_tests(df, label, categorical, classes).select(*columns)
    )
    significant = F.coalesce(F.col("p_value") < level, F.lit(False))
    return both.withColumn(
        "significance", F.when(significant, "Significant").otherwise("Not Significant")
    ).orderBy(F.col("p_value").asc_nulls_last(), "variable")


def select_features(
    df: DataFrame, tests: DataFrame, label: str, always: Sequence[str] = (), key: str = "user"
) -> DataFrame:
    """Key, label, the significant columns in order of their probability, and `always`, each once.

    The only rows that reach the driver are the test results, one per column.
    """
    ordered = tests.filter(F.col("significance") == "Significant").orderBy("p_value", "variable")
    names = [r["variable"] for r in ordered.select("variable").collect()]
    return df.select(*dict.fromkeys([key, label, *names, *always]))
