"""Schema selectors and null-safe numeric helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

TIME_WORDS = ("date", "time", "year", "month")


def quoted(name: str) -> str:
    """Column name safe for `F.col`, whatever blanks or dots it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType))]


def time_typed_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def time_like_columns(df: DataFrame, words: Iterable[str] = TIME_WORDS) -> list[str]:
    """Columns whose name suggests a point in time."""
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "nested"


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN folded to NULL."""
    c = col(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value; a NaN counts as missing."""
    c = col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL instead of an error on a constant side."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)


def adjusted_skew(x: Column) -> Column:
    """Bias-corrected sample skewness, NULL below three values or without spread."""
    n = F.count(x).cast("double")
    return F.when(
        (F.count(x) > 2) & (F.stddev_pop(x) > 0),
        F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2),
    )


def clip(c: Column, low, high) -> Column:
    """Clip to a range; NULL stays NULL although least/greatest skip nulls."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def literal_table(df: DataFrame, rows: list[tuple], fields: dict[str, str]) -> DataFrame:
    """A few known rows as a DataFrame that needs no data transfer. `fields` maps names to SQL types."""
    cells = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields.items())]) for row in rows]
    empty = f"array<struct<{','.join(f'{quoted(n)}:{t}' for n, t in fields.items())}>>"
    table = F.array(*cells) if cells else F.array().cast(empty)
    return df.sparkSession.range(1, numPartitions=1).select(F.inline(table))


def long_table(one_row: DataFrame, names: list[str], fields: dict[str, str], key: str = "column") -> DataFrame:
    """Turn a one-row frame with columns `<field>__<i>` into one row per name.

    `fields` maps each output field to its SQL type.
    """
    rows = []
    for i, name in enumerate(names):
        literal = "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"
        cells = ", ".join(f"cast(`{f}__{i}` as {t})" for f, t in fields.items())
        rows.append(f"{i}, {literal}, {cells}")
    outputs = ", ".join([f"`ordinal`, `{key}`"] + [f"`{f}`" for f in fields])
    return one_row.selectExpr(f"stack({len(names)}, {', '.join(rows)}) as ({outputs})")
