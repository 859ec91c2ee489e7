"""Column types from all cells of text columns.

One aggregate over the rows: every cell gives a mask of the types whose text
form it has, and the masks of a column are joined by AND, so what remains are the
types that hold all cells. Partial masks are one integer per column and task.

Of these the narrowest is taken: BOOLEAN, BIGINT, DOUBLE (any number), DATE,
TIMESTAMP (any day, with or without a clock). Clock and other text stays text, and so
does a column without a cell. NULL cells fit every type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Narrowest first; a cell of one may also be one of the next.
_TYPES = ("boolean", "bigint", "double", "date", "timestamp")
_NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_DAY = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
_CLOCK = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?$"


def _bits(*types: str) -> Column:
    return F.lit(sum(1 << _TYPES.index(t) for t in types))


def cell_mask(c: Column) -> Column:
    """The types that hold this cell, as bits; NULL for a NULL cell.

    No text is a number and a day, or one of them and a truth value, so the first form that fits decides. Only what
    looks like an integer is cast to one: a cast that fails is slow.
    """
    return (F.when(c.isNull(), F.lit(None).cast("int"))
            .when(c.rlike(_NUMBER), F.when(c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull(), _bits("bigint", "double"))
                  .otherwise(_bits("double")))
            .when(c.rlike(_DAY) & c.try_cast("date").isNotNull(), _bits("date", "timestamp"))
            .when(c.rlike(_CLOCK) & c.try_cast("timestamp").isNotNull(), _bits("timestamp"))
            .when(F.lower(c).isin("true", "false"), _bits("boolean")).otherwise(_bits()))


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def column_masks(df: DataFrame, text: list[str]) -> DataFrame:
    """One row with the mask of each column."""
    # One lambda for all cells of a row: a method that tests each column by itself is too large for the JVM to compile.
    cells = df.select(F.transform(F.array(*map(_named, text)), cell_mask).alias("masks"))
    return cells.agg(*(F.bit_and(F.get("masks", F.lit(i))).alias(f"m{i}") for i in range(len(text))))


def cell_types(df: DataFrame) -> dict[str, str]:
    """The type of every text column that holds all its cells: one row reaches the driver."""
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not text:
        return {}
    masks = column_masks(df, text).first()
    return {c: next((t for i, t in enumerate(_TYPES) if (mask or 0) >> i & 1), "string") for c, mask in zip(text, masks)}


def typed_by_cells(df: DataFrame) -> DataFrame:
    """``df`` with its text columns typed by all their cells."""
    types = cell_types(df)
    return df.select(*(F.trim(_named(c)).cast(types[c]).alias(c) if types.get(c, "string") != "string"
                       else _named(c) for c in df.columns))
