"""Projection of a result to JSON-safe values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NATIVE = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
           T.FloatType, T.DoubleType)


def json_safe(df: DataFrame) -> DataFrame:
    """Keep strings, booleans and native numbers; turn dates into ISO text,
    timestamps into ``yyyy-MM-ddTHH:mm:ss[.SSSSSS]``, decimals and everything
    else into text. NULL stays NULL. Done by the executors, column by column.
    """
    names = df.columns
    # By position first: a query may return two columns of one name, or odd names.
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        t = f.dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            c = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        elif not isinstance(t, _NATIVE):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols).toDF(*names)
