"""Country names of a map and the counts matched to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions.text import country_key, strip_blanks
from trendlens.operators._common import zero_if_null

_GEOMETRIES = ("objects", "countries", "geometries")


def _field(t: T.DataType, name: str) -> T.DataType | None:
    if isinstance(t, T.StructType) and name in t.fieldNames():
        return t[name].dataType
    return None


def country_names(atlas: DataFrame) -> DataFrame:
    """``name``: distinct country names of map documents, ascending.

    Each row of ``atlas`` is one document shaped
    ``{objects: {countries: {geometries: [{properties: {name}}]}}}``. Absent
    keys are tolerated (no names), geometries without a name and empty names
    are skipped, and names are stripped of surrounding whitespace (after the
    emptiness test, so an all-blank name becomes '').
    """
    t: T.DataType | None = atlas.schema
    for key in _GEOMETRIES:
        t = _field(t, key)
    props = _field(t.elementType, "properties") if isinstance(t, T.ArrayType) else None
    if _field(props, "name") is None:
        return atlas.sparkSession.createDataFrame([], "name string")
    geo = atlas.select(F.explode(F.col(".".join(_GEOMETRIES))).alias("g"))
    name = F.col("g.properties.name").cast("string")
    stripped = strip_blanks(name)
    return (geo.where(name.isNotNull() & (name != "")).select(stripped.alias("name"))
            .distinct().orderBy("name"))


def map_counts(names: DataFrame, counts: DataFrame, *, name: str = "name", country: str = "country",
               count: str = "cnt") -> DataFrame:
    """``name, key, cnt``: each map name with the count of the data countries
    sharing its key (``country_key``), 0 where none does.

    Two data countries with one key are summed (a map shows one value per
    shape). Both sides hold one row per country, so the join is between two
    small aggregates; Spark broadcasts whichever is under the size threshold
    it measures, and falls back to a shuffle join otherwise.
    """
    keyed = (counts.select(country_key(F.col(country)).alias("key"), F.col(count).alias("_cnt"))
             .where(F.col("key").isNotNull() & (F.col("key") != ""))
             .groupBy("key").agg(F.sum("_cnt").alias("_cnt")))
    shapes = names.select(F.col(name).alias("name"), country_key(F.col(name)).alias("key"))
    return (shapes.join(keyed, "key", "left")
            .select("name", "key", zero_if_null(F.col("_cnt")).alias("cnt")))
