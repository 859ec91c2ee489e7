"""CSV with a header row -> table, and the matching CSV writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.sources.csv_ranges import HeadsTooLarge, split_records
from trendlens.sources.infer import typed_by_cells

# Names of files that are compressed as a whole, so that no task can begin inside one.
WHOLE_FILES = (".gz", ".deflate", ".snappy", ".lz4")


def csv_columns(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of the first file's header, as Spark's reader names them."""
    return _reader(spark, sep, True, encoding).csv(path).columns


def _reader(spark: SparkSession, sep: str, multiline: bool, encoding: str):
    return (spark.read.option("header", True).option("sep", sep).option("multiLine", multiline)
            .option("quote", '"').option("escape", '"').option("encoding", encoding))


def _whole(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether all files are compressed as a whole: only their names are looked at."""
    files = spark.read.text(path).inputFiles()
    return bool(files) and all(f.endswith(WHOLE_FILES) for f in files)


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", infer: bool = False,
             multiline: bool | None = None, encoding: str = "UTF-8", schema=None) -> DataFrame:
    """Read CSV files with a header row.

    By default every column is a string: the cleaning step re-types each
    column anyway. ``infer=True`` types each column by all of its cells (see
    ``sources.infer``). Quoted fields may hold newlines and doubled quotes; a
    quote inside an unquoted field is an ordinary character. Files are read
    in splits, also where records go on over lines (``sources.csv_ranges``).
    ``multiline=True`` has each file parsed by one task, ``False`` takes every
    line as a record; other encodings than UTF-8 are read whole, and so are
    compressed files, which cannot be split. An empty field, quoted or not,
    reads as NULL.
    """
    if infer and schema is None:
        return typed_by_cells(read_csv(spark, path, sep, False, multiline, encoding))
    if multiline is None and encoding.upper() in ("UTF-8", "UTF8") and not _whole(spark, path):
        names = csv_columns(spark, path, sep)
        if schema is not None:
            kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
            if kind.fieldNames() != names:
                raise ValueError(f"the header {names} is not that of the schema {kind.fieldNames()}")
        else:
            kind = T.StructType([T.StructField(n, T.StringType()) for n in names])
        try:
            records, multiline = split_records(spark, path, sep), False
        except HeadsTooLarge:
            records, multiline = None, True
        if records is not None:
            options = {"sep": sep, "quote": '"', "escape": '"'}
            parsed = F.from_csv("record", F.lit(", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"
                                                          for f in kind.fields)), options)
            return records.where(F.col("record") != "").select(parsed.alias("row")).select("row.*")
    reader = _reader(spark, sep, True if multiline is None else multiline, encoding)
    if schema is not None:
        # Check each file's header against the schema instead of applying it
        # by position.
        reader = reader.schema(schema).option("enforceSchema", False)
    return reader.csv(path)


def ingest_csv(spark: SparkSession, path: str | list[str], table: str, replace: bool = False,
               infer: bool = False, sep: str = ",", multiline: bool | None = None, location: str | None = None) -> DataFrame:
    """Load CSV into the catalog table ``table`` and return the table.

    ``replace=True`` rebuilds the table; otherwise an existing table is left
    untouched and returned as is. The rows go to a new Parquet folder below
    ``location`` (by default the shared folder) and the table is then
    created on it or switched to it, so a failed load never leaves a
    half-written table. The tasks that read the CSV write the table; only
    where they are fewer than the cores are its rows shuffled.
    """
    from trendlens.sources.tables import replace_table
    if not replace and spark.catalog.tableExists(table):
        return spark.table(table)
    df = read_csv(spark, path, sep=sep, infer=infer, multiline=multiline)
    few = df.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism
    return replace_table(spark, df, table, root=location, sort_by=() if few else None)


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none", most_rows: int = 0) -> str:
    """Write ``df`` as CSV with a header that ``read_csv`` reads back
    unchanged: text is quoted when needed, quotes doubled, blanks kept,
    NULL written as an empty field and '' as ``""``. A file holds ``most_rows``
    at most, if given: a compressed one is read by one task."""
    (df.write.mode("errorifexists").option("header", True).option("sep", sep).option("quote", '"')
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("compression", compression).option("maxRecordsPerFile", most_rows).csv(path))
    return path
