"""Stand-in inputs derived from the driver's tables.

No trending-video data ships with this repo, so the operators run on tables
that Spark derives from the TPC-H-like test tables (see FIXTURES.md):

* ``trending`` -- the clean table: one row per lineitem; video = part,
  channel country = supplier nation, trending country = customer nation,
  trending day = order day, with case/blank variants and messy tags;
* ``raw_snapshots`` -- raw text columns (numbers, timestamps, French dates,
  durations) for the parsers;
* ``raw_trending`` -- the same text arranged as the 25-column raw export;
* ``documents`` text as tag strings; and map documents built from
  region x nation.

Each Spark builder has a SQL twin (DuckDB dialect) used by the oracle; the
twins are checked equal on the test data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spark_refs(sf_dir: str) -> dict[str, str]:
    """Table references for the shared SQL templates, Spark side."""
    return {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in TABLES}


DUCKDB_REFS = {t: t for t in TABLES}


# --------------------------------------------------------------------------
# the clean table
# --------------------------------------------------------------------------

def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean-table stand-in, as a lazy join of the base tables."""
    return trending_columns(trending_facts(spark, sf_dir))


def trending_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of the clean table are made from, with its day and video.

    Texts made of other columns are left to ``trending_columns``, so that a
    shuffle of these rows (each join, the layout of the table) carries
    neither them nor the fractions that the table does not keep.

    Join order is dimension-first: customer and supplier meet their nation
    (25 rows) before touching the facts, and orders meets customer before
    lineitem does, so the wide fact table is joined on orderkey, suppkey and
    partkey only. No broadcast is forced: Spark broadcasts a side whose
    measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
    re-plans from real shuffle sizes); beyond that it shuffles.
    """
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation").select("n_nationkey", "n_name")
    cust = (t("customer").select("c_custkey", "c_nationkey")
            .join(nation.withColumnRenamed("n_nationkey", "c_nationkey").withColumnRenamed("n_name", "cn_name"),
                  "c_nationkey")
            .select("c_custkey", "cn_name"))
    orders = (t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("video_trending_date"))
              .join(cust, F.col("o_custkey") == F.col("c_custkey"))
              .select("o_orderkey", "video_trending_date", "cn_name"))
    supp = (t("supplier").select("s_suppkey", "s_nationkey")
            .join(nation.withColumnRenamed("n_nationkey", "s_nationkey").withColumnRenamed("n_name", "sn_name"),
                  "s_nationkey")
            .select("s_suppkey", "sn_name"))
    part = t("part").select("p_partkey", "p_name", "p_type", "p_brand")
    li = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                              F.floor("l_quantity").cast("bigint").alias("quantity"),
                              F.floor("l_extendedprice").cast("bigint").alias("price"))
    rows = (li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(supp, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey")))
    return rows.select(F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("video_id"), "video_trending_date",
                       "l_suppkey", "l_linenumber", "quantity", "price", "cn_name", "sn_name", "p_name", "p_type", "p_brand")


def trending_columns(facts: DataFrame) -> DataFrame:
    """The clean table's columns from the rows of ``trending_facts``, in their order."""
    sn, line, supk = F.col("sn_name"), F.col("l_linenumber"), F.col("l_suppkey")
    return facts.select(
        "video_id",
        F.col("p_name").alias("video_title"),
        F.concat(F.lit("Ch"), supk.cast("string")).alias("channel_title"),
        F.when(line == 7, F.concat(F.lit(" "), F.lower(sn), F.lit(" "))).otherwise(sn).alias("channel_country"),
        F.when(supk % 50 == 0, F.lit(None).cast("string")).when(supk % 51 == 0, F.lit(" "))
        .otherwise(F.col("cn_name")).alias("video_trending_country"),
        "video_trending_date",
        F.col("price").alias("video_view_count"),
        (F.col("quantity") * 100).alias("video_like_count"),
        (line.cast("bigint") * 7).alias("video_comment_count"),
        F.concat(F.lit(" "), F.replace(F.col("p_name"), F.lit(" "), F.lit(",")), F.lit(", "), F.col("p_type"),
                 F.lit(",,x,"), F.col("p_brand"), F.lit(",why?,"), F.substring("p_name", 1, 3)).alias("video_tags"),
    )


TRENDING_SQL = """
select concat('V', cast(l_partkey as string))  as video_id,
       p_name                                   as video_title,
       concat('Ch', cast(l_suppkey as string)) as channel_title,
       case when l_linenumber = 7 then concat(' ', lower(sn.n_name), ' ')
            else sn.n_name end                  as channel_country,
       case when l_suppkey % 50 = 0 then null
            when l_suppkey % 51 = 0 then ' '
            else cn.n_name end                  as video_trending_country,
       cast(o_orderdate as date)                as video_trending_date,
       cast(floor(l_extendedprice) as bigint)   as video_view_count,
       cast(floor(l_quantity) as bigint) * 100  as video_like_count,
       cast(l_linenumber as bigint) * 7         as video_comment_count,
       concat(' ', replace(p_name, ' ', ','), ', ', p_type, ',,x,', p_brand,
              ',why?,', substr(p_name, 1, 3))   as video_tags
from lineitem
join orders   on l_orderkey = o_orderkey
join customer on o_custkey  = c_custkey
join nation cn on c_nationkey = cn.n_nationkey
join supplier on l_suppkey  = s_suppkey
join nation sn on s_nationkey = sn.n_nationkey
join part     on l_partkey  = p_partkey
"""


# --------------------------------------------------------------------------
# raw text columns; and the 25-column raw export built from them
# --------------------------------------------------------------------------

RAW_SQL = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case l_linenumber % 4
    when 0 then cast(cast(floor(l_extendedprice) as bigint) as string)
    when 1 then concat(cast(cast(floor(l_extendedprice) as bigint) as string), '.5')
    when 2 then concat(' ', cast(l_partkey as string), ' ')
    else 'n/a' end                                              as view_raw,
  case l_linenumber % 4
    when 0 then concat(cast(day(o_orderdate) as string), '/',
                       cast(month(o_orderdate) as string), '/',
                       cast(year(o_orderdate) as string), ' 7:05')
    when 1 then concat(cast(cast(o_orderdate as date) as string),
                       case when l_partkey % 3 = 0 then '   ' else ' ' end, '01:02:03')
    when 2 then cast(cast(o_orderdate as date) as string)
    else 'bad' end                                              as pub_raw,
  case when l_linenumber = 3 then cast(cast(o_orderdate as date) as string)
    when l_linenumber = 7 and l_partkey % 50 = 0
      then concat('Lundi 31 février ', cast(year(o_orderdate) as string))
    when l_linenumber = 6
      then concat('Mardi ', cast(day(o_orderdate) as string),
                  case month(o_orderdate) when 2 then ' fevrier ' when 8 then ' aout '
                    when 12 then ' decembre ' else ' Mai ' end, cast(year(o_orderdate) as string))
    when l_linenumber = 5
      then concat('JEUDI ', cast(day(o_orderdate) as string),
                  case month(o_orderdate) when 2 then ' FÉVRIER ' when 8 then ' AOÛT '
                    when 12 then ' DÉCEMBRE ' else ' Juillet ' end, cast(year(o_orderdate) as string), ' ')
    else concat('Lundi ', cast(day(o_orderdate) as string), ' ',
                case month(o_orderdate)
                  when 1 then 'janvier' when 2 then 'février' when 3 then 'mars'
                  when 4 then 'avril' when 5 then 'mai' when 6 then 'juin'
                  when 7 then 'juillet' when 8 then 'août' when 9 then 'septembre'
                  when 10 then 'octobre' when 11 then 'novembre' when 12 then 'décembre' end, ' ',
                cast(year(o_orderdate) as string)) end         as trend_raw,
  case l_linenumber % 5
    when 0 then concat('PT', cast(l_partkey % 3 + 1 as string), 'H',
                       cast(l_partkey % 60 as string), 'M',
                       cast(l_suppkey % 60 as string), 'S')
    when 1 then concat('PT', cast(l_suppkey % 60 as string), 'S')
    when 2 then concat(cast(l_partkey % 24 as string), ':',
                       lpad(cast(l_suppkey % 60 as string), 2, '0'), ':05')
    when 3 then case when l_partkey % 40 = 0 then 'PT9223372036854775807H' else 'none' end
    else concat('PT', cast(l_partkey % 60 as string), 'M') end  as dur_raw
from {lineitem} join {orders} on l_orderkey = o_orderkey
"""

# The 25 text columns of a raw export, every one a string, with dirty
# variants of each kind (blank, junk, decimals, exponents, padded text).
RAW_TRENDING_SQL = """
select
  concat('V', cast(l_partkey as string))                         as video_id,
  concat('UC', cast(l_suppkey as string))                        as channel_id,
  concat('Ch', cast(l_suppkey as string))                        as channel_title,
  concat('Video ', cast(l_partkey as string))                    as video_title,
  case when l_linenumber = 2 then null else 'desc' end            as video_description,
  ''                                                              as channel_description,
  concat('thumb/', cast(l_partkey as string), '.jpg')            as video_default_thumbnail,
  concat(' Tag', cast(l_partkey % 7 as string), ',t', cast(l_linenumber as string),
         ', x ,why?,,  Musique  ')                                as video_tags,
  '2d'                                                            as video_dimension,
  case when l_linenumber % 2 = 0 then 'hd' else 'sd' end          as video_definition,
  concat('NATION_', cast(l_orderkey % 25 as string))             as video_trending_country,
  concat('NATION_', cast(l_suppkey % 25 as string))              as channel_country,
  cast(l_linenumber + 20 as string)                              as video_category_id,
  case l_linenumber % 4 when 0 then 'true' when 1 then '0' when 2 then case when l_partkey % 2 = 0 then ' yes' else 'yes' end
       else 'maybe' end                                           as video_licensed_content,
  view_raw                                                        as video_view_count,
  case l_linenumber % 3 when 0 then concat(cast(l_partkey % 90 as string), 'e1')
       when 1 then ' 12.7 ' else '-2.5' end                       as video_like_count,
  cast(l_linenumber * 3 as string)                               as video_comment_count,
  concat(cast(l_orderkey % 100000 as string), '.25')             as channel_view_count,
  case when l_linenumber = 1 then '' else cast(l_orderkey % 1000 as string) end
                                                                  as channel_subscriber_count,
  case when l_linenumber = 5 then '1,234' else cast(l_linenumber as string) end
                                                                  as channel_video_count,
  pub_raw                                                         as video_published_at,
  concat(' ', pub_raw, ' ')                                       as channel_published_at,
  trend_raw                                                       as video_trending__date,
  dur_raw                                                         as video_duration
from ({raw}) raw
"""


def raw_sql(refs: dict[str, str]) -> str:
    return RAW_SQL.format(**refs)


def raw_trending_sql(refs: dict[str, str]) -> str:
    return RAW_TRENDING_SQL.format(raw=raw_sql(refs))


# Lines of a CSV export whose quoted fields hold separators, quotes and line
# feeds, and whose unquoted fields hold quotes; and the values they stand for.
QUOTED_LINES_SQL = """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), ',"Part ', cast(l_partkey as string),
              ', called ""P', cast(l_partkey % 9 as string), '""', repeat(decode(unhex('0A'), 'UTF-8'), l_linenumber % 3),
              '",', cast(l_suppkey % 40 as string), '" screen,',
              case l_linenumber % 4 when 0 then '' when 1 then '""' when 2 then '"x,y"' else 'say "so"' end, ',',
              cast(l_linenumber as string)) as value
from {lineitem}
"""

QUOTED_VALUES_SQL = """
select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string)) as id,
       concat('Part ', cast(l_partkey as string), ', called "P', cast(l_partkey % 9 as string), '"',
              repeat(chr(10), cast(l_linenumber % 3 as bigint))) as note,
       concat(cast(l_suppkey % 40 as string), '" screen') as size,
       case l_linenumber % 4 when 2 then 'x,y' when 3 then 'say "so"' end as remark,
       cast(l_linenumber as string) as line
from lineitem
"""


def quoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per record of the quoted export."""
    return spark.sql(QUOTED_LINES_SQL.format(**spark_refs(sf_dir)))


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys plus the four raw text columns (view, published, trending day,
    duration). Planned by Spark SQL from the shared template."""
    return spark.sql(raw_sql(spark_refs(sf_dir)))


def raw_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25-column raw export (all strings) built on F2.

    With a lambda (here around one column, which stays as it is) Spark compiles the projection in small methods;
    without one it makes a method too large for the JVM to compile."""
    raw = spark.sql(raw_trending_sql(spark_refs(sf_dir)))
    return raw.withColumn("video_id", F.get(F.transform(F.array("video_id"), lambda c: c), F.lit(0)))


# Country names as data and as a map may spell them, by nation: blanks, case,
# accents, other names.
_DATA_NAMES = (" USA ", "Ivory Coast", "RUSSIA", "UK", "Great Britain", "united states", "South Korea", "North Korea",
               "Czech Republic", "Congo-Kinshasa", "Congo-Brazzaville", "Swaziland", "Cape Verde", "Laos", "Burma",
               "Myanmar", "BRÉSIL", "Türkiye", "  ", "España", "Nowhere", "São Tomé", "Perú", "Österreich", "México")
_MAP_NAMES = ("United States of America", "Côte d'Ivoire", "Russian Federation", "United Kingdom", "Wales", "USA",
              "Korea, Republic of", "Korea, Democratic People's Republic of", "Czechia",
              "Democratic Republic of the Congo", "Republic of the Congo", "eSwatini", "Cabo Verde", "Lao PDR", "MYANMAR",
              "Chad", "Bresil", "Turkiye", "Blank", "ESPANA", "Mali", "Sao Tome", "peru", "Osterreich", "Mexico")


def _name_sql(names: tuple[str, ...], key: str) -> str:
    """One of ``names`` by ``key``; both engines: an apostrophe is put in by chr(39)."""
    texts = ["concat('" + n.replace("'", "', chr(39), '") + "')" for n in names]
    cases = " ".join(f"when {i} then {t}" for i, t in enumerate(texts))
    return f"case {key} % {len(names)} {cases} end"


def data_countries_sql(refs: dict[str, str]) -> str:
    """Customers by country, as data may spell it."""
    return f"select {_name_sql(_DATA_NAMES, 'c_custkey')} as country, count(*) as cnt from {refs['customer']} group by 1"


def map_countries_sql(refs: dict[str, str]) -> str:
    """Countries of suppliers, as a map may spell them."""
    return f"select distinct {_name_sql(_MAP_NAMES, 's_suppkey')} as name from {refs['supplier']}"


# --------------------------------------------------------------------------
# map documents
# --------------------------------------------------------------------------

def atlas_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One map document per region, shaped like a TopoJSON file:
    ``objects.countries.geometries[].properties.name`` = its nations' names.

    The list per region is bounded by the nation table (a fixed dimension),
    so ``collect_list`` here gathers a bounded group.
    """
    region = table(spark, sf_dir, "region").select("r_regionkey")
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    geoms = (region.join(nation, F.col("r_regionkey") == F.col("n_regionkey"))
             .groupBy("r_regionkey")
             .agg(F.collect_list(F.struct(F.struct(F.col("n_name").alias("name")).alias("properties")))
                  .alias("geometries")))
    return geoms.select(F.struct(F.struct("geometries").alias("countries")).alias("objects"))
