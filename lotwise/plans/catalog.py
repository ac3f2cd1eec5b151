"""Registry of the queries, and the roles the test tables play in them.

A query is a function of `Tables`; most have an SQL text with the same result.
Floating-point results are cut to a fixed grid on both sides, because sums of
doubles differ in their last bits between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lotwise.scale import share_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The year from which ages are counted in the queries.
NOW = 2003


class Tables:
    """The given tables of one scale, and the listing view over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        share_package(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def listings(self) -> DataFrame:
        """Line items with their part, in the roles of vehicle listings."""
        rows = self("lineitem").join(self("part"), F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("url"),
            F.col("l_linestatus").alias("snapshot"),
            F.col("l_shipdate").cast("date").alias("index_date"),
            F.col("p_brand").alias("brand"), F.col("p_type").alias("model"), F.col("p_name").alias("variant"),
            F.year("l_shipdate").alias("year"),
            F.col("l_extendedprice").alias("price"),
            (F.col("l_quantity") * 4000).alias("km"),
            (F.col("p_size") * 10.0).alias("horsepower"),
            F.when(F.col("l_returnflag") == "A", "Diesel").when(F.col("l_returnflag") == "N", "Essence")
            .otherwise("Hybride essence").alias("energie"),
            F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"),
            F.col("l_suppkey").alias("seller"),
        )

    @property
    def aged(self) -> DataFrame:
        return self.listings.withColumn("car_age", F.lit(NOW) - F.col("year"))

    @property
    def market(self) -> DataFrame:
        return self.listings.where("flag = 'N'")

    @property
    def second_market(self) -> DataFrame:
        return self.listings.where("flag = 'A'")

    @property
    def declared(self) -> DataFrame:
        """Declared values: prices of the third flag, below or above market by a rule on their data."""
        factor = F.lit(1.15) - F.col("discount") * 6
        return self.listings.where("flag = 'R'").withColumn("declared_price", F.col("price") * factor)

    @property
    def raw_listings(self) -> DataFrame:
        """The listing view as a scraper would deliver it: text only."""
        return self.listings.select(
            "url", F.col("index_date").cast("string").alias("index_date"),
            F.col("index_date").cast("string").alias("first_publication_date"),
            F.concat(F.col("price").cast("string"), F.lit(" €")).alias("price"),
            F.col("brand").alias("marque"), F.col("model").alias("modele"),
            F.col("year").cast("string").alias("annee_modele"),
            F.concat(F.col("km").cast("bigint").cast("string"), F.lit(" km")).alias("kilometrage"),
            "energie", F.concat(F.col("horsepower").cast("bigint").cast("string"), F.lit(" Ch")).alias("puissance_din"),
            F.col("seller").cast("string").alias("reference"),
        )


LISTINGS = """WITH l AS (
  SELECT l_orderkey || '-' || l_linenumber AS url, l_linestatus AS snapshot,
         CAST(l_shipdate AS DATE) AS index_date, p_brand AS brand, p_type AS model, p_name AS variant,
         CAST(year(l_shipdate) AS INT) AS year, l_extendedprice AS price, l_quantity * 4000 AS km,
         CAST(p_size * 10 AS DOUBLE) AS horsepower,
         CASE l_returnflag WHEN 'A' THEN 'Diesel' WHEN 'N' THEN 'Essence' ELSE 'Hybride essence' END AS energie,
         l_returnflag AS flag, l_discount AS discount, l_suppkey AS seller,
         CAST(2003 - year(l_shipdate) AS INT) AS car_age
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 d AS (SELECT *, price * (1.15::DOUBLE - discount * 6) AS declared_price FROM l WHERE flag = 'R'),
 m AS (SELECT * FROM l WHERE flag = 'N'),
 m2 AS (SELECT * FROM l WHERE flag = 'A')"""


def grid(c: Column) -> Column:
    """Cut to 4 decimals; the offset keeps short decimals away from the cut."""
    return F.floor(c * 10000.0 + 0.637) / 10000.0


def on_grid(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.select(*[grid(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


def sql(body: str, plain: str | list[str] = "", doubles: str = "", *, listings: bool = True) -> str:
    """`body` (a SELECT, or further CTEs and a SELECT) with its double columns on the grid.

    `plain` and `doubles` name the output columns, separated by blanks (or as a list).
    """
    start = LISTINGS if listings else "WITH _none AS (SELECT 1)"
    text = body.strip()
    whole = f"{start}, {text[5:].strip()}" if text[:5].upper() == "WITH " else f"{start} {text}"
    columns = (plain.split() if isinstance(plain, str) else plain) + [
        f"floor(CAST({c} AS DOUBLE) * 10000.0::DOUBLE + 0.637::DOUBLE) / 10000.0::DOUBLE AS {c}" for c in doubles.split()
    ]
    return f"SELECT {', '.join(columns)} FROM ({whole}) AS result"


def query(name: str, oracle: str | None = None):
    """Register a function of Tables under a name, with its SQL if it has one."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: on_grid(build(Tables(spark, sf_dir)))
        if oracle:
            ORACLES[name] = oracle
        return build

    return register
