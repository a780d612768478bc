"""Domain tables derived from the TPC-H-like test tables.

Only expressions: every domain row comes from a row of the given tables. The
expression lists are plain SQL that both Spark and the checking engine read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.panel import WeekRange
from .session import spread

WEEKS = WeekRange("1995-01-02", "2001-07-30")
CHATTER_WEEKS = WeekRange("2024-01-01", "2024-01-29")
FIT_END = "1999-12-31"
TRAIN_END = "1999-12-31"
VALID_END = "2000-12-31"

REGISTRY_SQL = """
    concat('U', lpad(cast(n_nationkey as string), 3, '0')) as lga_code,
    n_name as lga_name,
    concat('S', cast(n_regionkey as string)) as state_code,
    r_name as state_name,
    concat('Zone ', cast(n_regionkey % 2 as string)) as zone,
    cast(null as string) as senatorial_district,
    cast(1000 + 37 * n_nationkey as double) as area_sqkm,
    cast(2 * floor(n_nationkey / 5) + 1 as double) as centre_lat,
    cast(2 * (n_nationkey % 5) + 1 as double) as centre_lon
"""

LARGE_REGISTRY_SQL = """
    concat('C', lpad(cast(c_custkey as string), 9, '0')) as lga_code,
    c_name as lga_name,
    concat('S', cast(c_nationkey as string)) as state_code,
    n_name as state_name,
    r_name as zone,
    cast(null as string) as senatorial_district,
    cast(1000 + c_custkey % 97 as double) as area_sqkm,
    cast((c_custkey % 900) / 100.0 as double) as centre_lat,
    cast((c_custkey % 700) / 100.0 as double) as centre_lon
"""

SMALL_CLASS_SQL = """case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'banditry_kidnapping'
    when o_orderpriority = '3-MEDIUM' then 'state_operation' else 'other' end"""
LARGE_CLASS_SQL = """case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'banditry_kidnapping'
    when o_orderpriority = '3-MEDIUM' then 'state_operation' else 'other' end"""

INCIDENT_SQL = """
    concat('E', cast(o_orderkey as string)) as event_id,
    'orders' as source,
    cast(o_orderkey as string) as source_event_id,
    cast(o_orderdate as date) as event_date,
    {event_class} as event_class,
    lower(o_orderpriority) as event_type,
    c_mktsegment as actor_primary,
    case when o_orderkey % 4 = 0 then null when o_orderkey % 11 = 0 then ' Civilians '
         else concat('group_', cast(o_custkey % 7 as string)) end as actor_secondary,
    {lga_code} as lga_code,
    cast(((o_orderkey * 7) % 1030) / 100.0 + 0.003 as double) as latitude,
    cast((o_orderkey % 1100) / 100.0 + 0.003 as double) as longitude,
    cast(o_orderkey % 5 as int) as fatalities,
    concat('Order ', cast(o_orderkey as string)) as headline
"""
SMALL_CODE_SQL = "concat('U', lpad(cast(c_nationkey as string), 3, '0'))"
LARGE_CODE_SQL = "concat('C', lpad(cast(c_custkey as string), 9, '0'))"

SENTENCE_SQL = """
    concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string), '-', cast(l_suppkey as string),
           '-', cast(l_quantity as string), '-', cast(l_extendedprice as string)) as text_id,
    case l_orderkey % 5
      when 0 then concat('Gunmen killed ', cast(l_linenumber as string), ' people near ', n_name, ' and demanded N',
                         cast(cast(floor(o_totalprice) as bigint) as string), ' ransom')
      when 1 then concat('Police denied that bandits attacked ', n_name, ', ', r_name, '; calm was restored')
      when 2 then concat('The abducted students were released near ', n_name, ' after ', cast(l_linenumber as string), '.5 million naira was paid')
      when 3 then concat('Seven villagers were killed and ', cast(l_linenumber as string), ' farmers kidnapped during a military operation in ', n_name)
      else concat('Market day in ', r_name, ' and ', n_name, ': NGN 1.2 billion in levies, no attack, three others hurt')
    end as text
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _columns(sql: str) -> list[str]:
    """Split a select list on its top-level commas."""
    parts, depth, quoted, current = [], 0, False, ""
    for ch in sql:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quoted else 0
        if ch == "," and not quoted and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


@dataclass
class Domain:
    """Lazy domain tables for one data folder. ``large`` makes every customer a unit."""

    spark: SparkSession
    sf_dir: str
    large: bool = False

    def table(self, name: str) -> DataFrame:
        return _table(self.spark, self.sf_dir, name)

    @property
    def long_texts(self) -> DataFrame:
        return spread(self.table("documents").select("doc_id", "text", "source", "n_chars"))

    @property
    def registry(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        if not self.large:
            return nation.selectExpr(*_columns(REGISTRY_SQL))
        return self.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(*_columns(LARGE_REGISTRY_SQL))

    @property
    def adjacency(self) -> DataFrame:
        if self.large:
            keys = self.table("customer").select(F.col("c_custkey").alias("k"))
            pairs = keys.select("k", F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("o")).join(
                keys.select(F.col("k").alias("o")), "o", "left_semi"
            )
            weights = pairs.groupBy("k").agg((1.0 / F.count(F.lit(1))).alias("weight"))
            code = lambda c: F.concat(F.lit("C"), F.lpad(F.col(c).cast("string"), 9, "0"))
            return pairs.join(weights, "k").select(
                code("k").alias("lga_code"), code("o").alias("neighbour_code"), "weight",
                F.lit(1.0).alias("border_km"), F.lit(1.0).alias("centroid_km"),
            )
        code = lambda c: F.concat(F.lit("U"), F.lpad(c.cast("string"), 3, "0"))
        k = F.col("n_nationkey")
        return self.table("nation").select(
            code(k).alias("lga_code"),
            F.explode(
                F.array(
                    F.struct(code((k + 5) % 25).alias("neighbour_code"), F.lit(0.75).alias("weight")),
                    F.struct(code((k + 20) % 25).alias("neighbour_code"), F.lit(0.25).alias("weight")),
                )
            ).alias("e"),
        ).select("lga_code", "e.neighbour_code", "e.weight", F.lit(1.0).alias("border_km"), F.lit(1.0).alias("centroid_km"))

    @property
    def incidents(self) -> DataFrame:
        sql = INCIDENT_SQL.format(
            event_class=LARGE_CLASS_SQL if self.large else SMALL_CLASS_SQL,
            lga_code=LARGE_CODE_SQL if self.large else SMALL_CODE_SQL,
        )
        joined = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.selectExpr(*_columns(sql))

    @property
    def documents(self) -> DataFrame:
        code = lambda c: F.concat(F.lit("U"), F.lpad(c.cast("string"), 3, "0"))
        d = F.col("doc_id")
        return self.table("documents").select(
            F.concat(F.lit("D"), d.cast("string")).alias("doc_id"),
            "source",
            F.date_add(F.lit("1995-01-02").cast("date"), (d % 2400).cast("int")).alias("published_at"),
            F.array_distinct(F.array(code(d % 25), code((d * 7) % 25))).alias("lga_codes"),
            F.when(d % 3 == 0, (F.col("n_chars") * 10).cast("double")).alias("ransom_ngn"),
        )

    @property
    def chatter(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").cast("string").alias("chatter_id"),
            F.col("event_type").alias("platform"),
            F.col("ts").alias("posted_at"),
            F.concat(F.lit("U"), F.lpad((F.col("user_id") % 25).cast("string"), 3, "0")).alias("lga_code"),
            (F.col("value") / (1 + F.abs("value"))).alias("threat_score"),
        )

    @property
    def sentences(self) -> DataFrame:
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        # Orders meet their places first, so that the many lines are dealt once.
        placed = (
            self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
            .join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_totalprice", "n_name", "r_name")
        )
        return (
            spread(self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"))
            .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
            .selectExpr(*_columns(SENTENCE_SQL))
        )
