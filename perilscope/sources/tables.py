"""The policy table and the other tables the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Policy columns over orders, customer and nation. The text is valid in both
# Spark SQL and DuckDB, so the checks and the jobs share one definition.
POLICY_COLUMNS: dict[str, str] = {
    "id_policy": "o_orderkey",
    "year": "cast(year(o_orderdate) as int)",
    "pol_coverage": (
        "case o_orderpriority when '1-URGENT' then 'Max' when '2-HIGH' then 'Med2' "
        "when '3-MEDIUM' then 'Med1' when '5-LOW' then 'Min' end"
    ),
    "pol_no_claims_discount": "cast((o_orderkey*7)%40 as double)/40",
    "pol_duration": "cast((o_orderkey*3)%20+1 as double)",
    "pol_sit_duration": "cast((o_orderkey*5)%8+1 as double)",
    "pol_pay_freq": (
        "case (o_orderkey*11)%4 when 0 then 'Monthly' when 1 then 'Quarterly' "
        "when 2 then 'Biannual' else 'Yearly' end"
    ),
    "pol_payd": "case when o_orderkey%5=0 then 'Yes' else 'No' end",
    "pol_usage": (
        "case (o_orderkey*13)%5 when 0 then 'AllTrips' when 1 then 'Professional' "
        "when 2 then 'Retired' when 3 then 'WorkPrivate' else 'Unlisted' end"
    ),
    "drv_sex1": (
        "case c_mktsegment when 'BUILDING' then 'F' when 'MACHINERY' then 'F' "
        "when 'AUTOMOBILE' then 'M' when 'FURNITURE' then 'M' else 'U' end"
    ),
    "drv_age1": "cast(22+o_custkey%60 as double)",
    "drv_age_lic1": "case when o_custkey%17=0 then null else cast(18+o_custkey%5 as double) end",
    "drv_sex2": "case o_orderkey%3 when 0 then '0' when 1 then 'M' else 'F' end",
    "drv_age2": "case when o_orderkey%3=0 then null else cast(20+(o_custkey*3)%55 as double) end",
    "drv_age_lic2": "case when o_orderkey%3=0 then null else cast(18+(o_custkey*3)%9 as double) end",
    "vh_fuel": "case o_orderstatus when 'F' then 'Gasoline' when 'O' then 'Diesel' else 'Hybrid' end",
    "vh_type": "case when o_orderkey%9=0 then 'Commercial' else 'Tourism' end",
    "vh_make_model": "concat('MAKE', cast(o_custkey%30 as string))",
    "vh_age": "case when o_orderkey%23=0 then null else cast((o_orderkey*17)%26 as double) end",
    "vh_value": "o_totalprice/10",
    "vh_speed": "cast(120+(o_orderkey*19)%90 as double)",
    "vh_weight": "case when o_orderkey%31=0 then null else cast(800+(o_orderkey*29)%1200 as double) end",
    "population": "cast((n_nationkey+1)*1000+o_custkey%500 as double)",
    "town_surface_area": (
        "case when n_nationkey=7 then cast(0 as double) "
        "else cast(10+(n_nationkey*13)%97 as double) end"
    ),
    "claim_amount": (
        "case when o_totalprice>420000 or (o_custkey%60<6 and o_orderstatus='F') "
        "or (o_orderkey*17)%26>22 then o_totalprice*cast(0.01 as double) else cast(0 as double) end"
    ),
}

_TYPES = {"id_policy": T.LongType(), "year": T.IntegerType()}
_TEXT = {
    "pol_coverage", "pol_pay_freq", "pol_payd", "pol_usage",
    "drv_sex1", "drv_sex2", "vh_fuel", "vh_type", "vh_make_model",
}

# Declared once so that CSV and JSON reads never pay for schema inference.
POLICY_SCHEMA = T.StructType([
    T.StructField(name, T.StringType() if name in _TEXT else _TYPES.get(name, T.DoubleType()))
    for name in POLICY_COLUMNS
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order. The dimension sides are left unhinted: Spark
    broadcasts them while they fit its size threshold and otherwise sort-merges
    with adaptive skew splitting."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(
        nation, customer.c_nationkey == nation.n_nationkey
    )
    return joined.selectExpr(*(f"{sql} as {name}" for name, sql in POLICY_COLUMNS.items()))


def policies_sql() -> str:
    """The same view as SQL text."""
    columns = ",\n  ".join(f"{sql} as {name}" for name, sql in POLICY_COLUMNS.items())
    return (
        f"select {columns}\nfrom orders join customer on o_custkey=c_custkey "
        "join nation on c_nationkey=n_nationkey"
    )
