"""Typed readers for the input tables, and the checks made while loading them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dailycast.functions.numeric import nan_to_null

SALES = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Revenue", T.DoubleType()),
        T.StructField("COGS", T.DoubleType()),
    ]
)
HORIZON = SALES
ORDERS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
    ]
)
ORDER_ITEMS = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("discount_amount", T.DoubleType()),
    ]
)
RETURNS = T.StructType([T.StructField("order_id", T.StringType())])
WEB_TRAFFIC = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("sessions", T.LongType())]
)

TARGETS = {"Revenue": "revenue", "COGS": "cogs"}
TARGET_ALIAS = "net_revenue"


@dataclass(frozen=True)
class Facts:
    """The transaction and traffic tables behind the annual metrics; all optional."""

    orders: DataFrame | None = None
    order_items: DataFrame | None = None
    returns: DataFrame | None = None
    web_traffic: DataFrame | None = None

    def before(self, cutoff: str) -> Facts:
        """Only what was known before ``cutoff``; items and returns follow their orders."""
        day = F.lit(cutoff).cast("date")
        return replace(
            self,
            orders=self.orders and self.orders.filter(F.col("order_date") < day),
            web_traffic=self.web_traffic and self.web_traffic.filter(F.col("date") < day),
        )


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """Read the columns ``schema`` names, by header, whatever else the file holds.

    A CSV schema is positional in Spark, so the header decides which columns
    exist and the declared types are applied by name. NaN becomes NULL here,
    once, because Spark would otherwise treat it as an ordinary value.
    """
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    by_name = {f.name: f.dataType for f in schema.fields}
    missing = [n for n in by_name if n not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return clean(raw.select(*[F.col(n).cast(t).alias(n) for n, t in by_name.items()]))


def clean(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column."""
    floats = [
        f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def read_optional(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv"
) -> DataFrame | None:
    """``None`` where the path does not exist; any other problem still raises."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_sales(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, SALES, fmt).toDF("date", "revenue", "cogs")


def read_horizon(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Dates only: a template's measures are never features."""
    return read_table(spark, path, T.StructType(HORIZON.fields[:1]), fmt).toDF("date")


def read_facts(spark: SparkSession, root: str, fmt: str = "csv", suffix: str = ".csv") -> Facts:
    """Each table is loaded if its path exists; its metrics go missing otherwise."""
    return Facts(
        orders=read_optional(spark, f"{root}/orders{suffix}", ORDERS, fmt),
        order_items=read_optional(spark, f"{root}/order_items{suffix}", ORDER_ITEMS, fmt),
        returns=read_optional(spark, f"{root}/returns{suffix}", RETURNS, fmt),
        web_traffic=read_optional(spark, f"{root}/web_traffic{suffix}", WEB_TRAFFIC, fmt),
    )


def canonical_targets(df: DataFrame) -> DataFrame:
    """Target headers in any letter case become ``Revenue`` and ``COGS``.

    ``net_revenue`` stands in for a missing ``Revenue``. Two columns that would
    take the same name are an error rather than an ambiguous frame.
    """
    renames: dict[str, str] = {}
    for canonical, lower in TARGETS.items():
        if canonical in df.columns:
            continue
        found = [c for c in df.columns if c.lower() == lower]
        if canonical == "Revenue" and TARGET_ALIAS in df.columns:
            found.append(TARGET_ALIAS)
        if len(found) > 1:
            raise ValueError(f"columns {found} would all become {canonical}")
        renames.update({c: canonical for c in found})
    return df.withColumnsRenamed(renames)


def drop_leaks(features: DataFrame, targets: Sequence[str] = tuple(TARGETS)) -> DataFrame:
    """Remove target columns that slipped into the feature table.

    Matched with exact case: under Spark's case-insensitive names ``drop``
    alone would also remove a differently spelled column.
    """
    return features.select(*[F.col(c) for c in features.columns if c not in set(targets)])


def attach_target(
    features: DataFrame,
    target: DataFrame,
    on: Sequence[str] = ("date",),
    targets: Sequence[str] = ("revenue", "cogs"),
    check: bool = True,
) -> DataFrame:
    """Left-join the targets and refuse to go on if any row stayed without one."""
    on = list(on)
    joined = features.join(target.select(*on, *targets), on, "left")
    if check:
        incomplete = F.lit(False)
        for t in targets:
            incomplete = incomplete | F.col(t).isNull()
        if not joined.filter(incomplete).isEmpty():
            raise ValueError("some feature rows have no target")
    return joined


def align_columns(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    """Reorder to ``columns``; add absent ones as NULL and drop the rest."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit(None).cast(dtype).alias(c) for c in columns]
    )
