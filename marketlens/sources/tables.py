"""The nine retail tables: schemas, readers and the CSV sink."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


# Column names and order of the marketplace files: fixed values. Timestamps
# arrive as text and are coerced after reading, so that one bad value becomes
# NULL instead of failing the file.
SCHEMAS: dict[str, T.StructType] = {
    "orders": _schema(
        order_id=_S,
        customer_id=_S,
        order_status=_S,
        order_purchase_timestamp=_S,
        order_approved_at=_S,
        order_delivered_carrier_date=_S,
        order_delivered_customer_date=_S,
        order_estimated_delivery_date=_S,
    ),
    "customers": _schema(
        customer_id=_S,
        customer_unique_id=_S,
        customer_zip_code_prefix=_I,
        customer_city=_S,
        customer_state=_S,
    ),
    "order_items": _schema(
        order_id=_S,
        order_item_id=_I,
        product_id=_S,
        seller_id=_S,
        shipping_limit_date=_S,
        price=_D,
        freight_value=_D,
    ),
    "order_payments": _schema(
        order_id=_S,
        payment_sequential=_I,
        payment_type=_S,
        payment_installments=_I,
        payment_value=_D,
    ),
    "order_reviews": _schema(
        review_id=_S,
        order_id=_S,
        review_score=_S,
        review_comment_title=_S,
        review_comment_message=_S,
        review_creation_date=_S,
        review_answer_timestamp=_S,
    ),
    "products": _schema(
        product_id=_S,
        product_category_name=_S,
        product_name_lenght=_I,
        product_description_lenght=_I,
        product_photos_qty=_I,
        product_weight_g=_D,
        product_length_cm=_D,
        product_height_cm=_D,
        product_width_cm=_D,
    ),
    "category_translation": _schema(product_category_name=_S, product_category_name_english=_S),
    "geolocation": _schema(
        geolocation_zip_code_prefix=_I,
        geolocation_lat=_D,
        geolocation_lng=_D,
        geolocation_city=_S,
        geolocation_state=_S,
    ),
    "sellers": _schema(seller_id=_S, seller_zip_code_prefix=_I, seller_city=_S, seller_state=_S),
}


@dataclass(frozen=True)
class RetailTables:
    """The logical tables; one the source does not have is None."""

    orders: DataFrame
    customers: DataFrame | None = None
    order_items: DataFrame | None = None
    order_payments: DataFrame | None = None
    order_reviews: DataFrame | None = None
    products: DataFrame | None = None
    category_translation: DataFrame | None = None
    geolocation: DataFrame | None = None
    sellers: DataFrame | None = None

    def named(self) -> dict[str, DataFrame]:
        found = {name: getattr(self, name) for name in SCHEMAS}
        return {name: df for name, df in found.items() if df is not None}


#: Tables whose CSV fields may hold line breaks. Their files cannot be split.
MULTI_LINE = ("order_reviews",)


def _as_stated(stored: DataFrame, field: T.StructField) -> Column:
    if field.name not in stored.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    same = stored.schema[field.name].dataType == field.dataType
    return F.col(field.name) if same else F.col(field.name).cast(field.dataType).alias(field.name)


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """One table with its stated schema; columns are matched by name.

    Of a parquet file columns that the schema lacks are not read, columns that
    the file lacks are null, and a column of another type is converted.
    """
    if fmt == "csv":
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        return reader.option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path)
    if fmt == "parquet":
        stored = spark.read.parquet(path)
        return stored.select(*[_as_stated(stored, field) for field in schema])
    raise ValueError(f"unknown table format: {fmt}")


def load_tables(
    spark: SparkSession,
    folder: str,
    fmt: str = "csv",
    names: dict[str, str] | None = None,
    multi_line: Sequence[str] = MULTI_LINE,
) -> RetailTables:
    """Read every table from ``folder``; ``names`` maps tables to file names."""
    names = names or {name: f"{name}.{fmt}" for name in SCHEMAS}
    frames = {name: read_table(spark, f"{folder.rstrip('/')}/{file}", SCHEMAS[name], fmt, name in multi_line) for name, file in names.items()}
    return RetailTables(**frames)


def export_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write as CSV with a header: one file per partition, no gathering."""
    df.write.mode(mode).option("header", True).csv(path)


def export_tables(tables: RetailTables, folder: str) -> None:
    """Write the tables as CSV folders with the stated columns; those a table lacks are empty."""
    for name, df in tables.named().items():
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]]
        export_csv(df.select(*cols), f"{folder.rstrip('/')}/{name}.csv")
