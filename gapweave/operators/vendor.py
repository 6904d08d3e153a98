"""Vendor product rows: nested JSON with prices, attributes and quantities in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a vendor row.
TEXT_COLUMNS = (
    "product_url category_url part_number manufacturer manufacturer_url datasheet_url rohs_compliant stock price "
    "series package product_status mounting_type package_case output_type circuit voltage_input voltage_load "
    "load_current termination_style image input_link base_product_number lead_time product_category "
    "digikey_part_number manufacture_part_number url moisture_sensitivity_level_msl eccn htsus "
    "additional_resources standard_package pop_up tariff_status timestamp"
).split()
NESTED_COLUMNS = {
    "documents_and_media": "array<struct<type:string,link:array<string>>>",
    "pricing_per_quantity": "struct<quantity1:bigint,pricing_qty1:double,quantity2:bigint,pricing_qty2:double,"
    "quantity3:bigint,pricing_qty3:double,quantity4:bigint,pricing_qty4:double>",
    "other_names": "array<string>",
    "marketplace_product": "boolean",
    "mfr_standard_lead_time": "bigint",
    "alternate_packaging": "struct<part_number:string,packaging:string,min_order_quantity:bigint,price:string>",
    "categories": "array<string>",
    "product_attributes": "array<struct<type:string,description:string>>",
    "input": "struct<url:string>",
}
SCHEMA = ", ".join([f"{c} string" for c in TEXT_COLUMNS] + [f"{c} {t}" for c, t in NESTED_COLUMNS.items()])


def read_rows(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Vendor files with the declared schema, so no pass is spent on inference."""
    return spark.read.schema(SCHEMA).option("multiLine", not one_per_line).json(path)


def price_ladder(rows: DataFrame) -> DataFrame:
    """``qty : $price : packaging;…`` as rows; rows without a ladder give none."""
    steps = rows.select("part_number", F.posexplode(F.split("price", ";")).alias("step", "text"))
    cells = F.split("text", " : ")
    return steps.select(
        "part_number",
        "step",
        F.trim(cells[0]).try_cast("long").alias("quantity"),
        F.regexp_replace(F.get(cells, F.lit(1)), r"[$,\s]", "").try_cast("double").alias("unit_price"),
        F.trim(F.get(cells, F.lit(2))).alias("packaging"),
    )


def price_columns(rows: DataFrame) -> DataFrame:
    """The numbered price columns as rows."""
    p = "pricing_per_quantity"
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.col(f"{p}.quantity{i}").alias("quantity"),
                F.col(f"{p}.pricing_qty{i}").alias("unit_price"),
            )
            for i in range(1, 5)
        ]
    )
    return rows.select("part_number", F.inline(F.filter(pairs, lambda x: x["quantity"].isNotNull())))


def attribute_map(attributes: Column) -> Column:
    """Attribute list as a map; a type given twice keeps its last description."""
    last = F.filter(
        attributes,
        lambda a, i: ~F.exists(F.slice(attributes, i + 2, F.size(attributes)), lambda x: x["type"] == a["type"]),
    )
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["type"].alias("key"), a["description"].alias("value"))))


def attribute_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """The wanted attributes as columns."""
    m = rows.select("part_number", attribute_map(F.col("product_attributes")).alias("m"))
    return m.select("part_number", *[F.try_element_at("m", F.lit(n)).alias(_column(n)) for n in names])


def _column(name: str) -> str:
    return "_".join(name.lower().replace("/", " ").replace("-", " ").split())


def media_links(rows: DataFrame) -> DataFrame:
    """One row per media link; kinds without links and parts without media stay, as null."""
    kinds = rows.select("part_number", F.explode_outer("documents_and_media").alias("m"))
    return kinds.select("part_number", F.col("m.type").alias("type"), F.explode_outer("m.link").alias("link"))


def _number(text: str, pattern: str, group: int = 1) -> Column:
    return F.regexp_replace(F.regexp_extract(text, pattern, group), ",", "").try_cast("double")


RANGE = r"([0-9][0-9.,]*)(?:\s*~\s*([0-9][0-9.,]*))?\s*(V[A-Z]*)"


def quantities(rows: DataFrame) -> DataFrame:
    """Numbers out of text: stock, lead time in days, current, voltage ranges."""

    def span(column, name):
        low, high = _number(column, RANGE, 1), _number(column, RANGE, 2)
        return [low.alias(f"{name}_low"), F.coalesce(high, low).alias(f"{name}_high")]

    return rows.select(
        "part_number",
        _number("stock", r"In-Stock:\s*([0-9][0-9,]*)").cast("long").alias("in_stock"),
        (_number("lead_time", r"([0-9]+)\s*Weeks?") * 7).cast("long").alias("lead_days"),
        _number("load_current", r"([0-9.]+)\s*A").alias("load_amperes"),
        *span("voltage_input", "input_volts"),
        *span("voltage_load", "load_volts"),
        F.nullif(F.regexp_extract("voltage_input", RANGE, 3), F.lit("")).alias("input_unit"),
    )
