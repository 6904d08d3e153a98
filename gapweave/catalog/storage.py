"""Vendor rows (S4, V) and the run log (S5–S9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import content
from ..operators import log, metrics, vendor
from ..session import scratch_dir
from ..sources import tables
from .base import Catalog, shape
from .extraction import FIELDS

catalog = Catalog()
add = catalog.add

# --- vendor rows: one JSON text per part ---------------------------------------------


def vendor_texts(spark, folder):
    """``part`` as vendor JSON: ladders, attributes and media may be missing."""
    p = tables.table(spark, folder, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")

    def step(quantity, factor):
        return F.concat(F.lit(f"{quantity} : $"), F.format_string("%.5f", price * factor), F.lit(" : Bulk"))

    ladder = F.concat_ws(";", step(1, 1.0), step(10, 0.95), step(50, 0.9), step(100, 0.87))

    def attribute(name, value):
        return F.struct(F.lit(name).alias("type"), value.alias("description"))

    def media(kind, *links):
        none = F.array().cast("array<string>")
        return F.struct(F.lit(kind).alias("type"), (F.array(*links) if links else none).alias("link"))

    attributes = F.array(
        attribute("Category", F.col("p_type")),
        attribute("Manufacturer", F.lit("unknown")),
        attribute("Load Current", F.concat(size.cast("string"), F.lit(" A"))),
        attribute("Manufacturer", F.col("p_brand")),
    )
    documents = F.array(
        media("Datasheets", F.concat(F.lit("http://d.example.org/"), "p_partkey"), F.concat(F.lit("http://e.example.org/"), "p_partkey")),
        media("Video File"),
    )
    bare = size % 7 == 0
    row = F.struct(
        F.concat(F.lit("P"), "p_partkey").alias("part_number"),
        F.col("p_brand").alias("manufacturer"),
        F.when(size % 9 == 0, "Out of stock").otherwise(F.concat(F.lit("In-Stock: "), F.format_number(size * 100, 0))).alias("stock"),
        F.when(size % 10 != 0, ladder).alias("price"),
        F.concat(size.cast("string"), F.lit(" Weeks")).alias("lead_time"),
        F.concat(size.cast("string"), F.lit(" A")).alias("load_current"),
        F.when(size % 4 == 0, "5V").otherwise(F.concat(size.cast("string"), F.lit(" ~ "), (size + 29).cast("string"), F.lit("VDC"))).alias("voltage_input"),
        F.lit("24 ~ 240V").alias("voltage_load"),
        F.when(bare, F.array_except(attributes, attributes)).otherwise(attributes).alias("product_attributes"),
        F.when(bare, F.array_except(documents, documents)).otherwise(documents).alias("documents_and_media"),
        F.struct(
            F.lit(1).alias("quantity1"),
            price.alias("pricing_qty1"),
            F.when(size % 3 != 0, 10).alias("quantity2"),
            F.when(size % 3 != 0, price / 2).alias("pricing_qty2"),
        ).alias("pricing_per_quantity"),
        F.array("p_type", "p_name").alias("categories"),
    )
    return tables.spread(p.select(F.to_json(row).alias("value")))


def vendor_rows(spark, folder):
    parsed = vendor_texts(spark, folder).select(F.from_json("value", vendor.SCHEMA).alias("r"))
    return parsed.select("r.*")


@add(
    "s4_vendor_json",
    """SELECT 'P' || p_partkey AS part_number, p_brand AS manufacturer, CASE WHEN p_size % 7 = 0 THEN 0 ELSE 4 END AS n_attributes,
       p_type || ',' || p_name AS categories FROM part""",
)
def s4(spark, folder):
    path = scratch_dir(spark)
    vendor_texts(spark, folder).write.text(path)
    rows = vendor.read_rows(spark, path, one_per_line=True)
    return rows.select(
        "part_number",
        "manufacturer",
        F.size("product_attributes").alias("n_attributes"),
        F.array_join("categories", ",").alias("categories"),
    )


@add(
    "v1_price_ladder",
    """SELECT 'P' || p_partkey AS part_number, step, q AS quantity, round(p_retailprice * f, 5) AS unit_price, 'Bulk' AS packaging
       FROM part, (VALUES (0, 1, 1.0::DOUBLE), (1, 10, 0.95), (2, 50, 0.9), (3, 100, 0.87)) t(step, q, f) WHERE p_size % 10 <> 0""",
)
def v1(spark, folder):
    return vendor.price_ladder(vendor_rows(spark, folder))


@add(
    "v2_price_columns",
    """SELECT 'P' || p_partkey AS part_number, 1 AS step, 1 AS quantity, p_retailprice AS unit_price FROM part
       UNION ALL SELECT 'P' || p_partkey, 2, 10, p_retailprice / 2 FROM part WHERE p_size % 3 <> 0""",
)
def v2(spark, folder):
    return vendor.price_columns(vendor_rows(spark, folder))


@add(
    "v3_attributes",
    """SELECT 'P' || p_partkey AS part_number, CASE WHEN p_size % 7 <> 0 THEN p_type END AS category,
       CASE WHEN p_size % 7 <> 0 THEN p_brand END AS manufacturer, CASE WHEN p_size % 7 <> 0 THEN p_size || ' A' END AS load_current FROM part""",
)
def v3(spark, folder):
    return vendor.attribute_columns(vendor_rows(spark, folder), ["Category", "Manufacturer", "Load Current"])


@add(
    "v4_media_links",
    """SELECT 'P' || p_partkey AS part_number, CASE WHEN p_size % 7 <> 0 THEN t.type END AS type,
       CASE WHEN p_size % 7 <> 0 THEN t.base || p_partkey END AS link
       FROM part, (VALUES ('Datasheets', 'http://d.example.org/'), ('Datasheets', 'http://e.example.org/'), ('Video File', NULL)) t(type, base)
       WHERE p_size % 7 <> 0 OR t.base IS NULL""",
)
def v4(spark, folder):
    return vendor.media_links(vendor_rows(spark, folder))


@add(
    "v5_quantities",
    """SELECT 'P' || p_partkey AS part_number, CASE WHEN p_size % 9 <> 0 THEN p_size * 100 END AS in_stock, p_size * 7 AS lead_days,
       p_size::DOUBLE AS load_amperes, CASE WHEN p_size % 4 = 0 THEN 5.0::DOUBLE ELSE p_size END AS input_volts_low,
       CASE WHEN p_size % 4 = 0 THEN 5.0::DOUBLE ELSE p_size + 29 END AS input_volts_high, 24.0::DOUBLE AS load_volts_low,
       240.0::DOUBLE AS load_volts_high, CASE WHEN p_size % 4 = 0 THEN 'V' ELSE 'VDC' END AS input_unit FROM part""",
)
def v5(spark, folder):
    return vendor.quantities(vendor_rows(spark, folder))


@add(
    "v6_result_counts",
    """SELECT event_id, CASE t WHEN 'ARRAY' THEN json_array_length(g) WHEN 'OBJECT' THEN 1 ELSE 0 END::BIGINT AS row_count,
       CASE t WHEN 'OBJECT' THEN len(json_keys(g)) WHEN 'ARRAY' THEN CASE WHEN json_type(g, '$[0]') = 'OBJECT' THEN len(json_keys(g, '$[0]')) ELSE 0 END
         ELSE 0 END AS field_count
       FROM (SELECT event_id, g, json_type(g) AS t FROM (SELECT event_id, CASE WHEN json_valid(j) THEN j END AS g FROM contents))""",
    "contents",
)
def v6(spark, folder):
    c = shape(spark, folder, "contents")
    j = F.col("j")
    return c.select(
        "event_id",
        F.coalesce(content.row_count(j), F.lit(0)).alias("row_count"),
        F.coalesce(content.field_count(j), F.lit(0)).alias("field_count"),
    )


# --- sinks and log ---------------------------------------------------------------------


@add(
    "s5_save_pages",
    "SELECT entity_id, url, data_kind, length(data) AS n_chars FROM scrapes WHERE success AND status = 'ready' AND length(data) > 0",
    "scrapes",
)
def s5(spark, folder):
    path = scratch_dir(spark)
    log.save_pages(shape(spark, folder, "scrapes"), path)
    saved = spark.read.parquet(path)
    return saved.select("entity_id", "url", "data_kind", F.length("data").alias("n_chars"))


def run_tables(spark, folder):
    """The run events as a header per run and rows per link."""
    events = shape(spark, folder, "run_events")
    success = F.col("successful_extractions") > 0
    runs = (
        metrics.run_metrics(events)
        .withColumn("query", F.concat(F.lit("run "), F.col("run_id").cast("string")))
        .withColumn("success", success)
        .withColumn("status", F.when(success, "finished").otherwise("failed"))
        .withColumn("urls_scraped", F.col("successful_scrapes"))
        .withColumn("urls_extracted", F.col("successful_extractions"))
    )
    day = F.to_date("ts").alias("run_date")
    link = ["run_id", "url", "cost"]
    scrapes = events.filter(F.col("stage").isin("scraped", "failed")).select(
        *link, (F.col("stage") == "scraped").alias("success"), day
    )
    extracts = events.filter(F.col("stage") == "extracted").select(*link, F.lit(True).alias("success"), day)
    return {log.RUNS: log.run_records(runs, FIELDS), log.SCRAPES: scrapes, log.EXTRACTS: extracts}


def _logged(spark, folder, mode="test"):
    path = log.log_path(scratch_dir(spark), mode)
    log.write_log(run_tables(spark, folder), path)
    return path


N = "count(*) FILTER (stage = '{}')"
RUN_SQL = f"""SELECT run_id, 'run ' || run_id AS query, {N.format('extracted')} > 0 AS success,
    CASE WHEN {N.format('extracted')} > 0 THEN 'finished' ELSE 'failed' END AS status,
    {N.format('found')} AS urls_found, {N.format('scraped')} AS urls_scraped, {N.format('failed')} AS errors,
    round(sum(cost) FILTER (stage IN ('found', 'scraped', 'extracted')), 6) AS total_cost,
    strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') AS created_at"""


@add("s6_write_log", f"{RUN_SQL}, CAST(min(ts) AS DATE) AS run_date, {len(FIELDS)} AS n_fields FROM run_events GROUP BY run_id", "run_events")
def s6(spark, folder):
    runs = log.read_log(spark, _logged(spark, folder))[log.RUNS]
    return runs.select(
        "run_id", "query", "success", "status",
        F.col("status_details.urls_found").alias("urls_found"),
        F.col("status_details.urls_scraped").alias("urls_scraped"),
        "errors",
        F.coalesce("costs.total_cost", F.lit(0.0)).alias("total_cost"),
        F.date_format("created_at", log.ISO).alias("created_at"),
        "run_date",
        F.size("schema").alias("n_fields"),
    )


@add(
    "s7_read_log",
    """SELECT run_id, CASE WHEN stage = 'extracted' THEN 'extract' ELSE 'scrape' END AS kind, url, stage <> 'failed' AS success, cost,
       CASE WHEN count(*) FILTER (stage = 'extracted') OVER (PARTITION BY run_id) > 0 THEN 'finished' ELSE 'failed' END AS status
       FROM run_events QUALIFY stage IN ('scraped', 'failed', 'extracted')""",
    "run_events",
)
def s7(spark, folder):
    runs, scrapes, extracts = log.read_log(spark, _logged(spark, folder)).values()
    links = scrapes.withColumn("kind", F.lit("scrape")).unionByName(extracts.withColumn("kind", F.lit("extract")))
    return links.join(runs.select("run_id", "status"), "run_id").select("run_id", "kind", "url", "success", "cost", "status")


@add("s8_export_runs", f"{RUN_SQL} FROM run_events GROUP BY run_id", "run_events")
def s8(spark, folder):
    lines = log.export_runs(run_tables(spark, folder)[log.RUNS])

    def at(path, kind="string"):
        return F.get_json_object("record", path).cast(kind)

    return lines.select(
        "run_id",
        at("$.query").alias("query"),
        at("$.success", "boolean").alias("success"),
        at("$.status").alias("status"),
        at("$.status_details.urls_found", "long").alias("urls_found"),
        at("$.status_details.urls_scraped", "long").alias("urls_scraped"),
        at("$.errors", "long").alias("errors"),
        at("$.costs.total_cost", "double").alias("total_cost"),
        at("$.created_at").alias("created_at"),
    )


@add(
    "s8_export_links",
    """SELECT run_id, CASE WHEN stage = 'extracted' THEN 'extract' ELSE 'scrape' END AS kind, url, stage <> 'failed' AS success
       FROM run_events WHERE stage IN ('scraped', 'failed', 'extracted')""",
    "run_events",
)
def s8_links(spark, folder):
    done = run_tables(spark, folder)
    lines = log.export_links(done[log.SCRAPES], done[log.EXTRACTS])
    return lines.select(
        "run_id",
        "kind",
        F.get_json_object("record", "$.url").alias("url"),
        F.get_json_object("record", "$.success").cast("boolean").alias("success"),
    )


@add(
    "s9_log_schemas",
    "SELECT s AS log_schema, count(DISTINCT run_id) AS n_runs FROM run_events, (VALUES ('production'), ('test')) v(s) GROUP BY s",
    "run_events",
)
def s9(spark, folder):
    root = scratch_dir(spark)
    tables_ = run_tables(spark, folder)
    parts = []
    for mode in ("prod", "test"):
        path = log.log_path(root, mode)
        log.write_log(tables_, path)
        runs = log.read_log(spark, path)[log.RUNS]
        parts.append(runs.agg(F.count("*").alias("n_runs")).withColumn("log_schema", F.lit(path.split("/")[-2])))
    return parts[0].unionByName(parts[1])


@add(
    "s9_log_tables",
    """SELECT 'production' AS log_schema, run_id, count(*) AS n FROM run_events WHERE stage IN ('scraped', 'failed') GROUP BY run_id
       UNION ALL SELECT 'test', run_id, count(*) FROM run_events WHERE stage IN ('scraped', 'failed') AND run_id % 2 = 0 GROUP BY run_id""",
    "run_events",
)
def s9_tables(spark, folder):
    root, prefix = scratch_dir(spark), f"log_{uuid.uuid4().hex}_"
    scrapes = {log.SCRAPES: run_tables(spark, folder)[log.SCRAPES]}
    even = {name: rows.filter("run_id % 2 = 0") for name, rows in scrapes.items()}
    log.write_log_tables(scrapes, root, "prod", prefix)
    log.write_log_tables(even, root, "test", prefix)
    return spark.sql(
        f"""SELECT 'production' AS log_schema, run_id, count(*) AS n FROM production.{prefix}{log.SCRAPES} GROUP BY run_id
            UNION ALL SELECT 'test', run_id, count(*) FROM test.{prefix}{log.SCRAPES} GROUP BY run_id"""
    )
