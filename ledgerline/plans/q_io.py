"""Source and sink round trips: a table is written in the format under the
shared checkpoint folder and read back by the source, so the check compares
the read-back rows with the original table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators import inventory as inv
from ledgerline.plans.q_inventory import items
from ledgerline.plans.registry import register
from ledgerline.session import ensure_checkpoint_dir
from ledgerline.sources import files
from ledgerline.sources.tables import table


def _path(spark, name):
    return ensure_checkpoint_dir(spark).rstrip("/") + f"/io/{name}-{uuid.uuid4().hex}"


@register("scan_csv", sql="SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def q_scan_csv(spark, d):
    p = _path(spark, "part_csv")
    files.sink_csv(table(spark, d, "part"), p)
    return files.scan_csv(spark, p).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


@register("scan_csv_sniff", sql="SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_scan_csv_sniff(spark, d):
    p = _path(spark, "supplier_semicolon")
    table(spark, d, "supplier").write.option("header", True).option("sep", ";").csv(p)
    return files.scan_csv_sniff(spark, p).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


_NAMED = {"utf8": " é€ 猫", "latin1": " é ñ", "cp1252": " é € “x”"}


@register("scan_csv_encodings", sql=" UNION ALL ".join(
    f"SELECT '{enc}' AS written, s_suppkey, s_name || '{tail}' AS s_name, s_acctbal FROM supplier" for enc, tail in _NAMED.items()))
def q_scan_csv_encodings(spark, d):
    """Files in three encodings and with three separators, read back without a hint."""
    out = None
    for (enc, tail), sep in zip(_NAMED.items(), files.CANDIDATE_SEPARATORS):
        p = _path(spark, f"supplier_{enc}")
        x = table(spark, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(tail)).alias("s_name"), "s_acctbal")
        if enc == "cp1252":  # its characters as the bytes 80 to 9F
            x = x.withColumn("s_name", F.translate("s_name", files.CP1252.replace(" ", ""), files._HIGH))
        x.write.option("header", True).option("sep", sep).option("encoding", "UTF-8" if enc == "utf8" else "ISO-8859-1").csv(p)
        back = files.scan_csv_sniff(spark, p).select(F.lit(enc).alias("written"), "s_suppkey", "s_name", "s_acctbal")
        out = back if out is None else out.unionByName(back)
    return out


@register("scan_csv_skip_bad", sql="SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_scan_csv_skip_bad(spark, d):
    p = _path(spark, "nation_csv")
    n = table(spark, d, "nation")
    # a header, all rows, and for every fifth one a line whose key is no number
    good = n.select(F.lit(1).alias("part"), F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    bad = n.where("n_nationkey % 5 = 0").select(F.lit(1).alias("part"), F.concat_ws(",", F.lit("x"), "n_name", F.lit("y")).alias("value"))
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit("n_nationkey,n_name,n_regionkey").alias("value"))
    head.unionByName(good).unionByName(bad).coalesce(1).sortWithinPartitions("part", "value").select("value").write.text(p)
    return files.scan_csv(spark, p, schema="n_nationkey int, n_name string, n_regionkey int", skip_bad=True)


@register("scan_json", sql="SELECT r_regionkey, r_name FROM region")
def q_scan_json(spark, d):
    p = _path(spark, "region_json")
    table(spark, d, "region").write.json(p)
    return files.scan_json(spark, p, "r_regionkey int, r_name string")


@register("sink_csv_excel_safe", sql="SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q_sink_excel(spark, d):
    p = _path(spark, "customer_excel")
    files.sink_csv_excel_safe(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), p)
    return spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n") \
        .schema("c_custkey long, c_name string, c_mktsegment string").csv(p)


@register("sink_jsonl_append", sql="SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 6 <> 0")
def q_sink_jsonl(spark, d):
    p = _path(spark, "labels_jsonl")
    # every sixth label is out of range and must be rejected
    lb = table(spark, d, "labels").withColumn("quality", F.when(F.col("doc_id") % 6 == 0, F.col("quality") + 5).otherwise(F.col("quality")))
    files.sink_jsonl_append(lb.filter("quality = 1"), p, "quality", [0, 1])
    files.sink_jsonl_append(lb.filter("quality <> 1"), p, "quality", [0, 1])
    return files.scan_json(spark, p, "doc_id long, quality int, toxic int")


@register("scan_records", sql="SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_scan_records(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "map<string,string>")["k"].alias("k"))


@register("scan_latest", sql="SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def q_scan_latest(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)


@register("doc_find", sql="SELECT doc_id, source FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 100 OFFSET 5")
def q_doc_find(spark, d):
    return table(spark, d, "documents").filter(F.col("lang") == "en").select("doc_id", "source") \
        .orderBy("doc_id").offset(5).limit(100)


@register("import_merge", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS category FROM part""")
def q_import_merge(spark, d):
    it = items(spark, d).select(F.col("id").cast("string").alias("id"), "name", "category",
                                F.col("quantity").cast("string").alias("quantity"),
                                F.col("unit_price").cast("string").alias("unit_price"))
    base = it.filter(F.col("category") == "ECONOMY")
    incoming = it.filter(F.col("category") != "ECONOMY")
    for c in inv.INVENTORY_COLUMNS:
        if c not in base.columns:
            base = base.withColumn(c, F.lit(None).cast("string"))
    merged = inv.import_merge(base.select(*inv.INVENTORY_COLUMNS), incoming, "append", stamp="2024-01-01 00:00:00")
    return merged.select("id", "name", "category")


@register("export_table", sql="SELECT p_partkey AS id, p_type AS category FROM part")
def q_export_table(spark, d):
    p = _path(spark, "inventory_export")
    files.sink_csv(items(spark, d).select("id", "category"), p)
    return spark.read.option("header", True).schema("category string, id long").csv(p)
