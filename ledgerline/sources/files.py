"""Delimited-text, JSON-lines and text-folder sources and sinks.

Scans never collect: the delimiter sniffer parses the whole input once per
candidate with Spark's CSV source and compares counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CANDIDATE_SEPARATORS = [",", ";", "\t"]


def scan_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",",
             encoding: str = "UTF-8", skip_bad: bool = False) -> DataFrame:
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    if skip_bad:
        r = r.option("mode", "DROPMALFORMED")
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def sniff_separator(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The candidate under which the input parses best: the smallest share of
    records whose field count differs from the header's, then the largest
    share of cells that are numbers (a decimal comma counts), then the most
    columns.  Quoted separators are the CSV reader's business.  Every
    candidate is tried on all rows; one row of counts each is fetched."""
    best = None
    for sep in CANDIDATE_SEPARATORS:
        reader = spark.read.option("sep", sep).option("encoding", encoding)
        n = len(reader.option("header", True).csv(path).columns)
        if n < 2:
            continue
        names = [f"c{i}" for i in range(n)]
        schema = StructType([StructField(c, StringType()) for c in [*names, "_bad"]])
        rows = (spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", True)
                     .option("enforceSchema", True).option("columnNameOfCorruptRecord", "_bad").csv(path))
        number = r"^\s*[-+]?\d+([.,]\d+)?\s*$"
        hits = sum((F.coalesce(F.col(c).rlike(number), F.lit(False)).cast("long") for c in names), F.lit(0))
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("bad"), F.sum(hits).alias("numbers")).first()
        total = max(row["n"], 1)
        rank = (-row["bad"] / total, (row["numbers"] or 0) / (total * n), n)
        if best is None or rank > best[0]:
            best = rank, sep
    return best[1] if best else ","


# What the bytes 80 to 9F are in CP1252 (blank: undefined there); in Latin-1 they are control characters.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"
_HIGH = "".join(chr(0x80 + i) for i, c in enumerate(CP1252) if c != " ")
_UNDEFINED = "".join(chr(0x80 + i) for i, c in enumerate(CP1252) if c == " ")


def sniff_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line is valid UTF-8 (no byte of a longer character is a line end,
    so lines can be judged one by one, wherever the input is split); else
    CP1252 if some byte is a character there and a control character in
    Latin-1, and none is undefined there; else ISO-8859-1.  One aggregation over all lines."""
    line = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    row = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8("value")).alias("bad"), F.count_if(line.rlike(f"[{_HIGH}]")).alias("high"),
                                    F.count_if(line.rlike(f"[{_UNDEFINED}]")).alias("undefined")).first()
    if not row["bad"]:
        return "UTF-8"
    return "CP1252" if row["high"] and not row["undefined"] else "ISO-8859-1"


def scan_csv_sniff(spark: SparkSession, path: str) -> DataFrame:
    """A CSV input of unknown encoding (UTF-8, CP1252, ISO-8859-1) and separator."""
    encoding = sniff_encoding(spark, path)
    read_as = "ISO-8859-1" if encoding == "CP1252" else encoding
    df = scan_csv(spark, path, sep=sniff_separator(spark, path, read_as), encoding=read_as)
    if encoding != "CP1252":
        return df
    there = CP1252.replace(" ", "")
    names = [c.translate(str.maketrans(_HIGH, there)) for c in df.columns]
    df = df.toDF(*names)
    return df.select(*[F.translate(f"`{c}`", _HIGH, there).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes])


def scan_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def scan_textdir(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: (path, text) for a folder of text documents."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


RECORD, UNIT = "\x1e", "\x1f"  # ASCII record and unit separators


def scan_text_records(spark: SparkSession, folder: str, sep: str = RECORD) -> DataFrame:
    """One row per record, (path, text), for files that hold many documents
    parted by ``sep``; large files are split across tasks."""
    return spark.read.option("lineSep", sep).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def sink_text_records(df: DataFrame, path: str, sep: str = RECORD) -> None:
    """Rows of one string column as records; the separator must not occur in them."""
    df.write.option("lineSep", sep).text(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header row; columns in sorted order so unions of records with
    different keys produce a stable header."""
    df.select(*sorted(df.columns)).write.mode(mode).option("header", True).csv(path)


def sink_csv_excel_safe(df: DataFrame, path: str) -> None:
    """Every field quoted, CRLF line ends, quotes escaped by doubling."""
    (df.write.mode("overwrite").option("header", True).option("quoteAll", True)
       .option("lineSep", "\r\n").option("escape", '"').csv(path))


def sink_jsonl_append(df: DataFrame, path: str, label_col: str | None = None, allowed=None) -> None:
    """Append records (JSON lines); rows with a label outside ``allowed``
    are rejected before writing."""
    if label_col and allowed:
        df = df.filter(F.col(label_col).isin(*allowed))
    df.write.mode("append").json(path)
