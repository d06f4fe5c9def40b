"""CSV in and out. Parsing is Spark's; what its reader lacks is done by column expressions over lines or fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest prefix of a field that is a number, as C's strtod reads decimal numbers.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


@dataclass(frozen=True)
class CsvOptions:
    """delimiter None: detected. missing: what an empty or unreadable field becomes. max_rows, max_cols: 0 for all."""

    has_header: bool = False
    delimiter: str | None = ","
    quote: str = '"'
    missing: float | None = None
    max_rows: int = 0
    max_cols: int = 0


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path).select(F.trim(text).alias("line")).where("line <> '' AND NOT line LIKE '#%' AND NOT line LIKE '//%'")


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """From the first line that is neither blank nor a comment: tab or semicolon where there are strictly most of it, else a comma."""
    first = _lines(spark, path).first()
    line = first[0] if first else ""
    tabs, semicolons, commas = (line.count(c) for c in "\t;,")
    return "\t" if tabs > max(semicolons, commas) else ";" if semicolons > max(tabs, commas) else ","


def _number(field: Column) -> Column:
    return F.regexp_extract(F.trim(field), NUMBER, 0).try_cast("double")


def _names(count: int) -> list[str]:
    return [f"c{i}" for i in range(count)]


def read_csv(spark: SparkSession, path: str, options: CsvOptions = CsvOptions()) -> DataFrame:
    """Numeric columns, named by the header or c0, c1, ... Quoted fields may hold delimiters, doubled quotes and line ends; lines that
    begin with # or // and blank lines are skipped; a field counts up to where it stops being a number; short rows are filled up with
    `missing`, long ones cut to the first row's width."""
    delimiter = options.delimiter or detect_delimiter(spark, path)
    reader = spark.read.option("sep", delimiter).option("quote", options.quote).option("escape", options.quote).option("multiLine", True).option("comment", "#")
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("mode", "PERMISSIVE")
    raw = reader.option("header", False).csv(path)
    if not raw.columns:
        raise ValueError(f"{path}: no data found")
    raw = raw.withColumn(raw.columns[0], F.regexp_replace(raw.columns[0], "^﻿", "")).where(F.col(raw.columns[0]).isNull() | ~F.col(raw.columns[0]).startswith("//"))
    names = _names(len(raw.columns))
    raw = raw.toDF(*names)
    if options.has_header:
        head = raw.first()
        if head is None:
            raise ValueError(f"{path}: no data found")
        titles = [h if h else n for h, n in zip(head, names, strict=True)]
        # the header is a file's first line: the reader itself leaves it out of each file
        body = reader.option("header", True).option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
        raw = body.where(F.col(names[0]).isNull() | ~F.col(names[0]).startswith("//"))
    else:
        titles = names
    raw = raw.where(F.coalesce(*[F.col(n) for n in names]).isNotNull())
    width = options.max_cols if 0 < options.max_cols < len(names) else len(names)
    out = raw.select(*[F.coalesce(_number(F.col(n)), F.lit(options.missing).cast("double")).alias(t) for n, t in zip(names[:width], titles[:width], strict=True)])
    return out.limit(options.max_rows) if options.max_rows > 0 else out


def read_csv_strict(spark: SparkSession, path: str, has_header: bool = False) -> DataFrame:
    """Commas only; a field of the first row's width that is empty or no number fails the read, when its rows are read."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(2).collect()
    if len(first) <= int(has_header):
        raise ValueError(f"{path}: no data found")
    names = [c.strip() for c in first[0][0].split(",")] if has_header else _names(first[0][0].count(",") + 1)
    raw = spark.read.option("header", has_header).option("enforceSchema", True).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    checked = [F.when(F.col(f"`{n}`").try_cast("double").isNull(), F.raise_error(F.concat(F.lit(f"{path}: column {n} holds no number: "), F.coalesce(F.col(f"`{n}`"), F.lit("nothing"))))).otherwise(F.col(f"`{n}`").try_cast("double")).cast("double").alias(n) for n in names]
    return raw.select(*checked)


def headers(spark: SparkSession, path: str, delimiter: str | None = None) -> list[str]:
    first = _lines(spark, path).first()
    return [h.strip().strip('"') for h in first[0].split(delimiter or detect_delimiter(spark, path))] if first else []


def write_csv(df: DataFrame, path: str) -> None:
    """All columns with six decimals, without a header."""
    df.select(*[F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=False)


def write_predictions(df: DataFrame, path: str, column: str = "prediction") -> None:
    """One column under a header; whole numbers as such, others with six decimals."""
    x = F.col(column).cast("double")
    whole = (x == F.rint(x)) & (F.abs(x) < 1e9)
    df.select(F.when(whole, F.format_string("%d", x.cast("long"))).otherwise(F.format_string("%.6f", x)).alias("prediction")).write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    """Histories and learning curves: doubles with ten decimals, in one file, as they have a row for each epoch or size."""
    fields = [F.format_string("%.10f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*fields).coalesce(1).write.mode("overwrite").csv(path, header=True)
