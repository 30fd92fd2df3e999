"""Definition tables: signals, enums, channel names.

Definitions are CSV files or tables of text columns. Files are read with their
line numbers, so that validation can name them; the typed tables are plain
projections of the checked text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelake.functions.bytes import parse_id

CAN_COLUMNS = ["message_id", "signal_name", "start_byte", "start_bit", "bit_length", "byte_order", "is_signed", "scale", "offset", "pdu_id"]
SOMEIP_COLUMNS = ["service_id", "method_id", *CAN_COLUMNS[1:9]]
ENUM_COLUMNS = ["signal_name", "raw_value", "category"]
CHANNEL_COLUMNS = ["type", "channel", "name"]
COLUMNS = {"can": CAN_COLUMNS, "someip": SOMEIP_COLUMNS, "enum": ENUM_COLUMNS, "channel": CHANNEL_COLUMNS}


class DefinitionError(ValueError):
    """The first error of a definition file, with its line."""


def lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(line, n_fields, the columns as trimmed text) of the data lines of a CSV
    file. Definition files are small: they are read as one text."""
    names = COLUMNS[kind]
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "raw"))
    data = text.select((F.col("at") + 1).alias("line"), F.trim("raw").alias("raw"))
    data = data.where((F.col("raw") != "") & ~F.col("raw").startswith("#") & ~F.col("raw").startswith(names[0]))
    parts = data.withColumn("p", F.split("raw", ","))
    return parts.select("line", F.size("p").alias("n_fields"), *(F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)))


def table_lines(df: DataFrame, kind: str) -> DataFrame:
    """The same from a table of text columns."""
    names = COLUMNS[kind]
    n = sum(c in df.columns for c in names)
    line = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1  # small by contract
    return df.select(line.alias("line"), F.lit(n).alias("n_fields"), *(F.trim(F.col(c).cast("string")).alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names))


def _whole(name: str, most: int = 2**32 - 1) -> Column:
    """A message where the text is no unsigned whole number."""
    bad = parse_id(name).isNull() | (parse_id(name) > most)
    hint = F.when(F.contains(name, F.lit(".")), F.lit(" (must be a whole number, not a decimal; if this came from a spreadsheet, format the column as integer or text)")).otherwise("")
    return F.when(F.coalesce(bad, F.lit(True)), F.concat(F.lit(f'invalid {name}: "'), F.coalesce(F.col(name), F.lit("")), F.lit('"'), hint))


def _real(name: str) -> Column:
    """A message where the text is neither blank nor a number."""
    blank = F.coalesce(F.col(name), F.lit("")) == ""
    return F.when(~blank & F.expr(f"try_cast(`{name}` as double)").isNull(), F.concat(F.lit(f'invalid {name}: "'), F.col(name), F.lit('"')))


def _one_of(name: str, allowed: list[str], hint: str) -> Column:
    low = F.lower(F.coalesce(F.col(name), F.lit("")))
    return F.when(~low.isin(allowed), F.concat(F.lit(f'invalid {name}: "'), F.coalesce(F.col(name), F.lit("")), F.lit(f'", expected {hint}')))


def _checks(kind: str) -> list[Column]:
    least = {"can": 9, "someip": 10, "enum": 3, "channel": 3}[kind]
    few = F.when(F.col("n_fields") < least, F.concat(F.lit(f"expected at least {least} columns, got "), F.col("n_fields")))
    if kind == "enum":
        empty = F.when(F.coalesce(F.col("category"), F.lit("")) == "", F.lit("category is empty"))
        return [few, _whole("raw_value", 2**62), empty]
    if kind == "channel":
        return [few, _one_of("type", ["can", "ethernet"], "CAN or Ethernet"), _whole("channel", 2**16 - 1)]
    ids = [_whole("message_id")] if kind == "can" else [_whole("service_id", 2**16 - 1), _whole("method_id", 2**16 - 1)]
    fields = [*(_whole(c) for c in ("start_byte", "start_bit", "bit_length")), _one_of("byte_order", ["intel", "motorola"], "Intel or Motorola"), _one_of("is_signed", ["true", "false", "1", "0"], "true/false/1/0"), _real("scale"), _real("offset")]
    wide = F.when(parse_id("bit_length") > 64, F.concat(F.lit("bit_length "), F.col("bit_length"), F.lit(" is over 64")))
    pdu = [F.when(F.coalesce(F.col("pdu_id"), F.lit("")) != "", _whole("pdu_id"))] if kind == "can" else []
    return [few, *ids, *fields, wide, *pdu]


def check(rows: DataFrame, kind: str) -> DataFrame:
    """(line, message): all errors of all lines. A line with too few columns
    has that error only. For CAN also ids with both regular and container rows."""
    few, *rest = _checks(kind)
    found = rows.select("line", F.when(few.isNotNull(), F.array(few)).otherwise(F.array(*rest)).alias("messages"))
    errors = found.select("line", F.explode("messages").alias("message")).where("message is not null")
    if kind == "can":
        ids = rows.select("line", parse_id("message_id").alias("id"), (F.coalesce(F.col("pdu_id"), F.lit("")) != "").alias("in_container")).where("id is not null")
        mixed = ids.groupBy("id").agg(F.min("in_container").alias("a"), F.max("in_container").alias("b"), F.min("line").alias("line")).where("a <> b")
        errors = errors.unionByName(mixed.select("line", F.concat(F.lit("message_id 0x"), F.hex("id"), F.lit(" has both regular and container-frame rows; its regular rows are not decoded")).alias("message")))
    if kind == "channel":
        again = rows.groupBy(F.lower("type").alias("type"), parse_id("channel").alias("channel")).agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 1")
        errors = errors.unionByName(again.select("line", F.concat(F.lit("duplicate channel "), F.col("type"), F.lit(" "), F.col("channel")).alias("message")))
    return errors.orderBy("line", "message")


def check_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return check(lines(spark, path, kind), kind)


def detect_kind(first_line: str) -> str | None:
    """The kind of a CSV file by its header."""
    head = [x.strip().lower() for x in first_line.split(",")]
    return next((k for k, names in COLUMNS.items() if head[: min(3, len(names))] == names[: min(3, len(names))]), None)


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """The typed table of checked lines, in file order."""
    def real(name: str, default: float) -> Column:
        return F.coalesce(F.expr(f"try_cast(nullif(`{name}`, '') as double)"), F.lit(default)).alias(name)

    if kind == "enum":
        return rows.select("signal_name", parse_id("raw_value").cast("decimal(20,0)").alias("raw_value"), "category")
    if kind == "channel":
        return rows.select(F.when(F.lower("type") == "can", "CAN").otherwise("Ethernet").alias("type"), parse_id("channel").cast("int").alias("channel"), "name")
    signal = [
        F.col("signal_name"),
        (parse_id("start_byte") * 8 + parse_id("start_bit")).cast("int").alias("start_bit"),
        parse_id("bit_length").cast("int").alias("bit_length"),
        F.initcap("byte_order").alias("byte_order"),
        F.lower("is_signed").isin("true", "1").alias("is_signed"),
        real("scale", 1.0),
        real("offset", 0.0),
    ]
    if kind == "can":
        return rows.select(parse_id("message_id").alias("message_id"), *signal, parse_id(F.expr("nullif(pdu_id, '')")).alias("pdu_id"))
    return rows.select(parse_id("service_id").cast("int").alias("service_id"), parse_id("method_id").cast("int").alias("method_id"), *signal)


def load(spark: SparkSession, source: str | DataFrame, kind: str) -> DataFrame:
    """A definition table from a CSV path or a table; the first error raises.
    Loading checks what decoding needs, the mixed-id warning is left to ``check``."""
    rows = lines(spark, source, kind) if isinstance(source, str) else table_lines(source, kind)
    few, *rest = _checks(kind)
    bad = rows.select("line", F.coalesce(few, *rest).alias("message")).where("message is not null").orderBy("line").first()
    if bad is None and kind == "channel":
        bad = check(rows, kind).first()
    if bad:
        raise DefinitionError(f"line {bad['line']}: {bad['message']}")
    return typed(rows, kind)


def merge(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """The overlay's rows win on (id[, pdu], name)."""
    keys = [k for k in ("message_id", "service_id", "method_id", "pdu_id", "signal_name") if k in base.columns]
    same = [base[k].eqNullSafe(overlay[k]) for k in keys]
    return base.join(overlay, same, "left_anti").unionByName(overlay)


def container_ids(defs: DataFrame) -> DataFrame:
    return defs.where("pdu_id is not null").select("message_id").distinct().orderBy("message_id")


def canonical(defs: DataFrame) -> DataFrame:
    """The text columns of a definition CSV, regular rows before container rows,
    by id, pdu and name."""
    def real(name: str) -> Column:  # 1 rather than 1.0
        return F.regexp_replace(F.col(name).cast("string"), r"\.0$", "").alias(name)

    ids = [F.concat(F.lit("0x"), F.hex("message_id")).alias("message_id")] if "message_id" in defs.columns else [F.format_string("0x%04X", c).alias(c) for c in ("service_id", "method_id")]
    pdu = [F.when(F.col("pdu_id").isNotNull(), F.concat(F.lit("0x"), F.hex("pdu_id"))).otherwise("").alias("pdu_id")] if "pdu_id" in defs.columns else []
    order = ([F.col("pdu_id").isNotNull(), "message_id", "pdu_id"] if pdu else ["service_id", "method_id"]) + ["signal_name"]
    start = [F.expr("start_bit div 8").alias("start_byte"), F.expr("start_bit % 8").alias("start_bit")]
    return defs.orderBy(*order).select(*ids, "signal_name", *start, "bit_length", "byte_order", "is_signed", real("scale"), real("offset"), *pdu)


def save_table(rows: DataFrame, name: str) -> None:
    """Overwrites a table of definitions, all columns as text."""
    rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns)).write.mode("overwrite").saveAsTable(name)
