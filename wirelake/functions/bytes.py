"""Expressions over binary columns and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def u8(data, offset) -> Column:
    """The byte at a 0-based offset (number or column), NULL beyond the end."""
    data, at = col(data), offset if isinstance(offset, Column) else F.lit(offset)
    return F.when(F.length(data) > at, F.conv(F.hex(F.substr(data, at + 1, F.lit(1))), 16, 10).cast("int"))


def u16(data, offset) -> Column:
    """Two bytes, big-endian."""
    return number(data, offset, 2).cast("int")


def u32(data, offset) -> Column:
    return number(data, offset, 4)


def number(data, offset, width: int) -> Column:
    """``width`` bytes, big-endian, as a long; NULL beyond the end."""
    data, at = col(data), offset if isinstance(offset, Column) else F.lit(offset)
    return F.when(F.length(data) >= at + width, F.conv(F.hex(F.substr(data, at + 1, F.lit(width))), 16, 10).cast("long"))


def tail(data, offset) -> Column:
    """The bytes from an offset on."""
    data, at = col(data), offset if isinstance(offset, Column) else F.lit(offset)
    return F.substr(data, at + 1, F.greatest(F.length(data) - at, F.lit(0)))


def hex_id(c, digits: int) -> Column:
    """0x-prefixed upper-case hexadecimal of fixed width; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.format_string(f"0x%0{digits}X", c))


def mac(c) -> Column:
    """XX:XX:XX:XX:XX:XX"""
    c = col(c)
    return F.concat_ws(":", *(F.hex(F.substring(c, i, 1)) for i in range(1, 7)))


def ipv4(data, offset) -> Column:
    return F.concat_ws(".", *(u8(data, offset + i).cast("string") for i in range(4)))


def ipv6(data, offset) -> Column:
    """Eight groups of four digits, not shortened."""
    data = col(data)
    return F.concat_ws(":", *(F.lower(F.hex(F.substr(data, F.lit(1 + 2 * i) + offset, F.lit(2)))) for i in range(8)))


def hex_preview(data, most: int = 16) -> Column:
    """The first bytes, space-separated, with an ellipsis where cut."""
    data = col(data)
    shown = F.trim(F.regexp_replace(F.hex(F.substring(data, 1, most)), "(..)", "$1 "))
    return F.when(F.length(data) > most, F.concat(shown, F.lit("..."))).otherwise(shown)


def parse_id(text) -> Column:
    """0x-prefixed hexadecimal or decimal text as a long, NULL otherwise."""
    t = F.trim(col(text))
    return F.when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("long")).when(t.rlike("^[0-9]{1,18}$"), t.cast("long"))


def parse_id_or_hex(text) -> Column:
    """As ``parse_id``; bare digits with letters (1A) are hexadecimal."""
    t = F.trim(col(text))
    return F.coalesce(parse_id(t), F.when(t.rlike("^[0-9a-fA-F]{1,15}$"), F.conv(t, 16, 10).cast("long")))


def parse_flexible_int(text) -> Column:
    """0x.., 0b.., ..h, decimals and floats (cut to whole numbers)."""
    t = F.lower(F.trim(col(text)))
    return (
        F.when(t.rlike("^0x[0-9a-f]{1,15}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast("long"))
        .when(t.rlike("^0b[01]{1,62}$"), F.conv(F.substring(t, 3, 64), 2, 10).cast("long"))
        .when(t.rlike("^[0-9a-f]{1,15}h$"), F.conv(F.regexp_replace(t, "h$", ""), 16, 10).cast("long"))
        .when(t.rlike(r"^[+-]?[0-9]{1,18}(\.[0-9]*)?$"), F.regexp_replace(t, r"\..*$", "").cast("long"))
    )


def direction(c="dir") -> Column:
    return F.when(col(c) == 0, "Tx").when(col(c) == 1, "Rx").otherwise("TxRq")


def file_stem(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]+)\.[^./]+$", 1)


def is_diagnostic(can_id) -> Column:
    """ISO 15765-4 ids: 0x7DF-0x7EF and 0x18DAxxxx."""
    c = col(can_id)
    return c.between(0x7DF, 0x7EF) | (c.bitwiseAND(F.lit(0xFFFF0000)) == 0x18DA0000)


def display_source(c="signal_source") -> Column:
    return F.when(col(c) == "SOMEIP", "ETH").otherwise(col(c))


def signal_key(source="signal_source", channel="channel", name="signal_name") -> Column:
    """source|channel|name, with - for a missing channel."""
    return F.concat_ws("|", col(source), F.coalesce(col(channel).cast("string"), F.lit("-")), col(name))


def parse_plot_key(key) -> Column:
    """{source}{channel}::{name} as (source, channel, name); channel 0 where missing."""
    k = col(key)
    number = F.regexp_extract(k, r"^[A-Za-z_]+(\d+)::", 1)
    return F.struct(
        F.regexp_extract(k, r"^([A-Za-z_]+)\d*::", 1).alias("source"),
        F.when(number == "", 0).otherwise(number.cast("int")).alias("channel"),
        F.regexp_extract(k, r"^[A-Za-z_]+\d*::(.*)$", 1).alias("name"),
    )
