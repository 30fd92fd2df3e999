"""Signal definitions from spreadsheets.

A sheet's columns are mapped to definition fields, cells are normalised, and
rows that can't be are reported with their line. Sheets are small; everything
here is driver-side Python, and the result is a table of text columns.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .blf import open_file
from .definitions import CAN_COLUMNS, ENUM_COLUMNS, SOMEIP_COLUMNS
from .documents import read_sheets

# fixed values: what spreadsheets write for nothing, byte orders and signs
MISSING = frozenset(("", "-", "not available", "n/a", "na", "none", "null", "nan"))
INTEL = frozenset(("intel", "little", "little_endian", "little-endian", "le", "l", "0"))
MOTOROLA = frozenset(("motorola", "big", "big_endian", "big-endian", "be", "m", "b", "1"))
SIGNED = frozenset(("true", "yes", "1", "signed", "t", "y"))
UNSIGNED = frozenset(("false", "no", "0", "unsigned", "f", "n"))


def missing(cell) -> bool:
    return cell is None or str(cell).strip().lower() in MISSING


def whole_number(cell) -> int:
    """0x.., 0b.., ..h, decimal, or a number cell cut to a whole number."""
    if isinstance(cell, (int, float)):
        return int(cell)
    s = str(cell).strip()
    if re.fullmatch(r"[0-9A-Fa-f]+[hH]", s):
        return int(s[:-1], 16)
    if re.fullmatch(r"\d+\.0*", s):  # number cells are stored as text with a fraction
        return int(float(s))
    return int(s, {"0x": 16, "0b": 2}.get(s[:2].lower(), 10))


def identifier(cell) -> str:
    return f"0x{whole_number(cell):X}"


def _token(cell) -> str:
    if isinstance(cell, (bool, str)):
        return str(cell).strip().lower()
    return str(int(cell)) if isinstance(cell, (int, float)) else str(cell).strip().lower()


def byte_order(cell) -> str:
    t = re.sub(r"\.0+$", "", _token(cell))
    if t in INTEL:
        return "Intel"
    if t in MOTOROLA:
        return "Motorola"
    raise ValueError(f"unrecognized byte_order value: {cell!r}")


def sign(cell) -> str:
    t = re.sub(r"\.0+$", "", _token(cell))
    if t in SIGNED or (isinstance(cell, (int, float)) and cell):
        return "true"
    if t in UNSIGNED:
        return "false"
    raise ValueError(f"unrecognized is_signed value: {cell!r}")


def _or_none(read: Callable) -> Callable:
    def inner(cell):
        try:
            return None if missing(cell) else read(cell)
        except ValueError:
            return None

    return inner


def real(cell) -> float:
    return float(cell) if isinstance(cell, (int, float)) else float(str(cell).strip())


READERS: dict[str, Callable] = {
    "message_id": identifier,
    "service_id": identifier,
    "method_id": identifier,
    "pdu_id": lambda c: None if missing(c) else identifier(c),
    "signal_name": lambda c: None if missing(c) else str(c).strip(),
    "start_byte": _or_none(whole_number),
    "start_bit": _or_none(whole_number),
    "bit_length": _or_none(whole_number),
    "byte_order": byte_order,
    "is_signed": sign,
    "scale": lambda c: 1.0 if (v := _or_none(real)(c)) is None else v,
    "offset": lambda c: 0.0 if (v := _or_none(real)(c)) is None else v,
}


def resolve_column(spec: str | int, headers: list[str]) -> int:
    """A column by its 0-based number or its header."""
    text = str(spec).strip()
    if re.fullmatch(r"-?\d+", text) and (isinstance(spec, int) or text not in headers):
        if not 0 <= int(text) < len(headers):
            raise ValueError(f"column {text} is outside of the sheet's {len(headers)} columns")
        return int(text)
    if str(spec) not in headers:
        raise ValueError(f"column {spec!r} not found among {headers}")
    return headers.index(str(spec))


def enum_rows(name: str, coding, meaning, line: int, errors: list[str]) -> list[dict[str, str]]:
    """Pairs of the lines of two cells; the surplus of the longer one is dropped."""
    if missing(coding) or missing(meaning):
        return []
    codes, labels = ([x.strip() for x in str(c).splitlines() if x.strip()] for c in (coding, meaning))
    if len(codes) != len(labels):
        errors.append(f"row {line}: coding/meaning line count mismatch ({len(codes)} vs {len(labels)}) for signal {name!r}; using first {min(len(codes), len(labels))} pair(s)")
    out = []
    for code, label in zip(codes, labels):
        try:
            out.append({"signal_name": name, "raw_value": str(whole_number(code)), "category": label})
        except ValueError:
            errors.append(f"row {line}: unparseable coding value {code!r} for signal {name!r}")
    return out


def convert(rows: list[list], mapping: dict[str, str | int], mode: str, header_row: int = 0) -> tuple[list[dict], list[dict], list[str]]:
    """(signal rows, enum rows, errors) of a sheet. Rows without id or name are
    blank; a row's first error is reported; rows lacking a required field, or
    with a negative position or an empty length, are left out."""
    headers = [str(c) if c is not None else f"Unnamed: {i}" for i, c in enumerate(rows[header_row] if len(rows) > header_row else [])]
    at = {f: resolve_column(spec, headers) for f, spec in mapping.items() if spec is not None}
    ids = ["message_id"] if mode == "can" else ["service_id", "method_id"]
    required = [*ids, "signal_name", "start_byte", "start_bit", "bit_length", "byte_order", "is_signed"]
    columns = CAN_COLUMNS if mode == "can" else SOMEIP_COLUMNS
    signals, enums, errors = [], [], []
    late: list[str] = []
    for line, cells in enumerate(rows[header_row + 1 :], header_row + 2):
        cell = {f: cells[i] if i < len(cells) else None for f, i in at.items()}
        if missing(cell.get(ids[0])) or missing(cell.get("signal_name")):
            continue
        value, error = {"scale": 1.0, "offset": 0.0}, None
        for f, read in READERS.items():
            if f not in cell:
                continue
            try:
                value[f] = read(cell[f])
            except (ValueError, TypeError) as e:
                error = error or str(e)
        if error:
            errors.append(f"row {line}: {error}")
            continue
        if any(value.get(f) is None for f in required):
            continue
        wrong = [f for f, least in (("start_byte", 0), ("start_bit", 0), ("bit_length", 1)) if value[f] < least]
        if wrong:
            late += [f"row {line}: column {f!r} is out of range (value: {value[f]!r})" for f in wrong]
            continue
        signals.append({c: "" if value.get(c) is None else str(value[c]) for c in columns if c != "pdu_id" or "pdu_id" in at})
        if "coding" in at and "meaning" in at:
            enums += enum_rows(value["signal_name"], cell["coding"], cell["meaning"], line, errors)
    return signals, enums, errors + late


def decrypted(raw: bytes, password: str | None) -> bytes:
    if not password:
        return raw
    try:
        import msoffcrypto
    except ImportError as e:
        raise ImportError("password-protected workbooks need the msoffcrypto-tool package") from e
    book, out = msoffcrypto.OfficeFile(io.BytesIO(raw)), io.BytesIO()
    book.load_key(password=password)
    book.decrypt(out)
    return out.getvalue()


def load_sheet(path: str, sheet: str | int = 0, password: str | None = None) -> list[list]:
    """The rows of one sheet, by name or number."""
    with open_file(path) as f:
        sheets = read_sheets(decrypted(f.read(), password))
    titles = [t for t, _ in sheets]
    text = str(sheet)
    k = titles.index(text) if text in titles else int(text) if text.isdigit() and int(text) < len(sheets) else None
    if k is None:
        raise ValueError(f"sheet {sheet!r} not found among {titles}")
    return sheets[k][1]


def defs_from_sheet(spark: SparkSession, path: str, mapping: dict[str, str | int], mode: str = "can", sheet: str | int = 0, header_row: int = 0, password: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(definitions, enums, errors): both tables of text columns, ready for
    ``definitions.load`` or to overwrite a table."""
    signals, enums, errors = convert(load_sheet(path, sheet, password), mapping, mode, header_row)
    columns = CAN_COLUMNS if mode == "can" else SOMEIP_COLUMNS
    text = ", ".join(f"{c} string" for c in columns)
    defs = spark.createDataFrame([tuple(s.get(c, "") for c in columns) for s in signals], text)
    return defs, spark.createDataFrame([tuple(e[c] for c in ENUM_COLUMNS) for e in enums], ", ".join(f"{c} string" for c in ENUM_COLUMNS)), errors
