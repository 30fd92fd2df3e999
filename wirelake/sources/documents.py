"""Document text: PDF pages, DOCX documents, PPTX slides, XLSX sheets.

Office files are zip archives of XML and are read with the standard library.
PDF text is taken by ``pypdf`` where installed, else from the page streams'
text operators (uncompressed or Flate streams with simple encodings only).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "_source_file string, _file_mtime timestamp, _file_size_bytes long, _ingested_at timestamp, doc_type string, section_number int, section_label string, text string"
Section = tuple[int, str, str]

_LOCAL = re.compile(r"\{.*\}")


def _tag(e) -> str:
    return _LOCAL.sub("", e.tag)


def _each(root, name: str):
    return (e for e in root.iter() if _tag(e) == name)


def _number(name: str) -> int:
    return int(re.sub(r"\D", "", name) or 0)


def docx_sections(raw: bytes) -> list[Section]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    body = next(_each(root, "body"), root)
    lines = []
    for p in (e for e in body if _tag(e) == "p"):
        parts = [{"t": e.text or "", "tab": "\t", "br": "\n"}.get(_tag(e), "") for e in p.iter()]
        lines.append("".join(parts))
    return [(1, "Document", "\n".join(x for x in lines if x))]


def pptx_sections(raw: bytes) -> list[Section]:
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
        for i, name in enumerate(slides, 1):
            texts = []
            for body in _each(ElementTree.fromstring(z.read(name)), "txBody"):
                lines = ["".join(t.text or "" for t in _each(p, "t")) for p in _each(body, "p")]
                texts.append("\n".join(lines))
            out.append((i, f"Slide {i}", "\n".join(t for t in texts if t)))
    return out


def column_of(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def read_sheets(raw: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(title, rows of cell texts) of each sheet, in the workbook's order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in _each(si, "t")) for si in _each(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")]
        targets = {}
        if "xl/_rels/workbook.xml.rels" in names:
            for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                target = r.get("Target", "")
                targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        out = []
        for k, sheet in enumerate(_each(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet"), 1):
            link = next((v for a, v in sheet.attrib.items() if a.endswith("}id")), None)
            path = targets.get(link, f"xl/worksheets/sheet{k}.xml")
            rows = []
            for row in _each(ElementTree.fromstring(z.read(path)), "row") if path in names else ():
                at = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - len(rows))]
                cells = rows[at - 1]
                for c in _each(row, "c"):
                    column = column_of(c.get("r") or "") if c.get("r") else len(cells)
                    cells += [None] * (column + 1 - len(cells))
                    value = next((v.text for v in _each(c, "v")), None)
                    kind = c.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in _each(c, "t"))
                    elif kind == "b" and value is not None:
                        value = "True" if value == "1" else "False"
                    cells[column] = value
            out.append((sheet.get("name") or f"Sheet{k}", rows))
    return out


def xlsx_sections(raw: bytes) -> list[Section]:
    out = []
    for i, (title, rows) in enumerate(read_sheets(raw), 1):
        lines = ["\t".join(c for c in row if c is not None) for row in rows]
        out.append((i, f"Sheet '{title}'", "\n".join(x for x in lines if x)))
    return out


_TEXT_OP = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")|\[((?:\\.|[^\]])*)\]\s*TJ|(T\*|Td|TD|ET)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.S)


def _unescape(raw: bytes) -> str:
    def one(m):
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(x, x)

    return _ESCAPE.sub(one, raw).decode("latin-1")


def _stream_text(stream: bytes) -> str:
    out = []
    for single, several, move in _TEXT_OP.findall(stream):
        if move:
            out.append("\n")
        elif several:
            out.append("".join(_unescape(s) for s in _STRING.findall(several)))
        else:
            out.append(_unescape(single))
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def pdf_sections(raw: bytes) -> list[Section]:
    try:
        import pypdf
    except ImportError:
        pages = []
        for head, body in re.findall(rb"<<((?:(?!stream).)*?)>>\s*stream\r?\n(.*?)endstream", raw, re.S):
            if b"FlateDecode" in head:
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    continue
            if b"BT" in body and (text := _stream_text(body)):
                pages.append(text)
        return [(i, f"Page {i}", t) for i, t in enumerate(pages, 1)]
    return [(i, f"Page {i}", p.extract_text() or "") for i, p in enumerate(pypdf.PdfReader(io.BytesIO(raw)).pages, 1)]


EXTRACTORS: dict[str, tuple[str, Callable[[bytes], list[Section]]]] = {"pdf": ("PDF", pdf_sections), "docx": ("DOCX", docx_sections), "pptx": ("PPTX", pptx_sections), "xlsx": ("XLSX", xlsx_sections)}


def scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Document files under a path, searched recursively."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    return reader.load(path).where(F.lower("path").rlike(r"\.(pdf|docx|pptx|xlsx)$"))


def sections(files: DataFrame) -> DataFrame:
    """One row per section; files that can't be read are reported and skipped."""

    def run(batches):
        for b in batches:
            rows = []
            for f in b.to_pylist():
                kind, extract = EXTRACTORS.get(f["path"].rsplit(".", 1)[-1].lower(), (None, None))
                if kind is None:
                    continue
                try:
                    found = extract(f["content"])
                except Exception as e:  # noqa: BLE001
                    print(f"{f['path']} not read: {e}")
                    continue
                rows += [(f["path"], f["modificationTime"], f["length"], kind, *s) for s in found]
            columns = list(zip(*rows)) or [()] * 7
            types = [pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["_source_file", "_file_mtime", "_file_size_bytes", "doc_type", "section_number", "section_label", "text"])

    schema = "_source_file string, _file_mtime timestamp, _file_size_bytes long, doc_type string, section_number int, section_label string, text string"
    found = files.select("path", "modificationTime", "length", "content").mapInArrow(run, schema)
    return found.withColumn("_ingested_at", F.current_timestamp()).select(*[x.split()[0] for x in SECTIONS.split(", ")])


def with_section_id(rows: DataFrame) -> DataFrame:
    """A key that is the same whenever a file's version is read again."""
    parts = ["_source_file", F.coalesce(F.col("_file_mtime").cast("string"), F.lit("")), F.coalesce(F.col("_file_size_bytes").cast("string"), F.lit("")), F.col("section_number").cast("string")]
    return rows.withColumn("section_id", F.sha2(F.concat_ws("||", *parts), 256))


def new_sections(source: DataFrame, target: DataFrame) -> DataFrame:
    """What an insert-only merge on ``section_id`` appends."""
    return source.join(target.select("section_id"), "section_id", "left_anti")


def merge_sections(source: DataFrame, path: str) -> int:
    """Appends new sections to a Parquet table; their number."""
    spark = source.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception:  # noqa: BLE001  no table yet
        target = None
    added = source.dropDuplicates(["section_id"]) if target is None else new_sections(source.dropDuplicates(["section_id"]), target)
    before = 0 if target is None else target.count()
    added.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
