"""Document fingerprints: SimHash.

Terms are words and word pairs. A term's hash votes on each of 128 signed bits
with the term's weight, which grows with the logarithm of its count; words
weigh by their length, so that function words hardly count. A bit is set when
its votes are positive. Fingerprints within a Hamming radius r agree on one of
r + 1 blocks of bits, so tables sorted by each block in turn find them all.

Cases: null texts equal empty ones; a text without words has fingerprint 0.
Equal texts have equal fingerprints. Documents are ordered by descending id,
nulls last; rows with one id by a hash of the text. A sole document is its own
next one. An empty table gives no rows. Texts of any length are read whole,
their votes in chunks of bounded memory. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TermCache, mix64, stored, text_or_empty

BITS = 128
CHUNK = 32_768
RADIUS = 3

_WORD = re.compile(r"\w+")
_cache = TermCache(lambda w: xxhash.xxh64_intdigest(w) & ~15 | min(len(w), 15))
_K = np.uint64(0x9E3779B97F4A7C15)
_WEIGHT = np.array([min(n, 8) ** 2 / 64 for n in range(16)])


def fingerprint(text: str) -> int:
    words = _WORD.findall(text.lower())
    if not words:
        return 0
    h = _cache.array(words)
    terms, counts = np.unique(h, return_counts=True)
    pairs, pair_counts = np.unique((h[:-1] * _K) ^ (h[1:] + (h[1:] << np.uint64(7))), return_counts=True)
    weights = np.concatenate([_WEIGHT[(terms & np.uint64(15)).astype(int)] * (1 + np.log(counts)), 1 + np.log(pair_counts)])
    weights = np.maximum(1, np.rint(16 * weights)).astype(np.float32)
    low = mix64(np.concatenate([terms, pairs]))
    hashes = np.stack([low, mix64(low + _K)], axis=1)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(low), CHUNK):  # whole numbers under 2^24: exact in any order
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8), axis=1).astype(np.float32)
        w = weights[at : at + CHUNK]
        votes += (2 * (w @ bits) - w.sum()).astype(np.int64)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    """Share of equal bits."""
    return 1 - (a ^ b).bit_count() / BITS


def as_hex(f: int) -> str:
    return f"{f:0{BITS // 4}x}"


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the next text's first."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _row(doc, text: str, own: int, following: str, next_print: int) -> tuple:
    changed = edited(text, following)
    e = fingerprint(changed) if changed != text else own
    return doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), as_hex(own), as_hex(e), likeness(own, e), likeness(own, next_print)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, fingerprint) for every row."""

    def run(batches):
        for b in batches:
            prints = [as_hex(fingerprint(t.as_py())) for t in b.column("__text")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(prints, pa.string())], names=[*keep, "fingerprint"])

    picked = docs.select(*keep, text_or_empty().alias("__text"))
    schema = ", ".join(f"`{n}` {picked.schema[n].dataType.simpleString()}" for n in keep)
    return picked.mapInArrow(run, f"{schema}, fingerprint string")


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Every document beside its successor by descending id: own fingerprint,
    that of the edited text, likeness to that and to the successor's.

    One range exchange brings neighbours together. Each task keeps one row in
    hand; its first and last row go to a small table with their texts, where
    the ends of adjoining tasks meet."""
    arrow = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in _NAMES[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])

    def run(batches):
        part, held, rows = TaskContext.get().partitionId(), None, []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                own = held[2] if held and held[1] == text else fingerprint(text)
                if held is None:
                    rows.append((part, 1, None, None, None, as_hex(own), None, None, None, text))
                else:
                    rows.append((part, 0, *_row(*held, text, own), None))
                held = (doc, text, own)
            yield _batch(rows, arrow)
            rows = []
        if held:
            yield _batch([(part, 2, held[0], None, None, as_hex(held[2]), None, None, None, held[1])], arrow)

    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    done = stored(dealt.mapInArrow(run, f"part int, kind int, {RESULT}, text string"))
    # one int per task; text stays out of the window
    parts = done.where("kind = 1").select("part")
    wrap = parts.agg(F.min("part").alias("first"))
    following = F.lead("part").over(Window.orderBy("part"))
    nexts = parts.select("part", following.alias("n")).crossJoin(F.broadcast(wrap)).select("part", F.coalesce("n", "first").alias("next"))
    heads = done.where("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    tails = done.where("kind = 2").select("part", "doc_id", "text", "fingerprint").join(nexts, "part").join(heads, "next")

    def finish(batches):
        for b in batches:
            yield _batch([_row(r["doc_id"], r["text"], int(r["fingerprint"], 16), r["next_text"], int(r["next_print"], 16)) for r in b.to_pylist()], pa.schema(list(arrow)[2:-1]))

    return done.where("kind = 0").select(*_NAMES).unionByName(tails.mapInArrow(finish, RESULT))


def _halves(name: str = "fingerprint") -> list:
    return [F.expr(f"cast(conv(substr({name}, {1 + 16 * i}, 16), 16, -10) as long)").alias(f"b{i}") for i in range(BITS // 64)]


def _blocks(prints: DataFrame, radius: int) -> DataFrame:
    """One row per block of bits: (block, value) is the key of a sorted table."""
    n, width = radius + 1, BITS // 4
    cut = [(width * i // n, width * (i + 1) // n) for i in range(n)]
    blocks = F.array(*(F.struct(F.lit(i).alias("block"), F.substring("fingerprint", a + 1, b - a).alias("value")) for i, (a, b) in enumerate(cut)))
    return prints.select("fingerprint", *[c for c in prints.columns if c not in ("fingerprint", "__b")], *_halves(), F.explode(blocks).alias("__b")).select("*", "__b.*").drop("__b")


def within_radius(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fingerprint, distance): all distinct fingerprints of ``prints``
    within ``radius`` bits of each distinct fingerprint of ``queries``. The block
    tables are joined on (block, value); the distance is tested in the join,
    and a pair that meets in several blocks is taken from the first only."""
    if not 0 <= radius < BITS // 4:
        raise ValueError(f"radius has to be under {BITS // 4}")
    every = _blocks(prints.select("fingerprint").distinct(), radius)
    asked = _blocks(queries.select("fingerprint").distinct(), radius).select(F.col("block").alias("qblock"), F.col("value").alias("qvalue"), F.col("fingerprint").alias("query"), *(F.col(f"b{i}").alias(f"q{i}") for i in range(BITS // 64)))
    away = sum((F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(BITS // 64)), F.lit(0))
    met = asked.join(every, (F.col("qblock") == F.col("block")) & (F.col("qvalue") == F.col("value")) & (away <= radius))
    return met.select("query", "fingerprint", away.alias("distance")).distinct()
