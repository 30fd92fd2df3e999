"""Near-duplicate detection: ProbMinHash over sets of shingles.

Each five-word shingle of a text is a Poisson process whose rate is its weight:
its arrivals, seeded by its hash, fall on random registers, and a register keeps
the shingle that arrives first. A shingle stops as soon as its next arrival lies
beyond the latest first arrival of all registers, so most stop after one. Two
texts agree on a register with their probability Jaccard. Links are decided by
the Jaccard similarity of the shingle sets, so every shingle weighs 1 however
often it repeats: then both similarities are the same. 28 bands of 5 registers
make candidates, which are verified exactly (0.8 or more). A pair at 0.8 is
missed by the bands with a chance of about 1.5e-5, whatever repeats in it.

Texts with equal words are one node. A class needs only links that span it, so
no group is expanded into its pairs:

1. In each band bucket every node is compared with the bucket's least node;
   verified links give connected components.
2. Buckets that still hold several components are cut finer by bits of a sketch,
   in several ways; every node is compared with one representative of each of
   its parts. Both steps compare a node as often as it has bands, however large
   its bucket is.
3. What is left are pairs in one bucket but in different components. They are
   found by their rare shingles: two sets with a similarity t share one of the
   (1 - t)|x| + 1 shingles of each that the fewest other sets hold, and those
   shingles' ranks bound what the sets can share. An equi-join on such shingles
   finds the pairs that can reach t, which are verified too. No bucket or
   posting is gathered in one task: the join's hot shingles can be split.

Every link between different texts thus ends in one class, with no cap on
buckets or partners.

Cases: null texts equal empty ones. A text of one to four words has one
shingle, of all its words; texts without words stay alone. Very long texts are
read whole, a worker holds one group of them at a time. Ties and repeated
rows are in one class; the class is named by its largest doc_id, whose row is
kept (one of them, where it repeats). Null ids never name a class that has
another. An empty table gives no rows. Other columns are ignored, whatever their
names, and kept by ``drop_near_copies``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, TermCache, mix64, small, stored, text_or_empty, without

WORDS = 5
SIMILARITY = 0.8
BANDS, PER_BAND = 28, 5
REGISTERS = BANDS * PER_BAND
#: At a similarity of 0.8 a bit of the sketch differs with a chance of 0.1: more
#: than 36 of 128 do with one of 2e-9.
SKETCH_BITS, SKETCH_MOST = 128, 36
#: Ways in which a bucket that holds several components is cut finer.
CUTS = 4
ROUNDING = 1e-9
#: Up to so many edges the components are found by the driver, beyond in jobs.
MOST_LOCAL = 100_000
#: A worker holds the shingles of so many documents, and the registers of so many elements.
SLICE, GROUP_ELEMENTS = 2000, 1 << 17

_WORD = re.compile(r"\w+")
_cache = TermCache(xxhash.xxh64_intdigest)
_K = np.uint64(0x9E3779B97F4A7C15)
_MULT = [np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64)) for k in range(1, WORDS + 1)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str]) -> np.ndarray:
    """64-bit hashes of all shingles, with repeats."""
    if not words:
        return np.empty(0, np.uint64)
    h, width = _cache.array(words), min(WORDS, len(words))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += h[k : n + k] * _MULT[k]
    return mix64(total)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], m: int = REGISTERS, seed: int = 0) -> np.ndarray:
    """Registers (rows of m shingle hashes) of non-empty weighted sets, given as
    (hashes, weights). All sets advance together, one arrival per round."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    first = np.full(len(sets) * m, np.inf)
    holder = np.zeros(len(sets) * m, np.uint64)
    at, turn = np.zeros(len(element)), 0
    while len(element):
        turn += 1
        r = mix64(element + np.uint64(0x9E3779B97F4A7C15 * (turn + seed * 1_000_003) & MASK64))
        at = at - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) / weight
        slot = doc * m + ((r & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        np.minimum.at(first, slot, at)
        won = first[slot] == at
        holder[slot[won]] = element[won]
        live = at < first.reshape(-1, m).max(axis=1)[doc]
        doc, element, weight, at = doc[live], element[live], weight[live], at[live]
    return holder.reshape(-1, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, which holds the band's number too."""
    parts = sig.reshape(len(sig), BANDS, PER_BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _K + np.zeros((len(sig), 1), np.uint64)
    for k in range(PER_BAND):
        key = mix64(key ^ (parts[:, :, k] + _MULT[k]))
    return key.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each of 128 registers, as two 64-bit numbers a row."""
    bits = (mix64(sig[:, :SKETCH_BITS]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def name_of(words: list[str]) -> tuple[int, int] | None:
    """128 bits of a cryptographic hash, in two halves."""
    if not words:
        return None
    digest = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, h1, h2, keys, s0, s1) for every row; h1, h2 name the
    words. They and the rest are null for texts without words."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64())), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(batches):
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            rows = []
            for i, t in enumerate(b.column("t")):
                words = words_of(t.as_py())
                h = np.unique(shingles(words))
                rows.append((len(h), i, name_of(words) or (None, None), h))
            rows.sort(key=lambda r: r[0])  # sets of like size take a like number of rounds
            ids, keys_of = b.column("doc_id"), b.column("text_key")
            at = 0
            while at < len(rows):
                end, load = at, 0
                while end < len(rows) and (end == at or load + rows[end][0] <= GROUP_ELEMENTS):
                    load += rows[end][0]
                    end += 1
                group = rows[at:end]
                at = end
                filled = [r for r in group if r[0]]
                empty = len(group) - len(filled)  # they come first
                keys, s = [None] * empty, [(None, None)] * empty
                if filled:
                    sig = signatures([(r[3], np.ones(r[0])) for r in filled])
                    keys += list(bands(sig))
                    s += sketch(sig).tolist()
                take = pa.array([r[1] for r in group])
                names = (pa.array(x, pa.int64()) for x in zip(*(r[2] for r in group)))
                yield pa.RecordBatch.from_arrays([ids.take(take), keys_of.take(take), *names, pa.array(keys, arrow.field("keys").type), *(pa.array(x, pa.int64()) for x in zip(*s))], schema=arrow)

    picked = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("t")).withColumn("text_key", F.xxhash64("t"))
    return picked.mapInArrow(run, "doc_id long, text_key long, h1 long, h2 long, keys array<long>, s0 long, s1 long")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per set of words, numbered: (node, h1, h2, keys, s0, s1, rep).
    The numbers are those written, whatever order a repeated task would give."""
    each = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("keys").alias("keys"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.max("doc_id").alias("rep"))
    return stored(each.withColumn("node", F.monotonically_increasing_id()))


def _shingle_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, recomputed from the texts of their
    representatives, so that the sets of all other texts are never stored."""
    named = stored(nodes.join(wanted, "node", "left_semi").select("node", "h1", "h2", "rep"))
    ids = named.select("rep").where("rep is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("t"))
    known = texts.join(small(ids), texts.doc_id == ids.rep, "left_semi")

    def run(batches):
        for b in batches:
            rows = [(*name_of(w), np.unique(shingles(w)).tobytes()) for t in b.column(0) if (w := words_of(t.as_py()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)] + [pa.array([r[2] for r in rows], pa.binary())], ["h1", "h2", "shingles"])

    found = known.unionByName(texts.where("doc_id is null")).select("t").mapInArrow(run, "h1 long, h2 long, shingles binary")
    return stored(found.join(named.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "shingles").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose exact Jaccard similarity reaches the bound."""

    def run(batches):
        for b in batches:
            reached = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                reached.append(both >= similarity * (len(x) + len(y) - both) - ROUNDING)
            kept = b.select(["a", "b"]).filter(pa.array(reached, pa.bool_()))
            yield kept

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node linked to each) of the edges (u, v)."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[u], root[v]
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``edges`` (a, b; stored): comp is the least
    node linked to it. A few edges are brought to the driver, since each job costs
    more than they do; with more they stay where they are."""
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() > MOST_LOCAL:
        return _components_by_stars(edges)
    met = edges.toArrow()
    nodes, comps = least_linked(*(met.column(c).to_numpy() for c in ("a", "b")))
    return edges.sparkSession.createDataFrame(pa.table({"node": nodes, "comp": comps}))


def _components_by_stars(edges: DataFrame) -> DataFrame:
    """The same by alternating large and small stars. Aggregates are stored before
    they are joined, so that a hub's rows can be split in the join."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame | None:
    """Verified links (a, b) whose components are the classes; None without any."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"))
    members = stored(keyed.join(buckets, "key"))
    wanted = stored(members.select("node").distinct())
    if wanted.isEmpty():
        return None
    sets = _shingle_sets(docs, nodes, wanted)
    pairs = stored(members.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    found = _verified(pairs, sets, similarity)
    # the only pair of a bucket of two is known now, and so are the least node's
    apart = _apart(members.where("n > 2").select("key", "node", "least"), components(found)).where("node <> least").drop("least")
    apart = stored(apart)
    if apart.isEmpty():
        return found
    found = stored(found.unionByName(_verified(_finer_pairs(apart, nodes), sets, similarity)))
    apart = _apart(apart.select("key", "node"), components(found))
    left = apart.groupBy("node", "comp").agg(F.max(F.col("comp") != F.col("major")).alias("minor"))
    rare = _rare_shingles(stored(left.join(nodes.select("node", "s0", "s1"), "node")), sets, similarity)
    return found.unionByName(_verified(_meeting(rare, similarity), sets, similarity))


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``members`` (key, node, ..) of buckets that hold several components, with
    their component and ``major``, the bucket's largest."""
    comps = stored(comps).withColumnRenamed("node", "cnode")
    inside = members.join(comps, members.node == comps.cnode, "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))
    inside = stored(inside)
    sizes = stored(inside.groupBy("key", "comp").agg(F.count("*").alias("size")))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "comp")).alias("top"), F.count("*").alias("n_comps")).where("n_comps > 1")
    return inside.join(stored(mixed.select("key", F.col("top.comp").alias("major"))), "key")


def _finer_pairs(apart: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): each node with the representative of its part of a bucket, where
    it is of another component. A bucket is cut into parts in ``CUTS`` ways,
    each by 6 bits of the nodes' sketches."""
    own = stored(apart.join(nodes.select("node", "s0", "s1"), "node"))
    cut = own.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))  # a fixed number
    at = "cast(pmod(xxhash64(key, cut), 58) as int)"
    part = F.expr(f"xxhash64(key, cut, shiftright(if(cut % 2 = 0, s0, s1), {at}) & 63)")
    mixed = F.expr("node ^ (xxhash64(cut) & 0xFFFFFFFFFF)".replace("0xFFFFFFFFFF", str((1 << 40) - 1)))  # another least node for each cut
    parts = stored(cut.select("node", "comp", part.alias("part"), mixed.alias("order"), "cut"))
    first = stored(parts.groupBy("part", "cut").agg(F.min("order").alias("order")).select("part", F.expr(f"order ^ (xxhash64(cut) & {(1 << 40) - 1})").alias("b")))
    comps = own.select(F.col("node").alias("b"), F.col("comp").alias("bcomp")).distinct()
    met = stored(parts.join(first, "part").where("node <> b").select(F.col("node").alias("a"), "b", "comp").distinct())
    met = met.join(comps, "b").where("comp <> bcomp")
    return stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _rare_shingles(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, place, size) of each node of ``left``, beside its columns: those
    of its (1 - t)|x| + 1 rarest shingles that other nodes of ``left`` hold too;
    place is the number of its shingles that are rarer."""

    def run(batches):
        for b in batches:
            for i, x in enumerate(b.column("shingles")):
                h = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), b.column("node")[i].as_py())), pa.array(np.full(len(h), len(h), np.int32)), pa.array(h)], ["node", "size", "shingle"])

    held = left.select("node").join(sets, "node").mapInArrow(run, "node long, size int, shingle long")
    held = stored(held)
    shared = stored(held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    common = held.join(shared, "shingle").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("s"))  # one text's shingles
    most = f"size - cast(ceil({similarity} * size - {ROUNDING}) as int) + 1"
    alone = "(size - size(s))"  # shingles that no other node holds come first
    rare = common.select("node", "size", F.expr(alone).alias("alone"), F.posexplode(F.expr(f"slice(s, 1, greatest(0, {most} - {alone}))")).alias("i", "e"))
    rare = stored(rare.select("node", "size", (F.col("alone") + F.col("i")).alias("place"), F.col("e.shingle").alias("shingle")))
    return stored(rare.join(left, "node"))


def _meeting(rare: DataFrame, similarity: float) -> DataFrame:
    """(a, b): nodes of different components that meet in a rare shingle and may
    reach the similarity, as far as sizes, places and sketches tell."""
    x = rare.where("minor").select("shingle", *(F.col(c).alias(f"x_{c}") for c in ("node", "comp", "size", "place", "s0", "s1")))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("x_s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("x_s1")))
    need = (F.col("size") + F.col("x_size")) * (similarity / (1 + similarity)) - ROUNDING
    able = F.least(F.col("size") - F.col("place"), F.col("x_size") - F.col("x_place")) >= need
    able &= F.least("size", "x_size") >= F.greatest("size", "x_size") * similarity - ROUNDING
    once = ~F.col("minor") | (F.col("node") > F.col("x_node"))
    met = x.join(rare, (x.shingle == rare.shingle) & (F.col("comp") != F.col("x_comp")) & once & able & (differ <= SKETCH_MOST))
    return stored(met.select(F.least("node", "x_node").alias("a"), F.greatest("node", "x_node").alias("b")).distinct())


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, text_key (xxhash64 of its text), class_id (the largest
    doc_id of its class), class_size and kept."""
    rows = stored(_signed(docs).withColumn("row", F.monotonically_increasing_id()))  # to tell repeated rows apart
    nodes = _nodes(rows)
    found = links(docs, nodes, similarity)
    rows = rows.select("doc_id", "text_key", "row", "h1", "h2")
    if found is not None:
        # a class goes by the name of its least node
        names = nodes.select("node", "h1", "h2")
        roots = names.select(F.col("node").alias("comp"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
        moved = stored(stored(components(found)).join(names, "node").join(roots, "comp").select(F.col("h1").alias("n1"), F.col("h2").alias("n2"), "c1", "c2"))
        rows = rows.join(moved, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")), "left")
        rows = stored(rows.select("doc_id", "text_key", "row", F.coalesce("c1", "h1").alias("h1"), F.coalesce("c2", "h2").alias("h2")))
    groups = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n")).where("n > 1")
    single = F.col("n").isNull()
    return rows.join(stored(groups), ["h1", "h2"], "left").select(
        "doc_id",
        "text_key",
        F.when(single, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("class_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("class_size"),
        (single | (F.col("row") == F.col("top.row"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns: one of each class."""
    marked = stored(classes(docs, similarity).select("doc_id", "text_key", "kept"))
    return without(docs, marked, "text_key", F.xxhash64(text_or_empty()))
