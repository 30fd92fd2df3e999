"""SentencePiece encoding and decoding by suffix-array matching.

The segments of a batch that are not yet known (a segment is a word with the
spaces before it; no piece of the vocabulary spans two) are concatenated and
indexed by a suffix array over their code points, ordered as deep as the
longest piece. Every piece is binary-searched for its range of occurrences; the
occurrences, sorted by position, are the edges of the segments' lattices.

The lattices are then reduced in BPE order: of all edges that join two
neighbouring tokens the best-scored, leftmost one is taken until none is left.
Characters outside the vocabulary become bytes. Models that are not BPE, or that
normalise more than by a space in front, are an error.

Cases: null texts equal empty ones and have no token. Repeated rows are encoded
each. Of equally ranked pairs the leftmost is joined first. An empty table gives
no rows. Texts and words of any length are encoded whole: words of more than
``LONG`` characters are cut where no piece holds both neighbours, which changes
nothing, and what remains is indexed ``INDEX_CHARS`` characters at a time and
reduced by a heap, in some 100 bytes a character. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_u32, text_or_empty

SPACE = "▁"
MOST_CACHED = 150_000
INDEX_CHARS = 400_000
LONG = 40
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` codes, by
    prefix doubling. Codes below 0 end a segment and sort first."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, step, n = np.argsort(rank, kind="stable"), 1, len(codes)
    while step < min(depth, n):  # beyond the end nothing tells suffixes apart
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        rank, step = fresh, step * 2
    return order


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) in the suffix array for each piece (rows of codes padded to the
    longest), all pieces searched at once, one code deeper each time."""
    n = len(codes)
    lo, hi = np.zeros(len(pieces), np.int64), np.full(len(pieces), n, np.int64)

    def bound(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, depth: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            spot = order[np.minimum(mid, n - 1)] + depth
            have = np.where(spot < n, codes[np.minimum(spot, n - 1)], -2)
            less = (have <= want) if right else (have < want)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    for depth in range(pieces.shape[1]):
        at = np.flatnonzero((lengths > depth) & (lo < hi))
        if not len(at):
            break
        want = pieces[at, depth]
        a, b = lo[at], hi[at]
        lo[at], hi[at] = bound(at, a, b, want, depth, False), bound(at, a, b, want, depth, True)
    return lo, hi


def _fields(message: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a serialized protobuf message."""
    out: dict[int, int | bytes] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        field, kind = divmod(number(), 8)
        if kind == 0:
            out[field] = number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        out[field] = message[at : at + size]
        at += size
    return out


def require_plain_bpe(proto: bytes) -> None:
    """Raises for models whose ids merging in BPE order would not give."""
    model = _fields(proto)
    trainer, normalizer = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    if trainer.get(3, 1) != 2:
        raise ValueError("only BPE models are supported")
    # charsmap, dummy prefix, extra spaces removed, spaces escaped; then spaces as suffixes
    if normalizer.get(2) or [normalizer.get(i, 1) for i in (3, 4, 5)] != [1, 0, 1] or trainer.get(24, 0):
        raise ValueError("only models with identity normalisation, a dummy prefix and kept spaces are supported")


class Codec:
    """A model's vocabulary with the encoder and the decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        require_plain_bpe(model.serialized_model_proto())
        n = model.get_piece_size()
        self.unk = model.unk_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.special = np.array([i in self.control or i in self.byte_of for i in range(n)])
        self.normal = np.array([i for i in range(n) if not special[i]])
        self.rank = np.unique([-model.get_score(i) for i in range(n)], return_inverse=True)[1].astype(np.int32)
        self.lengths = np.array([len(self.pieces[i]) for i in self.normal])
        self.codes = np.full((len(self.normal), self.lengths.max()), -3, np.int64)
        for row, i in enumerate(self.normal):
            self.codes[row, : self.lengths[row]] = [ord(c) for c in self.pieces[i]]
        self.kind = np.int16 if n < 1 << 15 else np.int32  # of piece numbers
        inside = np.arange(self.codes.shape[1] - 1) < self.lengths[:, None] - 1
        self.neighbours = np.unique((self.codes[:, :-1] << 21 | self.codes[:, 1:])[inside])
        # segments are independent unless a piece holds a space after other characters
        self.by_segment = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in self.normal)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # the generation before: what is still used moves on
        self.shown = [" " * len(p) if set(p) == {SPACE} else p.replace(SPACE, " ") for p in self.pieces]

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        cut = _SEGMENT.findall(whole) if self.by_segment else [whole]
        return cut if max(map(len, cut)) <= LONG else [x for s in cut for x in ([s] if len(s) <= LONG else self.parts(s))]

    def parts(self, segment: str) -> list[str]:
        """The segment cut between characters that no piece holds side by side:
        no join crosses such a place."""
        codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        apart = np.flatnonzero(~np.isin(codes[:-1] << 21 | codes[1:], self.neighbours)) + 1
        cuts = [0, *apart.tolist(), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:])]

    def edges(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The piece at each position of the concatenated text by its length - 1
        (-1 where none), and where each segment starts."""
        sizes = np.array([len(s) + 1 for s in segments])
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer((" ".join(segments) + " ").encode("utf-32-le", "surrogatepass"), np.int32).astype(np.int64)
        codes[starts + sizes - 1] = -1
        order = suffix_array(codes, self.codes.shape[1])
        lo, hi = occurrence_ranges(codes, order, self.codes, self.lengths)
        counts = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        position = order[first + np.arange(counts.sum())]
        at = np.full((len(codes), self.codes.shape[1]), -1, self.kind)
        at[position, np.repeat(self.lengths, counts) - 1] = np.repeat(self.normal, counts)
        return at, starts

    def edges_of_long(self, segment: str) -> np.ndarray:
        """The edges of one segment, found in one index after another; each
        reaches as far into the next one as the longest piece."""
        width = self.codes.shape[1]
        out = np.empty((len(segment), width), self.kind)
        for at in range(0, len(segment), INDEX_CHARS):
            part = segment[at : at + INDEX_CHARS]
            out[at : at + len(part)] = self.edges([segment[at : at + INDEX_CHARS + width]])[0][: len(part)]
        return out

    def relax_long(self, edges: np.ndarray, segment: str) -> bytes:
        """Ids of one segment, whose edges are given, as 16-bit numbers. The heap
        holds rank, place and length of a join in one number each."""
        n, width, rank = len(segment), edges.shape[1], self.rank
        bits = width.bit_length()
        rows = edges[:n].tolist() if n <= 100 * LONG else edges  # a list is faster and takes several times the memory
        nexts, alive = array("i", range(1, n + 1)), bytearray(b"\1") * n
        before = array("i", range(-1, n - 1))
        heap: list[int] = []

        def offer(i: int, end: int) -> None:
            if end - i <= width and (p := rows[i][end - i - 1]) >= 0:
                heapq.heappush(heap, (int(rank[p]) << 40 | i) << bits | end - i)

        for i in range(n - 1):
            offer(i, i + 2)
        while heap:
            top = heapq.heappop(heap)
            i = top >> bits & (1 << 40) - 1
            end = i + (top & (1 << bits) - 1)
            middle = nexts[i] if alive[i] else n
            if middle >= n or nexts[middle] != end:
                continue  # one side has been joined meanwhile
            alive[middle] = 0
            nexts[i] = end
            if end < n:
                before[end] = i
                offer(i, nexts[end])
            if before[i] >= 0:
                offer(before[i], end)
        ids, i = array("H"), 0
        while i < n:
            end = nexts[i]
            ids.extend(self._named(int(rows[i][end - i - 1]) if end - i <= width else -1, segment[i:end]))
            i = end
        return np.array(ids, "<u2").tobytes()

    def _named(self, piece: int, text: str) -> list[int]:
        if piece >= 0:
            return [piece]
        return [self.bytes[b] for b in text.encode("utf-8", "surrogatepass")] if self.bytes else [self.unk]

    def relax(self, edges: np.ndarray, starts: np.ndarray, segments: list[str]) -> list[bytes]:
        """Ids of segments of like length: each round joins, in every segment
        that still has one, the best-ranked pair of neighbours, leftmost first."""
        sizes, width = np.array([len(s) for s in segments]), edges.shape[1]
        most, none = sizes.max(), np.iinfo(np.int32).max
        column = np.arange(most)
        inside = column < sizes[:, None]
        nexts = np.where(inside, column + 1, most)
        before = np.broadcast_to(column - 1, nexts.shape).copy()

        def rank(row, i, end):
            length = end - i
            piece = edges[starts[row] + i, np.minimum(length, width) - 1]
            return np.where((piece >= 0) & (length <= width), self.rank[piece], none)

        ranks = np.full(nexts.shape, none, np.int32)
        r, i = np.nonzero(column < sizes[:, None] - 1)
        ranks[r, i] = rank(r, i, i + 2)
        row = np.arange(len(segments))
        while len(row):
            i = ranks[row].argmin(axis=1)
            more = ranks[row, i] < none
            row, i = row[more], i[more]
            middle = nexts[row, i]
            end = nexts[row, middle]
            nexts[row, i] = end
            ranks[row, middle] = none
            inside[row, middle] = False
            ranks[row, i] = none
            on = end < sizes[row]
            r, f, e = row[on], i[on], end[on]
            before[r, e] = f
            ranks[r, f] = rank(r, f, nexts[r, e])
            on = before[row, i] >= 0
            r, f = row[on], before[row[on], i[on]]
            ranks[r, f] = rank(r, f, end[on])
        r, i = np.nonzero(inside)
        length = nexts[r, i] - i
        ids = np.where(length <= width, edges[starts[r] + i, np.minimum(length, width) - 1], -1)
        last = np.cumsum(inside.sum(axis=1))
        odd = set(r[ids < 0].tolist())
        flat, cuts = ids.astype("<u2").tobytes(), (2 * last).tolist()
        out = [flat[a:b] for a, b in zip([0, *cuts], cuts)]
        for k in odd:
            at = slice(last[k] - inside[k].sum(), last[k])
            named = [x for p, f, n in zip(ids[at].tolist(), i[at].tolist(), length[at].tolist()) for x in self._named(p, segments[k][f : f + n])]
            out[k] = np.array(named, "<u2").tobytes()
        return out

    def learn(self, segments) -> None:
        """Encodes unknown segments, ``INDEX_CHARS`` characters an index."""
        if len(self.known) > MOST_CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        batch, load = [], 0
        for s in segments:
            if s in known:
                continue
            if (held := older.get(s)) is not None:
                known[s] = held
                continue
            batch.append(s)
            load += len(s)
            if load >= INDEX_CHARS:
                self._index(batch)
                batch, load = [], 0
        if batch:
            self._index(batch)

    def _index(self, batch: list[str]) -> None:
        batch.sort(key=len)
        while batch and len(batch[-1]) > INDEX_CHARS:
            s = batch.pop()
            self.known[s] = self.relax_long(self.edges_of_long(s), s)
        if not batch:
            return
        edges, starts = self.edges(batch)
        at = 0
        while at < len(batch) and len(batch[at]) <= LONG:
            end = at
            while end < len(batch) and len(batch[end]) <= min(LONG, len(batch[at]) + 3):
                end += 1
            group = batch[at:end]
            self.known.update(zip(group, self.relax(edges, starts[at:end], group)))
            at = end
        for s, start in zip(batch[at:], starts[at:].tolist()):
            self.known[s] = self.relax_long(edges[start : start + len(s)], s)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.segments(t) for t in texts]
        self.learn(dict.fromkeys(s for c in cut for s in c))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, c)), "<u2") for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        shown = self.shown
        if not self.special[ids].any():
            text = "".join(map(shown.__getitem__, ids.tolist()))
        else:
            parts, run = [], bytearray()
            for i in ids.tolist():
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                parts.append(run.decode("utf-8", "replace"))
                run.clear()
                if i not in self.control:
                    parts.append(shown[i])
            text = "".join(parts) + run.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str | None = None, group: int = 1000) -> DataFrame:
    """(doc_id, ids): the pieces of every text."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, group):
                part = b.slice(at, group)
                ids = [x.astype(np.int32) for x in c.encode(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of ``ids``."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32)) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chars, decoded_sha256) of encoded rows:
    the ids and what they decode to."""
    path = model or default_model()

    def run(batches):
        c = codec(path)
        for b in batches:
            rows = []
            for x in b.column("ids"):
                ids = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32)
                text = c.decode(ids)
                rows.append((len(ids), crc32_u32(ids), len(text), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, pa.string() if k == 3 else pa.int64()) for k, v in enumerate(columns))], ["doc_id", "n_tokens", "ids_crc32", "n_chars", "decoded_sha256"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, n_chars long, decoded_sha256 string")
