"""Exact dedup, token counts and packing against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wirelake.llm import exact_dedup, packing, token_hist
from wirelake.llm.tokens import default_tokenizer, encode

ROWS = [(1, "a b c"), (2, "a b c"), (3, None), (4, ""), (5, "A b c"), (6, "x" * 500 + "1"), (7, "x" * 500 + "2"), (8, "x" * 500 + "1"), (9, "a b c"), (10, "é" * 70_000), (None, "a b c"), (None, "only")]


def expected_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("digest,buckets", [(True, 2048), (False, 2048), (False, 1)])
def test_refine(documents, digest, buckets, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKETS", buckets)
    out = exact_dedup.refine(documents(ROWS, extra=True), digest=digest).collect()
    want = expected_groups(ROWS)
    assert len(out) == len(ROWS)
    text = {i: t or "" for i, t in ROWS if i is not None}
    for r in out:
        if r["doc_id"] is None:
            continue
        top, n = want[text[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, n, r["doc_id"] == top)
        if digest:
            assert r["full_hash"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
    assert sum(r["kept"] for r in out) == len(want)
    if not digest and buckets > 1:  # only rows that share length and head are hashed
        assert {r["doc_id"] for r in out if r["full_hash"]} == {None, 1, 2, 3, 4, 6, 7, 8, 9}


def test_the_first_levels_decide_with_digests_too(spark, sf, documents, monkeypatch):
    from wirelake.llm import queries

    levels, seen = exact_dedup._surviving, []
    monkeypatch.setattr(exact_dedup, "_surviving", lambda heads: seen.append(heads.columns) or levels(heads))
    want = queries.op3_exact_dedup(spark, sf)
    assert seen == [["len", "head"]] and want.where("group_size > 1").count() > 0
    # groups are formed only among rows that share length and head
    monkeypatch.setattr(exact_dedup, "_surviving", lambda heads: levels(heads).where("false"))
    out = exact_dedup.refine(documents(ROWS), digest=True).collect()
    assert len(out) == len(ROWS) and {r["group_size"] for r in out} == {1} and all(r["full_hash"] for r in out)


def test_refine_equals_brute_force(documents):
    r = random.Random(2)
    heads = ["x" * 200, "y" * 200, "", "é" * 130]
    rows = [(i, r.choice(heads) + r.choice(["", "a", "b", "ab", "ba"]) * r.randint(0, 2)) for i in range(400)]
    out = {x["doc_id"]: x for x in exact_dedup.refine(documents(rows).repartition(5)).collect()}
    want = expected_groups(rows)
    for i, t in rows:
        assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (*want[t], i == want[t][0])


def test_drop_copies_keeps_columns_of_any_name(documents):
    df = documents([(1, "same"), (2, "same"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)]).selectExpr("*", "'a' as own_key", "'b' as gone_id", "'c' as full_hash", "'d' as kept", "'e' as row")
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and sorted((r["doc_id"], r["own_key"], r["gone_id"], r["full_hash"], r["kept"], r["row"]) for r in out.collect()) == [(i, "a", "b", "c", "d", "e") for i in (2, 4)]


def test_copies_are_dropped_without_moving_texts(documents):
    plan = exact_dedup.drop_copies(documents([(1, "same"), (2, "same"), (3, "z")]))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_repeated_rows_keep_one(documents):
    rows = [(1, "same")] * 3 + [(2, "other")] * 2 + [(3, "same"), (None, "n"), (None, "n")]
    out = exact_dedup.refine(documents(rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in out if r["kept"]) == [0, 2, 3]
    kept = exact_dedup.drop_copies(documents(rows, extra=True))
    assert kept.columns[:2] == ["doc_id", "text"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "n"), (2, "other"), (3, "same")]


def test_empty_tables(documents):
    none = documents([(1, "x")]).where("false")
    assert exact_dedup.refine(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
    assert token_hist.suffix_sums(token_hist.lengths(none)).count() == 0
    assert packing.pack(none).count() == 0


def test_fast_ids_equal_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", "plain text", "tabs\t\n  spaces   ", "it's we'll", "中文 🙂 é ​", "a<|endoftext|>b", "123 4567 x_y", "\x00\x1f", "the " * 500]:
        assert encode(t, default_tokenizer()) == library.encode(t, add_special_tokens=False).ids


def test_token_histogram(documents):
    texts = ["a b c", None, "", "the cat sat", "x" * 3000, "a b c"] + [f"word{i} " * (i % 40) for i in range(60)]
    n = sorted(len(encode(t or "", default_tokenizer())) for t in texts)
    sums = token_hist.suffix_sums(token_hist.lengths(documents(list(enumerate(texts)), extra=True))).cache()
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert r["n_docs"] == n.count(k) and r["docs_from"] == sum(x >= k for x in n)
        assert r["tokens_from"] == sum(x for x in n if x >= k) and r["tokens_cut"] == sum(min(x, k) for x in n)
        assert r["tokens_all"] == sum(n)
    for limit in (0, 1, 3, 50, 10**6):
        r = token_hist.at_limit(sums, limit).first()
        assert (r["docs_over"], r["tokens_cut"]) == (sum(x > limit for x in n), sum(min(x, limit) for x in n))
    none = token_hist.at_limit(sums.where("false"), 5).first()
    assert (none["docs_over"], none["tokens_over"], none["tokens_cut"]) == (0, 0, 0)
    for q in (0.1, 0.5, 0.9, 1.0):
        assert sums.agg(token_hist.quantile(q)).first()[0] == n[int(np.ceil(q * len(n))) - 1]


@pytest.mark.parametrize("capacity", [1, 7, 100, 1024])
def test_cuts(capacity):
    for n in [*range(1, 2 * capacity + 2), 5 * capacity + 3]:
        parts = packing.cuts(n, capacity)
        assert [s for s, _ in parts] == list(np.cumsum([0, *[x for _, x in parts]])[:-1]) and sum(x for _, x in parts) == n
        for _, x in parts:  # each fills its class, or is the longest reciprocal below what was left
            k = capacity // x
            assert capacity // (k + 1) < x or x == capacity // k
            assert x == capacity // k or (capacity - k * x) * packing.SLACK <= capacity
    assert np.mean([len(packing.cuts(n, 1024)) for n in range(1, 1025)]) < 3.5


def test_bins_hold_a_fixed_count_of_their_class():
    bins, done = packing.Bins(100, 3), {}
    r = random.Random(1)
    lengths = [r.randint(1, 100) for _ in range(3000)]
    for i, n in enumerate(lengths):
        for piece, sequence, offset in bins.put((i,), n):
            done.setdefault(sequence, []).append((piece, offset))
    for pieces in done.values():
        k = {min(100 // lengths[i], packing.SLACK) for i, _ in pieces}
        assert len(k) == 1 and (len(pieces) in k or (k == {packing.SLACK} and sum(lengths[i] for i, _ in pieces) > 98))
    assert sum(map(len, bins.open.values())) < packing.SLACK**2 / 2
    last = {}
    for piece, sequence, offset in bins.finish():
        last.setdefault(sequence, []).append((piece, offset))
    assert not set(last) & set(done) and sorted(i for s in (done, last) for v in s.values() for i, _ in v) == list(range(3000))
    for pieces in (*done.values(), *last.values()):
        at = 0
        for i, offset in pieces:
            assert offset == at
            at += lengths[i]
        assert at <= 100


def test_packing(documents, prose):
    rows = [(i, prose(i, 40 + 90 * (i % 7))) for i in range(60)] + [(100, None), (101, ""), (102, "word " * 4000), (103, "tie"), (103, "tie")]
    out = packing.pack(documents(rows, extra=True).repartition(3)).collect()
    ids = {i: [*encode(t or "", default_tokenizer()), 0] for i, t in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        times = sum(j == i for j, _ in rows)
        assert sum(x for _, x in pieces[i]) == times * len(ids[i])
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:]))
        assert sum(n for _, n in s) <= 1024
    filled = sum(n for s in sequences.values() for _, n in s)
    assert filled >= 0.97 * 1024 * (len(sequences) - 3)  # the last one of each worker may be nearly empty


def test_any_capacity(documents, prose):
    rows = [(i, prose(i, 300)) for i in range(20)]
    out = packing.pack(documents(rows), capacity=1000).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 1000 for r in out)
    with pytest.raises(ValueError):
        packing.pack(documents([(1, "x")]), capacity=0)


def test_digest_only_omits_ids(documents):
    assert "ids" not in packing.pack(documents([(1, "x")]), with_ids=False).columns
    assert packing.pack(documents([(1, "x y z")])).select(F.sum("length")).first()[0] == 4
