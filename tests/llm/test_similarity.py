"""Fingerprints, near-duplicates, SentencePiece, the classifier and the pipeline."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from wirelake.llm import probminhash, quality, queries, sentencepiece_sa, simhash
from wirelake.llm.common import crc_bucket


def hexed(rows):
    return {r["doc_id"]: r for r in rows}


def test_edited_neighbours_equal_brute_force(documents, prose):
    rows = [(i, prose(i, 30 + 7 * (i % 9))) for i in range(0, 90, 3)] + [(200, None), (201, ""), (202, "é中🙂" * 50), (5, prose(0, 30)), (7, prose(7, 4000))]
    out = hexed(simhash.edited_neighbours(documents(rows, extra=True).repartition(5)).collect())
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    prints = {i: simhash.fingerprint(t) for i, t in order}
    for (i, t), (j, following) in zip(order, order[1:] + order[:1]):
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == simhash.as_hex(prints[i]) and r["edited_fingerprint"] == simhash.as_hex(simhash.fingerprint(changed))
        assert r["near_edited"] == simhash.likeness(prints[i], simhash.fingerprint(changed)) and r["near_next"] == simhash.likeness(prints[i], prints[j])
    assert out[0]["fingerprint"] == out[5]["fingerprint"] and len(out) == len(rows)


def test_simhash_edges(documents):
    one = simhash.edited_neighbours(documents([(1, "a sole text")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert simhash.edited_neighbours(documents([(1, "x")]).where("false")).count() == 0
    assert simhash.edited_neighbours(documents([(1, "same")] * 4 + [(None, "n"), (None, None)])).count() == 6
    assert simhash.fingerprint("") == 0 == simhash.fingerprint("!!!")
    long = " ".join(f"w{i % 50_000}" for i in range(60_000))
    assert simhash.fingerprint(long) == simhash.fingerprint(long)


def test_fingerprint_equals_plain_votes(prose):
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for text in ("", "One", "a a a b", prose(1, 80), prose(2, 400) + " é 中文"):
        words = re.findall(r"\w+", text.lower())
        h = [xxhash.xxh64_intdigest(w) & ~15 | min(len(w), 15) for w in words]
        counts = {}
        for x in h:
            counts[x, min(x & 15, 8) ** 2 / 64] = counts.get((x, min(x & 15, 8) ** 2 / 64), 0) + 1
        for x, y in zip(h, h[1:]):
            pair = (x * 0x9E3779B97F4A7C15 & mask) ^ (y + (y << 7 & mask) & mask)
            counts[pair, 1.0] = counts.get((pair, 1.0), 0) + 1
        votes = [0] * 128
        for (term, weight), n in counts.items():
            w = max(1, round(16 * (weight * (1 + math.log(n)))))
            low = mix(term)
            bits = low.to_bytes(8, "little") + mix(low + 0x9E3779B97F4A7C15 & mask).to_bytes(8, "little")
            for i in range(128):
                votes[i] += w if bits[i // 8] >> (7 - i % 8) & 1 else -w
        assert simhash.fingerprint(text) == sum(1 << (127 - i) for i in range(128) if votes[i] > 0)


def test_within_radius_equals_brute_force(spark):
    r = random.Random(1)
    base = [r.getrandbits(128) for _ in range(60)]
    every = set(base)
    for b in base:
        for _ in range(4):
            x = b
            for bit in r.sample(range(128), r.randint(1, 6)):
                x ^= 1 << bit
            every.add(x)
    df = spark.createDataFrame([(simhash.as_hex(x),) for x in every], "fingerprint string")
    asked = df.limit(80)
    for radius in (0, 3, 5):
        got = {(q["query"], q["fingerprint"], q["distance"]) for q in simhash.within_radius(df, asked, radius).collect()}
        asks = [int(a[0], 16) for a in asked.collect()]
        want = {(simhash.as_hex(a), simhash.as_hex(x), (a ^ x).bit_count()) for a in asks for x in every if (a ^ x).bit_count() <= radius}
        assert got == want


def brute_classes(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    return sorted(sorted(g, key=lambda i: i or -1) for g in groups.values())


def near_corpus(prose):
    r = random.Random(9)
    rows, n = [], 0
    for g in range(12):
        words = prose(1000 + g, 150).split()
        for copy in range(1 + g):  # groups of growing size, each copy edited on its own
            w = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    chain = prose(77, 200).split()
    for step in range(12):  # neighbours are alike, the ends are not
        chain = chain[:]
        for k in range(3):
            chain[step * 12 + k * 4] = f"step{step}{k}"
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, "!!!"), (n + 3, "two words"), (n + 4, "Two  words."), (n + 5, prose(5, 4)), (n + 6, "word " * 3000), (n + 7, "word " * 3100)]
    return rows


def test_classes_equal_brute_force(documents, prose):
    rows = near_corpus(prose)
    out = probminhash.classes(documents(rows, extra=True).repartition(3)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["class_id"], []).append(r)
    assert sorted(sorted(r["doc_id"] for r in g) for g in groups.values()) == brute_classes(rows)
    for top, g in groups.items():
        assert top == max(r["doc_id"] for r in g) and all(r["class_size"] == len(g) for r in g) and [r["doc_id"] for r in g if r["kept"]] == [top]


def test_repeats_do_not_hide_near_copies(documents):
    rows = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(204)]
        cycle = [f"c{g}x{i}" for i in range(40)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words + cycle * 100))]  # 0.82, extra shingles repeat
        same = [f"s{g}x{i}" for i in range(200)]
        often = same[:40] * 300 + same
        rows += [(10 * g + 2, " ".join(same[:40] * 2 + same)), (10 * g + 3, " ".join(often))]  # equal sets
    groups = {}
    for r in probminhash.classes(documents(rows)).collect():
        groups.setdefault(r["class_id"], []).append(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == brute_classes(rows) and all(len(g) == 2 for g in groups.values())


def overlap_classes(rows, least=0.8):
    """brute_classes for many rows: every text is counted against all others at
    once, through the rows that hold its shingles."""
    sets, holders = [], {}
    for k, (_, t) in enumerate(rows):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
        for x in sets[-1]:
            holders.setdefault(x, []).append(k)
    holders, size = {x: np.array(v) for x, v in holders.items()}, np.array([len(x) for x in sets])
    label = np.arange(len(rows))
    for k, own in enumerate(sets):
        both = np.bincount(np.concatenate([holders[x] for x in own]), minlength=len(rows))
        alike = both >= least * (size + size[k] - both) - 1e-9
        label[np.isin(label, label[alike])] = label[alike].min()
    return label


def large_group(seed, n):
    """n edited copies of one text, most of them near 0.8 of each other: some
    classes of hundreds, many of a few, most alone."""
    r = random.Random(seed)
    base = [f"base{i}" for i in range(150)]
    families = [base]
    for f in range(5):
        w = list(base)
        for k in r.sample(range(150), 3 + f):
            w[k] = f"family{f}x{k}"
        families.append(w)
    rows = []
    for i in range(n):
        w = list(r.choice(families))
        for k in r.sample(range(0, 150, 5), r.choice([0, 2, 3, 4, 6, 8])):
            w[k] = f"own{r.randrange(2)}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_large_bucket_of_many_classes(documents):
    rows = large_group(3, 2000)
    label = overlap_classes(rows)
    sizes = np.unique(label, return_counts=True)[1]
    assert sizes.max() > 400 and (sizes == 1).sum() > 100 and ((sizes > 1) & (sizes < 50)).sum() >= 3
    got = {r["doc_id"]: r["class_id"] for r in probminhash.classes(documents(rows).repartition(4)).collect()}
    want = {}
    for i, k in enumerate(label):
        want[k] = max(want.get(k, -1), i)
    assert got == {i: want[k] for i, k in enumerate(label)}


def test_near_copies_of_long_texts_and_columns_of_any_name(documents, prose):
    long = prose(70, 30_000)
    df = documents([(1, long), (2, long + " one word more"), (3, prose(71, 9))]).selectExpr("*", "'a' as __k", "'b' as own_key", "'c' as h1", "'d' as row")
    out = probminhash.drop_near_copies(df)
    assert out.columns == df.columns and sorted((r["doc_id"], r["__k"], r["own_key"], r["h1"], r["row"]) for r in out.collect()) == [(i, "a", "b", "c", "d") for i in (2, 3)]


def test_near_copies_edges(documents, prose):
    t = prose(3)
    rows = [(1, t), (1, t), (2, t + " more"), (None, t), (3, "other words that are not alike at all"), (4, None), (5, "")]
    left = probminhash.drop_near_copies(documents(rows, extra=True))
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4, 5]
    none = documents([(1, "x")]).where("false")
    assert probminhash.classes(none).count() == 0 and probminhash.drop_near_copies(none).count() == 0
    plain = [(i, prose(50 + i)) for i in range(5)]
    assert probminhash.drop_near_copies(documents(plain)).count() == 5


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(0)
    for shared, own in ((300, 30), (200, 200), (50, 300)):
        h = r.integers(0, 2**63, shared + 2 * own).astype(np.uint64)
        a, b = np.concatenate([h[:shared], h[shared : shared + own]]), np.concatenate([h[:shared], h[shared + own :]])
        wa = r.integers(1, 4, len(a)).astype(float)
        wb = np.concatenate([wa[:shared], r.integers(1, 4, own).astype(float)])
        weights_a, weights_b = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
        both = set(weights_a) & set(weights_b)
        every = set(weights_a) | set(weights_b)
        exact = sum(1 / sum(max(weights_a.get(j, 0) / weights_a[i], weights_b.get(j, 0) / weights_b[i]) for j in every) for i in both)
        estimate = np.mean([np.mean(np.equal(*probminhash.signatures([(a, wa), (b, wb)], seed=s))) for s in range(8)])
        assert estimate == pytest.approx(exact, abs=0.06)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    out = probminhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["comp"] for r in out} == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}}


def test_components_of_few_edges_need_no_jobs(spark, monkeypatch):
    from wirelake.llm import common

    r = random.Random(8)
    edges = [(r.randrange(-150, 150), r.randrange(-150, 150)) for _ in range(130)] + [(5, 5)] * 2 + [(2**62, -(2**62)), (2**62 - 1, 2**62)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    held = common.stored_count()
    few = sorted(tuple(x) for x in probminhash.components(df).collect())
    assert common.stored_count() == held and probminhash.components(df).columns == ["node", "comp"]
    assert probminhash.components(df.where("a = b")).count() == 0
    monkeypatch.setattr(probminhash, "MOST_LOCAL", 0)
    many = sorted(tuple(x) for x in probminhash.components(df).collect())
    assert common.stored_count() > held and few == many and len({c for _, c in few}) < len(few)


def test_components_of_many_edges(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "MOST_LOCAL", 10)
    test_components(spark)


def test_sentencepiece_equals_the_library(documents, prose):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "▁", "\n", "é", "中文", "🙂", "\x00", "12", "<s>", "ß"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 50)))) for i in range(300)] + [(900 + i, prose(i)) for i in range(20)] + [(1000, None), (1001, ""), (1002, "a" * 3000), (1003, " " * 200), (1003, "tie")]
    encoded = sentencepiece_sa.encode(documents(rows, extra=True)).cache()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(model.encode(t or ""))
    for x in encoded.collect():
        assert x["ids"] in texts[x["doc_id"]]
    shown = {(x["doc_id"], x["text"]) for x in sentencepiece_sa.decode(encoded).collect()}
    assert shown == {(i, model.decode(model.encode(t or ""))) for i, t in rows}
    assert sentencepiece_sa.encode(documents([(1, "x")]).where("false")).count() == 0


def test_sentencepiece_batches_of_any_length(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_sa.Codec(path)
    r, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyzé中 "
    for n in range(41):
        for text in ("".join(r.choice(letters) for _ in range(n)), "a" * n, "ab cd " * 7):
            text = text[:n]
            fresh = sentencepiece_sa.Codec.__new__(sentencepiece_sa.Codec)
            fresh.__dict__.update(codec.__dict__, known={}, older={})  # alone in its index
            assert fresh.encode([text])[0].tolist() == model.encode(text)
            assert codec.encode([text])[0].tolist() == model.encode(text)  # on a warm cache, with one new word
    long = ["".join(r.choice("etaoin中文é") for _ in range(5000)), "a" * 5000, "zq" * 1500, "▁" * 300 + "x"]
    want = [model.encode(t) for t in long]
    for chars in (400_000, 700):  # in one index and in several
        monkeypatch.setattr(sentencepiece_sa, "INDEX_CHARS", chars)
        fresh = sentencepiece_sa.Codec.__new__(sentencepiece_sa.Codec)
        fresh.__dict__.update(codec.__dict__, known={}, older={})
        assert [x.tolist() for x in fresh.encode(long)] == want


def test_models_that_merging_does_not_reproduce_are_an_error(tmp_path, prose):
    sentencepiece_sa.codec(public_tokenizers.path("piece_bpe_32k.model"))
    cases = {"plain": ("bpe", "identity", False), "unigram": ("unigram", "identity", False), "nfkc": ("bpe", "nfkc", False), "spaces": ("bpe", "identity", True)}
    for name, (kind, rule, squeeze) in cases.items():
        path = str(tmp_path / name)
        lines = iter([prose(i) for i in range(30)])
        sentencepiece.SentencePieceTrainer.train(sentence_iterator=lines, model_prefix=path, vocab_size=60, model_type=kind, normalization_rule_name=rule, remove_extra_whitespaces=squeeze, hard_vocab_limit=False, minloglevel=2)
        if name == "plain":
            sentencepiece_sa.codec(path + ".model")
        else:
            with pytest.raises(ValueError):
                sentencepiece_sa.codec(path + ".model")


def test_suffix_array():
    codes = np.array([ord(c) for c in "banana"] + [-1] + [ord(c) for c in "ban"] + [-1])
    order = sentencepiece_sa.suffix_array(codes, 4)
    keys = [codes[i : i + 4].tolist() for i in order]
    assert keys == sorted(keys)


def test_quality_held_out(spark, sf):
    big = sf.replace("0.001", "0.01")
    out = queries.op1_quality(spark, big)
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
    assert out.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_edges(spark, documents, prose):
    good = [(i, prose(i)) for i in range(40)]
    bad = [(100 + i, " | ".join(prose(100 + i).split())) for i in range(40)]
    rows = good + bad + [(500, None), (501, ""), (502, good[0][1]), (503, good[0][1]), (None, "x")]
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0) for i, _ in good + bad] + [(1, None), (2, 7), (None, 1), (9999, 1), (3, 0)], "doc_id long, quality int")
    df = documents(rows, extra=True)
    model = quality.fit(df, labels)
    out = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert np.mean([out[i] >= 0.3 for i, _ in good]) > 0.95 and np.mean([out[i] >= 0.3 for i, _ in bad]) < 0.05
    assert out[502] == out[503] and out[500] == out[501] and 0 <= out[500] <= 1
    learned = set(df.where(crc_bucket() != 0).select("doc_id").toPandas()["doc_id"].dropna().astype(int))
    assert 0 < len(learned) < 85
    assert quality.score(df.where("false"), model).count() == 0
    single = quality.fit(df, labels.where("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(df, single).collect()} and single.slope == 1.0
    nothing = quality.fit(df, labels.where("false"))
    assert {r["score"] for r in quality.score(df, nothing).collect()} == {0.5}


def test_score_keeps_columns_of_any_name(documents):
    model = quality.fit_rows([np.array([1], np.int32)], np.array([1]))
    df = documents([(1, "x"), (2, None), (3, "word " * 400_000)]).selectExpr("*", "'a' as whole_text", "'b' as __text", "'c' as `odd name`", "array(named_struct('x', 1)) as nested")
    out = quality.score(df, model)
    assert out.columns == [*df.columns, "score"] and {(r["whole_text"], r["__text"], r["odd name"]) for r in out.collect()} == {("a", "b", "c")}


def brute_fit(sets, y, c=1.0, steps=60_000):
    """The published method in plain Python: smoothed counts, their log-ratio,
    and the hinge loss minimised by its primal, by subgradients."""
    names = sorted(set().union(*sets))
    ratio = {}
    for f in names:
        held = [sum(f in s for s, t in zip(sets, y) if t == side) for side in (1, -1)]
        ratio[f] = math.log((held[0] + 1) / (y.count(1) + 2) / ((held[1] + 1) / (y.count(-1) + 2))) if sum(held) >= 3 else 0.0
    x = np.array([[ratio[f] / len(s) ** 0.5 if f in s else 0.0 for f in names] + [1.0] for s in sets])
    side = np.array([c * len(y) / (2 * y.count(t)) for t in y])
    target, w = np.array(y), np.zeros(len(names) + 1)

    def loss(w):
        return w @ w / 2 + (side * np.maximum(0, 1 - target * (x @ w))).sum()

    best, least = w, loss(w)
    for t in range(1, steps):
        w = w - (w - x.T @ (side * target * (target * (x @ w) < 1))) / (t + 50)
        if t > steps // 2 and (now := loss(w)) < least:
            best, least = w.copy(), now
    return names, ratio, best, least, loss


def test_fit_equals_brute_force():
    r = random.Random(6)
    y = [r.choice([1, -1]) for _ in range(60)]
    sets = [{f for f in range(25) if r.random() < (0.5 if (f % 3 == 0) == (t == 1) else 0.25)} | {99} for t in y]
    rows = [np.array(sorted(s), np.int32) for s in sets]
    names, ratio, best, least, loss = brute_fit(sets, y)
    got = quality.log_ratios(rows, np.array(y))
    assert all(got[f] == pytest.approx(ratio[f]) for f in names) and np.count_nonzero(got) == sum(v != 0 for v in ratio.values())
    w, b = quality.hinge_weights(rows, np.array(y), got, epochs=2000, tolerance=1e-9)
    assert loss(np.array([*(w[f] for f in names), b])) == pytest.approx(least, rel=2e-3) and loss(np.array([*(w[f] for f in names), b])) <= least + 1e-6
    mixed, _ = quality.dual_descent(rows, np.array(y), got)
    w, _ = quality.hinge_weights(rows, np.array(y), got)
    mean = np.mean([abs(w[f]) for f in names if w[f]])
    assert all(mixed[f] == pytest.approx(got[f] * (0.25 * w[f] + 0.75 * mean)) for f in names if w[f])
    model = quality.fit_rows(rows, np.array(y))
    for s in rows:
        value = sum(float(model.weights[f]) for f in s) / len(s) ** 0.5 + model.bias
        assert model.score(s) == pytest.approx(1 / (1 + math.exp(-(model.slope * value + model.offset))), abs=1e-6)


def test_log_ratios_and_descent():
    rows = [np.array([1, 2, 9], np.int32), np.array([1, 3], np.int32), np.array([2, 9], np.int32)] * 4
    y = np.array([1, -1, 1] * 4)
    ratio = quality.log_ratios(rows, y)
    assert ratio[9] > 0 > ratio[3] and ratio[5] == 0
    w, b = quality.dual_descent(rows, y, ratio)
    assert all(np.sign(w[r].sum() / len(r) ** 0.5 + b) == s for r, s in zip(rows, y))


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    state, stages = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.stored(stage(spark, state, sf))
        assert state.columns == docs.columns
        stages.append({r["doc_id"]: r["text"] for r in state.collect()})
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if model.score(quality.features(r["text"])) >= quality.THRESHOLD}
    assert stages[0] == kept
    by_text = {}
    for i, t in kept.items():
        by_text[t] = max(i, by_text.get(t, i))
    kept = {i: t for t, i in by_text.items()}
    assert stages[1] == kept
    tops = {max(g) for g in brute_classes(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if i in tops}
    assert stages[2] == kept
    assert set(stages[3]) == set(kept)
    for i, t in stages[3].items():
        assert not re.search(r"@mail\d+\.example\.com|\+1 \(\d{3}\) 555-\d{4}", t)
        if "@" not in kept[i] and "+1 (" not in kept[i] and not re.search(r"\d{7}|\d\.\d+\.\d+\.\d", kept[i]):
            assert t == kept[i]
    packed = corpus_pipeline.run(spark, sf)
    sizes = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    from wirelake.llm.tokens import default_tokenizer, encode

    assert sizes == {i: len(encode(t, default_tokenizer())) + 1 for i, t in stages[3].items()}


def test_pipeline_takes_any_rows_and_leaves_no_tables(spark, documents, prose, tmp_path):
    import os

    from wirelake.llm import common

    labels = [(i, int(i % 2 == 0)) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    good = [(i, prose(i)) if i % 2 == 0 else (i, " | ".join(prose(i).split())) for i in range(80)]
    rows = good + [(200, prose(2)), (201, prose(4) + " more"), (202, None), (203, ""), (203, ""), (None, prose(300)), (204, prose(6) + " call +1 (017) 555-7713"), (205, " ".join(prose(i) for i in range(500, 700)))]
    rows += [(206, rows[-1][1] + " end")] * 2
    cases = {"rows": documents(rows).selectExpr("*", "'a' as quality_score", "'b' as own_key", "'c' as __t"), "none": documents(rows).where("false")}
    for name, df in cases.items():
        folder = tmp_path / name
        folder.mkdir()
        os.symlink(tmp_path / "labels.parquet", folder / "labels.parquet")
        df.write.parquet(f"{folder}/documents.parquet")
        common.release(spark)
        root = f"{common.shared_root(spark)}/wirelake"
        os.makedirs(root, exist_ok=True)
        others = set(os.listdir(root))  # a shared folder
        state = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = corpus_pipeline.stored(stage(spark, state, str(folder)))
            assert state.columns == df.columns
        left = {(r["doc_id"], r["quality_score"], r["own_key"], r["__t"]) for r in state.collect()}
        if name == "rows":
            ids = {i for i, *_ in left}
            assert {x[1:] for x in left} == {("a", "b", "c")} and None in ids and not {2, 4, 6, 205} & ids and {200, 201, 204, 206} <= ids
            assert "<PHONE>" in {r["doc_id"]: r["text"] for r in state.collect()}[204]
        else:
            assert not left
        common.release(spark)
        assert corpus_pipeline.run(spark, str(folder)).count() == (0 if name == "none" else corpus_pipeline.run(spark, str(folder)).count())
        assert len(common._tables) <= 2  # the input of each last stage
        assert set(os.listdir(root)) - others == {x.rsplit("/", 1)[-1] for x in common._tables}
        common.release(spark)
        assert set(os.listdir(root)) <= others
