"""The operators for training data against brute force, and on odd input."""

from __future__ import annotations

import itertools
import math
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltline.llm import bpe, chat, lines, lm, minhash, packing, quality, registry, sitetree, topk, vectors, words
from siltline.llm.common import components, spanning

from ..compare import assert_same

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __rid string, line string, root int"  # the last three clash with inner names
VOCABULARY = [f"w{i}x" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "a", "b", 1) for i, t in rows], DOCS)


def odd(spark):
    """Nulls, empty and long texts, blanks, ties and repeated rows."""
    return documents(spark, [(None, None), (None, "one two three"), (1, ""), (2, None), (3, "   \n\n "), (4, "x"), (4, "x"), (4, "other"), (5, "long word " * 20000), (6, "é漢字🙂 ñ"), (7, "a\nb\na\n"), (8, "!!! ???"), (None, "one two three")])


def empty(spark):
    return documents(spark, [])


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLES[name], FOLDER)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_hashes():
    texts = ["The cat, the CAT", "", "É é été", "x" * 3000, None, "the"]
    h, first = words.word_hashes(*words.buffers(pa.array(texts)))
    assert list(np.diff(first)) == [4, 0, 3, 1, 0, 1] and h[0] == h[2] == h[-1] and h[1] == h[3] and h[4] == h[5] and len(set(h)) == 5


# packing


def naive(lengths, capacity):
    left, bins = list(range(len(lengths))), []
    while left:
        chosen, gap = [], capacity
        while fit := [i for i in left if lengths[i] <= gap]:
            i = min(fit, key=lambda i: (-lengths[i], i))
            chosen.append(i)
            left.remove(i)
            gap -= lengths[i]
        if gap and len(chosen) > 1:
            least = chosen[-1]
            best = min(((-lengths[i] - lengths[j], -lengths[i], i, j) for i, j in itertools.permutations(left, 2) if lengths[i] >= lengths[j] and lengths[least] < lengths[i] + lengths[j] <= gap + lengths[least]), default=None)
            if best:
                chosen[-1:] = best[2:]
                left = [x for x in [*left, least] if x not in best[2:]]
        bins.append(chosen)
    return bins


def test_packing_equals_naive():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.randint(5, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 25))]
        assert packing.pack(lengths, capacity) == naive(lengths, capacity)


def test_packing_keeps_all_text(spark):
    docs = odd(spark)
    bins = packing.packed(docs, 50, 1000).collect()
    pieces: dict = {}
    for b in bins:
        assert b.used == sum(b.lengths) + len(b.lengths) <= 50 and len(b.text) == b.used and len({len(x) for x in (b.doc_ids, b.starts, b.lengths)}) == 1
        at = 0
        for i, start, n in zip(b.doc_ids, b.starts, b.lengths):
            pieces.setdefault(i, []).append((start, b.text[at : at + n]))
            assert b.text[at + n] == packing.END
            at += n + 1
    for i in {r.doc_id for r in docs.collect()}:
        want = sum(len(r.text or "") for r in docs.collect() if r.doc_id == i)
        assert sum(len(t) for _, t in pieces.get(i, [])) == want
    assert "".join(t for _, t in sorted(pieces[5])) == "long word " * 20000
    assert packing.packed(empty(spark)).count() == 0
    assert len({b.bin_id for b in bins}) == len(bins) and len({b.bin_id >> 32 for b in packing.packed(documents(spark, [(None, f"{i} " * 60) for i in range(60)]), 50, 500).collect()}) > 5  # rows without an id go to several shards
    named = spark.createDataFrame([("b", "x" * 9), ("a", "y" * 9)], "doc_id string, text string")
    assert [(b.doc_ids, b.text) for b in packing.packed(named).collect()] == [(["a", "b"], "y" * 9 + "\n" + "x" * 9 + "\n")]


# tokens


def test_bpe_equals_whole_encoding():
    codec = bpe.Codec.of(bpe.TOKENIZER)
    rng = random.Random(2)
    bits = ["a", "b ", " ", "  ", "\n", "é", "ñ ", "1", "漢", "'s", "'ll ", "!", "\t", "word ", "the "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 2500))) for _ in range(80)] + ["", "x" * 20000, " " * 4000, "漢字" * 2000, "a b " * 3000]
    ids, first = codec.encode(*words.buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        own = ids[first[k] : first[k + 1]]
        assert own.tolist() == codec.encoding.encode_ordinary(t) and codec.decode(own).tobytes() == t.encode()


def test_bpe_small_chunks_equal_whole_encoding(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BITS", 5)
    rng = random.Random(4)
    bits = ["a", "b ", " ", "\u00a0", "\u3000", "字", "字，", "漢。", "é", "1", "'s", " 'll", "!", "\t", "\u2003", "\x1f", "\u0085", "_", "word ", "ж "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 900))) for _ in range(120)]
    for codec in (bpe.Codec(bpe.TOKENIZER), bpe.Codec(bpe.TOKENIZER, r"\p{L}+ ?|[^\p{L}]+")):  # blanks belong to the word before: no known points
        assert codec.breaks == (" ?\\p{L}+|" in codec.encoding._pat_str)
        ids, first = codec.encode(*words.buffers(pa.array(texts)))
        assert all(ids[first[k] : first[k + 1]].tolist() == codec.encoding.encode_ordinary(t) for k, t in enumerate(texts))


@pytest.mark.parametrize("unit", ["w{}x ", "字漢{}語，"])
def test_bpe_encodes_shared_chunks_once(unit):
    codec = bpe.Codec(bpe.TOKENIZER)
    rng = random.Random(3)
    passage = "".join(unit.format(rng.randrange(400)) for _ in range(9000))
    codec.encode(*words.buffers(pa.array([passage])))
    before = codec.encoded
    codec.encode(*words.buffers(pa.array(["intro words " + passage, passage + " the end"])))
    assert codec.encoded - before < 12 < before


def test_bpe_odd(spark):
    rows = bpe.encoded(odd(spark)).collect()
    assert len(rows) == 13 and all(r.round_trip is None if r.token_ids is None else r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    back = bpe.decoded(bpe.encoded(odd(spark))).select("doc_id", "text").collect()
    assert sorted(map(str, back)) == sorted(map(str, odd(spark).select("doc_id", "text").collect()))
    assert bpe.encoded(empty(spark)).count() == 0


# chat


def test_chat_spans():
    talk = [("system", "s"), ("user", "hello"), ("assistant", "<think>hm</think> hi"), ("user", "bye"), ("assistant", "<think>x</think>ok")]
    for render in (chat.chatml, chat.headed):
        text, spans, rewrites = chat.locate(render, talk)
        assert not any(rewrites) and all(t.strip() in text[a:b] for (_, t), (a, b) in zip(talk, spans)) and spans[-1][1] == len(text)
    text, spans, rewrites = chat.locate(chat.forgetful, talk)
    assert rewrites == [False, False, False, True, False] and spans[2] is None and text[slice(*spans[1])].startswith("<|im_start|>user\nhello") and "bye" in text[slice(*spans[3])]
    assert chat.locate(chat.chatml, []) == ("", [], [])


def test_chat_odd(spark):
    turns = spark.createDataFrame([(None, 0, "user", "a", 1), (1, None, None, None, 1), (1, 1, "user", "x" * 50000, 1), (1, 1, "user", "x" * 50000, 1), (1, 1, "assistant", "", 1)], "conv_id bigint, turn bigint, role string, text string, segment int")
    rows = chat.formatted(turns).collect()
    assert len(rows) == 5 and sorted(len(r.segment) for r in rows)[-1] > 50000
    assert [r.role for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.span_start)] == [None, "assistant", "user", "user"]
    assert chat.formatted(turns.limit(0)).count() == 0
    lone = chat.formatted(turns.union(turns)).where("conv_id IS NULL").collect()
    assert [(r.span_start, r.segment) for r in lone] == [(0, "<|im_start|>user\na<|im_end|>\n")] * 2


def test_chat_finds_rewritten_history(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(6)] + [(2, 0, "user", "only")], "conv_id bigint, turn bigint, role string, text string")
    rows = {(r.template, r.conv_id, r.turn): r for r in chat.formatted(turns, chat.TEMPLATES).collect()}
    assert [rows["last_four", 1, i].rewrites_history for i in range(6)] == [False] * 4 + [True] * 2 and not any(r.rewrites_history for k, r in rows.items() if k[0] == "chatml")
    assert [rows["last_four", 1, i].segment for i in range(6)] == [""] * 5 + ["<|im_start|>user\nturn 5<|im_end|>\n"] and rows["last_four", 2, 0].span_start == 0 and rows["last_four", 1, 2].span_end == -1


# lines


def test_line_dedup_odd(spark):
    got = sorted(((str(r.doc_id), r.text, r.gone) for r in lines.dedup(odd(spark), removed="gone").collect()), key=str)
    # (null, "one two three") twice is one document; 4 "other" comes with another key; 7 repeats "a"
    assert got == sorted([("None", None, 0), ("None", "one two three", 0), ("None", "one two three", 0), ("1", "", 0), ("2", None, 0), ("3", "   \n\n ", 0), ("4", "x", 0), ("4", "x", 0), ("4", "other", 0), ("5", "long word " * 20000, 0), ("6", "é漢字🙂 ñ", 0), ("7", "a\nb\n", 1), ("8", "!!! ???", 0)], key=str)
    assert lines.dedup(odd(spark)).columns == odd(spark).columns
    crlf = documents(spark, [(1, "a\r\n\r\nb\r\n\t\n\t"), (2, "\r\na\r\n\t\nb")])
    assert [r.text for r in lines.dedup(crlf).orderBy("doc_id").collect()] == ["a\r\n\r\nb\r\n\t\n\t", "\r\n\t\nb"]
    assert lines.dedup(crlf, removed="line").columns == [*(c for c in crlf.columns if c != "line"), "line"]
    assert lines.dedup(empty(spark)).count() == 0


def test_line_dedup_shuffled_hashes_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    docs = documents(spark, [(i, "\n".join(f"line {rng.randrange(300)}" for _ in range(rng.randrange(9)))) for i in range(200)])
    seen, want = set(), {}
    for r in docs.orderBy("doc_id").collect():
        kept = []
        for x in r.text.split("\n"):
            if x.strip() == "" or x not in seen:
                kept.append(x)
            seen.add(x)
        want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == want
    monkeypatch.setattr(lines, "MAX_FILTER", 0)
    assert {r.doc_id: r.text for r in lines.dedup(docs).collect()} == want
    assert lines.dedup(docs, drop_emptied=True).count() == sum(bool(t.strip()) or not r.text.strip() for r in docs.collect() for t in [want[r.doc_id]])


# quality


def test_quality_held_out(spark):
    rng = random.Random(5)

    def one(kind):
        text = prose(rng, rng.randint(30, 200))
        if kind == "bad":
            return text.upper().replace(" ", "!! ")
        return text.replace(" ", " rude ", 1) + " vexing rude" if kind == "toxic" else text

    kinds = [rng.choice(["good", "good", "bad", "toxic"]) for _ in range(900)]
    docs = documents(spark, [(i, one(k)) for i, k in enumerate(kinds)])
    labels = spark.createDataFrame([(i, int(k != "bad"), int(k == "toxic")) for i, k in enumerate(kinds) if i < 600] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id for r in quality.keep(docs, quality.train(docs, labels)).collect()}
    right = sum((i in kept) == (kinds[i] == "good") for i in range(600, 900))
    assert right >= 285


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(5, 2 * (1 + quality.RANK)))
    m = quality.Machine(np.array([0.5, -0.5]), np.arange(5), rows)
    got = m.logits(np.array([0, 2, 3, 4]), np.array([0, 3, 4]))
    for d, ids in enumerate(([0, 2, 3], [4])):
        x = rows[ids].reshape(-1, 2, 1 + quality.RANK)
        want = m.bias + x[:, :, 0].sum(0) + sum((x[i, :, 1:] * x[j, :, 1:]).sum(1) for i, j in itertools.combinations(range(len(ids)), 2))
        assert np.allclose(got[d], want, atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 11, 12, 13])
def test_quality_fits_few_labels(n):
    rng = np.random.default_rng(n)
    ids, offsets = rng.choice(5000, 20 * n, False), np.arange(0, 20 * n + 1, 20)
    targets = np.stack([np.arange(n) % 2, np.zeros(n)], 1).astype(float)
    p = quality.fit(ids, offsets, targets).logits(ids, offsets)
    assert np.isfinite(p).all() and (n == 1 or ((p[:, 0] > 0) == (targets[:, 0] > 0.5)).all()) and (p[:, 1] < 0).all()
    assert np.isfinite(quality.fit(np.zeros(0, int), np.zeros(n + 1, int), targets).bias).all()  # documents without a feature


def test_quality_learns_one_document_of_an_id(spark):
    docs = documents(spark, [(1, f"copy {i}") for i in range(50)] + [(2, "another text"), (None, "x")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    sizes = []
    kept, quality.fit = quality.fit, lambda ids, offsets, targets: sizes.append(len(targets))
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = kept
    assert sizes == [2]


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.keep(odd(spark), quality.train(odd(spark), none)).count() == 13  # nothing learned, nothing rejected
    one = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    scored = quality.scored(odd(spark), quality.train(odd(spark), one))
    clash = quality.scored(odd(spark).withColumn("__Quality", F.lit(3)), quality.train(odd(spark), one))
    assert clash.where("__Quality = 3 AND __quality_1.good IS NOT NULL").count() == 13
    assert scored.where("isnan(__quality.good) OR __quality.good IS NULL").count() == 0 and quality.keep(empty(spark), quality.train(empty(spark), one)).columns == empty(spark).columns


# top-k


def test_top_k_odd(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)], 1) for i in range(40)] + [(100, None, 1), (101, [], 1), (102, [1.0, None, 2.0], 1), (103, [float("nan"), 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0], 1), (104, [1.0, 2.0], 1), (5, [5.0, 1.0, 5.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = {(r.query_id, r.rank): (r.neighbor_id, r.score) for r in topk.top(df, 3, shard=16).collect()}
    v = {i: np.array(e) for i, e, _ in rows[:40]}
    for q in v:
        best = sorted((-round(float(v[q] @ v[i]), 6), i) for i in v if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]
    assert len(got) == 120 and topk.top(df.limit(0)).count() == 0


def test_ball_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 10
    x = np.concatenate([c + rng.normal(size=(200, 8)) * 0.1 for c in centres])
    best = topk.Best(np.arange(len(x)), x, 5)
    best.search(topk.Tree(np.arange(len(x)), x))
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -np.inf)
    assert np.allclose(best.scores, -np.sort(-s, 1)[:, :5]) and best.visited < 0.3 * len(x) * len(topk.Tree(np.arange(len(x)), x).leaves)


@pytest.mark.parametrize("seeds", [3, 16])
def test_top_k_in_chunks_equals_brute_force(spark, monkeypatch, seeds):
    monkeypatch.setattr(topk, "SEEDS", seeds)  # 10 shards: in two passes, and in one
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[40:60] = x[0]  # ties
    df = spark.createDataFrame([(i - 30, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top(df, 4, every=5, shard=30, chunk_bytes=600).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id, r.score))
    assert sorted(got) == list(range(-30, 270, 5))
    for q, rows in got.items():
        s = np.round(x @ x[q + 30], 6)
        want = sorted((-s[i], i - 30) for i in range(300) if i - 30 != q)[:4]
        assert [(a, b) for _, a, b in sorted(rows)] == [(i, -v) for v, i in want]


def test_top_k_of_extreme_vectors():
    x = np.random.default_rng(4).normal(size=(300, 48)) * 1e25
    best = topk.Best(np.arange(300), x, 5)
    best.search(topk.Tree(np.arange(300), x))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.allclose(best.scores, -np.sort(-s, 1)[:, :5])


# language model


def test_lm_prefers_known_text(spark):
    rng = random.Random(6)
    chain = {w: rng.sample(VOCABULARY, 3) for w in VOCABULARY}

    def walk(n):
        out = [rng.choice(VOCABULARY)]
        while len(out) < n:
            out.append(rng.choice(chain[out[-1]]))
        return " ".join(out)

    docs = documents(spark, [(i, walk(400)) for i in range(300)])
    model = lm.train(docs)
    new = [walk(300) for _ in range(20)]
    test = documents(spark, [(i, t) for i, t in enumerate(new)] + [(100 + i, " ".join(rng.sample(t.split(), 300))) for i, t in enumerate(new)])
    bits = {r.doc_id: r.bits_per_word for r in lm.scored(test, model).collect()}
    assert all(bits[i] < bits[100 + i] - 0.3 for i in range(20))
    assert abs(bits[0] * 300 + {r.doc_id: r.log2_prob for r in lm.scored(test, model).collect()}[0]) < 1e-6


def small_model():
    return lm.Model(np.array([5, 9], np.uint64), np.array([3, 2]), np.ones(lm.SIDE), 4000)


def test_lm_probabilities_sum_to_one():
    model = small_model()
    rng = np.random.default_rng(2)
    model.rows[:] = rng.normal(0, 0.5, model.rows.shape)
    features = np.repeat(rng.integers(0, 1 << 63, (lm.FEATURES, 1)).astype(np.uint64), lm.SIDE**2, 1)
    assert abs(np.exp(model.step(np.arange(lm.SIDE**2), features)).sum() - 1) < 1e-3


def test_lm_equal_events_of_a_batch_both_count():
    def moved(n):
        model = small_model()
        model.step(np.zeros(n, int), np.repeat(np.array([[1], [2], [3], [4]], np.uint64), n, 1), 0.1)
        return model.rows

    one, two, many = moved(1), moved(2), moved(40)
    assert np.any(one) and np.allclose(two, 2 * one) and np.allclose(many, lm.LIMIT * one)
    rng = np.random.default_rng(3)
    index, change = (rng.zipf(1.5, 4096) % 700).astype(np.uint16), rng.normal(size=(4096, lm.SIDE)).astype(np.float32)
    got, want = np.zeros((2, 1 << 14, lm.SIDE), np.float32)
    lm.add_summed(got, index, change)
    np.add.at(want, index, change)
    assert np.allclose(got, want * np.minimum(1, lm.LIMIT / np.maximum(np.bincount(index, minlength=1 << 14), 1))[:, None], atol=1e-3)


def test_lm_step_equals_naive_loop():
    """A batch of events against loops over levels, features and outcomes of each."""
    rng, model = np.random.default_rng(7), small_model()
    model.rows[:] = rng.normal(0, 0.3, model.rows.shape)
    features, outcome = rng.integers(0, 40, (lm.FEATURES, 60)).astype(np.uint64), rng.integers(0, 18, 60)
    before, size = model.rows.astype(float), 1 << model.bits
    used = np.zeros(len(before), np.int64)
    got = model.step(outcome, features, 0.1, used)
    change, events, want = np.zeros(before.shape), np.zeros(len(before), int), []
    for e in range(60):
        log = 0.0
        for level in range(2):
            node = int(outcome[e]) // 16 ** (2 - level)
            digit = int(outcome[e]) // 16 ** (1 - level) % 16
            salt = (node * 0xD6E8FEB86659FD93 + level + 1) * 0xA0761D6478BD642F & (1 << 64) - 1
            rows = [(level * 4 + k) * size + ((int(features[k, e]) ^ salt) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 >> 0) // (1 << 64 - model.bits) for k in range(4)]
            logits = model.bias[level][node] + sum(before[r] for r in rows)
            p = np.exp(logits) / np.exp(logits).sum()
            log += math.log(p[digit])
            for r in rows:
                change[r] += 0.1 * ((np.arange(16) == digit) - p)
                events[r] += 1
        want.append(log)
    change *= np.minimum(1, lm.LIMIT / np.maximum(events, 1))[:, None]
    assert np.allclose(got, want, atol=1e-4) and np.allclose(model.rows, before + change, atol=1e-4) and used.tolist() == events.tolist()


def test_lm_average_weighs_rows_by_use():
    rng = np.random.default_rng(1)
    n, w = rng.integers(0, 3, (3, lm.ROWS)).astype(np.uint32), rng.normal(size=(3, lm.ROWS, lm.SIDE)).astype(np.float16)
    batch = pa.RecordBatch.from_arrays([pa.array([lm.GROUP + 1] * 3, pa.int32()), pa.array([x.tobytes() for x in n], pa.binary()), pa.array([x.tobytes() for x in w], pa.binary())], ["block", "n", "w"])
    (out,) = lm._average((pa.scalar(1),), [batch])
    got = np.frombuffer(out.column(1)[0].as_py(), np.float16).reshape(lm.ROWS, lm.SIDE)
    want = (w.astype(float) * n[:, :, None]).sum(0) / np.maximum(n.sum(0), 1)[:, None]
    assert out.column(0).to_pylist() == [lm.GROUP + 1] and np.allclose(got, want, atol=1e-2)


def test_lm_rare_words_share_an_outcome(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEVELS", 3)  # 3840 words of their own
    many = [f"r{i}" for i in range(6000)]
    docs = documents(spark, [(0, " ".join(w for i, w in enumerate(many) for _ in range(9 if i < 4500 else 1 + i % 5)))])
    test = documents(spark, [(i, w) for i, w in enumerate([*many, "unseen"])] + [(0, many[0])])
    bits = {}
    for held in (1 << 20, 5000, 0):  # the counts of none, of some and of all words are joined
        monkeypatch.setattr(lm, "HELD", held)
        model = lm.train(docs)
        assert (model.tail is None) == (held > 6000) and model.top == 3840
        rows = lm.scored(test, model).collect()
        assert len(rows) == 6002
        bits[held] = {r.doc_id: r.bits_per_word for r in rows}
        assert 0.9 < sum(2**-b for b in bits[held].values()) < 1.01
    assert all(abs(bits[h][i] - b) < 1e-4 for i, b in bits[1 << 20].items() for h in (5000, 0))
    monkeypatch.undo()
    assert lm.train(docs).top == 6000 and lm.train(test.limit(9)).levels < lm.train(docs).levels


def test_lm_odd(spark):
    rows = lm.scored(odd(spark), lm.train(odd(spark))).collect()
    assert len(rows) == 13 and all((r.perplexity is None) == (r.n_words == 0) for r in rows)
    assert lm.scored(empty(spark), lm.train(empty(spark))).count() == 0


# vectors


def test_vector_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noisy = base[rng.integers(0, 60, 120)] + rng.normal(size=(120, 16)) * 0.02
    x = np.concatenate([base, noisy, base[:5]])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, root int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= vectors.THRESHOLD
    label = np.arange(len(x))
    while (new := np.array([label[n].min() for n in near])).tolist() != label.tolist():
        label = new
    want = {(i, int(r)) for i, r in enumerate(label) if i != r}
    rows = vectors.classed(df).collect()
    got = {(r.vec_id, r.class_id) for r in rows if not r.keep}
    assert len(rows) == len(x) and len(got & want) >= 0.9 * len(want) and got <= want | {(i, j) for i, j in got if near[i, j]}
    different = near[:, :-5]  # the last five are copies of the first
    full = {i: int(n) - 1 for i, n in enumerate(different.sum(1))}
    assert all(r.links <= full[r.vec_id] and r.copies == 1 + (r.vec_id < 5 or r.vec_id >= 420) for r in rows) and sum(r.links for r in rows) >= 0.9 * sum(full.values())
    monkeypatch.setattr(vectors, "BLOCK", 16)
    assert sorted(vectors.classed(df).collect()) == sorted(rows)


def test_vector_pairs_of_several_cells_count_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MARGIN", 3.0)  # all vectors are guests everywhere, so every pair is seen
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= vectors.THRESHOLD).sum(1) - 1
    for block in (2048, 7):
        monkeypatch.setattr(vectors, "BLOCK", block)
        assert [r.links for r in vectors.classed(df).orderBy("vec_id").collect()] == want.tolist()


def test_vector_dedup_odd(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0]), (None, [3.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, size int, __rid int")
    assert sorted((str(r.vec_id), r.class_id) for r in vectors.classed(df).collect() if not r.keep) == [("5", 5), ("6", 5), ("None", 5)] and vectors.classed(df).count() == 10
    assert sorted(str(r.vec_id) for r in vectors.dedup(df).collect()) == ["1", "2", "3", "4", "5", "7", "8"] and vectors.dedup(df).columns == df.columns
    assert vectors.classed(df.limit(0)).count() == 0 and vectors.dedup(df.limit(0)).count() == 0


# pages


def site(n):
    return [(f"http://A.example/{i}", f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></li><li>About us</li></ul></nav><div class=main><h1>Title {i}</h1>" + "".join(f"<p>Story {i} of part {j}</p>" for j in range(1 + i % 4)) + "</div><footer>Copyright A &amp; B</footer></body></html>") for i in range(n)]


def test_site_noise_goes_and_stories_stay(spark):
    pages = spark.createDataFrame([(i, u, h, "z") for i, (u, h) in enumerate(site(24))], "page_id int, url string, html string, node string")
    rows = {r.page_id: r for r in sitetree.extracted(pages).collect()}
    for i in range(24):
        assert rows[i].text.split("\n") == [f"Title {i}"] + [f"Story {i} of part {j}" for j in range(1 + i % 4)]
    assert sorted(map(str, sitetree.extracted(pages, 0).collect())) == sorted(map(str, rows.values()))


def naive_texts(pages):
    """The texts of a host's different pages, by a style tree of whole DOMs and entropies as they are defined."""
    roots = [sitetree.parse(h) for h in pages]

    def look(nodes):
        """(importance, the greatest in the branch, what to look at below) of the nodes at one place of the pages."""
        m, leaves, variants = len(nodes), [n for n in nodes if not n.children], {}
        for n in nodes:
            if n.children:
                variants.setdefault(tuple(c.sign for c in n.children), []).append(n)
        below = [[look(c) + (c,) for c in zip(*(n.children for n in own))] for own in variants.values()]
        if m < sitetree.MIN_PAGES:
            return 1.0, 1.0, below
        shares = [len(v) / m for v in variants.values()] + ([len(leaves) / m] if leaves else [])
        entropy = -sum(s * math.log(s, m) for s in shares)
        inner, most = 0.0, 0.0
        for own, children in zip(variants.values(), below):
            known = len(own) > 1
            inner += len(own) / m * (sum(c[0] for c in children) / len(children) if known else 1.0)
            most = max([most, *(c[1] for c in children)]) if known else 1.0
        if leaves:
            seen = [sum(n.tag == x.tag and n.content == x.content for n in leaves) for x in leaves]
            inner += len(leaves) / m * (1 - sum(math.log(x, len(leaves)) for x in seen) / len(leaves) if len(leaves) > 1 else 1.0)
        weight = 0.9 ** len(shares)
        value = (1 - weight) * entropy + weight * inner if variants else inner
        return value, max(most, value), below

    cut = set()

    def mark(looked, nodes):
        if looked[1] < sitetree.THRESHOLD:
            cut.update(id(n) for n in nodes)
            return
        for children in looked[2]:
            for c in children:
                mark(c[:3], c[3])

    mark(look(roots), roots)

    def text(node):
        if id(node) in cut:
            return ""
        own = node.content if node.tag == "#text" else "".join(map(text, node.children))
        return f" {own} " if node.tag == "#text" else own if node.tag in sitetree._INLINE else f"\n{own}\n"

    return ["\n".join(" ".join(x.split()) for x in text(r).split("\n") if x.strip()) for r in roots]


def test_site_tree_equals_naive(spark):
    rng = random.Random(12)

    def some(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Home", "About", f"News {rng.randrange(40)}", f"Item {rng.randrange(4)}"])
        tag, name = rng.choice(["div", "ul", "b", "section"]), rng.choice(["", " class=x", " class='y z'"])
        return f"<{tag}{name}>" + "".join(some(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    parts = [some(3) for _ in range(6)]
    pages = sorted({"<body>" + "".join(rng.choice(parts[:2]) if rng.random() < 0.7 else some(2) if rng.random() < 0.5 else rng.choice(parts) for _ in range(rng.randint(2, 4))) + f"<p>Story {rng.randrange(25)}</p><footer>All rights</footer></body>" for _ in range(60)})
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id int, url string, html string")
    want = naive_texts(pages)
    for most in (sitetree.MAX_SET, 0):
        assert [r.text for r in sitetree.extracted(df, most).orderBy("page_id").collect()] == want
    assert any(len(w) < len(" ".join(sitetree.extract(sitetree.parse(p), 0, None)[0].split())) for w, p in zip(want, pages))


@pytest.mark.parametrize("page", ["<a " * 340000, "<a \"" * 250001, "<a " * 340000 + "\">\"", "<b>" * 200000 + "</i>" * 200000, "<ul><li><ul>" + "<b>" * 150000 + "<li></li>" * 60000, "<a '\">" * 150000, "<" * 1000000, "<!" * 500000, "<p class=" * 100000 + ">"])
def test_broken_markup_takes_little_time(page):
    began = time.process_time()
    sitetree.extract(sitetree.parse(page), 0, None)
    assert time.process_time() - began < 5


def test_markup_without_ends():
    text = lambda page: sitetree.extract(sitetree.parse(page), 0, None)[0]
    assert text("1 < 2 <b>x</b> <a href='>'>y</a> <c") == "1 < 2 x y <c"
    assert text("a <i title=\"it's\">b</i> <u x='>c</u> d") == "a b c d"
    assert text("a<script>if (a<b) x()</SCRIPT >b<style>c") == "a b" and text("<!doctype html><?x y?>t<!-- a > b -->u<!-- v") == "t u"


@pytest.mark.parametrize("ids", [[7] * 6, [None] * 6, [7, 7, 8, None, None, 9]])
def test_repeated_pages_count_as_one(spark, ids):
    html = "<html><body><h1>Only page</h1><p>Its text</p></body></html>"
    pages = spark.createDataFrame([(i, "http://one.example/", html) for i in ids], "page_id int, url string, html string")
    for most in (sitetree.MAX_SET, 0):
        assert [r.text for r in sitetree.extracted(pages, most).collect()] == ["Only page\nIts text"] * 6


def test_pages_odd(spark):
    long = "<p>" + "word " * 50000 + "</p>"
    rows = [(1, None, None), (2, "", ""), (3, "http://b/", "plain <b>x"), (4, "http://b:80/x", "<p>one<p>two</b></div>"), (5, "nonsense", long), (None, "http://c/", "<div class='a>b'>&lt;ok</div><!-- no"), (6, "http://d/", "<div>same text</div>"), (7, "http://d/1", "<div>same text</div>"), (6, "http://d/", "<div>same text</div>")]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id int, url string, html string, host int")
    got = {r.page_id: r.text for r in sitetree.extracted(pages).collect()}
    assert (got[1], got[2], got[3], got[4], got[None], got[6], got[7]) == (None, "", "plain x", "one\ntwo", "<ok", "same text", "same text") and got[5] == ("word " * 50000).strip()
    assert sitetree.extracted(pages.limit(0)).count() == 0


# near duplicates


def shingles_of(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_minhash_equals_brute_force(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(40, 300)) for _ in range(120)]
    for k in range(40):
        w = texts[k].split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += texts[:10] * 3
    docs = documents(spark, list(enumerate(texts)))
    sets = [shingles_of(t) for t in texts]
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= minhash.THRESHOLD * len(sets[i] | sets[j]):
            a, b = label[i], label[j]
            label = [min(a, b) if x in (a, b) else x for x in label]
    want = {(i, r) for i, r in enumerate(label) if i != r}
    rows = minhash.classed(docs).collect()
    got = {(r.doc_id, r.class_id) for r in rows if not r.keep}
    assert len(rows) == len(texts) and all(r.keep == (r.class_id == r.doc_id) for r in rows)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)
    kept = minhash.dedup(docs)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in got} and kept.columns == docs.columns


def test_minhash_links_are_counted_once(spark, monkeypatch):
    rng, base = random.Random(9), []
    for _ in range(4):
        words_ = [rng.choice(VOCABULARY) for _ in range(120)]
        for k in range(25):  # texts of a chain: each like the next ones, the first unlike the last
            words_[(k * 5) % 120 : (k * 5) % 120 + 4] = [rng.choice(VOCABULARY) for _ in range(4)]
            base.append(" ".join(words_))
    docs = documents(spark, list(enumerate(base + base[:7])))
    hashed = [minhash.shingles(*words.word_hashes(*words.buffers(pa.array([t])))) for t in base]
    sigs = np.concatenate([minhash.signatures(h, np.array([0])) for h, _ in hashed])
    bands = sigs.view(np.int64)
    near = [[j for j in range(100) if j != i and (sigs[i] == sigs[j]).sum() >= 64 and (bands[i] == bands[j]).any()] for i in range(100)]
    for block in (2048, 3):
        monkeypatch.setattr(minhash, "BLOCK", block)
        rows = {r.doc_id: r for r in minhash.classed(docs).collect()}
        assert all(rows[i].links == len(near[i]) and rows[i].copies == 1 + (i < 7) for i in range(100)) and rows[100].links == rows[0].links
        assert max(len(n) for n in near) > 6


def test_min_max_estimate():
    rng = np.random.default_rng(4)
    both, a, b = (rng.integers(0, 1 << 32, n).astype(np.uint32) for n in (600, 200, 200))
    s = minhash.signatures(np.concatenate([both, a, both, b]), np.array([0, 800]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


def test_spanning():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 200, 120), rng.integers(0, 200, 120)
    label = spanning(200, x, y)
    want = np.arange(200)
    for _ in range(200):
        for i, j in zip(x, y):
            want[want == max(want[i], want[j])] = min(want[i], want[j])
    assert label.tolist() == want.tolist()


def test_minhash_odd(spark):
    rows = minhash.classed(odd(spark)).collect()
    assert len(rows) == 13 and sorted((str(r.doc_id), str(r.class_id)) for r in rows if not r.keep) == [("4", "4"), ("None", "None")]
    assert minhash.dedup(odd(spark)).count() == 11 and minhash.dedup(odd(spark)).columns == odd(spark).columns
    assert minhash.dedup(empty(spark)).count() == 0 and minhash.classed(empty(spark)).count() == 0


# the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    good = [(i, "\n".join(prose(rng, 40) + "." for _ in range(4))) for i in range(150)]
    bad = [(1000 + i, prose(rng, 80).upper().replace(" ", "!! ")) for i in range(60)]
    near = [(2000 + i, " ".join(good[i][1].replace("\n", " ").split()[:-3]) + " changed end") for i in range(10)]
    docs = documents(spark, good + bad + near).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad if i % 3], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        seen.append({r.doc_id for r in now.select("doc_id").collect()} if "doc_id" in now.columns else None)
    assert seen[0] == {i for i, _ in good + near} and seen[1] == seen[0] and seen[2] == {i for i, _ in good} and seen[3] is None
    bins = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(i for b in bins for i in b.doc_ids) == sorted(i for i, _ in good) and sum(sum(b.lengths) for b in bins) == sum(len(t) for _, t in good)


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline

    names = ("doc_id", "text", "lang", "source", "n_chars")
    odd(spark).select(*names).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    empty(spark).select(*names).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for d in "ab":
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / d / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
    assert "x" in "".join(r.text for r in corpus_pipeline.run(spark, str(tmp_path / "a")).collect())


def test_no_local_checkpoint():
    here = os.path.dirname(registry.__file__)
    assert not any("localCheck" + "point" in open(os.path.join(here, f)).read() for f in os.listdir(here) if f.endswith(".py"))
