"""What models learn from, and how much work and planning that takes."""

import cProfile
import pstats
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchloom.llm import context_mixing, mixing, quality_model

WORDS = [f"w{i}x{i * 7 % 13}" for i in range(40)]


# 1: context mixing


def test_every_training_text_teaches_the_gate(spark):
    """Other orders of the same words in a few of many texts change how all texts are scored."""
    ids = spark.range(1_600).select(F.col("id").alias("doc_id"))
    last = ids.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).desc()).limit(60)
    last = {row.doc_id for row in last.collect()}

    def scores(of_last):
        own = lambda i: [WORDS[(i + k) % 40] for k in range(6)]
        rows = [(i, " ".join(of_last(own(i)) if i in last else own(i) * 2)) for i in range(1_600)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = context_mixing.scored(docs, F.col("doc_id") % 5 == 1).where(~F.col("doc_id").isin(*last))
        return found.agg(F.sum("score")).first()[0]

    assert scores(lambda x: x * 2) != pytest.approx(scores(lambda x: [w for w in x for _ in (0, 1)]), rel=1e-6)


def test_every_type_teaches_the_mixer():
    tokens = [f"{i:x}".encode() for i in range(45_000)]
    batches = [pa.RecordBatch.from_pydict({"token": pa.array(part, pa.binary()), "c": pa.array([2] * len(part))}) for part in (tokens[:10_000], tokens[10_000:])]
    counts = np.ones((len(context_mixing.ORDERS), 1 << context_mixing.SLOT_BITS, 2), np.float32)
    pieces = context_mixing._fit_mixer(counts)(iter(batches))
    learned, refine = (np.frombuffer(zlib.decompress(x["part"][0].as_py())) for x in pieces)
    bits = 8 * sum(len(t) + 1 for t in tokens)
    assert learned.reshape(64, -1)[:, 0].sum() == bits == refine.sum()


def test_classes_are_the_same_however_texts_are_dealt(spark):
    kinds = [WORDS[:15], WORDS[15:25], WORDS[25:]]
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(kinds[i % 3], 5 + i % 23)),) for i in range(90)]
    rows += [(None,), ("",)]
    one, many = (
        context_mixing.fit_classes(spark.createDataFrame(rows, "text string").select(F.col("text").cast("binary")).repartition(n))
        for n in (1, 5)
    )
    assert np.allclose(one.prior, many.prior) and np.allclose(one.logs, many.logs)
    assert np.allclose(np.exp(one.prior).sum(), 1) and np.allclose(np.exp(one.logs).sum(axis=1), 1)
    told = one.of([[*(w.encode() for w in kind), b""] for kind in kinds])
    assert len(set(told.tolist())) == 3


def test_gate_by_ratios_met_against_plain_steps():
    rng = np.random.default_rng(3)
    cell, ratio = rng.integers(0, 4, 3_000), np.where(rng.random(3_000) < 0.5, 0, 2 ** rng.normal(3, 4, 3_000))
    met = np.zeros((4, context_mixing.RATIOS + 1))
    np.add.at(met, (cell, context_mixing.ratio_bins(ratio)), 1)
    gate = np.full(4, 0.3)
    for _ in range(context_mixing.GATE_ROUNDS):
        part = gate[cell] * ratio / (gate[cell] * ratio + 1 - gate[cell])
        gate = (np.bincount(cell, part) + 3) / (np.bincount(cell) + 10)
    assert np.allclose(context_mixing.fit_gate(met), gate, atol=2e-3)


def test_like_bytes_are_spelled_once(monkeypatch):
    rng = np.random.default_rng(4)
    shape = len(context_mixing.ORDERS), 1 << context_mixing.SLOT_BITS
    model = context_mixing.Spelling(
        rng.normal(size=shape).astype(np.float32), rng.normal(size=(64, shape[0])).astype(np.float32),
        rng.uniform(0.1, 0.9, (256, context_mixing.CELLS)).astype(np.float32),
    )
    tokens = [b"%s%d" % (word, i % 5) for i in range(400) for word in (b"beginnings", b"", b"aaaaaaaaaaaa", b"\xff")] + [b""]
    alone = np.concatenate([context_mixing.spelled(model, [token]) for token in tokens])
    found, slots = [], context_mixing.slots
    monkeypatch.setattr(context_mixing, "slots", lambda *x: found.append(slots(*x)) or found[-1])
    assert np.allclose(context_mixing.spelled(model, tokens), alone)
    assert sum(map(len, found)) < 40 * sum(len(t) + 1 for t in tokens) / 50


def random_spelling(rng):
    shape = len(context_mixing.ORDERS), 1 << context_mixing.SLOT_BITS
    return context_mixing.Spelling(
        rng.normal(size=shape).astype(np.float32), rng.normal(size=(64, shape[0])).astype(np.float32) / 4,
        rng.uniform(0.1, 0.9, (256, context_mixing.CELLS)).astype(np.float32),
    )


def test_contexts_reach_over_words():
    texts = [None, "the cat sat on it", "a dog sat on it", "q" * 30 + " b", "cat cat cat", ""]
    groups = [context_mixing.group_of(pa.array([x and x.encode() for x in part], pa.binary())) for part in (texts, texts[1:3])]
    data, place, since, starts = context_mixing._joined(groups)
    plain = [b"".join(x + b" " for x in (x or "").encode().split()) + b"\n" for x in texts + texts[1:3]]
    assert data.tobytes() == b"".join(plain)
    own = np.concatenate([np.arange(len(x)) for x in plain])
    in_token = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    assert np.array_equal(since, np.minimum(own, 7)) and np.array_equal(place, np.minimum(in_token, 7))
    kinds = context_mixing.Kinds.of(data, place, since)
    for of_kinds, context in zip(kinds.contexts(), context_mixing.contexts(data, own)):
        assert np.array_equal(of_kinds[kinds.at], context)
    # The same token costs more or less after other words.
    logs = context_mixing.spelled_after(random_spelling(np.random.default_rng(6)), data, place, since, starts)
    by_token = {}
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)])):
        by_token.setdefault((data[max(0, a - min(6, own[a])) : b].tobytes()), []).append(logs[i])
    assert all(np.allclose(x, x[0]) for x in by_token.values())
    assert abs(by_token[b"e cat sat "][0] - by_token[b"a dog sat "][0]) > 0.01
    # What the mixer learns from sees the same contexts.
    before = [data[a - min(6, own[a]) : a].tobytes() for a in starts]
    tokens = [data[a:b].tobytes().rstrip() for a, b in zip(starts, [*starts[1:], len(data)])]
    assert all(np.array_equal(x, y) for x, y in zip(context_mixing._after(before, tokens), context_mixing.contexts(data, own)))


def test_bytes_after_a_word_are_a_distribution():
    texts = [b"some words " + bytes([i]) for i in range(256)]
    data, place = np.frombuffer(b"".join(texts), np.uint8), np.tile([0, 1, 2, 3, 4, 0, 1, 2, 3, 4, 5, 0], 256)
    since, starts = np.tile(np.arange(12), 256), np.add.outer(np.arange(256) * 12, [0, 5, 11]).ravel()
    logs = context_mixing.spelled_after(random_spelling(np.random.default_rng(2)), data, place, since, starts)
    assert np.exp(logs[2::3]).sum() == pytest.approx(1, abs=1e-4)


def test_words_in_their_order_are_likelier(spark):
    """Every word comes as often as before; only what stands before it differs."""
    names = ["".join(chr(97 + (i * k + k) % 26) for k in (1, 3, 5, 7, 9)) for i in range(20)]
    rows = [(5 * i, " ".join(names[(i + k) % 20] for k in range(8))) for i in range(400)]
    rows += [(1, " ".join(names[:8])), (6, " ".join(names[i] for i in (3, 0, 5, 2, 7, 4, 1, 6)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in context_mixing.scored(docs, F.col("doc_id") % 5 == 1).where("held_out").collect()}
    assert found[1] > found[6] + 3


def plain_mixer(counts, batch):
    """The mixer's sums, each byte looked up for itself."""
    weights, rng = np.full((64, len(context_mixing.ORDERS)), 0.3), np.random.default_rng(7)
    learned, total, refine = np.zeros(64), np.zeros(weights.shape), np.zeros((256, context_mixing.CELLS, 2))
    batch = batch.take(pa.array(rng.permutation(len(batch))))
    for start in range(0, len(batch), 500):
        part = batch.slice(start, 500)
        data, place, starts = context_mixing._bytes(part.column("token").to_pylist())
        own = np.repeat(1 + np.log(part.column("c").to_numpy()), np.diff(np.append(starts, len(data))))
        last = np.where(place > 0, np.append(0, data[:-1]), 0)
        made, times, step = context_mixing.contexts(data, place), np.zeros(64), np.zeros(weights.shape)
        for bit, node, value in context_mixing.bits_of(data):
            met = [x[context_mixing.slots(c, o, node)] - np.stack([own * (1 - value), own * value], axis=1) for x, c, o in zip(counts, made, context_mixing.ORDERS)]
            odds = np.array([np.log((np.maximum(x[:, 1], 0) + 0.4) / (np.maximum(x[:, 0], 0) + 0.4)) for x in met]).T
            gate = context_mixing.gates(place, bit)
            mixed = np.clip((odds * weights[gate]).sum(axis=1), -8, 8)
            np.add.at(times, gate, 1)
            np.add.at(step, gate, odds * (value - 1 / (1 + np.exp(-mixed)))[:, None])
            np.add.at(refine, (last, np.rint((mixed + 8) * 2).astype(int), value), 1)
        total += weights * times[:, None]
        learned += times
        weights += 0.02 * step / np.maximum(times, 1)[:, None] ** 0.5
    return np.column_stack([learned, total]), refine


def test_like_bytes_teach_the_mixer_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    tokens = [b"%s%d" % (word, i % 300) for i in range(600) for word in (b"beginnings", b"aaaaaaaaaaaa", b"\xff")] + [b"", b"q" * 900]
    batch = pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.binary()), "c": pa.array(rng.integers(1, 4, len(tokens)))})
    counts = rng.uniform(0, 9, (len(context_mixing.ORDERS), 1 << context_mixing.SLOT_BITS, 2)).astype(np.float32)
    found, slots = [], context_mixing.slots
    expected = plain_mixer(counts, batch)

    def mixed():
        pieces = [*context_mixing._fit_mixer(counts)(iter([batch.slice(0, 0), batch]))]
        return [np.frombuffer(zlib.decompress(x["part"][0].as_py())) for x in pieces]

    monkeypatch.setattr(context_mixing, "slots", lambda *x: found.append(slots(*x)) or found[-1])
    once = mixed()
    assert sum(map(len, found)) < 40 * sum(len(t) + 1 for t in tokens) / 4
    monkeypatch.setattr(context_mixing, "SPAN", 150)  # steps are cut, too
    for learned, refine in (once, mixed()):
        assert np.allclose(learned.reshape(64, -1), expected[0])
        assert np.array_equal(refine.reshape(expected[1].shape), expected[1])


def test_rounds_over_the_texts_take_few_tasks(spark, monkeypatch):
    tasks, summed = [], context_mixing._summed
    monkeypatch.setattr(context_mixing, "_summed", lambda pieces, *x: tasks.append(pieces.rdd.getNumPartitions()) or summed(pieces, *x))
    texts = spark.createDataFrame([(" ".join(WORDS[i % 30 : i % 30 + 9]),) for i in range(240)], "text string").repartition(24)
    context_mixing.fit_classes(texts.select(F.col("text").cast("binary")))
    assert len(tasks) > 2 and max(tasks) <= 24 // 4


def test_tokens_of_groups_against_plain_ones():
    texts = [None, "", " \t", "A b\x0bA\n", "\x1cx\x85 É é\xa0Z  z ", "b", "q" * 70]
    group = context_mixing.group_of(pa.array([x and x.encode() for x in texts], pa.binary()))
    names = group.different.to_pylist()
    plain = [[*(x or "").encode().lower().split(), b""] for x in texts]
    assert [[names[i] for i in group.at[a:b]] for a, b in zip(group.ends, group.ends[1:])] == plain
    assert group.doc.tolist() == [i for i, x in enumerate(plain) for _ in x]
    batch = pa.RecordBatch.from_pydict({"held_out": [False, True], "text": pa.array([b"a a b", b"c"])})
    classes = context_mixing.Classes(np.zeros((context_mixing.CLASSES, context_mixing.BUCKETS)), np.zeros(context_mixing.CLASSES))
    rows = [row for part in context_mixing._count(classes)(iter([batch, batch])) for row in part.to_pylist()]
    assert {row["token"]: sum(row[k] for k in context_mixing.CLASS_COUNTS) for row in rows} == {b"a": 4, b"b": 2, b"c": 0, b"": 2}


# 4: quality model


def calls(run):
    profile = cProfile.Profile()
    profile.runcall(run)
    return pstats.Stats(profile).total_calls


def test_facts_and_scores_take_few_calls():
    texts = ["A few words, Said again; and 42 more! " * 500] * 20
    words = 20 * 500 * 8
    assert calls(lambda: [quality_model.labels(f) for f in quality_model.Facts.all(texts)]) < words / 20
    assert calls(lambda: [*quality_model.Hasher().sums(texts, np.ones(quality_model.BUCKETS))]) < words / 20


def test_facts_by_hand():
    texts = [None, "", " \n \n ", "x\xa0y \x1cq\x85 Ⓐ", "A a a. 12 #!\nA a a. 12 #!", "ǅ ª² ½ 😀", "\x00 b?"]
    for text, found in zip(texts, quality_model.Facts.all(texts), strict=True):
        words = quality_model.WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if x.strip()]
        assert vars(found) == {
            "words": len(words), "letters": sum(map(str.isalpha, text or "")), "upper": sum(map(str.isupper, text or "")),
            "symbols": sum(c in quality_model.SYMBOLS for c in text or ""),
            "bare": sum(not any(map(str.isalpha, w)) for w in words), "distinct": len(set(words)),
            "repeated": sum(a == b for a, b in zip(words, words[1:])), "lines": len(lines),
            "distinct_lines": len(set(lines)), "ends": sum(w[-1] in ".!?" for w in words),
        }


def test_words_are_kept_right_beyond_the_bound(monkeypatch):
    texts = [" ".join(WORDS[i : i + 9] * 2) for i in range(30)] + ["", None]
    weights = np.random.default_rng(2).normal(size=quality_model.BUCKETS)
    whole = np.concatenate([*quality_model.Hasher().sums(texts, weights)])
    monkeypatch.setattr(quality_model, "KEPT_WORDS", 10)
    monkeypatch.setattr(quality_model, "GROUP", 20)
    assert np.allclose(np.concatenate([*quality_model.Hasher().sums(texts, weights)]), whole)
    hasher = quality_model.Hasher()
    for text, total in zip(texts[:30], whole):
        at, share = hasher.features(text)
        assert weights[at] @ share == pytest.approx(total)
    assert (whole[30:] == -np.inf).all()


# 6: mixing


def test_raking_plans_stay_small(spark, monkeypatch):
    rows = [(s, l, t, float(1 + i)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "mn")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    joins = []
    write = mixing.staged

    def spy(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df)

    monkeypatch.setattr(mixing, "staged", spy)
    raked = mixing.rake(cells, mixing.default_targets(cells)).collect()
    assert len(raked) == len(rows) and raked[0].margin_error < mixing.TOLERANCE
    assert max(joins) <= 2
    # The goals are in the cells, so a step joins its margin and nothing else.
    assert set(joins[-len(mixing.DIMENSIONS) :]) == {1}
