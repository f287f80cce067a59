from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import classifier as mil
from shoplens.llm import context_mixing as cm
from tests.llm.conftest import prose, words


def _labelled(n: int):
    rnd = random.Random(4)
    rows, labels = [], []
    for k in range(n):
        good = k % 4 != 0
        text = prose(rnd, rnd.randint(2, 14))
        if not good:  # junk in one part of the text only
            text += "\n" + " ".join(w.upper() + "!!" for w in words(rnd, 90)) + "\n" + prose(rnd, 3)
        rows.append((k, text))
        labels.append((k, int(good), 0))
    return rows, labels


def test_gradient():
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(n, mil.FEATURES)) for n in (1, 3, 5)], np.array([1.0, 0.0, 1.0])
    m = {"W": rng.normal(0, .2, (mil.FEATURES, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)),
         "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(0.1)}
    x, sizes = np.concatenate(bags), np.array([1, 3, 5])

    def loss():
        p = mil._forward(m, x, sizes)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    grad = mil._gradient(m, x, sizes, y)
    for k in m:
        flat = m[k].reshape(-1)
        for i in range(min(5, flat.size)):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            assert grad[k].reshape(-1)[i] == pytest.approx((up - loss()) / 2e-5, abs=1e-6), k
            flat[i] = was


def test_held_out_accuracy(spark):
    rows, labels = _labelled(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mil.train(docs, labelled)
    got = {r.doc_id: r for r in mil.score(docs, model).collect()}
    out = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k].quality_score >= 0.5) == (labels[k][1] == 1) for k in out]) >= 0.95
    again = {r.doc_id: r.quality_score for r in mil.score(docs.repartition(2), mil.train(docs.repartition(3), labelled)).collect()}
    assert all(abs(again[k] - got[k].quality_score) < 1e-6 for k in again)


def test_classifier_cases(spark, docs, corpus, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = mil.train(docs, none)
    assert model.weights is None
    scored = mil.score(docs, model)
    assert scored.columns == [*docs.columns, "quality_score"] and scored.count() == len(corpus)
    odd = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = mil.score(docs, mil.train(docs, odd)).collect()
    assert len(rows) == len(corpus) and all(0 <= r.quality_score <= 1 for r in rows)
    assert mil.score(empty, model).count() == 0
    assert mil.passages("").shape == (1, mil.FEATURES) and mil.passages("word " * 1000, 5).shape[0] == 5


def test_repetition_is_seen_in_very_long_texts():
    distinct = [f"w{k}" for k in range(30_000)]
    x = mil.passages(" ".join(distinct * 2))
    again = x[-(-len(distinct) // mil.PASSAGE):, mil._N_CLASSES + 2]
    assert len(again) and (again == 1).all()


# ---- context mixing ------------------------------------------------------------


def test_code_is_a_prefix_code():
    rng = np.random.default_rng(1)
    code = cm.Code(rng.integers(0, 50, (256, 256)) * (rng.random((256, 256)) < 0.1))
    for before in (0, 97, 255):
        n = code.length[before * 256:before * 256 + 256].astype(float)
        assert (2.0 ** -n).sum() == pytest.approx(1.0)
    assert (code.steps < 2 * 65536).all() and (code.steps >= 0).all()


def test_bits_do_not_depend_on_their_neighbours():
    code = cm.Code(np.ones((256, 256), int))
    texts = [b"some words here \n", b"\n", b"others and others \n" * 60]
    together, alone = cm.Bits(code, texts), [cm.Bits(code, [t]) for t in texts]
    for k, b in enumerate(alone):
        own = together.lane == k
        assert np.array_equal(together.node[own], b.node) and np.array_equal(together.bit[own], b.bit)
        for s, z in zip(together.slots, b.slots):
            assert np.array_equal(s[own], z)


def test_probabilities_add_up():
    """Over all next bytes after one beginning the model's probabilities add up to 1."""
    rng = np.random.default_rng(2)
    code = cm.Code(rng.integers(0, 50, (256, 256)))
    tables = [rng.integers(-3000, 3000, 1 << s).astype(np.int16) for s in cm.SLOTS]
    model = cm.Mixer(code, tables, cm._start_weights())
    start = b"the and of th"
    logs = model.logs([start + bytes([b]) for b in range(256)])
    assert np.exp(logs - model.logs([start])[0]).sum() == pytest.approx(1.0, abs=1e-4)


def test_mixing_against_slow_loop():
    """One text bit by bit, weights updated after each block."""
    rng = np.random.default_rng(3)
    code = cm.Code(rng.integers(0, 50, (256, 256)))
    tables = [rng.integers(-3000, 3000, 1 << s).astype(np.int16) for s in cm.SLOTS]
    text = " ".join(words(random.Random(1), 120)).encode() + b"\n"
    b = cm.Bits(code, [text])
    w, total = np.full((cm.GATES, cm.INPUTS), 0.35), 0.0
    for a, z in zip(b.steps, b.steps[1:]):
        change = np.zeros_like(w)
        for i in range(a, z):
            v = [int(t[s[i]]) for t, s in zip(tables, b.slots)]
            x = np.array([code.logit[b.node[i]], *((k >> 3) / 240 for k in v)])
            g = (v[0] & 7) * 8 + (v[1] & 7)
            p = 1 / (1 + math.exp(-min(12, max(-12, float(w[g] @ x)))))
            total += math.log(p if b.bit[i] else 1 - p)
            if (i - a) % cm.EVERY == 0:
                change[g] += cm.EVERY * cm.PACE * (b.bit[i] - p) * x
        w += change
    assert cm.Mixer(code, tables, cm._start_weights()).logs([text])[0] == pytest.approx(total, rel=1e-3)


def test_scores(spark, docs, corpus, empty, monkeypatch):
    toks = {k: [*(r[1] or "").encode().lower().split(), b"\n"] for k, r in enumerate(corpus)}
    out = {k: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for k, r in enumerate(corpus)}
    c = Counter(t for k, ts in toks.items() if not out[k] for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), out[k], len(toks[k]), sum(t in c for t in toks[k]), n,
                   round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in toks[k]), 6)) for k, r in enumerate(corpus))
    for frequent in (cm.FREQUENT, 50):
        monkeypatch.setattr(cm, "FREQUENT", frequent)
        rows = cm.score(docs).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
        assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert cm.score(empty).count() == 0
    held = docs.filter("crc32(cast(doc_id as string)) % 7 = 2")
    assert cm.score(held).filter("train_tokens <> 0 OR n_known <> 0").count() == 0


def test_learns(spark):
    rnd = random.Random(8)
    vocabulary = words(rnd, 60)
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(200))) for k in range(300)]
    got = cm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).filter("held_out").collect()
    assert np.mean([r.bits_per_byte for r in got]) < 1.7  # log2(60) bits for about 6.5 bytes, learned from 60 kB a task


def test_long_texts_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(cm, "PIECE", 100)
    assert b"".join(cm.pieces(b"x" * 250)) == b"x" * 250 and len(cm.pieces(b"x" * 250)) == 3
    df = spark.createDataFrame([(1, "some words " * 50), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in cm.score(df).collect()} == {1: 101, 2: 1}


def _brute_keys(code, texts: list[bytes]) -> dict:
    """Zeros and ones of each (kind of context, context, node), one byte after the other."""
    seen: dict = {}
    for t in texts:
        raw = bytes([cm.END]) * 6 + t
        for i in range(6, len(raw)):
            word = re.split(rb"[ \n]", raw[max(0, i - 60):i])[-1]
            a = raw[i - 1] * 256 + raw[i]
            for step in code.steps[code.start[a]:code.start[a] + code.length[a]].tolist():
                for context in (("w", word), (6, raw[i - 6:i]), (4, raw[i - 4:i])):
                    seen.setdefault((*context, step >> 1), [0, 0])[step & 1] += 1
    return seen


def test_each_context_has_counts_of_its_own():
    """Many words: slots of a fixed table are shared by distinct contexts, keys are not."""
    rnd = random.Random(4)
    texts = [" ".join(f"{rnd.randrange(10 ** 9)}" for _ in range(1500)).encode() + b"\n" for _ in range(4)]
    pairs = np.zeros((256, 256), int)
    for t in texts:
        np.add.at(pairs, (np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)), 1)
    code = cm.Code(pairs)
    want = _brute_keys(code, texts)
    found = cm.Keys(code, cm.Spots(texts, in_blocks=False))
    assert len(found.keys) == len(want)
    assert sorted(map(tuple, found.counts().reshape(-1, 2).tolist())) == sorted(map(tuple, want.values()))
    b = cm.Bits(code, texts)
    found = cm.Keys(code, b)  # in the order of the bits' blocks
    for k, (slots, places) in enumerate(zip(b.slots, found.slots(b))):
        own = [key for key in want if key[0] == ("w", 6, 4)[k]]
        assert len(np.unique(places)) == len(own) >= len(np.unique(slots))
        assert np.array_equal(found.keys[places], cm._keys(k, b.contexts[k].take(b.of), b.node))
    assert len(np.unique(b.slots[1])) < len([key for key in want if key[0] == 6])


def test_answers_are_the_counts_of_all_chunks():
    """Every key of every chunk is answered with the sums over all training chunks, and over the others."""
    rnd = random.Random(5)
    parts = [[" ".join(words(rnd, 80)).encode() + b"\n"] for _ in range(6)]
    code = cm.Code(np.ones((256, 256), int))
    rows = [(k, k != 2, sum(map(len, t)), [k] * len(t), t) for k, t in enumerate(parts)]
    total: dict = {}
    for k, learn, *_, t in rows:
        for key, n in _brute_keys(code, t).items() if learn else ():
            total[key] = np.add(total.get(key, [0, 0]), n)
    own = _brute_keys(code, parts[0])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"chunk": r[0], "learn": r[1], "texts": r[4]} for r in rows],
                                       pa.schema([("chunk", pa.int64()), ("learn", pa.bool_()), ("texts", pa.list_(pa.binary()))]))
    sent = pa.Table.from_batches(cm._keyed(code, 8)([batch])).sort_by("shard")
    got = pa.Table.from_batches(cm._answered(iter(sent.to_batches()))).sort_by([("chunk", "ascending"), ("shard", "ascending")]).to_pylist()
    for name, counts in (("whole", [total[key] for key in own]), ("others", [np.subtract(total[key], n) for key, n in own.items()])):
        want = np.array(counts, float)
        values = np.frombuffer(b"".join(r[name] for r in got if r["chunk"] == 0), np.int16)
        assert sorted(values.tolist()) == sorted(cm._packed(want[:, 0], want[:, 1]).tolist())
    assert all(r["others"] == b"" for r in got if r["chunk"] == 2)


def _bundles(seed: int) -> list[tuple]:
    """(chunk, texts, learn): training, held out and mixed ones; some texts very often, one empty."""
    rnd = random.Random(seed)
    many = " ".join(words(rnd, 12)).encode() + b"\n"
    parts = [[" ".join(words(rnd, 80)).encode() + b"\n" for _ in range(3)] for _ in range(5)]
    parts[1] += [many] * 400
    parts[3] += [many, b"\n"]
    return [(k, t, [k != 2 and not (k == 3 and i % 2) for i in range(len(t))]) for k, t in enumerate(parts)]


def _sent(code, bundles: list[tuple], shards: int):
    import pyarrow as pa

    schema = pa.schema([("chunk", pa.int64()), ("learn", pa.list_(pa.bool_())), ("texts", pa.list_(pa.binary()))])
    batch = pa.RecordBatch.from_pylist([{"chunk": k, "learn": learn, "texts": t} for k, t, learn in bundles], schema)
    return pa.Table.from_batches(cm._sent(code, shards)([batch])).sort_by("shard")


@pytest.mark.parametrize("shards", [1, 8])
def test_bundles_know_the_counts_of_all_training_text(shards):
    """From its own texts and the counts outside of it a bundle has every chunk's keys with their counts in all training text."""
    import pyarrow as pa

    bundles = _bundles(6)
    pairs = np.zeros((256, 256), int)
    for _, texts, _ in bundles:
        for t in texts:
            np.add.at(pairs, (np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)), 1)
    for code in (cm.Code(pairs), cm.Code(np.ones((256, 256), int))):
        total: Counter = Counter()
        for key, n in _brute_keys(code, [t for _, texts, learn in bundles for t, own in zip(texts, learn) if own]).items():
            total[key] = tuple(n)
        told = cm._answered(cm._opened(code)(iter(_sent(code, bundles, shards).to_batches())), cm._outside)
        answers = pa.Table.from_batches(told).sort_by([("chunk", "ascending"), ("shard", "ascending")]).to_pylist()
        for chunk, texts, learn in bundles:
            bundle = cm.Bundle(code, learn, texts, [r["counts"] for r in answers if r["chunk"] == chunk], shards)
            for own in (texts[:2], texts[2:], texts):
                got = bundle.of(cm.Keys(code, cm.Spots(own, in_blocks=False)))
                want = [tuple(total[key] or (0, 0)) for key in _brute_keys(code, own)]
                assert sorted(map(tuple, got.tolist())) == sorted(want)


@pytest.mark.parametrize("bits,n", [(1, 50), (40, 5000), (56, 5000), (62, 70_000), (64, 70_000), (64, 1), (63, 3 << 20)])
def test_distinct_values_and_their_places(bits, n):
    """As of numpy, also where a value leaves no room for its place, or not even its lower bits do."""
    rng = np.random.default_rng(bits + n)
    some = rng.integers(0, 1 << 63, max(1, n // 3), np.uint64) << np.uint64(1) | rng.integers(0, 2, max(1, n // 3), np.uint64)
    values = (some >> np.uint64(64 - bits))[(rng.random(n) ** 2 * len(some)).astype(int)]
    values[n // 2:] ^= rng.integers(0, 2, n - n // 2, np.uint64)  # neighbours in the lowest bit
    for got, want in zip(cm._unique(values), np.unique(values, return_inverse=True, return_counts=True)):
        assert np.array_equal(got, want)
    assert [len(x) for x in cm._unique(values[:0])] == [0, 0, 0]


def test_a_bundle_finds_the_bits_of_its_chunks():
    """Scoring takes the logits of a chunk's bits from the bundle's one table: those that the chunk's own keys have there."""
    import pyarrow as pa

    bundles = _bundles(7)
    pairs = np.zeros((256, 256), int)
    for _, texts, _ in bundles:
        for t in texts:
            np.add.at(pairs, (np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)), 1)
    code = cm.Code(pairs)
    answers = pa.Table.from_batches(cm._answered(cm._opened(code)(iter(_sent(code, bundles, 8).to_batches())), cm._outside)).sort_by(
        [("chunk", "ascending"), ("shard", "ascending")]).to_pylist()
    for chunk, texts, learn in bundles:
        bundle = cm.Bundle(code, learn, texts, [r["counts"] for r in answers if r["chunk"] == chunk], 8)
        assert bundle.counts.dtype == np.int32
        for own in (texts[:2], texts[2:], texts):
            bits = cm.Bits(code, own)
            k = cm.Keys(code, bits)
            packed = cm._packed(*bundle.of(k).T)
            for at, whole in zip(k.slots(bits), bundle.slots(code, bits), strict=True):
                assert np.array_equal(packed[at], bundle.values()[whole])


def test_a_bundle_sends_a_few_bytes_a_key():
    """Keys and counts as they are take 16 bytes a key, about 30 a byte of text."""
    rnd = random.Random(9)
    vocabulary = words(rnd, 3000)
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(200)).encode() + b"\n" for _ in range(300)]
    pairs = np.zeros((256, 256), int)
    for t in texts:
        np.add.at(pairs, (np.frombuffer(t[:-1], np.uint8), np.frombuffer(t[1:], np.uint8)), 1)
    code = cm.Code(pairs)
    sent = _sent(code, [(0, texts, [True] * 300)], 8)
    keys = len(cm.Keys(code, cm.Spots(texts, in_blocks=False)).keys)
    assert sum(len(b) for c in ("pairs", "times") for b in sent[c].to_pylist()) < 4 * keys


def test_scores_leave_little_on_disk(spark):
    from pathlib import Path

    rnd = random.Random(10)
    vocabulary = words(rnd, 3000)
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(300))) for k in range(400)]
    root = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(root.rglob("*"))
    assert cm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).count() == 400
    left = sum(p.stat().st_size for p in set(root.rglob("*")) - before if p.is_file())
    assert left < 2 * sum(len(t) for _, t in rows)


def test_weights_learn_from_every_bit():
    """A text between 256 and 512 bytes is refined once, and each of its bits counts."""
    assert cm.LEARN == cm.EVERY == 1 and cm.BLOCK <= 256
    rng = np.random.default_rng(6)
    code = cm.Code(rng.integers(0, 50, (256, 256)))
    tables = [rng.integers(-3000, 3000, 1 << s).astype(np.int16) for s in cm.SLOTS]
    text = " ".join(words(random.Random(2), 100)).encode()[:400] + b"\n"
    assert len(cm.Bits(code, [text]).steps) == 3
    model = cm.Mixer(code, tables, cm._start_weights())
    refined = model.logs([text])[0]
    b = cm.Bits(code, [text])
    x, gate = cm._inputs(code, b.node, [t.take(s) for t, s in zip(tables, b.slots)])
    assert np.log(cm._mixed(cm._start_weights(), gate, x, b.bit)[0]).sum() != pytest.approx(refined, rel=1e-4)


def test_forward_against_slow_loop():
    """Attention over the passages of each bag, passage by passage."""
    import math

    rng = np.random.default_rng(4)
    bags = [rng.normal(size=(n, mil.FEATURES)) for n in (1, 4, 2)]
    m = {"W": rng.normal(0, .2, (mil.FEATURES, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)),
         "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.array(-0.3)}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    want = []
    for bag in bags:
        encoded, energy = [], []
        for passage in bag:
            h = [math.tanh(sum(v * w for v, w in zip(passage, m["W"][:, k])) + m["b"][k]) for k in range(4)]
            gates = [math.tanh(sum(h[i] * m["V"][i, k] for i in range(4))) * sigmoid(sum(h[i] * m["U"][i, k] for i in range(4))) for k in range(3)]
            encoded.append(h)
            energy.append(sum(g * w for g, w in zip(gates, m["w"])))
        share = [math.exp(e) / sum(map(math.exp, energy)) for e in energy]
        z = [sum(a * h[k] for a, h in zip(share, encoded)) for k in range(4)]
        want.append(sigmoid(sum(v * c for v, c in zip(z, m["c"])) + float(m["d"])))
    got = mil._forward(m, np.concatenate(bags), np.array([len(b) for b in bags]))["p"]
    assert got == pytest.approx(want, abs=1e-12)
