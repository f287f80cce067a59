from __future__ import annotations

import random
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoplens.llm import token_files as tf
from shoplens.llm.tokens import Encoder, token_bytes

FILES = {"space": "word_bpe_49k.json", "byte": "byte_bpe_50k.json", "piece": "piece_bpe_32k.model"}
ODD = ["", " ", "\n\n a  b   c\n d", "It's 3.14 we'll\t\tgo", "a b c", "x\x1cy z", "é ́a", "ΑΣ ΟΔΟΣ", "a \n b",
       "  lead", "trail  ", "\r\n\r\nx", "İstanbul ǅ ﬁ", "a\u0085b 　 c", "'S 'LL don't", "日本語 テスト１２", "😀😀 ok", "\x00a \x0b b"]


SPELLED = ["a<|endoftext|>b", "x <|startoftext|> y", "<|endoftext|>", "<0x41> ▁a ▁ b", "  ▁▁"]


def library(kind: str, plain: bool):
    """The named library's own whole-text call."""
    path = public_tokenizers.path(FILES[kind])
    if kind == "piece":
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = not plain
    return lambda t: lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind,plain", [("space", True), ("space", False), ("byte", True), ("byte", False), ("piece", True)])
def test_like_the_library(kind, plain, corpus):
    enc, lib = Encoder(public_tokenizers.path(FILES[kind]), kind, cache_units=300, plain=plain), library(kind, plain)
    rnd = random.Random(1)
    texts = ODD + SPELLED + [r[1] for r in corpus if r[1]] + ["a" * 5000 + " b", " " * 3000]
    texts += ["".join(rnd.choice(" \n\t\r\x0b\x0c\x01\x02▁ ́'sTdL1٣é.,!|<>ßÀÿª²ΣİВ😀") for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    want = [np.asarray(lib(t), "<u4").tobytes() for t in texts]
    assert enc.many(texts) == want
    assert enc.many(texts) == want  # with units that are kept
    assert [enc.one(t) for t in texts[:200]] == want[:200]


@pytest.mark.parametrize("kind", ["byte", "piece"])
def test_token_bytes(kind, corpus):
    path = public_tokenizers.path(FILES[kind])
    shown, enc = token_bytes(path, kind), Encoder(path, kind, plain=False)
    lead = " " if kind == "piece" else ""
    for t in [r[1] for r in corpus if r[1]] + SPELLED[:3] + ODD:
        ids = np.frombuffer(enc.one(t), "<u4")
        if t:
            assert b"".join(shown[k] for k in ids) == (lead + t).encode()


@given(st.lists(st.integers(0, 49_407), max_size=300), st.integers(1, 40), st.sampled_from([16, 17, 19, 32]))
@settings(max_examples=80, deadline=None)
def test_pack_round_trip(ids, first, bits):
    ids = np.array(ids * 30, np.uint32)
    payload = tf.pack(ids, bits)
    assert np.array_equal(tf.unpack(payload), ids)
    assert np.array_equal(tf.unpack(payload, first, 7), ids[first:first + 7])
    if len(ids):
        assert tf.id_at(payload, len(ids) - 1) == ids[-1]


def test_pack_limits():
    assert tf.bits_for(49_408) == 16 and tf.bits_for(65_537) == 17 and tf.bits_for(1) == 1
    with pytest.raises(ValueError):
        tf.pack(np.array([8], np.uint32), 3)
    with pytest.raises(ValueError):
        tf.unpack(b"x" * 40)


@pytest.mark.parametrize("shards,segment", [(1, 10), (4, 500), (13, 1 << 18)])
def test_files(spark, docs, corpus, empty, shards, segment):
    path, where = public_tokenizers.path("word_bpe_49k.json"), tempfile.mkdtemp()
    tf.write_packed(docs, f"{where}/a", path, "space", 2, segment, shards)
    lib = Tokenizer.from_file(path)
    want, start = [], 0
    for r in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in tf.document_digests(spark, f"{where}/a").orderBy("start").collect()] == want
    tf.write_packed(empty, f"{where}/b", path, "space", 2, segment, shards)
    assert tf.document_digests(spark, f"{where}/b").count() == 0
