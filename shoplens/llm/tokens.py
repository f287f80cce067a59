"""Tokenisation by a public vocabulary file, many texts at a time.

Three kinds of file; the result is always the one of the named library's own
whole-text call, which ``tests/llm`` holds it against:

* ``byte``   — byte-level BPE of the ``tokenizers`` library (``byte_bpe_50k``).
  The file's merges stand in the order of the ids, so that ``tiktoken`` gives
  the same ids from the same file, several times faster.
* ``space``  — BPE with word ends, white space dropped (``word_bpe_49k``). Its
  pattern never matches across white space, so each distinct unit between
  white space is encoded once and kept. All new units of a batch are encoded in
  one call: every pre-token gets a mark that stands for the word end, as in
  the file, whose first merges are "last byte and end".
* ``piece``  — ``sentencepiece`` BPE (``piece_bpe_32k``). No piece holds a space
  after another character, so that a text with single spaces is the units
  between them, each encoded once and kept.

What a fast way does not cover goes to the library whole: other scripts in a
``space`` unit, runs of spaces for ``piece``, very long runs without a space.
With ``plain`` (the default) a text that spells a special token of a
``tokenizers`` file gets its id, as the library does when the file is merely
loaded; otherwise such a string is ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: GPT-2's pattern, which the library's ByteLevel step uses: a fixed value
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_KINDS = ("space", "byte", "piece")
#: characters that a unit on the fast way of ``space`` may hold
_SIMPLE = re.compile(rf"[{_LETTERS}!-~]+").fullmatch
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_ODD = re.compile("[\x1c-\x1f]")  # Python's white space, not the library's
_END, _BREAK = "\x01", "\x02"  # word end and unit end; no simple unit holds them
_LONG = 2000
_CHUNK = 1 << 20


def byte_alphabet() -> dict[int, int]:
    """Byte value -> code point of byte-level BPE: printable Latin-1 stands for
    itself, the other bytes take the code points from 256 on, in order."""
    shown = {b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _shown_bytes() -> dict[str, bytes]:
    moved = byte_alphabet()
    return {chr(moved.get(b, b)): bytes([b]) for b in range(256)}


def token_bytes(path: str, kind: str) -> list[bytes]:
    """The bytes that each id stands for (``byte`` or ``piece``); b"" for special ids."""
    if kind == "byte":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        to, special = _shown_bytes(), {t["id"] for t in model["added_tokens"]}
        vocab = model["model"]["vocab"]
        out = [b""] * (1 + max([*vocab.values(), *special]))
        for token, k in vocab.items():
            if k not in special:
                out[k] = b"".join(map(to.__getitem__, token))
        return out
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def one(k: int) -> bytes:
        if sp.is_byte(k):
            return bytes([int(sp.id_to_piece(k)[3:-1], 16)])
        if sp.is_control(k) or sp.is_unknown(k):
            return b""
        return sp.id_to_piece(k).replace("▁", " ").encode("utf-8")

    return [one(k) for k in range(sp.get_piece_size())]


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    """``many(texts)``: for each text the little-endian uint32 bytes of its ids.

    ``cache_units`` bounds the cache (about 150 bytes a unit); a full cache
    starts anew, which costs time and changes no result.
    """

    def __init__(self, path: str, kind: str, cache_units: int = 400_000, plain: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if kind not in _KINDS:
            raise ValueError(f"kind is one of {_KINDS}")
        self.kind, self.limit, self.units = kind, cache_units, {}
        self.special: list[str] = []
        if kind == "piece":
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.vocab = self.sp.get_piece_size()
            inner = [k for k in range(self.vocab) if "▁" in self.sp.id_to_piece(k).lstrip("▁")]
            self.by_units = not inner and self.sp.encode("a b") == self.sp.encode("a") + self.sp.encode("b")
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not plain
        self.vocab = self.tok.get_vocab_size(with_added_tokens=True)
        self._ranks(path, plain)

    def _ranks(self, path: str, plain: bool) -> None:
        """The same merges for tiktoken, which merges by the id of the result."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, to = file["model"], _shown_bytes()
        end = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.special = list(special) if plain else []
        ranks = {}
        for token, k in model["vocab"].items():
            if token in special:
                continue
            ends = bool(end) and token.endswith(end)
            shown = token[:len(token) - len(end)] if ends else token
            ranks[b"".join(map(to.__getitem__, shown)) + (_END.encode() if ends else b"")] = k
        self.break_id = model["vocab"][next(c for c, b in _shown_bytes().items() if b == _BREAK.encode())]
        first = len(model["vocab"]) - len(special.keys() & model["vocab"].keys()) - len(model["merges"])
        for i, pair in enumerate(model["merges"]):
            left, right = pair if not isinstance(pair, str) else pair.split(" ")
            if model["vocab"][left + right] != first + i:
                raise ValueError("the ids of this file do not follow its merges")
        pattern = BYTE_PATTERN if self.kind == "byte" else f"[^{_END}{_BREAK}]+{_END}|{_BREAK}"
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _library(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if self.kind == "piece":
            return list(map(_pack, self.sp.encode(texts, num_threads=1)))
        return [_pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, text: str, keys: list[str]) -> bool:
        """Does this text go to the library whole?"""
        if any(s in text for s in self.special) or max(map(len, keys), default=0) > _LONG:
            return True
        if self.kind == "space":
            return _ODD.search(text) is not None
        if self.kind == "piece":
            return not self.by_units or "" in keys or "▁" in text
        return False

    def _fresh(self, units: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of units that are not kept yet."""
        if self.kind == "piece":
            yield from zip(units, self._library(units))
            return
        simple = [u for u in units if _SIMPLE(u)]
        marked = _PRE_TOKEN.sub(rf"\g<0>{_END}", "\n".join(simple).lower()).replace("\n", _BREAK)
        ids = np.asarray(self.fast.encode_ordinary(marked + _BREAK), "<u4")
        cuts = np.flatnonzero(ids == self.break_id).tolist()
        raw = ids.tobytes()
        yield from zip(simple, (raw[4 * s:4 * e] for s, e in zip([0, *(c + 1 for c in cuts)], cuts)))
        other = [u for u in units if not _SIMPLE(u)]
        yield from zip(other, self._library(other))

    def _chunk(self, texts: list[str]) -> list[bytes]:
        if self.kind == "byte":
            keys = [t.split(" ") for t in texts]
            return [self._library([t])[0] if self._whole(t, k) else _pack(self.fast.encode_ordinary(t))
                    for t, k in zip(texts, keys)]
        keys = [t.split() if self.kind == "space" else t.split(" ") for t in texts]
        whole = [not t or self._whole(t, k) for t, k in zip(texts, keys)]
        keys = [[] if w else k for k, w in zip(keys, whole)]
        new = set().union(*keys).difference(self.units)
        if len(self.units) + len(new) > self.limit:
            self.units = {}
            new = set().union(*keys)
        if new:
            self.units.update(self._fresh(list(new)))
        get = self.units.__getitem__
        return [self._library([t])[0] if w else b"".join(map(get, k)) for t, k, w in zip(texts, keys, whole)]

    def many(self, texts: list[str]) -> list[bytes]:
        """Of all texts, about a million characters at a time."""
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= _CHUNK or i + 1 == len(texts):
                out += self._chunk(texts[at:i + 1])
                at, size = i + 1, 0
        return out

    def one(self, text: str) -> bytes:
        return self._chunk([text])[0]


_ENCODERS: dict = {}


def encoder(path: str, kind: str, plain: bool = True) -> Encoder:
    """The worker process's encoder for this file; made on first use."""
    key = (path, kind, plain)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, kind, plain=plain)
    return _ENCODERS[key]


def encoded(enc: Encoder, column, lead: str = "", rows: int = 512) -> Iterator[bytes]:
    """``enc.many`` over an Arrow column of texts (null: empty), some rows at a time;
    ``lead`` is put before every text."""
    for at in range(0, len(column), rows):
        yield from enc.many([lead + (t or "") for t in column.slice(at, rows).to_pylist()])
