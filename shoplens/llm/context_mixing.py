"""Operator 6 — language-model scores by online logistic context mixing.

A text is modelled as the bytes of its lower-cased (A-Z) words, each ended by a
space, and one end byte. Each byte is a path of bits through a Huffman tree
that belongs to the byte before it, so that likely bytes take one or two bits.
Four predictors give each bit a logit from counts of zeros and ones:

* the tree node itself (so the byte before), counted exactly;
* the word so far (46 bits of its hash) and the node;
* the last ``NEAR[0]`` bytes and the node, and the last ``NEAR[1]`` bytes and
  the node, both as they are.

A logistic mixer adds them up with weights; which weights is gated by how
often the word and the longest context were seen. The weights learn online: over the
training texts, one bit in ``LEARN`` against the counts of all other chunks
of training text, averaged over tasks; then,
from there, over each text while it is scored, after each block of
``BLOCK`` bytes, from one bit in ``EVERY``. The score is the sum of the log10 probabilities of all bits.

All training texts are counted, and each (context, node) has counts of its own,
however many there are: texts are cut into chunks and these gathered in bundles.
A bundle sends its distinct (context, byte) with its own counts to their shards,
as sorted and compressed differences; a shard lays them out over the trees'
nodes, adds them up and answers each bundle with the counts outside of it, one
number a context and one a node, mostly 0; the answers meet the bundle's texts
again, which give its own and each chunk's counts. Nothing of this
is collected or broadcast; the number of shards grows with the bytes.
The unigram base counts every training token; words with at least one in
``FREQUENT`` of all tokens (so at most ``FREQUENT`` words) are broadcast, all
others meet their counts in a join.

Cases: a null or empty text is the end byte alone (one token); a null doc_id
is not held out; rows are scored one by one, also repeated ones; texts over
``PIECE`` bytes are scored in pieces, whose weights start anew; an empty table
gives no rows, and without any training text all counts are 0; other columns
are not read.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import shuffle_partitions, written
from shoplens.session import remove_path

#: bytes before that make up a context (6, 4 or both); their longest
NEAR = (6, 4)
MOST_NEAR = max(NEAR)
#: slots of the tables of a mixer that is given its tables (the word's and those of NEAR), as powers of 2
SLOTS = (20, 20, 20)
LEARN, BLOCK, PIECE, CHUNK = 1, 256, 1 << 18, 1 << 20
#: texts a chunk at most; occurrences of keys a shard, about; bytes of a bundle of chunks; of a task whose chunks go alone
TEXTS, SHARD, BUNDLE, ALONE = 4096, 1 << 23, 3 << 22, 1 << 22
FREQUENT = 500_000
END = 0x0A
GATES, INPUTS = 64, 4  # inputs: tree node, word, NEAR
PACE = 0.006
#: bits to one that the weights of a text learn from
EVERY = 1
_LN10 = math.log(10.0)


def in_training(doc_id: Column) -> Column:
    """Rows that are learned from: crc32 of the id as text modulo 7 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


# ---- texts as bits -------------------------------------------------------------


def spelled(text: str) -> tuple[bytes, list[bytes]]:
    """The modelled bytes of ``text``, and its words."""
    words = text.encode("utf-8").lower().split()
    return b" ".join([*words, bytes([END])]), words


def pieces(raw: bytes) -> list[bytes]:
    return [raw[a:a + PIECE] for a in range(0, len(raw), PIECE)]


class Code:
    """Huffman trees: for (byte before, byte) the nodes of its path and their bits."""

    def __init__(self, pairs: np.ndarray):
        start, length, nodes, bits = np.zeros(65536, np.int64), np.zeros(65536, np.int64), [], []
        self.rank, self.ranked = np.zeros(65536, np.uint64), np.zeros(65536, np.int32)
        self.node_counts = np.zeros((65536, 2))
        at = 0
        for before in range(256):
            row = pairs[before].astype(float) + 1e-3
            heap = [(n, b) for b, n in enumerate(row.tolist())]
            heapq.heapify(heap)
            parent, next_node = {}, 256
            while len(heap) > 1:
                (n0, a), (n1, b) = heapq.heappop(heap), heapq.heappop(heap)
                inner = before * 256 + next_node - 256
                parent[a], parent[b] = (next_node, inner, 0), (next_node, inner, 1)
                self.node_counts[inner] = n0, n1
                heapq.heappush(heap, (n0 + n1, next_node))
                next_node += 1
            turns = []
            for b in range(256):
                path, x = [], b
                while x in parent:
                    x, inner, bit = parent[x]
                    path.append((inner, bit))
                path.reverse()
                start[before * 256 + b], length[before * 256 + b] = at, len(path)
                nodes += [p[0] for p in path]
                bits += [p[1] for p in path]
                turns.append(bits[at:])
                at += len(path)
            order = np.array(sorted(range(256), key=turns.__getitem__)) + before * 256  # the leaves as they stand in the tree
            self.rank[order], self.ranked[before * 256:before * 256 + 256] = np.arange(256), order
        self.start, self.length = start.astype(np.int32), length.astype(np.int32)
        self.steps = np.array(nodes, np.int32) * 2 + np.array(bits, np.int32)  # node and bit of each step of a path
        n0, n1 = self.node_counts.T
        self.logit = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -8, 8).astype(np.float32)


_K = 0x9E3779B97F4A7C15
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, k in (("up", _K), ("down", pow(_K, -1, 1 << 64))):
            p = np.full(n + 1, k, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _behind(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
    """At each place ``a`` there and above its ``shift`` bytes ``b`` that many places before."""
    out = a.copy()
    out[shift:] |= b[:-shift] << np.uint64(8 * shift)
    return out


def _keys(part: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """64-bit keys of contexts (at most 54 bits, the byte before the lowest) and nodes; no two share one."""
    k = (context << np.uint64(8)) | (node & 255).astype(np.uint64)
    k |= np.uint64(part << 62)
    k ^= k >> np.uint64(32)
    k *= np.uint64(_K)
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k


class Spots:
    """The bytes of many pieces, block after block of all of them if asked for, with their contexts."""

    def __init__(self, texts: list[bytes], in_blocks: bool = True):
        lead = bytes([END]) * MOST_NEAR
        raw = np.frombuffer(b"".join([lead + t for t in texts]), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes + MOST_NEAR)
        at = np.arange(len(raw), dtype=np.int32)
        lane = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + MOST_NEAR)
        place = at - np.repeat(ends - sizes, sizes + MOST_NEAR)
        up, down = _powers(len(raw) + 1)
        total = np.cumsum((raw + np.uint64(1)) * down[:len(raw)], dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), total[:-1]])
        breaks = np.concatenate([[True], (raw[:-1] == 0x20) | (raw[:-1] == END)])
        begin = np.maximum.accumulate(np.where(breaks, at, np.int32(0)))
        word = (total - total.take(begin)) * up.take(begin)  # the hash of the word so far, wherever it stands
        word ^= word >> np.uint64(31)
        word *= np.uint64(0x94D049BB133111EB)
        word >>= np.uint64(18)
        one = np.concatenate([np.zeros(1, np.uint64), raw[:-1].astype(np.uint64)])
        two = _behind(one, one, 1)
        four = _behind(two, two, 2)
        last = {4: four, 6: _behind(four, two, 4)}
        own = np.flatnonzero(place >= 0).astype(np.int32)
        if in_blocks:
            block = (place.take(own) // BLOCK).astype(np.uint16)
            if len(texts) > 1:
                own = own.take(np.argsort(block, kind="stable"))
            self.step = np.concatenate([[0], np.cumsum(np.bincount(block))])
        self.which = raw.take(own - 1).astype(np.int32) * 256 + raw.take(own)
        self.contexts = [c.take(own) for c in (word << np.uint64(8) | one, *(last[n] for n in NEAR))]
        self.own_lane = lane.take(own)
        self.lanes = len(texts)


class Bits(Spots):
    """The bits of the bytes."""

    def __init__(self, code: Code, texts: list[bytes], in_blocks: bool = True):
        super().__init__(texts, in_blocks)
        n = code.length.take(self.which)
        self.before = np.concatenate([[0], np.cumsum(n)])
        self.of = np.repeat(np.arange(len(n), dtype=np.int32), n)
        path = (code.start.take(self.which) - self.before[:-1].astype(np.int32)).take(self.of) + np.arange(len(self.of), dtype=np.int32)
        self.node = code.steps.take(path)
        self.bit = (self.node & 1).astype(np.uint8)
        self.node >>= 1
        if in_blocks:
            self.lane = self.own_lane.take(self.of)
            self.steps = self.before[self.step].tolist()

    @property
    def slots(self) -> list[np.ndarray]:
        """Slots of tables of ``SLOTS``."""
        return [(_keys(k, c.take(self.of), self.node) >> np.uint64(64 - s)).astype(np.uint32)
                for k, (c, s) in enumerate(zip(self.contexts, SLOTS))]


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct 64-bit values in order, the place of each value among them, and how often it comes.

    Plain sorts of numbers that hold a value's place in their lower bits take less time than a
    sort that moves places along. Values that leave no room for it are sorted by their upper bits
    first, then by the number of the group that these make and the lower bits."""
    n = len(values)
    wide = max(1, n - 1).bit_length()
    low = max(0, int(values.max()).bit_length() + wide - 64) if n else 0
    if not n or low and 2 * wide + low > 64:
        out, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
        return out, inverse.astype(np.int32), times
    shift, below = np.uint64(wide), np.uint64((1 << wide) - 1)
    packed = values >> np.uint64(low)
    packed <<= shift
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & below).astype(np.int32)
    packed >>= shift
    if low:
        group = np.zeros(n, np.uint64)
        np.cumsum(packed[1:] != packed[:-1], out=group[1:])
        group <<= np.uint64(low)
        group |= values.take(order) & np.uint64((1 << low) - 1)
        group <<= shift
        group |= order.astype(np.uint64)
        group.sort()
        order = (group & below).astype(np.int32)
        packed = group
        packed >>= shift
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(packed[1:], packed[:-1], out=first[1:])
    del packed
    inverse = np.empty(n, np.int32)
    inverse[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    starts = np.flatnonzero(first)
    return values.take(order.take(starts)), inverse, np.diff(np.append(starts, n))


def _pairs(code: Code, spots: Spots) -> list[np.ndarray]:
    """For each kind of context: the context and below it the next byte, by its rank in the tree of the byte before."""
    rank = code.rank.take(spots.which)
    return [(context << np.uint64(8)) | rank for context in spots.contexts]


class Paths:
    """The keys on the paths of distinct (context, rank), in order for each kind of context.

    Leaves that follow each other in a tree share the beginning of their paths,
    so the keys of a pair are those it shares with the one before and new ones.
    """

    def __init__(self, code: Code, parts: list[np.ndarray]):
        self.parts, self.steps = [len(p) for p in parts], code.steps
        self.pairs = np.concatenate(parts)
        which = code.ranked.take((self.pairs & np.uint64(0xFFFF)).astype(np.int32))
        self.first, self.length = code.start.take(which), code.length.take(which)
        context = self.pairs >> np.uint64(8)
        same = np.zeros(len(context) + 1, bool)
        same[1:-1] = context[1:] == context[:-1]
        same[np.cumsum([0, *self.parts])] = False
        self.shared, at, step = np.zeros(len(context), np.int32), np.flatnonzero(same), 0
        while len(at):
            self.shared[at] += 1
            at = at[code.steps.take(self.first.take(at) + step) == code.steps.take(self.first.take(at - 1) + step)]
            step += 1
        self.new = self.length - self.shared
        self.key = np.cumsum(self.new, dtype=np.int32) - self.new
        self.start = np.cumsum(self.length, dtype=np.int32) - self.length
        self.n_keys = int(self.new.sum())
        self.place = np.empty(int(self.length.sum()), np.int32)
        at, step = np.arange(len(context), dtype=np.int32), 0
        while len(at):
            shared = self.shared.take(at)
            last = np.maximum.accumulate(np.where(shared <= step, np.arange(len(at), dtype=np.int32), np.int32(0)))  # has the key that is shared
            self.place[self.start.take(at) + step] = (self.key.take(at) + step - shared).take(last)
            step += 1
            at = at[self.length.take(at) > step]

    def of_keys(self, per_pair: np.ndarray) -> np.ndarray:
        """Per key: ``per_pair`` of the pair that it is new in, plus the step there."""
        out = np.repeat(per_pair + self.shared - self.key, self.new)
        out += np.arange(self.n_keys, dtype=np.int32)
        return out

    def depth(self) -> np.ndarray:
        return self.of_keys(np.int32(0))

    def lead(self) -> np.ndarray:
        """Per key its node and bit on the path of the pair that it is new in."""
        return self.steps.take(self.of_keys(self.first))

    def keys(self) -> np.ndarray:
        part = np.repeat(np.arange(len(self.parts)), self.parts)
        pair = np.repeat(np.arange(len(self.pairs)), self.new)
        node, out, at = self.lead() >> 1, np.empty(self.n_keys, np.uint64), np.searchsorted(part.take(pair), np.arange(len(self.parts) + 1))
        for k, (a, z) in enumerate(zip(at, at[1:])):
            out[a:z] = _keys(k, self.pairs.take(pair[a:z]) >> np.uint64(8), node[a:z])
        return out

    def counts(self, times: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """Zeros and ones of each key, if the pairs come ``times``; added to ``out``, if given."""
        out = np.zeros((self.n_keys, 2), np.int64) if out is None else out
        for a in range(0, len(self.pairs), 1 << 17):
            z = min(len(self.pairs), a + (1 << 17))
            start, length = self.start[a:z], self.length[a:z]
            place = self.place[start[0]:start[-1] + length[-1]]
            low = int(place.min())
            side = np.repeat(self.first[a:z] - start, length)
            side += np.arange(start[0], start[0] + len(place), dtype=np.int32)
            side = self.steps.take(side) & 1
            side += (place - low) * 2
            found = np.bincount(side, np.repeat(times[a:z], length)).astype(np.int64)
            out.reshape(-1)[2 * low:2 * low + len(found)] += found
        return out


class Keys:
    """The distinct keys of the bits of ``spots``; how often a zero and a one came at each."""

    def __init__(self, code: Code, spots: Spots):
        self.parts, self.inverse, times = zip(*map(_unique, _pairs(code, spots)))
        self.inverse = list(self.inverse)
        self.times = np.concatenate(times)
        self.paths = Paths(code, self.parts)

    @property
    def keys(self) -> np.ndarray:
        return self.paths.keys()

    def counts(self) -> np.ndarray:
        """Zeros and ones of each key."""
        return self.paths.counts(self.times).astype("<u4").ravel()

    def slots(self, b: Bits) -> list[np.ndarray]:
        """The place of each bit's key among the keys, for each context."""
        starts = np.split(self.paths.start, np.cumsum(self.paths.parts)[:-1])
        return _slots(b, (start.take(inverse) for start, inverse in zip(starts, self.inverse)), self.paths.place)


def _slots(b: Bits, starts: Iterator, place: np.ndarray) -> list[np.ndarray]:
    """The place of each bit's key, for each context; a byte's path begins at its start in ``place``."""
    step = np.arange(len(b.of), dtype=np.int32) - b.before.astype(np.int32).take(b.of)
    out = []
    for start in starts:
        at = start.take(b.of)
        at += step
        out.append(place.take(at))
    return out


# ---- counts and weights --------------------------------------------------------


def _confidence(n: np.ndarray) -> np.ndarray:
    """0 to 7: 0, 1, 2-3, 4-7, 8-15, 16-63, 64-255, 256 and more."""
    return np.searchsorted(np.array([1, 2, 4, 8, 16, 64, 256]), n, side="right")


def _packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logit (in steps of 1/240) and confidence of each slot, in 16 bits."""
    logit = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8.5, 8.5)
    return ((np.rint(logit * 240).astype(np.int16) << 3) | _confidence(zeros + ones).astype(np.int16)).astype(np.int16)


def _start_weights() -> np.ndarray:
    return np.full((INPUTS, GATES), 0.35, np.float32)


def _inputs(code: Code, node: np.ndarray, packed: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Mixer inputs of bits, one array each, and the gate of each bit."""
    x = [code.logit.take(node)]
    for v in packed:
        logit = (v >> 3).astype(np.float32)
        logit *= np.float32(1 / 240)
        x.append(logit)
    return x, (packed[0] & 7) * np.int16(8) + (packed[1] & 7)


def _mixed(w: np.ndarray, row: np.ndarray, x: list[np.ndarray], bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of the bit that came, and the error times the pace. ``w`` has a row an input."""
    sign = bit.astype(np.float32)
    sign *= 2
    sign -= 1
    dot = w[0].take(row)
    dot *= x[0]
    for k in range(1, INPUTS):
        part = w[k].take(row)
        part *= x[k]
        dot += part
    dot *= sign
    np.clip(dot, -12, 12, out=dot)
    np.negative(dot, out=dot)
    np.exp(dot, out=dot)
    dot += 1
    right = np.reciprocal(dot)
    sign *= np.float32(PACE) - np.float32(PACE) * right
    return right, sign


def _learned(w: np.ndarray, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
    for a in range(0, len(bit), 4096):
        part, g = [v[a:a + 4096] for v in x], gate[a:a + 4096]
        err = _mixed(w, g, part, bit[a:a + 4096])[1]
        for k in range(INPUTS):
            w[k] += np.bincount(g, err * part[k], GATES)
    return w


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Bytes of arrays of counts: what is under 255 in a byte each, then the larger ones; compressed."""
    import pyarrow as pa

    raw = b"".join(part for a in arrays for part in
                   (np.minimum(a, 255).astype(np.uint8).tobytes(), a[a >= 255].astype("<i8").tobytes()))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def _unsqueezed(data: bytes, *lengths: int) -> Iterator[np.ndarray]:
    raw, at = _inflated(data), 0
    for n in lengths:
        out = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        large = np.flatnonzero(out == 255)
        out[large] = np.frombuffer(raw, "<i8", len(large), at + n)
        at += n + 8 * len(large)
        yield out


def _deflated(raw: bytes) -> bytes:
    import pyarrow as pa

    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 9).compress(raw, asbytes=True)


def _inflated(data: bytes) -> bytes:
    import pyarrow as pa

    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _distinct(code: Code, texts: list[bytes], learn: list[bool]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct pairs of ``texts`` for each kind of context, in order, and how often all of them come in those to ``learn``."""
    found: list = [[] for _ in range(INPUTS - 1)]

    def merged(some: list) -> tuple[np.ndarray, np.ndarray]:
        if len(some) == 1:
            return some[0]
        pairs, inverse, _ = _unique(np.concatenate([p for p, _ in some]))
        return pairs, np.bincount(inverse, np.concatenate([n for _, n in some]), len(pairs)).astype(np.int64)

    for kind in (True, False):
        own, a = [t for t, k in zip(texts, learn) if k == kind], 0
        while a < len(own):
            z, size = a, 0
            while z < len(own) and (z == a or size + len(own[z]) <= CHUNK):
                size += len(own[z])
                z += 1
            for part, p in enumerate(_pairs(code, Spots(own[a:z], in_blocks=False))):
                pairs, n = np.unique(p, return_counts=True)
                found[part].append((pairs, n * kind))
                if len(found[part]) > 8:
                    found[part] = [merged(found[part])]
            a = z
    parts, times = [], []
    for k in range(len(found)):
        pairs, n = merged(found[k])
        found[k] = None
        parts.append(pairs)
        times.append(n)
    return parts, np.concatenate(times)


def _shards(parts: list[np.ndarray], shards: int) -> np.ndarray:
    """The shard of each pair: all of a context's are in one, and those of contexts that begin alike."""
    bits = shards.bit_length() - 1
    begin = np.concatenate([parts[0] >> np.uint64(16), parts[1] >> np.uint64(24), parts[2] >> np.uint64(16)])
    begin ^= np.repeat(np.arange(len(parts), dtype=np.uint64) << np.uint64(60), [len(p) for p in parts])
    begin *= np.uint64(_K)
    begin ^= begin >> np.uint64(29)
    begin *= np.uint64(0xBF58476D1CE4E5B9)
    return (begin >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(begin), np.int64)


def _sent(code: Code, shards: int):
    """(shard, chunk, parts, pairs, times) of each row (chunk, learn, texts): its distinct pairs by shard, and
    how often they come in texts to learn; without any it sends no times."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for chunk, learn, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                texts = texts.as_py()
                learn = np.broadcast_to(learn, len(texts))
                parts, times = _distinct(code, texts, learn)
                shard = _shards(parts, shards)
                order = np.argsort(shard, kind="stable")
                part = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).take(order)
                pairs, times, cut = np.concatenate(parts).take(order), times.take(order), np.searchsorted(shard.take(order), np.arange(shards + 1))
                for i in np.flatnonzero(np.diff(cut)).tolist():
                    own, n = pairs[cut[i]:cut[i + 1]], np.bincount(part[cut[i]:cut[i + 1]], minlength=len(parts))
                    # differences of the contexts without the byte before, byte by byte; that byte; the rank
                    begin = np.diff(own >> np.uint64(16), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
                    coded = b"".join([begin.tobytes(), (own >> np.uint64(8)).astype(np.uint8).tobytes(), own.astype(np.uint8).tobytes()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([chunk], pa.int64()), pa.array([n.tolist()], pa.list_(pa.int64())),
                         pa.array([_deflated(coded)], pa.binary()), pa.array([_squeezed(times[cut[i]:cut[i + 1]]) if learn.any() else b""], pa.binary())],
                        names=["shard", "chunk", "parts", "pairs", "times"])

    return run


def _opened(code: Code):
    """(shard, chunk, keys, counts, lead) of what was sent: its keys, their zeros and ones, and for each
    the bit on the path that it is new in, plus 2 at the root."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for shard, chunk, n, coded, times in zip(*(c.to_pylist() for c in b.columns)):
                planes = np.frombuffer(_inflated(coded), np.uint8).reshape(10, -1)
                pairs = np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64) << np.uint64(16)
                pairs |= planes[8].astype(np.uint64) << np.uint64(8) | planes[9]
                paths = Paths(code, np.split(pairs, np.cumsum(n)[:-1]))
                own = next(_unsqueezed(times, len(pairs))) if times else np.zeros(len(pairs), np.int64)
                lead = (paths.lead() & 1) + 2 * (paths.depth() == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([chunk], pa.int64()), pa.array([paths.keys().astype("<u8").tobytes()], pa.binary()),
                     pa.array([paths.counts(own).astype("<u4").tobytes()], pa.binary()), pa.array([lead.astype(np.uint8).tobytes()], pa.binary())],
                    names=["shard", "chunk", "keys", "counts", "lead"])

    return run


def _keyed(code: Code, shards: int):
    """What a shard finds in what was sent."""
    return lambda batches: _opened(code)(_sent(code, shards)(batches))


def _groups(batches: Iterator) -> Iterator:
    """Rows that follow each other with the same first column, as (its value, rows)."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    return itertools.groupby(rows, key=lambda row: row[0])


def _logits(zeros: np.ndarray, ones: np.ndarray, own: np.ndarray, lead: np.ndarray) -> dict:
    """Logits of keys from all counts and from those of other chunks (none for a held out one)."""
    whole = _packed(zeros + own[:, 0], ones + own[:, 1])
    return {"whole": whole.tobytes(), "others": _packed(zeros, ones).tobytes() if own.any() else b""}


def _outside(zeros: np.ndarray, ones: np.ndarray, own: np.ndarray, lead: np.ndarray) -> dict:
    """The counts outside of a bundle: of each root, and of each key's side that its path does not take."""
    return {"counts": _squeezed((zeros + ones)[lead >= 2], np.where(lead & 1, zeros, ones))}


def _answered(batches: Iterator, told=_logits) -> Iterator:
    """(chunk, shard, ...) of a shard's rows: what ``told`` makes of the counts outside of each row and of its own."""
    import pyarrow as pa

    for shard, rows in _groups(batches):
        _, chunks, keys, counts, leads = zip(*rows)
        keys = [np.frombuffer(k, "<u8") for k in keys]
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        own = np.frombuffer(b"".join(counts), "<u4").reshape(-1, 2)
        zeros, ones = (np.bincount(inverse, own[:, k]).astype(np.int64) for k in (0, 1))
        for chunk, a, z, lead in zip(chunks, cut, cut[1:], leads):
            at, mine = inverse[a:z], own[a:z].astype(np.int64)
            made = told(zeros.take(at) - mine[:, 0], ones.take(at) - mine[:, 1], mine, np.frombuffer(lead, np.uint8))
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), *(pa.array([v], pa.binary()) for v in made.values())],
                names=["chunk", "shard", *made])


class Bundle:
    """The keys of a bundle's chunks with their counts in all training text: its own, and the answers of all shards."""

    def __init__(self, code: Code, learn: list[bool], texts: list[bytes], answers: list[bytes], shards: int):
        self.parts, times = _distinct(code, texts, learn)
        p = Paths(code, self.parts)
        self.start, self.place = p.start, p.place
        shard = _shards(self.parts, shards)
        n_keys = np.bincount(shard, p.new, shards).astype(np.int64)
        n_roots = np.bincount(shard, p.shared == 0, shards).astype(np.int64)
        some = np.flatnonzero(n_keys)
        roots, against = zip(*(_unsqueezed(a, n_roots[s], n_keys[s]) for s, a in zip(some, answers, strict=True)))
        order = np.argsort(shard, kind="stable")
        new = p.new.take(order)
        at = np.repeat(p.key.take(order) - np.cumsum(new, dtype=np.int32) + new, new)  # the keys, shard by shard
        at += np.arange(p.n_keys, dtype=np.int32)
        depth, taken, entry = p.depth().astype(np.int16), p.of_keys(p.first), p.of_keys(p.start)
        other = np.empty(p.n_keys, np.int64)
        other[at] = np.concatenate(against)
        at = at[depth.take(at) == 0]
        total = np.zeros(p.n_keys, np.int64)
        total[at] = np.concatenate(roots)
        del shard, order, new, at, roots, against
        most = int(total.max(initial=0)) + int(times.sum())  # no key has more
        self.counts = np.empty((p.n_keys, 2), np.int32 if most < 1 << 31 else np.int64)
        by_depth = np.argsort(depth, kind="stable").astype(np.int32)
        ends = np.cumsum(np.bincount(depth))
        for step, (a, z) in enumerate(zip([0, *ends], ends)):
            here = by_depth[a:z]
            if step:  # what takes the side of the key above that leads here
                above, side = p.place.take(entry.take(here) - 1), p.steps.take(taken.take(here) - 1) & 1
                total[here] = self.counts[above, side]
            away, bit = other.take(here), p.steps.take(taken.take(here)) & 1
            self.counts[here, 1 - bit] = away
            self.counts[here, bit] = total.take(here) - away
        del depth, taken, entry, other, total, by_depth
        p.counts(times, self.counts)

    def values(self) -> np.ndarray:
        """Logit and confidence of each key in all training text."""
        out = np.empty(len(self.counts), np.int16)
        for a in range(0, len(out), 1 << 18):
            out[a:a + (1 << 18)] = _packed(*self.counts[a:a + (1 << 18)].T)
        return out

    def slots(self, code: Code, b: Bits) -> list[np.ndarray]:
        """The place of each bit's key among the bundle's, for each context."""
        def starts() -> Iterator:
            for a, whole, pairs in zip(np.cumsum([0, *map(len, self.parts)]), self.parts, _pairs(code, b)):
                some, inverse, _ = _unique(pairs)
                yield self.start.take(a + np.searchsorted(whole, some)).take(inverse)

        return _slots(b, starts(), self.place)

    def of(self, k: Keys) -> np.ndarray:
        """Zeros and ones in all training text of the keys ``k`` of a chunk."""
        at = np.concatenate([a + np.searchsorted(whole, part) for a, whole, part in
                             zip(np.cumsum([0, *map(len, self.parts)]), self.parts, k.parts)])
        return self.counts.take(self.place.take(k.paths.of_keys(self.start.take(at))), axis=0)


def _unpacked(packed: bytes, lengths: list[int]) -> list[bytes]:
    """The texts of a bundle."""
    raw = _inflated(bytes(packed))
    return [raw[z - n:z] for n, z in zip(lengths, itertools.accumulate(lengths))]


def _texts(batches: Iterator) -> Iterator:
    """(chunk, learn, texts) of bundles, ``learn`` for each text."""
    import pyarrow as pa

    for b in batches:
        for chunk, learn, packed, lengths, chunks in zip(*(c.to_pylist() for c in b.columns)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([np.repeat(learn, chunks).tolist()], pa.list_(pa.bool_())),
                 pa.array([_unpacked(packed, lengths)], pa.list_(pa.binary()))], names=["chunk", "learn", "texts"])


def _chunks(code: Code, rows: Iterator, shards: int, fit: bool) -> Iterator:
    """(owners, bits, slots, logits) of each chunk; to ``fit``, of each training chunk, and the
    logits are from the counts of all other chunks.

    A bundle's row with the texts stands before its answers, which are in the order of the shards."""
    for _, own in itertools.groupby(rows, key=lambda r: r.chunk):
        first, *answers = own
        if fit and not any(first.learn):
            continue
        texts, ends = _unpacked(first.packed, first.lengths), list(itertools.accumulate(first.chunks))
        bundle = Bundle(code, np.repeat(first.learn, first.chunks), texts, [bytes(r.counts) for r in answers], shards)
        if not fit:  # a text's own counts stay in: one table serves all chunks
            whole = bundle.values()
            del bundle.counts
        for learn, a, z in zip(first.learn, [0, *ends], ends):
            if learn or not fit:
                bits = Bits(code, texts[a:z], in_blocks=not fit)
                if fit:
                    k = Keys(code, bits)
                    slots = k.slots(bits)
                    del bits.of, k.inverse  # the largest, and no longer needed
                    counts = bundle.of(k)
                    counts -= k.paths.counts(k.times)
                    values = _packed(counts[:, 0], counts[:, 1])
                    del k, counts
                else:
                    slots, values = bundle.slots(code, bits), whole
                    del bits.of
                yield first.owners[a:z], bits, slots, values
                del bits, slots, values
        del bundle  # before the next one is built


def _fitted(code, shards: int):
    """The weights learned from this task's training chunks, times the bits seen, and that number."""
    def run(rows: Iterator) -> Iterator:
        w, learned = _start_weights(), 0
        for _, b, slots, values in _chunks(code.value, rows, shards, fit=True):
            for a in range(0, len(b.bit), LEARN << 16):
                some = slice(a, a + (LEARN << 16), LEARN)
                w = _learned(w, *_inputs(code.value, b.node[some], [values.take(s[some]) for s in slots]), b.bit[some])
            learned += len(b.bit)
            del b, slots, values
        if learned:
            yield np.append(w.astype(float).ravel() * learned, float(learned)).tolist()

    return run


def _probabilities(code, weights: np.ndarray, shards: int):
    """(row, log): natural logarithms of the probabilities of a chunk's pieces, by row."""
    def run(rows: Iterator) -> Iterator:
        for owners, b, slots, values in _chunks(code.value, rows, shards, fit=False):
            logs = Mixer(code.value, [values] * len(SLOTS), weights).logs_of(b, slots)
            del b, slots, values
            own, at = np.unique(np.array(owners), return_inverse=True)
            yield from zip(own.tolist(), np.bincount(at, logs).tolist())

    return run


class Mixer:
    """A model: code, logits of slots, starting weights."""

    def __init__(self, code: Code, tables: list[np.ndarray], weights: np.ndarray):
        self.code, self.tables, self.weights = code, tables, weights

    def logs(self, texts: list[bytes]) -> np.ndarray:
        """Natural logarithm of the probability of each piece."""
        b = Bits(self.code, texts)
        return self.logs_of(b, b.slots)

    def logs_of(self, b: Bits, slots: list[np.ndarray]) -> np.ndarray:
        """The same for bits and their slots in the tables."""
        w = np.tile(self.weights, (1, b.lanes)).astype(np.float32)
        out = np.zeros(b.lanes)
        for a, z in zip(b.steps, b.steps[1:]):
            if a == z:
                continue
            x, gate = _inputs(self.code, b.node[a:z], [t.take(s[a:z]) for t, s in zip(self.tables, slots)])
            lane = b.lane[a:z]
            row = lane * np.int32(GATES)
            row += gate
            right, err = _mixed(w, row, x, b.bit[a:z])
            out += np.bincount(lane, np.log(right), b.lanes)
            row, err = row[::EVERY], err[::EVERY] * np.float32(EVERY)
            for k in range(INPUTS):
                w[k] += np.bincount(row, err * x[k][::EVERY], w.shape[1])
        return out


# ---- the unigram base ----------------------------------------------------------


def _tokens(batches: Iterator) -> Iterator:
    """(kind, h, c): words (kind 0, 64-bit hash) and pairs of bytes (kind 1) with their counts."""
    import pyarrow as pa
    import xxhash

    def rows(kind: int, h: np.ndarray, c: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind), pa.int32()), pa.array(h, pa.int64()),
                                           pa.array(c, pa.int64())], names=["kind", "h", "c"])

    def flush():
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        for a in range(0, len(h), 50_000):
            yield rows(0, h[a:a + 50_000], np.fromiter(words.values(), np.int64, len(words))[a:a + 50_000])

    words: Counter = Counter()
    pairs = np.zeros(65536, np.int64)
    for b in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
        texts = [bytes([END])]
        for t in b.column(0):
            raw, own = spelled(t.as_py() or "")
            words.update(own)
            texts.append(raw)  # each ends with the byte that stands before the next
        data = np.frombuffer(b"".join(texts), np.uint8)
        pairs += np.bincount(data[:-1].astype(np.int32) * 256 + data[1:], minlength=65536)
        if len(words) > 400_000:
            yield from flush()
            words = Counter()
    yield from flush()
    seen = np.flatnonzero(pairs)
    yield rows(1, seen, pairs[seen])


def _scored(frequent: np.ndarray, logs: np.ndarray):
    """Per row: figures of frequent words; hashes and counts of its other words. Per chunk: its pieces."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
                 "binary": pa.binary(), "array<boolean>": pa.list_(pa.bool_())}
        schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in _SCORED.split(", "))])
        row = chunk = TaskContext.get().partitionId() << 33
        enough = {True: CHUNK >> 6, False: CHUNK >> 6}  # the first chunks are short, so that a small input has several
        waiting: dict = {True: [], False: []}
        size = {True: 0, False: 0}
        pending: list = []  # chunks that are not in a bundle yet
        bundles = 0

        def chunked(learn: bool):
            nonlocal chunk
            pending.append((chunk, learn, size[learn], waiting[learn]))
            chunk += 1
            waiting[learn], size[learn], enough[learn] = [], 0, min(CHUNK, 2 * enough[learn])
            if sum(n for _, _, n, _ in pending) >= BUNDLE:
                yield bundled(pending)
                pending.clear()

        def bundled(some: list):
            nonlocal bundles
            bundles += 1
            first, learn, sizes, texts = zip(*some)
            owners, every = zip(*itertools.chain.from_iterable(texts))
            return pa.RecordBatch.from_pylist([{
                "chunk": first[0], "learn": learn, "n_chunk": sum(sizes), "owners": owners, "packed": _deflated(b"".join(every)),
                "lengths": list(map(len, every)), "chunks": list(map(len, texts)), "bundle": True}], schema)

        def batch(ids: list, spelt: list):
            nonlocal row
            sizes = np.array([len(words) for _, words in spelt])
            every = [w for _, words in spelt for w in words]
            codes = {w: k for k, w in enumerate(dict.fromkeys(every))}
            code = np.fromiter(map(codes.__getitem__, every), np.int64, len(every))
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, codes), np.uint64, len(codes)).view(np.int64)
            at = np.minimum(np.searchsorted(frequent, h), max(0, len(frequent) - 1))
            known = frequent[at] == h if len(frequent) else np.zeros(len(h), bool)
            log = np.where(known, logs[at], 0.0) if len(frequent) else np.zeros(len(h))
            owner = np.repeat(np.arange(len(spelt)), sizes)
            n_known = np.bincount(owner, known[code], len(spelt)).astype(np.int64)
            base = np.bincount(owner, log[code], len(spelt))
            rare = ~known[code]
            pair, times = np.unique(owner[rare] * max(1, len(codes)) + code[rare], return_counts=True)
            lists = np.bincount(pair // max(1, len(codes)), minlength=len(spelt))
            offsets = pa.array(np.concatenate([[0], np.cumsum(lists)]), pa.int32())
            n = len(spelt)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes + 1, pa.int64()),
                 pa.array(n_known, pa.int64()), pa.array(base.astype(float)),
                 pa.array([len(raw) for raw, _ in spelt], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(h[pair % max(1, len(codes))], pa.int64())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
                 *(pa.nulls(n, f.type) for f in list(schema)[8:-1]), pa.array([False] * n)], schema=schema)
            row += n
            return out

        ids, spelt, held = [], [], 0
        for b in batches:
            for doc_id, t, learn in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                ids.append(doc_id)
                spelt.append(spelled(t.as_py() or ""))
                for piece in pieces(spelt[-1][0]):
                    waiting[learn].append((row + len(ids) - 1, piece))
                    size[learn] += len(piece)
                    if size[learn] >= enough[learn] or len(waiting[learn]) >= TEXTS:
                        yield from chunked(learn)
                held += len(spelt[-1][0])
                if held >= CHUNK >> 3:
                    yield batch(ids, spelt)
                    ids, spelt, held = [], [], 0
        if ids:
            yield batch(ids, spelt)
        for learn in (True, False):
            if waiting[learn]:
                yield from chunked(learn)
        if bundles or sum(n for _, _, n, _ in pending) > ALONE:
            pending = [pending] if pending else []
        else:  # so that several tasks work on a small input
            pending = [[c] for c in pending]
        yield from map(bundled, pending)

    return run


_SCORED = ("row long, doc_id long, n_tokens long, n_frequent long, log_frequent double, n_bytes long, "
           "h array<long>, tf array<long>, chunk long, learn array<boolean>, n_chunk long, owners array<long>, packed binary, "
           "lengths array<long>, chunks array<long>, bundle boolean")
_BUNDLE = ["chunk", "learn", "n_chunk", "owners", "packed", "lengths", "chunks"]


def _logs(chunks: DataFrame, code: Code) -> DataFrame:
    """(row, log) of the pieces of ``chunks`` (_BUNDLE)."""
    spark = chunks.sparkSession
    n = shuffle_partitions(spark)
    size = chunks.agg(F.sum("n_chunk")).first()[0] or 0
    # at most three pairs a byte; several shards a task, so that tasks are alike
    shards = 1 << max(4 * n - 1, size * 2 // SHARD).bit_length()
    code_ = spark.sparkContext.broadcast(code)
    sent = chunks.select("chunk", "learn", "packed", "lengths", "chunks").mapInArrow(
        lambda it: _sent(code_.value, shards)(_texts(it)), "shard int, chunk long, parts array<long>, pairs binary, times binary")
    answers = (sent.repartition(n, "shard").sortWithinPartitions("shard")
               .mapInArrow(lambda it: _answered(_opened(code_.value)(it), _outside), "chunk long, shard int, counts binary"))
    texts = chunks.drop("n_chunk").withColumn("shard", F.lit(-1))
    both = answers.unionByName(texts, allowMissingColumns=True).select("chunk", "shard", "counts", "learn", "owners", "packed", "lengths", "chunks")
    # the one exchange of texts and answers is read twice: Spark keeps its files while the RDD is there
    rows = both.repartition(n, "chunk").sortWithinPartitions("chunk", "shard").rdd
    sums = list(map(np.array, rows.mapPartitions(_fitted(code_, shards)).collect()))  # one short row a task
    w = sum(sums)
    weights = (w[:-1] / w[-1]).reshape(INPUTS, GATES).astype(np.float32) if sums else _start_weights()
    return spark.createDataFrame(rows.mapPartitions(_probabilities(code_, weights, shards)), "row long, log double", verifySchema=False)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of
    each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = rows.filter(in_training(F.col("doc_id"))).select("text")
    counts = written(learn.mapInArrow(_tokens, "kind int, h long, c long").groupBy("kind", "h").agg(F.sum("c").alias("c")), "lm_counts")
    pairs = np.zeros((256, 256), np.int64)
    for r in counts.filter("kind = 1").collect():  # at most 65536
        pairs[r.h >> 8, r.h & 255] = r.c
    words = counts.filter("kind = 0").select("h", "c")
    n_words, n_distinct = words.agg(F.sum("c"), F.count("*")).first()
    ends = learn.count()
    total, distinct = (n_words or 0) + ends, n_distinct + (ends > 0)
    often = words.filter(F.col("c") * FREQUENT >= total).orderBy("h").toPandas()  # at most FREQUENT
    frequent, logs = often["h"].to_numpy(np.int64), np.log10(often["c"].to_numpy(float) + 1)

    known = spark.sparkContext.broadcast((frequent, logs))
    spelt = written(rows.withColumn("learn", in_training(F.col("doc_id"))).mapInArrow(lambda it: _scored(*known.value)(it), _SCORED), "lm_rows", "bundle")
    scored = spelt.filter("NOT bundle").drop("bundle", *_BUNDLE)
    chunks = spelt.filter("bundle").select(*_BUNDLE)
    bits = written(_logs(chunks, Code(pairs)).groupBy("row").agg((F.sum("log") / _LN10).alias("score")), "lm_scores")
    remove_path(spark, f"{spelt.written_at}/bundle=true")  # its last reader is written
    rare = (scored.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", "x.h", "x.tf")
            .join(words.filter(F.col("c") * FREQUENT < total), "h")
            .groupBy("row").agg(F.sum("tf").alias("n_rare"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("log_rare")))
    each = math.log10(total + distinct + 1)
    known_end = F.lit(1 if ends else 0)
    base = F.col("log_frequent") + F.coalesce("log_rare", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(each)
    return scored.drop("h", "tf").join(bits, "row").join(rare, "row", "left").select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_rare", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
