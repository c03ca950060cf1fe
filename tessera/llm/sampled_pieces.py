"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text's lattice has an arc for each piece of the vocabulary that stands in it, and one
for the bytes of a character that is no piece.  Forward filtering sums the weights of all paths to each place; backward
sampling then draws a path from the end, arc by arc, in proportion to
(weight of paths to the arc's start) x (weight of the arc): an exact sample of segmentations, with
probability proportional to the product of the pieces' weights to the power ``alpha``.

Weights are Zipf's law over the pieces' ranks, for the vocabulary of a merge model has ranks and no probabilities.

The lattice falls apart wherever no piece of the vocabulary holds both neighbouring characters, such as before a blank
after a word.  Distinct units between such places are filtered once, all new ones of many texts together:
the vocabulary's trie is walked from every place at once, and sums run over place and rank of the arcs.  A place's arcs are kept as
thresholds of 53 bits that depend on the unit alone, and a draw's random number is a hash of the row's
key, the unit's number in the text and the step; so a row is segmented alike in any batch, task or run.

Decoding joins pieces and bytes and drops the blank put before the text: what was encoded comes back exactly, blanks, controls and
the blank sign U+2581 included.

Edge cases: a null text has null ids and no pieces; an empty text has no ids; rows with the same key and text get the same ids; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ALPHA = 0.7
SEED = 1
#: A worker forgets all units before new ones if it holds so many arcs (16 bytes each) or units.
ARCS_KEPT = 2_000_000
UNITS_KEPT = 200_000
#: Texts are taken together up to so many characters, units learnt together up to so many; a unit over LONG is cut where no piece spans.
CHARS_AT_ONCE = 1 << 19
LEARN_AT_ONCE = 1 << 17
LONG = 32
_ONE = 1 << 53
_RUNS = re.compile(r" +[^ ]*")
_A = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... of size[0] numbers, then those of begin[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class _Trie:
    """The vocabulary's trie as a hash table of (node, character) with linear probing."""

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, str], int] = {}
        self.piece_at: list[int] = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in p:
                if (to := nodes.get((at, c))) is None:
                    to = nodes[at, c] = len(self.piece_at)
                    self.piece_at.append(-1)
                at = to
            self.piece_at[at] = i
        self.piece_at = np.array(self.piece_at, np.int32)
        key = np.array([n << 21 | ord(c) for n, c in nodes], np.int64)
        to = np.fromiter(nodes.values(), np.int32, len(nodes))
        self.mask = (1 << max(4, (4 * len(key)).bit_length())) - 1
        self.key, self.to = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.key[slot[left]] < 0
            some, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.key[some], self.to[some] = key[put], to[put]
            left = left[self.key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _A) >> np.uint64(40)).astype(np.int64) & self.mask

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child by char of each node, -1 if there is none."""
        key = node.astype(np.int64) << 21 | char
        slot = self._slot(key)
        there = self.key[slot]
        out = np.where(there == key, self.to[slot], -1)
        left = np.flatnonzero((there != key) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.key[slot[left]]
            hit = there == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


class Sampler:
    def __init__(self, model: str, alpha: float = ALPHA, seed: int = SEED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.seed, self.bytes = seed, np.zeros(256, np.int32)
        out: list[bytes] = []
        pieces, self.weight = [], {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                out.append(b"")
            else:
                piece = piece.replace("▁", " ")
                out.append(piece.encode())
                self.weight[piece] = (i, math.exp(-alpha * math.log(len(pieces) + 10)))
                pieces.append(piece)
        self.fallback = math.exp(-alpha * 4 * math.log(len(pieces) + 10))  # for a character in bytes
        self.id_of = np.array([self.weight[p][0] for p in pieces], np.int32)
        self.weight_of = np.array([self.weight[p][1] for p in pieces])
        self.trie = _Trie(pieces)
        self.depth = max(map(len, pieces))
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.out = out
        self.out_size = np.array([len(b) for b in out], np.int64)
        self.out_at = np.cumsum(self.out_size) - self.out_size
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.unit: dict[str, int] = {}
        self.unit_last = np.empty(0, np.int64)  # of each unit: its last node
        self.first = np.zeros(1, np.int64)  # of each node: its first arc
        self.limit, self.before, self.code = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)  # of each arc

    def arcs(self, s: str) -> list[list[tuple[int, int, float]]]:
        """For each end in s (from 1): start, code and weight of the arcs into it; plain, for tests."""
        out = [[] for _ in s]
        for b in range(len(s)):
            if s[b] not in self.weight:
                out[b].append((b, -ord(s[b]) - 1, self.fallback))
            for e in range(b + 1, min(len(s), b + self.depth) + 1):
                if s[b:e] in self.weight:
                    out[e - 1].append((b, *self.weight[s[b:e]]))
        return out

    def _filter(self, units: list[str]) -> tuple:
        """Forward filtering of all units together: last node of each unit; of each node its number of arcs; of each arc threshold, node before, code."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(chars)
        begin = np.cumsum(size) - size
        unit_end = np.repeat(begin + size, size)
        # walk the trie from every place; a piece of d characters from i is an arc from node i - 1 into node i + d - 1
        found: list[tuple] = []
        node, at, d = np.zeros(n, np.int32), np.arange(n), 0
        single = np.zeros(n, bool)
        while len(at):
            node = self.trie.step(node, chars[at + d])
            go = node >= 0
            node, at = node[go], at[go]
            piece = self.trie.piece_at[node]
            is_ = piece >= 0
            found.append((at[is_], piece[is_]))
            if d == 0:
                single[at[is_]] = True
            d += 1
            inside = at + d < unit_end[at]
            node, at = node[inside], at[inside]
        alone = np.flatnonzero(~single)
        # arcs of a node: the longest first, so that they can be put in their places length by length
        number = (~single).astype(np.int64)
        for d, (at, _) in enumerate(found):
            number[at + d] += 1
        first = np.cumsum(number) - number
        total = int(number.sum())
        place, into, start = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        code, weight, rank = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int64)
        seen, lo = np.zeros(n, np.int64), 0
        for d in range(len(found) - 1, -1, -1):
            at, piece = found[d]
            some = slice(lo, lo + len(at))
            into[some], start[some] = at + d, at
            code[some], weight[some] = self.id_of[piece], self.weight_of[piece]
            rank[some] = seen[at + d]
            seen[at + d] += 1
            lo += len(at)
        some = slice(lo, total)
        into[some], start[some], code[some], weight[some], rank[some] = alone, alone, -chars[alone] - 1, self.fallback, seen[alone]
        place = first[into] + rank
        # sums run by place in the unit, then by rank: within one such step each node has one arc at most
        offset = np.arange(n) - np.repeat(begin, size)
        most = int(rank.max()) + 1 if total else 1
        step = offset[into] * most + rank
        order = np.argsort(step.astype(np.uint16) if n and int(offset.max() + 1) * most < 1 << 16 else step, kind="stable")
        into, start, weight, place = into[order], start[order], weight[order], place[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(step[order])) + 1, [total]]).tolist() if total else [0]
        at_of = (step[order][edges[:-1]] // most).tolist() if total else []
        path = np.zeros(n + len(units) + 1)  # weight of all paths to the places between characters; shifted by one for each unit before
        shift = np.repeat(np.arange(len(units)), size)
        to, since = into + shift[into] + 1, start + shift[into]
        path[begin + np.arange(len(units))] = 1.0
        running, share = np.empty(total), np.empty(total)
        ends: list[int] = []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            t = to[lo:hi]
            path[t] += path[since[lo:hi]] * weight[lo:hi]
            running[lo:hi] = path[t]
            ends.append(lo)
            if i + 1 == len(at_of) or at_of[i + 1] != at_of[i]:  # the last rank of this place
                share[ends[0] : hi] = running[ends[0] : hi] / path[to[ends[0] : hi]]
                ends.clear()
                if at_of[i] % 16 == 15:  # keep long units in range: exact, by powers of two
                    here = np.flatnonzero(size > at_of[i] + 1)
                    window = (begin + np.arange(len(units)))[here][:, None] + at_of[i] + 1 - np.arange(min(self.depth, at_of[i] + 2))[None]
                    path[window] = np.ldexp(path[window], -np.frexp(path[window].max(1))[1][:, None])
        limit, before, codes = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.int32)
        limit[place] = (share * _ONE).astype(np.int64)
        if total:
            limit[first + number - 1] = _ONE
        before[place] = np.where(start > begin[shift[into]], start - 1, -1)
        inverse = np.empty(total, np.int32)
        inverse[place] = code[order]
        return begin + size - 1, number, limit, before, inverse

    def _learn(self, new: list[str]) -> None:
        at, chars = 0, 0
        for i, u in enumerate(new):
            chars += len(u)
            if chars >= LEARN_AT_ONCE or i + 1 == len(new):
                some = new[at : i + 1]
                last, number, limit, before, code = self._filter(some)
                nodes, arcs = len(self.first) - 1, len(self.limit)
                self.unit.update(zip(some, range(len(self.unit), len(self.unit) + len(some)), strict=True))
                self.unit_last = np.concatenate([self.unit_last, last + nodes])
                self.first = np.concatenate([self.first, arcs + np.cumsum(number)])
                self.limit = np.concatenate([self.limit, limit])
                self.before = np.concatenate([self.before, np.where(before >= 0, before + nodes, -1).astype(np.int32)])
                self.code = np.concatenate([self.code, code])
                at, chars = i + 1, 0

    def _cut(self, word: str) -> list[str]:
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _units(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text
        # runs of blanks stay with the word after them
        words = _RUNS.findall(text) if "  " in text or text[-1] == " " else [" " + w for w in text[1:].split(" ")]
        if len(max(words, key=len)) > LONG:
            return [u for w in words for u in (self._cut(w) if len(w) > LONG else [w])]
        return words

    def sample(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The ids of a sampled segmentation of each text."""
        ids, bounds = self._sample(texts, keys)
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _sample(self, texts: list[str], keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin and end."""
        units = [self._units(t) for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        flat = [u for us in units for u in us]
        total = len(flat)
        # look each distinct unit up once
        coded = pa.array(flat, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.limit) > ARCS_KEPT or len(self.unit) > UNITS_KEPT:
            self.clear()
        if new := [u for u in names if u not in self.unit]:
            self._learn(new)
        known = np.fromiter(map(self.unit.__getitem__, names), np.int64, len(names))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if not total:
            return np.empty(0, np.int32), bounds
        unit = known[coded.indices.to_numpy()]
        number = np.arange(total) - np.repeat(bounds[:-1], counts)
        seeds = np.array([xxhash.xxh3_64_intdigest(f"{self.seed}:{k}") for k in keys], np.uint64)
        with np.errstate(over="ignore"):
            stream = _mix(np.repeat(seeds, counts) + number.astype(np.uint64) * _A)
            node, alive, steps = self.unit_last[unit], np.arange(total), []
            length = np.zeros(total, np.int64)
            while len(alive):
                u = (_mix(stream + np.uint64(len(steps) + 1) * _A) >> np.uint64(11)).astype(np.int64)
                arc = self.first[node]
                more = np.flatnonzero(u >= self.limit[arc])
                while len(more):
                    arc[more] += 1
                    more = more[u[more] >= self.limit[arc[more]]]
                steps.append((alive, self.code[arc]))
                length[alive] += 1
                node = self.before[arc].astype(np.int64)
                go = np.flatnonzero(node >= 0)
                alive, node, stream = alive[go], node[go], stream[go]
        stop = np.cumsum(length)
        ids = np.empty(int(stop[-1]), np.int32)
        for t, (who, c) in enumerate(steps):
            ids[stop[who] - 1 - t] = c
        return self._spell(ids, np.concatenate([[0], stop])[bounds])

    def _spell(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put the bytes of a character that is no piece in its place."""
        if not len(ids) or ids.min() >= 0:
            return ids, bounds
        chars, which = np.unique(-1 - ids[ids < 0], return_inverse=True)
        raw = [chr(c).encode() for c in chars.tolist()]
        sizes = np.array([len(r) for r in raw], np.int64)
        spelled = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        size = np.ones(len(ids), np.int64)
        size[ids < 0] = sizes[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        out[out < 0] = spelled[_ranges((np.cumsum(sizes) - sizes)[which], sizes[which])]
        return out, ends[bounds]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.out.__getitem__, ids)).decode()[1:] if len(ids) else ""

    def _restored(self, ids: np.ndarray, bounds: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether decoding the ids of each text gives it back."""
        size = self.out_size[ids]
        decoded = self.out_bytes[_ranges(self.out_at[ids], size)].tobytes()
        raw = [b" " + t.encode() if t else b"" for t in texts]
        if decoded == b"".join(raw):
            ends = np.concatenate([[0], np.cumsum(size)])[bounds]
            if np.array_equal(np.diff(ends), np.fromiter(map(len, raw), np.int64, len(raw))):
                return [True] * len(texts)
        return [self.decode(ids[a:b].tolist()) == t for a, b, t in zip(bounds, bounds[1:], texts, strict=False)]


@functools.cache
def sampler(model: str, alpha: float, seed: int) -> Sampler:
    return Sampler(model, alpha, seed)


def _encode(model: str, alpha: float, seed: int):
    def encode(batches):
        s = sampler(model, alpha, seed)
        common.claim("sampled_pieces", sampler.cache_clear)
        for batch in batches:
            for some in common.slices(batch, 0, CHARS_AT_ONCE):
                texts = some.column(0).to_pylist()
                whole_texts = [t or "" for t in texts]
                ids, bounds = s._sample(whole_texts, some.column(1).to_pylist())
                whole = s._restored(ids, bounds, whole_texts)
                null = pa.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=null)
                at = pa.py_buffer((bounds * 4).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), len(texts), [None, at, pa.py_buffer(ids.astype("<i4"))])
                raw = pc.if_else(null, pa.scalar(None, pa.binary()), raw)
                yield pa.RecordBatch.from_arrays([*some.columns[2:], lists, raw, pa.array(whole, pa.bool_())], [*some.schema.names[2:], "ids", "raw", "lossless"])

    return encode


def encode(docs: DataFrame, key: str, model: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs with n_pieces, ids, ids_crc32 (of the ids, little-endian) and lossless (whether decoding gave the text back); columns of those names are replaced."""
    common.ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("n_pieces", "ids", "ids_crc32", "lossless")]
    narrow = docs.select(F.col("text").cast("string").alias("_t"), F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("_key"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept)])
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in narrow.schema.fields[2:])
    found = narrow.mapInArrow(_encode(model, alpha, seed), f"{shape}ids array<int>, raw binary, lossless boolean")
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)], F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", F.crc32("raw").alias("ids_crc32"), "lossless")
