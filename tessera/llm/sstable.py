"""Token ids in sorted-string-table shards.

``write_sstable`` tokenises documents and writes them, in ascending key order,
as immutable shard files; ``read_sstable`` scans them; ``SSTable`` looks up one key.

A shard file holds, in this order:

* blocks of about BLOCK_BYTES: entries ``varint shared, varint unshared,
  varint value_bytes, key suffix, value``, where *shared* is the length of the
  prefix that the key has in common with the entry before it (0 at the start of
  a block), then the block's crc32;
* the sparse index: for each block its first key, offset, length and entries;
* a Bloom filter of the keys (BLOOM_BITS bits a key, double hashing);
* a footer of fixed size with the places of the above, the counts and a magic word.

Keys are order-preserving bytes of a 64-bit integer (null sorts first); a value
is a byte with the width of its ids, 2 or 4, then the ids, little-endian.

Edge cases: a null or empty text has the end id alone; null doc_ids come first;
rows with the same doc_id are all kept, ordered by a hash of their text; an empty table makes
no shard; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"TSRSST01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES = 64 * 1024
BLOOM_BITS = 10
BLOOM_HASHES = 7
END_ID = 1
_SIGN = 1 << 63


# ---------------------------------------------------------------- tokenising

#: Words seen by this Python worker.  It only saves time; dropping it changes nothing.
_CACHE: dict[str, "WordEncoder"] = {}
WORDS_KEPT = 600_000
IDS_KEPT = 6_000_000
CHARS_AT_ONCE = 1 << 20
_PUNCTUATED = r"([a-z])([,.;:!?]) "
_END = " \x00 "  # stands between words; a word holding it goes to the library alone


class WordEncoder:
    """The tokenizers library over distinct words.

    The tokenizer lowers, drops white space and never joins what it separates, so a
    text's ids are those of its words, one after another.  It also parts letters
    from punctuation, so that one sign after a letter and before a blank is a word of its own.  Each
    distinct word goes to the library once, many in a text with a mark between them.  Texts that may hold
    a special token go to it whole, for those are found in upper and lower case as they stand.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = np.array(self.tokenizer.encode(_END, add_special_tokens=False).ids, np.uint32)
        if len(self.mark) != 1:
            raise ValueError("the tokenizer has no single id for the mark between words")
        self.clear()

    def clear(self) -> None:
        self.word: dict[str, int] = {}
        self.flat = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if "\x00" not in w]
        found, sizes = [], []
        for i in range(0, len(plain), 1000):
            some = plain[i : i + 1000]
            ids = np.array(self._ids([_END.join(["", *some, ""])])[0], np.uint32)
            ends = np.flatnonzero(ids == self.mark[0])
            if len(ends) != len(some) + 1:
                raise ValueError("words and marks don't match")
            found.append(np.delete(ids, ends))
            sizes.append(np.diff(ends) - 1)
        if odd := [w for w in words if "\x00" in w]:
            alone = [np.array(x, np.uint32) for x in self._ids(odd)]
            found += alone
            sizes.append(np.array([len(x) for x in alone]))
        n = len(self.word)
        self.word.update(zip([*plain, *odd], range(n, n + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *found])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the ids of each."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        special = pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        if special.any():
            return self._with_special(column, special)
        # words stand between blanks; white space of other kinds is the library's
        spaced = pc.replace_substring(pc.ascii_lower(column), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(spaced, _PUNCTUATED, r"\1 \2 "), " ")
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.word) > WORDS_KEPT or len(self.flat) > IDS_KEPT:
            self.clear()
        if new := [w for w in names if w not in self.word]:
            self.learn(new)
        known = np.fromiter(map(self.word.__getitem__, names), np.int64, len(names))
        at = known[coded.indices.to_numpy()] if len(names) else known
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[at] - (ends - size), size)]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = np.concatenate([[0], ends])
        return ids, np.diff(ends[bounds])

    def _with_special(self, column: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = self.encode(column.filter(pa.array(~special)))
        rest, whole = iter(np.split(ids, np.cumsum(sizes)[:-1])), iter(self._ids(column.filter(pa.array(special)).to_pylist()))
        each = [np.array(next(whole), np.uint32) if s else next(rest) for s in special.tolist()]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def encoder(path: str) -> WordEncoder:
    if path not in _CACHE:
        _CACHE[path] = WordEncoder(path)
    return _CACHE[path]


# ------------------------------------------------------------------ the format


def pack_key(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + _SIGN).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - _SIGN


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while (x := b[at]) > 127:
        n |= (x & 127) << shift
        at, shift = at + 1, shift + 7
    return n | x << shift, at + 1


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [((a + i * b) & (1 << 64) - 1) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Takes keys in ascending order; holds one block, the index and the keys' hashes."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashes: list[bytes] = []
        self.tokens = self.entries = 0
        self._block, self._first, self._last, self._n, self._size = [], b"", b"", 0, 0

    def add(self, key: bytes, value: bytes) -> None:
        if key < self._last:
            raise ValueError("keys must ascend")
        shared = 0
        if self._n:
            shared = len(os.path.commonprefix((key, self._last)))
        else:
            self._first = key
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self._block += [head, value]
        self._size += len(head) + len(value)
        if key != self._last or not self.entries:
            self.hashes.append(key)
        self._last = key
        self._n += 1
        self.entries += 1
        self.tokens += (len(value) - 1) // value[0]
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def _flush(self) -> None:
        if self._n:
            body = b"".join(self._block)
            at = self._put(body + zlib.crc32(body).to_bytes(4, "little"))
            self.index.append((self._first, at, len(body) + 4, self._n))
            self._block, self._n, self._size = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(size) + _varint(n) for k, at, size, n in self.index)
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at, bloom_at = self._put(index), self._put(bytes(bloom))
        self._put(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), self.entries, self.tokens, zlib.crc32(index + bytes(bloom)), bits & 0xFFFFFFFF, MAGIC))


class SSTable:
    """A shard opened for lookup and scan."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        with self.fs.open_input_file(self.path) as f:
            size = f.size()
            tail = f.read_at(FOOTER.size, size - FOOTER.size)
            index_at, index_len, bloom_at, bloom_len, self.entries, self.tokens, crc, self.bits, magic = FOOTER.unpack(tail)
            if magic != MAGIC:
                raise ValueError(f"{uri} is no shard")
            index, self.bloom = f.read_at(index_len, index_at), f.read_at(bloom_len, bloom_at)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"{uri} is damaged")
        self.index, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            key, at = index[at : at + n], at + n
            place, at = _read_varint(index, at)
            length, at = _read_varint(index, at)
            count, at = _read_varint(index, at)
            self.index.append((key, place, length, count))

    @staticmethod
    def _entries(data: bytes):
        body = data[:-4]
        if zlib.crc32(body) != int.from_bytes(data[-4:], "little"):
            raise ValueError("a block is damaged")
        at, key = 0, b""
        while at < len(body):
            shared, at = _read_varint(body, at)
            rest, at = _read_varint(body, at)
            size, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + rest]
            at += rest
            yield key, body[at : at + size]
            at += size

    def scan(self):
        with self.fs.open_input_file(self.path) as f:
            for _, at, size, _ in self.index:
                yield from self._entries(f.read_at(size, at))

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays under doc_id, usually none or one."""
        key = pack_key(doc_id)
        if not self.may_hold(key):
            return []
        firsts = [k for k, *_ in self.index]
        i = max(0, bisect.bisect_left(firsts, key) - 1)
        found = []
        with self.fs.open_input_file(self.path) as f:
            while i < len(self.index) and self.index[i][0] <= key:
                found += [unpack_ids(v) for k, v in self._entries(f.read_at(self.index[i][2], self.index[i][1])) if k == key]
                i += 1
        return found


# ------------------------------------------------------------------- on Spark

_MANIFEST = "shard int, path string, entries long, tokens long"
_SCAN = "doc_id long, start long, n_tokens long, ids binary"


def _put(files: pafs.FileSystem, temp: str, path: str) -> None:
    """Give a finished shard its name.  A task that runs again finds what it wrote before, with the same bytes."""
    if files.get_file_info(path).type == pafs.FileType.File:
        files.delete_file(temp)
        return
    try:
        files.move(temp, path)
    except OSError:  # another attempt was there first
        if files.get_file_info(path).type != pafs.FileType.File:
            raise
        files.delete_file(temp)


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        common.claim("sstable", _CACHE.clear)
        final = f"{folder}/shard-{shard:06d}.sst"
        files, path = pafs.FileSystem.from_uri(final)
        temp, out, w = f"{path}.{uuid.uuid4().hex}.tmp", None, None
        for batch in batches:
            for some in common.slices(batch, 1, CHARS_AT_ONCE):
                keys = some.column(0).to_pylist()
                ids, sizes = enc.encode(some.column(1))
                if out is None:
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(temp)
                    w = Writer(out)
                # each document's ids, the end id after them
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                b = 0
                for k, e in zip(keys, (ends + np.arange(1, len(ends) + 1)).tolist(), strict=True):
                    w.add(pack_key(k), pack_ids(ids[b:e]))
                    b = e
        if out is not None:
            w.close()
            out.close()
            _put(files, temp, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [final], "entries": [w.entries], "tokens": [w.tokens]})

    return write


def write_sstable(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None) -> list[tuple[int, str, int, int]]:
    """Tokenise docs (doc_id, text), write shards in ascending doc_id order; return the manifest, a row for each shard.

    One range shuffle of the text; a task holds one block, its shard's index and key hashes.
    """
    spark = docs.sparkSession
    common.ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(shards or common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return sorted(tuple(r) for r in dealt.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), _MANIFEST).collect())


def _scan(batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, starts, sizes, values, held = [], [], [], [], 0
            for key, value in SSTable(path).scan():
                keys.append(unpack_key(key))
                ids = unpack_ids(value)
                starts.append(base)
                sizes.append(len(ids))
                values.append(ids.tobytes())
                base += len(ids)
                held += len(values[-1])
                if held > 8 << 20:
                    yield _batch(keys, starts, sizes, values)
                    keys, starts, sizes, values, held = [], [], [], [], 0
            if keys:
                yield _batch(keys, starts, sizes, values)


def _batch(keys, starts, sizes, values):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_sstable(spark: SparkSession, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids (little-endian uint32), from the files, a task for each shard."""
    common.ship_package(spark)
    base, rows = 0, []
    for _, path, _, tokens in manifest:
        rows.append((path, base))
        base += tokens
    frame = spark.createDataFrame(rows, "path string, base long")
    return frame.repartition(max(1, len(rows))).mapInArrow(_scan, _SCAN)


def digest(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write, read back, and describe each document's ids."""
    read = read_sstable(spark, write_sstable(docs, common.shared_dir(spark), tokenizer))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
