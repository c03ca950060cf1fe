import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import common, queries, sstable

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    None, "", " ", "\n\n", "it's  they'll DON'T", "a\x1cb\x85c　d", "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ﬁ é x ́y",
    "ß.ẞ K Å", "12.5,7!?a1b2", "日本語テキスト。です", "🙂🙂 a🙂b", "\t\ttab\r\nline sep", "_a_b-c### &&& $$$ 9's", "x" * 3000, "é" * 999 + ".",
]


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_words_give_the_ids_of_whole_texts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    enc = sstable.WordEncoder(PATH)
    ids, sizes = enc.encode([t or "" for t in texts])
    got = np.split(ids, np.cumsum(sizes)[:-1])
    for text, a, b in zip(texts, got, expected(texts), strict=True):
        assert a.tolist() == b, text


def test_round_trip_and_lookup(spark):
    rows = [(i * 3, t, "clash") for i, t in enumerate(ODD)] + [(6, "again", ""), (6, "again", ""), (None, "no id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    manifest = sstable.write_sstable(df, common.shared_dir(spark), PATH, shards=3)
    read = sstable.read_sstable(spark, manifest).collect()
    assert len(read) == len(rows)
    ordered = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    want = {}
    for (d, t, _), ids in zip(rows, expected([t for _, t, _ in rows]), strict=True):
        want.setdefault(d, []).append([*ids, 1])
    got = {}
    for r in read:
        got.setdefault(r.doc_id, []).append(np.frombuffer(r.ids, "<u4").tolist())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    tables = [sstable.SSTable(path) for _, path, _, _ in manifest]
    for d in want:
        assert sorted(x.tolist() for t in tables for x in t.get(d)) == sorted(want[d])
    assert not [x for t in tables for d in range(1, 40, 3) for x in t.get(d)]


def test_blocks_and_prefixes(tmp_path):
    p = tmp_path / "s"
    with p.open("wb") as f:
        w = sstable.Writer(f)
        for i in range(5000):
            w.add(sstable.pack_key(i * 2 - 5000), sstable.pack_ids(np.arange(i % 50) * (70_000 if i % 3 else 1)))
        w.close()
    t = sstable.SSTable(str(p))
    assert len(t.index) > 3 and t.entries == 5000
    assert t.get(-5000)[0].size == 0 and t.get(4996)[0].tolist() == list(range(48)) and t.get(4998)[0].tolist() == list(range(0, 49 * 70_000, 70_000)) and t.get(3) == []
    wrong = sum(t.may_hold(sstable.pack_key(i)) for i in range(-4999, 4999, 2))
    assert wrong < 150


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.digest(spark, empty, PATH).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op2_sstable(spark, "/root/testdata/sf0.001").collect()}
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").sort_by("doc_id").to_pylist()
    at = 0
    for row, ids in zip(t, expected([r["text"] for r in t]), strict=True):
        ids = [*ids, 1]
        r = got[row["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
