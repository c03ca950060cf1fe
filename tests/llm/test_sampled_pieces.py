import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries
from tessera.llm import sampled_pieces as sp

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "   ", "a", " a  b ", "x\ny\r\n\tz", "▁lower▁", "日本語 🙂🙂", "ab1234 &&&###", "\x00\x07", "é" * 50, "a" * 3000, "don't (stop) now...", "İ ẞ ﬁ"]


@pytest.fixture(scope="module")
def sampler():
    return sp.Sampler(PATH)


def paths(s, text):
    """All segmentations and their weights, by enumeration of the whole text's lattice."""
    text = " " + text
    ends = s.arcs(text)

    def walk(e):
        if not e:
            yield (), 1.0
        for b, c, w in ends[e - 1] if e else ():
            for p, v in walk(b):
                yield (*p, c), v * w

    return dict(walk(len(text)))


def test_samples_have_the_lattice_distribution(sampler):
    for text in ("the cat", "ab\nab"):
        all_ = paths(sampler, text)
        whole, n = sum(all_.values()), 20_000
        got = Counter(tuple(x.tolist()) for x in sampler.sample([text] * n, [str(i) for i in range(n)]))
        want = {tuple(sampler._spell(np.array(p), np.array([0, len(p)]))[0].tolist()): w / whole for p, w in all_.items()}
        assert set(got) <= set(want)
        for p, share in want.items():
            assert abs(got[p] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 2e-4


def test_lossless_and_independent_of_batches(sampler):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ODD
    keys = [str(i) for i in range(len(texts))]
    all_ = sampler.sample(texts, keys)
    assert [sampler.decode(i.tolist()) for i in all_] == texts
    order = list(range(len(texts)))
    random.Random(0).shuffle(order)
    fresh = sp.Sampler(PATH)
    for i in order[:60]:
        assert fresh.sample([texts[i]], [keys[i]])[0].tolist() == all_[i].tolist()
    assert any(a.tolist() != b.tolist() for a, b in zip(sampler.sample(texts[:5], keys[:5]), sampler.sample(texts[:5], keys[5:10]), strict=True))


def exact(s, unit):
    """The thresholds of each node of a unit, by sums over its arcs in logarithms."""
    total, out = [0.0], []
    for here in s.arcs(unit):
        logs = [total[b] + math.log(w) for b, _, w in here]
        top = max(logs)
        sizes = [math.exp(x - top) for x in logs]
        total.append(top + math.log(sum(sizes)))
        out.append([sum(sizes[: i + 1]) / sum(sizes) for i in range(len(here))])
    return out


def limits(s, unit):
    end = s.unit_last[s.unit[unit]] + 1
    return [s.limit[a:b].tolist() for a, b in zip(s.first[end - len(unit) : end], s.first[end - len(unit) + 1 : end + 1], strict=True)]


def test_thresholds_depend_on_the_unit_alone(sampler):
    r = random.Random(3)
    text = "unbelievable internationalisation, " + "".join(r.choice("abcdeinrst日é") for _ in range(31)) + " " + "aab" * 4000
    used = sp.Sampler(PATH)
    while len(used.first) < 2_000_000:
        used._learn([" " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz日é") for _ in range(r.randint(1, 12))) + str(len(used.unit)) + "".join(r.choice("xyz") for _ in range(3)) + str(i) for i in range(20_000)])
    units = [u for u in dict.fromkeys(used._units(text)) if u not in used.unit]
    used._learn(units)
    fresh = sp.Sampler(PATH)
    for u in units:
        fresh._learn([u])
        assert limits(fresh, u) == limits(used, u)
        for got, want in zip(limits(fresh, u), exact(fresh, u), strict=True):
            assert got[-1] == 1 << 53
            assert all(abs(g / (1 << 53) - w) < 1e-9 for g, w in zip(got, want, strict=True))


def test_library_decodes_them_too(sampler):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t for t in ODD if t and "▁" not in t]
    for t, ids in zip(texts, sampler.sample(texts, texts), strict=True):
        assert lib.decode(ids.tolist()) == t


def test_query_and_edges(spark):
    got = queries.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate([None, *ODD, ODD[4], ODD[4]])] + [(None, "no key", "x", 5)], "doc_id long, text string, ids string, lossless int")
    rows = sp.encode(df, "doc_id", PATH).collect()
    assert len(rows) == len(ODD) + 4 and all(r.lossless for r in rows) and rows[0].asDict().keys() == {"doc_id", "text", "n_pieces", "ids", "ids_crc32", "lossless"}
    null = next(r for r in rows if r.doc_id == 0)
    assert null.ids is None and null.n_pieces == 0
    assert sp.encode(df.where("false"), "doc_id", PATH).count() == 0
