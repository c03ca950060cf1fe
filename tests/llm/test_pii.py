import hashlib
import re

import pyarrow.parquet as pq

from tessera.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = [int(c) for c in d[::-1]]
    return sum(s[::2] + [x * 2 - 9 if x > 4 else x * 2 for x in s[1::2]]) % 10 == 0


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


ODD = [
    None, "", "a@b.c%d@e.f g@h", "@@a@b..c x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 00000000001.1.1.1", "4111 1111 1111 1111-4111111111111111", "4111-1111-1111-1111 4111  1111",
    "+1 (017) 555-7713 +1+2 +123456789012345678 +12((((", "é🙂 me@x.org +49 30 1234567.", "9" * 3000, "1." * 2000, "a" * 4000 + "@", "+1" + "(" * 3000, "a@" * 1000, "192.168.1.1@mail.example.com", "a.b@c-d.e-f.g_h",
]


def test_base_spans_equal_the_patterns():
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    for text in t + ODD:
        assert [f"{pii.KINDS[k]}:{b}:{e}" for k, b, e in pii.base_spans(text)] == base(text), text


def test_query(spark):
    t = dict(zip(*pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    got = queries.op4_pii(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in got) == sorted(t)
    for r in got:
        want = base(t[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in PATTERNS]
        assert set(want) <= set(filter(None, r.spans.split(",")))
        tokens = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', t[r.doc_id])]
        extra = {x for x in r.spans.split(",") if x} - set(want)
        assert {f"secret:{b}:{e}" for b, e in tokens} == extra


def test_patterns_discover_what_no_seed_shows(spark):
    rows = [(i, f"word{'abcdefgh'[i % 8]} contact me at user{i}@host.example.com today") for i in range(12)]
    rows += [(100, "please contact me at jane55-at-home today"), (101, "we saw flight ab1234 leave"), (102, None), (103, ""), (5, rows[5][1]), (None, rows[6][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = {(r.doc_id, r.base_sha256): r for r in pii.extract(df).select("doc_id", "base_sha256", pii.text_of("spans").alias("spans")).collect()}
    assert len(pii.extract(df).collect()) == len(rows)
    spans = {d: r.spans for (d, _), r in got.items()}
    assert spans[100] == "email:21:35" and spans[101] == "" and spans[102] == "" and spans[103] == ""
    masked = {r.doc_id: r for r in pii.redact(df).collect()}
    assert masked[100].text == "please contact me at [EMAIL] today" and masked[5].text == "wordf contact me at [EMAIL] today" and masked[102].text is None
    assert masked[101].text == rows[13][1] and pii.redact(df).columns == df.columns
    assert pii.redact(df).count() == len(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.extract(df).count() == 0 and pii.redact(df).count() == 0
