from collections import Counter

import pytest

from tessera.llm import queries, sharding


def brute(shards, size):
    """From the definition: write out each permutation, then take turns."""
    perms = []
    for s in shards:
        offset, skip = sharding._hash(s, "offset") % size, sharding._hash(s, "skip") % (size - 1) + 1
        perms.append([(offset + j * skip) % size for j in range(size)])
    table, i = {}, 0
    while len(table) < size:
        slot = next(x for x in perms[i % len(shards)] if x not in table)
        table[slot] = i % len(shards)
        i += 1
    return [table[x] for x in range(size)]


@pytest.mark.parametrize(("n", "size"), [(1, 7), (3, 101), (7, 499)])
def test_table_is_the_definition(n, size):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.fill(shards, size)
    assert table == brute(shards, size)
    held = Counter(table).values()
    assert max(held) - min(held) <= 1


def test_few_slots_move_and_weights_hold():
    a = [f"s{i}" for i in range(20)]
    x, y = sharding.fill(a), sharding.fill(a[:-1])
    moved = sum(p != q for p, q in zip(x, y, strict=True) if p != 19)
    assert moved < 0.05 * len(x)
    heavy = Counter(sharding.fill(["a", "b"], weights={"a": 3}))
    assert abs(heavy[0] / heavy[1] - 3) < 0.01
    with pytest.raises(ValueError):
        sharding.fill(["a"], 100)


def test_query_is_even_and_whole(spark):
    got = queries.op3_sharding(spark, "/root/testdata/sf0.1").collect()
    ids = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in got) == sorted(ids)
    table = sharding.fill(queries.SHARDS)
    assert all(r.shard == queries.SHARDS[table[r.slot]] and not r.hot for r in got)
    held = Counter(r.shard for r in got)
    mean = len(ids) / len(queries.SHARDS)
    assert len(held) == len(queries.SHARDS) and max(held.values()) < 1.5 * mean


def test_hot_key_is_parted_and_edges(spark, tmp_path):
    rows = [("hot", i, 1) for i in range(400)] + [(f"k{i}", i, 1) for i in range(600)] + [(None, 5, 2), (None, 5, 2)]
    df = spark.createDataFrame(rows, "key string, n int, slot int")
    shards = ["a", "b", "c", "d"]
    got = sharding.place(df, "key", shards, ["n"]).collect()
    assert len(got) == len(rows)
    assert {r.shard for r in got if r.key == "hot"} == set(shards) and all(r.hot == (r.key == "hot") for r in got)
    assert len({r.shard for r in got if r.key is None}) == 1
    assert max(Counter(r.shard for r in got).values()) < 330
    assert sharding.place(df.where("false"), "key", shards).count() == 0
    sharding.write(sharding.place(df, "key", shards, ["n"]), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_weights_under_one_are_refused():
    import pytest

    with pytest.raises(ValueError, match="weights"):
        sharding.fill(["a", "b"], 11, {"a": 0, "b": 0})
