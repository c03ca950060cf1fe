"""Token sequences and their block hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tools

#: Seed of the block hashes.
SEED = 1337


def hashed(rows: DataFrame, tokens: str, size: int, seed: int = SEED, extra: str | None = None) -> DataFrame:
    """rows with blocks (XXH3 of each complete block of token ids) and sequence (each hash chained with the one before) (H1-H4).

    Ids are unsigned 32-bit, little-endian.  The first sequence hash is the first block's; each later one hashes the one before
    and the block's own.  extra: a column of arrays of hashes of each block (multimodal objects), sorted and hashed with its ids.
    Hashes are unsigned numbers given as signed longs of the same bits.  Spark has no XXH3, so Arrow batches go through Python.
    """
    import pyarrow as pa

    def step(batches):
        import numpy as np
        import xxhash

        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in batches:
            blocks, chains = [], []
            more = batch.column(extra).to_pylist() if extra else [None] * batch.num_rows
            for ids, others in zip(batch.column(tokens).to_pylist(), more, strict=True):
                own, chain = [], []
                raw = np.array(ids or [], np.int64).astype("<u4").tobytes()
                for i in range(len(ids or []) // size):
                    data = raw[4 * size * i : 4 * size * (i + 1)]
                    if others and i < len(others) and others[i]:
                        data += b"".join(h.to_bytes(8, "little") for h in sorted(x & (1 << 64) - 1 for x in others[i]))
                    h = xxhash.xxh3_64_intdigest(data, seed)
                    own.append(h)
                    chain.append(h if not i else xxhash.xxh3_64_intdigest(chain[-1].to_bytes(8, "little") + h.to_bytes(8, "little"), seed))
                blocks.append(list(map(signed, own)))
                chains.append(list(map(signed, chain)))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, kind), pa.array(chains, kind)], [*batch.schema.names, "blocks", "sequence"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(step, f"{shape}, blocks array<long>, sequence array<long>")


def mode(position: Column) -> Column:
    """0 to 3 by how many bits a position takes: 8, 16, 24 or 31; null beyond (H7)."""
    return F.when(position < 1 << 8, 0).when(position < 1 << 16, 1).when(position < 1 << 24, 2).when(position < 1 << 31, 3)


def positional(sequence: Column, position: Column, block: Column) -> Column:
    """A positional hash: its upper 64 bits are mode, position and what fits of the block's hash, its lower the sequence hash (H5)."""
    m, p, b = mode(position), position.cast("long"), block.cast("long")
    pack = lambda i, low: F.shiftleft(F.lit(i).cast("long"), 62).bitwiseOR(F.shiftleft(p, low)).bitwiseOR(b.bitwiseAND((1 << low) - 1))
    upper = F.when(m == 0, pack(0, 54)).when(m == 1, pack(1, 46)).when(m == 2, pack(2, 38)).when(m == 3, pack(3, 31))
    return F.struct(upper.alias("upper"), sequence.cast("long").alias("lower"))


def position_of(hash_: Column) -> Column:
    """The position in a positional hash (H5)."""
    upper = hash_["upper"]
    m = F.shiftrightunsigned(upper, 62)
    rest = upper.bitwiseAND((1 << 62) - 1)
    return F.when(m == 0, F.shiftright(rest, 54)).when(m == 1, F.shiftright(rest, 46)).when(m == 2, F.shiftright(rest, 38)).otherwise(F.shiftright(rest, 31))


def extend(tokens: Column, more: Column, size: int) -> Column:
    """The longer sequence, and the blocks that it completes: first and last + 1 (H8, H9)."""
    both = F.concat(tokens, more)
    return F.struct(both.alias("tokens"), F.floor(F.size(tokens) / size).alias("first"), F.floor(F.size(both) / size).alias("stop"))


def truncate(tokens: Column, length: Column) -> Column:
    """The first so many tokens."""
    return F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.least(length, F.size(tokens))))


def unwind(tokens: Column, n: Column) -> Column:
    """Without the last n; null if there are fewer (H11, H12 with n = 1)."""
    return F.when(n <= F.size(tokens), truncate(tokens, F.size(tokens) - n))


def part(tokens: Column, start: Column, stop: Column) -> Column:
    """Tokens from start to stop, as far as there are."""
    return F.when(start < F.least(stop, F.size(tokens)), F.slice(tokens, start + 1, F.least(stop, F.size(tokens)) - start)).otherwise(F.slice(tokens, 1, 0))


def split(tokens: Column, size: int) -> Column:
    """Complete blocks and the remainder."""
    return F.struct(tools.blocks(tokens, size).alias("blocks"), tools.remainder(tokens, size).alias("rest"))


def from_ids(ids: Column, size: int) -> Column:
    """A trace's block ids as tokens, each repeated for a block."""
    return F.flatten(F.transform(ids, lambda i: F.array_repeat(i, size)))


def random_ids(key: Column, length: Column, size: int, seed: int) -> Column:
    """As many reproducible ids as a prompt has blocks, a started one included."""
    n = F.ceil(length / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.lit(seed), key, i))).otherwise(F.array().cast("array<long>"))
