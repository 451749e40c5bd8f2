"""Pairwise operators in tiles: both sides are dealt into blocks, and each pair of blocks is a dense matrix of
bounded size.  All pairs' values are wanted of blocks that are packed to a row each and kept, so the shuffle
grows with rows only, and what is quadratic is the result (``pair_values``).

Elsewhere a side is copied once for each block of the other side, so the shuffle grows with rows times
blocks (``tiles``).  Where only sums over one side are wanted (``block_sums``), that side's blocks are as large as memory
allows, a task adds up its own part, and one row of bytes a pair of blocks travels on.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelloom.staging import bounded_batches, cut

BLOCK = 1024
#: Bytes of series in a block that is summed over, about.
DEEP_BYTES = 16 << 20
Matrix = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


class UnequalLengths(ValueError):
    """Series that a kernel of flat series can't compare."""


def stack(column: pd.Series) -> np.ndarray:
    """Rows of equal length as a matrix; rows of channels, one point after another."""
    rows = [_flat(v) for v in column]
    if len({len(r) for r in rows}) > 1:
        raise UnequalLengths(f"series of {min(map(len, rows))} to {max(map(len, rows))} values")
    return np.array(rows, float)


def _flat(v) -> np.ndarray:
    v = np.asarray(v)
    return np.concatenate([np.asarray(p, float) for p in v]) if v.dtype == object and len(v) else v.astype(float).ravel()


def fresh(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that a frame can meet itself."""
    return df.select([F.col(c).alias(c) for c in df.columns])


def tiles(left: DataFrame, right: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, key: str = "k", block: int = BLOCK, rows: tuple[int, int] | None = None, deep: int | None = None) -> DataFrame:
    """``fn`` on every pair of blocks.

    ``rows`` are the two sides' numbers of rows where the caller knows them, else they are counted; ``deep``
    is the right side's block, where that differs."""
    nl, nr = (max(1, -(-n // b)) for n, b in zip(rows or (left.count(), right.count()), (block, deep or block)))
    n = lambda m: F.pmod(F.xxhash64(key), F.lit(m)).cast("int")
    upto = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    a = left.withColumn("_x", n(nl)).withColumn("_y", F.explode(upto(nr)))
    b = fresh(right).withColumn("_y", n(nr)).withColumn("_x", F.explode(upto(nl)))

    def one(where: tuple, u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return fn(u, v) if len(u) and len(v) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return a.groupBy("_x", "_y").cogroup(b.groupBy("_x", "_y")).applyInPandas(one, schema)


#: Most rows and bytes of a packed block, and most partitions of a packed side.
PACKED_ROWS, PACKED_BYTES, PACKED_PARTS = 4096, 4 << 20, 64


def packed(df: DataFrame, key: str, block: int, at: str, body: str) -> DataFrame:
    """(at, body): a row for each block of rows, as bytes, made once and kept.  Small frames make a block for
    each core where there are rows for it."""
    n, spark = df.count(), df.sparkSession
    blocks = max(1, -(-n * 4 // (3 * PACKED_ROWS)), min(spark.sparkContext.defaultParallelism, -(-n // block)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def sealed() -> pa.RecordBatch:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, held[0].schema) as sink:
                for own in held:
                    sink.write_batch(own)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], [body])

        for batch in batches:
            step = max(1, min(PACKED_ROWS, batch.num_rows * PACKED_BYTES // max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                if held and (sum(h.num_rows for h in held) + piece.num_rows > PACKED_ROWS or sum(h.nbytes for h in held) + piece.nbytes > PACKED_BYTES):
                    yield sealed()
                held.append(piece)
        if held:
            yield sealed()

    parts = min(blocks, PACKED_PARTS)
    made = cut(df.repartition(parts, key).mapInArrow(pack, f"{body} binary").coalesce(parts))
    return made.withColumn(at, F.monotonically_increasing_id())


def pair_values(left: DataFrame, right: DataFrame | None, matrix: Matrix, value: str = "value", key: str = "k", block: int = BLOCK) -> DataFrame:
    """(i, j, value) of all pairs; without ``right``, of ``left`` with itself.  Each unordered pair is then
    computed in one tile only and mirrored.

    Packed blocks meet by a cross join that reads them where they are kept and shuffles nothing."""
    bounded_batches(left.sparkSession)
    kind, half = dict(left.dtypes)[key], right is None
    a = packed(left, key, block, "_x", "_u")
    b = a.select(F.col("_x").alias("_y"), F.col("_u").alias("_v")) if half else packed(right, key, block, "_y", "_v")
    met = a.hint("shuffle_replicate_nl").crossJoin(b)

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for x, y, left_bytes, right_bytes in part[["_x", "_y", "_u", "_v"]].itertuples(index=False):
                us, vs = ([t.iloc[i : i + block].reset_index(drop=True) for i in range(0, len(t), block)] for t in (pa.ipc.open_stream(raw).read_pandas() for raw in (left_bytes, right_bytes)))
                for p, u in enumerate(us):
                    for q, v in enumerate(vs):
                        if half and x == y and p > q:
                            continue
                        m = matrix(u, v)
                        i, j = np.repeat(u[key].to_numpy(), len(v)), np.tile(v[key].to_numpy(), len(u))
                        yield pd.DataFrame({"i": i, "j": j, value: m.ravel()})
                        if half and (x, p) != (y, q):
                            yield pd.DataFrame({"i": j, "j": i, value: m.ravel()})

    return (met.where("_x <= _y") if half else met).mapInPandas(values, f"i {kind}, j {kind}, {value} double")


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def masked_squared_distances(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of p_a p_b (a - b)^2, number of shared observed positions)."""
    d2 = (pa * a * a) @ pb.T + pa @ (pb * b * b).T - 2 * (pa * a) @ (pb * b).T
    return np.maximum(d2, 0.0), pa @ pb.T


def dtw(series: np.ndarray, others: list[np.ndarray], window: int | None = None) -> np.ndarray:
    """Dynamic-time-warping distances of one series (length, channels) to many; infinite where a band of
    ``window`` leaves no path.  Cells (i, j) of one sum i + j are independent: the sweep goes from one such
    diagonal to the next, for all others at once, and holds three of them, no longer than the band."""
    n, lengths = len(series), np.array([len(o) for o in others])
    top = int(lengths.max())
    band = n + top if window is None else window
    padded = np.zeros((len(others), top, series.shape[1]))
    for r, o in enumerate(others):
        padded[r, : len(o)] = o
    out = np.full(len(others), np.inf)
    # a diagonal: its first i and its cells; the path starts in front of both series
    start = (-1, np.zeros((len(others), 1)))
    before, last = start, (0, np.zeros((len(others), 0)))

    def cells(diagonal: tuple[int, np.ndarray], a: int, b: int) -> np.ndarray:
        """The cells of i from a to b, infinite outside the diagonal."""
        first, have = diagonal
        got = np.full((len(others), b - a + 1), np.inf)
        lo, hi = max(a, first), min(b, first + have.shape[1] - 1)
        if lo <= hi:
            got[:, lo - a : hi - a + 1] = have[:, lo - first : hi - first + 1]
        return got

    for d in range(n + top - 1):
        a, b = max(0, d - top + 1, -((band - d) // 2)), min(n - 1, d, (d + band) // 2)
        if a > b:
            before, last = last, (0, np.zeros((len(others), 0)))
            continue
        i = np.arange(a, b + 1)
        cost = ((padded[:, d - i] - series[i]) ** 2).sum(-1)
        now = (a, cost + np.minimum(np.minimum(cells(last, a - 1, b - 1), cells(last, a, b)), cells(before, a - 1, b - 1)))
        ends = np.flatnonzero(lengths - 1 == d - (n - 1))
        if len(ends) and b == n - 1:
            out[ends] = now[1][ends, -1]
        before, last = last, now
    return np.sqrt(out)


def dtw_matrix(window: int | None = None, col: str = "x") -> Matrix:
    def matrix(u: pd.DataFrame, v: pd.DataFrame) -> np.ndarray:
        shaped = lambda s: [np.stack([np.atleast_1d(np.asarray(p, float)) for p in x]) for x in s]
        right = shaped(v[col])
        return np.stack([dtw(x, right, window) for x in shaped(u[col])])

    return matrix


def patches(x: np.ndarray, width: int, stride: int = 1) -> np.ndarray:
    n = (len(x) - width) // stride + 1
    if n <= 0:
        raise ValueError(f"a series of {len(x)} has no patch of {width}")
    return np.lib.stride_tricks.sliding_window_view(x, width)[::stride]


def by_place(rows: list[np.ndarray], at: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a patch at a place, these patches)."""
    own = np.array([r for r, p in enumerate(rows) if len(p) > at], np.int64)
    return own, np.stack([rows[r][at] for r in own]) if len(own) else np.zeros((0, 0))


def aligned_patches(u: list[np.ndarray], v: list[np.ndarray], m: np.ndarray | None, sigma: float) -> np.ndarray:
    """Between all rows, the sum over aligned patches, as many as both have, of an RBF of their difference
    projected by m: one product of matrices a place."""
    out = np.zeros((len(u), len(v)))
    for at in range(min(max(map(len, u), default=0), max(map(len, v), default=0))):
        (i, p), (j, q) = by_place(u, at), by_place(v, at)
        p, q = (p, q) if m is None else (p @ m.T, q @ m.T)
        out[np.ix_(i, j)] += np.exp(-squared_distances(p, q) / (2 * sigma * sigma))
    return out


# -- sums over one side ----------------------------------------------------------------------------

Part = Callable[[pd.DataFrame, pd.DataFrame], "np.ndarray | list[np.ndarray]"]


def deep_block(right: DataFrame, block: int) -> int:
    """How many rows of a side that is summed over make a block, by the size of its first row."""
    first = right.limit(1).toPandas()
    size = sum(np.size(_flat(v)) if isinstance(v, (list, np.ndarray)) else 1 for row in first.itertuples(index=False) for v in row)
    return max(block, min(1 << 16, DEEP_BYTES // (8 * max(1, size))))


def _summed(fn: Part, key: str, block: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One tile's part as one row: the left block, its keys in order, the rows' lengths and all values."""

    def one(u: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        u, total, lengths = u.sort_values(key, ignore_index=True), 0.0, None
        for i in range(0, len(v), block):
            rows = fn(u, v.iloc[i : i + block])
            lengths = [len(r) for r in rows]
            total = total + np.concatenate([np.asarray(r, float) for r in rows])
        return pd.DataFrame({"_x": [u["_x"].iloc[0]], "_keys": [u[key].tolist()], "_n": [lengths], "_m": [total.astype("<f8").tobytes()]})

    return one


def _added(tiled: DataFrame, key: str, kind: str, out: str, blocks: int) -> DataFrame:
    """Tiles of one left block added up as a stream, then a row a key again."""

    def rows(keys: list, lengths: list, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({key: keys, out: np.split(total, np.cumsum(lengths)[:-1])})

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for part in parts:
            for x, keys, lengths, m in part.itertuples(index=False):
                values = np.frombuffer(m, "<f8")
                if now is not None and now[0] == x:
                    now[3] += values
                else:
                    if now is not None:
                        yield rows(*now[1:])
                    now = [x, keys, lengths, values.copy()]
        if now is not None:
            yield rows(*now[1:])

    dealt = tiled if blocks == 1 else tiled.repartition("_x").sortWithinPartitions("_x")
    return dealt.mapInPandas(add, f"{key} {kind}, {out} array<double>")


_TILE = "_x int, _keys array<{kind}>, _n array<int>, _m binary"


def block_sums(left: DataFrame, right: DataFrame, fn: Part, out: str, key: str = "k", block: int = BLOCK, rows: tuple[int, int] | None = None, deep: int | None = None) -> DataFrame:
    """(key, out): for each row of ``left`` the sum over all rows of ``right`` of fn's rows, arrays of any length.

    Shuffled rows grow with pairs of blocks, whatever the arrays' lengths; keys of the left are distinct."""
    bounded_batches(left.sparkSession)
    rows = rows or (left.count(), right.count())
    deep, kind = deep or deep_block(right, block), dict(left.dtypes)[key]
    tiled = tiles(left, right, _summed(fn, key, block), _TILE.format(kind=kind), key, block, rows=rows, deep=deep)
    return _added(tiled, key, kind, out, -(-rows[1] // deep))


def lone_numbers(spark: SparkSession, n: int) -> list[int]:
    """n numbers that a repartition into n by an int column deals one to each partition."""
    found: dict[int, int] = {}
    first = 0
    while len(found) < n:
        number = F.col("id").cast("int")
        for row in spark.range(first, first + 16 * n).select(number.alias("b"), F.pmod(F.hash(number), F.lit(n)).alias("at")).collect():
            found.setdefault(row.at, row.b)
        first += 16 * n
    return sorted(found.values())


def _ipc(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as sink:
        sink.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class Dealt:
    """A frame dealt with itself into pairs of blocks.  Blocks are packed to a row each, one a partition, and kept:
    afterwards they meet where they are, by a cross join, and only vectors and a task's own sums travel.

    There are as many blocks as give each core some pairs, more where a block would take over ``DEEP_BYTES``.
    With ``mirrored`` each unordered pair meets once, and serves both of its blocks."""

    def __init__(self, rows: DataFrame, n: int, key: str = "k", block: int = BLOCK, deep: int | None = None, mirrored: bool = False):
        spark = rows.sparkSession
        bounded_batches(spark)
        self.key, self.kind, self.mirrored = key, dict(rows.dtypes)[key], mirrored
        deep, cores = deep or deep_block(rows, block), spark.sparkContext.defaultParallelism
        self.blocks = max(1, -(-n // deep), min(-(-n // block), round(math.sqrt(6 * cores))))
        self.numbers = lone_numbers(spark, self.blocks)
        self.rows = self._packed(rows, "_rows").repartition(self.blocks, "_b").persist(StorageLevel.MEMORY_AND_DISK)
        self.rows.count()  # the planner then knows their size, which a cross join squares

    def _packed(self, rows: DataFrame, body: str) -> DataFrame:
        """(_b, body): a row a block, its rows in order of the key."""
        key, schema = self.key, pa.schema([("_b", pa.int32()), (body, pa.binary())])

        def pack(table: pa.Table) -> pa.Table:
            own = table.sort_by(key)
            return pa.Table.from_arrays([pa.array([own["_b"][0].as_py()], pa.int32()), pa.array([_ipc(own.drop_columns(["_b"]).combine_chunks())], pa.binary())], schema=schema)

        at = F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")
        placed = rows.withColumn("_b", F.get(F.array(*[F.lit(b) for b in self.numbers]), at))
        return placed.repartition(self.blocks, "_b").groupBy("_b").applyInArrow(pack, f"_b int, {body} binary")

    def sums(self, vectors: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], "np.ndarray | tuple[np.ndarray, np.ndarray]"], out: str) -> DataFrame:
        """(key, out): for each row the sum of fn's rows over all blocks; both sides have the columns of
        ``vectors`` (key, ...), which hold every key.

        fn gets two whole blocks and makes a row for each of the first, of any one number of values; with
        ``mirrored`` a row for each of the second too, which a block that meets itself leaves out."""
        full = self.rows.join(self._packed(vectors, "_own").hint("shuffle_hash"), "_b")
        named = lambda n: full.select(F.col("_b").alias(f"_b{n}"), F.col("_rows").alias(f"_rows{n}"), F.col("_own").alias(f"_own{n}"))
        met, key, mirrored = named(0).hint("shuffle_replicate_nl").crossJoin(named(1)), self.key, self.mirrored
        if mirrored:
            met = met.where("_b0 <= _b1")

        def part(b: int, keys: pd.Series | None, m: np.ndarray) -> pd.DataFrame:
            m = np.ascontiguousarray(m)
            ids = None if keys is None else _ipc(pa.table({key: pa.array(keys)}))
            return pd.DataFrame({"_b": [b], "_keys": [ids], "_width": [m.shape[1]], "_type": [m.dtype.str], "_m": [m.tobytes()]})

        def tile(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pairs in parts:
                for x, rows_u, own_u, y, rows_v, own_v in pairs[["_b0", "_rows0", "_own0", "_b1", "_rows1", "_own1"]].itertuples(index=False):
                    u = _unpacked(rows_u).merge(_unpacked(own_u), on=key)
                    v = u if x == y else _unpacked(rows_v).merge(_unpacked(own_v), on=key)
                    made = fn(u, v)
                    yield part(x, u[key] if x == y else None, made[0] if mirrored else made)
                    if mirrored and x != y:
                        yield part(y, None, made[1])

        def rows(keys: bytes, width: int, total: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({key: _unpacked(keys)[key], out: list(total.reshape(-1, width))})

        def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, ids, total = None, None, None
            for part in parts:
                for b, keys, width, kind, m in part.itertuples(index=False):
                    if now is not None and now[0] != b:
                        yield rows(ids, now[1], total)
                        now, ids = None, None
                    values = np.frombuffer(m, kind)
                    total = values.astype(float) if now is None else total + values
                    now, ids = (b, width), keys or ids
            if now is not None:
                yield rows(ids, now[1], total)

        tiled = met.mapInPandas(tile, "_b int, _keys binary, _width int, _type string, _m binary")
        return tiled.repartition(self.blocks, "_b").sortWithinPartitions("_b").mapInPandas(add, f"{key} {self.kind}, {out} array<double>")

    def drop(self) -> None:
        self.rows.unpersist()


def partial_sums(partials: DataFrame) -> list[tuple[int, np.ndarray]]:
    """(g, sum) of rows (g, m: doubles as bytes), one row a task and g: added up in a few streams for each g, the
    root of the number of tasks, then in one, a row at a time.  The driver gets the sums in one job, nothing else."""
    spark = partials.sparkSession
    bounded_batches(spark)
    ways = math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, total = None, None
        for part in parts:
            for own, m in part[["g", "m"]].itertuples(index=False):
                values = np.frombuffer(m, "<f8")
                if own == g:
                    total += values
                else:
                    if g is not None:
                        yield pd.DataFrame({"g": [g], "m": [total.tobytes()]})
                    g, total = own, values.copy()
        if g is not None:
            yield pd.DataFrame({"g": [g], "m": [total.tobytes()]})

    way = F.pmod(F.spark_partition_id(), F.lit(ways))
    some = partials.withColumn("_w", way).repartition(ways, "g", "_w").sortWithinPartitions("g").mapInPandas(add, "g long, m binary")
    whole = some.repartition(1).sortWithinPartitions("g").mapInPandas(add, "g long, m binary")
    return [(row.g, np.frombuffer(row.m, "<f8")) for row in whole.toLocalIterator()]
