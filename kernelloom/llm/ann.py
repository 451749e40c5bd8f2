"""Approximate nearest neighbours with score-aware (anisotropic) product quantisation.

Unit vectors are cut into two-dimensional subspaces of 16 centres each, so a code is four bits.  The
codebooks and codes minimise ``h * |r_par|^2 + |r_orth|^2`` of the residual r: an error parallel to
the vector changes the largest inner products most, so it weighs ``h > 1`` times as much.

The codebooks are fitted on a bounded sample (``sample`` vectors, those of the smallest hash).  Every row
is coded once, with the angle between it and its code; blocks of queries meet blocks of rows, and queries
scan the codes through tables of their own.  By the triangle inequality of angles a code bounds its row's
cosine, so each block scores exactly every row that may be among its best, however badly the codebooks fit,
and only the ``k`` best of each block go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch

CENTRES = 16


def parallel_weight(dim: int, threshold: float) -> float:
    """Weight of the parallel error for inner products above ``threshold`` of unit vectors."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _plain_codebooks(x: np.ndarray, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    n, subs, width = x.shape
    books = np.empty((subs, CENTRES, width))
    for s in range(subs):
        points = x[:, s]
        centre = points[rng.choice(n, CENTRES, replace=n < CENTRES)].copy()
        for _ in range(rounds):
            near = ((points[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            for c in range(CENTRES):
                if (own := near == c).any():
                    centre[c] = points[own].mean(0)
        books[s] = centre
    return books


def encode(x: np.ndarray, books: np.ndarray, h: float, sweeps: int = 2) -> np.ndarray:
    """Codes (n, subs) of unit vectors x (n, subs, width), by coordinate descent on the weighted loss."""
    n, subs, _ = x.shape
    errors = ((x[:, :, None] - books[None]) ** 2).sum(-1)
    along = np.einsum("nsw,scw->nsc", x, books)
    codes = errors.argmin(-1)
    rows = np.arange(n)
    # the parallel residual is 1 - sum over subspaces of <x_s, centre_s>
    total = 1.0 - along[rows[:, None], np.arange(subs)[None], codes].sum(1)
    for _ in range(sweeps):
        for s in range(subs):
            others = total + along[rows, s, codes[:, s]]
            best = (errors[:, s] + (h - 1) * (others[:, None] - along[:, s]) ** 2).argmin(1)
            total = others - along[rows, s, best]
            codes[:, s] = best
    return codes.astype(np.uint8)


def fit_codebooks(x: np.ndarray, threshold: float, rounds: int = 4, seed: int = 11) -> tuple[np.ndarray, float]:
    """Codebooks (subs, 16, width) of unit vectors x (n, dim): plain k-means, then rounds of weighted
    coding and weighted least squares for the centres of one subspace after another."""
    n, dim = x.shape
    width = 2 if dim % 2 == 0 else 1
    parts = x.reshape(n, dim // width, width)
    books = _plain_codebooks(parts, np.random.default_rng(seed))
    h = parallel_weight(dim, threshold)
    for _ in range(rounds):
        codes = encode(parts, books, h)
        chosen = np.take_along_axis(np.broadcast_to(books[None], (n, *books.shape)), codes[:, :, None, None].astype(np.int64), 2)[:, :, 0]
        along = (parts * chosen).sum(-1)
        total = 1.0 - along.sum(1)
        for s in range(parts.shape[1]):
            others = total + along[:, s]
            v = parts[:, s]
            for c in range(CENTRES):
                own = codes[:, s] == c
                if not own.any():
                    continue
                a = np.eye(width) * own.sum() + (h - 1) * v[own].T @ v[own]
                books[s, c] = np.linalg.solve(a, v[own].sum(0) + (h - 1) * (others[own, None] * v[own]).sum(0))
            along[:, s] = (v * books[s, codes[:, s]]).sum(-1)
            total = others - along[:, s]
    return books, h


def _usable(vec: Column, dim: int) -> Column:
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (F.size(vec) == dim) & ~F.exists(vec, bad) & F.exists(vec, lambda v: v != 0)


def code_bytes(unit: np.ndarray, books: np.ndarray, h: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit vectors (n, dim), two of four bits to a byte, and (n, 2): how much of what a code stands for
    lies along its vector, and how much across."""
    subs, _, width = books.shape
    parts = unit.reshape(len(unit), subs, width)
    codes = np.concatenate([encode(parts[i : i + 2048], books, h) for i in range(0, len(parts), 2048)])
    coded = books[np.arange(subs)[None], codes].reshape(len(unit), -1)
    along = (coded * unit).sum(1)
    across = np.sqrt(((coded - along[:, None] * unit) ** 2).sum(1))
    codes = np.pad(codes, ((0, 0), (0, subs % 2)))
    return codes[:, 0::2] * CENTRES + codes[:, 1::2], np.stack([along, across], 1)


#: More than rounding can add to an inner product read from the tables.
SLACK = 1e-5


class Bounds:
    """Upper bounds of the cosines of rows, from their codes' inner products with a unit query: with A the angle
    between query and code and D that between row and code, the row is no nearer than A - D."""

    def __init__(self, along: np.ndarray, across: np.ndarray):
        square = along.astype(np.float64) ** 2 + across.astype(np.float64) ** 2
        safe = np.maximum(square, 1e-12)
        self.square, self.inside = square.astype(np.float32), (along - SLACK).astype(np.float32)
        self.by_cos, self.by_sin = (along / safe).astype(np.float32), (across / safe).astype(np.float32)

    def __call__(self, near: np.ndarray) -> np.ndarray:
        most = near * self.by_cos + self.by_sin * np.sqrt(np.maximum(self.square - near * near, 0) + np.float32(SLACK)) + np.float32(SLACK)
        most[near >= self.inside] = 2.0
        return most


def query_tables(unit: np.ndarray, books: np.ndarray) -> np.ndarray:
    """(queries, bytes, 256): each byte's share of the inner product with each query."""
    subs, _, width = books.shape
    each = np.einsum("qsw,scw->qsc", unit.reshape(len(unit), subs, width), books).astype(np.float32)
    each = np.pad(each, ((0, 0), (0, subs % 2), (0, 0)))
    return (each[:, 0::2, :, None] + each[:, 1::2, None, :]).reshape(len(unit), -1, CENTRES * CENTRES)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows by powers of two, which no cosine shows, so that no square leaves the range of doubles."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def _matrix(column: pd.Series) -> np.ndarray:
    return _scaled(np.array([np.asarray(v, float) for v in column], float))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k ids of the highest scores, highest first, ties to smaller ids; an id counts by its best."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    threshold: float = 0.2,
    sample: int = 8192,
    rerank: int = 128,
    query_block: int = 1 << 15,
    code_block: int = 1 << 16,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest by cosine, ties to smaller ids.

    ``is_query`` picks the query rows; candidates are all rows with another id.  Rows with a null id,
    a null, empty or zero vector, a null or non-finite component, or a length other than the most
    frequent one (the smaller on a tie) take no part.  Of equal vectors only the ``k + 1`` smallest
    ids can appear in any answer, so only these are scanned.  Repeated rows count once.  Fewer candidates
    give fewer rows; a table without usable rows gives none.  Columns but the two named and those that
    ``is_query`` reads are ignored, whatever their names.

    In each block the ``rerank`` best by the tables are scored exactly first; then whatever row's bound reaches
    the k-th of these, so that no nearer row is missed.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    lengths = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = rows.where(_usable(F.col("v"), dim))
    picked = rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h").limit(sample).select("v").toPandas()
    if not len(picked):
        return spark.createDataFrame([], schema)
    x = _matrix(picked["v"])
    books, h = fit_codebooks(x / np.linalg.norm(x, axis=1)[:, None], threshold)

    # equal vectors meet after a local cut to k + 1 a partition, so a hot vector isn't gathered
    ranked = lambda df, *keys: df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    cands = rows.select("id", "v", F.xxhash64("v").alias("h")).distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    cands = ranked(ranked(cands, "h", "v", "salt").drop("salt"), "h", "v").select("id", "v")
    queries = scratch.write(rows.where("q").select("id", "v").distinct(), "queries")
    # vectors travel in as many bytes as the table gives them
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"

    def code(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                v = _matrix(part["v"])
                made, share = code_bytes(v / np.sqrt((v * v).sum(1))[:, None], books, h)
                raw = [np.asarray(own, kind).tobytes() for own in part["v"]]
                yield pd.DataFrame({"id": part["id"], "code": [c.tobytes() for c in made], "along": share[:, 0], "across": share[:, 1], "raw": raw})

    codes = scratch.write(cands.mapInPandas(code, "id long, code binary, along double, across double, raw binary"), "codes")
    n = codes.count()
    nq, nc = max(1, -(-queries.count() // query_block)), max(1, -(-n // code_block))
    # enough blocks of rows to keep the cores of a small cluster busy
    nc = max(nc, min(spark.sparkContext.defaultParallelism, -(-n // 4096)))
    cell = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", cell(nq).alias("x"), every(nc).alias("y"))
    right = codes.select("id", "code", "along", "across", "raw", cell(nc).alias("y"), every(nq).alias("x"))

    def scan(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(qs) and len(cs):
            cid = cs["id"].to_numpy()
            table = np.frombuffer(b"".join(cs["code"]), np.uint8).reshape(len(cs), -1).T.copy()
            full = _scaled(np.frombuffer(b"".join(cs["raw"]), kind).reshape(len(cs), -1).astype(float))
            length = np.sqrt((full * full).sum(1))
            along = cs["along"].to_numpy()
            bounds, turn = Bounds(along, cs["across"].to_numpy()), (1 / np.maximum(along, 1e-3)).astype(np.float32)
            # so many rows hold k ids at least
            need = k * int(np.unique(cid, return_counts=True)[1].max())

            def exact(v: np.ndarray, rows: np.ndarray) -> np.ndarray:
                some = full @ v if 2 * len(rows) > len(full) else None
                return (full[rows] @ v if some is None else some[rows]) / length[rows]

            for i in range(0, len(qs), 64):
                v = _matrix(qs["v"].iloc[i : i + 64])
                unit = v / np.sqrt((v * v).sum(1))[:, None]
                for own, u, q, qid in zip(query_tables(unit, books), unit, v, qs["id"].iloc[i : i + 64]):
                    near = own[0][table[0]]
                    for s in range(1, len(table)):
                        near += own[s][table[s]]
                    most, least, others = bounds(near), -np.inf, cid != qid
                    first = np.argpartition(-near * turn, rerank)[:rerank] if len(cid) > rerank else np.arange(len(cid))
                    first = first[others[first]]
                    if len(first) >= need:
                        least = np.partition(exact(u, first), -need)[-need] - SLACK
                    rows = np.flatnonzero((most >= least) & others)
                    near = exact(u, rows)
                    if len(rows) > need:
                        rows = rows[near >= np.partition(near, -need)[-need] - 1e-12]
                    score = cosines(np.broadcast_to(q, (len(rows), len(q))), full[rows])
                    best = best_rows(cid[rows], score, k)
                    found["query_id"].append(np.full(len(best), qid))
                    found["vec_id"].append(cid[rows[best]])
                    found["score"].append(score[best])
        return pd.DataFrame({n: np.concatenate(p) if p else np.zeros(0, np.float64 if n == "score" else np.int64) for n, p in found.items()})

    met = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(scan, "query_id long, vec_id long, score double")
    # an id with several vectors, as a query or as a candidate, counts by its best
    scored = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
