"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1.  Texts with equal shingle sets form one class; only the class's smallest doc_id goes on, so a
    group of exact copies of any size costs one node.
2.  Each class's signature (``rows * bands`` minimum hashes) is cut into bands; classes that share
    a band's value are candidates.
3.  A candidate pair's signatures are compared batch by batch.  With a uniform prior, the
    similarity's posterior after m of n equal hashes is Beta(m + 1, n - m + 1); a pair goes as
    soon as the chance that it reaches the threshold falls below ``miss``.
4.  Survivors are verified on their full shingle sets.

Pairs of a large bucket aren't all listed.  First every class is compared with its buckets' smallest
member; links found there already join most true groups.  Only pairs that these links leave in
different components are then compared, in blocks of bounded rows and bytes, with further batches of
one-byte hashes and, where these leave a pair standing, on the full sets.  A block returns a spanning
forest of its links, so no pair is ever a row unless it links.  No link between components is
missed (but for ``miss`` and the bands' own miss, ``(1 - t**rows)**bands``: 3e-7 at t = 0.75).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, small_batches
from kernelloom.llm.words import mix, shingle_sets

#: Rows of a large bucket that one task compares with as many others.
BLOCK = 1024
#: Further one-byte hashes for pairs within a bucket, and how many make a batch.
LONG, LONG_BATCH = 1024, 256
#: Bytes of shingle sets that a large bucket's block holds of each side, about.
BLOCK_BYTES = 16 << 20


def hash_family(n: int, seed: int = 20240501) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        part = a[:, None] * shingles[None, k : k + 1024]
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(batch: int, total: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes, a pair with fewer than m equal ones is dropped.

    P(s >= t | m of n) under the uniform prior is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) of the nodes in ``edges`` (a, b) but the components' smallest: large-star and
    small-star steps, each a grouped minimum and a join, until every node has one edge, to a root."""
    edges = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{tag}-0")
    step = 0
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select("b", "low").where("b <> low").toDF("a", "b").unionByName(low.toDF("a", "b")).distinct()
        edges = scratch.write(small, f"{tag}-{step + 1}")
        scratch.drop(f"{tag}-{step}")
        step += 1
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node with an edge to a smaller one has one only, to a node that has none."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count() == 0


def labelled(rows: DataFrame, labels: DataFrame, col: str, name: str) -> DataFrame:
    """``rows`` with each node's component; a node without a label is its own."""
    named = labels.select(F.col("node").alias(col), F.col("component").alias(name))
    return rows.join(named, col, "left").withColumn(name, F.coalesce(name, col))


def merged(labels: DataFrame, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``labels`` after further edges: only the components that these join are walked again."""
    between = labelled(labelled(edges.select("a", "b"), labels, "a", "la"), labels, "b", "lb")
    roots = components(between.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch, tag)
    moved = labelled(labels, roots.toDF("component", "root").select(F.col("component").alias("node"), F.col("root").alias("component")), "component", "root")
    return scratch.write(moved.select("node", F.col("root").alias("component")).unionByName(roots), f"{tag}-labels")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    rows: int = 4,
    bands: int = 40,
    batch: int = 32,
    miss: float = 1e-7,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key, group for every row of ``docs``.

    ``text_key`` is a hash of the text, which tells rows of one id apart; ``group`` numbers the component,
    null without shingles or id.  Two components have one component_id if two texts of that id head them.

    Null text, empty text and text of blanks only have an empty set: they are linked with nothing.
    Repeated rows get equal answers; rows that share a doc_id but not a text are linked by their own
    texts.  A null doc_id takes no part: component_id null, kept true.  Whole texts count, however long.  An
    empty table gives an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "neardup")
    total, share = rows * bands, percent / 100
    a, b = hash_family(total)
    steps = least_matches(batch, total, share, miss)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))

    def sign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = shingle_sets(part["text"].tolist(), width)
            yield pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64"),
                "text_key": part["text_key"],
                "n_shingles": np.array([len(s) for s in sets], np.int64),
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                "sig": [signature(s, a, b).tobytes() if len(s) else None for s in sets],
            })

    base = scratch.write(source.mapInPandas(sign, "doc_id long, text_key long, n_shingles long, digest binary, sig binary"), "base")
    full = base.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min_by("sig", "doc_id").alias("sig"), F.min("n_shingles").alias("size"))
    classes = scratch.write(classes.withColumn("node", F.col("doc")), "classes")
    if not classes.groupBy("node").count().where("count > 1").isEmpty():
        # an id with several texts heads several classes: number these in the order of their ids
        numbered = classes.repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest").withColumn("node", F.monotonically_increasing_id())
        classes = scratch.write(numbered, "numbered")

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for part in parts:
            if not len(part):
                continue
            sig = np.frombuffer(b"".join(part["sig"]), "<u4").reshape(len(part), bands, rows).astype(np.uint64)
            key = np.broadcast_to(salt, sig.shape[:2]).copy()
            for k in range(rows):
                key = mix(key ^ sig[:, :, k])
            yield pd.DataFrame({"key": key.view(np.int64).ravel(), "node": np.repeat(part["node"].to_numpy(), bands), "size": np.repeat(part["size"].to_numpy(), bands)})

    # a bucket's smallest member and size are one partial aggregate, and the join back has no more to do in
    # its stage, so Spark may split a bucket of any size
    buckets = classes.select("node", "sig", "size").mapInPandas(cut, "key long, node long, size long")
    shared = scratch.write(buckets.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), "shared")
    members = scratch.write(buckets.join(shared, "key").select("key", "node", "size", "pivot"), "members")
    scratch.drop("shared")

    def with_sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = shingle_sets(part["text"].tolist(), width)
            good = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(d) for s, d in zip(sets, part["digest"])]
            yield pd.DataFrame({"node": part["node"], "digest": part["digest"], "sig": part["sig"], "shingles": [s.tobytes() for s in sets]})[good]

    wanted = members.select("node").distinct().join(classes.drop("size"), "node")
    cand = (
        wanted.join(source, wanted.doc == source.doc_id).select("node", "digest", "sig", "text")
        .mapInPandas(with_sets, "node long, digest binary, sig binary, shingles binary")
        .dropDuplicates(["node", "digest"]).drop("digest")
    )
    cand = scratch.write(cand, "cand")

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.frombuffer(b"".join(part["sig_a"]), "<u4").reshape(len(part), total)
            y = np.frombuffer(b"".join(part["sig_b"]), "<u4").reshape(len(part), total)
            live = _survivors(x, y, steps)
            sa, sb = part["shingles_a"].to_numpy(), part["shingles_b"].to_numpy()
            good = [i for i in live if similar(np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64), percent)]
            yield part[["a", "b"]].iloc[good]

    def linked(pairs: DataFrame) -> DataFrame:
        left = cand.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("shingles").alias("shingles_a"))
        right = cand.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("shingles").alias("shingles_b"))
        return pairs.join(left, "a").join(right, "b").mapInPandas(verify, "a long, b long")

    # each class against the smallest of its buckets' smallest members
    first = members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("b")).withColumnRenamed("node", "a")
    labels = components(scratch.write(linked(first), "edges-1"), scratch, "cc-1")
    # against the other buckets' smallest members, where that would join components
    rest = labelled(labelled(members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), labels, "a", "la"), labels, "b", "lb")
    more = scratch.write(linked(rest.where("la <> lb").select("a", "b").join(first, ["a", "b"], "left_anti")), "edges-2")
    if not more.isEmpty():
        labels = merged(labels, more, scratch, "cc-2")
    # within the buckets that still hold several components
    sides = _blocks(labelled(members.select("key", "node", "size"), labels, "node", "label"), cand, scratch)
    good = scratch.write(_across(sides, steps, total, percent, miss).distinct(), "edges-3")
    if not good.isEmpty():
        labels = merged(labels, good, scratch, "cc-3")

    heads = classes.select(F.col("node").alias("group"), F.col("doc").alias("component_id"))
    named = labelled(classes.select("node", "digest"), labels, "node", "group").join(heads, "group").select("digest", "group", "component_id")
    named = scratch.write(named, "named")
    joined = full.select("doc_id", "text_key", "n_shingles", "digest").join(named, "digest").drop("digest")
    alone = base.where("digest is null or doc_id is null").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.unionByName(alone).select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key", "group")


def _survivors(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows whose signatures x and y pass every batch's bound."""
    live, hits, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, m in steps:
        hits = hits + (x[live, done:n] == y[live, done:n]).sum(axis=1)
        keep = hits >= m
        live, hits, done = live[keep], hits[keep], n
        if not len(live):
            break
    return live


def _blocks(members: DataFrame, cand: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, x, y, side, node, label, sig, long, shingles) of the buckets that hold several components.

    In each bucket, its most frequent component forms the main part and all others the rest; every
    pair in question has a member in the rest.  The bucket is cut into blocks of the whole and blocks
    of the rest, and each pair of such blocks is one group: of about ``2 * BLOCK`` rows or
    ``2 * BLOCK_BYTES``, whichever is less.
    """
    family = hash_family(LONG, seed=20240502)

    def lengthen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [signature(np.frombuffer(s, np.uint64), *family).astype(np.uint8).tobytes() for s in part["shingles"]]
            yield part.assign(long=rows)

    per = members.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"))
    per = per.groupBy("key").agg(
        F.max_by(F.struct("label", "n", "sizes"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("sizes").alias("sizes"), F.count("*").alias("labels")
    )
    per = scratch.write(per.where("labels > 1").drop("labels"), "per")
    mixed = scratch.write(members.drop("size").join(per, "key"), "mixed")
    nodes = mixed.select("node").distinct().join(cand, "node").select("node", "sig", "shingles")
    nodes = scratch.write(nodes.mapInPandas(lengthen, "node long, sig binary, shingles binary, long binary"), "long")
    block = lambda n, sizes: F.ceil(F.greatest(n / F.lit(float(BLOCK)), sizes * 8 / F.lit(float(BLOCK_BYTES)))).cast("int")
    row, main = F.xxhash64("node"), F.col("main")
    mixed = mixed.withColumns({"blocks": block(F.col("n"), F.col("sizes")), "rests": block(F.col("n") - main["n"], F.col("sizes") - main["sizes"])})
    mine = mixed.withColumns({"x": F.pmod(row, "blocks").cast("int"), "y": F.pmod(row, "rests").cast("int")})
    whole = mine.select("key", "node", "label", "x", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("y"), F.lit(0).alias("side"))
    rest = mine.where(F.col("label") != main["label"]).select("key", "node", "label", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), "y", F.lit(1).alias("side"))
    return whole.unionByName(rest).join(nodes, "node")


def _shared(sets: list[np.ndarray], one: np.ndarray) -> np.ndarray:
    """How many elements each of ``sets`` shares with ``one``; all are sorted, distinct and not empty."""
    ends = np.cumsum([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], ends[:-1])))


def _across(sides: DataFrame, steps: list[tuple[int, int]], total: int, percent: int, miss: float) -> DataFrame:
    """(a, b): of each block's links between different components, a spanning forest."""
    # two different minima share their low byte once in 256
    share = percent / 100
    more = least_matches(LONG_BATCH, LONG, share + (1 - share) / 256, miss)

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        links = []
        if len(left) and len(right):
            x = np.frombuffer(b"".join(left["sig"]), "<u4").reshape(len(left), total)
            y = np.frombuffer(b"".join(right["sig"]), "<u4").reshape(len(right), total)
            u = np.frombuffer(b"".join(left["long"]), np.uint8).reshape(len(left), LONG)
            v = np.frombuffer(b"".join(right["long"]), np.uint8).reshape(len(right), LONG)
            sets, others = ([np.frombuffer(s, np.uint64) for s in half["shingles"]] for half in (left, right))
            size = np.array([len(s) for s in sets])
            xn, yn = left["node"].to_numpy(), right["node"].to_numpy()
            xl, yl = left["label"].to_numpy().copy(), right["label"].to_numpy().copy()
            for i in range(len(y)):
                n = len(others[i])
                at = np.flatnonzero((xl != yl[i]) & (100 * np.minimum(size, n) >= percent * np.maximum(size, n)))
                live = at[_survivors(x[at], np.broadcast_to(y[i], (len(at), total)), steps)]
                live = live[_survivors(u[live], np.broadcast_to(v[i], (len(live), LONG)), more)]
                if not len(live):
                    continue
                both = _shared([sets[k] for k in live], others[i])
                for k in live[100 * both >= percent * (size[live] + n - both)]:
                    old, new = xl[k], yl[i]
                    if old != new:
                        links.append((max(xn[k], yn[i]), min(xn[k], yn[i])))
                        xl[xl == old] = new
                        yl[yl == old] = new
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return sides.groupBy("key", "x", "y").applyInPandas(compare, "a long, b long")
