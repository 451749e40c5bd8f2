"""Exact Jaccard join of word n-gram sets, size-aware: subsets for small sets, inverted lists for large ones.

Shingles have one order: those known to be frequent come last, the others go by hash.  If two sets share o
elements or more, then the first ``n - o + c`` elements of both share at least c.  So

* a small set gives a key for every 2-subset of its first ``n - o + 2`` elements,
* a large set, and a small one that a large one may be similar to, gives a key for each of its first
  ``n - o + 1`` elements, which is an inverted list to scan,

and two similar sets share a key.  Where small ends is chosen by cost, from the sizes of all sets and the
lengths of repeated shingles' lists: subsets multiply keys, lists multiply comparisons.

Equal sets are one class.  A class is compared with the smallest of its keys' first members, then with the
others that are in other components; what keys still hold of several components is compared in blocks.
A comparison first looks at bitmaps: each holds the parity of the elements that fall on each bit, so
the bits in which two differ are no more than the elements in which the sets differ.  What passes is
decided on the full sets.  The result is exact; no pair becomes a row unless its bitmaps allow a link,
and no pair within a block unless it joins two components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.neardup import components, labelled, merged, similar
from kernelloom.llm.shared import Scratch, small_batches
from kernelloom.llm.words import mix, shingle_sets

#: Rows and bytes of a block of one side.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Least and most bits of a bitmap.
LEAST_BITS, MOST_BITS = 256, 16_384
#: Frequent shingles that every task gets: those of the longest lists, at most this many (1 MB).
MOST_FREQUENT = 1 << 17
#: From this length on a list may count as frequent.
FREQUENT = 64
#: A comparison of two bitmaps costs as much as so many keys.
COMPARISON = 0.05


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements that a set of n shares with any set similar to it."""
    return -(-percent * n // 100)


def bitmap(s: np.ndarray) -> bytes:
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, brought to ``size`` bytes: parities of coarser bits are sums of parities."""
    out = np.empty((len(maps), size // 8), np.uint64)
    for i, m in enumerate(maps):
        row = np.frombuffer(m, np.uint64)
        out[i] = row if len(m) == size else np.bitwise_xor.reduce(row.reshape(-1, size // 8), axis=0)
    return out


def most_apart(sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements two similar sets may differ, by the sum of their sizes."""
    return sizes - 2 * (-(-percent * sizes // (100 + percent)))


def ordered(s: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """The first n of the set's elements in the common order."""
    if not len(frequent):
        return s[:n]
    late = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
    return np.concatenate([s[~late][:n], s[late][: max(0, n - int((~late).sum()))]])


def keys(s: np.ndarray, frequent: np.ndarray, percent: int, small: int) -> np.ndarray:
    """The keys of one set, where sets of up to ``small`` elements are small."""
    n, o = len(s), least_overlap(len(s), percent)
    out = []
    subsets = n <= small and o >= 2
    # the largest small sets must meet large ones
    if not subsets or 100 * n >= percent * (small + 1):
        out.append(mix(ordered(s, frequent, n - o + 1) + np.uint64(0x9FB21C651E98DF25)))
    if subsets:
        first = mix(ordered(s, frequent, n - o + 2))
        i, j = np.triu_indices(len(first), 1)
        out.append(mix(first[i] * np.uint64(0xD6E8FEB86659FD93) + first[j]))
    return np.unique(np.concatenate(out))


def cheapest_boundary(sizes: dict[int, int], lists: float, percent: int) -> int:
    """The largest small size: of all sizes that occur, that of the least cost in keys and comparisons.

    ``sizes`` says how many sets there are of each size, ``lists`` how many other members the list of a
    set's element has on average."""
    at = sorted(sizes)
    o = {n: least_overlap(n, percent) for n in at}
    scan = {n: sizes[n] * (n - o[n] + 1) * (1 + COMPARISON * lists) for n in at}
    index = {n: sizes[n] * (n - o[n] + 1) for n in at}
    subsets = {n: sizes[n] * math.comb(n - o[n] + 2, 2) for n in at}
    best, small, light = sum(scan.values()), 0, 0.0
    heavy = best
    for n in at:
        heavy -= scan[n]
        light += subsets[n] if o[n] >= 2 else scan[n]
        near = sum(index[m] for m in at if m <= n and 100 * m >= percent * (n + 1))
        if light + heavy + near < best:
            best, small = light + heavy + near, n
    return small


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, small: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, group of every row of ``docs``: documents link when 100 *
    intersection >= percent * union of their sets of ``width`` words, A-Z lower-cased.

    ``small`` sets the boundary between small and large sets instead of the cost.  ``text_key`` is a hash of
    the text, ``group`` numbers the component, null without shingles or id.

    Null text, empty text and text of blanks only have an empty set and link with nothing; with fewer than
    ``width`` words the whole sequence is one shingle.  Repeated rows get equal answers; rows that share a
    doc_id but not a text link by their own texts.  A null doc_id takes no part: component_id null.  Whole
    texts count, however long.  An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "setjoin")
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))

    def digest(s: np.ndarray) -> bytes | None:
        return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row a document, and rows (element, repeats) of the shingles that a batch holds several times."""
        for part in parts:
            sets = shingle_sets(part["text"].tolist(), width)
            rows = pd.DataFrame({
                "doc_id": part["doc_id"].astype("Int64"), "text_key": part["text_key"], "n_shingles": np.array([len(s) for s in sets], np.int64),
                "digest": [digest(s) for s in sets], "bits": [bitmap(s) if len(s) else None for s in sets],
            })
            # copies within a batch count once
            once = list({d: s for d, s in zip(rows["digest"], sets) if d is not None}.values())
            found, n = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, int))
            extra = pd.DataFrame({"element": found[n > 1].view(np.int64), "repeats": n[n > 1].astype(np.int64)})
            out = pd.concat([rows, extra], ignore_index=True)
            yield out.astype({c: "Int64" for c in ("doc_id", "text_key", "n_shingles", "element", "repeats")})

    told = scratch.write(source.mapInPandas(describe, "doc_id long, text_key long, n_shingles long, digest binary, bits binary, element long, repeats long"), "told")
    base = told.where("repeats is null").drop("element", "repeats")
    full = base.where("digest is not null and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.min("n_shingles").alias("size"), F.first("bits").alias("bits"))
    classes = scratch.write(classes.withColumn("node", F.col("doc")), "classes")
    if not classes.groupBy("node").count().where("count > 1").isEmpty():
        # an id with several texts heads several classes: number these in the order of their ids
        numbered = classes.repartitionByRange("doc", "digest").sortWithinPartitions("doc", "digest").withColumn("node", F.monotonically_increasing_id())
        classes = scratch.write(numbered, "numbered")

    frequent, lists = _frequent(told.where("repeats is not null"), classes, scratch)
    if small is None:
        small = cheapest_boundary(_sizes(classes), lists, percent)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sets = shingle_sets(part["text"].tolist(), width)
            yield pd.DataFrame({"doc": part["doc_id"], "digest": [digest(s) for s in sets], "keys": [keys(s, frequent, percent, small).view(np.int64) if len(s) else None for s in sets]})

    # only each class's first document's keys count
    heads = classes.select("doc", "digest", "node", "size")
    keyed = source.where("doc_id is not null").mapInPandas(cut, "doc long, digest binary, keys array<long>").where("digest is not null")
    keyed = keyed.dropDuplicates(["doc", "digest"]).join(heads, ["doc", "digest"]).select("node", "size", "keys")
    keyed = scratch.write(keyed, "keyed").select(F.explode("keys").alias("key"), "node", "size")
    shared = scratch.write(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot"), "shared")
    members = scratch.write(keyed.join(shared, "key"), "members")
    scratch.drop("keyed", "shared")
    maps = classes.select("node", "size", "bits")

    def apart(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good = np.zeros(len(part), bool)
            sizes = np.stack([part["size_a"].to_numpy(), part["size_b"].to_numpy()])
            lengths = np.minimum(part["bits_a"].map(len).to_numpy(), part["bits_b"].map(len).to_numpy()) if len(part) else np.zeros(0, int)
            near = 100 * sizes.min(0) >= percent * sizes.max(0)
            for length in np.unique(lengths):
                at = np.flatnonzero((lengths == length) & near)
                x, y = (folded([part[c].iat[i] for i in at], int(length)) for c in ("bits_a", "bits_b"))
                good[at] = np.bitwise_count(x ^ y).sum(1) <= most_apart(sizes[:, at].sum(0), percent)
            yield part.loc[good, ["a", "b"]]

    def verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = part["set_a"], part["set_b"]
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield part.loc[good, ["a", "b"]]

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(node, shingles) of some classes, read once more from their first documents' texts."""

        def again(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                sets = shingle_sets(part["text"].tolist(), width)
                yield pd.DataFrame({"node": part["node"], "shingles": [s.tobytes() for s in sets]})[[digest(s) == bytes(d) for s, d in zip(sets, part["digest"])]]

        some = nodes.join(classes.select("node", "doc", "digest"), "node")
        rows = some.join(source, some.doc == source.doc_id).select("node", "digest", "text")
        return rows.mapInPandas(again, "node long, shingles binary").dropDuplicates(["node"])

    def linked(pairs: DataFrame, tag: str) -> DataFrame:
        """Those of the pairs that link: by bitmaps, then on the sets of what these leave."""
        left = maps.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("bits").alias("bits_a"))
        right = maps.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("bits").alias("bits_b"))
        live = scratch.write(pairs.join(left, "a").join(right, "b").mapInPandas(apart, "a long, b long"), f"live-{tag}")
        both = scratch.write(sets_of(live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct()), f"sets-{tag}")
        left, right = both.toDF("a", "set_a"), both.toDF("b", "set_b")
        made = scratch.write(live.join(left, "a").join(right, "b").mapInPandas(verify, "a long, b long"), f"edges-{tag}")
        scratch.drop(f"live-{tag}", f"sets-{tag}")
        return made

    pairs = members.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("b")).withColumnRenamed("node", "a")
    labels = components(linked(pairs, "1"), scratch, "cc-1")
    rest = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    rest = labelled(labelled(rest, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select("a", "b").join(pairs, ["a", "b"], "left_anti")
    more = linked(rest, "2")
    if not more.isEmpty():
        labels = merged(labels, more, scratch, "cc-2")
    # what keys still hold of several components, now that all were compared with the first: who has a possible
    # partner at all, then these on full sets
    held = labelled(members.where("node <> pivot").select("key", "node", "size"), labels, "node", "label")
    grid = _grid(_banded(held, percent), F.lit(0), scratch, "grid-1").join(maps.select("node", "bits"), "node")
    some = scratch.write(grid.groupBy("pack").applyInPandas(_possible(percent), "node long").distinct(), "possible")
    if not some.isEmpty():
        sets = scratch.write(sets_of(some), "sets-3")
        again = _banded(held.join(some, "node"), percent)
        grid = _grid(again, F.col("size") * 8, scratch, "grid-2").join(maps.select("node", "bits"), "node").join(sets, "node")
        found = scratch.write(grid.groupBy("pack").applyInPandas(_forest(percent), "a long, b long").distinct(), "edges-3")
        if not found.isEmpty():
            labels = merged(labels, found, scratch, "cc-3")

    first = classes.select(F.col("node").alias("group"), F.col("doc").alias("component_id"))
    named = scratch.write(labelled(classes.select("node", "digest"), labels, "node", "group").join(first, "group").select("digest", "group", "component_id"), "named")
    out = ["doc_id", "n_shingles", "component_id", "text_key", "group"]
    alone = base.where("digest is null or doc_id is null").withColumns({"group": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return full.select("doc_id", "n_shingles", "text_key", "digest").join(named, "digest").select(out).unionByName(alone.select(out))


def _frequent(repeats: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[np.ndarray, float]:
    """(the most frequent shingles, sorted; the average list's other members among the rest).

    The order of elements changes costs only, never the result, so it does to count what recurs within a
    batch.  A count's power of two decides whether it is frequent: the longest lists that fit the bound."""
    counts = scratch.write(repeats.groupBy("element").agg(F.sum("repeats").alias("n")), "counts")
    level = F.floor(F.log2("n")).cast("int")
    by = {r.level: (r.elements, float(r.squares)) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("elements"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).collect()}
    least, total = int(math.log2(FREQUENT)), 0
    for at in sorted(by, reverse=True):
        total += by[at][0]
        if total > MOST_FREQUENT:
            least = max(least, at + 1)
            break
    rows = counts.where(level >= least).select("element").toPandas()["element"].to_numpy(np.int64)
    all_ = classes.agg(F.sum("size")).first()[0] or 1
    return np.sort(rows.view(np.uint64)), sum(s for at, (_, s) in by.items() if at < least) / all_


def _sizes(classes: DataFrame, fine: int = 64) -> dict[int, int]:
    """How many classes there are of each size, sizes above ``fine`` in steps of a sixteenth of their power of
    two: a bounded table."""
    step = F.when(F.col("size") > fine, F.pow(F.lit(2.0), F.floor(F.log2("size")) - 4)).otherwise(1.0)
    size = (F.floor(F.col("size") / step) * step).cast("long")
    return {r.s: r.n for r in classes.groupBy(size.alias("s")).agg(F.count("*").alias("n")).collect()}


def _banded(rows: DataFrame, percent: int) -> DataFrame:
    """Each row in two of its key's bands of sizes, whose width is a little more than a link allows: two sizes that
    may link share a band."""
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / (percent - 0.01))).cast("int")
    return rows.withColumn("band", F.explode(F.array(band, band + 1)))


def _grid(rows: DataFrame, weight: Column, scratch: Scratch, tag: str) -> DataFrame:
    """(pack, key, band, x, y, side, node, label, size) of the bands that hold several components: blocks of all
    rows (side 0) against blocks of those outside the most frequent component (side 1), each of a bounded
    number of rows and weight.  Bands of the same members count once.  A pair of blocks is a pack of its own;
    bands of one block share packs of about as many rows."""
    rows = rows.withColumn("weight", weight.cast("long"))
    hashed, marks = F.xxhash64("node"), [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in (1, 2)]
    per = rows.groupBy("key", "band", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), marks[0].alias("h1"), marks[1].alias("h2"))
    per = per.groupBy("key", "band").agg(
        F.max_by(F.struct("label", "n", "w"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("labels"),
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"),
    ).where("labels > 1")
    least = F.min(F.struct("key", "band", "main", "n", "w"))
    per = scratch.write(per.groupBy("h1", "h2", F.col("n").alias("same")).agg(least.alias("p")).select("p.*"), tag)
    blocks = lambda n, w: F.ceil(F.greatest(n / F.lit(float(BLOCK)), w / F.lit(float(BLOCK_BYTES)))).cast("int")
    main, total = F.col("main"), per.agg(F.sum("n"), F.sum("w")).first()
    packs = max(1, -(-(total[0] or 0) // BLOCK), -(-(total[1] or 0) // BLOCK_BYTES))
    mine = rows.drop("weight").join(per, ["key", "band"])
    mine = mine.withColumns({"blocks": blocks(F.col("n"), F.col("w")), "rests": blocks(F.col("n") - main["n"], F.col("w") - main["w"])})
    mine = mine.withColumns({"x": F.pmod(hashed, "blocks").cast("int"), "y": F.pmod(hashed, "rests").cast("int")})
    whole = mine.withColumns({"y": F.explode(F.sequence(F.lit(0), F.col("rests") - 1)), "side": F.lit(0)})
    rest = mine.where(F.col("label") != main["label"]).withColumns({"x": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "side": F.lit(1)})
    one = F.col("blocks") * F.col("rests") == 1
    pack = F.when(one, F.pmod(F.xxhash64("key", "band"), F.lit(packs))).otherwise(F.xxhash64("key", "band", "x", "y"))
    return whole.unionByName(rest).select(pack.alias("pack"), "key", "band", "x", "y", "side", "node", "label", "size")


class _Side:
    def __init__(self, part: pd.DataFrame, at: np.ndarray, least: int):
        self.size, self.label, self.node = (part[c].to_numpy()[at] for c in ("size", "label", "node"))
        self.words = folded([part["bits"].iat[i] for i in at], least)
        self.at = at


def _pairs_of_blocks(part: pd.DataFrame) -> Iterator[tuple[_Side, _Side]]:
    """Both sides of each pair of blocks in a pack, by size, with their bitmaps in words of one length."""
    if not len(part):
        return
    by = [part[c].to_numpy() for c in ("node", "size", "side", "y", "x", "band", "key")]
    order = np.lexsort(by)
    where = np.stack([c[order] for c in by[3:]])
    starts = np.flatnonzero(np.append(True, (where[:, 1:] != where[:, :-1]).any(0)))
    length, side = part["bits"].map(len).to_numpy(), by[2]
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        own = order[a:b]
        split = int((side[own] == 0).sum())
        if 0 < split < len(own):
            least = int(length[own].min())
            yield _Side(part, own[:split], least), _Side(part, own[split:], least)


def _partners(left: _Side, right: _Side, i: int, percent: int) -> np.ndarray:
    """Rows of the left that right's row i may link with, in other components."""
    n = int(right.size[i])
    lo, hi = np.searchsorted(left.size, [-(-percent * n // 100), 100 * n // percent + 1])
    at = lo + np.flatnonzero(left.label[lo:hi] != right.label[i])
    return at[np.bitwise_count(left.words[at] ^ right.words[i]).sum(1) <= most_apart(left.size[at] + n, percent)]


def _possible(percent: int):
    def find(part: pd.DataFrame) -> pd.DataFrame:
        out: set[int] = set()
        for left, right in _pairs_of_blocks(part):
            for i in range(len(right.node)):
                at = _partners(left, right, i, percent)
                if len(at):
                    out.update(left.node[at].tolist())
                    out.add(int(right.node[i]))
        return pd.DataFrame({"node": np.array(sorted(out), np.int64)})

    return find


def _forest(percent: int):
    def find(part: pd.DataFrame) -> pd.DataFrame:
        links, shingles = [], part["shingles"].to_numpy()
        for left, right in _pairs_of_blocks(part):
            for i in range(len(right.node)):
                one = np.frombuffer(shingles[right.at[i]], np.uint64)
                for k in _partners(left, right, i, percent):
                    old, new = left.label[k], right.label[i]
                    if old != new and similar(np.frombuffer(shingles[left.at[k]], np.uint64), one, percent):
                        links.append((max(left.node[k], right.node[i]), min(left.node[k], right.node[i])))
                        left.label[left.label == old] = new
                        right.label[right.label == old] = new
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return find
