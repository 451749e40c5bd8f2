"""Importance resampling towards a target corpus, on n-gram buckets whose CRCs are composed, not read.

A feature is a run of 1 to 3 words, its bucket the CRC-32 of its text modulo ``buckets``.  No such text is
made: each word's CRC is computed once, and since a CRC is linear over GF(2), the CRC of A followed by B is
``shift(crc(A), len(B)) ^ crc(B)``, where ``shift`` is the 32 x 32 matrix over GF(2) of as many zero bytes.
The matrix is kept as four tables of 256 images, one for each byte of the argument.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, free_names, small_batches
from kernelloom.llm.words import blocks, chunks, spans, utf8

#: Digits, letters without case, and all bytes of characters beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
#: Longer words go to zlib one by one; shorter ones are read together, byte by byte.
SHORT = 64
_SPACE = np.uint32(zlib.crc32(b" "))


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


STEP = _byte_table()


def _images(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The matrix of ``table`` (4, 256) applied to each of c."""
    low = np.uint32(255)
    return table[0, c & low] ^ table[1, (c >> np.uint32(8)) & low] ^ table[2, (c >> np.uint32(16)) & low] ^ table[3, c >> np.uint32(24)]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The matrices of 0 to 255 zero bytes, and of 256 * 2**j."""
    few = np.empty((256, 4, 256), np.uint32)
    few[0] = np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, 256):
        few[n] = (few[n - 1] >> np.uint32(8)) ^ STEP[few[n - 1] & np.uint32(255)]
    many = [(few[255] >> np.uint32(8)) ^ STEP[few[255] & np.uint32(255)]]
    for _ in range(23):
        many.append(_images(many[-1], many[-1]))
    return few, many


FEW, MANY = _shift_tables()


def shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What each CRC becomes behind n zero bytes."""
    low, at = np.uint32(255), n & 255
    out = FEW[at, 0, crc & low] ^ FEW[at, 1, (crc >> np.uint32(8)) & low] ^ FEW[at, 2, (crc >> np.uint32(16)) & low] ^ FEW[at, 3, crc >> np.uint32(24)]
    rest, j = n >> 8, 0
    while rest.any():
        odd = np.flatnonzero(rest & 1)
        out[odd] = _images(MANY[j], out[odd])
        rest, j = rest >> 1, j + 1
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word's bytes."""
    n = ends - starts
    order = np.argsort(-np.minimum(n, SHORT + 1), kind="stable")
    long = int((n > SHORT).sum())
    at, left = starts[order[long:]], n[order[long:]]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    live = np.searchsorted(-left, -np.arange(1, SHORT + 1), side="right")
    for p, k in enumerate(live):
        if not k:
            break
        crc[:k] = (crc[:k] >> np.uint32(8)) ^ STEP[(crc[:k] ^ buf[at[:k] + p]) & np.uint32(255)]
    out = np.empty(len(n), np.uint32)
    out[order[long:]] = ~crc
    for i in order[:long]:
        out[i] = zlib.crc32(buf[starts[i] : ends[i]])
    return out


def ngram_crcs(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text of each feature, CRC of each feature, features' words): in blocks of bounded size, of all runs of
    one, two and three words of each text, A-Z lower-cased."""
    for a, b in chunks(texts):
        buf, starts, ends, first = spans([utf8(t).lower() for t in texts[a:b]], IS_WORD)
        for i, j in blocks(starts, ends):
            # the two words behind the block end its last runs
            top = min(j + 2, len(starts))
            n = ends[i:top] - starts[i:top]
            text = np.searchsorted(first, np.arange(i, top), side="right") - 1
            one = word_crcs(buf, starts[i:top], ends[i:top])
            spaced = shift(np.full(len(one), _SPACE), n) ^ one
            run = one
            yield a + text[: j - i], run[: j - i], 1
            for k in (1, 2):
                run = shift(run[:-1], n[k:] + 1) ^ spaced[k:]
                same = np.flatnonzero(text[: len(run)] == text[k:])
                same = same[same < j - i]
                yield a + text[same], run[same], k + 1


def bucket_counts(texts: DataFrame, col: str, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: a vector a task, summed by bucket."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for _, crc, _ in ngram_crcs(part["t"].tolist()):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(F.col(col).cast("string").alias("t")).mapInPandas(count, "bucket long, n long")
    made, out = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas(), np.zeros(buckets, np.int64)
    out[made["bucket"].to_numpy(np.int64)] = made["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of a bucket's share in the target to that in the source)."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _noise(key: Column, seed: int) -> Column:
    """A Gumbel draw of seed and key, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 5, least: int = 20, seed: int = 42, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank, text_key of every row of ``docs``.

    weight sums the gains of a document's features, score adds a Gumbel draw; of the N documents of at
    least ``least`` words, those of the floor(percent * N / 100) highest scores are drawn and ranked from 1,
    ties to the smaller id.  All documents and all of the target count towards the gains.

    A null text has no words, so n_features and weight are 0, as for empty text and text of marks only.  A row
    without an id has a weight, but no score, isn't among the N and is never drawn.  Repeated rows have equal
    scores and ranks of their own.  Without target texts all gains go by the source's counts alone; an
    empty table gives an empty result.  Whole texts count, however long; other columns are ignored.
    ``text_key`` is a hash of the text, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "resample")
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))

    def weigh(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            total, count, words = (np.zeros(len(part), np.int64) for _ in range(3))
            for text, crc, k in ngram_crcs(part["text"].tolist()):
                # sums of whole numbers below 2**53 are exact
                total += np.bincount(text, gain[crc % np.uint32(buckets)], len(part)).astype(np.int64)
                own = np.bincount(text, minlength=len(part))
                count += own
                words += own if k == 1 else 0
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_features": count, "weight": total, "words": words, "text_key": part["text_key"]})

    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = source.mapInPandas(weigh, "doc_id long, n_features long, weight long, words long, text_key long")
    rows = scratch.write(rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scored")
    fit = (F.col("words") >= least) & F.col("doc_id").isNotNull()
    return _ranked(rows, fit, percent, scratch)


def _ranked(rows: DataFrame, fit: Column, percent: int, scratch: Scratch) -> DataFrame:
    """``rows`` with the rank of those drawn.  The fit rows are sorted by range; a row's rank is its place in
    its partition and the sizes of the partitions before, one number each."""
    spark, out = rows.sparkSession, ["doc_id", "n_features", "weight", "score", "rank", "text_key"]
    order = [F.col("score").desc(), "doc_id", "text_key"]
    at = rows.where(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = scratch.write(at, "placed")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before, sizes = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect()):
        sizes.append((p, before))
        before += n
    draws = percent * before // 100
    offsets = spark.createDataFrame(sizes, "part long, before long")
    rank = F.col("before") + place + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= draws, rank)).select(out)
    return ranked.unionByName(rows.where(~fit).withColumn("rank", F.lit(None).cast("long")).select(out))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``importance`` draws, with all their columns.  Rows that agree in id and text
    are drawn together if one of them is."""
    key, own, drawn = free_names(docs, "text_key", "drawn_id", "drawn_key")
    some = importance(docs, target, id_col, text_col, **options).where("rank is not null")
    some = some.select(F.col("doc_id").alias(own), F.col("text_key").alias(drawn)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
    return keyed.join(some, (F.col(id_col).cast("long") == F.col(own)) & (F.col(key) == F.col(drawn)), "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
