"""Token ids in range asymmetric numeral system (rANS) files that decode in parallel.

One static frequency table, counted over the whole corpus, serves all files; it is stored once, in
``table.rans``.  A shard holds a contiguous range of documents in ascending id order.  Its ids are cut
into independent blocks of ``BLOCK_TOKENS``; in a block, ``LANES`` coders take the ids in turn and
share one stream of 32-bit words.  Each block has a checkpoint: where its words begin, how many ids
it holds, the lanes' final states and a crc32 of its ids, so any block decodes alone and is checked.

Shard layout, little-endian:

    8 bytes  b"RANSTOK1"
    6 int64  documents, ids, blocks, ids a block, lanes, crc32 of the table file
    documents x int64   document ids (null: the least int64)
    documents x int64   ids of each document
    blocks x int64      first word of each block
    blocks x uint32     crc32 of each block's ids as unsigned 32-bit integers
    blocks x lanes x uint64   states
    uint32 words to the end of the file but for the last 4 bytes
    uint32 crc32 of all before it
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, attempt_name, read_file, small_batches, write_file

MAGIC, TABLE_MAGIC = b"RANSTOK1", b"RANSTAB1"
BITS, LANES, BLOCK_TOKENS = 20, 32, 16384
LOW, SHIFT = np.uint64(1 << 31), np.uint64(32)
NULL_ID = -(1 << 63)


# -- the frequency table ---------------------------------------------------------------------------


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for every id of the vocabulary, seen or not."""
    n, total = len(counts), 1 << bits
    if n > total:
        raise ValueError(f"{n} ids don't fit a table of {total} slots")
    share = counts / max(1, counts.sum()) * (total - n)
    freq = np.floor(share).astype(np.int64)
    left = total - n - int(freq.sum())
    freq[np.argsort(-(share - freq), kind="stable")[: left % n]] += 1
    return freq + 1 + left // n


def table_bytes(freq: np.ndarray) -> bytes:
    body = TABLE_MAGIC + struct.pack("<qq", BITS, len(freq)) + freq.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_table(data: bytes) -> np.ndarray:
    if data[:8] != TABLE_MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("damaged frequency table")
    bits, n = struct.unpack("<qq", data[8:24])
    freq = np.frombuffer(data[24:-4], "<u4").astype(np.int64)
    if len(freq) != n or freq.sum() != 1 << bits:
        raise ValueError("damaged frequency table")
    return freq


class Coder:
    """All blocks of a shard side by side: one numpy step codes one id of every lane of every block."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, block: int = BLOCK_TOKENS, lanes: int = LANES, group: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, first word of each block, states (blocks, lanes)) of ids; a last, short block is
        filled up with its own most frequent possible id, 0 bits of which anyone reads.  ``group`` blocks
        are coded at a time, which bounds the memory."""
        words, firsts, states, done = [], [], [], 0
        for i in range(0, len(ids), block * group):
            got, first, state = self._encode(ids[i : i + block * group], block, lanes)
            words.append(got)
            firsts.append(first + done)
            states.append(state)
            done += len(got)
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((0, lanes), np.uint64)
        return np.concatenate(words), np.concatenate(firsts), np.concatenate(states)

    def _encode(self, ids: np.ndarray, block: int, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = -(-len(ids) // block)
        steps = block // lanes
        filled = np.full(n * block, int(self.freq.argmax()), np.int32)
        filled[: len(ids)] = ids
        cells = filled.reshape(n, steps, lanes)
        state = np.full((n, lanes), LOW, np.uint64)
        words, marks = np.empty((n, steps, lanes), np.uint32), np.empty((n, steps, lanes), bool)
        room = np.uint64(31 - BITS + 32)
        for t in range(steps - 1, -1, -1):
            f, c = self.freq[cells[:, t]], self.start[cells[:, t]]
            full = state >= f << room
            words[:, t], marks[:, t] = state.astype(np.uint32), full
            state = np.where(full, state >> SHIFT, state)
            whole = state // f
            state = (whole << np.uint64(BITS)) + (state - whole * f) + c
        first = np.zeros(n, np.int64)
        np.cumsum(marks.sum(axis=(1, 2))[:-1], out=first[1:])
        return words[marks], first, state

    def decode(self, words: np.ndarray, first: np.ndarray, states: np.ndarray, block: int = BLOCK_TOKENS) -> np.ndarray:
        """All ids of the given blocks, the fill of a last, short block included."""
        n, lanes = states.shape
        steps = block // lanes
        out = np.empty((n, steps, lanes), np.uint32)
        words = np.append(words, np.zeros(lanes, np.uint32)).astype(np.uint64)
        state, at = states.copy(), first.copy()
        mask = np.uint64((1 << BITS) - 1)
        for t in range(steps):
            slot = state & mask
            symbol = self.slots[slot]
            out[:, t] = symbol
            state = self.freq[symbol] * (state >> np.uint64(BITS)) + slot - self.start[symbol]
            empty = state < LOW
            rank = empty.cumsum(axis=1)
            fresh = words[np.minimum(at[:, None] + rank - 1, len(words) - 1)]
            state = np.where(empty, (state << SHIFT) | fresh, state)
            at += rank[:, -1]
        return out.reshape(-1)


def _crcs(ids: np.ndarray, block: int) -> np.ndarray:
    raw = ids.astype("<u4")
    return np.array([zlib.crc32(raw[i : i + block].tobytes()) for i in range(0, len(raw), block)], "<u4")


def shard_bytes(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, coder: Coder, table_crc: int) -> bytes:
    words, first, states = coder.encode(ids)
    head = struct.pack("<6q", len(doc_ids), len(ids), len(first), BLOCK_TOKENS, LANES, table_crc)
    parts = [MAGIC, head, doc_ids.astype("<i8").tobytes(), lengths.astype("<i8").tobytes(), first.astype("<i8").tobytes(), _crcs(ids, BLOCK_TOKENS).tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass(frozen=True)
class Shard:
    """The parts of a shard's file."""

    doc_ids: np.ndarray
    lengths: np.ndarray
    total: int
    block: int
    first: np.ndarray
    crcs: np.ndarray
    states: np.ndarray
    words: np.ndarray


def parse_shard(data: bytes, table_crc: int, whole: bool = True) -> Shard:
    """ValueError on damage or another table; with ``whole=False`` the file's own checksum isn't asked,
    so that the sound blocks of a damaged file can still be read."""
    if data[:8] != MAGIC or len(data) < 60 or whole and struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("damaged shard")
    docs, total, blocks, block, lanes, crc = struct.unpack("<6q", data[8:56])
    if crc != table_crc:
        raise ValueError("the shard was coded with another table")
    at = 56

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, n, at)
        at += got.nbytes
        return got

    doc_ids, lengths, first, crcs = take("<i8", docs), take("<i8", docs), take("<i8", blocks), take("<u4", blocks)
    states = take("<u8", blocks * lanes).astype(np.uint64).reshape(blocks, lanes)
    return Shard(doc_ids, lengths, total, block, first.astype(np.int64), crcs, states, take("<u4", (len(data) - 4 - at) // 4))


def read_block(shard: Shard, k: int, coder: Coder) -> np.ndarray:
    """The ids of one block, decoded alone from its checkpoint and checked; ValueError if they are damaged."""
    ids = coder.decode(shard.words, shard.first[k : k + 1], shard.states[k : k + 1], shard.block)[: shard.total - k * shard.block]
    if _crcs(ids, shard.block)[0] != shard.crcs[k]:
        raise ValueError(f"the ids of block {k} don't agree with their checksum")
    return ids


def read_shard(data: bytes, coder: Coder, table_crc: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, lengths, all ids in order); raises ValueError on any damage."""
    s = parse_shard(data, table_crc)
    group, parts = 64, []
    for k in range(0, len(s.first), group):
        parts.append(coder.decode(s.words, s.first[k : k + group], s.states[k : k + group], s.block))
    ids = np.concatenate(parts)[: s.total] if parts else np.zeros(0, np.uint32)
    if len(ids) != s.total or s.lengths.sum() != s.total or (_crcs(ids, s.block) != s.crcs).any():
        raise ValueError("ids don't agree with their checksums")
    return s.doc_ids, s.lengths, ids


# -- tokenizing ------------------------------------------------------------------------------------

#: Pieces whose ids a worker remembers at most, in two generations: those used since the last change stay.
REMEMBERED = 500_000
#: Longer pieces are no words and aren't remembered.
LONGEST = 64
#: Stands between pieces that are encoded in one call.
MARK = "\x01"
#: Blanks at which a text is cut, and the place between a letter and a mark, where one is put in.
BLANKS = " \t\n\v\f\r"
LETTERS, MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", ".,;:!?)"
#: Texts on which a tokenizer shows how it treats blanks.
_PROBES = ("ab", "Ab", "a.", "it's", "'s", "12", "\u00e9\u0301", "e", ".,", "\u4e2d", "(x)")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of whole texts, by a tokenizer that drops white space and merges within words only.

    The ids of a text are then those of its pieces between blanks.  Arrow cuts a batch into pieces and finds
    the distinct ones; each of these is encoded once and remembered, new pieces together in one call with
    ``MARK`` between them.  Whether a tokenizer is of that kind is tried on ``_PROBES`` with every blank;
    texts go to any other tokenizer as they are.  A tokenizer that always parts letters from marks is
    tried likewise, and gets a blank between them, so that words recur whatever follows them.  Words of
    ``LETTERS`` alone, lower-cased, go to the tokenizer's model without the parts before it, which leave
    such words as they are; that too is tried, letter by letter.
    """

    def __init__(self, path: str):
        # Spark's tasks use the cores
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        own = {p: self._ids(p) for p in _PROBES}
        pairs = [(p, q) for p in _PROBES for q in _PROBES]
        added = self.tokenizer.get_added_tokens_decoder().values()
        plain = not any(t.lstrip or t.rstrip or t.single_word or any(map(str.isspace, t.content)) for t in added)
        splits = all(self._ids(f"{c}{p}{c}{q}{c}{c}") == own[p] + own[q] for c in BLANKS for p, q in pairs)
        mark = self._ids(MARK)
        marked = len(mark) == 1 and all(self._ids(f"{p} {MARK} {q}") == own[p] + mark + own[q] for p, q in pairs)
        self.mark = mark[0] if plain and splits and marked else None
        self.parts = f"([{LETTERS}])([{MARKS}])"
        letters = re.findall(f"[{LETTERS}]", "".join(map(chr, range(256))))
        if any(re.search(self.parts, t.content) for t in added) or any(self._ids(f"x{a}{m}y") != self._ids(f"x{a}") + self._ids(f"{m}y") for a in letters for m in MARKS):
            self.parts = None

        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        tried = [w for a in letters for w in (a, f"{a}x", f"x{a}", f"th{a}ther{a}")]
        same = all(self._ids(w) == self._ids(w.lower(), self.words) and self.ends[self._ids(w)].tolist() == [False] * (len(self._ids(w)) - 1) + [True] for w in tried)
        self.word = re.compile(f"[{LETTERS}]+").fullmatch if same else None

    def _ids(self, text: str, by=None) -> list[int]:
        return (by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _alone(self, text: str) -> np.ndarray:
        return np.array(self._ids(text), "<u2")

    def _learn(self, new: list[str], size: int = 2048) -> None:
        rest = new
        if self.word:
            rest, letters = [], {}
            for p in new:
                if self.word(p):
                    letters.setdefault(p.lower(), []).append(p)
                else:
                    rest.append(p)
            low = list(letters)
            for i in range(0, len(low), size):
                part = low[i : i + size]
                ids = np.array(self._ids(" ".join(part), self.words), "<u2")
                edges, raw = [0, *(2 * np.flatnonzero(self.ends[ids]) + 2).tolist()], ids.tobytes()
                if len(edges) != len(part) + 1:
                    # a word that the model doesn't end goes with the others
                    rest += [p for w in part for p in letters[w]]
                    continue
                self.known.update((w, raw[a:b]) for p, a, b in zip(part, edges, edges[1:]) for w in letters[p])
        for i in range(0, len(rest), size):
            part = rest[i : i + size]
            ids = self._alone(f" {MARK} ".join(part))
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) == len(part) - 1:
                edges, raw = [-2, *(2 * cut).tolist(), 2 * len(ids)], ids.tobytes()
                self.known.update((p, raw[a + 2 : b]) for p, a, b in zip(part, edges, edges[1:]))
            else:  # a piece holds the mark itself
                self.known.update((p, self._alone(p).tobytes()) for p in part)

    def encode(self, texts: pa.Array, end: bytes) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 16-bit integers, and ``end``."""
        texts = pc.fill_null(texts, "")
        if self.mark is None:
            return [self._alone(t).tobytes() + end for t in texts.to_pylist()]
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, self.parts, r"\1 \2") if self.parts else texts)
        pieces = cut.flatten().dictionary_encode()
        words, which = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        known, before = self.known, self.before
        new = [p for p in words if p not in known]
        known.update((p, before[p]) for p in new if p in before)
        new = [p for p in new if p not in before]
        self._learn(new)
        coded = [known[p] for p in words]
        # the ids of all pieces one after another, by the place of each piece's first id in a table of distinct ones
        table, size = np.frombuffer(b"".join(coded), "<u2"), np.array([len(c) // 2 for c in coded], np.int64)
        start, n = (np.cumsum(size) - size)[which], size[which]
        last = np.cumsum(n)
        ids = table[np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - n), n)].tobytes()
        edge = np.concatenate([[0], 2 * last])[cut.offsets.to_numpy() - cut.offsets[0].as_py()].tolist()
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > REMEMBERED // 2:
            self.known, self.before = {}, known
        return [ids[a:b] + end for a, b in zip(edge, edge[1:])]


def encode_texts(texts: pa.Array, tokenizer_path: str, end_id: int) -> list[bytes]:
    """Ids of each text (null: empty) and the end id, as little-endian unsigned 16-bit integers."""
    if tokenizer_path not in _encoders:
        _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return _encoders[tokenizer_path].encode(texts, struct.pack("<H", end_id))


#: Tasks that write or read shards at most; beyond that a task has several, one after another.
MOST_TASKS = 10_000

# -- files -----------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, scratch: Scratch, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 4_000_000) -> DataFrame:
    """Encode every text, write ``table.rans``, the shards and ``manifest`` (Parquet) to ``folder``; returns
    the manifest (part, place, file, docs, tokens), one row a shard, in order of part and place.

    Null and empty texts have the end id only.  A null id comes first; rows with equal or null ids are in
    the order of a hash of their ids, then of the ids' bytes, and may be in several shards; repeated rows
    repeat.  A very long text is one row, so a shard is as long as its longest text at least.  An empty
    table writes the table file and no shards.  Columns but the two named aren't read, whatever their names.
    """
    if vocabulary > 1 << 16 or not 0 <= end_id < vocabulary:
        raise ValueError("ids must fit 16 bits")
    spark = docs.sparkSession
    small_batches(spark)

    def tokenize(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(encode_texts(part.column("text"), tokenizer_path, end_id), pa.binary())], ["doc_id", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = scratch.write(source.mapInArrow(tokenize, "doc_id long, ids binary"), "tokens")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for part in parts:
            total += np.bincount(np.frombuffer(b"".join(part["ids"]), "<u2"), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "n": total[at]})

    # one row for each id of the vocabulary at most
    seen = tokens.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(vocabulary, np.int64)
    counts[seen["id"].to_numpy(np.int64)] = seen["n"].to_numpy(np.int64)
    table = table_bytes(quantise(counts))
    write_file(f"{folder}/table.rans", table)
    freq, table_crc = read_table(table), zlib.crc32(table)
    shards = max(1, int(counts.sum() // shard_tokens))

    def to_shards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's documents in order, in files of about ``shard_tokens`` ids."""
        ids, raw, size, done, coder = [], [], 0, [], Coder(freq)

        def flush() -> None:
            nonlocal ids, raw, size
            lengths, all_ids = np.array([len(x) // 2 for x in raw], np.int64), np.frombuffer(b"".join(raw), "<u2")
            name = attempt_name("shard", "rans", len(done))
            write_file(f"{folder}/{name}", shard_bytes(np.concatenate(ids), lengths, all_ids, coder, table_crc))
            done.append((TaskContext.get().partitionId(), len(done), name, len(raw), len(all_ids)))
            ids, raw, size = [], [], 0

        for part in parts:
            if not len(part):
                continue
            ids.append(part["doc_id"].astype("Int64").fillna(NULL_ID).to_numpy(np.int64))
            raw += part["ids"].tolist()
            size += sum(map(len, part["ids"])) // 2
            if size >= 2 * shard_tokens:
                flush()
        if raw:
            flush()
        yield pd.DataFrame(done, columns=["part", "place", "file", "docs", "tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("ids")]
    ordered = tokens.repartitionByRange(min(MOST_TASKS, shards), *order[:2]).sortWithinPartitions(*order)
    ordered.mapInPandas(to_shards, "part int, place int, file string, docs long, tokens long").write.parquet(f"{folder}/manifest")
    scratch.drop("tokens")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard from the files of the manifest, every block checked; files
    that a lost attempt left aren't read.  Damage raises ValueError."""
    table = read_file(f"{folder}/table.rans")
    freq, table_crc = read_table(table), zlib.crc32(table)

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(freq)
        for part in parts:
            for shard, file, offset in zip(part["shard"], part["file"], part["offset"]):
                doc_ids, lengths, ids = read_shard(read_file(f"{folder}/{file}"), coder, table_crc)
                raw, start = ids.astype("<u4").tobytes(), np.cumsum(lengths) - lengths
                null = doc_ids == NULL_ID
                yield pd.DataFrame({
                    "doc_id": pd.arrays.IntegerArray(np.where(null, 0, doc_ids), null), "start": offset + start, "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(start.tolist(), lengths.tolist())], "shard": shard,
                })

    manifest = spark.read.parquet(f"{folder}/manifest")
    # one number a writing task comes here; shards are numbered within their tasks
    before, files, sums = 0, 0, []
    for part, tokens, n in sorted(tuple(r) for r in manifest.groupBy("part").agg(F.sum("tokens"), F.count("*")).collect()):
        sums.append((part, before, files))
        before, files = before + tokens, files + n
    own = Window.partitionBy("part").orderBy("place")
    starts = F.broadcast(spark.createDataFrame(sums, "part int, before long, files long"))
    offsets = manifest.join(starts, "part").select((F.col("files") + F.col("place")).cast("int").alias("shard"), "file", (F.col("before") + F.sum("tokens").over(own) - F.col("tokens")).alias("offset"))
    dealt = offsets.repartitionByRange(min(MOST_TASKS, max(1, files)), "shard")
    return dealt.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def vocabulary_size(tokenizer_path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True)


def token_file_index(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all of ``docs`` to files in the shared folder and read them back: doc_id, start,
    n_tokens, ids_crc32, shard.  Edge cases: ``write_token_files``."""
    scratch = Scratch(docs.sparkSession, "ransfile")
    folder = scratch.folder("files")
    write_token_files(docs, folder, tokenizer_path, vocabulary_size(tokenizer_path), scratch, end_id, id_col, text_col)
    return read_token_files(docs.sparkSession, folder)
