"""The pipeline, stage by stage and as a whole, against plain Python on a small table."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kernelloom.llm.queries import table, tokenizer_path

from test_contracts import brute_targets
from test_operators import classes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, quality_score int"
ITEM = "how many baskets of ripe apples did the farmer sell on the first market day if each held 48 apples"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(7), tmp_path_factory.mktemp("pipeline")
    vocab = [f"{a}{b}" for a in "bar cold dus fer gol haw iri jad kel lin mor".split() for b in "el or us an ix um ay ock".split()]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    rows, labels = [], []

    def add(i, text, quality=1, source=None):
        rows.append((i, text, "en", source if source is not None else rng.choice("abc"), len(text or ""), "mine", 7))
        if i is not None:
            labels.append((i, quality, 0))

    for i in range(240):
        add(i, say(rng.randint(20, 60)))
    for i in range(240, 360):
        add(i, " ".join(rng.choice(["$$$", "!!!!", "0000", "###", "CLICK!!!"]) for _ in range(30)), 0)
    base = say(80)
    for i in range(360, 380):  # near copies, and exact ones
        add(i, base.replace(base.split()[i % 40], "changed", 1) if i % 2 else base)
    for i in range(380, 388):
        add(i, say(9) + " " + ITEM.replace("48", str(i)) + " " + say(9))
    add(390, say(30)), add(390, say(30)), add(391, base), add(391, say(40))
    rows += [rows[5]] * 3
    add(None, say(12)), add(392, None, 0), add(393, "", 0), add(394, "q" * 200_000 + " " + say(3000))
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_and_run(spark, folder):
    docs, kept = table(spark, folder, "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = corpus_pipeline.Scratch(spark, "test").write(stage(spark, docs, folder), name)
        assert name == "token_output" or out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        assert name == "token_output" or set(after) <= set(before)
        CHECKS[name](before, after)
        docs, kept = out, after
    again = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in again) == Counter((r[0], r[2], r[3]) for r in kept)
    empty = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def quality(before, after):
    """Junk goes, prose stays, also rows that were never labelled for learning; rows go by their text alone."""
    gone = Counter(before) - Counter(after)
    junk = lambda r: bool(r[1]) and r[1][0] in "$!0#C"
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0
    for part in (held, lambda r: not held(r)):
        rows = [r for r in before if r[1] and part(r) and len(r[1]) < 1000]
        assert np.mean([(r in gone) == junk(r) for r in rows]) > 0.97
    assert not {r[1] for r in gone} & {r[1] for r in after}


def near(before, after):
    """One row of each group of equal or near texts stays, that of the smallest id; every other row stays."""
    distinct = {}
    for r in before:
        distinct.setdefault((r[0], r[1]), r)
    keys = sorted((k for k in distinct if k[0] is not None), key=lambda k: (k[0], zlib.crc32((k[1] or "").encode())))
    low = classes(list(enumerate(t for _, t in keys)))
    head = {}
    for n, (i, _) in enumerate(keys):
        group = low[n][1] if low[n][0] else ("alone", n)
        head[group] = min(head.get(group, i), i)
    got = Counter(r[0] for r in after if r[0] is not None)
    want = Counter(head.values())
    for i, text in keys:  # rows without a word aren't linked, so repeated ones stay
        if not (text or "").split():
            want[i] += sum(r[:2] == (i, text) for r in before) - 1
    assert got == want and sum(r[0] is None for r in after) == sum(r[0] is None for r in before)


def leaks(before, after):
    held = {r[0] for r in before if r[1] and re.sub(r"\d+", "N", ITEM) in re.sub(r"\d+", "N", r[1])}
    assert Counter(after) == Counter(r for r in before if r[0] not in held) and held


def mixed(before, after):
    sizes, taken = Counter(), Counter()
    for rows, count in ((before, sizes), (after, taken)):
        for r in rows:
            count[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    assert max(Counter(after).values()) <= 3 * max(Counter(before).values())
    # a source comes as near its target as its documents' sizes let it
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in sizes), (sizes, taken, want)


def tokens(before, after):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    coded = [(r[0], [*made.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in before]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in coded)
    assert Counter((r[0], r[2], r[3]) for r in after) == want
    starts = sorted((r[1], r[2]) for r in after)
    assert all(b[0] == a[0] + a[1] for a, b in zip(starts, starts[1:])) and starts[0][0] == 0


CHECKS = {"quality_classifier": quality, "near_dedup": near, "benchmark_decontamination": leaks, "source_mixing": mixed, "token_output": tokens}
