"""The training-data operators against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelloom.llm import ann, decontam, mixing, neardup, notices, pseudonyms, quality, ransfile, urlfilter, warc
from kernelloom.llm.queries import QUERIES, table, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and (u := len(sets[a] | sets[b])) and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * u]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i]) for i in ids}


def test_near_duplicates(spark, monkeypatch):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    base = rng.choice(words, 120).tolist()
    docs = [(0, None), (1, ""), (2, " \t"), (3, "a b"), (4, "A B"), (5, "a b c")]
    for i in range(60):
        text = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 6)):
            text[j] = "x"
        docs.append((10 + i, " ".join(text)))
    docs += [(200 + i, " ".join(rng.choice(words, 40))) for i in range(40)] + [(300, "z " * 30_000)]
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 10_000)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    want = classes(docs)
    assert {i: v[:2] for i, v in got.items()} == want and all(k == (c == i) for i, (_, c, k) in got.items())
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_shared_counts_of_sets():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3], [9], [2, 7, 2**63])]
    assert neardup._shared(sets, np.array([2, 3, 2**63], np.uint64)).tolist() == [2, 0, 2]


def test_nearest_neighbours(spark, sf):
    got = QUERIES["op2_anisotropic_ann"](spark, sf).toPandas()
    rows = table(spark, sf, "embeddings").toPandas()
    v = np.array(rows["embedding"].tolist(), float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, hit, n = rows["vec_id"].to_numpy(), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        s[q] = -9
        want = set(ids[np.lexsort((ids, -s))[:5]])
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own["score"].is_monotonic_decreasing
        hit, n = hit + len(want & set(own["vec_id"])), n + 5
    assert hit / n >= 0.9
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [2.0, 0.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest_neighbours(odd, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 4), (0, 5)]
    assert ann.nearest_neighbours(odd.limit(0), F.lit(True)).count() == 0


def test_nearest_neighbours_whatever_the_codebooks_miss(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 16))
    tight = centre[rng.integers(0, 4, 3000)] + 0.001 * rng.normal(size=(3000, 16))
    wide = np.concatenate([3 + 0.1 * rng.normal(size=(3000, 16)), 1e200 * tight[:500]])
    for v in (tight, wide):
        df = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>")
        got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, code_block=1024).orderBy("query_id", "rank").collect()
        u = v / np.abs(v).max(1)[:, None]
        u /= np.linalg.norm(u, axis=1)[:, None]
        want = []
        for q in range(0, len(v), 100):
            s = u @ u[q]
            s[q] = -9
            want += np.sort(s)[:-6:-1].tolist()
        assert [r.score for r in got] == pytest.approx(want, abs=1e-12)


def test_mixing(spark, sf):
    docs = table(spark, sf, "documents")
    got = QUERIES["op3_entropy_mixing"](spark, sf).toPandas()
    rows = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.select("doc_id", "text").collect()}
    assert dict(zip(got["doc_id"], got["size"])) == rows
    assert (got["taken"] <= 3 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert per["target"].sum() == pytest.approx(sum(rows.values())) and (per["target"] <= 3 * per["size"] + 1e-6).all()
    assert (abs(per["taken"] - per["target"]) <= np.maximum(0.01 * per["target"], 60)).all()
    assert sorted(got["taken"]) == sorted(QUERIES["op3_entropy_mixing"](spark, sf).toPandas()["taken"])
    assert mixing.mix_plan(docs.limit(0)).count() == 0


def test_decontamination(spark):
    item = "A farmer in Kent sold 48 baskets of ripe apples on the first market day and half as many baskets on the second day how many baskets were sold altogether"
    other = item.replace("48", "72").replace("Kent", "Devon")
    docs = [(1, "Intro words here. " + item + " and more text follows."), (2, "Something else. " + other), (3, "Nothing of the kind stands in this clean text about gardens and rivers."), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reworded for r in decontam.contaminated(df, bench).collect()}
    assert got == {(1, 7): False, (2, 7): True}
    assert sorted(r.doc_id for r in decontam.decontaminate(df, bench).collect()) == [3, 4, 5]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_whatever_case_and_blanks(spark):
    item = "On Monday in Kent a farmer met Alice near Dover and then in York she paid Bob for apples from Wales while Carol of Leeds saw it"
    short = "What is the largest planet of all"
    docs = [item.lower(), item.upper(), item.replace(" ", "\n"), item.replace(" ", "  "), "everybody asks " + short, item.replace(" ", "  ").replace("Kent", "Devon"), "nothing of the kind"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, short)], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.share, r.reworded) for r in decontam.contaminated(df, bench).collect()}
    assert got == {i: (7, 1.0, False) for i in range(4)} | {4: (8, 1.0, False), 5: (7, 1.0, True)}


def test_decontamination_by_runs_and_inconsistent_slots(spark):
    words = [f"{a}{b}" for a in "barn cold dusk fern gold hawk iris jade".split() for b in "el or us an ix um ay ock".split()]
    item, rest = " ".join(words[:59]), " nothing else of it"
    slots = f"she had 2 apples and {' '.join(words[30:44])} for 2 days {' '.join(words[44:58])} until 9 came"
    docs = {
        1: "intro " + " ".join(words[5:37]) + rest, 2: "intro " + " ".join(words[5:18]) + rest, 3: "intro " + " ".join(words[5:17]) + rest,
        4: slots.replace("2 apples", "3 apples").replace("2 days", "5 days"), 5: slots.replace("2 days", "4 days"), 6: slots.replace("2 ", "6 "),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, slots)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.reworded) for r in decontam.contaminated(df, bench).collect()}
    # items share words 30 to 58, so passages of one may be passages of the other
    assert {(1, 7): (25, False), (2, 7): (6, False)}.items() <= got.items() and not any(d == 3 for d, _ in got)
    assert all(got[(d, 8)][1] for d in (4, 5, 6)) and got[(4, 8)][0] < got[(5, 8)][0] < got[(6, 8)][0]


def test_token_files(spark, sf):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    got = sorted(QUERIES["op5_rans_token_files"](spark, sf).collect(), key=lambda r: r.doc_id)
    docs = sorted(table(spark, sf, "documents").select("doc_id", "text").collect())
    start = 0
    for r, d in zip(got, docs, strict=True):
        ids = np.array([*made.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert ransfile.token_file_index(table(spark, sf, "documents").limit(0), tokenizer_path()).count() == 0


def test_pseudonyms(spark):
    texts = ["Card 4111 1111 1111 1111 and again 4111 1111 1111 1111.", "Card 4111 1111 1111 1111 on 2021-03-04", "clean words only", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, "key").collect()}
    assert "4111 1111 1111 1111" not in got[0] + got[1] and got[2] == "clean words only"
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}", got[0] + got[1])
    assert len(cards) == 3 and len(set(cards)) == 1


def test_pseudonyms_beside_other_numbers(spark):
    card, iban = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
    texts = {
        f"{card} 12/26": [("card", card)], "4111111111111111 123": [("card", "4111111111111111")], f"12 {card}": [("card", card)],
        "room 123 555-123-4567": [("phone", "555-123-4567")], "42 2021-03-04 12345": [("date", "2021-03-04")], f"{iban} BIC": [("iban", iban)],
        f"é {card} 555-123-4567 AB12 {iban} CAIXESBB, 12 {card} end": [("card", card), ("phone", "555-123-4567"), ("iban", iban), ("card", card)],
        "2021-99-99 1234 5678 9012": [], "4111 1111 1111 1112 12/26": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(df, "key").collect()}
    for i, (text, want) in enumerate(texts.items()):
        places, end = [], 0
        for kind, old in want:
            end = text.index(old, end)
            places.append((kind, end + 1))
            end += len(old)
        assert [tuple(p) for p in got[i].private_places] == places, text
        rest = list(text)
        for (_, at), (_, old) in zip(places, want):
            assert got[i].text[at - 1 : at - 1 + len(old)] != old
            rest[at - 1 : at - 1 + len(old)] = got[i].text[at - 1 : at - 1 + len(old)]
        assert "".join(rest) == got[i].text


def test_notices(spark):
    texts = ["Under the MIT License and the MIT license", "the apache license, v2", "nothing", None, "general public  license " + "pad " * 5000]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in notices.digest(notices.scan_notices(df)).collect()}
    assert [(got[i].n_base, got[i].first_word, got[i].base_labels) for i in range(3)] == [(2, 2, "mit"), (1, 1, "apache"), (0, None, "")]
    assert got[3].n_words == 0 and got[4].n_base == 1 and got[4].n_words == 5003


def test_quality(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels").select("doc_id", "quality")
    scored = QUERIES["op8_random_indexing_quality"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").toPandas()
    assert (scored["score"].between(0, 1)).all()
    a, b = scored[scored["quality"] == 1]["score"].to_numpy(), scored[scored["quality"] == 0]["score"].to_numpy()
    assert ((a[:, None] > b[None]).mean() + (a[:, None] == b[None]).mean() / 2) > 0.8
    flat = quality.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert quality.score(docs.limit(3), flat).count() == 3


def test_context_of_all_documents(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gamma", "delta"], rng.integers(0, 9))) for _ in range(50)] + [None, "unlabelled zeta word"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    model, index = quality.fit(docs, labels, F.lit(True), sample=10), quality.index_table()
    slot = lambda w: quality.word_slots([w.lower().encode()])[0][0]
    want = {}
    for text in texts:
        words = (text or "").split()
        for i, w in enumerate(words):
            near = [index[slot(words[j])] for j in range(max(0, i - 2), min(len(words), i + 3)) if j != i]
            want[slot(w)] = want.get(slot(w), 0) + sum(near, np.zeros(quality.DIM))
    for at, v in want.items():
        assert model.context[at] == pytest.approx(v / np.linalg.norm(v), abs=1e-5)
    assert slot("zeta") in want and not np.allclose(model.context[slot("zeta")], index[slot("zeta")])


def test_urls(spark):
    urls = [None, "no scheme", "http://a.NET/x", "https://example.net/en/1?q", "http://www.example.com/de/9#f", "http://x.org/fr/", "http://x.org", "http://notnet/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge_urls(df).collect()}
    assert [got[i] for i in range(8)] == [("", "", None), ("", "", None), ("a.net", "/x", "net/"), ("example.net", "/en/1", "example.net/en/"), ("www.example.com", "/de/9", "example.com/de/"), ("x.org", "/fr/", "org/fr/"), ("x.org", "", None), ("notnet", "/de/", None)]


def test_warc(spark):
    long = "é" * 600
    pages = spark.createDataFrame([(1, "u\r\n", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", long + "x")], "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).where("kind = 'record'").collect()}
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert got[1] == (1200, sha(long), "revisit", 2) and got[2] == (1200, sha(long), "response", None) and got[4][2:] == ("response", None) and got[5][0] == 0 and got[6][2] == "response"


def test_salvage():
    parts = [warc.gzip_member(warc.record_bytes(i, "u", b"p" * 50, "response", None, hashlib.sha1(b"p" * 50).hexdigest(), 50)) for i in range(4)]
    bad = bytearray(parts[1])
    bad[len(bad) // 2] ^= 255
    data = parts[0] + bytes(bad) + parts[2] + parts[3]
    found = list(warc.salvage(data))
    assert [f[0] for f in found] == ["record", "gap", "record", "record"] and [f[3]["page_id"] for f in found if f[0] == "record"] == [0, 2, 3]
    assert found[0][1] == 0 and found[-1][2] == len(data) and all(a[2] == b[1] for a, b in zip(found, found[1:]))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
