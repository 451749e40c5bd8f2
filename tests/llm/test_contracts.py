"""Operators against plain Python: whole results, edge cases, and failures reproduced before they were mended."""

import datetime
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelloom.llm import ann, decontam, mixing, neardup, notices, pseudonyms, quality, ransfile, urlfilter, warc
from kernelloom.llm.queries import tokenizer_path
from kernelloom.llm.shared import write_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- op1 ----------------------------------------------------------------------------------------------


def test_near_duplicates_of_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (7, a + " more"), (7, b), (7, b), (None, a), (9, "x " * 40_000), (10, "x " * 40_000), (11, "")]
    df = frame(spark, [(*r, "clash") for r in rows], "doc_id long, text string, group string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect())
    assert got == Counter({(3, 56, 3, True): 1, (7, 57, 3, False): 1, (7, 56, 7, True): 2, (None, 56, None, True): 1, (9, 1, 9, True): 1, (10, 1, 9, False): 1, (11, 0, 11, True): 1})


# -- op2 ----------------------------------------------------------------------------------------------


def brute_neighbours(rows, queries, k=5):
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)]
    dim = min(Counter(len(v) for _, v in use).items(), key=lambda c: (-c[1], c[0]))[0]
    use = [(i, v) for i, v in use if len(v) == dim]
    out = []
    for q, v in dict(use).items():
        if queries(q):
            scores = {}
            for i, w in use:
                if i != q:
                    scores[i] = max(scores.get(i, -9), float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))))
            best = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
            out += [(q, r + 1, i, pytest.approx(s)) for r, (i, s) in enumerate(best)]
    return sorted(out, key=lambda r: r[:2])


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(60)] + [(100, [1.0, 2.0, 3.0, 4.0, 5.0])]
    rows += [(200, [0.0] * 5), (201, None), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (204, [1.0, 2.0]), (205, []), (None, [1.0] * 5)]
    df = frame(spark, [(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, near string")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_neighbours(rows, lambda i: i % 20 == 0)


def test_recall_beyond_the_rerank(spark):
    v = np.random.default_rng(0).normal(size=(20_000, 64)).astype(np.float32)
    df = frame(spark, [(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 200 == 0, code_block=4096).toPandas()
    unit, hit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None], 0
    for q, own in got.groupby("query_id"):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(set(np.argsort(-s)[:5]) & set(own["vec_id"]))
    assert len(got) == 500 and hit / 500 >= 0.9


# -- op3 ----------------------------------------------------------------------------------------------


def brute_targets(sizes, repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level >= repeats * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in free}
        capped |= {s: float(repeats * sizes[s]) for s in over}


def test_mixing_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.lognormvariate(3, 1)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(1000, "same text of five", "b")] * 90 + [(None, "no id here", "c")] * 7 + [(2000, None, "b"), (2001, "", "a"), (2002, "long " * 60_000, "a")]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, source string, copies int")
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = brute_targets(sizes)
    plan = mixing.mix_plan(df).collect()
    assert sum(r.n for r in plan) == len(rows)
    taken = Counter()
    for r in plan:
        assert (r.source_size, r.target) == (sizes[r.source], pytest.approx(want[r.source])) and 0 <= r.more < max(r.n, 1)
        assert r.copies + (r.more > 0) <= 3
        taken[r.source] += r.size * (r.copies * r.n + r.more)
    # rates of one source fall or rise with size alone (the tilt), but for rounding
    assert all(abs(taken[s] - want[s]) <= max(5, 0.001 * want[s]) for s in ("b", "c", None)) and abs(taken["a"] - want["a"]) <= 60_000
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    got = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    keyed = {(r.id, r.source, r.size): r.copies * r.n + r.more for r in plan}
    assert got == Counter({k: n for k in set(rows) if (n := keyed[(k[0], k[2], len(WORD.findall(k[1] or "")))])})
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_entropy_balance_is_exponential(spark):
    df = frame(spark, [(i, "w " * (1 + i % 37), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    by = defaultdict(list)
    for r in mixing.mix_plan(df).collect():
        by[r.source, r.size].append(r.copies)
    for source in "ab":
        x = np.array(sorted(s for o, s in by if o == source))
        rate = np.array([np.mean(by[source, s]) for s in x])
        fit = np.polyfit(x, np.log(np.maximum(rate, 1e-9)), 1)
        assert np.abs(np.exp(np.polyval(fit, x)) - rate).max() < 0.1


# -- op4 ----------------------------------------------------------------------------------------------


def plain_tokens(text):
    marked = re.sub(r"(?<=[a-zà-ÿ,;])(\s+)([A-Z][a-z]+)", "\\1\ue000\\2", text or "").lower()
    return re.findall("\ue000?[a-zà-ÿ]+|[0-9]+(?:[.,][0-9]+)*", marked)


def slot(t):
    return "<num>" if t[0].isdigit() else "<name>" if t[0] == "\ue000" else "<unit>" if t in decontam.UNITS else ""


def brute_found(doc, item, width=8, literals=5, share=0.5, run=13):
    """(windows, reworded) of an item in a document, by comparing all windows of both."""
    d, t = plain_tokens(doc), plain_tokens(item)
    if len(t) < 5:
        return None
    w = min(len(t), width)
    bare, form = (lambda x: [y.lstrip("\ue000") for y in x]), (lambda x: [slot(y) or y for y in x])
    loose = lambda x: sum(map(bool, map(slot, x))) > w - w * literals // width
    lines = defaultdict(list)
    for q in range(len(t) - w + 1):
        for p in range(len(d) - w + 1):
            a, b = t[q : q + w], d[p : p + w]
            slots = lambda x: [y for y in x if slot(y)]
            if bare(a) == bare(b):
                lines[p - q].append((q, True, tuple(zip(slots(a), slots(a)))))
            if not loose(a) and not loose(b) and form(a) == form(b):
                lines[p - q].append((q, False, tuple(zip(slots(a), slots(b)))))
    windows, reworded, long = set(), False, False
    for hits in lines.values():
        pairs = {x for h in hits for x in h[2]}
        several = {a for a, n in Counter(a for a, _ in pairs).items() if n > 1}
        kept = [h for h in hits if h[1] or not any(a in several for a, _ in h[2])]
        if not kept:
            continue
        windows |= {h[0] for h in kept}
        reworded |= any(a != b for a, b in pairs)
        for only_exact in (False, True):
            places = sorted({h[0] for h in kept if h[1] or not only_exact})
            for i, q in enumerate(places):
                j = i
                while j + 1 < len(places) and places[j + 1] == places[j] + 1:
                    j += 1
                span = t[q : places[j] + w]
                long |= (len(span) if only_exact else sum(not slot(y) for y in span)) >= run
    distinct = {q: (tuple(bare(t[q : q + w])) if loose(t[q : q + w]) else tuple(form(t[q : q + w])), q) for q in range(len(t) - w + 1)}
    return (len(windows), reworded) if windows and (len(windows) / len(distinct) >= share or long) else None


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocab = "the farmer sold ripe apples while rain fell on market stalls near old mills and boats carried grain past quiet towns".split()
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = {}
    for i in range(12):
        n = rng.choice([3, 6, 9, 20, 40])
        words = say(n).split()
        for j in range(0, n, 5):
            words[j] = rng.choice([str(rng.randint(1, 99)), "Kent", "kg", words[j]])
        items[i] = " ".join(words)
    docs = {}
    for i in range(90):
        text = items[rng.randrange(12)]
        kind = i % 6
        if kind == 1:
            text = re.sub(r"\d+", lambda m: str(int(m[0]) + 3), text).replace("Kent", "Devon")
        elif kind == 2:
            text = " ".join(w for w in text.split() if rng.random() > 0.1)
        elif kind == 3:
            text = " ".join(text.split()[rng.randint(0, 8) :][: rng.randint(5, 30)])
        elif kind == 4:
            text = re.sub(r"\d+", lambda m: str(rng.randint(1, 5)), text)
        elif kind == 5:
            text = text.upper().replace(" ", " \n")
        docs[i] = f"{say(rng.randint(0, 9))}. {text} {say(rng.randint(0, 9))}"
    df = frame(spark, list(docs.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.reworded) for r in decontam.contaminated(df, frame(spark, list(items.items()), "item_id long, text string")).collect()}
    want = {(d, i): f for d, text in docs.items() for i, item in items.items() if (f := brute_found(text, item))}
    assert got == want and len(want) > 30


def test_decontamination_of_odd_rows(spark):
    item = "how many baskets of 48 apples were sold on that day in autumn"
    rows = [(1, "1," * 30_000 + "2"), (2, "x " * 200_000 + item), (3, None), (4, ""), (None, item), (5, item), (5, "clean words"), (5, item)]
    df = frame(spark, [(*r, "y") for r in rows], "doc_id long, text string, found_id string")
    bench = frame(spark, [(7, item), (7, item), (None, item), (8, "too short"), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(df, bench).collect()) == [(2, 7), (5, 7)]
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(str(r.doc_id) for r in clean.collect()) == ["1", "3", "4", "None"]
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.decontaminate(df, bench.limit(0)).count() == len(rows)


def test_items_of_few_tokens_are_found_as_whole_texts(spark):
    rng = random.Random(4)
    words = ["Yes", "no", "Oslo", "42", "1,000", "km", "the", "Été"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {i: say(rng.choice([0, 1, 2, 3, 4, 4, 5, 6])) for i in range(60)}
    docs = {i: say(rng.randint(0, 7)) for i in range(300)}
    docs |= {300 + i: rng.choice(["  {}.", "\n{}\t!", "«{}»"]).format(rng.choice([t, t.upper(), t.lower(), t.replace(" ", "  ")])) for i, t in items.items()}
    docs |= {400: "Yes " * 50_000, 401: "-" * 100_000 + " yes " + "!" * 100_000, 402: "1,000" * 1, 403: "1, 000", 404: "", 405: None}
    items |= {60: "yes", 61: "1,000", 62: "?!", 63: None}
    df, bench = frame(spark, list(docs.items()) * 2, "doc_id long, text string"), frame(spark, list(items.items()) + [(60, "yes"), (None, "yes")], "item_id long, text string")
    found = decontam.contaminated(df, bench).collect()
    low = lambda t: tuple(x.lstrip(decontam.NAME) for x in plain_tokens(t or ""))
    want = {(d, i) for d, text in docs.items() for i, item in items.items() if 0 < len(low(item)) < 5 and low(text) == low(item)}
    want_long = {(d, i) for d, text in docs.items() for i, item in items.items() if text and item and len(low(item)) >= 5 and brute_found(text, item)}
    got = [(r.doc_id, r.item_id) for r in found]
    assert len(got) == len(set(got)) and set(got) == want | want_long and len(want) > 60 and want_long
    assert (401, 60) in want and (402, 61) in want and not any(d in (400, 403, 404, 405) for d, _ in want)
    short = bench.where("item_id in (60, 61)")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(df, short).collect()} == {p for p in want if p[1] in (60, 61)}
    left = {r.doc_id for r in decontam.decontaminate(df, short).collect()}
    assert left == set(docs) - {d for d, i in want if i in (60, 61)}


# -- op5 ----------------------------------------------------------------------------------------------


def test_token_files_of_odd_rows(spark, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab .,'\x01\x1c\x85\xa0é\u0301İſ1२½中|<>\n\t\u030cJ") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    texts += [None, "", "<|endoftext|> x<|endoftext|>y", "word " * 100_000, "same", "same"]
    rows = [(i // 3 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = frame(spark, [(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(5)
    scratch, folder = ransfile.Scratch(spark, "odd"), str(tmp_path / "files")
    manifest = ransfile.write_token_files(df, folder, tokenizer_path(), 49408, scratch, shard_tokens=20_000)
    assert manifest.count() > 3
    ids = lambda t: [*made.encode(t or "", add_special_tokens=False).ids, 1]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [ids(t)])
    got = sorted(ransfile.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    # one block alone; a damaged block is found, and the others still read
    first = manifest.orderBy(F.desc("tokens")).first()
    path = tmp_path / "files" / first.file
    table = (tmp_path / "files" / "table.rans").read_bytes()
    coder, crc, data = ransfile.Coder(ransfile.read_table(table)), zlib.crc32(table), bytearray(path.read_bytes())
    whole = ransfile.read_shard(bytes(data), coder, crc)[2]
    shard = ransfile.parse_shard(bytes(data), crc)
    assert len(shard.first) > 1
    for k in range(len(shard.first)):
        assert (ransfile.read_block(shard, k, coder) == whole[k * shard.block : (k + 1) * shard.block]).all()
    data[len(data) - 4 - 4 * len(shard.words) + 4 * int(shard.first[-1])] ^= 64
    with pytest.raises(ValueError):
        ransfile.read_shard(bytes(data), coder, crc)
    hurt = ransfile.parse_shard(bytes(data), crc, whole=False)
    assert (ransfile.read_block(hurt, 0, coder) == whole[: shard.block]).all()
    with pytest.raises(ValueError):
        ransfile.read_block(hurt, len(shard.first) - 1, coder)
    with pytest.raises(ValueError):
        ransfile.parse_shard(bytes(shard.words.tobytes()), crc)


def test_other_tokenizers_get_whole_texts(tmp_path):
    import pyarrow as pa
    import public_tokenizers

    e = ransfile.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert e.mark is None
    text = "two  words\n and more"
    assert np.frombuffer(e.encode(pa.array([text]), b"")[0], "<u2").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


# -- op6 ----------------------------------------------------------------------------------------------


def pseudonyms_of(spark, texts):
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pseudonyms.pseudonymise(df, "key").collect()}


def test_permutations_keep_values_apart(spark):
    days = [datetime.date(2001, 1, 1) + datetime.timedelta(i) for i in range(1500)]
    kinds = {
        "slash": [f"{d:%m/%d/%Y}" for d in days] + [f"{d:%d/%m/%Y}" for d in days if d.day > 12],
        "iso": [f"{d:%Y-%m-%d}" for d in days],
        "ssn": [f"{a:03d}-{b:02d}-{c:04d}" for a in (1, 250, 665, 899) for b in (1, 99) for c in range(1, 60)],
        "phone": [f"({a}) 555-{i:04d}" for a in (212, 987) for i in range(300)],
        "ip": [f"10.0.{i}.{j}" for i in range(20) for j in range(20)],
        "email": [f"{a}@x.org" for a in "abcdefghijklmnopqrstuvwxyz"] + [f"{a}{b}@x.org" for a in "abcdxyz" for b in "ABCXYZ019"],
        "hex": [f"key='{i:08x}deadbeef'" for i in range(300)],
        "intl": [f"+49 30 {i:08d}" for i in range(300)],
        "trunk": [f"0171 {i:07d}" for i in range(300)],
        "key": [f"AKIA{i:016d}" for i in range(200)],
    }
    texts = [f"see {t} now" for v in kinds.values() for t in v]
    got = pseudonyms_of(spark, texts)
    again = pseudonyms_of(spark, [r.text for _, r in sorted(got.items())])
    at = 0
    for kind, values in kinds.items():
        own = [got[at + i] for i in range(len(values))]
        new = [r.text for r in own]
        assert len(set(new)) == len(values), kind
        assert all(r.n_private == 1 for r in own) and all(again[at + i].private_kinds == own[i].private_kinds for i in range(len(values))), kind
        shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", t)))
        assert kind in ("ip",) or all(shape(a) == shape(f"see {b} now") for a, b in zip(new, values)), kind
        at += len(values)


def test_pseudonyms_validate(spark):
    keep = ["000-12-3456", "666-12-3456", "987-65-4320", "123-00-4567", "123-45-0000", "v2.0.0.1", "version 2.0.0.1", "300.1.1.1", "13/13/2020", "2021-02-30", "4111 1111 1111 1112", "ES90 2100 0418 4502 0005 1332", "(123) 555-0000", "911 555 0000"]
    for text, r in zip(keep, [r for _, r in sorted(pseudonyms_of(spark, keep).items())]):
        assert (r.text, r.n_private) == (text, 0), text
    card = pseudonyms_of(spark, ["4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"])
    digits = [int(c) for c in card[0].text if c.isdigit()]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    plain = card[1].text.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_pseudonyms_of_odd_rows(spark):
    rows = [(1, "x@b" + ".a" * 20_000), (2, "A" * 60_000), (3, "1 " * 30_000), (4, None), (5, ""), (None, "10.0.0.1"), (6, "ip 10.0.0.1"), (6, "ip 10.0.0.1")]
    df = frame(spark, [(*r, "h", "f", "n") for r in rows], "doc_id long, text string, hit string, found string, n_private string")
    out = pseudonyms.pseudonymise(df, "key")
    assert out.columns[:4] == ["doc_id", "text", "hit", "found"] and {(r.hit, r.found) for r in out.collect()} == {("h", "f")}
    got = [(r.doc_id, r.text, r.n_private) for r in out.collect()]
    assert got[0][1] == got[0][1][0] + "@b" + ".a" * 20_000 and [g[2] for g in got] == [1, 0, 0, 0, 0, 1, 1, 1]
    assert got[3][1] is None and got[4][1] == "" and got[6][1] == got[7][1] == "ip " + got[5][1]
    assert pseudonyms.pseudonymise(df.limit(0), "key").count() == 0


# -- op7 ----------------------------------------------------------------------------------------------


def edit_ends(notice, text, k):
    """{end: fewest edits} of substrings of the text within k edits of the notice (Sellers' recursion)."""
    row = list(range(len(notice) + 1))
    out = {}
    for j, c in enumerate(text, 1):
        new = [0]
        for i, d in enumerate(notice, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (c != d)))
        row = new
        if row[-1] <= k:
            out[j] = row[-1]
    return out


def test_fuzzy_notices_against_brute_force():
    rng = random.Random(3)
    scanner = notices.Scanner(notices.NOTICES)
    for _ in range(60):
        text = ""
        for _ in range(rng.randint(1, 5)):
            n = rng.choice(notices.NOTICES)
            own = list(n.text)
            for _ in range(rng.randint(0, n.edits + 2)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["q"], [own[at], "z"]])
            text += "".join(own) + rng.choice([" ", "", " and then some other words ", " the "])
        text = " ".join(text.split())
        found = scanner.fuzzy(text)
        assert found == scanner.fuzzy(text)
        for n in notices.NOTICES:
            ends = edit_ends(n.text, text, n.edits)
            spans = [(a, b, e) for label, a, b, e in found if label == n.label]
            for end in ends:  # each match is found, or overlaps one that is
                assert any(a < end and b > end - len(n.text) - n.edits for a, b, _ in spans), (n, text)
        for label, a, b, e in found:  # each span is within its edits
            assert any(n.label == label and edit_ends(n.text, text[a:b], n.edits).get(b - a, 99) <= e <= n.edits for n in notices.NOTICES)


def test_neighbouring_notices_are_both_found():
    scanner = notices.Scanner(notices.NOTICES)
    assert scanner.fuzzy("licensed under the mit licence licensed under the mit license") == [("mit", 0, 30, 1), ("mit", 31, 61, 0)]
    assert [f[3] for f in scanner.fuzzy("licensd undr the mit license licensed under the mit license")] == [2, 0]


def test_base_phrases_against_brute_force(spark):
    rng = random.Random(5)
    parts = ["mit", "MIT", "license", "License,", "apache", "general", "public", "licé", "mit license", "GENERAL public-license", "\x00", "é", ""]
    texts = [rng.choice([" ", "\n", "--"]).join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)] + [None, "", "mit license " * 30_000]
    df = frame(spark, [(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    for r in notices.digest(notices.scan_notices(df)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id] or ""))
        hits = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        labels = ",".join(sorted({x for _, x in hits}))
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(hits), labels)
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert notices.scan_notices(df.limit(0)).count() == 0


# -- op8 ----------------------------------------------------------------------------------------------


def test_quality_of_odd_rows(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(["good", "clear", "prose"] if i % 2 else ["zz!!", "11", "$$$"]) for _ in range(30))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "word " * 300_000), (403, "good clear prose"), (403, "zz!! 11 $$$"), (None, "good clear")]
    df = frame(spark, [(*r, "mine") for r in rows], "doc_id long, text string, quality_score string")
    labels = frame(spark, [(i, i % 2) for i in range(300)] + [(403, 1), (None, 0), (1, 7)], "doc_id long, quality int")
    model = quality.fit(df, labels, ~quality.held_out())
    out = quality.score(df, model, out="own").collect()
    scores = {(r.doc_id, r.text): r.own for r in out}
    assert len(out) == len(rows) and all(0 <= r.own <= 1 for r in out) and {r.quality_score for r in out} == {"mine"}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(scores[rows[i]] >= 0.5) == (i % 2 == 1) for i in held]) > 0.95
    assert scores[(403, "good clear prose")] > scores[(403, "zz!! 11 $$$")]


def test_pooling_in_blocks_equals_one_pass():
    texts = ["a b c", "", None, "The the THE. 12 é! " * 4000, "x" * 300_000 + " y"]
    index = quality.index_table()
    got = quality.pool(texts, index, index)
    for i, text in enumerate(texts):
        letters, shape, first = quality.word_slots([(text or "").encode()])
        want = np.concatenate([index[letters].mean(0), index[letters].mean(0), index[shape].mean(0)]) if len(letters) else np.zeros(3 * quality.DIM)
        assert got[i, : 3 * quality.DIM] == pytest.approx(want, abs=5e-5)


# -- op9 ----------------------------------------------------------------------------------------------


def test_url_verdicts_against_brute_force(spark):
    hosts = ["net", "a.net", "example.net", "x.example.net", "notexample.net", "EXAMPLE.com", "www.example.com", "org", "b.org", "casino-bonus.example.org", "", "a:80"]
    paths = ["", "/", "/en/", "/en/1", "/de/2?x", "/fr/#f", "/fr", "?q=/fr/", "#/de/", "/ä/" + "p" * 5000]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/net/", "a://b://c/d", "http://x\n.net/a\nb", "://"]
    df = frame(spark, [(i, u, "x") for i, u in enumerate([*urls, *urls[:5]])], "page_id long, url string, score string")
    w, b = urlfilter.train()
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    got = urlfilter.judge_urls(df).collect()
    assert len(got) == len(urls) + 5
    for r in got:
        url = ([*urls, *urls[:5]])[r.page_id]
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in rules if (host == (h := x.partition("/")[0]) or host.endswith("." + h)) and path.startswith(x[len(h) :])]
        rule = max(fits, key=len, default=None)
        z = sum(w[g] for g in {zlib.crc32(f"{k}{t[i:i + n]}".encode()) % urlfilter.WEIGHTS for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)})
        n = len(urlfilter.grams(host, path))
        score = 1 / (1 + np.exp(-(z / np.sqrt(n) + b))) if host else 0.0
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.score == pytest.approx(score, abs=1e-5)
        assert r.verdict == (rules[rule] if rule else "block" if score >= 0.5 else "allow")
    assert urlfilter.judge_urls(df.limit(0)).count() == 0


def test_url_model_on_held_out_urls():
    """Precision and recall of both classes, on urls that neither the weights nor the cut have seen."""
    train, rest = urlfilter.held_out(urlfilter.LABELLED)
    w, b = urlfilter.train(tuple(train))
    said = np.array([(w[(g := urlfilter.grams(h, p))].sum() / np.sqrt(len(g)) + b) >= 0 for h, p, _ in rest])
    truth = np.array([bool(y) for *_, y in rest])
    assert len(rest) > 60 and min(truth.sum(), (~truth).sum()) > 25
    for label in (True, False):
        recall, precision = (said[truth == label] == label).mean(), (truth[said == label] == label).mean()
        assert recall >= 0.8 and precision >= 0.8, (label, recall, precision)


def test_no_url_of_the_table_is_of_a_test_table(spark):
    hosts = {h for h, _, _ in urlfilter.LABELLED}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seen = {r.host for r in urlfilter.judge_urls(pages).select("host").distinct().collect()}
    assert not hosts & seen and not any("example" in h for h in hosts)


def test_urls_of_odd_ids(spark):
    df = frame(spark, [(None, "http://a.net/x"), (None, None), (1, "http://www.a.net/\x00y")], "page_id long, url string")
    got = Counter((r.page_id, r.host, r.rule) for r in urlfilter.judge_urls(df).collect())
    assert got == Counter([(None, "a.net", "net/"), (None, "", None), (1, "www.a.net", "net/")])


# -- op10 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives_of_odd_rows(spark, broadcast):
    long = "ü" * 700
    rows = [(1, " u\t", long), (2, None, long), (2, "%20x", long), (None, "n", long), (3, "a\r\nb", "s"), (4, "c", "s"), (5, "", None), (6, "h", ""), (7, "z", "q" * 3_000_000), (8, "z", long)]
    df = frame(spark, [(*r, "x") for r in rows], "page_id long, url string, html string, top string")
    scratch = warc.Scratch(spark, "odd")
    folder = scratch.folder("archives")
    files = warc.write_archives(warc.plan_records(df, scratch, broadcast=broadcast), folder, limit=2000)
    # a file that a lost attempt left isn't read
    write_file(f"{folder}/part-000000-0000-ff-dead.warc.gz", warc.gzip_member(warc.record_bytes(99, "u", b"", "response", None, hashlib.sha1(b"").hexdigest(), 0)))
    got = warc.read_archives(files, folder).collect()
    assert {r.kind for r in got} == {"record"}
    want = Counter()
    for i, u, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 1000 and i is not None and h == long and i < 8
        want[i, u or "", len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 8 if again else None, b"" if again else raw] += 1
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_salvage_of_plain_and_cut_files():
    record = lambda i: warc.record_bytes(i, "u", b"p" * 50, "response", None, hashlib.sha1(b"p" * 50).hexdigest(), 50)
    cases = {
        "junk in front": (b"junk \x1f\x8b\x08 more" + warc.gzip_member(record(1)) + record(2), [1, 2]),
        "plain, cut": (record(1) + record(2)[:-30] + record(3) + record(4)[:40], [1, 3]),
        "packed, cut": (warc.gzip_member(record(1)) + warc.gzip_member(record(2))[:-9], [1]),
        "empty": (b"", []), "nothing": (b"\x1f\x8b\x08" * 50, []),
    }
    for name, (data, ids) in cases.items():
        found = list(warc.salvage(data))
        assert [f[3]["page_id"] for f in found if f[0] == "record"] == ids, name
        assert b"".join(data[f[1] : f[2]] for f in found) == data, name


def test_many_damaged_members_cost_no_more_than_sound_ones():
    member = warc.gzip_member(warc.record_bytes(1, "u", b"p" * 400, "response", None, hashlib.sha1(b"p" * 400).hexdigest(), 400))
    hurt = bytearray(member)
    hurt[-6] ^= 1
    data = bytes(hurt) * 8000 + member
    began = time.perf_counter()
    found = list(warc.salvage(data))
    assert time.perf_counter() - began < 5
    assert [f[:3] for f in found] == [("gap", 0, 8000 * len(member)), ("record", 8000 * len(member), len(data))]
    plain = warc.record_bytes(2, "u", b"", "response", None, hashlib.sha1(b"").hexdigest(), 0)
    data = b"WARC/1.1\r\nWARC-Type: response\r\n" * 20_000 + plain
    began = time.perf_counter()
    assert [f[0] for f in warc.salvage(data)] == ["gap", "record"] and time.perf_counter() - began < 5
    # a member that unpacks to more than it may is damaged
    bomb = warc.gzip_member(warc.record_bytes(3, "u", b"0" * 100_000, "response", None, hashlib.sha1(b"0" * 100_000).hexdigest(), 100_000))
    assert [f[0] for f in warc.salvage(bomb, most=50_000)] == ["gap"] and [f[0] for f in warc.salvage(bomb)] == ["record"]


def test_a_round_trip_with_a_gap_raises(spark):
    df = frame(spark, [(i, f"http://a/{i}\x00", "text " * i) for i in range(30)], "page_id long, url string, html string")
    assert {r.url for r in warc.verified_round_trip(df).collect()} == {f"http://a/{i}\x00" for i in range(30)}
    scratch = warc.Scratch(spark, "gaps")
    folder = scratch.folder("archives")
    files = warc.write_archives(warc.plan_records(df, scratch), folder)
    assert warc.whole(warc.read_archives(files, folder), files).count() == 30
    name = files.first().file
    data = bytearray(warc.read_file(f"{folder}/{name}"))
    data[len(data) // 2] ^= 255
    write_file(f"{folder}/{name}", bytes(data))
    with pytest.raises(ValueError, match="gaps"):
        warc.whole(warc.read_archives(files, folder), files)


def test_many_notices_in_one_text(spark):
    text = "x licensed under the mit license, " * 100_000
    df = frame(spark, [(1, text), (None, "All rights reserved")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in notices.scan_notices(df).collect()}
    assert time.perf_counter() - began < 60
    assert [(m.first_word, m.last_word) for m in got[1].fuzzy[:2]] == [(1, 5), (7, 11)] and len(got[1].fuzzy) == 100_000
    assert got[1].fuzzy[-1].last_word == 599_999 and [m.label for m in got[None].fuzzy] == ["proprietary"]


def test_shards_of_one_task(spark, monkeypatch):
    """Fewer tasks than shards: a task writes several files, and they read back in order."""
    df = frame(spark, [(i, f"word{i} and more words of number {i} " * 20) for i in range(1500)], "doc_id long, text string")
    want = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in ransfile.token_file_index(df, tokenizer_path()).orderBy("doc_id").collect()]
    monkeypatch.setattr(ransfile, "MOST_TASKS", 2)
    scratch = ransfile.Scratch(spark, "shards")
    folder = scratch.folder("files")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        manifest = ransfile.write_token_files(df, folder, tokenizer_path(), 49408, scratch, shard_tokens=10_000)
        back = ransfile.read_token_files(spark, folder).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 4 and manifest.select("part").distinct().count() == 2
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in back] == want
    assert [r.shard for r in back] == sorted(r.shard for r in back)


@pytest.mark.parametrize("rows", [
    [(i, "w " * (1 + i % 9), "one") for i in range(200)],
    [(i, "w " * (1 + i % 9), None) for i in range(50)],
    [(1, "", "a"), (2, None, "b"), (3, " \t", None), (4, "", "a")],
])
def test_mixes_of_one_source_or_without_words(spark, rows):
    got = mixing.mix_plan(frame(spark, rows, "doc_id long, text string, source string")).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    assert {r["id"]: r["size"] for r in got} == size and sum(r["n"] for r in got) == len(rows)
    copies = [(r["n"] * r["copies"] + r["more"], r["n"], r["size"]) for r in got]
    assert all(0 <= c <= 3 * n and (c == 0 or z) for c, n, z in copies)
    assert abs(sum(c * z for c, _, z in copies) - sum(size.values())) <= max(size.values())
