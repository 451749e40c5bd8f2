"""The set join, conversation repair and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from kernelloom.llm import conversations, resample, setjoin
from kernelloom.llm.words import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# -- op11 ---------------------------------------------------------------------------------------------


def shingles(text, width=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if None not in (sets[a][0], sets[b][0]) and x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = label[a], label[b]
                label = [new if v == old else v for v in label]
    low = defaultdict(list)
    for (i, _), v in zip(rows, label):
        low[v].append(i)
    return Counter((i, len(s), i if i is None else min(low[v])) for (i, s), v in zip(sets, label))


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(words) for _ in range(60)]
    rows, n = [], 0
    for n in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([3, 8, 20, 60, 200, 400]))]
        text = own + passage if n % 3 == 0 else passage[:12] + own if n % 3 == 1 else own
        rows.append((10 * n, " ".join(text)))
        for copy in range(rng.randint(0, 5)):
            near = list(text)
            for _ in range(rng.randint(0, 1 + len(near) // 60)):
                near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((10 * n + 1 + copy, " ".join(near).upper() if copy % 2 else "\t".join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[0][1]), (7, rows[3][1]), (7, rows[9][1]), rows[5], rows[5], (9000, "long " * 30_000), (9001, "long " * 30_001)]
    return rows


@pytest.mark.parametrize("small, block", [(None, None), (0, 4), (45, 4), (90, None)])
def test_set_join_against_brute_force(spark, monkeypatch, small, block):
    rows = corpus()
    if block:
        monkeypatch.setattr(setjoin, "BLOCK", block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, size int")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df, small=small).collect())
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) < len(got) - 20
    if small is None:
        assert setjoin.jaccard_components(df.limit(0)).count() == 0


def test_members_of_one_key_that_miss_its_first_member_are_linked(spark):
    """Three sets share a key with a first member that is similar to none of them."""
    words = [f"q{i}" for i in range(400)]
    rows = [(0, " ".join(words[:100] + [f"a{i}" for i in range(60)])), (1, " ".join(words[:300])), (2, " ".join(words[:299] + ["z"])), (3, " ".join(["y"] + words[:299]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (0, 1000):
        got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(df, small=small).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_similar_sets_share_a_key_and_bitmaps_never_reject_them():
    rng = np.random.default_rng(3)
    frequent = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    for n in (2, 3, 7, 12, 40, 90, 300, 1500):
        for _ in range(30):
            pool = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.choice(frequent, min(n, 30), replace=False)]))
            x = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
            keep = x[np.sort(rng.permutation(len(x))[: max(1, len(x) - int(rng.integers(0, 1 + len(x) // 8)))])]
            y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 12)), dtype=np.uint64)]))
            if len(x) == 0 or not setjoin.similar(x, y, 85):
                continue
            least = min(len(setjoin.bitmap(x)), len(setjoin.bitmap(y)))
            u, v = (setjoin.folded([setjoin.bitmap(s)], least) for s in (x, y))
            assert np.bitwise_count(u ^ v).sum() <= setjoin.most_apart(np.array([len(x) + len(y)]), 85)[0]
            for small in (0, 5, 60, 100, 2000):
                assert len(np.intersect1d(setjoin.keys(x, frequent, 85, small), setjoin.keys(y, frequent, 85, small)))


def test_the_boundary_follows_the_cost():
    assert setjoin.cheapest_boundary({50: 1000, 400: 1000}, 0.0, 85) == 0
    assert setjoin.cheapest_boundary({50: 1000, 4000: 1000}, 400.0, 85) == 50
    assert len(shingle_sets(["a b c d"], 4)[0]) == 1


# -- op12 ---------------------------------------------------------------------------------------------


def brute_damage(rows):
    out = []
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(c, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(ids, rows):
    by = {c: [] for c in ids}
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = []
    for c, own in by.items():
        own.sort(key=lambda r: r[:4])
        turns = [t for has, t, *_ in own if has]
        seen, faults = set(), []
        for _, _, role, _, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
            seen.add((role, text))
        roles = [r[2][:1] for r in own]
        best = {0: (0, "", ())}

        def put(at, state, x):
            if state not in at or x < at[state]:
                at[state] = x

        def inserted(at):
            for _ in range(2):
                for i, j in ((0, 2), (1, 2), (3, 2), (2, 3)):
                    if i in at:
                        put(at, j, (at[i][0] + 3, at[i][1] + "I", (*at[i][2], ("user:" if j == 2 else "assistant:"))))
            return at

        inserted(best)
        for (_, _, role, _, text), fault, a in zip(own, faults, roles):
            now = {}
            for s, (cost, audit, lines) in best.items():
                put(now, s, (cost + 4, audit + "D", lines))
                if fault not in ("blank", "duplicate"):
                    cost += 3 * (fault == "truncated")
                    for i, j, letter in ((0, 1, "s"), (0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a")):
                        if i == s and a == letter:
                            put(now, j, (cost, audit + "K", (*lines, f"{role}:{text}")))
                        if i == s and letter != "s":
                            put(now, j, (cost + 3, audit + "R", (*lines, ("user:" if j == 2 else "assistant:") + text)))
            best = inserted(now)
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def turns_of(seed=5):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Is it?", "", " \n", None, "An answer that breaks off", "Done! ", "ünï.", "x"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "admin"]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = roles[t % 2] if rng.random() < 0.8 else rng.choice(roles)
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, rng.choice(texts) if rng.random() < 0.4 else f"turn {rng.random()}."))
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Nobody."), (None, None, "user", "?"), (999, None, None, None), (-4, 3, "user", "a." * 200_000), (-4, 4, "assistant", "b.")]
    rows += [rows[3]] * 5
    return rows


def test_repair_against_brute_force(spark):
    rows = turns_of()
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "conv_id long, turn long, role string, text string, cost int, C string")
    got = Counter(map(tuple, conversations.repair(df, conversations.damaged(df)).collect()))
    assert got == brute_repair({r[0] for r in rows}, brute_damage(rows))
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert Counter(map(tuple, conversations.repair(df).collect())) == brute_repair({r[0] for r in rows}, plain)
    assert conversations.repair(df.limit(0)).count() == 0


def test_a_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["ok.", f"turn {t}.", f"turn {t}", ""])) for t in range(7000)]
    rows += [(c, t, ["user", "assistant"][t % 2], f"{c} {t}.") for c in range(2, 40) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    got = Counter(map(tuple, conversations.repair(df, conversations.damaged(df)).collect()))
    assert got == brute_repair({r[0] for r in rows}, brute_damage(rows))


def test_products_associate():
    rng = random.Random(2)
    for _ in range(300):
        codes = "".join(rng.choice("Dabcdefgh") for _ in range(rng.randint(2, 14)))
        whole, left = conversations.product(codes), conversations.ONE
        for c in codes:
            left = conversations.times(left, conversations.product(c))
        at = rng.randrange(len(codes))
        assert whole == left == conversations.times(conversations.product(codes[:at]), conversations.product(codes[at:]))


# -- op13 ---------------------------------------------------------------------------------------------


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def brute_draws(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        found, words = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    fit = sorted((-r[3], r[0]) for r in out if r[4] >= 20 and r[0] is not None)
    rank = {key: n + 1 for n, key in enumerate(fit[: 5 * len(fit) // 100])}
    return Counter((i, n, w, s, rank.get((None if s is None else -s, i)) if words >= 20 else None) for i, n, w, s, words in out)


def test_resampling_against_brute_force(spark):
    rng = random.Random(6)
    words = ["Red", "fox", "x1", "été", "漢字", "a", "q" * 90, "runs-on", "7", "é" * 40]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000, None), (1001, ""), (1002, " .,"), (None, "red fox " * 30), (1003, "z" * 200_000 + " fox" * 30_000)]
    target = ["Red fox x1 red fox", None, "été 漢字", ""]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, weight string, rank int")
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    made = resample.importance(df, aims)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in made.collect())
    assert got == brute_draws(docs, target)
    drawn = {i for i, *_, rank in got if rank is not None}
    kept = resample.resample(df, aims)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == drawn and drawn
    assert resample.importance(df.limit(0), aims).count() == 0
    # equal rows are drawn one by one
    same = spark.createDataFrame([(1, "fox " * 20)] * 100, "doc_id long, text string")
    assert sorted(r["rank"] for r in resample.importance(same, aims.limit(0)).where("rank is not null").collect()) == [1, 2, 3, 4, 5]


def test_crcs_of_long_shifts():
    rng = random.Random(1)
    for n in (0, 1, 255, 256, 257, 65_535, 70_000, 1_000_003):
        a, b = rng.randbytes(9), rng.randbytes(n)
        got = resample.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert got == zlib.crc32(a + b)
