"""Cheapest repair of a conversation's structure, as a product of min-plus matrices.

A conversation should read (system)? (user assistant)+, or be empty.  The state is what came last: nothing,
a system turn, a user turn, an assistant turn.  Each turn is a 4 x 4 matrix whose elements (cost, audit)
hold the cheapest way from one state to another that keeps, reroles or deletes the turn and then inserts
what is needed (the closure of the insert matrix); ``+`` is the lesser element, ties to the lesser audit,
and a product adds costs and joins audits.  Two elements of equal cost never have one audit in front of
the other, for they edit the same turns, so lesser parts make lesser wholes and products associate: a
stretch of a conversation becomes one matrix, wherever it is cut.

Rows are sorted by range of conversation, turn, role and text, so that a conversation of any length is
spread over partitions.  One that lies within a partition is repaired there.  Of one that doesn't, each
partition gives a matrix, these are multiplied in a tree, and its turns are read once more, in order,
for the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Allowed neighbours, by the initials of their roles.
LEGAL = ("su", "ua", "au")
#: A conversation of more rows or characters isn't buffered whole.
MOST_ROWS, MOST_CHARS = 4096, 4 << 20
#: Matrices that one step of the tree multiplies.
ARITY = 16

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]
#: Where a user turn and an assistant turn lead: from state to state.
_TO_USER, _TO_ASSISTANT = ((0, 2), (1, 2), (3, 2)), ((2, 3),)


def _lesser(x: Element, y: Element) -> Element:
    return y if x is None else x if y is None else min(x, y)


def times(p: Matrix, q: Matrix) -> Matrix:
    out: list[Element] = []
    for i in range(0, 16, 4):
        for j in range(4):
            best = None
            for k in range(4):
                x, y = p[i + k], q[4 * k + j]
                if x is not None and y is not None and (best is None or x[0] + y[0] <= best[0]):
                    best = _lesser(best, (x[0] + y[0], x[1] + y[1]))
            out.append(best)
    return tuple(out)


def _matrix(*entries: tuple[int, int, int, str]) -> Matrix:
    out: list[Element] = [None] * 16
    for i, j, cost, audit in entries:
        out[4 * i + j] = _lesser(out[4 * i + j], (cost, audit))
    return tuple(out)


ONE = _matrix(*[(i, i, 0, "") for i in range(4)])
_ONCE = _matrix(*[(i, i, 0, "") for i in range(4)], *[(i, j, INSERT, "I") for i, j in _TO_USER + _TO_ASSISTANT])
#: Any number of inserts.
CLOSURE = times(times(_ONCE, _ONCE), _ONCE)

#: A turn's code: its role (system, user, assistant, other) and its state (sound, truncated, to be deleted).
_ROLES, _STATES = "suax", "kt"


def code(initial: str, fault: str) -> str:
    """One letter for a turn: only role and fault decide about its matrix."""
    if fault in ("blank", "duplicate"):
        return "D"
    return chr(97 + 2 * _ROLES.index(initial if initial in ("s", "u", "a") else "x") + (fault == "truncated"))


def _turn(letter: str) -> Matrix:
    entries = [(i, i, DELETE, "D") for i in range(4)]
    if letter != "D":
        role, more = _ROLES[(ord(letter) - 97) // 2], TRUNCATED * ((ord(letter) - 97) % 2)
        keep = {"s": ((0, 1),), "u": _TO_USER, "a": _TO_ASSISTANT, "x": ()}[role]
        entries += [(i, j, KEEP + more, "K") for i, j in keep] + [(i, j, REROLE + more, "R") for i, j in _TO_USER + _TO_ASSISTANT]
    return times(_matrix(*entries), CLOSURE)


@lru_cache(1 << 15)
def _short(codes: str) -> Matrix:
    if len(codes) == 1:
        return _turn(codes)
    half = len(codes) // 2
    return times(_short(codes[:half]), _short(codes[half:]))


def product(codes: str) -> Matrix:
    """The matrix of a stretch of turns, multiplied in a tree."""
    if not codes:
        return ONE
    if len(codes) <= 8:
        return _short(codes)
    half = len(codes) // 2
    return times(product(codes[:half]), product(codes[half:]))


def cheapest(m: Matrix) -> tuple[int, str]:
    """(cost, audit) of the conversation whose turns make m: from nothing to nothing or an assistant turn."""
    row = times((*CLOSURE[:4], *[None] * 12), m)
    return min(x for x in (row[0], row[3]) if x is not None)


class Repair:
    """Repaired lines in order, from the audit and the turns fed to it, into a running hash."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.any = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str | None, text: str) -> None:
        if role is None:
            role = "assistant" if self.state == 2 else "user"
        self.state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(None, "")
            self.at += 1

    def feed(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._line(role if edit == "K" else None, text)

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENT = "c string, part int, n long, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, lo long, hi long, costs array<long>, audits array<string>"
_RESULT = "cost long, audit string, repaired_sha256 string"


def joined(p: dict, q: dict) -> dict:
    """Two neighbouring stretches as one."""
    if not p["n"] or not q["n"]:
        return q if not p["n"] else p
    out = {k: p[k] + q[k] for k in _COUNTS}
    out["illegal"] += p["last"] + q["first"] not in LEGAL
    out["turns"] -= p["hi"] is not None and p["hi"] == q["lo"]
    seen = [t for t in (p["lo"], q["lo"]) if t is not None], [t for t in (p["hi"], q["hi"]) if t is not None]
    return out | {"first": p["first"], "last": q["last"], "lo": min(seen[0], default=None), "hi": max(seen[1], default=None), "matrix": times(p["matrix"], q["matrix"])}


def gaps(s: dict) -> int:
    return 0 if s["lo"] is None else s["hi"] - s["lo"] + 1 - s["turns"]


class _Stretch:
    """Turns of one conversation as they come in one partition."""

    def __init__(self, c: str):
        self.c, self.codes, self.done = c, [], []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.lo = self.hi = None
        self.rows: list | None = []
        self.chars = self.begun = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, new: bool, blank: bool, truncated: bool) -> None:
        k, initial = self.counts, role[:1]
        k["n"] += copies
        k["blank"] += copies * blank
        k["duplicate"] += (copies - new) * (not blank)
        sick = new and not blank and truncated
        k["truncated"] += sick
        k["illegal"] += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        if turn is not None and turn != self.hi:
            k["turns"] += 1
            self.lo, self.hi = turn if self.lo is None else self.lo, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        sound = new and not blank
        self.codes.append((code(initial, "truncated" if sick else "") if sound else "D") + "D" * (copies - 1))
        self.begun += copies
        if self.begun >= MOST_ROWS:
            self._fold()
        if self.rows is not None:
            self.rows.append((role, text, copies))
            self.chars += len(text)
            if k["n"] > MOST_ROWS or self.chars > MOST_CHARS:
                self.rows = None

    def _fold(self) -> None:
        """Matrices of equal weight are multiplied, as the carries of a binary counter."""
        m, weight = product("".join(self.codes)), 1
        self.codes, self.begun = [], 0
        while self.done and self.done[-1][1] == weight:
            m, weight = times(self.done.pop()[0], m), 2 * weight
        self.done.append((m, weight))

    def segment(self) -> dict:
        m = product("".join(self.codes))
        for own, _ in reversed(self.done):
            m = times(own, m)
        return self.counts | {"first": self.first, "last": self.last, "lo": self.lo, "hi": self.hi, "matrix": m}


def _row(c: str, part: int, s: dict) -> dict:
    own = {k: s[k] for k in (*_COUNTS, "first", "last", "lo", "hi")}
    return {"c": c, "part": part, **own, "costs": [-1 if x is None else x[0] for x in s["matrix"]], "audits": ["" if x is None else x[1] for x in s["matrix"]]}


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    out = pd.DataFrame({name: pd.Series([r.get(name) for r in rows], dtype=object) for name in (f.split()[0] for f in schema.split(", "))})
    for field in schema.split(", "):
        name, kind = field.split()
        if kind in ("long", "int"):
            out[name] = out[name].astype("Int64")
    return out


def _stretches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repaired conversations that lie within the partition, and the matrices of the others."""
    schema, part = f"{_SEGMENT}, {_RESULT}", TaskContext.get().partitionId()
    now, whole, out = None, False, []

    def close(last: bool) -> dict:
        s = now.segment()
        if not whole or last or now.rows is None:
            return _row(now.c, part, s)
        cost, audit = cheapest(s["matrix"])
        repair = Repair(audit)
        for role, text, copies in now.rows:
            for _ in range(copies):
                repair.feed(role, text)
        return {"c": now.c, **{k: s[k] for k in (*_COUNTS, "lo", "hi")}, "cost": cost, "audit": audit, "repaired_sha256": repair.digest()}

    for rows in parts:
        for c, kind, has, t, role, text, copies, new, blank, truncated in rows.itertuples(index=False):
            if now is None or c != now.c:
                if now is not None:
                    out.append(close(False))
                now, whole = _Stretch(c), not kind
            if kind:
                now.add(int(t) if has else None, role, text, int(copies), bool(new), bool(blank), bool(truncated))
        if out:
            yield _frame(out, schema)
            out = []
    if now is not None:
        yield _frame([close(True)], schema)


def _segment(r) -> dict:
    own = {k: int(getattr(r, k)) for k in _COUNTS}
    ends = {k: None if pd.isna(getattr(r, k)) else int(getattr(r, k)) for k in ("lo", "hi")}
    names = {k: getattr(r, k) for k in ("first", "last")}
    return own | ends | names | {"matrix": tuple(None if c < 0 else (int(c), a) for c, a in zip(r.costs, r.audits))}


def _multiplied(group: pd.DataFrame) -> pd.DataFrame:
    made, c = None, group["c"].iloc[0]
    for r in group.sort_values("part").itertuples(index=False):
        made = _segment(r) if made is None else joined(made, _segment(r))
    return _frame([_row(c, int(group["part"].iloc[0]) // ARITY, made)], _SEGMENT)


def damaged(turns: DataFrame) -> DataFrame:
    """c, turn, role, text, copies: the test damage of the rows; ``c`` is the id as text, empty for null."""
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    names = [F.coalesce(F.col(c).cast("long").cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(names[0], F.lit(":"), names[1])) % 20
    return turns.select(
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("c"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    ).where("kind <> 0").select("c", "turn", "role", "text", F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def undamaged(turns: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("c"), F.col("turn").cast("long").alias("turn"), *own, F.lit(1).alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """One row for equal rows of a turn, with their number and faults.  A text is known by its hash: it is
    shuffled once, with the least turn that has it, and only that turn's row carries it on."""
    sha = F.unhex(F.sha2("text", 256))
    rows = rows.withColumns({"sha": sha, "has": F.col("turn").isNotNull(), "t": F.coalesce("turn", F.lit(0))})
    texts = rows.groupBy("c", "role", "sha").agg(F.first("text").alias("text"), F.min(F.struct("has", "t")).alias("least"))
    texts = texts.select("c", "role", "sha", "text", F.col("least.has").alias("has0"), F.col("least.t").alias("t0"))
    places = rows.groupBy("c", "role", "sha", "has", "t").agg(F.sum("copies").alias("copies"))
    both = places.join(texts, ["c", "role", "sha"])
    new: Column = (F.col("has") == F.col("has0")) & (F.col("t") == F.col("t0"))
    blank, cut = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return both.select("c", F.lit(1).alias("kind"), "has", "t", "role", "sha", F.when(new, F.col("text")).otherwise("").alias("text"), "copies", new.alias("new"), blank.alias("blank"), cut.alias("truncated"))


def repair(turns: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation
    in ``turns`` (conv_id, turn, role, text), whose ``rows`` (as ``undamaged`` gives them, the default) are
    repaired.

    Rows go by turn, null first, rows of one turn by role and then by their text's SHA-256.  Null roles and
    texts are one space; such a text is blank, and such a role, like any whose initial isn't s, u or a,
    can only be rerolled or deleted.  A null conv_id is a conversation of its own.  Repeated rows are
    duplicates.  A conversation without rows has zeros, an empty audit and the hash of nothing; an empty
    table gives an empty result.  Texts and conversations may be of any length: a conversation's audit is
    one value, and its repaired text is hashed as a stream.  Other columns are ignored.
    """
    spark = turns.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "conversations")
    rows = undamaged(turns) if rows is None else rows
    heads = turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("c")).distinct()
    flag = F.lit(False)
    heads = heads.select("c", F.lit(0).alias("kind"), flag.alias("has"), F.lit(0).cast("long").alias("t"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("sha"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), flag.alias("new"), flag.alias("blank"), flag.alias("truncated"))
    order = ["c", "kind", "has", "t", "role", "sha"]
    judged = heads.unionByName(_judged(rows)).repartitionByRange(*order).sortWithinPartitions(*order).drop("sha")
    made = scratch.write(judged.mapInPandas(_stretches, f"{_SEGMENT}, {_RESULT}"), "stretches")

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    width = F.when(F.col("lo").isNull(), 0).otherwise(F.col("hi") - F.col("lo") + 1 - F.col("turns")).cast("long")
    here = made.where("costs is null").withColumn("gaps", width).select("c", *names)
    apart = made.where("costs is not null").select(*[f.split()[0] for f in _SEGMENT.split(", ")])
    most = apart.agg(F.max("part")).first()[0]
    if most is None:
        return here.select(_id(), *names)
    while True:
        apart = apart.groupBy("c", F.floor(F.col("part") / ARITY).alias("step")).applyInPandas(_multiplied, _SEGMENT)
        most //= ARITY
        if not most:
            break

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = []
            for r in part.itertuples(index=False):
                s = _segment(r)
                cost, audit = cheapest(s["matrix"])
                made.append({"c": r.c, "gaps": gaps(s), **{k: s[k] for k in names[1:5]}, "cost": cost, "audit": audit})
            yield _frame(made, schema)

    schema = "c string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    solved = scratch.write(apart.mapInPandas(solve, schema), "solved")

    def hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, repairing, out = None, None, []
        for part in parts:
            for c, kind, role, text, copies, audit in part.itertuples(index=False):
                if not kind:
                    if repairing is not None:
                        out.append({"c": now, "repaired_sha256": repairing.digest()})
                    now, repairing = c, Repair(audit)
                for _ in range(int(copies)):
                    repairing.feed(role, text)
            if out:
                yield _frame(out, "c string, repaired_sha256 string")
                out = []
        if repairing is not None:
            yield _frame([{"c": now, "repaired_sha256": repairing.digest()}], "c string, repaired_sha256 string")

    again = _judged(rows.join(solved.select("c"), "c", "left_semi")).withColumn("audit", F.lit(None).cast("string"))
    first = heads.join(solved.select("c", "audit"), "c")
    stream = first.unionByName(again).repartition("c").sortWithinPartitions(*order).select("c", "kind", "role", "text", "copies", "audit")
    there = solved.join(stream.mapInPandas(hashed, "c string, repaired_sha256 string"), "c").select("c", *names)
    return here.unionByName(there).select(_id(), *names)


def _id() -> Column:
    return F.when(F.col("c") != "", F.col("c")).cast("long").alias("conv_id")
