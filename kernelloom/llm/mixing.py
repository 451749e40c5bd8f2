"""Mixing sources to target weights by entropy balancing.

Rates r_i >= 0 of documents with x_i words minimise ``sum r_i log r_i - r_i`` subject to
``sum r_i x_i = target`` in each source and r_i <= the repeat limit.  The dual is one convex function
of one multiplier a source, and r_i = min(limit, exp(lambda * x_i / scale)).  Newton's steps for all
sources at once are grouped sums over the sources' histograms of sizes, kept inside a bracket.

Rates become whole copies by error diffusion in blocks of bounded size: documents go from the
longest to the shortest, each takes floor or ceiling so that the running error stays least, and at
most two documents then change by one copy to bring the block's words nearest its target.  A document that
is large for its block is rounded first, and the others' rates make good what that leaves.  Documents that
agree in id, source and text are one group in a block, but get their copies each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, free_names, small_batches
from kernelloom.llm.words import word_counts

#: Documents that one task rounds together.
BLOCK = 4096


def cycle_weights(sizes: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, weight): sources by code point, null last, weigh 1, 2, 3, repeating."""
    # one row a source
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (at + 1).cast("int")))


def capped_shares(weighted: DataFrame, total: float, repeats: float) -> DataFrame:
    """Adds target: min(repeats * source_size, weight * level), where the level makes the sum ``total``.

    That is the fixed point of giving each source its share by weight, stopping at the cap, and
    sharing the excess again.  Each round is one aggregate; a capped source stays capped.
    """
    cap, level, known = F.col("source_size") * float(repeats), 0.0, -1
    while True:
        capped = cap <= F.col("weight") * level
        taken, weight, n = weighted.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count_if(capped)
        ).first()
        if n == known or not weight:
            break
        known, level = n, max(level, (total - taken) / weight)
    return weighted.withColumn("target", F.least(cap, F.col("weight") * level))


def tilted_rates(hist: DataFrame, targets: DataFrame, repeats: float, scratch: Scratch, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(source, scale, lam) solving each source's dual; lam is infinite where the cap binds everywhere.

    A source is done when its words are within ``tolerance`` of its target, or when no number is left
    between its bracket's ends.  RuntimeError if one isn't done after ``rounds``: bisection alone ends sooner.
    """
    hist = hist.where("size > 0")
    state = targets.where("source_size > 0").select(
        "source", "target", (F.col("source_size") / F.col("docs")).alias("scale"), F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        (F.col("target") >= repeats * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(False).alias("done"),
    )
    state = scratch.write(state, "dual-0")
    x = F.col("size") / F.col("scale")
    free = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
    rate = F.least(F.lit(float(repeats)), free)
    for step in range(1, rounds + 1):
        named = state.withColumnsRenamed({"source": "s"})
        sums = hist.join(named, hist.source.eqNullSafe(named.s)).where("not full and not done").groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(free < repeats, F.col("n") * F.col("size") * x * free).otherwise(0.0)).alias("slope")
        )
        gap = F.col("got") - F.col("target")
        new = state.join(sums, state.source.eqNullSafe(sums.s), "left").drop("s")
        new = new.withColumns({"lo": F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (F.col("lo").isNull() | (newton > F.col("lo"))) & (F.col("hi").isNull() | (newton < F.col("hi"))) & (F.abs(newton - F.col("lam")) <= 4)
        wide = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        near = F.abs(gap) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        narrow = F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.abs("hi"), F.abs("lo"))
        new = new.withColumn("done", F.col("full") | F.col("done") | F.coalesce(near, F.lit(False)) | F.coalesce(narrow, F.lit(False)))
        new = new.withColumn("lam", F.when(F.col("done"), F.col("lam")).when(inside, newton).otherwise(wide))
        state = scratch.write(new.drop("got", "slope"), f"dual-{step}")
        scratch.drop(f"dual-{step - 1}")
        if state.where("not done").isEmpty():
            break
    else:
        raise RuntimeError(f"the sources' rates haven't converged after {rounds} rounds")
    return state.select("source", "scale", F.when(F.col("full"), F.lit(float("inf"))).otherwise(F.col("lam")).alias("lam"))


def diffuse(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Copies of groups of ``counts`` equal documents in the given order, in all of a group's documents:
    each document gets floor or ceiling of its rate, and the running error of words stays least."""
    low = np.floor(rates).astype(np.int64)
    out, error = low * counts, 0.0
    part = (rates - low) * sizes * counts
    for i in np.flatnonzero(part > 0):
        error += part[i]
        more = min(int(counts[i]), max(0, int(np.floor(error / sizes[i] + 0.5))))
        out[i] += more
        error -= more * sizes[i]
    return out


def rounded(sizes: np.ndarray, counts: np.ndarray, rates: np.ndarray, repeats: int, large: float = 0.01) -> np.ndarray:
    """Copies of groups in descending order of size, in all of a group's documents.

    What the copies of a large document, of over ``large`` of all words wanted, leave of its share or exceed
    it by is more than its neighbours' rounding could make good: it is shared among all smaller documents
    in proportion to their rates.  The others are diffused and settled."""
    want, rates = float((rates * sizes * counts).sum()), rates.copy()
    most, out = repeats * counts, np.zeros(len(sizes), np.int64)
    i = 0
    while i < len(sizes) and sizes[i] > large * want > 0:
        out[i] = min(int(most[i]), int(np.floor(rates[i] * counts[i] + 0.5)))
        i += 1
        left = want - float((out[:i] * sizes[:i]).sum())
        for _ in range(8):
            rest = float((rates[i:] * sizes[i:] * counts[i:]).sum())
            if rest > 0:
                rates[i:] = np.minimum(repeats, rates[i:] * (max(left, 0.0) / rest))
    out[i:] = diffuse(sizes[i:], counts[i:], rates[i:])
    return settle(out, sizes, want, most)


def settle(copies: np.ndarray, sizes: np.ndarray, want: float, most: np.ndarray) -> np.ndarray:
    """Changes at most two groups' copies by one (one up, one down, or both), between 0 and ``most``, to come
    nearest ``want``."""
    error = want - float((copies * sizes).sum())
    up, down = np.flatnonzero((copies < most) & (sizes > 0)), np.flatnonzero((copies > 0) & (sizes > 0))
    # a change of nothing stands for "no document"
    gain, loss = np.append(sizes[up], 0.0), np.append(sizes[down], 0.0)
    order = np.argsort(loss, kind="stable")
    at = np.searchsorted(loss[order], gain - error)
    best, choice = abs(error), None
    for near in (np.maximum(at - 1, 0), np.minimum(at, len(loss) - 1)):
        left = np.abs(error - gain + loss[order][near])
        i = int(left.argmin())
        if left[i] < best and not (i < len(up) and order[near[i]] < len(down) and up[i] == down[order[near[i]]]):
            best, choice = left[i], (i, int(order[near[i]]))
    if choice:
        copies = copies.copy()
        if choice[0] < len(up):
            copies[up[choice[0]]] += 1
        if choice[1] < len(down):
            copies[down[choice[1]]] -= 1
    return copies


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """id, source, digest, n, size, source_size, target, copies, more: one row for all ``n`` documents that
    agree in id, source and text (their digest).  ``more`` of them get a copy more than ``copies``.

    A null or empty text has size 0 and no copies.  A null source is a source of its own.  Reruns on
    the same rows agree.  A very long text is one document like any other.  An empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "mixing")

    @F.pandas_udf("long")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series(word_counts(texts.tolist()))

    rows = scratch.write(docs.select(*_key(id_col, text_col, source_col), words(F.col(text_col).cast("string")).alias("size")), "rows")
    rows = rows.groupBy("id", "source", "digest", "size").agg(F.count("*").alias("n"))
    hist = scratch.write(rows.groupBy("source", "size").agg(F.sum("n").alias("n")), "hist")
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sizes = scratch.write(cycle_weights(sizes, cycle), "sizes")
    total = float(sizes.agg(F.sum("source_size")).first()[0] or 0)
    targets = scratch.write(capped_shares(sizes, total, repeats), "targets")
    rates = tilted_rates(hist, targets, repeats, scratch)
    plan = targets.select(F.col("source").alias("s"), "source_size", "target", "docs").join(rates.withColumnRenamed("source", "r"), F.col("s").eqNullSafe(F.col("r")), "left").drop("r")
    plan = scratch.write(plan, "plan")
    rows = rows.join(plan, rows.source.eqNullSafe(plan.s)).drop("s")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "digest"), F.ceil(F.col("docs") / BLOCK)))

    def to_copies(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "id", "digest"], ascending=[False, True, True], ignore_index=True)
        size = part["size"].to_numpy(np.float64)
        lam, scale = part["lam"].to_numpy(np.float64), part["scale"].to_numpy(np.float64)
        rate = np.zeros(len(part))
        some = size > 0
        rate[some] = np.minimum(repeats, np.exp(np.minimum(lam[some] * size[some] / scale[some], 50.0)))
        n = part["n"].to_numpy()
        copies = rounded(size, n, rate, repeats)
        part["copies"], part["more"] = copies // n, copies % n
        return part[["id", "source", "digest", "n", "size", "source_size", "target", "copies", "more"]]

    return rows.groupBy("source", "block").applyInPandas(to_copies, "id long, source string, digest long, n long, size long, source_size long, target double, copies long, more long")


def _key(id_col: str, text_col: str, source_col: str) -> list[Column]:
    return [F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(F.col(text_col).cast("string")).alias("digest")]


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", repeats: int = 3, cycle: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """``docs`` as the mix takes it: each row as often as its copies, none for 0.  Edge cases: ``mix_plan``.

    Of rows that agree in id, source and text but differ elsewhere, which get the copy more depends on the
    table's partitions; how many do doesn't.
    """
    names = ("id", "source", "digest")
    ours, theirs = free_names(docs, *names), free_names(docs, *[f"plan_{n}" for n in names])
    copies, more, part, place, before, copy = free_names(docs, "copies", "more", "part", "place", "before", "copy")
    scratch = Scratch(docs.sparkSession, "mixed")
    plan = scratch.write(mix_plan(docs, id_col, text_col, source_col, repeats, cycle).where("copies > 0 or more > 0"), "plan")
    uneven = not plan.where("more > 0").isEmpty()
    plan = plan.select(*[F.col(n).alias(t) for n, t in zip(names, theirs)], F.col("copies").alias(copies), F.when(F.col("more") > 0, F.col("more")).alias(more))
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(_key(id_col, text_col, source_col), ours)], F.spark_partition_id().alias(part))
    taken = keyed.join(plan, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(ours, theirs)]).drop(*theirs)
    if uneven:
        # equal rows, some of which get a copy more, are numbered by partition, and the partitions' counts added up
        alike = scratch.write(taken.where(F.col(more).isNotNull()), "alike")
        by = Window.partitionBy(*ours)
        counts = alike.groupBy(*ours, part).agg(F.count("*").alias(place)).withColumn(before, F.sum(place).over(by.orderBy(part)) - F.col(place))
        counts = counts.select(*[F.col(o).alias(t) for o, t in zip(ours, theirs)], F.col(part).alias(copy), before)
        numbered = alike.withColumn(place, F.row_number().over(Window.partitionBy(*ours, part).orderBy(F.lit(0))))
        numbered = numbered.join(counts, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip([*ours, part], [*theirs, copy])])
        own = F.col(copies) + (F.col(place) + F.col(before) <= F.col(more)).cast("int")
        kept = [F.col(f"`{c}`") for c in docs.columns]
        taken = taken.where(F.col(more).isNull()).select(*kept, copies).unionByName(numbered.select(*kept, own.alias(copies)).where(F.col(copies) > 0))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
