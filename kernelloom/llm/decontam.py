"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become tokens; numbers, names and units become typed placeholders, so a benchmark question with
other parameters has the same template.  Windows of ``width`` template tokens are hash-joined.  Along
one alignment of a document with an item, each slot value of the item must always meet the same value
in the document; windows by form that hold a value which meets several are coincidences, and go.

An item is found by a share of its windows, or by a run of them whatever the item's length.  One of very
few tokens is found only where it is a document's whole text: within others it would be a coincidence.

A window in which more than ``width - literals`` tokens are placeholders says too little by its form;
such a window is compared by its own tokens.  So is every window as well, without the marks of names:
exact text is found whatever its case and blanks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import free_names

#: Marks a name; from the private-use area, so no text's own letter.
NAME = "\ue000"
#: A capitalised word after a lower-case letter, a comma or a semicolon and white space is a name.
NAME_PATTERN = r"(?<=[\p{Ll},;])([\s\p{Z}]+)(\p{Lu}\p{Ll}+)"
#: Possessive, so that the JVM's matcher loops instead of recursing: a number may be a whole table of them.
TOKEN_PATTERN = NAME + r"?\p{L}++|[0-9]++(?:[.,][0-9]++)*+"
#: Unit words that aren't ordinary words as well.
UNITS = (
    "kg mg cm mm km ml mph kmh kwh mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms "
    "liter liters litre litres inch inches feet yard yards hour hours minute minutes second seconds day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees ton tons tonne tonnes watt watts volt volts"
).split()
#: Windows of the benchmark, at about 100 bytes each, that may be broadcast: 64 MB.
BROADCAST_WINDOWS = 600_000


def tokens(text: Column) -> Column:
    """Lower-case tokens; a name bears its mark."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, NAME_PATTERN, "$1" + NAME + "$2")), F.lit(TOKEN_PATTERN), 0)


def _is_number(t: Column) -> Column:
    return F.ascii(t).between(48, 57)


def _is_slot(t: Column) -> Column:
    return _is_number(t) | t.startswith(NAME) | t.isin(UNITS)


def template(toks: Column) -> Column:
    return F.transform(toks, lambda t: F.when(_is_number(t), F.lit("<num>")).when(t.startswith(NAME), F.lit("<name>")).when(t.isin(UNITS), F.lit("<unit>")).otherwise(t))


def _windows(df: DataFrame, widths: list[int], width: int, literals: int, counted: bool = False) -> DataFrame:
    """All windows of the given widths: the columns of ``df`` but ``_tok``, and p, w, own, form, slots.

    ``own`` hashes the window's plain tokens and ``form`` its template, which is null if it says too little.
    If ``counted``, also lo and hi: how many tokens before the window, and to its end, aren't slots.

    Functions of lambdas run once a text; what runs once a window is code that Spark generates.
    """
    df = df.withColumns({
        "_tpl": F.transform(template(F.col("_tok")), lambda t: F.xxhash64(t)),
        "_own": F.transform("_tok", lambda t: F.xxhash64(F.when(t.startswith(NAME), F.substr(t, F.lit(2))).otherwise(t))),
        "_slot": F.when(F.exists("_tok", _is_slot), F.transform("_tok", lambda t: F.when(_is_slot(t), t).otherwise(""))),
    }).drop("_tok")
    df = df.withColumn("w", F.explode(F.array(*map(F.lit, widths))) if len(widths) > 1 else F.lit(widths[0]))
    last = F.size("_tpl") - F.col("w") + 1
    # the outer form spares a filter on sizes, which would split the texts twice
    df = df.withColumn("p", F.explode_outer(F.when(last >= 1, F.sequence(F.lit(1), last)))).where("p is not null")
    at = lambda tokens_: F.slice(tokens_, F.col("p"), F.col("w"))
    slots = F.array_remove(at("_slot"), "")
    # a text without slots has null ones: none of its windows is loose
    loose = F.coalesce(F.size(slots) > F.col("w") - F.floor(F.col("w") * literals / width), F.lit(False))
    made = {"own": F.xxhash64(F.lit("own"), at("_own")), "form": F.when(~loose, F.xxhash64("w", at("_tpl"))), "slots": slots}
    if counted:
        lo, end = F.col("p") - 1, F.col("p") + F.col("w") - 1
        literal = lambda n: n - F.coalesce(F.size(F.array_remove(F.slice("_slot", F.lit(1), n), "")), F.lit(0))
        made |= {"lo": literal(lo), "hi": literal(end)}
    return df.withColumns(made).drop("_tpl", "_own", "_slot")


def _hashes() -> Column:
    """The hashes that a window is found by: (h, exact)."""
    own, form = (F.struct(F.col(n).alias("h"), F.lit(n == "own").alias("exact")) for n in ("own", "form"))
    return F.when(F.col("form").isNull(), F.array(own)).otherwise(F.array(own, form))


def _longest(spans: Column) -> Column:
    """The most tokens, hi - lo, in a run of consecutive windows, structs (q, lo, hi); 0 without windows."""
    def add(run: Column, s: Column) -> Column:
        lo = F.when(s["q"] <= run["q"] + 1, run["lo"]).otherwise(s["lo"])
        return F.struct(s["q"].alias("q"), lo.alias("lo"), F.greatest(run["best"], s["hi"] - lo).alias("best"))

    start = F.struct(F.lit(-9).alias("q"), F.lit(0).alias("lo"), F.lit(0).alias("best"))
    return F.aggregate(F.array_sort(spans), start, add)["best"]


def _whole_texts(docs: DataFrame, items: DataFrame, below: int) -> DataFrame:
    """The pairs of a document and an item with the same tokens, at least one and fewer than ``below``; ``docs``
    has doc_id and text, ``items`` item_id and _tok."""
    plain = F.transform("_tok", lambda t: F.when(t.startswith(NAME), F.substr(t, F.lit(2))).otherwise(t))
    items = items.select("item_id", plain.alias("_tok"))
    # a text of more tokens is told by its first ones; lower case never has fewer
    many = r"^[^\p{L}0-9]*+(?:(?:\p{L}++|[0-9]++(?:[.,][0-9]++)*+)[^\p{L}0-9]*+){%d}" % below
    few = docs.where(~F.col("text").rlike(many)).select("doc_id", tokens(F.col("text")).alias("_tok")).select("doc_id", plain.alias("_tok"))
    found = few.join(F.broadcast(items) if items.count() <= BROADCAST_WINDOWS else items, "_tok").select("doc_id", "item_id").distinct()
    one = F.lit(1).cast("long")
    return found.select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), F.lit(1.0).alias("share"), F.lit(False).alias("reworded"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    width: int = 8, literals: int = 5, shortest: int = 5, share: float = 0.5, run: int = 13,
) -> DataFrame:
    """One row a document and item found in it: doc_id, item_id, n_windows (of the item's, matched),
    item_windows, share, reworded (a slot has another value).  Clean documents have no row.

    An item is found if at least ``share`` of its windows are matched consistently, or if consecutive
    ones along one alignment hold ``run`` equal tokens: all tokens of windows with equal text, those that
    aren't slots of windows by form.  An item of fewer
    than ``width`` tokens is one window; one of fewer than ``shortest`` is found in the documents that
    consist of its tokens and no others, whatever their case.  Null ids take no part; null and empty texts match nothing; rows with one id count as one
    document, items with one id as one item; repeated rows change nothing; other columns are ignored.
    Empty tables give an empty result.  Whole texts are searched, however long.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text).cast("string")).alias("_tok"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("_tok") > 0)).distinct()
    # at most ``width`` different numbers
    sizes = sorted(r[0] for r in items.select(F.least(F.size("_tok"), F.lit(width))).distinct().collect())
    texts = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, item_windows long, share double, reworded boolean")
    if any(n < shortest for n in sizes):
        found = _whole_texts(texts, items.where(F.size("_tok") < shortest), shortest)
    widths = [n for n in sizes if n >= shortest]
    if not widths:
        return found
    by_windows = _by_windows(texts, items.where(F.size("_tok") >= shortest), widths, width, literals, share, run)
    return by_windows.unionByName(found) if len(widths) < len(sizes) else by_windows


def _by_windows(texts: DataFrame, items: DataFrame, widths: list[int], width: int, literals: int, share: float, run: int) -> DataFrame:
    """The pairs that ``contaminated`` finds by windows."""
    own = F.col("w") == F.col("_w")
    bench = _windows(items.withColumn("_w", F.least(F.size("_tok"), F.lit(width))), widths, width, literals, counted=True).where(own)
    bench = bench.select("item_id", F.struct(F.col("p").alias("q"), F.coalesce("form", "own").alias("h")).alias("q"), "own", "form", F.col("slots").alias("item_slots"), "lo", "hi")
    sizes = bench.groupBy("item_id").agg(F.count_distinct("q").cast("long").alias("item_windows"))
    bench = bench.select("item_id", "q", "item_slots", "lo", "hi", F.explode(_hashes()).alias("hit")).select("item_id", "q", "item_slots", "lo", "hi", "hit.h", "hit.exact")
    if bench.count() <= BROADCAST_WINDOWS:
        bench = F.broadcast(bench)

    rows = _windows(texts.select("doc_id", tokens(F.col("text")).alias("_tok")), widths, width, literals).select("doc_id", "p", F.col("slots").alias("doc_slots"), F.explode(_hashes()["h"]).alias("h"))
    nothing = F.array().cast("array<string>")
    # equal text has equal values, also where the document's blanks or case hide a name
    values = F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("doc_slots"))
    pairs = F.arrays_zip(F.coalesce("item_slots", nothing).alias("a"), F.coalesce(values, nothing).alias("b"))
    met = rows.join(bench, "h").select("doc_id", "item_id", (F.col("p") - F.col("q.q")).alias("at"), F.struct("q", "exact", "lo", "hi", pairs.alias("pairs")).alias("hit"))
    # an alignment has each of the item's windows twice at most, so these sets are as small as the item
    along = met.groupBy("doc_id", "item_id", "at").agg(F.collect_set("hit").alias("hits"))
    along = along.withColumn("pairs", F.array_distinct(F.flatten(F.transform("hits", lambda h: h["pairs"]))))
    values = F.transform("pairs", lambda x: x["a"])
    along = along.withColumn("several", F.when(F.size("pairs") > F.size(F.array_distinct(values)), F.array_distinct(F.filter(values, lambda a, i: F.array_position(values, a) != i + 1))).otherwise(nothing))
    along = along.withColumn("hits", F.filter("hits", lambda h: h["exact"] | ~F.exists(h["pairs"], lambda x: F.array_contains(F.col("several"), x["a"])))).where(F.size("hits") > 0)
    by_form = F.transform("hits", lambda h: F.struct(h["q"]["q"].alias("q"), h["lo"].alias("lo"), h["hi"].alias("hi")))
    in_full = F.transform(F.filter("hits", lambda h: h["exact"]), lambda h: F.struct(h["q"]["q"].alias("q"), h["q"]["q"].alias("lo"), (h["q"]["q"] + width).alias("hi")))
    along = along.withColumn("long_run", F.greatest(_longest(by_form), _longest(in_full)) >= run).withColumn("reworded", F.exists("pairs", lambda x: x["a"] != x["b"]))
    along = along.select("doc_id", "item_id", "reworded", "long_run", F.explode(F.transform("hits", lambda h: h["q"])).alias("q"))
    found = along.groupBy("doc_id", "item_id").agg(F.count_distinct("q").cast("long").alias("n_windows"), F.bool_or("reworded").alias("reworded"), F.bool_or("long_run").alias("long_run"))
    found = found.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_WINDOWS else sizes, "item_id").withColumn("share", F.col("n_windows") / F.col("item_windows"))
    return found.where((F.col("share") >= share) | F.col("long_run")).select("doc_id", "item_id", "n_windows", "item_windows", "share", "reworded")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the contaminated documents, columns unchanged, whatever their names.

    Rows without an id stay; of rows that share one, all go if any is contaminated."""
    (found_id,) = free_names(docs, "found_id")
    found = contaminated(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(found_id)).distinct()
    return docs.join(found, F.col(id_col).cast("long") == F.col(found_id), "left_anti")
