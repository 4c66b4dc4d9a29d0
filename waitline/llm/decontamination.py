"""Benchmark questions in documents, with their numbers, names and units possibly changed.

Texts are brought into template forms: words with a digit and units after a number become typed placeholders, other
words are lower-cased, punctuation goes.  What is a name depends on the form: capitalised words inside a sentence, any
capitalised word (names may open a sentence or follow a quote, and so do other words on either side), or none (copies in
other case).  Windows of five words of any form are joined by hash; forms that agree on a window give it one hash.  Matching windows at the same distance form a copy of the question.  In a consistent copy, whatever
stands for one value of the question is one value too.  A document is contaminated by an item if its consistent copies
hold at least 0.8 of the item's windows.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitline.llm.common import checked_broadcast, id_and_text
from waitline.session import written

#: Words of a window, and the part of an item's windows that makes a contaminated document.
WINDOW, CONTAINED = 5, 0.8
#: Words that count as a unit after a number.
UNITS = (
    "percent", "%", "km", "m", "cm", "mm", "miles", "mile", "feet", "foot", "inches", "inch", "kg", "g", "mg", "tons", "pounds",
    "pound", "ounces", "liters", "litres", "l", "ml", "gallons", "seconds", "second", "s", "minutes", "minute", "min", "hours",
    "hour", "h", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "cents", "euros", "euro",
    "mph", "kmh", "degrees", "degree")

_NUMBER = r"\d\S*+"
_UNIT = rf"(?<=<num>\s)(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])"
_NAME = r"\p{Lu}(?<=[^.!?:\s]\s\p{Lu})\p{Ll}+"
_CAPITAL = r"(?<![\p{L}\p{N}<'\u2019])\p{Lu}\p{Ll}+"
_MARKS = r"[^\p{L}\p{N}<>\s]+"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _steps(frame: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """One ``select`` for each step, so that what a step makes is computed once however often the next one names it."""
    for step in steps:
        frame = frame.withColumns(step)
    return frame


def templates(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the template words _w0, _w1, _w2 of ``text`` in each form, names inside sentences first.

    A word keeps its place, so that the forms line up with each other and with ``plain``; null gives no words.
    """
    t, a = F.col("_s"), F.col("_a")
    units = lambda c: F.when(F.contains(c, F.lit("<num>")), F.regexp_replace(c, _UNIT, "<unit>")).otherwise(c)
    # A number is found by its first digit; what stands before it in its word goes when the words are told apart.
    cut = lambda w: F.when(F.endswith(w, F.lit("<num>")), F.lit("<num>")).otherwise(w)
    words = lambda c: F.transform(_split(F.lower(c)), cut)
    made = _steps(
        rows.select(*keep, F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[<>]+", " ").alias("_s")),
        {"_s": F.regexp_replace(t, _NUMBER, "<num>")},
        {"_s": units(t), "_a": F.lower(t)},
        {"_a": units(a), "_b": F.regexp_replace(t, _CAPITAL, "<name>"), "_s": F.regexp_replace(t, _NAME, "<name>")},
        {c: F.regexp_replace(c, _MARKS, "") for c in ("_s", "_b", "_a")},
        {f"_w{k}": words(F.col(c)) for k, c in enumerate(("_s", "_b", "_a"))})
    return made.select(*keep, "_w0", "_w1", "_w2")


def plain(text: Column) -> Column:
    """The same words with their values: lower case without punctuation, a unit that is only marks as it is."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "[<>]+", " ")
    text = F.regexp_replace(text, r"(?<=\d\s)%", "percent")
    return _split(F.lower(F.regexp_replace(text, _MARKS, "")))


def windows(formed: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, start i from 0 and hash h of each window of the forms _w0, _w1, _w2.

    Starts become rows before anything is hashed, so that the hashes are compiled with the rest of the stage.  Hashes
    that agree at one start are one row.
    """
    starts = F.when(F.size("_w0") >= WINDOW, F.sequence(F.lit(0), F.size("_w0") - WINDOW))
    rows = formed.select(*keep, "_w0", "_w1", "_w2", F.explode(starts).alias("i"))
    at = lambda w: F.xxhash64(*[F.get(w, F.col("i") + k) for k in range(WINDOW)])
    hashed = rows.select(*keep, "i", *[at(f"_w{k}").alias(f"_h{k}") for k in range(3)])
    h0, h1, h2 = (F.col(f"_h{k}") for k in range(3))
    each = F.array(h0, F.when(h1 != h0, h1), F.when((h2 != h0) & (h2 != h1), h2))
    return hashed.select(*keep, "i", F.explode(each).alias("h")).where("h is not null")


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, n_windows, j, h, bare of every item; equal texts under two ids are two items, repeated rows one.

    A bare window holds placeholders only: it is the same in every list of numbers.
    """
    words = templates(items.where("item_id is not null and text is not null"), "item_id").distinct()
    words = words.withColumn("n_windows", F.size("_w0") - (WINDOW - 1))
    found = windows(words, "item_id", "n_windows").withColumnRenamed("i", "j")
    kinds = items.sparkSession.createDataFrame([("<num>",), ("<unit>",), ("<name>",)], "k string")
    runs = kinds.select(F.collect_list("k").alias("k"))
    for n in range(WINDOW):  # the 243 runs of five placeholders
        runs = runs.withColumn(f"k{n}", F.explode("k"))
    bare = runs.select(F.xxhash64(*[f"k{n}" for n in range(WINDOW)]).alias("_h")).withColumn("bare", F.lit(True))
    return found.join(F.broadcast(bare), F.col("h") == F.col("_h"), "left").select(
        "item_id", "n_windows", "j", "h", F.coalesce("bare", F.lit(False)).alias("bare"))


def item_slots(items: DataFrame) -> DataFrame:
    """item_id, p, value: the words behind the placeholders of an item, in whatever form."""
    named = items.where("item_id is not null and text is not null").select("item_id", "text", plain(F.col("text")).alias("value"))
    kinds = [F.col(f"_w{k}").alias(f"k{k}") for k in range(3)]
    slots = templates(named, "item_id", "value").select("item_id", F.posexplode(F.arrays_zip(*kinds, "value")).alias("p", "w"))
    some = F.expr(" or ".join(f"w.k{k} in ('<num>', '<unit>', '<name>')" for k in range(3)))
    return slots.where(some).select("item_id", "p", F.col("w.value").alias("value")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text, as ids may be null or repeat."""
    return id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("_t"))


def hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, _t, item_id, shift, j, n_windows: windows of an item that a document has, by their distance.

    A bare window of a document is told once, whatever its place, and has no shift.
    """
    known = wanted.select(F.col("h").alias("_h"), F.col("bare").alias("_bare")).distinct()
    found = windows(templates(_keyed(docs), "doc_id", "_t"), "doc_id", "_t")
    found = found.join(checked_broadcast(known), F.col("h") == F.col("_h")).select(
        "doc_id", "_t", F.when(~F.col("_bare"), F.col("i")).alias("i"), "h").distinct()
    return found.join(checked_broadcast(wanted), "h").select(
        "doc_id", "_t", "item_id", (F.col("i") - F.col("j")).alias("shift"), "j", "n_windows")


def copies(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, _t, item_id, shift, broken, n_changed of the copies that cover a slot: broken if one value of the item
    stands for two in the document; n_changed counts the slots that hold another value than the item's."""
    covered = found.select("doc_id", "_t", "item_id", "shift", F.explode(F.sequence("j", F.col("j") + WINDOW - 1)).alias("p"))
    slots = covered.join(checked_broadcast(item_slots(items)), ["item_id", "p"]).distinct()
    slots = slots.withColumn("_at", F.col("p") + F.col("shift")).withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_u")
    slots = written(slots, "covered-slots")
    texts = _keyed(docs).join(
        checked_broadcast(slots.select(F.col("_u").alias("_v")).distinct()), F.col("_t") == F.col("_v"), "left_semi")
    values = texts.select("doc_id", "_t", plain(F.col("text")).alias("_w")).distinct().join(
        checked_broadcast(slots), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")))
    held = values.select("doc_id", "_t", "item_id", "shift", "p", "value", F.get("_w", F.col("_at")).alias("now"))
    sides = held.groupBy("doc_id", "_t", "item_id", "shift", "value").agg(
        (F.min("now") != F.max("now")).alias("_two"), F.sum((F.col("now") != F.col("value")).cast("long")).alias("_n"))
    return sides.groupBy("doc_id", "_t", "item_id", "shift").agg(F.max("_two").alias("broken"), F.sum("_n").alias("n_changed"))


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, containment, n_changed, clean of every row.

    ``containment`` is that of the fullest item, 0 without a hit; ``n_changed`` counts the changed slots of the items
    found.  A copy in other case is found with other numbers, not with other names as well.  Items and texts
    of fewer than five words have no window and match nothing; null texts and ids likewise
    (rows without an id are judged like others), and items in which no five words in a row hold a plain word.  Runs of
    equal windows, as in very long lists of numbers, count once.  Repeated rows get equal results; no items, no
    contamination; an empty table gives an empty result.
    """
    all_hits = written(hits(docs, written(item_windows(items), "item-windows")), "template-hits")
    found = all_hits.where("shift is not null")
    kept = found.join(
        copies(docs, items, found).select(
            F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), F.col("item_id").alias("_item"), F.col("shift").alias("_s"), "broken", "n_changed"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")) & (F.col("item_id") == F.col("_item")) & (F.col("shift") == F.col("_s")),
        "left").where(~F.coalesce("broken", F.lit(False)))
    by_copy = kept.groupBy("doc_id", "_t", "item_id", "shift").agg(F.max("n_changed").alias("n_changed"))
    changed = by_copy.groupBy("doc_id", "_t", "item_id").agg(F.sum("n_changed").alias("_c"))
    # Bare windows add to an item that the document has a copy of; alone they say nothing.
    there = kept.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), F.col("item_id").alias("_item")).distinct()
    bare = all_hits.where("shift is null").join(
        there, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")) & (F.col("item_id") == F.col("_item")), "left_semi")
    full = kept.unionByName(bare, allowMissingColumns=True).select("doc_id", "_t", "item_id", "j", "n_windows").distinct().groupBy("doc_id", "_t", "item_id", "n_windows").agg(
        (F.count(F.lit(1)) / F.col("n_windows")).alias("_share"))
    named = changed.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), F.col("item_id").alias("_item"), "_c")
    full = full.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")) & (F.col("item_id") == F.col("_item")))
    bad = F.col("_share") >= contained
    verdicts = full.groupBy("doc_id", "_t").agg(
        F.max("_share").alias("_best"), F.sort_array(F.collect_set(F.when(bad, F.col("item_id")))).alias("_items"),
        F.sum(F.when(bad, F.coalesce("_c", F.lit(0))).otherwise(0)).alias("_changed"))
    verdicts = written(verdicts.withColumnRenamed("doc_id", "_id").withColumnRenamed("_t", "_u"), "template-verdicts")
    rows = _keyed(docs).select("doc_id", "_t").join(
        checked_broadcast(verdicts), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_u")), "left")
    n = F.coalesce(F.size("_items"), F.lit(0))
    n = F.when(F.col("_items").isNull(), 0).otherwise(n)
    return rows.select(
        "doc_id", (n > 0).alias("contaminated"), n.cast("long").alias("n_items"),
        F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"),
        F.round(F.coalesce("_best", F.lit(0.0)), 6).alias("containment"), F.coalesce("_changed", F.lit(0)).cast("long").alias("n_changed"),
        (n == 0).alias("clean"))
