"""Benchmark decontamination on canonical templates.

Tokens are words, numbers and names, case folded. Numbers, names (capitalised words
inside a sentence, those in a row together) and units behind a number become typed
placeholders. Every run of ``window`` canonical tokens is hashed, on both sides, and the
hashes are joined: a document that holds at least ``coverage`` of an item's windows holds
the item's template. Then the slots decide: the values that item and document have at the
same placeholders must map one to one in at least ``consistency`` of the item's values.
Equal values are a copy, other values a re-parameterised question. All of it is DataFrame
functions; no text is shuffled unless more documents match than may be broadcast.

A window may stand in a document many times. All its places are kept, and coverage and
slots are judged for each way to lay the item over one passage of the document
(``layings``); the best one counts.

This is done in three forms of the texts, on both sides, and an item is held if it is held
in one of them; the figures are those of the first in which it is verbatim, or else of the
first: names inside sentences, as above; all
capitalised words as names, also those at the start of a text, sentence or line, after a
quote or bracket, and in capitals; and no names, for copies in another letter case. Where
the letter case does not show names, changed names are not known as such.

An item's window counts only if it has at least ``plain`` tokens that are no placeholders.
Items shorter than ``window`` are one window of their own length, if that is at least
``shortest``. Of a long item a passage of ``passage`` tokens is enough. Items that have no
window by these rules, being short or mostly numbers, are held where their whole sequence of
raw tokens stands, in letter case of any kind, if they have at least ``fewest`` tokens: a
fourth form, in which all windows count and must be met side by side.

Defined results: null and empty texts hold nothing, and null items and those of fewer
tokens are held by nothing; items without an id are left out. Rows with equal id and text
are one document, and one item; of different texts under one id the best one counts.
Items with equal texts are reported each. Extra columns do not matter; empty tables give an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, row_key, small_side, staged, with_row_key

WINDOW = 8
SHORTEST = 5
PLAIN = 3
FEWEST = 3
PASSAGE = 50
#: Places of an item in a document that are judged in one row.
PART = 20_000
COVERAGE = 0.5
CONSISTENCY = 0.8
#: Marks around a name; canonical tokens.
OPEN, CLOSE = "\u0002", "\u0003"
NAME, NUMBER, UNIT = "\u0002", "\u0001", "\u0003"
#: Units that follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
    "second seconds minute minutes min hour hours day days week weeks month months year years "
    "percent cent cents dollar dollars euro euros pound pounds degree degrees meter meters metre metres gram grams kilogram kilograms kilometer kilometers mph kmh"
).split()
#: Names inside sentences; tokens. Loops over groups are possessive: others
#: call themselves in Java for every repeat, and a long list would end the executor.
NAMES = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*+"
TOKEN = f"{OPEN}[^{CLOSE}]*{CLOSE}|[0-9]+(?:[.,][0-9]+)*+|\\p{{L}}+"
#: The names of the forms.
CAPITALISED = r"(?<!\p{L})\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*+"
FORMS = (NAMES, CAPITALISED, None)
#: The form of whole raw sequences.
RAW = len(FORMS)


def tokens(text: Column, form: int = 0) -> Column:
    """Raw tokens; a name keeps its marks, so it starts with a control character."""
    text = F.coalesce(text, F.lit(""))
    marked = text if FORMS[form] is None else F.regexp_replace(text, F.lit(FORMS[form]), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def tokens_of(text: Column, form: Column) -> Column:
    """``tokens`` where the form is a column; a row is cut in its own form only."""
    return F.when(form == 0, tokens(text, 0)).when(form == 1, tokens(text, 1)).otherwise(tokens(text, 2))


def _is_number(x: Column) -> Column:
    return (x >= "0") & (x < ":")


def enough(coverage: float, window: int, passage: int) -> Column:
    """How many windows of an item have to match: a share of them, or those of a passage."""
    return F.when(F.col("form") == RAW, F.col("n_windows")).otherwise(F.least(F.col("n_windows") * coverage, F.lit(passage - window + 1)))


def _canonical(toks: Column, word, mark) -> Column:
    def one(x: Column, i: Column) -> Column:
        # Few tokens stand behind a number, so that is asked first; before the first
        # token stands null.
        before = F.get(toks, i - 1)
        unit = (before < ":") & (before >= "0") & F.array_contains(F.array(*map(F.lit, UNITS)), x)
        return F.when(x >= "A", F.when(unit, mark(UNIT)).otherwise(word(x))).when(_is_number(x), mark(NUMBER)).otherwise(mark(NAME))

    return F.transform(toks, one)


def canonical(toks: Column) -> Column:
    """Tokens with placeholders for numbers, names and units."""
    return _canonical(toks, lambda x: x, F.lit)


def canonical_hashes(toks: Column) -> Column:
    """The hashes of the canonical tokens, in one step. A placeholder's is its number."""
    return _canonical(toks, F.xxhash64, lambda mark: F.lit(ord(mark)).cast("long"))


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _join(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def _placed(hashes: Column, k: int) -> Column:
    """Runs of ``k`` tokens with their places; the hash tells lengths apart."""
    return F.transform(hashes, lambda h, i: F.struct(F.xxhash64(h, F.lit(k)).alias("h"), i.alias("pos"), F.lit(k).alias("k")))


def with_windows(df: DataFrame, lengths: list[int], name: str = "windows", raw: bool = False) -> DataFrame:
    """Add the hashes of all runs of ``lengths`` tokens of column ``toks``, by canonical or
    raw tokens. A run's hash is put together from runs half as long, so a step costs one value
    for each token."""
    df = df.withColumn("_w1", F.transform("toks", lambda x: F.xxhash64(x)) if raw else canonical_hashes(F.col("toks")))
    power = 1
    while power * 2 <= max(lengths):
        df = df.withColumn(f"_w{power * 2}", _join(F.col(f"_w{power}"), _shift(F.col(f"_w{power}"), power)))
        power *= 2
    parts = []
    for k in lengths:
        run, done = None, 0
        for p in (1 << b for b in range(k.bit_length()) if k >> b & 1):
            piece = _shift(F.col(f"_w{p}"), done)
            run, done = piece if run is None else _join(run, piece), done + p
        parts.append(F.slice(run, F.lit(1), F.greatest(F.size("_w1") - (k - 1), F.lit(0))))
    if len(parts) == 1:
        df = df.withColumn(name, F.transform(parts[0], lambda h, i: F.struct(h.alias("h"), i.alias("pos"), F.lit(lengths[0]).alias("k"))) if name == "items" else parts[0])
    else:
        df = df.withColumn(name, F.flatten(F.array(*[_placed(p, k) for k, p in zip(lengths, parts, strict=True)])))
    return df.drop(*[c for c in df.columns if c.startswith("_w")])


def bench_windows(bench: DataFrame, window: int, plain: int, shortest: int, fewest: int) -> tuple[DataFrame, dict[bool, list[int]]]:
    """``item, form, h, ipos, k`` for each window of the items that counts, a table, and the
    windows' lengths, for canonical and for raw ones."""
    k = F.least(F.size("toks"), F.lit(window))

    def windows(of: DataFrame, raw: bool) -> tuple[DataFrame, list[int]]:
        lengths = sorted({r[0] for r in of.select(k).distinct().collect()} | (set() if raw else {window}))
        if not lengths:
            return None, lengths
        cut = with_windows(of, lengths, "items", raw).withColumn("n", F.size("toks")).select("item", "form", "n", "canon", F.explode_outer("items").alias("w"))
        return cut.where(F.col("w.k") == F.least("n", F.lit(window))), lengths

    columns = ["item", "form", F.col("w.h").alias("h"), F.col("w.pos").alias("ipos"), F.col("w.k").alias("k")]
    cut, lengths = windows(bench.where((F.col("form") < RAW) & (F.size("toks") >= shortest)), False)
    good = staged(cut.where(F.size(F.filter(F.slice("canon", F.col("w.pos") + 1, F.col("w.k")), lambda x: x >= "A")) >= plain).select(*columns), "bench-windows")
    rest = bench.where((F.col("form") == RAW) & (F.size("toks") >= fewest)).join(good.select("item").distinct(), "item", "left_anti")
    rest = staged(rest, "bench-rest")
    raw, raw_lengths = windows(rest, True)
    if raw is not None:
        good = staged(good.unionByName(raw.select(*columns)), "bench-windows")
    return good, {False: lengths, True: raw_lengths}


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY, plain: int = PLAIN, shortest: int = SHORTEST, fewest: int = FEWEST, passage: int = PASSAGE) -> DataFrame:
    """``row, doc_id, item_id, n_windows, n_matched, coverage, n_slots, slot_consistency,
    verbatim``: a row for each document and benchmark item that it holds."""
    forms = F.explode(F.array(*map(F.lit, range(RAW + 1)))).alias("form")
    # An item is a text under an id; rows that repeat are one.
    bench = items.where(F.col("item_id").isNotNull()).select("item_id", "text").distinct()
    bench = bench.select("item_id", row_key("item_id").alias("item"), "text", forms).select("item_id", "item", "form", tokens_of(F.col("text"), F.col("form")).alias("toks"))
    # Raw tokens have no placeholders.
    bench = staged(bench.withColumn("canon", F.when(F.col("form") < RAW, canonical(F.col("toks"))).otherwise(F.transform("toks", lambda x: F.lit("a")))), "bench-tokens")
    cut, lengths = bench_windows(bench, window, plain, shortest, fewest)
    wanted = cut.groupBy("item", "form").agg(F.count(F.lit(1)).alias("n_windows"))

    side, hits = small_side(cut), None
    for form in range(RAW + 1):
        sizes = lengths[form == RAW]
        if not sizes:
            continue
        texts = docs.select("doc_id", row_key().alias("row"), tokens(F.col("text"), min(form, RAW - 1)).alias("toks"))
        runs = with_windows(texts, sizes, raw=form == RAW)
        # The outer forms: for the others Spark adds a filter on the array's size, which it
        # moves down to the scan and so works out every array twice, in each of its uses.
        if len(sizes) == 1:
            runs = runs.select("row", "doc_id", F.posexplode_outer("windows").alias("dpos", "h"))
        else:
            runs = runs.select("row", "doc_id", F.explode_outer("windows").alias("w")).select("row", "doc_id", F.col("w.pos").alias("dpos"), F.col("w.h").alias("h"))
        of_form = runs.join(side.where(F.col("form") == form), "h").select("row", "doc_id", "item", "form", "ipos", "dpos", "k")
        hits = of_form if hits is None else hits.unionByName(of_form)
    # A shift is a place where the item may lie: its windows that are met there.
    shifts = hits.groupBy("row", "doc_id", "item", "form", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.collect_set(F.struct("ipos", "k")).alias("hits"))
    shifts = staged(shifts, "shifts")
    held = shifts.select("row", "doc_id", "item", "form", "shift", F.explode("hits.ipos").alias("ipos")).groupBy("row", "doc_id", "item", "form")
    held = held.agg(F.size(F.collect_set("ipos")).alias("met"), (F.min("shift") == F.max("shift")).alias("single"), F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    need = enough(coverage, window, passage)
    # Less than that in the whole document cannot be enough in a passage of it.
    held = staged(held.join(small_side(wanted), ["item", "form"]).where(F.col("met") >= need), "held")
    laid = staged(layings(shifts, held, need), "layings")
    judged = staged(best_layings(laid, docs, bench), "judged")
    same = ["row", "item", "form"]
    share = F.col("best.n_matched") / F.col("n_windows")
    told = F.struct("best.verbatim", (-F.col("form")).alias("form"), "best.slot_consistency", share.alias("coverage"), "best.n_matched", "n_windows", "best.n_slots")
    names = bench.select("item", "item_id").distinct()
    out = held.join(judged.where(F.col("best.slot_consistency") >= consistency), same).join(small_side(names), "item").groupBy("row", "doc_id", "item_id")
    return out.agg(F.max(told).alias("x")).select("row", "doc_id", "item_id", *[f"x.{c}" for c in ("n_windows", "n_matched", "coverage", "n_slots", "slot_consistency", "verbatim")])


def layings(shifts: DataFrame, held: DataFrame, need: Column) -> DataFrame:
    """``row, item, form, part, hits``: the ways to lay an item over a document, a row each,
    with the places ``ipos, dpos, k`` of at least ``need`` of the item's windows. They are,
    for each shift ``dpos - ipos``, the windows at that shift alone, and with every other
    window at its shift nearest to that one, which goes over words put in or left out, but no
    further away than the item has windows: that would be another passage. The second is left
    out where it is the first again. The layings of one pair are dealt into parts of about
    ``PART`` places, as a document that repeats itself may have very many."""
    same = ["row", "item", "form"]
    pair = [*same, "n_windows", "parts"]
    rows = shifts.join(small_side(held.select(*pair, "single", "met")), same)
    placed = F.transform("hits", lambda h: F.struct(h["ipos"].alias("ipos"), (h["ipos"] + F.col("shift")).alias("dpos"), h["k"].alias("k")))
    alone = rows.select(*pair, F.col("shift").alias("at"), placed.alias("hits"))
    several = rows.where(~F.col("single") & (F.col("form") < RAW))
    flat = several.select(*pair, "shift", F.explode("hits").alias("x")).select(*pair, "shift", "x.ipos", "x.k")
    # Where all windows that are met lie at one shift no other is nearer.
    some = several.where(F.size("hits") < F.col("met")).select(*same, F.col("shift").alias("at"))
    grid = flat.select(*pair, "ipos", "k").distinct().join(some, same)
    # Both kinds of rows in one order: a shift of the window, and a shift asked for.
    grid = grid.select(*pair, "ipos", "k", "at", F.lit(None).cast("int").alias("shift"), F.lit(True).alias("asked"))
    grid = grid.unionByName(flat.select(*pair, "ipos", "k", F.col("shift").alias("at"), "shift", F.lit(False).alias("asked")))
    window = Window.partitionBy(*same, "ipos")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    below = F.last("shift", True).over(window.orderBy("at").rangeBetween(*so_far))
    above = F.last("shift", True).over(window.orderBy(F.desc("at")).rangeBetween(*so_far))
    grid = grid.withColumn("below", below).withColumn("above", above).where("asked")
    nearest = F.when(F.col("above").isNull() | (F.col("at") - F.col("below") <= F.col("above") - F.col("at")), F.col("below")).otherwise(F.col("above"))
    grid = grid.withColumn("nearest", nearest).where(F.abs(F.col("nearest") - F.col("at")) <= F.col("n_windows"))
    near = grid.groupBy(*pair, "at").agg(F.collect_list(F.struct("ipos", (F.col("ipos") + F.col("nearest")).alias("dpos"), "k")).alias("hits"), F.max(F.col("nearest") != F.col("at")).alias("other"))
    part = F.pmod(F.xxhash64("at"), F.col("parts")).alias("part")
    return alone.unionByName(near.where("other").drop("other")).where(F.size("hits") >= need).select(*same, part, "hits")


def best_layings(laid: DataFrame, docs: DataFrame, bench: DataFrame) -> DataFrame:
    """``row, item, form, best``: of the ways to lay an item the best one: what share of
    the values in the item's slots maps one to one (1 without slots), whether all are equal,
    how many windows match, how many values there are. A part of a pair's layings is judged
    in one row, which holds the document's tokens once."""
    same = ["row", "item", "form"]
    slotted = bench.where(F.exists("canon", lambda x: x < "A")).select("item", "form", F.col("toks").alias("itoks"), F.col("canon").alias("icanon"))
    plain = laid.join(small_side(slotted.select("item", "form").distinct()), ["item", "form"], "left_anti").groupBy(*same).agg(F.max(F.size("hits").cast("long")).alias("n_matched"))
    plain = plain.select(*same, F.struct(F.lit(1.0).alias("slot_consistency"), F.lit(True).alias("verbatim"), "n_matched", F.lit(0).alias("n_slots")).alias("best"))

    def places(h: Column) -> Column:
        # A slot's places in item and document as one number: those that windows share count once.
        slots = F.filter(F.sequence(h["ipos"], h["ipos"] + h["k"] - 1), lambda i: F.get("icanon", i) < "A")
        return F.transform(slots, lambda i: F.shiftleft(i.cast("long"), 32) + h["dpos"] + i - h["ipos"])

    asked = laid.join(small_side(slotted), ["item", "form"])
    asked = asked.select(*same, "part", F.size("hits").cast("long").alias("n_matched"), F.array_distinct(F.flatten(F.transform("hits", places))).alias("places"))
    asked = staged(asked.groupBy(*same, "part").agg(F.collect_list(F.struct("n_matched", "places")).alias("layings")), "slot-places")
    keys = small_side(staged(asked.select(F.col("row.a").alias("ra"), F.col("row.b").alias("rb"), "form", "part").distinct(), "slot-rows"))
    texts = docs.select(row_key().alias("row"), "text").withColumn("ra", F.col("row.a")).withColumn("rb", F.col("row.b")).join(keys, ["ra", "rb"])
    texts = staged(texts.select("row", "form", "part", tokens_of(F.col("text"), F.col("form")).alias("dtoks")), "slot-texts").dropDuplicates(["row", "form", "part"])
    at = asked.join(texts, ["row", "form", "part"]).join(small_side(slotted.drop("icanon")), ["item", "form"])

    def values(x: Column) -> Column:
        pairs = F.transform(x["places"], lambda p: F.struct(F.get("itoks", F.shiftright(p, 32).cast("int")).alias("i"), F.get("dtoks", p.bitwiseAND((1 << 32) - 1).cast("int")).alias("d")))
        return F.struct(x["n_matched"].alias("n_matched"), pairs.alias("pairs"))

    def counted(x: Column) -> Column:
        def count(of) -> Column:
            return F.size(F.array_distinct(F.transform(x["pairs"], of)))

        # The length keeps pairs apart that read the same when joined.
        both = count(lambda p: F.concat(F.char_length(p["i"]).cast("string"), F.lit(":"), p["i"], p["d"]))
        return F.struct(x["n_matched"].alias("n_matched"), count(lambda p: p["i"]).alias("n_slots"), F.greatest(both, count(lambda p: p["d"])).alias("n_values"), F.forall(x["pairs"], lambda p: p["i"] == p["d"]).alias("verbatim"))

    def judged(x: Column) -> Column:
        share = F.when(x["n_values"] == 0, 1.0).otherwise(x["n_slots"] / x["n_values"])
        return F.struct(share.alias("slot_consistency"), x["verbatim"].alias("verbatim"), x["n_matched"].alias("n_matched"), x["n_slots"].alias("n_slots"))

    at = at.select(*same, F.transform("layings", values).alias("pairs"))
    at = at.select(*same, F.transform("pairs", counted).alias("counts"))
    at = at.select(*same, F.array_max(F.transform("counts", judged)).alias("best")).groupBy(*same).agg(F.max("best").alias("best"))
    return plain.unionByName(at)


def without_contaminated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` but those that hold an item."""
    keyed, (a, b) = with_row_key(docs)
    gone = staged(found.select(F.col("row.a").alias(a), F.col("row.b").alias(b)).distinct(), "contaminated")
    return keyed.join(small_side(gone), [a, b], "left_anti").select(*quoted(docs.columns))
