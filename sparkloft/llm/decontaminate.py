"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after numbers and names within sentences are replaced by typed placeholders, other
words are lower-cased, marks are dropped. Windows of WORDS template words of the benchmark are hash-joined with those of
the documents. Windows of a document and an item on one alignment (position difference) form a match; if the item has
placeholders there, each of its values must stand for one value throughout, and different names for different names (slot
consistency), so re-parameterised questions are found and chance likeness of templates is not. Windows that more than SHARED_ITEMS
items have (an instruction, the frame of a form) tell nothing of any of them: they are not joined, and neither make a leak nor count for
its share. An item that has no other windows leaks where all of it stands. The plain lower-case words of all windows are joined
too, so copies are found in any case and however many placeholders a window has. A capitalised word that begins a sentence may be a
name or not: windows are joined both ways, and alignments are judged with such words as placeholders and without.

Only DataFrame functions. Of documents only ids, positions and hashes go through the join; texts are read again for slots,
but only those whose text hash is among the matched ones, each once. The benchmark's windows are broadcast only if they
are counted at most BROADCAST_ROWS; beyond, documents' windows are first held against the distinct hashes, if those are at
most BROADCAST_HASHES, and then joined by shuffle. Patterns begin where a run of marks begins and never give back what they
took, so work is linear in a text.

Defined results: null text counts as empty and matches nothing; an item of fewer than WORDS words, even one, matches
where its words stand in full, in any case. Documents are told apart by id and text hash: rows of one id with different texts
are judged each, and `leaks` gives the id's best match; repeated rows count as one document; a null id is an id like
others. Benchmark rows without an id are left out; several texts of one item id are one item. Of equally good matches the
first in a text counts. Very long texts are read whole. Empty tables give empty results. Only the named columns are
read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloft.sources.tables import durable, table

#: Window length; most placeholders in a window; matched windows (or share of an item's) that make a leak.
WORDS, MOST_SLOTS, LEAK_WINDOWS, LEAK_SHARE = 8, 4, 6, 0.5
#: Windows of more items than this are common ones.
SHARED_ITEMS = 5
BROADCAST_ROWS, BROADCAST_HASHES = 500_000, 5_000_000
#: Forms of windows; see `item_windows`.
TEMPLATE, PLAIN, OPEN = 0, 1, 2
WINDOWS = "array<struct<closed:bigint,low:bigint,open:bigint>>"
#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t lb lbs pound pounds ounce ounces ml l liter liters litre "
    "litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars cent cents euro euros usd eur mph kmh hz khz mhz ghz w kw mw v kv a j kj cal kcal"
).split()
#: Words that are numbers ("one" is an article more often).
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
NUMBER, UNIT, NAME, BEGIN = "<number>", "<unit>", "<name>", "\x02"
#: Where a sentence ends, and a word or number.
SENTENCE_END = r"""(?:[.!?:;]+['")*&#$%]*[ \x09-\x0D]+|\n)[ \x09-\x0D]*"""
TOKEN = rf"{BEGIN}?(?:[0-9]+(?:[.,][0-9]+)*[\p{{L}}\p{{N}}]*|[\p{{L}}\p{{N}}]+)"
#: The same, written so that no run is read again from each of its characters.
_SENTENCE_END = r"""(?:(?<![.!?:;])[.!?:;]++['")*&#$%]*+[ \x09-\x0D]++|\n)[ \x09-\x0D]*+"""
_TOKEN = rf"{BEGIN}?(?:[0-9]++(?:[.,][0-9]++)*+[\p{{L}}\p{{N}}]*+|[\p{{L}}\p{{N}}]++)"


def text_id(text: Column) -> Column:
    """XXH64 of the text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def tokens(text: Column) -> Column:
    """Words as written, without marks; the first of a sentence has a mark before it."""
    begun = F.concat(F.lit(BEGIN), F.regexp_replace(text, _SENTENCE_END, " " + BEGIN))
    return F.regexp_extract_all(begun, F.lit(_TOKEN), F.lit(0))


def lowered(words: Column) -> Column:
    return F.transform(words, lambda t: F.lower(F.ltrim(t, F.lit(BEGIN))))


def is_number(low: Column) -> Column:
    return ((low >= "0") & (low < ":")) | low.isin(NUMBER_WORDS)


def capitalised(words: Column, low: Column) -> Column:
    """Numbers and names within sentences as placeholders, other words in lower case."""

    def kind(t: Column, plain: Column) -> Column:
        name = (t != plain) & ~t.startswith(BEGIN) & (F.length(t) > 1) & (F.substring(t, 2, 10**6) == F.substring(plain, 2, 10**6))
        return F.when(is_number(plain), NUMBER).when(name, NAME).otherwise(plain)

    return F.zip_with(words, low, kind)


def template(seen: Column, low: Column) -> Column:
    """Placeholders and lower-case words, one for each token. seen: of `capitalised`; low: the words lower-cased."""
    units = F.array(*map(F.lit, UNITS))

    def kind(c: Column, i: Column) -> Column:
        counted = (c != NUMBER) & (F.get(seen, i - 1) == NUMBER) & F.array_contains(units, F.get(low, i))
        return F.when(counted, UNIT).otherwise(c)

    return F.transform(seen, kind)


def opened(words: Column, closed: Column) -> Column:
    """The template with capitalised words that begin a sentence as names, which they may be."""

    def kind(t: Column, c: Column) -> Column:
        word = F.substring(t, 2, 10**6)
        name = t.startswith(BEGIN) & (F.length(t) > 2) & (word != c) & (c != NUMBER) & (F.lower(word) == c) & (F.substring(t, 3, 10**6) == F.substring(c, 2, 10**6))
        return F.when(name, NAME).otherwise(c)

    return F.zip_with(words, closed, kind)


def templated(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, raw (words as written), low (lower-cased), words (template) and open (with names at the begin of sentences). Each
    list is a column of its own, which later steps refer to more than once, so it is computed once a row and not within a
    loop over its elements."""
    raw = rows.select(*keys, tokens(F.coalesce(F.col("text"), F.lit(""))).alias("raw"))
    low = raw.select(*keys, "raw", lowered(F.col("raw")).alias("low"))
    seen = low.select(*keys, "raw", "low", capitalised(F.col("raw"), F.col("low")).alias("seen"))
    closed = seen.select(*keys, "raw", "low", template(F.col("seen"), F.col("low")).alias("words"))
    return closed.select(*keys, "raw", "low", "words", opened(F.col("raw"), F.col("words")).alias("open"))


def is_slot(t: Column) -> Column:
    return t.isin(NUMBER, UNIT, NAME)


def with_windows(rows: DataFrame, sizes: dict[str, tuple[str, int]]) -> DataFrame:
    """The rows with a list of hashes under each name: of every window of that many words of that list, by its first word. A
    window's hash is made of those of its halves, so each list of hashes is a column that is computed once from shorter ones."""
    for name, (column, size) in sizes.items():
        parts, todo = set(), [size]
        while todo:
            m = todo.pop()
            if m > 1 and m not in parts:
                parts.add(m)
                todo += [m // 2, m - m // 2]
        at = lambda m, name=name, column=column: F.col(column if m == 1 else f"{name}_{m}")
        for m in sorted(parts):
            later = F.slice(at(m - m // 2), m // 2 + 1, F.size(column))
            rows = rows.withColumn(f"{name}_{m}", F.zip_with(at(m // 2), later, lambda a, b: F.xxhash64(a, b)))
        whole = at(size) if size > 1 else F.transform(column, lambda a: F.xxhash64(a))
        rows = rows.withColumn(name, F.slice(whole, 1, F.greatest(F.size(column) - (size - 1), F.lit(0)))).drop(*(f"{name}_{m}" for m in parts))
    return rows


def item_windows(benchmark: DataFrame, size: int = WORDS, most_slots: int = MOST_SLOTS) -> DataFrame:
    """item_id, item_pos, hash and form of the windows that documents are joined with. Form 0, TEMPLATE, has the templates with
    enough fixed words; form 1, PLAIN, also the lower-case words of every window; form 2, OPEN, also the templates with
    names at the begin of sentences. rich: too few fixed words for the template; item_windows: the windows of the
    item, fit_windows: those not rich; slotted: whether placeholders are to be compared; whole: whether all its windows are common
    ones, which only then are here; width: words of the window, less than
    `size` if the item is that short."""
    items = templated(benchmark.where("item_id is not null"), "item_id").where(F.size("low") > 0)
    items = items.withColumn("width", F.least(F.size("low"), F.lit(size)))
    items = with_windows(items, {f"{x}_h": (x, size) for x in ("words", "open")} | {f"low_{w}h": ("low", w) for w in range(1, size + 1)})
    low_h = F.get(F.array(*[F.col(f"low_{w}h") for w in range(1, size + 1)]), F.col("width") - 1)
    items = items.withColumn("low_h", low_h)
    listed = items.withColumn("item_pos", F.explode(F.sequence(F.lit(0), F.size("low") - F.col("width"))))
    cut = {x: F.slice(x, F.col("item_pos") + 1, F.col("width")) for x in ("low", "words", "open")}
    listed = listed.select("item_id", "item_pos", "width", *[v.alias(x) for x, v in cut.items()], *[F.get(f"{x}_h", F.col("item_pos")).alias(f"{x}_h") for x in cut])
    slots = {x: F.size(F.filter(x, is_slot)) for x in ("words", "open")}
    short = F.col("width") < size
    fit = {x: ~short & (n <= most_slots) for x, n in slots.items()}
    forms = [F.struct(F.col("low_h").alias("hash"), F.lit(form).alias("form")) for form in (PLAIN, OPEN)]
    forms += [F.when(fit[x], F.struct(F.col(f"{x}_h").alias("hash"), F.lit(form).alias("form"))) for x, form in (("words", TEMPLATE), ("words", PLAIN), ("words", OPEN), ("open", OPEN))]
    rich, slot = ~short & ~fit["words"], ~short & (slots["open"] > 0)
    base = F.when(fit["words"], F.col("words_h")).otherwise(F.col("low_h"))
    found = listed.select("item_id", "item_pos", "width", base.alias("base"), rich.alias("rich"), slot.alias("slot"), (fit["words"] & (slots["words"] > 0)).alias("fit_slot"), F.array(*forms).alias("forms"))
    found = durable(found)
    common = found.groupBy("base").agg((F.countDistinct("item_id") > SHARED_ITEMS).alias("common"))
    found = durable(found.join(common, "base"))
    found = found.join(found.groupBy("item_id").agg(F.bool_and("common").alias("whole")), "item_id").where("whole or not common")
    count = found.groupBy("item_id").agg(
        F.countDistinct("item_pos").alias("item_windows"), F.countDistinct(F.when(~F.col("rich"), F.col("item_pos"))).alias("fit_windows"),
        F.max("slot").alias("slotted"), F.max("fit_slot").alias("fit_slotted"), F.max("whole").alias("whole"))
    forms = found.select("item_id", "item_pos", "width", "rich", F.explode("forms").alias("f")).where("f is not null")
    forms = forms.select("item_id", "item_pos", "width", "rich", "f.*").distinct().join(count, "item_id")
    return forms.withColumn("slotted", F.when(F.col("form") == TEMPLATE, F.col("fit_slotted")).otherwise(F.col("slotted"))).drop("fit_slotted")


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. One row per document, item, alignment with a common window and form
    of windows: shift, windows, fit, first_pos, last_pos (of the document), item_windows, fit_windows, slotted."""
    items = durable(item_windows(benchmark, size))
    widths = [r["width"] for r in items.where(F.col("width") < size).select("width").distinct().collect()]
    rows = templated(docs.where("text is not null").withColumn("text_id", text_id(F.col("text"))), "doc_id", "text_id")
    widths.sort()
    rows = with_windows(rows, {f"{x}_h": (x, size) for x in ("words", "low", "open")} | {f"low_{w}h": ("low", w) for w in widths})
    none = F.array().cast("array<bigint>")
    lists = [F.arrays_zip("words_h", "low_h", "open_h"), *[F.arrays_zip(f"low_{w}h", none, none) for w in widths]]
    hashed = F.concat(*[x.cast(WINDOWS) for x in lists]) if widths else lists[0].cast(WINDOWS)
    # explode_outer: before explode Spark asks for the list's size and computes the list anew for that
    listed = rows.select("doc_id", "text_id", F.size("low").alias("n"), hashed.alias("found")).select("doc_id", "text_id", "n", F.posexplode_outer("found").alias("at", "w"))
    pos, begin = F.when(F.lit(False), 0), F.lit(0)
    for w in (size, *widths):
        end = begin + F.greatest(F.col("n") - (w - 1), F.lit(0))
        pos, begin = pos.when(F.col("at") < end, F.col("at") - begin), end
    closed, low, open_ = (F.col(f"w.{x}") for x in ("closed", "low", "open"))
    forms = F.array(closed, F.when(low.eqNullSafe(closed), None).otherwise(low), F.when(open_.eqNullSafe(closed) | open_.eqNullSafe(low), None).otherwise(open_))
    listed = listed.select("doc_id", "text_id", pos.alias("pos"), F.posexplode_outer(forms).alias("k", "hash"))
    number = items.count()
    if number <= BROADCAST_ROWS:
        items = F.broadcast(items)
    elif number <= BROADCAST_HASHES:
        listed = listed.join(F.broadcast(items.select("hash").distinct()), "hash", "left_semi")
    once = listed.join(items, "hash").where((F.col("k") == 0) | (F.col("form") != TEMPLATE)).select(
        "doc_id", "text_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "form", "item_pos", "rich", "item_windows", "fit_windows", "slotted", "whole").distinct()
    first, last = F.min("item_pos") + F.col("shift"), F.max("item_pos") + F.col("shift")
    return once.groupBy("doc_id", "text_id", "item_id", "shift", "form").agg(
        F.count("*").alias("windows"), F.count_if(~F.col("rich")).alias("fit"), first.alias("first_pos"), last.alias("last_pos"),
        F.max("item_windows").alias("item_windows"), F.max("fit_windows").alias("fit_windows"), F.max("slotted").alias("slotted"), F.max("whole").alias("whole"))


def slot_values(found: DataFrame, docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """For alignments with placeholders, by text_id, item_id, shift and form: slots (their number), varied (values that differ)
    and consistent. Only texts among `found` are tokenised, each once."""
    asked = durable(found.where("slotted").select("text_id", "item_id", "shift", "form", "first_pos", "last_pos").distinct())
    wanted = durable(asked.select("text_id").distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.where("text is not null").select("text", text_id(F.col("text")).alias("text_id")).join(wanted, "text_id", "left_semi")
    ours = durable(texts.dropDuplicates(["text_id"])).select("text_id", tokens(F.col("text")).alias("ours"))
    theirs = templated(benchmark.where("item_id is not null"), "item_id").select("item_id", F.col("raw").alias("theirs"), "words", F.col("open").alias("names"))
    both = asked.join(ours, "text_id").join(theirs, "item_id").withColumn("template", F.when(F.col("form") == OPEN, F.col("names")).otherwise(F.col("words")))
    places = F.sequence(F.col("first_pos") - F.col("shift"), F.col("last_pos") - F.col("shift") + size - 1)
    slots = F.filter(places, lambda i: is_slot(F.get("template", i)))
    pairs = F.transform(slots, lambda i: F.struct(
        F.lower(F.ltrim(F.get("theirs", i), F.lit(BEGIN))).alias("item"), F.lower(F.ltrim(F.get("ours", i + F.col("shift")), F.lit(BEGIN))).alias("doc")))
    both = both.select("text_id", "item_id", "shift", "form", F.array_distinct(pairs).alias("pairs"))
    names = F.filter("pairs", lambda p: ~is_number(p["item"]) & ~p["item"].isin(UNITS))
    distinct = lambda pairs, side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side])))
    return both.groupBy("text_id", "item_id", "shift", "form").agg(F.max("pairs").alias("pairs")).select(
        "text_id", "item_id", "shift", "form", F.size("pairs").alias("slots"),
        F.size(F.filter("pairs", lambda p: ~p["item"].eqNullSafe(p["doc"]))).alias("varied"),
        ((distinct("pairs", "item") == F.size("pairs")) & (distinct(names, "doc") == F.size(names))).alias("consistent"))


def _best(docs: DataFrame, benchmark: DataFrame, size: int, *keys: str) -> DataFrame:
    """The best match for each of the keys and item."""
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    found = durable(matches(docs, benchmark, size))
    if found.where("slotted").isEmpty():
        judged = found.withColumns({"slots": F.lit(0), "varied": F.lit(0), "consistent": F.lit(True)})
    else:
        judged = found.join(durable(slot_values(found, docs, benchmark, size)), ["text_id", "item_id", "shift", "form"], "left")
        judged = judged.fillna({"slots": 0, "varied": 0}).withColumn("consistent", F.coalesce("consistent", F.lit(True)))
    order = F.struct("consistent", "windows", (-F.col("varied")).alias("same"), (-F.col("shift")).alias("early"), (-F.col("form")).alias("closed"), "text_id")
    base = F.col("form") == TEMPLATE
    total = F.when(base, F.col("fit_windows")).otherwise(F.col("item_windows"))
    share = F.greatest(F.col("windows") / total, F.when(F.col("fit_windows") > 0, F.col("fit") / F.col("fit_windows")))
    leak = F.col("consistent") & F.when(F.col("whole"), share >= 1).otherwise((F.col("windows") >= LEAK_WINDOWS) | (share >= LEAK_SHARE))
    kept = F.struct("windows", total.alias("item_windows"), share.alias("share"), "slots", "varied", "consistent", leak.alias("contaminated"))
    best = judged.groupBy(*keys, "item_id").agg(F.max_by(kept, F.when(base, order)).alias("a"), F.max_by(kept, F.when(~base, F.struct(leak.alias("leak"), order.alias("rest")))).alias("b"))
    plain = F.col("a").isNotNull() & (F.col("a.contaminated") | ~F.col("b.contaminated"))
    best = best.select(*keys, "item_id", F.when(plain, F.col("a")).otherwise(F.col("b")).alias("b")).select(*keys, "item_id", "b.*")
    kind = F.when(~F.col("consistent"), "inconsistent").when(F.col("varied") > 0, "reparameterised").otherwise("verbatim")
    return best.select(*keys, "item_id", "windows", "item_windows", "share", F.col("slots").cast("long").alias("slots"), F.col("varied").cast("long").alias("varied"),
                       kind.alias("kind"), "contaminated")


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """One row per document and item that share a window on a consistent alignment or not: windows (most on one alignment
    that is consistent), item_windows, share (of all windows, or of those with enough fixed words if more), slots, varied, kind (verbatim, reparameterised, inconsistent), contaminated. The figures are of templates alone, item_windows then those with
    enough fixed words, unless only the other forms show a leak or a window."""
    return _best(docs, benchmark, size, "doc_id")


def leaks_by_text(docs: DataFrame, benchmark: DataFrame, size: int = WORDS) -> DataFrame:
    """As `leaks`, by the hash of the text in place of the document's id."""
    return _best(docs, benchmark, size, "text_id")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
