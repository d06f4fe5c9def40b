"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become sequences of tokens: numbers, names (words of a capital and then a small letter) and units after a number are replaced by
typed placeholders, all else is lower-cased, punctuation parts words. Windows of `window` tokens of documents and benchmark items are hash-joined
and compared token by token. As a sentence's first word may be a name or not, and as copies may lose their capitals, an item's windows come in
up to four forms: each capitalised word a name, only those within sentences, these and the text's first word, or none.

Windows on one diagonal (same distance of positions in document and item) make one occurrence. Its slots must be consistent: equal values of
the item stand for equal values of the document. An occurrence whose slots clash counts by its verbatim windows. It
counts from `least` windows on, or all of the item's windows where it has fewer.

An item shorter than a window is by default compared with documents that are as short as it. With `short_items` it is also looked for
inside longer documents, by windows of its own length; there an item of placeholders alone is found with its own values only,
as its template would fit any. The query and the pipeline set it.

Scale: the windows of the benchmark, some 300 bytes each, are broadcast only while their number is within `broadcast_windows`. Above that a join
of hashes alone finds the documents that hold any, and only their windows are joined whole. Joined rows grow with the number of matching windows alone.

Defined results: null texts count as empty; a text with fewer tokens than a window is one window, padded; texts without tokens
match nothing; rows with equal doc_id are judged together; a null doc_id is one id; items with equal text are separate items.
Columns besides doc_id and text, item_id and text aren't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

WINDOW, LEAST, BROADCAST_WINDOWS = 8, 3, 200_000
#: Placeholders: private characters, which texts don't hold as words.
NAME, NUMBER, UNIT, AFTER = "\ue001", "\ue002", "\ue003", "\ue004"
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks "
    "month months year years mph cm2 m2 km2 percent dollars dollar cents cent euros euro pounds pound usd eur gbp meters metres meter metre "
    "kilometers kilometres grams gram kilograms kilogram liters litres liter litre inches inch feet foot yards yard miles mile degrees degree"
).split()
_WORDS, _GLUED = "|".join(UNITS), "|".join(u for u in UNITS if u.isalpha())


#: Which capitalised words are names, as patterns with the word as their last group.
EVERY, WITHIN, NONE = r"()(?<!\p{L})(\p{Lu}\p{Ll}\p{L}*)", r"([\p{Ll}\p{N},] )(\p{Lu}\p{Ll}\p{L}*)", ""
FIRST = r"(^\P{L}*(?=\p{L}\p{Ll})|[\p{Ll}\p{N},] (?=\p{Lu}\p{Ll}))(\p{L}+)"


def marked_tokens(text: Column, names: str = EVERY) -> Column:
    """Array of tokens; those that a placeholder stands for begin with it and go on with the raw token."""
    named = F.lower(F.regexp_replace(text, names, f"$1{NAME}$2") if names else text)
    simple = F.split(named, rf"[^\p{{L}}{NAME}]+")
    # separators stay inside numbers
    spaced = F.regexp_replace(named, rf"(?:[^\p{{L}}\p{{N}}.,{NAME}]|[.,](?!\p{{N}})|(?<!\p{{N}})[.,])+", " ")
    numbers = F.regexp_replace(spaced, r"(?<![^ ])(\p{N}[\p{N}.,]*(?:" + _GLUED + r")?(?![^ ]))", NUMBER + "$1")
    units = F.regexp_replace(numbers, rf"({NUMBER}[\p{{N}}.,]+ )((?:{_WORDS})(?![^ ]))", f"$1{UNIT}$2")
    return F.array_remove(F.when(F.col("numeric"), F.split(units, " ")).otherwise(simple), "")


def template_token(token: Column) -> Column:
    """The placeholder of a marked token, any other token itself."""
    return F.when((token >= NAME) & (token < AFTER), F.substring(token, 1, 1)).otherwise(token)


def windows(texts: DataFrame, key: str, window: int, shorter: tuple[int, ...] = (), names: str = EVERY) -> DataFrame:
    """key, pos, w0.., h: each window of marked tokens with the hash of its template. shorter: further lengths of windows, padded; a text of
    just that length has its one padded window anyway. With them, len is the window's length."""
    text = F.coalesce("text", F.lit(""))
    rows = texts.select(key, text.alias("text"), text.rlike(r"\p{N}").alias("numeric"))
    # the generator keeps the optimiser from copying the tokens' expression into each of their uses
    rows = rows.select(key, F.explode(F.array(marked_tokens(F.col("text"), names))).alias("t")).where(F.size("t") > 0)
    length, kept = F.lit(window), [key]
    if shorter:
        length, kept = F.col("len"), [key, "len"]
        rows = rows.select(key, F.explode(F.array(*map(F.lit, (window, *shorter)))).alias("len"), "t").where((length == window) | (F.size("t") > length))
    rows = rows.select(*kept, F.when((length == window) & (F.size("t") < window), F.concat("t", F.array_repeat(F.lit(""), window - F.size("t")))).otherwise(F.col("t")).alias("t"))
    number = F.size("t") - length + 1
    shifted = [F.slice("t", i + 1, number) for i in range(window)]
    if shorter:
        shifted = [F.when(length > i, s).otherwise(F.array_repeat(F.lit(""), number)) for i, s in enumerate(shifted)]
    rows = rows.select(*kept, F.posexplode(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])).alias("pos", "w"))
    rows = rows.select(*kept, "pos", *[F.col(f"w.w{i}").alias(f"w{i}") for i in range(window)])
    return rows.withColumn("h", F.xxhash64(*[template_token(F.col(f"w{i}")) for i in range(window)]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, broadcast_windows: int = BROADCAST_WINDOWS, short_items: bool = False) -> DataFrame:
    """doc_id, item_id, windows, item_windows, changed_slots, occurrences: a row for each document and item found in it."""
    forms = [windows(benchmark, "item_id", window, names=names) for names in (EVERY, WITHIN, FIRST, NONE)]
    # a form that changes nothing in a window repeats it
    item = reduce(DataFrame.unionByName, forms).distinct()
    sizes = item.groupBy("item_id").agg(F.countDistinct("pos").alias("item_windows"))
    item = _with_sizes(item, sizes)
    renamed = item.select("item_id", "item_windows", F.col("pos").alias("item_pos"), F.col("h").alias("item_h"), *[F.col(f"w{i}").alias(f"b{i}") for i in range(window)])
    # a count decides: the benchmark isn't bounded by itself
    few = item.count() <= broadcast_windows
    same = F.col("h") == F.col("item_h")
    for i in range(window):
        same &= template_token(F.col(f"w{i}")) == template_token(F.col(f"b{i}"))
    slot = [(F.col(f"w{i}"), F.col(f"b{i}")) for i in range(window)]
    shorter = _short_lengths(item, window) if short_items else ()
    if shorter:
        plain, equal = F.lit(False), F.lit(True)
        for w, b in slot:
            plain |= (b != "") & ~((b >= NAME) & (b < AFTER))
            equal &= w == b
        same &= (F.col("len") == window) | plain | equal
    if few:
        renamed = F.broadcast(renamed)
    else:
        hashes = renamed.select("item_h").distinct()
        holding = windows(docs, "doc_id", window, shorter).select("doc_id", "h").join(hashes, F.col("h") == F.col("item_h"), "left_semi").select(F.col("doc_id").alias("holder")).distinct()
        docs = docs.select("doc_id", "text").join(holding, F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
    pairs = windows(docs, "doc_id", window, shorter).join(renamed, same)
    verbatim = F.lit(True)
    for w, b in slot:
        verbatim &= w == b
    slots = F.filter(F.array(*[F.when((w >= NAME) & (w < AFTER), F.struct(F.substring(w, 1, 1).alias("kind"), b.alias("b"), w.alias("d"))) for w, b in slot]), lambda s: s.isNotNull())
    runs = (
        pairs.select("doc_id", "item_id", "item_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal"), slots.alias("slots"), verbatim.alias("verbatim"))
        .groupBy("doc_id", "item_id", "diagonal")
        .agg(F.max("item_windows").alias("item_windows"), F.count(F.lit(1)).alias("windows"), F.sum(F.col("verbatim").cast("int")).alias("verbatim"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    )
    values = F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["kind"], s["b"]))))
    consistent = values == F.size("slots")
    runs = runs.withColumn("windows", F.when(consistent, F.col("windows")).otherwise(F.col("verbatim")))
    changed = F.when(consistent, F.size(F.filter("slots", lambda s: s["b"] != s["d"]))).otherwise(0)
    kept = runs.where(F.col("windows") >= F.least(F.lit(least), F.col("item_windows")))
    return kept.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"), F.max(changed).cast("long").alias("changed_slots"), F.count(F.lit(1)).alias("occurrences"))


def _short_lengths(item: DataFrame, window: int) -> tuple[int, ...]:
    """The lengths below the window that items have; fewer than the window, however many items there are."""
    length = sum(((F.col(f"w{i}") != "").cast("int") for i in range(1, window)), F.lit(1))
    return tuple(sorted(r[0] for r in item.where(F.col(f"w{window - 1}") == "").select(length.alias("n")).distinct().collect()))


def _with_sizes(item: DataFrame, sizes: DataFrame) -> DataFrame:
    named = sizes.select(F.col("item_id").alias("sized_id"), "item_windows")
    return item.join(named, F.col("item_id").eqNullSafe(F.col("sized_id"))).drop("sized_id")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options: int | bool) -> DataFrame:
    """The rows of docs, all columns as they are, without documents that hold an item."""
    name = unused("found_id", docs)
    found = find_contamination(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
