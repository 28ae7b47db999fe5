"""Benchmark decontamination by windows of words, in DataFrame operations only.

Texts are read in two forms. The literal form is their lower-case words and numbers. In the template form numbers, capitalised
names and units after numbers become typed placeholders, everything else lower-case words without punctuation; a run of names
is one placeholder, and a capitalised word at a sentence's start is a name unless it is one of STARTERS.

Windows of `window` words of one form are hash-joined between documents and benchmark items; template windows with under half
literal words say nothing and are left out, as are windows that over COMMON_ITEMS different items share, and windows with a word
in one of these, while LEFT others remain of an item. Windows of one document and one item whose distances between their places differ by less than half of BAND belong to one
alignment; a document is contaminated by an item if an alignment has enough different windows (`enough`, or `share` of those the
item has in this form if that is less). An alignment of templates is then checked for its slots: inside the matched windows,
placeholders of one value in the item must have one value in the document, as in a question asked again with other numbers, names
or units, or most values must be unchanged; a chance meeting of templates does neither. Items shorter than a window are joined as
one window of their own length, and those under FEW words only with texts that have no other words.

Each text is read once: its windows of all lengths and both forms are made from one pair of word lists and meet one table.

Null texts have no words and match nothing, as do empty ones; texts of any length are read whole. Items whose canonical text is
empty or all placeholders match nothing. Items with the same words count as one and are all named. Repeated rows each get the same
answer; rows that repeat a doc_id with another text, or have none, are judged each by its own text. Columns other than doc_id, text
and item_id are ignored. Without documents the result is empty, without items nothing is contaminated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fits_broadcast, materialize, text_key

WINDOW, ENOUGH, SHARE = 8, 6, 0.6
#: Items of fewer words are looked for as whole texts.
FEW = 5
#: Windows of more items than this, and those that overlap them, are left out of an item that has LEFT others.
COMMON_ITEMS, LEFT = 16, 3
UNITS = "km|kilometers|kilometres|miles|mi|m|meters|metres|cm|mm|feet|ft|inches|kg|kilograms|g|grams|mg|lb|lbs|pounds|tons|oz|l|liters|litres|ml|gallons|s|sec|seconds|min|minutes|h|hours|days|weeks|months|years|km/h|mph|usd|eur|dollars|euros|cents|percent|degrees|watts|kw|kwh|hz|bytes|kb|mb|gb"
MARK = "\u0002"


#: Distances within half of this belong to one alignment: words put in or left out shift what follows.
BAND = 8
#: Joins the words of a name.
GLUE = "\u0003"
STARTERS = "a|about|according|add|after|all|although|an|and|any|are|as|assume|at|before|besides|both|but|by|calculate|can|choose|compute|consider|could|define|describe|determine|did|do|does|during|each|estimate|every|evaluate|explain|express|find|first|five|for|four|from|give|given|has|have|he|hence|her|here|his|how|however|if|in|is|it|its|last|let|list|many|may|more|most|my|name|next|no|not|now|of|on|once|one|or|our|over|please|prove|she|should|show|simplify|since|so|solve|some|state|suppose|that|the|their|then|there|these|they|this|those|three|thus|to|today|two|under|until|use|was|we|were|what|when|where|which|while|who|whose|why|will|with|without|would|write|yes|you|your"
CAPITAL = rf"\p{{Lu}}[\p{{L}}{GLUE}]*\p{{Ll}}[\p{{L}}{GLUE}]*"
#: The starters by first letter, which is read first.
COMMON = "(?i:" + "|".join(f"{k}(?:{'|'.join(w[1:] for w in STARTERS.split('|') if w[0] == k)})" for k in sorted({w[0] for w in STARTERS.split("|")})) + r")(?!\p{L})"
RUN = rf"(?=\p{{Lu}}[\p{{L}}{GLUE}]*+ ++\p{{Lu}})(?<!\p{{L}})(?!{COMMON})({CAPITAL}) +(?=\p{{Lu}}\p{{L}}*\p{{Ll}})(?!{COMMON})"
NAME = rf"(?=\p{{Lu}})(?<=^|[\p{{Ll}}\p{{N}},.!?;:] |\n)(?!{COMMON})({CAPITAL})"
NUMBER = r"(\d+(?:[.,:/]\d+)*)"
UNIT = rf"({UNITS})(?![\p{{L}}\p{{N}}])"


def _joined(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK + GLUE, "  "), RUN, f"$1{GLUE}")


def literal_words(text: Column) -> Column:
    """Lower-case words and numbers."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def canonical(text: Column) -> Column:
    """The canonical words of a text; a placeholder is the mark and its type (n number, p name, u unit)."""
    t = F.regexp_replace(_joined(text), NAME, f"{MARK}p")
    t = F.lower(F.regexp_replace(t, NUMBER, f" {MARK}n "))
    t = F.regexp_replace(t, rf"{MARK}n +{UNIT}", f"{MARK}n {MARK}u")
    return F.filter(F.split(t, rf"[^\p{{L}}\p{{N}}{MARK}{GLUE}]+"), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """As canonical(), but placeholders also carry their values."""
    t = F.regexp_replace(_joined(text), NAME, f"{MARK}p$1")
    t = F.lower(F.regexp_replace(t, NUMBER, f" {MARK}n$1 "))
    t = F.regexp_replace(t, rf"({MARK}n\S+) +{UNIT}", f"$1 {MARK}u$2")
    return F.filter(F.split(t, rf"(?:[^\p{{L}}\p{{N}}{MARK}{GLUE}.,:/]|(?<!\d)[.,:/]|[.,:/](?!\d))+"), lambda w: w != "")


def _pairs(a: Column, by: int, code: int | None = None) -> Column:
    """A hash of each element, that `by` places on, and the code; a is to be a plain column, since it is read more than once."""
    most = F.greatest(F.size(a) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, most), F.slice(a, 1 + by, most), lambda x, y: F.xxhash64(x, y) if code is None else F.xxhash64(x, y, F.lit(code)))


def _widths(n: int) -> list[int]:
    """1, 2, 4, ... below n."""
    return [1 << k for k in range(max(1, (n - 1).bit_length()))]


def _with_pairs(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with column@2, column@4, ...: hashes of so many consecutive elements of column@1, each a projection of its own, so that none is computed twice."""
    for w in _widths(n)[1:]:
        df = df.withColumn(f"{column}@{w}", _pairs(F.col(f"{column}@{w // 2}"), w // 2))
    return df


def _windows(column: str, n: int, code: int) -> Column:
    """Hashes of n consecutive elements and the code, from the columns of _with_pairs."""
    if n == 1:
        return F.transform(f"{column}@1", lambda x: F.xxhash64(x, F.lit(code)))
    w = _widths(n)[-1]
    return _pairs(F.col(f"{column}@{w}"), n - w, code)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _code(exact: bool, n: int, whole: bool) -> int:
    return 4 * n + 2 * whole + exact


def canonical_items(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (the smallest of those with the same words), twins (all of them), exact (whether in literal form), words, hs@1 (their hashes), n, the words of a window: `window`, or all of a shorter item, and whole: whether only a whole text can match."""
    items = benchmark.select("item_id", canonical(F.col("text")).alias("words"), literal_words(F.col("text")).alias("plain"))
    items = items.where(F.exists("words", lambda w: ~w.startswith(MARK) & (w != "")))
    items = items.groupBy("words", "plain").agg(F.min("item_id").alias("item_id"), F.sort_array(F.collect_set("item_id")).alias("twins"))
    items = items.select("item_id", "twins", (F.size("plain") < FEW).alias("whole"), F.explode(F.array(F.struct(F.lit(True).alias("exact"), F.col("plain").alias("words")), F.struct(F.lit(False).alias("exact"), F.col("words")))).alias("form"))
    items = items.select("item_id", "twins", "whole", "form.exact", "form.words").where("exact OR NOT whole").withColumn("hs@1", _hashes(F.col("words")))
    return items.withColumn("n", F.least(F.lit(window), F.size("words")))


def item_windows(items: DataFrame, forms: list[tuple[bool, int, bool]], enough: int, share: float) -> DataFrame:
    """item_id, exact, n, need, at, h: the windows that count of each item, and how many of them an alignment needs."""
    # A template of placeholders only says nothing; its literal window does.
    literal = lambda at: F.size(F.filter(F.slice("words", at + 1, F.col("n")), lambda w: ~w.startswith(MARK)))
    items = _with_pairs(items, "hs", max(n for _, n, _ in forms))
    items = items.withColumn("kept", F.filter(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda at: F.col("exact") | (literal(at) * 2 >= F.col("n"))))
    of = lambda e, n, w: items.where((F.col("exact") == F.lit(e)) & (F.col("n") == n) & (F.col("whole") == F.lit(w))).withColumn("all", _windows("hs", n, _code(e, n, w)))
    wins = reduce(DataFrame.unionByName, [of(*f).select("item_id", "exact", "n", "all", F.explode("kept").alias("at")) for f in forms])
    wins = wins.select("item_id", "exact", "n", "at", F.get("all", F.col("at")).alias("h"))
    common = wins.groupBy("h").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") > COMMON_ITEMS).select("h", F.lit(True).alias("common"))
    # 2: no word in common with a frequent window of the item, 1: not frequent itself, 0: frequent. An item with one window has no other.
    near = Window.partitionBy("item_id", "exact").orderBy("at").rangeBetween(1 - max(n for _, n, _ in forms), max(n for _, n, _ in forms) - 1)
    wins = wins.join(common, "h", "left").withColumn("rare", F.when(F.col("common"), 0).when(F.max("common").over(near), 1).otherwise(2))
    own = wins.groupBy("item_id", "exact").agg(*[F.count_if(F.col("rare") >= k).alias(f"n{k}") for k in range(3)])
    least = F.when(F.col("n2") >= LEFT, 2).when(F.col("n1") >= LEFT, 1).otherwise(0)
    own = own.select("item_id", "exact", least.alias("least"), F.when(F.col("n2") >= LEFT, F.col("n2")).when(F.col("n1") >= LEFT, F.col("n1")).otherwise(F.col("n0")).alias("counted"))
    wins = wins.join(own, ["item_id", "exact"]).where("rare >= least")
    return wins.select("item_id", "exact", "n", F.least(F.lit(enough), F.ceil(F.lit(share) * F.col("counted"))).cast("int").alias("need"), "at", "h")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, enough: int = ENOUGH, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, twins, exact, n, band, windows, lines: of each shift (place in the document less that in the item) of the alignment the number and places (ats) of its windows, most first. doc_id may be of any type."""
    items = materialize(canonical_items(benchmark, window))
    forms = sorted((r[0], r[1], r[2]) for r in items.select("exact", "n", "whole").distinct().collect())
    if not forms:
        return docs.select("doc_id").where("false").crossJoin(benchmark.select("item_id").where("false")).select("doc_id", "item_id", F.array("item_id").alias("twins"), F.lit(True).alias("exact"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("band"), F.lit(0).alias("windows"), F.lit(None).cast("array<struct<many:int,shift:int,ats:array<int>>>").alias("lines"))
    wins = materialize(item_windows(items, forms, enough, share))
    words = docs.select("doc_id", _hashes(literal_words(F.col("text"))).alias("plain@1"), _hashes(canonical(F.col("text"))).alias("template@1"))
    for column in ("plain", "template"):
        words = _with_pairs(words, column, max((n for e, n, _ in forms if e == (column == "plain")), default=1))

    def of(exact: bool, n: int, whole: bool) -> Column:
        column = "plain" if exact else "template"
        found = _windows(column, n, _code(exact, n, whole))
        return F.when(F.size(f"{column}@1") == n, found).otherwise(F.array().cast("array<bigint>")) if whole else found

    mine = words.select("doc_id", F.explode(F.array(*[of(*f) for f in forms])).alias("hs"))
    mine = mine.select("doc_id", F.posexplode("hs").alias("place", "h"))
    found = mine.join(F.broadcast(wins) if fits_broadcast(wins.count(), 120) else wins, "h").select("doc_id", "item_id", "exact", (F.col("place") - F.col("at")).alias("shift"), "at", "need", "n")
    lined = found.groupBy("doc_id", "item_id", "exact", "n", "need", "shift").agg(F.collect_set("at").alias("ats"))
    # Bands in two places, so that shifts within half a band meet in one of them.
    bands = F.array(2 * F.floor(F.col("shift") / BAND), 2 * F.floor((F.col("shift") + BAND // 2) / BAND) + 1)
    lined = lined.select("doc_id", "item_id", "exact", "n", "need", F.explode(bands).alias("band"), F.struct(F.size("ats").alias("many"), "shift", "ats").alias("line"))
    lined = lined.groupBy("doc_id", "item_id", "exact", "n", "need", "band").agg(F.sort_array(F.collect_list("line"), asc=False).alias("lines"))
    lined = lined.withColumn("windows", F.size(F.array_distinct(F.flatten("lines.ats")))).where(F.col("windows") >= F.col("need"))
    twins = items.select("item_id", "twins", "exact")
    return lined.join(twins, ["item_id", "exact"]).select("doc_id", "item_id", "twins", "exact", "n", "band", "windows", "lines")


def agree(found: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of matches() that are literal or whose slots agree. Texts are read again only if an item has slots."""
    items = benchmark.select("item_id", raw_words(F.col("text")).alias("item")).where(F.exists("item", lambda w: w.startswith(MARK)))
    found = materialize(found)
    if items.isEmpty():
        return found
    slotted = found.where("NOT exact").join(items, "item_id", "left_semi")
    texts = docs.join(slotted.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", raw_words(F.col("text")).alias("words"))
    both = slotted.join(items, "item_id").join(texts, "doc_id")
    slots = F.filter(F.sequence(F.lit(0), F.size("item") - 1), lambda i: F.get("item", i).startswith(MARK))
    # A place is where the shift with the most windows has it, of those with a window over it.
    over = lambda i: F.filter("lines", lambda x: F.exists(x.ats, lambda at: (at <= i) & (i < at + F.col("n"))))
    placed = F.filter(F.transform(slots, lambda i: F.struct(F.get("item", i).alias("a"), F.get("words", i + F.get(over(i), F.lit(0)).shift).alias("b"))), lambda p: p.b.isNotNull())
    both = both.select("doc_id", "item_id", "band", placed.alias("placed"))
    pairs, values = F.array_distinct("placed"), F.array_distinct("placed.a")
    same = F.size(F.filter("placed", lambda p: p.a == p.b))
    bad = both.where((F.size(pairs) != F.size(values)) & (same * 2 <= F.size("placed"))).select("doc_id", "item_id", "band", F.lit(False).alias("exact"))
    return found.join(bad, ["doc_id", "item_id", "exact", "band"], "left_anti")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, enough: int = ENOUGH, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, items (sorted item_ids), windows (the most of one alignment) of each row of docs."""
    keyed = docs.select(text_key().alias("doc_id"), "text")
    good = agree(matches(keyed, benchmark, window, enough, share), keyed, benchmark)
    hit = good.groupBy(F.col("doc_id").alias("key")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("twins")))).alias("items"), F.max("windows").alias("windows"))
    marked = docs.select("doc_id", text_key().alias("key")).join(hit, "key", "left")
    return marked.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("windows", F.lit(0)).alias("windows"))
