"""Benchmark items in documents, also with other numbers, names and units: templates, window joins, slot checks.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbspark.functions.sizes import broadcast_if_small
from plumbspark.llm.blocks import rows_of
from plumbspark.llm.storage import written

WINDOW = 8
#: Matched windows that make an item found; an item with fewer windows needs all of them.
ENOUGH = 6
#: So many different beginnings of item windows go to the tasks; beyond it every window of every text is hashed.
STARTS = 50_000
NUMBER, UNIT, NAME = "§d", "§u", "§n"
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons ml cl l liter liters litre litres gallon gallons ms s second seconds minute minutes min h "
    "hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees"
).split()


def tokens_text(text: Column) -> Column:
    """Runs of letters and digits, a space between two; a point or comma inside a number becomes ``_``."""
    joined = F.regexp_replace(F.translate(text, "_", " "), r"(\p{N})[.,](\p{N})", "$1_$2")
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}_]+", " "))


def template_text(tokens: Column) -> Column:
    """The tokens with a placeholder for each that starts with a digit or a capital letter, and for a unit
    after a number; the others in lower case."""
    t = F.regexp_replace(tokens, r"(?<![^ ])\p{N}[^ ]*", NUMBER)
    t = F.regexp_replace(t, rf"(?<=§d )(?i:{'|'.join(UNITS)})(?![^ ])", UNIT)
    return F.lower(F.regexp_replace(t, r"(?<![^ ])\p{Lu}[^ ]*", NAME))


def folded(tokens: Column) -> Column:
    """The tokens without regard to case: by way of capitals, so that letters with several small forms meet;
    an eszett as the two letters that its capitals are."""
    return F.replace(F.lower(F.upper(tokens)), F.lit("ß"), F.lit("ss"))


def _templates(rows: DataFrame, key: str) -> DataFrame:
    """key, raw, template and plain (the raw tokens folded): arrays of equal length, of one empty text where
    there is no token.

    No filter on them here: it would be pushed below and compute the texts twice."""
    spaced = rows.select(key, tokens_text(F.col("text")).alias("tokens"))
    return spaced.select(
        key,
        F.split("tokens", " ").alias("raw"),
        F.split(template_text(F.col("tokens")), " ").alias("template"),
        F.split(folded(F.col("tokens")), " ").alias("plain"),
    )


def _start(tokens: str, at: Column, size: int) -> Column:
    """A hash of the first two tokens of a window, or of the one that it has."""
    return F.xxhash64(*[F.get(tokens, at + k) for k in range(min(2, size))])


def _windows(rows: DataFrame, key: str, at: str, size: int, starts: list[int] | None) -> DataFrame:
    """(key, at, size, window): a hash of each run of ``size`` template tokens, and one of the same run of folded
    tokens where it isn't the same. No folded token looks like a placeholder, so both kinds share one column.

    With ``starts`` only the runs that begin like one of them are hashed: the others match nothing."""
    n = F.lit(size)
    whole = f"size(template) >= {size} AND template[0] != ''"
    # no filter on the texts' arrays, and none that Spark infers from an inner explode: either computes them twice
    places = F.expr(f"CASE WHEN {whole} THEN sequence(0, size(template) - {size}) ELSE array() END")
    if starts is not None:
        known = ", ".join(f"{h}L" if h > -(2**63) else "(-9223372036854775807L - 1L)" for h in starts)
        begins = [f"xxhash64({', '.join(f'get({c}, i + {k})' for k in range(min(2, size)))}) IN ({known})" for c in ("template", "plain")]
        places = F.expr(f"filter(CASE WHEN {whole} THEN sequence(0, size(template) - {size}) ELSE array() END, i -> {' OR '.join(begins)})")
    both = F.transform(
        places,
        lambda i: F.struct(
            i.alias("at"),
            F.array_distinct(F.array(F.xxhash64(F.slice("template", i + 1, n)), F.xxhash64(F.slice("plain", i + 1, n)))).alias("windows"),
        ),
    )
    each = rows.select(key, n.alias("size"), F.explode_outer(both).alias("w")).where("w IS NOT NULL")
    each = each.select(key, "size", F.col("w.at").alias(at), "w.windows")
    return each.select(key, "size", at, F.explode("windows").alias("window"))


def item_windows(items: DataFrame, size: int = WINDOW, slot_heavy: bool = False) -> DataFrame:
    """(item_id, ipos, size, window, start, slots, n_windows) of the windows in which at least half of the tokens are
    words, twice: by the template with ``slots`` (place in the window, value), and by the folded tokens, where
    these differ, without slots. With ``slot_heavy`` the other windows are there too, by the folded tokens only.
    An item of fewer tokens than ``size`` is one window. ``start`` hashes a window's first tokens."""
    made = _templates(items, "item_id").where(F.get("template", F.lit(0)) != "").withColumn("n", F.least(F.size("template"), F.lit(size)))
    places = F.sequence(F.lit(1), F.size("template") - F.col("n") + 1)
    each = made.select(
        "item_id", "n", "raw", "template", "plain", F.explode(places).alias("p")
    )
    part = F.slice("template", F.col("p"), F.col("n"))
    slots = F.filter(
        F.transform(
            F.arrays_zip(part.alias("t"), F.slice("raw", F.col("p"), F.col("n")).alias("r")),
            lambda x, i: F.struct(i.alias("place"), F.lower(x["r"]).alias("value"), F.startswith(x["t"], F.lit("§")).alias("slot")),
        ),
        lambda x: x["slot"],
    )
    found = each.select(
        "item_id",
        (F.col("p") - 1).alias("ipos"),
        F.col("n").alias("size"),
        F.xxhash64(F.slice("template", F.col("p"), F.col("n"))).alias("window"),
        F.xxhash64(F.slice("plain", F.col("p"), F.col("n"))).alias("plain"),
        *[
            F.when(F.col("n") == 1, _start(c, F.col("p") - 1, 1)).otherwise(_start(c, F.col("p") - 1, 2)).alias(f"{c}_start")
            for c in ("template", "plain")
        ],
        slots.alias("slots"),
    )
    wordy = 2 * F.size("slots") <= F.col("size")
    found = found if slot_heavy else found.where(wordy)
    totals = found.groupBy("item_id").agg(F.count("*").alias("n_windows"))
    none = F.filter("slots", lambda s: F.lit(False)).alias("slots")
    by_template = found.where(wordy).select("item_id", "ipos", "size", "window", F.col("template_start").alias("start"), "slots")
    by_plain = found.where("plain != window").select("item_id", "ipos", "size", F.col("plain").alias("window"), F.col("plain_start").alias("start"), none)
    return by_template.unionByName(by_plain).join(totals, "item_id")


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    enough: int = ENOUGH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slot_heavy: bool = False,
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows): the items that documents hold.

    Numbers, capitalised words and units become typed placeholders. Windows of ``size`` template tokens of
    every whole text are hash-joined with the items' windows, and so are the same windows of plain tokens
    regardless of case, so copies in capitals or small letters match too. Of the windows that agree on one
    offset, the placeholders must map each value of the item to one value of the document; the windows of
    consistent offsets count, once by whichever key. An item is found with ``enough`` windows, or all of its
    own if it has fewer.

    Rows with a NULL id can't be named and are left out, as are NULL texts and texts without a letter or
    digit; repeated rows give one result row; rows with one id are read as one document's texts. Windows of
    more placeholders than words are left out, and items of nothing else can't be found, unless ``slot_heavy``
    is set: then they match by their own values and count in n_windows. Empty tables give no rows.
    """
    rows = rows_of(docs, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL")
    named = items.select(items[item_id_col].cast("bigint").alias("item_id"), items[item_text_col].alias("text"))
    wanted = written(item_windows(named.where("item_id IS NOT NULL AND text IS NOT NULL").distinct(), size, slot_heavy), "item-windows")
    texts = _templates(rows, "doc_id")
    keys = broadcast_if_small(wanted.select("item_id", "ipos", "size", "window", "slots", "n_windows"))
    found = None
    for n in sorted(r["size"] for r in wanted.select("size").distinct().collect()):  # one, or the short items' lengths too
        starts = [r.start for r in wanted.where(F.col("size") == n).select("start").distinct().limit(STARTS + 1).collect()]
        hits = _windows(texts, "doc_id", "pos", n, starts if len(starts) <= STARTS else None).join(keys, ["size", "window"])
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_matched long, n_windows long")
    found = found.select("doc_id", "item_id", "pos", "ipos", "slots", "n_windows", (F.col("pos") - F.col("ipos")).alias("shift"))
    found = written(found, "item-hits")  # read twice below, while the windows of all texts are made once
    many = found.groupBy("doc_id", "item_id").agg(F.count_distinct("ipos").alias("n"), F.first("n_windows").alias("n_windows"))
    enough_of = F.least(F.lit(enough), F.col("n_windows"))
    many = many.where(F.col("n") >= enough_of).select("doc_id", "item_id")
    # one row for each offset: its windows, and each slot once by its place in the document
    offsets = found.join(many, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", "shift", "ipos", "n_windows",
        F.transform("slots", lambda s: F.struct((F.col("pos") + s["place"]).alias("at"), s["value"].alias("value"))).alias("slots"),
    )
    offsets = offsets.groupBy("doc_id", "item_id", "shift").agg(
        F.count_distinct("ipos").alias("n"), F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots")
    )
    held = rows.join(broadcast_if_small(many.select("doc_id").distinct()), "doc_id", "left_semi")
    # a text that stands under one id more than once is told apart by its own offsets' check
    raw = held.dropDuplicates().select("doc_id", F.split(tokens_text(F.col("text")), " ").alias("raw"))
    paired = offsets.join(raw, "doc_id").select(
        "doc_id", "item_id", "shift", "n", "n_windows",
        F.array_distinct(
            F.transform("slots", lambda s: F.struct(s["value"].alias("item"), F.lower(F.get(F.col("raw"), s["at"])).alias("doc")))
        ).alias("pairs"),
    )
    one_to_one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    whole = paired.where(one_to_one).groupBy("doc_id", "item_id", "shift").agg(F.max("n").alias("n"), F.first("n_windows").alias("n_windows"))
    sums = whole.groupBy("doc_id", "item_id").agg(F.sum("n").alias("n"), F.first("n_windows").alias("n_windows"))
    return sums.where(F.col("n") >= enough_of).select(
        "doc_id", "item_id", F.least("n", "n_windows").cast("long").alias("n_matched"), F.col("n_windows").cast("long").alias("n_windows")
    )
