"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact weighted-shingle similarity.

DataFrame functions only. Windows have the sizes that items have. A window is
fingerprinted if it holds as many shingles of items of its size, whichever they
are, as the similarity needs with any of them; no other can be a leak. Which
items a window is near, the blocks of its fingerprint alone tell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, written

#: Words in a shingle (all of an item's, if it has fewer) and the similarity from which a window is a leak.
WORDS, SIMILAR = 5, 0.8
#: Bits of a fingerprint and of each of its blocks; fingerprints up to RADIUS apart are compared. One of the four blocks is then within RADIUS // 4.
BITS, BLOCK, RADIUS = 64, 16, 15
#: Words in a segment of a text, or as many as the longest item has.
SEGMENT = 4096
#: Words are runs of letters and digits, in lower case.
BETWEEN = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """The runs of `width` words, as text."""
    n = F.size(words) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))).otherwise(
        F.array().cast("array<string>")
    )


def simhash(items: Column) -> Column:
    """64-bit fingerprint of an array of strings: each repeat weighs once more; bit b is set if most hashes have it.

    One pass over the hashes: number j of 32 counts bit j in its low half and bit j + 32 in its high half.
    """
    lanes = range(BITS // 2)
    ones = F.lit((1 << 32) + 1)
    zero = F.struct(*(F.lit(0).cast("long").alias(f"c{j}") for j in lanes))
    add = lambda n, h: F.struct(*((n[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(ones)).alias(f"c{j}") for j in lanes))

    def most(n: Column) -> Column:
        def bit(count: Column, b: int) -> Column:
            return F.when(count * 2 > F.size(items), F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))

        low = (bit(n[f"c{j}"].bitwiseAND(F.lit((1 << 32) - 1)), j) for j in lanes)
        high = (bit(F.shiftrightunsigned(n[f"c{j}"], 32), j + 32) for j in lanes)
        return reduce(lambda x, y: x.bitwiseOR(y), [*low, *high])

    return F.aggregate(F.transform(items, lambda s: F.xxhash64(s)), zero, add, most)


def blocks(fingerprint: Column, reach: int) -> Column:
    """(at, bits): every number that differs from a block of the fingerprint in `reach` bits at most, for each of its blocks."""
    masks = F.array(*(F.lit(m) for m in range(1 << BLOCK) if m.bit_count() <= reach))
    block = lambda at: F.shiftrightunsigned(fingerprint, at * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("long"))
    near = lambda at: F.transform(masks, lambda m: F.struct(F.lit(at).alias("at"), block(at).cast("int").bitwiseXOR(m).alias("bits")))
    return F.concat(*(near(at) for at in range(BITS // BLOCK)))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of least counts over sum of greatest counts of the strings in two arrays."""
    count = lambda array, x: F.size(F.filter(array, lambda y: y == x))
    once = F.size(F.array_distinct(b)) == F.size(b)  # then each string of a counts once, if it is there
    counted = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    common = F.when(once, F.size(F.array_intersect(a, b))).otherwise(counted)
    return common / (F.size(a) + F.size(b) - common)


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n_words, width, item_shingles, item_print) of the items that have words."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).withColumn("n_words", F.size("words")).filter("n_words > 0")
    width = F.least(F.col("n_words"), F.lit(WORDS))
    by_width = reduce(lambda c, w: c.when(F.col("width") == w, shingles(F.col("words"), w)), range(1, WORDS + 1), F)
    return (
        words.withColumn("width", width).withColumn("item_shingles", by_width).withColumn("item_print", simhash(F.col("item_shingles"))).drop("words")
    )


def _key(text: Column) -> list[Column]:
    """96 bits that stand for a text; equal texts are looked at once."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("text_a"), F.hash(whole).alias("text_b")]


def _anchors(docs: DataFrame, text_col: str, widths: list[int], item_shingles: DataFrame) -> DataFrame:
    """(text_a, text_b, total, pos, n_words, width): where a text has a shingle of some item of n_words words. One pass for all widths."""
    hashes = F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))
    rows = docs.select(*_key(F.col(text_col)), hashes.alias("h")).withColumn("total", F.size("h")).filter(F.col("total") >= min(widths))
    runs = F.arrays_zip(*(F.slice("h", F.lit(i + 1), F.greatest(F.lit(0), F.col("total") - i)).alias(f"w{i}") for i in range(max(widths))))
    found = rows.select("text_a", "text_b", "total", F.posexplode(runs).alias("pos", "run"))
    shingle = lambda w: F.xxhash64(*(F.col(f"run.w{i}") for i in range(w)))
    if len(widths) == 1:
        found = found.select("text_a", "text_b", "total", "pos", F.lit(widths[0]).alias("width"), shingle(widths[0]).alias("shingle"))
    else:
        each = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), shingle(w).alias("shingle")) for w in widths)))
        found = found.select("text_a", "text_b", "total", "pos", each.alias("s")).select("text_a", "text_b", "total", "pos", "s.width", "s.shingle")
    known = item_shingles.select("n_words", "width", "shingle").distinct()
    return found.filter(F.col("pos") + F.col("width") <= F.col("total")).join(if_small(written(known, "leak-known")), ["width", "shingle"])


def _starts(positions: Column, total: Column, n_words: Column, width: Column, similar: float) -> Column:
    """The starts of all windows that hold enough of the positions (in order) of shared shingles to be `similar`, in order.

    With sizes a and b of the window's and the item's shingles, c in common give
    c / (a + b - c). A window that holds the needed number holds some position
    and the ones after it; each position gives the starts that the one before didn't.
    """
    size = F.least(n_words, total) - width + 1
    need = F.greatest(F.lit(1), F.ceil((size + n_words - width + 1) * similar / (1 + similar) - 1e-9).cast("int"))
    last = F.greatest(F.lit(0), total - n_words)

    def after(i: Column) -> Column:
        known = F.least(F.coalesce(F.get(positions, i - 1), F.lit(-1)), last) + 1
        low, high = F.greatest(known, F.get(positions, i + need - 1) - size + 1), F.least(F.get(positions, i), last)
        return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

    runs = F.size(positions) - need
    return F.when(runs >= 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(runs, F.lit(0))), after))).otherwise(F.array().cast("array<int>"))


def _window_words(windows: DataFrame, texts: DataFrame, longest: int) -> DataFrame:
    """(text_a, text_b, n_words, width, at: (start, words)) of the windows of texts, of equal ones in a text the first.

    Windows are first told apart by 96 bits of their words; those left are cut
    out of segments of their texts, so a long text is many rows' work and no row
    holds more than a segment's windows.
    """
    text, size = ["text_a", "text_b"], max(SEGMENT, longest)
    hashed = windows.join(texts.select(*text, F.transform("words", lambda w: F.xxhash64(w)).alias("h")), text)

    def told(s: Column) -> Column:
        words = F.slice("h", s + 1, F.col("n_words"))
        return F.struct(s.alias("start"), F.xxhash64(words).alias("a"), F.hash(words).alias("b"))

    each = hashed.select(*text, "n_words", "width", F.explode(F.transform("starts", told)).alias("w")).groupBy(*text, "n_words", "width", "w.a", "w.b").agg(F.min("w.start").alias("start"))
    each = each.groupBy(*text, "n_words", "width", F.floor(F.col("start") / size).cast("int").alias("segment")).agg(F.collect_list("start").alias("starts"))
    segment = lambda k: F.struct(k.alias("segment"), F.slice("words", k * size + 1, F.lit(size + longest)).alias("words"))
    segments = texts.select(*text, F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / size).cast("int")), segment)).alias("s")).select(*text, "s.*")
    cut = F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("words", s - F.col("segment") * size + 1, F.col("n_words")).alias("words")))
    return each.join(segments, [*text, "segment"]).select(*text, "n_words", "width", F.explode(cut).alias("at"))


def leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similar: float = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """(text_a, text_b, item_id, start, n_words, similarity): each distinct text's best window for each item that it leaks.

    A window has as many words as the item, or all of a shorter text's. Its
    shingles are compared with the item's as multisets. Null texts and items
    without words leak nothing; no items: no rows. Of equally similar windows
    the first counts. Every window that can reach `similar` is looked at, and
    found if its fingerprint is within `radius` of the item's: about 98 in 100
    at a similarity of 0.8, nearly all above 0.85.
    What belongs to the items is broadcast only if few; else joined by shuffle.
    """
    known = written(benchmark_items(items, item_id_col, item_text_col), "leak-items")
    widths = sorted(r.width for r in known.select("width").distinct().collect()) or [WORDS]
    exploded = known.select("n_words", "width", F.explode("item_shingles").alias("words"))
    hashed = F.split("words", " ")
    exploded = exploded.withColumn("shingle", reduce(
        lambda c, w: c.when(F.col("width") == w, F.xxhash64(*(F.xxhash64(F.element_at(hashed, i + 1)) for i in range(w)))), range(1, WORDS + 1), F
    ))
    anchors = _anchors(docs, text_col, widths, exploded)
    shared = written(anchors.groupBy("text_a", "text_b", "total", "n_words", "width").agg(F.array_sort(F.collect_set("pos")).alias("positions")), "leak-anchors")
    starts = _starts(F.col("positions"), F.col("total"), F.col("n_words"), F.col("width"), similar)
    windows = written(shared.select("text_a", "text_b", "n_words", "width", starts.alias("starts")).filter(F.size("starts") > 0), "leak-windows")

    texts = docs.select(*_key(F.col(text_col)), F.col(text_col).alias("text")).join(
        if_small(written(windows.select("text_a", "text_b").distinct(), "leak-texts")), ["text_a", "text_b"], "left_semi"
    )
    texts = written(texts.groupBy("text_a", "text_b").agg(F.first("text").alias("text")), "leak-texts").select("text_a", "text_b", words_of(F.col("text")).alias("words"))
    slices = _window_words(windows, texts, known.agg(F.max("n_words")).first()[0] or 1)
    by_width = reduce(lambda c, w: c.when(F.col("width") == w, shingles(F.col("at.words"), w)), widths, F)
    prints = slices.select("text_a", "text_b", "n_words", "at.start", by_width.alias("shingles"))
    prints = written(prints.withColumn("print", simhash(F.col("shingles"))), "leak-prints")

    # blocks within `reach` bits meet: the items' side goes most of the way, for there are fewer of them
    reach = radius // (BITS // BLOCK)
    index = known.select("item_id", "n_words", "item_print", F.explode(blocks(F.col("item_print"), reach - reach // 3)).alias("block")).select("item_id", "n_words", "item_print", "block.*")
    probes = prints.select("text_a", "text_b", "n_words", "start", "print", F.explode(blocks(F.col("print"), reach // 3)).alias("block")).select("text_a", "text_b", "n_words", "start", "print", "block.*")
    close = probes.join(if_small(written(index, "leak-index")), ["n_words", "at", "bits"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    close = written(close.select("text_a", "text_b", "n_words", "start", "item_id").distinct(), "leak-close")
    verified = (
        prints.join(close, ["text_a", "text_b", "n_words", "start"])
        .join(if_small(known.select("item_id", "item_shingles"), items="item_shingles"), "item_id")
        .withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("item_shingles")))
        .filter(F.col("similarity") >= similar)
    )
    best = F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start")))
    return verified.groupBy("text_a", "text_b", "item_id").agg(best.alias("best")).select("text_a", "text_b", "item_id", "best.start", "best.n_words", "best.similarity")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) for every document and item that it leaks; clean documents have no row."""
    found = leaks(docs, items, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), *_key(F.col(text_col)))
    return rows.join(if_small(written(found, "leaks")), ["text_a", "text_b"]).select("doc_id", "item_id", "start", "n_words", "similarity")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that leak no item, with their own columns."""
    found = written(leaks(docs, items, text_col, **options).select(F.col("text_a").alias("_leak_a"), F.col("text_b").alias("_leak_b")).distinct(), "leaks")
    a, b = _key(F.col(text_col))
    return docs.join(if_small(found), (a == F.col("_leak_a")) & (b == F.col("_leak_b")), "left_anti")


#: The same result in DuckDB SQL, by exact comparison of every window that shares a shingle with an item.
ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
items as (select item_id, ws, len(ws) as n_words, least(len(ws), 5) as width from b where len(ws) > 0),
item_sh as (select item_id, n_words, width, unnest(range(0, n_words - width + 1)) as item_pos, ws from items),
item_s as (select item_id, n_words, width, item_pos, array_to_string(ws[item_pos + 1 : item_pos + width], ' ') as s from item_sh),
doc_sh as (select doc_id, ws, len(ws) as total, width, unnest(range(0, len(ws) - width + 1)) as pos from d, (select distinct width from items) where len(ws) >= width),
doc_s as (select doc_id, total, width, pos, array_to_string(ws[pos + 1 : pos + width], ' ') as s from doc_sh),
shared as (select doc_id, item_id, n_words, width, total, pos, s from doc_s join (select distinct item_id, n_words, width, s from item_s) using (s, width)),
win as (
  select distinct doc_id, item_id, n_words, width, total, unnest(range(greatest(0, pos - (n_words - width)), least(pos, greatest(0, total - n_words)) + 1)) as start from shared
),
win_c as (
  select w.doc_id, w.item_id, w.start, w.n_words, w.width, w.total, x.s, count(*) as n
  from win w join shared x on x.doc_id = w.doc_id and x.item_id = w.item_id and x.pos between w.start and w.start + w.n_words - w.width
  group by all
),
item_c as (select item_id, s, count(*) as n from item_s group by all),
sim as (
  select doc_id, w.item_id, start, n_words, sum(least(w.n, i.n)) / cast(least(n_words, any_value(total)) + n_words - 2 * any_value(width) + 2 - sum(least(w.n, i.n)) as double) as similarity
  from win_c w join item_c i on w.item_id = i.item_id and w.s = i.s group by 1, 2, 3, 4
),
best as (select *, row_number() over (partition by doc_id, item_id order by similarity desc, start) as rn from sim where similarity >= 0.8)
select doc_id, item_id, cast(start as integer) as start, cast(n_words as integer) as n_words, similarity from best where rn = 1
"""
