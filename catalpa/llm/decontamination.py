"""Benchmark decontamination: a prefix-filtered join of item-sized windows with whole documents.

A window is WINDOW consecutive words of an item (all of them, where it has fewer). As a set of word shingles it is contained in a document
only if each of its shingles is, so its necessary prefix, shingles ordered from rare to common, is the one rarest shingle.

1. One pass counts, over all documents, the shingles that windows hold.
2. Each window keeps its rarest shingle and that shingle's place in it. A window with a shingle that no document holds is out.
3. A second pass finds the places of kept shingles inside each document's array of words, before anything is exploded, and hands on each
   place with the words around it only.
4. Places meet windows by the shingle. The place fixes where the window would start, so it must start at the first word or later and end at the
   last one or earlier (positional and length bound); then the words themselves are compared.

In 1 and 3 a mask of at most MOST_SLOTS signs, made by Spark, tells shingles that no window has; what passes by chance falls out in the join.
Tables of windows are broadcast only where their summed length is small. Only DataFrame functions are used.

Defined cases: null text is empty; a text without words has no windows, hits or items. Items of one id are one item, whatever their texts; an
item without an id is listed as an empty name. Repeated rows and rows that share an id are told each for itself (by id and a 64-bit hash of the text); a window
that occurs in several items counts for each. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalpa.llm.common import col, small
from catalpa.session import checkpoint

WINDOW = 10
SHINGLE = 4
#: Slots of a mask: so many for each shingle, within these bounds.
SLOTS_EACH, LEAST_SLOTS, MOST_SLOTS = 64, 2**12, 2**23
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII signs that are no digit or lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; Spark's own lower() serves where every sign is one byte."""
    given = F.coalesce(text, F.lit(""))
    lowered = F.when(F.length(given) == F.octet_length(given), F.lower(given)).otherwise(F.translate(given, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BETWEEN), "")


def numbered(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingles(own: Column, size: int) -> Column:
    """array<(len, at, h)>: a hash of so many words from each place on, counted from 0."""
    return F.transform(numbered(F.size(own) - size + 1), lambda at: F.struct(F.lit(size).alias("len"), at.alias("at"), F.xxhash64(*[F.get(own, at + i) for i in range(size)]).alias("h")))


def windows_of(items: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Different windows (w, window, size, words), and which item holds which (w, item)."""
    own = items.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), words(col(text_col)).alias("own")).where("size(own) > 0")
    sized = own.withColumn("size", F.least(F.size("own"), F.lit(window)))
    each = sized.select("item", "size", F.explode(F.transform(numbered(F.size("own") - F.col("size") + 1), lambda at: F.slice("own", at + 1, F.col("size")))).alias("words"))
    held = checkpoint(each.select("item", "size", "words", F.array_join("words", " ").alias("window")).distinct())
    windows = checkpoint(held.select("window", "size", "words").distinct().withColumn("w", F.monotonically_increasing_id()))
    members = held.select("window", "item").join(windows.select("w", "window"), "window").select("w", "item")
    return windows, checkpoint(members)


def shingles_of(windows: DataFrame, size: int) -> DataFrame:
    """(w, len, at, h) of each shingle of each window; a window shorter than a shingle is one of its own length."""
    sizes = {n: F.col("size") == n if n < size else F.col("size") >= n for n in range(1, size + 1)}
    parts = [windows.where(fits).select("w", F.explode(shingles(F.col("words"), n)).alias("x")).select("w", "x.*") for n, fits in sizes.items()]
    return reduce(DataFrame.unionByName, parts)


def mask(hashes: DataFrame, column: str = "h") -> bytes:
    """A '1' for each slot that a hash falls into, else '0'; put together by Spark, at most MOST_SLOTS signs."""
    n = hashes.agg(F.approx_count_distinct(column)).first()[0]
    slots = LEAST_SLOTS
    while slots < min(MOST_SLOTS, SLOTS_EACH * n):
        slots *= 2
    slot = F.pmod(F.col(column), F.lit(slots))
    lit = hashes.groupBy(F.floor(slot / 64).cast("long").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, 63 - cast(pmod(" + column + ", 64) as int))")).alias("bits"))
    rows = hashes.sparkSession.range(slots // 64).join(lit, "id", "left").select("id", F.lpad(F.bin(F.coalesce("bits", F.lit(0).cast("long"))), 64, "0").alias("signs"))
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "signs"))), lambda r: r["signs"]), ""))
    return whole.first()[0].encode()


def masked(h: Column, signs: bytes) -> Column:
    return F.substring(F.lit(signs), F.pmod(h, F.lit(len(signs))).cast("int") + 1, F.lit(1)) == F.lit(b"1")


def places(own: Column, lengths: list[int], signs: bytes) -> Column:
    """array<(len, at, h)> of the shingles, of the given lengths, that the mask lets pass."""
    found = [F.filter(shingles(own, n), lambda p: masked(p["h"], signs)) for n in lengths]
    return found[0] if len(found) == 1 else F.concat(*found)


def rarest(docs: DataFrame, text_col: str, windows: DataFrame, size: int) -> DataFrame:
    """(w, len, at, h): the window's rarest shingle by its count over all documents; none where some shingle is in no document."""
    held = checkpoint(shingles_of(windows, size))
    kinds = checkpoint(held.select("len", "h").distinct())
    lengths = sorted(r[0] for r in kinds.select("len").distinct().collect())  # SHINGLE at most
    if not lengths:
        return held
    seen = docs.select(words(col(text_col)).alias("own")).select(F.explode(places(F.col("own"), lengths, mask(kinds))).alias("p")).select("p.len", "p.h")
    counts = seen.join(small(kinds, F.lit(16)), ["len", "h"], "left_semi").groupBy("len", "h").agg(F.count("*").alias("n"))
    known = held.join(small(checkpoint(counts), F.lit(24)), ["len", "h"], "left")
    least = known.groupBy("w").agg(F.min(F.struct("n", "h", "at", "len")).alias("r"), F.bool_and(F.col("n").isNotNull()).alias("whole"))
    return checkpoint(least.where("whole").select("w", "r.len", "r.at", "r.h"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """A row for each document: (doc_id, n_words, n_hit, spans, items).

    spans: array<(start, end)> of words that windows cover, numbered from 0, the end exclusive, joined where they touch or overlap; items: the
    names of items of which a window occurs, sorted as strings.
    """
    windows, members = windows_of(items, item_col, item_text, window)
    probes = rarest(docs, text_col, windows, min(size, window))
    probes = checkpoint(probes.join(windows.select("w", "window", F.col("size").alias("w_size")), "w"))
    lengths = sorted(r[0] for r in probes.select("len").distinct().collect())  # SHINGLE at most
    own = docs.select(col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(col(text_col), F.lit(""))).alias("mark"), words(col(text_col)).alias("own"))
    if not lengths:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return own.select("doc_id", F.size("own").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("spans"), F.array().cast("array<string>").alias("items"))
    first = lambda p: F.greatest(p["at"] - (window - 1), F.lit(0))
    around = F.transform(places(F.col("own"), lengths, mask(probes)), lambda p: F.struct(p["len"].alias("p_len"), p["at"].alias("place"), p["h"].alias("p_h"), first(p).alias("first"), F.slice("own", first(p) + 1, 2 * window).alias("near")))
    read = checkpoint(own.select("doc_id", "mark", F.size("own").alias("n_words"), around.alias("around")))
    asked = read.where("size(around) > 0").select("doc_id", "mark", "n_words", F.explode("around").alias("p")).select("doc_id", "mark", "n_words", "p.*")
    met = asked.join(small(probes, 48 + F.length("window")), F.expr("p_h = h AND p_len = len")).withColumn("start", F.col("place") - F.col("at"))
    met = met.where("start >= 0 AND start + w_size <= n_words").where(F.array_join(F.slice("near", F.col("start") - F.col("first") + 1, F.col("w_size")), " ") == F.col("window"))
    hits = checkpoint(met.select("doc_id", "mark", F.struct("start", (F.col("start") + F.col("w_size")).alias("end")).alias("span"), "w").distinct())
    key = ["d", "m"]
    keyed = hits.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "span", "w")
    spans = runs(keyed.select(*key, "span"), key)
    found = keyed.select(*key, "w").distinct().join(small(members, 16 + F.length("item")), "w").select(*key, "item").distinct()
    listed = found.groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.col("d").alias("d_"), F.col("m").alias("m_"), "items")
    told = checkpoint(spans.join(listed, F.expr("d <=> d_ AND m = m_")).drop("d_", "m_"))
    out = read.select("doc_id", "mark", "n_words").join(small(told, 32 + 8 * F.size("spans") + F.length(F.array_join("items", ","))), F.expr("doc_id <=> d AND mark = m"), "left")
    return out.select("doc_id", F.col("n_words").cast("long"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def runs(spans: DataFrame, key: list[str]) -> DataFrame:
    """(key, n_hit, spans): spans (key, span) of a document put together where they touch or overlap."""
    ordered = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(*key, "span.*").distinct().withColumn("opens", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    run = opened.withColumn("run", F.sum("opens").over(ordered)).groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return run.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests that op11_decontamination returns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
