"""Benchmark decontamination: a distributed positional inverted index of the corpus, searched from the rarest terms (native).

The index stores every posting (term, document, position) of the benchmark's terms, written once by a single pass over
the texts. The benchmark is cut into windows of consecutive words. A window's lists are adjusted by their offsets and
intersected from the rarest term on: first its list alone, then with that of the next, then with all others.
A document is known by the digest of its text, so copies have one list after the first intersection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, lower_ascii, quoted, small, stash

#: What stands between words once A-Z is lower-cased, and before. Latin classes like these are bitmaps in Java's engine.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH = 10


def _inner(text: Column, between: str) -> Column:
    """The text without what stands before its first and after its last word."""
    return F.btrim(text, F.lit("".join(c for c in map(chr, range(128)) if re.match(between, c))))


def words_of(text: Column) -> Column:
    inner = _inner(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BETWEEN, -1))


def count_words(text: Column) -> Column:
    """As many as words_of gives, without making them."""
    inner = _inner(F.coalesce(text, F.lit("")), BETWEEN_ANY_CASE)
    return F.when(inner == "", 0).otherwise(F.regexp_count(inner, F.lit(BETWEEN_ANY_CASE)) + 1).cast("long")


def windows_of(items: DataFrame, item: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary (term, t), distinct windows (wid, terms) and (wid, item). An item of fewer words is one window; without words, none."""
    w = items.select(quoted(item).alias("item"), words_of(quoted(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    w = cut(w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), length).alias("phrase")).distinct())
    terms = cut(w.select(F.explode("phrase").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()))
    windows = cut(w.select("phrase").distinct().withColumn("wid", F.monotonically_increasing_id()))
    owners = cut(w.join(small(windows), "phrase").select("wid", "item"))
    placed = windows.select("wid", F.posexplode("phrase").alias("o", "term")).join(small(terms), "term")
    numbered = placed.groupBy("wid").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: x["t"]).alias("terms"))
    return terms, cut(numbered), owners


def keyed(text: Column) -> list[Column]:
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t).alias("k0"), F.xxhash64(F.lit(1), t).alias("k1")]


def build_index(docs: DataFrame, text: str, vocabulary: DataFrame) -> DataFrame:
    """(t, k0, k1, pos): the stored postings of the vocabulary's terms; pos counts words from 0. One pass over the texts."""
    words = docs.select(*keyed(quoted(text)), F.posexplode(words_of(quoted(text).cast("string"))).alias("pos", "term"))
    return stash(words.join(small(vocabulary), "term").select("t", "k0", "k1", "pos"), "postings")


def by_rarity(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(wid, terms, lists): lists are (n, o, t), the n postings of a window's terms and their offsets, rarest first.

    Windows with a term that never occurs are left out.
    """
    counts = cut(index.groupBy("t").agg(F.count("*").alias("n")))
    each = windows.select("wid", "terms", F.posexplode("terms").alias("o", "t")).join(small(counts), "t")
    lists = each.groupBy("wid").agg(F.first("terms").alias("terms"), F.array_sort(F.collect_list(F.struct("n", "o", "t"))).alias("lists"))
    return cut(lists.where(F.size("lists") == F.size("terms")))


def _lists_of(index: DataFrame, lists: DataFrame, k: int, *more: str) -> DataFrame:
    """Postings of the k-th list of each window, with the window's wid, o and others of its columns."""
    one = cut(lists.where(F.size("lists") > k).select("wid", *more, F.col("lists")[k]["t"].alias("t"), F.col("lists")[k]["o"].alias("o")))
    return index.join(small(one), "t")


def phrase_matches(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(k0, k1, wid, start, length) of every exact occurrence of a window."""
    at = ["k0", "k1", "wid", "start"]
    first = _lists_of(index, lists, 0).select("k0", "k1", "wid", (F.col("pos") - F.col("o")).alias("start")).where("start >= 0").distinct()
    first = stash(first.join(small(lists.select("wid", "lists"), width=F.size("lists") * 20), "wid"), "candidates")
    whole = first.where(F.size("lists") == 1).select(*at, F.lit(1).alias("length"))
    # The second list alone cuts most of the rest off; postings are counted once whatever the copies of a text.
    next_terms = cut(lists.where(F.size("lists") > 1).select(F.col("lists")[1]["t"].alias("t")).distinct())
    second = index.join(small(next_terms), "t", "left_semi").select("k0", "k1", "t", "pos").distinct()
    need = F.col("lists")[1]
    tried = first.where(F.size("lists") > 1).select("*", need["t"].alias("t"), (F.col("start") + need["o"]).alias("pos"))
    left = stash(tried.join(second, ["k0", "k1", "t", "pos"], "left_semi").select(*at, "lists"), "candidates")
    whole = whole.unionByName(left.where(F.size("lists") == 2).select(*at, F.lit(2).alias("length")))
    left = left.where(F.size("lists") > 2)
    held = cut(left.select("k0", "k1").distinct())
    rest = index.join(small(held), ["k0", "k1"], "left_semi").select("k0", "k1", "t", "pos").distinct()
    probes = left.select(*at, F.size("lists").alias("length"), F.explode(F.slice("lists", 3, F.size("lists") - 2)).alias("x"))
    probes = probes.select(*at, "length", F.col("x.t").alias("t"), (F.col("start") + F.col("x.o")).alias("pos"))
    met = probes.join(rest, ["k0", "k1", "t", "pos"]).groupBy(*at, "length").agg(F.count("*").alias("met"))
    return whole.unionByName(met.where("met = length - 2").select(*at, "length"))


def proximity_matches(index: DataFrame, lists: DataFrame, slop: int, length: int = LENGTH) -> DataFrame:
    """(k0, k1, wid, pos): places of a window's rarest term within whose reach all of its terms stand, in any order.

    All must lie in as many consecutive words as the window has, and slop more, that hold the rarest term. The second term
    must stand near first, then all are gathered: never more than twice the reach of a place.
    """
    reach = length + slop
    span = F.size("terms") + slop
    bucket = lambda c: F.floor(F.col(c) / reach)
    lists = cut(lists.select("wid", "terms", F.array_distinct(F.transform("lists", lambda x: F.struct(x["t"].alias("t"), F.lit(0).alias("o")))).alias("lists")))
    wide = small(lists, width=F.size("terms") * 28)
    first = _lists_of(index, lists, 0).select("k0", "k1", "wid", "pos").distinct()
    first = stash(first.join(wide, "wid"), "candidates")
    around = first.where(F.size("lists") > 1).withColumn("t", F.col("lists")[1]["t"]).withColumn("b", F.explode(F.sequence(bucket("pos") - 1, bucket("pos") + 1)))
    next_terms = cut(lists.where(F.size("lists") > 1).select(F.col("lists")[1]["t"].alias("t")).distinct())
    near = index.join(small(next_terms), "t", "left_semi").select("k0", "k1", "t", F.col("pos").alias("q")).distinct()
    pairs = around.join(near.withColumn("b", bucket("q")), ["k0", "k1", "t", "b"]).where(F.abs(F.col("q") - F.col("pos")) < span)
    left = stash(pairs.select("k0", "k1", "wid", "pos").distinct().join(wide, "wid"), "candidates")
    held = cut(left.select("k0", "k1").distinct())
    rest = index.join(small(held), ["k0", "k1"], "left_semi").select("k0", "k1", "t", F.col("pos").alias("q")).distinct().withColumn("b", bucket("q"))
    around = left.withColumn("b", F.explode(F.sequence(bucket("pos") - 1, bucket("pos") + 1)))
    met = around.join(rest, ["k0", "k1", "b"]).where((F.abs(F.col("q") - F.col("pos")) < span) & F.array_contains("terms", F.col("t")))
    met = met.groupBy("k0", "k1", "wid", "pos").agg(F.first("terms").alias("terms"), F.collect_set(F.struct("q", "t")).alias("found"))
    starts = F.sequence(F.col("pos") - span + 1, F.col("pos"))
    inside = lambda s: F.transform(F.filter("found", lambda x: (x["q"] >= s) & (x["q"] < s + span)), lambda x: x["t"])
    all_there = F.exists(starts, lambda s: F.size(F.array_except("terms", inside(s))) == 0)
    return met.where(all_there).select("k0", "k1", "wid", "pos").unionByName(first.where(F.size("lists") == 1).select("k0", "k1", "wid", "pos"))


def find_phrases(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", length: int = LENGTH
) -> tuple[DataFrame, DataFrame]:
    """All exact matches (k0, k1, wid, start, length) and (wid, item) of the benchmark's windows. Null texts have no words."""
    terms, windows, owners = windows_of(items, item, item_text, length)
    index = build_index(docs, text, terms)
    return cut(phrase_matches(index, by_rarity(index, windows))), owners


def contamination(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", length: int = LENGTH,
) -> DataFrame:
    """A row per row of docs: doc, n_words, n_hit (words inside any occurrence of a window), the items found, contaminated.

    Texts decide, so ids may repeat or be null. Null or empty texts and benchmark items have no words; items that repeat
    an id are one; a null id is no item, but its words are hit. Empty tables: empty result, or no hits.
    """
    matches, owners = find_phrases(docs, items, text, item, item_text, length)
    key = ["k0", "k1"]
    end = F.col("start") + F.col("length")
    before = W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    spans = matches.groupBy(*key, "start").agg(F.max(end).alias("end"))
    spans = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.groupBy(*key).agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    of = matches.select(*key, "wid").distinct().join(small(owners), "wid").select(*key, F.col("item").cast("string").alias("item"))
    of = of.distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = cut(hit.join(of, key, "left"))
    found = small(found, width=F.octet_length(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")) + 40)
    # Counted without building the words.
    rows = docs.select(quoted(doc).alias("doc"), *keyed(quoted(text)), count_words(quoted(text).cast("string")).alias("n_words"))
    return rows.join(found, key, "left").select(
        F.col("doc").alias(doc), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def contamination_report(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    return found.select(
        doc, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
