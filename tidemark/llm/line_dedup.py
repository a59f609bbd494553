"""Line dedup: a suffix array over line ids by distributed prefix doubling (native).

Lines get ranks by their digests; ranks of twice as many lines follow by ranking pairs, until no suffix
shares its prefix with another. Suffixes of one rank at a depth are a longest-common-prefix interval: a run of so many
lines that occurs more than once. All but the first of an interval are later copies, and the lines they cover go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, as_row, from_row, join_hot, quoted, stash

MIN_LINES = 2
#: A document: its id and its text's digest. Rows that share both are one document; null ids come last.
DOC = ["id", "digest"]


def _at() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "digest", "no")


def _lines(docs: DataFrame, long_words: int | None) -> DataFrame:
    """(id, digest, no, a, b, long): the lines with a word, numbered within their document without the blank ones; a, b: digest."""
    kept = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(SPACE_WORD))
    e = docs.select(*DOC, F.posexplode(kept).alias("no", "line"))
    long = F.lit(False) if long_words is None else F.regexp_count("line", F.lit(SPACE_WORD)) >= long_words
    return e.select(*DOC, "no", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"), long.alias("long"))


def _ranked(df: DataFrame, total: int) -> DataFrame:
    """df (id, digest, no, a, b, ..) with a rank per distinct (a, b), and the first place that has it; total: rows of df, or more.

    Rows whose pair occurs once are left out. Pairs are counted before the shuffle, and hot ones are joined in parts,
    so a line that a third of all rows hold is no task of its own. Ranks order pairs by their hash partition and in that by
    value: equal prefixes are neighbours in that order, which is all that common prefixes need.
    """
    found = df.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(_at()).alias("first")).where("times > 1")
    found = found.sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())
    return join_hot(df, found, ["a", "b"], "times", F.xxhash64("id", "digest", "no"), total).drop("a", "b")


def _pairs(cur: DataFrame, step: int) -> DataFrame:
    """(id, digest, no, a, b): the rank of each suffix and that of the one `step` lines on, where it has one too."""
    by = W.partitionBy(*DOC).orderBy("no").rangeBetween(step, step)
    return cur.select(*DOC, "no", F.col("rank").alias("a"), F.max("rank").over(by).alias("b")).where("b is not null")


def _later(cur: DataFrame, depth: int) -> DataFrame:
    """(id, digest, no, n, first): the suffixes that share their first `depth` lines with an earlier one."""
    return cur.where(_at() != F.col("first")).select(*DOC, "no", F.lit(depth).alias("n"), "first")


def copies(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(id, digest, no, n, first): every later copy of n lines from line no on; from (id, digest, text).

    Depths are 1, 2, 4, .. up to min_lines, then its doubles while any suffix shares so many lines with another. A run
    that repeats over d lines is covered by its copies at the greatest such depth below d, so all together
    cover the maximal runs. Depths under min_lines make no copies, but for single lines of long_words words.
    """
    # Splitting the texts is the dear part: lines are written once, as digests.
    lines = stash(_lines(docs, long_words), "lines")
    cur = _ranked(lines, lines.count()).distinct()
    out, depth = [], 1
    while True:
        cur = stash(cur, "suffixes")
        left = cur.count()
        if not left:
            break
        if depth >= min_lines:
            out.append(_later(cur, depth))
        elif depth == 1 and long_words is not None:
            out.append(_later(cur.where("long"), 1))
        step = depth if depth >= min_lines else min(depth, min_lines - depth)
        cur = _ranked(_pairs(cur, step), left)
        depth += step
    if not out:
        return _later(cur, depth)
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(id, digest, from, to, depth, source): maximal runs of non-blank lines that are later copies; from (id, digest, text).

    source: the first place, as (none, id, digest, no), of the `depth` lines that the run begins with.
    """
    each = copies(docs, min_lines, long_words).groupBy(*DOC, "no").agg(F.max(F.struct("n", "first")).alias("most"))
    by = W.partitionBy(*DOC).orderBy("no")
    end = F.col("no") + F.col("most.n")
    new = (F.col("no") > F.coalesce(F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    runs = each.withColumn("new", new).withColumn("run", F.sum("new").over(by)).groupBy(*DOC, "run")
    lead = F.min(F.struct("no", "most"))
    return runs.agg(lead["no"].alias("from"), F.max(end).alias("to"), lead["most"]["n"].alias("depth"), lead["most"]["first"].alias("source")).drop("run")


def dedup_rows(rows: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(row, text, n_lines, n_removed, n_runs) of rows (row, id, text), where row is anything."""
    d = rows.select("row", "id", "text", F.xxhash64("text").alias("digest"))
    runs = repeated_runs(d.select("id", "digest", F.coalesce("text", F.lit("")).alias("text")), min_lines, long_words)
    runs = runs.groupBy(F.col("id").alias("of"), F.col("digest").alias("of_digest")).agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))
    out = d.join(runs, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    touched = F.col("runs").isNotNull()
    out = out.select(
        "row", "text", "runs", F.size(F.filter(lines, lambda x: x.rlike(SPACE_WORD))).cast("long").alias("n_lines"), F.when(touched, lines).alias("lines")
    )
    word = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(SPACE_WORD), i)), lambda i: i.isNotNull())
    out = out.withColumn("word", F.when(touched, word))
    # Places in the line array: a run is cut into stretches between its blank lines by dropping single numbers.
    gone = F.flatten(F.transform("runs", lambda r: F.slice("word", r["from"] + 1, r["to"] - r["from"])))
    out = out.withColumn("gone", F.when(touched, gone))
    # What stands between two removed lines is kept whole.
    out = out.withColumn("edges", F.when(touched, F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("lines")))))
    stay = F.filter(
        F.transform("edges", lambda e, i: F.struct(e.alias("at"), (F.coalesce(F.get("edges", i + 1), e) - e - 1).alias("n"))), lambda s: s["n"] > 0
    )
    kept = F.array_join(F.flatten(F.transform(stay, lambda s: F.slice("lines", s["at"] + 2, s["n"]))), "\n")
    many = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(
        "row", F.when(touched, kept).otherwise(F.col("text")).alias("text"), "n_lines", many("gone").alias("n_removed"), many("runs").alias("n_runs")
    )


def rows_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    return docs.select(as_row(docs).alias("row"), quoted(doc).alias("id"), quoted(text).cast("string").alias("text"))


def line_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """docs with `text` without later copies of repeated line runs, and n_lines, n_removed, n_runs.

    A run has min_lines lines, or is one line of long_words words or more (None: no line is a run by itself). Lines are
    split at \\n; blank ones are no lines and stay. First copies, by (doc, digest of the text, line), stay. Null texts stay null
    with 0 lines. Rows that repeat an id are documents of their own where their texts differ, and one document where
    they don't; null ids are treated alike and come after all others. Columns of docs stay whatever their
    names, but for ones named as the three results, which these replace. Empty table: empty.
    """
    own = ("n_lines", "n_removed", "n_runs")
    out = dedup_rows(rows_of(docs, doc, text), min_lines, long_words)
    columns = [F.col("text").alias(c) if c == text else r for c, r in zip(docs.columns, from_row(docs, "row"), strict=True) if c not in own]
    return out.select(*columns, *own)
