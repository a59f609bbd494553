"""Quality rules: robust multivariate outliers of text statistics per language and source (native).

Per group the minimum-covariance-determinant estimate is found by concentration steps from several starts: mean and
covariance are refitted to the h rows of least Mahalanobis distance, and the start whose covariance ends with the least
determinant is taken. All of it is aggregates and column expressions; the h-th distance comes from a mergeable histogram.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE_WORD, as_row, cut, extract_all, from_row, quoted, small, stash

WINDOW = 8
#: Least spread of each feature, in its own unit: below it a difference is no sign of junk.
FLOORS = (0.40, 0.10, 0.40, 0.10, 0.50)
D = len(FLOORS)
MIN_GROUP = 40
ALPHA = 0.75
STEPS = 3
#: Starts by a share of the rows, beside those by medians and by all rows: rows whose features' hash has each of these rests by 4.
SUBSETS = (0, 1)
KEY = ["__lang", "__source"]
#: What a fit is of: 0 and a group, 1 and a language, or 2 alone; what is pooled is empty.
FIT = ["__level", *KEY]
TAIL = 1e-6


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1.0 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(d / 2, mid / 2) < p else (low, mid)
    return high


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null or empty text: all zero and base_failed. Whole texts, no shuffle: windows are hashed and sorted within a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.withColumn("__words", extract_all(t, SPACE_WORD)).withColumn(
        "__lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(SPACE_WORD))
    )
    a = a.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    grams = F.when(
        F.col("n_words") > WINDOW,
        F.transform(
            F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")),
            lambda i: F.xxhash64(F.slice("__hashes", i, WINDOW)),
        ),
    )
    a = a.withColumn("__grams", grams)
    repeated = F.size(F.array_distinct("__grams")) < F.size("__grams")
    a = a.withColumn(
        "__sorted",
        F.when(repeated, F.array_sort(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("p"))))),
    )
    beside = lambda x, i: F.coalesce(F.get("__sorted", i)["g"] == x["g"], F.lit(False))
    a = a.withColumn(
        "__at",
        F.array_sort(
            F.transform(F.filter("__sorted", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["p"])
        ),
    )
    covered = F.transform("__at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW))))
    a = a.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(covered, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return a.withColumn("base_failed", failed).drop("__hashes", "__grams", "__sorted", "__at")


def _features() -> list[Column]:
    c = {k: F.col(k).cast("double") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    some = F.greatest(c["n_words"], F.lit(1.0))
    chars = F.greatest(c["word_chars"], F.lit(1.0))
    return [
        F.log1p(c["n_words"]),
        F.log(chars / some),
        F.log1p(100 * c["n_symbols"] / chars),
        c["n_repeat_words"] / some,
        F.log1p(c["n_dup_lines"]),
    ]


_NAMES = [f"m{i}" for i in range(D)] + [f"v{i}{j}" for i in range(D) for j in range(i + 1)]


def _params(df: DataFrame) -> DataFrame:
    """A row per fit and start with mean m_i, the inverse Cholesky factor v_i_j of the covariance plus floors, and its log determinant."""
    x = lambda i: F.col(f"__f{i}")
    p = df.groupBy(*FIT, "__start").agg(
        *[F.avg(x(i)).alias(f"m{i}") for i in range(D)],
        *[F.covar_pop(x(i), x(j)).alias(f"c{i}{j}") for i in range(D) for j in range(i + 1)],
    )
    # The factor that makes the trimmed covariance consistent for normal data.
    scale = ALPHA / _gamma_p(D / 2 + 1, chi2_quantile(ALPHA, D) / 2)

    def rest(i: int, j: int) -> Column:
        s = F.col(f"c{i}{j}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        return s

    def inverse(i: int, j: int) -> Column:
        s = F.lit(1.0 if i == j else 0.0)
        for k in range(j, i):
            s = s - F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
        return s / F.col(f"l{i}{i}")

    # Each step's columns need those of earlier steps only.
    for j in range(D):
        p = p.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1e-12))))
        p = p.withColumns({f"l{i}{j}": rest(i, j) / F.col(f"l{j}{j}") for i in range(j + 1, D)})
    for i in range(D):
        p = p.withColumns({f"v{i}{j}": inverse(i, j) for j in range(i + 1)})
    logdet = 2 * sum((F.log(f"l{i}{i}") for i in range(1, D)), F.log("l00"))
    return p.select(*FIT, "__start", *_NAMES, logdet.alias("logdet"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(D):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"v{i}{j}") * (F.col(f"__f{j}") - F.col(f"m{j}"))
        total = total + y * y
    return total


def _starts(stats: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parameters per fit and start: 0 by medians and absolute deviations, 1 by all rows, then by shares of the rows."""
    med = stats.groupBy(*FIT).agg(*[F.percentile_approx(f"__f{i}", 0.5, 1000).alias(f"m{i}") for i in range(D)])
    mad = stats.join(hint(cut(med)), FIT).groupBy(*FIT).agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(D)],
        *[F.percentile_approx(F.abs(F.col(f"__f{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i in range(D)],
    )
    factor = [
        (1 / F.sqrt(F.pow(F.col(f"s{i}") * 1.4826, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i in range(D) for j in range(i + 1)
    ]
    robust = mad.select(*FIT, F.lit(0).alias("__start"), *[f"m{i}" for i in range(D)], *factor)
    rest = F.pmod(F.xxhash64(*[f"__f{i}" for i in range(D)]), F.lit(4))
    own = F.filter(F.array(F.lit(1), *[F.when(rest == k, F.lit(2 + n)) for n, k in enumerate(SUBSETS)]), lambda x: x.isNotNull())
    others = _params(stats.withColumn("__start", F.explode(own))).drop("logdet")
    return robust.unionByName(others)


def fit_groups(stats: DataFrame, most: int) -> DataFrame:
    """MCD parameters per fit from a table with __level, __lang, __source, __f0.. of at most so many fits; those of the start of least determinant.

    A fit's h-th distance is taken at a histogram edge (1/64 in the logarithm), so ties stay together and
    none is ever gathered in one task. group_rows: the fit's rows. Fits go side by side: their number adds no jobs.
    """
    each = [*FIT, "__start"]
    hint = F.broadcast if most * (2 + len(SUBSETS)) <= BROADCAST_ROWS else lambda df: df
    params = _starts(stats, hint)
    for _ in range(STEPS):
        near = stats.join(hint(cut(params)), FIT).withColumn("__bin", F.floor(F.log(_distance() + 1e-6) * 64).cast("long"))
        counts = near.groupBy(*each, "__bin").count()
        by = W.partitionBy(*each)
        edges = (
            counts.withColumn("__upto", F.sum("count").over(by.orderBy("__bin")))
            .withColumn("__all", F.sum("count").over(by))
            .where(F.col("__upto") >= F.lit(ALPHA) * F.col("__all"))
            .groupBy(*each)
            .agg(F.min("__bin").alias("__edge"), F.first("__all").alias("__n"))
        )
        edges = cut(edges)
        params = _params(near.join(hint(edges), each).where(F.col("__bin") <= F.col("__edge")).select(*stats.columns, "__start"))
    least = F.min(F.struct("logdet", "__start", F.struct("__n", *_NAMES).alias("fit")))
    best = params.join(edges.select(*each, "__n"), each).groupBy(*FIT).agg(least["fit"].alias("fit"))
    return best.select(*FIT, *[f"fit.{c}" for c in _NAMES], F.col("fit.__n").alias("group_rows"))


def fit_or_pool(stats: DataFrame) -> DataFrame:
    """A row per group as of fit_groups; a group under MIN_GROUP rows has its language's fit, or that of all rows if
    the language too is under it. group_rows: the rows behind the fit.
    """
    sizes = stats.groupBy(*KEY).agg(F.count("*").alias("__n"))
    langs = sizes.groupBy("__lang").agg(F.sum("__n").alias("__m"), F.min("__n").alias("__least"))
    level = F.when(F.col("__n") >= MIN_GROUP, 0).when(F.col("__m") >= MIN_GROUP, 1).otherwise(2)
    pooled = (F.col("__m") >= MIN_GROUP) & (F.col("__least") < MIN_GROUP)
    judged = cut(sizes.join(langs, "__lang").select(*KEY, level.alias("__level"), pooled.alias("__pooled")))
    groups, highest = judged.agg(F.count("*"), F.max("__level")).first()
    name = lambda level, lang, source: F.struct(F.lit(level).alias("__level"), lang.alias("__lang"), source.alias("__source"))
    none, lang, source = F.lit(""), F.col("__lang"), F.col("__source")
    every = [F.when(F.col("__level") == 0, name(0, lang, source)), F.when(F.col("__pooled"), name(1, lang, none))]
    every += [name(2, none, none)] if highest == 2 else []
    # All rows of what a fit is of: of the group, of the language with its large groups, or of everything.
    hint = F.broadcast if groups <= BROADCAST_ROWS else lambda df: df
    of = judged.select(*KEY, F.filter(F.array(*every), lambda x: x.isNotNull()).alias("__of"))
    features = [f"__f{i}" for i in range(D)]
    rows = stats.join(hint(of), KEY).select(F.explode("__of").alias("__of"), *features).select("__of.*", *features)
    # At most the groups, their languages and all rows have a fit.
    fits = fit_groups(rows, 2 * groups + 1)
    wanted = judged.select(
        *[F.col(c).alias(f"{c}_own") for c in KEY], "__level", F.when(F.col("__level") < 2, lang).otherwise(none).alias("__lang"),
        F.when(F.col("__level") == 0, source).otherwise(none).alias("__source"),
    )
    out = wanted.join(hint(fits), FIT).drop(*FIT)
    return out.withColumnsRenamed({f"{c}_own": c for c in KEY})


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def judged(rows: DataFrame) -> DataFrame:
    """(row, statistics, base_failed, kept, mahalanobis_sq) of rows (row, text, lang, source), where row is anything."""
    keyed = rows.select(
        F.col("row").alias("__row"), F.col("text").alias("__text"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in ("lang", "source")],
    )
    base = text_stats(keyed, "__text").drop("__text")
    base = stash(base.select("*", *[f.alias(f"__f{i}") for i, f in enumerate(_features())]), "quality")
    usable = base.where(~F.col("base_failed")).select(*KEY, *[f"__f{i}" for i in range(D)])
    params = small(cut(fit_or_pool(usable)))
    cutoff = chi2_quantile(1 - TAIL, D)
    out = base.join(params, KEY, "left").withColumn("mahalanobis_sq", _distance())
    far = (F.col("group_rows") >= MIN_GROUP) & (F.col("mahalanobis_sq") > cutoff)
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return out.select(F.col("__row").alias("row"), *STATS, kept.alias("kept"), "mahalanobis_sq")


def rows_of(docs: DataFrame, text: str, row: Column) -> DataFrame:
    group = [(quoted(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select(row.alias("row"), quoted(text).cast("string").alias("text"), *group)


def quality_rules(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(doc, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, mahalanobis_sq) of every row.

    A row is kept unless base_failed or its squared Mahalanobis distance in its (lang, source) group exceeds the
    chi-square quantile 1 - 1e-6. Null lang or source is a group of its own; missing columns too. Groups under 40
    usable rows are judged by their language's estimate, or that of all rows; only a table of under 40 usable rows gets
    no outlier verdict. Rows are judged one by one, so ids may repeat or be null. Empty table: empty result.
    The text is read once: statistics are written to the shared folder and only the narrow columns are read per step.
    """
    out = judged(rows_of(docs, text, quoted(doc)))
    return out.select(F.col("row").alias(doc), *STATS, "kept", "mahalanobis_sq")


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with all columns whatever their names, without the rows that quality_rules would not keep.

    The rows are written with their statistics, so that verdicts need no join by id.
    """
    return judged(rows_of(docs, text, as_row(docs))).where("kept").select(*from_row(docs, "row"))
