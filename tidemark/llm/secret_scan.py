"""Secret scans: an incremental blob ledger (native).

Every version of a text is addressed by its content. Only (blob, rule version) pairs that the ledger lacks are
scanned, each once; findings join back to all paths that hold the blob. The ledger is two tables in one folder: what
was scanned, and what was found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import extract_all, quoted, shared_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern: Java syntax without capturing what `least` measures; matches are leftmost and do not overlap.

    tail: pattern of the measured end of a match (None: the whole match); least: its fewest characters. whole: what the
    match must be as a whole, or it is none. Patterns must read a text in time proportional to its length: no repeated
    group, and no open-ended run that can begin anew inside itself without matching.
    """

    kind: str
    pattern: str
    tail: str | None
    least: int
    whole: str | None = None


VALUE = r"[A-Za-z0-9+/_.=-]+"
#: In the order in which findings at one place are listed. A run of hex digits or of an access key's
#: characters is maximal, so its least length may stand in the pattern: shorter runs never match inside.
BASE = (
    Rule("assign", rf"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({VALUE})", VALUE, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", None, 20),
    Rule("hex", r"[0-9a-f]{24,}", None, 24),
)
#: Kinds beyond the base ones; the formats are fixed values.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None, 1),
    # A maximal run of its characters, dots after it included: 35 are the fewest of three parts.
    Rule("jwt", r"[A-Za-z0-9_.-]{35,}", None, 35, r"^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.*$"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", None, 1),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", None, 1),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}", None, 1),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}", None, 1),
    Rule("login_url", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", None, 1),
)
RULES = BASE + MORE
RULE_VERSION = "1"
#: Rule versions in the ledger; a changed or added rule is a new version, and only that is scanned anew.
RULE_SETS = (("base-1", BASE), ("more-2", MORE))


def _any_rule(rules: tuple[Rule, ...]) -> Column:
    any_rule = None
    for r in rules:
        any_rule = F.col("__text").rlike(r.pattern) if any_rule is None else any_rule | F.col("__text").rlike(r.pattern)
    return any_rule


def _matches(blobs: DataFrame, rules: tuple[Rule, ...], fenced: bool) -> DataFrame:
    """(blob, rule, i, match, gap): every match of a rule and the text between it and the one before.

    Unfenced, Catalyst may move the test for any match before the joins, which spares the shuffle of texts without
    one. That would scan what the ledger has, so with a ledger the test stays in the generator, which is not moved.
    """
    any_rule = _any_rule(rules)
    hit = blobs if fenced else blobs.where(any_rule)
    per_rule = [
        F.struct(
            F.lit(n).alias("rule"),
            F.arrays_zip(
                extract_all(F.col("__text"), r.pattern).alias("match"),
                F.split("__text", r.pattern, -1).alias("gap"),
                F.regexp_extract_all("__text", F.lit(r.pattern), F.lit(1 if r.tail else 0)).alias("value"),
            ).alias("found"),
        )
        for n, r in enumerate(rules)
    ]
    rows = hit.select("blob", F.explode(F.when(any_rule, F.array(*per_rule))).alias("r")).select(
        "blob", "r.rule", F.posexplode("r.found").alias("i", "f")
    )
    # The text after the last match is a gap without a match.
    return rows.where(F.col("f.match").isNotNull()).select("blob", "rule", "i", "f.match", "f.gap", "f.value")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, fenced: bool = False) -> DataFrame:
    """(blob, kind, order, start, end) for blobs (blob, __text); places in code points, end exclusive; order: of the rule.

    Starts are running sums of gaps and matches, so a text with many matches costs in proportion to them.
    """
    m = _matches(blobs, rules, fenced)
    before = W.partitionBy("blob", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    length = F.length("match").cast("long")
    start = F.coalesce(F.sum(length + F.length("gap")).over(before), F.lit(0)) + F.length("gap")
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    m = m.withColumn("start", start.cast("long"))
    good = F.length("value") >= least
    for n, r in enumerate(rules):
        if r.whole:
            good &= (F.col("rule") != n) | F.col("value").rlike(r.whole)
    return m.where(good).select(
        "blob", kind.alias("kind"), F.col("rule").alias("order"), "start", (F.col("start") + length).alias("end")
    )


def update_ledger(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    rule_version: str = RULE_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """Scan what is new. versions: (path, content); a null content is empty, repeated rows are one blob.

    ledger: (blob, rule_version) already scanned. Returns (blob, rule_version) newly scanned and their findings.
    One bearer of each new blob is chosen from (path, blob) alone, so copies never meet in one task with their texts;
    rows that repeat path and content, which this can't tell apart, are joined to one.
    """
    v = versions.select(F.col("path"), F.coalesce(F.col("content"), F.lit("")).alias("__text"))
    v = v.withColumn("blob", F.sha2("__text", 256)).withColumn("__key", F.xxhash64("path"))
    bearer = v.groupBy("blob").agg(F.min("__key").alias("__key"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        bearer = bearer.join(seen, "blob", "left_anti")
    one = ["blob", "__key"]
    if ledger is None:
        # Texts without a match leave before the repeats are joined, for no filter moves below that.
        new = v.where(_any_rule(rules)).dropDuplicates(one).join(bearer, one)
    else:
        new = v.join(bearer, one).dropDuplicates(one)
    found = scan_blobs(new.select("blob", "__text"), rules, ledger is not None).withColumn("rule_version", F.lit(rule_version))
    return bearer.select("blob", F.lit(rule_version).alias("rule_version")), found


def _listed(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def _ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, or None if nothing was scanned yet; one that stands there but can't be read fails the scan."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if there else None


def scan_history(versions: DataFrame, ledger: str, rule_sets: tuple[tuple[str, tuple[Rule, ...]], ...] = RULE_SETS) -> DataFrame:
    """(blob, kind, order, start, end): findings of all versions (path, content) under the rule sets, kept in the ledger's folder.

    What the ledger lacks is scanned and added. Findings are written before the pairs they belong to: a run that dies
    between the two scans those again, and findings that stand twice are read once. order follows the rule sets.
    """
    spark, first, parts = versions.sparkSession, 0, []
    for version, rules in rule_sets:
        seen = _ledger(spark, f"{ledger}/scanned/{version}")
        scanned, found = update_ledger(versions, seen, rules, version)
        found.withColumn("order", F.col("order") + first).write.mode("append").parquet(f"{ledger}/found/{version}")
        scanned.write.mode("append").parquet(f"{ledger}/scanned/{version}")
        parts.append(f"{ledger}/found/{version}")
        first += len(rules)
    return spark.read.parquet(*parts).select("blob", "kind", "order", "start", "end").distinct()


def find_secrets(docs: DataFrame, text: str = "text", path: str = "doc_id", ledger: str | None = None) -> DataFrame:
    """A row for each row of docs: path, blob, spans array<struct<start, order, end, kind>> in order of start and rule.

    ledger: folder of the ledger, which stays; None: a new one in the shared folder, gone with the driver. Null or empty
    texts, and texts without a finding, have an empty array. Paths may repeat or be null. Empty table: empty result.
    """
    versions = docs.select(quoted(path).alias("path"), quoted(text).cast("string").alias("content"))
    found = scan_history(versions, ledger or shared_path(docs.sparkSession, "ledger"))
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "order", "end", "kind"))).alias("spans"))
    paths = versions.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    return paths.join(spans, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("spans", none).alias("spans"))


def secret_report(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts per base kind, all spans as text, and the digest of the base kinds' spans, from find_secrets' rows."""
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["order"] < len(BASE))
    return found.select(
        path, *[n(r.kind) for r in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
