"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .alignment import aligned_texts, alignment_report, read_byte_level
from .common import shared_path, stash, table
from .decontaminate import contamination, contamination_report
from .line_dedup import line_dedup
from .lm import score_texts
from .near_dup import near_duplicates
from .packing import read_packed, tokenised, write_packed
from .periodic import periodic_runs, planted_tail, run_report
from .prefix_join import jaccard_components
from .quality import quality_rules
from .secret_scan import find_secrets, secret_report
from .suffix_dedup import suffix_dedup
from .warc import read_archive, write_archive


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, ranks, P.PATTERN, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text(), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", digest)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(find_secrets(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    # The ids are written once: the number of bins is known before the rows are dealt.
    path = shared_path(spark, "packed")
    write_packed(stash(tokenised(table(spark, sf_dir, "documents"), ranks, P.PATTERN), "ids"), path)
    return read_packed(spark, path)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = read_byte_level(P.path("byte_bpe_50k.json"))
    return alignment_report(aligned_texts(docs, ranks, P.PATTERN, P.path("piece_bpe_32k.model")), docs.select("doc_id", "text"))


def op12_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return run_report(periodic_runs(docs, rewrite=planted_tail), docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP4_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as n, sha1(payload) as digest,
             max(page_id) over (partition by sha1(payload), octet_length(payload)) as last from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
       case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < last then last end as refers_to from q"""

OP5_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
w as (select doc_id, line, pos, row_number() over (partition by doc_id order by pos) as no from l
      where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
p as (select *, lead(line) over (partition by doc_id order by no) as line2 from w),
f as (select doc_id, no, row_number() over (partition by line, line2 order by doc_id, no) as copy from p where line2 is not null),
g as (select distinct doc_id, no + k as no from f, (values (0), (1)) v(k) where copy > 1),
i as (select doc_id, no, no - row_number() over (partition by doc_id order by no) as run from g),
r as (select doc_id, count(*) as n_removed, count(distinct run) as n_runs from i group by doc_id),
k as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as kept
      from l left join w on l.doc_id = w.doc_id and l.pos = w.pos left join g on w.doc_id = g.doc_id and w.no = g.no
      where g.no is null group by l.doc_id),
n as (select doc_id, count(*) as n_lines from w group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(n_runs, 0) as n_runs,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join n on d.doc_id = n.doc_id left join r on d.doc_id = r.doc_id left join k on d.doc_id = k.doc_id"""

OP6_SQL = """
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
v as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as phrase
      from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
lens as (select distinct n from v),
o as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as phrase
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from t, lens)),
m as (select o.doc_id, o.n, o.s, v.item_id from o join v on o.phrase = v.phrase and o.n = v.n),
h as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, cast(item_id as varchar) as item from m) group by doc_id)
select t.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from t left join h on t.doc_id = h.doc_id left join i on t.doc_id = i.doc_id"""

#: Starts of matches: the lengths of all gaps and matches before them.
_OP7_KIND = """
select doc_id, {k} as ord, '{kind}' as kind, m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as start, val
from (select doc_id, ms, g, unnest(ms) as m, unnest(vs) as val, generate_subscripts(ms, 1) as i from (
  select doc_id, regexp_extract_all(text, '{p}') as ms, regexp_extract_all(text, '{p}', {group}) as vs,
         string_split_regex(text, '{p}') as g from t))
where length(val) >= {least}{whole}"""

_OP7_JWT = r" and regexp_matches(m, '^eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.*$')"

OP7_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
s as ({" union all ".join(_OP7_KIND.format(k=k, kind=kind, p=p.replace("'", "''"), group=group, least=least, whole=_OP7_JWT if kind == "jwt" else "") for k, (kind, p, group, least) in enumerate((
    ("assign", r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20), ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("jwt", r"[A-Za-z0-9_.-]{35,}", 0, 35),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1), ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("maps", r"AIza[A-Za-z0-9_-]{35}", 0, 1), ("payment", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 1),
    ("login_url", r"(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", 0, 1),
)))}),
a as (select doc_id, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access,
             count(*) filter (where ord = 2) as n_hex,
             string_agg(span, ',' order by start, ord) filter (where ord < 3) as base, string_agg(span, ',' order by start, ord) as spans
      from (select *, kind || ':' || cast(cast(start as bigint) as varchar) || ':' || cast(cast(start as bigint) + length(m) as varchar) as span from s)
      group by doc_id)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join a on t.doc_id = a.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_archive": OP4_SQL,
        "op5_line_dedup": OP5_SQL,
        "op6_benchmark_decontamination": OP6_SQL,
        "op7_secret_scans": OP7_SQL,
    }
