"""Secret scans end on any text: every rule over a megabyte of its own characters, in Spark and in DuckDB."""

import random
import re

import duckdb
import pytest

from tests.llm.test_llm_small import frame
from tidemark.llm import queries, secret_scan

SIZE = 1_000_000
HARD = {
    "begin": "-----BEGIN " + "A " * (SIZE // 2), "begins": "-----BEGIN A " * (SIZE // 13), "jwt": "eyJ" * (SIZE // 3), "dots": "eyJ." * (SIZE // 4),
    "parts": ("eyJ" + "a" * 9 + ".") * (SIZE // 13), "url": "http://a:" * (SIZE // 9), "at": "http://a:" + "b" * SIZE, "password": "password" * (SIZE // 8),
    "spaces": "token" + " " * SIZE, "hex": "0" * SIZE, "hexes": "abc g" * (SIZE // 5), "access": "AKIA" * (SIZE // 4), "chat": "xoxa-" * (SIZE // 5),
    "host": "ghp_" * (SIZE // 4), "maps": "AIza" * (SIZE // 4), "pay": "sk_live_" * (SIZE // 8), "quotes": "token'" * (SIZE // 6),
}


def by_rules(text):
    """Spans by Python's re, of texts short enough for it."""
    out = []
    for order, r in enumerate(secret_scan.RULES):
        # Python has no inline flag for a part without a colon form of its own; the patterns are the same else.
        for m in re.finditer(r.pattern, text):
            value = m.group(1) if r.tail else m.group(0)
            if len(value) >= r.least and (r.whole is None or re.search(r.whole, value)):
                out.append((m.start(), order, f"{r.kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def spans(spark, texts):
    return {r.doc_id: r.spans for r in secret_scan.secret_report(secret_scan.find_secrets(frame(spark, texts))).collect()}


def test_hard_texts_end_and_agree_with_sql(spark):
    texts = list(HARD.values())
    got = spans(spark, texts)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"select doc_id, spans from ({queries.OP7_SQL})").fetchall())
    for i, name in enumerate(HARD):
        assert got[i] == want[i], name
    assert got[list(HARD).index("begin")] == "" and got[list(HARD).index("hex")] == f"hex:0:{SIZE}"


def test_random_texts_of_the_rules_own_characters(spark):
    rng = random.Random(4)
    bits = ["-----BEGIN ", "RSA ", "PRIVATE KEY-----", "eyJ", "a1_-" * 3, ".", "ghp_", "Zz9" * 13, "xoxb-", "AIza", "sk_live_", "https://", "u", ":", "p", "@", "password", " ", "=", "'", "AKIA", "A1B2" * 4, "0af3" * 7, "\n", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(1500)]
    jwt = "eyJ" + "h" * 10 + ".eyJ" + "p" * 20 + "." + "s" * 12
    texts += [jwt, f"see {jwt}.", "x" + jwt, jwt + "/", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == by_rules(t), t
    n = len(texts)
    assert got[n - 6] == f"jwt:0:{len(jwt)}" and got[n - 5] == f"jwt:4:{len(jwt) + 5}" and got[n - 4] == "" and got[n - 2].startswith("private_key:0:27")


def test_an_unreadable_ledger_fails(spark, tmp_path):
    at = tmp_path / "ledger" / "scanned" / secret_scan.RULE_SETS[0][0]
    at.mkdir(parents=True)
    (at / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017, PT011
        secret_scan.find_secrets(frame(spark, ["token=abcdefg"]), ledger=str(tmp_path / "ledger")).collect()
