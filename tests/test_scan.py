"""Scan against a brute-force reference: Python's re with ASCII classes,
IGNORECASE and MULTILINE (the broad tool's flags), on small texts."""
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.rules_data import CONTEXT_WHITESPACE
from tidemark.operators.scan import scan

WS = re.compile("[" + re.escape(CONTEXT_WHITESPACE) + "]+")


def brute(texts, rules):
    out = set()
    for sid, t in texts:
        if not t:
            continue
        for i, r in enumerate(rules):
            if r.line_word:
                pos = 0
                k = 0
                for line in t.split("\n"):
                    if r.line_word not in line.lower():
                        out.add((sid, r.name, k, pos, pos + len(line), line[:200], ctx(t, pos, pos + len(line))))
                        k += 1
                    pos += len(line) + 1
                continue
            rx = re.compile(r.regex, re.I | re.M | re.A)
            for k, m in enumerate(rx.finditer(t)):
                out.add((sid, r.name, k, m.start(), m.end(), m.group(0)[:200], ctx(t, m.start(), m.end())))
    return out


def ctx(t, s, e):
    return WS.sub(" ", t[max(0, s - 100):min(len(t), e + 100)]).strip()


def spark_set(spark, texts, rules):
    df = spark.createDataFrame(texts, "page_id long, body string").withColumn(
        "url", F.concat(F.lit("http://h.example/"), F.col("page_id").cast("string")))
    rows = scan(df, rules, "broad").collect()
    return {(r.src_id, r.pattern, r.match_idx, r.start, r.end, r.match, r.context) for r in rows}


AK = "AK" + "IA"
TEXTS = [
    (1, f"key {AK}ABCDEFGHIJKLMNOP and {AK}QRSTUVWXYZ234567 end"),
    (2, "mail bob@example.com, 10.0.0.12\r\nline two 4111 1111 1111 1111\n\nlast"),
    (3, "x" * 150 + " api_token = \"" + "a" * 300 + "\" " + "é" * 120),
    (4, f"{AK}ABCDEFGHIJKLMNOP"),
    (5, ""),
    (6, None),
    (7, "écrit 123-45-6789 über ß 0x" + "ab" * 20 + " fin"),
    (8, "password=abcd;pwd=efgh pass=ijkl\tdebug = true\nTODO: fix this\n"),
    # adjacent tiny matches: the bounded look-around falls back to the text
    (9, "x" * 300 + "error" * 60 + " y" * 150 + "\n" * 40 + "a\nb"),
]


def test_scan_matches_brute_force(spark):
    rules = R.catalogue("broad")
    assert spark_set(spark, TEXTS, rules) == brute(TEXTS, rules)


def test_planted_documents_brute_force(spark):
    from tidemark.plans.fixtures import planted_documents
    docs = planted_documents(spark, "/root/testdata/sf0.001").orderBy("doc_id").limit(40).collect()
    texts = [(d.doc_id, d.text) for d in docs]
    rules = R.select_rules(["api_keys", "database", "financial", "sensitive"])
    assert spark_set(spark, texts, rules) == brute(texts, rules)


def test_offsets_reproduce_match(spark):
    df = spark.createDataFrame(TEXTS[:4], "page_id long, body string").withColumn("url", F.lit("u"))
    f = scan(df, R.catalogue("broad"), "broad")
    j = f.join(df.select(F.col("page_id").alias("src_id"), "body"), "src_id")
    bad = j.filter(F.substring(F.expr("substring(body, start + 1, `end` - start)"), 1, 200) != F.col("match"))
    assert bad.count() == 0


def test_long_match_and_context(spark):
    df = spark.createDataFrame([(3, TEXTS[2][1])], "page_id long, body string").withColumn("url", F.lit("u"))
    rows = scan(df, [r for r in R.catalogue("broad") if r.name == "Generic API Key"], "broad").collect()
    assert rows and len(rows[0].match) == 200 and rows[0].end - rows[0].start > 200


def test_strict_profile_case_and_end(spark):
    rules = [r for r in R.catalogue("strict") if r.name in ("Log Files", "AWS Access Key ID")]
    df = spark.createDataFrame([(1, "a.log\n" + AK.lower() + "abcdefghijklmnop"), (2, "b.log")],
                               "page_id long, body string").withColumn("url", F.lit("u"))
    got = {(r.src_id, r.pattern) for r in scan(df, rules, "strict").collect()}
    # strict: '$' is the end of the text; rules are case-sensitive as written
    assert got == {(2, "Log Files")}


@pytest.mark.parametrize("n", [1, 31, 32, 33, 100, 1000])
def test_prefix_sums(spark, n):
    from tidemark.functions.arrays import exclusive_prefix_sums
    vals = [(i * 7) % 11 for i in range(n)]
    got = spark.range(1).select(F.expr(exclusive_prefix_sums(
        "array(" + ",".join(map(str, vals)) + ")", "t_")).alias("p")).collect()[0].p
    exp, s = [], 0
    for v in vals:
        exp.append(s)
        s += v
    assert got == exp
