"""Rules with a linear form find what the published text finds, also on long lines."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.linear import LINEAR
from tidemark.operators.scan import scan

FRAGMENTS = {
    "Google Service Account": ["service_account", "service account", ".json", "private_key", '"', " x ", "serviceaccount"],
    "SQL Server Connection": ["server=", "data source=", "a", ";", "uid=", "user id=", "pwd=", "password=", "b c", "server=a;uid=b;"],
    "Kubernetes Config": ["kubeconfig", "kubectl", "token", "certificate", '"', " x "],
    "JS Config Object": ["config", "settings=", " = ", "{", "}", "key", "token", " x ", "options = {"],
    "JS Fetch with Auth": ["fetch(", "headers", "Authorization", "authorization", ")", "x", " "],
    "JS Comments with Secrets": ["//", "token", "key", "api", ":", "=", " ", '"', "abcdefghij", "abc_def-12345", "x"],
    "JS Import Secret": ["import ", "import\n", "import", "from ", "from\n", "from", '"', "'", "key", "config", " x ", "a"],
    "JS Require Secret": ["require(", '"', "'", ")", "secret", "key", " x "],
    "JS Axios Auth": ["axios.get(", "axios.post(", "headers", "auth", ")", "x", " "],
    "JS Hardcoded URL with Key": ["http://", "https://", "?", "&", "api_key=", "token=", "auth=", "v", " ", '"', "/"],
    "SQL Injection Point": ["select ", "from ", "where ", "$_GET", "$_POST", "$_REQUEST", " x "],
    "XSS Vulnerable": ["eval(", "innerHTML (", "document.write(", "$_GET", "location.", ")", " x "],
    "Email Address": ["a", "b.c", "@", "x.co", ".", " ", "-", "é", "%", "a" * 70, "a.b" * 30, ".com", "%" * 66],
    "Elasticsearch URL": ["http://", "https://", ":", "@", "/", "9", "80", "a", "b c", "http:"],
}


def texts_for(name, n, seed):
    rng = random.Random(f"{name}{seed}")
    parts = [*FRAGMENTS[name], "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 26))) for _ in range(n)]


def test_fragments_cover_the_table():
    assert FRAGMENTS.keys() == LINEAR.keys() and all(R.catalogue()[i].skips for i, r in enumerate(R.catalogue()) if r.name in LINEAR)


def test_same_matches_as_published(spark):
    rules = {r.name: r for r in R.catalogue("broad") if r.name in LINEAR}
    hits = 0
    for name, rule in rules.items():
        texts = list(enumerate(texts_for(name, 1500, 1)))
        df = spark.createDataFrame(texts, "page_id long, body string").withColumn("url", F.lit("u"))
        got = {(r.src_id, r.match_idx, r.start, r.end) for r in scan(df, [rule], "broad").collect()}
        rx = re.compile(rule.regex, re.I | re.M | re.A)
        want = {(i, k, m.start(), m.end()) for i, t in texts for k, m in enumerate(rx.finditer(t))}
        assert got == want, (name, sorted(got ^ want)[:3], [texts[x[0]] for x in sorted(got ^ want)[:1]])
        hits += len({w[0] for w in want}) > 20
    assert hits >= len(rules) - 2


LONG = {
    "JS Comments with Secrets": "a//token b ", "Google Service Account": "service_account ", "SQL Server Connection": "server=a ",
    "Kubernetes Config": "kubectl x ", "JS Config Object": "config = { ", "JS Fetch with Auth": "fetch( headers ", "JS Import Secret": 'import a from "b ',
    "JS Require Secret": 'require("a ', "JS Axios Auth": "axios.get(x ", "JS Hardcoded URL with Key": "http://a?", "SQL Injection Point": "from where ",
    "XSS Vulnerable": "eval(", "Email Address": "a.b-", "Elasticsearch URL": "http://a:b ",
}


@pytest.mark.parametrize("size", [200_000])
def test_long_lines_take_seconds(spark, size):
    rules = R.catalogue("broad")
    for name, unit in LONG.items():
        df = spark.createDataFrame([(1, "$_GET @ key .json private_key\n" + unit * (size // len(unit)))], "page_id long, body string").withColumn("url", F.lit("u"))
        began = time.time()
        scan(df, [r for r in rules if r.name == name], "broad").agg(F.count("*")).collect()
        assert time.time() - began < 20, name


def test_many_short_lines(spark):
    rules = [r for r in R.catalogue("broad") if r.line_word]
    seconds = []
    for n in (60_000, 120_000):
        df = spark.createDataFrame([(1, "a b\n" * n)], "page_id long, body string").withColumn("url", F.lit("u"))
        began = time.time()
        assert scan(df, rules, "broad").agg(F.count("*"), F.sum(F.length("context"))).collect()[0][0] == 4 * (n + 1)
        seconds.append(time.time() - began)
    assert seconds[1] < 4 * seconds[0] + 5
