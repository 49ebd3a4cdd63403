"""What is tried before a rule (leads, shapes, pooled literals) and written-out classes lose no match."""
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import literals as LT
from tidemark.functions import regex as RX
from tidemark.functions import rules as R
from tidemark.functions.linear import LEADS, SHAPE_OF, SHAPES
from tidemark.functions.rules_data import RULES
from tidemark.functions.sql_function import register_scan_text
from tidemark.operators.scan import scan
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"


def test_classes_are_written_out():
    seen = 0
    for _, name, rx, *_ in RULES:
        for kind, text in RX._tokens(rx):
            if kind == "class":
                new = RX.java_classes(text)
                chars = [chr(k) for k in range(160)]
                assert [bool(re.match(text, c, re.A)) for c in chars] == [bool(re.match(new, c, re.A)) for c in chars], (name, text)
                seen += new != text
    assert seen > 100 and RX.java_classes("[a-c]") == "[abc]"
    assert [RX.java_classes(x) for x in (r"[\b]", "[a&&b]", "[a[b]", "[é-ü]", r"[\S]")] == [r"[\b]", "[a&&b]", "[a[b]", "[é-ü]", r"[\S]"]


def test_literals_in_one_pass():
    gates = {g for r in R.catalogue("broad") for g in r.gates}
    pool = LT.pooled(gates)
    assert len(pool) > 150 and LT.pooled(["abc"] * 50) == []
    rx = re.compile(LT.finder(pool))
    rng = random.Random(7)
    parts = [*sorted(gates), *"abe.-_/:$ é\n", "acc", "k_te", ".env", "api"]
    for _ in range(1500):
        t = "".join(p[rng.randrange(2):len(p) - rng.randrange(2)] if rng.random() < 0.4 else p for p in rng.choices(parts, k=rng.randrange(1, 14)))
        found = "\n".join({m.group(1) for m in rx.finditer(t)})
        assert [g for g in pool if g in found] == [g for g in pool if g in t]


def test_gates_look_once(spark):
    """The text is not searched for each of 224 literals, nor are computed texts computed below the shuffle too."""
    plan = catalog.q_extracted_scan(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Contains\(_lt#", plan)) < 60
    below = plan[plan.index("Exchange"):]
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in below


SAMPLES = [
    "4111 1111-1111 1111", "5500-0000 0000 0004", "3782 822463 10005", "6011000990139424", "1 2-3 4 5 6 7 8 9 0 1 2 3 4", "123-45-6789", "12345678",
    "(555) 123-4567", "+1.555.123.4567", "1-555 1234567", "+44 (20) 123 456", "DE89370400440532013000", "DEUTDEFF500", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT",
    "5" + "K" * 51, "0x" + "aB" * 20, "aF" * 16, "0b" * 20, "9c" * 32, "Ab+/" * 12 + "QQ==", "Zz09" * 10, "00:1A-2b:3C-4d:5E", "123e4567-e89b-12d3-a456-426614174000",
    "M" + "a1" * 11 + "b." + "abc123." + "d" * 27, "discord token=N" + "x" * 23 + ".ABCDEF." + "e" * 27, "12345678:" + "a-_" * 11 + "bc", "SK" + "a0" * 16, "AC" + "f9" * 16,
    "e" * 32 + "-us12", "azure_key=" + "b" * 32, "storage key: " + "C" * 86 + "==", "AK" + "IA" + "A" * 16, "gh" + "p_" + "a" * 36, "google_api_key=" + "x" * 20,
    "api-key: " + "z" * 20, "g-cloud token " + "q" * 20, "db_pass=x", "pwd=abc", "user = bob", "login:x", "10.1.2.3", "192.168.1.20", "cvv2: 123", "routing# 123456789",
    "a.b@c.de", "%x@y.org", "bob@localhost", "var apiUrl='x'", "let myToken = \"t\"", "const KEY='k'", "config = {key: 1}", "private_key", "secret-key", "priv key",
    "select $_GET", "eval(location.", "exec(", "cmd (", "Traceback", "stack trace", "TODO: x", "FIXME:y", "s3://bucket-a", "s3-eu.amazonaws.com/b-1", "cdn.site.com",
    "media.x-y.org", "http://u:p@h/x:9", "https://h/?token=1", "// key = abcdefghij1", "fetch(u, {headers: Authorization: x})", "axios.get(u, {headers: h})",
    "import a from 'config'", "require('secret')", "kubectl get token", "kubeconfig", "service account x.json", "server=a;uid=b;pwd=c",
]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        row = []
        for s in rng.choices(SAMPLES, k=rng.randrange(1, 7)):
            if rng.random() < 0.3:
                i = rng.randrange(len(s))
                s = s[:i] + rng.choice(["", s[i] * 2, " ", "x", "7", "-"]) + s[i + 1:]
            row.append(rng.choice([str, str, str.upper, str.lower])(s) + rng.choice(["", " ", "  ", "\n", "\t", ".", "é", " ", " a "]))
        out.append((k, "".join(row)))
    return out


@pytest.mark.parametrize("profile", ["broad", "strict"])
def test_leads_and_shapes_lose_nothing(spark, profile):
    rules = [r for r in R.catalogue(profile) if r.line_word is None]
    rows = texts(500, profile)
    df = spark.createDataFrame(rows, "page_id long, body string").withColumn("url", F.lit("u"))
    got = {(r.src_id, r.pattern, r.match_idx, r.start, r.end) for r in scan(df, rules, profile).collect()}
    want, seen = set(), set()
    for rule in rules:
        rx = rule.regex if profile == "broad" else rule.regex.replace("(\\?|$)", "(\\?|\\Z)")
        rx = re.compile(rx, (re.I | re.M if profile == "broad" else 0) | re.A)
        for i, t in rows:
            size = len if profile == "broad" else (lambda s: len(s.encode()))
            found = [m for m in rx.finditer(t)]
            want |= {(i, rule.name, k, size(t[:m.start()]), size(t[:m.end()])) for k, m in enumerate(found)}
            seen |= {rule.name} if found else set()
    assert got == want, sorted(got ^ want)[:4]
    assert {r.name for r in rules if r.name in LEADS or r.name in SHAPE_OF} <= seen and set(SHAPE_OF.values()) == SHAPES.keys()


def test_contexts_fold_as_before(spark):
    """Line ends are replaced once a text; odd white space is folded in each context."""
    rows = [(0, "a\nfixme\n\nb"), (1, "a fixme b"), (2, "x\t fixme y"), (3, "\n fixme\r\nz \n"), (4, "é\nfixme " + "\n".join("w" * 130))]
    df = spark.createDataFrame(rows, "page_id long, body string").withColumn("url", F.lit("u"))
    rule = [R.custom_rule("Word", "fixme\\s*")]
    got = {r.src_id: (r.match, r.context) for r in scan(df, rule, "broad").collect()}
    for i, t in rows:
        m = re.search("fixme\\s*", t, re.A)
        assert got[i] == (m.group(), " ".join(t[max(0, m.start() - 100):m.end() + 100].split())), i


def test_scan_from_sql_finds_the_same(spark):
    rules = R.catalogue("broad")
    register_scan_text(spark, rules, name="scan_gates")
    df = spark.createDataFrame(texts(60, "sql"), "page_id long, body string").withColumn("url", F.lit("u"))
    df.createOrReplaceTempView("tm_gates")
    cols = ["src_id", "rule_idx", "match_idx", "start", "end", "match", "context"]
    sql = spark.sql("SELECT page_id AS src_id, f.* FROM (SELECT page_id, scan_gates(body, 'all') AS fa FROM tm_gates) d LATERAL VIEW OUTER inline(d.fa) f "
                    "WHERE f.rule_idx IS NOT NULL").select(*cols)
    plain = scan(df, rules, "broad").select(*cols)
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, plain.collect()))
