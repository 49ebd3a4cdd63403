import pytest

from tidemark.functions import rules as R
from tidemark.functions.regex import java_regex, re2_regex


def test_catalogue_counts():
    assert len(R.catalogue("broad")) == 149
    assert len(R.catalogue("strict")) == 116
    diff = [r for r in R.D.RULES if r[3] and R.broad_severity(r[1]) != r[3]]
    assert len(diff) == 72


def test_severity_totals():
    sev = [R.broad_severity(r.name) for r in R.catalogue("broad")]
    assert (sev.count("high"), sev.count("medium"), sev.count("low")) == (48, 9, 92)
    st = [r.severity for r in R.catalogue("strict")]
    assert (st.count("high"), st.count("medium"), st.count("low")) == (74, 34, 8)


def test_severity_order_high_first():
    assert R.broad_severity("Secret Email") == "high"
    assert R.broad_severity("Phone") == "medium"
    assert R.broad_severity("Other") == "low"


def test_select_rules():
    api = R.select_rules(["api-keys"], "strict")
    assert len(api) == 45
    twice = R.select_rules(["api-keys", "api-keys"], "strict")
    assert len(twice) == 45
    assert len(R.select_rules("all", "strict")) == 116
    cred = R.select_rules(["credentials"], "broad")
    assert len(cred) == 29
    with pytest.raises(ValueError):
        R.select_rules(["nope"])


def test_category_and_custom():
    assert R.category_of("SSN") == "Financial Data"
    assert R.category_of("My Rule") == "Custom"
    c = R.custom_rule("My Token", "abc")
    assert c.category == "Custom" and c.severity == "high"
    merged = R.add_rules(R.select_rules(["cloud"]), [c, R.custom_rule("CDN URL", "x")])
    assert len(merged) == 11 and merged[6].regex == "x"


def test_validate(spark):
    ok, bad = R.validate_rules(spark, [R.custom_rule("bad", "(a"), R.custom_rule("good", "a+")])
    assert [r.name for r in ok] == ["good"] and bad[0][0] == "bad"


def test_dialects():
    assert java_regex(r"\bab\b").startswith("(?dim)")
    assert r"\b" not in java_regex(r"\bab\b").replace("\\\\", "")
    assert java_regex(r"[\b]x", "strict") == r"(?d)[\b]x"
    assert java_regex(r"a(\?|$)", "strict") == r"(?d)a(\?|\z)"
    assert java_regex(r"\$_GET", "strict") == r"(?d)\$_GET"
    assert re2_regex("x", "broad") == "(?im)x"


def test_all_rules_compile(spark):
    for prof in ("broad", "strict"):
        ok, bad = R.validate_rules(spark, R.catalogue(prof), prof)
        assert not bad, bad


def test_gates_are_sound():
    """Every gate literal must occur (lower-cased) in every match: check on
    matches found by Python's re over the planted tokens and page text."""
    import re
    samples = ["api_key = 'abcdefghijklmnopqrstuvwx'", "Bearer abc.def", "AKIA" + "ABCDEFGHIJKLMNOP",
               "password=hunter22", "user: bob", "10.1.2.3", "-----BEGIN RSA PRIVATE KEY-----",
               "/admin/x", "a.env?x", "x.bak", "https://s3.amazonaws.com/bucket-name"]
    for r in R.catalogue("broad"):
        if r.line_word or not r.gates:
            continue
        rx = re.compile(r.regex, re.I | re.M | re.A)
        for s in samples:
            for m in rx.finditer(s):
                assert any(g in m.group(0).lower() for g in r.gates), (r.name, m.group(0))
