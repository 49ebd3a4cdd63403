"""Every rule fires: on a text made from its pattern, on neighbours of that
text (a hit twice, with a character less at either end), as Python reads it."""
import re
import warnings

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from tidemark.functions import rules as R

from .test_scan import brute, spark_set


def examples(rule, n=6):
    """Texts that the rule's published pattern matches from end to end."""
    found = []
    alphabet = st.characters(min_codepoint=32, max_codepoint=126)

    @settings(max_examples=40, phases=[Phase.generate], derandomize=True, database=None, deadline=None,
              suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.regex, re.A), fullmatch=True, alphabet=alphabet))
    def collect(text):
        if text and len(found) < n and re.search(rule.regex, text, re.I | re.M | re.A):
            found.append(text)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        collect()
    return found


@pytest.mark.parametrize("profile", ["broad"])
def test_every_rule_has_a_hit_and_near_misses(spark, profile):
    rules = R.catalogue(profile)
    texts = []
    for rule in rules:
        made = ["Server: x\n\nend"] if rule.line_word else examples(rule)
        assert made, rule.name
        for e in made:
            texts += [e, f"a {e} {e} z", e[1:], e[:-1], f"x{e}\n{e}1", e.upper(), e + "." + e]
    texts = list(enumerate(dict.fromkeys(texts)))
    got = spark_set(spark, texts, rules)
    want = brute(texts, rules)
    assert got == want, sorted(got ^ want, key=str)[:4]
    assert {g[1] for g in got} == {r.name for r in rules} and len(rules) == 149
