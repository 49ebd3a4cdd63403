"""Rule catalogue: kits, selection, severities, categories, custom rules.

Rules are few (hundreds at most) and become literal expressions of the scan
plan, so the catalogue is a driver-side list; ``rules_df`` exposes it as a
DataFrame for the table-shaped operations (counts, divergence, removal).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import rules_data as D
from tidemark.functions.linear import LEADS, LINEAR, SHAPE_OF
from tidemark.functions.regex import java_regex, validate_java

PROFILES = ("broad", "strict")
KIT_TITLES = dict(D.KITS)
KIT_KEYS = [k for k, _ in D.KITS]
LINE_WORDS = dict(D.MISSING_HEADER_RULES)


_PUBLISHED = {name: rx for _, name, rx, *_ in D.RULES}


@dataclass(frozen=True)
class Rule:
    kit: str            # kit key, or "custom"
    name: str
    regex: str          # Python-syntax text, or "LINES"
    category: str
    severity: str       # severity under the profile the rule was loaded for
    gates: tuple = field(default=())
    line_word: str | None = None  # set for the missing-header rules

    @property
    def skips(self) -> bool:
        """The Java form also takes stretches without a match; those leave group 1 empty."""
        return self.name in LINEAR and self.regex == _PUBLISHED.get(self.name)

    @property
    def shape(self) -> str | None:
        """The shape (``linear.SHAPES``) that every match holds."""
        return SHAPE_OF.get(self.name) if self.regex == _PUBLISHED.get(self.name) else None

    def java(self, profile: str) -> str:
        published = self.regex == _PUBLISHED.get(self.name)
        case = "(?i)" if self.regex.startswith("(?i)") else ""
        lead = java_regex(case + LEADS[self.name], profile) if published and self.name in LEADS else ""
        if self.skips:
            main, skip = (java_regex(x, profile) for x in LINEAR[self.name])
            return f"{lead}(?:({main})|(?:{skip}))" if lead else f"({main})|(?:{skip})"
        return lead + java_regex(self.regex, profile)


def broad_severity(name: str) -> str:
    low = name.lower()
    if any(w in low for w in D.HIGH_WORDS):
        return "high"
    if any(w in low for w in D.MEDIUM_WORDS):
        return "medium"
    return "low"


def severity_expr(name: Column) -> Column:
    """Broad severity as a Spark expression (high words tested first)."""
    low = F.lower(name)
    hi = None
    for w in D.HIGH_WORDS:
        c = low.contains(w)
        hi = c if hi is None else (hi | c)
    med = None
    for w in D.MEDIUM_WORDS:
        c = low.contains(w)
        med = c if med is None else (med | c)
    return F.when(hi, "high").when(med, "medium").otherwise("low")


def _first_kit() -> dict[str, str]:
    first: dict[str, str] = {}
    for kit, name, *_ in D.RULES:
        first.setdefault(name, kit)
    return first


_FIRST_KIT = _first_kit()


def category_of(name: str) -> str:
    kit = _FIRST_KIT.get(name)
    return KIT_TITLES[kit] if kit else "Custom"


def catalogue(profile: str = "broad") -> list[Rule]:
    """All built-in rules of a profile, in catalogue order."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    out = []
    for kit, name, rx, sev_strict, gates in D.RULES:
        if profile == "strict" and sev_strict is None:
            continue
        sev = broad_severity(name) if profile == "broad" else sev_strict
        out.append(Rule(kit, name, rx, KIT_TITLES[kit], sev, tuple(gates),
                        LINE_WORDS.get(name) if rx == "LINES" else None))
    return out


def select_rules(kits="all", profile: str = "broad") -> list[Rule]:
    """Choose kits by name; ``all`` loads every kit.

    Broad kit keys are ``api_keys database financial endpoints sensitive
    javascript security cloud``; strict kit names are the file names
    ``api-keys credentials endpoints financial javascript headers cloud``.
    An unknown kit raises; a rule name already loaded is not added twice.
    """
    if isinstance(kits, str):
        kits = [k for k in kits.split(",") if k] or ["all"]
    known = dict(D.STRICT_KITS)
    known.update({k: [k] for k in KIT_KEYS})
    wanted: list[str] = []
    if kits == ["all"]:
        wanted = list(KIT_KEYS)
    else:
        for k in kits:
            if k not in known:
                raise ValueError(f"unknown pattern kit {k!r}")
            wanted.extend(known[k])
    rules, seen = [], set()
    by_kit = {}
    for r in catalogue(profile):
        by_kit.setdefault(r.kit, []).append(r)
    for k in wanted:
        for r in by_kit.get(k, []):
            if r.name not in seen:
                seen.add(r.name)
                rules.append(r)
    return rules


_RULE_SCHEMA = T.StructType([
    T.StructField("kit", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("regex", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("sev_broad", T.StringType()),
    T.StructField("sev_strict", T.StringType()),
])


def rules_df(spark: SparkSession) -> DataFrame:
    """The full catalogue as a table: one row per (kit, rule)."""
    rows = [(kit, name, rx, KIT_TITLES[kit], broad_severity(name), sev)
            for kit, name, rx, sev, _ in D.RULES]
    return spark.createDataFrame(rows, _RULE_SCHEMA)


def rules_to_df(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    schema = T.StructType([
        T.StructField("ord", T.IntegerType()),
        T.StructField("kit", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("regex", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
    ])
    return spark.createDataFrame(
        [(i, r.kit, r.name, r.regex, r.category, r.severity) for i, r in enumerate(rules)],
        schema)


def load_rules(df: DataFrame, profile: str = "broad") -> list[Rule]:
    """Rules held in a table (name, regex[, kit, category, severity]) → list.

    A rule set is the caller's own input, like a query text: its rows become
    literals of the plan, so they come to the driver. Rows are taken in name
    order; a name that repeats is given by its last row.
    """
    out: dict[str, Rule] = {}
    for row in df.orderBy("name", "regex").collect():
        d = row.asDict()
        name, rx = d.get("name"), d.get("regex")
        if not name or not rx:
            raise ValueError("a rule needs a name and a regex")
        out[name] = Rule(d.get("kit") or "custom", name, rx, d.get("category") or category_of(name),
                         d.get("severity") or (broad_severity(name) if profile == "broad" else "medium"), ())
    return list(out.values())


def add_rules(rules: list[Rule], custom: list[Rule]) -> list[Rule]:
    """Append custom rules; a name already present is replaced in place."""
    by_name = {r.name: i for i, r in enumerate(rules)}
    out = list(rules)
    for c in custom:
        if c.name in by_name:
            out[by_name[c.name]] = c
        else:
            by_name[c.name] = len(out)
            out.append(c)
    return out


def custom_rule(name: str, regex: str, profile: str = "broad",
                category: str | None = None, severity: str | None = None) -> Rule:
    """A user rule: category ``Custom`` unless the name is a built-in one,
    severity by name keyword (broad) or ``medium`` (the table default)."""
    if not name or not regex:
        raise ValueError("a rule needs a name and a regex")
    return Rule("custom", name, regex, category or category_of(name),
                severity or (broad_severity(name) if profile == "broad" else "medium"), ())


def validate_rules(spark: SparkSession, rules: list[Rule], profile: str = "broad"):
    """Split rules into (usable, rejected); rejected = [(name, message)]."""
    ok, bad = [], []
    for r in rules:
        if r.line_word is not None or r.regex == _PUBLISHED.get(r.name):
            ok.append(r)
            continue
        err = validate_java(spark, java_regex(r.regex, profile))
        if err is None:
            ok.append(r)
        else:
            bad.append((r.name, err))
    return ok, bad


def rejected_df(spark: SparkSession, bad) -> DataFrame:
    schema = T.StructType([T.StructField("pattern", T.StringType()),
                           T.StructField("error", T.StringType())])
    return spark.createDataFrame(list(bad), schema)


def count_rules(rules_table: DataFrame) -> DataFrame:
    """Rules of a table (kit, n findings) per kit, plus a ``total`` row."""
    return (rules_table.rollup("kit").agg(F.count(F.lit(1)).alias("n_rules"), F.sum(F.coalesce("n", F.lit(0))).alias("n_findings"))
            .select(F.coalesce("kit", F.lit("total")).alias("kit"), "n_rules", "n_findings"))


def remove_rules(rules_table: DataFrame, names=None) -> DataFrame:
    """Drop the named rules; ``names=None`` clears all."""
    if names is None:
        return rules_table.limit(0)
    return rules_table.filter(~F.col("name").isin(list(names)))
