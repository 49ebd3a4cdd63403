"""Header scanning and the missing-header checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import Rule
from tidemark.functions.rules_data import MISSING_HEADER_RULES
from tidemark.operators.scan import findings_at, match_positions, scan
from tidemark.sources.tables import header_text

HEADER_SUFFIX = " (headers)"


def scan_headers(pages: DataFrame, rules: list[Rule], profile: str = "broad",
                 carry=()) -> DataFrame:
    """Every rule over the ``name: value`` header text of each page; the
    source URL is the page URL + `` (headers)``. Pages without headers are
    skipped, as in both originals."""
    with_text = pages.filter(F.col("headers").isNotNull() & (F.size("headers") > 0)).select(
        "page_id", "url", header_text(F.col("headers"), profile).alias("htext"), *carry)
    return scan(with_text, rules, profile, text_col="htext", part="headers",
                url_suffix=HEADER_SUFFIX, carry=carry)


def page_texts(pages: DataFrame, profile: str = "broad", carry=()) -> DataFrame:
    """The two texts of each page stacked from one read (``_part`` = body / headers)."""
    has_h = F.col("headers").isNotNull() & (F.size("headers") > 0)
    texts = F.array(
        F.struct(F.lit("body").alias("p"), F.col("body").alias("t")),
        F.when(has_h, F.struct(F.lit("headers").alias("p"),
                               header_text(F.col("headers"), profile).alias("t"))))
    return (pages.select("page_id", "url", *carry, F.explode(texts).alias("_x"))
            .filter(F.col("_x").isNotNull())
            .select("page_id", "url", *carry, F.col("_x.p").alias("_part"), F.col("_x.t").alias("_text")))


def scan_page(pages: DataFrame, rules: list[Rule], profile: str = "broad", carry=()) -> DataFrame:
    """Body and header findings of each page in one pass: both texts are
    scanned by one plan."""
    return scan(page_texts(pages, profile, list(carry)), rules, profile, text_col="_text", carry=carry, part_col="_part",
                suffixes={"headers": HEADER_SUFFIX})


def page_positions(pages: DataFrame, rules: list[Rule], profile: str = "broad") -> DataFrame:
    """Where the rules match in each page's texts, a row a text."""
    return match_positions(page_texts(pages, profile), rules, profile, text_col="_text", carry=["_part"])


def page_findings_at(placed: DataFrame, rules: list[Rule], profile: str = "broad", carry=()) -> DataFrame:
    """``page_positions`` → findings, as ``scan_page`` gives them."""
    return findings_at(placed, rules, profile, carry=[*carry, "_part"], part_col="_part", suffixes={"headers": HEADER_SUFFIX})


def missing_headers(pages: DataFrame) -> DataFrame:
    """Per page, each of the four security headers it lacks (names compared
    without case). Output: page_id, url, pattern, header."""
    keys = F.transform(F.map_keys(F.coalesce("headers", F.create_map().cast("map<string,string>"))),
                       lambda k: F.lower(k))
    checks = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(w).alias("header"))
                       for n, w in MISSING_HEADER_RULES])
    return (pages.select("page_id", "url", keys.alias("_k"), F.explode(checks).alias("c"))
            .filter(~F.array_contains("_k", F.col("c.header")))
            .select("page_id", "url", "c.pattern", "c.header"))
