"""``scan_text(text, kit)``: the scan callable from SQL.

A SQL scalar function returning the findings of one text as an array of
structs; its body is the same native expression the DataFrame scan uses
(regex literals, gates, offsets, context), and ``inline`` turns the array
into rows:

    SELECT d.doc_id, f.* FROM (SELECT doc_id, scan_text(text, 'financial') AS fa FROM docs) d
    LATERAL VIEW OUTER inline(d.fa) f WHERE f.rule_idx IS NOT NULL

(``OUTER`` + the null filter: a plain ``inline`` makes the optimizer push
``size(array) > 0`` into the scan, evaluating every regex twice.)

A scalar function is expanded in place, so the plan is one projection and a
Generate over the input partitions. (A SQL *table* function called with
LATERAL is decorrelated by Spark into distinct-texts → join back, which
shuffles every text; that form is not used.)

``kit`` is a kit key (``api_keys`` … ``cloud``) or ``all``; rules of other
kits, the line rules included, are gated off and not evaluated.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark.functions.arrays import let, sql_str
from tidemark.functions.rules import Rule, select_rules
from tidemark.operators.scan import (around_sql, flat_sql, folded_sql, gate_columns_sql, held_sql, match_columns_sql, match_sql,
                                     meta_arrays_sql, odd_sql, positions_sql, total_sql)

FIELDS = ("rule_idx INT, kit STRING, pattern STRING, category STRING, severity STRING, "
          "match_idx INT, start INT, `end` INT, match STRING, context STRING")


def scan_text_sql(rules: list[Rule], profile: str = "broad", name: str = "scan_text") -> str:
    def kit_ok(r: Rule) -> str:
        return f"_kit = 'all' OR _kit = {sql_str(r.kit)}"
    mcols = match_columns_sql(rules, profile, kit_ok, shared=False)
    slot = {name: k for k, (name, _) in enumerate(mcols)}
    found = positions_sql(rules, profile, column=lambda name: f"_ms[{slot[name]}]",
                          line_gate=lambda lines: " OR ".join({f"({kit_ok(r)})" for _, r in lines}))
    if mcols:
        found = let("array(" + ", ".join(sql for _, sql in mcols) + ")", "_ms", found)
    for column, sql in gate_columns_sql(rules, shared=False):
        found = let(sql, column, found)
    meta = meta_arrays_sql(rules)
    context = let(around_sql("f.start", "f.len", profile), "_x", folded_sql("_x", profile))
    shaped = (f"transform({found}, f -> named_struct('rule_idx', f.rule_idx, "
              f"'kit', get({meta['kit']}, f.rule_idx), 'pattern', get({meta['pattern']}, f.rule_idx), "
              f"'category', get({meta['category']}, f.rule_idx), 'severity', get({meta['severity']}, f.rule_idx), "
              f"'match_idx', f.match_idx, 'start', f.start, 'end', f.start + f.len, "
              f"'match', {match_sql('f.start', 'f.len', profile)}, 'context', {context}))")
    shaped = let(total_sql(profile), "_n", let(held_sql(profile), "_c", let(held_sql(profile, flat_sql()), "_k", let(odd_sql(), "_odd", shaped))))
    empty = "_t IS NULL" + (" OR length(_t) = 0" if profile == "broad" else "")
    body = f"CASE WHEN {empty} THEN CAST(array() AS ARRAY<STRUCT<{FIELDS}>>) ELSE {shaped} END"
    return (f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(_t STRING, _kit STRING) "
            f"RETURNS ARRAY<STRUCT<{FIELDS}>> RETURN {body}")


def register_scan_text(spark: SparkSession, rules: list[Rule] | None = None, profile: str = "broad",
                       name: str = "scan_text") -> str:
    spark.sql(scan_text_sql(rules or select_rules("all", profile), profile, name))
    return name
