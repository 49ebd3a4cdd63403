"""Rule scan: every rule over every text, one row per non-overlapping match.

Plan shape (per input partition, no shuffle):

1. one projection holds, per rule, the gated match array
   ``when(lower(text) holds a literal, regexp_extract_all(text, rx, 0))``;
   the regex is a literal, so each task compiles it once, and the gates'
   literals are found in one pass (``functions.literals``);
2. a second projection turns each non-empty match array into positions: gap
   lengths from ``split(text, rx, -1)`` (run only where the rule matched)
   and match lengths give exact offsets; no match text is held there;
3. the positions of all rules are concatenated and exploded; match and
   context are then cut from the text, held as an array of short pieces, by
   generated code that costs what it cuts, wherever the match stands.

Every step is linear in the text. Rules that a backtracking engine would
retry from every start of a long line have an equivalent form that is not
(``functions.linear``); what its skipping alternative took is dropped in 2.

Rule metadata (name, kit, category, severity) enters as literal arrays
indexed by the rule number, so no join is needed.

The broad profile counts characters. The strict one counts bytes of UTF-8, as
its tool does: gaps and matches are measured by their bytes, the text is held as
binary, of which a cut costs what it takes wherever it stands, and a character
that a cut leaves in parts shows as one U+FFFD for each of its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import cut, exclusive_prefix_sums, let, pieces, sql_str
from tidemark.functions.linear import SHAPES
from tidemark.functions.literals import found_sql, pooled
from tidemark.functions.regex import java_class
from tidemark.functions.rules import Rule, validate_rules
from tidemark.functions.rules_data import CONTEXT_WHITESPACE, STRICT_WHITESPACE

MATCH_CAP = 200       # characters (strict: bytes) of a match kept per finding
CONTEXT_SPAN = 100    # and either side of it


def _white_run(chars: str) -> str:
    """One or more of the characters; most texts hold no wide ones, so one look at
    their range spares the list."""
    narrow, wide = "".join(c for c in chars if c < "\u0100"), "".join(c for c in chars if c >= "\u0100")
    return rf"(?:{java_class(narrow)}|(?=[\x{{{ord(min(wide)):x}}}-\x{{{ord(max(wide)):x}}}]){java_class(wide)})++"


WS_RUN = {"broad": _white_run(CONTEXT_WHITESPACE), "strict": _white_run(STRICT_WHITESPACE)}
# what a text without line ends must hold to need folding: two spaces, or white space (or near it) that is none
_CONTROLS = "".join(f"\\x{k:02x}" for k in range(33))
WS_ODD = rf"[{_CONTROLS}\x85\xa0\x{{1680}}-\x{{3000}}](?:(?<! )|(?<=  ))"
SIZE = {"broad": "length", "strict": "octet_length"}

FINDING_COLUMNS = [
    "src_id", "url", "page_url", "part", "rule_idx", "kit", "pattern", "category",
    "severity", "match_idx", "start", "end", "match", "context", "is_javascript",
    "finding_hash",
]


def is_javascript(url: Column, text: Column) -> Column:
    """URL names a .js/.json resource, or 'javascript' in the first 100 chars."""
    return url.contains(".js") | F.substring(text, 1, 100).contains("javascript")


def gate_columns_sql(rules: list[Rule], shared: bool = True) -> list[tuple[str, str]]:
    """(column name, SQL) of what the gates read, each over the ones before it and
    ``_t``: the lower-case text ``_lt``, the literals that stand in it
    ``_lits``, and a flag for every shape that some rule's matches hold. Without
    ``shared`` only ``_lt``: where most rules are not run, their gates are not either."""
    rules = [r for r in rules if r.line_word is None]
    out = [("_lt", "lower(_t)")] if any(r.gates for r in rules) else []
    if not shared:
        return out
    if pool := pooled(g for r in rules for g in r.gates):
        out.append(("_lits", found_sql("_lt", pool)))
    shapes = [r.shape for r in rules]
    return out + [(f"_{s}", f"_t RLIKE {sql_str(rx)}") for s, rx in SHAPES.items() if shapes.count(s) > 1]


def _gate_sql(rule: Rule, gates: list[str], pool: set[str]) -> str | None:
    """The rule's gates, over the columns of ``gate_columns_sql``."""
    out = []
    if rule.gates:
        out.append(" OR ".join(f"contains({'_lits' if g in pool else '_lt'}, {sql_str(g)})" for g in rule.gates))
    if f"_{rule.shape}" in gates:
        out.append(f"_{rule.shape}")
    return " AND ".join(f"({c})" for c in out) or None


def _hit_sql(idx: int, mcol: str, vcol: str | None, java_rx: str) -> str:
    """One rule's matches plus the gaps between them (the split runs only
    on a hit); ``v`` tells matches from skipped stretches."""
    return (f"named_struct('i', {idx}, 'm', {mcol}, 'v', {vcol or 'CAST(NULL AS ARRAY<STRING>)'}, "
            f"'g', CASE WHEN size({mcol}) > 0 THEN split(_t, {sql_str(java_rx)}, -1) END)")


def _positions_sql(hits: list[str], size: str) -> str:
    """Position structs for all rules that matched (one shared lambda)."""
    body = ("transform(filter(transform(ml, (n, j) -> named_struct('start', get(pre, j) + get(gl, j), 'len', n, "
            "'ok', h.v IS NULL OR get(h.v, j) != '')), x -> x.ok), "
            "(x, k) -> named_struct('rule_idx', h.i, 'match_idx', k, 'start', x.start, 'len', x.len))")
    body = let(exclusive_prefix_sums("d", "p_"), "pre", body)
    body = let("zip_with(slice(gl, 1, size(ml)), ml, (a, b) -> coalesce(a, 0) + b)", "d", body)
    body = let(f"transform(h.m, w -> {size}(w))", "ml", body)
    body = let(f"transform(h.g, q -> {size}(q))", "gl", body)
    return (f"flatten(transform(filter(array({', '.join(hits)}), hh -> hh.g IS NOT NULL), "
            f"h -> {body}))")


def _line_positions_sql(line_rules, size: str) -> str:
    """Missing-header rules: every line (empty ones too) lacking the word."""
    per_rule = []
    for idx, r in line_rules:
        v = f"l{idx}_"
        keep = f"filter(li, {v}x -> NOT contains({v}x.low, {sql_str(r.line_word)}))"
        per_rule.append(f"transform({keep}, ({v}x, {v}k) -> named_struct('rule_idx', {idx}, 'match_idx', {v}k, "
                        f"'start', {v}x.start, 'len', {v}x.len))")
    info = "transform(ls, (lx, lj) -> named_struct('start', get(st, lj), 'len', get(ll, lj), 'low', lower(lx)))"
    body = let(info, "li", f"flatten(array({', '.join(per_rule)}))")
    body = let(exclusive_prefix_sums("transform(ll, n -> n + 1)", "ln_"), "st", body)
    body = let(f"transform(ls, lw -> {size}(lw))", "ll", body)
    return let("split(_t, '\\n', -1)", "ls", body)


def held_sql(profile: str, text: str = "_t") -> str:
    """The text as cuts are made from it."""
    return f"CAST({text} AS BINARY)" if profile == "strict" else pieces(text)


def flat_sql(text: str = "_t") -> str:
    """The text with spaces for line ends: its places are the same, and it is
    done once a text, not once a context."""
    return f"replace({text}, '\\n', ' ')"


def odd_sql(text: str = "_t") -> str:
    """Whether a context of the text may need more than that."""
    return f"{flat_sql(text)} RLIKE {sql_str(WS_ODD)}"


def total_sql(profile: str) -> str:
    return f"{SIZE[profile]}(_t)"


def byte_cut(held: str, start: str, n: str) -> str:
    """``n`` bytes from the 0-based ``start``, as text. Bytes of a character
    whose rest is cut off become a U+FFFD each: of a head with bytes after it
    ``make_valid_utf8`` makes only one."""
    part = f"substring({held}, CAST({start} + 1 AS INT), CAST({n} AS INT))"
    tail = f"hex(substring({part}, -3, 3))"
    more = f"CASE WHEN {tail} RLIKE 'F.[89AB].[89AB].$' THEN 2 WHEN {tail} RLIKE '[EF].[89AB].$' THEN 1 ELSE 0 END"
    return f"concat(make_valid_utf8(CAST({part} AS STRING)), repeat('\uFFFD', {more}))"


def _cut(held: str, start: str, n: str, profile: str) -> str:
    return (byte_cut if profile == "strict" else cut)(held, start, n)


def match_sql(start: str, length: str, profile: str = "broad", held: str = "_c") -> str:
    return _cut(held, start, f"least({length}, {MATCH_CAP})", profile)


def around_sql(start: str, length: str, profile: str = "broad", held: str = "_k", total: str = "_n") -> str:
    """The match with CONTEXT_SPAN either side, from the text without line ends."""
    low = f"greatest({start} - {CONTEXT_SPAN}, 0)"
    high = f"least({start} + {length} + {CONTEXT_SPAN}, {total})"
    return _cut(held, low, f"({high} - {low})", profile)


def folded_sql(text: str, profile: str = "broad", odd: str = "_odd") -> str:
    """White space of a cut without line ends folded to single spaces and
    trimmed. The pattern runs only where more is to do."""
    return (f"trim(CASE WHEN {odd} AND {text} RLIKE {sql_str(WS_ODD)} THEN regexp_replace({text}, {sql_str(WS_RUN[profile])}, ' ') "
            f"ELSE {text} END)")


def match_columns_sql(rules: list[Rule], profile: str, extra: str | None = None, shared: bool = True):
    """(column name, SQL) of each regex rule's gated match array over
    ``_t`` and the columns of ``gate_columns_sql``, and for rules that skip, of
    the array that is empty where they did (``_v``); ``extra(rule)`` may add a
    condition per rule."""
    gates = [name for name, _ in gate_columns_sql(rules, shared)]
    pool = set(pooled(g for r in rules if r.line_word is None for g in r.gates)) if "_lits" in gates else set()
    out = []
    for i, r in enumerate(rules):
        if r.line_word is not None:
            continue
        conds = [c for c in (extra(r) if extra else None, _gate_sql(r, gates, pool)) if c]
        cond = " AND ".join(f"({c})" for c in conds)
        for name, group in ((f"_m{i}", 0), (f"_v{i}", 1)) if r.skips else ((f"_m{i}", 0),):
            m = f"regexp_extract_all(_t, {sql_str(r.java(profile))}, {group})"
            out.append((name, f"CASE WHEN {cond} THEN {m} END" if cond else m))
    return out


def positions_sql(rules: list[Rule], profile: str, column=lambda name: name, line_gate=None) -> str:
    """Array of position structs for one text, given the match arrays
    (``column(name)``: the columns of ``match_columns_sql`` by default).
    ``line_gate(rules)``: SQL condition under which the line rules run."""
    regex_rules = [(i, r) for i, r in enumerate(rules) if r.line_word is None]
    line_rules = [(i, r) for i, r in enumerate(rules) if r.line_word is not None]
    parts = []
    if regex_rules:
        parts.append(_positions_sql([_hit_sql(i, column(f"_m{i}"), column(f"_v{i}") if r.skips else None, r.java(profile))
                                     for i, r in regex_rules], SIZE[profile]))
    if line_rules:
        lines = _line_positions_sql(line_rules, SIZE[profile])
        if line_gate:
            none = "CAST(array() AS ARRAY<STRUCT<rule_idx INT, match_idx INT, start INT, len INT>>)"
            lines = f"CASE WHEN {line_gate(line_rules)} THEN {lines} ELSE {none} END"
        parts.append(lines)
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def meta_arrays_sql(rules: list[Rule]) -> dict:
    """Literal arrays of rule names, kits, categories and severities."""
    def lits(vals):
        return "array(" + ", ".join(sql_str(x) for x in vals) + ")"
    return {"pattern": lits([r.name for r in rules]), "kit": lits([r.kit for r in rules]),
            "category": lits([r.category for r in rules]), "severity": lits([r.severity for r in rules])}


def scan(df: DataFrame, rules: list[Rule], profile: str = "broad", *,
         text_col: str = "body", url_col: str = "url", id_col: str = "page_id",
         part: str = "body", url_suffix: str = "", carry=(),
         part_col: str | None = None, suffixes: dict | None = None, filled: bool = False) -> DataFrame:
    """Run ``rules`` over ``df[text_col]``; one row per match.

    Output columns: ``FINDING_COLUMNS`` plus ``carry``. ``url`` is the source
    URL (``page_url`` + ``url_suffix``); ``start``/``end`` are 0-based
    offsets into the scanned text, of characters (strict: of UTF-8 bytes). With ``part_col`` the part
    comes from that column and the URL suffix from ``suffixes[part]``, so
    several texts of a page (body, headers) go through one plan.
    The broad profile skips empty texts, as the broad tool does. ``filled`` says
    that no text is null or empty: the test would be pushed below the shuffle,
    and a text that is computed be computed there a second time.
    """
    carry = list(carry) + ([part_col] if part_col and part_col not in carry else [])
    placed = match_positions(df, rules, profile, text_col=text_col, url_col=url_col, id_col=id_col, carry=carry, filled=filled)
    return findings_at(placed, rules, profile, part=part, url_suffix=url_suffix, carry=carry, part_col=part_col, suffixes=suffixes)


def match_positions(df: DataFrame, rules: list[Rule], profile: str = "broad", *,
                    text_col: str = "body", url_col: str = "url", id_col: str = "page_id", carry=(), filled: bool = False) -> DataFrame:
    """The rules' part of ``scan``: a row per text, with the text and the places
    of all matches (``_f``). Findings, many times as long as the text, are
    cut from it by ``findings_at``, so this is what to keep for several uses."""
    if not rules:
        raise ValueError("no rules to scan with")
    _, rejected = validate_rules(df.sparkSession, rules, profile)
    if rejected:
        raise ValueError(f"rules that cannot run: {rejected}")
    carry = list(carry)
    t = F.col("_t")
    base = df.select(F.col(id_col).alias("src_id"), F.col(url_col).alias("page_url"),
                     F.col(text_col).alias("_t"), *carry)
    if not filled:
        base = base.filter(t.isNotNull())
        if profile == "broad":
            base = base.filter(F.length(t) > 0)

    for name, sql in gate_columns_sql(rules):
        base = base.withColumn(name, F.expr(sql))

    # 1. gated match arrays, one column per rule
    mcols = [F.expr(sql).alias(name) for name, sql in match_columns_sql(rules, profile)]
    keep = ["src_id", "page_url", "_t", *carry]
    step1 = base.select(*keep, *mcols)

    # 2. positions per rule; split only where the rule matched
    return step1.select(*keep, F.expr(positions_sql(rules, profile)).alias("_f"))


def findings_at(placed: DataFrame, rules: list[Rule], profile: str = "broad", *, part: str = "body",
                url_suffix: str = "", carry=(), part_col: str | None = None, suffixes: dict | None = None) -> DataFrame:
    """``match_positions`` → findings (columns as ``scan``)."""
    carry = list(carry)
    step2 = placed.select("src_id", "page_url", *carry,
                          is_javascript(F.col("page_url"), F.col("_t")).alias("is_javascript"),
                          F.expr(held_sql(profile)).alias("_c"), F.expr(held_sql(profile, flat_sql())).alias("_k"),
                          F.expr(odd_sql()).alias("_odd"), F.expr(total_sql(profile)).alias("_n"), "_f")

    # 3. explode, cut, and attach rule metadata from literal arrays. A plain
    # explode makes the optimizer add ``size(array) > 0`` below it, which
    # re-evaluates every rule a second time; explode_outer + a null filter
    # on the (small) struct avoids that.
    ex = step2.select("src_id", "page_url", *carry, "is_javascript", "_c", "_k", "_odd", "_n",
                      F.explode_outer("_f").alias("f")).filter(F.col("f").isNotNull())
    meta = meta_arrays_sql(rules)
    names, kits = F.expr(meta["pattern"]), F.expr(meta["kit"])
    cats, sevs = F.expr(meta["category"]), F.expr(meta["severity"])
    idx = F.col("f.rule_idx")
    if part_col:
        suffix = F.lit("")
        for k, v in (suffixes or {}).items():
            suffix = F.when(F.col(part_col) == k, F.lit(v)).otherwise(suffix)
        url = F.concat(F.col("page_url"), suffix)
        part_c = F.col(part_col)
    else:
        url = F.concat(F.col("page_url"), F.lit(url_suffix)) if url_suffix else F.col("page_url")
        part_c = F.lit(part)
    carry = [c for c in carry if c != part_col]
    out = ex.select(
        "src_id", url.alias("url"), "page_url", part_c.alias("part"),
        idx.alias("rule_idx"), F.get(kits, idx).alias("kit"),
        F.get(names, idx).alias("pattern"), F.get(cats, idx).alias("category"),
        F.get(sevs, idx).alias("severity"), F.col("f.match_idx").alias("match_idx"),
        F.col("f.start").alias("start"), (F.col("f.start") + F.col("f.len")).alias("end"),
        F.expr(match_sql("f.start", "f.len", profile)).alias("match"),
        F.expr(around_sql("f.start", "f.len", profile)).alias("context"),
        "is_javascript", *carry, "_odd")
    # in a projection of its own: what is cut once is folded
    return out.withColumn("context", F.expr(folded_sql("context", profile))).withColumn(
        "finding_hash", F.md5(F.concat(F.col("url"), F.col("pattern"), F.col("match")))).drop("_odd")


def failed(df: DataFrame, rejected: list[tuple[str, str]], id_col: str = "page_id", text_col: str = "body") -> DataFrame:
    """(id, pattern, error): a row for each text that a rejected rule (name,
    message) would have been run over. The rules are the caller's own short
    list, so they enter as a literal array."""
    rules = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(m).alias("error")) for n, m in rejected]).cast(
        "array<struct<pattern:string,error:string>>")
    texts = df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    return texts.select(id_col, F.explode(rules).alias("r")).select(id_col, "r.pattern", "r.error")
