"""DuckDB SQL for the oracle check.

The SQL is written against the same parquet tables, in RE2 syntax: a rule ×
text cross product, ``regexp_extract_all`` / ``string_split_regex``, window
sums for offsets; link shapes are written out here. The rules' published texts
and the derived inputs (``fixtures``) are shared with the Spark side; plans
and expressions are not.
"""

from __future__ import annotations

from tidemark.functions.regex import re2_class, re2_regex
from tidemark.functions.rules import Rule
from tidemark.functions.rules_data import CONTEXT_WHITESPACE, STRICT_WHITESPACE

WS_RUN_RE2 = {"broad": re2_class(CONTEXT_WHITESPACE) + "+", "strict": re2_class(STRICT_WHITESPACE) + "+"}


def q(s: str | None) -> str:
    """SQL string literal."""
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def _most_chars(chars: str, side: str, n: int) -> str:
    """How many characters from one side of ``chars`` take at most ``n`` bytes."""
    return f"list_max(list_filter(range(length({chars}) + 1), lambda k: strlen({side}({chars}, k)) <= {n}))"


def _edge(chars: str, side: str, n: int, more: str) -> str:
    """At most ``n`` bytes from one side of ``chars``; ``more``: characters there
    are in all. Bytes left of a character that does not fit are U+FFFD."""
    k = _most_chars(chars, side, n)
    left = f"repeat(chr(65533), CASE WHEN {k} < {more} THEN CAST({n} - strlen({side}({chars}, {k})) AS INTEGER) ELSE 0 END)"
    whole = f"{side}({chars}, {k})"
    return f"{left} || {whole}" if side == "right" else f"{whole} || {left}"


def _strict_cuts() -> tuple[str, str]:
    """Match and context of the strict profile, by characters and their bytes."""
    match = _edge("left(m, 200)", "left", 200, "length(m)")
    before = _edge("substring(t, greatest(cstart - 100, 0) + 1, least(cstart, 100))", "right", 100, "cstart")
    after = _edge("substring(t, cstart + length(m) + 1, 100)", "left", 100, "length(t) - cstart - length(m)")
    return match, f"{before} || m || {after}"


def scan_sql(src_sql: str, rules: list[Rule], profile: str = "broad", *,
             part: str = "body", url_suffix: str = "", carry: list[str] = ()) -> str:
    """Findings of ``rules`` over ``src_sql`` (columns src_id, page_url, t, carry).

    Columns match ``tidemark.operators.scan.FINDING_COLUMNS`` + carry.
    """
    size = "strlen" if profile == "strict" else "length"   # bytes or characters
    carry = list(carry)
    cc = "".join(f", {c}" for c in carry)
    regex_rules = [(i, r) for i, r in enumerate(rules) if r.line_word is None]
    line_rules = [(i, r) for i, r in enumerate(rules) if r.line_word is not None]
    nonempty = " AND length(t) > 0" if profile == "broad" else ""
    parts = [f"src AS (SELECT * FROM ({src_sql}) WHERE t IS NOT NULL{nonempty})"]
    unions = []
    if regex_rules:
        vals = ",\n".join(
            f"({i}, {q(r.kit)}, {q(r.name)}, {q(r.category)}, {q(r.severity)}, {q(re2_regex(r.regex, profile))})"
            for i, r in regex_rules)
        parts.append(f"rx(rule_idx, kit, pattern, category, severity, rx) AS (VALUES\n{vals})")
        parts.append(
            "hits AS (SELECT s.*, r.rule_idx, r.kit, r.pattern, r.category, r.severity, r.rx, "
            "regexp_extract_all(s.t, r.rx) AS ms FROM src s CROSS JOIN rx r)")
        parts.append(
            "per AS (SELECT src_id, page_url, t, rule_idx, kit, pattern, category, severity" + cc + ", "
            "unnest(ms) AS m, unnest(range(len(ms))) AS match_idx, string_split_regex(t, rx) AS gs "
            "FROM hits WHERE len(ms) > 0)")
        parts.append(
            "pos AS (SELECT *, coalesce(sum(length(gs[match_idx + 1]) + length(m)) OVER ("
            "PARTITION BY src_id, rule_idx ORDER BY match_idx "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(gs[match_idx + 1]) AS cstart, "
            f"coalesce(sum({size}(gs[match_idx + 1]) + {size}(m)) OVER ("
            "PARTITION BY src_id, rule_idx ORDER BY match_idx "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + {size}(gs[match_idx + 1]) AS start "
            "FROM per)")
        unions.append("SELECT src_id, page_url, t, rule_idx, kit, pattern, category, severity" + cc +
                      ", match_idx, cstart, start, m FROM pos")
    if line_rules:
        vals = ",\n".join(
            f"({i}, {q(r.kit)}, {q(r.name)}, {q(r.category)}, {q(r.severity)}, {q(r.line_word)})"
            for i, r in line_rules)
        parts.append(f"lr(rule_idx, kit, pattern, category, severity, word) AS (VALUES\n{vals})")
        parts.append(
            "lines AS (SELECT src_id, page_url, t" + cc + ", unnest(string_split(t, chr(10))) AS line, "
            "unnest(range(len(string_split(t, chr(10))))) AS line_no FROM src)")
        parts.append(
            "lpos AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY src_id "
            "ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cstart, "
            f"coalesce(sum({size}(line) + 1) OVER (PARTITION BY src_id "
            "ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines)")
        parts.append(
            "lhits AS (SELECT l.*, r.rule_idx, r.kit, r.pattern, r.category, r.severity, "
            "row_number() OVER (PARTITION BY l.src_id, r.rule_idx ORDER BY l.line_no) - 1 AS match_idx "
            "FROM lpos l CROSS JOIN lr r WHERE NOT contains(lower(l.line), r.word))")
        unions.append("SELECT src_id, page_url, t, rule_idx, kit, pattern, category, severity" + cc +
                      ", match_idx, cstart, start, line AS m FROM lhits")
    parts.append("allm AS (" + " UNION ALL ".join(unions) + ")")
    url = f"page_url || {q(url_suffix)}" if url_suffix else "page_url"
    if profile == "strict":
        match, context = _strict_cuts()
    else:
        match = "substring(m, 1, 200)"
        context = "substring(t, greatest(start - 100, 0) + 1, least(start + length(m) + 100, length(t)) - greatest(start - 100, 0))"
    body = (
        "WITH " + ",\n".join(parts) + "\n"
        f"SELECT src_id, {url} AS url, page_url, {q(part)} AS part, CAST(rule_idx AS INTEGER) AS rule_idx, "
        "kit, pattern, category, severity, CAST(match_idx AS INTEGER) AS match_idx, "
        f"CAST(start AS INTEGER) AS start, CAST(start + {size}(m) AS INTEGER) AS \"end\", {match} AS match, "
        f"trim(regexp_replace({context}, {q(WS_RUN_RE2[profile])}, ' ', 'g'), ' ') AS context, "
        "(contains(page_url, '.js') OR contains(substring(t, 1, 100), 'javascript')) AS is_javascript, "
        f"md5({url} || pattern || {match}) AS finding_hash" + cc + " FROM allm"
    )
    return body


# --- URL resolution in DuckDB --------------------------------------------------

def _dots_duck(segs: str) -> str:
    fold = (f"list_reduce({segs}, lambda acc, s: CASE WHEN s = '..' THEN acc[1:len(acc) - 1] "
            f"WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])")
    fixed = f"CASE WHEN {segs}[-1] IN ('.', '..') THEN list_append({fold}, '') ELSE {fold} END"
    joined = f"coalesce(nullif(array_to_string({fixed}, '/'), ''), '/')"
    return f"CASE WHEN starts_with({joined}, '/') THEN {joined} ELSE '/' || {joined} END"


def resolve_duck(base: str, href: str) -> str:
    """DuckDB: ``href`` resolved against ``base`` (urljoin for http(s))."""
    SCHEME_RX = r"^([A-Za-z][A-Za-z0-9+.-]*):"
    AUTH_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
    PATH_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
    h1 = f"regexp_extract({href}, '^([^#]*)', 1)"
    hfrag = f"CASE WHEN instr({href}, '#') > 0 THEN '#' || regexp_extract({href}, '#(.*)$', 1) ELSE '' END"
    hp = f"regexp_extract({h1}, '^([^?]*)', 1)"
    hq = f"regexp_extract({h1}, '\\?(.*)$', 1)"
    hq_s = f"CASE WHEN instr({h1}, '?') > 0 AND {hq} <> '' THEN '?' || {hq} ELSE '' END"
    bs = f"regexp_extract({base}, {q(SCHEME_RX)}, 1)"
    ba = f"regexp_extract({base}, {q(AUTH_RX)}, 1)"
    bp = f"regexp_extract({base}, {q(PATH_RX)}, 1)"
    b1 = f"regexp_extract({base}, '^([^#]*)', 1)"
    bq = f"regexp_extract({b1}, '\\?(.*)$', 1)"
    bq_s = f"CASE WHEN instr({b1}, '?') > 0 AND {bq} <> '' THEN '?' || {bq} ELSE '' END"
    origin = f"({bs} || '://' || {ba})"
    root_path = _dots_duck(f"string_split({hp}, '/')")
    bparts = f"string_split({bp}, '/')"
    bdir = f"CASE WHEN {bparts}[-1] <> '' THEN {bparts}[1:len({bparts}) - 1] ELSE {bparts} END"
    joined = f"list_concat({bdir}, string_split({hp}, '/'))"
    middle = f"list_filter({joined}, lambda s, i: i = 1 OR i = len({joined}) OR s <> '')"
    rel_path = _dots_duck(middle)
    return (
        f"CASE WHEN {href} = '' THEN {base} WHEN regexp_matches({href}, {q(SCHEME_RX)}) THEN {href} "
        f"WHEN starts_with({href}, '//') THEN {bs} || ':' || {href} "
        f"WHEN starts_with({hp}, '/') THEN {origin} || {root_path} || {hq_s} || {hfrag} "
        f"WHEN {hp} = '' THEN {origin} || {bp} || CASE WHEN {hq_s} <> '' THEN {hq_s} ELSE {bq_s} END || {hfrag} "
        f"ELSE {origin} || {rel_path} || {hq_s} || {hfrag} END")


# --- links, stated for DuckDB ---------------------------------------------------

# in two steps, unlike the Spark side: first what is no markup, or no start tag, is
# taken out, then all start tags are read, of any name
QUOTED = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
NO_TAG = "(?is)" + "|".join((
    r"<!--(?:-?>|.*?(?:--!?>|\z))",
    *(rf"<{e}(?:[\s/]{QUOTED})?>.*?(?:</{e}[\s/>]|\z)" for e in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")),
    r"<[!?/][^>]*>"))
TAG = rf"""(?is)<([a-z][^\s/>"']*)((?:[\s/]{QUOTED})?)>"""
ATTR = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
REFERENCES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("eacute", "é"), ("nbsp", "\xa0"), ("#224", "à"), ("#x2F", "/"), ("amp", "&"))
SCRIPTS = [
    r"""["']([^"']*?\.(?:html|php|jsp|asp|aspx))["']""",
    r"""(?:href|src|action)\s*=\s*["']([^"']+)["']""",
    r"""(?:window\.)?location(?:\.href)?\s*=\s*["']([^"']+)["']""",
    r"""fetch\(["']([^"']+)["']""",
    r"""axios\.(?:get|post)\(["']([^"']+)["']""",
    r"""XMLHttpRequest.*open\([^,]+,\s*["']([^"']+)["']""",
]


def tag_links_duck(src: str) -> str:
    """(page_id, url, kind, rank, ord, href) of a, link and form tags."""
    tag, attr = q(TAG), q(ATTR)
    refs = "v"
    for name, ch in REFERENCES:
        refs = f"replace({refs}, '&{name};', {q(ch)})"
    tags = (f"list_filter(list_zip(list_transform(regexp_extract_all(h, {tag}, 1), lambda x: lower(x)), regexp_extract_all(h, {tag}, 2)), "
            f"lambda z: z[1] IN ('a', 'link', 'form'))")
    return (f"SELECT page_id, url, kind, 0 AS rank, ord, {refs} AS href FROM ("
            f"SELECT page_id, url, kind, ord, coalesce(d[i], '') || coalesce(s[i], '') || coalesce(b[i], '') AS v FROM ("
            f"SELECT *, list_position(list_transform(regexp_extract_all(att, {attr}, 1), lambda x: lower(x)), "
            f"CASE WHEN kind = 'form' THEN 'action' ELSE 'href' END) AS i, regexp_extract_all(att, {attr}, 2) AS d, "
            f"regexp_extract_all(att, {attr}, 3) AS s, regexp_extract_all(att, {attr}, 4) AS b FROM ("
            f"SELECT page_id, url, tags[n][1] AS kind, tags[n][2] AS att, CAST(n - 1 AS INTEGER) AS ord FROM ("
            f"SELECT page_id, url, tags, unnest(range(1, len(tags) + 1)) AS n FROM (SELECT page_id, url, {tags} AS tags FROM ("
            f"SELECT page_id, url, regexp_replace(html, {q(NO_TAG)}, ' ', 'g') AS h FROM ({src})))))) WHERE i IS NOT NULL) WHERE v <> ''")


def script_links_duck(src: str) -> str:
    parts = []
    for k, rx in enumerate(SCRIPTS, 1):
        arr = f"regexp_extract_all(html, {q('(?i)' + rx)}, 1)"
        parts.append(f"SELECT page_id, url, 'script{k}' AS kind, {k} AS rank, CAST(unnest(range(len({arr}))) AS INTEGER) AS ord, "
                     f"unnest({arr}) AS href FROM ({src})")
    return ("SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE href <> '' AND NOT (starts_with(href, 'data:') "
            "OR starts_with(href, 'javascript:') OR starts_with(href, '#'))")


def all_links_duck(src: str) -> str:
    """Every link with ``resolved``."""
    return (f"SELECT page_id, url, kind, rank, ord, href, {resolve_duck('url', 'href')} AS resolved "
            f"FROM (({tag_links_duck(src)}) UNION ALL ({script_links_duck(src)}))")


AUTH = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
SCHEME = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
NO_FRAGMENT = "regexp_extract({}, '^([^#]*)', 1)"


def targets_duck(src: str, strict: bool = False) -> str:
    """Links a crawl follows, on the page's own host."""
    same = f"{AUTH.format('resolved')} = {AUTH.format('url')}"
    if strict:
        return (f"SELECT page_id, url, kind, rank, ord, {NO_FRAGMENT.format('resolved')} AS dst FROM ({all_links_duck(src)}) "
                f"WHERE kind IN ('a', 'form') AND {SCHEME.format('resolved')} IN ('http', 'https') AND {same}")
    return (f"SELECT page_id, url, kind, rank, ord, CASE WHEN kind IN ('a', 'link') THEN {NO_FRAGMENT.format('resolved')} "
            f"ELSE resolved END AS dst FROM ({all_links_duck(src)}) WHERE {same}")


def deduped_duck(src: str, strict: bool = False) -> str:
    return (f"SELECT page_id, url, dst, rank, ord FROM ({targets_duck(src, strict)}) "
            f"QUALIFY row_number() OVER (PARTITION BY page_id, url, dst ORDER BY rank, ord) = 1")


def allowed_duck(url: str, rules: str) -> str:
    """Robots verdict of a URL: the first rule, in file order, whose prefix fits."""
    return (f"coalesce((SELECT arg_min(r.allow, r.line_no) FROM {rules} r WHERE r.authority = {AUTH.format(url)} AND starts_with("
            f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), r.path_prefix)), true)")
