"""Links: extraction from stored HTML, URL resolution, host/scheme/fragment
rules, per-page dedupe and robots filtering — all per-row expressions or
joins keyed by page / authority.

One pass over the html reads it token by token, as a browser's tokenizer
would: comments, declarations, end tags, every start tag with its quoted
values, and elements whose content is no markup (script, style, textarea, ...)
are each consumed whole, so what looks like a tag inside them is none. Of the
``a``, ``link`` and ``form`` tags the attributes are read one after the other,
so an attribute's value never passes for another attribute. The token pattern is
possessive throughout: a position is passed once, and no run costs stack.
URL parts come from the RFC 3986 split regex; dot segments are removed by
folding the path segments.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import let, sql_str
from tidemark.functions.regex import java_regex

# --- FIXED VALUES: link shapes -----------------------------------------------
# elements whose content is text, up to their end tag or the end of the page
TEXT_ELEMENTS = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
# what follows a tag's name: values in quotes may hold ">", bare ones run to white space
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|[^\s>"'][^\s>]*+)?+)*+"""
# a token; group 1: an a, link or form tag without its brackets
TOKEN_RX = "|".join((
    r"<!--(?:-?>|(?:[^-]++|-(?!-!?>))*+(?:--!?>|\z))",
    rf"<((?:a|link|form)(?=[\s/>]){_REST})>",
    rf"<({'|'.join(TEXT_ELEMENTS)})(?=[\s/>]){_REST}(?:>(?:[^<]++|<(?!/\2[\s/>]))*+|\z)",
    rf"<plaintext(?=[\s/>]){_REST}>.*+",
    rf"</?[a-z][^\s/>]*+{_REST}(?:>|\z)",
    r"<[!?/][^>]*+(?:>|\z)",
))
# an attribute: name, then its value in double quotes, in single quotes, or bare
ATTR_RX = r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?"""
# a character reference; without a semicolon it is plain text here
ENTITY_RX = r"&([A-Za-z][A-Za-z0-9]*|#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7});"
# six URL shapes in script text (matched without case)
SCRIPT_RX = [
    r'["\']([^"\']*?\.(?:html|php|jsp|asp|aspx))["\']',
    r'(?:href|src|action)\s*=\s*["\']([^"\']+)["\']',
    r'(?:window\.)?location(?:\.href)?\s*=\s*["\']([^"\']+)["\']',
    r'fetch\(["\']([^"\']+)["\']',
    r'axios\.(?:get|post)\(["\']([^"\']+)["\']',
    r'XMLHttpRequest.*open\([^,]+,\s*["\']([^"\']+)["\']',
]
SKIP_PREFIXES = ("data:", "javascript:", "#")

SCHEME_RX = r"^([A-Za-z][A-Za-z0-9+.-]*):"
AUTH_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_RX = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def _rx(r: str) -> str:
    return sql_str(r)


_TOKEN_JAVA = "(?is)" + TOKEN_RX
#: the named references that HTML defines, by name
_NAMED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
#: numbers 128 to 159 mean Windows-1252 characters where that has one
_WINDOWS = "".join(bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160))


def decoded_sql(v: str) -> str:
    """The character references of ``v`` replaced: every named one of HTML, and
    numeric ones; numbers that are no character give U+FFFD, unknown names stay."""
    name = "get(_en, _ei)"
    number = (f"CAST(CASE WHEN lower({name}) LIKE '#x%' THEN conv(substr({name}, 3), 16, 10) "
              f"WHEN {name} LIKE '#%' THEN substr({name}, 2) END AS BIGINT)")
    point = f"decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')"
    char = (f"CASE WHEN {number} BETWEEN 128 AND 159 THEN substr({sql_str(_WINDOWS)}, CAST({number} - 127 AS INT), 1) "
            f"WHEN {number} = 0 OR {number} BETWEEN 55296 AND 57343 OR {number} > 1114111 THEN '\uFFFD' ELSE {point} END")
    # one literal, looked up in only where a reference was found
    table = f"map_from_arrays(array({', '.join(map(sql_str, _NAMED))}), array({', '.join(map(sql_str, _NAMED.values()))}))"
    named = f"try_element_at({table}, {name})"
    one = (f"CASE WHEN _ei >= size(_en) THEN '' WHEN startswith({name}, '#') THEN {char} "
           f"ELSE coalesce({named}, concat('&', {name}, ';')) END")
    whole = let(f"regexp_extract_all({v}, {sql_str(ENTITY_RX)}, 1)", "_en",
                f"array_join(transform(split({v}, {sql_str(ENTITY_RX)}, -1), (_eg, _ei) -> concat(_eg, {one})), '')")
    return f"CASE WHEN instr({v}, '&') = 0 THEN {v} ELSE {whole} END"


def _tags_sql(html_col: str) -> str:
    """Links of the tags, in document order: ``ord`` counts the page's a, link
    and form tags; a tag without a value for its attribute gives none."""
    tags = f"filter(regexp_extract_all({html_col}, {_rx(_TOKEN_JAVA)}, 1), _tx -> _tx != '')"
    kind = "lower(regexp_extract(_tg, '^[A-Za-z]+', 0))"
    attrs = ", ".join(f"regexp_extract_all(substr(_tg, length(_tk) + 1), {_rx(ATTR_RX)}, {g})" for g in (1, 2, 3, 4))
    wanted = "CASE WHEN _tk = 'form' THEN 'action' ELSE 'href' END"
    first = f"get(filter(arrays_zip({attrs}), _at -> lower(_at['0']) = {wanted}), 0)"
    value = let(first, "_av", let("concat(_av['1'], _av['2'], _av['3'])", "_ah", decoded_sql("_ah")))
    link = let(kind, "_tk", f"named_struct('kind', _tk, 'rank', 0, 'ord', _ti, 'href', {value})")
    return f"filter(transform({tags}, (_tg, _ti) -> {link}), _tl -> coalesce(_tl.href, '') != '')"


def _script_sql(html_col: str) -> str:
    skip = " OR ".join(f"startswith(l.href, {_rx(p)})" for p in SKIP_PREFIXES)
    parts = [f"transform(regexp_extract_all({html_col}, {_rx(java_regex(rx, 'broad'))}, 1), (h, i) -> "
             f"named_struct('kind', 'script{k}', 'rank', {k}, 'ord', i, 'href', h))" for k, rx in enumerate(SCRIPT_RX, 1)]
    return f"filter(concat({', '.join(parts)}), l -> l.href != '' AND NOT ({skip}))"


def _explode(pages: DataFrame, arr_sql: str) -> DataFrame:
    ex = pages.select("page_id", "url", F.explode(F.expr(arr_sql)).alias("l"))
    return ex.select("page_id", "url", "l.kind", "l.rank", "l.ord", "l.href")


def tag_links(pages: DataFrame, kinds=("a", "link", "form"), html_col: str = "html") -> DataFrame:
    """(page_id, url, kind, rank, ord, href) of the tags of these kinds."""
    return _explode(pages, _tags_sql(html_col)).filter(F.col("kind").isin(*kinds))


def script_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The six script shapes; data:, javascript: and # links skipped."""
    return _explode(pages, _script_sql(html_col))


def all_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The broad set: tags and script shapes of each page in one pass over
    the html. (rank, ord) is a link's position: the tags in document order,
    then each script shape."""
    return _explode(pages, f"concat({_tags_sql(html_col)}, {_script_sql(html_col)})")


# --- resolution (Spark SQL text) --------------------------------------------

def _dots(segs: str) -> str:
    """Fold '.'/'..' out of a segment array, as urljoin does."""
    fold = (f"aggregate({segs}, CAST(array() AS ARRAY<STRING>), (acc, s) -> CASE "
            f"WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
            f"WHEN s = '.' THEN acc ELSE array_append(acc, s) END)")
    fixed = (f"CASE WHEN element_at({segs}, -1) IN ('.', '..') THEN array_append({fold}, '') "
             f"ELSE {fold} END")
    joined = f"coalesce(nullif(array_join({fixed}, '/'), ''), '/')"
    # a path under an authority always starts with '/'
    return f"CASE WHEN startswith({joined}, '/') THEN {joined} ELSE concat('/', {joined}) END"


def resolve_sql(base: str, href: str) -> str:
    """Spark SQL: ``href`` resolved against ``base`` (urljoin semantics for
    http(s) bases)."""
    h1 = f"regexp_extract({href}, '^([^#]*)', 1)"
    hfrag = f"CASE WHEN instr({href}, '#') > 0 THEN concat('#', regexp_extract({href}, '#(.*)$', 1)) ELSE '' END"
    hp = f"regexp_extract({h1}, '^([^?]*)', 1)"
    hq = f"regexp_extract({h1}, '\\\\?(.*)$', 1)"
    hq_s = f"CASE WHEN instr({h1}, '?') > 0 AND {hq} <> '' THEN concat('?', {hq}) ELSE '' END"
    bs = f"regexp_extract({base}, {_rx(SCHEME_RX)}, 1)"
    ba = f"regexp_extract({base}, {_rx(AUTH_RX)}, 1)"
    bp = f"regexp_extract({base}, {_rx(PATH_RX)}, 1)"
    b1 = f"regexp_extract({base}, '^([^#]*)', 1)"
    bq = f"regexp_extract({b1}, '\\\\?(.*)$', 1)"
    bq_s = f"CASE WHEN instr({b1}, '?') > 0 AND {bq} <> '' THEN concat('?', {bq}) ELSE '' END"
    origin = f"concat({bs}, '://', {ba})"
    root_path = _dots(f"split({hp}, '/', -1)")
    bparts = f"split({bp}, '/', -1)"
    bdir = (f"CASE WHEN element_at({bparts}, -1) <> '' THEN slice({bparts}, 1, size({bparts}) - 1) "
            f"ELSE {bparts} END")
    joined = f"concat({bdir}, split({hp}, '/', -1))"
    middle = f"filter({joined}, (s, i) -> i = 0 OR i = size({joined}) - 1 OR s <> '')"
    rel_path = _dots(middle)
    return (
        f"CASE WHEN {href} = '' THEN {base} WHEN {href} RLIKE {_rx(SCHEME_RX)} THEN {href} "
        f"WHEN startswith({href}, '//') THEN concat({bs}, ':', {href}) "
        f"WHEN startswith({hp}, '/') THEN concat({origin}, {root_path}, {hq_s}, {hfrag}) "
        f"WHEN {hp} = '' THEN concat({origin}, {bp}, CASE WHEN {hq_s} <> '' THEN {hq_s} ELSE {bq_s} END, {hfrag}) "
        f"ELSE concat({origin}, {rel_path}, {hq_s}, {hfrag}) END")


def resolve(base: Column | str, href: Column | str) -> Column:
    b = base if isinstance(base, str) else None
    h = href if isinstance(href, str) else None
    if b is None or h is None:
        raise TypeError("resolve takes column names")
    return F.expr(resolve_sql(b, h))


def authority(url_col: str) -> Column:
    return F.expr(f"regexp_extract({url_col}, {_rx(AUTH_RX)}, 1)")


def scheme(url_col: str) -> Column:
    return F.lower(F.expr(f"regexp_extract({url_col}, {_rx(SCHEME_RX)}, 1)"))


def cut_fragment(url_col: str) -> Column:
    return F.expr(f"regexp_extract({url_col}, '^([^#]*)', 1)")


def resolved_links(links: DataFrame) -> DataFrame:
    return links.withColumn("resolved", resolve("url", "href"))


def same_host(links: DataFrame, root: str | None = None) -> DataFrame:
    """Links whose authority equals that of the crawl's ``root`` URL, or, by
    default, their page's (port kept, case kept)."""
    own = authority("url") if root is None else F.expr(f"regexp_extract({_rx(root)}, {_rx(AUTH_RX)}, 1)")
    return links.filter(authority("resolved") == own)


def http_only(links: DataFrame) -> DataFrame:
    return links.filter(scheme("resolved").isin("http", "https"))


def targets(links: DataFrame, root: str | None = None, strict: bool = False) -> DataFrame:
    """Resolved links that a crawl follows, with ``dst``. Broad: same host;
    a and link lose their fragment, forms and script links keep it. Strict:
    a and form tags, http(s) only, same host, no fragments."""
    if strict:
        kept = same_host(http_only(links.filter(F.col("kind").isin("a", "form"))), root)
        return kept.withColumn("dst", cut_fragment("resolved"))
    return same_host(links, root).withColumn(
        "dst", F.when(F.col("kind").isin("a", "link"), cut_fragment("resolved")).otherwise(F.col("resolved")))


def dedupe_links(links: DataFrame) -> DataFrame:
    """One row per (page, target), first position (rank, ord) kept."""
    return (links.groupBy("page_id", "url", "dst").agg(F.min(F.struct("rank", "ord")).alias("p"))
            .select("page_id", "url", "dst", "p.rank", "p.ord"))


#: rules of an authority up to which they are tried one after the other
FEW_RULES = 16


def _rule_found_sql(key: str) -> str:
    """Place of ``key`` among the sorted prefixes (or where it would be), by bisection."""
    middle = "CAST((b.lo + b.hi) div 2 AS INT)"
    step = (f"CASE WHEN b.lo >= b.hi THEN b WHEN get(_rules, {middle}).prefix < {key} "
            f"THEN named_struct('lo', {middle} + 1, 'hi', b.hi) ELSE named_struct('lo', b.lo, 'hi', {middle}) END")
    steps = "sequence(1, CAST(ceil(log2(size(_rules) + 1)) AS INT) + 1)"
    return f"aggregate({steps}, named_struct('lo', 0, 'hi', size(_rules)), (b, s) -> {step}, b -> b.lo)"


def robots_filter(urls: DataFrame, robots: DataFrame, url_col: str = "dst") -> DataFrame:
    """Drop URLs disallowed for ``*``: rules of the URL's authority in file
    order, the first whose prefix starts the path (+ query) decides; no
    matching rule (or no robots rows) = allowed.

    Rules are gathered per authority (a robots file is a file of one site),
    sorted by prefix, each prefix with its first line, so each URL is decided
    in-row after one join on authority; the planner broadcasts a small rule side
    and splits a hot authority. In a long file the URL's beginnings, of the
    lengths that prefixes have, are looked up by bisection: the time grows with
    the lengths and the logarithm of the rules, not with the rules.
    """
    first = robots.groupBy("authority", "path_prefix").agg(F.min(F.struct("line_no", "allow")).alias("_first"))
    per_auth = first.groupBy(F.col("authority").alias("_rule_auth")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("path_prefix").alias("prefix"), "_first.line_no", "_first.allow"))).alias("_rules"),
        F.collect_set(F.length("path_prefix")).alias("_lengths"))
    pathq = F.expr(f"regexp_extract({url_col}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)")
    u = urls.withColumn("_auth", authority(url_col)).withColumn("_pq", pathq)
    j = u.join(per_auth, u["_auth"] == per_auth["_rule_auth"], "left")
    line = "named_struct('line_no', r.line_no, 'allow', r.allow)"
    each = f"array_min(transform(filter(_rules, r -> startswith(_pq, r.prefix)), r -> {line}))"
    at = let("left(_pq, l)", "_key", let(f"get(_rules, {_rule_found_sql('_key')})", "r", f"CASE WHEN r.prefix = _key THEN {line} END"))
    looked_up = f"array_min(transform(filter(_lengths, l -> l <= length(_pq)), l -> {at}))"   # nulls, prefixes that are no rule, don't count
    verdict = F.expr(f"(CASE WHEN size(_rules) <= {FEW_RULES} THEN {each} ELSE {looked_up} END).allow")
    return (j.withColumn("_allow", F.coalesce(verdict, F.lit(True)))
            .filter("_allow").drop("_auth", "_pq", "_rule_auth", "_rules", "_lengths", "_allow"))
