"""Derived inputs, each stated once as SQL text valid in both Spark SQL and
DuckDB, so the Spark query and the oracle compute the same thing.

* response headers and status per page, by ``page_id`` residues;
* planted tokens appended to document text, by ``doc_id`` residue, built
  from ``md5(doc_id)`` with marks assembled from pieces at run time;
* scan membership of pages (one page may be in two scans) and scan times
  from ``events``.
All are narrow per-row expressions or small aggregates over given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import read_table

# (name, seq, value, modulus, residues of page_id that carry it)
HEADER_ROWS = [
    ("Content-Type", 1, "text/html; charset=utf-8", 1, (0,)),
    ("Server", 1, "nginx/1.18.0", 4, (0,)),
    ("Server", 1, "Apache/2.4.41 (Ubuntu)", 4, (1,)),
    ("Server", 1, "cloudflare", 4, (2,)),
    ("Server", 1, "Microsoft-IIS/10.0", 4, (3,)),
    ("X-Powered-By", 1, "PHP/7.4.3", 5, (0,)),
    ("X-Powered-By", 1, "Express", 5, (1,)),
    ("X-Powered-By", 1, "ASP.NET", 5, (2,)),
    ("X-AspNet-Version", 1, "4.0.30319", 5, (2,)),
    ("Access-Control-Allow-Origin", 1, "*", 3, (0,)),
    ("Content-Security-Policy", 1, "default-src 'self'", 2, (0,)),
    ("X-Frame-Options", 1, "DENY", 3, (0, 2)),
    ("X-Content-Type-Options", 1, "nosniff", 4, (0, 1, 2)),
    ("Strict-Transport-Security", 1, "max-age=31536000", 6, (0, 1, 2)),
    ("Set-Cookie", 1, "sid=abc; HttpOnly", 2, (1,)),
    ("Set-Cookie", 2, "theme=dark", 2, (1,)),
    ("X-Debug", 1, "debug=true", 7, (3,)),
]
STATUS_CODES = [200, 200, 200, 301, 404, 500, 403]   # by page_id % 7
N_SCANS = 4


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spark_lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def header_rows_sql_union(id_col: str = "page_id", table: str = "pages") -> str:
    """DuckDB: the header rows (page_id, name, seq, value)."""
    parts = []
    for name, seq, value, mod, res in HEADER_ROWS:
        cond = f"{id_col} % {mod} IN ({', '.join(map(str, res))})"
        parts.append(f"SELECT {id_col} AS page_id, {_lit(name)} AS name, {seq} AS seq, "
                     f"{_lit(value)} AS value FROM {table} WHERE {cond}")
    return " UNION ALL ".join(parts)


def header_rows(pages: DataFrame) -> DataFrame:
    """Spark: header rows per page (narrow: a filtered literal array per row)."""
    structs = ", ".join(
        f"named_struct('name', {_spark_lit(n)}, 'seq', {s}, 'value', {_spark_lit(v)}, "
        f"'keep', page_id % {m} IN ({', '.join(map(str, r))}))"
        for n, s, v, m, r in HEADER_ROWS)
    arr = F.expr(f"filter(array({structs}), x -> x.keep)")
    return (pages.select("page_id", F.inline(arr))
            .select("page_id", "name", F.col("seq").cast("int").alias("seq"), "value"))


def headers_map_expr():
    """Spark: first value per header name as a map, computed per row."""
    firsts = {}
    for n, s, v, m, r in HEADER_ROWS:
        firsts.setdefault(n, []).append((s, v, m, r))
    entries = []
    for n, vals in firsts.items():
        # the lowest seq present wins
        cases = " ".join(
            f"WHEN page_id % {m} IN ({', '.join(map(str, r))}) THEN {_spark_lit(v)}"
            for s, v, m, r in sorted(vals))
        entries.append(f"named_struct('k', {_spark_lit(n)}, 'v', CASE {cases} END)")
    return F.expr(
        f"map_from_entries(transform(filter(array({', '.join(entries)}), e -> e.v IS NOT NULL), "
        f"e -> struct(e.k, e.v)))")


def status_expr_sql(id_col: str = "page_id") -> str:
    """Same text in both engines."""
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(STATUS_CODES))
    return f"CAST(CASE {id_col} % {len(STATUS_CODES)} {whens} END AS INTEGER)"


def pages_with_headers(spark: SparkSession, sf_dir: str, profile: str = "broad") -> DataFrame:
    """Stored pages in Page schema with derived headers and status."""
    pages = read_table(spark, sf_dir, "pages")
    out = pages.select("page_id", "url", F.col("html").alias("body"),
                       headers_map_expr().alias("headers"),
                       F.expr(status_expr_sql()).alias("status_code"),
                       F.lit(0).alias("depth"), F.lit(False).alias("from_js"))
    if profile == "broad":
        out = out.filter(F.col("body").isNotNull() & (F.length("body") > 0))
    return out


# --- planted tokens ----------------------------------------------------------
# Each residue of doc_id % len(PLANTS) appends one token shaped like a rule's
# target; marks are joined from pieces so no literal token sits in the repo.
# Text valid in both Spark SQL and DuckDB; ``{h}`` stands for md5 of the id.
PLANTS = [
    "concat('AK', 'IA', upper(substr({h}, 1, 16)))",
    "concat('gh', 'p_', substr({h}, 1, 32), substr({h}, 1, 4))",
    "concat('https://hooks.', 'slack.com/services/T', upper(substr({h}, 1, 8)), '/B', upper(substr({h}, 9, 8)), '/', substr({h}, 17, 16))",
    "concat('sk', '_live_', substr({h}, 1, 24))",
    "concat('password', '=', substr({h}, 1, 10))",
    "concat('mongo', 'db://app:', substr({h}, 1, 8), '@db.internal:27017/app')",
    "concat('ey', substr({h}, 1, 12), '.ey', substr({h}, 13, 12), '.', substr({h}, 1, 16))",
    "concat('-----BEGIN ', 'RSA PRIVATE', ' KEY-----')",
    "concat('123-45-', lpad(substr({h}, 1, 4), 4, '0'))",
    "concat('AI', 'za', substr({h}, 1, 32), 'x_-')",
    "concat('https://s3.', 'amazonaws.com/', substr({h}, 1, 12))",
    "concat('AK', 'IA', upper(substr({h}, 1, 10)))",
    "concat('api', '_key = ', chr(34), substr({h}, 1, 24), chr(34))",
    "concat('xox', 'b-', '1234567890-1234567890-', substr({h}, 1, 24))",
    "concat('SELECT * FROM t WHERE id=', '$', '_GET[id]')",
    "concat('aws_secret', '_access_key=', substr({h}, 1, 32), substr({h}, 1, 8))",
    # endpoints, two texts for the kit
    "concat_ws(chr(10), '/admin', '/api/v1/items', '/graphql', 'site.env', 'x.bak', 'dump.sql', 'err.log', 'a.tar.gz', "
    "'index.php', '.git/config .svn/ .idea/')",
    "concat_ws(chr(10), 'package.json webpack.config .travis.yml', 'Dockerfile k8s.yaml', '/debug /phpinfo.php', "
    "'/server-status /.well', concat('near: .envy /adm /graph .gi package_json ', {h}))",
    # javascript, two texts for the kit, and near misses
    "concat_ws(chr(10), concat('var api', 'Url = ', chr(34), substr({h}, 1, 8), chr(34)), concat('let my', 'Token = ', chr(34), {h}, chr(34)), "
    "'config = {{ key: 1 }}', 'fetch(x, {{headers: {{Authorization: t}}}})', concat('xhr.setRequestHeader(', chr(34), 'Authorization', chr(34)), "
    "concat('localStorage.getItem(', chr(34), 'token', chr(34)), concat('sessionStorage.setItem(', chr(34), 'key', chr(34)))",
    "concat_ws(chr(10), 'window.myToken = 1', concat('// my key: ', substr({h}, 1, 20)), concat('import x from ', chr(34), './config', chr(34)), "
    "concat('require(', chr(34), './secret', chr(34), ')'), 'axios.get(u, {{headers: h}})', 'process.env.API_KEY', "
    "concat('https://h.example/x?api_key=', {h}), 'fetch(x, {{headers: 1}}) config = {{ a }} // nothing here axios.get(u)')",
]


def planted_text_sql(id_col: str, text_col: str) -> str:
    h = f"md5(CAST({id_col} AS STRING))"
    whens = " ".join(f"WHEN {i} THEN {p.format(h=h)}" for i, p in enumerate(PLANTS))
    return f"concat({text_col}, ' ', CASE {id_col} % {len(PLANTS)} {whens} END)"


def planted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
                       F.expr(planted_text_sql("doc_id", "text")).alias("text"))


def planted_documents_sql() -> str:
    return (f"SELECT doc_id AS src_id, concat('doc://', CAST(doc_id AS STRING)) AS page_url, "
            f"{planted_text_sql('doc_id', 'text')} AS t FROM documents")


# --- scans -------------------------------------------------------------------

def scan_membership_sql(id_col: str = "page_id") -> str:
    """scan ids of a page: its own residue, and the next scan for every
    fifth page (a rescan that repeats findings)."""
    return (f"CASE WHEN {id_col} % 5 = 0 THEN array({id_col} % {N_SCANS}, ({id_col} + 1) % {N_SCANS}) "
            f"ELSE array({id_col} % {N_SCANS}) END")


def scans_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scan: start/end from the events table (min/max ts per residue)."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.groupBy((F.col("event_id") % N_SCANS).cast("long").alias("scan_id"))
            .agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time")))


SCANS_TIMES_SQL = (f"SELECT CAST(event_id % {N_SCANS} AS BIGINT) AS scan_id, min(ts) AS start_time, "
                   f"max(ts) AS end_time FROM events GROUP BY 1")


def visited_sql(id_col: str = "src_id", scan_col: str = "scan_id") -> str:
    """Second at which a scan sees a page: scans are an hour apart, and from the
    third on every 13th page comes three hours late. Same text in both engines."""
    return (f"CAST(1700000000 + {scan_col} * 3600 + {id_col} % 600 - CASE WHEN {id_col} % 13 = 0 AND {scan_col} >= 2 "
            f"THEN 10800 ELSE 0 END AS BIGINT)")


# --- links beyond the stored anchors ------------------------------------------
# Appended to the html by page_id % 6: form, link, fetch, XHR, axios and
# location shapes; absolute, scheme-relative, query-only, dot-segment,
# mailto:, data:, javascript: and fragment hrefs. Same text in both engines.
AUTH_RX_SQL = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"
EXTRA_LINKS = [
    "concat('<form method=\"post\" action=\"/submit?id=', {id}, '\"></form><a href=\"mailto:info@example.com\">m</a>')",
    "concat('<link rel=\"stylesheet\" href=\"../static/site.css\"><a href=\"data:text/plain,hi\">d</a>"
    "<script>axios.get(\"/api/v1/items\")</script>')",
    "concat('<script>fetch(\"/api/items/', {id}, '\"); var x = new XMLHttpRequest(); x.open(\"GET\", \"/xhr/', {id}, "
    "'\");</script><a href=\"javascript:void(0)\">j</a>')",
    "concat('<script>window.location.href = \"./next.html\";</script><a href=\"#top\">t</a><a href=\"Sub/Page.PHP\">p</a>')",
    "concat('<a href=\"https://other.example.org/x/', {id}, '\">x</a><a href=\"//', {auth}, '/proto/', {id}, '#f\">s</a>"
    "<a data-href=\"/no\" href=/bare>b</a><A title=\"x href=/in\" HREF=\"/q?a=1&amp;b=2\">e</A><form action=\"/send#part\"></form>')",
    "concat('<a href=\"?page=', {id}, '\">q</a><a href=\"../up/./a/../b.html#frag\">u</a><form action=\"\">f</form>')",
]


# What looks like a link in comments, scripts and other text, by page_id % 7,
# and links right behind it; the last one's comment has no end.
HIDDEN_LINKS = [
    "'<!-- <a href=\"/hidden/comment\"> --><a href=\"/after/comment\">c</a>'",
    "concat('<script>var s = \"<a href=', chr(39), '/hidden/script', chr(39), '>\"; // <!-- </script><a href=\"/after/script\">s</a>')",
    "'<style>/* <a href=\"/hidden/style\"> */</style><textarea><form action=\"/hidden/area\"></textarea><title><a href=\"/hidden/title\"></title>'",
    "concat('<div title=', chr(39), '<a href=\"/hidden/value\">', chr(39), ' data-x=a=b>t</div><a href=\"/d&eacute;j&#224;/&#x2F;&nbsp;&none;&AMP\">r</a>')",
    "'<SCRIPT type=\"a>b\"><a href=\"/hidden/upper\"></Script ><!--><a href=\"/after/empty\">e</a><!-- x --!><a href=\"/after/bang\">b</a>'",
    "'<!DOCTYPE x \"<a href=/hidden/type\"><?php <a href=/hidden/php ?></p <a href=/hidden/end><a href=/after/end>l</a><!-- <a href=\"/hidden/open\">'",
]


def augmented_html_sql(id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> str:
    ids = f"CAST({id_col} AS STRING)"
    auth = f"regexp_extract({url_col}, {AUTH_RX_SQL}, 1)"
    whens = " ".join(f"WHEN {i} THEN {e.format(id=ids, auth=auth)}" for i, e in enumerate(EXTRA_LINKS))
    hidden = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(HIDDEN_LINKS))
    return (f"concat({html_col}, CASE {id_col} % {len(EXTRA_LINKS)} {whens} END, "
            f"CASE {id_col} % {len(HIDDEN_LINKS) + 1} {hidden} ELSE '' END)")


def augmented_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", F.expr(augmented_html_sql()).alias("html"))


# robots rules per authority, by length(authority) % 3 (line_no, allow, prefix)
ROBOTS = {0: [(1, False, "/fr/")], 1: [(1, True, "/en/1"), (2, False, "/en/")], 2: []}


def robots_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    auths = pages.select(F.expr(f"regexp_extract(url, {AUTH_RX_SQL}, 1)").alias("authority")).distinct()
    structs = []
    for k, rows in ROBOTS.items():
        for line, allow, prefix in rows:
            structs.append(f"named_struct('k', {k}, 'line_no', {line}, 'allow', {str(allow).lower()}, "
                           f"'path_prefix', '{prefix}')")
    arr = F.expr(f"filter(array({', '.join(structs)}), r -> r.k = length(authority) % 3)")
    return auths.select("authority", F.inline(arr)).select(
        "authority", F.col("line_no").cast("int").alias("line_no"), "allow", "path_prefix")


def robots_rows_sql() -> str:
    vals = ", ".join(f"({k}, {line}, {str(allow).lower()}, '{prefix}')"
                     for k, rows in ROBOTS.items() for line, allow, prefix in rows)
    return (f"SELECT a.authority, CAST(r.line_no AS INTEGER) AS line_no, r.allow, r.path_prefix FROM "
            f"(SELECT DISTINCT regexp_extract(url, {AUTH_RX_SQL}, 1) AS authority FROM pages) a "
            f"JOIN (VALUES {vals}) r(k, line_no, allow, path_prefix) ON r.k = length(a.authority) % 3")


def many_rules_sql(links: str) -> str:
    """Long robots files, from links (page_id, ord, rank, dst): each link gives its
    host a rule, for the beginning of its path. Same text in both engines."""
    n = "(page_id * 31 + rank * 7 + ord)"
    path = "regexp_extract(dst, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1)"
    return (f"SELECT regexp_extract(dst, {AUTH_RX_SQL}, 1) AS authority, CAST(row_number() OVER (PARTITION BY "
            f"regexp_extract(dst, {AUTH_RX_SQL}, 1) ORDER BY {n} % 1009, page_id, rank, ord) AS INTEGER) AS line_no, "
            f"{n} % 3 = 0 AS allow, substr({path}, 1, CAST(2 + {n} % 14 AS INTEGER)) AS path_prefix FROM {links}")


# links between stored pages (those whose URL a crawl can reach, without a
# fragment): each gets anchors to the two next pages of its host, by page_id,
# and the last ones to the host's first (cycles)
NEIGHBOURS_SQL = (
    f"SELECT page_id, url, lead(url, 1, f) OVER w AS n1, lead(url, 2, f) OVER w AS n2 FROM ("
    f"SELECT page_id, url, a, first_value(url) OVER (PARTITION BY a ORDER BY page_id) AS f FROM ("
    f"SELECT page_id, url, regexp_extract(url, {AUTH_RX_SQL}, 1) AS a FROM pages WHERE instr(url, '#') = 0) q0) q1 WINDOW w AS (PARTITION BY a ORDER BY page_id)")


def linked_html_sql() -> str:
    return f"concat('<a href=\"', n.n1, '\">1</a><a href=\"', n.n2, '\">2</a>', {augmented_html_sql('p.page_id', 'p.html', 'p.url')})"


LINKED_PAGES_SQL = (f"SELECT p.page_id, p.url, {linked_html_sql()} AS html FROM pages p JOIN ({NEIGHBOURS_SQL}) n ON n.page_id = p.page_id "
                    f"WHERE p.html IS NOT NULL AND length(p.html) > 0")


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages whose html also links to other stored pages of the host."""
    view = "tm_pages"
    read_table(spark, sf_dir, "pages").createOrReplaceTempView(view)
    return spark.sql(LINKED_PAGES_SQL.replace("FROM pages", f"FROM {view}"))


# --- rendered bodies and client state (stand-ins for a browser render) --------
def rendered_sql(id_col: str = "page_id", html_col: str = "html") -> str:
    """Rendered html for every third page: the raw html plus a marker block."""
    return (f"CASE WHEN {id_col} % 3 = 0 THEN concat({html_col}, '<div id=\"app\" data-rendered=\"', "
            f"CAST({id_col} AS STRING), '\"></div>') END")


def client_state_sql(id_col: str = "page_id"):
    """(global vars, local storage, session storage) JSON text by residue;
    'null', '{}' and '' count as empty."""
    h = f"md5(CAST({id_col} AS STRING))"
    g = (f"CASE WHEN {id_col} % 2 = 0 THEN concat('{{\"apiKey\":\"', substr({h}, 1, 24), '\"}}') "
         f"ELSE '{{}}' END")
    loc = (f"CASE WHEN {id_col} % 3 = 0 THEN concat('{{\"token\":\"', substr({h}, 5, 20), '\"}}') "
           f"WHEN {id_col} % 3 = 1 THEN 'null' ELSE '' END")
    ses = f"CASE WHEN {id_col} % 4 = 0 THEN concat('{{\"sid\":\"', substr({h}, 9, 16), '\"}}') ELSE '{{}}' END"
    return g, loc, ses
