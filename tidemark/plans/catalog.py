"""Registered queries: each a function (spark, sf_dir) → DataFrame, with the
DuckDB SQL stating the same result for the oracle check.

Every query reads the given tables (pages, documents, events) or data Spark
derives from them; derived inputs are defined once in ``fixtures``.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules as R
from tidemark.functions.rules import select_rules
from tidemark.operators import headers as H
from tidemark.operators import reports as RP
from tidemark.operators import store as ST
from tidemark.operators.findings_store import FindingsStore
from tidemark.operators.scan import failed, scan
from tidemark.plans import fixtures as FX
from tidemark.plans import oracle as O
from tidemark.sources.tables import SPREAD_BYTES, bucket_table, page_columns, read_pages, read_table, spread, text_bytes, write_buckets

QUERIES: dict = {}
SQL: dict = {}


def register(key, sql=None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


_MEMOS: list = []


def reset_memos() -> None:
    """Forget memoized intermediates (benchmarks time each query cold)."""
    for c in _MEMOS:
        for df in c.values():
            if hasattr(df, "unpersist"):
                df.unpersist()
        c.clear()


def _memo(fn):
    """Per (session, folder) memo of a shared intermediate, persisted so the
    queries built on it do not repeat the scan; lineage stays intact, so a
    lost executor recomputes its share."""
    cache = {}
    _MEMOS.append(cache)

    def wrapped(spark, sf_dir):
        key = (id(spark), spark.sparkContext.applicationId, sf_dir)
        if key not in cache:
            cache[key] = fn(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
        return cache[key]
    return wrapped


# --- inputs ------------------------------------------------------------------

PAGES_SRC_SQL = "SELECT page_id AS src_id, url AS page_url, html AS t FROM pages"
LIVE_PAGES_SQL = "SELECT * FROM pages WHERE html IS NOT NULL AND length(html) > 0"
HDR_ROWS_SQL = FX.header_rows_sql_union()
HFIRST_SQL = (f"SELECT page_id, name, arg_min(value, seq) AS value FROM ({HDR_ROWS_SQL}) "
              f"GROUP BY page_id, name")


def htext_src_sql(profile="broad"):
    agg = "string_agg(h.name || ': ' || h.value, chr(10) ORDER BY h.name)"
    if profile == "strict":
        agg = f"({agg}) || chr(10)"
    return (f"SELECT p.page_id AS src_id, p.url AS page_url, {agg} AS t "
            f"FROM ({LIVE_PAGES_SQL}) p JOIN ({HFIRST_SQL}) h ON p.page_id = h.page_id "
            f"GROUP BY p.page_id, p.url")


def membership_sql(col="src_id"):
    return (f"CASE WHEN {col} % 5 = 0 THEN [{col} % {FX.N_SCANS}, ({col} + 1) % {FX.N_SCANS}] "
            f"ELSE [{col} % {FX.N_SCANS}] END")


def pages_h(spark, sf_dir, profile="broad"):
    return spread(FX.pages_with_headers(spark, sf_dir, profile))


ALL = select_rules("all")
ALL_STRICT = select_rules("all", "strict")


@_memo
def page_positions(spark, sf_dir):
    """Where the broad rules match in the body and the headers of every stored
    page. This is kept, not the findings, which are many times as long: each
    query cuts from it the columns that it reads."""
    return H.page_positions(pages_h(spark, sf_dir), ALL, "broad")


def page_findings(spark, sf_dir):
    """Body then header findings of every stored page, broad profile."""
    return H.page_findings_at(page_positions(spark, sf_dir), ALL, "broad")


def raw_findings(spark, sf_dir):
    """Findings of every scan, before dedup: a page belongs to one or two
    scans (fixtures), so its findings repeat in each. A text is dealt to its
    scans before its findings are cut: a filter by scan cuts those of its pages only."""
    visits = page_positions(spark, sf_dir).withColumn("scan_id", F.explode(F.expr(FX.scan_membership_sql("src_id"))))
    f = H.page_findings_at(visits, ALL, "broad", carry=["scan_id"])
    return f.select(*[c for c in f.columns if c != "scan_id"], "scan_id")


def stored_findings(spark, sf_dir):
    return ST.dedupe(raw_findings(spark, sf_dir))


BODY_SCAN_SQL = O.scan_sql(PAGES_SRC_SQL, ALL, "broad")
HDR_SCAN_SQL = O.scan_sql(htext_src_sql("broad"), ALL, "broad", part="headers",
                          url_suffix=" (headers)")
PAGE_FINDINGS_SQL = f"({BODY_SCAN_SQL}) UNION ALL ({HDR_SCAN_SQL})"
RAW_SQL = f"SELECT *, unnest({membership_sql()}) AS scan_id FROM ({PAGE_FINDINGS_SQL})"
STORED_SQL = (
    "SELECT * EXCLUDE (rn) FROM (SELECT * REPLACE (substring(match, 1, 500) AS match, "
    "substring(context, 1, 1000) AS context), row_number() OVER (PARTITION BY finding_hash "
    "ORDER BY scan_id, src_id, part, rule_idx, match_idx) AS rn FROM raw) WHERE rn = 1")


def with_store(body: str) -> str:
    return f"WITH raw AS ({RAW_SQL}), stored AS ({STORED_SQL}) {body}"


def with_raw(body: str) -> str:
    return f"WITH raw AS ({RAW_SQL}) {body}"


# --- 2.2 scan ----------------------------------------------------------------

@register("scan_body", O.scan_sql(PAGES_SRC_SQL, ALL, "broad"))
def q_scan_body(spark, sf_dir):
    """All 149 broad rules over every stored page body."""
    return scan(spread(read_pages(spark, sf_dir)), ALL, "broad")


@register("scan_headers", HDR_SCAN_SQL)
def q_scan_headers(spark, sf_dir):
    """All broad rules over each page's header text; url gets ' (headers)'."""
    return H.scan_headers(pages_h(spark, sf_dir), ALL, "broad")


DOCS_SRC_SQL = FX.planted_documents_sql()


def docs(spark, sf_dir):
    return spread(FX.planted_documents(spark, sf_dir))


@register("scan_documents", O.scan_sql(DOCS_SRC_SQL, ALL, "broad"))
def q_scan_documents(spark, sf_dir):
    """All broad rules over every document (with planted tokens)."""
    return scan(docs(spark, sf_dir), ALL, "broad", text_col="text", id_col="doc_id")


STRICT_BODY_SQL = O.scan_sql(PAGES_SRC_SQL, ALL_STRICT, "strict")
STRICT_HDR_SQL = O.scan_sql(htext_src_sql("strict"), ALL_STRICT, "strict", part="headers",
                            url_suffix=" (headers)")


@register("scan_strict", f"({STRICT_BODY_SQL}) UNION ALL ({STRICT_HDR_SQL})")
def q_scan_strict(spark, sf_dir):
    """Strict profile (rules as written, per-rule severity; all kits
    including ``credentials``) over bodies and header text."""
    return H.scan_page(pages_h(spark, sf_dir, "strict"), ALL_STRICT, "strict")


@register("scan_strict_documents", O.scan_sql(DOCS_SRC_SQL, ALL_STRICT, "strict"))
def q_scan_strict_documents(spark, sf_dir):
    """Strict profile over every document, whose texts are mostly not ASCII:
    offsets, match and context count bytes."""
    return scan(docs(spark, sf_dir), ALL_STRICT, "strict", text_col="text", id_col="doc_id")


def _kit_query(kit):
    rules = select_rules([kit])

    def q(spark, sf_dir):
        return scan(docs(spark, sf_dir), rules, "broad", text_col="text", id_col="doc_id")
    q.__doc__ = f"Only the {kit} kit over documents."
    return q, O.scan_sql(DOCS_SRC_SQL, rules, "broad")


for _k in R.KIT_KEYS:
    _q, _s = _kit_query(_k)
    register(f"scan_by_kit_{_k}", _s)(_q)


@register("match_offsets", f"SELECT src_id, pattern, match_idx, start, \"end\", \"end\" - start AS match_len "
                           f"FROM ({O.scan_sql(DOCS_SRC_SQL, ALL, 'broad')})")
def q_match_offsets(spark, sf_dir):
    """Start/end character offsets of every match."""
    f = scan(docs(spark, sf_dir), ALL, "broad", text_col="text", id_col="doc_id")
    return f.select("src_id", "pattern", "match_idx", "start", "end",
                    (F.col("end") - F.col("start")).alias("match_len"))


@register("match_truncate", with_raw(
    "SELECT finding_hash, scan_id, substring(url, 1, 100) AS url_100, substring(match, 1, 100) AS match_100, "
    "substring(context, 1, 200) AS context_200, substring(match, 1, 500) AS match_500, "
    "substring(context, 1, 1000) AS context_1000, CAST(length(match) AS INTEGER) AS match_len FROM raw"))
def q_match_truncate(spark, sf_dir):
    """The cuts: match ≤200 (scan), ≤500 stored, context ≤1000 stored,
    table view 100/200, report url ≤100."""
    f = raw_findings(spark, sf_dir)
    return f.select("finding_hash", "scan_id", F.substring("url", 1, 100).alias("url_100"),
                    F.substring("match", 1, 100).alias("match_100"),
                    F.substring("context", 1, 200).alias("context_200"),
                    F.substring("match", 1, 500).alias("match_500"),
                    F.substring("context", 1, 1000).alias("context_1000"),
                    F.length("match").alias("match_len"))


@register("match_context", f"SELECT src_id, part, pattern, match_idx, context FROM ({PAGE_FINDINGS_SQL})")
def q_match_context(spark, sf_dir):
    """Context: 100 characters either side, whitespace collapsed, trimmed."""
    return page_findings(spark, sf_dir).select("src_id", "part", "pattern", "match_idx", "context")


def _severity_case_sql(col):
    hi = " OR ".join(f"contains(lower({col}), {O.q(w)})" for w in R.D.HIGH_WORDS)
    med = " OR ".join(f"contains(lower({col}), {O.q(w)})" for w in R.D.MEDIUM_WORDS)
    return f"CASE WHEN {hi} THEN 'high' WHEN {med} THEN 'medium' ELSE 'low' END"


@register("rule_severity",
          f"SELECT pattern, {_severity_case_sql('pattern')} AS severity, count(*) AS n "
          f"FROM ({PAGE_FINDINGS_SQL}) GROUP BY pattern")
def q_rule_severity(spark, sf_dir):
    """Broad severity by keyword in the rule name, per rule that fired."""
    f = page_findings(spark, sf_dir)
    return f.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).select(
        "pattern", R.severity_expr(F.col("pattern")).alias("severity"), "n")


def _rules_values_sql():
    rows = ",\n".join(
        f"({O.q(k)}, {O.q(n)}, {O.q(R.KIT_TITLES[k])}, {O.q(R.broad_severity(n))}, {O.q(s)})"
        for k, n, rx, s, g in R.D.RULES)
    return f"(VALUES {rows}) AS rt(kit, name, category, sev_broad, sev_strict)"


@register("severity_divergence",
          f"SELECT rt.name, rt.sev_broad, rt.sev_strict, coalesce(c.n, 0) AS n_findings "
          f"FROM {_rules_values_sql()} LEFT JOIN (SELECT pattern, count(*) AS n FROM ({PAGE_FINDINGS_SQL}) "
          f"GROUP BY pattern) c ON c.pattern = rt.name "
          f"WHERE rt.sev_strict IS NOT NULL AND rt.sev_broad <> rt.sev_strict")
def q_severity_divergence(spark, sf_dir):
    """Rules whose severity differs between profiles, with their finding
    count on the stored pages."""
    rt = R.rules_df(spark)
    diff = rt.filter(F.col("sev_strict").isNotNull() & (F.col("sev_broad") != F.col("sev_strict")))
    counts = page_findings(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # the rule table is bounded by the catalogue size: a broadcast side
    return (counts.join(F.broadcast(diff), counts.pattern == diff.name, "right")
            .select("name", "sev_broad", "sev_strict", F.coalesce("n", F.lit(0)).alias("n_findings")))


CUSTOM = [R.custom_rule("Email Address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
          R.custom_rule("Internal Host", r"[a-z]+\.example\.(?:com|net|org)")]
WITH_CUSTOM = R.add_rules(select_rules(["sensitive"]), CUSTOM)


@register("custom_rules", O.scan_sql(PAGES_SRC_SQL, WITH_CUSTOM, "broad"))
def q_custom_rules(spark, sf_dir):
    """User rules kept in a table, written and read back, appended to a kit:
    a new name gets category Custom; a known name keeps its kit's category
    and replaces the built-in rule."""
    from tidemark.sources.sinks import scratch_path
    path = scratch_path(spark, "custom-rules")
    spark.createDataFrame([(r.name, r.regex) for r in CUSTOM], "name string, regex string").write.parquet(path)
    rules = R.add_rules(select_rules(["sensitive"]), R.load_rules(spark.read.parquet(path)))
    return scan(spread(read_pages(spark, sf_dir)), rules, "broad")


@register("rule_category",
          f"SELECT pattern, category, count(*) AS n FROM ({O.scan_sql(PAGES_SRC_SQL, WITH_CUSTOM, 'broad')}) "
          f"GROUP BY pattern, category")
def q_rule_category(spark, sf_dir):
    """Category of each rule that fired: first kit holding the name, else Custom."""
    f = scan(spread(read_pages(spark, sf_dir)), WITH_CUSTOM, "broad")
    return f.groupBy("pattern", "category").agg(F.count(F.lit(1)).alias("n"))


SELECTED = select_rules(["api-keys", "financial", "cloud", "financial"], "strict")


@register("rule_selection", O.scan_sql(PAGES_SRC_SQL, SELECTED, "strict"))
def q_rule_selection(spark, sf_dir):
    """Strict kits chosen by name (a repeated kit adds nothing) over pages."""
    return scan(spread(read_pages(spark, sf_dir, "strict")), SELECTED, "strict")


REMOVED = ["SWIFT Code", "Missing CSP Header", "Bank Account Number"]
KEPT = [r for r in ALL if r.name not in REMOVED]


@register("rule_remove", O.scan_sql(PAGES_SRC_SQL, KEPT, "broad"))
def q_rule_remove(spark, sf_dir):
    """The catalogue less three rules, over pages."""
    rt = R.remove_rules(R.rules_df(spark), REMOVED)
    names = {r["name"] for r in rt.select("name").collect()}   # bounded: the catalogue
    return scan(spread(read_pages(spark, sf_dir)), [r for r in ALL if r.name in names], "broad")


@register("rule_count",
          f"SELECT coalesce(rt.kit, 'total') AS kit, count(*) AS n_rules, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS n_findings "
          f"FROM {_rules_values_sql()} LEFT JOIN (SELECT pattern, count(*) AS n FROM ({PAGE_FINDINGS_SQL}) "
          f"GROUP BY pattern) c ON c.pattern = rt.name GROUP BY ROLLUP (rt.kit)")
def q_rule_count(spark, sf_dir):
    """Loaded rules per kit and in total, with the findings they produced on pages."""
    rt = R.rules_df(spark)
    counts = page_findings(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return R.count_rules(F.broadcast(rt).join(counts, rt.name == counts.pattern, "left"))


@register("rules_table",
          f"SELECT rt.kit, rt.name, rt.category, rt.sev_broad, rt.sev_strict, coalesce(c.n, 0) AS n_findings "
          f"FROM {_rules_values_sql()} LEFT JOIN (SELECT pattern, count(*) AS n FROM ({PAGE_FINDINGS_SQL}) "
          f"GROUP BY pattern) c ON c.pattern = rt.name")
def q_rules_table(spark, sf_dir):
    """The catalogue as a table, each rule with its findings on pages."""
    rt = R.rules_df(spark).drop("regex")
    counts = page_findings(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return (F.broadcast(rt).join(counts, rt.name == counts.pattern, "left")
            .select("kit", "name", "category", "sev_broad", "sev_strict",
                    F.coalesce("n", F.lit(0)).alias("n_findings")))


@register("javascript_flag",
          f"SELECT page_id, (contains(url, '.js') OR contains(substring(html, 1, 100), 'javascript')) "
          f"AS is_javascript FROM ({LIVE_PAGES_SQL})")
def q_javascript_flag(spark, sf_dir):
    """URL holds .js/.json, or 'javascript' in the first 100 characters."""
    from tidemark.operators.scan import is_javascript
    p = read_pages(spark, sf_dir)
    return p.select("page_id", is_javascript(F.col("url"), F.col("body")).alias("is_javascript"))


@register("needs_rendering",
          "SELECT page_id, (" + " OR ".join(f"contains(html, {O.q(m)})" for m in R.D.RENDER_MARKERS)
          + f") AS needs_js FROM ({LIVE_PAGES_SQL})")
def q_needs_rendering(spark, sf_dir):
    """Body holds any of the 15 framework markers (case-sensitive)."""
    from tidemark.operators.pages import needs_rendering
    p = read_pages(spark, sf_dir)
    return p.select("page_id", needs_rendering(F.col("body")).alias("needs_js"))


@register("missing_header_lines",
          O.scan_sql(htext_src_sql("broad"), [r for r in ALL if r.line_word], "broad",
                     part="headers", url_suffix=" (headers)"))
def q_missing_header_lines(spark, sf_dir):
    """The four missing-header rules as the broad tool runs them: one
    finding per header line lacking the word."""
    return H.scan_headers(pages_h(spark, sf_dir), [r for r in ALL if r.line_word], "broad")


_MISSING_VALUES = ", ".join(f"({O.q(n)}, {O.q(w)})" for n, w in R.D.MISSING_HEADER_RULES)


@register("missing_headers",
          f"SELECT p.page_id, p.url, m.pattern, m.header FROM ({LIVE_PAGES_SQL}) p, "
          f"(VALUES {_MISSING_VALUES}) m(pattern, header) WHERE NOT EXISTS (SELECT 1 FROM ({HFIRST_SQL}) h "
          f"WHERE h.page_id = p.page_id AND lower(h.name) = m.header)")
def q_missing_headers(spark, sf_dir):
    """Per page, each security header it lacks (the per-page form)."""
    return H.missing_headers(pages_h(spark, sf_dir))


# --- 2.1 sources -------------------------------------------------------------

@register("pages_source",
          f"SELECT page_id, url, html AS body, {FX.status_expr_sql()} AS status_code, "
          f"0 AS depth, false AS from_js FROM ({LIVE_PAGES_SQL})")
def q_pages_source(spark, sf_dir):
    """Stored pages → Page schema (empty bodies dropped)."""
    return pages_h(spark, sf_dir).drop("headers")


@register("headers_first_value", HFIRST_SQL)
def q_headers_first_value(spark, sf_dir):
    """Multi-valued header rows → first value per name."""
    from tidemark.sources.tables import first_headers
    rows = FX.header_rows(read_table(spark, sf_dir, "pages"))
    m = first_headers(rows)
    return m.select("page_id", F.explode("headers").alias("name", "value"))


@register("header_text",
          f"SELECT b.src_id AS page_id, b.t AS text_broad, s.t AS text_strict FROM ({htext_src_sql('broad')}) b "
          f"JOIN ({htext_src_sql('strict')}) s ON b.src_id = s.src_id")
def q_header_text(spark, sf_dir):
    """Header map → sorted ``name: value`` lines, both profiles."""
    from tidemark.sources.tables import header_text
    p = FX.pages_with_headers(spark, sf_dir)
    return p.select("page_id", header_text(F.col("headers"), "broad").alias("text_broad"),
                    header_text(F.col("headers"), "strict").alias("text_strict"))


# --- 2.4 store ---------------------------------------------------------------

@register("finding_hash", with_raw("SELECT url, pattern, match, md5(url || pattern || match) AS finding_hash FROM raw"))
def q_finding_hash(spark, sf_dir):
    """MD5 of url + rule + match, no separators."""
    f = raw_findings(spark, sf_dir)
    return f.select("url", "pattern", "match",
                    ST.finding_hash(F.col("url"), F.col("pattern"), F.col("match")).alias("finding_hash"))


STORE_COLS = ["finding_hash", "scan_id", "src_id", "url", "page_url", "part", "pattern", "category",
              "severity", "match_idx", "match", "context"]


@register("findings_dedupe", with_store(f"SELECT {', '.join(STORE_COLS)} FROM stored"))
def q_findings_dedupe(spark, sf_dir):
    """First finding per hash wins over all scans."""
    return stored_findings(spark, sf_dir).select(*STORE_COLS)


@register("findings_source", with_store(f"SELECT {', '.join(STORE_COLS)} FROM stored"))
def q_findings_source(spark, sf_dir):
    """The stored findings table written as parquet and read back."""
    from tidemark.sources.sinks import roundtrip_tables
    return roundtrip_tables(spark, sf_dir, stored_findings(spark, sf_dir).select(*STORE_COLS), "findings")


@register("findings_append", with_store(
    "SELECT " + ", ".join(STORE_COLS) + " FROM stored WHERE scan_id = 3 AND finding_hash NOT IN "
    "(SELECT finding_hash FROM raw WHERE scan_id < 3)"))
def q_findings_append(spark, sf_dir):
    """Append scan 3 to a store holding scans 0-2: only unseen hashes."""
    raw = raw_findings(spark, sf_dir)
    store = ST.dedupe(raw.filter(F.col("scan_id") < 3))
    return ST.append(store, raw.filter(F.col("scan_id") == 3)).select(*STORE_COLS)


def page_bytes(spark, sf_dir):
    return text_bytes(FX.pages_with_headers(spark, sf_dir).select("body"))


def store_buckets(size):
    """Buckets of a store for the findings of ``size`` bytes of pages, of which an
    append brings about a third: a bucket holds those of 32 MB."""
    return max(16, -(-size // (8 * SPREAD_BYTES)))


def _written_store(spark, sf_dir):
    """The store after scan 0, then scans 1 and 2 begun from one version and
    committed in the other order, then scan 3."""
    from tidemark.sources.sinks import scratch_path
    raw = raw_findings(spark, sf_dir)
    scan_no = lambda k: raw.filter(F.col("scan_id") == k)
    store = FindingsStore(spark, scratch_path(spark, "store"), store_buckets(page_bytes(spark, sf_dir)))
    store.append(scan_no(0))
    first, second = store.begin(scan_no(1)), store.begin(scan_no(2))
    second.commit()
    first.commit()
    store.append(scan_no(3))
    return store


_COMMITTED_SQL = STORED_SQL.replace("ORDER BY scan_id,", "ORDER BY CASE scan_id WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE scan_id END,")


@register("findings_append_concurrent", f"WITH raw AS ({RAW_SQL}), stored AS ({_COMMITTED_SQL}) SELECT {', '.join(STORE_COLS)} FROM stored")
def q_findings_append_concurrent(spark, sf_dir):
    """Two appends from one version of the store leave each hash once: of a
    hash that both have, who committed first has it."""
    return _written_store(spark, sf_dir).read().select(*STORE_COLS)


@register("store_statistics", f"WITH raw AS ({RAW_SQL}), stored AS ({_COMMITTED_SQL}) SELECT pattern, category, severity, count(*) AS count "
                              f"FROM stored WHERE finding_hash NOT LIKE '0%' GROUP BY pattern, category, severity")
def q_store_statistics(spark, sf_dir):
    """Counts kept up by every append and by a withdrawal (hashes that begin
    with 0), read from the deltas alone."""
    store = _written_store(spark, sf_dir)
    store.withdraw(store.read().filter("finding_hash LIKE '0%'").select("finding_hash"))
    return store.statistics(["pattern", "category", "severity"])


def pages_per_scan(spark, sf_dir):
    p = FX.pages_with_headers(spark, sf_dir)
    m = p.select(F.explode(F.expr(FX.scan_membership_sql("page_id"))).alias("scan_id"))
    return m.groupBy("scan_id").agg(F.count(F.lit(1)).alias("pages_scanned"))


PPS_SQL = (f"SELECT scan_id, count(*) AS pages_scanned FROM (SELECT unnest({membership_sql('page_id')}) "
           f"AS scan_id FROM ({LIVE_PAGES_SQL})) GROUP BY scan_id")


def scan_starts(spark, sf_dir):
    """The 'running' row of each scan: times and pages only, no rule runs.
    Pages per scan and the base URL come from one read of the pages."""
    visits = (FX.pages_with_headers(spark, sf_dir)
              .select(F.explode(F.expr(FX.scan_membership_sql("page_id"))).alias("scan_id"), "page_id", "url"))
    per_scan = visits.groupBy("scan_id").agg(F.min_by("url", "page_id").alias("base_url"),
                                             F.count(F.lit(1)).alias("n_pages"))
    return FX.scans_times(spark, sf_dir).join(per_scan, "scan_id")


def scan_log(spark, sf_dir):
    """Append-only scan log: a 'running' row at start, a 'complete' row
    with totals at the end (two events per scan)."""
    raw = raw_findings(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))
    base = scan_starts(spark, sf_dir).join(raw, "scan_id", "left")
    # both events of a scan come from one row of ``base`` (one read, no union of re-reads)
    events = F.array(
        F.struct(F.lit(1).alias("event_no"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
                 F.lit(0).alias("pages_scanned"), F.lit(0).cast("long").alias("findings_count"),
                 F.lit("running").alias("status")),
        F.struct(F.lit(2).alias("event_no"), F.col("end_time"),
                 F.col("n_pages").cast("int").alias("pages_scanned"),
                 F.coalesce("n", F.lit(0)).cast("long").alias("findings_count"),
                 F.lit("complete").alias("status")))
    return base.select("scan_id", "base_url", "start_time", F.explode(events).alias("e")).select(
        "scan_id", "e.event_no", "base_url", "start_time", "e.end_time", "e.pages_scanned",
        "e.findings_count", "e.status")


BASEURL_SQL = (f"SELECT scan_id, arg_min(url, page_id) AS base_url FROM (SELECT unnest({membership_sql('page_id')}) "
               f"AS scan_id, page_id, url FROM ({LIVE_PAGES_SQL})) GROUP BY scan_id")
SCANS_SQL = with_raw(
    f", t AS ({FX.SCANS_TIMES_SQL}), b AS ({BASEURL_SQL}), pps AS ({PPS_SQL}), "
    f"n AS (SELECT scan_id, count(*) AS n FROM raw GROUP BY scan_id) "
    f"SELECT t.scan_id, b.base_url, t.start_time, t.end_time, CAST(coalesce(pps.pages_scanned, 0) AS INTEGER) AS pages_scanned, "
    f"CAST(coalesce(n.n, 0) AS BIGINT) AS findings_count, 'complete' AS status FROM t JOIN b ON t.scan_id = b.scan_id "
    f"LEFT JOIN pps ON pps.scan_id = t.scan_id LEFT JOIN n ON n.scan_id = t.scan_id")


def scans_table(spark, sf_dir):
    return ST.scan_log_current(scan_log(spark, sf_dir))


@register("scan_start", f"WITH t AS ({FX.SCANS_TIMES_SQL}), b AS ({BASEURL_SQL}) SELECT t.scan_id, b.base_url, "
                        f"t.start_time, 'running' AS status FROM t JOIN b ON t.scan_id = b.scan_id")
def q_scan_start(spark, sf_dir):
    """The 'running' row each scan writes when it starts."""
    return scan_starts(spark, sf_dir).select("scan_id", "base_url", "start_time", F.lit("running").alias("status"))


@register("scan_end", SCANS_SQL)
def q_scan_end(spark, sf_dir):
    """Current row per scan from the append-only log: the completed one."""
    return scans_table(spark, sf_dir).select("scan_id", "base_url", "start_time", "end_time",
                                             "pages_scanned", "findings_count", "status")


@register("scans_source", SCANS_SQL)
def q_scans_source(spark, sf_dir):
    """The scans table written as parquet and read back."""
    from tidemark.sources.sinks import roundtrip_tables
    return roundtrip_tables(spark, sf_dir, q_scan_end(spark, sf_dir), "scans")


@register("scan_summary", with_store(
    f", pps AS ({PPS_SQL}), r AS (SELECT scan_id, count(*) AS n FROM raw GROUP BY scan_id), "
    f"s AS (SELECT scan_id, count(*) AS n FROM stored GROUP BY scan_id) "
    f"SELECT pps.scan_id, pps.pages_scanned, coalesce(r.n, 0) AS findings_raw, coalesce(s.n, 0) AS findings_stored "
    f"FROM pps LEFT JOIN r ON r.scan_id = pps.scan_id LEFT JOIN s ON s.scan_id = pps.scan_id"))
def q_scan_summary(spark, sf_dir):
    """Pages visited, findings before dedup, findings stored, per scan."""
    return ST.summary(pages_per_scan(spark, sf_dir), raw_findings(spark, sf_dir),
                      stored_findings(spark, sf_dir))


@register("page_log",
          f"SELECT scan_id, page_id, url, {FX.status_expr_sql()} AS status_code, md5(html) AS content_hash, "
          "(" + " OR ".join(f"contains(html, {O.q(m)})" for m in R.D.RENDER_MARKERS) + ") AS has_javascript "
          f"FROM (SELECT *, unnest({membership_sql('page_id')}) AS scan_id FROM ({LIVE_PAGES_SQL}))")
def q_page_log(spark, sf_dir):
    """One row per fetched page and scan: status, content hash, script flag."""
    from tidemark.operators.pages import needs_rendering
    p = FX.pages_with_headers(spark, sf_dir)
    return p.select(F.explode(F.expr(FX.scan_membership_sql("page_id"))).alias("scan_id"), "page_id", "url",
                    "status_code", F.md5("body").alias("content_hash"),
                    needs_rendering(F.col("body")).alias("has_javascript"))




@register("findings_with_scan",
          f"WITH raw AS ({RAW_SQL}), stored AS ({STORED_SQL}), t AS ({FX.SCANS_TIMES_SQL}), b AS ({BASEURL_SQL}) "
          "SELECT s.finding_hash, s.scan_id, b.base_url, t.start_time, s.pattern, s.severity "
          "FROM stored s JOIN t ON s.scan_id = t.scan_id JOIN b ON b.scan_id = s.scan_id")
def q_findings_with_scan(spark, sf_dir):
    """Stored findings joined to their scan (the declared foreign key)."""
    sc = scan_starts(spark, sf_dir).select("scan_id", "base_url", "start_time")
    return (stored_findings(spark, sf_dir).join(F.broadcast(sc), "scan_id")   # a row a scan
            .select("finding_hash", "scan_id", "base_url", "start_time", "pattern", "severity"))


# --- 2.5 aggregations ----------------------------------------------------------

@register("total_scans", f"WITH t AS ({FX.SCANS_TIMES_SQL}) SELECT count(*) AS total_scans FROM t")
def q_total_scans(spark, sf_dir):
    return RP.total(scan_starts(spark, sf_dir), "total_scans")


@register("total_findings", with_store("SELECT count(*) AS total_findings FROM stored"))
def q_total_findings(spark, sf_dir):
    return RP.total(stored_findings(spark, sf_dir), "total_findings")


@register("top_patterns_10", with_store(
    "SELECT pattern, count(*) AS count FROM stored GROUP BY pattern ORDER BY count DESC, pattern LIMIT 10"))
def q_top_patterns_10(spark, sf_dir):
    """Stored findings per rule, top 10 (ties by name)."""
    return RP.top_patterns(stored_findings(spark, sf_dir), 10)


@register("top_patterns_20", with_raw(
    "SELECT pattern, count(*) AS count FROM raw WHERE scan_id = 0 GROUP BY pattern ORDER BY count DESC, pattern LIMIT 20"))
def q_top_patterns_20(spark, sf_dir):
    """Current scan (0), before dedup, top 20."""
    return RP.top_patterns(raw_findings(spark, sf_dir).filter("scan_id = 0"), 20)


@register("severity_distribution", with_store("SELECT severity, count(*) AS count FROM stored GROUP BY severity"))
def q_severity_distribution(spark, sf_dir):
    return RP.severity_counts(stored_findings(spark, sf_dir))


@register("severity_ordered", with_raw(
    "SELECT severity, count(*) AS count, CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS INTEGER) AS rank "
    "FROM raw WHERE scan_id = 0 AND severity IN ('high', 'medium', 'low') GROUP BY severity"))
def q_severity_ordered(spark, sf_dir):
    """Current scan's counts in order high, medium, low; absent ones omitted."""
    return RP.severity_counts(raw_findings(spark, sf_dir).filter("scan_id = 0"), ordered=True)


@register("category_counts", with_raw(
    "SELECT category, count(*) AS count FROM raw WHERE scan_id = 0 GROUP BY category ORDER BY count DESC, category"))
def q_category_counts(spark, sf_dir):
    return RP.category_counts(raw_findings(spark, sf_dir).filter("scan_id = 0"))


@register("report_summary", with_raw(
    "SELECT count(*) AS total, CAST(count_if(severity = 'high') AS BIGINT) AS high, "
    "CAST(count_if(severity = 'medium') AS BIGINT) AS medium, "
    "CAST(count_if(severity = 'low') AS BIGINT) AS low FROM raw WHERE scan_id = 0"))
def q_report_summary(spark, sf_dir):
    return RP.report_summary(raw_findings(spark, sf_dir).filter("scan_id = 0"))


@register("report_rows", with_raw(
    "SELECT CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 1 END AS INTEGER) AS rank, "
    "src_id, part, rule_idx, match_idx, url, pattern, upper(severity) AS severity, match, context "
    "FROM raw WHERE scan_id = 0"))
def q_report_rows(spark, sf_dir):
    """Current scan's findings in rank order high, medium, low (unknown =
    medium), stable in scan order."""
    return RP.report_rows(raw_findings(spark, sf_dir).filter("scan_id = 0"))


@register("findings_by_scan", with_store(
    "SELECT src_id, part, rule_idx, match_idx, url, pattern, category, match, context, severity "
    "FROM stored WHERE scan_id = 1"))
def q_findings_by_scan(spark, sf_dir):
    """One scan's stored findings: severity as text descending, then time
    (scan order)."""
    return RP.findings_by_scan(stored_findings(spark, sf_dir), 1)


@register("scan_history", SCANS_SQL.replace("SELECT t.scan_id", "SELECT * FROM (SELECT t.scan_id", 1)
          + ") ORDER BY start_time DESC LIMIT 50")
def q_scan_history(spark, sf_dir):
    """The 50 latest scans by start time."""
    return RP.scan_history(q_scan_end(spark, sf_dir), 50)


@register("findings_per_page", with_raw("SELECT page_url, count(*) AS n FROM raw GROUP BY page_url"))
def q_findings_per_page(spark, sf_dir):
    return RP.per_page(raw_findings(spark, sf_dir))


@register("status_counts", f"SELECT {FX.status_expr_sql()} AS status_code, count(*) AS pages FROM ({LIVE_PAGES_SQL}) GROUP BY 1")
def q_status_counts(spark, sf_dir):
    return RP.status_counts(FX.pages_with_headers(spark, sf_dir))


@register("progress_percent",
          f"SELECT page_id, CAST(least(100, floor(100.0 * row_number() OVER (ORDER BY page_id) / 100)) AS INTEGER) AS percent "
          f"FROM ({LIVE_PAGES_SQL}) WHERE list_contains({membership_sql('page_id')}, 0) QUALIFY row_number() OVER (ORDER BY page_id) <= 100 "
          f"UNION ALL SELECT NULL, 100")
def q_progress_percent(spark, sf_dir):
    """int(100 × visited / max_pages) after each page of scan 0 (cap 100),
    then 100 once the scan has ended (no page)."""
    p = FX.pages_with_headers(spark, sf_dir).filter(F.array_contains(F.expr(FX.scan_membership_sql("page_id")), F.lit(0)))
    return RP.progress(p, "page_id", 100)


@register("history_union", with_store(
    f"SELECT {', '.join(STORE_COLS)} FROM stored WHERE scan_id IN (0, 2)"))
def q_history_union(spark, sf_dir):
    """Stored findings of two scans put together (union by name)."""
    s = stored_findings(spark, sf_dir).select(*STORE_COLS)
    return RP.union_findings(s.filter("scan_id = 0"), s.filter("scan_id = 2"))


# --- 2.3 links and crawl -------------------------------------------------------

from tidemark.operators import crawl as CR  # noqa: E402
from tidemark.operators import links as L  # noqa: E402

AUG_SQL = f"SELECT page_id, url, {FX.augmented_html_sql()} AS html FROM pages"


def aug(spark, sf_dir):
    return spread(FX.augmented_pages(spark, sf_dir))


TAGS_SQL = O.tag_links_duck(AUG_SQL)
LINKS_SQL = O.all_links_duck(AUG_SQL)
LINK_COLS = "page_id, url, kind, rank, ord, href"


@register("links_anchor", f"SELECT {LINK_COLS} FROM ({TAGS_SQL}) WHERE kind IN ('a', 'link')")
def q_links_anchor(spark, sf_dir):
    """href of a and link tags, in document order."""
    return L.tag_links(aug(spark, sf_dir), ("a", "link"))


@register("links_form", f"SELECT {LINK_COLS} FROM ({TAGS_SQL}) WHERE kind = 'form'")
def q_links_form(spark, sf_dir):
    """action of form tags; empty ones give no link."""
    return L.tag_links(aug(spark, sf_dir), ("form",))


@register("links_script", f"SELECT {LINK_COLS} FROM ({O.script_links_duck(AUG_SQL)})")
def q_links_script(spark, sf_dir):
    """Six URL shapes in script text; data:, javascript:, # skipped."""
    return L.script_links(aug(spark, sf_dir))


def resolved(spark, sf_dir):
    return L.resolved_links(L.all_links(aug(spark, sf_dir)))


@register("link_resolve", LINKS_SQL)
def q_link_resolve(spark, sf_dir):
    """Every extracted link resolved against its page URL."""
    return resolved(spark, sf_dir)


@register("link_same_host", f"SELECT * FROM ({LINKS_SQL}) WHERE {O.AUTH.format('resolved')} = {O.AUTH.format('url')}")
def q_link_same_host(spark, sf_dir):
    """Resolved links on the page's own authority."""
    return L.same_host(resolved(spark, sf_dir))


@register("link_scheme", f"SELECT * FROM ({LINKS_SQL}) WHERE {O.SCHEME.format('resolved')} IN ('http', 'https')")
def q_link_scheme(spark, sf_dir):
    """Resolved links with an http or https scheme."""
    return L.http_only(resolved(spark, sf_dir))


@register("link_fragment", O.targets_duck(AUG_SQL))
def q_link_fragment(spark, sf_dir):
    """The broad set: same host; a and link lose their fragment, forms and
    script links keep it."""
    return L.targets(resolved(spark, sf_dir)).select("page_id", "url", "kind", "rank", "ord", "dst")


@register("links_strict", O.deduped_duck(AUG_SQL, strict=True))
def q_links_strict(spark, sf_dir):
    """The strict set: a and form tags in document order, http(s), same
    host, no fragments, each target once."""
    return L.dedupe_links(L.targets(resolved(spark, sf_dir), strict=True))


@register("link_dedupe", O.deduped_duck(AUG_SQL))
def q_link_dedupe(spark, sf_dir):
    """One row per (page, target) of the broad set, first position kept."""
    return L.dedupe_links(L.targets(resolved(spark, sf_dir)))


ROBOTS_SQL = FX.robots_rows_sql()


@register("robots_filter", f"WITH d AS ({O.deduped_duck(AUG_SQL)}), rb AS ({ROBOTS_SQL}) "
                           f"SELECT d.* FROM d WHERE {O.allowed_duck('d.dst', 'rb')}")
def q_robots_filter(spark, sf_dir):
    """Deduped same-host links less those robots rules disallow for '*'."""
    return L.robots_filter(q_link_dedupe(spark, sf_dir), FX.robots_rows(spark, sf_dir))


_memo_links = _memo(q_link_dedupe)


@register("robots_filter_many", f"WITH d AS ({O.deduped_duck(AUG_SQL)}), rb AS ({FX.many_rules_sql('d')}) "
                                f"SELECT d.* FROM d WHERE {O.allowed_duck('d.dst', 'rb')}")
def q_robots_filter_many(spark, sf_dir):
    """Deduped links under robots files of as many rules as their host has links."""
    links = _memo_links(spark, sf_dir)
    view = "tm_rule_links"
    links.createOrReplaceTempView(view)
    return L.robots_filter(links, spark.sql(FX.many_rules_sql(view)))


# the crawl: from the first allowed page of the host with most pages, over the
# links of the stored pages, with a cap that the host's pages exceed
CRAWL_DEPTH, CRAWL_PAGES = 3, 40
CRAWL_SQL = (
    f"WITH RECURSIVE pg AS ({FX.LINKED_PAGES_SQL}), rb AS ({ROBOTS_SQL}), "
    f"seed AS (SELECT url FROM pg p WHERE {O.allowed_duck('p.url', 'rb')} ORDER BY count(*) OVER (PARTITION BY {O.AUTH.format('p.url')}) DESC, "
    f"{O.AUTH.format('p.url')}, p.page_id LIMIT 1), "
    f"e AS (SELECT d.url AS src, d.dst, d.rank, d.ord FROM ({O.deduped_duck('SELECT * FROM pg')}) d WHERE {O.allowed_duck('d.dst', 'rb')}), "
    f"paths(url, depth, path) AS (SELECT url, 0, [0, 0] FROM seed UNION ALL "
    f"SELECT e.dst, p.depth + 1, list_concat(p.path, [e.rank, e.ord]) FROM paths p JOIN e ON e.src = p.url WHERE p.depth < {CRAWL_DEPTH}), "
    f"b AS (SELECT url, min(depth) AS depth FROM paths GROUP BY url), "
    f"bp AS (SELECT p.url, p.depth, min(p.path) AS path FROM paths p JOIN b ON p.url = b.url AND p.depth = b.depth "
    f"GROUP BY p.url, p.depth), "
    f"o AS (SELECT url, depth, row_number() OVER (ORDER BY depth, path) AS visit_ord FROM bp) "
    f"SELECT url, CAST(depth AS INTEGER) AS depth, CAST(visit_ord AS BIGINT) AS visit_ord, "
    f"url IN (SELECT url FROM pg) AS fetched FROM o WHERE visit_ord <= {CRAWL_PAGES}")


def crawl(spark, sf_dir):
    pages = FX.linked_pages(spark, sf_dir)
    rules = FX.robots_rows(spark, sf_dir)
    hosts = pages.select("page_id", "url", L.authority("url").alias("host"))
    allowed = L.robots_filter(hosts, rules, url_col="url")
    first = (hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).join(allowed.groupBy("host").agg(
        F.min_by("url", "page_id").alias("url")), "host").orderBy(F.desc("n"), "host").first())
    # a crawl keeps to its root's host: no other page can be fetched, so no other page's links are read
    own = spread(pages.filter(L.authority("url") == F.lit(first.host)))
    links = L.dedupe_links(L.targets(L.resolved_links(L.all_links(own)), root=first.url))
    edges = links.select(F.col("url").alias("src_url"), F.col("dst").alias("dst_url"), "rank", "ord")
    return CR.reach(spark, own.select("url"), edges, [first.url], CRAWL_DEPTH, CRAWL_PAGES, robots=rules)


@register("crawl_order", f"SELECT url, depth, visit_ord FROM ({CRAWL_SQL}) WHERE fetched")
def q_crawl_order(spark, sf_dir):
    """Breadth-first over the stored pages' links on one host, less what
    robots rules disallow: depth ≤ 3, capped, each URL once at its least
    depth, order (depth, parent order, link position)."""
    return crawl(spark, sf_dir).filter("fetched").select("url", "depth", "visit_ord")


@register("crawl_unfetched", f"SELECT url, depth, visit_ord FROM ({CRAWL_SQL}) WHERE NOT fetched")
def q_crawl_unfetched(spark, sf_dir):
    """Reached URLs with no stored page: they use up the cap, give no links."""
    return crawl(spark, sf_dir).filter("NOT fetched").select("url", "depth", "visit_ord")


def _crawl_src(src):
    return f"SELECT * FROM ({src}) WHERE page_url IN (SELECT url FROM ({CRAWL_SQL}) WHERE fetched)"


@register("crawl_scan", f"({O.scan_sql(_crawl_src(PAGES_SRC_SQL), ALL, 'broad')}) UNION ALL "
                        f"({O.scan_sql(_crawl_src(htext_src_sql('broad')), ALL, 'broad', part='headers', url_suffix=' (headers)')})")
def q_crawl_scan(spark, sf_dir):
    """Reach, then scan the bodies and headers of the visited pages (end to end)."""
    visited = crawl(spark, sf_dir).filter("fetched").select("url")
    return H.scan_page(spread(FX.pages_with_headers(spark, sf_dir).join(visited, "url", "left_semi")), ALL, "broad")


# --- rendering stand-ins -------------------------------------------------------

from tidemark.operators import pages as PG  # noqa: E402


#: buckets of the page tables that are laid out by url
URL_BUCKETS = 16


@register("rendered_override",
          f"SELECT page_id, (r IS NOT NULL) AS from_js, CAST(length(coalesce(r, html)) AS INTEGER) AS body_len, "
          f"md5(coalesce(r, html)) AS body_md5 FROM (SELECT page_id, html, {FX.rendered_sql()} AS r FROM ({LIVE_PAGES_SQL}))")
def q_rendered_override(spark, sf_dir):
    """A rendered body replaces the raw one and sets from_js. Both tables are
    laid out by url when they are taken in, so the join moves no body."""
    raw = read_table(spark, sf_dir, "pages")
    rendered = raw.select("url", F.expr(FX.rendered_sql()).alias("html")).filter("html IS NOT NULL")
    base = SK.scratch_path(spark, "by-url")
    write_buckets(raw.select("page_id", "url", "html"), "url", URL_BUCKETS, os.path.join(base, "pages"))
    write_buckets(rendered, "url", URL_BUCKETS, os.path.join(base, "rendered"))
    pages = bucket_table(spark, os.path.join(base, "pages"), "page_id BIGINT, url STRING, html STRING", "url", URL_BUCKETS)
    out = PG.apply_rendered(page_columns(pages), bucket_table(spark, os.path.join(base, "rendered"), "url STRING, html STRING", "url", URL_BUCKETS))
    return out.select("page_id", "from_js", F.length("body").alias("body_len"), F.md5("body").alias("body_md5"))


_G, _LS, _SS = FX.client_state_sql()


def _state_block_sql(v):
    return (f"CASE WHEN {v} IS NOT NULL AND {v} NOT IN ('', 'null', '{{}}') "
            f"THEN concat(chr(10), chr(10), {v}) ELSE '' END")


_BLOCKS_SQL = ", ".join(_state_block_sql(v) for v in (_G, _LS, _SS))


@register("client_state_append",
          f"SELECT page_id, md5(concat(html, {_BLOCKS_SQL})) AS body_md5, concat({_BLOCKS_SQL}) AS appended FROM ({LIVE_PAGES_SQL})")
def q_client_state_append(spark, sf_dir):
    """Non-empty client state appended to the rendered body."""
    p = read_table(spark, sf_dir, "pages").filter(F.col("html").isNotNull() & (F.length("html") > 0))
    s = p.select("page_id", "html", F.expr(_G).alias("g"), F.expr(_LS).alias("l"), F.expr(_SS).alias("s"))
    body = PG.append_state(F.col("html"), F.col("g"), F.col("l"), F.col("s"))
    tail = PG.append_state(F.lit(""), F.col("g"), F.col("l"), F.col("s"))
    return s.select("page_id", F.md5(body).alias("body_md5"), tail.alias("appended"))


def _extracted_sql():
    def block(label, v, empty):
        return f"CASE WHEN {v} IS NOT NULL AND {v} NOT IN ({empty}) THEN ['{label}: ' || {v}] ELSE [] END"
    rx = O.q(PG.SCRIPT_RX)
    scripts = (f"list_transform(list_filter(list_zip(regexp_extract_all(html, {rx}, 1), regexp_extract_all(html, {rx}, 2)), "
               f"lambda z: NOT regexp_matches(z[1], {O.q(PG.SRC_ATTR_RX)}) AND length(z[2]) > 0), "
               f"lambda z: 'INLINE_SCRIPT: ' || substring(z[2], 1, 5000))")
    lines = (f"array_to_string(list_concat(list_concat(list_concat({block('GLOBAL_VARS', _G, repr(''))}, "
             f"{block('LOCAL_STORAGE', _LS, repr('') + ', ' + repr('{}'))}), {block('SESSION_STORAGE', _SS, repr('') + ', ' + repr('{}'))}), {scripts}), chr(10))")
    return (f"SELECT page_id, url, html || CASE WHEN l <> '' THEN chr(10) || '<!-- EXTRACTED JS CONTENT -->' || chr(10) || l ELSE '' END AS body "
            f"FROM (SELECT page_id, url, html, {lines} AS l FROM ({AUG_SQL}) WHERE html IS NOT NULL AND length(html) > 0)")


EXTRACTED_SQL = _extracted_sql()


def extracted_pages(spark, sf_dir):
    """Pages with the broad client-state block and inline scripts appended."""
    p = aug(spark, sf_dir).filter(F.col("html").isNotNull() & (F.length("html") > 0))
    body = PG.append_extracted(F.col("html"), F.expr(_G), F.expr(_LS), F.expr(_SS), PG.inline_script_texts("html"))
    return p.select("page_id", "url", body.alias("body"))


@register("client_state_extracted", f"SELECT page_id, md5(body) AS body_md5, CAST(length(body) AS INTEGER) AS body_len FROM ({EXTRACTED_SQL})")
def q_client_state_extracted(spark, sf_dir):
    """Broad form: labelled client state and inline scripts joined to the body."""
    return extracted_pages(spark, sf_dir).select("page_id", F.md5("body").alias("body_md5"), F.length("body").alias("body_len"))


@register("extracted_scan", O.scan_sql(f"SELECT page_id AS src_id, url AS page_url, body AS t FROM ({EXTRACTED_SQL})", ALL, "broad"))
def q_extracted_scan(spark, sf_dir):
    """All broad rules over the bodies with the extracted script content."""
    return scan(extracted_pages(spark, sf_dir), ALL, "broad", filled=True)


@register("inline_scripts", (
    f"SELECT page_id, url, pos, 'INLINE_SCRIPT: ' || substring(c, 1, 5000) AS script FROM ("
    f"SELECT page_id, url, unnest(range(len(regexp_extract_all(html, {O.q(PG.SCRIPT_RX)}, 1)))) AS pos, "
    f"unnest(regexp_extract_all(html, {O.q(PG.SCRIPT_RX)}, 1)) AS a, "
    f"unnest(regexp_extract_all(html, {O.q(PG.SCRIPT_RX)}, 2)) AS c FROM ({AUG_SQL})) "
    f"WHERE NOT regexp_matches(a, {O.q(PG.SRC_ATTR_RX)}) AND length(c) > 0"))
def q_inline_scripts(spark, sf_dir):
    """Inline script contents without src, ≤5000 characters, labelled."""
    p = aug(spark, sf_dir).withColumnRenamed("html", "body")
    return PG.inline_scripts(p).select("page_id", "url", F.col("pos").cast("long").alias("pos"), "script")


# --- validation ------------------------------------------------------------------

BAD_RULES = [R.custom_rule("Broken Rule", r"(?i)token=([a-z"), R.custom_rule("Host Name", r"[a-z]+\.example\.org")]


@register("rule_validation", O.scan_sql(PAGES_SRC_SQL, [BAD_RULES[1]], "broad"))
def q_rule_validation(spark, sf_dir):
    """Rules are compiled by the JVM before planning; an invalid one is set
    aside with its message and the scan goes on with the rest."""
    ok, bad = R.validate_rules(spark, BAD_RULES)
    if [b[0] for b in bad] != ["Broken Rule"]:
        raise AssertionError(f"validation: {bad}")
    return scan(spread(read_pages(spark, sf_dir)), ok, "broad")


# user rules made from a table's names: every fourth is sound, the others are
# an unclosed group, a rule that matches nothing at all, and an unclosed class
USER_RULES_SQL = ("SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN concat('(', lower(n_name)) WHEN 1 THEN concat('(?:', lower(n_name), ')?') "
                  "WHEN 2 THEN concat(lower(n_name), '[') ELSE concat('the [a-z]+', CAST(n_nationkey % 7 AS STRING), '?') END AS regex FROM {}")


@register("scan_errors", f"SELECT page_id, n_name AS pattern, CASE n_nationkey % 4 WHEN 1 THEN 'matches the empty string' ELSE 'does not compile' END "
                         f"AS error FROM ({LIVE_PAGES_SQL}), nation WHERE n_nationkey % 4 < 3")
def q_scan_errors(spark, sf_dir):
    """Rules of a user's table that validation sets aside, with every page
    that each would have been run over."""
    view = "tm_user_rules"
    read_table(spark, sf_dir, "nation").createOrReplaceTempView(view)
    _, bad = R.validate_rules(spark, R.load_rules(spark.sql(USER_RULES_SQL.format(view))))
    kind = F.when(F.col("error").contains("empty string"), "matches the empty string").otherwise("does not compile")
    return failed(read_pages(spark, sf_dir), bad).withColumn("error", kind)


# --- sinks -------------------------------------------------------------------------

from tidemark.sources import sinks as SK  # noqa: E402

REPORT_SQL = with_raw(
    f", t AS ({FX.SCANS_TIMES_SQL}) SELECT r.scan_id, strftime(t.start_time, '%Y-%m-%d %H:%M:%S') AS timestamp, r.url, r.category, "
    "r.pattern, r.severity, r.match, r.context FROM raw r JOIN t ON r.scan_id = t.scan_id")


def report_findings(spark, sf_dir, scan_id=None):
    """The findings of all scans, or of one, with the scan's start as their timestamp text."""
    t = FX.scans_times(spark, sf_dir).select("scan_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))
    found = raw_findings(spark, sf_dir)
    # a row a scan: a broadcast side; by the size of ``events`` the planner would deal all findings by their few scans
    return (found if scan_id is None else found.filter(F.col("scan_id") == scan_id)).join(F.broadcast(t), "scan_id")


@register("sink_csv", REPORT_SQL)
def q_sink_csv(spark, sf_dir):
    """A report a scan: the seven CSV fields written with a header and read back."""
    path = SK.write_csv(report_findings(spark, sf_dir), SK.scratch_path(spark, "csv"), by="scan_id")
    return SK.read_csv(spark, path).select(F.col("scan_id").cast("long").alias("scan_id"), *SK.CSV_FIELDS)


@register("sink_json", with_raw("SELECT scan_id, finding_hash, url, pattern, category, severity, match, context, "
                                "CAST(start AS BIGINT) AS start, CAST(\"end\" AS BIGINT) AS \"end\", is_javascript FROM raw"))
def q_sink_json(spark, sf_dir):
    """Findings of all scans as JSON lines, read back."""
    f = raw_findings(spark, sf_dir).select(
        "scan_id", "finding_hash", "url", "pattern", "category", "severity", "match", "context", "start", "end", "is_javascript")
    path = SK.write_json(f, SK.scratch_path(spark, "json"))
    return spark.read.json(path).select(*f.columns)


def _esc_sql(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


HTML_ROWS_SQL = with_raw(
    "SELECT scan_id, '<tr class=\"severity-' || " + _esc_sql("coalesce(severity, 'medium')") + " || '\"><td>' || "
    + _esc_sql("upper(coalesce(severity, 'medium'))") + " || '</td><td>' || " + _esc_sql("pattern")
    + " || '</td><td>' || " + _esc_sql("coalesce(category, '')") + " || '</td><td>' || "
    + _esc_sql("substring(url, 1, 100)") + " || '</td><td><code>' || " + _esc_sql("substring(match, 1, 100)")
    + " || '</code></td><td>' || " + _esc_sql("substring(context, 1, 200)") + " || '</td></tr>' AS line "
    "FROM raw UNION ALL SELECT scan_id, '<html><head><meta charset=\"utf-8\"><title>Scan report</title></head>"
    "<body><h1>Scan report</h1><p>Total: ' || count(*) || ' High: ' || count_if(severity = 'high') || ' Medium: ' || "
    "count_if(severity = 'medium') || ' Low: ' || count_if(severity = 'low') || '</p><table><tr><th>Severity</th>"
    "<th>Pattern</th><th>Category</th><th>URL</th><th>Match</th><th>Context</th></tr>' FROM raw GROUP BY scan_id "
    "UNION ALL SELECT DISTINCT scan_id, '</table></body></html>' FROM raw")


@register("sink_html", HTML_ROWS_SQL)
def q_sink_html(spark, sf_dir):
    """An HTML report a scan (summary, escaped rows in rank order) written as
    text and read back line by line."""
    path = SK.write_html(raw_findings(spark, sf_dir), SK.scratch_path(spark, "html"), by="scan_id")
    return spark.read.text(path).select(F.col("scan_id").cast("long").alias("scan_id"), F.col("value").alias("line"))


def _stat_table_sql(title, src, key, cls=False):
    cell = (f"'<td class=''severity-' || {key} || '''>' || upper({key}) || '</td>'" if cls
            else f"'<td>' || {_esc_sql(key)} || '</td>'")
    return (f"SELECT '<h3>{title}</h3><table>' AS line UNION ALL SELECT '</table>' UNION ALL "
            f"SELECT '<tr>' || {cell} || '<td>' || count || '</td></tr>' FROM ({src})")


_GROUPED = "SELECT {0}, count(*) AS count FROM {1} GROUP BY {0} ORDER BY count DESC, {0} LIMIT {2}"


@register("statistics_html", with_store(
    f", t AS ({FX.SCANS_TIMES_SQL}), r0 AS (SELECT * FROM raw WHERE scan_id = 0) "
    "SELECT '<p>total_scans: <b>' || count(*) || '</b></p>' AS line FROM t UNION ALL "
    "SELECT '<p>total_findings: <b>' || count(*) || '</b></p>' FROM stored UNION ALL "
    + " UNION ALL ".join((
        _stat_table_sql("Findings by Category", _GROUPED.format("category", "r0", 1000), "category"),
        _stat_table_sql("Severity Distribution", _GROUPED.format("severity", "r0", 1000), "severity", True),
        _stat_table_sql("Top Patterns Found", _GROUPED.format("pattern", "r0", 20), "pattern"),
        _stat_table_sql("Historical Top Patterns", _GROUPED.format("pattern", "stored", 10), "pattern")))))
def q_statistics_html(spark, sf_dir):
    """Statistics page: totals, categories, severities, top rules."""
    path = SK.write_statistics(
        {"total_scans": q_total_scans(spark, sf_dir), "total_findings": q_total_findings(spark, sf_dir)},
        q_category_counts(spark, sf_dir), q_severity_ordered(spark, sf_dir), q_top_patterns_20(spark, sf_dir),
        q_top_patterns_10(spark, sf_dir), SK.scratch_path(spark, "stats"))
    return spark.read.text(path).select(F.col("value").alias("line"))


@register("sink_tables", with_store(
    f", t AS ({FX.SCANS_TIMES_SQL}) SELECT 'findings' AS table_name, count(*) AS n FROM stored "
    f"UNION ALL SELECT 'scans', count(*) FROM t "
    f"UNION ALL SELECT 'pages', count(*) FROM (SELECT unnest({membership_sql('page_id')}) FROM ({LIVE_PAGES_SQL})) "
    f"UNION ALL SELECT 'custom_patterns', {len(CUSTOM)}"))
def q_sink_tables(spark, sf_dir):
    """The four store tables written as parquet (findings and pages
    partitioned by scan) and counted after reading back."""
    tables = {"findings": stored_findings(spark, sf_dir).select(*STORE_COLS),
              "scans": q_scan_end(spark, sf_dir),
              "pages": q_page_log(spark, sf_dir),
              "custom_patterns": R.rules_to_df(spark, CUSTOM)}
    paths = SK.write_tables(tables, SK.scratch_path(spark, "tables"))
    out = None
    for name, p in paths.items():
        c = spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


@register("format_check", with_raw(
    ", n AS (SELECT count(*) AS n, count(DISTINCT scan_id) AS scans FROM raw) SELECT f.format, f.status, n.n + f.extra * n.scans AS n_lines FROM n, "
    "(VALUES ('stream', 'ok', 0), ('json', 'ok', 0), ('csv', 'ok', 0), ('html', 'ok', 2), ('xml', 'refused', NULL)) f(format, status, extra)"))
def q_format_check(spark, sf_dir):
    """Each requested format is checked; stream/json/csv/html write the
    findings of all scans and are counted as they read back, anything else is refused."""
    f = report_findings(spark, sf_dir)
    out = None
    for fmt in ("stream", "json", "csv", "html", "xml"):
        try:
            path = SK.write(f, SK.scratch_path(spark, f"fmt-{fmt}"), fmt, by="scan_id", compression="gzip")
            back = SK.read_csv(spark, path) if fmt == "csv" else spark.read.text(path)
            row = back.agg(F.lit(fmt).alias("format"), F.lit("ok").alias("status"), F.count(F.lit(1)).alias("n_lines"))
        except ValueError:
            row = spark.range(1).select(F.lit(fmt).alias("format"), F.lit("refused").alias("status"), F.lit(None).cast("long").alias("n_lines"))
        out = row if out is None else out.unionByName(row)
    return out


# --- 2.8 streaming -------------------------------------------------------------

from tidemark.streaming import stream as SS  # noqa: E402

_STREAM_RUNS: dict = {}
STREAM_FILES = 8   # files of a scan at least, taken together in one micro-batch
_MEMOS.append(_STREAM_RUNS)


def _stream_part(name, fn):
    """Run one of the stream's queries once per session and folder."""
    def wrapped(spark, sf_dir):
        key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
        if key not in _STREAM_RUNS:
            _STREAM_RUNS[key] = fn(spark, sf_dir)
        return _STREAM_RUNS[key]
    return wrapped


def _scan_run(spark, sf_dir):
    """Stage page visits as files per scan in a fresh folder under the
    checkpoint dir, then run the streaming scan, one scan a micro-batch: a page
    of two scans comes again in a later batch."""
    pages = FX.pages_with_headers(spark, sf_dir)
    visits = pages.withColumn("scan_id", F.explode(F.expr(FX.scan_membership_sql("page_id"))))
    base, size = SK.scratch_path(spark, "stream"), page_bytes(spark, sf_dir)
    files = stream_files(size)
    SS.stage_files(spread(visits.select(*[f.name for f in SS.VISIT_SCHEMA.fields]), size), os.path.join(base, "in"), range(FX.N_SCANS), files=files)
    paths = SS.scan_stream(spark, os.path.join(base, "in"), ALL, os.path.join(base, "out"), files_per_trigger=files,
                           tasks=files if files > STREAM_FILES else None)
    return paths | {"files": files, "buckets": store_buckets(size)}


def stream_files(size):
    """Files of a scan's visits: about a third of ``size`` bytes of pages, in tasks of SPREAD_BYTES."""
    return max(STREAM_FILES, -(-size // (3 * SPREAD_BYTES)))


def _run_store(spark, sf_dir):
    run = stream_run(spark, sf_dir)
    return SS.store_stream(spark, run, run["files"], run["buckets"])


def _run_totals(spark, sf_dir):
    run = stream_run(spark, sf_dir)
    return SS.status_stream(spark, run, 2 * run["files"])


stream_run = _stream_part("scan", _scan_run)
stream_store = _stream_part("store", _run_store)
stream_lines = _stream_part("lines", lambda spark, sf_dir: SS.lines_stream(spark, stream_run(spark, sf_dir)))
stream_totals = _stream_part("status", _run_totals)


RAW_COLS = ["finding_hash", "scan_id", "src_id", "url", "part", "pattern", "match_idx", "start", "match", "context"]


@register("stream_scan", with_raw(f"SELECT {', '.join(RAW_COLS)} FROM raw"))
def q_stream_scan(spark, sf_dir):
    """Findings leave each micro-batch as its pages arrive; the sink holds
    exactly the batch result."""
    return spark.read.parquet(stream_run(spark, sf_dir)["raw"]).select(*RAW_COLS)


@register("stream_format", with_raw("SELECT finding_hash, scan_id, url, pattern, severity, match FROM raw"))
def q_stream_format(spark, sf_dir):
    """The ``stream`` output format: JSON lines emitted batch by batch."""
    lines = spark.read.json(stream_lines(spark, sf_dir))
    return lines.select("finding_hash", "scan_id", "url", "pattern", "severity", "match")


@register("stream_dedupe", with_store(f"SELECT {', '.join(STORE_COLS)} FROM stored"))
def q_stream_dedupe(spark, sf_dir):
    """First finding per hash across micro-batches (each an append to the store)."""
    return stream_store(spark, sf_dir).read().select(*STORE_COLS)


DELAY = 1800   # seconds that a hash is remembered for, and that an event may be late


def _bounded_dedupe_sql():
    """The streaming dedupe written out batch by batch (one scan each): w: the
    watermark in force, behind the latest event before the batch; events are
    late against the one before; m: what is remembered after a batch."""
    parts = [f"f AS (SELECT DISTINCT finding_hash, scan_id, {FX.visited_sql()} AS visited FROM raw)", "w0 AS (SELECT 0 AS w)", "late0 AS (SELECT 0 AS w)"]
    for b in range(FX.N_SCANS):
        if b:
            parts += [f"w{b} AS (SELECT greatest(coalesce(max(visited), 0) - {DELAY}, 0) AS w FROM f WHERE scan_id < {b})",
                      f"late{b} AS (SELECT w FROM w{b - 1})"]
        seen = f" AND finding_hash NOT IN (SELECT finding_hash FROM m{b - 1})" if b else ""
        parts.append(f"k{b} AS (SELECT * FROM f WHERE scan_id = {b} AND visited > (SELECT w FROM late{b}){seen})")
        held = f"SELECT * FROM k{b}" + (f" UNION ALL SELECT * FROM m{b - 1}" if b else "")
        parts.append(f"m{b} AS (SELECT * FROM ({held}) WHERE visited + {DELAY} > (SELECT w FROM w{b}))")
    return with_raw(", " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM k{b}" for b in range(FX.N_SCANS)))


def _seen_files(spark, sf_dir):
    base, files = SK.scratch_path(spark, "seen"), stream_files(page_bytes(spark, sf_dir))
    seen = raw_findings(spark, sf_dir).select("finding_hash", "scan_id", F.expr(FX.visited_sql()).alias("visited"))
    SS.stage_files(seen, os.path.join(base, "in"), range(FX.N_SCANS), files=files)
    return base, files


@register("stream_dedupe_bounded", _bounded_dedupe_sql())
def q_stream_dedupe_bounded(spark, sf_dir):
    """Dedupe with state that expires: a hash seen again within half an hour is
    dropped, later it counts anew; events behind the watermark are dropped."""
    base, files = _seen_files(spark, sf_dir)
    SS.dedupe_stream(spark, os.path.join(base, "in"), base, f"{DELAY} seconds", files)
    return spark.read.parquet(os.path.join(base, "seen")).select("finding_hash", "scan_id", "visited")


@register("stream_status", with_raw(
    f", p AS (SELECT scan_id, count(*) AS pages FROM (SELECT unnest({membership_sql('page_id')}) AS scan_id "
    f"FROM ({LIVE_PAGES_SQL})) GROUP BY scan_id), f AS (SELECT scan_id, count(*) AS findings FROM raw GROUP BY scan_id) "
    "SELECT p.scan_id, p.pages, coalesce(f.findings, 0) AS findings, "
    "CAST(sum(p.pages) OVER (ORDER BY p.scan_id) AS BIGINT) AS pages_total, "
    "CAST(sum(coalesce(f.findings, 0)) OVER (ORDER BY p.scan_id) AS BIGINT) AS findings_total "
    "FROM p LEFT JOIN f ON p.scan_id = f.scan_id"))
def q_stream_status(spark, sf_dir):
    """Pages visited and findings per scan, kept as a streaming aggregate, with running totals."""
    return SS.running_status(spark, stream_totals(spark, sf_dir))


@register("stream_summary", with_store(
    f"SELECT (SELECT count(*) FROM (SELECT unnest({membership_sql('page_id')}) FROM ({LIVE_PAGES_SQL}))) AS pages_total, "
    "(SELECT count(*) FROM raw) AS findings_raw, (SELECT count(*) FROM stored) AS findings_stored"))
def q_stream_summary(spark, sf_dir):
    """Summary only (no finding rows) once the stream has ended."""
    stream_store(spark, sf_dir)
    stream_totals(spark, sf_dir)
    return SS.summary(spark, stream_run(spark, sf_dir))


# --- 2.9 SQL surface -------------------------------------------------------------

from tidemark.functions.sql_function import register_scan_text  # noqa: E402

TEXT_COLS = ["src_id", "pattern", "category", "severity", "match_idx", "start", "end", "match", "context"]


@register("scan_text", f"SELECT {', '.join(c if c != 'end' else chr(34) + 'end' + chr(34) for c in TEXT_COLS)} "
                       f"FROM ({O.scan_sql(DOCS_SRC_SQL, select_rules(['financial']), 'broad')})")
def q_scan_text(spark, sf_dir):
    """The scan called from SQL: scan_text(text, 'financial') per row, then
    LATERAL VIEW inline over the array."""
    fn = register_scan_text(spark)
    view = f"tm_docs_{abs(hash(sf_dir)) % 10**8}"
    docs(spark, sf_dir).createOrReplaceTempView(view)
    return spark.sql(f"SELECT d.doc_id AS src_id, f.pattern, f.category, f.severity, f.match_idx, f.start, "
                     f"f.`end`, f.match, f.context FROM (SELECT doc_id, {fn}(text, 'financial') AS fa "
                     f"FROM {view}) d LATERAL VIEW OUTER inline(d.fa) f WHERE f.rule_idx IS NOT NULL")
