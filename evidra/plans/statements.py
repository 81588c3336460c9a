"""Plans over the driver's tables, each stated once for both engines. ``d`` spells a dialect."""

from __future__ import annotations

PLANS: dict = {}


def plan(f):
    PLANS[f.__name__] = f
    return f


SENTENCE_END = "[.!?]+"
SLUG = "[^a-z0-9]+"


# --- sources and predicates


@plan
def scan_pages(d):
    return f"SELECT page_id, url, {d.first('html', '<html lang=.([a-z]+)', 1)} AS lang, length(html) AS html_chars FROM pages"


@plan
def filter_date_range(d):
    return "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus = 'F'"


@plan
def scan_payload(d):
    return "SELECT doc_id, lang, source, n_chars FROM documents WHERE source = 'src3' AND n_chars >= 200"


@plan
def filter_exclude(d):
    return f"SELECT doc_id FROM documents WHERE upper(source) NOT IN ('SRC0', 'SRC5') AND NOT (text LIKE '%License%' OR text LIKE '%license%')"


@plan
def html_clean(d):
    x = "html"
    for tag in ("script", "style", "nav", "footer"):
        x = d.rr(x, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    x = d.rr(d.rr(x, "(?s)<[^>]*>", " "), "[ \\t\\r\\n]+", " ")
    return f"SELECT page_id, trim({x}) AS text FROM pages"


def _host(d, u="url"):
    return f"lower({d.first(u, '^[a-z]+://([^/?#]*)', 1)})"


@plan
def link_internal(d):
    return f"SELECT page_id, host, (host = 'example.com' OR host LIKE '%.example.com') AS internal FROM (SELECT page_id, {_host(d)} AS host FROM pages) x"


@plan
def url_allowed(d):
    return f"SELECT page_id, ({d.has('url', '^https?://[^/]*/en/')} AND NOT {d.has('url', '[.](png|jpg|pdf|zip)$')} AND NOT {d.has('url', '/_sources/|/images/')}) AS allowed FROM pages"


@plan
def filter_failed(d):
    return "SELECT event_id, user_id FROM events WHERE event_type = 'error'"


@plan
def alias_indexable(d):
    alnum = f"length({d.rr('p_name', '[^A-Za-z0-9]', '')})"
    return f"SELECT p_partkey, (({alnum} >= 2 OR p_name LIKE '%/%' OR p_name LIKE '%-%') AND (length(p_name) >= 3 OR {d.has('p_name', '[0-9/-]')})) AS indexable FROM part"


@plan
def context_budget(d):
    return "SELECT conv_id, turn, used FROM (SELECT conv_id, turn, sum(least(length(text), 400)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM conversations) x WHERE used <= 1200".replace("SELECT conv_id, turn, used FROM", "SELECT conv_id, turn, cast(used as bigint) AS used FROM", 1)


@plan
def answer_status(d):
    return "SELECT conv_id, CASE WHEN n = 0 THEN 'no_evidence' WHEN n = 1 THEN 'limited_evidence' ELSE 'grounded' END AS status FROM (SELECT conv_id, count_if(role = 'assistant') AS n FROM conversations GROUP BY conv_id) x"


@plan
def dup_ids(d):
    return "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1"


# --- joins


@plan
def validate_labels(d):
    return "SELECT d.doc_id AS id, 'missing_annotation' AS problem FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL UNION ALL SELECT l.doc_id, 'unknown_id' FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL UNION ALL SELECT doc_id, 'duplicate_id' FROM labels GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'toxic_but_good' FROM labels WHERE toxic = 1 AND quality = 1"


@plan
def resolve_parent(d):
    return "SELECT c.conv_id, c.turn, coalesce(d.doc_id, -1) AS parent, coalesce(length(d.text), length(c.text)) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS n FROM conversations) c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.n = 1"


@plan
def enrich_docs(d):
    return "SELECT d.doc_id, d.source, n.n_name AS entity, r.r_name AS scope FROM documents d LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 40 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"


@plan
def alias_scan(d):
    """The oracle only, and of single-word aliases only: the query is ``operators.aliases.alias_scan``, tested against a regex loop."""
    words = d.distinct(d.all("lower(text)", "[a-z0-9]+"))
    return f"SELECT t.doc_id, a.alias FROM (SELECT doc_id, w FROM documents {d.unnest(words, 'u', 'w')}) t JOIN (SELECT DISTINCT lower(e) AS alias FROM (SELECT n_name AS e FROM nation UNION ALL SELECT 'license' UNION ALL SELECT 'version' UNION ALL SELECT 'apache' UNION ALL SELECT 'mit') z) a ON a.alias = t.w"


@plan
def boundary_match(d):
    return f"SELECT doc_id FROM documents WHERE {d.has('text', '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)')}"


@plan
def version_match(d):
    seen = d.distinct(d.all("text", "[0-9]+[.][0-9]+(?:[.][0-9]+)*"))
    known = d.array("'1.0.0'", "'2.0'", "'3.1'")
    return f"SELECT doc_id, {d.join(d.sort(d.both(seen, known)), '|')} AS versions FROM documents"


@plan
def module_match(d):
    """The oracle only: the query is ``operators.matches.pairs_by_key``."""
    return "SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON lower(p.p_brand) = concat('brand#', cast(s.s_suppkey % 55 as varchar(9)))"


@plan
def citation_key(d):
    return f"SELECT conv_id, {d.join(d.sort(d.distinct(d.items('cast(turn as varchar(9))', 'turn'))), '|')} AS reference_key FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


@plan
def alias_ambiguity(d):
    return "SELECT lower(p_name) AS alias, count(DISTINCT p_brand) AS canonicals FROM part GROUP BY lower(p_name) HAVING count(DISTINCT p_brand) > 1"


@plan
def split_lookup(d):
    return "SELECT d.doc_id, CASE WHEN d.doc_id % 10 >= 7 THEN 'test' ELSE 'dev' END AS split, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@plan
def source_authority(d):
    return "SELECT d.doc_id, CASE WHEN d.source IN ('src0', 'src1') THEN 'local_official' WHEN l.quality = 1 THEN 'external_official' WHEN l.quality = 0 THEN 'ticket_memory' WHEN d.source LIKE 'src1%' THEN 'external' ELSE 'unknown' END AS authority FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@plan
def split_semi(d):
    return "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@plan
def split_anti(d):
    return "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"


@plan
def prefix_overlap(d):
    return "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND b.n_name LIKE concat(substr(a.n_name, 1, 8), '%')"


@plan
def sparse_expand(d):
    return f"SELECT item_id, concat(text, ' ', {d.join(d.items('n_name', 'n_nationkey'), ' ')}) AS expanded FROM benchmark JOIN nation ON n_regionkey = item_id % 5 GROUP BY item_id, text"


# --- aggregations


@plan
def composition_counts(d):
    return f"WITH rows_ AS (SELECT s.split, x.lang FROM (SELECT CASE WHEN doc_id % 10 >= 7 THEN 'test' ELSE 'dev' END AS own, lang FROM documents) x JOIN (SELECT 'all' AS split UNION ALL SELECT 'dev' UNION ALL SELECT 'test') s ON s.split = 'all' OR s.split = x.own), grid AS (SELECT split, lang FROM (SELECT 'all' AS split UNION ALL SELECT 'dev' UNION ALL SELECT 'test') a CROSS JOIN (SELECT 'de' AS lang UNION ALL SELECT 'en' UNION ALL SELECT 'es' UNION ALL SELECT 'fr' UNION ALL SELECT 'it') b), n AS (SELECT split, lang, count(*) AS n FROM rows_ GROUP BY split, lang), t AS (SELECT split, count(*) AS total FROM rows_ GROUP BY split) SELECT grid.split, grid.lang, coalesce(n.n, 0) AS n, t.total, round(coalesce(n.n, 0) / cast(t.total as double), 6) AS proportion FROM grid LEFT JOIN n ON n.split = grid.split AND n.lang = grid.lang JOIN t ON t.split = grid.split"


@plan
def composition_combos(d):
    return "SELECT lang, source, quality, toxic, count(*) AS n, cast(sum(count(*)) OVER (PARTITION BY lang) as bigint) AS total FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang, source, quality, toxic"


@plan
def composition_summary(d):
    return "SELECT count(*) AS total, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic, count_if(quality = 1 AND toxic = 1) AS both_, count_if(lang = 'en' AND quality = 0) AS english_bad FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@plan
def source_distribution(d):
    return "SELECT turn, role, n, cast(sum(n) OVER (PARTITION BY turn) as bigint) AS total, round(n / cast(sum(n) OVER (PARTITION BY turn) as double), 6) AS proportion FROM (SELECT turn, coalesce(nullif(role, ''), 'unknown') AS role, count(*) AS n FROM conversations GROUP BY turn, coalesce(nullif(role, ''), 'unknown')) x"


@plan
def stage_aggregates(d):
    return "SELECT o_orderpriority, count(x) AS n, round(avg(x), 4) AS mean, round(min(x), 4) AS low, round(max(x), 4) AS high, round(stddev_pop(x), 4) AS std FROM (SELECT o_orderpriority, CASE WHEN isnan(o_totalprice) THEN NULL ELSE o_totalprice END AS x FROM orders) y GROUP BY o_orderpriority"


@plan
def quality_aggregates(d):
    return "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM events WHERE NOT isnan(value) GROUP BY event_type"


@plan
def metric_means(d):
    return f"SELECT round(avg({d.number('cast(l_quantity as varchar(20))')}), 6) AS quantity, round(avg({d.number('l_returnflag')}), 6) AS flag FROM lineitem"


@plan
def prep_stats(d):
    return "SELECT event_type, count(*) AS n, round(count(*) / cast(sum(count(*)) OVER () as double), 6) AS rate, CASE WHEN count(*) / cast(sum(count(*)) OVER () as double) > 0.5 THEN 'INVALID' ELSE 'VALID' END AS verdict FROM events GROUP BY event_type"


@plan
def latency_percentiles(d):
    p = ", ".join(f"round({d.pct('value', q)}, 6) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95))
    return f"SELECT event_type, {p}, round(max(value), 6) AS top, round(avg(value), 6) AS mean FROM events WHERE event_type <> 'error' GROUP BY event_type"


@plan
def feedback_summary(d):
    return "SELECT coalesce(nullif(event_type, ''), 'ad_hoc') AS scenario, count(*) AS total, count_if(value > 50) AS helpful FROM events GROUP BY coalesce(nullif(event_type, ''), 'ad_hoc')"


@plan
def count_tickets(d):
    parent = d.rr("concat(cast(conv_id as varchar(19)), '::chunk::', cast(turn as varchar(9)))", "::chunk::[0-9]+$", "")
    return f"SELECT count(*) AS chunks, count(DISTINCT {parent}) AS tickets FROM conversations"


@plan
def trial_objective(d):
    return "SELECT l_suppkey, round(coalesce((avg(l_discount) + avg(l_tax)) / 2, -1.0), 6) AS objective FROM lineitem GROUP BY l_suppkey"


@plan
def null_cell_rate(d):
    return "SELECT round((count_if(l.quality IS NULL) + count_if(l.toxic IS NULL)) / (2.0 * count(*)), 6) AS rate FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id".replace("2.0 *", "cast(2 as double) *")


@plan
def validity_status(d):
    return "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) ELSE 'unknown' END AS status, count(*) AS n FROM documents GROUP BY source"


@plan
def yearly_resolution(d):
    days = "(o_orderkey % 97) / cast(4 as double)"
    return f"SELECT year(o_orderdate) AS y, count(*) AS n, round(avg({days}), 6) AS mean_days, round({d.pct(days, 0.5)}, 6) AS median_days FROM orders GROUP BY year(o_orderdate)"


@plan
def unique_once(d):
    return "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text HAVING count(*) = 1"


@plan
def split_targets(d):
    return f"SELECT lang, count(*) AS n, cast({d.even('count(*) * cast(0.3 as double)')} as bigint) AS target FROM documents GROUP BY lang"


@plan
def rebuild_transcript(d):
    return f"SELECT conv_id, {d.join(d.items('text', 'turn'), '|')} AS text FROM conversations GROUP BY conv_id"


@plan
def row_sources(d):
    return f"SELECT conv_id, {d.join(d.sort(d.distinct(d.items('role', 'turn'))), '|')} AS roles, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id"


@plan
def alias_index(d):
    return f"SELECT lower(p_name) AS alias, {d.join(d.items('cast(p_partkey as varchar(19))', 'p_partkey'), '|')} AS ids FROM part GROUP BY lower(p_name)"


# --- windows, order and sets


@plan
def freshness_rank(d):
    return "SELECT doc_id, source, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - (i - 1) / cast(n - 1 as double) END, 6) AS freshness FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) x".replace("THEN 1.0", "THEN cast(1 as double)")


@plan
def minmax_norm(d):
    return "SELECT event_id, round(CASE WHEN hi - lo <= 1e-12 THEN cast(1 as double) ELSE (value - lo) / (hi - lo) END, 6) AS score FROM (SELECT event_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events) x"


@plan
def chunk_links(d):
    return "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_id, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_id FROM conversations"


@plan
def leaderboard(d):
    return "SELECT o_orderpriority, o_orderstatus, row_number() OVER (ORDER BY total DESC NULLS LAST, o_orderpriority, o_orderstatus) AS place FROM (SELECT o_orderpriority, o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus) x"


@plan
def latest_per_group(d):
    return "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n = 1"


@plan
def dedupe_first(d):
    return "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) x WHERE n = 1"


@plan
def pii_aliases(d):
    return f"SELECT doc_id, v AS value, concat('EMAIL_', {d.padded('row_number() OVER (PARTITION BY doc_id ORDER BY place, v)', 3)}) AS alias FROM (SELECT doc_id, v, min(instr(text, v)) AS place FROM (SELECT doc_id, text, v FROM documents {d.unnest(d.all('text', '[A-Za-z0-9._]+@[A-Za-z0-9.]+[.][a-z]+'), 'u', 'v')}) x GROUP BY doc_id, v) y"


@plan
def message_ids(d):
    return f"SELECT conv_id, turn, concat(cast(conv_id as varchar(19)), '::msg::', {d.padded('turn', 4)}) AS message_id FROM conversations"


@plan
def best_concurrency(d):
    return "SELECT event_type FROM (SELECT event_type, row_number() OVER (ORDER BY CASE WHEN avg(value) < 60 THEN 0 ELSE 1 END, count(*) DESC, event_type) AS n FROM events GROUP BY event_type) x WHERE n = 1"


@plan
def top3_summary(d):
    return f"SELECT source, {d.join(d.items('cast(doc_id as varchar(19))', 'doc_id'), ', ')} AS first_ids FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) x WHERE n <= 3 GROUP BY source"


@plan
def sorted_unique(d):
    return f"SELECT conv_id, {d.join(d.sort(d.distinct(d.items('trim(role)', 'turn'))), '|')} AS roles FROM conversations WHERE trim(role) <> '' GROUP BY conv_id"


@plan
def match_component(d):
    return f"SELECT x.doc_id, CASE WHEN {d.size('x.w')} = 0 OR {d.size('b.w')} = 0 THEN 0 WHEN {d.overlap('x.w', 'b.w')} THEN 1 ELSE -1 END AS component FROM (SELECT doc_id, {d.all('lower(text)', '[a-z]{9,}')} AS w FROM documents) x JOIN (SELECT item_id, {d.all('lower(text)', '[a-z]{9,}')} AS w FROM benchmark) b ON b.item_id = x.doc_id % 40"


@plan
def union_dedup(d):
    return "SELECT source AS value FROM documents UNION SELECT lang FROM documents"


@plan
def weight_grid(d):
    v = "(SELECT 0.0 AS w UNION ALL SELECT 0.5 UNION ALL SELECT 1.0)".replace("0.0", "cast(0 as double)").replace("0.5", "cast(0.5 as double)").replace("1.0", "cast(1 as double)")
    names = ["authority", "scope", "software", "version", "status", "freshness"]
    return "SELECT DISTINCT " + ", ".join(f"t{i}.w AS {n}" for i, n in enumerate(names)) + " FROM " + " CROSS JOIN ".join(f"{v} t{i}" for i in range(len(names)))


@plan
def set_intersect(d):
    return "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"


@plan
def set_except(d):
    return "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"


# --- evaluation


def _tokens(d, x="text"):
    return d.all(f"lower({x})", "[a-z0-9_]+")


@plan
def tokens(d):
    words = d.each(d.all("text", "[A-Za-z0-9_]+"), "w", "lower(w)")
    return f"SELECT doc_id, {d.join(words, ' ')} AS tokens FROM documents"


@plan
def bm25_stats(d):
    return f"WITH t AS (SELECT doc_id, w FROM documents {d.unnest(_tokens(d), 'u', 'w')}), l AS (SELECT d.doc_id, count(t.w) AS n FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY d.doc_id) SELECT (SELECT count(DISTINCT w) FROM t) AS terms, (SELECT count(*) FROM t) AS postings, round(greatest(avg(n), 1), 6) AS avgdl, count(*) AS docs FROM l"


@plan
def stratified_split(d):
    return "SELECT doc_id, lang, CASE WHEN n > 1 AND i <= ceil(n * cast(0.3 as double)) THEN 'test' ELSE 'dev' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(cast(doc_id as varchar(19))), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) x"


@plan
def split_score(d):
    return f"SELECT round(sum((n_test - target) * (n_test - target) / cast(n as double) + CASE WHEN n_test = 0 THEN 100 ELSE 0 END), 6) AS score FROM (SELECT source, count(*) AS n, count_if(doc_id % 10 >= 7) AS n_test, {d.even('count(*) * cast(0.3 as double)')} AS target FROM documents GROUP BY source) x"


@plan
def scope_bucket(d):
    return "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') AND lang = 'en' THEN 'local_and_external' WHEN source IN ('src0', 'src1') THEN 'local_official' WHEN lang = 'en' THEN 'external_official' ELSE 'none' END AS bucket FROM documents"


@plan
def scaffold_labels(d):
    return "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'seeded' ELSE 'verified' END AS review_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"


@plan
def query_review(d):
    return "SELECT b.item_id, length(b.text) AS chars, count(l.doc_id) AS labelled, coalesce(cast(sum(l.quality) as bigint), 0) AS good FROM benchmark b LEFT JOIN labels l ON l.doc_id % 40 = b.item_id GROUP BY b.item_id, length(b.text)"


@plan
def mod_split(d):
    return "SELECT item_id, CASE WHEN item_id % 10 >= 7 THEN 'test' ELSE 'dev' END AS split FROM benchmark"


@plan
def fingerprint(d):
    text = "concat('{status:', o_orderstatus, ',priority:', o_orderpriority, '}')"
    return f"SELECT o_orderkey, {d.sha(text)} AS fingerprint FROM orders"


# --- text functions


@plan
def normalize_key(d):
    return f"SELECT doc_id, trim({d.rr('lower(source)', SLUG, ' ')}) AS k, trim({d.rr(d.rr('text', SLUG, ' '), ' +', ' ')}) AS t FROM documents"


@plan
def clean_title(d):
    return f"SELECT page_id, trim({d.rr(d.first('html', '<title>([^<]*)</title>', 1), ' [|-] [^|-]*$', '')}) AS title FROM pages"


@plan
def html_title(d):
    return f"SELECT page_id, {d.first('html', '(?is)<title[^>]*>(.*?)</title>', 1)} AS title FROM pages"


@plan
def url_slug(d):
    return f"SELECT page_id, {d.first(d.rr('url', '[?#].*$', ''), '([^/]*)/?$', 1)} AS slug FROM pages"


@plan
def page_class(d):
    return f"SELECT page_id, CASE WHEN {d.has('url', '[?]page=')} THEN 'listing' WHEN {d.has('url', '^https://')} THEN 'secure' ELSE 'plain' END AS class, {d.first('url', '/([a-z]{2})/', 1)} AS lang FROM pages"


@plan
def transcript(d):
    m = f"concat('<MESSAGE id=', {d.padded('turn', 4)}, ' role=', role, '>', text, '</MESSAGE>')"
    return f"SELECT conv_id, {d.join(d.items(m, 'turn'), ' ')} AS transcript FROM conversations GROUP BY conv_id"


@plan
def message_blocks(d):
    block = "concat('<M id=', cast(turn as varchar(9)), '>', text)"
    return f"SELECT conv_id, {d.size(d.all('t', '<M id=[0-9]+>', 0))} AS blocks FROM (SELECT conv_id, {d.join(d.items(block, 'turn'), ' ')} AS t FROM conversations GROUP BY conv_id) x"


@plan
def token_count(d):
    return "SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, cast(floor(length(text) / 4) as bigint)) END AS n_tokens FROM documents"


@plan
def token_tail(d):
    return "SELECT doc_id, right(text, 32) AS tail FROM documents"
