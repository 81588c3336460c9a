"""Tickets of a paged source, crawls, joins by place and other ways in, over the driver's tables, with SQL of their own."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import pages as G
from evidra.functions import urls as U
from evidra.operators import crawl as C
from evidra.operators import positions as P
from evidra.operators import ticket_documents as D
from evidra.sources import tickets as T
from evidra.sources.shared import shared_folder
from evidra.streaming import tickets as W
from evidra.streaming.streams import events_stream


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ticket_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a service's tickets, exported by day and read back page by page, with filters that the service answers."""
    e = _t(spark, sf_dir, "events")
    at = shared_folder(spark, "tickets")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    status = F.when(F.col("event_type") == "error", "Open").otherwise("Resolved")
    row = F.to_json(F.struct(F.concat(F.lit("EV-"), F.col("event_id")).alias("key"), stamp.alias("created"), status.alias("status"), F.concat("event_type", F.lit(" of user "), "user_id").alias("summary"), F.struct("value").alias("fields")))
    # a day in eight files, so that days with many events are written by several tasks; JSON is made where it is written
    dealt = e.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    dealt.select(row.alias("value"), "day").write.partitionBy("day").text(at)
    got = T.read(spark, T.Export(at), words=["purchase", "click"], start="2024-01-05", windowDays=3, pageSize=500)
    got = got.where((F.col("created") < "2024-01-20 12:00:00") & ~F.col("key").isin("EV-1000", "EV-2000"))
    return got.select("key", "status", "summary", F.get_json_object("fields", "$.value").cast("double").alias("value"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_links(_t(spark, sf_dir, "pages"))


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


def page_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first page of each language, four links deep. A word of a menu leads to the first page that has it there, every second one to the last."""
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), U.hrefs(F.col("html")).alias("h"))
    name = lambda c: F.concat(F.lit("https://site.example/p/"), c.cast("string"))
    words = pages.select("page_id", F.posexplode("h").alias("pos", "word"))
    known = words.groupBy("word").agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"))
    to = F.when(F.col("pos") % 2 == 0, F.col("low")).otherwise(F.col("high"))
    links = words.join(known, "word").groupBy(name(F.col("page_id")).alias("page"), name(to).alias("link")).agg(F.min("pos").alias("pos"))
    home = pages.groupBy(F.col("lang").alias("source")).agg(name(F.min("page_id")).alias("home"), F.lit(4).alias("max_depth"), F.lit(1 << 30).alias("max_pages"))
    return C.internal_crawl(links.select("page", "pos", "link"), home).select("source", "link", "depth")


def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date beside orders by price: the two tables have no key in common but the place."""
    o = _t(spark, sf_dir, "orders")
    a = P.row_index(o.select("o_orderkey"), [F.col("o_orderkey")])
    b = P.row_index(o.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")])
    return P.joined_by_place(a, b).select("place", "o_orderkey", "o_orderkey_right", "o_totalprice")


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", G.to_markdown(F.col("html")).alias("markdown"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_chunks(_t(spark, sf_dir, "pages"), "page_id", "html", 500)


def stream_open_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as messages of a ticket that a purchase resolves, or twelve hours without any close."""
    e = events_stream(spark, sf_dir).select(F.col("user_id").alias("ticket"), "ts", F.col("event_id").cast("string").alias("text"), (F.col("event_type") == "purchase").alias("resolves"))
    out = shared_folder(spark, "open-tickets")
    W.run(e, 12 * 3_600_000, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(W.CLOSED).parquet(f"{out}/out")


def ticket_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw tickets: the first turn describes, the others are comments; every third is resolved a day after it came."""
    leaf = lambda t: F.struct(F.lit("doc").alias("type"), F.array(F.struct(F.lit("paragraph").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce(t, F.lit("")).alias("text"))).alias("content"))).alias("content"))
    who = lambda c: F.struct(c.alias("emailAddress"))
    user, desk = F.concat(F.lit("user"), F.col("conv_id"), F.lit("@x.org")), F.lit("desk@x.org")
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    comment = lambda x: F.struct(who(F.when(x["role"] == "assistant", desk).otherwise(user)).alias("author"), leaf(x["text"]).alias("body"))
    rest = F.transform(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), comment)
    day = lambda n: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 300).cast("int") + n), "yyyy-MM-dd'T'HH:mm:ss'.000+0000'")
    fields = F.struct(
        F.concat(F.lit("Ticket of "), user).alias("summary"), leaf(F.col("t")[0]["text"]).alias("description"), F.struct(F.when(F.col("conv_id") % 3 == 0, "Resolved").otherwise("Open").alias("name")).alias("status"), day(0).alias("created"),
        F.when(F.col("conv_id") % 3 == 0, day(1)).alias("resolutionDate"), who(desk).alias("assignee"), who(user).alias("creator"), who(user).alias("reporter"), F.struct(rest.alias("comments")).alias("comment"),
    )
    raw = turns.select(F.concat(F.lit("DEMO-"), "conv_id").alias("key"), F.to_json(fields).alias("fields"))
    return D.documents(raw).select("key", "text", "markdown", "resolved_at", "time_to_resolution", "status")


QUERIES = {f.__name__: f for f in (ticket_documents, stream_open_tickets, html_markdown, page_chunks, ticket_pages, page_links, url_canonical, page_crawl, positional_join)}
_HREF = "'(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1"
_CANON = "regexp_replace(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1), '^.*$', lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1))) || CASE WHEN regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE rtrim(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') END || regexp_extract(u, '^[^#]*?([?][^#]*)?(#|$)', 1)"
_TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_DAY = "strftime(DATE '2024-01-01' + (conv_id % 300)::INT + {}, '%Y-%m-%dT00:00:00.000+0000')"
_MARKDOWN = "concat('# Ticket ', key, chr(10), chr(10), '- Summary: ', summary, chr(10), '- Status: ', status, chr(10), '- Created: ', created, chr(10), '- Resolved: ' || resolved_at || chr(10), chr(10), '## Initial Description', chr(10), chr(10), CASE WHEN tidy = '' THEN '_No description provided._' ELSE tidy END, chr(10), chr(10), '## Conversation', chr(10), coalesce(told, chr(10) || '_No comments._'))"
SQL = {
    "ticket_documents": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, coalesce(text, '') || chr(10) AS body, CASE WHEN role = 'assistant' THEN 'HELPDESK_ASSIGNEE' ELSE 'TICKET_CREATOR' END AS who FROM conversations), "
    f"m AS (SELECT *, regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS stripped, {_TIDY.format('body')} AS tidy FROM t), "
    "c AS (SELECT conv_id, coalesce(string_agg('<MESSAGE id=' || lpad(i::VARCHAR, 4, '0') || ' role=' || who || '>' || chr(10) || stripped || chr(10) || '</MESSAGE>' || chr(10) || chr(10), '' ORDER BY i) FILTER (WHERE i > 0), '') AS said, "
    "string_agg(chr(10) || '### Message ' || lpad(i::VARCHAR, 4, '0') || ' (' || who || ')' || chr(10) || chr(10) || CASE WHEN tidy = '' THEN '_Empty message._' ELSE tidy END, chr(10) ORDER BY i) FILTER (WHERE i > 0) AS told, max(body) FILTER (WHERE i = 0) AS body, max(tidy) FILTER (WHERE i = 0) AS tidy FROM m GROUP BY conv_id), "
    f"d AS (SELECT *, 'DEMO-' || conv_id AS key, CASE WHEN conv_id % 3 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, 'Ticket of user' || conv_id || '@x.org' AS summary, {_DAY.format(0)} AS created, CASE WHEN conv_id % 3 = 0 THEN {_DAY.format(1)} END AS resolved_at FROM c) "
    "SELECT key, status, resolved_at, CASE WHEN resolved_at IS NOT NULL THEN 86400.0::DOUBLE END AS time_to_resolution, "
    "'<BEGIN_TICKET>' || chr(10) || '[TICKET_KEY] ' || key || chr(10) || '[STATUS] ' || status || chr(10) || '[CREATED] ' || created || chr(10) || '[SUMMARY] ' || summary || chr(10) || chr(10) || '[INITIAL_DESCRIPTION]' || chr(10) || body || chr(10) || chr(10) || '[CONVERSATION]' || chr(10) || said || '<END_TICKET>' AS text, "
    f"{_TIDY.format(_MARKDOWN)} AS markdown FROM d",
    "stream_open_tickets": "WITH e AS (SELECT user_id::VARCHAR AS ticket, epoch_us(ts) AS us, event_id::VARCHAR AS text, event_type = 'purchase' AS done FROM events), "
    "b AS (SELECT *, CASE WHEN lag(done) OVER w OR us - lag(us) OVER w >= 43200000000 THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY ticket ORDER BY us, text)), "
    "s AS (SELECT *, sum(cut) OVER (PARTITION BY ticket ORDER BY us, text) AS n FROM b), "
    "g AS (SELECT ticket, n, bool_or(done) AS done, max(us) AS last, max(n) OVER (PARTITION BY ticket) AS final FROM s GROUP BY ticket, n) "
    "SELECT ticket, row_number() OVER (PARTITION BY ticket, n ORDER BY us, text) - 1 AS seq, us AS \"at\", text, CASE WHEN g.done THEN 'resolved' ELSE 'timed_out' END AS outcome "
    "FROM s JOIN g USING (ticket, n) WHERE g.done OR g.n < final OR g.last // 1000 + 43200000 <= (SELECT max(us) // 1000 FROM e)",
    "ticket_pages": "SELECT 'EV-' || event_id AS key, CASE WHEN event_type = 'error' THEN 'Open' ELSE 'Resolved' END AS status, event_type || ' of user ' || user_id AS summary, value FROM events WHERE event_type IN ('purchase', 'click') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20 12:00:00' AND event_id NOT IN (1000, 2000)",
    "url_canonical": f"SELECT page_id, {_CANON} AS canonical FROM (SELECT page_id, trim(url) AS u FROM pages)",
    "page_links": f"WITH p AS (SELECT url, {_CANON} AS page, regexp_extract(url, '^[A-Za-z]+://[^/?#]*', 0) AS own, regexp_extract_all(html, {_HREF}) AS h FROM (SELECT url, html, trim(url) AS u FROM pages)), "
    f"l AS (SELECT page, 0 AS pos, page AS link FROM p UNION ALL SELECT page, pos, {_CANON} FROM (SELECT page, own || h[i] AS u, i AS pos FROM (SELECT page, own, h, unnest(range(1, len(h) + 1))::INT AS i FROM p))) SELECT page, min(pos) AS pos, link FROM l GROUP BY page, link",
    "page_crawl": f"WITH RECURSIVE p AS (SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract_all(html, {_HREF}) AS h FROM pages), w AS (SELECT page_id, unnest(h) AS word, unnest(range(len(h))) AS i FROM p), k AS (SELECT word, min(page_id) AS low, max(page_id) AS high FROM w GROUP BY 1), "
    "l AS (SELECT DISTINCT page_id AS a, CASE WHEN i % 2 = 0 THEN low ELSE high END AS b FROM w JOIN k USING (word)), home AS (SELECT lang, min(page_id) AS a FROM p GROUP BY 1), "
    "walk(lang, a, d) AS (SELECT lang, a, 0 FROM home UNION SELECT lang, l.b, d + 1 FROM walk JOIN l ON l.a = walk.a WHERE d < 4), visited AS (SELECT lang, a, min(d) AS d FROM walk GROUP BY 1, 2), "
    "met AS (SELECT lang, b, min(d) AS d FROM visited JOIN l USING (a) GROUP BY 1, 2 UNION ALL SELECT lang, a, d FROM visited WHERE a NOT IN (SELECT a FROM l) UNION ALL SELECT lang, a, -1 FROM home) "
    "SELECT lang AS source, 'https://site.example/p/' || b AS link, coalesce(min(d) FILTER (WHERE d >= 0), -1) AS depth FROM met GROUP BY 1, 2",
    "positional_join": "WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey AS o_orderkey_right, o_totalprice FROM orders) SELECT place, o_orderkey, o_orderkey_right, o_totalprice FROM a JOIN b USING (place)",
}
