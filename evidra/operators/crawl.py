"""Breadth-first crawls over a table of links, for many sources at once.

A round takes the pages that the last one queued, joins them to their links, and queues those that no round has
seen, in the order in which a queue would meet them: by the place of the page that names them first, then by the
place on it. What is known is a written table; a round adds to it, so a lost machine costs a round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from evidra.functions import urls as U
from evidra.sources.shared import shared_folder, written

#: Fixed value: pages that a crawl visits where nothing else is said.
MOST_PAGES = 512


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(page, pos, link): each page itself, then the pages of its host and hosts below that it links to, canonical, each once."""
    page = pages.select(U.canonical(F.col(url)).alias("page"), F.col(url).alias("base"), U.hrefs(F.col(html)).alias("h"))
    links = page.select("page", "base", F.posexplode("h").alias("i", "href")).select("page", "base", "i", U.resolved(F.col("base"), F.col("href")).alias("to"))
    links = links.where(U.internal(F.col("base"), F.col("to"))).select("page", (F.col("i") + 1).alias("pos"), U.canonical(F.col("to")).alias("link"))
    own = page.select("page", F.lit(0).alias("pos"), F.col("page").alias("link"))
    return own.unionByName(links).groupBy("page", "link").agg(F.min("pos").alias("pos")).select("page", "pos", "link")


def crawled(links: DataFrame, sources: DataFrame, allowed: Callable[[Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Visited pages (source, url, depth, place) and links met (source, link, depth, parent, pos) of every source.

    ``links``: (page, pos, link), canonical. ``sources``: (source, home, max_depth, max_pages) and whatever ``allowed``
    reads, which is given ``F.col("source")``-side columns by name and the link; ``max_depth`` null is no bound. Once
    ``max_pages`` are queued, a page's links count up to the first one that would have been queued, as for a queue that
    is full. Both are ordered by (depth, place) and (depth, parent, pos); a page without links links to itself.
    """
    spark = links.sparkSession
    base = sources.withColumn("home", U.canonical(F.col("home")))
    root, met_root = shared_folder(spark, "crawl-known"), shared_folder(spark, "crawl-met")
    known_schema, met_schema = None, None
    first = base.select("source", F.col("home").alias("url"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("place"))
    first.write.parquet(f"{root}/r-0")
    known_schema = first.schema
    read = lambda at, schema: spark.read.schema(schema).parquet(at)
    most = base.agg(F.max("max_pages")).first()[0] or 0
    depth, front = 0, read(f"{root}/r-0", known_schema)
    while True:
        known = read(f"{root}/r-*", known_schema)
        out = front.join(links, front["url"] == links["page"], "left").select("source", F.col("place").alias("parent"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("link", "url").alias("link"))
        out = out.join(base, "source").where(allowed(F.col("home"), F.col("link"))).select("source", "parent", "pos", "link", (F.col("max_depth").isNull() | (F.col("max_depth") > depth)).alias("deeper"))
        out = written(out, "crawl-links")
        seen = known.select("source", F.col("url").alias("link"))
        fresh = out.where("deeper").groupBy("source", "link").agg(F.min(F.struct("parent", "pos")).alias("at")).join(seen, ["source", "link"], "left_anti")
        room = base.join(known.groupBy("source").agg(F.count(F.lit(1)).alias("held")), "source").select("source", (F.col("max_pages") - F.col("held")).alias("room"))
        ranked = fresh.withColumn("n", F.row_number().over(W.partitionBy("source").orderBy("at"))).where(F.col("n") <= int(most))
        queued = ranked.join(room, "source").where("n <= room").select("source", F.col("link").alias("url"), F.lit(depth + 1).alias("depth"), F.col("n").cast("long").alias("place"))
        queued.write.parquet(f"{root}/r-{depth + 1}")
        front = read(f"{root}/r-{depth + 1}", known_schema)
        beyond = fresh.select("source", "link").join(front.select("source", F.col("url").alias("link")), ["source", "link"], "left_anti")
        cut = out.where("deeper").join(beyond, ["source", "link"]).groupBy("source", "parent").agg(F.min("pos").alias("cut"))
        met = out.join(cut, ["source", "parent"], "left").where("cut is null or pos <= cut").groupBy("source", "link").agg(F.min(F.struct("parent", "pos")).alias("at"))
        met = met.select("source", "link", F.lit(depth).alias("depth"), "at.parent", "at.pos")
        met.write.parquet(f"{met_root}/r-{depth}")
        met_schema = met.schema
        depth += 1
        if front.isEmpty():
            break
    every = read(f"{met_root}/r-*", met_schema).groupBy("source", "link").agg(F.min(F.struct("depth", "parent", "pos")).alias("at"))
    return read(f"{root}/r-*", known_schema), every.select("source", "link", "at.*")


def internal_crawl(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, link, depth, parent, pos) of the subtree of each home, the home first where no page links to it."""
    _, met = crawled(links, sources, U.in_subtree)
    home = sources.select("source", U.canonical(F.col("home")).alias("link")).where(U.in_subtree(F.col("link"), F.col("link")))
    missing = home.join(met, ["source", "link"], "left_anti").select("source", "link", F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("parent"), F.lit(0).alias("pos"))
    return met.unionByName(missing)


#: Parts of paths where addresses don't stay.
UNSTABLE = ("/blog", "/blogs", "/community", "/communities", "/discuss", "/discussion", "/forum", "/forums", "/issues", "/pull", "/pulls", "/news")


def source_crawl(links: DataFrame, register: DataFrame) -> DataFrame:
    """(source, url, depth, place) of registered sources (source, home, max_depth, max_pages, domains, prefixes, excluded)."""
    fits = lambda url: U.of_source(url, F.col("domains"), F.col("prefixes"), F.col("excluded"), UNSTABLE)
    home = register.withColumn("home", U.canonical(F.col("home"))).where(fits(F.col("home")) & (F.col("max_pages") > 0))
    visited, _ = crawled(links, home, lambda _, link: fits(link))
    return visited
