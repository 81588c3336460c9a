"""Answers and their evidence with what names people and tickets replaced, for a demonstration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import rules as X

#: Fixed value: the source whose evidence is tickets, whatever its ids look like.
TICKETS = "tickets"


def of_ticket(doc_id: Column, source: Column) -> Column:
    id_like = F.trim(F.coalesce(doc_id, F.lit(""))).rlike("^(?:" + X.PERSONAL["TICKET"] + ")$")
    return (F.lower(F.trim(F.coalesce(source, F.lit("")))) == TICKETS) | id_like


def anonymised(answers: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_id, answer), context and (query_id, value, alias) with aliases in place of what tickets give away.

    ``context``: query_id, rank, doc_id, text, source and any other columns; a query's evidence is as much as was
    retrieved for it. Only tickets are read for values and changed, and with them the answer; a query without tickets
    keeps its answer as it is. One value has one alias in a query: tickets by rank first, then each kind by its places.
    """
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    rows = context.withColumn("__ticket", of_ticket(F.col("doc_id"), F.col("source")))
    item = F.concat(F.lit("CONTEXT ITEM "), own("rank"), F.lit("\nDOC_ID: "), own("doc_id"), F.lit("\nSOURCE: "), own("source"), F.lit("\n"), strip(own("text")), F.lit("\n"))
    each = rows.where("__ticket").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("doc_id", F.lit("")).alias("doc_id"), item.alias("item")))).alias("c"))
    seen = strip(F.array_join(F.transform("c", lambda x: x["item"]), "\n"))
    named = each.select("query_id", X.personal(seen, F.transform("c", lambda x: x["doc_id"])).alias("__aliases"))
    none = F.array().cast("array<struct<value:string,alias:string>>")
    told = answers.join(named, "query_id", "left").withColumn("answer", X.masked(F.coalesce("answer", F.lit("")), F.coalesce("__aliases", none))).drop("__aliases")
    joined = rows.join(named, "query_id", "left").withColumn("__aliases", F.coalesce("__aliases", none))
    exact = F.get(F.filter("__aliases", lambda a: a["value"] == F.col("doc_id")), F.lit(0))["alias"]
    shown = joined.withColumns({
        "doc_id": F.when(F.col("__ticket"), F.coalesce(exact, X.masked(F.coalesce("doc_id", F.lit("")), F.col("__aliases")))).otherwise(F.col("doc_id")),
        "text": F.when(F.col("__ticket"), X.masked(F.coalesce("text", F.lit("")), F.col("__aliases"))).otherwise(F.col("text")),
    })
    return told, shown.select(*context.columns), named.select("query_id", F.inline("__aliases"))
