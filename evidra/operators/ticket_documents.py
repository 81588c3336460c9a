"""Raw tickets as documents: a transcript of marked messages, Markdown, and what is known about each.

A raw ticket is a key and a JSON text of its fields; descriptions and comments are rich-text trees in it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.tickets import comment_role, read_tree
from evidra.functions.values import seconds_between

_PERSON = "struct<emailAddress:string,displayName:string>"
#: Trees stay JSON texts until they are read.
FIELDS = (
    f"summary string, description string, status struct<name:string>, created string, updated string, resolutionDate string, assignee {_PERSON}, creator {_PERSON}, reporter {_PERSON}, "
    f"customfield_10042 array<{_PERSON}>, comment struct<comments:array<struct<author:{_PERSON},body:string,created:string>>>"
)


def tidy(text: Column) -> Column:
    """LF line ends, no blanks before one, at most one empty line running, trimmed."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")


def _trees(values: pd.Series) -> pd.Series:
    return values.map(lambda xs: [read_tree(x) for x in xs])


def documents(tickets: DataFrame, key: str = "key", fields: str = "fields") -> DataFrame:
    """(key, text, markdown, metadata columns) of raw tickets; a ticket whose fields are no JSON object has empty ones.

    ``text`` is the transcript between its markers; metadata are created_at, updated_at, resolved_at,
    time_to_resolution (seconds, null while unresolved), summary and status in capitals.
    """
    f = F.from_json(F.col(fields), FIELDS)
    rows = tickets.select(F.col(key).alias("key"), f.alias("f"))
    comments = F.coalesce(F.col("f.comment.comments"), F.array().cast(f"array<struct<author:{_PERSON},body:string,created:string>>"))
    read = F.pandas_udf(_trees, "array<string>")
    email = lambda c: F.col(f"f.{c}.emailAddress")
    investigator = F.get("f.customfield_10042", F.lit(0))["emailAddress"]
    rows = rows.withColumn("c", comments).withColumn("trees", read(F.concat(F.array(F.coalesce(F.col("f.description"), F.lit(""))), F.transform("c", lambda x: F.coalesce(x["body"], F.lit(""))))))
    role = lambda x: comment_role(x["author"]["displayName"], x["author"]["emailAddress"], email("assignee"), email("creator"), investigator, email("reporter"))
    bodies = F.transform(F.arrays_zip(F.transform("c", role).alias("role"), F.slice("trees", 2, F.greatest(F.size("trees") - 1, F.lit(0))).alias("body")), lambda x, i: F.struct(F.lpad((i + 1).cast("string"), 4, "0").alias("n"), x["role"].alias("role"), x["body"].alias("body"), (i + 1).alias("i")))
    rows = rows.withColumn("m", bodies)
    own = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    number = lambda x: F.when(F.length(x["i"].cast("string")) > 4, x["i"].cast("string")).otherwise(x["n"])
    status = F.upper(F.coalesce(F.col("f.status.name"), F.lit("")))
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    said = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<MESSAGE id="), number(x), F.lit(" role="), x["role"], F.lit(">\n"), strip(x["body"]), F.lit("\n</MESSAGE>\n\n"))), "")
    text = F.concat(
        F.lit("<BEGIN_TICKET>\n[TICKET_KEY] "), F.coalesce("key", F.lit("")), F.lit("\n[STATUS] "), status, F.lit("\n[CREATED] "), own("created"), F.lit("\n[SUMMARY] "), own("summary"),
        F.lit("\n\n[INITIAL_DESCRIPTION]\n"), F.col("trees")[0], F.lit("\n\n[CONVERSATION]\n"), said, F.lit("<END_TICKET>"),
    )
    line = lambda name, c: F.when(own(c) != "", F.concat(F.lit(f"- {name}: "), own(c)))
    filled = lambda x, other: F.when(x == "", other).otherwise(x)
    told = F.transform("m", lambda x: F.concat(F.lit("\n### Message "), number(x), F.lit(" ("), x["role"], F.lit(")\n\n"), filled(tidy(x["body"]), "_Empty message._")))
    head = F.array(F.concat(F.lit("# Ticket "), F.coalesce("key", F.lit(""))), F.lit(""), F.concat(F.lit("- Summary: "), own("summary")), F.concat(F.lit("- Status: "), status), F.concat(F.lit("- Created: "), own("created")), line("Updated", "updated"), line("Resolved", "resolutionDate"))
    about = F.array(F.lit("\n## Initial Description\n"), filled(tidy(F.col("trees")[0]), "_No description provided._"), F.lit("\n## Conversation"))
    markdown = tidy(F.array_join(F.concat(F.array_compact(head), about, F.when(F.size("m") == 0, F.array(F.lit("\n_No comments._"))).otherwise(told)), "\n"))
    return rows.select(
        F.col("key").alias(key), text.alias("text"), markdown.alias("markdown"), F.col("f.created").alias("created_at"), F.col("f.updated").alias("updated_at"), F.col("f.resolutionDate").alias("resolved_at"),
        seconds_between(F.col("f.created"), F.nullif(F.col("f.resolutionDate"), F.lit(""))).alias("time_to_resolution"), F.col("f.summary").alias("summary"), status.alias("status"),
    )
