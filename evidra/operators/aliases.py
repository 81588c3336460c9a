"""Aliases in texts: token equi-join for candidates, the bounded literal for what they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
#: Bytes of aliases that go to all tasks.
SENT = 8 << 20


def alias_scan(docs: DataFrame, aliases: DataFrame, key: str = "doc_id", text: str = "text", alias: str = "alias") -> DataFrame:
    """(key, alias) of every alias that stands in the text as a literal between other characters than A-Z, a-z and 0-9.

    Case doesn't count; aliases come out trimmed and in small letters. A literal so bounded has whole tokens only, so
    its first token is one of the text's: these join. Aliases of other than one bare token are then looked for
    themselves, and those without any token in every text. Aliases of ``SENT`` bytes at most are sent to all tasks;
    more are joined to the tokens alone, and texts come to what is left to be looked for.
    """
    a = aliases.select(F.lower(F.regexp_replace(alias, r"^\s+|\s+$", "")).alias("alias")).where("alias <> ''").distinct()
    a = a.withColumn("first", F.regexp_extract("alias", TOKEN, 0))
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("low")).where("low is not null")
    first = F.explode(F.array_distinct(F.concat(F.regexp_extract_all("low", F.lit(TOKEN), F.lit(0)), F.array(F.lit(""))))).alias("first")
    literal = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("alias"), F.lit(r"\E(?![a-z0-9])"))  # small letters hold no \E
    bare = F.col("alias") == F.col("first")
    if (a.agg(F.sum(F.octet_length("alias"))).first()[0] or 0) <= SENT:
        found = low.select("key", "low", first).join(F.broadcast(a), "first").where(bare | F.rlike("low", literal))
        return found.select(F.col("key").alias(key), "alias")
    hits = low.select("key", F.xxhash64("low").alias("h"), first).join(a, "first")
    texts = low.distinct().select(F.col("key").alias("k"), F.xxhash64("low").alias("g"), "low")
    looked = hits.where(~bare).join(texts, F.col("key").eqNullSafe(F.col("k")) & (F.col("h") == F.col("g"))).where(F.rlike("low", literal))
    return hits.where(bare).select(F.col("key").alias(key), "alias").unionByName(looked.select(F.col("key").alias(key), "alias"))
