"""The few spellings in which Spark SQL and the oracle's SQL differ, so a plan is stated once."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    lit = staticmethod(lambda p: "r'" + p + "'")
    size = staticmethod(lambda a: f"cast(size({a}) as bigint)")
    join = staticmethod(lambda a, s: f"array_join({a}, '{s}')")
    items = staticmethod(lambda x, order: f"transform(array_sort(collect_list(struct({order} as o, {x} as x))), e -> e.x)")
    sort = staticmethod(lambda a: f"array_sort({a})")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    each = staticmethod(lambda a, v, e: f"transform({a}, {v} -> {e})")
    keep = staticmethod(lambda a, v, e: f"filter({a}, {v} -> {e})")
    both = staticmethod(lambda a, b: f"array_intersect({a}, {b})")
    without = staticmethod(lambda a, b: f"array_except({a}, {b})")
    overlap = staticmethod(lambda a, b: f"arrays_overlap({a}, {b})")
    unnest = staticmethod(lambda a, t, x: f"LATERAL VIEW explode({a}) {t} AS {x}")
    pct = staticmethod(lambda x, p: f"percentile({x}, {p})")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    epoch = staticmethod(lambda t: f"unix_timestamp({t})")
    span = staticmethod(lambda a, b: f"sequence({a}, {b})")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    prop = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    even = staticmethod(lambda x: f"bround({x})")
    number = staticmethod(lambda x: f"try_cast({x} as double)")
    at = staticmethod(lambda a, i: f"try_element_at({a}, {i})")
    #: Padded numbers keep all their digits.
    padded = staticmethod(lambda x, n: f"CASE WHEN {x} IS NOT NULL THEN format_string('%0{n}d', {x}) END")

    @classmethod
    def rr(cls, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {cls.lit(p)}, {cls.lit(r)})"

    @classmethod
    def first(cls, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract({x}, {cls.lit(p)}, {g})"

    @classmethod
    def all(cls, x: str, p: str, g: int = 0) -> str:
        return f"regexp_extract_all({x}, {cls.lit(p)}, {g})"

    @classmethod
    def has(cls, x: str, p: str) -> str:
        return f"({x} rlike {cls.lit(p)})"


class Duck(Spark):
    lit = staticmethod(lambda p: "'" + p + "'")
    size = staticmethod(lambda a: f"len({a})::BIGINT")
    join = staticmethod(lambda a, s: f"array_to_string({a}, '{s}')")
    items = staticmethod(lambda x, order: f"list({x} ORDER BY {order})")
    sort = staticmethod(lambda a: f"list_sort({a})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    each = staticmethod(lambda a, v, e: f"list_transform({a}, lambda {v}: {e})")
    keep = staticmethod(lambda a, v, e: f"list_filter({a}, lambda {v}: {e})")
    both = staticmethod(lambda a, b: f"list_intersect({a}, {b})")
    without = staticmethod(lambda a, b: f"list_filter({a}, lambda zz: NOT list_contains({b}, zz))")
    overlap = staticmethod(lambda a, b: f"list_has_any({a}, {b})")
    unnest = staticmethod(lambda a, t, x: f", unnest({a}) AS {t}({x})")
    pct = staticmethod(lambda x, p: f"quantile_cont({x}, {p})")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    epoch = staticmethod(lambda t: f"floor(epoch({t}))::BIGINT")
    span = staticmethod(lambda a, b: f"generate_series({a}, {b})")
    sha = staticmethod(lambda x: f"sha256({x})")
    prop = staticmethod(lambda x, k: f"({x}::JSON->>'$.{k}')")
    even = staticmethod(lambda x: f"round_even({x}, 0)")
    at = staticmethod(lambda a, i: f"list_extract({a}, {i})")
    padded = staticmethod(lambda x, n: f"CASE WHEN {x} IS NOT NULL THEN printf('%0{n}d', cast({x} as bigint)) END")
    number = staticmethod(lambda x: f"try_cast({x} as double)")

    @classmethod
    def rr(cls, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, '{p}', '{r.replace('$', chr(92))}', 'g')"

    @classmethod
    def has(cls, x: str, p: str) -> str:
        return f"regexp_matches({x}, '{p}')"


def ran(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).createOrReplaceTempView(t)
    return spark.sql(sql)
