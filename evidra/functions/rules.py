"""Rules that read facts from texts: status, partitions, modules, versions, scope families, personal data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of each status, the first that occurs counts.
STATUS = {
    "eol": r"(?i)\b(?:eol|end[- ]of[- ]life)\b",
    "legacy": r"(?i)\b(?:legacy|retired|deprecated)\b",
    "maintenance": r"(?i)\bmaintenance\b",
    "current": r"(?i)\b(?:current|recommended|supported)\b",
}
#: Where scheduler lines and prose name partitions, and words that are no names.
PARTITION_LINE = r"(?im)^\s*#SBATCH\s+(?:--partition(?:=|\s+)|-p\s+)([A-Za-z0-9][A-Za-z0-9_-]*)\b"
PARTITION_COMMAND = r"(?i)\b(?:sbatch|srun|salloc)\b[^\n#]*(?:--partition(?:=|\s+)|-p\s+)([A-Za-z0-9][A-Za-z0-9_-]*)\b"
PARTITION_LONG = r"(?i)\b([A-Za-z0-9][A-Za-z0-9_-]*-long)\b"
NO_PARTITIONS = ("partition", "partitions", "queue")
#: Module commands, and words that are no modules.
MODULE_LOAD = r"(?im)(?:^|&&|;)\s*(?:\$+\s*)?module\s+load\s+((?:[^\n#;&]|&[^\n#;&])+)"
#: Version numbers.
VERSION = r"(?i)\b(?:\d+\.\d+(?:\.\d+){0,2}(?:[-+_][A-Za-z0-9][A-Za-z0-9.+_-]*)?|r\d{4}[a-z])\b"
#: A family's names, and the names of its special variants.
FAMILIES: dict[str, tuple[str, ...]] = {
    "cclake": (r"\bcclake(?:-(?:himem|long))?\b", r"\bcascade\s+lake\b", "/cclake/", r"\blogin-cascadelake\b"),
    "icelake": (r"\bicelake(?:-(?:himem|long))?\b", r"\bice\s+lake\b", "/icelake/", r"\bdefault-icl\b", r"\blogin-icelake\b"),
    "sapphire": (r"\bsapphire(?:-(?:hbm|long))?\b", r"\bsapphire\s+rapid(?:s)?\b", "/sapphire/"),
    "ampere": (r"\bampere(?:-long)?\b", r"\ba100\b", "/ampere/", r"\bdefault-amp\b", r"\bwilkes3\b"),
    "pvc": (r"\bpvc\b", r"\bdawn\b"),
    "wbic": (r"\bwbic\b",),
}
SPECIAL: dict[str, tuple[str, ...]] = {
    "cclake": (r"\bcclake-(?:himem|long)\b",),
    "icelake": (r"\bicelake-(?:himem|long)\b",),
    "sapphire": (r"\bsapphire-(?:hbm|long)\b",),
    "ampere": (r"\bampere-long\b",),
}
#: Personal data, by kind.
PERSONAL = {
    "TICKET": r"\b[A-Z][A-Z0-9]{1,15}-\d+\b",
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE": r"(?<!\w)(?:\+?\d[\d().\-\s]{6,}\d)(?!\w)",
    "USER": r"(?i)(?:/home|/users|/user|/rds/user|/rds/project)/([A-Za-z][A-Za-z0-9._-]{1,31})(?=/)",
    "ACCOUNT": r"(?i)\b(?:crsid|username|login|account)\b\s*[:=]?\s*([A-Za-z](?:[A-Za-z0-9._-]{0,30}[A-Za-z0-9])?)\b",
    "IDENTIFIER": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}
GROUPED = {"USER", "ACCOUNT"}
PREFIX = {"ACCOUNT": "USER"}
IPV4 = r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b"
PATH = r"(?:^|\W)/(?:[A-Za-z0-9._-]+/)+[A-Za-z0-9._-]+"


def status(text: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(STATUS.items()):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def found(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def partitions(text: Column, no: Sequence[str] = NO_PARTITIONS) -> Column:
    """Sorted distinct partition names: of scheduler lines, the last one a command names, and ``-long`` names in lines that mention one."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.lower(x).contains("partition") | F.lower(x).contains("-long"))
    names = F.concat(found(text, PARTITION_LINE, 1), found(text, PARTITION_COMMAND, 1), F.flatten(F.transform(lines, lambda x: found(x, PARTITION_LONG, 1))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin(*no))))


def modules(text: Column) -> Column:
    """Distinct tokens of ``module load`` commands, in order, without switches."""
    tokens = F.flatten(F.transform(found(text, MODULE_LOAD, 1), lambda x: F.split(F.trim(F.substring_index(x, "&&", 1)), r"[\s,]+")))
    clean = F.transform(tokens, lambda x: F.regexp_replace(x, "^[`'\"()\\[\\]{}]+|[`'\"()\\[\\]{}]+$", ""))
    return F.array_distinct(F.filter(clean, lambda x: (x != "") & ~x.startswith("-")))


def versions(text: Column) -> Column:
    """Distinct versions in order."""
    return F.array_distinct(found(text, VERSION, 0))


def families(text: Column, rules: Mapping[str, Sequence[str]] = FAMILIES) -> Column:
    """Names of the rules of which any pattern occurs; one pass over the text's column."""
    return F.filter(F.array(*[F.when(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), F.lit(name)) for name, ps in rules.items()]), lambda x: x.isNotNull())


def privacy_flags(text: Column) -> Column:
    rules = {"email": PERSONAL["EMAIL"], "ip": IPV4, "path": PATH}
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in rules.items()]), lambda x: x.isNotNull())


#: Fixed value: what aliases look like; a value that holds one gets none.
VISIBLE = r"\b(?:TICKET|DOC|PERSON|EMAIL|PHONE|USER|PROJECT|ACCOUNT|ORG|LOCATION|IDENTIFIER|SENSITIVE_INFO)_\d+\b"


def personal(text: Column, ids: Column | None = None) -> Column:
    """Array of (value, alias): each value once, under its first kind; a kind's values are numbered by their first places in the text.

    ``ids``, if given, are tickets already known, the first to be numbered.
    """
    text = F.coalesce(text, F.lit(""))
    groups = {prefix: [k for k in PERSONAL if PREFIX.get(k, k) == prefix] for prefix in dict.fromkeys(PREFIX.get(k, k) for k in PERSONAL)}
    none = F.array().cast("array<string>")
    known = F.array_distinct(F.filter(F.transform(F.coalesce(ids, none), lambda v: F.trim(v)), lambda v: v != "")) if ids is not None else none
    # every kind's values are found once, then named
    raw = F.struct(text.alias("text"), known.alias("known"), *[F.concat(*[F.transform(found(text, PERSONAL[k], int(k in GROUPED)), lambda v: F.trim(v)) for k in kinds]).alias(prefix) for prefix, kinds in groups.items()])

    def named(r: Column) -> Column:
        seen, out = r["known"], F.array().cast("array<struct<value:string,alias:string>>")
        for prefix in groups:
            fresh = F.array_except(F.filter(r[prefix], lambda v: (v != "") & ~v.rlike(VISIBLE)), seen)
            placed = F.transform(F.array_sort(F.transform(fresh, lambda v, i: F.struct(F.instr(r["text"], v).alias("at"), i.alias("i"), v.alias("v")))), lambda x: x["v"])
            ordered = F.concat(r["known"], placed) if prefix == "TICKET" else placed
            out = F.concat(out, F.transform(ordered, lambda v, i: F.struct(v.alias("value"), F.format_string(prefix + "_%03d", i + 1).alias("alias"))))  # noqa: B023
            seen = F.concat(seen, r[prefix])
        return out

    return F.element_at(F.transform(F.array(raw), named), 1)


def masked(text: Column, aliases: Column) -> Column:
    """The text with every value of ``aliases`` (value, alias) replaced, the longest first, between other characters than letters and digits."""
    ordered = F.array_sort(aliases, lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).when(a["value"] < b["value"], -1).when(a["value"] > b["value"], 1).otherwise(0))
    bare = lambda v: v.rlike(r"^(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|[A-Za-z0-9._-]+)$")
    literal = lambda v: F.concat(F.lit(r"\Q"), v, F.lit(r"\E"))
    pattern = lambda v: F.when(bare(v), F.concat(F.lit("(?<![A-Za-z0-9])"), literal(v), F.lit("(?![A-Za-z0-9])"))).otherwise(literal(v))
    return F.aggregate(ordered, text, lambda t, s: F.regexp_replace(t, pattern(s["value"]), s["alias"]))


def markdown_plain(text: Column) -> Column:
    """LF line ends, no white space before one, at most one empty line running, trimmed."""
    lines = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), r"[^\S\n]+(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\s+|\s+\z", "")
