"""Registry candidates in Markdown pages: partitions, modules and toolchains that their commands name."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions import rules as X
from evidra.functions.text import FENCE, md_sections
from evidra.functions.values import key_of

#: What makes an indented block a command, starts of lines that are one, and inline code.
COMMAND = r"\b(?:module|source|conda|sbatch|srun|salloc)\b|#SBATCH"
STARTS = ("$ ", "module ", "source ", "conda ", "sbatch ", "srun ", "salloc ", "#SBATCH")
INLINE = r"`([^`]+)`"
#: Words that are no modules, modules without version, modules that are legacy, and heads of toolchains.
NO_MODULES = ("#", "all", "basic", "cpu", "environment", "for", "load", "loads", "module", "partitions", "recommended", "required", "the")
BARE_MODULES = (
    "alphafold", "castep", "cuda", "cudnn", "gromacs", "intelpython-conda", "jupyter", "jupyterlab", "lammps", "matlab",
    "openfoam", "openmm", "pgi", "python", "pytorch", "r", "spack", "tensorflow", "turbovnc", "use.own",
)
LEGACY_MODULES = ("default-impi", "default-wilkes", "rhel7/default-peta4")
TOOLCHAINS = ("foss", "gompi", "intel", "cuda", "default", "oneapi", "gcccore", "nvhpc", "amp", "openmpi")
TOOLCHAIN_STARTS = ("default-", "cuda", "cudnn", "intelpython-conda")
_COMMAND, _INLINE = re.compile(COMMAND, re.IGNORECASE), re.compile(INLINE)
EVIDENCE = 400


def snippets_of(text: str | None) -> list[str]:
    """Fenced blocks, indented blocks that hold a command, lines that begin like one, and inline code."""
    out: list[str] = []
    block: list[str] = []
    fence: list[str] | None = None
    body = (text or "").replace("\r\n", "\n").replace("\r", "\n")

    def indented() -> None:
        whole = "\n".join(block).strip()
        block.clear()
        if _COMMAND.search(whole):
            out.append(whole)

    for line in body.split("\n"):
        bare = line.strip()
        if bare.startswith(FENCE):
            indented()
            if fence is None:
                fence = []
            else:
                out.append("\n".join(fence).strip())
                fence = None
        elif fence is not None:
            fence.append(line)
        elif line.startswith(("    ", "\t")):
            block.append(line[4:] if line.startswith("    ") else line.lstrip("\t"))
        else:
            indented()
            if bare.startswith(STARTS):
                out.append(bare)
    indented()
    return [s for s in [*out, *_INLINE.findall(body)] if s.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def snippets(texts: pd.Series) -> pd.Series:
    """Whether a line is in a fence depends on all lines before it, so this is no column expression."""
    return texts.map(snippets_of)


def command_lines(found: Column) -> Column:
    return F.flatten(F.transform(found, lambda s: F.split(s, "\n")))


def partitions(text: Column, lines: Column) -> Column:
    """Sorted names of scheduler lines in commands, and ``-long`` names in lines of the text that speak of partitions."""
    prose = F.filter(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.lower(x).contains("partition") | F.lower(x).contains("-long"))
    of = lambda arrays, pattern: F.flatten(F.transform(arrays, lambda x: X.found(x, pattern, 1)))
    names = F.concat(of(lines, X.PARTITION_LINE), of(lines, X.PARTITION_COMMAND), of(prose, X.PARTITION_LONG))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (key_of(x) != "") & ~key_of(x).isin(*X.NO_PARTITIONS))))


def modules(lines: Column) -> Column:
    """Sorted tokens of ``module load`` commands that look like modules."""
    raw = F.flatten(F.transform(lines, lambda x: X.found(x, r"(?i)\bmodule\s+load\s+(.*?)(?=\bmodule\s+load\s|$)", 1)))
    cut = F.transform(raw, lambda x: F.trim(F.substring_index(F.substring_index(F.substring_index(x, "&&", 1), ";", 1), "#", 1)))
    tokens = F.transform(F.flatten(F.transform(cut, lambda x: F.split(x, r"[\s,]+"))), lambda x: F.regexp_replace(x, "^[`'\"()\\[\\]{}]+|[`'\"()\\[\\]{}]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda x: like_module(x))))


def like_module(x: Column) -> Column:
    low = F.lower(x)
    shaped = x.contains("/") | x.contains(".") | x.rlike(r"\d") | low.isin(*BARE_MODULES) | (x.contains("-") & ~x.rlike(r"^\p{L}+$"))
    return (x != "") & ~x.startswith("-") & ~low.isin(*NO_MODULES) & ~(x.startswith("<") & x.endswith(">")) & ~x.rlike(r"[()]") & shaped


def toolchain(module: Column) -> Column:
    low = F.lower(module)
    starts = F.lit(False)
    for s in TOOLCHAIN_STARTS:
        starts = starts | low.startswith(s)
    return (low.startswith("rhel") & module.contains("/")) | starts | F.substring_index(low, "/", 1).isin(*TOOLCHAINS)


def versions(module: Column) -> Column:
    """Parts of a module's name that are dotted numbers, with or without a suffix, or a year with a letter."""
    return F.array_sort(F.array_distinct(F.filter(F.split(module, "/"), lambda x: x.rlike(r"^(?:\d+(?:\.\d+)+(?:[-+_][A-Za-z0-9][A-Za-z0-9.+_-]*)?|[rR]?\d{4}[a-z])$"))))


def registry_candidates(pages: DataFrame, key: str, text: str, title: str, scope: str = "local_official") -> DataFrame:
    """Candidates (``registry.CANDIDATE``) of the sections of Markdown pages.

    A partition is current unless its section says otherwise; a module's status is what its section says, and some
    are legacy by name. Pages without commands give none.
    """
    sections = md_sections(pages, key, text).withColumnRenamed("text", "body").join(pages.select(key, F.col(title).alias("doc_title")), key)
    rows = sections.withColumn("lines", command_lines(snippets("body"))).withColumn("said", X.status(F.col("body"))).withColumn("m", modules(F.col("lines")))
    item = lambda kind, name, aliases, known, status, method: F.struct(F.lit(kind).alias("entity_type"), name.alias("canonical_name"), aliases.alias("aliases"), known.alias("known_versions"), status.alias("status"), F.lit(method).alias("extraction_method"))
    none = F.array().cast("array<string>")
    said = F.col("said")
    legacy = lambda x: F.when(key_of(x).isin(*[re.sub("[^a-z0-9]+", " ", n) for n in LEGACY_MODULES]), "legacy").otherwise(said)
    found = F.concat(
        F.transform(partitions(F.col("body"), F.col("lines")), lambda x: item("partition", x, F.array(x), none, F.when(said == "unknown", "current").otherwise(said), "partition_parse")),
        F.transform("m", lambda x: item("module", x, F.array(F.lower(x)), versions(x), legacy(x), "module_load_parse")),
        F.transform(F.filter("m", toolchain), lambda x: item("toolchain", x, F.array(F.lower(x)), versions(x), legacy(x), "toolchain_parse")),
    )
    each = rows.select(key, "doc_title", "heading_path", "body", F.explode(found).alias("x"))
    return each.select(
        F.lit(scope).alias("source_scope"), "x.entity_type", "x.canonical_name", "x.aliases", "x.known_versions", "x.status", F.col(key).cast("string").alias("doc_id"), "doc_title", "heading_path",
        F.substring("body", 1, EVIDENCE).alias("evidence_text"), "x.extraction_method",
    )
