"""Metadata that a file's path carries, and patterns over paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed rules: the first whose parts all match the lower-cased path decides
MEMORY_RULES = [
    ("skill", {"contains": ["/aria/skills/"]}),
    ("semantic", {"endswith": ["/memory.md"], "contains": ["/aria/"]}),
    ("semantic", {"endswith": ["/soul.md"]}),
    ("semantic", {"endswith": ["/user.md"]}),
    ("procedural", {"endswith": ["/issues.md"], "contains": ["/aria/"]}),
    ("episodic", {"contains": ["/daily notes/"]}),
    ("episodic", {"contains": ["/periodic/daily/"]}),
    ("episodic", {"contains": ["/aria/messages/"]}),
    ("semantic", {"contains": ["/aria/contacts/"]}),
]


def memory_type(path: Column | str, rules=MEMORY_RULES) -> Column:
    """semantic, procedural, episodic, skill or null."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    out = None
    for kind, parts in rules:
        test = F.lit(True)
        for how, values in parts.items():
            for value in values:
                test = test & getattr(low, how)(value)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out if out is not None else F.lit(None).cast("string")


def file_date(path: Column | str) -> Column:
    """The file's stem if it has the shape of a date (ten bytes, hyphens fifth and eighth), else null; the digits aren't checked."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    stem = F.when(name.rlike("^.[^.]*$"), name).otherwise(F.regexp_replace(name, "\\.[^.]*$", ""))
    dated = (F.octet_length(stem) == 10) & (F.substring(stem, 5, 1) == "-") & (F.substring(stem, 8, 1) == "-")
    return F.when(dated, stem)


def like_of_glob(pattern: str) -> str:
    """A LIKE pattern of a glob: * and ? become % and _; % and _ in the glob stay wildcards."""
    return pattern.replace("*", "%").replace("?", "_")


def excluded(path: Column | str, globs: list[str]) -> Column:
    """Whether a path matches one of the globs (** crosses folders, * and ? don't)."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def glob_regex(glob: str) -> str:
    """A regular expression over whole paths for a glob."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if glob[i] in "\\.^$+{}[]|()" else "") + glob[i], i + 1
    return f"^{out}$"
