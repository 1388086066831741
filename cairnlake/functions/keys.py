"""Column functions for identities, paths and digests. All of them stay inside Catalyst."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_fold(c: Column | str) -> Column:
    """Lower-cases A-Z only: identities fold ASCII and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def casefold(c: Column) -> Column:
    """Trimmed of all Unicode white space, lower-cased, with the few letters folded that lower case keeps apart."""
    plain = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.translate(F.replace(F.lower(plain), F.lit("ß"), F.lit("ss")), "ςſ", "σs")


def canonical_json(*fields: Column) -> Column:
    """One object with keys in the order given (pass them sorted), compact, UTF-8 kept, nulls written."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def stable_id(scope: str, kind: str, *parts: Column) -> Column:
    """scope.kind- and the first 20 hex digits of SHA-256 over the JSON list of the parts."""
    return F.concat(F.lit(f"{scope}.{kind}-"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 20))


def piped_id(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts joined by pipes."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def hex_ref(c: Column | str) -> Column:
    return F.format_string("0x%08x", F.col(c) if isinstance(c, str) else c)


def identifier_ok(c: Column, scope: str, longest: int = 160) -> Column:
    """Lower-case words of letters and digits joined by dots, colons and dashes, of bounded length, in a scope."""
    return c.rlike(r"^[a-z0-9]+(?:[.:-][a-z0-9]+)*\z") & (F.length(c) <= longest) & c.startswith(scope + ".")


def normalize_path(c: Column) -> Column:
    """struct<path, error>: forward slashes, no `.` or empty parts, folded; null path and a reason for what leaves the root."""
    s = F.replace(c, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(s, "/"), lambda p: (p != "") & (p != "."))
    error = (
        F.when(c.isNull(), "null").when(s.startswith("/"), "absolute").when(s.rlike("^[A-Za-z]:"), "drive")
        .when(F.instr(c, "\0") > 0, "nul").when(F.exists(parts, lambda p: p == ".."), "parent").when(F.size(parts) == 0, "empty")
    )
    return F.struct(F.when(error.isNull(), ascii_fold(F.array_join(parts, "/"))).alias("path"), error.alias("error"))


def strip_prefix(c: Column, prefix: str, only_if: Column | None = None) -> Column:
    hit = c.startswith(prefix) if only_if is None else c.startswith(prefix) & only_if
    return F.when(hit, F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def path_problem(c: Column, suffixes: tuple[str, ...] = (), folders: tuple[str, ...] = ()) -> Column:
    """The first reason why a relative path must not be published, or null."""
    parts = F.split(c, "/")
    return (
        F.when(c.isNull() | (c == ""), "empty").when(c.startswith("/"), "absolute").when(c.contains("\\"), "backslash")
        .when(c.rlike(r"[\x00-\x1f\x7f]"), "control").when(c.rlike("^[A-Za-z]:"), "drive")
        .when(F.exists(parts, lambda p: (p == "..") | (p == ".") | (p == "")), "dots")
        .when(F.lit(False) if not suffixes else F.lower(c).rlike("(?:" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"), "suffix")
        .when(F.lit(False) if not folders else F.exists(parts, lambda p: p.isin(*folders)), "folder")
    )
