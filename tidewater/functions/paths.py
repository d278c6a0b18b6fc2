"""Path expressions and predicates (columns in, columns out).  Case folding is always an argument."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "/\\"


def _fold(c: Column, ignore_case: bool) -> Column:
    return F.lower(c) if ignore_case else c


def under(path: Column, root: str, ignore_case: bool = False) -> Column:
    """The root itself, or anything below it; a root that ends in a separator allows its children."""
    p, r = _fold(path, ignore_case), root.lower() if ignore_case else root
    after = F.substring(p, len(r) + 1, 1)
    return F.startswith(p, F.lit(r)) & ((F.length(p) == len(r)) | F.lit(r[-1:] in SEPARATORS and r != "") | after.isin("/", "\\"))


def prefix_excluded(path: Column, prefix: str, ignore_case: bool = False) -> Column:
    """The path is the prefix, or goes on after it with a separator (a prefix that ends in one fits no child by this test)."""
    p, r = _fold(path, ignore_case), prefix.lower() if ignore_case else prefix
    return F.startswith(p, F.lit(r)) & ((F.length(p) == len(r)) | F.substring(p, len(r) + 1, 1).isin("/", "\\"))


def under_root(path: Column, root: str) -> Column:
    """A plain prefix test that ignores case."""
    return F.startswith(F.lower(path), F.lit(root.lower()))


def map_path(path: Column, base: str, dest: str) -> Column:
    """The path moved from under ``base`` to under ``dest``; null where it isn't under ``base``."""
    rest = F.ltrim(F.substr(path, F.lit(len(base) + 1)), F.lit(SEPARATORS))
    return F.when(under(path, base), F.when(rest == "", F.lit(dest)).otherwise(F.concat(F.lit(dest.rstrip(SEPARATORS) + "/"), rest)))


def relative(path: Column, root: str) -> Column:
    return F.when(under(path, root), F.ltrim(F.substr(path, F.lit(len(root) + 1)), F.lit(SEPARATORS))).otherwise(path)


def rebase(path: Column, old: str, new: str) -> Column:
    return F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^(.*?)(\.[^.]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1)


def extended_length(path: Column, limit: int = 240) -> Column:
    """Windows' long-path prefix, for long paths that lack it."""
    lead = "\\\\?\\"
    return F.when((F.length(path) > limit) & ~F.startswith(path, F.lit(lead)), F.concat(F.lit(lead), path)).otherwise(path)


def like_escape(text: Column) -> Column:
    for c in ("\\", "%", "_"):
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def segments(path: Column) -> Column:
    """Path segments without empty ones, "." and drive letters; null where ".." stands."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda s: (s != "") & (s != ".") & ~s.rlike("^[A-Za-z]:$"))
    return F.when(~F.array_contains(parts, F.lit("..")), parts)


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda d: d != "")


def glob_regex(pattern: str) -> str:
    """Anchored: * is any run (separators too), ? is one character, and separators are alike."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else r"[/\\]" if c in SEPARATORS else re.escape(c) for c in pattern) + "$"


def glob(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(("(?i)" if ignore_case else "") + glob_regex(pattern))


def excluded(path: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """A pattern fits the file name; one with a separator also the whole path, or its end after any directory."""
    hits = []
    for p in patterns:
        if not p:
            continue
        hits.append(glob(file_name(path), p, ignore_case))
        if any(c in p for c in SEPARATORS):
            hits += [glob(path, p, ignore_case), glob(path, "*/" + p, ignore_case)]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def size_allowed(size: Column, max_mb: float) -> Column:
    """A limit of zero or less, or an unknown size, keeps all."""
    return F.lit(True) if max_mb <= 0 else size.isNull() | (size <= int(max_mb * 1048576))


def all_pass(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def name_filter(display: Column, name: Column, spec: str) -> Column:
    """A bare word is a substring, * and ? make a glob; both ignore case and look at either text."""
    if any(c in spec for c in "*?"):
        return glob(display, spec, True) | glob(name, spec, True)
    return F.contains(F.lower(display), F.lit(spec.lower())) | F.contains(F.lower(name), F.lit(spec.lower()))


CONTROL = (".archive", ".versions", ".tidewater")


def control_file(rel: Column) -> Column:
    """Lock files, hold ledgers and the archive and version folders are never stale."""
    first = F.lower(F.regexp_extract(rel, r"^([^/\\]*)", 1))
    return first.isin(*CONTROL) | F.endswith(F.lower(rel), F.lit(".lock")) | F.endswith(F.lower(rel), F.lit(".holds"))


def shadow_diff(name: Column) -> Column:
    return name.rlike(r"^(\{[0-9A-Fa-f-]{8,}\})+$")


def sanitize_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def volume_label(text: Column) -> tuple[Column, Column]:
    """(label, rest) of "[Label]\\path"."""
    return F.regexp_extract(text, r"^\[([^\]]+)\]", 1), F.regexp_extract(text, r"^\[[^\]]+\][/\\]*(.*)$", 1)
