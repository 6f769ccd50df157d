"""Paths, globs and ignore patterns as Spark expressions. Patterns become anchored regexes when a plan is built."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def dir_name(path: Column) -> Column:
    """Folder of a path, '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """From the last dot of the whole path on, lower-cased; '' without a dot."""
    return F.lower(F.regexp_extract(path, r"\.[^.]*$", 0))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def clean_path(raw: str) -> str:
    """A clean relative path; ValueError for NUL, empty, absolute paths and those that leave the root."""
    if "\0" in raw:
        raise ValueError("path contains NUL")
    path = raw.replace("\\", "/").strip()
    if not path:
        raise ValueError("path is empty")
    path = posixpath.normpath(path)
    if path in (".", "..") or path.startswith(("../", "/")):
        raise ValueError(f"not a clean relative path: {raw!r}")
    return path


def clean_prefix(raw: str) -> str:
    """A deny prefix with a slash at either end; '/' for all. It can't name a single file."""
    if "\0" in raw:
        raise ValueError("prefix contains NUL")
    parts: list[str] = []
    for part in raw.replace("\\", "/").strip().split("/"):
        if part == "..":
            if not parts:
                raise ValueError("prefix leaves the root")
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/" + "".join(p + "/" for p in parts)


def cleaned(path: Column) -> Column:
    """clean_path for a column without `..` segments to resolve; null where it isn't valid."""
    p = F.regexp_replace(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))), r"/(\./|/)*", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^(\./)+", ""), r"(/\.?)$", "")
    bad = p.isNull() | (p == "") | (p == ".") | p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.contains("\0")
    return F.when(~bad, p)


def _segment(part: str) -> str:
    """Regex of one glob segment: *, ? and [classes] stay within it."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[i + 2 :]:
            end = part.index("]", i + 2)
            body = part[i + 1 : end]
            out += "[" + ("^/" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end
        elif c == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob over whole paths; `**` stands for any number of segments, none included."""
    parts = posixpath.normpath(pattern.replace("\\", "/")).split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            # a last ** may also stand for nothing, with the slash before it
            out = (out[:-1] + "(/.*)?" if out.endswith("/") else out + ".*") if last else out + "([^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Whether one of the globs matches; equality with a glob as written counts too. False without globs."""
    if not globs:
        return F.lit(False)
    return path.isin(*globs) | path.rlike("|".join(glob_regex(g) for g in globs))


def selected(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Subset selection: any include (all without includes), less any exclude."""
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)


def literal_prefix(glob: str) -> str:
    """What every match of a glob starts with; as `startswith` it prunes Parquet row groups."""
    return re.split(r"[*?\[\\]", glob, maxsplit=1)[0]


def glob_filter(path: Column, glob: str) -> Column:
    lead = literal_prefix(glob)
    exact = F.coalesce(path.rlike(glob_regex(glob)), F.lit(False))
    # `dir/**` also matches dir itself, which the prefix with its slash would lose
    return exact if not lead or glob.endswith("/**") and lead == glob[:-2] else path.startswith(lead) & exact


# Patterns that are always, or by default, left out, and names of secret files.
ALWAYS_IGNORED = [".git"]
DEFAULT_IGNORED = ["node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tpfs", ".next", ".nuxt", ".cache", ".DS_Store", "Thumbs.db", "*.pyc", "*.pyo", "*.o", "*.so", "*.dylib", "*.class"]
SECRET_NAMES = [".env", ".env.*", "*.pem", "*.key", "*_rsa", "id_rsa", "id_ed25519", "id_ecdsa", "credentials.json", "service-account*.json", "*.p12", "*.pfx", ".npmrc", ".pypirc"]


def ignore_regex(line: str, folder: str = "") -> str | None:
    """Regex of an ignore-file line of `folder` over paths; null for blanks, comments and negations.

    A negation never takes a file back in: any pattern that excludes wins.
    """
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith(("#", "!")):
        return None
    only_dir = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    inner = glob_regex(body)[1:-1] if body else ""
    lead = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
    middle = "" if anchored else "(.*/)?"
    return f"^{lead}{middle}{inner}{'/.+' if only_dir else '(/.*)?'}$"


def ignored(path: Column, lines: Sequence[str] = (), scoped: Sequence[tuple[str, str]] = (), defaults: bool = True) -> Column:
    """Whether a path is ignored by lines of the root, lines of nested folders (folder, line) or the defaults."""
    all_lines = [("", x) for x in [*ALWAYS_IGNORED, *(DEFAULT_IGNORED if defaults else []), *lines]] + list(scoped)
    found = [r for folder, line in all_lines if (r := ignore_regex(line, folder))]
    return path.rlike("|".join(found)) if found else F.lit(False)


def secret(path: Column) -> Column:
    """Whether a path's base name looks like a secret file."""
    return base_name(path).rlike("|".join(glob_regex(p) for p in SECRET_NAMES))


def ignored_by_patterns(paths: DataFrame, patterns: DataFrame, path: str = "path") -> DataFrame:
    """Rows of `paths` that no row (folder, line) of a pattern table ignores.

    The table is a policy: its lines are read when the plan is built, a thousand to an expression.
    """
    lines = [(r["folder"] or "", r["line"] or "") for r in patterns.select("folder", "line").distinct().toLocalIterator()]
    found = sorted({r for folder, line in lines if (r := ignore_regex(line, folder))} | {ignore_regex(x) for x in ALWAYS_IGNORED})
    for i in range(0, len(found), 1000):
        paths = paths.where(~F.coalesce(F.col(path).rlike("|".join(found[i : i + 1000])), F.lit(False)))
    return paths


def moved_kind(old: Column, new: Column) -> Column:
    """RENAMED within one folder under another name, else MOVED."""
    return F.when((dir_name(old) == dir_name(new)) & (base_name(old) != base_name(new)), "RENAMED").otherwise("MOVED")


def absolute_path(root: Column, path: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(root, "/+$", ""), path)


def ancestors(path: Column) -> Column:
    """The folders above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
