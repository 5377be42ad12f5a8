"""Path expressions. Paths are strings with '/'; all of these are Column expressions that stay in code generation or higher-order functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def strip_slashes(path: Column) -> Column:
    """Forward slashes, none at the end."""
    return F.regexp_replace(to_posix(path), "/+$", "")


def is_absolute(path: Column) -> Column:
    return path.startswith("/") | path.rlike("^[A-Za-z]:") | path.startswith("\\\\")


def parent(path: Column) -> Column:
    """Everything before the last slash; empty for a name alone."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ancestors(path: Column, itself: bool = False) -> Column:
    """Array of the proper ancestors, the topmost first; with itself, the path last."""
    parts = F.split(path, "/")
    top = F.size(parts) if itself else F.size(parts) - 1
    return F.when(top < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def join_path(prefix: Column, path: Column) -> Column:
    return F.concat_ws("/", F.nullif(prefix, F.lit("")), F.nullif(path, F.lit("")))


def under(path: Column, root: Column | str) -> Column:
    """Strictly below root by whole components; everything is below ''."""
    root = F.lit(root) if isinstance(root, str) else root
    return (root == "") | F.startswith(path, F.concat(root, F.lit("/")))


def relative(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    return F.when(root == "", path).otherwise(F.substr(path, F.length(root) + 2))


def normalize(path: Column) -> Column:
    """Without empty and '.' parts; '..' takes the part before it, except at the front, and stays behind a root."""
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & (F.size(done) > 0) & (last != ".."), F.slice(done, 1, F.size(done) - 1))
            .otherwise(F.concat(done, F.array(part)))
        )

    body = F.aggregate(F.split(path, "/"), start, step, lambda a: F.array_join(a, "/"))
    return F.when(path.startswith("/"), F.concat(F.lit("/"), body)).otherwise(body)


def components(path: Column) -> Column:
    """Array of the components; in the order of such arrays a directory is next to what is below it, in that of strings 'a-b' is between 'a' and 'a/c'."""
    return F.split(path, "/")


def common_directory(low: Column, high: Column) -> Column:
    """Longest common run of components of two paths, given as components. Of the least and the greatest of a set it is that of the whole set."""
    a, b = low, high
    n = F.least(F.size(a), F.size(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
    return F.array_join(F.slice(a, 1, F.coalesce(F.array_max(same), F.lit(0))), "/")


def utf16_order(path: Column) -> Column:
    """Sort key by UTF-16 code units."""
    return F.encode(path, "UTF-16BE")


def escape_glob(path: Column) -> Column:
    return F.regexp_replace(path, r"([*?\[\]{}!])", r"\\$1")


def glob_to_regex(pattern: str, braces: bool = False) -> str:
    """A pattern as a regular expression for the whole path; * and ? also match '/'. braces: {a,b} and backslash escapes are special.

    [!a] is any other character; with braces [^a] is as well, without them '^' stands for itself.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            if pattern[i - 2 : i] == "**" and i < len(pattern) and pattern[i] == "/":
                i += 1
                out.append("(.*/)?")
            else:
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                raise ValueError(f"unclosed class in pattern {pattern!r}")
            body = pattern[i:end]
            negated = body[0] == "!" or (braces and body[0] == "^")
            plain = re.sub(r"[\\\[\]&^]", lambda m: "\\" + m[0], body[1:] if negated else body)
            out.append(f"[{'^' if negated else ''}{plain}]")
            i = end + 1
        elif braces and c == "{":
            depth += 1
            out.append("(?:")
        elif braces and c == "}":
            if not depth:
                raise ValueError(f"unopened brace in pattern {pattern!r}")
            depth -= 1
            out.append(")")
        elif braces and c == "," and depth:
            out.append("|")
        elif braces and c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c))
    if depth:
        raise ValueError(f"unclosed brace in pattern {pattern!r}")
    return "(?s)^" + "".join(out) + "$"


def matches_globs(path: Column, include: list[str] = (), exclude: list[str] = (), braces: bool = False) -> Column:
    """Excluded by none and, if there are any, included by one."""
    hit = lambda patterns: reduce(lambda x, y: x | y, [path.rlike(glob_to_regex(p, braces)) for p in patterns])
    wanted = hit(include) if include else F.lit(True)
    return wanted & ~hit(exclude) if exclude else wanted


def within_root(path: Column, root: Column | str) -> Column:
    """At or below root by whole components, after normalising both."""
    root = normalize(F.lit(root) if isinstance(root, str) else root)
    return (normalize(path) == root) | under(normalize(path), F.regexp_replace(root, "/$", ""))


def for_manifest(path: Column, root: Column | str) -> Column:
    """The path relative to root as it stands in a manifest, '' for root itself; one outside raises."""
    whole, top = normalize(path), F.regexp_replace(normalize(F.lit(root) if isinstance(root, str) else root), "/$", "")
    return F.when(whole == top, "").when(under(whole, top), F.substr(whole, F.length(top) + 2)).otherwise(F.raise_error(F.concat(F.lit("path outside root: "), F.coalesce(path, F.lit("null")))))


def permissions(type: Column, runnable: Column) -> Column:
    """Mode bits that a tree shows: folders and programs 755, links 777, other files 644."""
    return F.when(type == "symlink", 0o777).when((type == "directory") | F.coalesce(runnable, F.lit(False)), 0o755).otherwise(0o644)


def name_matches(name: Column, pattern: str) -> Column:
    """Names by a pattern with * and ?, whatever the case; no pattern matches all."""
    return F.lit(True) if not pattern else F.lower(name).rlike("(?s)^" + re.escape(pattern.lower()).replace(r"\*", ".*").replace(r"\?", ".") + "$")
