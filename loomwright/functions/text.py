"""Column expressions over source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import value_names

SOURCE_FILE = r"\.[cm]?[jt]sx?\z"
UNTAGGED = r"\.[cm]?ts\z"
DECLARATIONS = r"\.d\.[cm]?ts\z"
NAME_SHAPED = r"\A[a-z0-9_]+\z"
#: One alternative for each kind of quote; a back-reference would not do in engines without them.
QUOTED_NAME = r"'[a-z0-9_]+'|\"[a-z0-9_]+\"|`[a-z0-9_]+`"
IGNORED_DIRECTORIES = ("node_modules", "ios", "android", "Pods", "coverage")


def units(*texts: str) -> tuple[bytes, ...]:
    """Sort key of texts by UTF-16 code units, as scripts sort; it differs from code points where a text has characters beyond U+FFFF."""
    return tuple(t.encode("utf-16-be", "surrogatepass") for t in texts)


def is_source(path: Column) -> Column:
    return path.rlike(SOURCE_FILE)


def is_declaration(path: Column) -> Column:
    return path.rlike(DECLARATIONS)


def is_name_shaped(c: Column) -> Column:
    return c.rlike(NAME_SHAPED)


def text_of(content: Column) -> Column:
    """Bytes as UTF-8; invalid ones become U+FFFD, and nothing fails."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def literals(code: Column) -> Column:
    """Distinct name-shaped tokens between equal quotes, sorted. Null code has none."""
    found = F.regexp_extract_all(F.coalesce(code, F.lit("")), F.lit(QUOTED_NAME), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))))


#: What comment marks may stand in without beginning a comment: strings, templates, regular expressions, and the slashes of a URL in text.
#: Loops are possessive: they give nothing back and need no stack, however long a string is.
STRINGS = r"'[^'\\\n]*(?:\\.[^'\\\n]*)*+'|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*+\"|`[^`\\]*(?:\\(?s:.)[^`\\]*)*+`"
NO_COMMENT = STRINGS + r"|[=(,:!&|?;{}\[][ \t]*/(?:[^*/\\\n\[]|\\.|\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*+\])(?:[^/\\\n\[]|\\.|\[[^\]\\\n]*(?:\\.[^\]\\\n]*)*+\])*+/|://"
BLOCK_COMMENT = r"/\*(?s:.*?)\*/"
LINE_COMMENT = r"//[^\n]*"

def without_comments(code: Column) -> Column:
    """Code without comments. Of strings, templates, regular expressions and comments the one that begins first counts, so a comment mark in a string is no comment."""
    return F.regexp_replace(F.coalesce(code, F.lit("")), F.lit(f"({NO_COMMENT})|{BLOCK_COMMENT}|{LINE_COMMENT}"), F.lit("$1"))


def without_line_comments(code: Column) -> Column:
    """Code without line comments; all lines stay, and so do block comments."""
    return F.regexp_replace(F.coalesce(code, F.lit("")), F.lit(f"({NO_COMMENT}|{BLOCK_COMMENT})|{LINE_COMMENT}"), F.lit("$1"))


def value_literals(code: Column, path: Column) -> Column:
    """literals() of value positions (values.value_names); declaration files have none. Plain TypeScript has no tags; all else may have them."""
    return F.when(is_declaration(path), F.array().cast("array<string>")).otherwise(value_names(code, ~F.coalesce(path.rlike(UNTAGGED), F.lit(False))))


_REFERENCE = r"&#(?:x[0-9a-fA-F]{1,6}|[0-9]{1,7});"


def without_references(text: Column) -> Column:
    """Text with numeric character references replaced by their characters; those beyond ASCII become U+FFFD, for a name has none of them. Named
    references stay: no name holds a character that has one."""
    found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    number = lambda r: F.when(F.substring(r, 3, 1) == "x", F.conv(F.regexp_extract(r, "x([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(r, "([0-9]+)", 1)).cast("int")
    character = lambda r: F.when(number(r).between(1, 127), F.char(number(r))).when(number(r) <= 0x10FFFF, "\uFFFD").otherwise(r)
    return F.array_join(F.zip_with(F.split(text, _REFERENCE), found, lambda a, r: F.concat(a, F.coalesce(character(r), F.lit("")))), "")


def markers(text: Column, wanted: list[str]) -> Column:
    """Those of wanted that the text contains, in the order of wanted. Case counts, and a part of a word will do."""
    return F.filter(F.array(*[F.lit(m) for m in wanted]).cast("array<string>"), lambda m: F.contains(F.coalesce(text, F.lit("")), m))


def glob_regex(glob: str) -> str:
    """A glob as a whole-path pattern: **/ is any number of directories, ** anything, * anything but a slash; other characters stand for themselves."""
    any_char, out, at = r"[^\n\r\u2028\u2029]", "", 0
    glob = glob.removeprefix("./")
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + f"(?:{any_char}*/)?", at + 3
        elif glob.startswith("**", at):
            out, at = out + f"{any_char}*", at + 2
        elif glob[at] == "*":
            out, at = out + "[^/]*", at + 1
        else:
            out, at = out + re.escape(glob[at]), at + 1
    return rf"\A{out}\z"


def excluded(rel_path: Column, globs: list[str]) -> Column:
    """Does a glob match the path or a directory above it? A directory that matches takes all below it along."""
    if not globs:
        return F.lit(False)
    parts = F.split(rel_path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    pattern = "|".join(glob_regex(g) for g in globs)
    return F.exists(above, lambda p: p.rlike(pattern))


def in_ignored_directory(rel_path: Column) -> Column:
    """A directory on the path begins with a dot or is one that sources are never kept in. File names may begin with a dot."""
    parts = F.split(rel_path, "/")
    directories = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(directories, lambda d: d.startswith(".") | d.isin(*IGNORED_DIRECTORIES))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """floor(x + 1/2), also below zero; never -0."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale
