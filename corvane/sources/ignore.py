"""Ignore rules of the gitignore kind, as regular expressions that Spark applies; the last rule that matches wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pieces of a pattern, longest first, and what each stands for.
_PIECES = re.compile(r"(?P<deep>\*\*/)|(?P<any>\*\*)|(?P<part>\*)|(?P<one>\?)|(?P<set>\[[^\]]*\])|(?P<text>.)", re.DOTALL)
_STANDS = {"deep": "(?:.*/)?", "any": ".*", "part": "[^/]*", "one": "[^/]"}


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    directory_only: bool


def compile_line(line: str) -> Rule | None:
    """The rule of one line; null for blank lines, comments and bare slashes."""
    body = line.rstrip()
    if not body or body[0] == "#":
        return None
    negated = body[0] == "!"
    body = body[1:] if negated else body
    folder = body.endswith("/")
    body = body[:-1] if folder else body
    rooted = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    regex = "".join(_STANDS.get(m.lastgroup) or (m[0] if m.lastgroup == "set" else re.escape(m[0])) for m in _PIECES.finditer(body))
    return Rule(("^" if rooted else "^(?:.*/)?") + regex + "$", negated, folder)


def compile_lines(text: str) -> list[Rule]:
    return [r for r in map(compile_line, re.split(r"\r?\n", text)) if r]


def ignored(path: Column, rules: list[Rule], directory: bool = False) -> Column:
    """Whether the last rule that matches the path ignores it."""
    out = F.lit(False)
    if not any(r.negated for r in rules):  # whichever matches, so one expression asks them all
        some = "|".join(r.regex for r in rules if not r.directory_only or directory)
        return path.rlike(some) if some else out
    for r in rules:
        if not r.directory_only or directory:
            out = F.when(path.rlike(r.regex), F.lit(not r.negated)).otherwise(out)
    return out


def ignored_file(path: Column, rules: list[Rule]) -> Column:
    """A file is ignored by itself, or by a folder above it when no rule is negated (a folder is then pruned whole)."""
    out = ignored(path, rules)
    if rules and not any(r.negated for r in rules):
        out = out | path.rlike("|".join(r.regex.removesuffix("$") + "/" for r in rules))
    return out
