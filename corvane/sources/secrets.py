"""Secret guard: paths that are never read, and shapes of credentials in the first 16 KB of a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.words import DENY_PATHS
from corvane.sources.ignore import compile_line

SNIFF = 16 * 1024
#: Reason and pattern. Headers need a body and words like "password" need no match, so that code about secrets passes.
PATTERNS = (
    ("private key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s+[A-Za-z0-9+/=]{40,}"),
    ("cloud access key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("repository token", r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})"),
    ("model provider key", r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{24,}"),
    ("chat token", r"\bxox[abposr]-[A-Za-z0-9-]{10,}"),
    ("service account", r"\"type\"\s*:\s*\"service_account\""),
    ("credentials in a URL", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@[^\s/]+"),
)

#: What a head must hold for the pattern of that reason to meet it: looked for first, as that is far cheaper.
NEEDLES = {
    "private key": ("PRIVATE KEY-----",), "cloud access key": ("AKIA", "ASIA"), "repository token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "model provider key": ("sk-",),
    "chat token": ("xox",), "service account": ("service_account",), "credentials in a URL": ("://",),
}


def path_blocked(path: Column, deny: tuple[str, ...] = DENY_PATHS) -> Column:
    return path.rlike("|".join(compile_line(p).regex for p in deny)) if deny else F.lit(False)


def content_reason(c: Column, patterns: tuple[tuple[str, str], ...] = PATTERNS) -> Column:
    """The first pattern's reason that the head of the text meets; null if none."""
    head, out = F.substring(c, 1, SNIFF), None
    for reason, p in patterns:
        met = head.rlike(p)
        if (reason, p) in PATTERNS:
            held = F.lit(False)
            for needle in NEEDLES[reason]:
                held = held | c.contains(needle)
            met = held & met
        out = F.when(met, reason) if out is None else out.when(met, reason)
    return out
