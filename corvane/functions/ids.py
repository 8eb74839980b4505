"""Paths, entity ids and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.words import LANGUAGES


def posix_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def normalize_path(c: Column) -> Column:
    """The path without `.` and `..`; null where it would leave the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(s: Column, part: Column) -> Column:
        kept, up = s["kept"], part == ".."
        shorter = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.struct(F.when(up, shorter).otherwise(F.array_append(kept, part)).alias("kept"), (s["ok"] & ~(up & (F.size(kept) == 0))).alias("ok"))

    parts = F.filter(F.split(c, "/"), lambda p: ~p.isin("", "."))
    return F.aggregate(parts, start, step, lambda s: F.when(s["ok"], F.array_join(s["kept"], "/")))


def qualify(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def entity_id(path: Column, kind: Column, qualified: Column, ordinal: Column) -> Column:
    """path#TYPE:qualified, with ~ordinal from the second on."""
    return F.concat(path, F.lit("#"), kind, F.lit(":"), qualified, F.when(ordinal > 0, F.concat(F.lit("~"), ordinal.cast("string"))).otherwise(""))


def file_entity_id(path: Column) -> Column:
    return entity_id(path, F.lit("FILE"), path, F.lit(0))


def parse_entity_id(c: Column) -> Column:
    """Struct (path, type, qualified, ordinal) of an entity id; null parts where it is none."""
    whole = r"^(.*?)#([A-Z_]+):(.*?)(?:~(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(c, whole, i), F.lit(""))
    return F.struct(part(1).alias("path"), part(2).alias("type"), part(3).alias("qualified"), F.coalesce(part(4).cast("int"), F.lit(0)).alias("ordinal"))


def content_hash(c: Column) -> Column:
    """SHA-256 of the text with line ends as \\n."""
    return F.sha2(F.replace(c, F.lit("\r\n"), F.lit("\n")), 256)


def short_hash(c: Column) -> Column:
    return F.left(content_hash(c), F.lit(12))


def language(path: Column) -> Column:
    """Language by the last ending of the file name; unknown without one, or with only a leading dot."""
    ending = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(table[ending], F.lit("unknown"))
