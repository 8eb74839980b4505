"""Rows that extractors emit: entities and unresolved edges of one file."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from corvane.functions.text import content_words, estimates, fold_accents, literals as literals_of

ENTITY_FIELDS = ("id", "type", "name", "qualified_name", "language", "file_path", "parent_id", "start_line", "end_line", "start_byte", "end_byte", "signature", "documentation", "exported", "fingerprint", "token_estimate", "literals", "metadata")
RELATION_FIELDS = ("source_id", "target_id", "target_hint", "type", "resolution", "confidence", "file_path", "line", "metadata")


class Extraction:
    """Collects rows; the FILE entity comes first, repeats of a type and name get ordinals in order of position."""

    def __init__(self, path: str, language: str, source: str) -> None:
        self.path, self.language, self.source = path, language, source
        self.found: list[dict] = []
        self.read: list[bool] = []
        self.relations: list[dict] = []
        self.seen: dict[str, int] = {}
        self.said: dict[tuple[str, ...], str | None] = {}
        self.partial = False
        self.file_id = self.entity("FILE", path, path, 0, len(source), None, exported=True, literals=False)

    @property
    def entities(self) -> list[dict]:
        return self.measured()

    def measured(self, columns: Sequence[str] = ENTITY_FIELDS) -> list[dict]:
        """The entities' rows with these columns; what is measured on their text is measured only where it is asked for."""
        spans = [(row["start_byte"], row["end_byte"]) for row in self.found]
        made: dict[str, list] = {}
        if "fingerprint" in columns:
            made["fingerprint"] = [hashlib.sha256(self.source[a:b].replace("\r\n", "\n").encode("utf-8", "surrogatepass")).hexdigest()[:12] for a, b in spans]
        if "token_estimate" in columns:  # together, since entities lie in one another
            made["token_estimate"] = estimates(self.source, spans)
        if "literals" in columns:
            made["literals"] = [self.words(tuple(literals_of(self.source[a:b]))) if read else None for (a, b), read in zip(spans, self.read, strict=True)]
        return [{c: made[c][i] if c in made else row[c] for c in columns} for i, row in enumerate(self.found)]

    def words(self, spans: tuple[str, ...]) -> str | None:
        """The content words of these literals without accents; an entity within another mostly has the same ones."""
        if spans not in self.said:
            words = content_words(spans)
            self.said[spans] = fold_accents(words) if words else None
        return self.said[spans]

    def line(self, offset: int) -> int:
        return self.source.count("\n", 0, offset) + 1

    def entity(self, kind: str, name: str, qualified: str, start: int, end: int, parent: str | None, *, signature: str | None = None, documentation: str | None = None, exported: bool = False, metadata: dict | None = None, literals: bool = True) -> str:
        key = f"{kind}:{qualified}"
        n = self.seen[key] = self.seen.get(key, -1) + 1
        own = f"{self.path}#{key}" + (f"~{n}" if n else "")
        values = (
            own, kind, name, qualified, self.language, self.path, parent, self.line(start), self.line(end), start, end, signature, documentation, exported,
            None, None, None, json.dumps(metadata) if metadata else None,
        )
        self.found.append(dict(zip(ENTITY_FIELDS, values, strict=True)))
        self.read.append(literals)
        return own

    def relation(self, source: str, hint: str, kind: str, offset: int, metadata: dict | None = None) -> None:
        values = (source, None, hint, kind, "UNRESOLVED", 0.0, self.path, self.line(offset), json.dumps(metadata) if metadata else None)
        self.relations.append(dict(zip(RELATION_FIELDS, values, strict=True)))
