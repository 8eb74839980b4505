"""Edge linking: import paths, bindings and the ladder of symbol resolution, as ranked candidate joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.ids import normalize_path
from corvane.functions.scoring import ambiguous_confidence
from corvane.schemas import RELATION_KEY, RELATION_METADATA
from corvane.session import kept

# Endings that an import without one may stand for, and the files of a package folder.
ENDINGS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".py")


def _base(file_path: Column, hint: Column) -> Column:
    """What a relative specifier says, as a path; a Python module's leading dots are relative too."""
    folder = F.regexp_extract(file_path, r"^(.*/)?[^/]*$", 1)
    dotted = hint.rlike(r"^\.+[A-Za-z_][\w.]*$|^\.+$") & file_path.rlike(r"\.pyi?$")
    up = F.repeat(F.lit("../"), F.greatest(F.length(F.regexp_extract(hint, r"^(\.+)", 1)) - 1, F.lit(0)))
    python = F.concat(up, F.replace(F.regexp_replace(hint, r"^\.+", ""), F.lit("."), F.lit("/")))
    return normalize_path(F.concat(folder, F.when(dotted, python).otherwise(hint)))


def _bare(base: Column) -> Column:
    return F.regexp_replace(base, r"\.[mc]?jsx?$", "")


def _probes(base: Column, bare: Column) -> list[Column]:
    probes = [base, bare]
    for stem in (bare, base):
        probes += [F.concat(stem, F.lit(e)) for e in ENDINGS]
    probes += [F.concat(stem, F.lit("/index" + e)) for stem in (bare, base) for e in ENDINGS[:-1]] + [F.concat(base, F.lit("/__init__.py"))]
    return probes


def import_candidates(file_path: Column, hint: Column) -> Column:
    """Ordered paths that a relative specifier may mean."""
    base = _base(file_path, hint)
    return F.array_distinct(F.array_compact(F.array(*_probes(base, _bare(base)))))


def _told(path: Column) -> Column:
    """The stems whose `import_candidates` may hold a path: itself and what is left of it without each ending that it has."""
    ends = [*ENDINGS, *("/index" + e for e in ENDINGS[:-1]), "/__init__.py"]
    return F.array_compact(F.array(path, *(F.when(path.endswith(e), F.substring(path, F.lit(1), F.length(path) - len(e))) for e in ends)))


def path_suffixes(paths: DataFrame) -> DataFrame:
    """(suffix, path): every tail of whole segments, so that a suffix match is an equi-join."""
    parts = F.split("path", "/")
    return paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("suffix"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(*key, path) for the imports (RELATION_KEY columns) that mean a file of `files` (column path)."""
    relative = F.col("target_hint").startswith(".")
    # Files tell the few stems that may mean them, so an import asks for its two stems and not for every candidate.
    near = imports.filter(relative).select(*RELATION_KEY, _base(F.col("file_path"), F.col("target_hint")).alias("_base")).withColumn("_bare", _bare(F.col("_base")))
    near = near.select("*", F.explode(F.array_distinct(F.array("_base", "_bare"))).alias("_stem"))
    told = files.select(F.col("path").alias("_path")).distinct().select("_path", F.explode(_told(F.col("_path"))).alias("_stem"))
    place = F.coalesce(*(F.when(F.col("_path") == probe, i) for i, probe in enumerate(_probes(F.col("_base"), F.col("_bare")))))
    near = near.join(told, "_stem").select(*RELATION_KEY, "_path", place.alias("_at")).filter("_at is not null")
    near = near.groupBy(*RELATION_KEY).agg(F.min_by("_path", "_at").alias("path"))
    module = F.replace("target_hint", F.lit("."), F.lit("/"))
    dotted = imports.filter(~relative & ~F.col("target_hint").contains("/") & F.col("file_path").rlike(r"\.pyi?$"))
    dotted = dotted.select(*RELATION_KEY, F.explode(F.array(F.concat(module, F.lit(".py")), F.concat(module, F.lit("/__init__.py")))).alias("suffix"))
    dotted = dotted.join(path_suffixes(files), "suffix").groupBy(*RELATION_KEY).agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("_best")).select(*RELATION_KEY, "_best.path")
    return near.unionByName(dotted)


def bindings(resolved: DataFrame) -> DataFrame:
    """(file_path, local_name, bound_path): names that imports bring into a file, the last import winning."""
    names = resolved.select("file_path", "line", "path", F.posexplode("names").alias("_at", "local_name"))
    return names.groupBy("file_path", "local_name").agg(F.max_by("path", F.struct("line", "_at", "path")).alias("bound_path"))


#: Stands for any file and for any qualified name in the keys of `summaries`.
ANY = "\x00"


def summaries(entities: DataFrame) -> DataFrame:
    """(target_hint, in_file, as_name, n, best): how many entities a hint may mean and the first of them, exported before hidden, then by id.

    A hint is an entity's name or qualified name. It is summed up per hint (in_file and as_name are ANY), per file, per
    qualified name, and per both, so that every rule is a look-up of one row, however many entities share a name.
    """
    forms = F.array_distinct(F.array("name", "qualified_name"))
    rows = entities.select(F.explode(forms).alias("target_hint"), "file_path", "qualified_name", F.struct((~F.col("exported")).alias("hidden"), "id").alias("best")).filter("target_hint is not null")
    scopes = F.array(*(F.struct(f.alias("in_file"), q.alias("as_name")) for f in (F.lit(ANY), F.col("file_path")) for q in (F.lit(ANY), F.col("qualified_name"))))
    rows = rows.select("target_hint", F.explode(scopes).alias("_"), "best").select("target_hint", "_.in_file", "_.as_name", "best")
    return rows.groupBy("target_hint", "in_file", "as_name").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best"))


def resolve_symbols(edges: DataFrame, entities: DataFrame, bound: DataFrame) -> DataFrame:
    """(*key, new_target, new_resolution, new_confidence) for unresolved edges that have a candidate.

    An edge asks one summary per rule and takes the least rule that has an answer; of its candidates the first, exported before
    hidden, then by id. Rules: 1 the hint is bound to the candidate's file; 2 same class through this/self; 3
    constructed class; 4 the receiver is bound to its file; 5 only one in the same file; 6 only one anywhere; then guesses,
    local first (7) for a member call, any (8). No edge meets its candidates one by one. What an edge asks depends on its hint, file, receiver and, for
    this and self, class: each such question is answered once, and only the answer meets the edges.
    """
    has = F.from_json("metadata", RELATION_METADATA)["expression"]
    e = edges.withColumn("_expr", has).withColumn("_receiver", F.when(F.col("_expr").contains("."), F.regexp_extract("_expr", r"^(.+)\.[^.]*$", 1)))
    direct = bound.select("file_path", F.col("local_name").alias("target_hint"), F.col("bound_path").alias("_bound"))
    base = bound.select("file_path", F.col("local_name").alias("_base"), F.col("bound_path").alias("_base_bound"))
    source = entities.select(F.col("id").alias("source_id"), F.split("qualified_name", r"\.")[0].alias("_class"), F.col("file_path").alias("_class_file"))
    e = e.join(source, "source_id", "left")
    member = F.col("_expr").isNotNull()
    own = F.when(member & F.col("_receiver").isin("this", "self"), F.concat_ws(".", "_class", "target_hint"))
    e = kept(e.select(*RELATION_KEY, member.alias("_member"), "_receiver", own.alias("_own"), F.when(own.isNotNull(), F.col("_class_file")).alias("_own_file")))
    question = ["target_hint", "file_path", "_member", "_receiver", "_own", "_own_file"]
    q = e.select(*question).distinct().withColumn("_base", F.split("_receiver", r"\.")[0]).join(direct, ["file_path", "target_hint"], "left").join(base, ["file_path", "_base"], "left")
    constructed = F.nullif(F.regexp_extract("_receiver", r"^new\s+([A-Za-z_$][\w$]*)", 1), F.lit(""))
    made = F.when(F.col("_member"), F.concat(constructed, F.lit("."), F.col("target_hint")))
    any_ = F.lit(ANY)
    asked = (
        (1, F.col("_bound"), any_), (2, F.col("_own_file"), F.col("_own")), (3, F.when(made.isNotNull(), any_), made), (4, F.when(F.col("_member"), F.col("_base_bound")), any_),
        (7, F.col("file_path"), any_), (8, any_, any_),
    )
    probes = F.filter(F.array(*(F.struct(F.lit(r).alias("rule"), f.alias("in_file"), q.alias("as_name")) for r, f, q in asked)), lambda x: x["in_file"].isNotNull() & x["as_name"].isNotNull())
    rows = q.select(*question, F.explode(probes).alias("_")).select(*question, "_.*")
    rows = rows.join(summaries(entities), ["target_hint", "in_file", "as_name"])
    alone = ~F.col("_member") & (F.col("n") == 1)
    rule = F.when(F.col("rule") == 7, F.when(alone, 5).when(F.col("_member"), 7)).when((F.col("rule") == 8) & alone, 6).otherwise(F.col("rule"))
    answers = rows.withColumn("_rule", rule).groupBy(*question).agg(F.min(F.when(F.col("_rule").isNotNull(), F.struct("_rule", "best"))).alias("_best"), F.max(F.when(F.col("rule") == 8, F.col("n"))).alias("_n"))
    answers = answers.select(*(F.col(c).alias(f"{c}_q") for c in question), "_best", "_n")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_q")) for c in question]
    best = e.join(answers, same).groupBy(*RELATION_KEY).agg(F.min("_best").alias("_best"), F.max("_n").alias("_n"))  # edges that differ in nothing but their metadata are one
    tier = F.when(F.col("_best._rule") <= 3, "EXACT").when(F.col("_best._rule") <= 6, "SCOPED").otherwise("AMBIGUOUS")
    confidence = F.when(tier == "EXACT", 1.0).when(tier == "SCOPED", 0.75).otherwise(ambiguous_confidence(F.col("_n")))
    return best.select(*RELATION_KEY, F.col("_best.best.id").alias("new_target"), tier.alias("new_resolution"), confidence.alias("new_confidence"))


def resolve_all(relations: DataFrame, entities: DataFrame, files: DataFrame) -> DataFrame:
    """The relations with every null target tried against the entities and files as they are now."""
    open_ = relations.filter("target_id is null")
    imports = relations.filter("type = 'IMPORTS'")
    found = kept(resolve_imports(imports.select(*RELATION_KEY), files))
    names = F.coalesce(F.from_json("metadata", RELATION_METADATA)["names"], F.array().cast("array<string>"))
    bound = bindings(imports.select(*RELATION_KEY, names.alias("names")).join(found, RELATION_KEY).select("file_path", "line", "path", "names"))
    to_files = found.join(entities.filter("type = 'FILE'").select(F.col("file_path").alias("path"), F.col("id").alias("new_target")), "path")
    to_files = to_files.select(*RELATION_KEY, "new_target", F.lit("EXACT").alias("new_resolution"), F.lit(1.0).alias("new_confidence"))
    to_symbols = resolve_symbols(open_.filter("type <> 'IMPORTS'"), entities.filter("type <> 'FILE'"), bound)
    return apply_updates(relations, to_files.unionByName(to_symbols))


def apply_updates(relations: DataFrame, updates: DataFrame) -> DataFrame:
    """Relations with the updates in place of null targets."""
    out = relations.join(updates, RELATION_KEY, "left")
    free = F.col("target_id").isNull() & F.col("new_target").isNotNull()
    out = out.withColumns({"resolution": F.when(free, F.col("new_resolution")).otherwise(F.col("resolution")), "confidence": F.when(free, F.col("new_confidence")).otherwise(F.col("confidence")), "target_id": F.coalesce("target_id", "new_target")})
    return out.select(*relations.columns)
