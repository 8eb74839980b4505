from pyspark.sql import functions as F

from corvane.functions import ids, scoring, text


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_split_identifier(spark):
    got = {s: one(spark, text.split_identifier(F.lit(s))) for s in ("HTTPSConnection", "parseJSONResponse", "monthly-report", "calculateCommission2", "", "snake_case")}
    assert got == {"HTTPSConnection": ["HTTPS", "Connection"], "parseJSONResponse": ["parse", "JSON", "Response"], "monthly-report": ["monthly", "report"], "calculateCommission2": ["calculate", "Commission2"], "": [], "snake_case": ["snake", "case"]}


def test_query_terms(spark):
    terms = lambda s: {(c["term"], c["is_prefix"]) for c in one(spark, text.query_terms(F.lit(s)))}
    assert terms("integration") == {("integration", False), ("integr", True)}
    assert terms("login") == {("login", False)}
    assert terms("a e o") == set()
    assert terms("fix the login") == {("login", False)}


def test_path_terms(spark):
    assert one(spark, text.path_terms(F.array(F.lit("indicacao"), F.lit("js"), F.lit("api")))) == ["indicacao", "indica"]


def test_accents_and_literals(spark):
    assert spark.createDataFrame([("indicação",), (None,)], "t string").select(text.strip_accents("t").alias("x")).toPandas()["x"].tolist() == ["indicacao", None]
    assert text.literal_words('<div className="flex items">Relatório mensal</div> const a = "Vendas do mês"') == "relatório mensal vendas mês"
    assert text.literal_words('<a class="grey">') is None


def test_classify_and_symbols(spark):
    kinds = {s: one(spark, text.classify_task(F.lit(s))) for s in ("corrigir o login", "adicionar botao", "escrever testes", "como funciona isso", "blargh")}
    assert kinds == {"corrigir o login": "BUG_FIX", "adicionar botao": "FEATURE", "escrever testes": "TEST", "como funciona isso": "EXPLAIN", "blargh": "UNKNOWN"}
    assert one(spark, text.task_symbols(F.lit("Validar `a.b` no Resolver com my_name e lower"))) == ["a.b", "Resolver", "my_name"]
    assert one(spark, text.task_paths(F.lit("see src/a.ts and b.py"))) == ["src/a.ts", "b.py"]


def test_tokens(spark):
    sample = "export function calculateCommission(total: number) {\n  const rate = 0.05;\n  return total * rate;\n}"
    estimate = one(spark, text.estimate_tokens(F.lit(sample)))
    assert 25 < estimate < 70
    assert estimate == text.estimate(sample)
    assert one(spark, text.estimate_tokens(F.lit(""))) == 0
    assert one(spark, text.line_count(F.lit("a\nb"))) == 2 and one(spark, text.line_count(F.lit(""))) == 0


def test_comment_and_names(spark):
    assert one(spark, text.clean_comment(F.lit("/** Saves it.\n * Twice. */"))) == "Saves it.\nTwice."
    assert one(spark, text.base_name(F.lit("a.b.C<D>"))) == "C"
    assert one(spark, text.strip_quotes(F.lit("'x'"))) == "x"


def test_ids(spark):
    made = one(spark, ids.entity_id(F.lit("a/b.ts"), F.lit("METHOD"), F.lit("A.run~x"), F.lit(2)))
    assert made == "a/b.ts#METHOD:A.run~x~2"
    assert one(spark, ids.parse_entity_id(F.lit(made))).asDict() == {"path": "a/b.ts", "type": "METHOD", "qualified": "A.run~x", "ordinal": 2}
    assert [one(spark, ids.normalize_path(F.lit(p))) for p in ("a/./b/../c", "../x", "a/../../b", "a//b")] == ["a/c", None, None, "a/b"]
    assert one(spark, ids.content_hash(F.lit("a\r\nb"))) == one(spark, ids.content_hash(F.lit("a\nb")))
    assert [one(spark, ids.language(F.lit(p))) for p in ("a.TS", "a.d.ts", ".env", "Makefile", "x/y.py")] == ["typescript", "typescript", "unknown", "unknown", "python"]


def test_scoring(spark):
    assert [one(spark, scoring.effective_budget(F.lit(float(b)), F.lit(float(m)))) for b, m in ((20000, 0.05), (1000, 5), (1000, -1))] == [19000, 500, 1000]
    day = 86400.0
    assert one(spark, scoring.recency(F.lit(0.0), F.lit(0.0))) == 1
    assert abs(one(spark, scoring.recency(F.lit(0.0), F.lit(30 * day))) - 0.5) < 1e-9
    assert one(spark, scoring.recency(F.lit(0.0), F.lit(365 * day))) < 0.01
    assert one(spark, scoring.recency(F.lit(None).cast("double"), F.lit(1.0))) == 0
    names = list(scoring.SIGNAL_WEIGHTS)
    assert one(spark, scoring.weighted_score({n: F.lit(0.0) for n in names})) == 0
    assert abs(one(spark, scoring.weighted_score({n: F.lit(1.0) for n in names})) - 100) < 1e-9
    assert [one(spark, scoring.ambiguous_confidence(F.lit(n))) for n in (0, 1, 2, 4)] == [0.0, 0.5, 0.5, 0.25]
    assert one(spark, scoring.affinity(F.lit("BUG_FIX"), F.lit("FILE"))) == 0.3 and one(spark, scoring.affinity(F.lit("TEST"), F.lit("CLASS"))) == 0.85
    risks = [one(spark, scoring.risk(*(F.lit(x) for x in case))) for case in ((0, 0, 0, 0, True), (21, 0, 1, 1, False), (1, 1, 11, 1, False), (6, 0, 1, 1, False), (1, 0, 1, 0, True), (1, 0, 1, 1, True))]
    assert risks == ["LOW", "HIGH", "HIGH", "MEDIUM", "MEDIUM", "LOW"]
