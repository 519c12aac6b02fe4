"""Column functions on small literals, in the shapes that records and texts come in."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from vereda.functions import dates, legal, normaliser, numeric, parsing, records, sections, text
from vereda.operators import allocation, catalogue, containment, harvest, merge, ordered, references, search, series
from vereda.plans import citations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    "raw, domain, want",
    [
        ("O ato publico nao podera valer, na forma do art. 7o da constituicao  federal .", "all", "O ato público não poderá valer, na forma do art. 7º da Constituição Federal."),
        ("Sumula  Vinculante 11 - plenario", "juris", "Súmula Vinculante 11 - plenário"),
        ("A Lei nº 9784, de 29 de janeiro de 1999 e a Lei Complementar 95, de 1998", "all", "A Lei 9.784/1999 e a Lei Complementar 95/1998"),
        ("SUMULA e Codigo", "all", "SÚMULA e Código"),
        ("um ,dois;tres.. ( quatro )\n \n\n\nfim", "all", "um, dois; tres. (quatro)\n\nfim"),
        ("decreto - lei e RECURSO EXTRAORDINARIO", "all", "Decreto-Lei e Recurso Extraordinário"),
        ("Art. 12 ° e art. 3°", "all", "Art. 12 º e art. 3º"),
        ("", "all", ""),
    ],
)
def test_normaliser(spark, raw, domain, want):
    assert one(spark, normaliser.normalised(lit(raw), domain)) == want


def test_normaliser_parts_a_text_at_listed_words_alone(spark):
    keys = list(normaliser.ACCENTS)
    assert one(spark, normaliser.parts(lit("uma nota,  sem nada: naoo"), keys)) == ["uma nota,  sem nada: naoo"]
    assert one(spark, normaliser.parts(lit("NAO ha nota; nao\U0001d41a la"), keys)) == ["NAO", " ha nota; nao\U0001d41a ", "la"]
    assert one(spark, F.size(normaliser.parts(F.repeat(lit("uma palavra, 12 vezes\n"), 50_000), keys))) == 1


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a..b,,c. .d ( e", "a. b, c.. d (e"),
        ("a \n b\t\n\r\n c\td \n. e(\n\nf", "a\nb\n\nc d. e(f"),
        ("\U0001d41anao \U0001d41aart. 5o, \U0001f600nao \U0001f600art. 5o", "\U0001d41anao \U0001d41aart. 5o, \U0001f600não \U0001f600art. 5º"),
        ("art. 5°nao, part. 5°", "art. 5ºnão, part. 5°"),
        ("\u017fUMULA v\u0131nculante, xtema de repetitivo", "Súmula Vinculante, xtema de repetitivo"),
        ("xLei 8112, de 1990 e LE\u0130 n. 8112, de 1990", "xLei 8112, de 1990 e LE\u0130 8112/1990"),
    ],
)
def test_normaliser_at_odd_letters_and_runs(spark, raw, want):
    assert one(spark, normaliser.normalised(lit(raw))) == want


def test_normaliser_of_a_long_text(spark):
    assert one(spark, normaliser.normalised(F.repeat(lit("um ,dois  e nao;"), 50_000))) == ("um, dois e não; " * 50_000)[:-1]
    assert one(spark, normaliser.normalised(F.repeat(lit("um ,dois  e nao;\n\n\n"), 50_000), "juris")) == "um ,dois e não;\n\n\n" * 50_000


def test_glued_words_are_parted(spark):
    assert one(spark, normaliser.normalised(lit("contratosem prazo, vinculante e direitopúblico"), glued=True)) == "contrato sem prazo, vinculante e direito público"


def test_texts_function_table(spark):
    assert one(spark, text.document_key(lit(" "), lit("a.pdf"))) == "a.pdf" and one(spark, text.document_key(lit("http://X.example/a/"), lit("a"))) == "https://x.example/a"
    assert one(spark, text.repaired(lit("SÃ£o"))) == "São" and one(spark, text.repaired(lit("São"))) == "São"
    assert one(spark, text.broken_encoding(lit("a�"))) and not one(spark, text.broken_encoding(lit("ação")))


def record(spark, value):
    return spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "rec string").select(records.opened(F.col("rec")).alias("r"))


@pytest.mark.parametrize(
    "value, want",
    [
        ({"texto": "t", "dispositivo": " d "}, "d"),
        ({"texto": "t", "metadata": {"norma": "n"}}, "n"),
        ({"texto": "t", "meta": {"ementa": "e"}, "metadata": {"x": 1}}, "e"),
        ({"texto": "t", "enunciado": "full"}, "full"),
        ({"artigos": [{"numero": 3, "texto": "a"}, {"num": "Art. 4", "conteudo": "b"}, " c ", {"numero": 5}]}, "Art. 3\na\n\nArt. 4\nb\n\nc"),
        ({"metadata": {"texto_questao": "Q?", "alternativas": [{"letra": "a", "texto": "x"}, {"letra": "b", "texto": "y"}], "gabarito": "b"}}, "Q?\n\nA) x\nB) y\n\nGabarito (objetiva): b"),
        ({"body": " b ", "texto": ""}, "b"),
        ({}, None),
    ],
)
def test_main_text(spark, value, want):
    assert record(spark, value).select(records.body(F.col("r")).alias("x")).first().x == want


def test_fields_of_records(spark):
    r = record(spark, {"type": "x", "title": "T", "area": "adm", "metadata": {"orgao": "Supremo  Tribunal Federal", "ano": "2020b", "banca": "cebraspe", "explicacao": "why", "urn": "u"}})
    got = r.select(records.title(F.col("r")).alias("t"), records.explanation(F.col("r")).alias("e"), records.meta(F.col("r")).alias("m"), records.organised(records.meta(F.col("r"))).alias("o"), records.external_id(F.col("r")).alias("i")).first()
    assert (got.t, got.e, len(got.i)) == ("T", "why", 64)
    assert set(got.m) == {"area", "orgao", "ano", "banca", "explicacao", "urn"}
    assert got.o == {"tribunal": "STF", "materia": "Administrativo", "banca": "CEBRASPE", "lex_ml_urn": "u"}


@pytest.mark.parametrize(
    "raw, want",
    [
        ({"a": " um ", "B": "dois"}, {"A": "um", "B": "dois"}),
        ([{"letra": "a", "texto": "um"}, {"ordem": 2, "descricao": "dois"}], {"A": "um", "B": "dois"}),
        (["A) um", "(b) dois", "nothing"], {"A": "um", "B": "dois"}),
        ("a) um\nb - dois", {"A": "um", "B": "dois"}),
        (json.dumps({"c": "x"}), {"C": "x"}),
        ({"a": "first", "A": "last"}, {"A": "last"}),
    ],
)
def test_options_in_any_shape(spark, raw, want):
    raw = raw if isinstance(raw, str) else json.dumps(raw)
    assert one(spark, records.option_map(lit(raw))) == want


@pytest.mark.parametrize(
    "value, want",
    [
        ({"acertou": False}, True), ({"answeredCorrectly": True}, False), ({"gabarito": "b", "resposta_usuario": "c"}, True), ({"gabarito": "b", "userAnswer": "B"}, None), ({"resultado": "Errado"}, True),
        ({"errou": False, "classificacao": "CERTA"}, False), ({}, None), ({"correct_answer": "Alternativa D", "respostaMarcada": "a"}, True),
    ],
)
def test_wrong_right_or_unknown(spark, value, want):
    m = records.aligned(F.from_json(lit(json.dumps(value)), "map<string,string>"))
    assert one(spark, records.answered_wrong(m)) is want


def test_harvest(spark):
    question = {"enunciado": "Q", "alternativas": {"a": "x", "b": "y"}, "gabarito": "a", "acertou": True}
    free = {"pergunta": "a question of some length", "resposta_modelo": "an answer of ten"}
    rows = [(1, json.dumps({"data": [{"item": question}, free]})), (2, "{broken"), (3, json.dumps({"enunciado": "Q", "alternativas": {"a": "x"}})), (4, None)]
    got = harvest.questions(spark.createDataFrame(rows, "k int, p string"), "k", "p").collect()
    assert sorted((r.k, r.kind, r.wrong) for r in got) == [(1, "discursive", None), (1, "objective", False)]
    assert harvest.questions(spark.createDataFrame(rows, "k int, p string"), "k", "p", wrong_only=True).count() == 0
    assert len(harvest.objects('{"a":' * 900 + "1" + "}" * 900)) == 900 and harvest.objects("[" * 10**6) == []


def test_harvest_walks_all_of_a_long_payload(spark):
    one = {"statement_html": "Q", "options": [{"label": "a", "text": "x"}, {"label": "b", "text": "y"}], "gabarito": "b"}
    got = harvest.questions(spark.createDataFrame([(1, json.dumps([{"q": one}] * 3000))], "k int, p string"), "k", "p")
    assert got.filter("kind = 'objective' and answer = 'b'").count() == 3000


def test_identities(spark):
    for title, want in (("Lei nº 9.784/1999", ("lei", "9784", None)), ("Lei Complementar 95/1998 — x", ("lei_complementar", "95", None)), ("Medida Provisória 2.200-2/2001", ("medida_provisoria", "2200", "2")), ("Constituição Federal", ("constituicao", "1988", None)), ("Portaria 3", None), (None, None)):
        got = one(spark, legal.identity(lit(title)))
        assert (tuple(got) if got else None) == want
    assert one(spark, legal.label(legal.identity(lit("Lei 12527/2011")))) == "Lei nº 12.527"
    assert tuple(one(spark, legal.identity_in_url(lit("https://x.example/D5005.htm")))) == ("decreto", "5005", None)
    ok = references.issues(legal.identity(lit("Lei 9.784/1999")), legal.identity_in_url(lit("https://x.example/l9784.htm")), lit("t"))
    bad = references.issues(legal.identity(lit("Lei 9.784/1999")), legal.identity_in_url(lit("https://x.example/l9785.htm")), lit("t"))
    assert one(spark, ok) == ["OK"] and one(spark, bad) == ["NUMBER_TITLE_URL"]


def test_articles_and_revocation(spark):
    body = "Art. 1º um\n\nsegue o art. 3\n\nArt. 2 dois\nArt. 3º três (Revogado)\n\n  Art. 30 trinta"
    assert one(spark, legal.article(lit(body), F.lit(3))) == "Art. 3º três (Revogado)"
    assert one(spark, legal.article(lit(body), F.lit(1))) == "Art. 1º um\n\nsegue o art. 3" and one(spark, legal.article(lit(body), F.lit(9))) is None
    assert one(spark, legal.without_revoked(lit("a\n\nb (Revogada pela Lei 1)\n\nc (Incluído) (Revogado)\n\nd"))) == "a\n\nd"
    assert one(spark, legal.wholly_revoked(lit("x"), lit("~~" + "a" * 90 + "~~ " + "b" * 20))) and not one(spark, legal.wholly_revoked(lit("x"), lit("a" * 200)))
    assert [one(spark, legal.effect(lit(t))) for t in ("Revoga e altera", "Altera a", "Acrescenta", "x")] == ["revoke", "alter", "add", "unknown"]
    assert one(spark, legal.referred_laws(lit("a Lei nº 8.112, a lei 8112 e o Decreto-Lei 200"))) == ["8112", "200"]


def test_paragraphs_keep_digits_at_their_edges(spark):
    body = "0 a\n\n 1 b 1 \n\nc 555-9192\n \nd 3"
    assert one(spark, legal.paragraphs(lit(body))) == ["0 a", "1 b 1", "c 555-9192", "d 3"]
    assert one(spark, legal.without_revoked(lit(body))) == "0 a\n\n1 b 1\n\nc 555-9192\n\nd 3"
    page = legal.summary_page(lit("Publicação: 1/2/2003\n011 enunciado da súmula\n"), lit("x"))
    assert one(spark, page).statement == "011 enunciado da súmula"


def test_unique_paragraphs_are_told_by_whole_texts(spark, tmp_path):
    rows = [(i, f"x {i}", "en", "src1") for i in (3574, 5495, 1)] + [(7, "ends with 33", "de", "src2"), (8, "ends with 1034", "de", "src3")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # the text's paragraph is the fourth and, in lower case, the eleventh: digits 3, 1 and 0 stay
    got = {r.doc_id: r.paragraphs for r in citations.unique_paragraphs(spark, str(tmp_path)).collect()}
    assert got == {i: 7 for i in (3574, 5495, 1, 7, 8)}


def test_unique_paragraphs_of_other_spaces_and_capitals(spark, tmp_path):
    import duckdb

    edge = "".join(map(chr, (0xA0, 0x1680, 0x2003, 0x202F, 0x205F, 0x3000)))
    assert one(spark, legal.paragraphs(lit(f"{edge}a{edge}b {edge}\n\n{edge}\n\n\tc\u200b"))) == [f"a{edge}b", "\tc\u200b"]
    assert one(spark, text.lowered(lit("İI ΑΣ ΣΑΣ É"))) == "ii ασ σασ é"
    texts = [f"{edge}wide{edge}", "İI ΑΣ\n\nii ας\n\nii ασ", f"a\n\n{edge}\n\n{edge}A"]
    spark.createDataFrame([(i, t, "x", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, citations.unique_paragraphs(spark, str(tmp_path)).collect()))
    sql = citations.ORACLE_SQL["unique_paragraphs"].replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(duckdb.sql(sql).fetchall())


def test_impacts_are_counted_without_pairs(spark, sf_dir):
    hits = spark.createDataFrame([(i, "Revoga a Lei nº 8.001 e a Lei 8.002" if i % 2 else "Altera a Lei nº 8.001, e a lei 8001") for i in range(20)] + [(1, "Revoga a Lei nº 8.001"), (None, "Altera a Lei 8.009")], "h long, t string")
    laws = spark.createDataFrame([(i, f"lei {8001 + i % 3}") for i in range(30)] + [(0, "lei 8001"), (7, "lei 8009")], "e long, n string")
    counts = references.impact_counts(hits, "h", "t", laws, "e", "n")
    pairs = references.impacts(hits, "h", "t", laws, "e", "n").groupBy("law", "effect").agg(F.countDistinct("h").alias("hits"), F.countDistinct("e").alias("entries"))
    want = sorted(tuple(r) for r in pairs.collect())
    assert sorted(tuple(r) for r in counts.collect()) == want and len(want) == 4
    # both sides of the join are grouped already: no row of one law meets another row of it
    plan = citations.impact_hits(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_abstract_is_the_paragraph_of_the_sql(spark):
    assert one(spark, parsing.abstract(lit("0997 begins with a digit, long enough"))) == "0997 begins with a digit, long enough"
    assert one(spark, parsing.abstract(lit("  Um texto que basta como resumo.\nÉmentaux est un autre mot."))) == "Um texto que basta como resumo."
    assert one(spark, parsing.abstract(lit("Um texto que basta como resumo.\nEMENTA x"))) == "EMENTA x"


def test_parsing(spark):
    assert one(spark, parsing.pages(lit("a\n" * 10), 8)) == ["a\na\na\na", "a\na\na\na", "a\na"] and one(spark, parsing.pages(lit("ab\n\nc"), 8)) == ["ab\n\nc"]
    assert one(spark, parsing.change(lit("crude inventories fell by 1,234.0 thousand barrels"))) == -1.234
    assert one(spark, parsing.fenced_json(lit("```json\nx {\"a\": 1} y\n```"))) == '{"a": 1}'
    assert one(spark, parsing.front_matter(lit("---\na: b: c\n---\nx"))) == {"a": "b: c"}
    assert one(spark, parsing.article_numbers_plain(lit("Art. 1.026 e art 10.000"))) == "Art. 1026 e art 10000"
    assert one(spark, parsing.rewritten(lit("/ler x"), {"ler": "Leia"})) == "Leia x" and one(spark, parsing.rewritten(lit("ler x"), {"ler": "Leia"})) == "ler x"
    h = 2166136261
    for c in b"chave/1":
        h = (h ^ c) * 16777619 % 2**32
    assert one(spark, parsing.fnv(lit("chave/1"))) == h
    assert one(spark, parsing.shortened(lit("word " * 100))).endswith("word…")


def test_greeks(spark):
    up, down = (one(spark, numeric.black_scholes(F.lit(True), F.lit(100.0 + h), F.lit(105.0), F.lit(0.5), F.lit(0.1), F.lit(0.3))) for h in (0.01, -0.01))
    g = one(spark, numeric.greeks(F.lit(True), F.lit(100.0), F.lit(105.0), F.lit(0.5), F.lit(0.1), F.lit(0.3)))
    assert g.delta == pytest.approx((up - down) / 0.02, abs=1e-4)
    sooner = one(spark, numeric.black_scholes(F.lit(True), F.lit(100.0), F.lit(105.0), F.lit(0.5 - 1 / 365), F.lit(0.1), F.lit(0.3)))
    now = one(spark, numeric.black_scholes(F.lit(True), F.lit(100.0), F.lit(105.0), F.lit(0.5), F.lit(0.1), F.lit(0.3)))
    assert g.theta == pytest.approx(sooner - now, abs=1e-3)
    assert tuple(one(spark, numeric.greeks(F.lit(False), F.lit(90.0), F.lit(100.0), F.lit(0.0), F.lit(0.1), F.lit(0.3)))) == (-1.0, 0.0)


def test_dates(spark):
    ts = F.lit(datetime.datetime(2024, 3, 4, 20, 30)).cast("timestamp_ntz")
    assert one(spark, dates.local(ts, "America/Sao_Paulo")) == datetime.datetime(2024, 3, 4, 17, 30) and one(spark, dates.market_open(dates.local(ts, "America/Sao_Paulo")))
    day = F.lit(datetime.date(2024, 1, 31))
    assert one(spark, dates.releases(day, 3, 12)) == [datetime.date(2024, m, 12) for m in (1, 2, 3)]
    assert one(spark, dates.since(day, F.lit(None).cast("date"), 7)) == datetime.date(2024, 1, 24) and one(spark, dates.since(day, F.lit(datetime.date(2024, 1, 10)), 7)) == datetime.date(2024, 1, 9)


def test_chunks_equal_the_plain_cut(spark):
    import random

    rng = random.Random(3)
    texts = ["", " \n ", "a" * 50, "\n\n".join("x" * rng.randint(0, 30) for _ in range(40)), "a\n\n\n" * 60, "é " * 300, None] + ["".join(rng.choice("ab \n\n") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for r in catalogue.chunks(df, "k", size=60).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk)
    assert got == {k: catalogue.cut(t, 60) for k, t in enumerate(texts) if catalogue.cut(t, 60)}


def test_containment_equals_contains(spark):
    docs = [(1, "the quick brown fox jumps over the lazy dog"), (2, "a quick brown\tfox jumps"), (3, ""), (4, None), (5, "xquick brownx"), (6, "dog")]
    refs = [(1, "uick brown fox jumps o"), (2, "quick brown"), (3, "brown\tfox"), (4, "dog"), (5, " "), (6, "ick brown fo"), (7, None), (8, "the quick brown fox jumps over the lazy dog"), (9, "o"), (10, "rown fox jumps over the lazy do")]
    got = containment.holding(spark.createDataFrame(docs, "d int, t string"), "d", "t", spark.createDataFrame(refs, "r int, n string"), "r", "n").collect()
    assert sorted((x.d, x.r) for x in got) == sorted((d, r) for d, t in docs for r, n in refs if t and n and n.strip() and n in t)


def test_running_totals(spark):
    df = spark.createDataFrame([(i * 7 % 101, i % 5) for i in range(101)], "k int, v int").repartition(5)
    got = {r.k: (r._n, r.s) for r in ordered.running(ordered.running(df, ["k"]), ["k"], F.col("v"), "s").collect()}
    total = 0
    for n, (k, v) in enumerate(sorted((r.k, r.v) for r in df.collect()), 1):
        total += v
        assert got[k] == (n, total)
    days = allocation.round_robin(spark.createDataFrame([(g, i) for g in "ab" for i in range(3)], "g string, i int"), "g", "i", 2, 2).collect()
    assert sorted((r.day, r.turn, r.g) for r in days) == [(0, 1, "a"), (0, 1, "b"), (1, 2, "a"), (1, 2, "b"), (1, 3, "a"), (1, 3, "b")]
    assert one(spark, allocation.quota(F.lit(100), F.lit(7))) == 15


def test_merges(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "k string, at int, v string")
    got = merge.last_writer(frame(("a", 2, "l"), ("b", 1, "l")), frame(("a", 2, "r"), ("b", 3, "r"), ("c", 1, "r")), "k", "at", ["at", "v"]).collect()
    assert sorted((r.k, r.v, r.side) for r in got) == [("a", "l", "local"), ("b", "r", "remote"), ("c", "r", "remote")]
    assert [r.v for r in merge.keep_one(frame(("a", 2, "x"), ("a", 1, "y")), ["k"], [F.col("at")]).collect()] == ["y"]
    found = merge.first_candidate(spark.createDataFrame([(1, ["p", "q"]), (2, ["z"])], "i int, c array<string>"), "i", "c", spark.createDataFrame([("q", 5), ("p", 6)], "n string, w int"), "n").collect()
    assert [(r.i, r.place, r.w) for r in found] == [(1, 1, 6)]
    rows = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "id int, t string")
    assert [(r.q, r.id, r.score) for r in search.top_of_each(rows, ["beta alpha", "gamma"], "t", "id", 1).orderBy("q").collect()] == [(0, 1, 8), (1, 3, 12)]


def test_aligned_series(spark):
    d = lambda *x: datetime.date(2024, *x)
    a = spark.createDataFrame([(d(1, 1), 1.0), (d(3, 1), 3.0)], "d date, a double")
    b = spark.createDataFrame([(d(2, 1), 2.0), (d(3, 1), None)], "d date, b double")
    assert [tuple(r) for r in series.aligned(a, b, "d", ["a", "b"]).orderBy("d").collect()] == [(d(1, 1), 1.0, None), (d(2, 1), 1.0, 2.0), (d(3, 1), 3.0, 2.0)]


def test_fundamentals_of_unknown_issuers(spark):
    from vereda.functions import numeric

    df = spark.createDataFrame([(None,) * 9 + (False,), (8.0, 1.0, 5.0, 6.0, 20.0, 15.0, 10.0, 10.0, 50.0, False), (None, None, None, None, 14.84, None, None, None, None, True)], ", ".join(f"c{i} double" for i in range(9)) + ", bank boolean")
    got = [r.f for r in df.select(numeric.fundamentals(*[F.col(c) for c in df.columns]).alias("f")).collect()]
    assert (got[0].score, got[0].tag) == (0.0, "NEUTRA") and got[1].tag == "SÓLIDA"
    assert (got[2].score, got[2].tag) == (14.0, "NEUTRA")  # 14.2 is 14: the tag goes by the whole number
    fund = spark.createDataFrame([(0.9, 0.1), (1.5, 5.0), (None, None), (0.0, None)], "p double, d double")
    found = [r.f for r in fund.select(numeric.real_estate(F.col("p"), F.col("d")).alias("f")).collect()]
    assert found[0].valor == pytest.approx(0.55 * 10.5 + 0.45 * 60) and found[0].qualidade == pytest.approx(12) and found[0].tag == "SÓLIDA"
    assert found[1].qualidade == pytest.approx(0.6 * -24 + 0.4 * 10) and found[2].score == 0 and found[2].valor is None and found[3].qualidade == 0


def test_batches_of_texts_become_strings_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sections, "SLICE", 10)
    texts = ["a" * 4, None, "é" * 3, "", "b" * 25, "c", None]
    got = [p.to_pylist() for p in sections.parts(pa.array(texts))]
    assert got == [texts[:3], texts[3:5], texts[5:]]
    assert sections.parts(pa.array(texts).slice(4, 2))[0].to_pylist() == ["b" * 25]
    assert [p.to_pylist() for p in sections.parts(pa.array([], pa.string()))] == [[]]


def test_long_batches_keep_every_text(spark):
    rows = [(i, None if i % 7 == 0 else f"{i} " + "word\n\n" * (400 * (i % 5))) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, t string").coalesce(1)
    got = {r.i: (r.p, r.c) for r in df.select("i", parsing.pages(F.col("t")).alias("p"), catalogue.pieces(F.col("t")).alias("c")).collect()}
    assert got == {i: (sections.pages(t, parsing.PAGE), sections.pieces(t, catalogue.CHUNK)) for i, t in rows}
