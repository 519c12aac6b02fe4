"""Queries over open JSON records, each with its SQL.

The records are JSON text made of the tables' columns, in four shapes (by language): case law
with nested metadata, a law with a flat body, an objective question, and a list of articles.
Both sides read the fields back out of that text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records, text
from ..operators import harvest
from .common import table

#: White space that whole texts are squeezed by.
_WS = r"[ \t\n\r\f\x0B]+"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def open_records(spark, sf_dir) -> DataFrame:
    """(doc_id, rec) for every document, with its whole text."""
    case = F.to_json(F.struct("doc_id", F.lit("Acordao").alias("type"), F.concat(F.lit(" "), F.col("source")).alias("titulo"), F.struct(F.col("text").alias("ementa"), F.lit("supremo").alias("tribunal"), F.lit("direito  penal").alias("materia"), F.col("n_chars").cast("string").alias("ano")).alias("metadata")))
    law = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("").alias("type"), F.col("source").alias("epigrafe"), F.col("text").alias("dispositivo"), F.struct(F.lit("não").alias("vinculante"), F.col("source").alias("categoria_lei")).alias("meta")))
    option = lambda letter, body: F.struct(F.lit(letter).alias("letra"), body.alias("texto"))
    nested = F.struct(F.col("text").alias("texto_questao"), F.array(option("a", F.col("source")), option("b ", F.col("lang"))).alias("alternativas"), F.lit("b").alias("gabarito"), F.lit("cebraspe").alias("banca"), (F.col("doc_id") % 40).cast("string").alias("numero_questao"), F.lit("objetiva").alias("formato_questao"))
    question = F.to_json(F.struct(F.lit("questao").alias("type"), F.col("source").alias("title"), nested.alias("metadata")))
    article = lambda number, body: F.struct(number.alias("numero"), body.alias("texto"))
    articles = F.to_json(F.struct(F.col("source").alias("nome_lei"), F.array(article(F.lit("1"), F.col("text")), article(F.lit("Art. 2"), F.col("source"))).alias("artigos"), F.col("lang").alias("area")))
    by = F.when(F.col("lang") == "en", case).when(F.col("lang") == "fr", law).when(F.col("lang") == "de", question).otherwise(articles)
    return table(spark, sf_dir, "documents").select("doc_id", by.alias("rec"))


RECORDS = """r AS (SELECT doc_id, CASE lang
    WHEN 'en' THEN json_object('doc_id', doc_id, 'type', 'Acordao', 'titulo', ' ' || source, 'metadata', json_object('ementa', text, 'tribunal', 'supremo', 'materia', 'direito  penal', 'ano', n_chars::VARCHAR))
    WHEN 'fr' THEN json_object('id', doc_id, 'type', '', 'epigrafe', source, 'dispositivo', text, 'meta', json_object('vinculante', 'não', 'categoria_lei', source))
    WHEN 'de' THEN json_object('type', 'questao', 'title', source, 'metadata', json_object('texto_questao', text, 'alternativas', json_array(json_object('letra', 'a', 'texto', source), json_object('letra', 'b ', 'texto', lang)), 'gabarito', 'b',
        'banca', 'cebraspe', 'numero_questao', (doc_id % 40)::VARCHAR, 'formato_questao', 'objetiva'))
    ELSE json_object('nome_lei', source, 'artigos', json_array(json_object('numero', '1', 'texto', text), json_object('numero', 'Art. 2', 'texto', source)), 'area', lang) END AS rec FROM documents)"""


def _sql(names: list[str], *levels: str) -> str:
    """The first alias with a value, level by level."""
    at = levels or ("$",)
    return "coalesce(" + ", ".join(f"""nullif(trim(rec->>'{level}."{n}"'), '')""" for level in at for n in names) + ")"


_NESTED = ("$.metadata", "$.meta")
_ALL = ("$", *_NESTED)
_ARTICLES = """nullif(array_to_string(list_transform((rec->'$.artigos')::JSON[], lambda a: CASE WHEN lower(a->>'$.numero') LIKE 'art%' THEN (a->>'$.numero') ELSE 'Art. ' || (a->>'$.numero') END || chr(10) || trim(a->>'$.texto')), chr(10) || chr(10)), '')"""
_LINES = """array_to_string(list_transform((rec->'$.metadata.alternativas')::JSON[], lambda a: upper(trim(a->>'$.letra')) || ') ' || trim(a->>'$.texto')), chr(10))"""
_QUESTION = f"CASE WHEN (rec->'$.metadata.alternativas') IS NOT NULL THEN concat_ws(chr(10) || chr(10), {_sql(records.STATEMENT, *_ALL)}, {_LINES}, 'Gabarito (objetiva): ' || {_sql(records.KEY, *_ALL)}) END"
_BODY = f"coalesce({_sql(records.BODY_OF_LAW, *_ALL)}, {_ARTICLES}, {_QUESTION}, {_sql(records.BODY_OF_SUMMARY, *_ALL)}, {_sql(records.BODY_OF_CASE, *_ALL)}, {_sql(records.BODY_OF_ANY)})"


@query(f"WITH {RECORDS} SELECT doc_id, {_sql(records.BODY_OF_CASE + ['banca'], *_NESTED)} IS NOT NULL AS known, sha256(coalesce({_sql(records.BODY_OF_CASE + ['banca', 'categoria_lei'], *_NESTED)}, '')) AS found FROM r")
def nested_fields(spark, sf_dir):
    """Aliases looked up in nested metadata."""
    r = records.opened(F.col("rec"))
    found = records.nested(r, [*records.BODY_OF_CASE, "banca", "categoria_lei"])
    return open_records(spark, sf_dir).select("doc_id", records.nested(r, [*records.BODY_OF_CASE, "banca"]).isNotNull().alias("known"), F.sha2(F.coalesce(found, F.lit("")), 256).alias("found"))


@query(f"WITH {RECORDS}, b AS (SELECT doc_id, {_BODY} AS body, {_sql(records.TITLE)} AS title FROM r) SELECT doc_id, title, sha256(body) AS body_sha256, length(body) AS chars FROM b")
def record_bodies(spark, sf_dir):
    """Title and main text of every record."""
    rows = open_records(spark, sf_dir).select("doc_id", records.opened(F.col("rec")).alias("r"))
    made = rows.select("doc_id", records.title(F.col("r")).alias("title"), records.body(F.col("r")).alias("body"))
    return made.select("doc_id", "title", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("chars"))


@query(f"WITH {RECORDS}, b AS (SELECT doc_id, {_BODY} AS body, {_sql(records.TITLE)} AS title, {_sql(records.SOURCE_ID)} AS own FROM r) SELECT doc_id, coalesce(own, sha256(coalesce(title, '') || chr(10) || coalesce(body, ''))) AS external_id FROM b")
def record_ids(spark, sf_dir):
    """An external id, or a hash of title and body."""
    rows = open_records(spark, sf_dir).select("doc_id", records.opened(F.col("rec")).alias("r"))
    return rows.select("doc_id", records.external_id(F.col("r")).alias("external_id"))


@query(
    f"""WITH {RECORDS}, m AS (SELECT doc_id, rec, list_filter(json_keys(rec), lambda k: k NOT IN ({", ".join(f"'{n}'" for n in records.RESERVED)})) AS own, coalesce(json_keys(rec->'$.metadata'), json_keys(rec->'$.meta'), []::VARCHAR[]) AS nested FROM r)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(own, nested))), ',') AS names, coalesce(rec->>'$.metadata.gabarito', rec->>'$.gabarito') AS gabarito,
        array_to_string(list_sort(list_distinct(list_concat(list_concat(own, nested), CASE WHEN {_sql(records.KEY, *_ALL)} IS NOT NULL THEN ['gabarito'] ELSE []::VARCHAR[] END))), ',') AS flat FROM m"""
)
def record_meta(spark, sf_dir):
    """Names of the residual metadata, and of it with a question's answers lifted."""
    r = F.col("r")
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    rows = open_records(spark, sf_dir).select("doc_id", records.opened(F.col("rec")).alias("r"))
    rows = rows.select("doc_id", records.meta(r).alias("m"), records.flat_meta(r).alias("f"))
    return rows.select("doc_id", names(F.col("m")).alias("names"), F.try_element_at("f", F.lit("gabarito")).alias("gabarito"), names(F.col("f")).alias("flat"))


_CANON = lambda names, x, other: f"coalesce(MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in names.items())}}}[regexp_replace(lower({x}), '\\s+', ' ', 'g')], {other}({x}))"


@query(
    f"""WITH {RECORDS}, f AS (SELECT doc_id, {_sql(["tribunal", "court", "orgao"], "$.metadata")} AS t, {_sql(["materia", "assunto", "area"], "$.metadata")} AS m, {_sql(["banca", "orgao_examinador"], "$.metadata")} AS b,
        try_cast({_sql(["ano", "ano_prova"], "$.metadata")} AS INTEGER) AS ano, {_sql(["numero_questao"], "$.metadata")} AS numero, {_sql(["formato_questao"], "$.metadata")} AS formato, {_sql(["secao_lei_seca", "categoria_lei"], *_NESTED)} AS secao FROM r)
    SELECT doc_id, {_CANON(records.COURTS, "t", "upper")} AS tribunal, {_CANON(records.SUBJECTS, "m", "upper")} AS materia, {_CANON(records.BOARDS, "b", "upper")} AS banca, ano::VARCHAR AS ano, numero AS numero_questao,
        upper(formato[1]) || formato[2:] AS formato_questao, secao AS secao_lei_seca FROM f"""
)
def organised_fields(spark, sf_dir):
    """Canonical court, subject and board, year, number and format."""
    rows = open_records(spark, sf_dir).select("doc_id", records.opened(F.col("rec")).alias("r"))
    rows = rows.select("doc_id", records.organised(F.coalesce("r.metadata", "r.meta")).alias("o"))
    return rows.select("doc_id", *[F.try_element_at("o", F.lit(n)).alias(n) for n in ("tribunal", "materia", "banca", "ano", "numero_questao", "formato_questao", "secao_lei_seca")])


@query(
    f"""WITH {RECORDS}, b AS (SELECT doc_id, (rec->'$.metadata.alternativas') IS NOT NULL AS question, {_BODY} AS body, {_sql(records.TITLE)} AS title, lower(rec::VARCHAR) AS whole FROM r)
    SELECT doc_id, question, NOT question AND (length(coalesce(body, '')) >= 20 OR title IS NOT NULL) AS normative, contains(whole, 'cebraspe') AS hinted FROM b"""
)
def record_kinds(spark, sf_dir):
    """Whether a record is a question, a norm, or hints at a source."""
    rows = open_records(spark, sf_dir).select("doc_id", "rec", records.opened(F.col("rec")).alias("r"))
    r = F.col("r")
    rows = rows.select("doc_id", "rec", records.is_question(r).alias("question"), F.length(records.body(r)).alias("n"), records.title(r).alias("title"))
    normative = ~F.col("question") & ((F.coalesce("n", F.lit(0)) >= 20) | F.col("title").isNotNull())
    return rows.select("doc_id", "question", normative.alias("normative"), F.lower("rec").contains("cebraspe").alias("hinted"))


_SHAPES = """s AS (SELECT conv_id, turn, role, text, CASE conv_id % 4 WHEN 0 THEN json_object('a', ' ' || role || ' ', 'b', text)::VARCHAR WHEN 1 THEN json_array(json_object('letra', 'a', 'texto', text), json_object('ordem', 2, 'descricao', role))::VARCHAR
    WHEN 2 THEN json_array('A) ' || role, '(b) ' || text)::VARCHAR ELSE 'a) ' || role || chr(10) || 'b - ' || regexp_replace(text, '\\s+', ' ', 'g') END AS raw FROM conversations)"""


@query(
    f"""WITH {_SHAPES} SELECT conv_id, turn, 'A,B' AS letters, sha256(trim(CASE WHEN conv_id % 4 = 1 THEN text ELSE role END)) AS a,
        sha256(CASE conv_id % 4 WHEN 0 THEN trim(raw->>'$.b') WHEN 1 THEN trim(raw->>'$[1].descricao') WHEN 2 THEN trim(regexp_extract(raw->>'$[1]', '(?s)^\\(b\\)\\s*(.*)$', 1)) ELSE trim(regexp_extract(raw, '(?s)\\nb - (.*)$', 1)) END) AS b FROM s
        WHERE length(trim(text)) > 0"""
)
def option_maps(spark, sf_dir):
    """Options in four shapes as one map by letter."""
    c, k = table(spark, sf_dir, "conversations").filter("length(trim(text)) > 0"), F.col("conv_id") % 4
    item = lambda **f: F.to_json(F.struct(*[v.alias(n) for n, v in f.items()]))
    flat = F.regexp_replace("text", r"\s+", " ")
    raw = (
        F.when(k == 0, item(a=F.concat(F.lit(" "), F.col("role"), F.lit(" ")), b=F.col("text")))
        .when(k == 1, F.concat(F.lit("["), item(letra=F.lit("a"), texto=F.col("text")), F.lit(","), item(ordem=F.lit(2), descricao=F.col("role")), F.lit("]")))
        .when(k == 2, F.to_json(F.array(F.concat(F.lit("A) "), F.col("role")), F.concat(F.lit("(b) "), F.col("text")))))
        .otherwise(F.concat(F.lit("a) "), F.col("role"), F.lit("\nb - "), flat))
    )
    made = c.select("conv_id", "turn", records.option_map(raw).alias("o"))
    at = lambda n: F.sha2(F.try_element_at("o", F.lit(n)), 256)
    return made.select("conv_id", "turn", F.array_join(F.map_keys("o"), ",").alias("letters"), at("A").alias("a"), at("B").alias("b"))


@query(
    """WITH r AS (SELECT event_id, event_type, value, (props->>'$.k')::INTEGER AS k FROM events),
    a AS (SELECT event_id, event_type, k, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN value > 30 END AS flag, CASE WHEN event_type IN ('click', 'error') THEN substr('ABCDE', 1 + k % 5, 1) END AS key, substr('ABCDE', 1 + (value::INTEGER) % 5, 1) AS own FROM r)
    SELECT event_id, CASE WHEN event_type = 'view' THEN NOT flag WHEN event_type IN ('click', 'error') THEN CASE WHEN key <> own THEN true END WHEN event_type = 'purchase' THEN true END AS wrong FROM a"""
)
def wrong_answers(spark, sf_dir):
    """Wrong, right or unknown, out of flags, results and letters in several spellings."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    # as records: a flag in another spelling, a key and an answer, or a result
    own = F.substring(F.lit("ABCDE"), 1 + F.pmod(F.bround("value").cast("int"), F.lit(5)), F.lit(1))
    key = F.concat(F.lit("Alternativa "), F.substring(F.lit("ABCDE"), 1 + k % 5, F.lit(1)))
    rec = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct((F.col("value") > 30).alias("answeredCorrectly"))))
        .when(F.col("event_type").isin("click", "error"), F.to_json(F.struct(key.alias("resposta_certa"), own.alias("userAnswer"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(F.lit("Errado").alias("resultado"))))
        .otherwise("{}")
    )
    m = records.aligned(F.from_json(rec, "map<string,string>"))
    return e.select("event_id", records.answered_wrong(m).alias("wrong"))


@query(
    f"""SELECT page_id, CASE {" ".join(f"WHEN contains(lower(url), '{n}') THEN '{s}'" for n, s in records.NETWORKS)} ELSE 'exam_network' END AS network, url LIKE 'https://%' AND NOT regexp_matches(lower(url), '^https://(www[.])?(localhost|127[.])') AS publishable FROM pages"""
)
def network_sources(spark, sf_dir):
    """Where a question comes from, by its address, and whether the address may be published."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", records.network(u).alias("network"), (u.startswith("https://") & ~F.lower(u).rlike(r"^https://(www[.])?(localhost|127[.])")).alias("publishable"))


@query(
    """SELECT doc_id, contains(text, chr(65533)) OR (regexp_matches(text, 'Presid.{0,2}ncia') AND NOT contains(text, 'Presidência')) AS corrupt, length(text) - length(replace(text, '[', '')) AS brackets, (length(text) - length(replace(text, 'http', ''))) // 4 AS links,
        contains(text, chr(65533)) OR regexp_matches(text, '[ÃÂ][\\x{80}-\\x{BF}]') OR length(text) - length(replace(text, '[', '')) >= 4 OR length(text) - length(replace(text, 'http', '')) >= 12 OR regexp_matches(text, '\\[[^\\]]+\\]\\(https?://') AS reformat FROM documents"""
)
def encoding_checks(spark, sf_dir):
    """Broken encodings, and texts that need to be formatted again."""
    t = F.col("text")
    gone = lambda s: F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))
    corrupt = t.contains("�") | (t.rlike("Presid.{0,2}ncia") & ~t.contains("Presidência"))
    reformat = text.broken_encoding(t) | (gone("[") >= 4) | (gone("http") >= 12) | t.rlike(r"\[[^\]]+\]\(https?://")
    return table(spark, sf_dir, "documents").select("doc_id", corrupt.alias("corrupt"), gone("[").cast("long").alias("brackets"), F.floor(gone("http") / 4).alias("links"), reformat.alias("reformat"))


@query(
    """WITH f AS (SELECT o_orderkey, year(o_orderdate) AS ano, o_orderpriority AS p, o_orderstatus AS s FROM orders), t AS (SELECT o_orderkey, ano, list_filter([CASE WHEN p LIKE '1%' OR p LIKE '2%' THEN 'magistratura' END, CASE WHEN s = 'F' THEN 'procuradoria' END, CASE WHEN p LIKE '%LOW' THEN 'defensoria' END], lambda x: x IS NOT NULL) AS tags FROM f WHERE ano IN (1996, 1997, 1998))
    SELECT o_orderkey, ano, array_to_string(tags, ',') AS tags, list_contains(tags, 'procuradoria') AS chosen FROM t WHERE len(tags) > 0"""
)
def exam_window(spark, sf_dir):
    """Rows of an exam-year window with the careers that they fit."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    tags = F.array_compact(F.array(F.when(p.rlike("^[12]"), "magistratura"), F.when(s == "F", "procuradoria"), F.when(p.endswith("LOW"), "defensoria")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", records.exam_year(F.create_map(F.lit("ano"), F.col("o_orderdate").cast("string"))).alias("ano"), tags.alias("tags"))
    o = o.filter(F.col("ano").isin(1996, 1997, 1998) & (F.size("tags") > 0))
    return o.select("o_orderkey", F.col("ano").cast("long").alias("ano"), F.array_join("tags", ",").alias("tags"), F.array_contains("tags", "procuradoria").alias("chosen"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, role, max(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS back FROM conversations)
    SELECT conv_id, turn, trim(text) AS front, trim(back) AS back, right(conv_id::VARCHAR || ':' || turn::VARCHAR, 16) AS short_id, substr(trim(text), 1, 160) AS preview, regexp_extract(back, '(?s)<mark>(.*?)</mark>', 1) AS marked
    FROM c WHERE role = 'user' AND trim(text) <> '' AND trim(back) <> ''"""
)
def card_rows(spark, sf_dir):
    """Cards out of a question and the answer after it; cards without front or back go."""
    from pyspark.sql import Window

    nxt = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("back", F.when(F.lead("role").over(nxt) == "assistant", F.lead("text").over(nxt))).filter("role = 'user'")
    front, back = F.trim("text"), F.trim("back")
    c = c.filter((front != "") & (back != ""))
    return c.select("conv_id", "turn", front.alias("front"), back.alias("back"), F.right(F.concat_ws(":", "conv_id", "turn"), F.lit(16)).alias("short_id"), F.substring(front, 1, 160).alias("preview"), F.regexp_extract("back", r"(?s)<mark>(.*?)</mark>", 1).alias("marked"))


@query(
    """WITH b AS (SELECT e.event_id, e.event_type, e.value, (props->>'$.k')::INTEGER AS k FROM events e), j AS (SELECT event_id, event_type, least(greatest(value / 100.0, 0.0), 1.0) AS confidence, k FROM b)
    SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type END AS kind, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.62 AND event_type IN ('click', 'view', 'purchase') THEN 'ai:' || event_type ELSE 'base:' || (k % 3)::VARCHAR END AS subject FROM j"""
)
def merged_enrichment(spark, sf_dir):
    """Payloads checked and clamped, and merged into base fields where they are sure enough."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    payload = F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("value") / 100).alias("confidence"), F.concat(F.lit("ai:"), F.col("event_type")).alias("subject")))
    p = F.from_json(payload, "struct<kind:string,confidence:double,subject:string>")
    rows = e.select("event_id", p.alias("p"), F.concat(F.lit("base:"), (k % 3).cast("string")).alias("base"))
    kind = F.when(F.col("p.kind").isin("click", "view", "purchase"), F.col("p.kind"))
    sure = F.least(F.greatest(F.col("p.confidence"), F.lit(0.0)), F.lit(1.0))
    return rows.select("event_id", kind.alias("kind"), F.round(sure, 6).alias("confidence"), F.when((sure >= 0.62) & kind.isNotNull(), F.col("p.subject")).otherwise(F.col("base")).alias("subject"))


@query(
    """WITH q AS (SELECT doc_id, text FROM documents WHERE lang IS NULL OR lang <> 'fr' UNION ALL SELECT doc_id, reverse(text) AS text FROM documents WHERE lang = 'de'), d AS (SELECT doc_id, text FROM documents WHERE lang = 'fr')
    SELECT doc_id, 'objective' AS kind, count(*) AS found, sum(length(trim(text)))::BIGINT AS chars FROM q WHERE length(trim(text)) > 0 GROUP BY doc_id
    UNION ALL SELECT doc_id, 'discursive' AS kind, 1 AS found, length(trim(text)) AS chars FROM d WHERE length(trim(text)) >= 15"""
)
def harvest_rows(spark, sf_dir):
    """Question rows out of nested JSON payloads."""
    options = F.create_map(F.lit("a"), F.col("source"), F.lit("b"), F.lit("x"))
    one = lambda t: F.struct(t.alias("enunciado"), options.alias("alternativas"), F.lit("B").alias("gabarito"))
    free = F.struct(F.col("text").alias("enunciado"), F.lit("uma resposta de referência").alias("resposta_modelo"))
    d = table(spark, sf_dir, "documents")
    payload = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(F.struct(one(F.col("text")).alias("item")).alias("data"))))
        .when(F.col("lang") == "de", F.to_json(F.struct(F.array(F.struct(one(F.col("text")).alias("q")), F.struct(one(F.reverse("text")).alias("q"))).alias("items"))))
        .when(F.col("lang") == "fr", F.to_json(F.array(free)))
        .otherwise(F.to_json(F.array(F.struct(F.array(F.struct(F.lit(1).alias("n"), F.struct(F.col("text").alias("statement_html"), options.alias("options"), F.lit("a").alias("gabarito")).alias("q"))).alias("list")))))
    )
    rows = harvest.questions(d.select("doc_id", payload.alias("payload")), "doc_id", "payload")
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("found"), F.sum(F.length("statement")).alias("chars"))


@query(
    f"""WITH {RECORDS}, b AS (SELECT doc_id, rec, {_BODY} AS body, {_sql(records.TITLE)} AS title, lower(trim(coalesce(rec->>'$.type', ''))) AS kind FROM r),
    t AS (SELECT doc_id, title, trim(regexp_replace(body, '[ \t\n\r\f\x0B]+', ' ', 'g')) AS body, upper(trim(coalesce(rec->>'$.metadata.gabarito', rec->>'$.gabarito'))) AS letter,
        CASE WHEN kind LIKE '%acord%' OR kind LIKE '%juris%' THEN 'jurisprudencia' WHEN (rec->>'$.metadata.formato_questao') = 'objetiva' THEN 'questoes_objetivas' WHEN (rec->>'$.metadata.ementa') <> '' AND (rec->>'$.metadata.tribunal') <> '' THEN 'jurisprudencia' END AS doc_type FROM b)
    SELECT min(doc_id) AS doc_id, sha256(body) AS body_sha256, count(*) AS copies, arg_min(doc_type, doc_id) AS doc_type, arg_min(letter, doc_id) AS letter, arg_min(title, doc_id) AS title, max(length(body)) AS chars FROM t GROUP BY body"""
)
def doc_pipeline(spark, sf_dir):
    """The document cycle, and the flagship: records are opened, their main text is chosen and
    squeezed, type and answer are inferred, and of equal texts the first document stays."""
    r = F.col("r")
    rows = open_records(spark, sf_dir).select("doc_id", records.opened(F.col("rec")).alias("r"))
    # step by step: what several columns use is a column of its own
    rows = rows.select("doc_id", F.trim(F.regexp_replace(records.body(r), _WS, " ")).alias("body"), records.flat_meta(r).alias("flat"), records.title(r).alias("title"), F.coalesce(records.value(F.col("r.top"), "type"), F.lit("")).alias("kind"))
    kind, flat = F.col("kind"), F.col("flat")
    rows = rows.select("doc_id", F.sha2("body", 256).alias("body_sha256"), F.length("body").cast("long").alias("chars"), "title", text.document_type(kind, flat).alias("doc_type"), records.value(flat, "gabarito").alias("key"))
    rows = rows.withColumn("letter", text.answer_letter(F.col("key")))
    first = F.min_by(F.struct("doc_id", "doc_type", "letter", "title"), "doc_id")
    g = rows.groupBy("body_sha256").agg(first.alias("x"), F.count("*").alias("copies"), F.max("chars").alias("chars"))
    return g.select("x.doc_id", "body_sha256", "copies", "x.doc_type", "x.letter", "x.title", "chars")
