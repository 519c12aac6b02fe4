"""Queries over free text, metadata and study plans, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numeric, parsing, records
from ..operators import allocation, catalogue
from .common import rounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(
    r"""WITH RECURSIVE l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents),
    r AS (SELECT doc_id, text, ls, 0 AS i, 0 AS page, 0 AS used FROM l UNION ALL
        SELECT doc_id, text, ls, i + 1, CASE WHEN used > 0 AND used + length(ls[i + 1]) + 1 > 2800 THEN page + 1 ELSE page END, CASE WHEN used > 0 AND used + length(ls[i + 1]) + 1 > 2800 THEN length(ls[i + 1]) + 1 ELSE used + length(ls[i + 1]) + 1 END FROM r WHERE i < len(ls)),
    p AS (SELECT doc_id, page, string_agg(ls[i], chr(10) ORDER BY i) AS body FROM r WHERE i > 0 AND length(text) > 3360 GROUP BY doc_id, page)
    SELECT doc_id, page::INTEGER AS page, sha256(body) AS body_sha256 FROM p UNION ALL SELECT doc_id, 0 AS page, sha256(text) AS body_sha256 FROM documents WHERE length(text) <= 3360"""
)
def text_pages(spark, sf_dir):
    """Texts packed into pages, line by line."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parsing.pages(F.col("text"))).alias("page", "body"))
    return p.select("doc_id", "page", F.sha2("body", 256).alias("body_sha256"))


_COURT = "CASE " + " ".join(f"WHEN contains(lower(u), '{n}') THEN '{c}'" for n, c in parsing.COURT_NEEDLES) + " END"
_URLS = "x AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'https://x.example/stj/sumula-' || page_id::VARCHAR WHEN 1 THEN 'https://x.example/stf-vinculante/sumula-vinculante-' || (page_id % 60)::VARCHAR WHEN 2 THEN 'https://x.example/tst/tema-repetitivo-' || page_id::VARCHAR WHEN 3 THEN 'https://planalto.example/ccivil/L' || (8000 + page_id)::VARCHAR || 'comp.htm' WHEN 4 THEN 'https://x.example/temas-stj/tema-' || page_id::VARCHAR ELSE url END AS u FROM pages)"


def _urls(spark, sf_dir) -> DataFrame:
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 6
    u = F.when(k == 0, F.concat(F.lit("https://x.example/stj/sumula-"), i)).when(k == 1, F.concat(F.lit("https://x.example/stf-vinculante/sumula-vinculante-"), (F.col("page_id") % 60).cast("string"))).when(k == 2, F.concat(F.lit("https://x.example/tst/tema-repetitivo-"), i))
    u = u.when(k == 3, F.concat(F.lit("https://planalto.example/ccivil/L"), (8000 + F.col("page_id")).cast("string"), F.lit("comp.htm"))).when(k == 4, F.concat(F.lit("https://x.example/temas-stj/tema-"), i)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", u.alias("u"))


@query(
    f"""WITH RECURSIVE {_URLS}, f AS (SELECT page_id, u, 0 AS i, 2166136261::BIGINT AS h FROM x UNION ALL SELECT page_id, u, i + 1, (xor(h, ascii(u[i + 1])::BIGINT) * 16777619) % 4294967296 FROM f WHERE i < length(u)),
    d AS (SELECT page_id, u, h FROM f WHERE i = length(u)), c AS (SELECT *, {_COURT} AS court FROM d)
    SELECT page_id, court, CASE WHEN contains(lower(u), 'sumula') THEN 'sumula' WHEN contains(u, 'planalto') THEN 'legislacao' ELSE 'jurisprudencia' END AS doc_type, CASE WHEN regexp_matches(lower(u), 'l(\\d{{4,5}})') THEN 'Lei nº ' || replace(format('{{:,}}', regexp_extract(lower(u), 'l(\\d{{4,5}})', 1)::BIGINT), ',', '.') END AS title,
        CASE WHEN regexp_matches(u, 'sumula-vinculante-\\d') THEN 'sumula-stf-sv-' || regexp_extract(u, 'sumula-vinculante-(\\d+)', 1) WHEN regexp_matches(u, 'sumula-\\d') THEN 'sumula-' || lower(coalesce(court, 'stf')) || '-' || regexp_extract(u, 'sumula-(\\d+)', 1)
        WHEN regexp_matches(u, 'tema-repetitivo-\\d') THEN 'tema-' || lower(coalesce(court, 'stf')) || '-rep-' || regexp_extract(u, 'tema-repetitivo-(\\d+)', 1) WHEN regexp_matches(u, 'tema-\\d') THEN 'tema-' || lower(coalesce(court, 'stf')) || '-' || regexp_extract(u, 'tema-(\\d+)', 1)
        WHEN regexp_matches(u, '/L\\d+comp\\.htm') THEN 'lei-' || regexp_extract(u, '/L(\\d+)comp', 1) ELSE 'doc-' || lower(to_base(h, 36)) END AS route FROM c"""
)
def page_routes(spark, sf_dir):
    """Court, kind, title and short id of addresses."""
    u = F.col("u")
    court = parsing.court(u)
    kind = F.when(F.lower(u).contains("sumula"), "sumula").when(u.contains("planalto"), "legislacao").otherwise("jurisprudencia")
    return _urls(spark, sf_dir).select("page_id", court.alias("court"), kind.alias("doc_type"), parsing.law_title(u).alias("title"), parsing.route(u, court, u).alias("route"))


@query(
    """WITH t AS (SELECT event_id, event_type, value, (props->>'$.k')::INTEGER AS k FROM events), s AS (SELECT event_id, CASE event_type WHEN 'click' THEN -round(value, 2) WHEN 'view' THEN round(value, 2) WHEN 'purchase' THEN -round(value) / 1000 END AS v FROM t)
    SELECT event_id, round_even(v, 3) AS change, CASE WHEN v IS NULL THEN 'unknown' WHEN round_even(v, 3) < -0.5 THEN 'strong draw' WHEN round_even(v, 3) < 0 THEN 'draw' WHEN round_even(v, 3) > 0.5 THEN 'strong build' WHEN round_even(v, 3) > 0 THEN 'build' ELSE 'flat' END AS reading FROM s"""
)
def stock_changes(spark, sf_dir):
    """Changes that sentences report, signed by their verbs."""
    number = lambda x, n: F.regexp_replace(F.format_number(x, n), ",", "")
    v = F.round("value", 2)
    s = F.when(F.col("event_type") == "click", F.concat(F.lit("Stocks Decreased by "), number(v, 2), F.lit("million barrels."))).when(F.col("event_type") == "view", F.concat(F.lit("They rose by "), number(v, 2), F.lit(" million barrels"))).when(F.col("event_type") == "purchase", F.concat(F.lit("gasoline drew by "), number(F.round("value", 0), 0), F.lit(" thousand barrels"))).otherwise("no news")
    change = parsing.change(s)
    return table(spark, sf_dir, "events").select("event_id", change.alias("change"), parsing.reading(change).alias("reading"))


@query(
    """WITH c AS (SELECT event_type, round_even(avg(CASE WHEN event_type IN ('click', 'view') THEN value END), 6) AS m FROM events GROUP BY 1), s AS (SELECT round(-avg(m), 6) AS signal FROM c)
    SELECT signal, CASE WHEN signal > 0.3 THEN 'altista' WHEN signal < -0.3 THEN 'baixista' ELSE 'neutro' END AS label FROM s"""
)
def inventory_signal(spark, sf_dir):
    """A composite of the changes that are known."""
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.bround(F.avg(F.when(F.col("event_type").isin("click", "view"), F.col("value"))), 6).alias("m"))
    s = c.agg(F.round(-F.avg("m"), 6).alias("signal"))
    return s.select("signal", F.when(F.col("signal") > 0.3, "altista").when(F.col("signal") < -0.3, "baixista").otherwise("neutro").alias("label"))


@query(
    r"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT conv_id, turn, sha256(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+$', ''))) AS body_sha256, role AS kind, CASE WHEN role = 'user' THEN trim('Procure no acervo: ' || text) ELSE text END AS command, 'nota ' || turn::VARCHAR AS title FROM c"""
)
def parsed_messages(spark, sf_dir):
    """JSON out of fenced text, front matter, and slash commands."""
    c = table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("role").alias("kind"), F.col("text").alias("body"))), F.lit("\n```"))
    j = F.from_json(parsing.fenced_json(fenced), "struct<kind:string,body:string>")
    front = parsing.front_matter(F.concat(F.lit("---\ntitle:  nota "), F.col("turn").cast("string"), F.lit(" \nx: a:b\n---\n"), F.col("text")))
    command = parsing.rewritten(F.when(F.col("role") == "user", F.concat(F.lit("/buscar "), F.col("text"))).otherwise(F.col("text")), {"buscar": "Procure no acervo:", "ler": "Leia o documento:"})
    return c.select("conv_id", "turn", F.sha2(F.trim(F.regexp_replace(j["body"], r"[ \t\n\r\f\x0B]+$", "")), 256).alias("body_sha256"), j["kind"].alias("kind"), command.alias("command"), F.try_element_at(front, F.lit("title")).alias("title"))


@query(
    r"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(s)) AS ps, text FROM documents), a AS (SELECT doc_id, text, coalesce(list_filter(ps, lambda p: regexp_matches(lower(p), '^(ementa|resumo|dispoe|altera|institui)'))[1], list_filter(ps, lambda p: length(p) >= 20)[1]) AS abstract FROM p),
    s AS (SELECT doc_id, text, abstract, length(substr(abstract, 1, 280)) - strpos(reverse(substr(abstract, 1, 280)), ' ') AS pos, strpos(reverse(substr(abstract, 1, 280)), ' ') AS sp FROM a)
    SELECT doc_id, CASE WHEN length(abstract) <= 280 THEN abstract ELSE regexp_replace(CASE WHEN sp > 0 AND pos > 80 THEN substr(abstract, 1, pos) ELSE substr(abstract, 1, 280) END, '[\s,;:.]+$', '') || '…' END AS preview,
        regexp_replace(regexp_extract(text, '\d{1,2}/\d{2}/\d{4}', 0), '^$', '') AS day FROM s"""
)
def text_previews(spark, sf_dir):
    """Abstracts of whole texts, shortened at a space."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", parsing.shortened(parsing.abstract(t)).alias("preview"), F.regexp_extract(t, r"\d{1,2}/\d{2}/\d{4}", 0).alias("day"))


_TOPICS = {"penal": ["the ", "that"], "civil": ["une ", "pour"], "geral": ["und ", "der "]}


@query(
    "WITH h AS (SELECT doc_id, translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñýÿ', 'aaaaaaeeeeiiiiooooouuuucnyy') AS t FROM documents), n AS (SELECT doc_id, "
    + ", ".join(f"({' + '.join(f'contains(t, {w!r})::INT' for w in words)}) AS n{i}" for i, words in enumerate(_TOPICS.values()))
    + " FROM h) SELECT doc_id, CASE WHEN greatest(n0, n1, n2) = 0 THEN 'outros' WHEN n0 >= n1 AND n0 >= n2 THEN 'penal' WHEN n1 >= n2 THEN 'civil' ELSE 'geral' END AS topic FROM n"
)
def text_topics(spark, sf_dir):
    """The discipline with the most keyword hits in the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", parsing.topic(F.col("text"), _TOPICS, "outros").alias("topic"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, md5(conv_id::VARCHAR || ':' || text) AS key FROM conversations WHERE role = 'user'), m AS (SELECT md5(conv_id::VARCHAR || ':' || text) AS key, min(turn) AS answer FROM conversations WHERE turn < 2 GROUP BY 1), k AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT c.conv_id, c.turn, m.answer, coalesce(k.last, -1) AS last, CASE WHEN m.key IS NULL THEN 'new' ELSE 'known' END AS state FROM c LEFT JOIN m ON m.key = c.key LEFT JOIN k ON k.conv_id = c.conv_id"""
)
def cached_answers(spark, sf_dir):
    """Questions looked up in a memo by the hash of id and text, and in a sidecar by id."""
    c = table(spark, sf_dir, "conversations")
    key = F.md5(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("text")))
    memo = c.filter("turn < 2").groupBy(key.alias("key")).agg(F.min("turn").alias("answer"))
    side = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    q = c.filter("role = 'user'").select("conv_id", "turn", key.alias("key")).join(memo, "key", "left").join(side, "conv_id", "left")
    return q.select("conv_id", "turn", "answer", F.coalesce("last", F.lit(-1)).alias("last"), F.when(F.col("answer").isNull(), "new").otherwise("known").alias("state"))


@query(
    """WITH l AS (SELECT l_partkey, max(l_shipdate)::DATE AS d, arg_max(l_extendedprice, struct_pack(d := l_shipdate, k := l_orderkey, n := l_linenumber, e := l_extendedprice)) AS price FROM lineitem GROUP BY 1), m AS (SELECT max(d) AS now FROM l),
    s AS (SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1)
    SELECT p_partkey, CASE WHEN date_diff('day', l.d, now) <= 45 THEN l.d END AS recent, round(l.price, 2) AS price, s.n, s.disc FROM part CROSS JOIN m LEFT JOIN l ON l_partkey = p_partkey LEFT JOIN s ON l_suppkey = p_partkey"""
)
def joined_quotes(spark, sf_dir):
    """Parts with their last price, the day if it is recent, and figures of another table."""
    li = table(spark, sf_dir, "lineitem")
    last = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.to_date(F.max("l_shipdate")).alias("d"), F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")).alias("price"))
    now = li.agg(F.to_date(F.max("l_shipdate")).alias("m")).first()["m"]
    s = li.groupBy(F.col("l_suppkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("disc"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(last, "p_partkey", "left").join(s, "p_partkey", "left")
    return p.select("p_partkey", F.when(F.date_diff(F.lit(now), "d") <= 45, F.col("d")).alias("recent"), F.round("price", 2).alias("price"), "n", "disc")


#: Specifications by priority: what fits, and how many are taken.
_SPECS = [("p_type = 'PROMO'", 3), ("p_size <= 10", 5), ("p_type IN ('PROMO', 'SMALL')", 4), ("p_size <= 20 AND p_type <> 'LARGE'", 6)]


def _greedy() -> str:
    """One specification after the other, each from what is left."""
    steps, taken = [], []
    for i, (fits, take) in enumerate(_SPECS, 1):
        left = "".join(f" AND p_partkey NOT IN (SELECT p_partkey FROM s{j})" for j in taken)
        steps.append(f"s{i} AS (SELECT p_partkey, {i} AS spec, (row_number() OVER (ORDER BY p_partkey))::INTEGER AS place FROM part WHERE {fits}{left} QUALIFY place <= {take})")
        taken.append(i)
    return "WITH " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT p_partkey, spec, place FROM s{i}" for i in taken)


@query(_greedy())
def spec_matches(spark, sf_dir):
    """Specifications against documents without reuse; what a full one turns away goes to its
    second choice."""
    specs = spark.createDataFrame([(i, i, take) for i, (_, take) in enumerate(_SPECS, 1)], "spec int, prio int, take int")
    fits = F.array_compact(F.array(*[F.when(F.expr(e), F.lit(i)) for i, (e, _) in enumerate(_SPECS, 1)]))
    return allocation.matched(table(spark, sf_dir, "part").select("p_partkey", F.explode(fits).alias("spec")), "p_partkey", specs)


@query(
    """WITH q AS (SELECT o_orderkey, o_custkey % 3 = 0 AS mine, o_orderpriority, year(o_orderdate) AS ano, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O')), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN mine THEN 0 ELSE 1 END, ano DESC, o_orderkey) AS k FROM q)
    SELECT o_orderpriority, o_orderkey, mine, ano, k::INTEGER AS place FROM r WHERE k <= 25"""
)
def question_pool(spark, sf_dir):
    """The pool of questions of each subject: preferred board first, then newer ones, to a cap."""
    q = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", (F.col("o_custkey") % 3 == 0).alias("mine"), "o_orderpriority", F.year("o_orderdate").cast("long").alias("ano"))
    w = Window.partitionBy("o_orderpriority").orderBy(F.when(F.col("mine"), 0).otherwise(1), F.desc("ano"), "o_orderkey")
    return q.withColumn("place", F.row_number().over(w)).filter("place <= 25").select("o_orderpriority", "o_orderkey", "mine", "ano", "place")


@query(
    """WITH d AS (SELECT p_brand, p_partkey, p_size AS u, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) - p_size AS lo, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part WHERE p_size > 0),
    b AS (SELECT *, greatest(1, ceil(total / 30.0))::BIGINT AS bite FROM d), x AS (SELECT p_brand, p_partkey, bite, lo, lo + u AS hi, unnest(generate_series(((lo) // bite)::BIGINT, ((lo + u - 1) // bite)::BIGINT)) AS day FROM b)
    SELECT p_brand, p_partkey, day::BIGINT AS day, (least(hi, (day + 1) * bite) - greatest(lo, day * bite))::BIGINT AS n FROM x"""
)
def interleaved_plan(spark, sf_dir):
    """Every group a proportional bite each day, so that all groups end within thirty days."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    p = table(spark, sf_dir, "part").filter("p_size > 0").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("u"))
    total = p.groupBy("p_brand").agg(F.greatest(F.ceil(F.sum("u") / 30.0), F.lit(1)).alias("bite"))
    p = p.withColumn("hi", F.sum("u").over(w)).withColumn("lo", F.col("hi") - F.col("u")).join(total, "p_brand")
    p = p.select("*", F.explode(F.sequence(F.floor(F.col("lo") / F.col("bite")), F.floor((F.col("hi") - 1) / F.col("bite")))).alias("day"))
    return p.select("p_brand", "p_partkey", "day", (F.least("hi", (F.col("day") + 1) * F.col("bite")) - F.greatest("lo", F.col("day") * F.col("bite"))).alias("n"))


@query(
    """WITH g AS (SELECT l_returnflag AS side, l_shipdate::DATE AS d, l_linenumber AS cell, l_extendedprice * (l_discount - 0.05) AS pnl FROM lineitem), f AS (SELECT side, cell, count(DISTINCT d) AS sessions, 100.0 * count(*) FILTER (WHERE pnl > 0) / count(*) AS rate FROM g GROUP BY 1, 2), c AS (SELECT side, 100.0 * count(*) FILTER (WHERE pnl > 0) / count(*) AS rate FROM g GROUP BY 1)
    SELECT c.side, k.cell::INTEGER AS cell, round(CASE WHEN f.sessions >= 6 THEN f.rate ELSE c.rate END, 6) AS rate, coalesce(f.sessions >= 6, false) AS granular FROM c CROSS JOIN (SELECT unnest(generate_series(1, 9)) AS cell) k LEFT JOIN f ON f.side = c.side AND f.cell = k.cell"""
)
def live_cells(spark, sf_dir):
    """The rate of a fine cell where it has enough sessions, else of its coarse one."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), F.to_date("l_shipdate").alias("d"), F.col("l_linenumber").alias("cell"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))
    rate = 100.0 * F.count_if(F.col("pnl") > 0) / F.count("*")
    fine = g.groupBy("side", "cell").agg(F.countDistinct("d").alias("sessions"), rate.alias("fine"))
    coarse = g.groupBy("side").agg(rate.alias("coarse")).select("side", "coarse", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("cell"))
    j = coarse.join(fine, ["side", "cell"], "left")
    granular = F.coalesce(F.col("sessions") >= 6, F.lit(False))
    return rounded(j.select("side", "cell", F.when(granular, F.col("fine")).otherwise(F.col("coarse")).alias("rate"), granular.alias("granular")))


@query(
    """WITH o AS (SELECT p_partkey, p_partkey % 2 = 0 AS call, 100.0 + p_size AS spot, 110.0 AS strike FROM part), m AS (SELECT *, unnest(generate_series(-3, 8)) AS step FROM o)
    SELECT p_partkey, step::INTEGER AS step, round(CASE WHEN call THEN greatest(spot * (1 + step * 0.05) - strike, 0) - 2 ELSE greatest(strike - spot * (1 + step * 0.05), 0) - 2 END, 6)::DOUBLE AS pnl FROM m"""
)
def scenario_results(spark, sf_dir):
    """What a position is worth at expiry in twelve moves of the spot."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2 == 0).alias("call"), (100.0 + F.col("p_size")).alias("spot"), F.explode(F.sequence(F.lit(-3), F.lit(8))).alias("step"))
    moved = F.col("spot") * (1 + F.col("step") * 0.05)
    worth = numeric.black_scholes(F.col("call"), moved, F.lit(110.0), F.lit(0.0), F.lit(0.1), F.lit(0.4))
    return rounded(p.select("p_partkey", "step", (worth - 2).alias("pnl")))


@query(
    """WITH c AS (SELECT conv_id, turn, text FROM conversations), k AS (SELECT conv_id, 'doc-' || substr(sha256(conv_id::VARCHAR), 1, 12) AS fp, turn, length(text) AS n, 'Documento ' || conv_id::VARCHAR || chr(10) || text AS body FROM c)
    SELECT fp || '-' || turn::VARCHAR AS id, conv_id, sha256(body) AS body_sha256, 'titulo=Documento ' || conv_id::VARCHAR || ';tribunal=STJ;versao=2' AS metadata FROM k"""
)
def chunk_rows(spark, sf_dir):
    """Chunk rows with a header, a deterministic id and canonical metadata; what the base has wins."""
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("Documento "), F.col("conv_id").cast("string"))
    base = F.create_map(F.lit("titulo"), name, F.lit("versao"), F.lit("2"), F.lit("secao"), F.lit(None).cast("string"))
    extra = F.create_map(F.lit("tribunal"), F.lit("STJ"), F.lit("versao"), F.lit("1"))
    known = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    meta = records.merged(extra, known(base))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    ident = F.concat(F.lit("doc-"), F.substring(F.sha2(F.col("conv_id").cast("string"), 256), 1, 12), F.lit("-"), F.col("turn").cast("string"))
    return c.select(ident.alias("id"), "conv_id", F.sha2(F.concat_ws("\n", name, "text"), 256).alias("body_sha256"), shown.alias("metadata"))


@query("SELECT doc_id, source, sha256(source || ' · ' || lang || chr(10) || text) AS snippet_sha256, CASE WHEN n_chars > 5000 THEN 'Texto longo' ELSE 'Texto' END || ' em ' || lang || CASE WHEN contains(text, '?') THEN ', com pergunta' ELSE '' END AS readout FROM documents WHERE lang IN ('en', 'fr')")
def visible_rows(spark, sf_dir):
    """Rows that a reader may see, with a snippet and a read-out of the parts that hold."""
    allowed = spark.createDataFrame([("en",), ("fr",)], "lang string")
    d = table(spark, sf_dir, "documents").join(F.broadcast(allowed), "lang", "left_semi")
    read = F.concat(F.when(F.col("n_chars") > 5000, "Texto longo").otherwise("Texto"), F.lit(" em "), F.col("lang"), F.when(F.col("text").contains("?"), ", com pergunta").otherwise(""))
    return d.select("doc_id", "source", F.sha2(F.concat(F.concat_ws(" · ", "source", "lang"), F.lit("\n"), F.col("text")), 256).alias("snippet_sha256"), read.alias("readout"))


@query(
    """WITH a AS (SELECT 'documents' AS catalogue, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations), t AS (SELECT sum(n) AS total FROM a)
    SELECT catalogue, n, round(100.0 * n / total, 6) AS share FROM a, t"""
)
def catalogue_counts(spark, sf_dir):
    """Totals of several catalogues and their shares."""
    counts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("catalogue"), "n") for t in ("documents", "pages", "conversations")]
    a = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return a.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # three rows


@query(
    """WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head FROM pages)
    SELECT page_id, title = head AS equal, round(CASE WHEN title = head THEN 1.0 ELSE 1 - levenshtein(title, head)::DOUBLE / greatest(length(title), length(head)) END, 6) AS likeness FROM t WHERE length(title) + length(head) > 0"""
)
def title_audit(spark, sf_dir):
    """How like the titles of a page are to its heads."""
    at = lambda tag: F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    t = table(spark, sf_dir, "pages").select("page_id", at("title").alias("title"), at("h1").alias("head")).filter("length(title) + length(head) > 0")
    like = F.when(F.col("title") == F.col("head"), 1.0).otherwise(1 - F.levenshtein("title", "head") / F.greatest(F.length("title"), F.length("head")))
    return rounded(t.select("page_id", (F.col("title") == F.col("head")).alias("equal"), like.alias("likeness")))
