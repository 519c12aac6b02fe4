"""Document queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tables, text
from ..operators import allocation, catalogue, containment, merge, search
from ..operators.ordered import running
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


_URL_SQL = "regexp_replace(regexp_replace(lower(regexp_replace(trim(url), '^http://', 'https://', 'i')), '#.*$', ''), '/+$', '')"
_REST = "regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"
_PATH = f"regexp_replace(regexp_extract({_REST}, '^[^/]*(/.*)$', 1), '/+$', '')"
_URL_PY = f"'https://' || lower(regexp_extract({_REST}, '^([^/]*)', 1)) || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END"


@query(f"SELECT page_id, {_URL_SQL} AS lowered, {_URL_PY} AS canonical, substr(sha256({_URL_PY}), 1, 12) AS fingerprint FROM pages")
def url_normalise(spark, sf_dir):
    """Both URL normal forms and the fingerprint."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.url_lowered(u).alias("lowered"), text.url_canonical(u).alias("canonical"), text.fingerprint(text.url_canonical(u)).alias("fingerprint"))


@query(
    f"""WITH p AS (SELECT {_URL_PY} AS doc_key, page_id, url, length(html) AS n FROM pages)
    SELECT doc_key, max(url) AS url, count(*) AS chunk_count, sum(n)::BIGINT AS chars, arg_min(url, page_id) AS metadata FROM p GROUP BY doc_key"""
)
def catalog_pages(spark, sf_dir):
    """Pages grouped by canonical URL."""
    u = text.url_canonical(F.col("url"))
    g = table(spark, sf_dir, "pages").groupBy(u.alias("doc_key"))
    return g.agg(F.max("url").alias("url"), F.count("*").alias("chunk_count"), F.sum(F.length("html")).alias("chars"), F.min_by("url", "page_id").alias("metadata"))


@query("SELECT conv_id, max(role) AS role, count(*) AS chunk_count, arg_min(text, turn) AS metadata FROM conversations GROUP BY conv_id")
def catalog_documents(spark, sf_dir):
    """Catalogue of conversations taken as documents, turns as chunks."""
    got = catalogue.catalogue(table(spark, sf_dir, "conversations"), F.col("conv_id"), "turn", {"role": F.col("role")}, F.col("text"))
    return got.withColumnRenamed("doc_key", "conv_id")


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def document_text(spark, sf_dir):
    """Chunks of each document, in order, as one text."""
    return catalogue.joined_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS k FROM conversations) WHERE k > 20 AND k <= 70")
def catalog_page(spark, sf_dir):
    """An ordered page of fifty rows after the first twenty."""
    return catalogue.page(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], 50, 20)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def distinct_on(spark, sf_dir):
    """The first turn of each conversation."""
    return merge.best(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn"), ["turn", "role", "text"], last=False)


@query("SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn)::INTEGER AS seq FROM conversations")
def sequence_in_group(spark, sf_dir):
    """A running number within conversation and role."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.row_number().over(w).alias("seq"))


_SQUEEZED = "trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256({_SQUEEZED}) AS content_hash FROM documents GROUP BY {_SQUEEZED}")
def dedupe_ranked(spark, sf_dir):
    """Documents that differ in case and spacing only, as one."""
    same = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " "))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(same, 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_FEED = "SELECT doc_id, doc_id // 2 AS key, source, lang, n_chars, text FROM documents"


@query(f"SELECT key, arg_max(doc_id, doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM ({_FEED}) GROUP BY key")
def merge_last(spark, sf_dir):
    """Two feeds by key, the later row wins."""
    d = _feed(spark, sf_dir)
    return merge.best(d, ["key"], F.col("doc_id"), ["doc_id", "lang"])


def _feed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).alias("key"), "source", "lang", "n_chars", "text")


@query(f"SELECT key, min(doc_id) AS place, arg_max(doc_id, doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM ({_FEED}) GROUP BY key")
def merge_first_place(spark, sf_dir):
    """The last value of each key, at the place of the first."""
    return merge.last_value_first_place(_feed(spark, sf_dir), "key", "doc_id", ["doc_id", "source"])


@query(f"SELECT key, arg_max(doc_id, struct_pack(n := n_chars, d := doc_id)) AS doc_id, max(n_chars) AS n_chars FROM ({_FEED}) GROUP BY key")
def merge_longest(spark, sf_dir):
    """The longest text of each key, later ones winning ties."""
    return merge.best(_feed(spark, sf_dir), ["key"], F.struct("n_chars", "doc_id"), ["doc_id", "n_chars"])


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def merge_newest(spark, sf_dir):
    """The newest row of each key with the union of a field."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type"), F.max("ts").alias("ts"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def incremental_pending(spark, sf_dir):
    """Rows that the state of an earlier run does not hold with the same hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    state = rows.filter("doc_id % 3 = 0").withColumn("content_hash", F.when(F.col("doc_id") % 2 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    return merge.changed(rows, state, "doc_id", "content_hash")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE source END AS source FROM documents UNION ALL SELECT doc_id + 10000000 AS doc_id, 'new' AS source FROM documents WHERE doc_id % 50 = 0")
def upsert_by_key(spark, sf_dir):
    """New rows replace and extend the old."""
    old = table(spark, sf_dir, "documents").select("doc_id", "source")
    new = old.filter("doc_id % 5 = 0").select("doc_id", F.lit("new").alias("source"))
    more = old.filter("doc_id % 50 = 0").select((F.col("doc_id") + 10000000).alias("doc_id"), F.lit("new").alias("source"))
    return merge.upsert(old, new.unionByName(more), "doc_id")


@query(
    """SELECT coalesce(l.doc_id, b.item_id) AS key, coalesce(nullif(b.text, ''), l.source) AS value FROM documents l FULL OUTER JOIN benchmark b ON b.item_id = l.doc_id"""
)
def merge_fields(spark, sf_dir):
    """Full outer merge in which non-empty right values win."""
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("value"))
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value"))
    return merge.filled_from(left, right, "key", ["value"])


@query("SELECT coalesce(l.doc_id, b.item_id) AS key, coalesce(nullif(b.text, ''), l.source) AS value FROM documents l FULL OUTER JOIN benchmark b ON b.item_id = l.doc_id")
def merge_all_fields(spark, sf_dir):
    """The same merge over all documents."""
    left = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("value"))
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value"))
    return merge.filled_from(left, right, "key", ["value"])


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"kind\":\"' || event_type || '\",\"k\":' || (props->>'$.k') || '}' AS built FROM events")
def json_props(spark, sf_dir):
    """A field of a JSON payload, and an object built from fields."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"), k.alias("k"))).alias("built"))


_SEARCHES = ["the and that", "une pour le", "thention with"]


def _score_sql(q: str, column: str) -> str:
    parts = [f"CASE WHEN contains(lower({column}), '{t}') THEN {4 if len(t) > 3 else 2} ELSE 0 END" for t in text.tokens(q)]
    return " + ".join([*parts, f"CASE WHEN contains(lower({column}), '{' '.join(text.tokens(q))}') THEN 8 ELSE 0 END"])


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS q, doc_id, score::INTEGER AS score FROM (SELECT doc_id, {_score_sql(s, 'text')} AS score, row_number() OVER (ORDER BY {_score_sql(s, 'text')} DESC, doc_id) AS k FROM documents) WHERE k <= 8 AND score > 0"
        for i, s in enumerate(_SEARCHES)
    )
)
def search_scored(spark, sf_dir):
    """The eight best documents for each of three queries."""
    return search.top_of_each(table(spark, sf_dir, "documents"), _SEARCHES, "text", "doc_id")


_FOLD = f"translate(lower(text), '{tables.ACCENTED}', '{tables.PLAIN}')"


@query(" UNION ALL ".join(f"SELECT {i} AS q, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE {' AND '.join(f'contains({_FOLD}, {chr(39)}{t}{chr(39)})' for t in s.split())}" for i, s in enumerate(_SEARCHES)))
def search_all_tokens(spark, sf_dir):
    """Documents that hold every token of a query, accents aside."""
    hits = F.array(*[F.struct(F.lit(i).alias("q"), F.when(text.holds_all(F.col("text"), s), F.col("doc_id")).alias("hit")) for i, s in enumerate(_SEARCHES)])
    d = table(spark, sf_dir, "documents").select(F.inline(hits))
    return d.groupBy("q").agg(F.count("hit").alias("n"), F.min("hit").alias("first_id"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS stem FROM conversations WHERE role = 'user')
    SELECT sha256(stem) AS stem_key, count(*) AS n, string_agg(conv_id::VARCHAR || ':' || turn::VARCHAR, ',' ORDER BY conv_id, turn) AS ids, count(DISTINCT conv_id) AS files FROM t GROUP BY stem"""
)
def question_groups(spark, sf_dir):
    """Equal questions grouped, with where they occur."""
    t = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("stem", F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r\f\x0B]+", " ")))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn"))), lambda x: F.concat(x["conv_id"].cast("string"), F.lit(":"), x["turn"].cast("string"))), ",")
    return t.groupBy(F.sha2("stem", 256).alias("stem_key")).agg(F.count("*").alias("n"), ids.alias("ids"), F.countDistinct("conv_id").alias("files"))


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script)\b.*?</script>|<(style)\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM b"""
)
def html_text(spark, sf_dir):
    """Text of a page without tags."""
    return table(spark, sf_dir, "pages").select("page_id", text.without_tags(F.col("html")).alias("body"))


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(text, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') AS t FROM documents),
    e AS (SELECT doc_id, 0 AS a, 0 AS z, t FROM d UNION ALL
        SELECT doc_id, z AS a, CASE WHEN z + 1800 < length(t) AND strpos(reverse(substr(t, z + 1, 1800)), chr(10) || chr(10)) > 0 AND 1799 - strpos(reverse(substr(t, z + 1, 1800)), chr(10) || chr(10)) > 600 THEN z + 1799 - strpos(reverse(substr(t, z + 1, 1800)), chr(10) || chr(10)) ELSE least(z + 1800, length(t)) END AS z, t FROM e WHERE z < length(t)),
    p AS (SELECT doc_id, a, regexp_replace(substr(t, a + 1, z - a), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') AS chunk FROM e WHERE z > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS i FROM p WHERE chunk <> '')
    SELECT doc_id, i::INTEGER AS chunk_index, chunk, substr(sha256(doc_id::VARCHAR), 1, 12) || '-' || i::VARCHAR AS id FROM k"""
)
def chunks(spark, sf_dir):
    """Documents cut into chunks with deterministic ids."""
    return catalogue.chunks(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def counts_by_type(spark, sf_dir):
    """Counts by language and source, with subtotals."""
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (WHERE contains(text, chr(65533))) AS broken, count(*) FILTER (WHERE n_chars < 200) AS short, count(*) FILTER (WHERE contains(text, 'http')) AS linked,
        count(*) FILTER (WHERE length(text) - length(replace(text, '[', '')) >= 4) AS bracketed, round(avg(n_chars), 6) AS mean_chars FROM documents"""
)
def status_counts(spark, sf_dir):
    """Conditional counters over all documents in one pass."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("total"), F.count_if(t.contains("�")).alias("broken"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(t.contains("http")).alias("linked"),
        F.count_if(F.length(t) - F.length(F.replace(t, F.lit("["), F.lit(""))) >= 4).alias("bracketed"), F.round(F.avg("n_chars"), 6).alias("mean_chars"),
    )


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(translate(lower(text), '" + tables.ACCENTED + "', '" + tables.PLAIN + r"'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents")
def slugs(spark, sf_dir):
    """Slugs of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT p_brand, p_partkey, day::BIGINT AS day, n::BIGINT AS n FROM (WITH t AS (SELECT p_brand, p_partkey, p_size AS u, sum(p_size) OVER (ORDER BY p_brand, p_partkey ROWS UNBOUNDED PRECEDING) AS hi FROM part), d AS (SELECT *, unnest(generate_series(least((hi - u) // 500, 59)::BIGINT, least((hi - 1) // 500, 59)::BIGINT)) AS day FROM t WHERE u > 0) SELECT p_brand, p_partkey, day, CASE WHEN day = 59 THEN hi ELSE least(hi, (day + 1) * 500) END - greatest(hi - u, day * 500) AS n FROM d)")
def study_plan_days(spark, sf_dir):
    """Units dealt in order to sixty days of five hundred."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("units"))
    return allocation.sequential(parts, ["p_brand", "p_partkey"], "units", 500, 60).drop("units")


@query("WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) SELECT p_brand, p_partkey, turn::INTEGER AS turn, least((row_number() OVER (ORDER BY turn, p_brand) - 1) // 40, 29)::BIGINT AS day FROM t")
def study_plan_rounds(spark, sf_dir):
    """Items in turn from each group, forty to a day."""
    return allocation.round_robin(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 40, 30)


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events), p AS (SELECT * FROM (VALUES ('24h', 1), ('7d', 7), ('30d', 30), ('365d', 365), ('all', NULL)) AS v(period, days)),
    a AS (SELECT ts, event_type <> 'error' AND value > 20 AS correct FROM events)
    SELECT period, count(*) AS answered, sum(correct::INT)::BIGINT AS right_ones, round(100.0 * sum(correct::INT) / count(*), 6) AS accuracy FROM a, p, n WHERE days IS NULL OR ts > now - days * INTERVAL 1 DAY GROUP BY period"""
)
def answer_stats(spark, sf_dir):
    """Accuracy of answers over rolling periods, in one pass."""
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    rows = e.select("ts", ((F.col("event_type") != "error") & (F.col("value") > 20)).cast("int").alias("correct"))
    periods = [("24h", 1), ("7d", 7), ("30d", 30), ("365d", 365), ("all", None)]
    inside = F.array_compact(F.array(*[F.when(F.lit(True) if d is None else F.col("ts") > F.lit(now) - F.expr(f"INTERVAL {d} DAYS"), F.lit(p)) for p, d in periods]))
    g = rows.select(F.explode(inside).alias("period"), "correct").groupBy("period")
    return g.agg(F.count("*").alias("answered"), F.sum("correct").alias("right_ones"), F.round(100.0 * F.sum("correct") / F.count("*"), 6).alias("accuracy"))


@query(
    """WITH r AS (SELECT user_id, event_type AS deck, arg_max(value, ts) AS v, max(ts)::DATE AS seen FROM events GROUP BY 1, 2), d AS (SELECT deck, seen + CASE WHEN v < 20 THEN 0 WHEN v < 60 THEN 1 ELSE 3 END AS due FROM r)
    SELECT deck, count(*) AS cards, count(*) FILTER (WHERE due <= DATE '2024-01-28') AS due FROM d GROUP BY deck"""
)
def due_cards(spark, sf_dir):
    """Cards due by a day, from their last review's rating."""
    r = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("deck")).agg(F.max_by("value", "ts").alias("v"), F.to_date(F.max("ts")).alias("seen"))
    due = F.date_add("seen", F.when(F.col("v") < 20, 0).when(F.col("v") < 60, 1).otherwise(3))
    return r.groupBy("deck").agg(F.count("*").alias("cards"), F.count_if(due <= F.lit("2024-01-28").cast("date")).alias("due"))


@query("SELECT event_type, count(*) AS posts, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def engagement(spark, sf_dir):
    """Totals, means and shares of kinds of events."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("posts"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"))
    return g.withColumn("share", F.round(100.0 * F.col("posts") / F.sum("posts").over(Window.partitionBy()), 6))


@query("SELECT user_id, event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def latest_per_metric(spark, sf_dir):
    """The latest value of each metric."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


@query(
    """SELECT s.source, lang, count(*) AS n, round(avg(toxic), 6) AS toxic_rate, round(avg(quality), 6) AS quality_rate FROM labels l JOIN documents s ON s.doc_id = l.doc_id GROUP BY GROUPING SETS ((s.source, lang), (lang))"""
)
def logit_cells(spark, sf_dir):
    """Empirical rates in cells and in their aggregate."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    return rounded(j.groupingSets([["source", "lang"], ["lang"]], "source", "lang").agg(F.count("*").alias("n"), F.avg("toxic").alias("toxic_rate"), F.avg("quality").alias("quality_rate")))


@query(
    """WITH j AS (SELECT l.doc_id, quality, n_chars, row_number() OVER (ORDER BY n_chars, l.doc_id) - 1 AS k, count(*) OVER () AS n FROM labels l JOIN documents d ON d.doc_id = l.doc_id)
    SELECT CASE WHEN k < n // 3 THEN 1 WHEN k < 2 * (n // 3) THEN 2 ELSE 3 END AS tercile, count(*) AS rows_in, min(n_chars) AS low, max(n_chars) AS high, round(avg(quality), 6) AS rate FROM j GROUP BY 1"""
)
def calibration(spark, sf_dir):
    """Outcome by tercile of a score, cut at thirds of the row count."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    n = j.count()
    k = F.col("_n") - 1
    t = F.when(k < n // 3, 1).when(k < 2 * (n // 3), 2).otherwise(3)
    return rounded(running(j, ["n_chars", "doc_id"]).withColumn("tercile", t).groupBy("tercile").agg(F.count("*").alias("rows_in"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.avg("quality").alias("rate")))


@query("SELECT DISTINCT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE trim(b.text) <> ''")
def theta_containment(spark, sf_dir):
    """Documents that hold a whole reference text."""
    return containment.holding(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("WITH r AS (SELECT item_id, trim(substr(text, 6, greatest(length(text) - 10, 1) // (1 + item_id % 3))) AS needle FROM benchmark) SELECT DISTINCT d.doc_id, r.item_id FROM documents d JOIN r ON contains(d.text, needle) WHERE needle <> ''")
def passage_containment(spark, sf_dir):
    """Documents that hold a passage of a reference, from its middle and of any length."""
    refs = table(spark, sf_dir, "benchmark")
    n = F.floor(F.greatest(F.length("text") - 10, F.lit(1)) / (1 + F.col("item_id") % 3)).cast("int")
    refs = refs.select("item_id", F.trim(F.substring(F.col("text"), F.lit(6), n)).alias("needle"))
    return containment.holding(table(spark, sf_dir, "documents"), "doc_id", "text", refs, "item_id", "needle")


@query(
    """SELECT doc_id, d.source FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang = 'fr') s JOIN documents d ON d.source = s.source
    EXCEPT SELECT doc_id, source FROM documents WHERE n_chars < 100"""
)
def set_operations(spark, sf_dir):
    """Intersection, join and difference of key sets."""
    d = table(spark, sf_dir, "documents")
    sources = lambda lang: d.filter(F.col("lang") == lang).select("source")
    both = sources("en").intersect(sources("fr"))
    return d.join(both, "source").select("doc_id", "source").subtract(d.filter("n_chars < 100").select("doc_id", "source"))


@query(
    """WITH d AS (SELECT sha256(text) AS key, source, lang, n_chars FROM documents)
    SELECT DISTINCT d.key, d.source FROM (SELECT source FROM d WHERE lang = 'en' INTERSECT SELECT source FROM d WHERE lang = 'fr') s JOIN d ON d.source = s.source
    EXCEPT SELECT key, source FROM d WHERE n_chars < 100"""
)
def whole_set_operations(spark, sf_dir):
    """Intersection of sources, join and difference of text keys, over all documents."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("key"), "source", "lang", "n_chars")
    sources = lambda lang: d.filter(F.col("lang") == lang).select("source")
    both = sources("en").intersect(sources("fr"))
    return d.join(both, "source").select("key", "source").distinct().subtract(d.filter("n_chars < 100").select("key", "source"))


@query(
    """WITH b AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, source, n_chars FROM documents)
    SELECT source, (k // 40)::BIGINT AS batch, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM b GROUP BY 1, 2"""
)
def fixed_batches(spark, sf_dir):
    """Rows of each group in batches of forty."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(k / 40).alias("batch"))
    return d.groupBy("source", "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("ids"))
