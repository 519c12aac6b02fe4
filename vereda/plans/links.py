"""Queries that link texts and pages with each other: identities, overlaps, aliases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.text import folded, squeezed
from ..operators import automaton, identity, overlap
from ..operators.ordered import running
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_HOST = r"^https?://(www\.|m\.|blog\.)?"
_TAIL = r"([?#].*|\.html|/)*$"


@query(
    rf"""WITH RECURSIVE p AS (SELECT page_id, url, length(html) AS n, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, md5(regexp_extract(html, '(?s)<body.*', 0)) AS body FROM pages),
    k AS (SELECT page_id, 'u' || regexp_replace(regexp_replace(lower(url), '{_HOST}', ''), '{_TAIL}', '') AS key FROM p UNION
          SELECT page_id, 't' || translate(lower(title), '{tables.ACCENTED}', '{tables.PLAIN}') FROM p WHERE trim(title) <> '' UNION SELECT page_id, 'b' || body FROM p),
    e AS (SELECT a.page_id AS u, b.page_id AS v FROM k a JOIN k b ON a.key = b.key),
    r AS (SELECT page_id AS u, page_id AS v FROM p UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
    g AS (SELECT u AS page_id, min(v) AS identity FROM r GROUP BY u),
    s AS (SELECT p.page_id, identity, title, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, CASE WHEN contains(url, '//www.') THEN 0 WHEN contains(url, '//m.') THEN 2 WHEN contains(url, '//blog.') THEN 3 ELSE 1 END AS rank, n FROM p JOIN g ON g.page_id = p.page_id),
    b AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY rank * 100000 - n, page_id) = 1 AS kept FROM s),
    o AS (SELECT page_id, row_number() OVER (ORDER BY lang, rank, title, page_id) AS place FROM b WHERE kept)
    SELECT b.page_id, identity, rank::INTEGER AS rank, kept, place FROM b LEFT JOIN o ON o.page_id = b.page_id"""
)
def page_identities(spark, sf_dir):
    """One page under several addresses, titles and bodies: pages that share any of the three,
    over chains too, are one; the best source of each stands in the catalogue's order."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").alias("n"), title.alias("title"), F.md5(F.regexp_extract("html", r"(?s)<body.*", 0)).alias("body"))
    address = F.regexp_replace(F.regexp_replace(F.lower("url"), _HOST, ""), _TAIL, "")
    keys = F.array(F.concat(F.lit("u"), address), F.when(F.trim("title") != "", F.concat(F.lit("t"), folded(F.col("title")))), F.concat(F.lit("b"), "body"))
    rank = F.when(F.col("url").contains("//www."), 0).when(F.col("url").contains("//m."), 2).when(F.col("url").contains("//blog."), 3).otherwise(1)
    lang = F.regexp_extract("url", r"/(en|fr|de|es)/", 1)
    ranked = p.join(identity.identities(p, "page_id", keys), "page_id").select("page_id", "identity", "title", "n", rank.alias("rank"), lang.alias("lang"))
    ranked = identity.best_of_each(ranked, "identity", [F.col("rank") * 100000 - F.col("n"), F.col("page_id")])
    placed = running(ranked.filter("kept").select("page_id", "lang", "rank", "title"), ["lang", "rank", "title", "page_id"], out="place").select("page_id", "place")
    return ranked.join(placed, "page_id", "left").select("page_id", "identity", "rank", "kept", "place")


_WORDS = f"list_distinct(list_filter(regexp_extract_all(translate(lower(coalesce(text, '')), '{tables.ACCENTED}', '{tables.PLAIN}'), '[a-z0-9]{{5,}}'), lambda w: NOT list_contains({overlap.SILENT}, w)))"


@query(
    f"""WITH c AS (SELECT conv_id, turn, unnest({_WORDS}) AS w FROM conversations), d AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
    n AS (SELECT conv_id, turn, doc_id, count(*) AS overlap FROM c JOIN d ON c.w = d.w GROUP BY ALL HAVING count(*) >= 7),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY overlap DESC, doc_id) AS place FROM n)
    SELECT conv_id, turn, doc_id, overlap::INTEGER AS overlap, place::INTEGER AS place FROM r WHERE place <= 3"""
)
def question_sources(spark, sf_dir):
    """For every turn of a conversation the three documents with the most words in common, seven
    at least, where no number is cited."""
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("l"), overlap.tokens(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("r"), overlap.tokens(F.col("text")).alias("tokens"))
    found = overlap.most_overlapping(c, d)
    return found.select("l.conv_id", "l.turn", F.col("r").alias("doc_id"), "overlap", "place")


_PLAIN_TEXT = "trim(regexp_replace(translate(lower({}), '" + tables.ACCENTED + "', '" + tables.PLAIN + r"'), '\s+', ' ', 'g'))"


@query(
    rf"""WITH b AS (SELECT item_id, string_split({_PLAIN_TEXT.format("text")}, ' ') AS ws FROM benchmark), w AS (SELECT item_id, ws, unnest(generate_series(1, len(ws) - 1)) AS i FROM b),
    a AS (SELECT item_id * 1000 + i AS place, ws[i] || ' ' || ws[i + 1] AS alias, item_id FROM w WHERE length(ws[i]) + length(ws[i + 1]) >= 12),
    d AS (SELECT doc_id, {_PLAIN_TEXT.format("text")} AS t FROM documents),
    f AS (SELECT doc_id, min(place) AS place, count(DISTINCT alias) AS n_aliases FROM d JOIN a ON contains(t, alias) GROUP BY doc_id)
    SELECT f.doc_id, f.place, a.item_id AS target, n_aliases FROM f JOIN a ON a.place = f.place"""
)
def aliased_documents(spark, sf_dir):
    """Whole texts against hundreds of aliases, word pairs of the benchmark's items: the item of
    the first alias in the list that a text contains, and how many it contains."""
    plain = lambda c: squeezed(folded(F.col(c)))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.split(plain("text"), " ").alias("ws"))
    w = b.select("item_id", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("i"))
    one, two = F.element_at("ws", F.col("i")), F.element_at("ws", F.col("i") + 1)
    aliases = w.filter(F.length(one) + F.length(two) >= 12).select((F.col("item_id") * 1000 + F.col("i")).alias("place"), F.concat_ws(" ", one, two).alias("alias"), F.col("item_id").alias("target"))
    d = table(spark, sf_dir, "documents").select("doc_id", plain("text").alias("text"))
    found = automaton.contained(d, "doc_id", "text", aliases, "alias")
    best = aliases.groupBy("alias").agg(F.min(F.struct("place", "target")).alias("first"))
    named = found.join(best, "alias").groupBy("doc_id").agg(F.min("first").alias("first"), F.count("*").alias("n_aliases"))
    return named.select("doc_id", "first.place", "first.target", "n_aliases")
