"""Legal texts: acts and their identity, articles, references, revocation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sections
from .text import folded

# Kinds of acts (as read, without accents → as kept → as shown).
ACTS = {
    "lei complementar": ("lei_complementar", "Lei Complementar"),
    "decreto-lei": ("decreto_lei", "Decreto-Lei"),
    "medida provisoria": ("medida_provisoria", "Medida Provisória"),
    "mpv": ("medida_provisoria", "Medida Provisória"),
    "emenda constitucional": ("emenda_constitucional", "Emenda Constitucional"),
    "lei": ("lei", "Lei"),
    "decreto": ("decreto", "Decreto"),
}
#: Fixed value: characters of an article that a citation shows.
LONGEST_ARTICLE = 8000
#: Fixed value: struck-out share from which a whole law counts as revoked.
REVOKED_SHARE = 0.72
_HEAD = r"(?im)^[ \t]*art\.?[ ]*([0-9]+)"
_KINDS = [("titulo", r"(?iu)^t[ií]tulo\b"), ("capitulo", r"(?iu)^cap[ií]tulo\b"), ("secao", r"(?iu)^se[cç][aã]o\b"), ("artigo", r"(?i)^art\.?[ ]*[0-9]")]


def paragraphs(body: Column) -> Column:
    """What stands between blank lines, trimmed; empty ones go."""
    return F.filter(F.transform(F.split(body, r"\n[ \t]*\n"), lambda p: F.trim(p, F.lit(sections.SPACES))), lambda p: p != "")


def structure(body: Column) -> Column:
    """(kind, text) of a statute's blocks; text that follows an article belongs to it."""
    classes = [(name, re.compile(pattern.replace("(?iu)", "(?i)"))) for name, pattern in _KINDS]

    def cut(text: str | None) -> list[dict] | None:
        found = sections.blocks(text, classes, "texto", {"artigo"})
        return None if found is None else [{"kind": k, "text": t} for k, t in found]

    return sections.each(body, cut, "array<struct<kind:string,text:string>>")


#: What a line of a summary's page begins with that is not its statement.
_NO_STATEMENT = r"(?iu)^(STF|STJ|TST|TSE|Súmula|Sumula|Julgamento|Publicação|Conversação|Olá|SV\s+[0-9])"


def summary_page(text: Column, url: Column) -> Column:
    """A case-law summary's page as fields: number, court, binding, judged, published, statement.

    The statement is the first line of twelve characters after the dates that is neither a heading
    nor a dash; without one, the last line that is not blank."""
    u = F.lower(F.coalesce(url, F.lit("")))
    found = lambda p, g=1: F.nullif(F.trim(F.regexp_extract(text, p, g)), F.lit(""))
    number = F.coalesce(found(r"(?iu)s[úu]mula\s+vinculante\s+(\d+)"), found(r"(?iu)s[úu]mula\s+(\d+)"))
    court = F.when(u.contains("stj"), "STJ").when(u.contains("tst"), "TST").when(u.contains("tse"), "TSE").otherwise("STF")
    binding = u.contains("vinculante") | text.rlike(r"(?iu)s[úu]mula\s+vinculante")
    after = F.element_at(F.split(text, r"(?iu)publica[cç][aã]o:[^\n]+\n"), -1)
    lines = F.filter(F.transform(F.split(after, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    good = F.filter(lines, lambda s: (F.length(s) >= 12) & ~s.rlike(_NO_STATEMENT))
    plain = F.filter(good, lambda s: ~s.rlike(r"^[—–-]\s"))
    statement = F.coalesce(F.get(plain, F.lit(0)), F.get(good, F.lit(0)), F.try_element_at(lines, F.lit(-1)))
    return F.struct(number.cast("int").alias("number"), court.alias("court"), binding.alias("binding"), found(r"(?iu)julgamento:\s*([^\n]+)").alias("judged"), found(r"(?iu)publica[cç][aã]o:\s*([^\n]+)").alias("published"), statement.alias("statement"))


def article(body: Column, number: Column) -> Column:
    """The article of that number, up to the next article's head."""
    parts = F.split(body, r"(?im)(?=^[ \t]*art\.?[ ]*[0-9])")
    own = F.filter(parts, lambda p: F.regexp_extract(p, _HEAD, 1) == number.cast("string"))
    clean = F.regexp_replace(F.regexp_replace(F.get(own, F.lit(0)), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.substring(F.trim(F.regexp_replace(clean, r"\s+$", "")), 1, LONGEST_ARTICLE), F.lit(""))


def without_revoked(body: Column) -> Column:
    """Paragraphs that are, or end with, a note of revocation go."""
    bare = lambda p: F.trim(F.regexp_replace(p, r"(?iu)\((?:inclu[ií]d|alterad|reda[cç][aã]o)[^)]*\)", ""))
    return F.array_join(F.filter(paragraphs(body), lambda p: ~bare(p).rlike(r"(?iu)\(revogad[oa][^)]*\)\.?$")), "\n\n")


def struck_share(body: Column) -> Column:
    """The share of a text that stands between pairs of ~~."""
    parts = F.split(body, "~~")
    size = lambda keep: F.aggregate(F.filter(parts, keep), F.lit(0), lambda n, p: n + F.length(F.trim(p)))
    return F.try_divide(size(lambda p, i: i % 2 == 1), size(lambda p, i: i >= 0))


def wholly_revoked(title: Column, body: Column) -> Column:
    return folded(title).rlike(r"\brevogad[oa]\b") | (F.trim(F.coalesce(body, F.lit(""))) == "") | ((F.length(body) >= 100) & (struck_share(body) >= REVOKED_SHARE))


def effect(x: Column) -> Column:
    """What a text does to a law: revoke before alter before add."""
    f = folded(x)
    return F.when(f.rlike(r"\brevog"), "revoke").when(f.rlike(r"\b(alter|da nova redacao)"), "alter").when(f.rlike(r"\b(acrescent|inclu)"), "add").otherwise("unknown")


def identity(title: Column) -> Column:
    """(act, digits, suffix) of a norm's title; null if it names none."""
    f = F.trim(folded(title))
    head = r"^(" + "|".join(ACTS) + r")\s+(?:n[.ºo°]*\s*)?([0-9][0-9.]*)(?:-([0-9]+))?(?:/[0-9]{4})?(?:\s.*)?$"
    act = F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in ACTS.items() for x in (k, v)]), F.regexp_extract(f, head, 1))
    digits = F.replace(F.regexp_extract(f, head, 2), F.lit("."), F.lit(""))
    named = F.struct(act.alias("act"), digits.alias("digits"), F.nullif(F.regexp_extract(f, head, 3), F.lit("")).alias("suffix"))
    federal = F.struct(F.lit("constituicao").alias("act"), F.lit("1988").alias("digits"), F.lit(None).cast("string").alias("suffix"))
    return F.when(f.rlike(r"constituicao\s+federal"), federal).when(act.isNotNull(), named)


def identity_in_url(url: Column) -> Column:
    """(act, digits, suffix) out of the last part of an address such as …/lei8112.htm."""
    leaf = F.regexp_extract(F.lower(url), r"/([^/?#]+)$", 1)
    act, digits = F.regexp_extract(leaf, r"^(lcp|del|mpv|emc|lei|l|d)[-_]?([0-9]+)", 1), F.regexp_extract(leaf, r"^(?:lcp|del|mpv|emc|lei|l|d)[-_]?([0-9]+)", 1)
    names = {"lcp": "lei_complementar", "del": "decreto_lei", "mpv": "medida_provisoria", "emc": "emenda_constitucional", "lei": "lei", "l": "lei", "d": "decreto"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), act)
    return F.when(kind.isNotNull(), F.struct(kind.alias("act"), digits.alias("digits"), F.nullif(F.regexp_extract(leaf, r"^[a-z]+[-_]?[0-9]+-([0-9]+)", 1), F.lit("")).alias("suffix")))


def label(i: Column) -> Column:
    """An identity as it is shown, its number with a thousand dot."""
    names = F.create_map(*[F.lit(x) for v, shown in dict(ACTS.values()).items() for x in (v, shown)])
    d = i["digits"]
    dotted = F.when(F.length(d) >= 4, F.concat(F.substring(d, 1, F.length(d) - 3), F.lit("."), F.right(d, F.lit(3)))).otherwise(d)
    number = F.when((i["act"] == "medida_provisoria") & i["suffix"].isNotNull(), F.concat_ws("-", dotted, i["suffix"])).otherwise(dotted)
    return F.when(i["act"] == "constituicao", "Constituição Federal").when(i.isNotNull(), F.concat(F.try_element_at(names, i["act"]), F.lit(" nº "), number))


#: A reference to a law or a summary in running text.
LAW_REFERENCE = r"\b(?:lei(?:\s+complementar)?|decreto(?:-lei)?)\s+(?:n[.ºo]*\s*)?([0-9]{1,3}(?:[.][0-9]{3})+|[0-9]{3,6})"
SUMMARY_REFERENCE = r"\bsumulas?\s+(?:vinculantes?\s+)?(?:n[.ºo]*\s*)?([0-9]{1,4})"


def referred_laws(x: Column) -> Column:
    """Distinct numbers of the laws that a text refers to, in order, without dots."""
    return F.array_distinct(F.transform(F.regexp_extract_all(folded(x), F.lit(LAW_REFERENCE), 1), lambda s: F.replace(s, F.lit("."), F.lit(""))))


def referred_summaries(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(folded(x), F.lit(SUMMARY_REFERENCE), 1), lambda s: s.cast("int")))
