"""A normaliser of Portuguese legal text.

A text is parted at the words that need accents, and each of those is looked up by itself; spaces,
marks and ordinals are set right by patterns that see their neighbours.  Phrases of several words
are then brought to their canonical forms, whose patterns are made from those forms.

Every pattern reads the whole text, so each begins with what few characters are; what must not
stand before is looked at after that.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Words that need accents.
ACCENTED_WORDS = """
    não será serão são estará estarão poderá poderão deverá deverão houverá também porém além após até já lá só número números
    público pública públicos públicas único única último última constituição orgânica jurisdição competência violação decisão
    condenação ilícitos ilícita ilícito administração obrigação obrigações disposição disposições revogação alteração redação
    vigência eficácia licitação contratação sanção sanções extraordinário ordinário publicação súmula súmulas observância
    obrigatória obrigatório repercussão parágrafo parágrafos alínea alíneas código códigos provisória convênio plenário plenária
    tributária tributário previdenciário previdenciária intervenção sindicância anulatória convalidação ratificação homologação
    adjudicação habilitação qualificação impugnação espécie espécies benefício benefícios previdência segurança atribuição
    atribuições responsabilização responsabilizações indenização indenizações reparação reparações indenizatório indenizatória
""".split()
# Phrases in their canonical form.
PHRASES = ["Súmula Vinculante", "Decreto-Lei", "Constituição Federal", "Recurso Extraordinário", "Recurso Ordinário", "Repercussão Geral", "Recurso Repetitivo", "Tema de Repetitivo"]
# Endings that a crawl glues to the word before them.
GLUED = """
    público pública públicos públicas privado privada dolosamente culposamente administrativa administrativo administrativos
    constitucionais jurídica jurídico dolosa doloso efetivamente comprovadamente obrigatoriamente expressamente especificamente
    respectivamente independentemente cumulativamente subsidiariamente alternativamente nos nas num numa pelo pela pelos pelas
    que por como para sem sobre entre contra mediante conforme durante
""".split()

WORD = r"\p{L}+|\P{L}+"
_SPACE = r"[ \t\n\r\f\x0B]"
#: No letter before the character just read; a letter of two code units, named here, has Java look for such, too.
_NO_LETTER = r"(?<![\p{L}𐐀].)"


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


#: Plain spelling → spelling with accents.
ACCENTS = {plain(w): w for w in ACCENTED_WORDS}


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(WORD), 0)


def _listed(keys: list[str]) -> str:
    """A pattern of whole words out of a list, in any case, where a word begins."""
    rest = {c: "|".join(k[1:] for k in keys if k[0] == c) for c in sorted({k[0] for k in keys})}
    return "(?:" + "|".join(f"[{c}{c.upper()}](?i:{r})" for c, r in rest.items()) + r")(?!\p{L})"


def parts(x: Column, keys: list[str]) -> Column:
    """The words of a text that are in a list of plain spellings, and whole what lies between them."""
    listed = _listed(keys)
    return F.regexp_extract_all(x, F.lit(rf"{listed}|(?:\P{{L}}++|(?!{listed})\p{{L}}++)++"), 0)


def cased(like: Column, word: Column) -> Column:
    """A lower-case word in the case of another: all capitals, a first capital, or none."""
    first = F.substring(like, 1, 1)
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(word)).when(first != F.lower(first), F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 20))).otherwise(word)


def accented(x: Column) -> Column:
    """Accents on words that need them."""
    table, longest = F.create_map(*[F.lit(s) for pair in ACCENTS.items() for s in pair]), max(map(len, ACCENTS))
    word = lambda t: F.coalesce(cased(t, F.try_element_at(table, F.lower(t))), t)
    return F.array_join(F.transform(parts(x, list(ACCENTS)), lambda t: F.when(F.octet_length(t) <= longest, word(t)).otherwise(t)), "")


#: What of marks and spaces goes, each group being what stays: a mark twice; space after an opening
#: bracket and before a closing mark; a run of spaces with one or more ends of a line, and without.
SPACING = r"(?=[\n.,(]| [ \n,;:.!?)])(?:([.,])\1+|(\()[ \n]++|[ \n]++(?=[,;:.!?)])| *+(\n) *+(?:(\n)[ \n]*+)?|( ) ++)"


def spaced(x: Column) -> Column:
    """Spaces and marks set right: no space before a closing mark or after an opening bracket, one
    after a mark that a letter follows, no mark twice, no more than one blank line."""
    blank = F.regexp_replace(x, r"[\t\r\f\x0B]", " ")
    return F.regexp_replace(F.regexp_replace(blank, SPACING, "$1$2$3$4$5"), r"([,;:.])(?=\p{L})", "$1 ")


#: "art." and a number (group 1), and a degree sign or an o by itself.
ORDINAL = rf"([Aa]{_NO_LETTER}[Rr][Tt]\.{_SPACE}*+[0-9]++{_SPACE}*+)(?:°|[Oo](?!\p{{L}}))"


def ordinals(x: Column) -> Column:
    """The sign of an ordinal number after "art." and a number, where a degree sign or an o stands."""
    return F.regexp_replace(x, ORDINAL, "$1º")


def phrase_pattern(phrase: str) -> str:
    """Any case, with or without accents, any white space where the phrase has a space."""
    char = lambda c: {" ": r"[ \t\n]+", "-": r"[ \t]*-[ \t]*"}.get(c, f"[{c}{plain(c)}]" if plain(c) != c else c)
    first = {"S": "[Ssſ]"}.get(phrase[0], f"[{phrase[0]}{phrase[0].lower()}]")
    return first + r"(?<!\p{L}.)(?iu)" + "".join(char(c) for c in phrase[1:]) + r"(?!\p{L})"


def anchor(phrase: str) -> str:
    """The longest part of a phrase whose letters only have themselves as the other case (i, k and s
    stand for other letters, too), so that a lower-cased text without it has no such phrase."""
    return max(re.findall("[a-hjl-rt-z]+", phrase.lower()), key=len)


def phrased(x: Column) -> Column:
    def each(low: Column, t: Column, p: str) -> Column:
        return let(t, lambda v: F.when(F.contains(low, F.lit(anchor(p))), F.regexp_replace(v, phrase_pattern(p), p)).otherwise(v))

    return let(x, lambda v: let(F.lower(v), lambda low: reduce(lambda t, p: each(low, t, p), PHRASES, v)))


_LEI = r"([Ll](?<!\p{L}.)(?iu)ei(?:[ ]+Complementar)?)(?iu)"
#: A law's number (group 2, the name in group 1), with or without "nº", and the year after its date.
LAW = _LEI + r"[ ]+(?:n[.º°o]*[ ]*)?(\d{1,3}(?:\.?\d{3})?)[ ]*,?[ ]+de[ ]+(?:\d{1,2}[º°]?[ ]+de[ ]+\p{L}+[ ]+de[ ]+)?(\d{4})(?!\d)"


def laws(x: Column) -> Column:
    """Law references as name, dotted number and year."""
    short = F.regexp_replace(x, LAW, "$1 $2/$3")
    short = F.regexp_replace(short, _LEI + r"[ ]+n[.º°o]*[ ]*(?=\d)", "$1 ")
    return F.regexp_replace(short, r"([Ll]ei \d{1,3})(\d{3})(?=/\d{4})", "$1.$2")


def unglued(ts: Column) -> Column:
    """Words that end in another word of the list, parted from it; four letters stay before it."""
    ends = "|".join(sorted(GLUED, key=len, reverse=True))
    pattern = rf"(?iu)^(\p{{L}}{{4,}}?)({ends})$"
    whole = F.array(*[F.lit(w) for w in [*ACCENTED_WORDS, "vinculante", "inconforme"]])
    return F.transform(ts, lambda t: F.when(F.array_contains(whole, F.lower(t)), t).otherwise(F.regexp_replace(t, pattern, "$1 $2")))


def normalised(x: Column, domain: str = "all", glued: bool = False) -> Column:
    """The whole normaliser; for case law (``juris``) spacing stays but for runs of spaces.
    ``glued`` parts glued words, too."""
    joined = accented(x)
    if glued:
        joined = F.array_join(unglued(words(joined)), "")
    joined = ordinals(joined)
    out = F.regexp_replace(joined, r"[ \t]{2,}", " ") if domain == "juris" else spaced(joined)
    return laws(phrased(out))
