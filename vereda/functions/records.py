"""Fields of open JSON records as Column expressions.

A record is the text of a JSON object whose fields have many names.  ``opened`` parses it once
into a map of strings (nested values keep their JSON text) and the maps of its two nested
objects; every other function takes what it gives.  Strings are trimmed, blank ones are missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .binding import let

# The names under which records have a field, by preference.
BODY_OF_LAW = ["dispositivo", "dispositivo_legal", "texto_dispositivo", "integra_dispositivo", "texto_normativo", "norma_juridica", "norma", "conteudo_normativo", "conteudo_artigo", "texto_artigo", "texto_do_artigo", "corpo_artigo", "artigo_texto", "texto_integral_dispositivo", "ementa_dispositivo"]
BODY_OF_SUMMARY = ["enunciado", "texto_enunciado", "texto_sumula", "sumula_texto", "enunciado_sumula"]
BODY_OF_CASE = ["ementa", "texto_ementa", "texto_acordao", "acordao_texto", "inteiro_teor", "texto_decisao", "decisao_texto", "fundamentacao"]
BODY_OF_ANY = ["texto", "body", "content", "texto_completo", "integra"]
EXPLANATION = ["explicacao", "explicação", "comentario_juris", "notas_explicativas", "explicacao_jurisprudencia", "explicacao_pedagogica"]
TITLE = ["titulo", "title", "epigrafe", "nome_lei", "nome_norma"]
ARTICLES = ["artigos", "articles", "artigos_texto"]
ARTICLE_NUMBER = ["numero", "num", "id", "artigo"]
ARTICLE_TEXT = ["texto", "dispositivo", "texto_dispositivo", "conteudo", "corpo", "ementa", "enunciado"]
STATEMENT = ["enunciado_questao", "texto_questao", "questao_texto", "questao", "stem", "comando"]
KEY = ["gabarito", "resposta_correta", "alternativa_correta", "chave", "resposta_oficial_objetiva"]
REFERENCE = ["resposta_oficial", "gabarito_discursivo", "resposta_modelo", "padrao_resposta", "ponto_avaliacao", "espelho_correcao"]
OPTIONS = ["alternativas", "opcoes", "choices", "itens"]
QUESTION_TYPES = ["questoes_objetivas", "questoes_subjetivas", "questao_objetiva", "questao_subjetiva", "questao_discursiva", "prova_objetiva", "prova_discursiva"]
OPTION_LETTER = ["letra", "label", "opcao", "col", "sigla", "codigo", "letter"]
OPTION_TEXT = ["texto", "text", "conteudo", "valor", "descricao", "description", "alternativa", "conteudo_html"]
USER_ANSWER = ["resposta_usuario", "marcacao", "marcada", "resposta_marcada", "usuario_resposta", "alternativa_marcada"]
SUBJECT = ["disciplina", "materia", "subject", "tema_principal", "area", "conteudo_programatico"]
SOURCE_ID = ["id", "external_id", "question_id", "questao_id", "public_id", "hash", "codigo", "pk", "slug", "uuid"]
# Canonical names of courts, subjects and boards.
COURTS = {"stf": "STF", "supremo": "STF", "supremo tribunal federal": "STF", "stj": "STJ", "superior tribunal de justica": "STJ", "tst": "TST", "tribunal superior do trabalho": "TST", "tse": "TSE", "tribunal superior eleitoral": "TSE", "stm": "STM", "tribunal militar": "STM"}
SUBJECTS = {"penal": "Penal", "direito penal": "Penal", "administrativo": "Administrativo", "adm": "Administrativo", "processual": "Processual", "processo": "Processual", "tributario": "Tributário", "tributário": "Tributário", "constitucional": "Constitucional", "civil": "Civil", "trabalho": "Trabalho", "trabalhista": "Trabalho", "eleitoral": "Eleitoral"}
BOARDS = {"cespe": "CESPE", "cebrap": "CEBRAP", "cebraspe": "CEBRASPE", "fcc": "FCC", "fgv": "FGV", "fundacao getulio vargas": "FGV", "vunesp": "VUNESP", "ibfc": "IBFC", "funcern": "FUNCERN", "aocep": "AOCEP", "quadrix": "QUADRIX", "cs": "CS-UFG"}
# Where a harvested question comes from, by what its address holds, in order.
NETWORKS = [("tecconcursos", "tecconcursos_network"), ("qconcurso", "qconcurso_network"), ("fcconcursos", "fcconcursos_network"), ("cebraspe", "cebraspe_network"), ("cespe", "cebraspe_network"), ("vunesp", "vunesp_network"), ("fgv", "fgv_network")]
#: Names that a record's meta does not repeat: they have columns of their own.
RESERVED = ["id", "external_id", "type", "doc_type", "tipo", "titulo", "title", "texto", "body", "content", "metadata", "meta"]

_MAP = "map<string,string>"


def opened(record: Column) -> Column:
    """(top, metadata, meta): maps of strings; null maps for what is no object."""
    inner = lambda top, name: F.from_json(F.try_element_at(top, F.lit(name)), _MAP).alias(name)
    return let(F.from_json(record, _MAP), lambda top: F.struct(top.alias("top"), inner(top, "metadata"), inner(top, "meta")))


def value(m: Column, name: str) -> Column:
    return text.blank_to_null(F.try_element_at(m, F.lit(name)))


def first(m: Column, names: list[str]) -> Column:
    """The first of the names that the map has a value for.  The names are one literal array, so
    the expression is small however many there are."""
    found = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.trim(F.try_element_at(m, n)))
    return F.get(F.filter(found, lambda v: v != ""), F.lit(0))


def nested(r: Column, names: list[str]) -> Column:
    """As ``first``, in metadata and then in meta: a level's whole list before the next level."""
    return F.coalesce(first(r["metadata"], names), first(r["meta"], names))


def anywhere(r: Column, names: list[str]) -> Column:
    return F.coalesce(first(r["top"], names), nested(r, names))


def articles(r: Column) -> Column:
    """Articles (objects or strings) as one text, each under its label, parted by blank lines."""
    items = F.from_json(first(r["top"], ARTICLES), "array<string>")

    def labelled(m: Column) -> Column:
        label = let(first(m, ARTICLE_NUMBER), lambda n: F.when(F.lower(n).startswith("art"), n).otherwise(F.concat(F.lit("Art. "), n)))
        return let(first(m, ARTICLE_TEXT), lambda body: F.when(body.isNotNull(), F.concat_ws("\n", label, body)))

    def one(item: Column) -> Column:
        m = F.from_json(F.when(F.startswith(F.trim(item), F.lit("{")), item), _MAP)
        return let(m, lambda m: F.when(m.isNull(), text.blank_to_null(item)).otherwise(labelled(m)))

    return text.blank_to_null(F.array_join(F.array_compact(F.transform(items, one)), "\n\n"))


def raw_options(r: Column) -> Column:
    return anywhere(r, OPTIONS)


def is_question(r: Column) -> Column:
    """A question's type, options, a key with a statement, or a board with a number."""
    kind = F.lower(F.coalesce(first(r["top"], ["type", "doc_type", "tipo"]), F.lit("")))
    named = reduce(lambda a, b: a | b, [kind.contains(t) for t in QUESTION_TYPES])
    keyed = anywhere(r, KEY).isNotNull() & F.coalesce(anywhere(r, STATEMENT), anywhere(r, ["texto", "body"])).isNotNull()
    answered = anywhere(r, REFERENCE).isNotNull() & anywhere(r, STATEMENT).isNotNull()
    numbered = nested(r, ["banca"]).isNotNull() & nested(r, ["numero_questao", "questao_numero"]).isNotNull()
    return named | raw_options(r).isNotNull() | keyed | answered | numbered


def option_map(raw: Column) -> Column:
    """Options in any shape (object, array of objects or strings, lines of text) → letter → text."""
    line = r"^\s*\(?([A-Za-z])\)?\s*[).:\-]\s*"

    def pair(letter: Column, body: Column) -> Column:
        return F.struct(F.upper(F.substring(F.trim(letter), 1, 1)).alias("key"), F.trim(body).alias("value"))

    def from_line(x: Column) -> Column:
        return F.when(x.rlike(line), pair(F.regexp_extract(x, line, 1), F.regexp_replace(x, line, "")))

    def from_object(m: Column) -> Column:
        place = first(m, ["ordem", "order", "index"]).try_cast("int")
        letter = F.coalesce(first(m, OPTION_LETTER), let(place, lambda p: F.when(p.between(1, 26), F.chr(p + 64))))
        return let(F.struct(letter.alias("l"), first(m, OPTION_TEXT).alias("b")), lambda o: F.when(o["l"].isNotNull() & o["b"].isNotNull(), pair(o["l"], o["b"])))

    def from_item(x: Column) -> Column:
        return let(F.from_json(F.when(F.trim(x).startswith("{"), x), _MAP), lambda m: F.when(m.isNull(), from_line(x)).otherwise(from_object(m)))

    def pairs(whole: Column) -> Column:
        objects = F.from_json(F.when(whole.startswith("{"), whole), _MAP)
        items = F.from_json(F.when(whole.startswith("["), whole), "array<string>")
        lines = F.when(~whole.rlike(r"^[\[{]"), F.split(whole, "\n"))
        named = F.transform(F.map_entries(objects), lambda e: F.when(e["value"].isNotNull(), pair(e["key"], e["value"])))
        return F.array_compact(F.coalesce(named, F.transform(items, from_item), F.transform(lines, from_line)))

    def last_of_each(good: Column) -> Column:
        after = lambda i: F.slice(good, i + 2, F.greatest(F.size(good), F.lit(1)))
        return F.map_from_entries(F.array_sort(F.filter(good, lambda e, i: ~F.exists(after(i), lambda o: o["key"] == e["key"]))))

    return let(F.trim(raw), lambda whole: let(pairs(whole), last_of_each))


def option_lines(raw: Column) -> Column:
    return text.blank_to_null(F.array_join(F.transform(F.map_entries(option_map(raw)), lambda e: F.concat(e["key"], F.lit(") "), e["value"])), "\n"))


def question_body(r: Column) -> Column:
    """Statement, options, key and reference answer of a question, parted by blank lines."""
    statement = F.coalesce(anywhere(r, STATEMENT), anywhere(r, ["enunciado"]), first(r["top"], ["texto", "body", "content"]))
    key = F.concat(F.lit("Gabarito (objetiva): "), anywhere(r, KEY))
    answer = F.concat(F.lit("Resposta de referência (discursiva):\n"), anywhere(r, REFERENCE))
    return F.when(is_question(r), text.blank_to_null(F.concat_ws("\n\n", statement, option_lines(raw_options(r)), key, answer)))


def body(r: Column) -> Column:
    """The main text: law (flat, nested, articles), question, summary, case law, anything."""
    top = r["top"]
    return F.coalesce(
        first(top, BODY_OF_LAW), nested(r, BODY_OF_LAW), articles(r), question_body(r),
        first(top, BODY_OF_SUMMARY), nested(r, BODY_OF_SUMMARY), first(top, BODY_OF_CASE), nested(r, BODY_OF_CASE), first(top, BODY_OF_ANY),
    )


def title(r: Column) -> Column:
    return first(r["top"], TITLE)


def explanation(r: Column) -> Column:
    return anywhere(r, EXPLANATION)


def external_id(r: Column) -> Column:
    """Its own id, else a hash of the title and the whole body."""
    made = F.sha2(F.concat_ws("\n", F.coalesce(title(r), F.lit("")), F.coalesce(body(r), F.lit(""))), 256)
    return F.coalesce(first(r["top"], SOURCE_ID), made)


def merged(low: Column, high: Column) -> Column:
    """The union of two maps; where both have a key, ``high`` wins."""
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    union = lambda l, h: F.map_concat(F.map_filter(l, lambda k, _: ~F.map_contains_key(h, k)), h)
    return let(F.coalesce(low, none), lambda l: let(F.coalesce(high, none), lambda h: union(l, h)))


def meta(r: Column) -> Column:
    """The nested meta and all other top-level names; what is nested wins."""
    rest = F.map_filter(r["top"], lambda k, v: ~k.isin(RESERVED) & v.isNotNull() & ~k.startswith("_"))
    return F.map_filter(merged(rest, F.coalesce(r["metadata"], r["meta"])), lambda _, v: v.isNotNull())


def flat_meta(r: Column) -> Column:
    """Meta with the key, the reference answer and the options of nested questions, where absent."""
    found = F.create_map(F.lit("gabarito"), anywhere(r, KEY), F.lit("resposta_oficial"), anywhere(r, REFERENCE), F.lit("alternativas"), raw_options(r))
    return merged(F.map_filter(found, lambda _, v: v.isNotNull()), meta(r))


def sorted_json(m: Column) -> Column:
    """A map as JSON with ascending names: equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def canonical(x: Column, names: dict[str, str], other=F.upper) -> Column:
    """The canonical name of a value, else the value in capitals (or what ``other`` makes)."""
    table = F.create_map(*[F.lit(s) for pair in names.items() for s in pair])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")), other(text.blank_to_null(x)))


def organised(m: Column) -> Column:
    """Canonical fields of a meta map; missing ones are left out of the map."""
    return let(m, _organised)


def _organised(m: Column) -> Column:
    fields = {
        "tribunal": canonical(first(m, ["tribunal", "court", "orgao"]), COURTS),
        "materia": canonical(first(m, ["materia", "assunto", "area"]), SUBJECTS, F.initcap),
        "banca": canonical(first(m, ["banca", "orgao_examinador", "instituicao"]), BOARDS),
        "ano": first(m, ["ano", "ano_prova"]).try_cast("int").cast("string"),
        "cargo": first(m, ["cargo", "cargo_prova"]),
        "numero_questao": first(m, ["numero_questao", "questao_numero"]),
        "formato_questao": F.initcap(value(m, "formato_questao")),
        "secao_lei_seca": first(m, ["secao_lei_seca", "categoria_lei"]),
        "lex_ml_urn": first(m, ["urn", "lexml_urn"]),
        "numeracao": first(m, ["numeracao", "numero", "id_publico"]),
        "tags_incidencia": first(m, ["tags_incidencia", "bancas"]),
    }
    return F.map_filter(F.create_map(*[x for n, c in fields.items() for x in (F.lit(n), c)]), lambda _, v: v.isNotNull())


def letter(x: Column) -> Column:
    """The single letter A to E in an answer, else its first character."""
    up = F.upper(F.trim(x))
    return F.coalesce(F.nullif(F.regexp_extract(up, r"\b([A-E])\b", 1), F.lit("")), F.nullif(F.substring(up, 1, 1), F.lit("")))


def answered_wrong(m: Column) -> Column:
    """True, false or null (not known) of a flat map: flags, then the result, then the letters."""
    return let(m, _answered_wrong)


def _answered_wrong(m: Column) -> Column:
    flag = lambda n: F.lower(value(m, n)) == "true"
    unflag = lambda n: F.lower(value(m, n)) == "false"
    wrong = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (unflag("acertou"), unflag("usuario_acertou"), unflag("correto_usuario"), flag("errou"), flag("is_wrong"), flag("incorreta"), flag("incorrect"), F.lower(value(m, "resultado")).isin("errado", "erro", "incorrect", "falso"))])
    differ = letter(text.answer_letter(first(m, KEY))) != letter(first(m, USER_ANSWER))
    right = F.coalesce(flag("acertou"), F.lit(False)) | F.coalesce(unflag("errou") & (value(m, "classificacao") == "CERTA"), F.lit(False))
    return F.when(wrong | F.coalesce(differ, F.lit(False)), True).when(right, False)


#: Other spellings of the flags and answers, and the names that they stand for.
ALIGNED = {"usuario_acertou": ["answered_correctly", "answeredCorrectly", "usuarioAcertou"], "resposta_usuario": ["user_answer", "userAnswer", "respostaMarcada", "marcacao_usuario", "user_option"], "gabarito": ["gabaritoOfficial", "resposta_certa", "correct_answer", "correctAnswer"]}


def aligned(m: Column) -> Column:
    """A flat map in which flags and answers in other spellings stand under the usual names too."""
    return let(m, _aligned)


def _aligned(m: Column) -> Column:
    known = lambda x: F.map_filter(x, lambda _, v: v.isNotNull())
    names = F.create_map(*[x for n, others in ALIGNED.items() for x in (F.lit(n), first(m, others))])

    def with_right(out: Column) -> Column:
        right = F.coalesce(value(out, "acertou"), value(out, "usuario_acertou"), value(out, "correct"))
        return merged(known(F.create_map(F.lit("acertou"), right)), out)

    return let(merged(known(names), known(m)), with_right)


def network(url: Column) -> Column:
    out = F.lit("exam_network")
    for needle, name in reversed(NETWORKS):
        out = F.when(F.lower(url).contains(needle), name).otherwise(out)
    return out


def exam_year(m: Column) -> Column:
    return F.substring(first(m, ["ano", "ano_prova"]), 1, 4).try_cast("int")
