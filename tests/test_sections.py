"""One-pass cutting against plain versions, and its time on long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from vereda.functions import legal, parsing, sections
from vereda.operators import catalogue

KINDS = [("titulo", re.compile("t[ií]tulo\\b", re.I)), ("artigo", re.compile("art\\.?[ ]*[0-9]", re.I))]


def plain_blocks(text):
    out = []
    for p in re.split(r"\n[ \t]*\n", text):
        p = p.strip(" ")
        kind = next((k for k, x in KINDS if x.match(p)), "texto")
        if p and kind == "texto" and out and out[-1][0] == "artigo":
            out[-1] = ("artigo", out[-1][1] + "\n" + p)
        elif p:
            out.append((kind, p))
    return out


def plain_pages(text, size):
    if len(text) <= size * 1.2:
        return [text]
    out, held = [], ""
    for line in text.split("\n"):
        line = line.strip(" ")
        if line and held and len(held) + len(line) + 1 > size:
            out.append(held[:-1])
            held = ""
        held += line + "\n" if line else ""
    return out + ([held[:-1]] if held else [])


def plain_pieces(text, size):
    text, out = text.strip(sections.WHITE), []
    while text:
        end = min(size, len(text))
        if len(text) > size:
            blank = text.rfind("\n\n", 0, size)
            end = blank if blank > size // 3 else size
        out.append(text[:end].strip(sections.WHITE))
        text = text[end:]
    return [p for p in out if p]


def test_equal_plain_versions(spark):
    rng = random.Random(11)
    words = ["Art. 1", "Título I", "art 22 x", "text", "ação", "\n\n", "\n \n", "\n", " ", "x" * 30, "título", "Artigo"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "\n\n", " "]
    for t in texts:
        assert sections.blocks(t, KINDS, "texto", {"artigo"}) == plain_blocks(t)
        for size in (7, 40, 90):
            assert sections.pages(t, size) == plain_pages(t, size)
            assert sections.pieces(t, size) == plain_pieces(t, size)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    for r in df.select("i", "t", legal.structure(F.col("t")).alias("b"), parsing.pages(F.col("t"), 40).alias("p"), catalogue.pieces(F.col("t"), 40).alias("c")).collect():
        if r.i < 0:
            assert r.b is None and r.p is None and r.c == []
        else:
            assert r.p == plain_pages(r.t, 40) and r.c == plain_pieces(r.t, 40)
            assert "".join(x.text for x in r.b).replace("\n", "").replace(" ", "") == re.sub(r"\s", "", r.t)


@pytest.mark.parametrize("cut", [lambda t: sections.blocks(t, KINDS, "texto", {"artigo"}), lambda t: sections.pages(t, 2800), lambda t: sections.pieces(t, 1800)])
def test_time_follows_the_text(cut):
    part = "Art. 7 Something that is said at some length here.\n\nMore of it follows\nin two lines.\n\n" * 1000
    took = []
    for n in (110, 220):  # 10 and 20 MB
        began = time.process_time()
        cut(part * n)
        took.append(time.process_time() - began)
    assert took[1] < 3 * took[0] + 0.5 and took[1] < 20


def test_summary_pages(spark):
    page = "STF\nSúmula Vinculante 11\nJulgamento: 13/08/2008\nPublicação: 22/08/2008\n— riscado fora\nSúmula\nSó é lícito o uso de algemas em casos de resistência.\nOutra linha que segue."
    rows = [(1, page, "https://x/stf"), (2, "Súmula 7\ncurta", "https://x/stj/7"), (3, "", None), (4, None, "https://x/tst-vinculante")]
    df = spark.createDataFrame(rows, "i int, t string, u string").select("i", legal.summary_page(F.col("t"), F.col("u")).alias("s"))
    got = {r.i: tuple(r.s) for r in df.collect()}
    assert got[1] == (11, "STF", True, "13/08/2008", "22/08/2008", "Só é lícito o uso de algemas em casos de resistência.")
    assert got[2] == (7, "STJ", False, None, None, "curta")
    assert got[3][0] is None and got[3][5] is None and got[4][1:3] == ("TST", True)
