"""Identities, overlaps and aliases against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vereda.functions.legal import article
from vereda.operators import automaton, identity, overlap


def plain_groups(rows):
    part = {i: i for i, _ in rows}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    seen = {}
    for i, keys in rows:
        for k in keys or []:
            if k is not None:
                a, b = find(i), find(seen.setdefault(k, i))
                part[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_identities_follow_chains(spark):
    rng = random.Random(4)
    ids = rng.sample(range(1000), 400)
    rows = [(i, [f"c{n}", f"c{n + 1}"]) for n, i in enumerate(ids[:120])]  # one chain of 120 rows
    rows += [(i, ["hot", f"x{i}"]) for i in ids[120:260]]  # a key that a third of the rows have
    rows += [(i, [f"r{rng.randrange(90)}", None, f"r{rng.randrange(90)}"]) for i in ids[260:380]]
    rows += [(i, None) for i in ids[380:390]] + [(i, []) for i in ids[390:]]
    df = spark.createDataFrame(rows + rows[:5] + [(None, ["hot"])], "id long, keys array<string>")
    got = {r.id: r.identity for r in identity.identities(df, "id", F.col("keys")).collect()}
    assert got.pop(None) is None and got == plain_groups(rows)
    assert identity.identities(df.limit(0), "id", F.col("keys")).count() == 0


def test_best_of_each_and_top_of_each(spark):
    df = spark.createDataFrame([(1, 5, 2), (2, 5, 2), (3, 5, 9), (4, 6, 1), (5, None, 1), (6, None, 0)], "id int, g int, s int")
    best = identity.best_of_each(df, "g", [F.col("s"), F.col("id")])
    assert {r.id for r in best.filter("kept").collect()} == {1, 4, 6} and best.count() == 6
    top = identity.top_of_each(df, ["g"], [F.desc("s"), F.col("id")], 2).collect()
    assert {(r.id, r.place) for r in top} == {(3, 1), (1, 2), (4, 1), (5, 1), (6, 2)}


@pytest.mark.parametrize("least", [1, 3, 7])
def test_overlaps_equal_all_pairs(spark, least):
    rng = random.Random(least)
    words = [f"w{int(rng.paretovariate(0.6)) % 300:04d}" for _ in range(4000)]
    some = lambda n: {k: rng.sample(words, rng.randint(0, 40)) for k in range(n)}
    left, right = some(60), some(80)
    left[60] = right[80] = words[:300]
    df = lambda d, k: spark.createDataFrame([(i, sorted(set(w))) for i, w in d.items()] + [(None, words[:50]), (999, None)], f"{k} int, tokens array<string>")
    want = {(i, j, len(set(a) & set(b))) for i, a in left.items() for j, b in right.items() if len(set(a) & set(b)) >= least}
    assert {tuple(r) for r in overlap.overlapping(df(left, "l"), df(right, "r"), least).collect()} == want
    top = overlap.most_overlapping(df(left, "l"), df(right, "r"), least, 2).collect()
    for i in left:
        mine = sorted(((-n, j) for a, j, n in want if a == i))[:2]
        assert [(r.r, r.place) for r in sorted(top, key=lambda r: r.place) if r.l == i] == [(j, k + 1) for k, (_, j) in enumerate(mine)]


def test_overlaps_return_no_more_pairs_than_asked(spark):
    hot = [f"w{i}" for i in range(9)]
    df = lambda n, k: spark.createDataFrame([(i, hot + [f"{k}{i}"]) for i in range(n)], f"{k} int, tokens array<string>")
    got = overlap.overlapping(df(40, "l"), df(500, "r"), 7, 3)  # 20,000 pairs meet
    assert got.count() == 3 * 40 and {(r.r, r.overlap) for r in got.collect()} == {(0, 9), (1, 9), (2, 9)}


def _plain_pairs(left, right, least):
    return {(i, j, len(set(a) & set(b))) for i, a in left.items() for j, b in right.items() if len(set(a) & set(b)) >= least}


def test_overlaps_hold_no_block_in_a_row(spark):
    df = lambda n, k: spark.createDataFrame([(i, [f"w{j}" for j in range(i % 9, i % 9 + 12)]) for i in range(n)], f"{k} int, tokens array<string>")
    found = overlap.overlapping(df(30, "l"), df(50, "r"), 7, None)
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "HashJoin" not in plan  # either had a whole block in an executor's memory
    assert found.count() == len(_plain_pairs({i: range(i % 9, i % 9 + 12) for i in range(30)}, {i: range(i % 9, i % 9 + 12) for i in range(50)}, 7))


@pytest.mark.parametrize("top", [None, 2])
def test_overlaps_of_many_blocks_long_and_equal_sets(spark, monkeypatch, top):
    monkeypatch.setattr(overlap, "WORK", 1)
    monkeypatch.setattr(overlap, "TASKS", 6)
    monkeypatch.setattr(overlap, "BLOCK", 1500)
    monkeypatch.setattr(overlap, "LONGEST", 4)
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.5)) % 400:04d}" for _ in range(6000)]
    some = lambda n, most: {k: sorted(set(rng.sample(words, rng.randint(0, most)))) for k in range(n)}
    left, right = some(50, 60), some(70, 40) | {70 + k: sorted(set(rng.sample(words, 400))) for k in range(5)}
    left |= {100 + k: left[k] for k in range(0, 50, 2)}  # equal sets on both sides
    right |= {100 + k: right[k % 8] for k in range(60)} | {200 + k: right[70] for k in range(4)}
    df = lambda d, k: spark.createDataFrame([(i, w + [None]) for i, w in d.items()], f"{k} int, tokens array<string>")
    want = _plain_pairs(left, right, 5)
    got = {tuple(r) for r in overlap.overlapping(df(left, "l"), df(right, "r"), 5, top).collect()}
    if top is None:
        assert got == want
    else:
        best = {p for i in left for p in sorted((p for p in want if p[0] == i), key=lambda p: (-p[2], p[1]))[:top]}
        assert best <= got <= want
        found = overlap.most_overlapping(df(left, "l"), df(right, "r"), 5, top).collect()
        assert {(r.l, r.r, r.overlap) for r in found} == best and len(found) == len(best)


def test_overlaps_tell_tokens_of_equal_numbers_apart(spark, monkeypatch):
    first = lambda token, salt: F.xxhash64(token, F.lit(salt)) if salt else F.length(token).cast("long")
    monkeypatch.setattr(overlap, "number", first)
    sets = lambda k: spark.createDataFrame([(1, [f"{k}{i}" for i in range(8)] + ["b", "cc"])], f"{k} int, tokens array<string>")
    assert [tuple(r) for r in overlap.overlapping(sets("l"), sets("r"), 2).collect()] == [(1, 1, 2)]


@pytest.mark.parametrize("sparse", [0, 10**6])
@pytest.mark.parametrize("seen", [1, 3, 50])
def test_shared_equals_all_pairs(monkeypatch, seen, sparse):
    for k, v in {"SEEN": seen, "SPARSE": sparse, "BITS": 70, "FREQUENT": 20, "PAIRS": 50}.items():
        monkeypatch.setattr(overlap, k, v)
    rng = np.random.default_rng(seen)
    draw = lambda n, most: [np.unique(rng.zipf(1.3, rng.integers(0, most)) % 500).astype(np.int64) for _ in range(n)]
    left, right = draw(60, 80), draw(200, 60)
    least = rng.integers(1, 12, len(left)).astype(np.int32)
    for top in (None, 3):
        block = overlap.Block(np.concatenate(right), np.repeat(np.arange(len(right), dtype=np.int32), [len(x) for x in right]), len(right))
        found = list(block.shared(np.concatenate(left), np.array([len(x) for x in left]), least, top))
        got = [(int(i), int(j), int(n)) for part in found for i, j, n in zip(*part, strict=True)]
        want = [(i, j, n) for i, a in enumerate(left) for j, b in enumerate(right) if (n := len(np.intersect1d(a, b))) >= least[i]]
        if top:
            want = [p for i in range(len(left)) for p in sorted((p for p in want if p[0] == i), key=lambda p: (-p[2], p[1]))[:top]]
        assert len(got) == len(set(got)) and set(got) == set(want) and len(found) > 1


def test_tokens_are_folded_and_distinct(spark):
    df = spark.createDataFrame([("Súmula SUMULA sobre alternativa ab1234 curto não",), (None,)], "t string")
    assert [r[0] for r in df.select(overlap.tokens(F.col("t"))).collect()] == [["sumula", "ab1234", "curto"], []]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_phrases_by_automaton_and_by_join(spark, limit):
    rng = random.Random(7)
    vocab = ["codigo", "penal", "civil", "lei", "do", "da", "execucao", "acao", "aa", "a"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    phrases = [*{text(rng.randint(2, 6)) for _ in range(300)}, "codigo penal", "codigo penal", "penal", "aa a", "odigo pen", None, " "]
    texts = {i: text(rng.randint(0, 40)) for i in range(80)} | {100: "penal", 101: "", 102: text(30000 if limit else 1500)}
    df = spark.createDataFrame([*texts.items(), (103, None)], "id int, text string")
    aliases = spark.createDataFrame([(i, p, i % 7) for i, p in enumerate(phrases)], "place int, alias string, target int")
    want = {(i, p) for i, t in texts.items() for p in set(phrases) if p and p.strip() and p in t}
    found = automaton.contained(df, "id", "text", aliases, "alias", limit).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    first = {r.id: (r.place, r.target) for r in automaton.first_alias(df, "id", "text", aliases, limit).collect()}
    by = {}
    for i, p in want:
        n = phrases.index(p)
        by[i] = min(by.get(i, (n, n % 7)), (n, n % 7))
    assert first == by
    assert automaton.contained(df, "id", "text", aliases.limit(0), "alias", limit).count() == 0


def test_cited_articles(spark):
    body = "Art. 1º Matar alguém:\nPena.\n\nArt. 12. Outro texto\nlinha\n\nArt. 13 Fim."
    laws = spark.createDataFrame([(1, body), (2, "Art. 12 De outra lei.")], "target int, body string")
    numbers = F.transform(F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*art\.?[ ]*([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))
    parts = laws.select("target", "body", F.explode(numbers).alias("number")).select("target", "number", article(F.col("body"), F.col("number")).alias("block"))
    texts = spark.createDataFrame([(7, "o art. 12 e o artigo 1 do codigo penal, art 12 e art. 99"), (8, "art. 12 do codigo civil"), (9, "art. 13 sem lei"), (10, None)], "id int, text string")
    aliases = spark.createDataFrame([(0, "codigo penal", 1), (1, "codigo civil", 2), (2, "codigo", 1)], "place int, alias string, target int")
    named = automaton.first_alias(texts, "id", "text", aliases)
    asked = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\bart(?:igo)?\.?\s*(\d{1,4})"), F.lit(1)), lambda n: n.cast("int"))
    got = {(r.id, r.target, r.place, r.number, re.sub(r"\s+", " ", r.block)) for r in automaton.cited_parts(texts, "id", named, asked, parts).collect()}
    assert got == {(7, 1, 0, 12, "Art. 12. Outro texto linha"), (7, 1, 1, 1, "Art. 1º Matar alguém: Pena."), (8, 2, 0, 12, "Art. 12 De outra lei.")}
