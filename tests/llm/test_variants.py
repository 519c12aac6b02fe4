"""Spelling variants against a plain version, on words made to be near each other."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vereda.llm import variants


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n, out, form = plain_words(rows), {}, {}
    for w in n:
        close = sorted((v for v in n if abs(len(v) - len(w)) < 2 and near(v, w)), key=lambda v: (-n[v], v))
        form[w] = close[0] if close and n[close[0]] >= 10 * n[w] else None
        out[w] = len(close)
    root = dict.fromkeys(n)
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted((w, form[w] or "", root[w], n[w], out[w], n[form[w]] if form[w] else -1) for w in n)


def got(spark, rows, extra=""):
    found = variants.spelling_variants(spark.createDataFrame([(*r, *["x"] * extra.count(",")) for r in rows], "doc_id long, text string" + extra)).collect()
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    bases = ["".join(rng.choice("abÀé÷zx") for _ in range(rng.randint(7, 10))) for _ in range(6)] + ["aaaaaaaa", "aaaaaaab", "abababab", "babababa"]

    def edited(w, times):
        for _ in range(times):
            i, c = rng.randrange(len(w)), rng.choice("abÀéz")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])
        return w

    out = [(None, None), (None, "Aaaaaaaa AAAAAAAA"), (1, ""), (2, "short words 1234567 only"), (2, "repeated repeated"), (2, "repeated repeated")]
    for i in range(3, 120):
        words = [edited(rng.choice(bases), rng.choice([0] * 30 + [1] * 3 + [2])) for _ in range(rng.randint(0, 60))]
        out.append((i, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words)))
    # a chain of forms, each ten times as frequent as the one before it
    return out + [(500, " ".join(["chained"] * 2000 + ["chaineds"] * 200 + ["xchaineds"] * 20 + ["xchainedsy"] * 2))]


def test_equals_plain_version(spark, rows):
    want = plain(rows)
    assert got(spark, rows, ", id string, word string, n string, key string, a string, h string") == want
    assert len(want) > 40 and any(w[1] and w[1] != w[2] for w in want)


def test_empty_and_enormous(spark):
    assert got(spark, []) == [] and got(spark, [(1, None), (2, "")]) == []
    long = "ab" * 200000  # its deletions as texts would take 160 GB
    found = got(spark, [(i, t) for i, t in enumerate([long] * 3 + [long + "a"] * 2 + [long[:77] + "c" + long[78:]] * 2 + ["word" * 2])])
    want = plain_words(list(enumerate([long] * 3 + [long + "a"] * 2 + [long[:77] + "c" + long[78:]] * 2)))
    assert {r[0]: r[3] for r in found} == want
    assert {r[0]: r[4] for r in found}[long] == 2


def test_keys_are_shared_once_by_near_words():
    words = ["abcdefgh", "abcdefg", "abcdefgx", "aabcdefgh", "ba", "ab", "aaa", "aa"]
    keys, own = variants.delete_keys(words)
    of = [set(keys[own == i].tolist()) for i in range(len(words))]
    for i, a in enumerate(words):
        assert len(of[i]) == 1 + len({a[:k] + a[k + 1 :] for k in range(len(a))}) == int((own == i).sum())
        for j in range(i):
            assert not near(a, words[j]) or len(of[i] & of[j]) == 1
            assert variants.one_apart(a, words[j]) == near(a, words[j]) == variants.one_apart(words[j], a)
    assert np.array_equal(variants.delete_keys([])[0], np.zeros(0, np.int64))


def test_no_table_of_words_is_broadcast(spark, capsys):
    """Small files make Spark broadcast a table of a million words through the driver."""
    rows = [(i, "variant variant varient varients spelling speling spellings") for i in range(40)]
    found = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    words = spark.createDataFrame([(1, "spelling", 5), (2, "speling", 2)], "id long, word string, n long")
    for df in (found, variants.near_pairs(words)):
        df.collect()
        df.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
