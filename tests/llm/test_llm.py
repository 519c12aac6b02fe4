"""Each operator against a plain version of itself, on small hostile tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from vereda.llm import components, impacts, language, minhash, mixing, ngrams, pieces, queries, repeats, store, syncmers, toxicity, words
from vereda.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, rest string"


def table(spark, rows):
    """Rows of (doc_id, text) with the other columns of documents, and clashing ones."""
    full = [(i, t, ["en", "fr", None][n % 3], f"s{n % 2}", len(t or ""), 7, "k", "r") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ.") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t ", "  "]) for _ in range(n))
    passage, base = text(60), text(120).split()
    out = [(0, None), (1, ""), (2, "   \n"), (3, "one"), (4, "One"), (5, "日本語 🙂 text"), (6, text(4000))]
    for i in range(7, 40):
        kind = i % 5
        if kind == 0:
            t = text(rng.randint(1, 40)) + passage + text(rng.randint(0, 30))
        elif kind == 1:
            t = " ".join(base)
        elif kind == 2:
            copy = list(base)
            for _ in range(i % 4):
                copy[rng.randrange(len(copy))] = "edited"
            t = " ".join(copy)
        elif kind == 3:
            t = (text(21) * 3)
        else:
            t = text(rng.randint(0, 80))
        out.append((i, t))
    return out


def test_words_and_runs(rows):
    texts = [t for _, t in rows]
    w = words.split(pa.array(texts))
    got = [[bytes(w.data[w.start[j] : w.end[j]]).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]


def test_fingerprints(spark, rows):
    found = {r.doc_id: r for r in syncmers.compare_neighbours(table(spark, rows)).collect()}
    assert len(found) == len(rows)
    texts = [t or "" for _, t in rows]
    for n, (i, _) in enumerate(rows):
        own, after = texts[n], texts[(n + 1) % len(rows)]
        q = len(own) // 4
        edited = own[: len(own) - q] + after[:q]
        r = found[i]
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert bytes.fromhex(r.fingerprint) == syncmers.fingerprints([own])[0].tobytes()
        assert bytes.fromhex(r.edited_fingerprint) == syncmers.fingerprints([edited])[0].tobytes()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if own == after:
            assert r.near_next == 1


def test_syncmers_are_context_free():
    rng = np.random.default_rng(1)
    core = rng.integers(97, 123, 400).astype(np.uint32)
    hits = []
    for n in (0, 13):
        at, h = syncmers.syncmers(np.concatenate((rng.integers(97, 123, n).astype(np.uint32), core)))
        hits.append({(int(a) - n, int(x)) for a, x in zip(at, h) if a >= n})
    assert hits[0] == hits[1] and len(hits[0]) > 40
    for a, _ in hits[0]:  # an anchor's least inner hash stands at an edge
        one = syncmers.mix(core[a : a + syncmers.K].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        inner = words.runs(one, syncmers.S)
        assert inner.min() in (inner[0], inner[-1])


def test_language(spark):
    en, fr = "the quick brown fox and the dog were over there ", "le renard brun et rapide saute sur un chien dans le pré "
    rows = [(i, (en if i % 2 else fr)[i % 7 :] * (1 + i % 3), "en" if i % 2 else "fr") for i in range(80)] + [(100, None, "en"), (101, "123 456", None), (102, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert {r.lang_pred for r in language.predict(docs.select("doc_id", "text"), language.fit(docs, F.lit(False))).collect()} == {"und"}


def test_ppm_costs_equal_plain_escapes():
    train = {0: [b"abracadabra abra", b"cad"], 1: [b"banana bandana"]}
    lang, order, key, n = [], [], [], []
    counts = collections.defaultdict(collections.Counter)
    for l, texts in train.items():
        for t in texts:
            padded = language.PAD + t
            for i in range(language.ORDER, len(padded)):
                for k in range(language.ORDER + 1):
                    counts[l, padded[i - k : i]][padded[i]] += 1
    for (l, ctx), c in counts.items():
        for b, m in c.items():
            lang.append(l), order.append(len(ctx)), key.append(int.from_bytes(ctx + bytes([b]), "big")), n.append(m)
    model = language.Model.build(["a", "b"], np.array(lang), np.array(order), np.array(key, np.uint64), np.array(n))

    def plain(l, t):
        padded, total = language.PAD + t, 0.0
        for i in range(language.ORDER, len(padded)):
            for k in range(language.ORDER, -1, -1):
                c = counts.get((l, padded[i - k : i]))
                if not c:
                    continue
                whole = sum(c.values()) + len(c)
                if padded[i] in c:
                    total += math.log(c[padded[i]] / whole)
                    break
                total += math.log(len(c) / whole)
            else:
                total += math.log(1 / 256)
        return total

    tests = [b"abra", b"", b"zebra bandit", b"\xc3\xa9"]
    assert np.allclose(model.costs(tests), [[plain(l, t) for l in (0, 1)] for t in tests], atol=1e-4)


def plain_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            if k in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_repeats(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in repeats.without_repeats(table(spark, rows)).collect()}
    want = plain_repeats(rows)
    assert got == want and sum(v[1] for v in want.values()) > 500


def test_repeats_keep_columns_and_bear_odd_keys(spark, rows):
    odd = [*rows, (9, rows[6][1]), (None, rows[6][1]), (None, None), rows[8]]
    found = repeats.without_repeats(table(spark, odd))
    assert found.count() == len(odd) and {"part", "key", "rest", "lang"} <= set(found.columns)
    empty = repeats.without_repeats(table(spark, []))
    assert empty.count() == 0


def plain_links(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    want = plain_links(rows)
    assert got == want and sum(not v[2] for v in want.values()) > 5


def test_near_duplicates_in_a_hot_group(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows = []
    for i in range(150):  # copies at all distances around the threshold
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == plain_links(rows)


def test_estimate_is_collision_corrected():
    rng = random.Random(2)
    words_ = [f"a{i}" for i in range(3000)]
    shared = " ".join(words_[:2000])
    texts = [shared + " " + " ".join(words_[2000:2400]), shared + " " + " ".join(f"b{rng.random()}" for _ in range(400))]
    s = minhash.signatures(pa.array(texts))
    differ = 0
    for j in range(4):
        x = int(s["bits"][j][0]) ^ int(s["bits"][j][1])
        differ += bin((x | x >> 1) & 0x5555555555555555).count("1")
    (h, edge) = minhash.shingle_sets(pa.array(texts))
    a, b = set(h[: edge[1]].tolist()), set(h[edge[1] :].tolist())
    assert abs((1 - differ / 128 - 0.25) / 0.75 - len(a & b) / len(a | b)) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 1), (5, 9), (9, 200), (7, 7), (160, 100)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 100 for i in range(101, 161)}, 5: 1, 9: 1, 200: 1}


def test_store(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    more = [*rows, (60, "<|endoftext|> x"), (61, "don't  we'll\n\n 12½ \x00 a"), (62, rows[6][1])]
    out = f"file://{tmp_path}/store"
    store.write(table(spark, more), path, out)
    got = {r.doc_id: r for r in store.checksums(store.read(spark, out)).collect()}
    at = 0
    for i, t in sorted(more):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert spark.read.parquet(f"{out}/chunks").count() == spark.read.parquet(f"{out}/chunks").select("digest").distinct().count()
    broken = spark.read.parquet(f"{out}/recipes").withColumn("n_tokens", F.col("n_tokens") + 1)
    broken.write.parquet(f"{out}-b/recipes")
    for part in ("chunks", "manifest"):
        os.symlink(f"{tmp_path}/store/{part}", f"{tmp_path}/store-b/{part}")
    with pytest.raises(ValueError, match="differ"):
        store.read(spark, f"{out}-b")


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(4)
    core = rng.integers(0, 50000, 20000).astype(np.uint16)
    named = []
    for n in (0, 777):
        ids = np.concatenate((rng.integers(0, 50000, n).astype(np.uint16), core))
        b = store.chunk_bounds(ids, np.array([0, len(ids)]))
        named.append({ids[x:y].tobytes() for x, y in zip(b[:-1], b[1:])})
    assert len(named[0] & named[1]) > 0.9 * len(named[0])


def test_top_k(spark):
    rng = np.random.default_rng(6)
    v = {i: (rng.normal(size=16) / 4).astype(np.float32).tolist() for i in range(300)}
    v[40], v[41] = v[60], v[60]
    bad = [(400, None), (420, [1.0, None] + [0.0] * 14), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (480, [0.5]), (None, v[1])]
    df = spark.createDataFrame([*v.items(), *bad], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in impacts.top_k(df, F.col("vec_id") % 20 == 0, 7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(64 * np.array(x, np.float64)).astype(int) for i, x in v.items()} | {480: np.array([32] + [0] * 15)}
    assert set(got) == {i for i in whole if i % 20 == 0}
    for q in got:
        want = sorted(((int(whole[q] @ x), i) for i, x in whole.items() if i != q), key=lambda p: (-p[0], p[1]))[:7]
        assert got[q] == [(i, s) for s, i in want]


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 32)) * 20
    v = np.round(centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 32)) * 2).astype(np.int64)
    row, dim = np.nonzero(v)
    value = v[row, dim]
    by = np.argsort(-np.abs(value), kind="stable")
    q, r, s = impacts.search(np.arange(4000), np.stack((row[by], dim[by], value[by])), 32, np.arange(20), v[:20], 5)
    for i in range(20):
        full = v @ v[i]
        full[i] = -(10**9)
        want = np.lexsort((np.arange(4000), -full))[:5]
        assert r[q == i].tolist() == want.tolist() and s[q == i].tolist() == full[want].tolist()


def test_lm_scores(spark, rows):
    docs = table(spark, rows)
    got = {r.doc_id: r for r in ngrams.scores(docs, crc_mod("doc_id", 7) != 2).collect()}
    tok = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    c = collections.Counter(x for i in tok if crc(i) % 7 != 2 for x in tok[i])
    n, v = sum(c.values()), len(c)
    for i, w in tok.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert {r.train_tokens for r in ngrams.scores(docs, F.lit(False)).collect()} == {0}


@pytest.mark.parametrize("sizes", [{}, {"hot": 0}, {"bits": 1 << 12}])
def test_lm_scores_keep_every_ngram(spark, sizes):
    """Against the model without a filter, however small its parts are."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(700)]
    rows = [(i, " ".join(vocab[int(700 * rng.random() ** 2)] for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    got = {r.doc_id: r.score for r in ngrams.scores(table(spark, rows), crc_mod("doc_id", 7) != 2, **sizes).collect()}
    tok = {i: [*t.split(), None] for i, t in rows}
    one, two = collections.Counter(), collections.Counter()
    for i, w in tok.items():
        if crc(i) % 7 != 2:
            one.update(w)
            two.update(zip([None, *w], w))
    mass = sum(one.values()) + len(one) + 1
    read = lambda c, kind: float(ngrams.values(kind)[ngrams.level_of(np.array([c]), kind)[0]]) if c else 0.0
    off = []
    for i, w in tok.items():
        want = 0.0
        for h, x in zip([None, *w], w):
            alone, before = (read(one[x], ngrams.UNI) + 1) / mass, read(one[h], ngrams.UNI)
            seen = min(1.0, read(two[h, x], ngrams.BI) / before) if before else 0.0
            want += math.log10(0.1 * seen + 0.9 * alone if before else alone)
        off.append(abs(got[i] / want - 1))
    assert np.median(off) < 0.005 and max(off) < 0.03


def test_filters_are_stored_without_the_bigrams(spark, rows):
    docs = table(spark, rows)
    _, merged = ngrams.fit(docs, F.lit(True), bits=1 << 12)
    stored = merged.collect()
    assert all((r["keys"] is None and r["counts"] is None) == (r.kind == ngrams.BI) for r in stored)
    assert any(r.parts > 1 for r in stored) and all(len(r["filter"]) % r.parts == 0 for r in stored)
    # every bigram that was seen is read back from the stored bits at its level or above it
    n = collections.Counter()
    for _, text in rows:
        tokens, _ = ngrams.sequence(pa.array([text or ""]))
        n.update(ngrams.bigrams(tokens).tolist())
    keys = np.array(list(n), np.uint64)
    level = ngrams.level_of(np.array(list(n.values())), ngrams.BI)
    buckets = max(r.bucket for r in stored) + 1
    buckets = max(8, buckets)
    to = ngrams.bucket_of(keys, buckets)
    for r in stored:
        if r.kind == ngrams.BI and len(mine := np.flatnonzero(to == r.bucket)):
            found = ngrams.probed(r.parts, bytes(r["filter"]), ngrams.BI, keys[mine].astype(np.uint32))
            assert (found >= level[mine]).all() and (found == level[mine]).mean() > 0.9


def test_filter_reads_levels_back():
    f = ngrams.Filter(4, 1 << 15)
    h = ngrams.mix(np.arange(1, 2001, dtype=np.uint64))
    level = np.arange(2000) % 5 + 1
    ident = f.ident(h, 4)
    bits = np.zeros(4 << 15, bool)
    for k in range(1, 6):
        for at in f.places(ident[level >= k], k, ngrams.UNI):
            bits[at.astype(np.int64)] = True
    f.bytes = np.packbits(bits, bitorder="little")
    found = f.level(h, ngrams.UNI, 1)
    assert (found >= level).all() and (found == level).mean() > 0.9
    assert (f.level(ngrams.mix(np.arange(5000, 7000, dtype=np.uint64)), ngrams.UNI, 1) == 0).mean() > 0.9


def test_raking_reaches_targets(spark, rows):
    docs = table(spark, rows)
    out = mixing.mixed(docs, {"source": {"s0": 0.7, "s1": 0.3}, "lang": 1.0, "topic": 1.0}, rounds=40).collect()
    cells = {(r.source, r.lang, r.topic): r.weight for r in out}
    assert sum(cells.values()) == pytest.approx(1, abs=1e-6)
    assert sum(w for (s, _, _), w in cells.items() if s == "s0") == pytest.approx(0.7, abs=1e-3)
    assert max(r.probability for r in out) == 1 and len(out) == len(rows)
    n = collections.Counter()
    for r in out:
        n[r.lang] += r.n_words
    assert sum(w for (_, lang, _), w in cells.items() if lang is None) == pytest.approx(n[None] / sum(n.values()), abs=1e-3)
    assert mixing.mixed(table(spark, [])).count() == 0


def test_sentencepiece(spark, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    more = [*rows, (70, "a▁b  c"), (71, " " * 40), (72, "\x00\r\n<s>"), (73, "".join(rng.choice("the ing on") for _ in range(3000))), (74, "x" * 5000)]
    got = {r.doc_id: r for r in pieces.encoded(table(spark, more), path).collect()}
    for i, t in more:
        assert got[i].ids == sp.encode(t or "")
        assert got[i].round_trip == ("▁" not in (t or ""))
        assert got[i].decoded_sha256 == hashlib.sha256(sp.decode(got[i].ids).encode()).hexdigest()


def test_toxicity(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if bad := i % 9 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["worthless", "idiotic", "scumbag"]))
        docs.append((i, " ".join(w)))
        if i % 2 == 0 or bad:
            labels.append((i, 1, int(bad)))
    labels += [(None, 1, 1), (3, 1, None)]
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, l, crc_mod("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [i for i in range(900) if crc(i) % 5 == 0]
    assert all(got[i].predicted == (i % 9 == 0) for i in held)
    assert got[1000].predicted == 0 and 0 <= got[1001].score <= 1
    none = toxicity.score(d, toxicity.fit(d, l.filter("toxic = 0"), F.lit(True))).agg(F.max("predicted").alias("m")).first().m
    assert none == 0


def test_risk_gradient_is_non_negative():
    rng = np.random.default_rng(1)
    row, feature = np.repeat(np.arange(200), 3), rng.integers(0, 30, 600)
    positive = np.arange(200) < 40
    feature[: 40 * 3] = rng.integers(25, 30, 120)
    w, b = toxicity.train(row, feature, positive, 30, 0.2)
    z = b + np.bincount(row, w[feature], 200)
    assert z[positive].mean() > z[~positive].mean()


def test_empty_tables(spark):
    none = table(spark, [])
    assert syncmers.compare_neighbours(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert ngrams.scores(none, F.lit(True)).count() == 0
    assert language.predict(none.select("doc_id", "text"), language.fit(none, F.lit(True))).count() == 0
    assert impacts.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_queries_cover_all():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version of it, on what its predecessor kept."""
    import corpus_pipeline as cp
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    have = {r.doc_id: r.text for r in docs.collect()}
    outs = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        outs.append(docs)
        if name != "sentencepiece":
            assert docs.columns == list(cp.COLUMNS)
    clean = {r.doc_id: r.text for r in outs[0].collect()}
    assert clean.items() <= have.items() and len(clean) > 0.6 * len(have)
    links = plain_links(list(clean.items()))
    near = {r.doc_id: r.text for r in outs[1].collect()}
    assert near == {i: clean[i] for i in clean if links[i][2]}
    cut = {r.doc_id: r.text for r in outs[2].collect()}
    assert cut == {i: v[2] for i, v in plain_repeats(list(near.items())).items()}
    mixed = {r.doc_id: r.text for r in outs[3].collect()}
    assert mixed.items() <= cut.items() and mixed
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.ids for r in outs[4].collect()} == {i: sp.encode(t) for i, t in mixed.items()}


def test_pieces_index_a_bounded_number_of_characters():
    import tracemalloc

    tables = pieces.Tables.load(public_tokenizers.path("piece_bpe_32k.model"))
    make = random.Random(5)
    text = " ".join("".join(make.choices("abcdefghij", k=9)) for _ in range(100_000))
    tables.encode(["warm up"])
    tracemalloc.start()
    ids, edge = tables.encode([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw, at = tables.decode(ids, edge)
    assert raw[at[0] + 1 : at[1]] == text.encode() and peak < 120 << 20
