"""Hostile tables for every operator and stage, plain versions, and lost parts of a store."""

import collections
import hashlib
import math
import os
import random
import re
import shutil
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
import public_tokenizers
from vereda.llm import impacts, language, minhash, mixing, ngrams, pieces, repeats, store, syncmers, toxicity
from vereda.llm.common import crc_mod

from test_llm import plain_links, plain_repeats

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns named like those that operators make for themselves.
CLASH = ["_source", "_lang", "_topic", "rest", "key", "h", "id", "part", "tail", "score", "predicted", "lang_pred", "n_words", "n_removed", "topic", "weight", "band", "first", "shard", "pack", "_w", "_have", "cell", "chance", "_id", "_h", "_nth"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def hostile(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *["x"] * len(CLASH)) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(60)
    huge = " ".join(["lorem ipsum dolor sit amet"] * 60000) + " " + "x" * 300000  # 1.9 MB, a third of a MB without a space
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t", "fr", "a"), (4, "½ Ⅷ 12", "fr", "b"), (5, base, "en", "a"), (5, base, "en", "a"), (6, base + " end", "en", None), (None, base, "fr", "b"), (None, None, None, None), (7, huge, "en", "a"), (7, text(30), "fr", "b"), (8, base, None, "a")]
    return rows + [(i, text(rng.randint(0, 50)), rng.choice(["en", "fr", None]), rng.choice("ab")) for i in range(20, 40)]


def labels(spark):
    return spark.createDataFrame([(20, 1, 1), (21, 1, 0), (21, 0, 1), (22, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def run_all(spark, df):
    """One frame for each operator that takes documents."""
    yield "op1", syncmers.compare_neighbours(df)
    yield "op2", language.predict(df, language.fit(df, F.lit(True)))
    yield "op3", repeats.without_repeats(df)
    path = store.new_path(spark)
    store.write(df, BYTES, path)
    yield "op4", store.read_checksums(spark, path)
    yield "op6", ngrams.scores(df, crc_mod("doc_id", 7) != 2, share=None)
    yield "op7", mixing.mixed(df)
    yield "op8", minhash.near_duplicates(df)
    yield "op9", pieces.encoded(df, PIECES, with_ids=False)
    yield "op10", toxicity.score(df, toxicity.fit(df, labels(spark), F.lit(True)))


def test_hostile_rows_keep_their_number(spark, odd):
    df = hostile(spark, odd).cache()
    for name, out in run_all(spark, df):
        got = out.collect()
        assert len(got) == len(odd), name
        assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, *_ in odd), name
        if name == "op2":
            und = {r.doc_id for r in got if r.lang_pred == "und"}
            assert {1, 2, 3, 4} <= und and not und & {5, 6}
        if name == "op7":  # kept columns, and those that are named like the added ones
            assert {"_source", "rest", "h", "id", "topic"} <= set(out.columns) and all(r._source == "x" for r in got)
        if name == "op8":
            by = {(r.doc_id, r.n_shingles): r.component_id for r in got}
            assert by[5, 56] == by[6, 57] == by[8, 56] == 5 and by[None, 56] is None and all(r.kept for r in got if r.doc_id is None)


def test_hostile_empty_tables(spark):
    df = hostile(spark, [])
    for name, out in run_all(spark, df):
        assert out.count() == 0, name
    for name, stage in cp.STAGES:
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
        if name != "toxicity":
            assert stage(spark, docs, "").count() == 0, name


def test_store_of_hostile_rows_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    path = store.new_path(spark)
    store.write(hostile(spark, odd), BYTES, path)
    want = collections.Counter((i, zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, *_ in odd)
    got = store.read_checksums(spark, path).collect()
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered[:-1]]))


def _store(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(str(rng.randrange(900)) for _ in range(n))
    shared = text(3000)
    docs = spark.createDataFrame([(i, text(400) + shared if i % 9 == 0 else text(700)) for i in range(120)], "doc_id long, text string").repartition(6)
    path = f"{tmp_path}/store"
    store.write(docs, BYTES, f"file://{path}")
    assert store.read(spark, f"file://{path}").count() == 120
    return path


def _edit(path, part, change):
    """Rewrite the files of a part; change takes and gives a table."""
    for f in sorted(os.listdir(f"{path}/{part}")):
        if f.endswith(".parquet"):
            full = f"{path}/{part}/{f}"
            table = change(pq.read_table(full))
            pq.write_table(table, full)
    for f in os.listdir(f"{path}/{part}"):
        if f.endswith(".crc"):
            os.remove(f"{path}/{part}/{f}")


@pytest.mark.parametrize("part", ["recipes", "manifest"])
def test_a_lost_shard_is_found(spark, tmp_path, part):
    path = _store(spark, tmp_path)
    _edit(path, part, lambda t: t.filter(pa.compute.not_equal(t.column("shard"), 1)))
    with pytest.raises(ValueError, match="differ"):
        store.read(spark, f"file://{path}")


def test_an_extra_shard_is_found(spark, tmp_path):
    path = _store(spark, tmp_path)
    for f in os.listdir(f"{path}/recipes"):
        if f.endswith(".parquet"):
            t = pq.read_table(f"{path}/recipes/{f}")
            t = t.set_column(0, t.schema.field(0), pa.array([99] * t.num_rows, pa.int32()))
            pq.write_table(t, f"{path}/recipes/more-{f}")
    with pytest.raises(ValueError, match="differ"):
        store.read(spark, f"file://{path}")


def test_a_lost_chunk_and_a_changed_byte_are_found(spark, tmp_path):
    path = _store(spark, tmp_path)
    shutil.copytree(f"{path}/chunks", f"{tmp_path}/chunks")
    lost = pq.read_table(f"{path}/chunks").column("digest")[7].as_py()
    _edit(path, "chunks", lambda t: t.filter(pa.compute.not_equal(t.column("digest"), pa.scalar(lost, pa.binary()))))
    with pytest.raises(Exception, match="missing|put together"):
        store.read(spark, f"file://{path}").count()
    shutil.rmtree(f"{path}/chunks")
    shutil.copytree(f"{tmp_path}/chunks", f"{path}/chunks")

    def flip(t):
        ids = t.column("ids").to_pylist()
        ids = [bytes([x[0] ^ 1]) + x[1:] if d == lost else x for x, d in zip(ids, t.column("digest").to_pylist())]
        return t.set_column(t.column_names.index("ids"), "ids", pa.array(ids, pa.binary()))

    _edit(path, "chunks", flip)
    with pytest.raises(Exception, match="differs from its digest"):
        store.read(spark, f"file://{path}").count()


def test_tokenizers_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        store.Encoder.load(public_tokenizers.path("word_bpe_49k.json"))


def test_likeness_estimates_the_jaccard_index_of_anchors():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    off = []
    for k in range(60):
        a, n = text(3000), 300 * (k % 10)
        b = a[: 3000 - n] + text(n)
        sets = [set(syncmers.syncmers(np.frombuffer(t.encode("utf-32-le"), np.uint32))[1].tolist()) for t in (a, b)]
        f = syncmers.fingerprints([a, b])
        off.append(float(syncmers.likeness(f[:1], f[1:])[0]) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(off)) < 0.03 and np.abs(off).max() < 0.2


def test_likeness_is_positional():
    rng = random.Random(2)
    blocks = ["".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(6)]
    f = syncmers.fingerprints(["".join(blocks), "".join(blocks[::-1]), "q" * 700 + "".join(blocks)])
    like = syncmers.likeness(f[[0, 0, 0]], f)
    assert like[0] == 1 and like[1] < 0.35 and like[2] > 0.8  # another order; the same text, shifted


def test_anchors_have_their_positions(spark):
    text = "".join(random.Random(4).choice("abcdef é") for _ in range(500))
    rows = syncmers.anchors(spark.createDataFrame([(3, text), (4, None)], "doc_id long, text string")).collect()
    at, h = syncmers.syncmers(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    assert {(r.doc_id, r.pos, r.hash) for r in rows} == {(3, int(a), int(x)) for a, x in zip(at, h.view(np.int64))}


def test_language_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    held = language.predict(docs.filter(crc_mod("doc_id", 4) == 2).select("doc_id", "text", "lang"), model).filter("lang is not null and lang_pred <> 'und'").collect()
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_cut_texts_cost_the_same():
    model = language.Model.build(["a", "b"], np.array([0, 0, 1, 1]), np.array([0, 1, 0, 2]), np.array([97, 97 * 256 + 98, 98, 97 * 65536 + 98 * 256 + 99], np.uint64), np.array([3, 2, 4, 1]))
    texts = [b"abcab" * 400, b"", b"zzabc", bytes(range(256)) * 9]
    assert np.allclose(model.costs(texts, 1 << 30), model.costs(texts, 7), rtol=1e-4)


def test_cut_texts_have_the_same_features():
    words_ = ["worthless", "idiotic", "scumbag"]
    chosen = toxicity.Chosen(sorted({int(k) for w in words_ for n in toxicity.SIZES for k in toxicity.keys(np.frombuffer(w.encode(), np.uint8), n)}))
    texts = pa.array(["fill " * 90 + " ".join(words_) + " fill" * 70, "", None, "idiotic"])
    whole, cut = (toxicity.present(texts, chosen, most) for most in (1 << 30, 37))
    assert sorted(zip(*(x.tolist() for x in whole))) == sorted(zip(*(x.tolist() for x in cut))) and len(whole[0]) > 20


def plain_risk(weight, bias, row, feature, positive, prior, ridge):
    z = bias + np.bincount(row, weight[feature], len(positive))
    p, u = positive, ~positive
    rest = np.logaddexp(0, z[u]).mean() - prior * np.logaddexp(0, z[p]).mean()
    return prior * np.logaddexp(0, -z[p]).mean() + max(0.0, rest) + ridge / 2 * (weight**2).sum(), rest


def test_training_lowers_the_non_negative_risk():
    rng = np.random.default_rng(5)
    n, prior = 400, 0.25
    positive = np.arange(n) < 100
    row, feature = np.repeat(np.arange(n), 3), rng.integers(0, 20, 3 * n)
    feature[:300] = rng.integers(12, 20, 300)
    zero = plain_risk(np.zeros(20), math.log(prior / (1 - prior)), row, feature, positive, prior, 1e-4)[0]
    w, b = toxicity.train(row, feature, positive, 20, prior)
    risk, rest = plain_risk(w, b, row, feature, positive, prior, 1e-4)
    assert risk < zero and rest > -0.05  # the corrected part doesn't run below nought
    # no small step away from the fit lowers the risk by much
    for _ in range(30):
        step = rng.normal(size=21) * 0.05
        assert plain_risk(w + step[:-1], b + step[-1], row, feature, positive, prior, 1e-4)[0] > risk - 5e-3


def plain_rake(cells, targets, tolerance=1e-9):
    """cells: (source, lang, topic) → words; targets: exponents by axis."""
    total = sum(cells.values()) or 1
    w = {c: n / total for c, n in cells.items()}
    goal = []
    for axis, power in enumerate(targets):
        sums = collections.defaultdict(float)
        for c, x in w.items():
            sums[c[axis]] += x
        wish = {v: s**power if s else 0.0 for v, s in sums.items()}
        goal.append({v: x / (sum(wish.values()) or 1) for v, x in wish.items()})
    for _ in range(2000):
        for axis in range(3):
            have = collections.defaultdict(float)
            for c, x in w.items():
                have[c[axis]] += x
            w = {c: x * goal[axis][c[axis]] / have[c[axis]] if have[c[axis]] else 0.0 for c, x in w.items()}
    ratio = {c: w[c] / (cells[c] / total) if cells[c] else None for c in cells}
    most = max([r for r in ratio.values() if r is not None], default=1) or 1
    return {c: (w[c], 1.0 if r is None else r / most) for c, r in ratio.items()}


def test_mixing_equals_plain_raking(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)) + rng.choice(["", " | ", " {", " http"]), rng.choice(["en", "fr", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(300)]
    got = mixing.mixed(hostile(spark, rows).drop("topic"), rounds=400, tolerance=1e-9).collect()
    cells = collections.Counter()
    for r in got:
        cells[r.source, r.lang, r.topic] += r.n_words
    want = plain_rake(cells, (0.8, 0.8, 0.9))
    assert len(got) == len(rows) and len(cells) > 20
    for r in got:
        w, p = want[r.source, r.lang, r.topic]
        assert r.weight == pytest.approx(w, abs=1e-6) and r.probability == pytest.approx(p, abs=1e-5)
        drawn = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) / 2**32
        assert r.sampled == (drawn < r.probability)


def test_top_k_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (20, [1.0, 1.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])]
    got = impacts.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 2).orderBy("query_id", "rank").collect()
    # of the repeated id the smallest vector counts; of equal scores the smaller id comes first
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 3, 2048), (0, 4, 2048), (20, 3, 12288), (20, 4, 12288)]


def test_near_copies_keep_one_row_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, base, "en", "a"), (5, base + " end", "en", "a"), (5, other, "en", "a"), (6, base, "en", "a"), (6, base, "en", "a"), (None, base, "en", "a"), (7, "", "en", "a"), (8, None, "en", "a")]
    docs = hostile(spark, rows).select(*cp.COLUMNS)
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in cp.drop_near_copies(spark, docs, "").collect() if r.doc_id is not None)
    assert got == sorted([(False, 3, base), (False, 5, other), (False, 7, "")] + []) + [(False, 8, None)]


def test_pipeline_run(spark, sf_dir):
    """run() against a plain pipeline: the model's scores, plain links, plain repeats, plain raking."""
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs.select(*cp.COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    rows = docs.collect()
    score = model.scores(pa.array([r.text for r in rows]))
    clean = {r.doc_id: r for r, s in zip(rows, score) if s < 0.5}
    links = plain_links([(i, r.text) for i, r in clean.items()])
    near = {i: r for i, r in clean.items() if links[i][2]}
    cut = {i: v[2] for i, v in plain_repeats([(i, r.text) for i, r in near.items()]).items()}
    topic = {r.doc_id: r.topic for r in spark.createDataFrame(list(cut.items()), "doc_id long, text string").select("doc_id", mixing.form_of(F.col("text")).alias("topic")).collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in cut.items()}
    cells = collections.Counter()
    for i in cut:
        cells[near[i].source, near[i].lang, topic[i]] += size[i]
    odds = plain_rake(cells, (0.8, 0.8, 0.9))
    drawn = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) / 2**32
    chance = {i: odds[near[i].source, near[i].lang, topic[i]][1] for i in cut}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.ids for r in cp.run(spark, sf_dir).collect()}
    sure = {i for i in cut if drawn(i) < chance[i] - 1e-4}
    assert sure <= set(got) <= {i for i in cut if drawn(i) < chance[i] + 1e-4}
    assert all(got[i] == sp.encode(cut[i]) for i in got) and len(got) > 20


def test_large_components_keep_their_values(spark):
    """Scores beyond what 32 bits and what a double hold exactly."""
    rng = random.Random(31)
    for scale in (1_000_000_000 / 64, 2.0**22 + 0.5):
        rows = [(i, [float(rng.randint(-99, 99)) / 100 * scale for _ in range(4)]) for i in range(60)] + [(60, [scale] * 4), (61, [scale] * 3 + [scale + 1 / 64])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in impacts.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()}
        for q in (0, 20, 40, 60):
            want = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    wide = spark.createDataFrame([(0, [1 / 64]), (1, [3e9 / 64]), (2, [2e9 / 64]), (3, [-3e9 / 64])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in impacts.top_k(wide, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 3_000_000_000), (2, 2_000_000_000), (3, -3_000_000_000)]
    huge = spark.createDataFrame([(0, [3_000_000_000.0] * 4), (1, [3_000_000_000.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        impacts.top_k(huge, F.lit(True)).collect()


def test_what_stands_late_in_a_long_text_is_learnt(spark):
    """Samples are bounded in rows and bytes; the texts in them are read whole."""
    late = "filler " * 50000
    docs = spark.createDataFrame([(i, late + ("zxqj vbnk " * 200 if i % 2 else "meme noodle " * 200), "aa" if i % 2 else "bb") for i in range(8)] + [(20, None, "cc"), (21, "", "cc")], "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.langs == ["aa", "bb"]  # no text, no language
    new = spark.createDataFrame([(1, "zxqj vbnk zxqj"), (2, "noodle meme"), (3, "Жук")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.predict(new, model).collect()}
    assert got[1] == "aa" and got[2] == "bb" and got[3] in ("aa", "bb")
    bad = spark.createDataFrame([(i, late + ("grobnik " * 20 if i < 40 else ""), 0) for i in range(120)], "doc_id long, text string, n int")
    marks = spark.createDataFrame([(i, int(i < 40)) for i in range(120)], "doc_id long, toxic int")
    found = toxicity.score(bad, toxicity.fit(bad, marks, F.lit(True))).select("doc_id", "predicted").collect()
    assert {r.doc_id for r in found if r.predicted} == set(range(40))


def test_crowded_bands_keep_their_links(spark):
    """Hundreds of unlike texts around one passage share bands; chains of near copies among them
    are linked."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(50)])) for i in range(400)]
    long = [word() for _ in range(200)]
    for step in range(12):  # neighbours are linked, ends are not
        long = long[7:] + [word() for _ in range(7)]
        rows.append((5000 + step, " ".join(long)))
    rows += [(6000 + k, rows[k][1] + " " + word()) for k in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_links(rows)


def test_stages_on_hostile_tables(spark, odd, tmp_path):
    """Every stage on nulls, empty and long texts, repeated rows and clashing columns, and on nothing."""
    few = spark.createDataFrame([(i, 0, int(i == 20)) for i in range(20, 40)], "doc_id long, quality int, toxic int")
    labels(spark).filter("doc_id is null or doc_id = 22").unionByName(few).write.parquet(f"{tmp_path}/labels.parquet")
    docs, ids = hostile(spark, odd), collections.Counter(i for i, *_ in odd)
    outs = {name: stage(spark, docs, str(tmp_path)) for name, stage in cp.STAGES}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        if name != "sentencepiece":
            assert outs[name].columns == list(cp.COLUMNS), name
    assert collections.Counter(r.doc_id for r in outs["toxicity"].collect()) == ids
    near = collections.Counter(r.doc_id for r in outs["near_dedup"].collect())
    assert near[5] == 1 and not near[6] and not near[8] and near[None] == ids[None] and near[7] == 2 and near[1] == near[2] == near[3] == 1
    cut = outs["substring_dedup"].collect()
    assert collections.Counter(r.doc_id for r in cut) == ids and all(r.text is not None and r.n_chars == len(r.text) for r in cut)
    assert {r.text for r in cut if r.doc_id == 1} == {""}
    sampled = collections.Counter(r.doc_id for r in outs["mixing"].collect())
    assert sampled <= ids and (sampled[5] in (0, 2)) and sampled
    pieces_of = outs["sentencepiece"].collect()
    assert collections.Counter(r.doc_id for r in pieces_of) == ids and all(r.n_pieces == 0 for r in pieces_of if r.doc_id in (1, 2))
