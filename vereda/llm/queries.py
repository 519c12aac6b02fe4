"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, impacts, language, lattice, minhash, mixing, ngrams, pieces, repeats, store, syncmers, toxicity, variants
from .common import crc_mod, table


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_neighbours(table(spark, sf_dir, "documents"))


def op2_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    return language.predict(docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text"), model)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_content_addressed_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = store.new_path(spark)
    store.write(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"), path)
    return store.read_checksums(spark, path)


def op5_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op6_lm_bloom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = ngrams.scores(docs, crc_mod("doc_id", 7) != 2, share=None)
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mixed(docs).select("doc_id", "source", "lang", "topic", "n_words", "weight", "probability", "sampled")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encoded(docs, model or public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op10_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), model or public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_ppm_language_id": op2_ppm_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_content_addressed_ids": op4_content_addressed_ids,
    "op5_impact_top_k": op5_impact_top_k,
    "op6_lm_bloom_scores": op6_lm_bloom_scores,
    "op7_ipf_mixing": op7_ipf_mixing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_toxicity_nnpu": op10_toxicity_nnpu,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_lattice_near_dedup": op12_lattice_near_dedup,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS pos FROM w WHERE len(ws) >= 20),
        k AS (SELECT doc_id, pos, array_to_string(list_slice(ws, pos, pos + 19), ' ') AS win FROM p),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 19)) AS i FROM r WHERE n > 1),
        o AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
        s AS (SELECT o.doc_id, count(g.i) AS n_removed, string_agg(CASE WHEN g.i IS NULL THEN o.word END, ' ' ORDER BY o.i) AS kept
              FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.i = o.i GROUP BY o.doc_id)
        SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM w LEFT JOIN s ON s.doc_id = w.doc_id
    """,
    "op5_impact_top_k": """
        WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS d FROM embeddings),
        i AS (SELECT vec_id, d, floor(64 * x::DOUBLE)::BIGINT AS y FROM v),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.y * b.y)::BIGINT AS score FROM i a JOIN i b ON a.d = b.d AND a.vec_id <> b.vec_id
              WHERE a.vec_id % 20 = 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS pos FROM w WHERE len(ws) > 0),
        h AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, pos, pos + 4), ' ') AS sh FROM g),
        n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
        c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM h a JOIN h b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
        m AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
        SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept
        FROM m LEFT JOIN n ON n.doc_id = m.doc_id
    """,
    "op13_spelling_variants": r"""
        WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
        r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
        k AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
        b AS (SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bs FROM k),
        h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
        m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        w AS (SELECT word, sum(n)::BIGINT AS n FROM m GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
        d AS (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w),
        g AS (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM d),
        e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
              UNION SELECT g.word, w.word, w.n FROM g JOIN w ON w.word = g.head || g.tail
              UNION SELECT w.word, g.word, g.n FROM g JOIN w ON w.word = g.head || g.tail),
        s AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS top, max(other_n) AS top_n FROM e GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form, CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n FROM w LEFT JOIN s ON s.word = w.word),
        c AS (SELECT word, word AS stop, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON f.word = c.stop WHERE f.form IS NOT NULL),
        z AS (SELECT word, last(stop ORDER BY depth) AS root FROM c GROUP BY word)
        SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
    """,
    "op12_lattice_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL),
        u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS s FROM v),
        e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) >= 0.9 * a.s * b.s),
        r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
        m AS (SELECT u AS vec_id, min(v) AS component_id FROM r GROUP BY u),
        n AS (SELECT u AS vec_id, count(*) AS n FROM e GROUP BY u)
        SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n ON n.vec_id = m.vec_id
    """,
}
