"""Alignment of two tokenizers against the libraries and plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, decoders

from vereda.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return dict(zip([chr(b) for b in shown] + [chr(256 + i) for i in range(len(rest))], shown + rest))


def plain(rows):
    t, m, byte = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_of()
    t.encode_special_tokens = True
    made = []
    for i, text in rows:
        want = b" " + (text or "").encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = m.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in t.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(m.id_to_piece(x)[3:5], 16)]) if m.is_byte(x) else m.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        links, groups = [], []
        x = y = 0
        if a:
            ga, gb = [a[0]], [b[0]]
            while True:
                links.append((a[x], b[y]))
                ea, eb = ends_a[x], ends_b[y]
                if ea == eb:
                    groups.append((ga, gb))
                    x, y = x + 1, y + 1
                    if x == len(a):
                        break
                    ga, gb = [a[x]], [b[y]]
                elif ea < eb:
                    x += 1
                    ga.append(a[x])
                else:
                    y += 1
                    gb.append(b[y])
        made.append((i, a, b, groups, links))
    n = Counter(k for *_, links in made for k in links)
    top = Counter()
    for (_, b), k in n.items():
        top[b] = max(top[b], k)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g).encode()).hexdigest() if g else ""
    return sorted(((-1 if i is None else i, len(a), len(b), len(g), len(k), sum(n[p] == top[p[1]] for p in k), sum(n[p] for p in k), digest(g)) for i, a, b, g, k in made)), n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["don't", "naïve", "résumé", "  two", "x" * 30, "日本語", "🙂", "é", "12345", "\n\n", "\t", "<s>", "<0x41>", "<|endoftext|>", "the", "of", "alignment", "Überfahrt", " ", "a​b"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "", "  ", "\n"]) for _ in range(n))
    out = [(0, None), (1, ""), (2, " "), (3, "a"), (3, "a"), (4, "has ▁ inside"), (None, "null id"), (5, "▁"), (6, " lead and trail "), (7, "<|endoftext|> and </s>"), (8, "the of " * 30000 + "y" * 5000)]
    return out + [(i, text(rng.randint(1, 60))) for i in range(10, 60)]


SCHEMA = "doc_id long, text string, row string, pair string, pairs string, n string"


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    out, pairs = alignment.align_tokenizers(docs, BYTES, PIECES)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()), pairs


def test_equals_plain_version(spark, rows, monkeypatch):
    want, n = plain(rows)
    got, pairs = run(spark, rows)
    assert got == want
    table = {(r.a, r.b): r for r in pairs.collect()}
    assert {k: r.n for k, r in table.items()} == dict(n)
    assert all(r.best_of_a == (r.n == max(k for (a, _), k in n.items() if a == r.a)) for r in table.values())
    assert all(g[4] == g[1] + g[2] - g[3] for g in got)
    # the same through the shuffled join alone, and with the smallest slices
    monkeypatch.setattr(alignment, "FREQUENT", 3)
    monkeypatch.setattr(alignment, "SLICE", 50)
    monkeypatch.setattr(alignment, "HELD", 16)
    assert run(spark, rows)[0] == want


def test_empty_table_and_texts(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, None), (2, "")])[0] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_token_bytes_decode_as_the_libraries_do(rows):
    t, a, b = Tokenizer.from_file(BYTES), alignment.Vocabulary.of_bytes(BYTES), alignment.Vocabulary.of_pieces(PIECES)
    t.encode_special_tokens, t.decoder = True, decoders.ByteLevel()
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _, text in rows:
        if text and "▁" not in text:
            assert a.bytes_of(np.array(t.encode(text).ids)).tobytes() == text.encode()
            assert b.bytes_of(np.array(m.encode(text))).tobytes() == b" " + text.encode()
