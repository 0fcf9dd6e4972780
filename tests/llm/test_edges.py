"""Cases that each operator must take: columns that clash with its own, rows that repeat, ids that are null, very long texts, brute force."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from polymix.llm import langid, line_dedup, ngram_join, packing, pieces, pii, secrets, token_files, topk
from pyspark.sql import functions as F

LONG = "\n".join(f"line {i} of a long text with secret: abcdefgh{i} in it" for i in range(30_000))
#: Names that operators use themselves.
CLASH = ("key", "n", "stays", "lang_pred", "score", "spans", "text_sha256", "whole", "base", "length", "piece", "rank", "line", "pos", "_text", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["one two three four five six", "one two three four five six", "one two three four five six seven", None, "", LONG, "tel +49 30 1234 5678 x", "a\nb\nc\na\nb\nc\nd"]
    rows = [(i, t, "en" if i % 2 else "de", "s", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "one two three four five six", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(3) for c in CLASH}).repartition(3)


@pytest.mark.parametrize(
    ("name", "make", "key"),
    [
        ("token_files", lambda spark, d: token_files.token_files(spark, d, P.path("word_bpe_49k.json"), False, 1), "ids_crc32"),
        ("secrets", lambda spark, d: secrets.scan_secrets(d), "base_sha256"),
        ("packing", lambda spark, d: packing.pack(d, P.path("byte_bpe_50k.json"), True, 0), "ids_crc32"),
        ("pii", lambda spark, d: pii.scan_pii(d), "base_sha256"),
        ("pieces", lambda spark, d: pieces.encode_pieces(d, P.path("piece_bpe_32k.model"), with_ids=False), "ids_sha256"),
        ("ngram_join", lambda spark, d: ngram_join.jaccard_components(d, width=3, percent=90), "n_shingles"),
        ("langid", lambda spark, d: langid.identify(d), "lang_pred"),
        ("line_dedup", lambda spark, d: line_dedup.line_dedup(d), None),
    ],
)
def test_rows_that_repeat_and_columns_that_clash(spark, docs, name, make, key):
    rows = make(spark, docs).collect()
    if name == "packing":
        rows = [r for r in rows if r.piece == 0]
    assert len(rows) == 12
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert sorted((k is None, len(v)) for k, v in by.items()) == sorted([(False, 1)] * 7 + [(False, 3), (True, 2)])
    if key:  # rows that repeat get the same
        assert len({r[key] for r in by[0]}) == 1 and by[0][0][key] == by[1][0][key]


def brute_secrets(text):
    kinds = [
        ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text, re.ASCII) if ok(m)]
    return [sum(x[1] == k for x in found) for k in range(3)], hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, n, b in sorted(found)).encode()).hexdigest()


def test_secrets_against_plain_patterns(spark):
    rng = np.random.default_rng(7)
    bits = ["password", "PassWd", "token", "api_key", "apikey", "secret", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "A1B2C3D4E5F6G7", "0123456789abcdef", "f" * 33, "\n", "é", "ſecret", "K", "-", "x."]
    texts = ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(1500)] + [None, "", LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in secrets.scan_secrets(df).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == brute_secrets(texts[r.doc_id] or ""), texts[r.doc_id]


def test_language_rows_that_are_learnt_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    # labels of rows that are held out, and of no row's own text, play no part
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))
    assert {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.identify(other).collect()} == {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in rows}


def test_top_k_with_clashing_columns(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "v", "qid", "q", "annulus", "score", "rank", "pivot", "dist")})
    whole = np.floor(1024 * v).astype(int)
    for r in topk.top_k(df, F.col("id") % 10 == 0, k=3).collect():
        scores = whole @ whole[r.query_id]
        order = [j for j in sorted(range(120), key=lambda j: (-scores[j], j)) if j != r.query_id]
        assert (r.vec_id, r.score) == (order[r.rank - 1], scores[order[r.rank - 1]])


def test_the_pipeline_against_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abeilmnorst"), rng.integers(3, 8)))
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("lang is not null and length(text) between 200 and 900").orderBy("doc_id").limit(60).collect()
    rows = [(i, r.text, r.lang, "s", len(r.text)) for i, r in enumerate(base)]
    whole = " ".join(word() for _ in range(80))
    rows += [(100, base[0].text, base[0].lang, "s", 1), (101, rows[1][1] + " " + word(), rows[1][2], "s", 1), (102, "123 456", "en", "s", 1), (103, None, None, None, None), (104, rows[2][1] + " write to joe.doe@site.org", rows[2][2], "s", 1), (105, whole, "en", "s", 1)]
    path = f"{tmp_path}/t"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path).collect()
    ids = {r.doc_id for r in got}
    # by hand: no letters or no text goes, of equal texts the largest id stays, of near copies one
    assert not ids & {102, 103} and not (0 in ids and 100 in ids) and (0 in ids or 100 in ids)
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    shingles = {i: {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for i, t, *_ in rows if t}
    kept = sorted(ids)
    for a in kept:
        for b in kept:
            assert a >= b or not shingles[a] or 10 * len(shingles[a] & shingles[b]) < 8 * len(shingles[a] | shingles[b])
    near = {i for i in shingles if any(j != i and 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j]) for j in shingles)}
    clean = {i for i in shingles if i not in near and i not in (102, 105)}
    assert clean <= ids
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
