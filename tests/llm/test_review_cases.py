"""Cases of the review: what an operator left out, compared with brute force."""

import numpy as np


def test_near_copies_with_repeated_and_null_ids(spark):
    import corpus_pipeline
    from polymix.llm import ngram_join

    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 100))
    a, b, c, d = (text() for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(5, a), (5, b), (3, near(b)), (None, c), (None, near(c)), (None, d), (9, near(d)), (9, a + " end"), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, 5, 80).collect()}
    assert got == {(5, 96, 5), (5, 96, 3), (3, 97, 3), (None, 96, None), (None, 97, None), (9, 97, None), (9, 97, 5), (4, 0, 4)}
    stay = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, df, "").collect()]
    assert len(stay) == 6
    assert {x for x in stay if x[0] is not None} == {(5, a), (3, near(b)), (4, None), (4, "")}
    assert sorted(t in (c, near(c)) for i, t in stay if i is None) == [False, True]
    assert (None, d) in stay


def test_pii_addresses_without_a_sign(spark):
    from polymix.llm import pii

    long = "anna.bea.carl.dora.emil.fritz.gerd.hans.ida.jan(at)site.org"
    texts = ["write to joe(at)site.org now", "or \"sue[at]list.com\".", "joe(at)site.org", "meet (at) noon", f"or {long} too", f"see {'x' * 300}(at)site.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.scan_pii(df).collect()}
    assert got == {0: "email:9:24", 1: "email:4:19", 2: "email:0:15", 3: "", 4: f"email:3:{3 + len(long)}", 5: "email:4:316"}
    masked = {r.doc_id: r.masked for r in pii.scan_pii(df, keep=("doc_id", "text")).collect()}
    assert masked[0] == "write to <EMAIL> now" and masked[1] == "or \"<EMAIL>\"."


def test_language_of_emoji(spark):
    from polymix.llm import langid

    known = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("die Katze sitzt auf der Matte", "de")] * 20)]
    docs = spark.createDataFrame([*known, (100, "\U0001F600\U0001F680 12 !!", None), (101, "\U0001F600 the cat", None), (102, "\U00020000\U00020001", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[100] == ("und", 0.0)
    assert got[101][0] == "en" and got[102][0] != "und"
    codes = langid.Grams().codes
    assert (codes("\U0001F600 the cat") == codes("! the cat")).all()


def test_pipeline_stages_keep_one_row_and_pass_unlabelled(spark):
    import corpus_pipeline

    rows = [(1, "x y"), (1, "x y"), (None, "a b"), (None, "a b"), (2, "c"), (3, "c"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, None, "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    passed = corpus_pipeline.language_id(spark, df, "")
    assert passed.count() == len(rows)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact(spark, passed, "").collect()), key=str)
    assert got == sorted([(1, "x y"), (None, "a b"), (3, "c"), (5, "")], key=str)


def test_parity_bitmaps_keep_every_link(spark):
    """No pair of sets that link is apart in more bits than the filter lets pass."""
    from polymix.llm.ngram_join import parity

    rng = np.random.default_rng(3)
    for n in (1, 7, 200, 3000):
        for _ in range(50):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            kept = a[rng.random(len(a)) < 0.95]
            b = np.union1d(kept, rng.integers(0, 1 << 63, n // 20).astype(np.uint64))
            apart = sum(int(x).bit_count() for x in (parity(a) ^ parity(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b))


def test_a_group_of_near_copies_is_not_paired_with_itself(spark, monkeypatch):
    """Copies with one to three changed words: few pairs are compared for each, whatever the size of the group, and no link is lost."""
    from polymix.llm import ngram_join

    compared, kept = [], ngram_join.saved

    def saved(df, what):
        out = kept(df, what)
        if what == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "saved", saved)
    rng = np.random.default_rng(11)
    first = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    texts = []
    for i in range(600):
        words = list(first)
        for at in rng.choice(150, 0 if i == 300 else rng.integers(1, 4), replace=False):
            words[at] = f"x{rng.integers(0, 1 << 40)}"
        texts.append(words)
    sets = [{tuple(w[k : k + 5]) for k in range(146)} for w in texts]
    label = list(range(600))
    for i in range(600):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, 5, 80).collect()}
    assert got == dict(enumerate(label))
    assert sum(compared) <= 6 * len(texts), compared
