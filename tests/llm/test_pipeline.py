"""The pipeline on the smallest tables, and its place in the entry module."""

import numpy as np

import corpus_pipeline
from packetloom.llm import nearcopies, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = corpus_pipeline.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").count() == 0


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_near_copies_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "one two", "One  TWO", "one three"]
    for n in (60, 100, 250):
        for _ in range(12):
            base = list(rng.choice(words, n))
            texts.append(" ".join(base))
            for edits in range(1, 7):  # similarities on both sides of 0.8
                copy = base.copy()
                for at in rng.integers(0, n, edits * n // 150):
                    copy[at] = "other" + str(rng.integers(9))
                texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                least, most = sorted((root[i], root[j]))
                root = [least if r == most else r for r in root]
    rows = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, rows, SF).collect())
    assert kept() == sorted(set(root)) and len(set(root)) < 0.8 * len(texts)
    monkeypatch.setattr(nearcopies, "PART_SHINGLES", 300)  # buckets in several parts
    assert kept() == sorted(set(root))
    assert corpus_pipeline.drop_near_copies(spark, rows.limit(0), SF).count() == 0


def test_near_copies_come_from_fingerprints(spark):
    """Fingerprints within seven bits are one bucket, directly or by others, whatever MinHash finds."""
    base = 0x0123456789ABCDEF
    far = base ^ 0x0F0F0F0F0F0F0F0F
    fps = [base, base ^ 0x7F, base ^ 0x7F ^ (0x7F << 20), base, far, far ^ 1, 0x7777 << 40]
    df = spark.createDataFrame([(k, 9, x) for k, x in enumerate(fps)] + [(90, 0, base)], "print long, n long, fp long")
    found = {r["print"]: (r["band"], r["value"]) for r in nearcopies.fingerprint_places(df).collect()}
    groups = {}
    for k, place in found.items():
        groups.setdefault(place, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5], [6]] and {b for b, _ in found.values()} == {-1}


def test_language_stage_without_labels(spark):
    rows = spark.createDataFrame([(1, "a b", None, "w", 3), (2, "12 !", None, "w", 4), (3, None, None, "w", 0), (4, "日本", None, "w", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_without_language(spark, rows, SF).collect()) == [1, 4]


def test_near_copies_with_repeated_and_null_ids(spark):
    one, two, three = ("the same words " * 5 + "one", "of another text altogether " * 4 + "two", "something else that stays here " * 3)
    rows = [(1, one), (1, one), (2, one.upper()), (2, two), (None, two), (None, three), (None, three), (None, None), (None, None)]
    df = spark.createDataFrame([(k, t, None, "w", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    assert len(kept) == 4 and set(kept) == {(1, one), (2, two), (None, three), (None, None)}
