"""Ties, held-out rows, contradictory labels, clashing names, very long texts, and brute force for what SQL can't express."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import hilbert, language, media, packing, pii, piececount, simhash, toxicity, urls, wordbpe

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = [("the quick brown fox's 42 jumps, " * 15_000)[:400_000], "x" * 150_000, "日本" * 60_000, "a-b " * 60_000]


def texts_of(spark, texts, **more):
    names = "".join(f", {k} string" for k in more)
    return spark.createDataFrame([(k, t, *more.values()) for k, t in enumerate(texts)], "doc_id long, text string" + names)


# Nearest neighbours


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(k, [1.0, float(k % 14 + 1), float(k // 14 + 1)]) for k in range(1, 201)] + [(7, [1.0, 8.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double").repartition(4)
    found = hilbert.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.rank, r.score) for r in found] == [(k, k, 1.0) for k in range(1, 21)]


def test_windows_go_on_across_ranges(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((1200, 16))
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    asked = F.col("vec_id") % 20 == 0
    found = [{(r.query_id, r.vec_id) for r in hilbert.nearest(df, asked, c=hilbert.Curves(window=100, curves=6, range_windows=n)).collect()} for n in (3, 1000)]
    assert len(found[1] & found[0]) == len(found[1]) == len(found[0])  # one range or many: the same windows
    wide = hilbert.nearest(df, asked, c=hilbert.Curves(window=1200, curves=1)).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    scores = v @ v.T
    for r in wide:
        assert set(r.ids) == set(sorted((k for k in range(1200) if k != r.query_id), key=lambda k: -scores[r.query_id, k])[:20])


# Language


def naive_phrases(text, sample):
    n = i = 0
    while i < len(text):
        size = 0
        while i + size < len(text) and text[i : i + size + 1] in sample:
            size += 1
        i += max(1, size)
        n += 1
    return n


def test_phrases_as_a_naive_parse():
    r = random.Random(2)
    flat = lambda x: "".join(c if language.LETTER.match(c) else "." for c in x)
    samples = {k: "".join(r.choice(a) for _ in range(400)) for k, a in (("a", "abc d"), ("b", "abcd e,"), ("z", "日本\U0001f600\U0001d4b3 x"))}
    texts = ["", "a", "abcab" * 40, "日本 x\U0001d4b3", *("".join(r.choice("abcdef ,日\U0001d4b3") for _ in range(r.randrange(200))) for _ in range(150)), "abc d" * 3000]
    parser = language.CrossParser(samples)
    for few in (0, 64, 10_000):
        language.FEW_LANES = few
        found, lengths = parser.phrases(texts)
        assert lengths.tolist() == [len(t) for t in texts]
        for k, label in enumerate(parser.labels):
            assert [int(x) for x in found[:, k]] == [naive_phrases(flat(t), flat(samples[label])) for t in texts]
    language.FEW_LANES = 64


def test_language_ties_and_names(spark):
    rows = texts_of(spark, ["aaa", "bbb", None], lang_pred="old", lang_score="old")
    out = language.identify(rows, {"y": "aaa", "x": "aaa"})
    assert sorted(out.columns) == ["doc_id", "lang_pred", "lang_score", "text"]
    assert [r.lang_pred for r in out.orderBy("doc_id").collect()] == ["x", "x", "und"]


def crc_rest(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_held_out_rows_are_never_learned_from(spark, tmp_path):
    en, de = "the man and the dog went home again ", "der mann und der hund gingen nach hause "
    rows = [(k, (en if k % 2 else de) * 3 + f"w{k}", ("en" if k % 2 else "de") if crc_rest(k, 3) != 1 else "secret", "s", 1) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, (k % 2) if crc_rest(k, 4) != 2 else 1 - k % 2) for k in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in language.op8_language(spark, str(tmp_path)).collect()}
    assert all(found[k].held_out == (crc_rest(k, 3) == 1) and found[k].lang_pred == ("en" if k % 2 else "de") for k in range(300))
    found = {r.doc_id: r for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()}
    assert all(found[k].held_out == (crc_rest(k, 4) == 2) and found[k].predicted == k % 2 for k in range(300))


def test_sample_is_bounded_over_all_labels(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 3001).cast("string"))).alias("lang"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    sample = language.labelled_sample(rows, "lang", "text", 6000, 100)
    assert sum(map(len, sample.values())) <= 6000 and len(sample) == 3002  # each label has a part, however many there are


# Toxicity


def toxic_rows(spark, n=600):
    bad, good = ["zorgish", "flumpy"], "this is a calm day and people walk in the park near the river".split()
    rng = np.random.default_rng(4)
    return spark.createDataFrame([(k, " ".join([*rng.choice(good, 12), *([rng.choice(bad)] if k % 2 else [])])) for k in range(n)], "doc_id long, text string")


def test_contradictory_labels_and_names(spark):
    rows = toxic_rows(spark)
    labels = [(k, k % 2) for k in range(600)]
    a = toxicity.learn(rows, spark.createDataFrame(labels + [(k, 1 - k % 2) for k in range(0, 600, 10)], "doc_id long, toxic int").repartition(5))
    b = toxicity.learn(rows, spark.createDataFrame([x for x in labels if x[0] % 10], "doc_id long, toxic int"))
    assert a.evidence == b.evidence and a.weights == b.weights
    out = toxicity.score(texts_of(spark, ["calm", "zorgish"], toxic_score="old"), a)
    assert out.columns == ["doc_id", "text", "toxic_score"] and [r.toxic_score > 0.5 for r in out.orderBy("doc_id").collect()] == [False, True]
    # copies of a document are one document of the sample
    c = toxicity.learn(rows.union(rows).union(rows), spark.createDataFrame([x for x in labels if x[0] % 10], "doc_id long, toxic int"))
    assert c.evidence == b.evidence


def test_every_label_is_learned_from(spark):
    n = 14_000
    rows = spark.range(n).selectExpr("id as doc_id", "concat(if(id % 4 = 0, 'zorgish', 'calm'), ' day') as text")
    labels = rows.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    toxic, clean = (labels.filter(f"pmod(xxhash64(doc_id), 2) = 0 and toxic = {k}").count() for k in (1, 0))
    model = toxicity.learn(rows, labels)
    assert toxic + clean > n * 0.45 and abs(model.evidence["zorgish"] - (np.log((toxic + 0.5) / (toxic + 1)) - np.log(0.5 / (clean + 1)))) < 1e-9
    points = [(float(k % 3), 0.0, k / 50, int(k % 7 < 3)) for k in range(60)]
    x, y = np.array([[1, *p[:3]] for p in points]), np.array([p[3] for p in points])
    weights = np.array(toxicity.logistic(spark.createDataFrame(points, "a double, b double, c double, toxic int").repartition(5)))
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ weights)) - y) + 1e-2 * weights).max() < 1e-5


def test_scores_as_brute_force(spark):
    model = toxicity.learn(toxic_rows(spark), spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int"))
    rng = np.random.default_rng(9)
    words = ["zorgish", "z0rgish", "zzorgiish", "calm", "river.", "fl-umpy", "f l u m p y", "(flumpy)", "ball", "4", "!zorg1sh", "x"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 5, 20) * 10]
    for text in texts:
        tokens = toxicity.words_of(text, model.channel.known)
        each = [max((model.evidence.get(m, 0.0) for f in toxicity.forms(w, model.channel, True) for m in toxicity.marks(f)), default=0.0) for w in tokens]  # everything is restored
        plain = [model.strength(w) for w in tokens]
        assert plain == each
        x = (max(each), math.log1p(sum(each)), math.log1p(100 * sum(each) / (len(tokens) + 5)))
        z = model.weights[0] + sum(w * f for w, f in zip(model.weights[1:], x))
        assert abs(model.score(model.features(text, toxicity.Store())) - 1 / (1 + math.exp(-z))) < 1e-12


def test_trigrams_of_the_whole_sample():
    words = Counter({"ab": 2, "abc": 1})
    assert toxicity.trigrams_of(words) == {"\x02\x02a": 3, "\x02ab": 3, "ab\x03": 2, "abc": 1, "bc\x03": 1}


def test_words_without_evidence_are_not_restored(monkeypatch):
    channel = toxicity.Deobfuscator.learned({"zorgish": 3, "river": 5, "ball": 4})
    channel.known = frozenset(["river", "ball", "calm", "zorgs", "flumpy"])
    model = toxicity.ToxicModel(channel, {"zorgish": 3.1, "zorg*": 2.3, "flumpy": 1.7}, [-1.0, 1.0, 0.0, 0.0])
    asked, strength = [], toxicity.ToxicModel.strength
    monkeypatch.setattr(toxicity.ToxicModel, "strength", lambda self, w: asked.append(w) or strength(self, w))
    kept = toxicity.Store()
    assert model.features("a calm river, ball; \"calm\" (river) 4.0 river*** x@y.org 12-34", kept) == (0.0, 0.0, 0.0) and asked == []
    words = ["z0rgish", "zoorgish,", "zorgs", "flumpy", "(flumpy)"]
    found = model.features(" ".join(words), kept)
    assert sorted(asked) == sorted(words) and found[0] == 3.1
    assert {model.features(" ".join(x), toxicity.Store()) for x in itertools.permutations(words)} == {found}  # whatever the order, to the last bit
    asked.clear()
    assert model.features(" ".join(words), kept) == found and asked == []


def test_runs_and_outlines_as_regular_expressions():
    rng = np.random.default_rng(5)
    spaced = re.compile(r"(?<!\S)\S[.\-_*~,/]?(?:\s+\S[.\-_*~,/]?){2,}(?!\S)")
    for _ in range(3000):
        text = "".join(rng.choice(list("ab.-* \t\n\x1c\x85²é€¡|lL4"), rng.integers(0, 25))).lower()
        words = set(text.split())
        assert toxicity.words_of(text) == words.union(" ".join(m[0].split()) for m in spaced.finditer(text))
        assert dict(toxicity.outlined(words)) == {w: re.sub(r"(?s)(.)\1+", r"\1", w.translate(toxicity.OUTLINE)) for w in words}


def test_trigrams_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "GRAM_WORDS", 3)
    words = {"": 4, "a": 1, "ab": 7, "añb": 2, "𝒜b𝒜": 3, "aaaa": 5, "b" * 40: 6, "ß": 1}
    count = Counter()
    for w, n in words.items():
        s = "\x02\x02" + w + "\x03"
        for i in range(len(s) - 2):
            count[s[i : i + 3]] += n
    assert toxicity.trigrams_of(words) == count and toxicity.trigrams_of({}) == {}


# Personal data


@pytest.mark.parametrize(("text", "found"), [("call 030 123 4567 89 now", "030 123 4567 89"), ("call 0049 30 1234 5678 now", "0049 30 1234 5678"), ("card 4111-1111-1111-1111 ok", "4111-1111-1111-1111"), ("ask bob.12 at verlu.org today", "bob.12 at verlu.org")])
def test_spans_are_not_cut_short(text, found):
    ((_, spans),) = pii.spans_of([text], pii.trained())
    assert [text[s:e] for s, e, _ in spans] == [found]


def test_the_gate_holds_all_that_the_check_takes():
    r = random.Random(5)
    for _ in range(3000):
        kind, text = pii.personal(r)
        if pii.plausible(kind, text):
            assert pii.TRIGGER.search(text), text
    for text in ("anton at verlu.com", "a at b . c", "a at b [dot] c", "a(at)b.c", "a AT b dot c"):
        assert pii.plausible("email", text) and pii.TRIGGER.search(text)


def test_held_out_figures_of_the_network():
    r, texts, gold = random.Random(99), [], []
    for _ in range(200):
        text, own = "", []
        while len(text) < 500:
            x = r.random()
            kind, part = pii.personal(r) if x < 0.1 else (None, pii.harmless(r) if x < 0.25 else pii.word(r))
            if kind:
                own.append((len(text), len(text) + len(part), kind))
            text += part + r.choice((" ", " ", ", ", ". ", "\n"))
        texts.append(text)
        gold.append(own)
    right = asked = added = 0
    for (base, spans), own in zip(pii.spans_of(texts, pii.trained()), gold):
        asked += len(set(own) - set(base))
        added += len(set(spans) - set(base))
        right += len((set(spans) & set(own)) - set(base))
    assert right / asked > 0.85 and right / added > 0.9


def test_viterbi_as_brute_force():
    import itertools

    net = pii.trained()
    em = np.random.default_rng(1).standard_normal((4, len(pii.TAGS))).astype("f4") * 3
    trans = net.p["trans"]
    best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=lambda p: sum(em[t, x] for t, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
    runs = [em[:1], em, np.vstack([em] * 50)]
    assert net.decode(runs)[1].tolist() == list(best) and [len(x) for x in net.decode(runs)] == [1, 4, 200]


# The others


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = texts_of(spark, LONG, key="k", ids="i", n_tokens="n", sequence_id="s", fp="f", row="r")
    ids = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4") for x in LONG]
    for r in wordbpe.encode_digest(rows, WORD).collect():
        assert r.ids_sha256 == hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest()
    packed = packing.pack(rows, WORD).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {k: len(x) + 1 for k, x in enumerate(ids)}
    assert {r.doc_id: r.n_tokens for r in piececount.count_tokens(rows, PIECE).collect()} == {k: len(sp.encode(x)) for k, x in enumerate(LONG)}
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.near_duplicates(rows).collect()}
    assert prints == {k: int(simhash.fingerprints_of([x])[0]) for k, x in enumerate(LONG)} and len(set(prints.values())) == len(LONG)
    assert language.identify(rows, {"en": "the quick brown fox " * 20, "de": "der schnelle braune fuchs " * 20}).filter("doc_id = 0").first().lang_pred == "en"
    assert toxicity.score(rows, toxicity.ToxicModel(toxicity.Deobfuscator.learned({"fox": 3}), {"quick": 2.0}, [-1.0, 1.0, 0.0, 0.0])).filter("toxic_score > 0.5").count() == 1
    assert pii.find(rows, pii.trained()).count() == len(LONG)


def test_ids_of_random_characters_as_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    r = random.Random(1)
    texts = ["it's we'll 'sthing don't''t 123 ½ x²y <|endoftext|>A<|startoftext|>", "a\x1cb\x1d <|endoftext|>", "ΣΑΣ İ ΆΣ" * 3]
    for _ in range(600):
        texts.append("".join(chr(x) for x in (r.randrange(0x110000) if r.random() < 0.3 else r.randrange(0x600) for _ in range(r.randrange(40))) if not 0xD800 <= x < 0xE000))
    for v in (wordbpe.WordBpe(WORD, 10_000), packing.Ids(WORD)):
        for text, ids in zip(texts, v.encode_all(texts)):
            want = t.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == want and v.decode(ids).decode() == t.decode(want, skip_special_tokens=False), repr(text)


def test_media_forms_and_features(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store_texts(texts_of(spark, ["abc", "é" * 90, ""], member="m"), path)
    for r in media.features(media.read_media(spark, path)).collect():
        n, payload = media.padded(["abc", "é" * 90, ""][r.doc_id])
        stored = media.wav(payload)
        assert (r.media_bytes, r.media_sha256, media.samples(stored)) == (len(stored), hashlib.sha256(stored).hexdigest(), payload)
        mean, rms = sum(payload) / len(payload), math.sqrt(sum((x - 128) ** 2 for x in payload) / len(payload))
        cross = sum((a >= 128) != (b >= 128) for a, b in zip(payload, payload[1:]))
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in Counter(payload).values())
        assert r.feature == f"n={len(payload)};mean={mean:.4f};rms={rms:.4f};cross={cross};entropy={entropy + 0.0:.4f}".replace("-0.0000", "0.0000") or r.feature.endswith("=-0.0000")


def test_attempts_leave_no_archives(tmp_path):
    (tmp_path / "m").mkdir()
    writer = media.ArchiveWriter({"path": f"file://{tmp_path}/m"})
    lost = writer.write(iter([("0_1_0.wav", b"x")]))
    kept = writer.write(iter([("1_1_1.wav", b"y")]))
    assert len(lost.names) == 1
    writer.commit([kept])
    assert [p.name for p in (tmp_path / "m").iterdir()] == kept.names


def test_urls_long_empty_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, "http://example.org/en/1" + "a" * 100_000, "x"), (2, "http://" + "h" * 50_000 + ".com/fr/", "x")], "page_id long, url string, verdict string")
    assert [(r.page_id, r.verdict) for r in urls.judge(rows).orderBy("page_id").collect()] == [(1, "block"), (2, "allow")]
    assert urls.judge(rows.limit(0)).count() == 0


# The stages of the pipeline


def test_stages_with_nulls_repeats_and_empty_tables(spark, tmp_path):
    good = "this is a calm day and people walk in the park near the river"
    rows = [(k, f"{good} w{k} v{k * 7} u{k * 13}", "en", "web", 5) for k in range(60)] + [(None, None, None, None, None), (None, good * 2, None, None, None), (1, f"{good} w1 v7 u13", "en", "web", 5), (2, "", "en", None, 0), (900, "mail a@b.org " + good[::-1], None, "x", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("toxic_score", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("key", F.lit(2))
    spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if name == "packing":
            assert kept.select("doc_id", "start").count() == len(rows)
            continue
        assert kept.columns == list(corpus_pipeline.COLUMNS)
        found = kept.collect()
        if name == "language":
            assert len(found) == len(rows) - 2  # a null and an empty text go
        if name == "personal_data":
            assert len(found) == len(rows) and [r.text for r in found if r.doc_id == 900][0].startswith("mail [EMAIL] ")
        if name == "near_copies":
            assert len([r for r in found if r.doc_id == 1]) == 1 and len({r.text or "" for r in found}) == len(found)


def test_language_stage_rejects_noise(spark):
    good = "this is a calm day and people walk in the park near the river "
    r = random.Random(3)
    noise = ["".join(r.choice("qxzjkvw") for _ in range(300)), "日本語のテキスト" * 20, "1234 +- " * 20, "a1b2c3d4" * 40]
    rows = [(k, good * 12 + f"w{k}", "en", "web", 5) for k in range(40)] + [(100 + k, t, None, "web", 5) for k, t in enumerate(noise)] + [(200, "q", None, "web", 1), (201, "日本", None, "web", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.drop_without_language(spark, docs, "").collect()}
    assert kept >= {*range(40), 200, 201} and not kept & {100, 101, 102}
