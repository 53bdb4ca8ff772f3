"""The operators of packetloom.llm against the libraries or brute force, with nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import hilbert, language, media, packing, pii, piececount, simhash, toxicity, urls, wordbpe

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "   ", "hello", "Hello  World!\tIt's 2024, isn't it?", "hello", "Übermäßige Straßenbäume", "x" * 5000, "naïve ﬁ ½ ΣΑΣ İ ✓ 日本語", "a<|endoftext|>b <|startoftext|>", "\x1c\x1d odd \x85 space   lines\n\n  two ",
    "the cat sat on the mat " * 900, "▁mark ▁▁ marks", "emoji 👩‍👩‍👧 \U0001f600\x00 nul", "é combining",
]
SCHEMA = "doc_id long, text string, key string, n_tokens int"


def docs(spark, texts=TEXTS):
    """Texts as rows with clashing extra columns; the last row has a null id and the one before repeats an id."""
    rows = [(k, t, "extra", 7) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (0, "again", None, None), (None, "no id", None, None)] if texts else [], SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.filter("doc_id > 0").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def test_word_bpe_as_the_library(spark, tokenizer):
    found = by_id(wordbpe.encode(docs(spark), WORD))
    for k, t in enumerate(TEXTS[1:], 1):
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert found[k]["ids"] == ids and found[k]["decoded"] == tokenizer.decode(ids, skip_special_tokens=False), repr(t)
    digest = by_id(wordbpe.encode_digest(docs(spark), WORD))
    assert digest[4]["ids_sha256"] == hashlib.sha256(np.array(found[4]["ids"], "<u4").tobytes()).hexdigest() and digest[4]["n_tokens"] == len(found[4]["ids"])
    assert wordbpe.encode(docs(spark), WORD).count() == len(TEXTS) + 2 and wordbpe.encode(docs(spark, []), WORD).count() == 0


def test_token_counts_as_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = by_id(piececount.count_tokens(docs(spark), PIECE, limit=100))
    for k, t in enumerate(TEXTS[1:], 1):
        n = len(sp.encode(t))
        assert (found[k]["n_tokens"], found[k]["n_bytes"], found[k]["over_limit"]) == (n, len(t.encode()), n > 100), repr(t)
    assert piececount.count_tokens(docs(spark, []), PIECE).count() == 0


def test_media_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store_texts(docs(spark), path)
    found = by_id(media.features(media.read_media(spark, path, rangeBytes="200")))
    for k, t in enumerate(TEXTS[1:], 1):
        raw = t.encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (found[k]["n_bytes"], found[k]["payload_bytes"], found[k]["payload_sha256"], found[k]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert found[3]["media_sha256"] == found[5]["media_sha256"] and found[3]["feature"] == found[5]["feature"]
    empty = f"file://{tmp_path}/none"
    media.store_texts(docs(spark, []), empty)
    assert media.read_media(spark, empty).count() == 0


def test_media_members_fail_alone(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    media.store_texts(docs(spark, ["one", "two" * 500]).coalesce(1), path)
    (file,) = (tmp_path / "m").glob("*.zip")
    raw = bytearray(file.read_bytes())
    raw[60] ^= 0xFF
    file.write_bytes(raw)
    rows = media.read_media(spark, path).collect()
    bad = [r for r in rows if r["error"]]
    assert len(rows) == 4 and len(bad) == 1 and bad[0]["attempts"] == 3 and bad[0]["media"] is None


def test_base_spans_and_mask(spark):
    text = "mail a.b@ex-ample.org, ip 10.0.0.1 or 10.0.0.999, card 4111 1111 1111 1111, tel +49 (30) 1234-5678."
    rows = docs(spark, [None, text, text, ""])
    found = by_id(pii.find(rows, pii.trained()))
    assert tuple(found[1])[:6] == (1, 1, 1, 1, 1, found[2]["base_sha256"]) or (found[1]["n_email"], found[1]["n_ip"], found[1]["n_card"], found[1]["n_phone"]) == (1, 1, 1, 1)
    said = [f"{k}:{text.index(x)}:{text.index(x) + len(x)}" for k, x in (("email", "a.b@ex-ample.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234-5678"))]
    assert found[1]["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(found[1]["spans"].split(","))
    assert found[3]["spans"] == ""
    hidden = by_id(pii.mask(rows, pii.trained()))
    assert "[EMAIL]" in hidden[1]["text"] and "4111" not in hidden[1]["text"] and hidden[3]["text"] == "" and hidden[1]["key"] == "extra"
    assert pii.find(docs(spark, []), pii.trained()).count() == 0


def test_pii_network_finds_written_out_forms():
    text = "Please write to anton_mi (at) verlu dot com for more about the schedule."
    (_, spans), *_ = pii.spans_of([text], pii.trained())
    assert [text[s:e] for s, e, k in spans if k == "email"] == ["anton_mi (at) verlu dot com"]


def test_base_spans_as_plain_patterns():
    rng = np.random.default_rng(3)
    bits = ["a", "B", ".", "@", "-", "_", " ", "1", "25", "300", "+", "(", "é", "a@b.c", "1.2.3.4", "x.y"]
    for n in (1, 3, 8, 30) * 100:
        text = "".join(rng.choice(bits, n))
        plain = sorted((m.start(), rank, m.end()) for rank, k in enumerate(pii.KINDS) for m in pii.COMPILED[k].finditer(text) if pii.holds(k, m[0]))
        assert pii.base_spans(text) == [(s, e, pii.KINDS[r]) for s, r, e in plain], text


@pytest.mark.parametrize("part", ["a", "1", "a@", "1.", "+1 ", "x dot ", "atdot"])
def test_base_spans_of_very_long_texts(part):
    text = part * 200_000
    assert pii.base_spans(f"{text} 10.0.0.1")[-1][2] in pii.KINDS
    assert pii.holds("ip", "0" * 9000 + "1.2.3.4") and not pii.plausible("email", "x at " + part * 5000 + "(")


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_as_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(["red", "Green", "blue", "sun", "moon", "tree"], 30)) for _ in range(25)]
    texts = [None, "", " \t", "one two", *base, *(t.replace("sun", "sun", 1) + " end" for t in base), *(t.upper() for t in base), *base]
    found = by_id(simhash.near_duplicates(docs(spark, texts)))
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, "again")]
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    for i, (k, _) in enumerate(rows):
        if k:
            assert found[k]["fp"] & (2**64 - 1) == prints[i]
            assert found[k]["component_id"] == min(rows[j][0] for j in range(len(rows)) if root[j] == root[i])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_links_of_random_prints(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 2**63, 60, dtype="u8")
    prints = np.unique(np.concatenate([seeds ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 60), dtype="u8")) for k in range(1, 7)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view("i8")], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    reach = near.copy()
    for _ in range(8):
        reach = reach @ reach
    for i, x in enumerate(prints.view("i8")):
        assert got.get(int(x), int(x)) == min(int(y) for y in prints.view("i8")[reach[i]])


def test_language(spark):
    sample = {"en": "the cat and the dog went out of the house with that old man " * 5, "de": "der hund und die katze gingen aus dem haus mit dem alten mann " * 5}
    rows = docs(spark, [None, "", "123 !?", "the man went out", "die alten katzen und der mann", "the man went out", "the dog and " * 4000])
    found = by_id(language.identify(rows, sample))
    assert [found[k]["lang_pred"] for k in range(1, 7)] == ["und", "und", "en", "de", "en", "en"] and found[1]["lang_score"] == 0 and 0.5 < found[3]["lang_score"] <= 1
    assert language.identify(docs(spark, []), sample).count() == 0
    assert {r["lang_pred"] for r in language.identify(rows, {}).collect()} == {"und"}


def test_language_sample_is_the_same_however_rows_lie(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 9 > 0, "b").alias("lang"), F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")).alias("text"))
    cut = language.labelled_sample(rows, "lang", "text", 12_000, 600)
    assert cut == language.labelled_sample(rows.repartition(7), "lang", "text", 12_000, 600) and set(cut) == {"a", "b"}


def test_toxicity(spark):
    bad, good = ["zorgish", "flumpy"], "this is a calm day and people walk in the park near the river".split()
    rng = np.random.default_rng(4)
    text = lambda toxic: " ".join([*rng.choice(good, 12), *([rng.choice(bad)] if toxic else [])])
    rows = spark.createDataFrame([(k, text(k % 2)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(rows, labels)
    asked = ["a calm zorgish day", "a calm z0rgish day", "a calm zooorgish day", "a calm z o r g i s h day", "a calm day", "", None]
    found = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert all(found[k] > 0.5 for k in range(4)) and all(found[k] < 0.3 for k in range(4, 7))
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = toxicity.learn(rows, labels.limit(0))
    assert {r["toxic_score"] for r in toxicity.score(docs(spark), none).collect()} == {0.0}


def test_toxic_words_in_pieces(spark):
    bad, good = ["zorgish", "flumpy", "gub"], "this is a calm day and people walk in the park near the river you are such".split()
    rng = np.random.default_rng(4)
    text = lambda toxic: " ".join([*rng.choice(good, 12), *([rng.choice(bad)] if toxic else [])])
    rows = spark.createDataFrame([(k, text(k % 2)) for k in range(600)], "doc_id long, text string")
    model = toxicity.learn(rows, spark.createDataFrame([(k, k % 2) for k in range(600)], "doc_id long, toxic int"))
    asked = ["you are a f l u m p y", "you are a f l u m p y a day", "such a g u b day", "such a g u b", "calm z  o  r   g i\ts  h day", "calm f. l. u. m. p. y. day", "you are flu mpy", "you are zo rgi sh, people", "such fl u mpy people"]
    clean = ["you are a calm day", "such a day in the park a a a", "a x b y", "people near rov er walk", "- - - a", ""]
    found = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(spark.createDataFrame(list(enumerate(asked + clean)), "doc_id long, text string"), model).collect()}
    assert [t for k, t in enumerate(asked) if found[k] < 0.5] == []
    assert [t for k, t in enumerate(clean, len(asked)) if found[k] >= 0.3] == []
    for run in ["a f l u m p y", "f|u (m) py", "f 1 u m m m p y", "gg ü b", "g u - b", "calm day", "z0 rg 1 sh"]:
        if any(m in model.evidence for w in toxicity.forms(run, model.channel) for m in toxicity.marks(w)):
            assert model.hinted(run), run
    assert {"a", "flumpy"} <= toxicity.restored("a f l u m p y", model.channel)


def test_restored_strings_are_the_cheapest():
    channel = toxicity.Deobfuscator.learned({"hello": 5, "ill": 3, "look": 4, "sell": 2})
    spelt = lambda path: sum(channel.cost(a + b, c) for a, b, c in zip(path, path[1:], path[2:]))

    def paths(runs):
        if not runs:
            yield "", 0.0
            return
        (c, n), *rest = runs
        for x, cost in channel.options(c):
            for times in {0} if not x else {1, 2} if n > 2 else {n, 1}:
                for tail, more in paths(rest):
                    yield x * times + tail, more + cost * n + (channel.shrink if times != n and x else 0.0)

    for token, runs in {"h3ll0": [*"h3", ("l", 2), "0"], "h.e.1.1.o": "h.e.1.1.o", "looook!": ["l", ("o", 4), *"k!"], "$3||": ["$", "3", ("|", 2)]}.items():
        found = [(cost + spelt(toxicity.START * 2 + text + toxicity.END), text) for text, cost in paths([x if len(x) == 2 else (x, 1) for x in runs])]
        best = channel.restore(token)
        assert min(cost for cost, text in found if text == best) <= min(found)[0] + 1e-9, token
    assert set(channel.restore("h3l" * 60_000)) <= set("hel")


def test_urls_as_regular_expressions():
    import re

    globs = ["*.example.org\n/en/1**", "**\n**.exe", "*.a*b\n/", "**" + "x" * 70 + "**"]
    texts = [".example.org\n/en/12", ".sub.example.org\n/en/1", ".example.org\n/fr", ".q\n/a.exe", ".q\n/a.exe/b", ".acb\n/", ".\n", "", "." + "x" * 71 + "\n/"]
    as_re = lambda g: re.compile("".join("(?s:.*)" if t == "**" else "[^\n]*" if t == "*" else re.escape(t) for t in re.findall(r"\*\*|\*|(?s:.)", g)))
    assert urls.WildcardAutomaton(globs).matches(texts).tolist() == [[bool(as_re(g).fullmatch(t)) for g in globs] for t in texts]


def test_url_rules(spark):
    rows = [(1, "https://WWW.Example.org/en/1?x"), (2, "https://example.org/es/a"), (3, "https://a.b.org"), (4, "http://x.com/de/1#f"), (5, "http://spammy.net/"), (6, None), (7, "no scheme"), (8, "http://notexample.org/es/"), (8, "http://notexample.org/es/")]
    found = sorted(tuple(r) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).fillna("").collect())
    assert [(x[0], x[3], x[4]) for x in found] == [(1, "example.org/en/1", "block"), (2, "example.org/es/", "block"), (3, "", "allow"), (4, "com/de/", "block"), (5, "", "block"), (6, "", "allow"), (7, "", "allow"), (8, "org/", "allow"), (8, "org/", "allow")]


def test_packing(spark, tokenizer):
    found = packing.pack(docs(spark), WORD, capacity=64).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(TEXTS[1:], 1):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))] and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in own)
    filled = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(filled) <= -(-sum(r["length"] for r in found) // 64) + 1
    assert packing.pack(docs(spark, []), WORD).count() == 0


@pytest.mark.parametrize("counts", [{}, {1: 1}, {64: 3}, {40: 10, 24: 10}, {33: 5}, {k: k % 7 for k in range(1, 65)}])
def test_shortest_pack_first_keeps_all(counts):
    patterns = packing.shortest_pack_first(counts, 64)
    placed = {}
    for lengths, n in patterns:
        assert sum(lengths) <= 64
        for x in lengths:
            placed[x] = placed.get(x, 0) + n
    assert placed == {k: n for k, n in counts.items() if n}


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((1500, 24)).astype("f4")
    v[100:110] = v[100]
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [1.0]), (None, [1.0] * 24), (2004, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in hilbert.nearest(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append(r)
    scores = v.astype("f8") @ v.astype("f8").T
    right = 0
    for q in range(0, 1500, 20):
        own = sorted(found[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r["score"] - scores[q, r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        right += len({r["vec_id"] for r in own} & {int(k) for k in sorted((k for k in range(1500) if k != q), key=lambda k: (-scores[q, k], k))[:20]})
    assert right / (75 * 20) >= 0.9 and set(found) == set(range(0, 1500, 20))
    assert hilbert.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_with_a_ragged_vector_first(spark):
    df = spark.createDataFrame([(0, [1.0])] + [(k, [1.0, float(k), 2.0]) for k in range(1, 400)], "vec_id long, embedding array<float>")
    found = hilbert.nearest(df, F.col("vec_id") % 200 == 0, k=3).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(200, n) for n in (1, 2, 3)]
