"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, empty tables, long texts, clashing names, deep and hot groups."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from packetloom.llm import hardnegatives, oneperm, prefixtrie
from packetloom.operators import joins

# Document fingerprints


def hashed(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else int(p).to_bytes(8, "little", signed=True), h)
    return h


def bins_of(text):
    words = [w.lower() for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return None
    found = {hashed(*(w.encode() for w in words[k : k + 5])) for k in range(len(words) - 4)} if len(words) >= 5 else {chain(words)}
    least = {}
    for h in found:
        least[h >> 56] = min(h, least.get(h >> 56, h))
    return least


def chain(words):
    h = 42
    for w in words:
        h = hashed((h - (1 << 64)) if h >= 1 << 63 else h, w.encode())
    return h


def densified(least):
    tables = oneperm.probes(256)
    out = []
    for i in range(256):
        b = next((b for b in (i, *(t[i] for t in tables)) if b in least), None)
        if b is None:
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            b = min((signed((hashed(i32(i), j) & ~255) | j), j) for j in least)[1]
        out.append(least[b] & 255)
    return out


def i32(i):
    return int(i).to_bytes(4, "little", signed=True)


def shown(text):
    least = bins_of(text)
    if least is None:
        return ""
    d = densified(least)
    return "".join(f"{sum(d[k + j] << 8 * j for j in range(8)):016x}" for k in range(0, 256, 8))


def near(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 512, 2)) / 256
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"wörd{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (1, 4, 5, 6, 40, 300, 3000, 30_000)]
    rows = [(k * 3 - 5, t) for k, t in enumerate([*texts, "", None, "  \n ", "Ab", "x", "😀é" * 9, texts[5], texts[5]])]
    rows += [(100, texts[4]), (100, texts[4]), (100, texts[3]), (None, "no id here at all"), (None, None)]
    rng.shuffle(rows)
    spark.createDataFrame([(*r, "x", 1.0, "k") for r in rows], "doc_id long, text string, fingerprint string, n_chars double, id string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    found = oneperm.op11_fingerprints(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    unsigned = lambda t, *seeds: [hashed(*s, t.encode()) for s in ((), (i32(1),))]
    key = lambda r: (r[0] is not None, r[0] or 0, *((x - (1 << 64) if x >= 1 << 63 else x) for x in unsigned(r[1])))
    order = sorted(((k, t or "") for k, t in rows), key=key)
    want = []
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, g, h = shown(t), shown(edited), shown(after)
        want.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, round(near(f, g), 9), round(near(f, h), 9)))
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in found), key=repr) == sorted(want, key=repr)


def test_likeness_is_near_the_similarity_of_shingles(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    rows, want = [], []
    for n in (12, 60, 400, 2000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            a = rng.choices(words, k=n)
            cut = int(n * share)
            b = a[:cut] + rng.choices(words, k=n - cut)
            sets = [{tuple(x[k : k + 5]) for k in range(n - 4)} for x in (a, b)]
            rows.append((len(rows), " ".join(a), " ".join(b)))
            want.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    both = oneperm.fingerprints(oneperm.fingerprints(df, "a", "fa"), "b", "fb")
    off = [abs(r.s - want[r.k]) for r in both.select("k", oneperm.likeness(F.col("fa"), F.col("fb")).alias("s")).collect()]
    assert max(off) < 0.15 and sum(off) / len(off) < 0.04


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert oneperm.op11_fingerprints(spark, str(tmp_path)).count() == 0


# Hard negatives


def mined(rows, m, is_anchor, label):
    whole = {}
    for k, v, c in rows:
        if k is None or c is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole[k, label(k, c), tuple(math.floor(256 * x) for x in v)] = None
    size = max(((sum(len(v) == n for _, _, v in whole), -n) for n in {len(v) for _, _, v in whole}), default=(0, 0))[1] * -1
    whole = [x for x in whole if len(x[2]) == size]
    out = []
    for a, own, v in whole:
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), k, c) for k, c, w in whole if k != a)
        for s, p, c in [x for x in scores if x[2] == own][: m.positives]:
            fits = [x for x in scores if x[2] != own and m.least * -s <= 100 * -x[0] <= m.most * -s][: m.negatives]
            out += [(a, p, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_as_brute_force(spark, small):
    rng = np.random.default_rng(6)
    rows = [(k, rng.standard_normal(12).astype("f4").tolist(), int(rng.integers(0, 4)) if k % 3 else 1) for k in range(600)]
    copy = rows[9][1]
    rows += [(1000 + k, copy, k % 4) for k in range(150)]  # a third of the copies of one vector
    rows += [(2000, [0.0] * 12, 1), (2050, [0.0] * 12, 2), (2100, None, 1), (2150, copy, None), (None, copy, 1), (2200, [*copy[:11], None], 1), (2250, [*copy[:11], float("nan")], 1), (2300, [*copy[:11], float("inf")], 1), (2350, copy[:5], 1), (2400, [], 1), (2450, [1e30] * 12, 1)]
    rows += rows[:20]
    m = hardnegatives.Mining(anchor_numbers=12 * 5, row_numbers=12 * 40, pairs=500) if small else hardnegatives.Mining()
    df = spark.createDataFrame([(*r, 1.0, 7) for r in rows], "vec_id long, embedding array<float>, label int, rank double, id int").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardnegatives.hard_negatives(df, F.col("vec_id") % 50 == 0, m, label=label).drop("anchor_row")
    want = mined([r for r in rows if r[0] != 2450], m, lambda k: k % 50 == 0, lambda k, c: (c + 1) % 10 if k % 7 == 0 else c)
    assert sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == want and len(want) > 60


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardnegatives.hard_negatives(df, F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(9)
    v, a = rng.integers(-300, 300, (200, 24)), rng.integers(-300, 300, (30, 24))
    v[:, :3] *= 20
    axes = np.linalg.eigh((v.T @ v).astype("f8"))[1][:, ::-1]
    exact, looks, last = a @ v.T, 0, None
    walk = hardnegatives.Bounds(axes, v).closer(a)
    score, off = next(walk)
    while True:
        looks += 1
        assert (np.abs(score - exact) <= off).all()
        last = off.max()
        try:
            score, off = walk.send(np.ones(exact.shape, bool))
        except StopIteration:
            break
    assert looks == 4 and last < 1


# Conversation tries


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    total, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        own = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        total[node], leaves[node] = own + sum(total[x] for x in below), sum(leaves[x] for x in below) or 1
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], total[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def conversations():
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for turn in range(rng.choice([0, 1, 2, 4, 8, 12])):
            rows.append((c, turn, rng.choice(["user", None, "a"]), rng.choice(["hi", "yes", None, "ü" * 5, "no"])))
    # equal and nearly equal conversations of many turns, one with a third of all turns, ties, repeated rows, nulls
    for c in (200, 205, 210, 215):
        rows += [(c, t, "u", "same") for t in range(90)]
    rows += [(215, 95, "u", "but for the last")]
    rows += [(300, t, "u", f"long {t % 7}") for t in range(400)]
    rows += [(400, 1, "u", "tie"), (400, 1, "a", "tie"), (400, None, "u", "first"), (400, 1, "u", "tie"), (None, 1, "u", "nobody"), (405, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_trie_as_brute_force(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(joins, "HOT_ROWS", 3)
        monkeypatch.setattr(prefixtrie, "PIECE", 16)
        monkeypatch.setattr(prefixtrie, "PART_BYTES", 10)
    rows = conversations()
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, n int").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = prefixtrie.op13_prefix_trie(spark, str(tmp_path))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == brute_trie(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "x")], [(7, None, None, None)], [(5, 1, "u", "a"), (5, 1, "u", "a")], [(3, 1, "u", "x"), (9, 0, "u", "x")]])
def test_small_tries(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = prefixtrie.trie(*prefixtrie.rebuilt(prefixtrie.turns(df)))
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rebuilt(rows))
