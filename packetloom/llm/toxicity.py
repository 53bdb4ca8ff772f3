"""Toxicity by a noisy channel: suspicious strings are restored first, then the restored text is scored.

Restoring: a string with leetspeak, stretched letters or single spaced letters is a lattice of characters. Each sign
may stand for itself or for letters it imitates, separators between letters may drop out or end a word, repetitions may shrink to
one or two. Runs of single characters are restored together, whatever their gaps; so are chunks: short tokens that labelled clean documents
don't have, with a short neighbour on either side. Chunks that all are words of clean documents stay words. Viterbi takes the cheapest path under a character trigram model, learned from the words of the
labelled documents, plus the channel's costs.

Every token that the channel could turn into a word of the lexicon is decoded; what an outline of letters shows that it can't is not.

Scoring: the lexicon holds words and word beginnings that are far more frequent in toxic documents of the first half of
the labelled ones; it is counted in Spark. A document's features are the strongest evidence among its restored words, the sum of the
evidence, and its density. A logistic model of these, fitted on the second half, gives the score.

All labelled documents but held-out ones are learned from; counts and the steps of the logistic model are sums in Spark. Scores take nothing but the text.

Null and empty texts get the score of a text without evidence. Rows with null keys are scored, and never learned from. A key whose labels
contradict each other is not learned from; of several texts with one key the smallest is. Repeated rows get equal scores. A text of any length is scored whole.
Without labels of both kinds every score is 0. An empty table gives an empty table. A column of the table that has the score's name is replaced by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import batched
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import documents, slices, written
from packetloom.llm.language import held_out

#: What a word of the lexicon needs: toxic documents that have it, and the logarithm of its odds.
LEAST_TOXIC, LEAST_ODDS = 3, 1.5
THRESHOLD = 0.3
#: What words come to is kept up to so many bytes in each task; then the store is emptied.
KEPT_BYTES = 20 << 20
#: Words whose trigrams are counted at once.
GRAM_WORDS = 20_000
#: What an entry of the store takes beside its word.
ENTRY_BYTES = 120

# Signs and the letters that they imitate.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = " .-_*~'`,/\\"
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"

#: What makes a token suspicious while the lexicon is learned: a sign between or before letters; a letter three times or more; separators between letters.
SUSPECT = re.compile(r"[^\W\d_][0-9@$!|+(€£¡]+[^\W\d_]|^[0-9@$!|+(€£¡]+[^\W\d_]{2}|[^\W\d_]{2}[0-9@$!|€£]$|([^\W\d_])\1\1|[^\W\d_][.\-_*~][^\W\d_][.\-_*~][^\W\d_]")
#: Signs after a word that aren't restored.
ENDS = ".,;:?\"'"
#: Separators that may follow each of three or more single characters with white space between them.
SPACING = ".-_*~,/"
#: The longest token that counts as a chunk of a broken word. Words that are broken into longer pieces aren't joined.
CHUNK = 6
LETTER = re.compile(r"[^\W\d_]")
DOUBLED = re.compile(r"(.)\1")
TRIPLED = re.compile(r"(.)\1\1")

START, END = "\x02", "\x03"
#: Costs of letters that a channel keeps in each worker.
COSTS = 50_000
#: Letters by which the outlines of evidence are looked up.
HEAD = 4


@dataclass
class Deobfuscator:
    """A character trigram model and the channel's costs, in nats."""

    trigrams: dict[str, int] = field(default_factory=dict)
    bigrams: dict[str, int] = field(default_factory=dict)
    swap: float = 1.0
    drop: float = 0.5
    split: float = 0.5
    shrink: float = 0.3
    keep_sign: float = 3.0
    #: Words of clean documents, which are no chunks; without any there are no chunks.
    known: frozenset[str] = frozenset()

    #: Costs that were asked for, COSTS of them at most.
    costs: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def cost(self, before: str, c: str) -> float:
        found = self.costs.get(before + c)
        if found is None:
            if len(self.costs) >= COSTS:
                self.costs.clear()
            found = self.costs[before + c] = -math.log((self.trigrams.get(before + c, 0) + 0.05) / (self.bigrams.get(before, 0) + 2.0))
        return found

    def options(self, c: str) -> list[tuple[str, float]]:
        """What an observed character may have been, at which cost; an empty string drops it, a space ends the word."""
        out = [(c, 0.0)] if c.isalpha() else [(c, self.keep_sign)]
        out += [(x, self.swap) for x in LEET.get(c, "")]
        if c in SEPARATORS:
            out = [("", self.drop), (" ", self.split)]
        return out

    def restore(self, token: str) -> str:
        """The most likely letters behind a token."""
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(?s)(.)\1*", token.lower())]
        costs = self.costs
        # a path is its cost and a chain of (rest of the chain, last piece), so that long strings take time in proportion
        paths: dict[str, tuple[float, tuple]] = {START + START: (0.0, ())}
        for c, n in runs:
            later: dict[str, tuple[float, tuple]] = {}
            for x, cost in self.options(c):
                for times in {0} if not x else {1} if x == " " else {1, 2} if n > 2 else {n, 1}:
                    extra = cost * n + (self.shrink if times != n and x.strip() else 0.0)
                    for state, (total, chain) in paths.items():
                        s, t = state, total + extra
                        if x == " ":
                            if s == START + START:  # a word can't end before it starts
                                continue
                            t += self.cost(s, END)
                            s = START + START
                        for _ in range(times if x != " " else 0):
                            step = costs.get(s + x)
                            t += self.cost(s, x) if step is None else step
                            s = s[1] + x
                        if s not in later or t < later[s][0]:
                            later[s] = t, (chain, x * times) if x else chain
            paths = later
        ends = [(total + self.cost(s, END), chain) for s, (total, chain) in paths.items()]
        least = min(total for total, _ in ends)
        return min(unchained(chain) for total, chain in ends if total == least)

    @classmethod
    def learned(cls, words: dict[str, int]) -> Deobfuscator:
        return cls.counted(trigrams_of(words))

    @classmethod
    def counted(cls, trigrams: dict[str, int]) -> Deobfuscator:
        bi: Counter[str] = Counter()
        for x, n in trigrams.items():
            bi[x[:2]] += n
        return cls(dict(trigrams), dict(bi))


def trigrams_of(words: dict[str, int]) -> Counter[str]:
    """Characters of words, each with the two before it."""
    out: Counter[str] = Counter()
    for part in batched(words.items(), GRAM_WORDS):
        text = "".join([START + START + w + END for w, _ in part])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
        sizes = np.array([len(w) + 3 for w, _ in part])
        inner = np.ones(len(codes), bool)
        inner[np.concatenate([sizes.cumsum() - 1, sizes.cumsum() - 2])] = False  # what begins there isn't of one word
        grams = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[inner[:-2]]
        found, place = np.unique(grams, return_inverse=True)
        sums = np.zeros(len(found), "i8")
        np.add.at(sums, place, np.repeat(np.array([n for _, n in part], "i8"), sizes)[:-2][inner[:-2]])
        for g, n in zip(found.tolist(), sums.tolist()):
            out[chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)] += n
    return out


def unchained(chain: tuple) -> str:
    pieces = []
    while chain:
        chain, piece = chain
        pieces.append(piece)
    return "".join(reversed(pieces))


class Store(dict):
    """What words come to, and those that come to nothing of their own, bounded in bytes together."""

    def __init__(self) -> None:
        super().__init__()
        self.size = 0
        self.none: set[str] = set()

    def take(self, size: int) -> None:
        self.size += size
        if self.size > KEPT_BYTES:
            self.clear()
            self.none.clear()
            self.size = size

    def put(self, word: str, value: Any, more: int = 0) -> None:
        self.take(len(word) + ENTRY_BYTES + more)
        self[word] = value

    def put_none(self, words: list[str]) -> None:
        self.take(sum(map(len, words)) + ENTRY_BYTES * len(words))
        self.none.update(words)


def restored(text: str, channel: Deobfuscator, kept: Store | None = None) -> set[str]:
    """The distinct words of a text, lower-cased, without signs at their edges, obfuscated ones with what they stand for. Chunks aren't joined: evidence is learned from whole words."""
    kept = Store() if kept is None else kept
    words = words_of(text)
    rest = words - kept.none
    out = words - rest  # these stand for themselves only
    new = []
    for token in rest:
        plain = token.rstrip(ENDS)
        if plain in kept.none:
            out.add(plain)
        elif plain.isalpha() and not TRIPLED.search(plain):
            out.add(plain)
            new.append(plain)
        else:
            found = kept.get(token)
            if found is None:
                found = forms(token, channel)
                kept.put(token, found, sum(map(len, found)))
            out.update(found)
    kept.put_none(new)
    return out


def words_of(text: str, known: frozenset[str] = frozenset()) -> set[str]:
    """The distinct tokens of a text, and the runs of them that may be one word."""
    tokens = text.lower().split()
    found = set(tokens)
    single = {w for w in found if len(w) < 3 and (len(w) == 1 or w[1] in SPACING)}
    chunks = {w for w in found - known if len(w) <= CHUNK and w.strip(EDGE) not in known and LETTER.search(w)} if known else set()
    few = single | chunks
    places = [i for i, w in enumerate(tokens) if w in few] if few else []
    end = 0
    for i in places:
        if i >= end and tokens[i] in single:
            end = i + 1
            while end < len(tokens) and tokens[end] in single:
                end += 1
            if end - i > 2:
                found.add(" ".join(tokens[i:end]))
    end = 0
    for i in places:
        if i >= end and tokens[i] in chunks:
            end = i + 1
            while end < len(tokens) and tokens[end] in chunks:
                end += 1
            first = i - 1 if i and len(tokens[i - 1]) <= CHUNK else i
            last = end + 1 if end < len(tokens) and len(tokens[end]) <= CHUNK else end
            if last - first > 1:
                found.add(" ".join(tokens[first:last]))
    return found


def forms(token: str, channel: Deobfuscator, suspect: bool | None = None) -> list[str]:
    """The token without the signs at its edges, and the words that it is restored to if it is suspect."""
    plain = token.strip(EDGE)
    out = [plain] if plain else []
    if suspect if suspect is not None else SUSPECT.search(token) or " " in token:
        for x in {token.rstrip(ENDS), plain}:
            for back in channel.restore(x).split(" ") if x else ():
                back = back.strip(EDGE)
                if back and back not in out:
                    out.append(back)
    return out


#: Letters of the beginnings of words that are features.
BEGINNINGS = (4, 5, 6)


def marks(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings, marked by an asterisk."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if len(word) > 2 else []


#: What the channel may do to a character, undone; letters that share a sign are one.
OUTLINE = str.maketrans({**{k: v[0].replace("l", "i") for k, v in LEET.items()}, "l": "i", **dict.fromkeys(SEPARATORS, "")})

#: The same with a mark for what is dropped.
DROPPED = "\x00"
OUTLINE_KEPT = {k: DROPPED if not v else v for k, v in OUTLINE.items()}
REPEATED = re.compile(r"([^\n])\1+")


#: The same for bytes of UTF-8, where it goes faster, and signs of more bytes than one.
WIDE = [(chr(k), v) for k, v in OUTLINE.items() if k > 127]
NARROW = bytes(ord(OUTLINE.get(k) or chr(k)) if k < 128 else k for k in range(256))
SEPARATOR_BYTES = SEPARATORS.encode()


def plain_outline(low: str) -> str:
    """Lower-cased text with letters for signs and without separators; OUTLINE as a table."""
    for sign, letter in WIDE:
        low = low.replace(sign, letter)
    return REPEATED.sub(r"\1", low.encode("utf-8", "surrogatepass").translate(NARROW, SEPARATOR_BYTES).decode("utf-8", "surrogatepass"))


def outline(text: str) -> str:
    """The same for a string and for all that it may be restored to, so that an outline of a restored word is part of the string's."""
    return plain_outline(text.lower())


def outlined(words: set[str]) -> Iterable[tuple[str, str]]:
    """Words, which have no line ends, with their outlines, taken at once."""
    return zip(words, plain_outline("\n".join(words)).split("\n"))


def outline_and_starts(text: str) -> tuple[str, list[int]]:
    """The outline, and where in it a restored word may begin."""
    out: list[str] = []
    starts = {0}
    for c, plain in zip(text.lower(), text.lower().translate(OUTLINE_KEPT)):
        if plain != DROPPED and (not out or out[-1] != plain):
            out.append(plain)
        if not c.isalpha():
            # the next character starts a part of its own, or joins one that is the same
            starts.update((len(out), max(0, len(out) - 1)))
    return "".join(out), sorted(starts)


@dataclass
class ToxicModel:
    channel: Deobfuscator
    evidence: dict[str, float]
    weights: list[float]

    def __post_init__(self) -> None:
        #: The first letters of all evidence: most words don't begin so, and are none.
        self.stems = frozenset(m.removesuffix("*")[:4] for m in self.evidence)
        #: Outlines of evidence: longer ones by their first HEAD letters, and those that have no more.
        outlines = sorted({x for m in self.evidence if (x := outline(m.removesuffix("*")))})
        self.short = frozenset(x for x in outlines if len(x) <= HEAD)
        self.sizes = sorted({len(x) for x in self.short})
        self.outlines: dict[str, tuple[str, ...]] = {}
        for x in outlines:
            if len(x) > HEAD:
                self.outlines[x[:HEAD]] = (*self.outlines.get(x[:HEAD], ()), x)
        #: The first HEAD letters of all outlines.
        self.heads = self.short.union(self.outlines)

    def begins(self, x: str, i: int) -> bool:
        """Whether the outline of evidence stands at this place of another."""
        for n in self.sizes:
            if x[i : i + n] in self.short:
                return True
        for y in self.outlines.get(x[i : i + HEAD], ()):
            if x.startswith(y, i):
                return True
        return False

    def possible(self, token: str, x: str) -> bool:
        """Whether a token of this outline may come to evidence. What are letters begins at the start; of others, places are found with `hinted` if any fits."""
        if token.isalpha() or token.rstrip(ENDS).isalpha():
            return self.begins(x, 0)
        heads = self.heads
        for i in range(len(x)):
            if (x[i : i + 4] in heads or x[i : i + 3] in heads or x[i : i + 2] in heads or x[i] in heads) and self.begins(x, i):
                return True
        return False

    def hinted(self, run: str) -> bool:
        """Whether a token or a run of them may hold evidence once it is restored; most don't, and need no restoring. Words begin at its start or after what is no letter."""
        x, starts = (outline(run), [0]) if run.isalpha() else outline_and_starts(run)
        return any(self.begins(x, i) for i in starts)

    def strength(self, token: str) -> float:
        """The strongest evidence among the words that a token may stand for."""
        plain = token.strip(EDGE)
        if plain.isalpha() and token.rstrip(ENDS) == plain:  # the channel takes it without its last signs
            token = plain
        if token.isalpha() and not DOUBLED.search(token):  # the channel leaves it as it is
            words = [token]
        else:
            words = forms(token, self.channel, self.hinted(token))
        best, evidence = 0.0, self.evidence
        for f in words:
            if f[:4] in self.stems:
                for m in marks(f):
                    best = max(best, evidence.get(m, 0.0))
        return best

    def features(self, text: str, kept: Store) -> tuple[float, float, float]:
        words = words_of(text, self.channel.known)
        heads = self.heads
        found, none = [], []
        for w, x in outlined(words - kept.none):
            # by their first letters most words are none
            if x[:4] in heads or x[:3] in heads or x[:2] in heads or x[:1] in heads or not (w.isalpha() or w.rstrip(ENDS).isalpha()):
                e = kept.get(w)
                if e is None and self.possible(w, x) and (e := self.strength(w)):
                    kept.put(w, e)
                if e:
                    found.append(e)
                    continue
            none.append(w)
        kept.put_none(none)
        best, total = max(found, default=0.0), math.fsum(found)  # the order of words doesn't show
        return best, math.log1p(total), math.log1p(100 * total / (len(words) + 5))

    def score(self, features: tuple[float, float, float]) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Steps of a logistic model, and the change of a weight at which they end.
STEPS, STILL = 30, 1e-9


def logistic(points: DataFrame, decay: float = 1e-2) -> list[float]:
    """Weights of a logistic model of (a, b, c, toxic) by Newton's steps, the constant first. Each step sums up in Spark; a task returns one row."""
    w = np.zeros(4)

    def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
        grad, square = np.zeros(4), np.zeros((4, 4))
        for b in batches:
            x, y = np.stack([np.ones(len(b)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[:3])], axis=1), b.column(3).to_numpy(zero_copy_only=False)
            z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad += x.T @ (z - y)
            square += (x * (z * (1 - z))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([[*grad, *square.ravel()]], pa.list_(pa.float64()))], ["sums"])

    for _ in range(STEPS):
        rows = points.mapInArrow(lambda b, w=w.copy(): sums(b, w), "sums array<double>").select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(20)
        for r in rows:
            total[r["k"]] = r["v"]
        step = np.linalg.solve(total[4:].reshape(4, 4) + (decay + 1e-6) * np.eye(4), total[:4] + decay * w)
        w -= step
        if np.abs(step).max() < STILL:
            break
    return [round(float(v), 9) for v in w]  # the order of sums doesn't show


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", least_toxic: int = LEAST_TOXIC, least_odds: float = LEAST_ODDS) -> ToxicModel:
    """A model from labelled documents: `labels` has key and label, already without held-out rows."""
    known = labels.select(labels[key].cast("long").alias("key"), labels[label].cast("int").alias("toxic")).filter("key is not null and toxic in (0, 1)")
    known = known.groupBy("key").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    known = known.withColumn("half", F.pmod(F.xxhash64("key"), F.lit(2)))
    rows = docs.select(docs[key].cast("long").alias("key"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).join(known, "key")
    rows = rows.groupBy("key", "toxic", "half").agg(F.min("text").alias("text")).select("text", "toxic", "half")
    return fitted(written(rows, "labelled"), least_toxic, least_odds)


def fitted(rows: DataFrame, least_toxic: int, least_odds: float) -> ToxicModel:
    """A model from (text, toxic, half)."""

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trigrams of the distinct words of each document, under kind 0; short words of clean documents, under kind 1."""
        words: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = set(t.lower().split())
                found = set(filter(str.isalpha, tokens))
                found.update(p for w in tokens - found if (p := w.strip(EDGE)).isalpha())
                words[toxic].update(found)
        clean = {w: n for w, n in words[0].items() if len(w) <= CHUNK}
        words[0].update(words[1])
        for kind, count in enumerate((trigrams_of(words[0]), clean)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(count), kind, "i4")), pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["kind", "x", "n"])

    spellings = rows.select("text", "toxic").mapInArrow(spelt, "kind int, x string, n long").groupBy("kind", "x").agg(F.sum("n").alias("n"))
    # a word of one document only may be a chunk itself
    held = spellings.filter("kind = 0 or n > 1").collect()
    channel = Deobfuscator.counted({r["x"]: r["n"] for r in held if r["kind"] == 0})
    channel.known = frozenset(r["x"] for r in held if r["kind"])

    def counts_of(marks: list[str], clean: list[int], toxic: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["mark", "clean", "toxic"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Store()
        docs = [0, 0]
        # by the length of a beginning (0: whole words): documents that have it, and toxic ones
        count: dict[int, tuple[Counter[str], Counter[str]]] = {n: (Counter(), Counter()) for n in (0, *BEGINNINGS)}
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs[toxic] += 1
                words = {w for w in restored(t, channel, kept) if len(w) > 2}
                for n, (every, bad) in count.items():
                    found = {w[:n] for w in words if len(w) > n} if n else words
                    every.update(found)
                    if toxic:
                        bad.update(found)
        yield counts_of([""], [docs[0]], [docs[1]])
        for n, (every, bad) in count.items():
            toxic = [bad.get(x, 0) for x in every]
            yield counts_of([x + "*" for x in every] if n else list(every), [k - m for k, m in zip(every.values(), toxic)], toxic)

    counts = rows.filter("half = 0").select("text", "toxic").mapInArrow(counted, "mark string, clean long, toxic long").groupBy("mark").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.filter((F.col("mark") == "") | (F.col("toxic") >= least_toxic)).persist()
    try:
        docs = counts.filter("mark = ''").first()
        if not docs or not docs["clean"] or not docs["toxic"]:
            return ToxicModel(channel, {}, [])
        odds = F.log((F.col("toxic") + 0.5) / (docs["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / (docs["clean"] + 1.0))
        best = counts.filter("mark <> ''").withColumn("odds", odds).filter(F.col("odds") > least_odds)
        evidence = {r["mark"]: float(r["odds"]) for r in best.collect()}
    finally:
        counts.unpersist()
    model = ToxicModel(channel, evidence, [])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Store()
        for b in slices(batches):
            x = [model.features(t, kept) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in x], pa.float64()) for i in range(3)), b.column(1)], ["a", "b", "c", "toxic"])

    points = written(rows.filter("half = 1").select("text", "toxic").mapInArrow(measured, "a double, b double, c double, toxic int"), "points")
    if points.select("toxic").distinct().count() == 2:
        model.weights = logistic(points)
    return model


def score(df: DataFrame, model: ToxicModel, text: str = "text", name: str = "toxic_score") -> DataFrame:
    """`df` with each row's score."""
    names = [c for c in df.columns if c != name]
    inner = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)], df[text].cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Store()
        for b in slices(batches):
            scores = [model.score(model.features(t or "", kept)) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score_"])

    schema = ",".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields[:-1])), "score_ double"])
    return inner.mapInArrow(run, schema).toDF(*names, name)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicModel:
    """A model from the rows of labels.parquet that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learn(docs, labels.filter(~held_out(labels["doc_id"], 4, 2)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = score(docs.select("doc_id", held_out(docs["doc_id"], 4, 2).alias("held_out"), "text"), trained(spark, docs, sf_dir), name="score")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
