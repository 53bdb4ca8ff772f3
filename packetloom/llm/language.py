"""Language identification by cross-parsing entropy.

Labelled text of each language is indexed by a suffix automaton. A text is parsed against it into phrases, each the longest
match with the labelled text from where the last one ended; the fewer phrases a character, the closer the language. The
language that needs the fewest normalised phrases wins; ties go to the smaller name.

All transitions lie in one table, a place for each. All texts of a batch and all languages take each step
together; a text is parsed from its first to its last character without a restart. When only a few long texts are left they are
walked one by one.

The labelled text is a bounded sample, chosen in Spark by a hash of the text: `total_chars` characters in all, which languages share equally, of `doc_chars`
at most from one document. With more languages each has less text; `total_chars` can be raised. Every letter of the sample is a symbol of its own, all that
is no letter is one, and a letter that the sample lacks is a phrase. Predictions take nothing but the text.

A null text, or one without letters, is `und` with score 0. Of languages that need equally few phrases the smaller name is taken. Repeated rows give
equal rows. An empty table gives an empty table. Without any labelled text everything is `und`. A column of the table that has the name of a
result is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import documents, loaded, slices, written

UNKNOWN = "und"
#: Bounds of the labelled sample, in characters.
TOTAL_CHARS = 120_000
DOC_CHARS = 600
#: Texts of a batch that are parsed together, in characters.
BATCH_CHARS = 4_000_000
#: So few lanes are walked one by one.
FEW_LANES = 64
LETTER = re.compile(r"[^\W\d_]")
LETTERS = re.compile(r"[^\W\d_]+")
LOW = 2**32 - 1


def held_out(key: Column, divisor: int, remainder: int) -> Column:
    """Whether crc32 of the key as text has this remainder; false for null keys."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % divisor == remainder, F.lit(False))


def labelled_sample(df: DataFrame, label: str, text: str, total_chars: int = TOTAL_CHARS, doc_chars: int = DOC_CHARS) -> dict[str, str]:
    """Labelled text by language, within the bounds; 8 * total_chars / doc_chars texts at most come to the driver, and one more of each language.

    Each language has the text of its smallest hash. Another text is taken if its hash lies below its language's cut, which the number of the language's texts gives, so that about
    equally many of each are taken and no language's rows meet in one task. Languages share total_chars; more of them than that is an error.
    """
    most = max(1, 4 * total_chars // doc_chars)
    rows = df.select(df[label].cast("string").alias("label"), df[text].cast("string").alias("text")).filter("label is not null and length(text) > 0")
    rows = rows.withColumn("order", F.xxhash64("text"))
    first = F.min(F.struct("order", F.substring("text", 1, doc_chars).alias("text"))).alias("first")
    counts = written(rows.groupBy("label").agg(F.approx_count_distinct("order", 0.02).alias("n"), first), "labels")
    labels = counts.count()
    if labels > total_chars:
        raise ValueError(f"{labels} languages can't share {total_chars} characters of labelled text: raise total_chars")
    share = total_chars // max(1, labels)
    found = {r["label"]: {r["order"]: r["text"]} for r in counts.select("label", "first.order", F.substring("first.text", 1, share).alias("text")).collect()}
    each = max(1, most // max(1, labels))
    # twice the range of a hash is 2**64; a label's cut lies at the share of its texts that is wanted
    cuts = counts.select(F.col("label").alias("of"), (F.lit(each) / F.col("n") * F.lit(2.0**64) - F.lit(2.0**63)).alias("cut"))
    chosen = rows.join(cuts, F.col("label") == F.col("of")).filter(F.col("order").cast("double") <= F.col("cut"))
    chosen = chosen.groupBy("label", "order").agg(F.min(F.substring("text", 1, doc_chars)).alias("text"))
    for r in chosen.orderBy("order", "label").limit(2 * most).collect():
        found[r["label"]][r["order"]] = r["text"]
    return {k: "\n".join(t for _, t in sorted(v.items())).lower()[:share] for k, v in sorted(found.items())}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state of the suffix automaton of a sequence; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def spread_out(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the states, and a table that has at (number + symbol) the state's number and the next one's, in its upper and lower half.

    States draw numbers until no two transitions share a place, those with many transitions first.
    """
    size = np.array([len(m) for m in moves], "i8")
    ends = np.cumsum(size)
    symbols, to = np.array([c for m in moves for c in m], "i8"), np.array([t for m in moves for t in m.values()], "i8")
    room = 4 * len(to) + 2 * len(moves) + width
    taken, used, numbers = np.zeros(room + width, bool), np.zeros(room, bool), np.full(len(moves), -1, "i8")
    rng = np.random.default_rng(3)
    for least in (64, 16, 4, 0):
        left = np.flatnonzero((size >= least) & (numbers < 0))
        left = left[np.argsort(-size[left], kind="stable")]
        while len(left):
            drawn = rng.integers(0, room, len(left))
            n = size[left]
            of = np.repeat(np.arange(len(left)), n)
            place = drawn[of] + symbols[np.repeat(ends[left] - np.cumsum(n), n) + np.arange(n.sum())]
            good = ~used[drawn]
            good[np.setdiff1d(np.arange(len(left)), np.unique(drawn, return_index=True)[1])] = False
            clash = taken[place]
            clash[np.setdiff1d(np.arange(len(place)), np.unique(place, return_index=True)[1])] = True
            good[of[clash]] = False
            used[drawn[good]] = True
            taken[place[good[of]]] = True
            numbers[left[good]] = drawn[good]
            left = left[~good]
    table = np.full(room + width, -1 << 32, "i8")
    own = np.repeat(numbers, size)
    table[own + symbols] = own << 32 | numbers[to]
    return numbers, table


class CrossParser:
    """Suffix automata of `texts` by language as one table of transitions. Symbols: 0 no letter, 1 a letter that no text has, then the letters."""

    def __init__(self, texts: dict[str, str]):
        self.labels = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t if LETTER.match(c)})
        self.width = len(letters) + 2
        self.symbols = np.zeros(0x110000, "u2" if self.width < 1 << 16 else "u4")
        for m in LETTERS.finditer("".join(map(chr, [*range(0xD800), *([0] * 0x800), *range(0xE000, 0x110000)]))):
            self.symbols[m.start() : m.end()] = 1
        for k, c in enumerate(letters):
            self.symbols[ord(c)] = 2 + k
        moves: list[dict[int, int]] = []
        starts = []
        for label in self.labels:
            base = len(moves)
            starts.append(base)
            moves += [{c: base + t for c, t in m.items()} for m in suffix_automaton(self.codes(texts[label]).tolist())]
        numbers, self.table = spread_out([{} if i in starts else m for i, m in enumerate(moves)], self.width)
        self.starts = numbers[starts]
        #: the state after each symbol from a language's start (language, symbol); its start where the text has none
        self.first = np.repeat(self.starts[:, None], self.width, axis=1) if starts else np.empty((0, self.width), "i8")
        for k, s in enumerate(starts):
            for c, t in moves[s].items():
                self.first[k, c] = numbers[t]
        self.entries = memoryview(self.table)

    def codes(self, text: str) -> np.ndarray:
        return self.symbols[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages): phrases that each text needs; and its characters."""
        codes = [self.codes(t) for t in texts]
        lengths = np.array([len(c) for c in codes], "i8")
        order = np.argsort(-lengths, kind="stable")  # the lanes that are still walked come first
        begin = (np.cumsum(lengths) - lengths)[order]
        flat = np.concatenate(codes) if codes else np.empty(0, "u2")
        k = len(self.labels)
        state = np.repeat(self.starts[:, None], len(texts), axis=1)
        counts = np.zeros((k, len(texts)), "i8")
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts longer than each step
        for t, n in enumerate(active.tolist()):
            if n * k <= FEW_LANES:
                for lane in range(n):
                    rest = flat[begin[lane] + t : begin[lane] + lengths[order[lane]]].tolist()
                    for label in range(k):
                        counts[label, lane] += self.walk(label, int(state[label, lane]), rest)
                break
            symbol = flat[begin[:n] + t]
            was = state[:, :n]
            entry = self.table[was + symbol]
            begun = entry >> 32 != was
            counts[:, :n] += begun
            state[:, :n] = np.where(begun, self.first[:, symbol], entry & LOW)
        out = np.empty((len(texts), k), "i8")
        out[order] = counts.T
        return out, lengths

    def walk(self, label: int, state: int, symbols: list[int]) -> int:
        """The phrases that begin within the symbols."""
        entries, first, n = self.entries, self.first[label].tolist(), 0
        for c in symbols:
            entry = entries[state + c]
            if entry >> 32 == state:
                state = entry & LOW
            else:
                state = first[c]
                n += 1
        return n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """The language, how clear it is (the share of the winner when shares fall with the phrases needed), and its phrases a character."""
        if not self.labels:
            return [(UNKNOWN, 0.0, 1.0)] * len(texts)
        lowered = ["" if t is None else t.lower() for t in texts]
        out: list[tuple[str, float, float]] = [(UNKNOWN, 0.0, 1.0)] * len(texts)
        part: list[int] = []
        size = 0
        # long texts together, so that their steps are shared
        for i in sorted(range(len(texts)), key=lambda i: -len(lowered[i])):
            part.append(i)
            size += len(lowered[i])
            if size > BATCH_CHARS:
                self._place(out, lowered, part)
                part, size = [], 0
        self._place(out, lowered, part)
        return out

    def _place(self, out: list, lowered: list[str], part: list[int]) -> None:
        for i, x in zip(part, self._predicted([lowered[i] for i in part])):
            out[i] = x

    def _predicted(self, lowered: list[str]) -> list[tuple[str, float, float]]:
        if not lowered:
            return []
        counts, lengths = self.phrases(lowered)
        rates = counts / np.maximum(lengths, 1)[:, None]
        out = []
        for t, r in zip(lowered, rates):
            if not LETTER.search(t):
                out.append((UNKNOWN, 0.0, 1.0))
                continue
            k = int(np.argmin(r))
            weights = np.exp(-20 * (r / r[k] - 1))
            out.append((self.labels[k], float(1 / weights.sum()), float(r[k])))
        return out


def parser(texts: dict[str, str]) -> CrossParser:
    """One for each worker and sample."""
    return loaded(("language", *sorted(texts.items())), lambda: CrossParser(texts))


def identify(df: DataFrame, sample: dict[str, str], text: str = "text", lang: str = "lang_pred", score: str = "lang_score", rate: str | None = None) -> DataFrame:
    """`df` with the predicted language and its score, and the phrases that it needs a character if `rate` is given; the parser is made from `sample` in each worker."""
    results = [lang, score, *([rate] if rate else [])]
    names = [c for c in df.columns if c not in results]
    inner = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(names)], df[text].cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = parser(sample).predict(b.column(len(names)).to_pylist())
            made = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "lang_", "score_", "rate_"])

    kept = ",".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields[:-1])), "lang_ string", "score_ double", "rate_ double"])
    out = inner.mapInArrow(run, kept)
    return (out if rate else out.drop("rate_")).toDF(*names, *results)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = held_out(docs["doc_id"], 3, 1)
    sample = labelled_sample(docs.filter(~out), "lang", "text")
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), sample, score="score").select("doc_id", "held_out", "lang_pred", "score")
