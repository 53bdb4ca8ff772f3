"""Token counts of a piece vocabulary by heap-and-linked-list byte-pair merging.

A word is a linked list of its characters. A heap holds the adjacent pairs that form a piece, best score
first, then leftmost; the best is popped, joined if it still stands, and its new neighbours are pushed.
The count is the number of initial symbols less the number of merges; a character that has no piece
counts as the bytes it is written in. No identifiers are made.

No piece holds a word mark after another character, so words are counted apart and their counts kept.
The same holds around characters that no longer piece contains (line ends, mostly): the text is cut there.

Nulls count as empty texts, with no tokens; repeated rows give equal rows; an empty table gives an empty table. A text of any length is counted
whole, in time n log n of its longest word. Other columns of the table are not looked at, so their names may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.common import documents, whole_text

MARK = "▁"
#: Counts are kept for words up to so many bytes in each worker; then the store is emptied.
KEPT_BYTES = 96 << 20
#: What an entry of the store takes beside its word.
ENTRY_BYTES = 150
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PieceCounter:
    """The vocabulary of a sentencepiece .model of kind BPE with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.scores: dict[str, float] = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.scores):
            raise ValueError("pieces that cross words can't be counted word by word")
        self.joined = {c for p in self.scores if len(p) > 1 for c in p}
        self.kept: dict[str, int] = {}
        self.size = 0

    def symbols(self, c: str) -> int:
        """What a character that stays alone counts."""
        return 1 if c in self.scores else len(c.encode())

    def merged(self, word: str) -> int:
        """The count of a word, its marks included."""
        n = len(word)
        if n == 1:
            return self.symbols(word)
        scores = self.scores
        piece: list[str | None] = list(word)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = []
        for i in range(n - 1):
            s = scores.get(word[i : i + 2])
            if s is not None:
                heap.append((s, i, 2))
        heapify(heap)
        merges = 0
        while heap:
            _, i, size = heappop(heap)
            a = piece[i]
            if a is None or (j := after[i]) < 0 or len(a) + len(piece[j]) != size:
                continue
            piece[i] = a = a + piece[j]
            piece[j] = None
            merges += 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                s = scores.get(a + piece[k])
                if s is not None:
                    heappush(heap, (s, i, len(a) + len(piece[k])))
            h = before[i]
            if h >= 0:
                s = scores.get(piece[h] + a)
                if s is not None:
                    heappush(heap, (s, h, len(piece[h]) + len(a)))
        alone = sum(self.symbols(p) - 1 for p in piece if p is not None and len(p) == 1 and p not in scores)
        return n - merges + alone

    def word(self, word: str) -> int:
        """`merged`, cut at characters that never merge, and kept."""
        found = self.kept.get(word)
        if found is None:
            if self.joined.issuperset(word):
                found = self.merged(word)
            else:
                found, run = 0, []
                for c in word:
                    if c in self.joined:
                        run.append(c)
                        continue
                    found += (self.merged("".join(run)) if run else 0) + self.symbols(c)
                    run = []
                found += self.merged("".join(run)) if run else 0
            self.size += len(word) + ENTRY_BYTES
            if self.size > KEPT_BYTES:
                self.kept.clear()
                self.size = len(word) + ENTRY_BYTES
            self.kept[word] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        total = 0
        lines = text.split("\n") if "\n" not in self.joined else [text]
        kept, word = self.kept, self.word
        for k, line in enumerate(lines):
            if k:
                total += self.symbols("\n")
            if "  " in line or MARK in line or line[:1] == " " or line[-1:] == " ":
                line = line.replace(" ", MARK)
                for w in WORDS.findall(line if k else MARK + line):
                    total += word(w)
                continue
            words = line.split(" ")
            if k and words[0]:
                total += word(words[0])
                words = words[1:]
            elif k or not line:
                total += 0 if k else word(MARK)
                continue
            for w in words:
                found = kept.get(w := MARK + w)
                total += word(w) if found is None else found
        return total


_LOADED: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """One for each worker and path."""
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def count_tokens(df: DataFrame, path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of each row of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [c.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
