"""BPE encoding and decoding with a word-end vocabulary, by a pair occurrence index.

All distinct new words of a batch are laid out as one linked sequence of symbols. An index maps each
adjacent pair to all its positions there; the ranks that occur are taken in ascending order, each is
applied at every position of its list, and the lists of the neighbouring pairs are brought up to date.
So a merge is looked up once for a whole batch and not once for each word.

Text is normalised as the vocabulary's file says (NFC, white space runs to one space, lower case one
character at a time), cut by its pattern, and its special strings are found before that in the raw text.
A piece never holds white space, so a batch is split into white-space-free chunks by Arrow, each distinct
chunk is encoded once, and numpy puts the ids of the texts together. Words that were merged are kept in
a store that is bounded in bytes.

Nulls count as empty texts and give no ids; repeated rows give equal rows; an empty table gives an empty table. A text of any
length is encoded whole, alone in its batch if it is long. Other columns of the table are not looked at, so their names may clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.common import documents, whole_text

#: Merged words are kept up to so many bytes in each worker, and as many older ones.
KEPT_BYTES = 48 << 20
#: What an entry of the store takes beside its bytes.
ENTRY_BYTES = 160
#: Characters that are encoded together.
BATCH_CHARS = 2_000_000
#: The control characters that Python and Arrow count as white space and the vocabulary's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")
KINDS = {"L": 0, "N": 1}
# Capital letters of Unicode 16 and 17, which Python does not know yet, and their small letters.
NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEWER |= {i: i + 0x20 for i in range(0x10D50, 0x10D66)} | {i: i + 0x1B for i in range(0x16EA0, 0x16EB9)}
#: Letters and numbers of Unicode 16 that Python does not know yet.
NEWER_RANGES = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113B5), (0x113B7, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
)
NEW_CAPITAL = re.compile("[" + "".join(map(chr, NEWER)) + "]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is visible Latin-1, else the next free one from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


def spread(values: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `take` of values, which are cut at offsets, one after another, and the offsets of these."""
    size = np.diff(offsets)[take]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(offsets[take] - ends + size, size) + np.arange(total)
    return values[at], np.concatenate(([0], ends))


class WordBpe:
    """The vocabulary at `path` (a tokenizers .json with word ends), with results kept by word."""

    def __init__(self, path: str, most: int = KEPT_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        cut = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(cut.replace(r"\s", r"\p{White_Space}"))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: (left, right) to (rank, merged symbol)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        #: of each character: 0 a letter, 1 a number, 2 another
        self.kinds = np.array([KINDS.get(unicodedata.category(chr(i))[0], 2) for i in range(0x110000)], "u1")
        for lo, hi in NEWER_RANGES:
            self.kinds[lo : hi + 1] = [0 if regex.match(r"\p{L}", chr(i)) else 1 if regex.match(r"\p{N}", chr(i)) else 2 for i in range(lo, hi + 1)]
        #: the tokens as bytes, each with the space that decoding puts after it
        spelt = [(self.tokens.get(i, "") + " ").encode() for i in range(max(self.tokens) + 1)]
        self.spelt = np.frombuffer(b"".join(spelt), "u1")
        self.spelt_at = np.concatenate(([0], np.cumsum([len(x) for x in spelt])))
        self.kept: dict[bytes, bytes] = {}
        self.last_kept: dict[bytes, bytes] = {}
        self.size, self.most = 0, most

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, by one pair occurrence index over all of them."""
        symbol: list[int] = []
        starts = []
        after: list[int] = []
        before: list[int] = []
        index: dict[tuple[int, int], list[int]] = {}
        ranks, inner, last = self.ranks, self.inner, self.last
        active: list[tuple[int, int, int, int]] = []
        for word in words:
            k = len(symbol)
            starts.append(k)
            n = len(word)
            own = [inner[b] for b in word]
            own[-1] = last[word[-1]]
            symbol += own
            before.append(-1)
            before.extend(range(k, k + n - 1))
            after.extend(range(k + 1, k + n))
            after.append(-1)
            for i, pair in enumerate(zip(own, own[1:]), k):
                if pair in ranks:
                    if pair in index:
                        index[pair].append(i)
                    else:
                        index[pair] = [i]
        for pair in index:
            rank, new = ranks[pair]
            active.append((rank, *pair, new))
        heapq.heapify(active)
        while active:
            _, a, b, new = heapq.heappop(active)
            for i in sorted(index.pop((a, b))):
                if symbol[i] != a or (j := after[i]) < 0 or symbol[j] != b:
                    continue
                symbol[i] = new
                symbol[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    pair = (new, symbol[k])
                    if pair in index:
                        index[pair].append(i)
                    elif found := ranks.get(pair):
                        index[pair] = [i]
                        heapq.heappush(active, (found[0], *pair, found[1]))
                h = before[i]
                if h >= 0:
                    pair = (symbol[h], new)
                    if pair in index:
                        index[pair].append(h)
                    elif found := ranks.get(pair):
                        index[pair] = [h]
                        heapq.heappush(active, (found[0], *pair, found[1]))
        out = []
        for i in starts:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def normal(self, text: str) -> str:
        """The text in NFC and lower case, white space as it was."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would look at its place in the word
            text = text.replace("Σ", "σ")
        if not text.isascii() and NEW_CAPITAL.search(text):
            text = text.translate(NEWER)
        return text.lower()

    def parts(self, text: str) -> list[str | int]:
        """The chunks of a text and the ids of special strings, in order."""
        out: list[str | int] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                out += [x for x in SPACES.split(self.normal(piece)) if x]
        return out

    def pieces(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all chunks, the offsets of their pieces in these, and the number of pieces of each chunk."""
        _, offsets, data = chunks.buffers()
        at = np.frombuffer(offsets, "i4")[chunks.offset : chunks.offset + len(chunks) + 1].astype("i8")
        raw = np.frombuffer(data, "u1")[at[0] : at[-1]] if len(chunks) and at[-1] > at[0] else np.empty(0, "u1")
        at = at - at[0]
        first = (raw & 0xC0) != 0x80  # the first byte of each character
        kind = self.kinds[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")]
        place = np.flatnonzero(first)
        cut = np.ones(len(kind), bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        starts = np.zeros(len(raw) + 1, bool)
        starts[place[cut]] = True
        starts[at] = True
        for k in np.flatnonzero(pc.match_substring(chunks, "'").to_numpy(zero_copy_only=False)):  # the pattern has endings with an apostrophe
            lo, hi = at[k], at[k + 1]
            word = raw[lo:hi].tobytes().decode()
            starts[lo + 1 : hi] = False
            # the pattern's own idea of letters and numbers may be of another version of Unicode
            for m in self.cut.finditer("".join([c if c.isascii() else "ü½¡"[self.kinds[ord(c)]] for c in word])):
                starts[lo + len(word[: m.start()].encode())] = True
        edges = np.flatnonzero(starts[:-1])
        counts = np.searchsorted(edges, at[1:]) - np.searchsorted(edges, at[:-1])
        return raw, np.concatenate((edges, [len(raw)])), counts

    def merged(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of raw between edges, one after another, and how many each has. Distinct pieces that aren't kept are merged by one index over all of them."""
        if len(edges) < 2:
            return np.empty(0, "u4"), np.empty(0, "i8")
        data, at = raw.tobytes(), edges.tolist()
        words = [data[a:b] for a, b in zip(at, at[1:])]
        kept, was = self.kept, self.last_kept
        new = []
        for w in set(words).difference(kept):
            found = was.get(w)
            if found is None:
                new.append(w)
            else:
                kept[w] = found
                self.size += len(w) + len(found) + ENTRY_BYTES
        for w, ids in zip(new, self.merge(new)):
            kept[w] = found = np.array(ids, "<u4").tobytes()
            self.size += len(w) + len(found) + ENTRY_BYTES
        found = [kept[w] for w in words]
        if self.size > self.most:  # a new store is begun, beside the last
            self.last_kept, self.kept, self.size = kept, {}, 0
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], "i8")

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        batch: list[str] = []
        size = 0
        for text in texts:
            batch.append(text)
            size += len(text)
            if size > BATCH_CHARS:
                yield from self._encoded(batch)
                batch, size = [], 0
        yield from self._encoded(batch)

    def _encoded(self, batch: list[str]) -> Iterator[np.ndarray]:
        if not batch:
            return
        odd = {i: self.parts(t) for i, t in enumerate(batch) if ("<|" in t and self.specials.search(t)) or ODD_SPACE.search(t)}
        # texts with special strings or odd control characters are split here, all others by Arrow
        lists = pc.utf8_split_whitespace(pa.array(["" if i in odd else self.normal(t) for i, t in enumerate(batch)], pa.string()))
        chunks, n = lists.flatten(), lists.value_lengths().to_numpy().astype("i8")
        if odd:
            ends = len(chunks)
            chunks = pa.concat_arrays([chunks, pa.array(["" if isinstance(x, int) else x for parts in odd.values() for x in parts], pa.string())])
        known = chunks.dictionary_encode()
        raw, edges, counts = self.pieces(known.dictionary)
        ids, size = self.merged(raw, edges)
        per_piece = np.concatenate(([0], np.cumsum(size)))
        tokens, at = spread(ids, per_piece[np.concatenate(([0], np.cumsum(counts)))], known.indices.to_numpy())
        docs = at[np.concatenate(([0], np.cumsum(n)))]
        for i, parts in odd.items():
            own = tokens[at[ends] : at[ends + len(parts)]]
            places = [k for k, x in enumerate(parts) if isinstance(x, int)]
            odd[i] = np.insert(own, at[ends + np.array(places, "i8")] - at[ends], [parts[k] for k in places]) if places else own
            ends += len(parts)
        for i in range(len(batch)):
            yield odd[i] if i in odd else tokens[docs[i] : docs[i + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """As the library does for a file without a decoder: the tokens, joined by spaces, in UTF-8."""
        return spread(self.spelt, self.spelt_at, ids)[0][:-1].tobytes()


_LOADED: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """One for each worker and path."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<long>, decoded string) of each row of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            found = list(v.encode_all(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype("i8") for x in found], pa.list_(pa.int64())), pa.array([v.decode(x).decode() for x in found], pa.string())], ["key", "ids", "decoded"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, ids array<long>, decoded string").withColumnRenamed("key", key)


def encode_digest(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what `encode` returns, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        sha = hashlib.sha256
        for b in batches:
            n, ids, decoded = [], [], []
            for found in v.encode_all(b.column(1).to_pylist()):
                n.append(len(found))
                ids.append(sha(found.tobytes()).hexdigest())
                decoded.append(sha(v.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digest(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
