"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of a few 64-bit words: one bit for each literal character of each
rule. All rules are simulated at once over each canonical URL by Shift-And: the active bits move on by one and stay where
the next character fits; a wildcard is a bit that also keeps itself. URLs of a batch take each step together, so a step
is a few operations on arrays of words.

A canonical URL is "." + host + "\\n" + path. In a rule `*` stands for any run of characters without line end, so it
stays in the host or in the path, and `**` for any run at all. A rule has to match the whole canonical URL.

Null URLs, and those without "://", have empty host and path, match no rule and are allowed. Repeated rows give
equal rows; an empty table gives an empty table. Of rules of equal length the first in the list wins. URLs of any length are matched whole, a step for each
character. Other columns of the table are not looked at, so their names may clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\n"
#: Characters above this share one class: they fit wildcards only.
CODES = 256


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """The host itself and all subdomains, and paths that start with the rule's."""
        return f"*.{self.host}{SEP}{self.path}**"


#: The rules of the query, by host and path; the longest that fits wins.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Globs for URLs that no rule fits: hosts with such labels, and such paths, are blocked.
BLOCKED_GLOBS = (
    f"*.*spam*{SEP}**",
    f"*.*casino*{SEP}**",
    f"*.ads.*{SEP}**",
    f"*.tracker.*{SEP}**",
    f"**{SEP}*/cgi-bin/**",
    f"**{SEP}**.exe",
)


class WildcardAutomaton:
    """Shift-And over all `globs`. Bit k of a rule means that k of its characters are matched; bit 0 is where it starts."""

    def __init__(self, globs: Sequence[str]):
        kept: list[tuple[int, str]] = []  # bit and kind of wildcard
        chars: list[tuple[int, str]] = []  # bit and the character that leads to it
        starts, self.ends, bit = [], [], 0
        for g in globs:
            starts.append(bit)
            for t in re.findall(r"\*\*|\*|[^*]", g):
                if t[0] == "*":
                    kept.append((bit, t))
                else:
                    bit += 1
                    chars.append((bit, t))
            self.ends.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        one = lambda b: (b // 64, np.uint64(1 << (b % 64)))
        self.step = np.zeros((CODES, self.words), "u8")
        self.stay = np.zeros((CODES, self.words), "u8")
        self.start = np.zeros(self.words, "u8")
        for b in starts:
            w, m = one(b)
            self.start[w] |= m
        for b, c in chars:
            w, m = one(b)
            if ord(c) >= CODES - 1:
                raise ValueError(f"a rule has {c!r}")
            self.step[ord(c), w] |= m
        for b, kind in kept:
            w, m = one(b)
            self.stay[:, w] |= m
            if kind == "*":
                self.stay[ord(SEP), w] &= ~m
        for b, kind in kept:
            if kind == "**":
                w, m = one(b)
                self.stay[ord(SEP), w] |= m

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """A row for each text: which globs match it."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            lengths = np.array([len(texts[i]) for i in part])
            state = np.tile(self.start, (len(part), 1))
            codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), "<u4")
            codes = np.minimum(codes, CODES - 1)
            begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for k in range(int(lengths[0]) if len(lengths) else 0):
                n = int(np.searchsorted(-lengths, -k))  # longest first: the first n have a character left
                c = codes[begin[:n] + k]
                now = state[:n]
                moved = now << np.uint64(1)
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
                state[:n] = (moved & self.step[c]) | (now & self.stay[c])
            for r, b in enumerate(self.ends):
                out[part, r] = (state[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1) > 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED_GLOBS, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of each row. Line ends in URLs count as spaces."""
    host, path = host_and_path(pages[url].cast("string"))
    globs = [r.glob for r in rules] + list(blocked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WildcardAutomaton(globs)
        for b in batches:
            texts = ["." + h.replace(SEP, " ") + SEP + p.replace(SEP, " ") for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            hit = automaton.matches(texts)
            names, verdicts = [], []
            for row in hit:
                fit = max((r for r, x in zip(rules, row) if x), key=lambda r: len(r.name), default=None)
                names.append(fit.name if fit else None)
                verdicts.append(fit.verdict if fit else "block" if row[len(rules) :].any() else "allow")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["key", "host", "path", "rule", "verdict"])

    rows = pages.select(pages[key].cast("long").alias("key"), host.alias("host"), path.alias("path"))
    return rows.mapInArrow(run, "key long, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') as rest from pages),
s as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
h as (select page_id, host, path, '.' || host as d from s),
r as (select page_id, host, path, d, case
  when ends_with(d, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when ends_with(d, '.example.org') and starts_with(path, '/es/') then 'example.org/es/'
  when ends_with(d, '.com') and starts_with(path, '/fr/') then 'com/fr/'
  when ends_with(d, '.com') and starts_with(path, '/de/') then 'com/de/'
  when ends_with(d, '.org') and starts_with(path, '/') then 'org/' end as rule from h)
select page_id, host, path, rule, case
  when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
  when contains(d, 'spam') or contains(d, 'casino') or contains(d, '.ads.') or contains(d, '.tracker.')
    or contains(path, '/cgi-bin/') or ends_with(path, '.exe') then 'block'
  else 'allow' end as verdict
from r
"""
