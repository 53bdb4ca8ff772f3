"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside exact base rules.

Base spans are what four patterns and their checks give (e-mail addresses, IPv4 addresses, card numbers that pass
Luhn, phone numbers in international form). They always stay.

The network adds spans that the patterns miss: written-out signs ("name (at) host dot com", "name at host.org"), other separators in
cards and addresses, phone numbers without a plus sign. It is trained in numpy, by gradients through time and through the CRF's
forward-backward sums, on labelled spans that a seeded generator makes; it is small and takes some seconds. A span of these kinds must pass a
check (`plausible`), which wants a digit or an at sign, written out or not, as `TRIGGER` has it; overlapping windows around each of those, in
the whole text, hold all that the check could take. Each character takes its scores from the window in whose middle it lies most, and one Viterbi run
over all windows that touch each other gives the labels. Numbers are carried on over the groups of digits beside them. Spans are added where they overlap no base span.

Positions are code points, ends exclusive. Null and empty texts have no spans; texts of any length are read whole; rows with null keys and repeated rows are
kept; an empty table gives an empty table. `find` looks at key and text only, so other names may clash; `mask` keeps all columns.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from packetloom.llm.common import documents, slices, whole_text

# The kinds in the order that ties take, and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match can't begin inside a run of digits whose start failed.
IP = re.compile(r"(?<![0-9])" + PATTERNS["ip"])
#: An address as the network may find it; signs that are written out stand apart.
WRITTEN_EMAIL = re.compile(r"[\w.%+-]+( ?@ ?| ?[(\[{] ?at ?[)\]}] ?| at )[\w-]+(( ?\. ?| ?[(\[{] ?(\.|dot) ?[)\]}] ?| dot )[\w-]+)+")
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]| at (?=[\w-]+(?: ?\. ?| ?[(\[{] ?(?:\.|dot) ?[)\]}] ?| dot )[\w-])", re.IGNORECASE)
#: A run of groups of digits.
DIGITS = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,3}[0-9])*")
NOT_DIGIT = re.compile(r"[^0-9]+")

WINDOW = 64
STRIDE = 32
MARGIN = 28
#: Characters of texts whose windows are scored together.
BATCH_CHARS = 500_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    """The check of a base match."""
    if kind == "ip":
        parts = [p.lstrip("0") or "0" for p in match.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        digits = NOT_DIGIT.sub("", match)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(NOT_DIGIT.sub("", match)) <= 15
    return True


def emails(text: str) -> Iterator[re.Match[str]]:
    """What the e-mail pattern's finditer gives, in time in proportion to the text: each at sign is tried once, from the first character that may precede it."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = COMPILED["email"].match(text, done + len(text[done:at].rstrip(LOCAL)))
        if m:
            yield m
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    for rank, kind in enumerate(KINDS):
        found = emails(text) if kind == "email" else (IP if kind == "ip" else COMPILED[kind]).finditer(text)
        out += [(m.start(), rank, m.end()) for m in found if holds(kind, m[0])]
    return [(s, e, KINDS[r]) for s, r, e in sorted(out)]


# The network -----------------------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = "0 @.-_+()[]/:,;\"'#&|=\n"
CLASSES = {c: i + 2 for i, c in enumerate(LETTERS + SIGNS)}
PAD, OTHER, N_CLASSES = 0, 1, 2 + len(LETTERS) + len(SIGNS)
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
CLASS_OF = np.full(0x250, OTHER, "u1")
for _c, _i in CLASSES.items():
    CLASS_OF[ord(_c)] = _i
    CLASS_OF[ord(_c.upper())] = _i
for _c in "0123456789":
    CLASS_OF[ord(_c)] = CLASSES["0"]


def classes(text: str) -> np.ndarray:
    return CLASS_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(CLASS_OF) - 1)]


@dataclass
class BiLstmCrf:
    """embed (classes, e); for each direction w (e + h + 1, 4h); out (2h + 1, tags); trans (tags, tags)."""

    p: dict[str, np.ndarray]
    hidden: int

    @classmethod
    def fresh(cls, embed: int, hidden: int, rng: np.random.Generator) -> BiLstmCrf:
        t = len(TAGS)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype("f4")
        p = {"embed": draw(N_CLASSES, embed) * 3, "f": draw(embed + hidden + 1, 4 * hidden), "b": draw(embed + hidden + 1, 4 * hidden), "out": draw(2 * hidden + 1, t), "trans": np.zeros((t, t), "f4")}
        for k in "fb":
            p[k][-1, hidden : 2 * hidden] = 1  # forget little at first
        return cls(p, hidden)

    def lstm(self, x: np.ndarray, w: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """x (steps, n, e) to states (steps, n, h)."""
        h = self.hidden
        steps, n, e = x.shape
        drive = x.reshape(-1, e) @ w[:e] + w[-1]
        drive = drive.reshape(steps, n, 4 * h)
        u = w[e:-1]
        s, c = np.zeros((n, h), "f4"), np.zeros((n, h), "f4")
        out, trail = np.empty((steps, n, h), "f4"), []
        for t in range(steps):
            g = drive[t] + s @ u
            gates = 0.5 * np.tanh(0.5 * g[:, : 3 * h]) + 0.5
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            a = np.tanh(g[:, 3 * h :])
            was_s, was_c = s, c
            c = f * c + i * a
            th = np.tanh(c)
            s = o * th
            out[t] = s
            if keep:
                trail.append((i, f, o, a, was_s, was_c, th))
        return out, trail

    def back(self, grad: np.ndarray, x: np.ndarray, w: np.ndarray, trail: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of w and x from those of the states."""
        h = self.hidden
        steps, n, e = x.shape
        dg = np.empty((steps, n, 4 * h), "f4")
        ds, dc = np.zeros((n, h), "f4"), np.zeros((n, h), "f4")
        u = w[e:-1]
        states = np.empty((steps, n, h), "f4")
        for t in range(steps - 1, -1, -1):
            i, f, o, a, was_s, was_c, th = trail[t]
            states[t] = was_s
            d = grad[t] + ds
            dc = dc + d * o * (1 - th * th)
            dg[t, :, :h] = dc * a * i * (1 - i)
            dg[t, :, h : 2 * h] = dc * was_c * f * (1 - f)
            dg[t, :, 2 * h : 3 * h] = d * th * o * (1 - o)
            dg[t, :, 3 * h :] = dc * i * (1 - a * a)
            ds = dg[t] @ u.T
            dc = dc * f
        flat = dg.reshape(-1, 4 * h)
        dw = np.vstack([x.reshape(-1, e).T @ flat, states.reshape(-1, h).T @ flat, flat.sum(0, keepdims=True)])
        return dw, (flat @ w[:e].T).reshape(x.shape)

    def emissions(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """codes (n, steps) to scores (steps, n, tags)."""
        x = self.p["embed"][codes.T]
        hf, tf = self.lstm(x, self.p["f"], keep)
        hb, tb = self.lstm(x[::-1], self.p["b"], keep)
        both = np.concatenate((hf, hb[::-1]), axis=2)
        return both @ self.p["out"][:-1] + self.p["out"][-1], (x, tf, tb, both)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The loss (negative log-likelihood of the tags a window) and its gradients."""
        em, (x, tf, tb, both) = self.emissions(codes, keep=True)
        steps, n, k = em.shape
        trans = self.p["trans"]
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0]
        for t in range(1, steps):
            alpha[t] = em[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows, want = np.arange(n), tags.T
        gold = em[np.arange(steps)[:, None], rows, want].sum(0) + trans[want[:-1], want[1:]].sum(0)
        dem = np.exp(alpha + beta - z[:, None])
        dem[np.arange(steps)[:, None], rows, want] -= 1
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - z[:, None, None])
        dtrans = pair.sum((0, 1))
        np.subtract.at(dtrans, (want[:-1], want[1:]), 1)
        dem /= n
        h, flat = self.hidden, dem.reshape(-1, k)
        dout = np.vstack([both.reshape(-1, 2 * h).T @ flat, flat.sum(0, keepdims=True)])
        dboth = dem @ self.p["out"][:-1].T
        df, dxf = self.back(dboth[:, :, :h], x, self.p["f"], tf)
        db, dxb = self.back(dboth[::-1, :, h:], x[::-1], self.p["b"], tb)
        dembed = np.zeros_like(self.p["embed"])
        np.add.at(dembed, codes.T, dxf + dxb[::-1])
        return float((z - gold).mean()), {"embed": dembed, "f": df, "b": db, "out": dout, "trans": dtrans / n}

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each run of scores (characters, tags), by Viterbi over the whole run."""
        order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
        out: list[np.ndarray] = [np.empty(0, "i1")] * len(scores)
        lo = 0
        while lo < len(order):
            longest = len(scores[order[lo]])
            part = order[lo : lo + max(1, 200_000 // longest)]
            lo += len(part)
            lengths = np.array([len(scores[i]) for i in part])
            em = np.zeros((longest, len(part), len(TAGS)), "f4")
            for j, i in enumerate(part):
                em[: lengths[j], j] = scores[i]
            best, came = em[0].copy(), np.empty((longest, len(part), len(TAGS)), "i1")
            came[:] = np.arange(len(TAGS), dtype="i1")  # beyond a run's end tags stay
            active = np.searchsorted(-lengths, -np.arange(longest), side="left")
            for t in range(1, longest):
                n = active[t]
                v = best[:n, :, None] + self.p["trans"]
                came[t, :n] = v.argmax(1)
                best[:n] = v.max(1) + em[t, :n]
            tags = np.empty((longest, len(part)), "i1")
            tags[-1] = best.argmax(1)
            rows = np.arange(len(part))
            for t in range(longest - 1, 0, -1):
                tags[t - 1] = came[t][rows, tags[t]]
            for j, i in enumerate(part):
                out[i] = tags[: lengths[j], j]
        return out


# Labelled spans --------------------------------------------------------------------------------------------------


def word(r: random.Random) -> str:
    return "".join(r.choice(("an", "er", "on", "the", "sch", "que", "ion", "ado", "mi", "ta", "ver", "lu", "b", "re", "st", "ou")) for _ in range(r.randint(1, 3)))


def card_digits(r: random.Random) -> str:
    d = "".join(r.choice("0123456789") for _ in range(r.choice((14, 15, 15))))
    return next(d + c for c in "0123456789" if luhn(d + c))


#: Sizes of the groups that phone numbers are written in.
GROUPS = ((3, 4, 2), (4, 4), (3, 2, 2), (2, 2, 2, 2), (3, 3, 2), (7,), (8,))


def personal(r: random.Random) -> tuple[str, str]:
    """(kind, string), plain or written in a way that the patterns don't know."""
    kind = r.choice(KINDS)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if kind == "email":
        at = r.choice(("@", "@", " @ ", " (at) ", "(at)", " [at] ", "[at]", " at ", " at "))
        dot = r.choice((" dot ", " (dot) ", "[dot]", ".")) if "at" in at else "."
        if at == " at ":
            dot = r.choice((" dot ", "."))
        return kind, r.choice((word(r), f"{word(r)}.{digits(2)}", f"{word(r)}_{word(r)}")) + at + word(r) + r.choice(("", digits(1))) + dot + r.choice(("com", "org", f"example{dot}com", "net", "de"))
    if kind == "ip":
        return kind, r.choice((".", ".", " . ", "[.]", "(.)", " dot ")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d, sep = card_digits(r), r.choice(("", " ", "-", ".", "/", "  ", " - "))
        return kind, sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    if r.random() < 0.3:  # groups of other sizes
        first = r.choice((f"0{digits(2)}", f"0{digits(3)}", f"00{digits(2)} {digits(2)}", f"00{digits(2)} {digits(3)}", f"({digits(4)})"))
        return kind, f"{first}{r.choice((' ', '/', ' / ', '-'))}" + r.choice((" ", " ", "-")).join(digits(n) for n in r.choice(GROUPS))
    sep = r.choice((" ", "-", ".", "/", " - "))
    area = r.choice((digits(3), f"({digits(3)})"))
    return kind, r.choice((f"+{digits(1)} ", f"+{digits(2)} ", f"00{digits(2)} ", "", "")) + area + sep + digits(3) + sep + digits(4)


#: Words before "at" that are no names.
AT_WORDS = ("look", "more", "us", "them", "page", "site", "found", "available", "is", "it", "and", "online", "read", "visit", "here", "are", "was", "shop", "or", "me")


def harmless(r: random.Random) -> str:
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    if r.random() < 0.12:
        return f"{r.choice(AT_WORDS)} at {word(r)}.{r.choice(('com', 'org', 'net', 'de'))}"
    return r.choice(
        (
            lambda: f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}",
            lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(r.choice((16, 32, 40))))}"',
            lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}",
            lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
            lambda: f"Version {digits(1)}.{digits(1)}",
            lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}",
            lambda: digits(r.randint(1, 6)),
            lambda: digits(r.choice((9, 12, 13, 20, 24))),
            lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: f"{digits(1)},{digits(3)}.{digits(2)}",
            lambda: f"{word(r)}@{word(r)}",
            lambda: f"https://{word(r)}.com/{digits(4)}",
            lambda: f"at {word(r)}",
        )
    )()


def labelled_window(r: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of one window of generated text."""
    text, tags = "", []
    while len(text) < 2 * WINDOW:
        x = r.random()
        kind, part = personal(r) if x < 0.25 else (None, harmless(r) if x < 0.45 else word(r))
        if kind:
            k = 1 + 2 * KINDS.index(kind)
            tags += [k] + [k + 1] * (len(part) - 1)
        else:
            tags += [0] * len(part)
        sep = r.choice((" ", " ", " ", ", ", ". ", "\n", " | "))
        text, tags = text + part + sep, tags + [0] * len(sep)
    start = r.randrange(len(text) - WINDOW)
    return classes(text)[start : start + WINDOW], np.array(tags[start : start + WINDOW])


@lru_cache(maxsize=2)
def trained(steps: int = 600, batch: int = 64, embed: int = 12, hidden: int = 20, seed: int = 11) -> BiLstmCrf:
    """A network, by Adam on so many generated batches."""
    r, net = random.Random(seed), BiLstmCrf.fresh(embed, hidden, np.random.default_rng(seed))
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for t in range(1, steps + 1):
        windows = [labelled_window(r) for _ in range(batch)]
        _, grads = net.gradients(np.array([c for c, _ in windows]), np.array([x for _, x in windows]))
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * (1 - t / (steps + 1)) + 0.001
        for k, g in grads.items():
            g = g * min(1.0, 5 / (size + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype("f4")
    return net


# Windows and spans -------------------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts on a grid of STRIDE of all windows that touch the surroundings of a trigger."""
    out: set[int] = set()
    done = -1
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        lo = max(0, (m.start() - MARGIN) // STRIDE - 1)
        hi = (m.end() + MARGIN) // STRIDE
        out.update(range(lo, hi + 1))
        done = hi * STRIDE - MARGIN
    return [k * STRIDE for k in sorted(out) if k * STRIDE < len(text)]


def plausible(kind: str, s: str) -> bool:
    """The check of a span that the network found."""
    low = s.lower()
    if kind == "email":
        return bool(WRITTEN_EMAIL.fullmatch(low))
    if kind == "ip":
        parts = re.split(r" ?(?:\.|[(\[{] ?\.? ?[)\]}]|dot| ) ?", low)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    digits = NOT_DIGIT.sub("", low)
    if re.search(r"[^0-9 ().+/-]", low):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[0-9][ ()./-]+[0-9]", low)) and not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*", low)


def spans_of(texts: list[str], net: BiLstmCrf) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans."""
    out, part, size = [], [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > BATCH_CHARS:
            out += spans_of_some(part, net)
            part, size = [], 0
    return out + spans_of_some(part, net)


def spans_of_some(texts: list[str], net: BiLstmCrf) -> list[tuple[list, list]]:
    owners, starts, rows = [], [], []
    for i, t in enumerate(texts):
        found = window_starts(t)
        if not found:
            continue
        codes = np.concatenate([classes(t), np.zeros(WINDOW, "u1")])
        for s in found:
            owners.append(i)
            starts.append(s)
            rows.append(codes[s : s + WINDOW])
    scores = [net.emissions(np.array(rows[k : k + 1024]))[0].transpose(1, 0, 2) for k in range(0, len(rows), 1024)]
    windows = np.concatenate(scores) if scores else np.empty((0, WINDOW, len(TAGS)), "f4")
    runs: list[np.ndarray] = []
    places: list[tuple[int, int]] = []
    k = 0
    while k < len(rows):
        end = k + 1
        while end < len(rows) and owners[end] == owners[k] and starts[end] == starts[end - 1] + STRIDE:
            end += 1
        # a run of overlapping windows: each character takes its scores from the window in whose middle it lies most
        lo, last = starts[k], len(texts[owners[k]])
        run = np.empty((starts[end - 1] + WINDOW - lo, len(TAGS)), "f4")
        for j in range(k, end):
            a = 0 if j == k else (WINDOW - STRIDE) // 2
            run[starts[j] - lo + a : starts[j] - lo + WINDOW] = windows[j, a:]
        runs.append(run[: last - lo])
        places.append((owners[k], lo))
        k = end
    added: dict[int, list] = {}
    for (owner, lo), tags in zip(places, net.decode(runs)):
        text = texts[owner]
        for s, e, kind in read_off(tags):
            s, e = trimmed(text, s + lo, e + lo)
            if kind in ("card", "phone"):
                s, e = carried_on(kind, text, s, e)
            if s < e and plausible(kind, text[s:e]):
                added.setdefault(owner, []).append((s, e, kind))
    out = []
    for i, t in enumerate(texts):
        own = base_spans(t) if TRIGGER.search(t) else []
        new: list[tuple[int, int, str]] = []
        for x in sorted(added.get(i, []), key=lambda x: (x[0], -x[1])):
            if all(x[1] <= s or e <= x[0] for s, e, _ in new[-1:]):
                new.append(x)
        new = apart(new, own)
        out.append((own, sorted(own + new, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))))
    return out


def apart(new: list[tuple[int, int, str]], own: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that overlap none of `own`; both are in order of their starts."""
    out, k, reach = [], 0, 0
    for x in new:
        while k < len(own) and own[k][0] < x[1]:
            reach = max(reach, own[k][1])
            k += 1
        if reach <= x[0]:
            out.append(x)
    return out


def trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    e = min(e, len(text))
    while s < e and text[s] in " ,;:.\n|\"'":
        s += 1
    while s < e and text[e - 1] in " ,;:.\n|\"'":
        e -= 1
    return s, e


#: A run of groups of digits that is longer has more digits than any card or phone: there are three signs at most between two of them.
REACH = 80


def carried_on(kind: str, text: str, s: int, e: int) -> tuple[int, int]:
    """The span, or the whole run of groups of digits that it is part of, if that passes the check. Where the run fails, as with a date behind a number, the part that was found stays."""
    before = text[max(0, s - REACH) : s]
    lo = s - len(before) + len(before.rstrip("0123456789 ()./-+"))
    for m in DIGITS.finditer(text, lo, min(len(text), e + REACH)):
        if m.start() <= s and e <= m.end():
            return (m.start(), m.end()) if plausible(kind, m[0]) else (s, e)
    return s, e


def read_off(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Maximal runs of tags of one kind; a beginning tag inside a run starts another."""
    out: list[tuple[int, int, str]] = []
    t, n = tags.tolist(), len(tags)
    i = 0
    while i < n:
        if not t[i]:
            i += 1
            continue
        kind, j = (t[i] - 1) // 2, i + 1
        while j < n and t[j] == 2 + 2 * kind:
            j += 1
        out.append((i, j, KINDS[kind]))
        i = j
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(df: DataFrame, net: BiLstmCrf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts of base spans, base_sha256, spans) of each row of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = spans_of(b.column(1).to_pylist(), net)
            counts = [pa.array([sum(x[2] == k for x in own) for own, _ in found], pa.int64()) for k in KINDS]
            sha = pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sha, pa.array([joined(x) for _, x in found], pa.string())], ["key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("key", key)


def mask(df: DataFrame, net: BiLstmCrf, text: str = "text") -> DataFrame:
    """`df` with each span of its texts replaced by its kind in brackets. Of overlapping spans the first covers the rest. Null texts stay null."""
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            found = spans_of([t or "" for t in texts], net)
            out = [None if t is None else masked(t, spans) for t, (_, spans) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    schema = ",".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(inner.schema.fields))
    return inner.mapInArrow(run, schema).toDF(*names)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, done = [], 0
    for s, e, kind in spans:
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join(out) + text[done:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(documents(spark, sf_dir), trained())
