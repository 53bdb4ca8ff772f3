"""Walks of all messages of a batch at once against walks of one message after another, over random bytes."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa

from packetloom.functions import walks

MOST_LABELS = walks.MOST_LABELS


def dns_name(data: bytes, at: int) -> tuple[str, int] | None:
    """The name at `at` and the place behind it, or None where it is broken.

    More than MOST_LABELS labels in a run break it. A pointer starts a new run elsewhere; if that is broken, or was visited before, the
    labels so far are the name. Behind labels the place is that of the pointer itself.
    """
    runs: list[list[str]] = [[]]
    place = None
    seen: set[int] = set()
    whole = False
    while True:
        labels = runs[-1]
        if at >= len(data) or len(labels) > MOST_LABELS:
            break
        size = data[at]
        if size == 0:
            place = at + 1 if place is None else place
            whole = True
            break
        if size >= 0xC0:
            if at + 1 >= len(data):
                break
            if place is None:
                place = at if labels else at + 2
            target = (size & 0x3F) << 8 | data[at + 1]
            runs.append([])
            if target in seen:
                break
            seen.add(target)
            at = target
            continue
        label = data[at + 1 : at + 1 + size]
        if len(label) < size:
            break
        try:
            labels.append(label.decode())
        except UnicodeDecodeError:
            labels.append("<invalid>")
        at += 1 + size
    if not whole and len(runs) == 1:
        return None
    name = ".".join(runs.pop()) if whole else None
    if not whole:
        runs.pop()
    for labels in reversed(runs):
        name = ".".join(labels) if name is None else ".".join([*labels, name]) if labels else name
    return name, place


def dns_question(data: bytes) -> tuple[str, int]:
    """Name and type of the first question; empty and 0 where the name is broken."""
    found = dns_name(data, 12)
    if found is None:
        return "", 0
    name, at = found
    return name, int.from_bytes(data[at : at + 2], "big") if len(data) >= at + 2 else 0


class Cursor:
    """Reads big-endian numbers up to an end; past it `short` is set."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end, self.short = data, at, end, False

    def number(self, n: int) -> int:
        if self.at + n > self.end:
            self.short = True
            return 0
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")


def extensions(c: Cursor, end: int) -> Iterator[tuple[int, int, int]]:
    """(type, start, end) of each extension up to `end`."""
    while c.at + 4 <= end:
        kind, size = c.number(2), c.number(2)
        yield kind, c.at, c.at + size
        c.at += size


def client_hello(data: bytes) -> dict | None:
    """Content and handshake type, version and server name of a TLS record; the name is empty for other handshakes, None for what is no or a cut handshake."""
    if len(data) < 9 or data[0] != 22:
        return None
    out = {"content_type": data[0], "major": data[1], "minor": data[2], "handshake_type": data[5], "sni": ""}
    if data[5] != 1:
        return out
    end = min(5 + int.from_bytes(data[3:5], "big"), len(data))
    c = Cursor(data, 43, end)
    for width in (1, 2, 1):  # session id, cipher suites, compression methods
        skipped = c.number(width)
        c.at += skipped
    size = c.number(2)
    if c.short:
        return None
    limit = min(c.at + size, end)
    for kind, a, b in extensions(c, limit):
        if kind == 0 and b - a > 5 and b <= limit and data[a + 2] == 0:
            stop = a + 5 + int.from_bytes(data[a + 3 : a + 5], "big")
            if stop <= limit:
                try:
                    return out | {"sni": data[a + 5 : stop].decode()}
                except UnicodeDecodeError:
                    return out
    return out


def ber_length(data: bytes, at: int) -> tuple[int, int] | None:
    """A BER length and the place behind it: one byte, or the number of up to four bytes that follow."""
    if at >= len(data):
        return None
    size = data[at]
    if size < 0x80:
        return size, at + 1
    n = size & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def trap_envelope(data: bytes) -> dict | None:
    """Version and community of an SNMP message."""
    if len(data) < 10 or data[0] != 0x30 or not (found := ber_length(data, 1)):
        return None
    values = []
    at = found[1]
    for tag in (0x02, 0x04):
        if at >= len(data) or data[at] != tag or not (found := ber_length(data, at + 1)):
            return None
        size, start = found
        at = start + size
        values.append((start, at))
    (version, _), (a, b) = values
    if version >= len(data) or b > len(data):
        return None
    try:
        community = data[a:b].decode()
    except UnicodeDecodeError:
        community = "???"
    return {"version": data[version], "community": community}


def label(x: bytes) -> str:
    try:
        return x.decode()
    except UnicodeDecodeError:
        return "<invalid>"


def messages(rng, kind, n):
    out = [None, b"", bytes(12), bytes(600)]
    for _ in range(n):
        if kind == "dns":
            size = rng.choice([12, 14, 30, 60, 300])
            body = bytearray(rng.choices([0, 1, 1, 2, 3, 5, 60, 0xC0, 0xC0, 97, 0xFF, rng.randrange(256)], k=size))
            for k in range(len(body) - 1):
                if body[k] >= 0xC0 and rng.random() < 0.9:
                    body[k], body[k + 1] = 0xC0, rng.randrange(12 + size) & 255
            out.append(bytes(12) + bytes(body))
        elif kind == "tls":
            name = rng.choice([b"host.example", b"", bytes(rng.choices([97, 46, 0xC3, 0xBC, 98], k=rng.randrange(12)))])
            sni = len(name).to_bytes(2, "big") + name
            extensions = b""
            for _ in range(rng.randrange(5)):
                data = rng.choice([b"", bytes(3), (len(sni) + 1).to_bytes(2, "big") + bytes([rng.choice([0, 0, 1])]) + sni])
                extensions += rng.choice([0, 0, 5, 16]).to_bytes(2, "big") + (len(data) + rng.choice([0, 0, 0, 1, 40])).to_bytes(2, "big") + data
            hello = bytes(34) + rng.choice([b"\0", b"\2ab", b"\2"]) + b"\0\2" + bytes(2) + b"\1\0" + (len(extensions) + rng.choice([0, 0, 3])).to_bytes(2, "big") + extensions
            whole = bytes([rng.choice([22, 22, 22, 23]), 3, 1]) + (4 + len(hello) + rng.choice([0, 0, 9, -3])).to_bytes(2, "big") + bytes([rng.choice([1, 1, 1, 2]), 0, 0, 0]) + hello
            out.append(whole[: rng.choice([len(whole), len(whole), rng.randrange(len(whole))])])
        else:
            name = bytes(rng.choices([97, 98, 0xC3, 0xBC], k=rng.randrange(9)))
            length = lambda x: bytes([x]) if rng.random() < 0.6 else bytes([0x80 | (w := rng.choice([1, 2, 4]))]) + x.to_bytes(w, "big")
            body = bytes([2]) + length(1) + bytes([rng.randrange(4)]) + bytes([rng.choice([4, 4, 4, 5])]) + length(len(name) + rng.choice([0, 0, 0, 30])) + name
            whole = bytes([0x30]) + length(len(body) & 127) + body + bytes(rng.randrange(4))
            out.append(whole[: rng.choice([len(whole), len(whole), rng.randrange(len(whole))])])
        if rng.random() < 0.1:
            out.append(rng.randbytes(rng.randrange(80)))
    return out


def test_dns_names():
    rng = random.Random(1)
    data = messages(rng, "dns", 4000)
    found = walks.dns_names(pa.array(data, pa.binary())).to_pylist()
    want = [None if m is None or dns_name(m, 12) is None else dns_question(m) for m in data]
    got = [None if f is None else (".".join(label(x) for x in f["labels"]) + "." * f["dot"], f["type"]) for f in found]
    assert got == want and sum(w is not None and "." in w[0] for w in want) > 300
    chain = bytes(12) + b"".join(bytes([1, 97, 0xC0, 12 + 4 * k]) for k in range(1, 60)) + bytes(3)
    assert walks.dns_names(pa.array([chain], pa.binary())).to_pylist()[0]["labels"] == [b"a"] * 59


def test_client_hellos():
    rng = random.Random(2)
    data = messages(rng, "tls", 4000)
    found = walks.client_hellos(pa.array(data, pa.binary())).to_pylist()
    want = [None if m is None else client_hello(m) for m in data]
    got = [None if f is None else f | {"sni": "" if label(f["sni"]) == "<invalid>" else f["sni"].decode()} for f in found]
    assert got == want and sum(bool(w and w["sni"]) for w in want) > 50


def test_trap_envelopes():
    rng = random.Random(3)
    data = messages(rng, "snmp", 4000)
    found = walks.trap_envelopes(pa.array(data, pa.binary())).to_pylist()
    want = [None if m is None else trap_envelope(m) for m in data]
    got = [None if f is None else f | {"community": "???" if label(f["community"]) == "<invalid>" else f["community"].decode()} for f in found]
    assert got == want and sum(w is not None for w in want) > 300


def test_slices_and_nothing():
    data = pa.array([b"x" * 30, None, bytes(12) + b"\1a\0\0\5"], pa.binary())
    assert walks.dns_names(data.slice(2)).to_pylist() == [{"labels": [b"a"], "dot": False, "type": 5}]
    for f in (walks.dns_names, walks.client_hellos, walks.trap_envelopes):
        assert len(f(data.slice(0, 0))) == 0
