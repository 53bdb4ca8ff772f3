"""Walks of unknown length through messages, for all messages of a batch at once: DNS names, extensions of a TLS ClientHello, BER headers of an SNMP message.

Each message has a cursor. A step reads what lies at all cursors that still go on and moves them, so there are as many steps as the longest walk of the batch has, and no loop over messages. Texts come back as bytes;
whether they are UTF-8 is for the caller's columns to say.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from packetloom.functions.frames import Bytes

#: More labels in a row break a DNS name.
MOST_LABELS = 10
#: Messages whose pointers are marked at once: a pointer leads to one of 2**14 places.
MARKED, PLACES = 1024, 1 << 14


def rest(b: Bytes, at: np.ndarray, size: np.ndarray, rows: np.ndarray) -> pa.Array:
    """So many bytes at a place of each of `rows` (a row may come more than once); an empty value where none."""
    ends = np.cumsum(size)
    place = np.repeat(b.start[rows] + at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate(([0], ends)).astype("i4")
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b.data[place].tobytes())])


def dns_names(messages: pa.Array) -> pa.Array:
    """STRUCT<labels, dot, type> of the name at byte 12 of each message, null where it is broken: its labels, whether a dot follows the last one, and the number behind it (0 without).

    A pointer starts a new run of labels elsewhere. If that is broken, or begins where one began before, the labels of the runs before it are the name. A dot follows where the last run of a name has no label and another has.
    Behind labels the place of the type is that of the pointer itself.
    """
    parts = [_dns_names(messages.slice(k, MARKED)) for k in range(0, len(messages), MARKED)]
    return pa.concat_arrays(parts) if parts else pa.array([], DNS_NAME)


DNS_NAME = pa.struct([("labels", pa.list_(pa.binary())), ("dot", pa.bool_()), ("type", pa.int32())])


def _dns_names(messages: pa.Array) -> pa.Array:
    b = Bytes(messages)
    n = len(b.start)
    at, place = np.full(n, 12), np.full(n, -1)
    count, run = np.zeros(n, "i8"), np.zeros(n, "i8")
    whole, seen = np.zeros(n, bool), None
    found: list[tuple[np.ndarray, ...]] = []
    rows = np.arange(n)
    while len(rows):
        rows = rows[(at[rows] < b.length[rows]) & (count[rows] <= MOST_LABELS)]
        size = b.number(at[rows], 1, rows)
        ends = rows[size == 0]
        whole[ends] = True
        place[ends] = np.where(place[ends] < 0, at[ends] + 1, place[ends])
        points = rows[size >= 0xC0]
        points = points[at[points] + 1 < b.length[points]]
        if len(points):
            seen = np.zeros((n, PLACES), bool) if seen is None else seen
            place[points] = np.where(place[points] < 0, np.where(count[points] > 0, at[points], at[points] + 2), place[points])
            target = b.number(at[points], 2, points) & (PLACES - 1)
            run[points] += 1
            count[points] = 0
            again = seen[points, target]
            seen[points, target] = True
            at[points] = target
            points = points[~again]
        plain = (size > 0) & (size < 0xC0)
        words, size = rows[plain], size[plain]
        fits = at[words] + 1 + size <= b.length[words]
        words, size = words[fits], size[fits]
        found.append((words, at[words] + 1, size, run[words]))
        at[words] += 1 + size
        count[words] += 1
        rows = np.sort(np.concatenate((points, words)))
    row, start, size, of = (np.concatenate(x) if found else np.empty(0, "i8") for x in (zip(*found) if found else ((),) * 4))
    kept = whole[row] | (of < run[row])  # the last run of a broken name doesn't count
    order = np.argsort(row[kept], kind="stable")
    row, start, size, of = (x[kept][order] for x in (row, start, size, of))
    last = np.full(n, -1)
    np.maximum.at(last, row, of)
    broken = ~whole & (run == 0)
    dot = (last >= 0) & (last < np.where(whole, run, run - 1))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype("i4")
    labels = pa.ListArray.from_arrays(pa.array(offsets), rest(b, start, size, row))
    there = ~broken & (place + 2 <= b.length)
    kind = np.where(there, b.number(np.maximum(place, 0), 2), 0).astype("i4")
    return pa.StructArray.from_arrays([labels, pa.array(dot), pa.array(kind)], fields=list(DNS_NAME), mask=pa.array(broken | messages.is_null().to_numpy(zero_copy_only=False)))


HELLO = pa.struct([("content_type", pa.int32()), ("major", pa.int32()), ("minor", pa.int32()), ("handshake_type", pa.int32()), ("sni", pa.binary())])


def client_hellos(messages: pa.Array) -> pa.Array:
    """Content and handshake type, version and the bytes of the server name of each TLS record; no name for other handshakes, null for what is no or a cut handshake."""
    b = Bytes(messages)
    n = b.length
    ok = (n >= 9) & (b.number(0, 1) == 22)
    hello = ok & (b.number(5, 1) == 1)
    end = np.minimum(5 + b.number(3, 2), n)
    at, short = np.full(len(n), 43), np.zeros(len(n), bool)
    for width in (1, 2, 1, 2):  # session id, cipher suites, compression methods, and the size of the extensions
        cut = at + width > end
        short |= cut
        size = np.where(cut, 0, b.number(at, width))
        at = np.where(cut, at, at + width)
        behind, at = at, at + size
    limit, at = np.minimum(at, end), behind
    name, stop = np.zeros(len(n), "i8"), np.zeros(len(n), "i8")
    rows = np.flatnonzero(hello & ~short)
    while len(rows):
        rows = rows[at[rows] + 4 <= limit[rows]]
        kind, size = b.number(at[rows], 2, rows), b.number(at[rows] + 2, 2, rows)
        first = at[rows] + 4
        after = first + size
        named = (kind == 0) & (size > 5) & (after <= limit[rows]) & (b.number(first + 2, 1, rows) == 0)
        to = first + 5 + b.number(first + 3, 2, rows)
        named &= to <= limit[rows]
        name[rows[named]], stop[rows[named]] = first[named] + 5, to[named]
        at[rows] = after
        rows = rows[~named]
    fields = [b.number(k, 1).astype("i4") for k in (0, 1, 2, 5)]
    gone = ~ok | (hello & short)
    return pa.StructArray.from_arrays([*map(pa.array, fields), rest(b, name, stop - name, np.arange(len(n)))], fields=list(HELLO), mask=pa.array(gone))


ENVELOPE = pa.struct([("version", pa.int32()), ("community", pa.binary())])


def ber_lengths(b: Bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, place behind it, whether there is one) of the BER length at a place of each message: one byte, or the number of up to four bytes that follow."""
    first = b.number(at, 1)
    k = np.where(first < 0x80, 0, first & 0x7F)
    ok = (at < b.length) & ((first < 0x80) | ((k >= 1) & (k <= 4) & (at + 1 + k <= b.length)))
    size = np.where(first < 0x80, first, 0)
    for width in (1, 2, 3, 4):
        size = np.where(k == width, b.number(at + 1, width), size)
    return size, at + 1 + k, ok


def trap_envelopes(messages: pa.Array) -> pa.Array:
    """Version and the community's bytes of each SNMP message; null for what is none."""
    b = Bytes(messages)
    n = b.length
    ok = (n >= 10) & (b.number(0, 1) == 0x30)
    _, at, has = ber_lengths(b, np.full(len(n), 1))
    ok &= has
    places = []
    for tag in (0x02, 0x04):
        at = np.where(ok, at, 0)
        ok &= (at < n) & (b.number(at, 1) == tag)
        size, start, has = ber_lengths(b, at + 1)
        ok &= has
        at = start + size
        places.append((start, at))
    (version, _), (start, stop) = places
    ok &= (version < n) & (stop <= n)
    start, size = np.where(ok, start, 0), np.where(ok, stop - start, 0)
    number = b.number(np.where(ok, version, 0), 1).astype("i4")
    return pa.StructArray.from_arrays([pa.array(number), rest(b, start, size, np.arange(len(n)))], fields=list(ENVELOPE), mask=pa.array(~ok))
