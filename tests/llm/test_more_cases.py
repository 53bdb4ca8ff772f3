"""Labels beyond the sample, archives that fail to open, components with one label, long runs of digits."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from packetloom.llm import language, media, pii, simhash
from packetloom.operators import joins


@pytest.mark.parametrize(("labels", "each"), [(400, 4), (3000, 1)])
def test_every_label_is_in_the_sample(spark, labels, each):
    df = spark.range(labels * each).select((F.col("id") % labels).cast("string").alias("lang"), F.concat(F.lit("Text "), F.col("id").cast("string"), F.lit(" of words")).alias("text"))
    sample = language.labelled_sample(df, "lang", "text")
    assert set(sample) == {str(k) for k in range(labels)} and all(sample.values()) and sum(map(len, sample.values())) <= language.TOTAL_CHARS


def test_more_labels_than_characters_is_an_error(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("lang"), F.lit("text").alias("text"))
    with pytest.raises(ValueError, match="total_chars"):
        language.labelled_sample(df, "lang", "text", total_chars=20)


class Faulty:
    """Opens an archive; calls and reads fail as listed."""

    def __init__(self, data, opens, reads):
        self.data, self.opens, self.reads, self.handles = data, list(opens), list(reads), []

    def __call__(self):
        if self.opens and self.opens.pop(0):
            raise OSError("no such store")
        outer = self

        class Handle(io.BytesIO):
            def read(self, *n):
                if outer.armed and outer.reads and outer.reads.pop(0):
                    raise OSError("lost")
                return super().read(*n)

        self.armed = False
        self.handles.append(Handle(self.data))
        return self.handles[-1]


def archive():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(3):
            z.writestr(f"m{k}", bytes([k]) * 100)
    return out.getvalue()


def test_opening_is_part_of_an_attempt():
    # the first member's read fails, then the archive can't be opened, then all is well
    source = Faulty(archive(), [False, True, False], [])
    rows = media.read_range(source, 0, 1 << 30, 3)
    original, calls = zipfile.ZipFile.read, []

    def read(self, info, *a):
        calls.append(info.filename)
        if len(calls) == 1:
            raise OSError("lost")
        return original(self, info, *a)

    zipfile.ZipFile.read = read
    try:
        found = list(rows)
    finally:
        zipfile.ZipFile.read = original
    assert [(r[0], r[2], r[3], r[4]) for r in found] == [("m0", bytes(100), 3, None), ("m1", b"\x01" * 100, 1, None), ("m2", b"\x02" * 100, 1, None)]
    assert len(source.handles) == 2 and all(h.closed for h in source.handles)


def test_a_member_that_cannot_be_read_is_a_row_and_an_archive_that_cannot_be_opened_an_error():
    data = bytearray(archive())
    data[data.index(b"\x01" * 100) + 5] ^= 0xFF
    found = list(media.read_range(Faulty(bytes(data), [True], []), 0, 1 << 30, 2))
    assert [(r[0], r[2] is None, r[4] is None) for r in found] == [("m0", False, True), ("m1", True, False), ("m2", False, True)]
    with pytest.raises(OSError, match="no such store"):
        list(media.read_range(Faulty(archive(), [True] * 9, []), 0, 1 << 30, 2))


def test_one_component_of_all_nodes(spark, monkeypatch):
    """A hub, a long path and a pair, with every key that has over a few rows hot."""
    monkeypatch.setattr(joins, "HOT_ROWS", 5)
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(59, 90)] + [(200, 201)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(91)} | {200: 200, 201: 200}


def test_hot_keys_are_looked_up_whole(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    rows = spark.range(500).select(F.when(F.col("id") < 200, 1).when(F.col("id") < 300, 2).otherwise(F.col("id")).alias("k"), "id")
    table = spark.createDataFrame([(1, "a"), (301, "b")], "k long, x string")
    for how, n in (("left", 500), ("inner", 201)):
        found = joins.lookup(rows, table, ["k"], how).collect()
        assert len(found) == n and {(r.k, r.x) for r in found if r.x} == {(1, "a"), (301, "b")} and len({r.id for r in found}) == n


def test_numbers_in_long_runs_of_digits():
    text = "4111 1111 1111 1111"
    assert pii.carried_on("card", text, 0, 14) == (0, 19)
    assert pii.carried_on("card", f"{text} 22", 0, 19) == (0, 19)
    run = "1 " * 5000
    assert pii.carried_on("card", run, 5000, 5019) == (5000, 5019)
