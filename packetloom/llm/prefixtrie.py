"""A trie of conversations by partition refinement: which conversations share their first turns, and what sharing saves.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Refinement starts with one class of all conversations and splits the classes by turn after turn.
A class that is left with one distinct conversation is retired: the rest of that conversation is a chain of nodes with one child each, which is written out and never compared again. It ends when no
class is left, or its conversations are over. Then values are folded back: what a node's subtree has of leaves, and of bytes saved, is the sum over its members of what each owns, where a node is owned by its smallest
member and a leaf is a retired conversation's end.

As Spark jobs: turns are numbered within conversations, and prefixes get their hashes, as running sums over Spark's own ranges, so a conversation may hold any part of all turns. A turn stands for
SHA-256 of role and text, texts themselves are hashed where they are read and never shuffled. A class is known by two 64-bit hashes of depth and turns up to there. Equal conversations are one, with a weight. A job splits by
as many turns as `block` says, and each further one by twice as many, so deep agreement costs few jobs; only rows of conversations that aren't retired take part. Keys that have a large part of all rows
(a common first turn, a long conversation, a node with many children) meet their table without a shuffle (`operators.joins.lookup`), or rows of a conversation are dealt by pieces of it. The
list of ids that end at a node is digested in order: sorted by Spark's ranges, each of which turns its part of a list into text; one task reads these parts, a row each, and keeps only the digest's state.

Turns are ordered by turn, null first, then by their hash. Null role and text are empty. Rows without a conversation's id take no part. Repeated rows are turns of their own. An empty table has no node, not even the root.
A conversation that has no turns belongs to the root. Texts may be of any length. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import written
from packetloom.operators.joins import lookup
from packetloom.operators.ordered import running_sums

#: Turns that the first job splits by.
BLOCK = 4
#: Turns of a conversation that are joined in one piece.
PIECE = 4096
#: Bytes of a part of a list of ids.
PART_BYTES = 1 << 16
#: Most turns that a conversation takes over, and conversations that share a first one.
HEAD, FAMILY = 9, 5
NODE = ("depth", "x", "y")
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, token, bytes): each turn with its place in its conversation, from 1."""
    said = lambda c: F.coalesce(df[c].cast("string"), F.lit(""))
    rows = df.select(df[key].cast("long").alias("conv"), df[turn].alias("turn"), said(role).alias("role"), said(text).alias("text")).filter("conv is not null")
    token = F.sha2(F.encode(F.concat(F.length("role"), F.lit(":"), "role", "text"), "UTF-8"), 256)
    rows = rows.select("conv", "turn", token.alias("token"), F.octet_length("text").cast("long").alias("bytes"))
    numbered = running_sums(rows, [F.col("turn").asc_nulls_first(), F.col("token")], {"at": F.lit(1)}, by=["conv"])
    return numbered.select("conv", "at", "token", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations that are asked about, and their turns: the first of another conversation, then what is left of the own ones.

    Conversation c takes the first h turns of c - c % 5 (fewer, if that has fewer) and drops as many of its own; h is crc32 of its id as a decimal, mod 9. Returns (conv, n) and (conv, depth, n, token, bytes).
    """
    counts = written(rows.groupBy("conv").agg(F.count("*").alias("n")), "conversations")
    base = F.col("conv") - F.col("conv") % FAMILY
    convs = counts.withColumns({"base": base, "head": F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % HEAD})
    convs = convs.join(counts.select(F.col("conv").alias("base"), F.col("n").alias("held")), "base", "left").withColumn("taken", F.least("head", F.coalesce("held", F.lit(0))))
    convs = written(convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "rebuilt")
    own = of_pieces(rows, "at", convs.select("conv", F.col("n").alias("most"), "head", "taken", F.col("total").alias("n")), "most").filter("at > head")
    own = own.select("conv", (F.col("at") - F.col("head") + F.col("taken")).alias("depth"), "n", "token", "bytes")
    heads = rows.filter(F.col("at") < HEAD).withColumnRenamed("conv", "base")  # at most so many rows of a conversation, for at most FAMILY others
    heads = heads.join(convs.select("base", "conv", "head", F.col("total").alias("n")), "base").filter("at <= head").select("conv", F.col("at").alias("depth"), "n", "token", "bytes")
    return convs.select("conv", F.col("total").alias("n")), own.union(heads)


def of_pieces(rows: DataFrame, at: str, table: DataFrame, n: str) -> DataFrame:
    """`rows` joined with `table` by conv, where a conversation's rows are dealt by pieces of it; `n` is the last place that a conversation has. The column n of `table` goes."""
    pieces = table.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(n) / PIECE)))).drop(n)
    return rows.withColumn("piece", F.floor(F.col(at) / PIECE)).join(pieces, ["conv", "piece"]).drop("piece")


def digests(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., ends): SHA-256, as hexadecimal digits, of the ascending decimal keys of each group, joined by commas."""
    order = [*by, key]
    kinds = ", ".join(f"{c} long" for c in by)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of lists as text, each with its first key."""
        group, first, ids, size = None, 0, [], 0

        def closed() -> list[tuple]:
            return [(*group, first, ",".join(ids))] if ids else []

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(len(by) + 1)), pa.array([r[-1] for r in out], pa.string())], [*by, "first", "said"])

        for b in batches:
            out = []
            for *here, k in zip(*(c.to_pylist() for c in b.columns)):
                if here != group or size > PART_BYTES:
                    out += closed()
                    group, first, ids, size = here, k, [], 0
                ids.append(str(k))
                size += len(ids[-1]) + 1
            if out:
                yield batch(out)
        if ids:
            yield batch(closed())

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(len(by))), pa.array([r[-1] for r in out], pa.string())], [*by, "ends"])

        for b in batches:
            out = []
            for *here, _, said in zip(*(c.to_pylist() for c in b.columns)):
                if here != group:
                    if group is not None:
                        out.append((*group, state.hexdigest()))
                    group, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(said.encode())
            if out:
                yield batch(out)
        if group is not None:
            yield batch([(*group, state.hexdigest())])

    said = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(parts, f"{kinds}, first long, said string")
    return said.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digested, f"{kinds}, ends string")


def trie(convs: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of conversations: (conv, n) and (conv, depth, n, token, bytes), depths from 1 without a gap up to n."""
    lanes = [F.xxhash64("depth", "token"), F.xxhash64(F.lit(1), "token", "depth")]
    hashed = running_sums(rows.withColumns({"u": lanes[0], "v": lanes[1]}), [F.col("depth")], {"x": F.col("u"), "y": F.col("v")}, by=["conv"], how="xor")
    hashed = hashed.select("conv", "depth", "n", "bytes", "x", "y", F.col("x").bitwiseXOR(F.col("u")).alias("px"), F.col("y").bitwiseXOR(F.col("v")).alias("py"))
    none = F.lit(0).cast("long")
    ends = written(hashed.filter("depth = n").select("conv", "n", "x", "y").union(convs.filter("n = 0").select("conv", "n", none, none)), "ends")
    lists = written(digests(ends.withColumnRenamed("n", "depth"), list(NODE), "conv"), "digests")
    kinds = written(ends.groupBy("n", "x", "y").agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "kinds")
    n_kinds = kinds.count()
    empty = kinds.sparkSession.createDataFrame([], "conv long, since long")
    # bytes up to each turn of the conversations that stand for their equals
    own = of_pieces(hashed, "depth", kinds.select("conv", F.col("n").alias("most"), "weight"), "most")
    own = written(running_sums(own, [F.col("depth")], {"upto": F.col("bytes")}, by=["conv"]), "turns")

    # Split: classes of a block of depths, of the conversations that share theirs with another one up to there
    active, lo, retired, shared = kinds.filter("n > 0").select("conv", "n", "weight"), 0, [], []
    if n_kinds == 1:  # the only class there is
        retired, active = [active.select("conv", F.lit(1).cast("long").alias("since"))], active.limit(0)
    while not active.isEmpty():
        hi = lo + block
        here = own.filter((F.col("depth") > lo) & (F.col("depth") <= hi))
        here = here.join(active.select("conv"), "conv", "left_semi") if lo else here  # at most `block` rows of a conversation
        classes = here.groupBy(*NODE).agg(F.count("*").alias("kinds"), F.sum("weight").alias("n_convs"), F.min("conv").alias("conv"), F.min("bytes").alias("bytes"), F.min("px").alias("px"), F.min("py").alias("py"))
        classes = written(classes, "classes")
        alone = written(classes.filter("kinds = 1").groupBy("conv").agg(F.min("depth").alias("since")), "alone")
        retired.append(alone)
        shared.append(classes.filter("kinds > 1"))
        active = written(active.filter(F.col("n") > hi).join(alone, "conv", "left_anti"), "active")
        lo, block = hi, 2 * block
    since = empty
    for r in retired:
        since = since.union(r)
    since = written(since, "retired")

    # Chains of the retired, and the classes of several
    state = kinds.select("conv", "n", "weight", "x", "y").join(since, "conv", "left")
    chain = of_pieces(own.drop("weight", "n"), "depth", state.filter("since is not null").select("conv", F.col("n").alias("most"), "n", "since", "weight"), "most").filter("depth >= since")
    last = state.filter("since is not null").join(own.filter("depth = n").select("conv", F.col("upto").alias("all")), "conv").select("conv", "all")
    chain = of_pieces(chain, "depth", last.join(kinds.select("conv", F.col("n").alias("most")), "conv"), "most")
    chain = chain.withColumn("saved", (F.col("weight") - 1) * (F.col("all") - F.col("upto") + F.col("bytes")))
    chain = written(chain, "chains")
    classes = empty.select("conv", *(none.alias(c) for c in ("depth", "x", "y", "px", "py", "n_convs", "bytes"))).limit(0)
    for s in shared:
        classes = classes.unionByName(s.drop("kinds"))
    classes = running_sums(classes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), [F.col("depth")], {"owned": F.col("own")}, by=["conv"])
    classes = written(classes, "shared")

    # Fold back: what each conversation owns, summed over a node's members
    of_chain = chain.filter("depth = since").select("conv", F.col("saved").alias("owns"), F.lit(1).cast("long").alias("leaf"))
    owns = classes.groupBy("conv").agg(F.sum("own").alias("owns")).withColumn("leaf", none).union(of_chain).groupBy("conv").agg(F.sum("owns").alias("owns"), F.sum("leaf").alias("leaf"))
    members = state.join(owns, "conv", "left").select("conv", "n", F.coalesce("since", F.col("n") + 1).alias("since"), F.coalesce("owns", none).alias("owns"), F.coalesce("leaf", none).alias("leaf"))
    members = written(members, "members")
    below = of_pieces(own.select("conv", *NODE), "depth", members.filter("n > 0").drop("n").withColumn("most", F.col("since") - 1), "most").filter("depth < since")
    below = below.groupBy(*NODE).agg(F.sum("owns").alias("saved"), F.sum("leaf").alias("n_leaves"))
    tops = chain.filter("depth = since").select(*NODE, "px", "py", "conv").unionByName(classes.select(*NODE, "px", "py", "conv"))
    tops = written(tops, "tops")
    children = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    parent = classes.select(F.col("depth").alias("up"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent"))
    parents = lookup(tops.filter("depth > 1").withColumn("up", F.col("depth") - 1), parent, ["up", "px", "py"], "inner").select(*NODE, "parent")
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    least = root.first()
    least = F.lit(least["conv"] if least else None).cast("long")
    parents = written(parents.union(tops.filter("depth = 1").select(*NODE, least)), "parents")

    shown = ("conv", *NODE, "parent", "n_convs", "n_children", "n_leaves", "saved")
    many = classes.join(below, list(NODE)).join(children, list(NODE), "left").join(parents, list(NODE))
    many = many.select("conv", *NODE, "parent", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", (F.col("saved") - F.col("owned") + F.col("own")).alias("saved"))
    ones = chain.join(parents, list(NODE), "left")
    ones = ones.select("conv", *NODE, F.when(F.col("depth") > F.col("since"), F.col("conv")).otherwise(F.col("parent")).alias("parent"), F.col("weight").alias("n_convs"), (F.col("depth") < F.col("n")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), "saved")
    of_all = members.agg(F.coalesce(F.sum("owns"), none).alias("saved"), F.coalesce(F.sum("leaf"), none).alias("leaves"), F.lit(0).alias("one"))
    first = tops.filter("depth = 1").agg(F.count("*").alias("n_children"), F.lit(0).alias("one"))
    top = root.withColumn("one", F.lit(0)).join(of_all, "one").join(first, "one")  # a row each
    top = top.select("conv", *(none.alias(c) for c in NODE), F.lit(None).cast("long").alias("parent"), "n_convs", "n_children", F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved")
    nodes = many.select(*shown).union(ones.select(*shown)).union(top.select(*shown))
    out = nodes.join(lists, list(NODE), "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_TABLE = "[list_reduce([n, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for n in range(256)]"
OP13_SQL = f"""with crc as (select cast({_TABLE} as bigint[]) as t),
o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as k, coalesce(role, '') as role, coalesce(text, '') as text
 from conversations where conv_id is not null),
n as (select c, count(*) as n, xor(list_reduce([4294967295] || [cast(ascii(x) as bigint) for x in string_split(cast(c as varchar), '')], lambda a, x: xor(a >> 8, any_value(t)[(xor(a, x) & 255) + 1])), 4294967295) % 9 as h from o, crc group by c),
g as (select n.*, least(n.h, coalesce(b.n, 0)) as took from n left join n b on b.c = n.c - n.c % 5),
t as (select g.c, k as d, role, text from g join o on o.c = g.c - g.c % 5 and k <= h union all select g.c, k - h + took, role, text from g join o using (c) where k > h),
p as (select c, d, strlen(text) as bytes, string_agg(sha256(length(role) || ':' || role || text), '') over (partition by c order by d) as path from t union all select c, 0, 0, '' from g),
m as (select *, d = max(d) over (partition by c) as ends from p),
v as (select path, any_value(d) as d, min(c) as c, count(*) as n, any_value(bytes) as bytes, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where ends), '')) as ends from m group by path),
ch as (select left(path, cast(length(path) - 64 as bigint)) as path, count(*) as n_children from v where d > 0 group by 1),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join ch using (path)),
s as (select a.path, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n - 1) * b.bytes) as saved from w a join (select *, unnest(range(d + 1)) as up from w) b on a.path = left(b.path, cast(64 * up as bigint)) group by a.path)
select w.c as conv_id, w.d as depth, u.c as parent_conv_id, w.n as n_convs, w.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, w.ends as ends_sha256
 from w join s using (path) left join w u on w.d > 0 and u.path = left(w.path, cast(length(w.path) - 64 as bigint))"""
