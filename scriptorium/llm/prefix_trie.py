"""The trie of conversation prefixes, built as a burst trie.

A turn is known by a 128-bit hash of its role and text.  Conversations that share a first run
of turns are a container under a trie head, and keep what comes behind it.  The root bursts,
and so does every container of more than ``CONTAINER`` turns and conversations: its head goes
down by all the turns that its members share (the least and the greatest member in
lexicographic order share just those, and both are plain aggregates), and its members go on to
the containers of their next turn.  A group of equal conversations of any size is over in one
such round.  The containers that remain are sorted, a partition many of them, and swept: one
pass over neighbours opens and closes nodes.  Sums of subtrees then go up the heads, a round
at a time.

Rounds are as many as branchings lie on a path, each with more than ``CONTAINER`` below it, and
read only rows of containers that still are too large.  No task holds more than a container
and a partition's sort spills; a conversation is one row of 20 bytes a turn, not its texts.
The digest of a node's ends has to read them in one order: ids meet in blocks of ``ENDS`` first,
then a node's blocks stream through the hash one at a time.

Defined results: a null role or text is empty; turns are ordered by number, null first, then
role, then text; repeated rows are repeated turns; rows without conv_id belong to no
conversation and are left out; an empty table has no node, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut, small_batches

#: Turns and conversations of a container that is swept in one go.
CONTAINER = 10_000
#: Keys of containers to burst that are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 20_000
#: Bits of conv_id within a block of ends.
ENDS = 10

WORDS = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ID = 16
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (id, words) in order, a row for each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    turn = F.struct(
        place.alias("place"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("id"),
        F.regexp_count("text", F.lit(WORDS)).cast("int").alias("words"),
    )
    grouped = rows.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def forked(sequences: DataFrame, family: int = 20, most: int = 3) -> DataFrame:
    """Each conversation behind the first turns of its family's first one.

    Conversation c begins with the first h turns of conversation c - c % ``family`` and goes on with
    its own behind its first h; h is the checksum of c's digits modulo ``most`` + 1.
    """
    heads = sequences.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    joined = sequences.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left")
    own = F.slice("turns", h + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), h), own)).alias("turns"))


def _shared(a: Column, b: Column) -> Column:
    """How many first elements of two arrays agree."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")


def _burst(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Heads of the containers of ``rows``, the members that end there, and those that go on, in the containers of their next turn."""
    heads = rows.groupBy("key").agg(
        F.min(F.struct("parent_key", "parent_conv", "depth", "head_words")).alias("top"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.min("turns").alias("lo"), F.max("turns").alias("hi")
    )
    heads = heads.withColumn("run", _shared(F.col("lo"), F.col("hi")))
    heads = cut(heads.select("key", "top.*", "n", "least", "run", F.transform(F.slice("lo", F.lit(1), F.col("run")), lambda t: t["words"]).alias("run_words")), "trie_heads")
    near = heads.select("key", "run", "least")
    joined = rows.join(F.broadcast(near) if near.count() <= BROADCAST_KEYS else near, "key").withColumn("next", F.try_element_at("turns", F.col("run") + 1))
    ends = joined.filter("next is null").select("key", "conv_id")
    onward = joined.filter("next is not null").select(
        "conv_id",
        F.unhex(F.md5(F.concat("key", "next.id"))).alias("key"),
        F.col("key").alias("parent_key"),
        F.col("least").alias("parent_conv"),
        (F.col("depth") + F.col("run") + 1).alias("depth"),
        F.col("next.words").alias("head_words"),
        F.slice("turns", F.col("run") + 2, F.size("turns")).alias("turns"),
    )
    return heads, ends, onward


def sweep(depth: int, head_words: int, members: list[tuple[int, bytes, list[int]]]) -> list[tuple]:
    """The nodes of a container, its head first, from its sorted members (conv_id, ids, words): depth, place of the parent, least, n, children, leaves, saved, ends."""
    up, deep, words, ends = [-1], [depth], [head_words], [[]]
    path, before = [0], b""
    for conv, ids, of in members:
        most, same = min(len(before), len(ids)), 0
        while same < most and before[same : same + _ID] == ids[same : same + _ID]:
            same += _ID
        shared = same // _ID
        del path[shared + 1 :]
        for k in range(shared, len(of)):
            up.append(path[-1])
            deep.append(depth + k + 1)
            words.append(of[k])
            ends.append([])
            path.append(len(up) - 1)
        ends[path[-1]].append(conv)
        before = ids
    size = len(up)
    n, children, leaves, saved = [len(e) for e in ends], [0] * size, [0] * size, [0] * size
    least = [e[0] if e else None for e in ends]
    for k in range(size - 1, -1, -1):  # parents stand before their children
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * words[k]
        if k:
            p = up[k]
            n[p] += n[k]
            children[p] += 1
            leaves[p] += leaves[k]
            saved[p] += saved[k]
            least[p] = least[k] if least[p] is None else min(least[p], least[k])
    return list(zip(deep, up, least, n, children, leaves, saved, ends, strict=True))


def _digest(ends: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else NO_ENDS


def _members(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int, int, int, int, bytes, list[int]]]:
    turns = batch.column("turns")
    inner = turns.flatten()
    at = np.r_[0, np.cumsum(np.asarray(turns.value_lengths()))].tolist()
    ids, words = b"".join(inner.field("id").to_pylist()), inner.field("words").to_pylist()
    rest = (batch.column(c).to_pylist() for c in ("key", "parent_key", "parent_conv", "depth", "head_words", "conv_id"))
    for k, row in enumerate(zip(*rest, strict=True)):
        yield *row, ids[at[k] * _ID : at[k + 1] * _ID], words[at[k] : at[k + 1]]


def _sweep_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a partition, whose rows come sorted by key, turns and conv_id."""
    schema = pa.schema([*[(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in COLUMNS], ("parent_key", pa.binary())])
    made: list[tuple] = []

    def close(top, members) -> None:
        _, parent_key, parent_conv, depth, head_words = top
        nodes = sweep(depth, head_words, members)
        for deep, up, least, n, children, leaves, saved, ends in nodes:
            parent = parent_conv if up < 0 else nodes[up][2]
            made.append((least, deep, parent, n, children, leaves, saved, _digest(ends), parent_key if up < 0 else None))

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
        made.clear()
        return out

    top, members = None, []
    for batch in batches:
        for *head, conv, ids, words in _members(batch):
            if top is None or head[0] != top[0]:
                if top is not None:
                    close(top, members)
                    if len(made) > CONTAINER:
                        yield rows()
                top, members = head, []
            members.append((conv, ids, words))
    if top is not None:
        close(top, members)
        yield rows()


def _head_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of the ids that end at a head, in blocks, a block at a time."""
    block = ends.groupBy("key", F.shiftright("conv_id", ENDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield row()
                    key, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key is not None:
            yield row()

    return block.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the trie of ``sequences`` (conv_id, turns of (id, words)), one row each."""
    small_batches(sequences.sparkSession)
    none = F.lit(None)
    rows = cut(
        sequences.select("conv_id", F.lit(b"").alias("key"), none.cast("binary").alias("parent_key"), none.cast("long").alias("parent_conv"), F.lit(0).alias("depth"), F.lit(0).alias("head_words"), "turns"), "trie_root"
    )
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], _NODE)
    heads, ends, small, large = [], [], [], rows
    while True:
        made, over, onward = _burst(large)
        onward = cut(onward, "trie_containers")
        heads.append(made)
        ends.append(over)
        due = onward.groupBy("key").agg(F.sum(F.size("turns").cast("long") + 1).alias("load")).filter(F.col("load") > container).select("key")
        due = cut(due, "trie_due")
        n = due.count()
        if not n:
            small.append(onward)
            break
        due = F.broadcast(due) if n <= BROADCAST_KEYS else due
        small.append(onward.join(due, "key", "left_anti"))
        large = onward.join(due, "key", "left_semi")

    columns = ["key", "parent_key", "parent_conv", "depth", "head_words", "conv_id", "turns"]
    left = reduce(DataFrame.unionByName, [s.select(columns) for s in small])
    swept = left.repartition("key").sortWithinPartitions("key", "turns", "conv_id").mapInArrow(_sweep_all, f"{_NODE}, parent_key binary")
    swept = cut(swept, "trie_swept")

    # sums go up: from the containers swept, then from the heads of each round to those of the round before
    total = [F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children")]
    below = cut(swept.filter("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(*total), "trie_sums")
    done: list[DataFrame] = []
    for level in reversed(heads):
        sums = below
        if done:
            upper = done[-1].select(F.col("parent_key").alias("key"), F.col("leaves").alias("n_leaves"), F.col("top_saved").alias("saved_tokens")).groupBy("key").agg(*total)
            sums = below.unionByName(upper).groupBy("key").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")])
        level = level.join(sums, "key", "left").fillna(0, ["saved", "children"]).fillna(1, ["leaves"])
        own = F.aggregate("run_words", F.col("head_words").cast("long"), lambda s, w: s + w)
        done.append(cut(level.withColumn("top_saved", F.col("saved") + (F.col("n") - 1) * own), "trie_summed"))
    top = reduce(DataFrame.unionByName, done)
    digests = _head_ends(reduce(DataFrame.unionByName, ends))

    # a head's turns: one node each
    behind = Window.partitionBy("key").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = top.select("*", F.posexplode(F.concat(F.array("head_words"), "run_words")).alias("step", "words"))
    each = each.withColumn("saved_here", F.col("saved") + (F.col("n") - 1) * F.sum(F.col("words").cast("long")).over(behind))
    last = F.col("step") == F.col("run")
    nodes = each.join(digests, "key", "left").select(
        F.col("least").alias("conv_id"),
        (F.col("depth") + F.col("step")).cast("long").alias("depth"),
        F.when(F.col("step") == 0, F.col("parent_conv")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved_here").alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return swept.select(COLUMNS).unionByName(nodes)
