"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns. Its name is the exclusive-or of the hashes of (turn, place), twice with
different hashes (128 bits in all), so the names of a conversation's prefixes are running values along its turns.

Subtree sums go over bands of BAND depths. Within its band every node passes its value to its ancestors only, which are
found on the turns of the node's smallest member: an equi-join on (conversation, band) that makes at most BAND rows of a
node. The tops of the bands form a trie that is BAND times flatter; it is rolled up the same way, and the completed totals
of its nodes then go to their ancestors in the band above. Depth D takes log(D) / log(BAND) rounds.

Turns are numbered by running sums over ranges, so neither a conversation with many turns nor a prefix that most
conversations share gathers in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxlens.llm.running import running_sum
from fluxlens.llm.tasks import settled

BAND = 16
#: Turns that one step of the running exclusive-or takes together.
STEP = 1024
WORDS = r"[^\x20\x09-\x0D]+"
_NODE = ["node_a", "node_b"]
_ABOVE = ["above_a", "above_b"]


def numbered_turns(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, place from 1, turn_a, turn_b, n_words) in the order of turns, nulls first; ties by role and text hash.

    Null role or text is empty; turns without a conversation identifier belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_column, text_column))
    turns = conversations.select(
        F.col(id_column).cast("long").alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.xxhash64(role, text).alias("turn_a"),
        F.xxhash64(F.lit(1), text, role, F.length(role)).alias("turn_b"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"),
        F.lit(1).cast("long").alias("one"),
    ).where(F.col("conv_id").isNotNull())
    return running_sum(settled(turns), ["conv_id"], ["turn", "turn_a", "turn_b"], {"place": "one"}).drop("one", "turn")


def shared_openings(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Turns of conversations rebuilt so that many open alike.

    The first h turns of conversation c come from conversation c - c % block, h = crc32(c) % most, followed by its own turns
    after its first h. A conversation without turns of either kind has one row of place 0, as every conversation has.
    """
    c = F.col("conv_id")
    convs = turns.select("conv_id").distinct()
    convs = convs.withColumns({"base": c - c % block, "borrowed": F.crc32(c.cast("string").cast("binary")) % most})
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    lent = convs.join(heads, "base").where("place <= borrowed").select("conv_id", "place", "turn_a", "turn_b", "n_words")
    found = lent.groupBy("conv_id").agg(F.count("*").alias("found"))
    lengths = convs.join(found, "conv_id", "left").select("conv_id", "borrowed", F.coalesce("found", F.lit(0)).alias("found"))
    own = turns.join(lengths, "conv_id").where("place > borrowed").withColumn("place", F.col("place") - F.col("borrowed") + F.col("found"))
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("place"), zero.alias("turn_a"), zero.alias("turn_b"), zero.alias("n_words"))
    return lent.unionByName(own.select(*lent.columns)).unionByName(roots)


def with_roots(turns: DataFrame) -> DataFrame:
    """The turns as they are, and a row of place 0 for each conversation."""
    zero = F.lit(0).cast("long")
    return turns.unionByName(turns.select("conv_id").distinct().select("conv_id", zero.alias("place"), zero.alias("turn_a"), zero.alias("turn_b"), zero.alias("n_words")))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, node above, n_words, last) for every prefix of every conversation, the textless one included."""
    placed = turns.select(
        "conv_id",
        F.col("place").alias("depth"),
        "n_words",
        (F.col("place") / STEP).cast("long").alias("_step"),
        F.when(F.col("place") == 0, 0).otherwise(F.xxhash64("turn_a", "place", F.lit(2), "turn_b")).cast("long").alias("_a"),
        F.when(F.col("place") == 0, 0).otherwise(F.xxhash64(F.lit(3), "place", "turn_b", "turn_a")).cast("long").alias("_b"),
    )
    steps = placed.groupBy("conv_id", "_step").agg(F.bit_xor("_a").alias("_sa"), F.bit_xor("_b").alias("_sb"), F.max("depth").alias("_end"))
    earlier = W.partitionBy("conv_id").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    starts = steps.select(
        "conv_id", "_step",
        *[F.coalesce(F.bit_xor(s).over(earlier), zero).alias(f"{s}0") for s in ("_sa", "_sb")],
        F.max("_end").over(W.partitionBy("conv_id")).alias("_end"),
    )
    inside = W.partitionBy("conv_id", "_step").orderBy("depth").rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = placed.withColumns({"_pa": F.bit_xor("_a").over(inside), "_pb": F.bit_xor("_b").over(inside)}).join(starts, ["conv_id", "_step"])
    node_a, node_b = (F.col(p).bitwiseXOR(F.col(s)) for p, s in (("_pa", "_sa0"), ("_pb", "_sb0")))
    return walked.select(
        "conv_id", "depth", "n_words", (F.col("depth") == F.col("_end")).alias("last"),
        node_a.alias("node_a"), node_b.alias("node_b"),
        node_a.bitwiseXOR(F.col("_a")).alias("above_a"), node_b.bitwiseXOR(F.col("_b")).alias("above_b"),
    )


def _sums(values: Sequence[str]) -> list[Column]:
    return [F.sum(v).alias(v) for v in values]


def subtree_sums(rows: DataFrame, nodes: DataFrame, values: Sequence[str], deepest: int, band: int = BAND) -> DataFrame:
    """(node, values): each value summed over the node's subtree.

    `rows` holds (conv_id, depth, node) for all prefixes, `nodes` one (conv_id, depth, node, values) for each node, conv_id
    being one of its members whose turns are in `rows`; `deepest` is the largest depth.
    """
    level = F.col("depth") % band
    paths = rows.select("conv_id", (F.col("depth") / band).cast("long").alias("band"), level.alias("high"), *_NODE)
    giving = nodes.select("conv_id", (F.col("depth") / band).cast("long").alias("band"), level.alias("low"), *values)
    within = paths.join(giving, ["conv_id", "band"]).where("high <= low").groupBy(*_NODE).agg(*_sums(values))
    if deepest < band:
        return within
    within = settled(within)
    tops = nodes.where(level == 0).drop(*values).join(within, _NODE)
    flat = tops.withColumn("depth", (F.col("depth") / band).cast("long"))
    totals = subtree_sums(rows.where(level == 0).withColumn("depth", (F.col("depth") / band).cast("long")), flat, values, deepest // band, band)
    below = tops.where("depth > 0").drop(*values).join(totals, _NODE)
    upward = below.select("conv_id", (F.col("depth") / band - 1).cast("long").alias("band"), *values)
    handed = paths.join(upward, ["conv_id", "band"]).select(*_NODE, *values)
    return within.unionByName(handed).groupBy(*_NODE).agg(*_sums(values))


def _lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of sorted (node, conv_id) rows as comma-joined text, one row for a node and batch."""
    for batch in batches:
        a, b, ids = (batch.column(c).to_pylist() for c in ("node_a", "node_b", "conv_id"))
        marks = [i for i in range(len(ids)) if i == 0 or a[i] != a[i - 1] or b[i] != b[i - 1]] + [len(ids)]
        out = [(a[s], b[s], ids[s], ",".join(map(str, ids[s:e]))) for s, e in zip(marks[:-1], marks[1:], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], ["node_a", "node_b", "first", "ids"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in order, fed piece by piece."""
    node, digest = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([digest.hexdigest()])], ["node_a", "node_b", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("node_a", "node_b", "ids")), strict=True):
            if node == (a, b):
                digest.update(b",")
            else:
                if node is not None:
                    yield row()
                node, digest = (a, b), hashlib.sha256()
            digest.update(ids.encode())
    if node is not None:
        yield row()


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at a node.

    Identifiers are sorted and joined in many tasks, whatever a node's share; a digest reads its node's pieces one after
    another, as SHA-256 must, and holds one piece at a time.
    """
    ends = rows.where("last").select(*_NODE, "conv_id")
    texts = (
        ends.repartitionByRange(*_NODE, "conv_id")
        .sortWithinPartitions(*_NODE, "conv_id")
        .mapInArrow(_lists, "node_a long, node_b long, first long, ids string")
    )
    return texts.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "node_a long, node_b long, ends_sha256 string")


def trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row for each node of the trie of `turns` (conv_id, place, turn_a, turn_b, n_words; a row of place 0 for each conversation).

    conv_id is the smallest member, parent_conv_id the parent's (null at the root), n_convs the number of members,
    n_children of children, n_leaves of childless nodes in the subtree; saved_tokens sums (n_convs - 1) * words of the last
    text over the subtree, and ends_sha256 is of the members that end at the node, joined by commas in ascending order.
    No conversation, no row.
    """
    rows = settled(prefixes(turns))
    nodes = settled(
        rows.groupBy(*_NODE, "depth").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_words").alias("n_words"),
            F.min("above_a").alias("above_a"), F.min("above_b").alias("above_b"),
        )
    )
    inner = nodes.where("depth > 0")
    families = inner.groupBy(*_ABOVE).agg(F.count("*").alias("n_children")).select(F.col("above_a").alias("node_a"), F.col("above_b").alias("node_b"), "n_children")
    named = settled(nodes.join(families, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    own = named.select(
        "conv_id", "depth", *_NODE,
        (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens"),
    )
    deepest = own.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(rows.select("conv_id", "depth", *_NODE), own, ["n_leaves", "saved_tokens"], deepest, band)
    parents = named.select(F.col("node_a").alias("above_a"), F.col("node_b").alias("above_b"), F.col("conv_id").alias("parent_conv_id"), (F.col("depth") + 1).alias("depth"))
    return (
        named.join(parents, [*_ABOVE, "depth"], "left")
        .join(sums, _NODE)
        .join(end_digests(rows), _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def conversation_trie(conversations: DataFrame, rebuild: bool = False, band: int = BAND, **columns: str) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text; other names by keyword, see `numbered_turns`).

    Turns are ordered by `turn`, null first, equal ones in an order that follows from role and text; null role or text is
    empty, a null identifier no conversation; repeated rows are turns of their own, and other columns are not read.
    `rebuild` first lets conversations share openings (`shared_openings`). An empty table gives no rows.
    """
    turns = numbered_turns(conversations, **columns)
    return trie(shared_openings(settled(turns)) if rebuild else with_roots(turns), band)
