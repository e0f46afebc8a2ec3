"""Conversation prefix trie: hash-partitioned by first turn, pointer dictionary tries in tasks.

1. Turns are put in order by a range exchange, so that one conversation with most of
   the rows is dealt over many tasks: a turn's place is its row in its part plus the
   rows of the parts before.
2. Each prefix has a 128-bit key: the XOR of two hashes of (place, digest of the turn)
   over its turns. It is a running window over chunks of CHUNK turns; the chunks' totals
   are carried over. So a prefix's parent is known from its key and its last turn alone.
3. Prefixes of one conversation only need no trie: below the last shared prefix a
   conversation is a single path. Counts, children and private tails of the shared ones
   come from aggregations that combine before the shuffle.
4. Shared prefixes are partitioned by their first turn and each group's trie is built of
   pointers in ``applyInPandas``; an iterative postorder sums leaves and saved tokens. A
   group of more than ``most`` nodes is cut: its upper levels, as many as fit, are one
   piece, what is below is partitioned anew by the next turns, again and again. Pieces
   are summed from the lowest up; a piece's root hands its sums to the piece above.
5. The ids of conversations that end at a shared prefix stream through SHA-256 in order;
   no list of them is held.

Results for odd input: rows of a null conversation are left out; turns of equal number
are ordered by role, then text; null role or text counts as empty; repeated rows are
turns of their own; below zero a block begins at a multiple of its size, too; an empty table gives an empty table (no root); very long texts and
conversations are not cut; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, joined, ship, sized, written

#: Nodes of a piece that one task builds a trie of.
MOST_NODES = 100_000

#: Turns over which prefix keys are summed before totals are carried over.
CHUNK = 1024

#: Levels that a cut may take at once: powers of two up to this one.
CUTS = 20

KEY = ["p1", "p2"]
UP = ["q1", "q2"]

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def ordered_turns(rows: DataFrame) -> DataFrame:
    """(conv, pos, digest, words) of the turns of conversations, ``pos`` from 0. The result is written."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    by = ["conv", F.col("turn").asc_nulls_first(), "role"]
    dealt = rows.withColumn("start", F.substring("text", 1, 64)).repartitionByRange(*by, "start").sortWithinPartitions(*by, "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    # the number of a row rises in its part, whose number are the upper bits
    seq = F.monotonically_increasing_id()
    rows = written(dealt.select("conv", digest.alias("digest"), words.alias("words"), seq.alias("seq")).withColumn("part", F.shiftright("seq", 33)), "turns")
    parts = written(rows.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")), "parts")
    several = parts.groupBy("conv").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("conv")
    # at most two conversations a part are cut, so this table is as small as there are parts
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.join(several, "conv", "left_semi").withColumn("offset", F.coalesce(before, F.lit(0))).select("conv", "part", "offset")
    starts = parts.select("conv", "part", "first").join(sized(offsets), ["conv", "part"], "left")
    placed = rows.join(starts, ["conv", "part"]).select("conv", (F.col("seq") - F.col("first") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "words")
    out = written(placed, "placed")
    discard(rows, parts)
    return out


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv, length), turns (conv, depth, digest, words, length)) with the heads of each block's first conversation.

    A conversation starts with the first h turns of the first of its ``block``, h being the checksum of
    its id modulo ``heads``, and goes on with its own turns after its first h. Both are written.
    """
    own = written(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "sizes")
    told = own.withColumn("h", F.crc32(F.col("conv").cast("string")) % heads).withColumn("base", F.col("conv") - F.pmod(F.col("conv"), F.lit(block)))
    bases = own.select(F.col("conv").alias("base"), F.col("own").alias("of_base"))
    told = told.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("of_base", F.lit(0))))
    length = F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    told = written(told.select("conv", "base", "h", "k", length.alias("length")), "conversations")
    tail = joined(turns, told.select("conv", "h", "k", "length"), "conv").where("pos >= h")
    tail = tail.select("conv", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "digest", "words", "length")
    first = turns.where(F.col("pos") < heads - 1).select(F.col("conv").alias("base"), "pos", "digest", "words")
    head = first.join(told, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "digest", "words", "length")
    out = written(tail.unionByName(head), "rebuilt")
    discard(own)
    return told, out


def paths(turns: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, q1, q2, words, last): the key of each prefix and that of its parent. Written."""
    step = [F.xxhash64("depth", "digest"), F.xxhash64(F.lit(11), "digest", "depth")]
    rows = turns.select("conv", "depth", "words", (F.col("depth") == F.col("length")).alias("last"), step[0].alias("x1"), step[1].alias("x2"))
    rows = rows.withColumn("chunk", F.floor((F.col("depth") - 1) / CHUNK))
    by = Window.partitionBy("conv", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = [F.bit_xor(f"x{k}").over(by).alias(f"in{k}") for k in (1, 2)]
    rows = written(rows.select("*", *inside), "inside")
    ends = rows.where(f"depth % {CHUNK} = 0").select("conv", (F.col("chunk") + 1).alias("chunk"), "in1", "in2")
    upto = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.select("conv", "chunk", *[F.bit_xor(f"in{k}").over(upto).alias(f"c{k}") for k in (1, 2)])
    rows_long = rows.where("chunk > 0").join(carry, ["conv", "chunk"])
    flat = rows.where("chunk = 0").withColumn("c1", F.lit(0).cast("long")).withColumn("c2", F.lit(0).cast("long")).unionByName(rows_long)
    key = [F.col(f"in{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2)]
    out = flat.select(
        "conv", "depth", *[key[k].alias(KEY[k]) for k in (0, 1)], *[key[k].bitwiseXOR(F.col(f"x{k + 1}")).alias(UP[k]) for k in (0, 1)], "words", "last"
    )
    out = written(out, "paths")
    discard(rows)
    return out


def _keyed(rows: DataFrame, keyed: DataFrame, at: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined on the key in columns ``at`` with ``keyed`` (p1, p2, ...), both dealt anew, so that a hot key is split."""
    left = rows.withColumn("__a", F.bitwise_not(F.col(at[0]))).withColumn("__b", F.col(at[1]))
    right = keyed.withColumn("__a", F.bitwise_not(F.col("p1"))).withColumnRenamed("p2", "__b").drop("p1")
    return left.join(right, ["__a", "__b"], how).drop("__a", "__b")


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """One piece: a dictionary of nodes with pointers to their children, summed up in postorder without recursion."""
    keys = list(zip(group["p1"].tolist(), group["p2"].tolist(), strict=True))
    at = {k: i for i, k in enumerate(keys)}
    children: dict[int, list[int]] = {}
    roots = []
    for i, up in enumerate(zip(group["q1"].tolist(), group["q2"].tolist(), strict=True)):
        parent = at.get(up)
        if parent is None:
            roots.append(i)
        else:
            children.setdefault(parent, []).append(i)
    leaves, saved = group["leaves"].tolist(), group["saved"].tolist()
    top = np.zeros(len(keys), bool)
    top[roots] = True
    stack = [(r, False) for r in roots]
    while stack:
        i, done = stack.pop()
        below = children.get(i, ())
        if done or not below:
            for c in below:
                leaves[i] += leaves[c]
                saved[i] += saved[c]
        else:
            stack.append((i, True))
            stack.extend((c, False) for c in below)
    return group[[*KEY, *UP]].assign(n_leaves=leaves, saved_tokens=saved, top=top)


def _pieces(shared: DataFrame, every: DataFrame, most: int) -> list[DataFrame]:
    """Tables of nodes with the key (a1, a2) of their piece, upper pieces first: each piece has ``most`` nodes or less."""
    anchor = every.select(F.col("conv"), F.col("depth").alias("cut"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    rest = shared.withColumn("cut", F.lit(1).cast("long")).join(anchor, ["conv", "cut"])
    out = []
    while True:
        rest = written(rest, "pieces")
        by_cut = [F.count(F.when(F.col("depth") < F.col("cut") + 2**k, 1)).alias(f"m{k}") for k in range(CUTS)]
        told = rest.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("m"), *by_cut).where(F.col("m") > most)
        fits = F.greatest(*[F.when(F.col(f"m{k}") <= most, 2**k).otherwise(1) for k in range(CUTS)]).cast("long")
        told = written(told.select(F.col("a1").alias("p1"), F.col("a2").alias("p2"), fits.alias("levels")), "large")
        if not told.limit(1).count():
            discard(told)
            return [*out, rest]
        marked = _keyed(rest, told, ["a1", "a2"])
        lower = F.col("levels").isNotNull() & (F.col("depth") >= F.col("cut") + F.col("levels"))
        out.append(marked.where(~lower).drop("levels"))
        low = marked.where(lower).withColumn("cut", F.col("cut") + F.col("levels")).drop("levels", "a1", "a2")
        rest = low.join(anchor, ["conv", "cut"])


def subtree_sums(shared: DataFrame, every: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(p1, p2, n_leaves, saved_tokens) of the shared nodes (p1, p2, q1, q2, conv, depth, leaves, saved), summed over subtrees."""
    schema = "p1 long, p2 long, q1 long, q2 long, n_leaves long, saved_tokens long, top boolean"
    done: DataFrame | None = None
    above: DataFrame | None = None
    for piece in reversed(_pieces(shared, every, most)):
        rows = piece.select("a1", "a2", *KEY, *UP, "leaves", "saved")
        if above is not None:
            given = above.where("top").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            zero = F.lit(0)
            rows = _keyed(rows, given, KEY).withColumn("leaves", F.col("leaves") + F.coalesce("l", zero)).withColumn("saved", F.col("saved") + F.coalesce("s", zero)).drop("l", "s")
        above = written(rows.groupBy("a1", "a2").applyInPandas(_summed, schema), "sums")
        done = above if done is None else done.unionByName(above)
    return done.select(*KEY, "n_leaves", "saved_tokens")


def end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of rows (p1, p2, conv): the ids of a key in order, streamed through one digest."""
    schema = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            p1, p2, conv = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero(np.r_[True, (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])][: len(p1)])
            out = []
            for lo, hi in zip(cut, np.r_[cut[1:], len(p1)], strict=True):
                ids = ",".join(map(str, conv[lo:hi].tolist())).encode()
                own = (int(p1[lo]), int(p2[lo]))
                if own == key:
                    digest.update(b"," + ids)
                    continue
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(3)], schema=schema)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], schema.field(k).type) for k, v in enumerate((*key, digest.hexdigest()))], schema=schema)

    rows = ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return rows.mapInArrow(run, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4, most: int = MOST_NODES) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). Written."""
    ship(conversations.sparkSession)
    turns = ordered_turns(conversations)
    told, whole = rebuilt(turns, block, heads)
    every = paths(whole)
    discard(turns, whole)
    n_all, least = told.agg(F.count(F.lit(1)), F.min("conv")).first()
    nodes = every.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("last").alias("last"), *[F.max(q).alias(q) for q in UP]
    )
    nodes = written(nodes, "nodes")
    kids = nodes.where("depth > 1").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n") == 1, 1)).alias("tails"))
    zero = F.lit(0).cast("long")
    shared = _keyed(nodes.where("n > 1"), kids, KEY).withColumn("n_children", F.coalesce("n_children", zero)).withColumn("tails", F.coalesce("tails", zero))
    shared = written(shared, "shared")
    begun = shared.select(
        *KEY, *UP, "conv", "depth", (F.col("tails") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")
    )
    sums = written(subtree_sums(begun, every, most), "subtrees")
    # what ends at a prefix of one conversation is that conversation
    ends = every.where("last").select(*KEY, "conv").join(shared.where("last").select(*KEY), KEY, "left_semi")
    of_root = told.where("length = 0").select(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"), "conv")
    digests = written(end_digests(ends.unionByName(of_root)), "ends")
    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.coalesce("up", "conv"))
    above = shared.select(*KEY, F.col("conv").alias("up"))
    alone = F.sha2(F.when(F.col("last"), F.col("conv").cast("string")).otherwise(""), 256)
    base = [F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs")]
    private = _keyed(nodes.where("n = 1"), above, UP).select(
        *base, F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), alone.alias("ends_sha256")
    )
    with_sums = shared.join(sums, KEY).join(digests, KEY, "left")
    common = _keyed(with_sums, above, UP).select(*base, "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    out = written(private.unionByName(common), "trie")
    # the root: over the nodes of the first turns
    top = out.where("depth = 1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n_leaves"), zero), F.coalesce(F.sum("saved_tokens"), zero)).first()
    ending = digests.where("p1 = 0 and p2 = 0").select("ends_sha256").first()
    root = [(least, 0, None, n_all, top[0], top[1] or 1, top[2], ending[0] if ending else EMPTY_SHA)] if n_all else []
    discard(told, every, nodes, shared, sums, digests)
    return out.unionByName(conversations.sparkSession.createDataFrame(root, out.schema))
