"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Each document's distinct five-word shingles are hashed once; the top bits
   choose one of BINS bins and each bin keeps its least value. Empty bins are
   filled by optimal densification: a fixed random sequence of other bins is
   tried for each bin until one holds a value.
2. Documents with the same shingle set are one class (the digest of the whole
   set). Each class gets a number of its own; from here on only classes are looked
   at, so an id that several different texts share takes part with each of them.
3. The signature is cut into BANDS bands of ROWS values: two documents with
   similarity 0.75 share no band with probability (1 - 0.75^4)^32 < 6e-6.
4. In each bucket the class with the smallest number is the centre of a
   star; the bucket's other members are compared with it alone, so a bucket of
   n members gives n - 1 candidates and not n^2 / 2.
5. Candidates are confirmed on the full sets. Confirmed links give components
   (label propagation over written tables).
6. What a star can miss are links between two members that do not link with
   the centre. The documents of buckets that still hold several components are
   looked at again, in buckets of their rarest shingles (``rare_buckets``, an exact
   filter that a passage common to thousands of documents does not fill): first
   the smallest members of each component with one another, then, when that finds no
   more, each of them against the members of the others, then all members of different
   components. Within a component
   nothing is compared again. It ends when no new link joins two components, so
   every link between documents that share a bucket counts.

Results for odd input: a null or empty text, or one without words, has no
shingles, is linked with nothing and kept; fewer than five words count as one
shingle; repeated ids have their component in common, whatever their texts; a null id is a document of
its own (null component, kept); very long texts are hashed whole; an empty table
gives an empty table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, joined, ship, sized, texts, written

WORDS = 5
#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 75

BINS = 128
ROWS = 4
BANDS = BINS // ROWS

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)
_MIX3 = np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX2
    h = (h ^ (h >> np.uint64(27))) * _MIX3
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text; ASCII letters are lower-cased."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    n = len(found) - words + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(words):
            h = _mixed(h * _MIX + one[k : k + n])
    return np.unique(h)


def _donors(bins: int, seed: int = 11) -> np.ndarray:
    """For each bin, the bins that it is filled from, in the order tried: a fixed permutation."""
    rng = np.random.default_rng(seed)
    return np.array([rng.permutation(bins) for _ in range(bins)])


_DONORS = _donors(BINS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set."""
    shift = np.uint64(64 - BINS.bit_length() + 1)
    bins = (shingles >> shift).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    full = np.zeros(BINS, bool)
    full[bins] = True
    out = np.zeros(BINS, np.uint64)
    out[full] = shingles[first[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        donor = _DONORS[empty]
        pick = donor[np.arange(len(empty)), full[donor].argmax(1)]
        out[empty] = out[pick]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = sig.reshape(-1, rows)
    h = np.arange(1, len(parts) + 1, dtype=np.uint64) * _MIX
    with np.errstate(over="ignore"):
        for k in range(rows):
            h = _mixed(h * _MIX + parts[:, k])
    return h.astype(np.int64, casting="unsafe")


def _set_key(packed: bytes) -> bytes | None:
    """The digest of a packed set; null without shingles."""
    return hashlib.blake2b(packed, digest_size=16).digest() if packed else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_shingles, set_key, bands). ``set_key`` is null and ``bands`` empty without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands = [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text)
                sizes.append(len(s))
                keys.append(_set_key(s.tobytes()))
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, shingles): the packed set of each class in ``nodes`` (id, doc_id, set_key), from a row of its id that has this set."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(sized(nodes.select("doc_id").distinct()), "doc_id", "left_semi")
    schema = pa.schema([("doc_id", pa.int64()), ("set_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [shingle_set(t).tobytes() for t in texts(batch.column(1))]
            keys = [_set_key(p) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], schema=schema)

    found = rows.mapInArrow(run, "doc_id long, set_key binary, shingles binary").dropDuplicates(["doc_id", "set_key"])
    return found.join(nodes, ["doc_id", "set_key"]).select("id", "shingles")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(small) < PERCENT * len(large) or not len(small):
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def _fingerprint(edges: DataFrame) -> tuple:
    """Three numbers that differ whenever the sets of edges do, but for a chance of about 2^-64."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).first())


def _stars_of_stars(edges: DataFrame) -> DataFrame:
    """The edges (u, v), u > v, after a large-star and a small-star step."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # large star: larger neighbours go to the smallest one
    large = joined(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    # small star: a node and its smaller neighbours go to the smallest one
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(id, label): the smallest id that each linked id can reach. ``most``: links there can be, where that is known.

    Large-star and small-star steps in turn: each node hooks its neighbours to
    the smallest label it sees, which halves the depth of the trees; every round
    is written to the shared folder, so no lineage grows and nothing is collected.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = written(edges, "edges", most)
    mark = _fingerprint(edges)
    while True:
        after = written(_stars_of_stars(edges), "edges", 2 * mark[0])
        discard(edges)
        edges, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    out = written(edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots), "labels", 2 * mark[0])
    discard(edges)
    return out


def _stars(members: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of bucket members (bucket, id): the smallest id against the rest."""
    centre = members.groupBy("bucket").agg(F.min("id").alias("a"))
    return joined(members, centre, "bucket").where("id != a").select("a", F.col("id").alias("b")).distinct()


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """The buckets that hold several labels."""
    return members.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")


def _band(n: Column) -> Column:
    """A number that grows with a size; linked sizes are in the same band or in neighbouring ones."""
    return F.floor(F.log(n) / F.log(F.lit(100.0 / PERCENT)))


def _across(members: DataFrame, whole: bool, tried: DataFrame, few: bool = False) -> DataFrame:
    """Candidate pairs between components that share a rare shingle, of members (bucket, id, n, place, label), without those in ``tried``.

    Not ``whole``: one member of each component in the bucket against the members
    of the others, or with ``few`` against one of each. ``whole``: all members of different components. The component
    with the most members in a bucket stands on one side alone: every pair that is
    asked for has a member of another one, and what is enumerated is at most twice
    what is asked for. The smaller set of a pair needs the shingle among its first
    n - ceil(6n/7) + 1, sizes must fit (they are part of the key), and what can still
    follow in both orders must reach the overlap that 0.75 asks for: the exact
    length, prefix and position filters of a set-similarity join.
    """
    row = ["n", "place", "id"]
    held = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("held"))
    top = held.groupBy("bucket").agg(F.max(F.struct("held", "label"))["label"].alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    inside = joined(members, top.select("bucket", "top"), "bucket")
    one = lambda df: df.groupBy("bucket", "label", "top").agg(F.min(F.struct(*row)).alias("m")).select("bucket", "label", "top", *[f"m.{c}" for c in row])
    if few:
        inside = one(inside)
    left = inside.where("label != top")
    if not whole and not few:
        left = one(left)
    left = left.select("bucket", F.col("label").alias("of_x"), *[F.col(c).alias(f"{c}_x") for c in row])
    sizes = F.sequence(_band(F.ceil(F.col("n_x") * PERCENT / 100)), _band(F.floor(F.col("n_x") * 100 / PERCENT)))
    key = lambda band: F.xxhash64("bucket", band)
    left = left.withColumn("band", F.explode(sizes)).withColumn("tile", key(F.col("band"))).drop("band")
    right = inside.withColumn("tile", key(_band(F.col("n")))).withColumnRenamed("bucket", "bucket_y")
    # of two members that are both on both sides one order is enough
    first = (F.col("n_x") < F.col("n")) | ((F.col("n_x") == F.col("n")) & (F.col("id_x") < F.col("id")))
    once = (F.col("label") == F.col("top")) | first if whole or few else F.lit(True)
    small, large = F.least("n_x", "n"), F.greatest("n_x", "n")
    place = F.when(F.col("n_x") < F.col("n"), F.col("place_x")).when(F.col("n_x") > F.col("n"), F.col("place")).otherwise(F.least("place_x", "place"))
    fit = (
        (F.col("bucket") == F.col("bucket_y"))
        & (F.col("label") != F.col("of_x"))
        & (100 * small >= PERCENT * large)
        & (7 * place <= small + 7)
        & ((100 + PERCENT) * (1 + F.least(F.col("n_x") - F.col("place_x"), F.col("n") - F.col("place"))) >= PERCENT * (F.col("n_x") + F.col("n")))
        & once
    )
    pairs = joined(right, left, "tile").where(fit)
    pairs = pairs.select(F.least("id_x", "id").alias("a"), F.greatest("id_x", "id").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def _same_ids(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of an id that stands beside several different texts: a star for each such id. None without such ids."""
    twice = known.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high").select("doc_id")
    if not twice.limit(1).count():
        return None
    rows = known.select("doc_id", "set_key").join(sized(twice), "doc_id", "left_semi").distinct()
    named = written(rows.join(classes.select("set_key", "id"), "set_key").select("doc_id", "id"), "named")
    first = named.groupBy("doc_id").agg(F.min("id").alias("a"))
    out = written(joined(named, first, "doc_id").where("id != a").select("a", F.col("id").alias("b")), "same")
    discard(named)
    return out


def rare_buckets(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(bucket, id, n, place): the rarest shingles of the sets of ``ids``, enough of them that any two linked sets share one.

    In one order of all shingles (rarest first), two sets with similarity 0.75
    share a shingle among the first n - ceil(0.75 n) + 1 of each. Shingles of a
    single set come first and can be shared with none, so a document of which
    more than a quarter is its own drops out whole, whatever passage it has in
    common with thousands of others.
    """
    rows = sets.join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("n", pa.int32())])
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                h = np.frombuffer(packed, np.int64)
                columns = [pa.array(np.full(len(h), at)), pa.array(h), pa.array(np.full(len(h), len(h), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    single = rows.select("id", "shingles").mapInArrow(run, "id long, h long, n int")
    often = single.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = joined(single, often, "h")
    mine = Window.partitionBy("id")
    place = F.row_number().over(mine.orderBy("often", "h"))
    # places count from the sets' own shingles, which come first: n - (number shared) of them
    ranked = shared.withColumn("place", F.col("n") - F.count(F.lit(1)).over(mine) + place)
    out = ranked.where(f"100 * place <= {100 - PERCENT} * n + 100")
    return out.select(F.col("h").alias("bucket"), "id", F.col("n").cast("long").alias("n"), F.col("place").cast("long").alias("place"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id, kept). The result is written; the tables that led to it are removed."""
    ship(docs.sparkSession)
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    known = prints.where("set_key is not null and doc_id is not null")
    n_docs, n_hashes = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    # the numbers of the classes are fixed by being written
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id())
    classes = written(classes, "classes", n_docs)
    # on key and id, not on the key alone: a class may hold a third of all rows
    reps = known.join(classes, ["set_key", "doc_id"]).dropDuplicates(["id"])
    everyone = reps.select(F.explode("bands").alias("bucket"), "id")
    crowded = everyone.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = written(joined(everyone, crowded, "bucket", "left_semi"), "members", BANDS * classes.count())
    n_members = members.count()
    nodes = written(classes.join(members.select("id").distinct(), "id", "left_semi"), "nodes", n_docs)
    sets = written(shingle_sets(docs, nodes, id_col, text_col), "sets", n_hashes)
    tried = written(_stars(members), "tried", n_members)
    same = _same_ids(known, classes)
    links = confirmed(tried, sets)
    links = written(links if same is None else links.unionByName(same), "links", n_hashes)
    n_links = links.count()
    labels = components(links, n_links)
    named = members.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    rest = joined(named, _mixed_buckets(named), "bucket", "left_semi").select("id").distinct()
    rare = written(rare_buckets(sets, rest), "rare", n_hashes)
    n_rare = rare.count()
    held = [prints, classes, members, nodes, sets, rare, tried, links]
    if same is not None:
        held.append(same)
    # the smallest members of components, each of them against all members, all against all
    step = 0
    while step < 3:
        named = rare.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        fresh = written(_across(named, step == 2, tried, few=step == 0), "tried", n_rare)
        more = written(confirmed(fresh, sets), "links", n_hashes)
        held += [fresh, more]
        tried = tried.unionByName(fresh)
        found = more.count()
        if found:
            # what is linked so far is a star of each component
            known = labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more)
            n_links, before, step = n_links + found, labels, 0
            labels = components(known, 2 * n_links)
            discard(before)
        else:
            step += 1
    # a component is named after its smallest id
    linked = classes.join(labels, "id")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"))
    linked = joined(linked, least, "label").select("id", "least")
    final = classes.join(linked, "id", "left").select("set_key", F.coalesce("least", "doc_id").alias("label"))
    # documents without shingles are not dealt by the null of their key
    thin = prints.select("doc_id", "n_shingles", F.coalesce("set_key", F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("set_key"))
    out = thin.join(final, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "doc_id"))
    out = out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
    out = written(out, "components", n_docs)
    discard(labels, *held)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns.

    Rows that repeat an id are reduced to one, that of the smallest text. Rows with a null id all stay.
    """
    found = near_components(docs, id_col, text_col)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(sized(gone), docs[id_col].cast("long") == gone["__gone"], "left_anti")
    twice = found.where("doc_id is not null and kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.limit(1).count():
        ids = sized(twice.select(F.col("doc_id").alias("__twice")))
        on = F.col(id_col).cast("long") == F.col("__twice")
        first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in kept.columns]), F.coalesce(text_col, F.lit("")))
        named = kept.join(ids, on, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(first.alias("__row")).select("__row.*")
        kept = kept.join(ids, on, "left_anti").unionByName(named)
    return kept
