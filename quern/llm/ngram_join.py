"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Two texts link when 100 * intersection >= PERCENT * union of their sets of distinct
five-word shingles. The join is exact: no link between different sets is lost.

1. Documents with the same set are one class, represented by its smallest id.
2. A link needs PERCENT of a set's shingles in the other set. In one slice of all
   hash values the shingles that a single class holds are counted; a class of
   which more than the rest is shown to be its own drops out. That bound is exact,
   whatever the slice, and most texts are done with here.
3. The sets of the others are ordered by how many of them hold a shingle, rarest
   first. Two linked sets share a shingle among the first n - ceil(P n) + 1 of each;
   such a shingle and a band of sizes are a tile. Linked sizes lie in one band or in
   two neighbours, so each set is at home in the tile of its band and a guest in
   that below. Of tiles with the same members one is kept.
4. Each set has a bitmap: the parity of its hashes at each of W places. Two bitmaps
   differ in at most as many places as the sets differ in members, so half of
   (n + m - bits that differ) bounds the overlap from above. Only pairs that pass it
   (and the bounds by size and by position) get to the exact intersection of the
   sorted arrays.
5. For components: a tile's smallest member is compared with the rest, then members of
   different components in tiles that still hold several. A first pass over their bitmaps
   tells which members have any partner that passes; only those get their sets, and a second
   pass compares them exactly where they meet and gives the links that join two components of
   a part, fewer than its members. Pairs that do not link leave the task in neither pass, so
   a group of m texts gives no more than m rows a tile. Tiles of more than TILE members or
   CELLS shingles are cut into blocks, and pairs of blocks are dealt over tasks; two blocks of
   one component never meet.

Results for odd input: a null or empty text, or one without words, has no shingles
and is linked with nothing; fewer than five words count as one shingle; all texts of
a repeated id count, and their links are that id's; a null id is a document of its
own (null component); very long texts are hashed whole; an empty table gives an empty
table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, joined, ship, sized, texts, written
from quern.llm.near_dedup import components, shingle_set

#: Link: 100 * intersection >= PERCENT * union.
PERCENT = 80

#: Share of all hash values in which shingles of a single class are counted.
SLICE_SHARE = 0.3

#: Bits of a bitmap: as many as the set has members, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 14

#: Members that are compared with each other in one step of a task.
TILE = 2048

#: Shingles of the members of a block: what a task holds of whole sets.
CELLS = 1 << 21

_SLICE_END = np.uint64(int(SLICE_SHARE * 2**64))


def set_key(shingles: np.ndarray) -> int:
    """64 bits of the digest of a whole set. Sets that share them by chance are told apart where sets are compared."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the hashes at each place; the place is the hash's low bits, so a map folds to half its width by XOR of its halves."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (len(shingles) - 1).bit_length()))
    places = (shingles & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(packed: list[bytes]) -> np.ndarray:
    """The bitmaps as rows of 64-bit words, all folded to the width of the narrowest."""
    width = min(map(len, packed))
    out = np.zeros((len(packed), width), np.uint8)
    for k, b in enumerate(packed):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def overlap(p: np.ndarray, q: np.ndarray) -> int:
    """Members that two sorted arrays of distinct values have in common."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, n_shingles, key, slice). Without shingles ``key`` is null and ``slice`` empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()), ("slice", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, cut = [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                cut.append(s[: np.searchsorted(s, _SLICE_END)].view(np.int64))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(cut, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key long, slice array<long>")


def _classes(known: DataFrame) -> DataFrame:
    """(key, id, n): each set with its smallest document."""
    return known.groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"))


def _linkable(known: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The classes that are not shown to be mostly their own."""
    held = known.select(F.explode("slice").alias("h"), "key").groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    own = held.where("low = high").groupBy(F.col("low").alias("key")).agg(F.count(F.lit(1)).alias("own"))
    rest = classes.join(own, "key", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
    return rest.drop("own")


def _sets(docs: DataFrame, rest: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, n, bits, shingles) of the classes in ``rest``: bitmap and packed set."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(sized(rest.select("id").distinct()), "id", "left_semi").select("text")
    schema = pa.schema([("key", pa.int64()), ("bits", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bits, packed = [], [], []
            for s in map(shingle_set, texts(batch.column(0))):
                if len(s):
                    keys.append(set_key(s))
                    bits.append(bitmap(s))
                    packed.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bits, pa.binary()), pa.array(packed, pa.binary())], schema=schema)

    found = rows.mapInArrow(run, "key long, bits binary, shingles binary").dropDuplicates(["key", "shingles"])
    return found.join(rest, "key").select("key", "id", "n", "bits", "shingles")


def _tiles(sets: DataFrame, percent: int) -> DataFrame:
    """(tile, home, key, id, n, place): the members of each tile that has two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            for key, at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                h = np.frombuffer(packed, np.int64)
                columns = [np.full(len(h), key), np.full(len(h), at), h, np.full(len(h), len(h))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    single = sets.select("key", "id", "shingles").mapInArrow(run, "key long, id long, h long, n long")
    often = single.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    mine = Window.partitionBy("key")
    # places count from the sets' own shingles, which come first: n - (number shared) of them
    place = F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("often", "h"))
    ranked = joined(single, often, "h").withColumn("place", place).where(f"100 * place <= {100 - percent} * n + 100")
    # a hair more than the ratio of linked sizes, so that rounding cannot put them two bands apart
    band = F.floor(F.log("n") / (math.log(100 / percent) * 1.0001))
    both = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band - 1).alias("band"), F.lit(False).alias("home"))))
    rows = ranked.withColumn("b", both).select(F.xxhash64("h", "b.band").alias("tile"), "b.home", "key", "id", "n", "place")
    rows = written(rows, "tiles")
    mark = F.xxhash64("key", "home")
    told = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("any"), F.bit_xor(mark).alias("x"), F.sum(F.shiftrightunsigned(mark, 32)).alias("s"))
    keep = told.where("m > 1 and any").groupBy("m", "x", "s").agg(F.min("tile").alias("tile")).select("tile")
    out = written(joined(rows, keep, "tile", "left_semi"), "tiles")
    discard(rows)
    return out


def _fit(x: str, y: str, percent: int):
    """Whether sizes and places of two members allow a link."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    p, q = F.col(f"place{x}"), F.col(f"place{y}")
    most = F.least(p, q) + F.least(n - p, m - q)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _stars(tiles: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b), a < b, keys: the smallest key at home in a tile against the other members."""
    centre = tiles.where("home").groupBy("tile").agg(F.min(F.struct("key", "n", "place")).alias("c"))
    rows = joined(tiles, centre.select("tile", F.col("c.key").alias("key_c"), F.col("c.n").alias("n_c"), F.col("c.place").alias("place_c")), "tile")
    rows = rows.where((F.col("key") != F.col("key_c")) & _fit("", "_c", percent))
    return rows.select(F.least("key", "key_c").alias("a"), F.greatest("key", "key_c").alias("b")).distinct()


def _passing(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates whose bitmaps allow a link."""
    bits = sets.select("key", "n", "bits")
    of = lambda x: bits.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = [int(np.bitwise_count(np.bitwise_xor(*folded([x, y]))).sum()) for x, y in zip(texts(batch.column(4)), texts(batch.column(5)), strict=True)]
            mask = pa.array((n - np.array(apart, np.int64)) * (100 + percent) >= 2 * percent * n, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, joint): the ids of the classes of the pairs (a, b) of keys that link, and the sizes of intersection and union."""
    of = lambda x: sets.select(F.col("key").alias(x), F.col("id").alias(f"id_{x}"), F.col("shingles").alias(f"of_{x}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a").select("id_a", "id_b", "of_a", "of_b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("joint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, joint = [], []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3)), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared.append(overlap(p, q))
                joint.append(len(p) + len(q) - shared[-1])
            mask = pa.array(100 * np.array(shared, np.int64) >= percent * np.array(joint, np.int64), pa.bool_())
            columns = [batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(joint, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in columns], schema=schema)

    return rows.mapInArrow(run, "a long, b long, shared long, joint long")


def _blocks(named: DataFrame, tile: int) -> DataFrame:
    """The members of mixed tiles dealt into parts (tile, part, side, ...): side 0 is compared with side 1, side 2 with itself.

    A tile of at most ``tile`` members and CELLS shingles is one part. In a larger one, blocks of
    its largest component meet the blocks of the rest, and those meet each other.
    """
    by_label = named.groupBy("tile", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    told = by_label.groupBy("tile").agg(F.sum("m").alias("m_all"), F.sum("n").alias("n_all"), F.max(F.struct("m", "label", "n")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    up = lambda m, n: F.greatest(F.ceil(m / tile), F.ceil(n / CELLS))
    m, n = F.col("top.m"), F.col("top.n")
    told = told.select("tile", up(F.col("m_all"), F.col("n_all")).alias("n_tile"), up(m, n).alias("n_major"), up(F.col("m_all") - m, F.col("n_all") - n).alias("n_rest"), F.col("top.label").alias("of_major"))
    rows = joined(named, told, "tile")
    small, mine = F.col("n_tile") == 1, F.col("label") == F.col("of_major")
    n_major, n_rest = F.col("n_major"), F.col("n_rest")
    at = F.pmod(F.xxhash64("key"), F.when(mine, n_major).otherwise(n_rest))
    seat = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"), side.cast("int").alias("side"))
    zero = F.lit(0)
    major = F.transform(F.sequence(zero, n_rest - 1), lambda j: seat(1, at, j, zero))
    with_major = F.transform(F.sequence(zero, n_major - 1), lambda i: seat(1, i, at, F.lit(1)))
    with_rest = F.transform(
        F.sequence(zero, n_rest - 1), lambda j: seat(2, F.least(at, j), F.greatest(at, j), F.when(at == j, 2).when(at < j, 0).otherwise(1))
    )
    seats = F.when(small, F.array(seat(0, zero, zero, F.lit(2)))).when(mine, major).otherwise(F.concat(with_major, with_rest))
    rows = rows.withColumn("s", F.explode(seats))
    return rows.select("tile", F.xxhash64("s.kind", "s.i", "s.j").alias("part"), F.col("s.side").alias("side"), "key", "label", "n", "place", "home")


def _met(group: pa.Table, label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j): each member of a part with those of another label whose sizes, places and bitmaps allow a link. ``label`` is read anew for each."""
    n, place, side = (group.column(c).to_numpy() for c in ("n", "place", "side"))
    home, bits = group.column("home").to_numpy(), folded(group.column("bits").to_pylist())
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1):
        j = right[(label[right] != label[i]) & (home[right] | home[i]) & ((side[right] == 1) | (right > i))]
        both = n[i] + n[j]
        most = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        j = j[(100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * most >= percent * both)]
        if len(j):
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            both = n[i] + n[j]
            j = j[(both - apart) * (100 + percent) >= 2 * percent * both]
        if len(j):
            yield i, j


def _rivals(named: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """The members (tile, key, label, n, place, home) of mixed tiles that may link with one of another label: at most all of them."""
    schema = "tile long, key long, label long, n long, place long, home boolean"

    def run(group: pa.Table) -> pa.Table:
        some = np.zeros(len(group), bool)
        for i, j in _met(group, group.column("label").to_numpy(), percent):
            some[i] = some[j] = True
        return group.select(["tile", "key", "label", "n", "place", "home"]).filter(pa.array(some))

    rows = _blocks(named, tile).join(sets.select("key", "bits"), "key")
    return rows.groupBy("tile", "part").applyInArrow(run, schema).distinct()


def _links(rivals: DataFrame, sets: DataFrame, percent: int, tile: int, forest: bool) -> DataFrame:
    """(a, b, shared, joint): the ids of classes of different labels that link, and the sizes of intersection and union.

    ``forest``: of a part's links only those that join two of its components that no link
    before them joined, fewer than it has members. What is left out links within a component.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("joint", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        label, at = group.column("label").to_numpy().copy(), group.column("id").to_numpy()
        packed = group.column("shingles").to_pylist()
        size = np.array([len(p) // 8 for p in packed])
        values, places = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
        sets_of = np.split(places.astype(np.int32), np.cumsum(size)[:-1])
        held, found = np.zeros(len(values), bool), []
        for i, j in _met(group, label, percent):
            held[sets_of[i]] = True
            shared = np.add.reduceat(held[np.concatenate([sets_of[k] for k in j])].astype(np.int64), np.cumsum(size[j]) - size[j])
            held[sets_of[i]] = False
            joint = size[i] + size[j] - shared
            ok = 100 * shared >= percent * joint
            for k, s, u in zip(j[ok], shared[ok], joint[ok], strict=True):
                if forest:
                    if label[k] == label[i]:
                        continue
                    label[label == label[k]] = label[i]
                found.append((min(at[i], at[k]), max(at[i], at[k]), s, u))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in np.array(found, np.int64).reshape(-1, 4).T], schema=schema)

    rows = _blocks(rivals, tile).join(sets.select("key", "id", "bits", "shingles"), "key")
    return rows.groupBy("tile", "part").applyInArrow(run, "a long, b long, shared long, joint long").distinct()


def _start(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written tables: prints, classes, sets of the classes that may link, and their tiles."""
    ship(docs.sparkSession)
    every = written(prints(docs, id_col, text_col), "prints")
    known = every.where("key is not null and doc_id is not null")
    classes = written(_classes(known), "classes", every.count())
    rest = written(_linkable(known, classes, percent), "rest", classes.count())
    sets = written(_sets(docs, rest, id_col, text_col), "sets")
    discard(rest)
    return every, classes, sets, _tiles(sets, percent)


def similar_pairs(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(a, b, shared, joint), a < b: every link between two different sets, by the smallest ids of their documents.

    Sizes of intersection and union come with each. ``class_members`` gives the other documents
    of a set; pairs of equal sets are not listed. Two sets of one repeated id are no pair.
    """
    every, classes, sets, tiles = _start(docs, percent, id_col, text_col)
    rivals = written(_rivals(tiles.withColumn("label", F.col("key")), sets, percent, tile), "rivals")
    out = written(_links(rivals, sets, percent, tile, forest=False).where("a != b").distinct(), "links")
    discard(every, classes, sets, tiles, rivals)
    return out


def class_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id): the smallest id with the same set; null without shingles or id."""
    ship(docs.sparkSession)
    every = written(prints(docs, id_col, text_col).drop("slice"), "prints")
    classes = _classes(every.where("key is not null and doc_id is not null")).select(F.col("key").alias("of"), "id")
    rows = every.withColumn("of", F.when(F.col("doc_id").isNotNull(), F.col("key")))
    return rows.join(classes, "of", "left").select("doc_id", "n_shingles", F.col("id").alias("class_id"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """One row a document: (doc_id, n_shingles, component_id). The result is written; the tables that led to it are removed."""
    every, classes, sets, tiles = _start(docs, percent, id_col, text_col)
    known = every.where("key is not null and doc_id is not null")
    tried = written(_stars(tiles, percent), "tried")
    links = _linked(_passing(tried, sets, percent), sets, percent).select("a", "b")
    # texts of one id belong together: their classes are linked through it
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("doc_id")
    through = known.join(several, "doc_id", "left_semi").join(classes.select("key", "id"), "key")
    links = written(links.unionByName(through.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))), "links")
    labels = components(links)
    named = tiles.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rivals = written(_rivals(named, sets, percent, tile), "rivals")
    more = written(_links(rivals, sets, percent, tile, forest=True).select("a", "b"), "links")
    held = [every, classes, sets, tiles, tried, links, rivals, more]
    if more.limit(1).count():
        # what is linked so far is a star of each component
        held.append(labels)
        labels = components(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(more))
    final = classes.join(labels, "id", "left").select("key", F.coalesce("label", "id").alias("label"))
    # documents without shingles are not dealt by the null of their key
    thin = every.select("doc_id", "n_shingles", F.col("key").isNotNull().alias("real"), F.coalesce("key", F.xxhash64("doc_id")).alias("key"))
    out = thin.join(final, "key", "left")
    label = F.when(F.col("real"), F.col("label"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(label, F.col("doc_id")))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    # a wordless text of an id that has another text as well is in that text's component
    if several.limit(1).count() or _odd_ids(every):
        low = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("low"))
        out = out.join(low, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("low", "component_id").alias("component_id"))
    out = written(out, "components")
    discard(labels, *held)
    return out


def _odd_ids(every: DataFrame) -> int:
    """Whether an id has both a text without words and one with words."""
    return every.where("doc_id is not null").groupBy("doc_id").agg(F.count("key").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 0 and k < n").limit(1).count()
