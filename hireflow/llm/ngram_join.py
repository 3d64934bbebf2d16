"""N-gram Jaccard join of documents: size-aware, heavy and light.

Each document is its set of distinct word shingles. With J >= t a set of s
shingles misses at most ``s - ceil(t s)`` of them in any partner, so among its
rarest ones both partners must agree on a few. Sets are split by size:

* small sets enumerate all ``SUBSET``-subsets of their rarest shingles; a subset is
  one join key, so two small sets meet only if they agree on all of it;
* large sets scan inverted lists: each of their rarest shingles is a key, and the
  lists also index the small sets that are near enough in size.

The boundary minimises the rows that both ways would read, from the histogram of
set sizes and the mean length of an inverted list. Rarity is the number of
documents that hold any shingle of the same hash bucket, counted over the whole
table into a fixed number of buckets, so the table that tasks get has a fixed size.

Equal sets are one node, so a group of copies is one set. In each list one set,
the one nearest to what all share, is compared with all others; after that only pairs from
different components are left, and all of those are decided. Most are by parity maps: the
parity of a set's shingles in each of 512 hash classes. Two maps differ in no more bits than
the sets have shingles not in common, so a pair whose maps differ in too many bits has no
link and is never made. No link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, flag_table, row_key, width
from .components import components
from .prefix_filter import WORDS, fits, may_share_enough, share_enough, with_marks
from .textkit import SLICE_BYTES, by_rarity, rarity_classes, slices, word_shingles

BUCKETS = 1 << 24            # hash buckets that shingles are counted in, a byte each in the tasks
BLOCK = 1 << 16              # buckets whose counts travel as one value
FLAGS = 1 << 22              # flags that tell tasks which texts may be asked for
SUBSET = 2
LARGEST_BOUNDARY = 1000      # sizes that the search for the boundary looks at
PARITY = 8                   # 64-bit words of a set's parity map
TEXT = SLICE_BYTES // 4      # text handled at once beside a table of BUCKETS
SKETCH = 1024                # least hashes kept to estimate how many distinct shingles there are


def _set_ids(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and a 128-bit name (two order-free sums of mixed hashes) of each document's set."""
    size = np.bincount(doc, minlength=n)
    stop = np.cumsum(size)
    names = []
    for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        h = (key ^ (key >> np.uint64(29))) * np.uint64(mult)
        h ^= h >> np.uint64(32)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)])
        names.append((total[stop] - total[stop - size]).view(np.int64))
    return size, names[0], names[1]


def _parity(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """For each set, PARITY words: bit c is the parity of its shingles of hash class c."""
    bits = 64 * PARITY
    h = (key ^ (key >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    cell = doc * bits + (h >> np.uint64(33)).astype(np.int64) % bits
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the sets of rows ``x`` and ``y`` can link: the bits in which their parity maps
    differ are the least number of shingles that only one of them has."""
    apart = sum((F.bit_count(F.col(f"{x}.odd{i}").bitwiseXOR(F.col(f"{y}.odd{i}"))) for i in range(PARITY)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col(f"{x}.size") + F.col(f"{y}.size"))


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text"), TEXT):
                doc, key = word_shingles(texts, words)
                size, a, b = _set_ids(doc, key, len(texts))
                odd = _parity(doc, key, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(texts)), batch.column("row_key").slice(first, len(texts)),
                     pa.array(size, pa.int64()), pa.array(a), pa.array(b),
                     *[pa.array(np.ascontiguousarray(odd[:, i])) for i in range(PARITY)]],
                    ["doc_id", "row_key", "n_shingles", "a", "b", *[f"odd{i}" for i in range(PARITY)]])
    return run


def _bucket_counts(words: int):
    """A task's counts, a compressed value for each block of buckets; as block -1 its least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, least = np.zeros(BUCKETS, np.uint32), np.zeros(0, np.uint64)
        for batch in batches:
            for _, texts in slices(batch.column("text"), TEXT):
                _, key = word_shingles(texts, words)
                np.add.at(count, (key & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
                key = np.unique(key)
                least = np.unique(np.concatenate([least, key[:SKETCH]]))[:SKETCH]
        blocks = count.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used.tolist()], pa.int64()),
             pa.array([least.tobytes(), *(pa.compress(blocks[i].tobytes(), "zstd", asbytes=True) for i in used)], pa.binary())],
            ["block", "counts"])
    return run


def _block_classes(key: tuple, table: pa.Table) -> pa.Table:
    """The sum of all tasks' counts of a block and its buckets' classes; of block -1 the least hashes of all."""
    block, values = key[0].as_py(), table.column("counts").to_pylist()
    if block < 0:
        total, out = 0, np.unique(np.frombuffer(b"".join(values), np.uint64))[:SKETCH]
    else:
        count = np.zeros(BLOCK, np.int64)
        for value in values:
            count += np.frombuffer(pa.decompress(value, 4 * BLOCK, "zstd", asbytes=True), np.uint32)
        total, out = int(count.sum()), rarity_classes(count)
    return pa.table({"block": pa.array([block], pa.int64()), "total": pa.array([total], pa.int64()),
                     "classes": pa.array([out.tobytes()], pa.binary())})


def _missing(size, percent: int):
    """Shingles of a set of this size that a partner may lack."""
    return size - -(-percent * size // 100)


def boundary(histogram: dict[int, int], list_length: float, percent: int) -> int:
    """The set size up to which enumerating subsets reads fewer rows than scanning lists."""
    best, best_cost, small = 0, None, 0.0
    sizes = sorted(s for s in histogram if s <= LARGEST_BOUNDARY)
    scan = {s: histogram[s] * (_missing(s, percent) + 1) for s in sizes}
    large = (1 + list_length) * sum(scan.values())
    for at in [0, *sizes]:
        if at:
            small += histogram[at] * math.comb(_missing(at, percent) + SUBSET, SUBSET)
            large -= (1 + list_length) * scan[at]
        indexed = sum(v for s, v in scan.items() if s <= at and 100 * s >= percent * (at + 1))
        if best_cost is None or small + large + indexed < best_cost:
            best, best_cost = at, small + large + indexed
    return best


def _keys(words: int, percent: int, bound: int, rarity):
    """Join keys of each distinct set that a task reads: key, a, b, size, place, scans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rarity.value
        seen: set[tuple[int, int]] = set()     # sets of this task, so that copies are sent once
        for batch in batches:
            for _, texts in slices(batch.column("text"), TEXT):
                doc, key = word_shingles(texts, words)
                size, a, b = _set_ids(doc, key, len(texts))
                doc, key = by_rarity(doc, key, table)
                new = np.zeros(len(texts), bool)
                for i in np.flatnonzero(size):
                    name = (int(a[i]), int(b[i]))
                    new[i] = name not in seen
                    seen.add(name)
                first = np.cumsum(size) - size
                place = np.arange(len(doc)) - first[doc]
                lack = _missing(size, percent)
                small = size <= bound
                out = []
                listed = new & (~small | (100 * size >= percent * (bound + 1)))
                at = np.flatnonzero(listed[doc] & (place <= lack[doc]))
                out.append((key[at].view(np.int64), doc[at], place[at], ~small[doc[at]]))
                # A small set whose partners must equal it needs no key: equal sets are one node.
                for i in np.flatnonzero(new & small & (100 * size >= percent * (size + 1))):
                    mine = key[first[i]:first[i] + min(lack[i] + SUBSET, size[i])]
                    x, y = np.triu_indices(len(mine), 1)
                    pair = ((np.minimum(mine[x], mine[y]) * np.uint64(0x9E3779B97F4A7C15))
                            ^ np.maximum(mine[x], mine[y])).view(np.int64)
                    out.append((pair, np.full(len(pair), i), np.zeros(len(pair), np.int64),
                                np.ones(len(pair), bool)))
                k, d, p, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(a[d]), pa.array(b[d]), pa.array(size[d], pa.int64()),
                     pa.array(p, pa.int32()), pa.array(s)], ["key", "a", "b", "size", "place", "scans"])
    return run


def _texts(words: int, flags):
    """(node, text) of each distinct set that a task reads and whose flag is up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = flags.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for first, texts in slices(batch.column("text"), TEXT):
                size, a, b = _set_ids(*word_shingles(texts, words), len(texts))
                up = table[a & (FLAGS - 1)] & (size > 0)
                new = [i for i in np.flatnonzero(up) if (name := (int(a[i]), int(b[i]))) not in seen
                       and not seen.add(name)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[new]), pa.array(b[new]),
                     batch.column("text").slice(first, len(texts)).take(pa.array(new, pa.int64()))],
                    ["a", "b", "text"])
    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            step = 256
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                sides = []
                for side in ("text", "other"):
                    got = [(doc + first, key) for first, texts in slices(part.column(side))
                           for doc, key in [word_shingles(texts, words)]]
                    sides.append([np.concatenate(x) for x in zip(*got, strict=True)])
                (d1, k1), (d2, k2) = sides
                n = np.bincount(d1, minlength=part.num_rows) + np.bincount(d2, minlength=part.num_rows)
                all_keys = np.sort(np.concatenate([d1, d2]).astype(np.uint64) << np.uint64(52)
                                   | np.concatenate([k1, k2]))
                twice = all_keys[1:][all_keys[1:] == all_keys[:-1]] >> np.uint64(52)
                both = np.bincount(twice.astype(np.int64), minlength=part.num_rows)
                linked[low:low + step] = 100 * both >= percent * (n - both)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(keep), batch.column("dst").filter(keep)],
                                             ["src", "dst"])
    return run


def _node():
    return F.struct("a", "b")


def ngram_join(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, links, component, row_key.

    Words are runs of anything but space and control white space, A-Z lower-cased;
    two sets link when 100 * intersection >= percent * union. component_id is the
    least identifier reachable by links, its own included; links says whether the
    row's set equals or links with another row's; component names the rows that belong
    together (null without links), and row_key is common.row_key of the row.

    Texts that are null or without words have an empty set, link with nothing and
    are their own component. Repeated rows and other copies share a set and so a
    component. Rows with a null identifier take part; a component of null
    identifiers only has a null component_id. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       row_key(id_col, text_col).alias("row_key"))
    id_type = docs.schema[id_col].dataType.simpleString()
    odd = [f"odd{i}" for i in range(PARITY)]
    rows = cut(text.mapInArrow(_profile(words), f"doc_id {id_type}, row_key string, n_shingles long, "
                               "a long, b long, " + ", ".join(f"{c} long" for c in odd)))
    sets = rows.filter("n_shingles > 0").groupBy("a", "b").agg(
        F.max("n_shingles").alias("size"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))

    counted = (text.select("text").mapInArrow(_bucket_counts(words), "block long, counts binary")
               .groupBy("block").applyInArrow(_block_classes, "block long, total long, classes binary").collect())
    classes, least, total = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint8), np.zeros(0, np.uint64), 0
    for r in counted:                                         # BUCKETS bytes and SKETCH hashes at most
        if r.block < 0:
            least = np.frombuffer(r.classes, np.uint64)
        else:
            classes[r.block], total = np.frombuffer(r.classes, np.uint8), total + r.total
    distinct = len(least) if len(least) < SKETCH else (SKETCH - 1) / (int(least[-1]) / float(1 << 52))
    sizes = {r["size"]: r["n"] for r in sets.filter(F.col("size") <= LARGEST_BOUNDARY)
             .groupBy("size").agg(F.count("*").alias("n")).collect()}
    bound = boundary(sizes, max(1.0, total / max(1.0, distinct)), percent)
    rarity = spark.sparkContext.broadcast(classes.ravel())       # BUCKETS bytes, whatever the input

    keys = text.select("text").mapInArrow(
        _keys(words, percent, bound, rarity),
        "key long, a long, b long, size long, place int, scans boolean")
    per_key = Window.partitionBy("key")
    listed = (keys.repartition(width(spark), "key")
              .withColumn("turn", F.row_number().over(Window.partitionBy("key", "a", "b").orderBy("place")))
              .filter("turn = 1")
              .withColumn("in_list", F.count("*").over(per_key))
              .withColumn("any_scans", F.max("scans").over(per_key))
              .filter("in_list > 1 and any_scans")
              .select("key", _node().alias("node"), "size", "place", "scans", "in_list"))
    listed = cut(listed)
    lists = listed.filter(F.col("size") > bound)          # without the small sets' subsets
    marks = [f"mark{i}" for i in range(WORDS)]
    listed = cut(listed.filter(F.col("size") <= bound).select(
        "*", F.lit(None).cast("long").alias("keys"), *[F.lit(None).cast("long").alias(m) for m in marks])
        .unionByName(with_marks(lists)))

    # Round 1: in each list the set that has the key at the lowest place, the one with the
    # fewest shingles of its own, against the others. In a group of near copies that is
    # the text closest to what they were copied from.
    head = listed.groupBy("key").agg(F.min(F.struct("place", "node", "size", "scans", "keys", *marks)).alias("h"))
    star = listed.join(head, "key").filter("h.node <> node")
    near = lambda x, y: (F.expr(f"{x}.scans or {y}.scans") & fits(
        f"{x}.size", f"{x}.place", f"{y}.size", f"{y}.place", percent)
        & F.coalesce(may_share_enough(x, y, percent), F.lit(True)))
    first_pairs = cut(share_enough(
        star.alias("s").filter(near("h", "s")).select(F.least("h.node", "s.node").alias("src"),
                                                      F.greatest("h.node", "s.node").alias("dst"))
        .distinct(), lists, percent))
    edges = cut(_verified(first_pairs, text, words, percent))
    # Round 2: what is left between different components. A list's head has met all others,
    # so a list of two is settled, and in longer lists the head goes.
    comp = cut(components(edges))
    grouped = listed.filter("in_list > 2").drop("in_list").join(comp, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    others = grouped.withColumn("head", F.min(F.struct("place", "node")).over(per_key)).filter("node <> head.node")
    mixed = cut(others.withColumn("lo", F.min("component").over(per_key))
                .withColumn("hi", F.max("component").over(per_key)).filter("lo <> hi").drop("lo", "hi", "head"))
    maps = rows.join(mixed.select("node.a", "node.b").distinct(), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    mixed = mixed.join(maps.select(_node().alias("node"), *odd), "node")
    x, y = mixed.alias("x"), mixed.alias("y")
    rest = x.join(y, F.col("x.key") == F.col("y.key")).filter(
        F.expr("x.node < y.node and x.component <> y.component") & _may_link("x", "y", percent)
        & near("x", "y")).select(
        F.col("x.node").alias("src"), F.col("y.node").alias("dst")).distinct()
    rest = cut(share_enough(rest, lists, percent).join(first_pairs, ["src", "dst"], "left_anti"))
    more = cut(_verified(rest, text, words, percent))
    final = components(edges.unionByName(more))

    named = sets.withColumn("node", _node()).join(final, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("nodes"))
    named = named.join(ids, "component").select(
        "a", "b", "component_id", "component", ((F.col("nodes") > 1) | (F.col("copies") > 1)).alias("links"))
    return rows.join(named, ["a", "b"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(False)).alias("links"), F.when(F.col("links"), F.col("component")).alias("component"),
        "row_key")


def _verified(pairs: DataFrame, text: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose sets, made from their texts, are similar enough.

    Tasks get a table of FLAGS flags, whatever the number of pairs, to leave out most
    texts that no pair asks for; the join picks the right ones.
    """
    spark = text.sparkSession
    wanted = cut(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct())
    flags = flag_table(wanted.select(F.col("node.a").bitwiseAND(F.lit(FLAGS - 1))), FLAGS)
    known = text.select("text").mapInArrow(_texts(words, spark.sparkContext.broadcast(flags)),
                                           "a long, b long, text string").select(_node().alias("node"), "text")
    texts = cut(known.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    return (pairs.join(texts, pairs["src"] == texts["node"]).drop("node")
            .join(texts.select("node", F.col("text").alias("other")), F.col("dst") == F.col("node")).drop("node")
            .mapInArrow(_verify(words, percent), pairs.select("src", "dst").schema))
