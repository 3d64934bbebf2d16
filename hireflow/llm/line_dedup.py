"""Near-duplicate lines by an exact set-similarity join.

A line is its set of distinct word shingles. Shingles are ordered by rarity (how
often any shingle of the same hash bucket stands in the table; a fixed number of
buckets is counted over all lines). Two lines of Jaccard similarity t or more must
share one of their rarest shingles, so only those are join keys. Length and
positional filters and the common part of both prefixes leave few pairs, whose
sets are compared in full. A line goes if any earlier line is similar.

Equal lines count as one, their first. In each list of a key the earliest line is
compared with all others; lines that this removes need no other partner, and only
the rest is compared with every earlier line of its lists.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .prefix_filter import WORDS, fits, may_share_enough, prefix_length, share_enough, with_marks

BUCKETS = 1 << 14
FLAGS = 1 << 24              # bits that tell which lines may be asked for again
LAST = (1 << 63) - 1
SPACE = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """(place, tag, pos, line, w) of every line that has words; w are its words, lower-cased."""
    split = docs.select("place", "tag", F.posexplode(F.split(F.lower("text"), "\n")).alias("pos", "line"))
    # Filtered by the line: a filter on w would be moved below it and make it twice.
    return split.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "place", "tag", "pos", "line", _words().alias("w"))


def _words() -> Column:
    return F.array_remove(F.split("line", SPACE), "")


def _shingles(words: int) -> Column:
    """The hashes of a line's runs of ``words`` words; a shorter line is one run."""
    run = ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(words))
    return F.expr(f"if(size(w) < {words}, array(xxhash64(w)), "
                  f"transform(sequence(0, size(w) - {words}), i -> xxhash64({run})))")


def _shingled(lines: DataFrame, words: int) -> DataFrame:
    """Adds ``shingles``: the distinct hashes of a line's runs of words."""
    return lines.withColumn("shingles", F.array_distinct(_shingles(words)))


def _rarity(lines: DataFrame, words: int) -> Column:
    """The place of each bucket in the order of counts, as an array literal of BUCKETS integers."""
    bucket = F.col("h").bitwiseAND(F.lit(BUCKETS - 1))
    # No line has an empty array. A plain explode would also filter by the arrays' sizes,
    # below the projection that makes them, and so make them twice.
    counts = (lines.select(F.explode_outer(_shingles(words)).alias("h"))
              .groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n")))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    places = every.join(counts, "bucket", "left").withColumn(
        "place", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "bucket")) - 1).agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("bucket", "place"))), lambda x: x["place"]), ","))
    return F.split(F.lit(places.first()[0]), ",").cast("array<int>")


def _first_lines(lines: DataFrame) -> DataFrame:
    """(name1, name2, first, copies): the first of all equal lines."""
    return lines.groupBy(*_names()).agg(F.min(F.struct("place", "tag", "pos")).alias("first"),
                                        F.count("*").alias("copies"))


def _names() -> list[Column]:
    return [F.xxhash64("w").alias("name1"), F.xxhash64(F.lit(7), F.col("w")).alias("name2")]


def _flag() -> Column:
    return F.pmod(F.xxhash64("node.place", "node.tag", "node.pos"), F.lit(FLAGS)).cast("int")


def _flags(wanted: DataFrame) -> DataFrame:
    """One row, an array of FLAGS / 64 words: the bits of the ``node``s of a table are up."""
    up = wanted.groupBy(F.shiftright(_flag(), 6).cast("long").alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _flag().bitwiseAND(F.lit(63)))).alias("bits"))
    every = wanted.sparkSession.range(FLAGS // 64).join(up, "id", "left").select(
        "id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).getField("bits").alias("flags"))


def _up(flags: Column) -> Column:
    return F.getbit(F.get(flags, F.shiftright(_flag(), 6)), _flag().bitwiseAND(F.lit(63))) == 1


def _similar(pairs: DataFrame, lines: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose shingle sets, made from their lines, are similar enough.

    A fixed number of flags keeps most lines that no pair asks for out of the
    shuffle; the join picks the right ones. Lines are sent as they are and cut into
    words behind it.
    """
    wanted = cut(pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct())
    flags = cut(_flags(wanted)).scalar()
    asked = (lines.withColumn("node", F.struct("place", "tag", "pos"))
             .filter(_up(flags))
             .select("node", "line").join(wanted, "node", "left_semi").dropDuplicates(["node"])
             .withColumn("w", _words()))
    sets = cut(_shingled(asked, words).select("node", "shingles"))
    both = F.size(F.array_intersect("shingles", "others"))
    return (pairs.join(sets, pairs["src"] == sets["node"]).drop("node")
            .join(sets.select("node", F.col("shingles").alias("others")), F.col("dst") == F.col("node"))
            .filter(100 * both >= percent * (F.size("shingles") + F.size("others") - both))
            .select("src", "dst"))


def _pair(high: str, low: str) -> Column:
    """Two numbers from 0 to 2^31 - 1 as one."""
    return F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(F.col(low).cast("long"))


def _high(pair: str) -> Column:
    return F.shiftright(pair, 32).cast("int")


def _low(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")


def removed_lines(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(place, tag, pos) of the lines to remove from a table (place, tag, text)."""
    lines = _lines(docs)
    order = _rarity(lines, words)
    # A shingle's name starts with its bucket's place, so that names sort by rarity.
    named = F.transform("shingles", lambda h: F.shiftleft(
        F.get(order, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), 47).bitwiseOR(
        F.shiftrightunsigned(h, 17)))
    sets = (_shingled(lines, words).withColumn("named", F.array_sort(named))
            .withColumn("size", F.size("shingles")))
    rare = F.slice("named", 1, prefix_length(F.col("size"), percent).cast("int"))
    firsts = sets.groupBy(*_names()).agg(F.min(F.struct("place", "tag", "pos", "size", rare.alias("rare")))
                                         .alias("f"))
    # Two numbers a word while most rows are sent to learn that their key stands alone.
    prefix = firsts.select("f.place", _pair("f.tag", "f.pos").alias("spot"), "f.size",
                           F.posexplode("f.rare").alias("at", "key")).select(
        "key", "place", "spot", _pair("size", "at").alias("extent"))
    listed = cut(prefix.withColumn("n", F.count("*").over(Window.partitionBy("key"))).filter("n > 1").select(
        "key", F.struct("place", _high("spot").alias("tag"), _low("spot").alias("pos")).alias("node"),
        _high("extent").alias("size"), _low("extent").alias("place")))
    listed = cut(with_marks(listed))
    near = lambda x, y: ((F.col(f"{x}.node") < F.col(f"{y}.node"))
                         & fits(f"{x}.size", f"{x}.place", f"{y}.size", f"{y}.place", percent)
                         & may_share_enough(x, y, percent))
    head = listed.groupBy("key").agg(F.min(F.struct(
        "node", "size", "place", "keys", *[f"mark{i}" for i in range(WORDS)])).alias("h"))
    star = listed.alias("s").join(head, "key").filter(near("h", "s")).select(
        F.col("h.node").alias("src"), F.col("s.node").alias("dst")).distinct()
    first_pairs = cut(share_enough(star, listed, percent))
    gone = cut(_similar(first_pairs, lines, words, percent).select("dst").distinct())
    left = listed.join(gone, listed["node"] == gone["dst"], "left_anti")
    rest = listed.alias("x").join(left.alias("y"), "key").filter(near("x", "y")).select(
        F.col("x.node").alias("src"), F.col("y.node").alias("dst")).distinct()
    rest = cut(share_enough(rest, listed, percent).join(first_pairs, ["src", "dst"], "left_anti"))
    gone = gone.union(_similar(rest, lines, words, percent).select("dst")).distinct()
    # Lines that equal an earlier one, and all copies of a first line that goes.
    known = cut(_first_lines(lines).join(gone, F.col("first") == F.col("dst"), "left")
                .filter("copies > 1 or dst is not null")
                .select("name1", "name2", "first", F.col("dst").isNotNull().alias("gone")))
    return (lines.select("place", "tag", "pos", *_names()).join(known, ["name1", "name2"])
            .filter(F.col("gone") | (F.struct("place", "tag", "pos") != F.col("first")))
            .select("place", "tag", "pos"))


def _placed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("place"),
                       F.xxhash64(text_col).bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("tag"),
                       F.col(text_col).alias("text"), *more)


def line_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, removed (line numbers from 0, sorted).

    Lines end at ``\\n``. Words are runs of anything but space and control white space,
    lower-cased; a line's set is its distinct runs of ``words`` words, or its whole
    sequence if it has fewer. A line is removed if an earlier line, by identifier and
    line number, has a set of Jaccard similarity percent / 100 or more; lines are
    judged on the input, also against lines that go themselves.

    Null texts have no lines; lines without words stay and match nothing. Rows that
    repeat (same id and text) are one document and share a result; rows of one id but
    different texts are ordered by a hash of the text; null ids come last. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    gone = (removed_lines(_placed(docs, id_col, text_col), words, percent)
            .groupBy("place", "tag").agg(F.array_sort(F.collect_set("pos")).alias("removed")))
    rows = _placed(docs, id_col, text_col, F.col(id_col).alias("doc_id")).select(
        "doc_id", "place", "tag", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("lines"),
        F.col("text").isNull().alias("none"))
    none = F.array().cast("array<int>")
    return rows.join(gone, ["place", "tag"], "left").select(
        "doc_id", F.when(F.col("none"), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"))


def without_removed_lines(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """The input rows as a struct ``row``, with ``kept_text``: the text without its removed lines."""
    gone = (removed_lines(_placed(docs, id_col, text_col), words, percent)
            .groupBy("place", "tag").agg(F.collect_set("pos").alias("removed")))
    rows = _placed(docs, id_col, text_col, F.struct(*[F.col(c) for c in docs.columns]).alias("row")).drop("text")
    lines = F.split(F.col(f"row.{text_col}"), "\n")
    joined = rows.join(gone, ["place", "tag"], "left").withColumn("lines", lines)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "removed"),
                                    lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select("row", F.when(F.col("removed").isNull(), F.col(f"row.{text_col}"))
                         .otherwise(kept).alias("kept_text"))
