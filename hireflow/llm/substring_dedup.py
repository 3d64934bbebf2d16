"""Suffix-array deduplication: bytes of long strings that an earlier document also holds.

The collection Burrows-Wheeler transform is built column by column, one symbol per
string and round (collection_bwt). Its strings must be short and meet by content,
so each document is first cut at anchors: of the ``ANCHOR``-byte strings inside a
window of ``width`` bytes the one with the least hash. Neighbouring windows with the
same anchor form one piece. Equal windows have equal anchors wherever they stand,
so pieces are dealt out by anchor and every repeat is found inside one collection.

Two passes keep what is sent small. The first sends of each piece only where it is and
its anchor: an anchor that one text alone holds cannot repeat. The second sends the bytes
of the pieces that share their anchor. A piece that an earlier document holds whole, byte
for byte, repeats whole; pieces that share their anchor but differ are narrowed to the runs of
windows that agree by hash with another document's. Runs are settled by their bytes as pieces
are, and those that differ are sorted suffix by suffix. A piece has at most ``LONGEST``
windows, so a round count has a fixed bound however long the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collection_bwt import repeated
from .common import cut
from .common import width as partitions
from .textkit import Texts, mix, slices

ANCHOR = 24
LONGEST = 27
COLLECTION_BYTES = 1 << 20
#: A task's pieces, column after column in one binary value. The anchor only deals pieces out and
#: groups them: anchors that share 32 bits are one group, whose pieces are told apart by their bytes.
_PACKED = (("anchor", np.uint32), ("place", np.int64), ("tag", np.int64), ("start", np.int32), ("n", np.uint8))
_OPEN = np.dtype([("anchor", np.uint32), ("start", np.int32), ("n", np.uint8)])
_SPAN = np.dtype([("start", np.int32), ("n", np.int32)])
_OF_DOCUMENTS = {kind: (("place", np.int64), ("tag", np.int64), *((c, kind[c]) for c in kind.names))
                 for kind in (_OPEN, _SPAN)}
#: A round of narrowing that leaves more than this share of the bytes is the last one.
_PAYS = 0.9
LAST = (1 << 63) - 1


def _places(texts, width: int) -> tuple[np.ndarray, ...]:
    """document, offset, number of windows, anchor hash of each piece."""
    n = len(texts.data)
    if n < width:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    at = np.arange(n - ANCHOR + 1)
    low = texts.hashes(at, at + ANCHOR)
    span, want = 1, width - ANCHOR + 1
    while 2 * span <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:len(low) - (want - span)], low[want - span:])     # one per window start
    edge = np.zeros(n + 1, np.int32)
    long_enough = texts.ends - texts.starts >= width
    edge[texts.starts[long_enough]] += 1
    edge[texts.ends[long_enough] - width + 1] -= 1
    valid = np.cumsum(edge)[:len(low)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    index = np.arange(len(low))
    run = np.maximum.accumulate(np.where(new, index, 0))
    new |= valid & ((index - run) % LONGEST == 0)
    start = np.flatnonzero(new)
    # A piece ends where the next one starts or where the document has no more windows.
    stops = np.flatnonzero(new | ~valid)
    stop = np.append(stops, len(low))[np.searchsorted(stops, start, side="right")]
    doc = np.searchsorted(texts.starts, start, side="right") - 1
    return doc, start - texts.starts[doc], stop - start, low[start]


def _pieces(texts, width: int) -> tuple[np.ndarray, ...]:
    """document, offset, number of windows, anchor hash, two content hashes of each piece."""
    doc, start, n, anchor = _places(texts, width)
    low = texts.starts[doc] + start
    return doc, start, n, anchor, texts.hashes(low, low + n + width - 1), texts.checks(low, low + n + width - 1)


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray], text=lambda rows: b"",
            kinds=_PACKED) -> pa.RecordBatch:
    """Rows sorted by bucket, one compressed value for each bucket: the columns, then ``text``."""
    parts = _runs(bucket)
    values = [b"".join([*(columns[c][x].astype(kind).tobytes() for c, kind in kinds), text(x)]) for x in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(bucket[x.start]) for x in parts], pa.int64()),
         pa.array([x.stop - x.start for x in parts], pa.int64()), pa.array([len(v) for v in values], pa.int64()),
         pa.array([pa.compress(v, "zstd", asbytes=True) for v in values], pa.binary())],
        ["bucket", "count", "size", "pieces"])


def _unpack(table: pa.Table, kinds=_PACKED) -> tuple[dict[str, np.ndarray], list[bytes]]:
    """The columns of all values, and the text that comes after them in each."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c, _ in kinds}
    rest = []
    for value, count, size in zip(*(table.column(c).to_pylist() for c in ("pieces", "count", "size")), strict=True):
        value, at = pa.decompress(value, size, "zstd", asbytes=True), 0
        for c, kind in kinds:
            parts[c].append(np.frombuffer(value, kind, count, at))
            at += count * np.dtype(kind).itemsize
        rest.append(value[at:])
    return {c: np.concatenate(x) for c, x in parts.items()}, rest


def _runs(values: np.ndarray) -> list[slice]:
    """The rows of each run of equal values."""
    if not len(values):
        return []
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])).tolist()
    return [slice(x, y) for x, y in zip(head, [*head[1:], len(values)], strict=True)]


def _for_documents(kind: np.dtype, buckets: int, **columns: np.ndarray) -> pa.Table:
    """Records of ``kind`` on their way to their documents, packed by bucket of the document: a row
    for each document and bucket of anchors would be up to a row for each record."""
    place, tag = columns["place"], columns["tag"]
    bucket = mix(place.view(np.uint64) ^ mix(tag.view(np.uint64))) % np.uint64(buckets)
    order = np.lexsort((columns["start"], tag, place, bucket))
    return pa.Table.from_batches([_packed(bucket[order], {c: x[order] for c, x in columns.items()},
                                          kinds=_OF_DOCUMENTS[kind])])


def _gathered(kind: np.dtype):
    def run(table: pa.Table) -> pa.Table:
        columns, _ = _unpack(table, _OF_DOCUMENTS[kind])
        return _per_document(columns.pop("place"), columns.pop("tag"), kind, **columns)
    return run


def _per_document(place: np.ndarray, tag: np.ndarray, kind: np.dtype, **columns: np.ndarray) -> pa.Table:
    """One row per document: place, tag, found: its records of ``kind`` end to end."""
    order = np.lexsort((columns["start"], tag, place))
    place, tag = place[order], tag[order]
    records = np.empty(len(order), kind)
    for c in kind.names:
        records[c] = columns[c][order]
    new = np.ones(len(order), bool)
    new[1:] = (place[1:] != place[:-1]) | (tag[1:] != tag[:-1])
    head = np.flatnonzero(new)
    ends = (np.append(head, len(order)) * kind.itemsize).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(records)])
    return pa.table({"place": place[head], "tag": tag[head], "found": found.cast(pa.binary())})


def _anchors(width: int, buckets: int):
    """The pieces of a slice of documents, packed by bucket of their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}       # texts of this task, so that copies are cut once
        for batch in batches:
            place, tag = batch.column("place").to_numpy(), batch.column("tag").to_numpy()
            for first, texts in slices(batch.column("text")):
                keep = np.zeros(len(texts), bool)
                for i in range(len(texts)):
                    name, mine = hashlib.blake2b(texts.text(i), digest_size=16).digest(), int(place[first + i])
                    if seen.get(name, LAST + 1) > mine:
                        seen[name], keep[i] = mine, True
                doc, start, n, anchor = _places(texts, width)
                bucket = anchor % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                order = order[keep[doc[order]]]
                columns = {"anchor": anchor[order] >> np.uint64(32), "place": place[first + doc[order]],
                           "tag": tag[first + doc[order]], "start": start[order], "n": n[order]}
                yield _packed(bucket[order], columns)
    return run


def _shared(buckets: int):
    """Of one bucket's pieces those whose anchor a smaller or larger document holds too.

    Texts that agree in their 64-bit tag are copies: the first stands for all, the others
    go whole by their digest.
    """
    def run(table: pa.Table) -> pa.Table:
        p, _ = _unpack(table)
        order = np.lexsort((p["place"], p["tag"], p["anchor"]))
        p = {c: x[order] for c, x in p.items()}
        new = np.ones(len(order), bool)
        new[1:] = (p["anchor"][1:] != p["anchor"][:-1]) | (p["tag"][1:] != p["tag"][:-1])
        first = p["place"][np.flatnonzero(new)][np.cumsum(new) - 1]
        p = {c: x[p["place"] == first] for c, x in p.items()}
        anchor, place = p["anchor"], p["place"]
        new = np.ones(len(anchor), bool)
        new[1:] = anchor[1:] != anchor[:-1]
        head = np.flatnonzero(new)
        if len(head):
            use = (np.minimum.reduceat(place, head) < np.maximum.reduceat(place, head))[np.cumsum(new) - 1]
            p = {c: x[use] for c, x in p.items()}
        return _for_documents(_OPEN, buckets, **p)
    return run


def _piece_bytes(width: int, buckets: int):
    """The pieces that share their anchor, packed by bucket, and after them their bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                rows = range(first, first + len(texts))
                found = [batch.column("found")[i].as_py() for i in rows]
                open_ = np.frombuffer(b"".join(found), _OPEN)
                doc = np.repeat(np.arange(len(texts)), [len(x) // _OPEN.itemsize for x in found])
                bucket = open_["anchor"] % np.uint32(buckets)
                order = np.argsort(bucket, kind="stable")
                doc, bucket = doc[order], bucket[order]
                columns = {c: open_[c][order] for c in _OPEN.names} | {
                    c: batch.column(c).to_numpy()[first + doc] for c in ("place", "tag")}
                low = texts.starts[doc] + columns["start"]
                high = low + columns["n"] + (width - 1)
                data = texts.data.tobytes()
                yield _packed(bucket, columns, lambda x: b"".join(
                    [data[a:b] for a, b in zip(low[x].tolist(), high[x].tolist(), strict=True)]))  # noqa: B023
    return run


def _collections(anchor: np.ndarray, size: np.ndarray) -> list[slice]:
    """Pieces in order of their anchors, about COLLECTION_BYTES at once, one anchor's together."""
    before, new = np.cumsum(size) - size, np.ones(len(size), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    return _runs((before[new] // COLLECTION_BYTES)[np.cumsum(new) - 1])


def _may_repeat(strings: list[bytes], owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """string, first offset, number of offsets of the runs of ``width`` bytes that agree by hash with
    some of another owner's string."""
    size = np.array([len(s) for s in strings], np.int64)
    windows, ends = size - width + 1, np.cumsum(size)
    string = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offset + (ends - size)[string]
    texts = Texts(np.frombuffer(b"".join(strings), np.uint8), ends - size, ends)
    h = texts.hashes(start, start + width)
    order = np.argsort(h)
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    head, whose = np.flatnonzero(new), owner[string[order]]
    hit = np.zeros(len(h) + 1, bool)          # the last one ends the last run
    hit[order] = (np.minimum.reduceat(whose, head) < np.maximum.reduceat(whose, head))[np.cumsum(new) - 1]
    first = np.flatnonzero(hit[:-1] & np.concatenate([[True], ~hit[:-2] | (string[1:] != string[:-1])]))
    last = np.flatnonzero(hit[:-1] & np.concatenate([~hit[1:-1] | (string[1:] != string[:-1]), [True]]))
    return string[first], offset[first], last - first + 1


def _contents(strings: list[bytes]) -> np.ndarray:
    """A number for each string, the same for equal ones."""
    return pa.array(strings, pa.large_binary()).dictionary_encode().indices.to_numpy()


def _narrowed(strings: list[bytes], owner: np.ndarray, width: int) -> tuple[tuple[np.ndarray, ...], tuple, list[bytes]]:
    """What of the strings repeats in a smaller owner's string, as far as equal bytes tell, and what
    the transform has to tell: twice (string, first offset, number of offsets), and the latter's bytes.

    Windows without a hit repeat nowhere. A run of the others that equals a smaller owner's
    repeats whole; the least owner's stays, so no window loses its earliest place.
    """
    string, offset = np.arange(len(strings)), np.zeros(len(strings), np.int64)
    settled = []
    while True:
        before = sum(map(len, strings))
        run, first, n = _may_repeat(strings, owner, width) if strings else (string, offset, offset)
        strings = [strings[i][a:a + c + width - 1] for i, a, c in zip(run.tolist(), first.tolist(), n.tolist(), strict=True)]
        string, offset, owner = string[run], offset[run] + first, owner[run]
        content = _contents(strings)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, content, owner)
        whole = owner > least[content]
        settled.append((string[whole], offset[whole], n[whole]))
        left = np.flatnonzero(~whole)
        strings = [strings[i] for i in left.tolist()]
        string, offset, n, owner = string[left], offset[left], n[left], owner[left]
        if not strings or sum(map(len, strings)) > _PAYS * before:
            return tuple(np.concatenate(x) for x in zip(*settled, strict=True)), (string, offset, n), strings


def _repeats(width: int, buckets: int):
    """Per document the windows of one bucket's pieces that an earlier document holds too."""
    def run(table: pa.Table) -> pa.Table:
        p, rest = _unpack(table)
        data = b"".join(rest)
        size = p["n"].astype(np.int64) + (width - 1)
        ends = np.concatenate([[0], np.cumsum(size)])
        content = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]
                                        ).dictionary_encode().indices.to_numpy()
        order = np.lexsort((p["place"], content, p["anchor"]))
        of_anchor, of_piece = np.ones(len(order), bool), np.ones(len(order), bool)
        of_anchor[1:] = p["anchor"][order][1:] != p["anchor"][order][:-1]
        of_piece[1:] = content[order][1:] != content[order][:-1]
        place = p["place"][order]
        whole = place > place[np.flatnonzero(of_piece)][np.cumsum(of_piece) - 1]
        kinds = np.add.reduceat(of_piece.astype(np.int64), np.flatnonzero(of_anchor))[np.cumsum(of_anchor) - 1]
        open_ = order[~whole & (kinds > 1)]
        rows, start, n = [order[whole]], [p["start"][order[whole]]], [p["n"][order[whole]].astype(np.int32)]

        def found(piece: np.ndarray, offset: np.ndarray, count: np.ndarray) -> None:
            rows.append(piece)
            start.append(p["start"][piece] + offset.astype(np.int32))
            n.append(count.astype(np.int32))

        # Most pieces share no more than their anchor: hashes of windows leave those out, and
        # the transform says what the others share.
        left, strings = [(open_[:0], open_[:0])], []
        for x in _collections(p["anchor"][open_], size[open_]):
            mine = open_[x]
            settled, (string, offset, _), parts = _narrowed(
                [data[ends[i]:ends[i + 1]] for i in mine.tolist()], p["place"][mine], width)
            found(mine[settled[0]], *settled[1:])
            left.append((mine[string], offset))
            strings += parts
        piece, offset = (np.concatenate(x) for x in zip(*left, strict=True))
        for x in _collections(p["anchor"][piece], np.array([len(s) for s in strings], np.int64)):
            hits = repeated(strings[x], p["place"][piece[x]], width)
            if hits:
                string, first, count = (np.array(c) for c in zip(*hits, strict=True))
                found(piece[x][string], offset[x][string] + first, count)
        at = np.concatenate(rows)
        return _for_documents(_SPAN, buckets, place=p["place"][at], tag=p["tag"][at],
                              start=np.concatenate(start), n=np.concatenate(n))
    return run


_REMOVED = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))


def _remove(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept_spans = [], [], [], [], []
            for i in range(batch.num_rows):
                data = (batch.column("text")[i].as_py() or "").encode()
                spans = [(a, a + n + width - 1) for a, n in
                         np.frombuffer(batch.column("found")[i].as_py() or b"", _SPAN).tolist()]
                if batch.column("copy")[i].as_py() and len(data) >= width:
                    spans = [(0, len(data))]
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
                digests.append(kept.hexdigest())
                kept_spans.append([{"start": a, "n": b - a} for a, b in merged])
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pc.equal(batch.column("place"), LAST), None, batch.column("place")),
                 pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(runs, pa.int64()), pa.array(digests), pa.array(kept_spans, _REMOVED)],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])
    return run


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed.

    Each byte covered by ``width`` bytes that also start in a row of smaller doc_id is
    removed; strings are judged on the input. ``removed`` lists the runs as byte
    offset and length in the original text.

    Null texts are empty; texts shorter than ``width`` keep all bytes. Rows of one
    doc_id do not count against each other, so repeated rows share a result. Null
    identifiers come after all others and not before each other. An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    buckets = partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("place"),
                       F.xxhash64(text).alias("tag"), text.alias("text"))
    packed, found = "bucket long, count long, size long, pieces binary", "place long, tag long, found binary"
    gathered = lambda x, kind: x.groupBy("bucket").applyInArrow(_gathered(kind), found)
    # Cut, so that the anchors are gone before the bytes are sent.
    shared = cut(gathered(rows.mapInArrow(_anchors(width, buckets), packed)
                          .groupBy("bucket").applyInArrow(_shared(buckets), packed), _OPEN))
    # A row that stands twice sends its pieces twice, which changes nothing.
    spans = gathered(rows.join(shared, ["place", "tag"]).select("place", "tag", "text", "found")
                     .mapInArrow(_piece_bytes(width, buckets), packed)
                     .groupBy("bucket").applyInArrow(_repeats(width, buckets), packed), _SPAN)
    copies = rows.select("place", "tag", F.md5("text").alias("digest"))
    firsts = copies.groupBy("digest").agg(F.min("place").alias("first"))
    copies = copies.distinct().join(firsts, "digest").filter("place > first").select(
        "place", "tag", F.lit(True).alias("copy"))
    verdict = spans.join(copies, ["place", "tag"], "full")
    # Both joins with the texts deal them out alike, so they are shuffled once.
    return (rows.join(verdict, ["place", "tag"], "left").select("place", "text", "found", "copy")
            .mapInArrow(_remove(width), "doc_id long, n_bytes long, n_removed long, n_spans long, "
                        "kept_sha256 string, removed array<struct<start: int, n: int>>"))
