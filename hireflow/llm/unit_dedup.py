"""Substring deduplication by hashing lines or paragraphs.

A unit is a line, a paragraph (lines up to one without words) or, on request, a sentence
inside a line (a line cut after words that end in ``.``, ``!`` or ``?``). Its digest is
taken over its words, A-Z lower-cased, so case and white space do not matter. Digests are
grouped over the whole table; of each group the occurrence that ranks first, by document
and offset, stays, and all later ones are removed, however short. Offsets are those of
the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textkit import NOT_SPACE, mix, powers, slices

LAST = (1 << 63) - 1
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _begins(unit: str, texts, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word begins a unit: it is its document's first, or between it and the
    word before there is a line end, a line without words, or a sentence end."""
    lines = np.concatenate([[0], np.cumsum(texts.data == 10)])
    between = lines[start[1:]] - lines[end[:-1]]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (between >= (2 if unit == "paragraph" else 1))
    if unit == "sentence":
        new[1:] |= _STOP[texts.data[end[:-1] - 1]]
    return new


def _units(unit: str):
    """One row per unit that has words; ``unit`` numbers them inside their document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                doc, start, end = texts.runs(NOT_SPACE)
                if not len(doc):
                    continue
                head = np.flatnonzero(_begins(unit, texts, doc, start, end))
                words = np.diff(np.append(head, len(doc)))
                last = head + words - 1
                h = texts.hashes(start, end, lower=True)
                up, down = powers(len(h))
                names = []
                for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                    total = np.concatenate([np.zeros(1, np.uint64),
                                            np.cumsum(mix(h ^ salt) * up[:len(h)], dtype=np.uint64)])
                    names.append(mix((total[head + words] - total[head]) * down[head]
                                     + words.astype(np.uint64)).view(np.int64))
                base = texts.starts[doc[head]]
                at = pa.array(doc[head] + first)
                number = np.arange(len(head)) - np.searchsorted(doc[head], doc[head], side="left")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[0]), pa.array(names[1]), batch.column("place").take(at),
                     batch.column("tag").take(at), pa.array(number, pa.int32()),
                     pa.array(start[head] - base, pa.int32()), pa.array(end[last] - base, pa.int32())],
                    ["name1", "name2", "place", "tag", "unit", "start", "stop"])
    return run


def _runs(repeats: list[dict]) -> list[tuple[int, int]]:
    """Byte ranges of the removed units, neighbouring ones as one."""
    out, before = [], None
    for r in sorted(repeats, key=lambda x: x["unit"]):
        if before is not None and r["unit"] == before + 1:
            out[-1] = (out[-1][0], r["stop"])
        else:
            out.append((r["start"], r["stop"]))
        before = r["unit"]
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, repeats in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "repeats")),
                                         strict=True):
            data = (text or "").encode()
            spans = _runs(repeats or [])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept = b"".join([*kept, data[at:]])
            out.append((doc_id, len(data), len(data) - len(kept), len(spans),
                        ",".join(f"{a}-{b}" for a, b in spans), hashlib.sha256(kept).hexdigest(),
                        None if text is None else kept.decode()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "kept_text"]
        types = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                 pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names)


def unit_dedup(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, removed, kept_sha256, kept_text.

    ``unit`` is line, paragraph or sentence. ``removed`` lists the removed byte ranges of
    the original text as first-stop pairs.

    Null texts have no units and a null kept_text; units without words do not exist, so
    blank lines stay. Repeated rows (same id and text) are one document and share a
    result; rows of one id but different texts rank by a hash. Identifiers that are no
    whole numbers, and null ones, rank last, by a hash of identifier and text. An empty
    table gives an empty result; other columns are ignored.
    """
    if unit not in ("line", "paragraph", "sentence"):
        raise ValueError(f"unit must be line, paragraph or sentence, not {unit!r}")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(id_col).try_cast("long"), F.lit(LAST)).alias("place"),
                       F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("tag"))
    units = rows.select("place", "tag", "text").mapInArrow(
        _units(unit), "name1 long, name2 long, place long, tag long, unit int, start int, stop int")
    first = cut(units.groupBy("name1", "name2").agg(
        F.min(F.struct("place", "tag", "unit")).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1").drop("copies"))
    repeats = (units.join(first, ["name1", "name2"])
               .filter(F.struct("place", "tag", "unit") != F.col("first"))
               .groupBy("place", "tag").agg(F.collect_set(F.struct("unit", "start", "stop")).alias("repeats")))
    id_type = docs.schema[id_col].dataType.simpleString()
    return rows.join(repeats, ["place", "tag"], "left").select("doc_id", "text", "repeats").mapInArrow(
        _cut_out, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, removed string, "
        "kept_sha256 string, kept_text string")
