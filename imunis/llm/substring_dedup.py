"""Removal of repeated passages of ``LENGTH`` bytes, exact, with suffix arrays.

A suffix array of everything would move every suffix. Instead texts are cut
down to the places where an equal passage can be, without losing one:

1. Anchors. The gram of ``GRAM`` bytes with the least hash in a passage is its
   anchor; equal passages have equal anchors at equal places. An anchor's
   context are the bytes of all passages that contain it. Anchors are dealt out
   by their hash, with the hash of their context, so that contexts that are
   equal throughout are settled here: each but the first is removed, and the
   first speaks for all. Equal contexts of one batch travel as one row, so a
   passage that a third of all documents share is a row for each batch.
2. Suffix arrays. Different contexts of one anchor are fetched from their
   documents, dealt out by anchor, and sorted, a few megabytes at a time, into a
   suffix array by two-stage sorting (``suffix_array``). Adjacent suffixes that
   have LENGTH bytes in common are the same passage: each but the earliest is
   removed.
   An anchor with so many different contexts that they exceed ``BLOCK`` bytes
   is not sorted in one task; its passages are dealt out by their own hashes
   and settled by a map-side aggregation.
3. The removed stretches of a document are merged and cut out of its text.

Passages are judged on the input. "Earlier" is by doc_id, then by place.

Defined results
  null text, short text  nothing is removed (null: the empty text).
  null doc_id            counts as the least id; all null ids are one document.
  repeated rows          rows of one doc_id are one document: equal ones give
                         equal results; of different texts under one id, the
                         stretches found in any are removed from each.
  ties                   passages at the same doc_id and place are the same one.
  empty table            gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import NULL_ID, materialize
from imunis.llm.suffix_array import Suffixes
from imunis.llm.text import _INVERSE, PIECE, column_bytes, mix, powers

LENGTH, GRAM = 100, 32
#: Bytes of contexts that one suffix array takes, and of one anchor's contexts beyond which they are dealt out again.
SORTED, BLOCK = 1 << 21, 1 << 23

_VALUES = np.random.default_rng(77).integers(1, 1 << 63, 256, np.uint64)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, fill) -> np.ndarray:
    """pick over values[j : j + width] for every j that has a whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, fill, values.dtype)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of rows laid out one behind the other: (row, hash, context hash, context start, context end).

    Starts and ends count from the row's first byte.
    """
    n = len(data)
    width = length - gram + 1
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(n), out=total[1:])
    inverse = powers(n + 1, _INVERSE)
    hashes = mix((total[gram:] - total[:n - gram + 1]) * inverse[:n - gram + 1])
    # A gram that reaches into the next row can be nobody's least.
    for k in range(1, gram):
        edge = bounds[1:-1] - k
        hashes[edge[(edge >= 0) & (edge < len(hashes))]] = np.iinfo(np.uint64).max
    least = _sliding(hashes, width, np.minimum, np.iinfo(np.uint64).max)
    around = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width, np.maximum, 0)
    at = np.flatnonzero((around[:len(hashes)] == hashes) & (hashes != np.iinfo(np.uint64).max))
    row = np.searchsorted(bounds, at, "right") - 1
    long = bounds[row + 1] - bounds[row] >= length
    at, row = at[long], row[long]
    lo = np.maximum(bounds[row], at - (length - gram))
    hi = np.minimum(bounds[row + 1], at + length)
    context = mix(mix((total[hi] - total[lo]) * inverse[lo]) + ((at - lo) << 32 | (hi - lo)).astype(np.uint64))
    return row, hashes[at], context, lo - bounds[row], hi - bounds[row]


def row_anchors(data: np.ndarray, bounds: np.ndarray, piece: int = PIECE):
    """``anchors`` in pieces of bounded size: whole rows, or overlapping parts of a long row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + piece, "right")) - 1)
        if bounds[j] - bounds[i] <= 2 * piece:
            row, *rest = anchors(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i])
            yield (row + i, *rest)
        else:  # one long row; neighbouring parts share all passages that cross their border, with whole contexts
            lap = 2 * LENGTH
            for at in range(0, int(bounds[j] - bounds[i]), piece):
                lo, hi = max(0, at - lap), min(int(bounds[j] - bounds[i]), at + piece + lap)
                part = data[bounds[i] + lo:bounds[i] + hi]
                row, h, c, start, end = anchors(part, np.array([0, len(part)], np.int64))
                # Contexts cut off by the part's own border are found whole in the neighbour.
                whole = ((start > 0) | (lo == 0)) & ((end < len(part)) | (lo + len(part) == bounds[j] - bounds[i]))
                yield (row + i)[whole], h[whole], c[whole], start[whole] + lo, end[whole] + lo
        i = j


_OCCURRENCE = "h long, c long, doc long, lo long, hi long, others binary"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different (anchor, context) of a batch: the earliest place, the others packed."""
    for batch in batches:
        ids = np.array(batch.column(0).fill_null(NULL_ID))
        data, bounds = column_bytes(batch.column(1))
        found = list(row_anchors(data, bounds))
        if not found:
            continue
        row, h, c, lo, hi = (np.concatenate([f[k] for f in found]) for k in range(5))
        doc = ids[row]
        order = np.lexsort((lo, doc, c, h))
        h, c, doc, lo, hi = h[order], c[order], doc[order], lo[order], hi[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(h)]]))
        packed = np.stack([doc, lo, hi], 1)
        others = [None] * len(first)
        for k in np.flatnonzero(size > 1).tolist():
            others[k] = packed[first[k] + 1:first[k] + size[k]].tobytes()
        for at in range(0, len(first), 50_000):
            f = first[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[f].view(np.int64)), pa.array(c[f].view(np.int64)), pa.array(doc[f]), pa.array(lo[f]), pa.array(hi[f]),
                 pa.array(others[at:at + 50_000], pa.binary())], names=["h", "c", "doc", "lo", "hi", "others"])


_FOUND = "h long, c long, doc long, lo long, hi long"


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of occurrences sorted by anchor, context and place: stretches to remove (h null), and the first
    occurrence of each context of an anchor that has several (h, c set)."""
    last_h = last_c = None
    keeper: tuple = ()
    held: tuple | None = None
    for batch in batches:
        h, c, doc, lo, hi = (np.array(batch.column(k)) for k in range(5))
        others = batch.column(5)
        shared = np.ones(len(h), bool)  # unless alone with its anchor
        if len(h) > 2:
            shared[1:-1] = (h[1:-1] == h[:-2]) | (h[1:-1] == h[2:]) | np.array(others.is_valid())[1:-1]
        gone, reps = [], []
        for i in np.flatnonzero(shared).tolist():
            row = (int(h[i]), int(c[i]), int(doc[i]), int(lo[i]), int(hi[i]))
            if row[0] != last_h or row[1] != last_c:
                if row[0] == last_h:
                    if held is not None:
                        reps.append(held)
                        held = None
                    reps.append(row)
                else:
                    held = row
                last_h, last_c, keeper = row[0], row[1], row[2:4]
            elif row[2:4] != keeper:
                gone.append((None, None, *row[2:]))
            if (more := others[i].as_py()) is not None:
                gone.extend((None, None, *x) for x in np.frombuffer(more, np.int64).reshape(-1, 3).tolist() if tuple(x[:2]) != keeper)
        rows = gone + reps
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                                         names=["h", "c", "doc", "lo", "hi"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted contexts, out of (doc, text, wanted [(h, lo, hi)])."""
    for batch in batches:
        out = []
        for doc, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode()
            out.extend((w["h"], doc, w["lo"], raw[w["lo"]:w["hi"]]) for w in wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["h", "doc", "lo", "context"])


def repeated(strings: list[bytes], doc: np.ndarray, lo: np.ndarray) -> list[tuple[int, int, int]]:
    """Stretches (doc, lo, hi) of the strings' passages that also start earlier in one of them, by a suffix array."""
    suffixes = Suffixes(strings, LENGTH)
    order = suffixes.array(LENGTH)
    if len(order) < 2:
        return []
    group = np.cumsum(suffixes.common_prefixes(order) < LENGTH)
    string = suffixes.string[order]
    of, at = doc[string], lo[string] + order - suffixes.first[string]
    by = np.lexsort((at, of, group))
    group, of, at = group[by], of[by], at[by]
    head = np.ones(len(group), bool)
    head[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    later = (of != of[lead]) | (at != at[lead])
    of, at = of[later], at[later]
    by = np.lexsort((at, of))
    of, at = of[by], at[by]
    if not len(of):
        return []
    start = np.ones(len(of), bool)
    start[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + LENGTH)
    first = np.flatnonzero(start)
    end = np.concatenate([first[1:], [len(of)]]) - 1
    return list(zip(of[first].tolist(), at[first].tolist(), (at[end] + LENGTH).tolist()))


_STRETCH = "doc long, lo long, hi long, w1 long, w2 long"


def _sort_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by anchor, in groups of whole anchors: stretches to remove. An anchor beyond BLOCK bytes gives its
    passages with two hashes (w1, w2) instead."""
    group: list[tuple[int, int, bytes]] = []  # of whole anchors
    own: list[tuple[int, int, bytes]] = []  # of the anchor at hand
    size = own_size = 0
    anchor, spread = None, False

    def stretches(rows):
        return [(*s, None, None) for s in repeated([r[2] for r in rows], np.array([r[0] for r in rows], np.int64),
                                                   np.array([r[1] for r in rows], np.int64))] if rows else []

    def passages(rows):
        out = []
        for doc, lo, context in rows:
            for k in range(len(context) - LENGTH + 1):
                d = hashlib.blake2b(context[k:k + LENGTH], digest_size=16).digest()
                out.append((doc, lo + k, lo + k + LENGTH, int.from_bytes(d[:8], "little", signed=True),
                            int.from_bytes(d[8:], "little", signed=True)))
        return out

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                                          names=["doc", "lo", "hi", "w1", "w2"])

    for batch in batches:
        for h, doc, lo, context in zip(*(c.to_pylist() for c in batch.columns)):
            if h != anchor:
                if spread:
                    yield batch_of(passages(own))
                else:
                    group += own
                    size += own_size
                if size >= SORTED:
                    yield batch_of(stretches(group))
                    group, size = [], 0
                anchor, own, own_size, spread = h, [], 0, False
            own.append((doc, lo, context))
            own_size += len(context)
            if own_size >= BLOCK:
                yield batch_of(passages(own))
                own, own_size, spread = [], 0, True
    if spread:
        yield batch_of(passages(own))
    else:
        group += own
    yield batch_of(stretches(group))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode()
            merged: list[list[int]] = []
            for s in sorted((s["lo"], min(s["hi"], len(raw))) for s in spans or ()):
                if s[0] >= s[1]:
                    continue
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([o[k] for o in out], t) for k, t in
                                enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def stretches(source: DataFrame) -> DataFrame:
    """(doc, lo, hi): stretches of bytes of ``source`` (doc, text) to remove; they may overlap."""
    found = materialize(
        source.mapInArrow(_occurrences, _OCCURRENCE).repartition("h").sortWithinPartitions("h", "c", "doc", "lo")
        .mapInArrow(_settle, _FOUND), "anchors")
    wanted = found.filter("h is not null").groupBy("doc").agg(F.collect_list(F.struct("h", "lo", "hi")).alias("wanted"))
    contexts = (source.join(wanted, "doc").select("doc", "text", "wanted")
                .mapInArrow(_contexts, "h long, doc long, lo long, context binary"))
    sorted_out = materialize(
        contexts.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_contexts, _STRETCH), "stretches")
    spread = sorted_out.filter("w1 is not null")
    first = materialize(spread.groupBy("w1", "w2").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count(F.lit(1)).alias("n"))
                        .filter("n > 1"), "passages")
    later = spread.join(first, ["w1", "w2"]).filter("doc <> first.doc or lo <> first.lo")
    gone = found.filter("h is null").select("doc", "lo", "hi")
    return gone.union(sorted_out.filter("w1 is null").select("doc", "lo", "hi")).union(later.select("doc", "lo", "hi"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes), one row for each input row."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text"))
    spans = stretches(source.filter("text is not null")).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return (source.join(spans, "doc", "left").select("doc", "text", "spans")
            .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
            .withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every whole text of ``documents``."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
