"""Benchmark decontamination by greedy string tiling.

1. Seeds. Every window of ``min_match`` words of a benchmark item is a seed; an
   item of fewer words is one seed. Documents are scanned once; a bitmap of
   fixed size, the same for a benchmark of any length, drops windows that are no
   seed, so almost nothing of a clean document leaves the scan. Kept are the
   runs of words that possible seeds cover, and the seeds themselves.
2. Keys. How many documents hold each seed is counted. An item's commonest
   seeds are put aside as long as all the words they cover stay below the
   threshold: a document with none but these cannot reach it. The others are
   the item's keys, and a join on keys gives the (document, item) pairs. So a
   phrase that very many documents and items share makes no pairs by itself.
3. Tiling. For each pair, the item's windows that the document holds bound the
   coverage from above; where that reaches the threshold, matches are found
   from the longest down by running Karp-Rabin hashes, and marked so that no
   word counts twice, in any order of passages. A document is contaminated by
   an item when the tiles cover at least ``threshold`` of the item's words.

Words are runs of letters and digits, lower-cased, so case, punctuation and
line breaks make no difference.

Defined results
  null or empty text    matches nothing, on either side.
  items below min_match match as a whole, wherever all their words stand together.
  null doc_id           is carried as null; null item_id likewise.
  repeated rows         share one result row for each item (the largest coverage).
  empty tables          give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import materialize, ship
from imunis.llm.text import _INVERSE, PUNCT, column_bytes, mix, powers, windows, words

#: Fewest words of a tile, and share of an item's words that makes a document contaminated.
MIN_MATCH, THRESHOLD = 5, 0.6
#: Bits of the seed bitmap that every task gets (2 MB).
BITMAP_BITS = 1 << 24


class _Rolled:
    """Karp-Rabin hashes of any stretch of a sequence of word hashes."""

    def __init__(self, values: np.ndarray):
        self.total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values)), out=self.total[1:])
        self.inverse = powers(len(values) + 1, _INVERSE)

    def stretch(self, at, length):
        return (self.total[at + length] - self.total[at]) * self.inverse[at]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int]:
    """(words of ``item`` covered, tiles): longest matches first, none overlapping, none shorter than ``least``.

    ``text`` holds word hashes; 0 separates its runs and matches nothing.
    """
    free_item, free_text = np.ones(len(item), bool), text != 0
    rolled = _Rolled(item), _Rolled(text)
    covered = tiles = 0
    length = min(len(item), len(text))
    while length >= least:
        found = _matches(rolled, item, text, free_item, free_text, length)
        if found and found[0][0] > 2 * length:
            length = found[0][0]
            continue
        marked = False
        for size, i, t in found:
            if free_item[i:i + size].all() and free_text[t:t + size].all():
                free_item[i:i + size] = free_text[t:t + size] = False
                covered, tiles, marked = covered + size, tiles + 1, True
        if not marked:  # nothing of this length is left
            length = length // 2 if length > 2 * least else least if length > least else 0
    return covered, tiles


def _matches(rolled, item, text, free_item, free_text, length) -> list[tuple[int, int, int]]:
    """Longest match of at least ``length`` at each place of the item, longest first."""
    def open_windows(values, free):
        closed = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(closed[length:] == closed[:-length]), windows(values, length)

    at_item, hash_item = open_windows(item, free_item)
    at_text, hash_text = open_windows(text, free_text)
    if not len(at_item) or not len(at_text):
        return []
    order = np.argsort(hash_text[at_text], kind="stable")
    sorted_text = hash_text[at_text][order]
    out = []
    lo, hi = np.searchsorted(sorted_text, hash_item[at_item], "left"), np.searchsorted(sorted_text, hash_item[at_item], "right")

    def room(free):  # free words from each place on: no match is longer
        taken = np.append(np.flatnonzero(~free), len(free))
        return taken[np.searchsorted(taken, np.arange(len(free)))] - np.arange(len(free))

    room_item, room_text = room(free_item), room(free_text)
    of_item, of_text = rolled
    for i, a, b in zip(at_item.tolist(), lo.tolist(), hi.tolist()):
        if a == b:
            continue
        places = at_text[order[a:b]]
        most = np.minimum(room_text[places], room_item[i])
        # The longest stretch that any of the places goes on for: halve the range, all places at once.
        known, top = length, int(most.max())
        places, most = places[most >= known], most[most >= known]
        while known < top:
            size = (known + top + 1) // 2
            far = places[most >= size]
            far = far[of_text.stretch(far, size) == of_item.stretch(i, size)]
            if len(far):
                known, places, most = size, far, room_text[far]
                most = np.minimum(most, room_item[i])
                top = min(top, int(most.max()))
            else:
                top = size - 1
        t = int(places.min())
        if np.array_equal(item[i:i + known], text[t:t + known]):
            out.append((known, i, t))
    return sorted(out, key=lambda m: (-m[0], m[1], m[2]))


def _seeds(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window; windows of another width are other seeds."""
    return mix(windows(words, width) + np.uint64(width))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, first = words(*column_bytes(batch.column(1)), PUNCT, latin=True)
        rows = [hashes[s:e] for s, e in zip(first[:-1], first[1:])]
        width = [min(MIN_MATCH, len(r)) for r in rows]
        seeds = [np.unique(_seeds(r, w)) if w else np.zeros(0, np.uint64) for r, w in zip(rows, width)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary()),
             pa.array(width, pa.int32()), pa.array([s.view(np.int64) for s in seeds], pa.list_(pa.int64()))],
            names=["item_id", "n_words", "words", "width", "seeds"])


def key_seeds(item: np.ndarray, held: dict[int, int], threshold: float) -> list[int]:
    """The seeds of an item of which a document that reaches the threshold has at least one.

    ``held``: documents of each seed. The commonest seeds are left out while
    the words they cover together stay below the threshold.
    """
    width = min(MIN_MATCH, len(item))
    seeds = _seeds(item, width).view(np.int64)
    covered = np.zeros(len(item), bool)
    keys: list[int] = []
    places: dict[int, list[int]] = {}
    for at, seed in enumerate(seeds.tolist()):
        places.setdefault(seed, []).append(at)
    for seed in sorted(places, key=lambda s: (-held.get(s, 0), s)):
        more = covered.copy()
        for at in places[seed]:
            more[at:at + width] = True
        if more.sum() < threshold * len(item):
            covered = more
        elif seed in held:
            keys.append(seed)
    return keys


def _keys(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, keys = [], []
            for item, raw, held in zip(*(c.to_pylist() for c in batch.columns)):
                found = key_seeds(np.frombuffer(raw, np.uint64), {h["seed"]: h["docs"] for h in held}, threshold)
                items += [item] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(keys, pa.int64())], names=["item", "seed"])
    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The seeds' bits, gathered as at most ``BITMAP_BITS / 64`` numbers whatever the benchmark's size."""
    cell = F.col("seed").bitwiseAND(F.lit(BITMAP_BITS - 1))
    one = F.expr(f"shiftleft(1L, int((seed & {BITMAP_BITS - 1}L) & 63))")
    rows = seeds.groupBy(F.shiftright(cell, 6).alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    numbers = np.zeros(BITMAP_BITS // 64, np.int64)
    for at, bits in rows:
        numbers[at] = bits
    return np.unpackbits(numbers.view(np.uint8), bitorder="little").astype(bool) if len(rows) else np.zeros(0, bool)


def _scan(bitmap: np.ndarray, widths: list[int]):
    packed = np.packbits(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        mask = np.uint64(len(bits) - 1)
        for batch in batches:
            ids, runs, seeds = [], [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes, first = words(*column_bytes(part.column(1)), PUNCT, latin=True)
                rolled = {w: _seeds(hashes, w) for w in widths}
                hit = {w: bits[(r & mask).astype(np.int64)] for w, r in rolled.items()}
                count = {w: np.concatenate([[0], np.cumsum(h)]) for w, h in hit.items()}
                for row, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    at_hit = {w: np.flatnonzero(hit[w][s:e - w + 1]) + s for w in widths
                              if e - w + 1 > s and count[w][e - w + 1] > count[w][s]}
                    if not at_hit:
                        continue
                    inside = np.zeros(e - s + 2, np.int64)
                    for w, places in at_hit.items():
                        np.add.at(inside, places - s, 1)
                        np.add.at(inside, places - s + w, -1)
                    inside = np.cumsum(inside)[:e - s] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside, [0]])))
                    kept = [x for a, b in zip(edges[::2], edges[1::2]) for x in (hashes[s + a:s + b], np.zeros(1, np.uint64))]
                    ids.append(part.column(0)[row].as_py())
                    runs.append(np.concatenate(kept).tobytes())
                    seeds.append(np.unique(np.concatenate([rolled[w][p] for w, p in at_hit.items()])).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(runs, pa.binary()), pa.array(seeds, pa.list_(pa.int64()))],
                names=["doc_id", "runs", "seeds"])
    return run


def _tile_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, n, item_words, runs in zip(*(c.to_pylist() for c in batch.columns)):
                own, text, width = np.frombuffer(item_words, np.uint64), np.frombuffer(runs, np.uint64), min(MIN_MATCH, n)
                shared = np.flatnonzero(np.isin(windows(own, width), windows(text, width)))
                most = np.zeros(n + 1, np.int64)
                np.add.at(most, shared, 1)
                np.add.at(most, shared + width, -1)
                if (np.cumsum(most)[:n] > 0).sum() < threshold * n:
                    continue
                covered, tiles = tile(own, text, width)
                if covered >= threshold * n:
                    out.append((doc, item, covered / n, covered, tiles))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in
                 enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                names=["doc_id", "item_id", "coverage", "matched_words", "n_tiles"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item whose words it covers to ``threshold`` or more.

    Returns doc_id, item_id, coverage, matched_words, n_tiles: contaminated
    pairs only.
    """
    ship(docs.sparkSession)
    items = materialize(
        benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col))
        .mapInArrow(_item_rows, "item_id long, n_words long, words binary, width int, seeds array<long>")
        .filter("n_words > 0"), "benchmark-items")
    # One number for each item row, so that a null or repeated item_id is a key like any other.
    items = items.withColumn("item", F.xxhash64("item_id", "words"))
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # MIN_MATCH rows at most
    bitmap = _bitmap(seeds)
    if not len(bitmap):
        bitmap = np.zeros(BITMAP_BITS, bool)
    hits = materialize(
        docs.select(F.col(id_col).cast("long"), F.col(text_col))
        .mapInArrow(_scan(bitmap, widths), "doc_id long, runs binary, seeds array<long>"), "seed-runs")
    hits = hits.withColumn("doc", F.xxhash64("doc_id", "runs"))
    held = hits.select(F.explode("seeds").alias("seed")).groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    counted = (seeds.distinct().join(held, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "docs")).alias("held")))
    keys = materialize(items.dropDuplicates(["item"]).join(counted, "item").select("item", "words", "held")
                       .mapInArrow(_keys(threshold), "item long, seed long"), "key-seeds", slim=True)
    pairs = hits.select("doc", F.explode("seeds").alias("seed")).join(keys, "seed").select("doc", "item").distinct()
    return (pairs.join(hits.select("doc", "doc_id", "runs"), "doc")
            .join(items.select("item", "item_id", "n_words", "words"), "item")
            .select("doc_id", "item_id", "n_words", "words", "runs")
            .mapInArrow(_tile_rows(threshold),
                        "doc_id long, item_id long, coverage double, matched_words long, n_tiles long")
            .groupBy("doc_id", "item_id").agg(
                F.max("coverage").alias("coverage"), F.max("matched_words").alias("matched_words"),
                F.min("n_tiles").alias("n_tiles")))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    bad = materialize(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "contaminated")
    left, right = docs.alias("d"), bad.alias("b")
    return left.join(right, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all of ``documents`` against all of ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
