"""Near-duplicate groups: exact Jaccard join on word shingles, size-aware, heavy and light sets apart.

Sets are ordered by one global order of shingles, rare ones first. Two sets that
reach the threshold share at least c shingles, so the first |A| - c + k of each
share at least k of them.

* Light sets (up to a size x) emit every subset of k = 2 shingles of that
  beginning: a fixed-size subset is a far rarer key than one shingle.
* Heavy sets scan inverted lists: they, and the light sets that are large
  enough to be their partners, emit the single shingles of the beginning (k = 1).

x is chosen by cost, from the histogram of set sizes: the subsets that the light
side would emit against the list entries that the heavy side would emit and scan.

The global order comes from a sketch of all shingles with a fixed number of
counters. A shingle that many documents share counts high, comes last and is no
key. The sketch only orders; any order gives the same result.

A key carries its place in the set's order. Two sets of sizes a and b that link
share c(a, b) shingles, so their first common shingle stands among the first
a - c(a, b) + 1 of the one and b - c(a, b) + 1 of the other: a key's entries that
stand further back link with nobody of that size and go.

Sets that are equal are one node. Keys with two nodes or more are candidates,
but never all their pairs: in the first round each node is compared with the
one where the key stands foremost (the least edited copy has the fewest rare
shingles of its own before it). Nodes that are linked already need no
comparison; what is left, pairs of a key in different components, is compared
in further rounds with a few nodes of each key, chosen anew, as long as they
bring components together, and at last exhaustively, by classes of size and
place that can link at all (``_across``). So a large group of near copies costs
a few comparisons for each member, documents that share a phrase below the
threshold cost none, and yet no link between different components is missed.
Comparisons count whole sets.

Defined results
  null or empty text, only white space: n_shingles 0, linked with nothing.
  fewer words than the width: the whole sequence is the one shingle.
  null doc_id    linked with nothing; component_id null.
  repeated rows  of one doc_id share its component; each gives its row. doc_id
                 should be unique: different texts under one id count as linked.
  ties           pairs exactly at the threshold link.
  empty table    gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import materialize, ship
from imunis.llm.components import components
from imunis.llm.text import column_bytes, mix, shingle_sets, words

#: Counters of the sketch, and how many of them make one row on its way.
CELLS_LOG2, CELL_ROW = 21, 4096
#: Largest set size that may count as light.
MAX_LIGHT = 64
#: Cost of a list entry, which is emitted and scanned, in terms of a subset, which is emitted.
SCAN_COST = 2
#: Pairs left, as a multiple of the keys' rows, above which a round with ``PIVOTS`` nodes of each key and class of sizes comes first.
ROUND_COST, PIVOTS = 8, 4


def _overlap(size: int, percent: int) -> int:
    """Fewest shingles that a set of this size shares with any partner."""
    return -(-percent * size // 100)


def _sets(batch: pa.RecordBatch, width: int, rows: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of a batch whose second column is the text."""
    for at in range(0, batch.num_rows, rows):
        hashes, first = words(*column_bytes(batch.column(1).slice(at, rows)))
        for i, s in enumerate(shingle_sets(hashes, first, width)):
            yield at + i, s


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on the order of the set."""
    a = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(width: int):
    """A row for each document (doc, n, f1, f2), and at the end of a task its share of the sketch (cell_row, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELLS_LOG2, np.int64)
        wait: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            n, f1, f2 = [], [], []
            for _, s in _sets(batch, width):
                n.append(len(s))
                a, b = _fingerprint(s)
                f1.append(a)
                f2.append(b)
                wait.append(_cell(s))
                waiting += len(s)
                if waiting > 1 << 20:
                    counts += np.bincount(np.concatenate(wait), minlength=len(counts))
                    wait, waiting = [], 0
            yield _rows(batch.column(0), n, f1, f2, None, None)
        if wait:
            counts += np.bincount(np.concatenate(wait), minlength=len(counts))
        table = counts.reshape(-1, CELL_ROW)
        used = np.flatnonzero(table.any(1)).tolist()
        yield _rows(None, None, None, None, used, [zlib.compress(table[i].astype(np.uint32).tobytes(), 1) for i in used])
    return run


def _rows(doc, n, f1, f2, cell_row, counts) -> pa.RecordBatch:
    size = len(n) if n is not None else len(cell_row)
    cols = [(doc, pa.int64()), (n, pa.int64()), (f1, pa.int64()), (f2, pa.int64()), (cell_row, pa.int64()), (counts, pa.binary())]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in cols],
        names=["doc", "n", "f1", "f2", "cell_row", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(packed), np.uint32)
            total[row] = total[row] + own if row in total else own.astype(np.int64)
    # Classes of a quarter of an octave: an order needs no more, and a byte holds it.
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int64()),
         pa.array([np.minimum(4 * np.log2(t + 1.0), 255).astype(np.uint8).tobytes() for t in total.values()], pa.binary())],
        names=["cell_row", "classes"])


def _order(signatures: DataFrame) -> bytes:
    """The sketch as one byte for each counter: 2 MB on the driver and in each task, whatever the input's size."""
    classes = np.zeros((1 << CELLS_LOG2) // CELL_ROW * CELL_ROW, np.uint8).reshape(-1, CELL_ROW)
    merged = (signatures.filter("cell_row is not null").select("cell_row", "counts").repartition("cell_row")
              .mapInArrow(_add_up, "cell_row long, classes binary"))
    for row, packed in merged.collect():
        classes[row] = np.frombuffer(packed, np.uint8)
    return classes.tobytes()


def boundary(histogram: dict[int, int], percent: int) -> int:
    """The set size up to which subsets cost less than list entries (0: all sets are heavy)."""
    def cost(x: int) -> int:
        subsets = sum(c * comb(s - _overlap(s, percent) + 2, 2) for s, c in histogram.items() if s <= x)
        lists = sum(c * (s - _overlap(s, percent) + 1) for s, c in histogram.items() if s >= _overlap(x + 1, percent))
        return subsets + SCAN_COST * lists
    return min(range(MAX_LIGHT), key=cost)


def _postings(classes: bytes, light: int, width: int, percent: int):
    """(key, doc, n, place): subsets of light sets, single shingles of heavy sets and of their light partners.

    ``place`` is the shingle's in its set; of a subset, one less than its second shingle's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(classes, np.uint8)
        upper, lower = np.triu_indices(MAX_LIGHT + 2, 1)
        partner = _overlap(light + 1, percent)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # Equal sets of a batch: the least id speaks for them; so the least of all always does.
            least: dict[tuple[int, int], int] = {}
            keys_of: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]] = {}
            for i, s in _sets(batch, width):
                n = len(s)
                c = _overlap(n, percent)
                if n == 0 or (c == n and 100 * n // percent == n):
                    continue  # equal sets only could link
                f = _fingerprint(s)
                if f in least:
                    least[f] = min(least[f], ids[i])
                    continue
                least[f] = ids[i]
                ordered = s[np.argsort(rank[_cell(s)], kind="stable")[:n - c + 2]]
                keys, places = [], []
                if n > light or n >= partner:
                    keys.append(ordered[:n - c + 1])
                    places.append(np.arange(n - c + 1))
                if n <= light:
                    pick = lower < len(ordered)
                    keys.append(mix(mix(ordered[upper[pick]]) + ordered[lower[pick]]))
                    places.append(lower[pick] - 1)
                keys_of[f] = n, np.concatenate(keys), np.concatenate(places)
            size = [len(k) for _, k, _ in keys_of.values()]
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([k for _, k, _ in keys_of.values()] + none).view(np.int64)),
                 pa.array(np.repeat(np.array([least[f] for f in keys_of], np.int64), size)),
                 pa.array(np.repeat(np.array([n for n, _, _ in keys_of.values()], np.int32), size)),
                 pa.array(np.concatenate([p for _, _, p in keys_of.values()] + none).astype(np.int32))],
                names=["key", "doc", "n", "place"])
    return run


def _need(a: str, b: str, percent: int) -> Column:
    """Fewest shingles that linked sets of sizes a and b share."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def _can_link(percent: int) -> Column:
    """Of two entries of a key, (n, place) and (m, at): sizes and places allow a link."""
    need = _need("n", "m", percent)
    return (need <= F.least("n", "m")) & (F.col("place") + need <= F.col("n")) & (F.col("at") + need <= F.col("m"))


def _reach(n: str, place: str, percent: int) -> Column:
    """The largest set that an entry of size ``n`` at ``place`` can link with."""
    return F.expr(f"({100 + percent} * ({n} - {place})) div {percent} - {n}")


def _grade(percent: int) -> Column:
    """Class of set sizes: partners are in the same or a neighbouring one."""
    return F.col("n").cast("int") if percent == 100 else F.floor(F.log("n") / float(np.log(100 / percent))).cast("int")


def _near_grades(grade: str) -> Column:
    return F.explode(F.array(*[F.col(grade) + i for i in (-1, 0, 1)]))


def _with_pivots(now: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b): each entry of a key with ``PIVOTS`` others of each class of sizes: the foremost, and some that a hash picks
    anew in each turn. A large group of near copies is hit, and brought together, by few."""
    live = now.filter(_reach("n", "place", percent) >= F.expr(f"({percent} * n + 99) div 100")).withColumn("grade", _grade(percent))
    node = [F.col("doc").alias("b"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("component").alias("other")]
    picks = [F.min(F.struct(F.col("place").cast("long").alias("by"), *node))]
    picks += [F.min(F.struct(F.xxhash64("doc", F.lit(turn * PIVOTS + i)).alias("by"), *node)) for i in range(1, PIVOTS)]
    pivots = live.groupBy("key", "grade").agg(F.array(*picks).alias("picks")).select("key", F.explode("picks").alias("p"), "grade") \
        .select("key", "p.b", "p.m", "p.at", "p.other", _near_grades("grade").alias("grade")).distinct()
    return live.join(pivots, ["key", "grade"]).filter("component <> other").filter(_can_link(percent))


def _across(now: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of a key's entries in different components that sizes and places allow to link.

    A key's entries are dealt out by size and place. Which of these classes
    can link is settled among the classes, each one row; only entries of such
    classes meet. So documents that share a phrase, but have too many rarer
    shingles of their own before it, make no pairs, however many they are.
    """
    live = now.filter(_reach("n", "place", percent) >= F.expr(f"({percent} * n + 99) div 100"))
    classes = live.groupBy("key", "n", "place").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .withColumn("grade", _grade(percent))
    other = classes.select("key", F.col("n").alias("m"), F.col("place").alias("at"), F.col("low").alias("low2"), F.col("high").alias("high2"),
                           _near_grades("grade").alias("grade"))
    able = (classes.join(other, ["key", "grade"]).filter(_can_link(percent))
            .filter("n < m or (n = m and place <= at)").filter("low <> low2 or high <> high2 or low <> high"))
    left = live.join(able.select("key", "n", "place", "m", "at"), ["key", "n", "place"])
    right = live.select("key", F.col("n").alias("m"), F.col("place").alias("at"), F.col("doc").alias("b"), F.col("component").alias("other"))
    return left.join(right, ["key", "m", "at"]).filter("component <> other and (n <> m or place <> at or component < other)")


def _verify(width: int, percent: int):
    """Of (a, b, text_a, text_b): the pairs whose whole sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in batches:
            a, b = [], []
            texts_b = batch.column(3)
            ids_a, ids_b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            previous = None
            for i, s in _sets(batch.select([0, 2]), width):
                text = texts_b[i]
                if ids_b[i] != last_id or not (previous is not None and text.equals(previous)):
                    last_id, last = ids_b[i], next(_sets(batch.select([1, 3]).slice(i, 1), width))[1]
                previous = text
                both = len(np.intersect1d(s, last, assume_unique=True))
                if both and 100 * both >= percent * (len(s) + len(last) - both):
                    a.append(ids_a[i])
                    b.append(ids_b[i])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def near_groups(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    component_id is the least doc_id that links reach, the row's own included.
    """
    if not 50 < percent <= 100:
        raise ValueError("the threshold lies above 50 and up to 100 percent")
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signatures = materialize(
        source.mapInArrow(_signatures(width), "doc long, n long, f1 long, f2 long, cell_row long, counts binary"), "sets")
    own = signatures.filter("cell_row is null").select("doc", "n", "f1", "f2")
    nodes = materialize(own.filter("doc is not null and n > 0").groupBy("f1", "f2", "n").agg(F.min("doc").alias("node")), "nodes", slim=True)

    sizes = nodes.filter(F.col("n") <= MAX_LIGHT).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in sizes}, percent)
    postings = source.filter("doc is not null").mapInArrow(
        _postings(_order(signatures), light, width, percent), "key long, doc long, n int, place int")
    shared = materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "keys", slim=True)
    entries = materialize(postings.join(shared, "key"), "entries")
    found = _components(entries, source, width, percent)

    rows = own.join(nodes, ["f1", "f2", "n"], "left")
    rows = rows.join(found.withColumnRenamed("component", "linked"), "node", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("linked", "node", "doc"))
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _components(entries: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    # The entry where the key stands foremost leads; entries too far back for the smallest set of the key go.
    lead = F.min(F.struct(F.col("place").alias("at"), F.col("doc").alias("b"), F.col("n").alias("m")))
    leads = materialize(entries.groupBy("key").agg(lead.alias("lead"), F.min("n").alias("least")).select("key", "lead.*", "least"),
                        "leads", slim=True)
    smallest = F.greatest(F.col("least"), F.expr(f"({percent} * n + 99) div 100"))
    known = materialize(
        entries.join(leads, "key").withColumn("smallest", smallest).filter(F.col("place") + _need("n", "smallest", percent) <= F.col("n"))
        .select("key", "doc", "n", "place", "b", "m", "at"), "lists")
    pairs = materialize(known.filter("doc <> b").filter(_can_link(percent)).select(F.col("doc").alias("a"), "b").distinct(),
                        "pairs", slim=True)
    texts = materialize(source.join(known.filter("doc <> b or place <> at").select("doc").union(pairs.select("b")).distinct(), "doc"),
                        "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")).join(pairs, "a")
        both = left.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
        return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(
            _verify(width, percent), "a long, b long"), "links", slim=True)

    known = known.select("key", "doc", "n", "place")
    links, tried = verified(pairs), pairs
    found, stuck, before, turn = components(links), False, None, 0
    while True:
        parts = known.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
            "component", F.coalesce("component", "doc"))
        by_part = parts.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
        open_keys = materialize(by_part.groupBy("key").agg(
            F.count(F.lit(1)).alias("parts"), F.sum("c").alias("rows"),
            F.sum(F.col("c").cast("double") * F.col("c")).alias("squares")).filter("parts > 1"), "open", slim=True)
        todo = open_keys.selectExpr("sum(rows) AS rows", "sum((rows * double(rows) - squares) / 2) AS cross").first()
        if not todo["rows"]:
            break
        now = materialize(parts.join(open_keys.select("key"), "key"), "open-lists")
        # Rounds with a few nodes of each key go on as long as they bring components together.
        last = stuck or todo["cross"] <= ROUND_COST * todo["rows"] or (before is not None and todo["cross"] > 0.9 * before)
        before, turn = todo["cross"], turn + 1
        met = _across(now, percent) if last else _with_pivots(now, percent, turn)
        fresh = met.select(F.greatest("doc", "b").alias("a"), F.least("doc", "b").alias("b")).distinct()
        done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        fresh = materialize(fresh.join(done, ["a", "b"], "left_anti"), "pairs", slim=True)
        new = verified(fresh)
        tried = tried.union(fresh)
        stuck = new.isEmpty()
        if not stuck:
            links = links.union(new)
            found = components(links)
        if last:
            break
    return found


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but the near copies: of each group the document with the least id stays. Null ids stay."""
    drop = (near_groups(docs, width, percent).filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(materialize(drop, "near-copies"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all of ``documents``, shingles of four words, 85 percent."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
