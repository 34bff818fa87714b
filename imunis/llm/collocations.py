"""Phrase collocations by multikey quicksort of suffix pointers, routed by leading words.

Phrases of 2 to ``LONGEST`` words that occur ``least`` times are counted and
scored. A phrase that occurs that often has only words that do, so rarer words
end a suffix, like the marks that end a piece.

Routing. A suffix (the next four words at a position) goes to a route by its
first two words, so that all suffixes with the same beginning meet in one task;
the number of routes follows the number of words. A pair that starts more than
``HEAVY`` of all suffixes would fill a route: the suffixes of such pairs are
dealt out by all their words, the counts of their beginnings are added up over
routes, and only then are infrequent ones left. Suffixes that a slice repeats
travel once, with their number.

Sorting. In a route a three-way multikey quicksort splits the pointers by one
word after another: smaller, equal, larger. A part with fewer than ``least``
occurrences is left at once, as nothing in it can reach them; the size of an
equal part is the count of the phrase up to that word, and its pointers go on to
the next word. Parts are numpy arrays, so a split is a few vector operations.

Scores, the rule that drops phrases inside longer ones, and ranks are joins and
windows over the frequent phrases. Products are decimals, and exact.

Defined results
  null, empty    no words. A null language is ``und``.
  no id is read; repeated rows count each time.
  ties           by phrase, in the order of its bytes.
  empty table    gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imunis.llm.chunks import by_chunk, pack, runs, unpack, word_lists
from imunis.llm.common import discard, materialize, ship
from imunis.llm.text import mix

LONGEST = 4
#: A suffix: its words' numbers (0 behind its end) and how often it occurs.
SUFFIX = np.dtype([(f"w{i}", "<u4") for i in range(LONGEST)] + [("n", "<u4")])
#: Words for each route, and routes at least.
ROUTE_WORDS, ROUTES = 1 << 21, 64
#: A pair of words that starts a larger share of a slice's suffixes is looked at over the corpus, and one that starts
#: half of it of all is dealt out; so there are at most 2 / HEAVY of these.
HEAVY = 1e-3
#: Positions whose suffixes are taken together.
SLICE = 1 << 16
#: Parts of the sort that are small enough to be sorted at once.
SMALL = 256


def suffixes(seq: np.ndarray, n: int | None = None) -> np.ndarray:
    """Distinct suffixes of two words or more at the first ``n`` places of a sequence in which 0 ends a piece, sorted, with their numbers."""
    n = len(seq) if n is None else n
    padded = np.concatenate([seq.astype(np.uint64), np.zeros(LONGEST, np.uint64)])
    words = [padded[i:n + i] for i in range(LONGEST)]
    for i in range(1, LONGEST):
        words[i] = np.where(words[i - 1] > 0, words[i], 0)
    keep = words[1] > 0
    first, rest = (words[0] << np.uint64(32) | words[1])[keep], (words[2] << np.uint64(32) | words[3])[keep]
    order = np.lexsort((rest, first))
    first, rest = first[order], rest[order]
    new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (rest[1:] != rest[:-1]))) if len(first) else np.zeros(0, np.int64)
    out = np.zeros(len(new), SUFFIX)
    low = np.uint64(0xFFFFFFFF)
    for i, x in enumerate((first[new] >> np.uint64(32), first[new] & low, rest[new] >> np.uint64(32), rest[new] & low)):
        out[f"w{i}"] = x
    out["n"] = np.diff(np.append(new, len(first)))
    return out


def _packed(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of ``sizes`` suffixes each."""
    return pack(np.stack([rows[f] for f in SUFFIX.names], 1).ravel(), np.asarray(sizes) * len(SUFFIX.names))


def _unpacked(col: pa.Array) -> np.ndarray:
    """All suffixes of a packed column."""
    values = unpack(col)[0].astype("<u4")
    return np.frombuffer(values.tobytes(), SUFFIX)


def pair_of(rows: np.ndarray) -> np.ndarray:
    return rows["w0"].astype(np.uint64) << np.uint64(32) | rows["w1"]


def multikey_quicksort(keys: list[np.ndarray], n: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, pointer, count): each beginning of keys[0..depth] that occurs ``least`` times, by one suffix that has it.

    ``n``: occurrences of each suffix; a key of 0 behind the first ends a suffix.
    """
    todo = [(np.arange(len(n)), 0, int(n.sum()))]
    while todo:
        at, depth, total = todo.pop()
        if total < least:
            continue
        key = keys[depth][at]
        if len(at) <= SMALL:
            # Small enough: all equal parts at once.
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(at))
            sums = np.add.reduceat(n[at], edges[:-1])
            equal = [(at[edges[i]:edges[i + 1]], int(sums[i])) for i in np.flatnonzero(sums >= least)]
        else:
            pivot = np.partition(key[:: max(1, len(key) // 9)], -(-len(key[:: max(1, len(key) // 9)]) // 2) - 1)[
                -(-len(key[:: max(1, len(key) // 9)]) // 2) - 1]
            smaller, larger = at[key < pivot], at[key > pivot]
            same = at[key == pivot]
            todo.append((smaller, depth, int(n[smaller].sum())))
            todo.append((larger, depth, int(n[larger].sum())))
            equal = [(same, int(n[same].sum()))]
        for same, count in equal:
            if count < least or (depth and not keys[depth][same[0]]):
                continue
            yield depth, int(same[0]), count
            if depth + 1 < len(keys):
                todo.append((same, depth + 1, count))


def _count_routes(least: int):
    """(kind, words, n): phrases of a route's suffixes; sorted input (route, heavy, packed)."""
    def count(held: list[np.ndarray], heavy: bool) -> pa.RecordBatch:
        rows = np.concatenate(held)
        keys = [pair_of(rows), *[rows[f"w{i}"] for i in range(2, LONGEST)]]
        # Heavy pairs' suffixes lie in several routes: their counts are parts, and none is left here.
        found = list(multikey_quicksort(keys, rows["n"].astype(np.int64), 1 if heavy else least))
        depth, at, n = (np.array([f[i] for f in found], np.int64) for i in range(3))
        sizes = depth + 2
        words = np.stack([rows[f"w{i}"][at] for i in range(LONGEST)], 1) if len(at) else np.zeros((0, LONGEST), np.uint32)
        flat = words[np.arange(LONGEST) < sizes[:, None]].astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat), pa.array(n)],
                                          names=["words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for route, heavy, part in runs(batches):
            if (route, heavy) != current:
                if held:
                    yield count(held, current[1] == 1)
                current, held = (route, heavy), []
            held.append(_unpacked(part.column(2)))
        if held:
            yield count(held, current[1] == 1)
    return run


def _number(words: DataFrame) -> DataFrame:
    """``words`` with dense numbers from 1 in ``id``, common words first: each task's rows behind those of the tasks before it."""
    placed = materialize(words.orderBy(F.desc("n"), "lang", "word").withColumn("place", F.monotonically_increasing_id()), "frequent-words")
    task = F.shiftright("place", 33)
    before = placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("rows"))  # a row for each task
    before = before.select("task", (F.sum("rows").over(Window.orderBy("task")) - F.col("rows")).alias("before"))
    return materialize(placed.withColumn("task", task).join(F.broadcast(before), "task")
                       .select("lang", "word", "n", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("id")), "numbered-words", slim=True)


def phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, frequent phrases, totals): (lang, word, n, id), (words: array of ids, n) of 2 to 4 words, and (lang, n).

    All that occur ``least`` times in a language; word ids tell languages apart.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.lit(True).alias("learnt"))
    lists = materialize(word_lists(rows, pieces=True), "pieces-by-chunk")
    listed, texts = lists.filter("kind = 0"), lists.filter("kind = 1")
    # A row for each language and chunk: the sum over all its words.
    totals = materialize(listed.groupBy("lang").agg(F.sum("n").alias("n")), "words-by-language", slim=True)
    words = _number(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    n_words = words.agg(F.sum("n")).first()[0] or 0
    n_routes = max(ROUTES, n_words // ROUTE_WORDS)

    def apply(emit):
        """Runs ``emit(chunk, sequence of word ids)`` over the chunks."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, ids, held = None, None, []
            for chunk, kind, part in runs(batches):
                if chunk != current:
                    if held:
                        yield from emit(current, np.concatenate(held))
                    current, ids, held = chunk, np.zeros(1 << 16, np.uint32), []
                if kind == 0:
                    at = part.column("at").to_numpy()
                    if at.max() >= len(ids):
                        ids = np.append(ids, np.zeros(max(len(ids), int(at.max()) + 1 - len(ids)), np.uint32))
                    ids[at] = part.column("id").to_numpy()
                    continue
                own, bounds = unpack(part.column("ids"))
                if len(own) and own.max() >= len(ids):  # words that no list has are rare
                    ids = np.append(ids, np.zeros(int(own.max()) + 1 - len(ids), np.uint32))
                held.append(np.insert(ids[own], bounds[1:], 0))
            if held:
                yield from emit(current, np.concatenate(held))
        return run

    def distinct(chunk: int, seq: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each slice's suffixes (pair null), and one for each pair that starts many of them."""
        for s in range(0, len(seq), SLICE):
            rows = suffixes(seq[s:s + SLICE + LONGEST], min(SLICE, len(seq) - s))
            if not len(rows):
                continue
            pair = pair_of(rows)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            sums = np.add.reduceat(rows["n"].astype(np.int64), first)
            many = np.flatnonzero(sums > HEAVY * sums.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([None] + pair[first[many]].astype(np.int64).tolist(), pa.int64()),
                 pa.array([int(sums.sum())] + sums[many].tolist(), pa.int64()),
                 pa.array(_packed(rows, [len(rows)]).to_pylist() + [None] * len(many), pa.binary())], names=["pair", "n", "packed"])

    known = listed.join(words.select("lang", "word", "id"), ["lang", "word"]).select("chunk", "kind", "at", "id")
    both = known.unionByName(texts.select("chunk", "kind", "ids"), allowMissingColumns=True)
    found = materialize(by_chunk(both).mapInArrow(apply(distinct), "pair long, n long, packed binary"), "suffixes")
    discard(lists)
    n_suffixes = found.filter("pair is null").agg(F.sum("n")).first()[0] or 0
    # At most 2 / HEAVY pairs.
    sums = found.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
    heavy = np.array(sorted(r.pair for r in sums.filter(F.col("n") > HEAVY * n_suffixes / 2).collect()), np.int64).view(np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = _unpacked(batch.column(0).slice(i, 1))
                pair = pair_of(rows)
                is_heavy = np.isin(pair, heavy)
                rest = rows["w2"].astype(np.uint64) << np.uint64(32) | rows["w3"]
                to = (mix(np.where(is_heavy, mix(pair) ^ rest, pair)) % np.uint64(n_routes)).astype(np.int64) * 2 + is_heavy
                order = np.argsort(to, kind="stable")
                to = to[order]
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[first] // 2, pa.int64()), pa.array((to[first] % 2).astype(np.int32)),
                     _packed(rows[order], np.diff(np.append(first, len(to))))], names=["route", "heavy", "packed"])

    routed = found.filter("pair is null").select("packed").mapInArrow(route, "route long, heavy int, packed binary")
    counted = routed.repartition("route").sortWithinPartitions("route", "heavy").mapInArrow(_count_routes(least), "words array<long>, n long")
    frequent = materialize(counted.groupBy("words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "frequent-phrases", slim=True)
    return words, frequent, totals


def score(words: DataFrame, frequent: DataFrame, absorbed: int = 80) -> DataFrame:
    """(words, a, l, r, score) of the phrases that no longer one absorbs.

    score: floor(2,000,000 a / (l + r)) at the cut that scores least; a phrase
    goes if a longer one that holds it occurs ``absorbed`` percent as often.
    """
    every = frequent.unionByName(words.select(F.array("id").alias("words"), "n"))
    parts = frequent.select("words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    side = lambda name: every.select(F.col("words").alias(name), F.col("n").alias(name[0]))
    cuts = (parts.withColumn("left", F.slice("words", F.lit(1), F.col("k")))
            .withColumn("right", F.expr("slice(words, k + 1, size(words) - k)"))
            .join(side("left"), "left").join(side("right"), "right")
            .select("words", "a", "l", "r", "k",
                    F.expr("cast((cast(a as decimal(20,0)) * 2000000bd) div (l + r) as long)").alias("score")))
    least = cuts.groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (frequent.filter(F.size("words") > 2)
             .select(F.col("n").alias("longer"), F.explode(F.expr(
                 "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")).alias("words"))
             .groupBy("words").agg(F.max("longer").alias("longer")))
    return (least.join(inner, "words", "left")
            .filter(f"longer is null or cast(longer as decimal(20,0)) * 100bd < cast(a as decimal(20,0)) * {absorbed}bd")
            .select("words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, absorbed: int = 80, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    words, frequent, totals = phrases(docs, least, text_col, lang_col)
    scored = score(words, frequent, absorbed)
    lang = words.select("lang", F.col("id").alias("first"))
    led = scored.withColumn("first", F.col("words")[0]).join(lang, "first")
    # Those in reach of the top by numbers alone, ties included; then their words, and the last order by phrase.
    numbers = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(led.withColumn("near", F.rank().over(numbers)).filter(F.col("near") <= top).drop("near", "first"), "near-top", slim=True)
    spelled = (near.select("lang", "words", "a", "l", "r", "score", F.posexplode("words").alias("at", "id"))
               .join(words.select("id", "word"), "id")
               .groupBy("lang", "words", "a", "l", "r", "score")
               .agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("spelled"))
               .withColumn("phrase", F.array_join(F.col("spelled.word"), " ")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every whole text of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
