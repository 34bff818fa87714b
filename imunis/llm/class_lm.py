"""Scores of a Brown class-based bigram model, with classes from exchange clustering.

P(word | word before) = P(class | class before) * P(word | class).

Words. Every word that makes up ``SHARE`` of the training tokens is a unit of
its own (so there are at most 1 / SHARE of these); all rarer words, unseen ones
included, fall into ``RARE`` units by their last letters. A document ends in one
unit of its own, which also stands before its first word.

Classes. Exchange clustering assigns the units to classes: in each round every
unit moves to the class that raises the class bigrams' likelihood most, given
its counts with the classes around it. Units are dealt to ``LANES`` lanes by
their number; a lane moves its units one after another, and lanes are put
together after the round. A round that does not raise the likelihood is taken
back and ends the exchange. The counts with neighbouring classes come from the
whole training text, by joins and grouped sums; only sums over classes and the
units' classes, both bounded, reach the driver.

Smoothing. Class transitions: absolute discounting, the discounted mass spread
by the classes' own probability. Words: a rare unit's words lose ``discount``
each, from the numbers of words seen once and twice, and an unseen word of the
unit gets what they lost. All probabilities of a context sum to one, counting
the unseen words of a unit as one word.

Scale. Documents stay with their chunk as numbers; the words of a chunk are
looked up once by joins (``chunks``), and each document becomes its sequence of
units, over which bigrams are counted and scores summed without a shuffle.

Defined results
  null, empty    one token, the end.
  null doc_id    is carried through and learnt from; repeated rows each give a row and count.
  no training text: base_score 0, every word unseen; scores are finite.
  empty table    gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imunis.llm.chunks import by_chunk, pack, runs, unpack, word_lists
from imunis.llm.common import discard, materialize, ship

#: Share of the training tokens, and occurrences, from which on a word is a unit of its own.
SHARE, LEAST = 1e-5, 5
#: Units of rarer words.
RARE = 4096
CLASSES, ROUNDS, LANES = 64, 6, 16
#: Pseudo count of base_score, a fixed value of its definition.
BASE = 0.1
#: Bigrams that a task holds before it counts them.
HELD = 1 << 22
#: Discount of class transitions, and pseudo count of a rare unit and of a class.
DISCOUNT, PSEUDO = 0.5, 0.5


def rare_unit(word: str, n_frequent: int) -> Column:
    """The unit of a rare word: those of the frequent words come before."""
    return (1 + n_frequent + F.pmod(F.xxhash64(F.substring(word, -3, 3)), F.lit(RARE))).cast("int")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(n: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, up to what does not depend on the classes."""
    return float(xlogx(n).sum() - xlogx(n.sum(0)).sum() - xlogx(n.sum(1)).sum())


def gains(n: np.ndarray, after: np.ndarray, before: np.ndarray, own: float) -> np.ndarray:
    """What the likelihood gains when a unit that is in no class joins each class, up to what is the same for all.

    ``n``: class bigrams without the unit; ``after`` and ``before``: its
    bigrams with each class behind and before it, without its ``own`` pairs.
    """
    some = after > 0
    out = (xlogx(n[:, some] + after[some]) - xlogx(n[:, some])).sum(1)
    some = before > 0
    out += (xlogx(n[some] + before[some, None]) - xlogx(n[some])).sum(0)
    diagonal = n.diagonal()
    out += xlogx(diagonal + after + before + own) + xlogx(diagonal) - xlogx(diagonal + after) - xlogx(diagonal + before)
    # The others' totals keep their bigrams with the unit, wherever it goes.
    for total, more in ((n.sum(1) + before, after.sum() + own), (n.sum(0) + after, before.sum() + own)):
        out -= xlogx(total + more) - xlogx(total)
    return out


def exchange(n: np.ndarray, units: list[tuple[int, int, np.ndarray, np.ndarray, float]]) -> list[int]:
    """New classes of units (unit, class, after, before, own), moved one after another; class 0 is the end's alone."""
    n = n.astype(float).copy()
    out = []
    for _, old, after, before, own in units:
        n[old] -= after
        n[:, old] -= before
        n[old, old] += own
        after, before = after.copy(), before.copy()
        after[old] -= own
        before[old] -= own
        gain = gains(n, after, before, own)
        gain[0] = -math.inf
        new = int(np.argmax(gain))
        if gain[new] <= gain[old] + 1e-9:
            new = old
        n[new] += after
        n[:, new] += before
        n[new, new] += own
        out.append(new)
    return out


@dataclass
class Scored:
    """``documents``: their scores; ``words``: each training word with its count, unit and class."""
    documents: DataFrame
    words: DataFrame
    #: Class of each unit, class bigrams in training, and the likelihood after each round of the exchange.
    units: np.ndarray
    transitions: np.ndarray
    likelihoods: list[float]


def _bigrams(n_units: int):
    """(pair, n): bigrams of units in the sequences, counted by task."""
    def count(held: list[np.ndarray]) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"pair": pair, "n": n})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            seq = unpack(batch.column(0))[0].astype(np.int64)
            if not len(seq):
                continue
            held.append(np.concatenate([[0], seq[:-1]]) * n_units + seq)  # every sequence ends in 0, the end
            size += len(seq)
            if size >= HELD:
                yield count(held)
                held, size = [], 0
        if held:
            yield count(held)
    return run


def _cluster(spark: SparkSession, bigrams: DataFrame, n_units: int, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each unit, class bigrams and the likelihood after each round."""
    k = CLASSES
    order = np.argsort(-totals[1:], kind="stable") + 1
    classes = np.zeros(n_units, np.int32)
    classes[order] = 1 + np.arange(len(order)) % (k - 1)

    def measured(classes: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        """Each unit's counts with the classes behind (0..k-1) and before it (k..2k-1), and the class bigrams."""
        known = F.broadcast(spark.createDataFrame(pd.DataFrame({"unit": np.arange(n_units), "class": classes}), "unit int, class int"))
        behind = bigrams.join(known.withColumnRenamed("unit", "w"), "w").select(F.col("v").alias("unit"), "class", "n", "own")
        ahead = bigrams.join(known.withColumnRenamed("unit", "v"), "v").select(
            F.col("w").alias("unit"), (F.col("class") + k).alias("class"), "n", F.lit(0).cast("long").alias("own"))
        profile = materialize(
            behind.union(ahead).groupBy("unit", "class").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
            .groupBy("unit").agg(F.collect_list(F.struct("class", "n")).alias("counts"), F.sum("own").alias("own")), "profiles", slim=True)
        n = np.zeros((k, k))
        sums = (profile.join(known, "unit").select(F.col("class").alias("c"), F.explode("counts").alias("x"))
                .filter(F.col("x.class") < k).groupBy("c", F.col("x.class").alias("d")).agg(F.sum("x.n").alias("n")))
        for c, d, x in sums.collect():  # k * k rows at most
            n[c, d] = x
        return profile, n

    def moves(n: np.ndarray, classes: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = []
            for batch in batches:
                for unit, counts, own in zip(*(c.to_pylist() for c in batch.columns)):
                    profile = np.zeros(2 * k)
                    for x in counts:
                        profile[x["class"]] = x["n"]
                    rows.append((unit, int(classes[unit]), profile[:k], profile[k:], float(own)))
            rows.sort(key=lambda r: r[0])
            for lane in range(LANES):
                mine = [r for r in rows if r[0] % LANES == lane]
                if mine:
                    yield pa.RecordBatch.from_pydict({"unit": pa.array([r[0] for r in mine], pa.int32()),
                                                      "class": pa.array(exchange(n, mine), pa.int32())})
        return run

    profile, n = measured(classes)
    reached = [likelihood(n)]
    for _ in range(ROUNDS):
        lanes = profile.filter("unit > 0").repartition(LANES, F.pmod("unit", F.lit(LANES))).select("unit", "counts", "own")
        now = classes.copy()
        for unit, new in lanes.mapInArrow(moves(n, classes), "unit int, class int").collect():  # a row for each unit, a bounded number
            now[unit] = new
        next_profile, next_n = measured(now)
        if likelihood(next_n) <= reached[-1]:
            break
        profile, n, classes = next_profile, next_n, now
        reached.append(likelihood(n))
    return classes, n, reached


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> Scored:
    """Learn from the documents that are not ``held_out`` and score all of them.

    Documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score and perplexity.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"),
                       (~F.coalesce(held_out, F.lit(False))).alias("learnt"))
    lists = materialize(word_lists(rows), "words-by-chunk")
    listed, texts = lists.filter("kind = 0"), lists.filter("kind = 1")
    n_ends = texts.filter("learnt").count()
    n_train = n_ends + (listed.agg(F.sum("n")).first()[0] or 0)
    least = max(LEAST, SHARE * n_train)
    # Each word's count comes to all its chunks in one shuffle. A word has one row in a chunk, so no word has many rows.
    # The word itself goes on with its first row and, where it is frequent, with all.
    of_word = Window.partitionBy("word")
    first = F.row_number().over(of_word.orderBy("chunk", "at")) == 1
    looked_up = materialize(
        listed.select("chunk", "kind", "at", "word", F.sum("n").over(of_word).alias("n"), first.alias("first"))
        .select("chunk", "kind", "at", "n", rare_unit("word", 0).alias("rare"), "first",
                F.when(F.col("first") | (F.col("n") >= least), F.col("word")).alias("word")), "words-looked-up")
    words = looked_up.filter("first and n > 0")
    n_distinct = words.count() + (n_ends > 0)
    frequent = sorted((-r.n, r.word) for r in words.filter(F.col("n") >= least).select("n", "word").collect())  # at most 1 / SHARE rows
    n_frequent = len(frequent)
    n_units = 1 + n_frequent + RARE
    own_units = spark.createDataFrame([(w, i) for i, (_, w) in enumerate(frequent, 1)], "word string, own int")

    def with_units(rows: DataFrame) -> DataFrame:
        unit = F.coalesce("own", F.col("rare") + n_frequent).alias("unit")
        return rows.join(F.broadcast(own_units), "word", "left").select(*[c for c in rows.columns if c != "rare"], unit)

    words = with_units(words).select("word", "n", "unit")
    totals, distinct = np.zeros(n_units), np.zeros(n_units)
    once = twice = 0
    sums = words.groupBy("unit").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.count_if(F.col("n") == 1).alias("once"),
                                     F.count_if(F.col("n") == 2).alias("twice"))
    for r in sums.collect():  # a row for each unit
        totals[r.unit], distinct[r.unit] = r.n, r.words
        if r.unit > n_frequent:
            once, twice = once + r.once, twice + r.twice
    totals[0] = n_ends
    discount = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5

    scale = n_train + BASE * (n_distinct + 1)
    end_base = math.log10((n_ends + BASE) / scale)

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, units, counts = None, None, None
        for chunk, kind, part in runs(batches):
            if chunk != current:
                current, units, counts = chunk, np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
                ready = False
            if kind == 0:
                at = part.column("at").to_numpy()
                if at.max() >= len(units):
                    more = max(len(units), int(at.max()) + 1 - len(units))
                    units, counts = np.append(units, np.zeros(more, np.uint32)), np.append(counts, np.zeros(more, np.int64))
                units[at], counts[at] = part.column("unit").to_numpy(), part.column("n").to_numpy()
                continue
            if not ready:
                base = np.log10((counts + BASE) / scale)
                rare = units > n_frequent
                total, kinds = totals[units], distinct[units]
                share = np.where(counts > 0, counts - discount, discount * kinds) / np.maximum(total, 1)
                within = np.log10(np.where(rare & (total > 0), share, 1.0))
                ready = True
            ids, ends = unpack(part.column("ids"))
            sizes = np.diff(ends)
            filled = np.flatnonzero(sizes)
            sums = {}
            for name, values in (("known", (counts > 0).astype(float)), ("base", base), ("within", within)):
                sums[name] = np.zeros(len(sizes))
                if len(filled):
                    sums[name][filled] = np.add.reduceat(values[ids], ends[:-1][filled])
            seq = np.insert(units[ids], ends[1:], 0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "held_out": pa.array(~part.column("learnt").to_numpy(zero_copy_only=False).astype(bool)),
                "n_tokens": sizes + 1, "n_known": sums["known"].astype(np.int64) + (n_ends > 0), "base_score": sums["base"] + end_base,
                "within": sums["within"], "units": pack(seq, sizes + 1)})

    both = with_units(looked_up).select("chunk", "kind", "at", "n", "unit").unionByName(
        texts.select("chunk", "kind", "doc_id", "learnt", "ids"), allowMissingColumns=True)
    found = materialize(by_chunk(both).mapInArrow(
        sequences, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, units binary"), "unit-sequences")

    discard(lists)
    pairs = found.filter("not held_out").select("units").mapInArrow(_bigrams(n_units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    v, w = F.expr(f"cast(pair div {n_units} as int)"), F.expr(f"cast(pair % {n_units} as int)")
    bigrams = materialize(pairs.select(v.alias("v"), w.alias("w"), "n", F.when(v == w, F.col("n")).otherwise(0).alias("own")), "unit-bigrams")
    classes, n, reached = _cluster(spark, bigrams, n_units, totals)

    # log10 of P(class | class before) and, for each unit, of P(unit | class).
    own = n.sum(0) + PSEUDO
    own /= own.sum()
    before = n.sum(1, keepdims=True)
    smooth = (np.maximum(n - DISCOUNT, 0) + DISCOUNT * (n > 0).sum(1, keepdims=True) * own) / np.maximum(before, 1)
    log_step = np.log10(np.where(before > 0, smooth, own))
    weight = totals + PSEUDO * (np.arange(n_units) > n_frequent)
    class_weight = np.bincount(classes, weights=weight, minlength=CLASSES)
    log_unit = np.log10(np.maximum(weight, 1e-300) / np.maximum(class_weight[classes], 1e-300))
    log_unit[0] = 0.0

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, starts = unpack(batch.column("units"))
            if not len(seq):
                continue
            c = classes[seq]
            before = np.concatenate([[0], c[:-1]])
            score = np.add.reduceat(log_step[before, c] + log_unit[seq], starts[:-1]) + batch.column("within").to_numpy()
            tokens = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_pydict({
                **{x: batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")}, "train_tokens": np.full(len(tokens), n_train),
                "base_score": batch.column("base_score"), "score": score, "perplexity": 10 ** (-score / tokens)})

    scored = found.mapInArrow(scores, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
                                      "score double, perplexity double")
    of_unit = spark.createDataFrame(pd.DataFrame({"unit": np.arange(n_units), "class": classes}), "unit int, class int")
    return Scored(scored, words.join(F.broadcast(of_unit), "unit").select("word", "n", "unit", "class"), classes, n, reached)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return train_and_score(docs, held_out).documents
