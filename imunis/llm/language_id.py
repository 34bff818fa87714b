"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte n-grams of its
letters, hashed to ``BUCKETS`` rows); a linear layer turns the average into one
score for each language. Both layers are trained together by stochastic
gradient descent in numpy, on the driver, on a bounded sample of labelled rows
(``TRAIN_ROWS``, shared out evenly over the languages, chosen by a hash of the
id). One row in five of the sample is kept out of training: on it, a
temperature makes the softmax's scores match how often they are right, and the
rejection threshold is set so that ``REJECTED`` of the rows known to be right
would be rejected at most.

At prediction embedding and linear layer are one table of BUCKETS x languages;
every whole text is scanned once, in place, without a shuffle.

Defined results
  null text, no letter  lang_pred "und", score 0, rejected.
  no labelled rows      every text is "und".
  null doc_id           held_out false; never trained on.
  repeated rows         each gives its row. Empty table: no rows.
  other columns         lang is read for training only; the rest not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.common import materialize, ship

#: Bound of the training sample.
TRAIN_ROWS = 3000
BUCKETS_LOG2 = 11
BUCKETS, DIM, GRAMS = 1 << BUCKETS_LOG2, 16, (2, 3, 4)
#: Share of right predictions on the calibration rows that rejection may cost.
REJECTED = 0.0005
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_BYTES = np.arange(256)
_KEEP = np.where(((_BYTES >= 97) & (_BYTES < 123)) | (_BYTES >= 128), _BYTES, 32).astype(np.uint8)
_PAD = " " * max(GRAMS)


def _count(data: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """rows x BUCKETS counts of the grams that start at the first len(row) bytes; ``data`` has at least three more."""
    out = np.zeros(rows << BUCKETS_LOG2)
    n = len(row)
    data = data.astype(np.uint32)
    letter = data != 32
    value = data[:n].copy()
    for k in range(1, max(GRAMS)):
        value |= data[k:n + k] << np.uint32(8 * k)
        if k + 1 in GRAMS:
            bucket = ((value + np.uint32(k * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS_LOG2)
            use = letter[:n] | letter[1:n + 1]
            out += np.bincount((row << BUCKETS_LOG2)[use] + bucket[use], minlength=len(out))
    return out.reshape(rows, BUCKETS)


def subword_counts(texts: list[str]) -> np.ndarray:
    """Texts x BUCKETS counts of hashed byte n-grams of the lower-cased texts; all but letters are spaces."""
    raw = [t.lower().encode() for t in texts]
    data = _KEEP[np.frombuffer(b"".join(_PAD.encode() + r for r in raw) + _PAD.encode(), np.uint8)]
    return _count(data, np.repeat(np.arange(len(raw)), [len(r) + len(_PAD) for r in raw]), len(raw))


def groups(texts: list[str], chars: int = 500_000, rows: int = 256) -> Iterator[slice]:
    """Consecutive texts of bounded number and, but for a single longer one, bounded length."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > chars or i - at >= rows):
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if texts:
        yield slice(at, len(texts))


def long_counts(texts: list[str], size: int = 1 << 20) -> np.ndarray:
    """``subword_counts`` in bounded memory: a single long text is counted in parts that overlap by what a gram spans."""
    if len(texts) != 1 or len(texts[0]) <= size:
        return subword_counts(texts)
    data = _KEEP[np.frombuffer(_PAD.encode() + texts[0].lower().encode() + _PAD.encode(), np.uint8)]
    n, out = len(data) - len(_PAD), np.zeros((1, BUCKETS))
    for at in range(0, n, size):
        to = min(at + size, n)
        out += _count(data[at:to + len(_PAD)], np.zeros(to - at, np.int64), 1)
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        return _softmax((counts @ self.table / total + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, labels: np.ndarray, langs: list[str], use: np.ndarray, epochs: int = 40, batch: int = 32,
          rate: float = 8.0, seed: int = 7) -> Model:
    """Stochastic gradient descent on the cross-entropy of embedding table and linear layer.

    ``x`` has a row of bucket frequencies for each example; the rows in ``use`` are learnt from.
    """
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    linear, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps = max(1, epochs * (len(use) // batch + 1))
    done = 0
    for _ in range(epochs):
        order = rng.permutation(use)
        for at in range(0, len(use), batch):
            rows = order[at:at + batch]
            step = rate * (1 - done / steps)
            done += 1
            mean = x[rows] @ embed
            wrong = _softmax(mean @ linear + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ linear.T
            linear -= step * (mean.T @ wrong)
            bias -= 0.1 * step * wrong.sum(0)
            embed -= step * (x[rows].T @ back) * 20
    return Model(langs, (embed @ linear).astype(np.float64), bias.astype(np.float64))


def calibrate(model: Model, counts: np.ndarray, labels: np.ndarray, rejected: float = REJECTED) -> None:
    """Temperature of least cross-entropy; threshold below nearly all right predictions."""
    if not len(counts):
        return
    def loss(t: float) -> float:
        model.temperature = t
        p = model.scores(counts)[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())
    model.temperature = min(np.geomspace(0.1, 10, 41), key=loss)
    p = model.scores(counts)
    right = p.max(1)[p.argmax(1) == labels]
    model.threshold = float(np.quantile(right, rejected)) if len(right) else 0.0


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled row: the whole text, and two passages of a few words, so that short texts are known as well."""
    for batch in batches:
        out = []
        for lang, order, text in zip(*(c.to_pylist() for c in batch.columns)):
            if not _LETTER.search(text):
                continue
            parts = text.split()
            picks = [" ".join(parts[at:at + width]) for at, width in
                     ((order % len(parts), 3 + order % 4), ((order >> 20) % len(parts), 8))] if parts else []
            for j, t in enumerate([text, *picks]):
                if _LETTER.search(t):
                    counts = long_counts([t])[0]
                    at = np.flatnonzero(counts)
                    out.append((lang, order, j, at.astype(np.uint16).tobytes(), counts[at].astype(np.float32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[i] for o in out], t) for i, t in
             enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
            names=["lang", "order", "part", "at", "counts"])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model | None:
    """Train on a sample of ``rows`` labelled rows at most, none of them held out."""
    ship(docs.sparkSession)
    labelled = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
                .filter("id is not null and text is not null and lang is not null").filter(~held_out("id"))
                .withColumn("order", F.shiftrightunsigned(F.xxhash64("id"), 1)))
    sizes = materialize(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "labels", slim=True)
    n_langs = sizes.count()
    if not n_langs:
        return None
    each = max(1, rows // n_langs)
    # A language's rows whose hash falls below its share of the range: about ``each`` of them. Hash times rows is about a
    # row's rank in its language, so that the limit cuts all languages at the same rank. Only ids and labels move.
    below = F.expr(f"order <= (9223372036854775807 div rows) * least(rows, {11 * each // 10 + 1})")
    rank = (F.col("order").cast("double") * F.col("rows")).alias("rank")
    drawn = (labelled.select("id", "lang", "order").join(sizes, "lang").filter(below).select("id", "lang", "order", rank)
             .orderBy("rank", "order", "lang").limit(rows).collect())
    ranks = {(r["order"], r["lang"]): r["rank"] for r in drawn}
    sample = (labelled.filter(F.col("id").isin(sorted({r["id"] for r in drawn}))).select("lang", "order", "text")
              .mapInArrow(_examples, "lang string, order long, part long, at binary, counts binary")
              .orderBy("part", "order", "lang", "at", "counts").limit(6 * rows).collect())
    sample = sorted((r for r in sample if (r["order"], r["lang"]) in ranks),
                    key=lambda r: (ranks[r["order"], r["lang"]], r["order"], r["part"], r["lang"], r["at"], r["counts"]))[:3 * rows]
    if not sample:
        return None
    langs = sorted({r["lang"] for r in sample})
    counts = np.zeros((len(sample), BUCKETS), np.float32)
    for i, r in enumerate(sample):
        counts[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    labels = np.array([langs.index(r["lang"]) for r in sample])
    kept_out = np.array([r["order"] % 5 == 0 for r in sample])
    del sample
    counts /= np.maximum(counts.sum(1, keepdims=True), 1)
    use = np.flatnonzero(~kept_out)
    model = train(counts, labels, langs, use if len(use) else np.arange(len(labels)))
    calibrate(model, counts[kept_out], labels[kept_out])
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted, one row for each input row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if _LETTER.search(t)] if model else []
            part = [texts[i] for i in known]
            for g in groups(part):
                p = model.scores(long_counts(part[g]))
                for i, row in zip(known[g], p):
                    lang[i], score[i] = model.langs[int(row.argmax())], row.max()
            accepted = [x != UNKNOWN and s >= model.threshold for x, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(accepted, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col)).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model accepts, with their columns; a filter in place, without a join."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if _LETTER.search(t)] if model else []
            part = [texts[i] for i in known]
            for g in groups(part):
                keep[known[g]] = model.scores(long_counts(part[g])).max(1) >= model.threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: train on ``documents`` without the held-out rows, predict all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
