"""Chunks: some documents of one task, worked on together in numpy and joined again by their chunk number.

An operator that has to look up every token of every document in a table that
grows with the corpus would shuffle a row for each token. Instead a task takes
documents in chunks of bounded size, lists each distinct thing of a chunk once,
and stores the documents as small numbers that point into that list. The lists
are looked up by joins; the answers come back to their chunk, where they are
applied to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from imunis.llm.text import column_bytes


def chunked(batches: Iterator[pa.RecordBatch], text_at: int, size: int, rows: int = 1 << 14) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(chunk, rows): rows of at most ``size`` bytes of text, or one row that is longer, in a chunk of a number of its own."""
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    for batch in batches:
        _, bounds = column_bytes(batch.column(text_at))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield number, batch.slice(at, to - at)
            number += 1
            at = to


def by_chunk(df: DataFrame) -> DataFrame:
    """Rows of one chunk behind one another in one task, in order of ``kind``; the sort spills, so that any number fits."""
    return df.repartition("chunk").sortWithinPartitions("chunk", "kind")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(chunk, kind, rows): parts of sorted batches whose rows share both; columns 0 and 1 hold them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            yield int(chunk[s]), int(kind[s]), batch.slice(s, e - s)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each range, one range behind the other."""
    total = np.cumsum(sizes)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(starts - (total - sizes), sizes)


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose values are consecutive parts of ``data``, of ``sizes`` items each."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def pack(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of rows of ``sizes`` numbers each, seven bits a byte, the last byte of a number below 128."""
    values = values.astype(np.uint64)
    width = np.ones(len(values), np.int64)
    for k in range(1, 5):
        width += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        some = np.flatnonzero(width > k)
        if not len(some):
            break
        last = width[some] == k + 1
        out[ends[some] - width[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(last, 0, 128).astype(np.uint8)
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return binary(out, np.diff(at))


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a packed column (uint32), and the index of each row's first (n + 1 values)."""
    data, bounds = column_bytes(col)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(ends)]
    out = np.zeros(len(ends), np.uint32)
    width = ends - starts + 1
    for k in range(int(width.max()) if len(width) else 0):
        some = slice(None) if k == 0 else np.flatnonzero(width > k)
        out[some] |= (data[starts[some] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
    return out, np.searchsorted(starts, bounds)


#: What ends a piece of text, as one byte; no word holds it.
_END = bytes([b if chr(b) not in ".,;:!?\n\x0b\x0c\r" else ord(".") for b in range(256)])


class _Numbers(dict):
    """Numbers for words in order of appearance, shared with the other lists of a chunk."""

    def __init__(self, words: list):
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = len(self.words)
        return len(self.words)


def word_lists(docs: DataFrame, pieces: bool = False, size: int = 16 << 20) -> DataFrame:
    """Documents (doc_id, text, lang, learnt) as numbers that point into the word list of their chunk.

    A-Z are lower-cased; words are runs without white space. Rows of kind 0: a
    word of the chunk (``lang``, ``word``, its number ``at`` and ``n``, its
    occurrences in learnt documents). Rows of kind 1: a document (doc_id, lang,
    learnt, n words and ``ids``, packed). With ``pieces``, words do not
    span the end marks either, and a mark is number 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunked(batches, 1, size):
            words: list[bytes] = []
            langs: list = []
            lists: dict = {}
            learnt = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            ids, lengths = [], []
            data, bounds = column_bytes(batch.column(1))
            data = data.tobytes().lower()
            if pieces:
                data = data.translate(_END)
            for s, e, lang in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist()):
                text = data[s:e]
                if pieces:
                    text = text.replace(b".", b" . ")
                if lang not in lists:
                    lists[lang] = _Numbers(words)
                    if pieces:
                        lists[lang][b"."] = 0
                row = np.fromiter(map(lists[lang].__getitem__, text.split()), "<u4")
                langs.extend([lang] * (len(words) - len(langs)))
                ids.append(row)
                lengths.append(len(row))
            flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
            counts = np.bincount(flat[np.repeat(learnt, lengths)], minlength=len(words) + 1)[1:]
            n, m = batch.num_rows, len(words)
            none = {f: pa.nulls(n, t) for f, t in (("word", pa.string()), ("at", pa.int32()))}
            yield pa.RecordBatch.from_pydict({
                "chunk": np.full(n, chunk), "kind": np.ones(n, np.int32), "lang": batch.column(2), "word": none["word"], "at": none["at"],
                "n": pa.array(lengths, pa.int64()), "doc_id": batch.column(0), "learnt": pa.array(learnt),
                "ids": pack(flat, np.array(lengths, np.int64))}, schema=WORD_LISTS)
            for at in range(0, m, 1 << 16):
                part = slice(at, min(at + (1 << 16), m))
                k = part.stop - at
                yield pa.RecordBatch.from_pydict({
                    "chunk": np.full(k, chunk), "kind": np.zeros(k, np.int32), "lang": pa.array(langs[part], pa.string()),
                    "word": pa.array(words[part], pa.binary()).cast(pa.string()), "at": np.arange(at + 1, at + k + 1, dtype=np.int32),
                    "n": counts[part], "doc_id": pa.nulls(k, pa.int64()), "learnt": pa.nulls(k, pa.bool_()),
                    "ids": pa.nulls(k, pa.binary())}, schema=WORD_LISTS)

    return docs.select("doc_id", "text", "lang", "learnt").mapInArrow(
        run, "chunk long, kind int, lang string, word string, at int, n long, doc_id long, learnt boolean, ids binary")


WORD_LISTS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("at", pa.int32()),
                        ("n", pa.int64()), ("doc_id", pa.int64()), ("learnt", pa.bool_()), ("ids", pa.binary())])
