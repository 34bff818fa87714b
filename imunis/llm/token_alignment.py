"""Cross-tokenizer alignment by whitespace-token anchors.

Every text is tokenised in full by two tokenizers, a byte-level BPE (A, on
space + text) and a sentence-piece model (B, which adds the space itself). A
place where a token of A and a token of B both end and the next tokens of both
start with a space is an anchor; anchors split a document into windows of token
ids. A window's alignment (the groups between its common token ends, and the
pairs of tokens that share a group) depends on its ids alone, so it is kept and
worked out once.

Scale. Tokens are not shuffled. A task takes documents in chunks and emits one
row for each id pair of a chunk, with the chunk's documents that hold it as
packed numbers. Counts over the corpus are a grouped sum of these rows; the
counts return to the rows by a join on the pair, and the rows to their chunk,
where the documents' sums are made. A pair that every document holds has one
row in a chunk, and AQE splits its join.

Pieces of text are remembered: a text is cut before each space that
follows no white space, which is where both tokenizers start a new token
whatever stands around it (checked for the vocabulary when it is read, and for
each text cut by the tokens' ends). Ids, alignments and texts are thus those of
the whole text. New pieces are tokenised and aligned many at once, in numpy. A
piece that is one window needs no other key; the windows of a piece that has
several are kept under their id tuples.

Defined results
  null, empty    no tokens: zeros and '' for the groups.
  bytes differ   texts whose joined tokens are not space + text count as without tokens.
  special tokens their strings inside texts are plain text.
  null doc_id    is carried through; repeated rows each give a row and count as documents.
  very long text is a chunk of its own; a group's pairs are made in slices of bounded size.
  empty table    gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imunis.llm.bpe import byte_alphabet, default_vocabulary
from imunis.llm.chunks import binary, by_chunk, chunked, runs, spread
from imunis.llm.common import materialize, ship
from imunis.llm.text import column_bytes

#: Bytes of text in a chunk.
CHUNK = 3 << 20
#: Pieces of text that one worker remembers; beyond it the memory starts afresh.
REMEMBERED = 200_000
#: Characters tokenised in one call, and pairs made at a time.
CALL, SLICE = 1 << 17, 1 << 18
#: Characters with Unicode's White_Space property (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_AFTER_SPACE = re.compile(f" (?<=[{_SPACE}] )")
#: Ends of a piece that ends in white space or is empty.
_SPACES = frozenset(["", *re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))])

#: Documents of a chunk that hold a pair, with its links in each: nearly all have few links.
_NARROW = np.dtype([("doc", "<u2"), ("links", "u1")])
_WIDE = np.dtype([("doc", "<u2"), ("links", "<i8")])

_SCHEMA = ("chunk long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, "
           "a int, b int, n_docs long, wide boolean, docs binary")


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both vocabularies, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        added = {t["content"] for t in spec["added_tokens"]}
        size = self.a.get_vocab_size(True)
        self.bytes_a = [b""] * size
        for word, i in self.a.get_vocab(True).items():
            self.bytes_a[i] = word.encode() if word in added else bytes(back[c] for c in word)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([t[:1] == b" " for t in x]) for x in (self.bytes_a, self.bytes_b))
        first = spec.get("pre_tokenizer") or {}
        #: Whether texts may be cut before spaces: A's pieces end there, and no piece of B goes on after its first letter.
        self.cuts = (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not spec.get("normalizer")
                     and not any("▁" in p.lstrip("▁") for p in pieces))

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of the whole of ``text``, which starts with a space; None if either side's bytes differ from it."""
        data = text.encode()
        a = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids  # the same ids, without their places in the text
        b = self.b.encode(text[1:])
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


class _Numbers(dict):
    """Numbers for pieces of text in order of appearance."""

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        return number


class Windows:
    """Alignments of windows. Pieces of text point to their windows; windows inside a piece are shared by their id tuples."""

    def __init__(self, tokens: Tokenizers):
        self.tokens = tokens
        n_a, n_b = len(tokens.bytes_a), len(tokens.bytes_b)
        #: Text of each token in a groups string: of A inside its group, of A last of its side, and the same of B; their lengths.
        self.marks = np.array([f"{i}{mark}" for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)], object)
        self.mark_lengths = np.array([len(m) for m in self.marks], np.int64)
        self.forget()

    def forget(self) -> None:
        #: Number of each remembered piece of text; where its windows lie in ``windows``, and how many (-1: the bytes differ).
        self.of_text = _Numbers()
        self.piece_first, self.piece_size, self.windows = array("q"), array("q"), array("q")
        self.by_ids: dict[bytes, int] = {}
        #: For each window: its text and sizes, and where its entries of A lie.
        self.text: list[str] = []
        self.sizes = {k: array("q") for k in ("n_a", "n_b", "n_groups", "n_links", "first", "entries")}
        #: For each entry (an id of A in a group): id, occurrences, and where the group's ids of B lie; ids of B, occurrences.
        self.a, self.a_times, self.group_first, self.group_size = array("q"), array("q"), array("q"), array("q")
        self.b, self.b_times = array("q"), array("q")

    def cut(self, text: str) -> list[str]:
        """Pieces between which both tokenizers start anew; the space before each is left out."""
        if not self.tokens.cuts:
            return [text]
        parts = text.split(" ")
        out = parts
        if text[:1] == " " or _AFTER_SPACE.search(text):
            out, held = [], parts[:1]
            for part in parts[1:]:
                if held[-1][-1:] not in _SPACES:
                    out.append(" ".join(held))
                    held = []
                held.append(part)
            out.append(" ".join(held))
        if len(out) > 1 and not out[-1]:  # a last space alone is no text to B
            out[-2:] = [out[-2] + " "]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Tokenise and align pieces not met before, many in one call; their numbers follow the last."""
        base = len(self.piece_size)
        for column in (self.piece_first, self.piece_size):
            column.frombytes(bytes(column.itemsize * len(pieces)))
        group: list[int] = []
        size = 0
        for number, piece in enumerate(pieces):
            if piece[-1:] in _SPACES:
                self._align([piece], [base + number])  # the next piece's space would join its white space
                continue
            group.append(number)
            size += len(piece) + 1
            if size >= CALL:
                self._align([pieces[i] for i in group], [base + i for i in group])
                group, size = [], 0
        if group:
            self._align([pieces[i] for i in group], [base + i for i in group])

    def _place(self, numbers: list[int], first: np.ndarray | int, size: np.ndarray | int) -> None:
        """Where the windows of pieces lie."""
        for column, values in ((self.piece_first, first), (self.piece_size, size)):
            np.frombuffer(column, np.int64)[numbers] = values

    def _align(self, pieces: list[str], piece_numbers: list[int]) -> None:
        tokens = self.tokens
        n_a, n_b = len(tokens.bytes_a), len(tokens.bytes_b)
        ids = tokens.encode(" " + " ".join(pieces))
        starts = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, map(str.encode, pieces)), np.int64, len(pieces)) + 1, out=starts[1:])
        n = int(starts[-1])
        if ids is not None:
            a, b = ids
            to_a, to_b = np.cumsum(tokens.length_a[a]), np.cumsum(tokens.length_b[b])
            ends, others = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            ends[to_a], others[to_b] = True, True
            ends &= others  # where a token of A and one of B both end
        if ids is None or not ends[starts[1:]].all():
            if len(pieces) == 1:
                self._place(piece_numbers, 0, -1)
            else:
                for piece, number in zip(pieces, piece_numbers):
                    self._align([piece], [number])
            return
        groups = np.cumsum(ends)  # common ends up to each byte
        n_groups = int(groups[-1])
        group_a, group_b = groups[to_a - 1], groups[to_b - 1]
        cuts, others = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        cuts[(to_a - tokens.length_a[a])[tokens.spaced_a[a]]] = True
        others[(to_b - tokens.length_b[b])[tokens.spaced_b[b]]] = True
        cuts &= others  # anchors
        cuts[starts] = True
        cuts = np.flatnonzero(cuts)
        per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        before_a, before_b = (np.concatenate([[0], np.cumsum(x)]) for x in (per_a, per_b))
        links = np.concatenate([[0], np.cumsum(per_a * per_b)])
        # Distinct ids of each group on either side.
        entry, entry_times = np.unique(group_a * n_a + a, return_counts=True)
        entry_group, entry_id = np.divmod(entry, n_a)
        other, other_times = np.unique(group_b * n_b + b, return_counts=True)
        other_group, other_id = np.divmod(other, n_b)
        other_first = np.searchsorted(other_group, np.arange(n_groups + 1))
        base_entry, base_other = len(self.a), len(self.b)
        for column, values in ((self.a, entry_id), (self.a_times, entry_times), (self.group_first, other_first[entry_group] + base_other),
                               (self.group_size, np.diff(other_first)[entry_group]), (self.b, other_id), (self.b_times, other_times)):
            column.frombytes(values.astype(np.int64).tobytes())
        # The groups' text: a group's tokens of A, then those of B.
        marks = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = (np.append(x[1:] != x[:-1], True) for x in (group_a, group_b))
        marks[np.arange(len(a)) + before_b[group_a]] = a + n_a * last_a
        marks[np.arange(len(b)) + before_a[group_b + 1]] = b + n_b * last_b + 2 * n_a
        text = "".join(self.marks[marks].tolist())
        text_at = np.concatenate([[0], np.cumsum(self.mark_lengths[marks])])
        # Windows, by groups and by tokens.
        at = groups[cuts]
        a_at, b_at = before_a[at], before_b[at]
        first = np.searchsorted(entry_group, at)
        where = np.searchsorted(cuts, starts)
        size = np.diff(where)
        # A piece of one window is met here only; other windows are looked up by their ids.
        base = len(self.text)
        kept = np.repeat(size == 1, size)
        numbers = np.zeros(len(kept), np.int64)
        inner = np.flatnonzero(~kept)
        if len(inner):
            ids_a, ids_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
            between = b"\xff" * 4  # no id
            fresh = base
            for w, alone, s, e, t, u in zip(inner.tolist(), np.cumsum(kept)[inner].tolist(), a_at[inner].tolist(), a_at[inner + 1].tolist(),
                                            b_at[inner].tolist(), b_at[inner + 1].tolist()):
                number = self.by_ids.setdefault(ids_a[4 * s:4 * e] + between + ids_b[4 * t:4 * u], fresh + alone)
                if number == fresh + alone:
                    kept[w] = True
                    fresh += 1
                numbers[w] = number
        kept = np.flatnonzero(kept)
        numbers[kept] = np.arange(base, base + len(kept))
        rows = text_at[a_at + b_at]
        self.text.extend([text[s:e] for s, e in zip(rows[kept].tolist(), rows[kept + 1].tolist())])
        for column, values in zip(self.sizes.values(), (np.diff(a_at), np.diff(b_at), np.diff(at), np.diff(links[at]), first[:-1] + base_entry, np.diff(first))):
            column.frombytes(values[kept].astype(np.int64).tobytes())
        self._place(piece_numbers, where[:-1] + len(self.windows), size)
        self.windows.frombytes(numbers.tobytes())

    def documents(self, texts: list[str]) -> list[np.ndarray | None]:
        """The windows of each text; None for texts without tokens."""
        if len(self.of_text) > REMEMBERED:
            self.forget()
        cut = [self.cut(t) if t else [] for t in texts]
        ends = np.cumsum([len(c) for c in cut])
        known = len(self.of_text)
        pieces = np.fromiter(map(self.of_text.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]) if len(ends) else 0)
        self.learn(list(islice(self.of_text, known, None)))
        first, size, windows = (np.array(x, np.int64) for x in (self.piece_first, self.piece_size, self.windows))
        differ = size[pieces] < 0
        size = np.maximum(size[pieces], 0)
        flat = windows[spread(first[pieces], size)]
        total, differ = (np.concatenate([[0], np.cumsum(x)]) for x in (size, differ))
        return [flat[total[s]:total[e]] if s < e and differ[s] == differ[e] else None for s, e in zip([0, *ends.tolist()], ends.tolist())]

    def table(self) -> dict[str, np.ndarray]:
        columns = self.sizes | {"a": self.a, "a_times": self.a_times, "group_first": self.group_first,
                                "group_size": self.group_size, "b": self.b, "b_times": self.b_times}
        return {k: np.array(v, np.int64) for k, v in columns.items()}


def _flat(docs: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many windows each document has, and the windows of all."""
    return np.array([0 if d is None else len(d) for d in docs], np.int64), np.concatenate([np.zeros(0, np.int64), *[d for d in docs if d is not None]])


def _pairs(docs: list[np.ndarray | None], table: dict[str, np.ndarray], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, document, links), sorted and distinct, of a chunk; in slices that share no pair."""
    n_docs = len(docs)
    sizes, flat = _flat(docs)
    code, times = np.unique(np.repeat(np.arange(n_docs), sizes) * len(table["n_a"]) + flat, return_counts=True)
    if not len(code):
        return
    doc, window = np.divmod(code, len(table["n_a"]))
    entries = table["entries"][window]
    at = spread(table["first"][window], entries)
    doc, times = np.repeat(doc, entries), np.repeat(times, entries) * table["a_times"][at]
    order = np.argsort(table["a"][at], kind="stable")
    at, doc, times = at[order], doc[order], times[order]
    a, size = table["a"][at], table["group_size"][at]
    total = np.concatenate([[0], np.cumsum(size)])
    edges = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))  # where another id of A starts
    s = 0
    while s < len(a):
        e = int(edges[np.searchsorted(total[edges], total[s] + SLICE, "right") - 1])
        if e <= s:
            e = int(edges[np.searchsorted(edges, s, "right")])
        inner = spread(table["group_first"][at[s:e]], size[s:e])
        code = (np.repeat(a[s:e], size[s:e]) * n_b + table["b"][inner]) * n_docs + np.repeat(doc[s:e], size[s:e])
        links = np.repeat(times[s:e], size[s:e]) * table["b_times"][inner]
        order = np.argsort(code)
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        pair, holder = np.divmod(code[first], n_docs)
        yield pair, holder, np.add.reduceat(links[order], first)
        s = e


_LOADED: dict[tuple[str, str], Windows] = {}


def load(path_a: str, path_b: str) -> Windows:
    """Both vocabularies, read once by each Python worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Windows(Tokenizers(path_a, path_b))
    return _LOADED[path_a, path_b]


@dataclass
class Alignment:
    """``documents``: a row per document; ``pairs``: each linked id pair (a, b), the documents that hold it (n_docs), and best."""
    documents: DataFrame
    pairs: DataFrame


def _record(schema: pa.Schema, n: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("groups_sha256", pa.string()),
                    ("a", pa.int32()), ("b", pa.int32()), ("n_docs", pa.int64()), ("wide", pa.bool_()), ("docs", pa.binary())])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False) -> Alignment:
    """Align the tokens of both vocabularies in every whole text.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 and, if asked for, ``groups`` (`a1,a2|b1;a3|b2,b3`). The
    vocabulary files must be at the same place on every executor.
    """
    spark = docs.sparkSession
    ship(spark)
    path_a, path_b = path_a or default_vocabulary(), path_b or default_pieces()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = load(path_a, path_b)
        n_b = len(windows.tokens.bytes_b)
        for chunk, batch in chunked(batches, 1, CHUNK):
            found = windows.documents([t or "" for t in batch.column(1).to_pylist()])
            table, n = windows.table(), batch.num_rows
            sums = {}
            sizes, flat = _flat(found)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for name in ("n_a", "n_b", "n_groups", "n_links"):
                sums[name] = np.diff(np.concatenate([[0], np.cumsum(table[name][flat])])[ends])
            texts = ["" if d is None else "".join(map(windows.text.__getitem__, d.tolist()))[:-1] for d in found]
            hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]
            extra = {"groups": texts} if with_groups else {}
            yield _record(_ARROW, n, chunk=np.full(n, chunk), kind=np.zeros(n, np.int32), doc_id=batch.column(0), groups_sha256=hashes,
                          a=np.arange(n), **sums, **extra)
            for pair, holder, links in _pairs(found, table, n_b):
                for wide, kind in ((False, _NARROW), (True, _WIDE)):
                    mine = (links > 255) == wide
                    p = pair[mine]
                    if not len(p):
                        continue
                    packed = np.empty(len(p), kind)
                    packed["doc"], packed["links"] = holder[mine], links[mine]
                    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
                    sizes = np.diff(np.append(first, len(p)))
                    m = len(first)
                    yield _record(_ARROW, m, chunk=np.full(m, chunk), kind=np.ones(m, np.int32), a=p[first] // n_b, b=p[first] % n_b,
                                  n_docs=sizes, wide=np.full(m, wide), docs=binary(packed, sizes))

    linked = materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(link, _SCHEMA), "aligned")
    rows = linked.filter("kind = 1").select("chunk", "kind", "a", "b", "n_docs", "wide", "docs")
    counts = materialize(rows.groupBy("a", "b").agg(F.sum("n_docs").alias("count")), "pair-counts", slim=True)
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # at most a row for each id of A
    pairs = materialize(counts.join(F.broadcast(highest), "a")
                        .select("a", "b", F.col("count").alias("n_docs"), (F.col("count") == F.col("highest")).alias("best")), "pairs", slim=True)
    counted = rows.join(pairs.select("a", "b", F.col("n_docs").alias("count"), "best"), ["a", "b"]).select(
        "chunk", "kind", "wide", "docs", "n_docs", "count", "best")

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"] + ["groups"] * with_groups + ["groups_sha256"]
    out_schema = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in kept)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, best, sums = None, None, None

        def done() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            order = rows.column("at").to_numpy()
            return pa.RecordBatch.from_arrays(
                [rows.column(c).combine_chunks() if c not in ("n_best", "count_sum")
                 else pa.array({"n_best": best, "count_sum": sums}[c][order]) for c in kept], names=kept)

        for chunk, kind, rows in runs(batches):
            if chunk != current:
                if held:
                    yield done()
                held, current = [], chunk
                best, sums = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            if kind == 0:
                held.append(rows)
                continue
            data, bounds = column_bytes(rows.column("docs"))
            wide = rows.column("wide").to_numpy(zero_copy_only=False)
            sizes, count, top = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("n_docs", "count", "best"))
            for flag, kind_of in ((False, _NARROW), (True, _WIDE)):
                mine = wide == flag
                if not mine.any():
                    continue
                lengths = sizes[mine] * kind_of.itemsize
                part = np.frombuffer(data[spread(bounds[:-1][mine], lengths)].tobytes(), kind_of)
                links = part["links"].astype(np.int64)
                np.add.at(sums, part["doc"], links * np.repeat(count[mine], sizes[mine]))
                np.add.at(best, part["doc"], links * np.repeat(top[mine], sizes[mine]))
        if held:
            yield done()

    wanted = [c for c in kept if c not in ("n_best", "count_sum")]
    none = {"wide": "boolean", "docs": "binary", "n_docs": "long", "count": "long", "best": "boolean"}
    both = linked.filter("kind = 0").select("chunk", "kind", F.col("a").alias("at"), *wanted, *[F.lit(None).cast(t).alias(c) for c, t in none.items()]) \
        .unionByName(counted, allowMissingColumns=True)
    return Alignment(by_chunk(both).mapInArrow(total, out_schema), pairs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every whole text of ``documents``."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents
