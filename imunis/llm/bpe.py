"""Byte-level BPE: speculate, verify, repair.

A word (a piece of the pre-tokenizer) is first cut by greedy longest match.
That cut is the BPE encoding exactly when every two adjacent tokens are
compatible, that is, when merging their joined bytes gives the same two tokens
back: a merge across a boundary would need the two sides' pieces to meet before
either side is built up. Compatibility is tested for all adjacent pairs of a
batch of words at once, in numpy, by undoing merges on both sides of the
boundary from the latest to the earliest. Only words with an incompatible pair
go through the merges themselves.

Words repeat, so each Python worker remembers words it has met, within a
stated bound; the memory only saves work.

Defined results
  null text      counts as the empty text: no tokens, hash of nothing.
  control string (an added token's content) becomes that token wherever it stands.
  null doc_id    is carried through; repeated rows each give a row.
  very long text is one row; long words are merged with a heap.
  empty table    gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters with Unicode's White_Space property (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces of the byte-level pre-tokenizer (fixed pattern of this vocabulary).
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Coarser pieces whose ends are always ends of ``_PIECE``: cheap to find, worth remembering.
_CHUNK = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Words that one worker remembers; beyond it the memory starts afresh.
REMEMBERED = 300_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(moved)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_alphabet())}
        vocab = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.text = [b""] * size
        for word, i in vocab.items():
            self.text[i] = word
        for word, i in self.added.items():
            self.text[i] = word.encode()
        self.byte_id = [vocab.get(bytes([b]), -1) for b in range(256)]
        # Tokens as built by merges: rank of the merge, and its two parts.
        self._size = size
        self.pair_rank: dict[int, int] = {}
        self.made: list[int] = []
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(back[c] for c in part) for part in (m if isinstance(m, list) else m.split(" ")))
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.made.append(k)
            self.pair_rank.setdefault(i * size + j, r)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        codes = np.fromiter(self.pair_rank, np.int64, len(self.pair_rank))
        order = np.argsort(codes)
        self._codes = codes[order]
        self._code_rank = np.fromiter(self.pair_rank.values(), np.int64, len(codes))[order]
        # Greedy match proposes only tokens that the merges themselves arrive at; -1 marks a mere beginning.
        self.prefixes: dict[bytes, int] = {}
        for w, i in vocab.items():
            if len(w) == 1 or self.merge(w) == [i]:
                self.prefixes[w] = i
                for n in range(1, len(w)):
                    self.prefixes.setdefault(w[:n], -1)
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") \
            if self.added else None
        self.chunks: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The merges applied one by one: lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        return self._merge_long(ids) if len(ids) > 64 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, size, none = self.pair_rank.get, self._size, len(self.made)
        ranks = [get(a * size + b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i:i + 2] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] * size + ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] * size + ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap: n log n for words of any length."""
        get, size, n = self.pair_rank.get, self._size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        todo = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(todo)
        while todo:
            r, i, a, b = heapq.heappop(todo)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(todo, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        get = self.prefixes.get
        out, at, n = [], 0, len(word)
        while at < n:
            end, best = at + 1, at
            while end <= n and (found := get(word[at:end])) is not None:
                if found >= 0:
                    best, token = end, found
                end += 1
            out.append(token)
            at = best
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: would the merges leave the boundary between them alone?

        Walks back through the time at which the two sides were built. At any
        moment the boundary has the token that ends the left side and the one
        that starts the right side; a merge of the two would have happened if
        its rank came before the step in which the later one was made.
        """
        a, b = left.astype(np.int64), right.astype(np.int64)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        # Bound (rank, side) of the last undone step: on equal terms the left side's pairs come first.
        until = np.full(len(a), 2 * len(self.made) + 2, np.int64)
        while len(live):
            x, y, bound = a[live], b[live], until[live]
            code = x * self._size + y
            at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
            meets = (self._codes[at] == code) & (2 * self._code_rank[at] < bound)
            good[live[meets]] = False
            rx, ry = self.rank[x], self.rank[y]
            from_left = rx >= ry
            # Undoing the later-made side: a left part made at rank r loses to an equal-rank merge at the boundary only
            # if that merge stands further left, a right part to one of equal rank as well.
            a[live] = np.where(from_left & (rx >= 0), self.right[x], x)
            b[live] = np.where(~from_left & (ry >= 0), self.left[y], y)
            until[live] = np.where(from_left, 2 * rx, 2 * ry + 1)
            live = live[~meets & ((rx >= 0) | (ry >= 0))]
        return good

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: proposals, one vectorised test over all adjacent pairs, merges for the rest."""
        cut = [self.propose(w) for w in words]
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        flat = np.fromiter((i for c in cut for i in c), np.int64, int(size.sum()))
        if len(flat) > 1:
            word_of = np.repeat(np.arange(len(cut)), size)
            inner = word_of[1:] == word_of[:-1]
            pairs, back = np.unique(flat[:-1][inner] * self._size + flat[1:][inner], return_inverse=True)
            good = self.compatible(pairs // self._size, pairs % self._size)
            for w in np.unique(word_of[1:][inner][~good[back]]):
                cut[w] = self.merge(words[w])
        return cut

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks not met before and remember their ids as little-endian 32-bit bytes."""
        if len(self.chunks) > REMEMBERED:
            self.chunks = {}
        if len(self.words) > REMEMBERED:
            self.words = {}
        known = self.words
        pieces = {c: [p.encode() for p in _PIECE.findall(c)] for c in chunks}
        fresh = list({p for ps in pieces.values() for p in ps if p not in known})
        for word, ids in zip(fresh, self.encode_words(fresh)):
            known[word] = struct.pack(f"<{len(ids)}I", *ids)
        self.chunks.update((c, b"".join([known[p] for p in ps])) for c, ps in pieces.items())

    def encode_batch(self, texts: list[str], limit: int = 4_000_000) -> Iterator[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit integers.

        Texts are taken in groups of about ``limit`` characters, whose new
        words are encoded together in one vectorised test.
        """
        group: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            # Every second part is an added token's content, which stands for itself.
            group.append(self._added.split(text) if self._added and self._added.search(text) else [text])
            size += len(text)
            if size >= limit or i == len(texts) - 1:
                cut = [[_CHUNK.findall(p) if n % 2 == 0 else [p] for n, p in enumerate(parts)] for parts in group]
                fresh = {c for parts in cut for chunks in parts[::2] for c in chunks}
                fresh.difference_update(self.chunks)
                if len(self.chunks) > REMEMBERED:
                    fresh = {c for parts in cut for chunks in parts[::2] for c in chunks}
                self.learn(fresh)
                known = self.chunks
                for parts in cut:
                    yield b"".join([b"".join([known[c] for c in chunks]) if n % 2 == 0
                                    else struct.pack("<I", self.added[chunks[0]]) for n, chunks in enumerate(parts)])
                group, size = [], 0

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))

    def decode(self, ids: bytes) -> str:
        text = self.text
        return b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary at ``path``, read once by each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for,
    ``ids`` (array of int). ``path`` is the tokenizer file, which must be at
    the same place on every executor.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 512):
                out: list[tuple] = []
                part = texts[at:at + 512]
                for ids in bpe.encode_batch(part):
                    out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                hashlib.sha256(bpe.decode(ids).encode()).hexdigest(), ids if with_ids else None))
                cols = [batch.column(0).slice(at, 512), pa.array([o[0] for o in out], pa.int64()),
                        pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(o[3], "<u4").astype(np.int32) for o in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
