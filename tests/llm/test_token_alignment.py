"""op11 against the libraries' own tokens and a plain alignment of them."""

import hashlib
import time
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from imunis.llm import token_alignment
from imunis.llm.bpe import byte_alphabet

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", "a", "  a  b ", "hello\n\n  world\n x", "<|endoftext|> x </s> <s>", "▁ bad", "x▁", "日本語テキスト 日本", "😀😀 😀", "a" * 5000,
       "é" * 300 + " ź", " ", " \n", "\n ", "tab\tx \t y", "nul\0x", "a　b 　c", "it's  we'll", "def f():\n    return 1\n\n\n", "  ",
       "...   ...", "a", "x " * 3, "a\n b", "a\n  b", "   x"]


def plain(texts):
    """The same from whole texts, one by one."""
    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: b for b, c in enumerate(byte_alphabet())}

    def piece(i):
        text = b_side.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b_side.is_byte(i) else text.replace("▁", " ").encode()

    aligned, held = [], Counter()
    for text in texts:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_side.encode(text or "")
        parts = [bytes(back[c] for c in a_side.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            aligned.append(None)
            continue
        ends = [[sum(map(len, p[:i + 1])) for i in range(len(p))] if len(p) < 3000 else list(_running(p)) for p in parts]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            s, t = i, j
            while i < len(a) and ends[0][i] <= end:
                i += 1
            while j < len(b) and ends[1][j] <= end:
                j += 1
            groups.append((a[s:i], b[t:j]))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(links.keys())
        aligned.append((a, b, groups, links))
    highest = {}
    for (x, _), n in held.items():
        highest[x] = max(n, highest.get(x, 0))
    for found in aligned:
        if found is None:
            yield (0,) * 6 + ("",), ""
            continue
        a, b, groups, links = found
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if held[p] == highest[p[0]]),
               sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest()), text


def _running(parts):
    total = 0
    for p in parts:
        total += len(p)
        yield total


def test_odd_texts_equal_the_plain_alignment(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in token_alignment.align(docs, with_groups=True).documents.collect()}
    for i, (row, text) in enumerate(plain(ODD)):
        assert (tuple(got[i][c] for c in COLUMNS), got[i].groups) == (row, text), repr(ODD[i][:40] if ODD[i] else ODD[i])


def test_whole_table_equals_the_plain_alignment(spark, sf_small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.query(spark, sf_small).collect()}
    assert got == dict(zip(texts, (row for row, _ in plain(list(texts.values())))))


def test_small_chunks_memory_and_slices_change_nothing(spark, sf_small, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").limit(40).collect()] + ["x" * 700 + "y" * 300]
    windows = token_alignment.Windows(token_alignment.Tokenizers(token_alignment.default_vocabulary(), token_alignment.default_pieces()))
    n_b = len(windows.tokens.bytes_b)

    def pairs():
        found = windows.documents(texts)
        rows = list(token_alignment._pairs(found, windows.table(), n_b))
        assert all(len(set(x[0]) & set(y[0])) == 0 for x, y in zip(rows, rows[1:]))
        return [r for s in rows for r in zip(*(x.tolist() for x in s))], [[windows.text[w] for w in d] for d in found]

    whole = pairs()
    monkeypatch.setattr(token_alignment, "SLICE", 50)
    monkeypatch.setattr(token_alignment, "REMEMBERED", 10)
    monkeypatch.setattr(token_alignment, "CALL", 100)
    assert pairs() == whole


def test_only_windows_inside_a_piece_are_looked_up_by_their_ids():
    windows = token_alignment.Windows(token_alignment.Tokenizers(token_alignment.default_vocabulary(), token_alignment.default_pieces()))
    first, second = windows.documents([" ".join(f"word{i}" for i in range(500)), "word7 word7 word400"])
    assert first[7] == second[0] == second[1] and first[400] == second[2] and len(windows.text) == 500
    assert not windows.by_ids  # pieces of one window: nothing is done one by one
    one, two = windows.documents(["f():\n    return 1\n    return", "g():\n    return 1\n    return"])
    assert one[0] != two[0] and one[1:].tolist() == two[1:].tolist() and len(one) > 2
    assert len(windows.text) == 500 + len(set(one.tolist() + two.tolist()))


def test_long_white_space_is_cut_in_one_pass():
    windows = token_alignment.Windows(token_alignment.Tokenizers(token_alignment.default_vocabulary(), token_alignment.default_pieces()))
    began = time.process_time()
    assert windows.cut("a b" + " " * 30_000 + "c d") == ["a", "b", " " * 29_999 + "c", "d"]
    assert time.process_time() - began < 5  # 17 s when each space looks at all the white space before it


def test_null_ids_repeats_extra_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string")
    docs = docs.withColumn("chunk", F.lit("x")).withColumn("a", F.lit(1)).withColumn("n_docs", F.lit(None).cast("int"))
    rows = sorted(token_alignment.align(docs).documents.collect(), key=str)
    assert len(rows) == 4 and sum(r.count_sum == 3 * r.n_links > 0 and r.n_best == r.n_links for r in rows) == 3
    assert token_alignment.align(docs.limit(0)).documents.collect() == []


def test_pairs_are_counted_by_document(spark):
    docs = spark.createDataFrame([(1, "one one two"), (2, "one"), (3, "two two")], "doc_id long, text string")
    aligned = token_alignment.align(docs)
    assert sorted(r.n_docs for r in aligned.pairs.collect()) == [2, 2]
    assert {r.doc_id: (r.n_links, r.count_sum) for r in aligned.documents.collect()} == {1: (3, 6), 2: (1, 2), 3: (2, 4)}
    assert pytest.approx(1) == aligned.pairs.filter("best").count() / aligned.pairs.count()
