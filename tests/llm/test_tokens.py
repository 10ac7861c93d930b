import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from runeflow.llm import queries, token_counts, token_files

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "x\x1cy z", "<|endoftext|> a <|startoftext|>", "é é Ǆ ΣΑΣ İ", "it's 12a3,b\n\n c", " lead", "tail ", "🙂 漢字", "a b c"]


def some_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "ab cé \n1',.漢\t🙂 the"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(n)]


def test_counts_are_the_librarys():
    lib = Tokenizer.from_file(WORD)
    texts = ODD + some_texts(1500, 1)
    assert token_counts.WordCounter(WORD).count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunks_are_spliced_exactly():
    lib = Tokenizer.from_file(WORD)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["the ", "qu1ck,", "\n", "é", "-- ", "<|endoftext|>"]) for _ in range(900)) for _ in range(20)]
    texts += ["".join(rnd.choice(["the", "qu1ck,", "'s", "'", "é", "e\u0301", "--", "<|endoftext|>", "9", "<\u0338", "."]) for _ in range(900)) for _ in range(40)]
    texts += ["x1y2" * 800, "word " * 700, "a" * 3000 + " b " + "c" * 3000]
    counter = token_counts.WordCounter(WORD, huge=200, chunk=300, overlap=8)
    assert counter.count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_texts_without_white_space_take_linear_time():
    lib, counter = Tokenizer.from_file(WORD), token_counts.WordCounter(WORD)
    rnd = random.Random(3)
    read = []
    starts = counter.starts
    counter.starts = lambda t: read.append(len(t)) or starts(t)
    for letters in ("ab,", "abcdefghijklmnopqrstuvwxyz0123456789.,;!", "abcé"):
        t = "".join(rnd.choice(letters) for _ in range(200_000))
        read.clear()
        assert counter.count([t]) == [len(lib.encode(t, add_special_tokens=False).ids)]
        assert sum(read) <= 3 * len(t)


def test_op3_on_whole_table(spark):
    lib = Tokenizer.from_file(WORD)
    rows = {r.doc_id: r for r in queries.op3_token_counts(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes, rows[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 2048)


def test_op3_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "a b", None)], "doc_id long, text string, n_tokens string")
    assert sorted(r.n_tokens for r in token_counts.token_counts(df, WORD).collect()) == [0, 0, 2]
    assert token_counts.token_counts(df.limit(0), WORD).count() == 0


def test_byte_encoder_is_the_library():
    lib = Tokenizer.from_file(BYTE)
    texts = ODD + some_texts(1500, 3)
    coder = token_files.ByteEncoder(BYTE)
    for t, data in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(data, coder.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_op2_files_hold_the_librarys_ids(spark):
    lib = Tokenizer.from_file(BYTE)
    rows = {r.doc_id: r for r in queries.op2_token_files(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect(), key=lambda d: d.doc_id):
        ids = [*lib.encode(d.text or "", add_special_tokens=False).ids, 0]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2_edges_and_wanted_documents(spark, tmp_path):
    df = spark.createDataFrame([(5, "b c", 1), (None, "z", 2), (3, None, 3), (5, "b c", 4), (-2, "word " * 90_000, 5)], "doc_id long, text string, ids int")
    m = token_files.write_token_files(df, BYTE, f"file://{tmp_path}/a", rows_per_shard=2)
    got = token_files.read_token_files(m).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -2, 3, 5, 5]
    assert got[2].token_ids == [0]
    assert [r.doc_id for r in token_files.read_token_files(m, [5]).collect()] == [5, 5]
    empty = token_files.write_token_files(df.limit(0), BYTE, f"file://{tmp_path}/b")
    assert token_files.read_token_digests(empty).count() == 0


def test_a_damaged_frame_is_found():
    import zstandard

    frames, seek = token_files.pack(np.arange(10, dtype="<u2").tobytes(), 2, zstandard.ZstdCompressor())
    whole = frames + token_files.tail([(1, 0, 1, 10)], [seek], 2)
    assert token_files.Shard(io.BytesIO(whole), len(whole)).ids(0).tolist() == list(range(10))
    bad = bytearray(whole)
    bad[len(frames) - 3] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Shard(io.BytesIO(bytes(bad)), len(bad)).ids(0)
