import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from runeflow.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = ["", " ", "a", "  a", "a  ", "hello world", "a \n b", "it's we'll 12 345", "über straße", "　x   y", "x" * 3000, "ab" * 700 + " " + "9" * 40, "🙂🙃 é", "a\x1cb \x1f c", " lead", "tail ", "<|endoftext|> x", "\r\n\r\n"]


def test_ids_are_the_librarys(library):
    rnd = random.Random(5)
    alphabet = "ab cé\n 1'st,.ñ漢🙂\t"
    texts = CASES + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(2000)]
    coder = bpe.load(PATH, P.PATTERN)
    for t, ids in zip(texts, coder.encode_batch(texts), strict=True):
        assert ids == library.encode_ordinary(t), t
        assert coder.decode_bytes(ids) == t.encode()


def test_long_rows(library):
    coder = bpe.load(PATH, P.PATTERN)
    rnd = random.Random(6)
    some = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    rows = ["z" * 600, "the" * 400, "qé" * 300, "=" * 1_000, "a" * 40_001, some("ab", 3_000), some("eéèthan", 4_000), some("漢字a", 900), some("abcdefghijklmnopqrstuvwxyz", 20_000), "ation" * 900 + "s"]
    rows += [some(some("abcdefghijklmnopqrstuvwxyzäöüé", 4), rnd.randrange(513, 1_200)) for _ in range(60)]
    for t in rows:
        assert coder.encode_batch([t])[0] == library.encode_ordinary(t), t[:40]


def test_short_rows_merge_as_long_ones():
    """Both ways of a row give the same ids, whatever its length."""
    coder = bpe.load(PATH, P.PATTERN)
    rnd = random.Random(7)
    tokens = ["".join(rnd.choice("abcdehinorstué=") for _ in range(rnd.randrange(2, 200))).encode() for _ in range(400)]
    assert coder._matrix(tokens) == [coder._long(t) for t in tokens]


def test_other_patterns_split_whole_texts(library):
    pattern = r"\p{Lu}?\p{Ll}+|\p{L}| ?\p{N}|\s+|[^\s\p{L}\p{N}]"
    own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=library._mergeable_ranks, special_tokens={})
    coder = bpe.load(PATH, pattern)
    for t in ["HelloWorld fooBar", "a  b 12 34", "it's aB,c"] + CASES:
        assert coder.encode_batch([t])[0] == own.encode_ordinary(t), t


def test_query_matches_library_on_whole_table(spark, library):
    rows = {r.doc_id: r for r in queries.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert rows[d.doc_id].n_tokens == len(ids)
        assert rows[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_nulls_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 7), (1, None, 7), (None, "a b", 8)], "doc_id long, text string, n_tokens int")
    out = bpe.bpe_digests(df, PATH, P.PATTERN)
    assert sorted(out.columns) == ["decoded_sha256", "doc_id", "ids_sha256", "n_tokens", "text"]
    assert sorted((r.n_tokens for r in out.collect())) == [0, 0, 2]
    assert bpe.bpe_digests(df.limit(0), PATH, P.PATTERN).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {bytes(r.decoded) for r in back} == {b"", b"a b"}
