"""Token counts against counting one by one."""

import base64

import public_tokenizers
import pytest
import tiktoken

from keyspan.llm import counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
CODER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, block int")
    sizes = [len(CODER.encode_ordinary(t or "")) for _, t in rows]
    got = {r.n_tokens: r for r in counts.token_counts(frame, PATH, public_tokenizers.PATTERN).collect()}
    assert set(got) == set(sizes)
    for n, r in got.items():
        assert r.n_docs == sizes.count(n)
        assert r.docs_over == sum(s > n for s in sizes) and r.tokens_over == sum(s for s in sizes if s > n)
        assert r.docs_total == len(sizes) and r.tokens_total == sum(sizes)
        assert r.truncated_total == sum(min(s, n) for s in sizes)
        assert r.quantile == sum(s <= n for s in sizes) / len(sizes)
    return sizes


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (4, "same"), (4, "same"), (5, "word " * 30_000), (6, "x " * 9000), (7, "é\n<|endoftext|>")]
    check(spark, rows)
    assert counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 7, 4096, 5000, 10**7])
def test_any_limit(spark, limit):
    sizes = [1, 1, 5, 9, 4100, 4100, 9000, 20_000]
    hist = counts.histogram(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n_tokens long"))
    row = counts.at_limit(counts.length_sums(hist), limit).collect()
    assert [tuple(r) for r in row] == [(sum(s > limit for s in sizes), sum(min(s, limit) for s in sizes))]


@pytest.mark.parametrize("share", [0.1, 0.25, 0.5, 0.51, 1.0])
def test_any_quantile(spark, share):
    sizes = sorted([3, 3, 3, 8, 8, 100, 5000, 9999])
    hist = counts.histogram(spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, n_tokens long"))
    want = next(s for s in sizes if sum(x <= s for x in sizes) / len(sizes) >= share)
    assert counts.at_quantile(counts.length_sums(hist), share).first()[0] == want
