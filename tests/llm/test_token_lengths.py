import math

from tidewatch.llm import queries, token_lengths


def test_suffix_sums_against_brute_force(spark):
    lengths = [0, 0, 1, 5, 5, 1023, 1024, 1025, 4000, 7]
    df = spark.createDataFrame([(n,) for n in lengths], "length long")
    got = {r.length: r for r in token_lengths.length_histogram(df).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r.n_docs == lengths.count(n)
        assert r.docs_at_least == sum(x >= n for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths)
        assert abs(r.quantile - sum(x <= n for x in lengths) / len(lengths)) < 1e-12


def test_encoding_matches_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    full.encode_special_tokens = True
    texts = ["Hello world's  end\n\n x", "", None, "Ünïcode ça 123 <|endoftext|>", "a" * 3000]
    got = token_lengths.encoded_lengths(spark.createDataFrame([(t, 1) for t in texts], "text string, length int")).collect()
    want = [len(full.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert sorted(r.length for r in got) == sorted(want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert token_lengths.length_histogram(token_lengths.encoded_lengths(df)).collect() == []


def test_any_limit_and_quantile_against_brute_force(spark):
    lengths = [0, 0, 1, 5, 5, 1023, 1024, 1025, 4000, 7]
    histogram = token_lengths.length_histogram(spark.createDataFrame([(n,) for n in lengths], "length long"))
    limits = [0, 1, 2, 5, 6, 64, 1023, 1024, 2000, 4000, 10**6]
    got = {r.limit: tuple(r)[1:] for r in token_lengths.at_limits(histogram, limits).collect()}
    kept = {n: sum(min(x, n) for x in lengths) for n in limits}
    assert got == {n: (sum(x <= n for x in lengths), sum(x > n for x in lengths), sum(lengths), kept[n], sum(lengths) - kept[n]) for n in limits}
    shares = [0.05, 0.1, 0.2, 0.5, 0.9, 1.0]
    found = {r.share: r.length for r in token_lengths.quantiles(histogram, shares).collect()}
    assert found == {q: sorted(lengths)[math.ceil(q * len(lengths) - 1e-9) - 1] for q in shares}
    assert [tuple(r) for r in token_lengths.at_limits(histogram.limit(0), [8]).collect()] == [(8, 0, 0, 0, 0, 0)]


def test_whole_query_against_the_public_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [None, ""]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = [len(full.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    got = {r.length: (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) for r in queries.op7_token_lengths(spark, str(tmp_path)).collect()}
    assert got == {k: (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n)) for k in set(n)}
