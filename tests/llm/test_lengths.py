import collections

from ledgerleaf.llm import lengths
from ledgerleaf.llm.queries import tokenizer_path


def test_sums_answer_every_limit(spark, docs, listed):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    own = sorted(len(reference.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in listed)
    histogram = lengths.encoded_lengths(docs, tokenizer_path())
    assert {r.length: r.documents for r in histogram.collect()} == collections.Counter(own)
    sums = lengths.suffix_sums(histogram)
    for r in sums.collect():
        assert (r.documents_within, r.tokens_kept) == (sum(n <= r.length for n in own), sum(min(n, r.length) for n in own))
    limits = [1, 50, 512, 2048, 1_000_000]
    found = {r.context_limit: r for r in lengths.truncated_totals(sums, spark.createDataFrame([(x,) for x in limits], "context_limit long")).collect()}
    for x in limits:
        assert found[x].tokens_kept == sum(min(n, x) for n in own)
        assert found[x].documents_cut == sum(n > x for n in own)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    for r in lengths.quantiles(sums, shares).collect():
        assert r.length == min(n for n in own if sum(m <= n for m in own) >= r.share * len(own))


def test_empty_table(spark, none):
    sums = lengths.suffix_sums(lengths.encoded_lengths(none, tokenizer_path()))
    limits = spark.createDataFrame([(10,)], "context_limit long")
    assert [tuple(r) for r in lengths.truncated_totals(sums, limits).collect()] == [(10, 0, 0, 0)]
    assert [r.length for r in lengths.quantiles(sums, [0.5]).collect()] == [None]
