"""No text may end an executor or hang a task: a megabyte of one sign after another through every operator on texts."""

import time

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import bpe, fim, fmindex, langid, queries, records, simhash, surrogates, unigram, warc

MB = 1_000_000
TEXTS = {
    "dots": "mail x@" + "a." * (MB // 2) + "com", "starts": "a." * (MB // 2), "hyphens": "Mr. A" + "-b" * (MB // 2), "open": "<a " * (MB // 3), "open2": "<a b " * (MB // 5), "quotes": '<a href="' * (MB // 9), "comments": "<!-" * (MB // 3),
    "titles": "<title>" * (MB // 7), "at": "@" * MB, "digits": "1" * MB, "spaced": "1 " * (MB // 2), "word": "x" * MB, "spaces": " " * MB, "amps": "&#" * (MB // 2), "lt": "<" * MB, "names": "Dr. " * (MB // 4),
}
OPERATORS = {
    "surrogates": lambda d, s: surrogates.replace(d),
    "fim": lambda d, s: fim.digest(fim.transform(d)),
    "bpe": lambda d, s: bpe.encode(d, queries.BYTES, queries.public_tokenizers.PATTERN),
    "records": lambda d, s: records.encode_and_read(d, queries.TOKENIZER),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "unigram": lambda d, s: unigram.count_tokens(d, queries.PIECES, keep_text=False),
    "decontaminate": lambda d, s: fmindex.digest(fmindex.mark(d, s.createDataFrame([("i", "a b a b a b a b a b a b")], "item_id string, text string"))),
    "language": lambda d, s: langid.keep_known(d),
    "warc": lambda d, s: warc.derivatives(warc.responses(d.withColumnRenamed("text", "html"), "doc_id")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_megabyte_of_anything(spark, name):
    docs = spark.createDataFrame([(k, t, "en", "s", "http://h/") for k, t in enumerate(TEXTS.values())], "doc_id long, text string, lang string, source string, url string").repartition(len(TEXTS), "doc_id")
    began = time.time()
    out = OPERATORS[name](docs, spark)
    assert out.agg(F.count("*")).first()[0] is not None and out.select(F.hash(*out.columns)).agg(F.sum(F.lit(1))).first() is not None
    assert time.time() - began < 240


def test_people_are_one_across_titles(spark):
    docs = spark.createDataFrame([(1, "Dr. Alex Kim met Mr. Alex Kim. Mrs. Ana Kim and Dr. Ana Ray too.")], "doc_id long, text string")
    w = surrogates.replace(docs).first()["text"].replace(".", "").split()
    assert w[1:3] == w[5:7] and w[8] == w[12] != w[1] and w[9] == w[2] and "Alex" not in w and "Ana" not in w


def test_benchmark_blocks_are_searched_in_one_pass(spark):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    one = fmindex.mark(docs, benchmark)
    many = fmindex.mark(docs, benchmark, block_bytes=300)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    key = lambda df: sorted(map(tuple, fmindex.digest(df).collect()))
    assert key(one) == key(many) and any(r["contaminated"] for r in fmindex.digest(one).collect())


def test_only_sampled_places_are_kept():
    import numpy as np

    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 20_000)
    text[rng.integers(0, 20_000, 150)] = 0
    text[-1] = 0
    index = fmindex.FMIndex(text, 5)
    assert len(index.at) < 20_000 / fmindex.SAMPLE + 160
    for size in (1, 3, 5):
        phrases = rng.integers(1, 5, (20, size))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
