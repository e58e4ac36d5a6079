"""Tokenizers and n-grams as column expressions; only Unicode normalisation leaves the JVM, and only where a text needs it."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning of their own (fixed values).
STOPWORDS = """
the a an of to in is are was were be been being and or but if then than that this these those it its as at by for from on with without
do does did not no yes can could will would should may might must have has had i you he she we they me him her us them your their my our
what which who whom when where why how all any both each few more most other some such only own same so too very s t just now
的 了 和 是 在 我 有 也 就 不 人 都 一 一个 上
""".split()

#: Runs of ASCII word characters or of common Chinese characters; all else separates.
SEGMENT = "[一-鿿]+|[a-z0-9_]+"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normal form KC, by Arrow batches."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding, which lower() isn't: a sharp s becomes ss."""
    return text.map(lambda t: None if t is None else t.casefold())


def normalised(docs: DataFrame, text: str = "text", out: str = "norm") -> DataFrame:
    """docs with the text in NFKC; texts of ASCII are in it already and stay in the JVM. A pattern of more signs that never change costs far more than the normalisation."""
    plain = F.coalesce(F.octet_length(text) == F.length(text), F.lit(True))
    rest = docs.where(~plain).withColumn(out, nfkc(F.col(text)))
    return docs.where(plain).withColumn(out, F.col(text)).unionByName(rest)


def segments(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SEGMENT), F.lit(0))


def pieces(word: Column, n: int) -> Column:
    """All substrings of n neighbouring characters, in order."""
    many = F.length(word) - (n - 1)
    return F.when(many > 0, F.transform(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Tokens of a normalised text in order, repeats kept: ASCII runs of two characters or more, neighbouring pairs of Chinese ones; no stop words."""
    long = F.regexp_extract_all(F.lower(text), F.lit("[一-鿿]{2,}|[a-z0-9_]{2,}"), F.lit(0))
    paired = F.flatten(F.transform(long, lambda s: F.when(s >= "一", pieces(s, 2)).otherwise(F.array(s))))
    return F.filter(F.when(text.rlike("[一-鿿]"), paired).otherwise(long), lambda t: ~t.isin(*STOPWORDS))


_LONG, _CJK = re.compile("[一-鿿]{2,}|[a-z0-9_]{2,}"), re.compile("[一-鿿]")
_APART = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for c in range(256))
_STOPPED = [w.encode() for w in STOPWORDS]


def counts(low: str) -> dict:
    """How often each token of a lower-cased normalised text stands in it: the tokens of tokens(), those of ASCII as bytes."""
    if not low.isascii() and _CJK.search(low):
        words = [[s[k : k + 2] for k in range(len(s) - 1)] if s >= "一" else [s] for s in _LONG.findall(low)]
        n = Counter(w.encode() for ws in words for w in ws)
    else:
        n = Counter(low.encode("utf-8", "replace").translate(_APART).split())
        for w in [w for w in n if len(w) < 2]:
            del n[w]
    for w in _STOPPED:
        n.pop(w, None)
    return n


def grams(text: Column) -> Column:
    """The set of neighbouring pairs and triples of characters in the segments of a normalised text; stop words count."""
    both = F.transform(F.array_distinct(segments(text)), lambda s: F.concat(pieces(s, 2), pieces(s, 3)))
    return F.array_distinct(F.flatten(both))


def runs(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script. It lowers and doesn't fold; see casefold()."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
