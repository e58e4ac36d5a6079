"""Ranking from impact-ordered postings: blocks that can't bring a document among the k best aren't read.

A score is a weighted sum: 0.7 of a cosine, itself a sum over the query's terms, and 0.3 of the share of the query's n-grams that a document
has, which is no more than the number of its own over that of the query's. A posting's impact is the document's weight for the term over the
document's norm, so a query's weight for the term times a block's greatest impact bounds what the block can add. Blocks are read from the
greatest bound on until what is unread, together with all n-grams, stays below the k-th score found; of the documents met, those are scored
whose own bound reaches that score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.storage import kept
from . import semantic

#: Postings of a block; postings of a term that are put in order together (more are dealt into slices, each in its own order).
BLOCK, SLICE = 128, 1 << 16
#: What may be left unread while a first k-th score is looked for, and documents scored for it, for each result asked for. What may be left in
#: the end, as a part of what a line lies above all n-grams: the less, the fewer documents are scored. Room for rounding in bounds.
UNREAD, FIRST, NEAR, SLACK = 0.04, 16, 0.1, 1e-6


def postings(term_rows: DataFrame, df: DataFrame, norm_rows: DataFrame, gram_rows: DataFrame, size, key: str = "id") -> DataFrame:
    """(term, slice, block, top, n, docs): blocks of (key, impact, grams: how many n-grams it has) in descending order of impact, top being the first's.

    A term's postings are dealt into slices of about SLICE by a hash of the document, so none is sorted whole.
    """
    own = semantic.with_df(term_rows.select(key, "term", F.col("n").cast("int").alias("n")), df.select("term", F.col("df").cast("int").alias("df")))
    own = own.groupBy(key).agg(F.collect_list(F.struct("term", "n", "df")).alias("own"))  # a document's terms move as a row
    w = own.join(norm_rows.join(gram_rows.select(key, F.size("grams").alias("grams")), key), key).select(key, "norm", "grams", F.inline("own"))
    impact = F.coalesce(F.try_divide((F.log("n") + 1) * semantic._idf(size, F.col("df")), F.col("norm")), F.lit(0.0))
    w = w.select("term", key, "grams", "df", impact.cast("float").alias("impact"))  # within SLACK of it
    w = w.withColumn("slice", F.pmod(F.xxhash64(key), F.ceil(F.col("df") / SLICE)).cast("int"))
    order = Window.partitionBy("term", "slice").orderBy(F.desc("impact"), key)
    w = w.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    docs = F.sort_array(F.collect_list(F.struct((-F.col("impact")).alias("below"), F.col(key).alias("key"), "grams")))  # BLOCK at most
    blocks = w.groupBy("term", "slice", "block").agg(F.max("impact").alias("top"), F.count("*").alias("n"), docs.alias("docs"))
    return blocks.withColumn("docs", F.transform("docs", lambda d: F.struct(d["key"].alias("key"), (-d["below"]).alias("impact"), d["grams"].alias("grams"))))


def weights(queries: DataFrame, df: DataFrame, size) -> DataFrame:
    """(query_id, term, qw, q_norm) of queries with toks."""
    q = queries.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    q = q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("qw", (F.log("qn") + 1) * semantic._idf(size, F.col("df")))
    norms = q.groupBy("query_id").agg(F.sqrt(semantic._sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    return q.join(norms, "query_id")


def heads(blocks: DataFrame, weighed: DataFrame) -> DataFrame:
    """Of each query the blocks of its terms by descending bound: what a block can add at most, and the most that is left unread after and before it."""
    a = semantic.COSINE * F.col("qw") / F.col("q_norm")
    h = blocks.select("term", "slice", "block", "top", "n").join(weighed.where("q_norm > 0"), "term").withColumn("bound", a * F.col("top"))
    of_term = Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), "slice", "block")
    h = h.withColumn("less", F.col("bound") - F.coalesce(F.lead("bound").over(of_term), F.lit(0.0))).withColumn("first", F.when(F.row_number().over(of_term) == 1, F.col("bound")).otherwise(0.0))
    of_query = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term", "slice", "block")
    upto = of_query.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = of_query.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("first").over(Window.partitionBy("query_id"))
    return h.withColumn("left", whole - F.sum("less").over(upto)).withColumn("left_before", whole - F.coalesce(F.sum("less").over(before), F.lit(0.0)))


def _members(chosen: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, key, part, grams): what the chosen blocks' documents get from them."""
    read = chosen.select("query_id", "term", "slice", "block", "qw", "q_norm").join(blocks.select("term", "slice", "block", "docs"), ["term", "slice", "block"])
    each = read.select("query_id", (semantic.COSINE * F.col("qw") / F.col("q_norm")).alias("a"), F.inline("docs"))
    return each.groupBy("query_id", "key").agg(F.sum(F.col("a") * F.col("impact")).alias("part"), F.first("grams").alias("grams"))


def exact(pairs: DataFrame, weighed: DataFrame, q: DataFrame, term_rows: DataFrame, gram_rows: DataFrame, norm_rows: DataFrame, df: DataFrame, size, key: str = "id") -> DataFrame:
    """(query_id, key, score_q) of pairs (query_id, key), as semantic.rank() scores them. gram_rows: key and the set of a document's n-grams."""
    pairs = semantic.few(pairs.select(F.col("key").alias(key), "query_id"))
    terms = term_rows.join(semantic.few(weighed.select("query_id", "term", "qw", "df")), "term").join(pairs, ["query_id", key])  # only terms of queries move
    dots = terms.groupBy("query_id", key).agg(semantic._sum((F.log("n") + 1) * semantic._idf(size, F.col("df")) * F.col("qw")).alias("dot"))
    q_norms = weighed.select("query_id", "q_norm").distinct()
    near = dots.join(norm_rows, key).join(q_norms, "query_id").select("query_id", key, F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("q_norm")), F.lit(0.0)).alias("cosine"))
    share = F.size(F.array_intersect("q_grams", "grams")) / F.size("q_grams")
    both = gram_rows.join(pairs, key).join(semantic.few(q.select("query_id", "q_grams")), "query_id").select("query_id", key, share.alias("share")).join(near, ["query_id", key], "left")
    score = F.rint((semantic.COSINE * F.coalesce("cosine", F.lit(0.0)) + semantic.GRAMS * F.col("share")) * semantic.UNITS).cast("long")
    return both.select("query_id", F.col(key).alias("key"), score.alias("score_q"))


class Search:
    """One set of queries (query_id and a normalised text) against an index's tables: postings, terms, frequencies, norms, ngrams and documents."""

    def __init__(self, tables: dict[str, DataFrame], queries: DataFrame, k: int = 50, key: str = "id"):
        self.tables, self.k, self.key = tables, k, key
        self.size = F.lit(tables["documents"].count())
        self.asked = queries.select("query_id", "text")
        self.q = kept(queries.select("query_id", X.tokens(F.col("text")).alias("toks"), X.grams(F.col("text")).alias("q_grams")).where(F.size("toks") > 0))
        self.weighed = kept(weights(self.q, tables["frequencies"], self.size))
        self.blocks = tables["postings"].join(semantic.few(self.weighed.select("term").distinct()), "term", "left_semi")  # no others are read
        self.heads = kept(heads(self.blocks, self.weighed))

    def _exact(self, pairs: DataFrame) -> DataFrame:
        t = self.tables
        return kept(exact(kept(pairs), self.weighed, self.q, t["terms"], t["ngrams"], t["norms"], t["frequencies"], self.size, self.key))

    def _bounded(self, chosen: DataFrame) -> DataFrame:
        """(query_id, key, bound): of the documents in these blocks, what they get from them and can get by n-grams."""
        met = _members(chosen, self.blocks).join(self.q.select("query_id", F.size("q_grams").alias("asked")), "query_id")
        return met.select("query_id", "key", (F.col("part") + semantic.GRAMS * F.least(F.lit(1.0), F.col("grams") / F.col("asked"))).alias("bound"))

    def first(self) -> tuple[DataFrame, DataFrame]:
        """(scores of the most promising documents of each query's first blocks, each query's k-th best of them). Queries without a line above all n-grams have none."""
        met = self._bounded(self.heads.where(F.col("left_before") > UNREAD))
        hope = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "key"))
        some = self._exact(met.withColumn("r", hope).where(F.col("r") <= FIRST * self.k).select("query_id", "key"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score_q"))
        kth = some.withColumn("r", F.row_number().over(order)).where(F.col("r") == self.k).select("query_id", (F.col("score_q") / semantic.UNITS).alias("line"))
        return some, kept(kth.where(F.col("line") > semantic.GRAMS + SLACK))

    def chosen(self, lines: DataFrame) -> DataFrame:
        """The blocks that are read: until what is left can't lift a document over the query's line, nor many others near it."""
        return self.heads.join(F.broadcast(lines), "query_id").where(F.col("left_before") + SLACK >= NEAR * (F.col("line") - semantic.GRAMS))

    def candidates(self, chosen: DataFrame, lines: DataFrame) -> DataFrame:
        """(query_id, key): documents of those blocks whose own bound, with what is unread, reaches the line."""
        rest = chosen.groupBy("query_id").agg(F.min("left").alias("rest"))
        met = self._bounded(chosen).join(lines, "query_id").join(rest, "query_id")
        return met.where(F.col("bound") + F.col("rest") + SLACK >= F.col("line")).select("query_id", "key")

    def reading(self) -> DataFrame:
        """query_id, postings of its terms, how many of them are read, and documents scored."""
        some, lines = self.first()
        chosen = self.chosen(lines)
        pairs = self.candidates(chosen, lines).unionByName(some.select("query_id", "key")).distinct()
        every = self.heads.groupBy("query_id").agg(F.sum("n").alias("postings"))
        read = chosen.groupBy("query_id").agg(F.sum("n").alias("read"))
        return every.join(read, "query_id", "left").join(pairs.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id", "left")

    def rank(self) -> DataFrame:
        """query_id, rank, key, score_q: just the rows of semantic.rank() over all documents.

        Queries that no line above all n-grams was found for, such as misspelt ones, are held against all documents.
        """
        some, lines = self.first()
        rest = self.candidates(self.chosen(lines), lines).join(some.select("query_id", "key"), ["query_id", "key"], "left_anti")
        scored = some.join(lines, "query_id", "left_semi").unionByName(self._exact(rest))
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_q"), "key"))
        best = scored.where("score_q > 0").withColumn("rank", order).where(F.col("rank") <= self.k).select("query_id", "rank", F.col("key").alias(self.key), "score_q")
        others = kept(self.asked.join(self.q.select("query_id"), "query_id", "left_semi").join(lines, "query_id", "left_anti"))
        if others.isEmpty():
            return best
        t = self.tables
        whole = semantic.rank(t["documents"].select(self.key, "norm"), others, self.k, self.key, index=(t["terms"], t["frequencies"], t["norms"]))
        return best.unionByName(whole.select(best.columns))
