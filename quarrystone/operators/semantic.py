"""Deterministic ranking: TF-IDF cosine and character n-grams, one shuffle by term and one by document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..functions.storage import kept, written
from ..functions.sums import fixed

COSINE, GRAMS, UNITS, LOW = 0.7, 0.3, 1_000_000_000, 200_000_000
#: n-grams of queries that are sent to all tasks at once.
BLOCK_GRAMS = 1 << 18
#: Rows of a side of a join that are sent to all tasks; rows of a document that are held to be compared.
SENT, HELD = 1 << 17, 1 << 20


def few(df: DataFrame) -> DataFrame:
    """df, sent to all tasks by a join if its rows are few. They are counted, so df is one that is kept or cheap; a checkpoint's own estimate of its size is far too high."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def terms(docs: DataFrame, key: str = "id", text: str = "norm") -> DataFrame:
    """(key, term, n): how often each token stands in a document.

    A row's tokens are counted where the row lies, so nothing is shuffled, but where rows share a key: their counts are added up then.
    """
    kind = T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(kind)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, often = [], [], []
            for j, low in enumerate(b.column(1)):
                n = X.counts(low.as_py())
                at.append((j, len(n)))
                found += n.keys()
                often += n.values()
                if len(found) >= 1 << 16 or j == b.num_rows - 1:
                    of = np.repeat(np.array([j for j, _ in at]), [n for _, n in at])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)).cast(arrow.types[0]), pa.array(found, arrow.types[1]), pa.array(often, arrow.types[2])], names=arrow.names)
                    at, found, often = [], [], []

    rows = docs.select(key, F.lower(text).alias("low")).where("low is not null").mapInArrow(counted, kind)
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy(key, "term").agg(F.sum("n").alias("n"))


def frequencies(term_rows: DataFrame) -> DataFrame:
    return term_rows.groupBy("term").agg(F.count("*").alias("df"))


def with_df(term_rows: DataFrame, df: DataFrame) -> DataFrame:
    """term_rows with df. The frequent terms' are sent to all tasks, so most rows stay where they lie, next to others of their document; only rows of the rest are shuffled."""
    sizes, least, total = {r["size"]: r["count"] for r in df.groupBy(F.floor(F.log2("df")).cast("int").alias("size")).count().collect()}, None, 0  # some 30 at most
    for size in sorted(sizes, reverse=True):
        total += sizes[size]
        if total > SENT:
            break
        least = size
    if total <= SENT:
        return term_rows.join(F.broadcast(df), "term")
    if least is None:
        return term_rows.join(df, "term")
    often = F.broadcast(df.where(F.floor(F.log2("df")) >= least))
    return term_rows.join(often, "term").unionByName(term_rows.join(often, "term", "left_anti").join(df, "term"))


def _sum(values: Column) -> Column:
    """A group's sum, exact and rounded once, the same in whatever order its rows come; products of weights lie within what fixed() holds."""
    return fixed(values)


def _idf(size: Column, df: Column) -> Column:
    return F.log((size + 1) / (df + 1)) + 1


def norms(term_rows: DataFrame, df: DataFrame, size: Column, key: str = "id") -> DataFrame:
    """(key, norm): the length of each document's vector of weights; documents without tokens have none."""
    w = with_df(term_rows, df).withColumn("w", (F.log("n") + 1) * _idf(size, F.col("df")))
    return w.groupBy(key).agg(F.sqrt(_sum(F.col("w") * F.col("w"))).alias("norm"))


def cosines(term_rows: DataFrame, df: DataFrame, norm_rows: DataFrame, asked: DataFrame, size: Column, key: str = "id") -> DataFrame:
    """(query_id, key, cosine) of queries (query_id, toks) and the documents that share a term with them: only terms of queries are joined."""
    q = asked.select("query_id", F.explode("toks").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    q = kept(q.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("qw", (F.log("qn") + 1) * _idf(size, F.col("df"))))
    q_norms = q.groupBy("query_id").agg(F.sqrt(_sum(F.col("qw") * F.col("qw"))).alias("q_norm"))
    w = term_rows.join(few(q), "term").withColumn("x", (F.log("n") + 1) * _idf(size, F.col("df")) * F.col("qw"))
    dots = w.groupBy("query_id", key).agg(_sum(F.col("x")).alias("dot"))
    both = dots.join(norm_rows, key).join(q_norms, "query_id")
    return both.select("query_id", key, F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("q_norm")), F.lit(0.0)).alias("cosine"))


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "id", text: str = "norm", index: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, rank, key, score_q: the k best documents of each query.

    queries: query_id and a normalised text. tf is 1 + ln n, idf is ln((N + 1) / (df + 1)) + 1 with N all documents, those without
    tokens too. Cosine and the share of the query's n-grams are weighed 0.7 to 0.3 and rounded half to even
    in units of 1e-9; zeros drop out; ties go by key in byte order. Only terms of queries are joined; n-grams are compared with every document, and each task
    passes on the k best of its documents for each query. A query without tokens has no rows.
    index: the terms, frequencies and norms of docs, if they are at hand; else they are made here.
    """
    docs = docs.select(key, text)
    q = kept(queries.select("query_id", X.tokens(F.col("text")).alias("toks"), X.grams(F.col("text")).alias("q_grams")).where(F.size("toks") > 0))
    if q.isEmpty():  # no terms are counted for nothing
        kind = T.StructType([q.schema["query_id"], T.StructField("rank", T.IntegerType()), docs.schema[key], T.StructField("score_q", T.LongType())])
        return q.sparkSession.createDataFrame([], kind)
    size = F.lit(docs.count())
    if index is None:
        t = written(terms(docs, key, text), "terms")
        df = written(frequencies(t), "frequencies")
        index = t, df, norms(t, df, size, key)
    close = cosines(*index, q.select("query_id", "toks"), size, key)
    best = scored(docs, q.select("query_id", "q_grams"), close, k, key, text)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score_q"), key))
    return best.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", key, "score_q")


_SIGNS = "abcdefghijklmnopqrstuvwxyz0123456789_"
_CODE = bytes(_SIGNS.find(chr(c)) + 1 if chr(c) in _SIGNS else 0 for c in range(256))
_WIDE = len(_SIGNS) + 1
_CJK = re.compile("[一-鿿]{2,}")


def _codes(data: np.ndarray) -> np.ndarray:
    """Numbers of the pairs and triples of word characters in coded text (0 separates); triples come after all pairs."""
    x = data.astype(np.int32)
    pair = (x[:-1] * _WIDE + x[1:])[(x[:-1] > 0) & (x[1:] > 0)]
    triple = ((x[:-2] * _WIDE + x[1:-1]) * _WIDE + x[2:])[(x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0)]
    return np.concatenate([pair, triple + _WIDE**2])


def _cjk(text: str) -> set[str]:
    return {s[k : k + n] for s in _CJK.findall(text) for n in (2, 3) for k in range(len(s) - n + 1)}


def scored(docs: DataFrame, q: DataFrame, close: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(query_id, key, score_q > 0): of each task's documents the k best for each query, by cosine and the share of the query's n-grams that they have.

    The queries are taken in blocks of a bounded number of n-grams, counted first. A document's n-grams are marked in a table of all pairs and
    triples of word characters (those of Chinese ones in a set), where a whole block is looked up at once.
    """
    total = q.agg(F.sum(F.size("q_grams"))).first()[0] or 0
    blocks, out = max(1, -(-total // BLOCK_GRAMS)), None
    kind = T.StructType([q.schema["query_id"], docs.schema[key], T.StructField("score_q", T.LongType())])
    arrow = to_arrow_schema(kind)
    block_of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    for b in range(blocks):
        rows = [r for r in q.where(block_of == b).select("query_id", "q_grams").collect() if r["q_grams"]]
        codes = [_codes(np.frombuffer(g.encode().translate(_CODE), np.uint8)).max() for r in rows for g in r["q_grams"] if g.isascii()]
        plain = [sum(g.isascii() for g in r["q_grams"]) for r in rows]
        others = [frozenset(g for g in r["q_grams"] if not g.isascii()) for r in rows]
        ids, sizes = [r["query_id"] for r in rows], np.array([len(r["q_grams"]) for r in rows])
        codes, owner = np.array(codes, np.int64), np.repeat(np.arange(len(rows)), plain)
        place = {i: j for j, i in enumerate(ids)}

        def each(batches, codes=codes, owner=owner, others=others, ids=ids, sizes=sizes, place=place):
            here = np.zeros(_WIDE**3 + _WIDE**2, bool)
            best, keys, rows = Best(k, len(ids)), [], []
            for b in batches:
                keys += b.column(0).to_pylist() if ids else []
                for t, near in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    low = (t or "").lower()
                    mine = _codes(np.frombuffer(low.encode("utf-8", "replace").translate(_CODE), np.uint8))
                    here[mine] = True
                    n = np.bincount(owner[here[codes]], minlength=len(ids))
                    here[mine] = False
                    if not low.isascii() and any(others):
                        own = _cjk(low)
                        n = n + np.array([len(own & o) for o in others])
                    cosine = np.zeros(len(ids))
                    for pair in near or ():
                        cosine[place[pair["query_id"]]] = pair["cosine"]
                    if ids:
                        rows.append(np.rint((COSINE * cosine + GRAMS * (n / sizes)) * UNITS).astype(np.int64))
                if len(keys) >= 4096:
                    best.add(keys, np.array(rows))
                    keys, rows = [], []
            if keys:
                best.add(keys, np.array(rows))
            of, at = np.nonzero(best.scores.T > 0)
            for j in range(0, len(at), 4096):
                cols = [[ids[c] for c in of[j : j + 4096]], [best.keys[c] for c in best.at[at[j : j + 4096], of[j : j + 4096]]], best.scores[at[j : j + 4096], of[j : j + 4096]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f) for c, f in zip(cols, arrow.types, strict=True)], names=kind.names)

        near = close.where(block_of == b).groupBy(F.col(key).alias("_near")).agg(F.collect_list(F.struct("query_id", "cosine")).alias("near"))  # no more than a block's queries
        part = docs.join(near, F.col(key) == F.col("_near"), "left").select(key, text, "near").mapInArrow(each, kind)
        out = part if out is None else out.unionByName(part)
    return out


class Best:
    """Of the rows added so far the k best of each column, ties to the smaller key; k rows of scores are held, and the keys that they name."""

    def __init__(self, k: int, columns: int):
        self.k, self.keys, self.scores, self.at = k, [], np.zeros((0, columns), np.int64), np.zeros((0, columns), np.int64)

    def add(self, keys: list, scores: np.ndarray) -> None:
        names = self.keys + keys
        order = np.empty(len(names), np.int64)
        order[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        new = np.broadcast_to(np.arange(len(self.keys), len(names))[:, None], scores.shape)
        scores, at = np.concatenate([self.scores, scores]), np.concatenate([self.at, new])
        first = np.lexsort((order[at], -scores), axis=0)[: self.k]
        self.scores, at = np.take_along_axis(scores, first, 0), np.take_along_axis(at, first, 0)
        named, self.at = np.unique(at, return_inverse=True)
        self.at, self.keys = self.at.reshape(at.shape), [names[n] for n in named]


def low_confidence(ranked: DataFrame) -> DataFrame:
    """query_id, best, low: whether no result of a query reaches 0.2."""
    return ranked.groupBy("query_id").agg(F.max("score_q").alias("best")).withColumn("low", F.col("best") < LOW)


def token_match(table: DataFrame, queries: DataFrame, value: str = "value", subject: str = "subject") -> DataFrame:
    """(query_id, subject): subjects of rows whose value has every token of the query; a query without tokens matches none.

    Each query goes to the values that hold its rarest token, and is held against those whole.
    """
    q = queries.select("query_id", F.array_distinct(X.plain_tokens(F.col("text"))).alias("q")).where(F.size("q") > 0)
    v = kept(table.select(subject, F.array_distinct(X.plain_tokens(F.col(value))).alias("v"), F.xxhash64(value).alias("row")).distinct())
    words = v.select("row", subject, F.explode("v").alias("t"))
    rarity = words.groupBy("t").agg(F.count("*").alias("df"))
    rare = q.select("query_id", "q", F.explode("q").alias("t")).join(rarity, "t").groupBy("query_id").agg(F.min_by("t", F.struct("df", "t")).alias("t"), F.first("q").alias("q"))
    hits = words.join(rare, "t").select("query_id", "q", "row", F.col(subject).alias("_of"))
    held = hits.join(v, (hits["row"] == v["row"]) & hits["_of"].eqNullSafe(v[subject]))
    return held.where(F.size(F.array_except("q", "v")) == 0).select("query_id", subject).distinct()


def structure_faults(term_rows: DataFrame, gram_rows: DataFrame, docs: DataFrame, metadata: dict, key: str = "id") -> DataFrame:
    """(rule, n): rules of an index's tables that don't hold, and by how many rows: keys, grammar, finite tf above zero, one row a key; known documents, all documents counted."""
    return failed(structure_rules(term_rows, gram_rows, key) | invariant_rules(term_rows, gram_rows, docs, metadata, key))


def structure_rules(term_rows: DataFrame, gram_rows: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Of each rule that the tables keep by themselves, how many rows break it (n)."""
    n = F.count("*").alias("n")
    if "grams" in gram_rows.columns:  # a document's set in a row
        length = F.size(F.filter("grams", lambda g: ~F.coalesce(F.length(g).isin(2, 3), F.lit(False))))
        once = gram_rows.groupBy(key).agg(F.sum(length).alias("odd"), F.sum(F.size("grams") - F.size(F.array_distinct("grams"))).alias("more"), n)
        once = kept(once)  # two rules and one pass over the sets
        grams = {"gram_length": once.where("odd > 0").agg(F.sum("odd").alias("n")), "gram_repeated": once.where("more > 0 or n > 1").agg(F.sum(F.col("more") + F.col("n") - 1).alias("n"))}
        grams = {name: df.select(F.coalesce("n", F.lit(0)).cast("long").alias("n")) for name, df in grams.items()}
    else:
        grams = {
            "gram_length": gram_rows.where(~F.coalesce(F.length("gram").isin(2, 3), F.lit(False))).agg(n),
            "gram_repeated": gram_rows.groupBy("gram", key).count().where("count > 1").agg(n),
        }
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return {
        "term_empty": term_rows.where(empty("term")).agg(n),
        "key_empty": term_rows.select(key).unionByName(gram_rows.select(key)).where(empty(key)).agg(n),
        "tf_illegal": term_rows.where(~F.coalesce((F.col("tf") > 0) & (F.col("tf") < float("inf")), F.lit(False))).agg(n),
        "term_repeated": _repeated(term_rows, key),
        **grams,
    }


def _repeated(term_rows: DataFrame, key: str) -> DataFrame:
    """(n): how many terms stand more than once in a document. Rows of a document mostly lie together and are compared there; those of documents that lie in several places are shuffled."""
    rows = term_rows.select(key, "term")
    kind = T.StructType([rows.schema[key], T.StructField("more", T.LongType())])
    arrow = to_arrow_schema(kind)

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        each = table.group_by([key, "term"]).aggregate([([], "count_all")])
        more = pc.cast(pc.greater(each["count_all"], 1), pa.int64())
        of = pa.table({key: each[key], "more": more}).group_by(key).aggregate([("more", "sum")])
        yield from pa.table([of[key].cast(arrow.types[0]), of["more_sum"].cast(pa.int64())], names=kind.names).to_batches()

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = t[key][-1]
            of_last = pc.fill_null(pc.equal(t[key], last), False) if last.is_valid else pc.is_null(t[key])
            held, done = t.filter(of_last), t.filter(pc.invert(of_last))
            if held.num_rows > HELD:
                held, done = None, t
            if done.num_rows:
                yield from counted(done)
        if held is not None and held.num_rows:
            yield from counted(held)

    seen = kept(rows.mapInArrow(together, kind).groupBy(key).agg(F.sum("more").alias("more"), F.count("*").alias("parts")))
    alone = seen.where("parts = 1").agg(F.coalesce(F.sum("more"), F.lit(0)).alias("n"))
    apart = few(seen.where("parts > 1").select(F.col(key).alias("_apart")))
    rest = rows.join(apart, F.col(key).eqNullSafe(F.col("_apart")), "left_semi").groupBy("term", key).count().where("count > 1").agg(F.count("*").alias("n"))
    return alone.unionByName(rest).agg(F.sum("n").alias("n"))


def invariant_rules(term_rows: DataFrame, gram_rows: DataFrame, docs: DataFrame, metadata: dict, key: str = "id") -> dict[str, DataFrame]:
    """The same of rules that hold the tables against the documents."""
    known = docs.select(F.col(key).alias("known"))
    counted = int(metadata.get("document_count", -1))
    return {
        "dangling": term_rows.select(key).union(gram_rows.select(key)).distinct().join(known, F.col(key) == F.col("known"), "left_anti").agg(F.count("*").alias("n")),
        "count": docs.agg((F.count("*") != F.lit(counted)).cast("long").alias("n")),
    }


def failed(rules: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("rule"), "n") for name, df in rules.items()]).where("n > 0")
