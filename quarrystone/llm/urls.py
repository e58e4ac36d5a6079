"""URL filter: rules, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, hold, widened

#: (verdict, host and path); of those that fit, the longest decides.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Labelled rows of each class that the trees are fitted on, at most.
FIT_ROWS = 10_000
ROUNDS, DEPTH, BINS, RATE = 40, 3, 32, 0.2
#: Rows of mean rate that smooth a suffix's rate.
SMOOTH = 5.0
SUFFIXES = 3
#: Hosts are dealt into so many folds; a url is judged by what the other folds' hosts say.
FOLDS = 5
#: Rates of so many suffixes are broadcast (some 20 MB); more are joined on the suffix and a salt, so that a hot one is dealt out.
BROADCAST_ROWS, SALTS = 200_000, 32

#: Host terms of the seed labels, where no labelled table is given.
SEED_TERMS = ("pills", "casino", "bets", "adult", "spam", "ads")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and subdomains where the path begins with its own."""
    rule = verdict = F.lit(None).cast("string")
    for what, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        at, _, rest = r.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "longest_label")


def lexical(url: str | None, host: str) -> list[float]:
    """Numbers of a url, in the order of FEATURES; null counts as empty. Lengths, shares and entropies are those of its bytes."""
    raw, name = (url or "").encode("utf-8", "replace"), host.encode("utf-8", "replace")
    rest = raw.partition(b"://")[2]
    path = rest[len(name) :].partition(b"?")[0].partition(b"#")[0]
    query = rest.partition(b"?")[2].partition(b"#")[0]
    counts = [np.bincount(np.frombuffer(x, np.uint8), minlength=256) for x in (raw, name)]

    def entropy(n: np.ndarray) -> float:
        p = n[n > 0] / max(1, n.sum())
        return float(-(p * np.log2(p)).sum())

    digits = [float(n[48:58].sum() / max(1, n.sum())) for n in counts]
    labels = name.split(b".")
    filled = lambda parts: sum(1 for x in parts if x)
    return [len(raw), len(name), len(path), filled(path.split(b"/")), len(labels), *digits, int(counts[1][45]), *map(entropy, counts), filled(query.split(b"&")), max(map(len, labels))]


class Trees:
    """Boosted regression trees on logistic loss over binned features; a tree is a heap of DEPTH levels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
        self.base, self.trees, self.depth = 0.0, [], depth
        total, (n, width) = np.zeros(len(y)), b.shape
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, bins, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                first, many = 2**level - 1, 2**level
                best = np.full(many, 1e-6)
                for f in range(width):
                    at = (node - first) * bins + b[:, f]
                    gs, hs = (np.bincount(at, w, many * bins).reshape(many, bins).cumsum(1) for w in (g, h))
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    k = gain.argmax(1)
                    better = gain[np.arange(many), k] > best
                    best[better] = gain[np.arange(many), k][better]
                    feature[first : first + many][better], cut[first : first + many][better] = f, k[better]
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**depth - 1)
            value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
            self.trees.append((feature, cut, value))
            total += value[leaf]

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        b, total = self._bin(x), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total


def suffixes(host: str) -> Column:
    """The last one, two .. labels of a host, as an array."""
    parts = F.split(F.col(host), r"\.")
    return F.array(*[F.array_join(F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k), ".") for k in range(1, SUFFIXES + 1)])


def _fold(host: str) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def _rates(labelled: DataFrame) -> DataFrame:
    """(level, suffix, n, bad) over all labelled rows: for suffixes of each length, labels and bad ones in each fold; hot ones are summed before the shuffle."""
    levels = F.transform(F.col("suffixes"), lambda s, k: F.struct(k.alias("level"), s.alias("suffix")))
    rows = labelled.select("fold", F.col("label").cast("long").alias("label"), F.inline(levels))
    in_fold = lambda value: F.array(*[F.sum(F.when(F.col("fold") == f, value).otherwise(F.lit(0))).cast("long") for f in range(FOLDS)])
    return rows.groupBy("level", "suffix").agg(in_fold(F.lit(1)).alias("n"), in_fold(F.col("label")).alias("bad"))


def _with_rates(rows: DataFrame, rates: DataFrame, sizes: dict[int, int], means: list[float]) -> DataFrame:
    """rows with the smoothed rate of each of its host's suffixes over the hosts of other folds than its own."""
    others = lambda column, fold: F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x) - F.get(column, fold)
    mean = F.get(F.array(*[F.lit(float(m)) for m in means]), F.col("fold"))
    for k in range(SUFFIXES):
        part = rates.where(F.col("level") == k).select(F.col("suffix").alias("__s"), F.col("n").alias("__n"), F.col("bad").alias("__b"))
        rows = rows.withColumn("__suffix", F.get("suffixes", F.lit(k)))
        if sizes.get(k, 0) <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(part), F.col("__suffix") == F.col("__s"), "left")
        else:
            part = part.withColumn("__t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("__salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
            rows = rows.join(part, (F.col("__suffix") == F.col("__s")) & (F.col("__salt") == F.col("__t")), "left").drop("__salt", "__t")
        n, bad = (F.coalesce(others(F.col(c), F.col("fold")), F.lit(0)) for c in ("__n", "__b"))
        rows = rows.withColumn(f"rate{k}", (bad + SMOOTH * mean) / (n + SMOOTH)).drop("__suffix", "__s", "__n", "__b")
    return rows


def seed_label(host: Column, terms=SEED_TERMS) -> Column:
    return F.greatest(F.lit(0), *[host.contains(t).cast("int") for t in terms])


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url", fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score (the trees' probability of block).

    labelled (url, label 1 to block) trains the trees; without it, hosts that hold a seed term are labelled 1 and all others 0.
    Hosts are dealt into folds, and each url is judged by trees and suffix rates of the other folds, so no label of its own host has a say: the verdict is a
    held-out one for labelled urls too. Rates are counted over all labelled rows; the trees are fitted on at most fit_rows of
    each class, those first by hash. With one class only, the trees block nothing. A null url or one without "://" has an empty
    host and path and is judged by the trees. Repeated rows all stay; an empty table gives no rows; very long urls are read whole.
    """
    spark = pages.sparkSession
    arrow_batches(spark)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if labelled is None:
        known = rows.select("url", "host", seed_label(F.col("host")).alias("label"))
    else:
        known = labelled.where("label is not null").select("url", host_of(F.col("url")).alias("host"), F.col("label").cast("int").alias("label"))
    known = known.withColumn("suffixes", suffixes("host")).withColumn("fold", _fold("host"))
    rates = hold(_rates(known), "rates")
    sizes = {r["level"]: r["count"] for r in rates.groupBy("level").count().collect()}
    whole = {r["fold"]: (r["n"], r["bad"]) for r in known.groupBy("fold").agg(F.count("label").alias("n"), F.sum("label").alias("bad")).collect()}
    means = [sum(b for f, (_, b) in whole.items() if f != g) / max(1, sum(n for f, (n, _) in whole.items() if f != g)) for g in range(FOLDS)]
    sample = [known.where(F.col("label") == c).orderBy(F.xxhash64("url", F.lit(7)), "url").limit(fit_rows) for c in (0, 1)]
    fit = _with_rates(sample[0].unionByName(sample[1]), rates, sizes, means).collect()
    fit.sort(key=lambda r: (r["label"], r["url"] or ""))
    features = lambda part: np.array([lexical(r["url"], r["host"]) + [r[f"rate{k}"] for k in range(SUFFIXES)] for r in part], np.float64).reshape(len(part), len(FEATURES) + SUFFIXES)
    x, y, folds = features(fit), np.array([r["label"] for r in fit]), np.array([r["fold"] for r in fit])
    trees = [Trees(x[folds != f], y[folds != f]) if len({*y[folds != f].tolist()}) == 2 else None for f in range(FOLDS)]
    scored = _with_rates(rows.withColumn("suffixes", suffixes("host")).withColumn("fold", _fold("host")), rates, sizes, means).drop("suffixes")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part = b.to_pylist()
                x, folds, p = features(part), np.array([r["fold"] for r in part]), np.zeros(len(part))
                for f, model in enumerate(trees):
                    if model and (folds == f).any():
                        p[folds == f] = 1 / (1 + np.exp(-model.score(x[folds == f])))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "score"])

    scored = scored.mapInArrow(each, widened(scored, score="double"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
