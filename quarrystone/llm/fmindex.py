"""Benchmark decontamination: an FM-index for each training shard, searched backwards for test phrases."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, scratch_path

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Benchmark text that is searched for at once; more goes in further blocks, one after another. Built, it takes about 20 times as much.
BLOCK_BYTES = 4 << 20
#: A shard is indexed once it holds so many bytes of text.
SHARD_BYTES = 64 << 20
#: Of the suffix positions in a run, one in so many is kept.
SAMPLE = 8

#: For bytes.translate: A-Z lower-cased; ASCII that is no letter or digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same words, to find where they stand.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_FOLD).split()


class WaveletMatrix:
    """Rank and access over an array of symbols below sigma, a bit of the symbol to a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = self.n - int(before[-1])
            self.levels.append((bit, zeros, before))
            order = ones.astype(bool)
            symbols = np.concatenate([symbols[~order], symbols[order]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before position i, for arrays of both."""
        at = np.zeros_like(i)
        for bit, zeros, before in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            i = np.where(one, zeros + before[i], i - before[i])
            at = np.where(one, zeros + before[at], at - before[at])
        return i - at

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), np.int64)
        for bit, zeros, before in self.levels:
            one = (before[i + 1] - before[i]).astype(bool)
            c |= one.astype(np.int64) << bit
            i = np.where(one, zeros + before[i], i - before[i])
        return c


class FMIndex:
    """Over runs of words, each run closed by symbol 0; words are 1 .. sigma - 1.

    Each closing 0 sorts by its position, so no suffix comparison goes beyond a run. Positions are
    kept for one suffix in SAMPLE and for the first word of each run, so a walk never leaves a run.
    """

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(ends)
        rank[ends] = np.arange(len(ends))
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = new
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        begins = np.zeros(n, bool)
        begins[0] = True
        begins[1:] = text[:-1] == 0
        kept = (begins | (np.arange(n) % SAMPLE == 0))[order]
        self.kept = np.packbits(np.append(kept, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64)])
        self.at = order[kept].astype(np.uint32 if n < 1 << 32 else np.int64)  # of the kept suffixes only

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of phrases (all of one length), the range of suffixes that begin with it."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.bwt.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by walking back to the next kept one."""
        out, live, steps = np.full(len(rows), -1, np.int64), np.arange(len(rows)), 0
        while len(live):
            word, bit = rows[live] >> 6, (rows[live] & 63).astype(np.uint64)
            done = (self.kept[word] >> bit & np.uint64(1)).astype(bool)
            ranks = self.before[word[done]] + np.bitwise_count(self.kept[word[done]] & ((np.uint64(1) << bit[done]) - np.uint64(1)))
            out[live[done]] = self.at[ranks].astype(np.int64) + steps
            live = live[~done]
            c = self.bwt.access(rows[live])
            rows[live] = self.first[c] + self.bwt.rank(c, rows[live])
            steps += 1
        return out


class Phrases:
    """The windows of a block of benchmark items, over the block's own vocabulary, each once, with the items that hold it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.names)}
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                by_length.setdefault(min(window, len(ids)), []).append((place[item], ids))
        self.shortest = min(by_length, default=0)
        self.by_length: list[tuple[int, np.ndarray]] = []
        self.first, self.owners = [np.zeros(1, np.int64)], []  # of each window over all lengths, its items
        for n in sorted(by_length):
            windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(ids, n) for _, ids in by_length[n]])
            owner = np.repeat([i for i, _ in by_length[n]], [len(ids) - n + 1 for _, ids in by_length[n]]).astype(np.int32)
            order = np.lexsort([owner, *windows.T[::-1]])
            windows, owner = windows[order], owner[order]
            new = np.append(True, (windows[1:] != windows[:-1]).any(1))
            keep = new | np.append(True, owner[1:] != owner[:-1])
            self.by_length.append((n, windows[new]))
            self.first.append(self.first[-1][-1] + np.cumsum(np.bincount((np.cumsum(new) - 1)[keep])))
            self.owners.append(owner[keep])
        self.first, self.owners = np.concatenate(self.first), np.concatenate([*self.owners, np.zeros(0, np.int32)])

    def find(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
        """For each text of a shard: its number of words, the merged spans of words hit, and the items found."""
        get, sizes, runs, where = self.vocabulary.get, [], [], []
        for t, raw in enumerate(texts):
            words = words_of(raw)
            sizes.append(len(words))
            if len(words) < max(1, self.shortest):
                continue
            ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
            for a, b in zip(edges[::2], edges[1::2], strict=True):  # runs of words that the items know
                if b - a >= self.shortest:
                    runs.append(np.append(ids[a:b], 0))
                    where.append((t, a, b - a + 1))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if not runs or not self.by_length:
            return sizes, spans, [[] for _ in texts]
        text = np.concatenate(runs)
        doc, first, long = (np.array(x) for x in zip(*where, strict=True))
        doc_at = np.repeat(doc, long)
        word_at = np.arange(len(text)) + np.repeat(first - np.concatenate([[0], np.cumsum(long)[:-1]]), long)
        index = FMIndex(text, len(self.vocabulary) + 1)
        change, pairs, base = np.zeros(len(text) + 1, np.int64), [], 0
        for length, phrases in self.by_length:
            low, high = index.search(phrases)
            many = high - low
            which = np.repeat(np.arange(len(phrases)), many)
            rows = np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
            for k in range(0, len(rows), 1 << 20):
                start = index.locate(rows[k : k + (1 << 20)].copy())
                change[: len(text)] += np.bincount(start, minlength=len(text))
                change -= np.bincount(start + length, minlength=len(text) + 1)
                pairs.append(np.unique(doc_at[start] * (len(self.first) - 1) + which[k : k + (1 << 20)] + base))
            base += len(phrases)
        hit = np.flatnonzero(np.cumsum(change)[:-1] > 0)
        if len(hit):
            cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(doc_at[hit]) != 0)) + 1
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]]), strict=True):
                spans[doc_at[hit[a]]].append((int(word_at[hit[a]]), int(word_at[hit[b - 1]]) + 1))
        for pair in np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)])).tolist():
            d, w = divmod(pair, len(self.first) - 1)
            items[d].update(self.names[i] for i in self.owners[self.first[w] : self.first[w + 1]])
        return sizes, spans, [sorted(x) for x in items]


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's items (i, t) in blocks of about so many bytes, by a hash."""
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n)]


_LOADED: dict[str, Phrases] = {}


def _load(path: str) -> Phrases:
    """A block's windows from their file; a worker holds one block at a time."""
    if path not in _LOADED:
        _LOADED.clear()
        store, name = fs.FileSystem.from_uri(path)
        with store.open_input_stream(name) as f:
            _LOADED[path] = pickle.loads(f.read())
    return _LOADED[path]


def _in_turn(files: list[str]) -> list[str]:
    """The block at hand first."""
    return sorted(files, key=lambda f: f not in _LOADED)


def _save(spark: SparkSession, phrases: Phrases) -> str:
    path = scratch_path(spark, "phrases")
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(pickle.dumps(phrases))
    return path


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep_text: bool = True) -> DataFrame:
    """docs (without its text, if that isn't to be kept) with n_words, spans (merged runs of words hit: from, to) and items (ids, as strings, whose windows occur).

    Each task gathers its rows into shards, builds a shard's index over the runs of words that the
    items know (no window can touch another word), and searches all windows in it: nothing is
    shuffled, and hot documents stay where they are. The benchmark is measured first and taken in
    blocks of at most about block_bytes. One block is broadcast; several lie as files in the shared folder, and a worker searches a shard
    for one after another, so that it holds one shard and one block however many there are. Null texts have no words; items without id or text take no part; an
    id that stands twice is one item with the windows of both. An empty table of either gives no rows, or rows without hits.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    named = [c for c in docs.columns if c.lower() not in ("n_words", "spans", "items")]
    place = named.index(text)
    kept = [k for k in range(len(named)) if keep_text or k != place]
    kind = docs.select(*[named[k] for k in kept], F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<`from`:bigint,`to`:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items")).schema
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    made = lambda block: Phrases([(r["i"], bytes(r["t"])) for r in block.collect()], window)
    one = spark.sparkContext.broadcast(made(blocks[0])) if len(blocks) == 1 else None
    files = [] if one else [_save(spark, made(block)) for block in blocks]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, size = [], [], 0

        def search() -> tuple[list, list, list]:
            if one:
                return one.value.find(texts)
            n, spans, items = [], [[] for _ in texts], [[] for _ in texts]
            for f in _in_turn(files):
                n, more, names = _load(f).find(texts)
                spans = [_union(x, y) for x, y in zip(spans, more, strict=True)]
                items = [sorted({*x, *y}) for x, y in zip(items, names, strict=True)]
            return n, spans, items

        def flush() -> Iterator[pa.RecordBatch]:
            found = zip(*search(), strict=True)
            for b in held:
                n, spans, items = zip(*[next(found) for _ in range(b.num_rows)], strict=True)
                found_here = [pa.array(n, pa.int64()), pa.array([[{"from": a, "to": z} for a, z in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in kept], *found_here], names=kind.names)

        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(place)
            held.append(b)
            texts += (got := raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary()).to_pylist())
            size += sum(len(x) for x in got if x)
            if size >= SHARD_BYTES:
                yield from flush()
                held, texts, size = [], [], 0
        if held:
            yield from flush()

    return docs.select(*named).mapInArrow(each, kind)


def _union(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of two blocks, those that touch or overlap merged."""
    if not old:
        return new
    out: list[list[int]] = []
    for a, z in sorted(list(old) + list(new)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def digest(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256 (of the ids as strings, sorted and joined by commas), contaminated."""
    hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.to - x.from)")
    names = F.array_join(F.array_sort("items"), ",")
    return marked.select(doc_id, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def cut(raw: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of spans and without what stands between the words of a span."""
    data = raw.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for a, z in spans:
        out.append(data[last : at[a][0]])
        last = at[z - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut(t, [(s["from"], s["to"]) for s in at]) if len(at) else t for t, at in zip(text, spans, strict=True)], dtype=object)


def scrub(docs: DataFrame, benchmark: DataFrame, text: str = "text", **params) -> DataFrame:
    """docs with the removal spans cut out of their texts, and n_removed (words cut); rows without a hit, null texts among them, are as they were.

    A text may hold a window again where what stood around a span meets: scrub again, or drop what clean() drops.
    """
    named = [c for c in docs.columns if c.lower() != "n_removed"]
    whole = docs.select(F.struct(*named).alias("row"), F.col(text).alias("text"))
    marked = mark(whole, benchmark, **params)
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.to - x.from)").alias("n_removed")
    left = F.when(F.size("spans") > 0, _cut(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return marked.select(*[left.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in named], removed)


def clean(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of docs with no hit, whole and unchanged; null texts have none and stay, repeated rows are judged alike, an empty table stays empty."""
    if not {c.lower() for c in docs.columns} & {"n_words", "spans", "items"}:
        return mark(docs, benchmark, **params).where(F.size("spans") == 0).select(*docs.columns)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "text")  # its own columns have the names of what is found
    return mark(whole, benchmark, keep_text=False, **params).where(F.size("spans") == 0).select("row.*")
