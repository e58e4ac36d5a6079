"""Hard negatives: for each anchor and each of its positives, the best rows of other labels within a band below the positive's score.

Vectors are turned by an orthogonal matrix that puts most of their length into the leading components. Partial inner products over
those bound the whole ones: the rest is at most the product of the residual norms, and rounding has a slack of its own. Pairs that
can't reach what an anchor still looks for are dropped step by step; those left are judged by integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, hold, scratch_path
from .vectors import INSIDE, clamped, finite, fit, from_bytes, from_key, products, to_bytes, to_integers

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Of a positive's score, in hundredths, the least and the most that a negative's may be.
BAND = (30, 90)
#: Rows that the rotation is fitted on (by hash); it decides what is dropped early, never what is found.
FIT_ROWS = 4096
#: Rows of a pack and of a group of anchors, packs that one task takes for a group, tasks aimed at, anchors held at once against a pack.
PACK, GROUP, AT_ONCE, TASKS, BLOCK = 8192, 2048, 32, 96, 256
#: Leading parts of the components after which pairs are dropped; below this share of pairs the rest is added pair by pair.
STEPS, FEW = (0.125, 0.25, 0.5, 1.0), 0.05
#: Pairs whose integer products are taken at once.
PAIRS = 1 << 15

_HEAD = "pack long, n long"


def rotation(rows: list[np.ndarray]) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal directions of rows, the strongest first."""
    dim = max(map(len, rows), default=1)
    x = np.zeros((max(1, len(rows)), max(1, dim)))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])


class Turned:
    """Rows of integers with their rotated floats, norms and, after each step, residual norms. Components beyond the rotation's stand after it as they are."""

    def __init__(self, x: np.ndarray, turn: np.ndarray, dim: int):
        f = fit(x, dim).astype(np.float64)
        self.whole = x
        self.floats = np.concatenate([f[:, : len(turn)] @ turn, f[:, len(turn) :]], axis=1)
        self.norm = np.sqrt((f * f).sum(1))
        self.cuts = sorted({max(1, round(s * dim)) for s in STEPS})
        square = self.floats * self.floats
        self.rest = [np.sqrt(square[:, c:].sum(1)) for c in self.cuts]


def slack_of(turn: np.ndarray, dim: int) -> float:
    """How far, as a share of the norms' product, a computed product may lie from the exact one: the matrix's distance from an orthogonal one, and the rounding of two rotations and a sum."""
    return float(np.linalg.norm(turn.T @ turn - np.eye(len(turn)), 2)) + 16 * (dim + 8) * np.finfo(np.float64).eps


def survivors(q: Turned, x: Turned, may: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, steps taken): pairs, among those that may be, that can be one of the k best of a window of anchor i.

    low and high hold a line of windows for each anchor, as floats that have room for rounding. Where all components are
    summed densely, the k-th best of a window's sure members raises its lower end.
    """
    wide = slack * q.norm[:, None] * x.norm[None] + 1e-6
    least, most = low.min(1), high.max(1)
    total = np.zeros((len(q.norm), len(x.norm)))
    start = 0
    for step, cut in enumerate(q.cuts):
        total += q.floats[:, start:cut] @ x.floats[:, start:cut].T
        rest = q.rest[step][:, None] * x.rest[step][None] + wide
        alive = may & (total + rest >= least[:, None]) & (total - rest <= most[:, None])
        start, left = cut, np.count_nonzero(alive)
        if left <= FEW * alive.size or not left:
            break
    i, j = np.nonzero(alive)
    if start < q.cuts[-1]:
        part = total[i, j]
        for step in range(step + 1, len(q.cuts)):
            cut = q.cuts[step]
            part += np.einsum("ij,ij->i", q.floats[i, start:cut], x.floats[j, start:cut])
            rest = q.rest[step][i] * x.rest[step][j] + wide[i, j]
            keep = (part + rest >= least[i]) & (part - rest <= most[i])
            i, j, part, start = i[keep], j[keep], part[keep], cut
    elif len(i) > 4 * k * len(q.norm):
        needed = np.full(alive.shape, False)
        for w in range(low.shape[1]):
            inside = np.where(may & (total - wide >= low[:, w, None]) & (total + wide <= high[:, w, None]), total - wide, -np.inf)
            sure = np.partition(inside, -k, axis=1)[:, -k] if inside.shape[1] >= k else np.full(len(inside), -np.inf)
            needed |= (total + wide >= np.maximum(sure, low[:, w])[:, None]) & (total - wide <= high[:, w, None])
        i, j = np.nonzero(alive & needed)
    return i, j, np.int64(step + 1)


def _products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    dim = min(q.shape[1], x.shape[1])
    return np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", q[i[k : k + PAIRS], :dim], x[j[k : k + PAIRS], :dim]) for k in range(0, len(i), PAIRS)]])


def _rounded(score: int, way: int) -> float:
    """A float at or below the score, or at or above it. Scores are held against it only where a long holds them, so more than that may be less."""
    f = float(min(max(score, -(10**30)), 10**30))
    return f + way * (abs(f) * 2.0**-50 + 1)


class Best:
    """The k best (score, then smaller id) of each window of a group of anchors, over the packs seen so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: list[list[tuple[int | None, int | None]]], k: int, same: bool, turn: np.ndarray):
        self.ids, self.labels, self.x, self.k, self.same, self.turn = ids, labels, x, k, same, turn
        self.windows = windows
        self.held: dict[tuple[int, int], list[tuple[int, int]]] = {}
        width = max(map(len, windows), default=0)
        self.low = np.full((len(ids), width), np.inf)
        self.high = np.full((len(ids), width), -np.inf)
        for i, some in enumerate(windows):
            for w, (a, b) in enumerate(some):
                self.low[i, w] = -np.inf if a is None else _rounded(a, -1)
                self.high[i, w] = np.inf if b is None else _rounded(b, 1)

    def see(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        if not self.low.shape[1]:
            return
        exact = object in (x.dtype, self.x.dtype)
        dim = max(x.shape[1], self.x.shape[1], len(self.turn))
        slack = slack_of(self.turn, dim)
        other = None if exact else Turned(x, self.turn, dim)
        for at in range(0, len(self.ids), BLOCK):
            part = slice(at, at + BLOCK)
            may = (self.labels[part, None] == labels[None]) == self.same
            may &= self.ids[part, None] != ids[None]
            if exact:
                i, j = np.nonzero(may)
                scores = products(self.x[part], x)[i, j]
            else:
                mine = Turned(self.x[part], self.turn, dim)
                i, j, _ = survivors(mine, other, may, self.low[part], self.high[part], self.k, slack)
                scores = _products(mine.whole, x, i, j)
            self._take(i + at, ids[j], scores)

    def _take(self, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Adds scored pairs, those of an anchor at once, and raises the lower ends of full windows."""
        if not len(i):
            return
        order = np.lexsort((ids, i))
        i, ids, scores = i[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
            k = int(i[a])
            some, names = scores[a:b], ids[a:b]
            for w, (low, high) in enumerate(self.windows[k]):
                inside = np.full(len(some), True)
                if low is not None:
                    inside &= some >= low
                if high is not None:
                    inside &= some <= high
                got = list(zip((-some[inside]).tolist(), names[inside].tolist(), strict=True))
                if not got:
                    continue
                got = sorted(self.held.get((k, w), []) + got)[: self.k]
                self.held[k, w] = got
                if len(got) == self.k:
                    self.low[k, w] = max(self.low[k, w], _rounded(-got[-1][0], -1))

    def rows(self) -> Iterator[tuple[int, int, int, int, int]]:
        """(anchor's place, window, rank from 0, id, exact score)."""
        for (i, w), got in self.held.items():
            for r, (score, name) in enumerate(got):
                yield i, w, r, name, -score


def _write(store: fs.FileSystem, base: str, number: int, attempt: int, ids, labels, rows: list[np.ndarray]) -> None:
    wide = rows[0].dtype == object
    x = np.array(rows, object if wide else np.int64).reshape(len(rows), -1)
    batch = pa.RecordBatch.from_pydict({"n": [len(rows)], "dim": [x.shape[1]], "wide": [wide], "ids": [np.array(ids, "<i8").tobytes()], "labels": [np.array(labels, "<i8").tobytes()], "x": [to_bytes(x)]})
    store.create_dir(base, recursive=True)
    mine = f"{base}/.attempt-{attempt}"
    with store.open_output_stream(mine) as f, pa.ipc.new_stream(f, batch.schema) as out:
        out.write_batch(batch)
    store.move(mine, f"{base}/{number}")  # a rerun of a lost task writes the same bytes


def read_pack(store: fs.FileSystem, base: str, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors."""
    with store.open_input_stream(f"{base}/{number}") as f, pa.ipc.open_stream(f.read()) as read:
        row = read.read_all().to_pylist()[0]
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), from_bytes(row["x"], row["n"], row["dim"], row["wide"])


def _packer(folder: str, most: int, scale: int):
    """Writes rows of (id, label, vector) as packs of one kind and dimension, a file each, and gives their numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        held: dict[tuple, tuple[list, list, list]] = {}
        made = 0

        def put(ids, labels, rows):
            nonlocal made
            number = (task.partitionId() << 24) + made
            made += 1
            _write(store, base, number, task.taskAttemptId(), ids, labels, rows)
            return pa.RecordBatch.from_pydict({"pack": [number], "n": [len(ids)]})

        for b in batches:
            for i, label, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), to_integers(b.column(2), scale), strict=True):
                if v is None:
                    continue
                some = held.setdefault((v.dtype == object, len(v)), ([], [], []))
                for out, value in zip(some, (i, label, v), strict=True):
                    out.append(value)
                if sum(len(h[0]) for h in held.values()) >= most:  # however many kinds there are
                    largest = max(held, key=lambda kind: len(held[kind][0]))
                    yield put(*held.pop(largest))
        for some in held.values():
            yield put(*some)

    return pack


def _work(groups: DataFrame, packs: DataFrame) -> DataFrame:
    """(anchors, packs): numbers of a group and of up to about AT_ONCE packs, dealt out over tasks."""
    g, p = groups.count(), packs.count()
    chunks = max(1, -(-p // AT_ONCE), min(p, -(-TASKS // max(1, g))))
    lists = packs.groupBy(F.pmod(F.xxhash64("pack"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list("pack")).alias("packs"))
    asked = groups.select(F.col("pack").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    return asked.join(lists, "chunk").repartition(max(1, g * chunks), "anchors", "chunk")


_FOUND = "anchor_id long, of_score long, of_key binary, vec_id long, score long, key binary"


def _search(folders: tuple[str, str], turn: np.ndarray, k: int, same: bool, band: tuple[int, int] | None):
    """Solves rows of work: the k best of each anchor's windows among some packs. With a band, windows come from the row's list of positive scores."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, base), (own_store, own) = (fs.FileSystem.from_uri(f) for f in folders)
        for b in batches:
            for row in b.to_pylist():
                ids, labels, x = read_pack(own_store, own, row["anchors"])
                scores: list[list[int | None]] = [[None] for _ in ids]
                if band:
                    place = {i: n for n, i in enumerate(ids.tolist())}
                    scores = [[] for _ in ids]
                    for s in row["positives"]:
                        scores[place[s["anchor_id"]]].append(from_key(s["score"], s["key"]))
                windows = [[(None, None) if s is None else (-(-band[0] * s // 100), band[1] * s // 100) for s in some] for some in scores]
                best = Best(ids, labels, x, windows, k, same, turn)
                for number in row["packs"]:
                    best.see(*read_pack(store, base, number))
                out = [(int(ids[i]), scores[i][w], name, score) for i, w, _, name, score in best.rows()]
                of, score = (clamped(np.array([0 if r[c] is None else r[c] for r in out], object)) for c in (1, 3))
                cols = [[r[0] for r in out], *of, [r[2] for r in out], *score]
                kinds = (pa.int64(), pa.int64(), pa.binary()) * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor_id", "of_score", "of_key", "vec_id", "score", "key"])

    return solve


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = [F.desc("score"), F.desc(_ordered("key")), F.asc("vec_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _ordered(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit(INSIDE))


def mine(data: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchors is a condition on rows of data. An anchor's positives are its first other rows of the same label, by integer inner product and
    then the smaller id; the negatives of each are the first rows of other labels whose score lies in the band, in hundredths of the positive's.
    Components count as floor(scale * x). Rows with a null id, label or vector, or a null or non-finite component, take no part. vec_id and label are whole numbers.
    Rows with an anchor's own id are never its candidates; an id that is an anchor several times counts once, by the least label and then the
    least vector; other repeated rows stand each for itself. Shorter vectors count as zero where they have no component. Scores beyond a long
    rank by their exact value and are given as the nearest long. An empty table gives no rows; other columns are ignored.

    Rows lie in packs, a file each in the shared folder; only their numbers are shuffled, and the best of each task. Work is anchors times rows, in blocks.
    """
    spark = data.sparkSession
    arrow_batches(spark)
    taken = data.where(f"`{vec_id}` is not null and `{label}` is not null and {finite(embedding)}").select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("embedding"), anchors.alias("asked"))
    sample = taken.select("embedding").orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(FIT_ROWS).toArrow()["embedding"].combine_chunks()
    turn = rotation([v for v in to_integers(sample, scale) if v is not None and v.dtype != object])
    folders = scratch_path(spark, "packs"), scratch_path(spark, "anchors")
    columns = ["vec_id", "label", "embedding"]
    packs = hold(taken.select(*columns).mapInArrow(_packer(folders[0], PACK, scale), _HEAD), "packs-heads")
    once = taken.where("asked").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    many = max(1, -(-once.count() // GROUP))
    grouped = once.repartitionByRange(many, "vec_id").sortWithinPartitions("vec_id") if many > 1 else once.coalesce(1)
    heads = hold(grouped.mapInArrow(_packer(folders[1], GROUP, scale), _HEAD), "anchor-heads")
    work = hold(_work(heads, packs), "work")
    found = hold(_first(work.mapInArrow(_search(folders, turn, positives, True, None), _FOUND), positives, "anchor_id"), "positives")
    named = hold(heads.select("pack").mapInArrow(_members(folders[1]), "anchors long, anchor_id long"), "members")
    scores = found.select("anchor_id", "score", "key").distinct().join(named, "anchor_id")
    limits = scores.groupBy("anchors").agg(F.collect_list(F.struct("anchor_id", "score", "key")).alias("positives"))  # as many as a group's anchors have positives
    second = work.join(limits, "anchors").repartition(max(1, work.count()), "anchors", "chunk")
    ranked = _first(second.mapInArrow(_search(folders, turn, negatives, False, band), _FOUND), negatives, "anchor_id", "of_score", "of_key")
    pairs = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("of_score"), _ordered("key").alias("of"))
    joined = pairs.join(ranked.select("anchor_id", "of_score", _ordered("of_key").alias("of"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor_id", "of_score", "of"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", F.col("of_score").alias("positive_score"), "negative_score")


def _members(folder: str):
    """(group, id of an anchor) of groups by number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for number in b.column(0).to_pylist():
                ids = read_pack(store, base, number)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number, np.int64)), pa.array(ids)], names=["anchors", "anchor_id"])

    return each
