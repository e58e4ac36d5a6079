"""Exact top-k search by inner product: a Voronoi kNN join."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, hold, widened
from .vectors import INSIDE, clamped, finite, fit, from_bytes, products, to_bytes, to_integers

K, SCALE = 10, 1024
#: Pivots (a bounded sample of the data, by hash), vectors of a packed row, queries of a group.
PIVOTS, PACK, QUERY_GROUP = 64, 8192, 4096
#: Queries scored at once against a packed row.
BLOCK = 256
#: Packed rows that one task holds against a group of queries: a group stands once for every so many.
AT_ONCE = 32

_PACK = pa.schema([
    ("pack", pa.int64()), ("dim", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("cells", pa.binary()), ("vectors", pa.binary()),
    ("stats", pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64()), ("radius", pa.float64()), ("norm", pa.float64())]))),
])
_PACK_SQL = "pack long, dim int, wide boolean, ids binary, cells binary, vectors binary, stats array<struct<cell:int,n:long,radius:double,norm:double>>"


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    dim = max(x.shape[1], pivots.shape[1])
    a, b = fit(x, dim).astype(np.float64), fit(pivots, dim).astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def _pack(part: int, made: int, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    """One row of vectors, sorted by id, with their cells and each cell's summary. Vectors beyond what a long's products hold have none: no bound stands on them."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if x.dtype == object:
        cols = [[(part << 24) + made], [x.shape[1]], [True], [ids.astype("<i8").tobytes()], [b""], [to_bytes(x)], [[]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACK, strict=True)], schema=_PACK)
    far = _distances(x, pivots)
    cells = far.argmin(1).astype(np.int32)
    near, norms = far[np.arange(len(x)), cells], np.sqrt((x.astype(np.float64) ** 2).sum(1))
    stats = [{"cell": int(c), "n": int((cells == c).sum()), "radius": float(near[cells == c].max()), "norm": float(norms[cells == c].max())} for c in np.unique(cells)]
    cols = [[(part << 24) + made], [x.shape[1]], [False], [ids.astype("<i8").tobytes()], [cells.tobytes()], [to_bytes(x)], [stats]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACK, strict=True)], schema=_PACK)


def _packer(pivots: np.ndarray, most: int, scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, bool], tuple[list, list]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), to_integers(b.column(1), scale), strict=True):
                if v is None or i is None:
                    continue
                kind = len(v), v.dtype == object
                ids, rows = held.setdefault(kind, ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == most:
                    yield _pack(part, made, np.array(ids), np.array(rows, v.dtype).reshape(len(ids), -1), pivots)
                    made += 1
                    del held[kind]
        for (_, wide), (ids, rows) in held.items():
            yield _pack(part, made, np.array(ids), np.array(rows, object if wide else np.int64).reshape(len(ids), -1), pivots)
            made += 1

    return pack


def _assign(pivots: np.ndarray, scale: int, name: str):
    """Adds each vector's cell; vectors that take no part have none."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [None if v is None else len(pivots) if v.dtype == object else int(_distances(v[None], pivots).argmin()) for v in to_integers(b.column(1), scale)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.int32())], names=[*b.schema.names, name])

    return assign


def _bounds(query_stats: list, data_stats: list, pivots: np.ndarray, k: int) -> dict[int, list[tuple[int, float, float]]]:
    """Of each query group, its cells with their radius and the score that its queries' k-th best reaches at least.

    For a query q of cell i and any s of cell j, q.s >= p_i.p_j - r_i |p_j| - (|p_i| + r_i) r_j. Cells are
    taken from the best such bound on until they hold over k rows (one may be the query's own). The
    pivots, which are rows themselves, give q.p_j >= p_i.p_j - r_i |p_j|.
    """
    inner = pivots.astype(np.float64) @ pivots.T
    norm = np.sqrt(np.maximum(inner.diagonal(), 0))
    cell = np.array([r["cell"] for r in data_stats], np.int64)
    n, radius = np.array([r["n"] for r in data_stats], np.int64), np.array([r["radius"] for r in data_stats])
    out: dict[int, list[tuple[int, float, float]]] = {}
    for r in query_stats:
        i, reach = r["cell"], r["radius"]
        low = inner[i, cell] - reach * norm[cell] - (norm[i] + reach) * radius
        order = np.argsort(-low)
        enough = np.flatnonzero(np.cumsum(n[order]) > k)
        least = low[order[enough[0]]] if len(enough) else -np.inf
        own = np.sort(inner[i] - reach * norm)[::-1]
        if len(own) > k:
            least = max(least, own[k])
        out.setdefault(r["pack"], []).append((i, reach, least - 1e-6 * abs(least) - 1))
    return out


_SENT = "pack long, salt int, dim int, wide boolean, ids binary, vectors binary"


def _replicate(bounds: dict, pivots: np.ndarray, salts: int):
    """Of each packed row, for each query group, the vectors whose upper bound p_i.s + r_i |s| reaches a cell's least score, with a salt that deals packed rows out. Groups and rows without bounds need all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                x = from_bytes(row["vectors"], len(ids), row["dim"], row["wide"])
                if not row["wide"]:
                    dim = max(row["dim"], pivots.shape[1])
                    f = fit(x, dim).astype(np.float64)
                    inner, norm = f @ fit(pivots, dim).T, np.sqrt((f * f).sum(1))
                salt = zlib.crc32(row["pack"].to_bytes(8, "little")) % salts
                for group, cells in bounds.items():
                    need = np.full(len(ids), True)
                    if cells and not row["wide"]:
                        i, reach, least = (np.array(c) for c in zip(*cells, strict=True))
                        need = (inner[:, i] + reach[None] * norm[:, None] >= least[None]).any(1)
                    if need.any():
                        cols = [[group], [salt], [row["dim"]], [row["wide"]], [ids[need].tobytes()], [to_bytes(x[need])]]
                        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["pack", "salt", "dim", "wide", "ids", "vectors"])

    return each


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best rows of x; ids ascend, ties go to the smaller."""
    out = [[], [], []]
    for at in range(0, len(q), BLOCK):
        s = products(q[at : at + BLOCK], x)
        for r, name in enumerate(q_ids[at : at + BLOCK]):
            others = np.flatnonzero(ids != name)
            own = s[r, others]
            if s.dtype == object:
                got = np.array(sorted(range(len(own)), key=lambda j: -own[j])[:k], np.int64)
            elif len(own) > k:
                line = np.partition(own, -k)[-k]
                above = np.flatnonzero(own > line)
                got = np.concatenate([above, np.flatnonzero(own == line)[: k - len(above)]])
            else:
                got = np.arange(len(own))
            out[0].append(np.full(len(got), name))
            out[1].append(ids[others[got]])
            out[2].append(own[got])
    return tuple(np.concatenate([*o, np.zeros(0, np.int64)]) for o in out)


def top_k(data: DataFrame, queries: DataFrame, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows of data by integer inner product, ties to the smaller vec_id.

    Both sides are assigned to the cells of their nearest pivots and packed; summaries of the cells
    (rows, radius, norm) give each group of queries the score that its k-th best must reach, and a
    data row goes only to the groups where its own bound reaches that. Groups are solved packed row by
    packed row, a group in as many tasks as its packed rows need, so no cell is held whole and no group is a hot key, and each query's k best of the parts are ranked at the end.
    vec_id is a key: rows with the query's own vec_id aren't its candidates; a query id that stands several times counts once, by its least
    vector, component by component; other repeated rows stand each for itself. A shorter vector counts as zero where it has no component.
    Vectors null or with null or non-finite components, and null ids, take no part, on either side. Scores are exact whatever their size: those that
    no long holds rank by their exact value and are given as the nearest long. Empty tables give no rows.
    """
    spark = data.sparkSession
    arrow_batches(spark)
    sound = lambda df: df.select(vec_id, embedding).where(f"`{vec_id}` is not null and {finite(embedding)}")
    data, queries = sound(data), sound(queries)
    sample = data.orderBy(F.xxhash64(vec_id, embedding), vec_id).limit(pivots).collect()
    sample = list({r[0]: r for r in sample}.values())  # a row for an id, as a query's own rows don't count
    chosen = [v for v in to_integers(pa.array([list(r[1]) for r in sample], pa.list_(pa.float64())), scale) if v.dtype != object] or [np.zeros(1, np.int64)]
    dim = max(map(len, chosen))
    points = np.array([np.pad(p, (0, dim - len(p))) for p in chosen])
    packed = hold(data.mapInArrow(_packer(points, PACK, scale), _PACK_SQL), "vectors")
    once = queries.groupBy(vec_id).agg(F.min(embedding).alias(embedding))
    placed = once.mapInArrow(_assign(points, scale, "__cell"), widened(once, __cell="int")).where("__cell is not null")
    placed = placed.repartitionByRange("__cell", vec_id).sortWithinPartitions("__cell", vec_id)  # a group of queries is one of neighbouring cells
    asked = hold(placed.select(vec_id, embedding).mapInArrow(_packer(points, QUERY_GROUP, scale), _PACK_SQL), "queries")
    stats = lambda df, *by: df.select("pack", F.inline("stats")).groupBy(*by).agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    own = data.join(queries.select(F.col(vec_id).alias("__q")).distinct(), F.col(vec_id) == F.col("__q"), "left_semi").groupBy(vec_id).count().agg(F.max("count")).first()[0] or 1
    bounds = _bounds(stats(asked, "pack", "cell"), stats(packed, "cell"), points, k + own - 1)  # a query's own rows are as many at most
    bounds = {r["pack"]: bounds.get(r["pack"], []) for r in asked.select("pack").collect()}  # a row for each QUERY_GROUP queries
    salts = max(1, -(-packed.count() // AT_ONCE))
    sent = packed.mapInArrow(_replicate(bounds, points, salts), _SENT)
    groups = asked.select("pack", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q, x = from_bytes(row["q_vectors"], len(q_ids), row["q_dim"], row["q_wide"]), from_bytes(row["vectors"], len(ids), row["dim"], row["wide"])
                of, name, score = best(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(name, pa.int64()), *[pa.array(c, t) for c, t in zip(clamped(score), (pa.int64(), pa.binary()), strict=True)]], names=["query_id", "vec_id", "score", "key"])

    parts = sent.join(groups, ["pack", "salt"]).mapInArrow(solve, "query_id long, vec_id long, score long, key binary")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.coalesce("key", F.lit(INSIDE))), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
