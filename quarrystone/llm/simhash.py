"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_batches, hold, scratch_path, widened, without
from .graph import components

#: Production parameters.
SHINGLE_WORDS, SEED, RADIUS = 4, 42, 4
#: Tiles at most, as long as none holds over TILE_MAX fingerprints (8 bytes each); a small table has fewer, of TILE_LEAST.
TILES, TILE_MAX, TILE_LEAST = 48, 1 << 20, 4096
#: Pairs of fingerprints that a task is held against, about, where there are more than four tasks a tile (some 100 seconds); bytes of tiles that a worker keeps.
TASK_WORK, TILES_KEPT = 10**11, 64 << 20
#: Fingerprints of a block, and blocks that a block is held against at once.
BLOCK, AT_ONCE = 64, 64

_CHUNK = 1 << 15


def simhash(raw: bytes | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint (as a signed long) of a UTF-8 text: a bit is 1 if set in over half of its shingles' XXH64."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[k : k + _CHUNK], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", width: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """docs with the fingerprint as a long column, in one pass without a shuffle; a null text counts as empty."""
    arrow_batches(docs.sparkSession)
    docs = without(docs, out)
    place = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(place)
            kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
            made = pa.array([simhash(t, width, seed) for t in texts.cast(kind).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, out])

    return docs.mapInArrow(each, widened(docs, **{out: "long"}))


def counts(x: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, one row each."""
    return np.stack([np.bitwise_count((x >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)], axis=1).astype(np.int16)


def _boxes(x: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and most population counts of each block, of its fingerprints' quarters, halves and wholes."""
    q = counts(x)
    parts = (q, q.reshape(-1, 2, 2).sum(2), q.sum(1, keepdims=True))
    return [(np.minimum.reduceat(c, starts, axis=0), np.maximum.reduceat(c, starts, axis=0)) for c in parts]


def _apart(one: list, row: int, many: list, first: int) -> np.ndarray:
    """Least distance that the population counts leave between a block and each of the blocks from first on."""
    gaps = [np.maximum(lo[row] - high[first:], low[first:] - hi[row]) for (lo, hi), (low, high) in zip(one, many, strict=True)]
    return np.maximum.reduce([np.maximum(g, 0).sum(1) for g in gaps])


class Forest:
    """Union-find over numbered nodes, fed with arrays of links; a root is its component's smallest number."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            x = y

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.find(i), self.find(j)
            keep = i != j
            i, j = i[keep], j[keep]
            np.minimum.at(self.up, np.maximum(i, j), np.minimum(i, j))
        self.up = self.find(self.up)


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that connect just what the pairs within radius connect, of tile a with b, or of a with itself.

    Blocks of a tile are held against blocks of the other by exclusive-or and bit count; pairs of
    blocks whose population counts differ beyond the radius are skipped. A tile's links are folded
    into a forest as they are found, so that a group of many near copies gives a link each, not
    one for each pair.
    """
    whole = a if b is None else np.concatenate([a, b])
    right, base = (a, 0) if b is None else (b, len(a))
    starts = [np.arange(0, len(x), block) for x in (a, right)]
    left_boxes, right_boxes = _boxes(a, starts[0]), _boxes(right, starts[1])
    grid = np.append(right, np.full(-len(right) % block, right[-1])).reshape(-1, block)  # filled up with its last one
    forest = Forest(len(whole))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for r in range(len(starts[0])):
        first = r if b is None else 0
        near = np.flatnonzero(_apart(left_boxes, r, right_boxes, first) <= radius) + first
        left = a[starts[0][r] : starts[0][r] + block]
        for k in range(0, len(near), AT_ONCE):
            some = near[k : k + AT_ONCE]
            close = np.bitwise_count(left[:, None] ^ grid[some].reshape(1, -1)) <= radius
            if not close.any():
                continue
            i, j = np.divmod(np.flatnonzero(close), close.shape[1])
            i, j = i + starts[0][r], np.minimum(some[j // block] * block + j % block, len(right) - 1)
            if b is None:
                i, j = i[i < j], j[i < j]
            found.append((i, j + base))
            waiting += len(i)
            if waiting > 1 << 20:
                forest.join(*(np.concatenate(x) for x in zip(*found, strict=True)))
                found, waiting = [], 0
    if found:
        forest.join(*(np.concatenate(x) for x in zip(*found, strict=True)))
    moved = np.flatnonzero(forest.up != np.arange(len(whole)))
    return whole[moved], whole[forest.up[moved]]


def _packer(folder: str, most: int):
    """Writes a partition of sorted fingerprints as tiles, a file each under folder, and gives each tile's number and the bounds of its population counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        held, made = [], 0

        def tile(x: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            c = counts(x)
            made += 1
            number = task.partitionId() * (1 << 24) + made
            store.create_dir(base, recursive=True)
            mine = f"{base}/.attempt-{task.taskAttemptId()}"
            with store.open_output_stream(mine) as f:
                f.write(x.tobytes())
            store.move(mine, f"{base}/{number}")  # a rerun of a lost task writes the same bytes
            cols = {"tile": [number], "size": [len(x)], "lo": [c.min(0).tolist()], "hi": [c.max(0).tolist()], "least": [int(c.sum(1).min())], "most": [int(c.sum(1).max())]}
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in _TILE], schema=_TILE)

        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            while sum(map(len, held)) >= most:
                x = np.concatenate(held)
                yield tile(x[:most])
                held = [x[most:]]
        if sum(map(len, held)):
            yield tile(np.concatenate(held))

    return pack


_TILE = pa.schema([("tile", pa.int64()), ("size", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
_TILE_SQL = "tile long, size long, least int, most int, lo array<int>, hi array<int>"


_KEPT: dict[tuple[str, int], np.ndarray] = {}


def _reader(folder: str):
    """Reads tiles by number, and keeps those read last for the worker's next pairs and tasks."""
    store, base = fs.FileSystem.from_uri(folder)

    def tile(number: int) -> np.ndarray:
        x = _KEPT.pop((folder, number), None)
        if x is None:
            with store.open_input_stream(f"{base}/{number}") as f:
                x = np.frombuffer(f.read(), np.uint64)
        _KEPT[folder, number] = x
        while sum(v.nbytes for v in _KEPT.values()) > TILES_KEPT and len(_KEPT) > 2:
            del _KEPT[next(iter(_KEPT))]
        return x

    return tile


def links(distinct: DataFrame, radius: int = RADIUS, tiles: int = TILES, most: int = TILE_MAX) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that connect all pairs within radius.

    The fingerprints are sorted by population counts and cut into tiles, a file each in the shared folder. Pairs
    of tiles whose counts lie within the radius are found from their bounds, dealt out by how much there is to compare, and compared in numpy:
    only numbers of tiles are shuffled, and a task reads its two tiles, of at most 8 MB each.
    """
    spark = distinct.sparkSession
    arrow_batches(spark)
    tiles = max(1, min(tiles, distinct.count() // TILE_LEAST))
    quarter = [F.bit_count(F.col("fp").bitwiseAND(F.lit((0xFFFF << s) - (1 << 64 if s == 48 else 0)))) for s in (48, 32, 16, 0)]
    order = [F.bit_count("fp"), quarter[0] + quarter[1], quarter[0], quarter[2], F.col("fp")]
    ranged = distinct.select("fp", *[k.alias(f"k{i}") for i, k in enumerate(order[:-1])])
    keys = ["k0", "k1", "k2", "k3", "fp"]
    folder = scratch_path(spark, "tiles")
    head = hold(ranged.repartitionByRange(tiles, *keys).sortWithinPartitions(*keys).select("fp").mapInArrow(_packer(folder, most), _TILE_SQL), "bounds")
    left = head.withColumn("at", F.explode(F.expr("sequence(least, most)")))
    right = head.withColumn("at", F.explode(F.expr(f"sequence(least - {radius}, most + {radius})")))
    gap = "aggregate(zip_with(zip_with(x.lo, y.hi, (p, q) -> p - q), zip_with(y.lo, x.hi, (p, q) -> p - q), (p, q) -> greatest(p, q, 0)), 0, (s, g) -> s + g)"
    pairs = left.alias("x").join(right.alias("y"), F.expr(f"x.at = y.at and {gap} <= {radius}"))
    pairs = pairs.select(F.least("x.tile", "y.tile").alias("p"), F.greatest("x.tile", "y.tile").alias("q"), (F.col("x.size") * F.col("y.size")).alias("work")).distinct()
    pairs = hold(pairs, "pairs")
    many, total = pairs.agg(F.count("*"), F.sum("work")).first()
    tasks = max(1, min(many, max(4 * tiles, -(-(total or 0) // TASK_WORK))))
    work = pairs.select("p", "q").repartition(tasks, "p", "q").sortWithinPartitions("p", "q")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _reader(folder)
        for b in batches:
            for row in b.to_pylist():
                x, y = tile(row["p"]), None if row["p"] == row["q"] else tile(row["q"])
                u, v = compare_tiles(x, y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["a", "b"])

    return work.mapInArrow(each, "a long, b long")


def classes(prints: DataFrame, doc_id: str = "doc_id", radius: int = RADIUS, tiles: int = TILES) -> DataFrame:
    """(fp, component_id, root): for each distinct fingerprint the smallest document reachable over links, and the fingerprint that stands for its component."""
    own = hold(prints.groupBy("fp").agg(F.min(doc_id).alias("least")), "classes")
    roots = hold(components(links(own, radius, tiles)), "roots").withColumnRenamed("node", "fp")
    least = roots.join(own, "fp").groupBy("root").agg(F.min("least").alias("reached"))
    linked = roots.join(least, "root").select("fp", "reached", "root")
    return hold(own.join(linked, "fp", "left").select("fp", F.coalesce("reached", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")), "components")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, seed: int = SEED, radius: int = RADIUS, tiles: int = TILES) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints that differ in at most radius bits are linked; a component's id is its smallest
    doc_id. Null or empty texts have fingerprint zero and are linked like any other. Repeated rows
    stay and share a component. A null doc_id counts for none but gets its component. An empty table gives no rows; other columns are ignored.
    """
    prints = hold(fingerprints(docs.select(doc_id, text), text, "fp", width, seed).select(doc_id, "fp"), "prints")
    return prints.join(classes(prints, doc_id, radius, tiles), "fp").select(
        doc_id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, whole and unchanged.

    Null ids come last; of rows with the same id, or of none with any, the first by a hash of their content stays.
    """
    named = docs.columns
    content = F.xxhash64(*[c.name for c in docs.schema if not re.search("map<|variant", c.dataType.simpleString())])  # Spark doesn't hash maps
    prints = fingerprints(docs, text, "__fp", params.get("width", SHINGLE_WORDS), params.get("seed", SEED))
    prints = hold(prints.withColumn("__content", content).withColumn("__row", F.monotonically_increasing_id()), "printed")
    which = classes(prints.select(doc_id, F.col("__fp").alias("fp")), doc_id, params.get("radius", RADIUS), params.get("tiles", TILES))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "__content", "__fp", "__row")
    firsts = prints.groupBy(F.col("__fp").alias("fp")).agg(F.min(order).alias("first"))
    firsts = firsts.join(which, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.__fp", "first.__row")
    return prints.join(firsts, ["__fp", "__row"], "left_semi").select(*named)
