"""Git objects as a data source: loose files and packs, read in parallel, and the files of commits as joins over them."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.storage import kept, written

KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAME_DELTA = 6, 7
#: Objects of a pack that a task reads, folders of loose objects that it reads, and bytes of delta bases that it keeps.
PACKED, LOOSE, KEPT = 4096, 16, 32 << 20
#: Compressed bytes of a pack that is written, but for the one object that may be larger.
ROOM = 64 << 20
SCHEMA = "oid string, kind string, size long, content binary"


@dataclass
class LooseRange(InputPartition):
    folders: tuple[str, ...]


@dataclass
class PackRange(InputPartition):
    pack: str
    first: int
    last: int


class Pack:
    """A pack by its index: names, places, and objects with their chains of deltas resolved."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.store, self.path = store, path
        with store.open_input_stream(path.removesuffix(".pack") + ".idx") as f:
            raw = f.read()
        if raw[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{path}: an index of another version")
        n = struct.unpack_from(">I", raw, 8 + 255 * 4)[0]
        at = 8 + 1024
        names = [raw[at + 20 * k : at + 20 * k + 20] for k in range(n)]
        at += 24 * n
        short = struct.unpack_from(f">{n}I", raw, at)
        at += 4 * n
        place = lambda x: struct.unpack_from(">Q", raw, at + 8 * (x & 0x7FFFFFFF))[0] if x >> 31 else x
        self.entries = sorted((place(x), name) for x, name in zip(short, names, strict=True))
        self.held: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.bytes = 0

    @cached_property
    def offsets(self) -> dict[bytes, int]:
        return {name: offset for offset, name in self.entries}

    @cached_property
    def ends(self) -> dict[int, int]:
        offsets = [o for o, _ in self.entries]
        return dict(zip(offsets, [*offsets[1:], self.store.get_file_info(self.path).size - 20], strict=True))

    @cached_property
    def file(self):
        return self.store.open_input_file(self.path)

    def _entry(self, offset: int) -> tuple[int, int | None, bytes]:
        """(type, where its base stands, its bytes) of one entry."""
        self.file.seek(offset)
        raw = self.file.read(self.ends[offset] - offset)
        kind, at = raw[0] >> 4 & 7, 1
        while raw[at - 1] & 128:
            at += 1
        base = None
        if kind == OFFSET_DELTA:
            back = raw[at] & 127
            while raw[at] & 128:
                at += 1
                back = (back + 1) << 7 | raw[at] & 127
            base, at = offset - back, at + 1
        elif kind == NAME_DELTA:
            base, at = self.offsets[raw[at : at + 20]], at + 20
        return kind, base, zlib.decompressobj().decompress(raw[at:])

    def read(self, offset: int) -> tuple[str, bytes]:
        chain, at = [], offset
        while at not in self.held:
            kind, base, data = self._entry(at)
            if base is None:
                self._keep(at, KINDS[kind], data)
                break
            chain.append((at, data))
            at = base
        kind, data = self.held[at]
        for where, delta in reversed(chain):
            data = patched(data, delta)
            self._keep(where, kind, data)
        return kind, data

    def _keep(self, offset: int, kind: str, data: bytes) -> None:
        self.held[offset] = kind, data
        self.bytes += len(data)
        while self.bytes > KEPT and len(self.held) > 1:
            self.bytes -= len(self.held.popitem(last=False)[1][1])


def patched(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base: copies from it and new bytes in turn."""
    at, sizes = 0, []
    for _ in range(2):
        size, shift = 0, 0
        while True:
            byte = delta[at]
            size |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                break
        sizes.append(size)
    if sizes[0] != len(base):
        raise ValueError("a delta stands on another base")
    out = []
    while at < len(delta):
        op = delta[at]
        at += 1
        if op & 128:
            fields = [0] * 7
            for k in range(7):
                if op >> k & 1:
                    fields[k] = delta[at]
                    at += 1
            start, size = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            out.append(base[start : start + size])
        else:
            out.append(delta[at : at + op])
            at += op
    made = b"".join(out)
    if len(made) != sizes[1]:
        raise ValueError("a delta gives another length")
    return made


class Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def _place(self) -> tuple[fs.FileSystem, str]:
        store, base = fs.FileSystem.from_uri(self.root)
        inside = f"{base}/.git/objects"
        return store, inside if store.get_file_info(inside).type == fs.FileType.Directory else f"{base}/objects"

    def partitions(self) -> list[InputPartition]:
        store, base = self._place()
        here = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        folders = sorted(i.base_name for i in here if len(i.base_name) == 2)
        out: list[InputPartition] = [LooseRange(tuple(folders[k : k + LOOSE])) for k in range(0, len(folders), LOOSE)]
        for i in store.get_file_info(fs.FileSelector(f"{base}/pack", allow_not_found=True)):
            if i.path.endswith(".pack"):
                with store.open_input_stream(i.path) as f:
                    many = struct.unpack(">I", f.read(12)[8:])[0]
                out += [PackRange(i.base_name, k, min(k + PACKED, many)) for k in range(0, many, PACKED)]
        return out or [LooseRange(())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, base = self._place()
        if isinstance(partition, PackRange):
            pack = Pack(store, f"{base}/pack/{partition.pack}")
            for offset, name in pack.entries[partition.first : partition.last]:
                kind, data = pack.read(offset)
                yield name.hex(), kind, len(data), data
            return
        for folder in partition.folders:
            for i in store.get_file_info(fs.FileSelector(f"{base}/{folder}")):
                if len(i.base_name) == 38:
                    with store.open_input_stream(i.path) as f:
                        head, _, data = zlib.decompress(f.read()).partition(b"\0")
                    yield folder + i.base_name, head.split(b" ")[0].decode(), len(data), data


class GitObjects(DataSource):
    """spark.read.format("git_objects").load(path): every object of a repository, or of a bare one, that all workers can open."""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"])


def stored(spark: SparkSession, root: str) -> DataFrame:
    """oid, kind, size, content of every object, as often as it is stored."""
    spark.dataSource.register(GitObjects)
    return spark.read.format("git_objects").load(root)


def objects(spark: SparkSession, root: str) -> DataFrame:
    """oid, kind, size, content, once for each object, though it may be loose and packed."""
    return stored(spark, root).dropDuplicates(["oid"])


def digested(spark: SparkSession, root: str) -> DataFrame:
    """objects() with the content_hash of blobs in place of their content, as a written table: a repository is read once, and no blob is moved."""
    blob = F.col("kind") == "blob"
    found = stored(spark, root).select("oid", "kind", "size", F.when(~blob, F.col("content")).alias("content"), F.when(blob, F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("content_hash"))
    return written(found.dropDuplicates(["oid"]), "objects")


def commits(found: DataFrame) -> DataFrame:
    """git_commit, tree, parents, committed_at (seconds), message."""
    text = F.decode("content", "UTF-8")
    head = F.split(text, "\n\n", 2)
    return found.where("kind = 'commit'").select(
        F.col("oid").alias("git_commit"), F.regexp_extract(text, "^tree ([0-9a-f]{40})", 1).alias("tree"), F.regexp_extract_all(head[0], F.lit("(?m)^parent ([0-9a-f]{40})"), F.lit(1)).alias("parents"),
        F.regexp_extract(head[0], r"(?m)^committer .* (\d+) [+-]\d{4}$", 1).cast("long").alias("committed_at"), F.get(head, F.lit(1)).alias("message"),
    )


def entries(found: DataFrame) -> DataFrame:
    """tree, mode, name, child: the lines of every tree."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for oid, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, out = 0, []
                while at < len(raw):
                    end = raw.index(b"\0", at)
                    mode, _, name = raw[at:end].partition(b" ")
                    out.append((oid, mode.decode(), name.decode("utf-8", "replace"), raw[end + 1 : end + 21].hex()))
                    at = end + 21
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["tree", "mode", "name", "child"])

    return found.where("kind = 'tree'").select("oid", "content").mapInArrow(lines, "tree string, mode string, name string, child string")


def files(found: DataFrame, asked: DataFrame) -> DataFrame:
    """git_commit, path, mode, oid: the files of the commits asked for (git_commit). Folders are entered level by level, all commits at once; submodules have no files here."""
    lines = kept(entries(found))
    at = commits(found).join(asked.select("git_commit").distinct(), "git_commit").select("git_commit", F.lit("").alias("path"), "tree")
    out = None
    while True:
        below = kept(at.join(lines, "tree").select("git_commit", F.concat("path", "name").alias("path"), "mode", "child"))
        leaves = below.where(~F.col("mode").isin("40000", "160000")).select("git_commit", "path", "mode", F.col("child").alias("oid"))
        out = leaves if out is None else out.unionByName(leaves)
        at = below.where("mode = '40000'").select("git_commit", F.concat("path", F.lit("/")).alias("path"), F.col("child").alias("tree"))
        if at.isEmpty():
            return out


def snapshots(found: DataFrame, refs: DataFrame) -> DataFrame:
    """path, git_commit, content_hash: the files that historical references (ref_path, git_commit) name and that exist, as integrity.verify() takes them."""
    wanted = refs.where("git_commit is not null").select(F.col("ref_path").alias("path"), "git_commit").distinct()
    named = files(found, wanted).join(wanted, ["git_commit", "path"]).select("path", "git_commit", "oid")
    digest = F.col("content_hash") if "content_hash" in found.columns else F.concat(F.lit("sha256:"), F.sha2("content", 256))
    blobs = found.where("kind = 'blob'").select("oid", digest.alias("content_hash"))
    return named.join(blobs, "oid").select("path", "git_commit", "content_hash")


def write_loose(made: DataFrame, root: str) -> None:
    """Writes objects (kind, content) as loose files under root/objects; what stands there already is the same object."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        for b in batches:
            for kind, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = f"{kind} {len(content)}\0".encode() + content
                oid = hashlib.sha1(raw).hexdigest()
                store.create_dir(f"{base}/objects/{oid[:2]}", recursive=True)
                mine = f"{base}/objects/{oid[:2]}/.attempt-{attempt}"
                with store.open_output_stream(mine) as f:
                    f.write(zlib.compress(raw, 1))
                store.move(mine, f"{base}/objects/{oid[:2]}/{oid[2:]}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    made.select("kind", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()


def write_packs(made: DataFrame, root: str) -> None:
    """Writes objects (kind, content) as packs of PACKED objects at most under root/objects/pack, with their indexes: few files, where write_loose() makes one for each object.

    An object that comes again in a task is left out of its pack; two packs may hold the same.
    """
    codes = {name: code for code, name in KINDS.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        folder, n, held = f"{base}/objects/pack", 0, {}
        store.create_dir(folder, recursive=True)

        def flush() -> None:
            out, at, places = [b"PACK" + struct.pack(">II", 2, len(held))], 12, {}
            for oid, (head, data) in held.items():
                places[oid] = at, zlib.crc32(data, zlib.crc32(head))
                out += [head, data]
                at += len(head) + len(data)
            body = b"".join(out)
            end, names = hashlib.sha1(body).digest(), sorted(held)
            first = [0] * 256
            for oid in names:
                first[oid[0]] += 1
            index = [b"\xfftOc\x00\x00\x00\x02", struct.pack(">256I", *accumulate(first)), *names]
            index += [struct.pack(">I", places[oid][1]) for oid in names] + [struct.pack(">I", places[oid][0]) for oid in names] + [end]  # under 2**31, by ROOM
            index = b"".join(index)
            name = f"{folder}/pack-{hashlib.sha1(b''.join(names)).hexdigest()}-{uuid.uuid4().hex}"
            for suffix, data in ((".idx", index + hashlib.sha1(index).digest()), (".pack", body + end)):  # a pack is there once its index is
                with store.open_output_stream(f"{name}{suffix}.part") as f:
                    f.write(data)
                store.move(f"{name}{suffix}.part", name + suffix)
            held.clear()

        room = 0
        for b in batches:
            for kind, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n += 1
                oid = hashlib.sha1(f"{kind} {len(content)}\0".encode() + content).digest()
                if oid in held:
                    continue
                size, head = len(content) >> 4, [codes[kind] << 4 | len(content) & 15]
                while size:
                    head[-1] |= 128
                    head.append(size & 127)
                    size >>= 7
                data = zlib.compress(content, 1)
                if held and room + len(data) > ROOM:
                    flush()
                    room = 0
                held[oid] = bytes(head), data
                room += len(data)
                if len(held) == PACKED:
                    flush()
                    room = 0
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    made.select("kind", "content").mapInArrow(put, "n long").agg(F.sum("n")).collect()
