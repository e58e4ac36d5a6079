"""Digests: of files, of directories, of canonical documents, and keyed streams of random words."""

from __future__ import annotations

import hashlib
import hmac
import json
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def file_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def ordered_digest(rows: DataFrame, by: list[str], order: list[str], line: str, out: str = "digest", unique: bool = False, end: str = "") -> DataFrame:
    """(by, n, out): the digest of each group's lines in the byte order of `order`, a line feed between them and `end` after the last.

    A group's lines go through one task, as a digest has to, but sorted by Spark and digested as they stream by, so that none is ever held whole. unique: a group in which an
    order stands twice has no digest.
    """
    kind = T.StructType([*(rows.schema[c] for c in by), T.StructField("n", T.LongType()), T.StructField(out, T.StringType())])
    names, width = kind.names, len(by)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, before, n, twice, made = None, None, 0, False, hashlib.sha256()

        def done() -> pa.RecordBatch:
            made.update(end.encode())
            values = [*group, n, None if unique and twice else "sha256:" + made.hexdigest()]
            return pa.RecordBatch.from_arrays([pa.array([v], f) for v, f in zip(values, to_arrow_schema(kind).types, strict=True)], names=names)

        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns, strict=True):
                if group != row[:width]:
                    if group is not None:
                        yield done()
                    group, before, n, twice, made = row[:width], None, 0, False, hashlib.sha256()
                made.update((("\n" if n else "") + (row[-1] or "")).encode())
                key = row[width:-1]
                n, twice, before = n + 1, twice or key == before, key
        if group is not None:
            yield done()

    dealt = rows.select(*by, *order, F.col(line).alias("_line")).repartition(*by).sortWithinPartitions(*by, *order, "_line")
    return dealt.mapInArrow(each, kind)


def manifest_digest(files: DataFrame, group: str, path: str, content_hash: str, out: str = "digest") -> DataFrame:
    """(group, n, out): the digest of each group's lines "path:hash" in byte order of the path, a line feed between them."""
    line = F.concat(F.col(path), F.lit(":"), F.regexp_replace(content_hash, "^sha256:", ""))
    return ordered_digest(files.select(group, F.col(path).alias("_path"), line.alias("_text")), [group], ["_path"], "_text", out)


def canonical(value) -> str:
    """A document with sorted keys and without nulls in maps; arrays stay as they are."""

    def drop(v):
        if isinstance(v, dict):
            return {k: drop(x) for k, x in v.items() if x is not None}
        return [drop(x) for x in v] if isinstance(v, list) else v

    return json.dumps(drop(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def strict(value) -> bytes:
    """A document in NFC with keys in byte order; integers of 64 bits only, no floats, control characters escaped."""

    def text(s: str) -> str:
        s = unicodedata.normalize("NFC", s)
        return '"' + "".join({'"': '\\"', "\\": "\\\\"}.get(c) or (f"\\u{ord(c):04x}" if ord(c) < 32 else c) for c in s) + '"'

    def one(v) -> str:
        if v is None or isinstance(v, bool):
            return {None: "null", True: "true", False: "false"}[v]
        if isinstance(v, int):
            if not -(2**63) <= v < 2**63:
                raise ValueError("an integer beyond 64 bits")
            return str(v)
        if isinstance(v, str):
            return text(v)
        if isinstance(v, list):
            return "[" + ",".join(map(one, v)) + "]"
        if isinstance(v, dict):
            keys = {unicodedata.normalize("NFC", k): x for k, x in v.items()}
            if len(keys) < len(v):
                raise ValueError("two keys are the same in NFC")
            return "{" + ",".join(f"{text(k)}:{one(keys[k])}" for k in sorted(keys, key=lambda k: k.encode())) + "}"
        raise ValueError(f"{type(v).__name__} isn't allowed")

    return one(value).encode()


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON texts in canonical form; null for what isn't JSON."""

    def one(t):
        try:
            return canonical(json.loads(t))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def frame(name: str, payload: bytes) -> bytes:
    return struct.pack(">H", len(name)) + name.encode("ascii") + struct.pack(">I", len(payload)) + payload


def tree_digest(entries: dict[str, tuple[int, bytes]]) -> str:
    """The digest of a tree's framed records (path, mode, content) in the byte order of paths in NFC. Paths are relative and plain; no file lies under another; modes are 644 or 755."""
    named = {unicodedata.normalize("NFC", p): e for p, e in entries.items()}
    paths = sorted(named, key=str.encode)
    bad = [p for p in paths if not p or p.startswith("/") or set(p.split("/")) & {"", ".", ".."} or named[p][0] not in (0o644, 0o755)]
    under = [b for a, b in zip(sorted(named), sorted(named)[1:], strict=False) if b.startswith(a + "/")]
    if bad or under or len(named) < len(entries):
        raise ValueError(f"a path or mode that a tree can't hold: {[*bad, *under] or 'two paths are the same in NFC'}")
    made = hashlib.sha256()
    for p in paths:
        mode, content = named[p]
        made.update(frame("path", p.encode()) + frame("mode", struct.pack(">H", mode)) + frame("content", content))
    return "sha256:" + made.hexdigest()


class Stream:
    """32-bit words of an HMAC counter stream, with unbiased integers and weighted choices from them."""

    def __init__(self, key: bytes):
        self.key, self.words = key, self._words()

    def _words(self) -> Iterator[int]:
        counter = 0
        while True:
            yield from struct.unpack(">8I", hmac.new(self.key, frame("counter", struct.pack(">Q", counter)), hashlib.sha256).digest())
            counter += 1

    def uniform(self, n: int) -> int:
        """Below n, by rejection; n = 1 takes no word."""
        if n == 1:
            return 0
        return next(w for w in self.words if w < (1 << 32) // n * n) % n

    def choice(self, weights: list[int]) -> int:
        v, total = self.uniform(sum(weights)), 0
        for k, w in enumerate(weights):
            total += w
            if v < total:
                return k
        raise AssertionError


def table_lines(df: DataFrame, table: str, columns: list[str], keys: list[str]) -> DataFrame:
    """(table, key, line): each row as canonical JSON of fixed columns; doubles with six places, text in NFC. A missing column is an error."""
    from .text import nfc

    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{table} lacks {lacking}")

    def value(name: str) -> Column:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DoubleType):
            return F.when(F.col(name).isNotNull(), F.format_string("%.6f", F.col(name) + 0.0))
        return F.col(name) if isinstance(kind, (T.IntegerType, T.LongType, T.BooleanType)) else nfc(F.col(name).cast("string"))

    row = df.select(F.array(*[F.col(k).cast("string") for k in keys]).alias("key"), *[value(c).alias(c) for c in sorted(columns)])
    line = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return row.select(F.lit(table).alias("table"), "key", line.alias("line"))


def dump_digest(lines: DataFrame) -> DataFrame:
    """(table, n, digest) over the lines of each table in the order of their keys; a key that stands twice makes the digest null."""
    return ordered_digest(lines.select("table", F.to_json("key").alias("key"), "line"), ["table"], ["key"], "line", unique=True, end="\n")
