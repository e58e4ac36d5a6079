"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A record file holds, for each document in ascending doc_id order,
    length (8 bytes) | checksum of the length (4) | payload | checksum of the payload (4)
all little-endian. A payload is doc_id (8 bytes), flags (1 byte: 1 for a null doc_id, 2 for ids of
four bytes instead of two) and the ids. A checksum is the CRC-32 of zlib, masked by a rotation and
an offset so that a checksum over data which itself holds checksums stays sound.
An index file beside it holds a row for each record: offset, tokens before it in the file, tokens.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, arrow_batches, scratch_path

END_ID = 1
#: Bytes of words and ids that a worker remembers, about; beyond it forgets all and starts anew. Words of more than LONG bytes aren't remembered.
REMEMBERED, LONG = 256 << 20, 64

_HEAD, _DOC, _ROW = struct.Struct("<QI"), struct.Struct("<qB"), np.dtype([("offset", "<u8"), ("before", "<u8"), ("tokens", "<u8")])
_NULL, _WIDE = 1, 2
#: Words of ASCII and the letters of Latin-1 are composed, and lower-case one sign to one; this is how the tokenizer splits them then.
_LATIN = re.compile("[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
#: The rules that the short way above was written for: how a tokenizer file normalises, and the pattern that it splits by (fixed values).
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file normalises and splits by the rules above, so that a text's ids are those of its words in turn. Its added tokens must begin with <| and hold no space."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    rules = file.get("normalizer") == _NORMALIZER and file.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_PATTERN, _BYTES]}
    added = file.get("added_tokens") or []
    return rules and all(t["content"].startswith("<|") and len(t["content"].split()) == 1 and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in added)


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def unmasked(c: int) -> int:
    c = (c - 0xA282EAD8) & 0xFFFFFFFF
    return ((c >> 17) | (c << 15)) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """A document's record."""
    payload = _DOC.pack(doc_id or 0, (doc_id is None) * _NULL + wide * _WIDE) + ids
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))])


def indexed(rows: list[tuple[int, int, int]]) -> bytes:
    return np.array(rows, _ROW).tobytes()


class Coder:
    """Ids of whole texts as bytes, the same as the tokenizer gives for the text at once.

    The tokenizer composes letters, lower-cases and splits at white space before it joins pieces, so nothing reaches
    across ASCII white space, and a text's ids are those of its words in turn. Words go to the tokenizer whole and as
    they stand; only those of ASCII and Latin-1 letters, where its rule has few cases, are lower-cased and split here.
    Short words are remembered. Texts for a tokenizer file of any other rules go to it whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = splits_at_spaces(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.known: dict[bytes, bytes] = {}
        self.bytes = 0

    def _plain(self, words: list[bytes]) -> list[bytes]:
        got, held, size = [], [], 0
        for w in words:
            held.append(w.decode("utf-8", "replace"))
            size += len(w)
            if len(held) == 4096 or size > 1 << 20:
                got += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)]
                held, size = [], 0
        return got + [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(held, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.bytes += sum(map(len, words)) + sum(map(len, ids)) + 160 * len(words)  # what the two objects and their place take

    def _learn(self, words: set[bytes]) -> None:
        whole, parts = [], {}
        for w in words:
            text = w.decode("utf-8", "replace")
            if b"<|" not in w and _LATIN.fullmatch(text):
                parts[w] = [p.encode() for p in _SPLIT.findall(text.lower())]
            else:
                whole.append(w)
        new = list({p for ps in parts.values() for p in ps if p not in self.known} | set(whole))
        self._keep(new, self._plain(new))
        more = [w for w in parts if w not in self.known]
        self._keep(more, [b"".join([self.known[p] for p in parts[w]]) for w in more])

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.by_words:
            return self._plain([t or b"" for t in texts])
        out: list[bytes] = []
        for t in texts:
            t = t or b""
            words = (t.translate(LOWER) if t.isascii() and b"<|" not in t else t).split()
            if self.bytes > REMEMBERED:
                self.known.clear()
                self.bytes = 0
            new = set(words).difference(self.known)
            long = {w for w in new if len(w) > LONG}
            if len(new) > len(long):
                self._learn(new - long)
            out.append(b"".join([self.known[w] for w in words] if not long else [self._plain([w])[0] if w in long else self.known[w] for w in words]))
        return out


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _place(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _writer(root: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        store, base = _place(root)
        code, end = None, b""
        out, rows, at, before = None, [], 0, 0
        name = f"{base}/shard-{shard:06d}"
        mine = f"{base}/.attempt-{task.taskAttemptId()}"
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                code = coder(path)
                end = np.array([end_id], code.kind).tobytes()
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{mine}.rec", buffer_size=1 << 20)
            texts = b.column(1)
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            for k in range(0, b.num_rows, 64):
                for doc_id, ids in zip(b.column(0).slice(k, 64).to_pylist(), code.encode(texts.slice(k, 64).to_pylist()), strict=True):
                    frame = framed(doc_id, ids + end, code.wide)
                    out.write(frame)
                    tokens = len(ids) // code.kind.itemsize + 1
                    rows.append((at, before, tokens))
                    at, before = at + len(frame), before + tokens
        if out is None:
            return
        out.close()
        with store.open_output_stream(f"{mine}.idx") as index:
            index.write(indexed(rows))
        for end_of in (".rec", ".idx"):  # a rerun of a lost task writes the same bytes
            store.move(f"{mine}{end_of}", f"{name}{end_of}")
        made = [[shard], [len(rows)], [before], [at]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=["shard", "docs", "tokens", "bytes"])

    return write


def write_records(docs: DataFrame, root: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> list[dict]:
    """Writes every text of docs under root, in ascending doc_id order over the shards, and a manifest; returns its shards.

    Texts are dealt out by ranges of doc_id, sorted and encoded where they land (their ids take no less room than compressed texts); each file is
    written under the attempt's name and moved into place, so a lost executor's tasks may run again.
    A null text is empty and holds only the end id; null doc_ids come first; repeated doc_ids keep all their
    rows, in an order fixed by their texts and spread over several shards if they are many. An empty table writes a manifest without shards.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    mixed = docs.select(doc_id, text).withColumn("__mix", F.xxhash64(text))
    stats = mixed.repartitionByRange(doc_id, "__mix").sortWithinPartitions(doc_id, "__mix", text).select(doc_id, text).mapInArrow(_writer(root, tokenizer, end_id), "shard long, docs long, tokens long, bytes long")
    start, shards = 0, []
    for r in sorted(stats.collect()):  # one row a file
        shards.append(r.asDict() | {"start": start})
        start += r["tokens"]
    store, base = _place(root)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps({"end_id": end_id, "tokens": start, "shards": shards}).encode())
    return shards


def _record(raw: bytes, what: str) -> tuple[int | None, np.ndarray]:
    """The doc_id and ids of a framed record, its checksums verified."""
    size, check = _HEAD.unpack_from(raw)
    payload = raw[_HEAD.size : _HEAD.size + size]
    if masked(raw[:8]) != check or len(payload) != size or masked(payload) != struct.unpack_from("<I", raw, _HEAD.size + size)[0]:
        raise ValueError(f"{what}: a record is damaged")
    doc_id, flags = _DOC.unpack_from(payload)
    return None if flags & _NULL else doc_id, np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=_DOC.size)


def scan(store: fs.FileSystem, name: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, tokens before it in the file, and ids, of each record of a shard in file order."""
    with store.open_input_stream(f"{name}.idx") as f:
        index = np.frombuffer(f.read(), _ROW)
    with store.open_input_stream(f"{name}.rec", buffer_size=1 << 20) as f:
        for row in index:
            head = f.read(_HEAD.size)
            yield (lambda got: (got[0], int(row["before"]), got[1]))(_record(head + f.read(_HEAD.unpack(head)[0] + 4), name))


def shuffled(root: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Every record once, in an order fixed by seed, by seeks at the offsets of the index files."""
    store, base = _place(root)
    with store.open_input_stream(f"{base}/manifest.json") as f:
        shards = [f"{base}/shard-{s['shard']:06d}" for s in json.loads(f.read())["shards"]]
    offsets = [np.frombuffer(store.open_input_stream(f"{s}.idx").read(), _ROW)["offset"] for s in shards]
    files = [store.open_input_file(f"{s}.rec") for s in shards]
    which = np.repeat(np.arange(len(shards)), [len(x) for x in offsets])
    flat = np.concatenate([*offsets, np.zeros(0, "<u8")])
    for k in np.random.default_rng(seed).permutation(len(flat)):
        f = files[which[k]]
        f.seek(int(flat[k]))
        head = f.read(_HEAD.size)
        yield _record(head + f.read(_HEAD.unpack(head)[0] + 4), shards[which[k]])


def read_records(spark: SparkSession, root: str, shards: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as unsigned 32-bit little-endian), read from the files."""
    kind = T.StructType([T.StructField("shard", T.LongType()), T.StructField("start", T.LongType())])
    listed = spark.createDataFrame([(s["shard"], s["start"]) for s in shards], kind)
    if shards:
        listed = listed.repartition(len(shards))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            store, base = _place(root)
            for row in b.to_pylist():
                held: list[tuple] = []
                for doc_id, before, ids in scan(store, f"{base}/shard-{row['shard']:06d}"):
                    held.append((doc_id, row["start"] + before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=names)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes docs to record files in the shared folder and returns what reading them gives."""
    root = scratch_path(docs.sparkSession, "records")
    return read_records(docs.sparkSession, root, write_records(docs, root, tokenizer, end_id))
