"""Byte-level BPE by dynamic programming over prefixes.

Merging pairs by rank gives each byte string one encoding, and a beginning of that encoding is the encoding of what it
covers. So each prefix has one last token: the token that ends there and goes together with the last token of the prefix
before it, that is, merging the two's bytes gives just the two. The table of last tokens is all that is kept. More bytes
only add to it, and after an edit it is the old one again as soon as it agrees with that over the longest token's length.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

#: Code points of a text that are split at once, at least.
STRETCH = 1 << 20
#: Bytes of pieces and ids that a worker remembers, about, and pairs of tokens; beyond it forgets all. Pieces of more than LONG bytes aren't remembered.
REMEMBERED, PAIRS, LONG = 192 << 20, 1 << 20, 64
#: Code points behind a piece that its end may depend on, or more.
AHEAD = 4


class Vocabulary:
    """Tokens by rank, the automaton that finds them, and which two go together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.longest, self.never = max(map(len, ranks)), max(ranks.values()) + 1
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.spines: dict[int, tuple[list, list]] = {}
        self.found = ahocorasick.Automaton()
        for t, r in ranks.items():
            parts = self.merged(t, len(t) > 1)
            if len(parts) <= 2 and t == b"".join(self.tokens[p] for p in parts) and self.merges(parts, r):  # merging never gives another one, but as a whole piece
                self.found.add_word(t.decode("latin-1"), (r, len(t)))
        self.found.make_automaton()

    def merges(self, parts: list[int], rank: int) -> bool:
        """Whether the last two parts of a token merge to it, which is kept; a byte is whole as it stands."""
        if len(parts) == 2:
            self.halves[rank] = (parts[0], parts[1])
        return parts == [rank] or len(parts) == 2

    def merged(self, word: bytes, stop: bool = False) -> list[int]:
        """The encoding of a short byte string by its definition: the pair of least rank is merged, the first of equal ones, until none is left; with stop, until two parts are."""
        parts = [word[k : k + 1] for k in range(len(word))]
        ranks = [self.ranks.get(word[k : k + 2], self.never) for k in range(len(word) - 1)]
        while ranks and not (stop and len(ranks) == 1):
            least = min(ranks)
            if least == self.never:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = self.ranks.get(parts[k] + parts[k + 1], self.never)
            if k:
                ranks[k - 1] = self.ranks.get(parts[k - 1] + parts[k], self.never)
        return [self.ranks[p] for p in parts]

    def spine(self, token: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
        """What stands at the token's right end while it is being merged, and at its left end: bytes, and the ranks at which it comes and goes."""
        known = self.spines.get(token)
        if known is None:
            known = ([], [])
            for side, out in ((1, known[0]), (0, known[1])):
                at, until = token, self.never
                while at is not None:
                    out.append((self.tokens[at], at, until))
                    at, until = self.halves.get(at, (None, None))[side], at
            self.spines[token] = known
        return known

    def together(self, a: int, b: int) -> bool:
        """Whether b may follow a: while the bytes of both are merged, no part at the end of a meets one at the beginning of b that it merges with sooner than either goes into its own token."""
        ranks, never = self.ranks, self.never
        for x, x_from, x_until in self.spine(a)[0]:
            for y, y_from, y_until in self.spine(b)[1]:
                rank = ranks.get(x + y, never)
                if rank < never:
                    when = max(rank, x_from, y_from)
                    if when < x_until and (when < y_until or rank == y_until):  # of equal pairs the left one is merged first
                        return False
        return True


class Prefixes:
    """A byte string with the last token of each of its prefixes; it may grow and be edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.text, self.last, self.worked = vocabulary, data.decode("latin-1"), [-1], 0
        self._fill(0, None, 0)

    def append(self, more: bytes) -> None:
        start = len(self.text)
        self.text += more.decode("latin-1")
        self._fill(start, None, 0)

    def edit(self, at: int, removed: int, inserted: bytes) -> None:
        """Puts inserted in the place of as many bytes at this place. The table is filled anew from there to where it is the old one again."""
        tail, old = self.text[at + removed :], self.last[at + removed :]
        self.text = self.text[:at] + inserted.decode("latin-1") + tail
        del self.last[at + 1 :]
        self._fill(at, old, at + len(inserted))

    def _fill(self, start: int, old: list[int] | None, base: int) -> None:
        """Adds the last tokens of all prefixes beyond start; old is what stood from base on."""
        v, last, alike = self.vocabulary, self.last, 0
        pairs, add, at = v.pairs, last.append, len(last) - 1  # at: the last byte of the prefix that is looked for
        for end, (token, size) in v.found.iter(self.text, start - v.longest) if start > v.longest else v.found.iter(self.text):
            if end != at:  # already known
                continue
            if size <= at:
                key = last[at + 1 - size] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[key] = v.together(key >> 32, token)
                if not fits:
                    continue
            add(token)
            at += 1
            if old is not None and at > base:
                alike = alike + 1 if old[at - base] == token else 0
                if alike >= v.longest:
                    last += old[at + 1 - base :]
                    break
        self.worked += at - start

    def ids(self) -> list[int]:
        out, at, last, sizes = [], len(self.text), self.last, self.vocabulary.sizes
        while at:
            token = last[at]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out


class Coder:
    """Encodes texts piece by piece, as a pattern splits them, and remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.bytes = 0

    def piece(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(data)  # a piece that is a token is that token, however merging would go
        ids = Prefixes(self.vocabulary, data).ids() if whole is None else [whole]
        return struct.pack(f"<{len(ids)}i", *ids)

    def split(self, text: str, at: int = 0) -> Iterator[list[str]]:
        """The pieces from a piece's start on, in lists. A text is split stretch by stretch; a stretch's pieces whose ends may depend on what follows are left to the next."""
        size = STRETCH
        while at < len(text):
            some = self.pattern.findall(text[at : at + size])
            if at + size < len(text):
                sure, end = len(some), size
                while sure and end + AHEAD > size:
                    sure -= 1
                    end -= len(some[sure])
                if not sure:
                    size *= 2
                    continue
                some = some[:sure]
                at += end
            else:
                at = len(text)
            size = STRETCH
            yield some

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian integers of four bytes."""
        if self.bytes > REMEMBERED:
            self.known.clear()
            self.bytes = 0
        long = {}
        for p in set(pieces).difference(self.known):
            if len(p) > LONG:
                long[p] = self.piece(p)
                continue
            self.known[p] = got = self.piece(p)
            self.bytes += 4 * len(p) + len(got) + 160  # what the two objects and their place take
        return [long[p] if p in long else self.known[p] for p in pieces] if long else list(map(self.known.__getitem__, pieces))

    def encode(self, text: str, shape: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """The ids of a text, and with shape the code points and the tokens of each piece."""
        ids, chars, tokens = [], [], []
        for pieces in self.split(text):
            got = self.ids(pieces)
            ids.append(b"".join(got))
            if shape:
                chars.append(np.fromiter(map(len, pieces), np.int32, len(pieces)))
                tokens.append(np.fromiter(map(len, got), np.int32, len(got)) // 4)
        flat = np.frombuffer(b"".join(ids), "<i4")
        return (flat, *(np.concatenate([np.zeros(0, np.int32), *x]) if shape else None for x in (chars, tokens)))

    def edited(self, text: str, ids: np.ndarray, chars: np.ndarray, tokens: np.ndarray, at: int, removed: int, inserted: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, int]:
        """(text, ids, chars, tokens) after an edit, and how many ids were made anew: those from the last piece that ends well before it up to the first that begins where an old one did."""
        ends, places = np.cumsum(chars), np.concatenate([[0], np.cumsum(tokens)])
        text = text[:at] + inserted + text[at + removed :]
        first = int(np.searchsorted(ends, at - AHEAD, "right"))
        here = int(ends[first - 1]) if first else 0
        moved = len(inserted) - removed
        new: list[str] = []
        rest = len(ends)
        for pieces in self._near(text, here):
            for p in pieces:
                new.append(p)
                here += len(p)
                if here >= at + len(inserted):
                    k = int(np.searchsorted(ends, here - moved)) + 1
                    if k <= len(ends) and ends[k - 1] + moved == here and ends[k - 1] >= at + removed:
                        rest = k
                        break
            else:
                continue
            break
        made = self.ids(new)
        middle = np.frombuffer(b"".join(made), "<i4")
        joined = lambda x, y, z: np.concatenate([x, y, z]).astype(np.int32)
        chars = joined(chars[:first], np.fromiter(map(len, new), np.int32, len(new)), chars[rest:])
        counts = np.fromiter(map(len, made), np.int32, len(made)) // 4
        return text, joined(ids[: places[first]], middle, ids[places[rest] :]), chars, joined(tokens[:first], counts, tokens[rest:]), len(middle)

    def _near(self, text: str, at: int) -> Iterator[list[str]]:
        """Pieces from a piece's start on, in short lists at first: an edit seldom reaches far."""
        size = 256
        while at < len(text):
            if at + size >= len(text):
                yield from self.split(text, at)
                return
            some = self.pattern.findall(text[at : at + size])
            sure, end = len(some), size
            while sure and end + AHEAD > size:
                sure -= 1
                end -= len(some[sure])
            if sure:
                yield some[:sure]
                at += end
            size *= 2


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    with open(path, "rb") as f:
        return Coder({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)


def _lists(parts: list[np.ndarray | None]) -> pa.ListArray:
    ends = np.cumsum([0, *[0 if p is None else len(p) for p in parts]])
    flat = np.concatenate([np.zeros(0, np.int32), *[p for p in parts if p is not None]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def encode(docs: DataFrame, ranks: str, pattern: str, shape: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int), a row for each row of docs; with shape also piece_chars and piece_tokens, which edit() needs.

    ranks is the path of a file of base64 tokens and ranks that every worker can open. A null text is empty and has no ids. Texts are taken whole,
    a stretch at a time; repeated rows stay; doc_id may be of any type and null; other columns are ignored; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                made = list(zip(*[code.encode(t or "", shape) for t in b.column(1).slice(k, 64).to_pylist()], strict=True))
                cols = {"doc_id": b.column(0).slice(k, 64), "ids": _lists(made[0])}
                if shape:
                    cols |= {"piece_chars": _lists(made[1]), "piece_tokens": _lists(made[2])}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = ", piece_chars array<int>, piece_tokens array<int>" if shape else ""
    return asked.mapInArrow(each, f"doc_id {asked.schema['doc_id'].dataType.simpleString()}, ids array<int>{more}")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary): the bytes of the ids, which need not be whole code points. Null where ids is null or holds what is no token."""
    arrow_batches(encoded.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = coder(ranks, pattern).vocabulary.tokens
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                out = []
                for row in part.column("ids"):
                    try:
                        out.append(b"".join(map(tokens.__getitem__, row.values.to_pylist())) if row.is_valid else None)
                    except KeyError:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    kept = encoded.select("doc_id", "ids")
    return kept.mapInArrow(each, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")


def edit(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text, ids, piece_chars, piece_tokens and remade (ids made anew) after each row's edit: inserted takes the place of `removed` code points of its text at `at`.

    encoded holds text, what encode(shape=True) gives, and at, removed (long) and inserted. An append is an edit at the text's length. Places beyond the
    text are its end; nulls stand for an empty text, 0 and nothing inserted. The ids are those of the whole new text, though only pieces near the edit are encoded.
    """
    arrow_batches(encoded.sparkSession)
    names = ["doc_id", "text", "ids", "piece_chars", "piece_tokens", "at", "removed", "inserted"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(ranks, pattern)
        for b in batches:
            for k in range(b.num_rows):
                doc_id, text, *arrays, at, removed, inserted = (b.column(n)[k] for n in names)
                text, at, removed, inserted = text.as_py() or "", at.as_py() or 0, removed.as_py() or 0, inserted.as_py() or ""
                ids, chars, tokens = (np.zeros(0, np.int32) if not a.is_valid else a.values.to_numpy(zero_copy_only=False) for a in arrays)
                at = min(max(at, 0), len(text))
                made = code.edited(text, ids, chars, tokens, at, min(max(removed, 0), len(text) - at), inserted)
                cols = [pa.array([doc_id.as_py()], doc_id.type), pa.array([made[0]], b.column(1).type), *map(_lists, ([made[1]], [made[2]], [made[3]])), pa.array([made[4]], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names[:5], "remade"])

    kept = encoded.select(*names)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(each, f"doc_id {kind}, text string, ids array<int>, piece_chars array<int>, piece_tokens array<int>, remade long")


def digest(decoded: DataFrame) -> DataFrame:
    """The number of ids, and the digests of the ids in decimal and of the decoded bytes."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
