"""Fill-in-middle: texts cut into prefix, middle and suffix at token boundaries, and put together in another order.

A token is a run of ASCII letters or one other code point. A text's bytes become classes by bytes.translate and these become
one big integer with a bit a byte: boundaries are a few shifts and boolean operations, their number is a bit count, and the
boundary of a given rank is found by halving. No token is ever made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many stay plain, and of a hundred others how many put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = "1"

#: Of each byte, '1' for a letter of ASCII, and '1' for the first byte of a code point.
_LETTERS = bytes(49 if chr(b).isascii() and chr(b).isalpha() else 48 for b in range(256))
_HEADS = bytes(48 if 0x80 <= b < 0xC0 else 49 for b in range(256))


def _mask(text: bytes, table: bytes) -> int:
    """An integer whose k-th bit is the class of the k-th byte."""
    return int(text[::-1].translate(table), 2) if text else 0


def boundaries(text: bytes) -> tuple[int, int]:
    """(marks, heads): bits at the bytes where tokens start, and where code points start."""
    letters, heads = _mask(text, _LETTERS), _mask(text, _HEADS)
    return heads & ~(letters & letters << 1), heads


def select(marks: int, rank: int, width: int) -> int:
    """The place of the bit with this rank, from 0, among those set; width if there are no more than rank. Halves are counted until one bit is left."""
    if rank >= marks.bit_count():
        return width
    at, size = 0, marks.bit_length()
    while size > 1:
        half = size >> 1
        low = marks & (1 << half) - 1
        n = low.bit_count()
        if rank < n:
            marks, size = low, half
        else:
            marks, rank, at, size = marks >> half, rank - n, at + half, size - half
    return at


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits fixed by the document's id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform_text(text: bytes, h: list[int], plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of a text under four draws."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    marks, heads = boundaries(text)
    n = marks.bit_count()
    if not text or p in text or s in text or m in text or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a = select(marks, first, len(text))
    b = a if first == last else select(marks, last, len(text))
    before, upto = ((heads & (1 << x) - 1).bit_count() for x in (a, b))
    if h[3] % 100 < suffix_first:
        return n, "spm", before, upto - before, b"".join([s, text[b:], p, text[:a], m, text[a:b]])
    return n, "psm", before, upto - before, b"".join([p, text[:a], s, text[b:], m, text[a:b]])


def transform(docs: DataFrame, seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points; null if plain) and output, a row for each row of docs.

    Cuts and form depend on seed and doc_id alone, so repeated ids are cut alike where their texts are; ids may be of any type and count by
    their decimal text, a null one as an empty text. A null text is empty; an empty one, and one that holds a marker, stays plain. Time and
    memory grow with a text's length only, a text at a time beside its batch. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    arrow_batches(docs.sparkSession)
    asked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = asked.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            for k in range(0, b.num_rows, 64):
                ids = b.column(0).slice(k, 64)
                rows = [transform_text(t or b"", draws(i, seed), plain, suffix_first) for i, t in zip(ids.to_pylist(), texts.slice(k, 64).to_pylist(), strict=True)]
                n, form, before, between, out = zip(*rows, strict=True)
                cols = [ids, pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return asked.mapInArrow(each, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from an output and its form: markers occur in no part and can't arise across two, so the output is split at them."""
    part = F.split(output, "<[PSM]>", 4)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))


def digest(transformed: DataFrame) -> DataFrame:
    """The digests of outputs and of the texts restored from them."""
    digests = F.sha2(F.col("output").cast("binary"), 256), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))
