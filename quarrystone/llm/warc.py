"""WARC derivatives: metadata and plain-text conversion records from responses, in DataFrame operations."""

from __future__ import annotations

import gzip
import hashlib
import html as markup
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches

#: Elements whose content isn't text and comments, up to their end or the page's; blocks that end a line; any other tag.
HIDDEN = r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|!--.*?(?:-->|\z))"
BREAKS = r"(?i)</?(?:p|br|div|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|title|head|body|html)\b[^>]*>"
TAG = r"</?[A-Za-z!][^>]*>"
#: The date of pages that carry none.
WARC_DATE = "1970-01-01T00:00:00Z"


_BLANK = re.compile("&nbsp;?|&#0*160;|&#[xX]0*[aA]0;")
#: A value of an attribute in any of its three forms; a link with its text, up to its end, the next link or the page's.
VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
ANCHOR = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{VALUE}[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"
LANG = rf"(?i)<html\s(?:[^>]*?\s)?lang\s*=\s*{VALUE}"


def _once(pattern: str, flags: str = "") -> str:
    """A pattern of tags ending in [^>]*> that also takes, as its group 1, one that never closes, with all behind it: no other can close there, and none is looked at again."""
    open_ = pattern.removeprefix(flags).removesuffix("[^>]*>")
    return f"{flags}(?:{open_}[^>]*+>|({open_}[^>]*+\\z))"


#: What is searched for, with alternatives that step over tags without what is asked, so that each sign of a page is looked at a few times only.
_BREAKS, _TAG = _once(BREAKS, "(?i)"), _once(TAG)
_LINKS, _PAGES = ANCHOR + r"|<a\s[^>]*+(?:>|\z)", LANG + r"|<html\s[^>]*+(?:>|\z)"
_HREF = rf"(?is)^<a\s(?:[^>]*?\s)?href\s*=\s*{VALUE}[^>]*>"
_TITLE = r"(?is)<title\b[^>]*+(?:>(.*?)(?:</title\s*>|\z)|\z)"


def resolved(text: str) -> str:
    """text with all entities of HTML and numeric references resolved; a no-break space becomes a space."""
    return markup.unescape(_BLANK.sub(" ", text)) if "&" in text else text


@F.pandas_udf(T.StringType())
def _resolved(texts: pd.Series) -> pd.Series:
    return texts.map(resolved, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_resolved(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: [resolved(t) for t in x], na_action="ignore")


def _shown(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, " ")


def _bare(shown: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(shown, _BREAKS, "$1\n"), _TAG, "$1 ")


def _joined(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f\x0B]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def plain_text(html: Column) -> Column:
    """The text of a page: hidden parts out, a line for each block, entities resolved, white space joined, no empty lines; null stays null."""
    return _joined(_resolved(_bare(_shown(html))))


def attribute(text: Column, pattern: str) -> Column:
    """The value in the first match of a pattern with VALUE."""
    return F.concat(*[F.regexp_extract(text, pattern, k) for k in (1, 2, 3)])


def urn(*parts: Column) -> Column:
    """A record id fixed by its parts, in the form of a UUID."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, k, n), F.lit("-"))][:-1], F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: Column | None = None, headers: Column | None = None) -> DataFrame:
    """Pages as response records: key, record_id, target_uri, date, headers (of the source's answer), payload, payload_digest.

    Where pages carry no date or headers, the date is WARC_DATE and the headers are the type and length of what is there. Records of a WARC file come by read_warc().
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    key = F.col(page_id).cast("string")
    own = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.octet_length(payload).cast("string"))
    return pages.select(
        F.col(page_id).alias("key"),
        urn(F.lit("response"), F.coalesce(key, F.lit("")), F.coalesce(F.col(url), F.lit("")), F.sha2(payload, 256)).alias("record_id"),
        F.col(url).alias("target_uri"), F.coalesce(*([] if date is None else [date]), F.lit(WARC_DATE)).alias("date"),
        F.coalesce(*([] if headers is None else [headers]), own).alias("headers"),
        payload.alias("payload"), digest(payload).alias("payload_digest"),
    )


def derivatives(answers: DataFrame) -> DataFrame:
    """Two rows for each response, a metadata record and a conversion record.

    Both carry a record id of their own, the response's as refers_to, its uri, date and digest. The metadata
    block is JSON: the envelope (refers-to, target, digest), the source's headers, title, declared language, and links
    (their texts, in the same order, as link_texts). The conversion block is the plain text. Each has the digest and the length of its own block. An
    empty payload gives an empty text and no links; a null uri stays null; repeated responses give repeated records. Pages are read
    whole, in time that grows with their length; an unclosed script, style or comment ends with its page. An empty table gives no rows; other columns are ignored.
    """
    answers = answers.select("key", "record_id", "target_uri", "date", "headers", "payload", "payload_digest")
    parts = answers.withColumn("shown", _shown(F.col("payload")))  # no links, titles or languages of scripts and comments; searched once, used by all below
    shown = F.col("shown")
    found = F.filter(F.regexp_extract_all(shown, F.lit(_LINKS), F.lit(0)), lambda m: m.rlike(_HREF))
    tag = F.regexp_extract(shown, _PAGES, 0)  # seldom has the first one no language where another has
    every = F.filter(F.regexp_extract_all(shown, F.lit(_PAGES), F.lit(0)), lambda m: m.rlike(LANG.replace("<html", "^<html")))
    tongue = F.when((tag == "") | tag.rlike(LANG), tag).otherwise(F.get(every, F.lit(0)))
    parts = parts.withColumns({"found": found, "text": _bare(shown), "lang": attribute(F.coalesce(tongue, F.lit("")), LANG)})
    parts = parts.withColumn("title", _bare(F.regexp_extract(shown, _TITLE, 1))).drop("shown")
    values, texts = F.transform("found", lambda m: F.regexp_replace(m, _HREF + r".*\z", "$1$2$3")), F.transform("found", lambda m: _bare(F.regexp_replace(m, _HREF, "")))
    parts = parts.withColumn("resolved", _all_resolved(F.concat(F.array("text", "title"), values, texts)))  # in one array: one way to Python and back
    n = F.size("found")
    parts = parts.withColumn("joined", F.transform(F.concat(F.slice("resolved", 1, 2), F.slice("resolved", n + 3, n)), _joined))
    title, texts, links = F.get("joined", F.lit(1)), F.slice("joined", 3, n), F.slice("resolved", 3, n)
    metadata = F.to_json(
        F.struct(
            F.struct(F.col("record_id").alias("refers_to"), F.col("target_uri").alias("target_uri"), F.col("payload_digest").alias("payload_digest")).alias("envelope"),
            F.col("headers").alias("headers"),
            title.alias("title"), F.col("lang").alias("lang"), links.alias("links"), texts.alias("link_texts"),
        )
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("content_type"), metadata.alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.get("joined", F.lit(0)).alias("block")),
    )
    rows = parts.select("key", "record_id", "target_uri", "date", "payload_digest", F.explode(kinds).alias("r"))
    return rows.select(
        "key", F.col("r.type").alias("type"), urn(F.col("r.type"), F.col("record_id")).alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.col("payload_digest").alias("source_digest"), F.col("r.content_type").alias("content_type"), digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"), F.col("r.block").alias("block"),
    )


def as_warc(records: DataFrame) -> DataFrame:
    """record: each derivative as the bytes of a WARC/1.0 record, with the two line ends that close it. Line ends in a uri are escaped."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A"), F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), maybe("WARC-Refers-To", F.col("refers_to")),
        maybe("WARC-Target-URI", F.col("target_uri")), maybe("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), maybe("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")), maybe("X-Source-Payload-Digest", F.col("source_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")),
    )
    return records.select(F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).cast("binary").alias("record"))


def write_warc(records: DataFrame, path: str) -> int:
    """Gzipped WARC files under path, one a partition, each record a gzip member of its own; returns how many records.

    A file is written under its attempt's name and moved into place, so a lost executor's tasks may run again. An empty table writes no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(path)
        out, n = None, 0
        mine = f"{base}/.attempt-{task.taskAttemptId()}"
        for b in batches:
            for record in b.column(0):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(mine, buffer_size=1 << 20)
                out.write(gzip.compress(record.as_py(), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            store.move(mine, f"{base}/part-{task.partitionId():05d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    arrow_batches(records.sparkSession)
    return as_warc(records).mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _body(headers: dict[str, str], body: bytes) -> str:
    """The payload of an answer as text: chunks joined, content codings undone, decoded by its charset (UTF-8, if that is none or unknown)."""
    low = {k.lower(): v for k, v in headers.items()}
    if "chunked" in low.get("transfer-encoding", "").lower():
        joined, rest = [], body
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            n = int(size.split(b";")[0].strip() or b"0", 16)
            if not n:
                break
            joined.append(rest[:n])
            rest = rest[n + 2 :]
        body = b"".join(joined)
    coding = low.get("content-encoding", "").lower().strip()
    if coding in ("gzip", "x-gzip", "deflate"):
        body = zlib.decompressobj(47 if coding != "deflate" else 15).decompress(body)
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", low.get("content-type", ""), re.I)
    try:
        return body.decode(charset.group(1) if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a WARC stream; one that ends amid a record, or has no version line, is an error."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record begins here")
        head: dict[str, str] = {}
        name = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC record ends in its header")
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[:1] in " \t" and name:
                head[name] += " " + text.strip()
            else:
                name, _, value = (x.strip() for x in text.partition(":"))
                head[name := name.lower()] = value
        block = stream.read(size := int(head["content-length"]))
        if len(block) != size:
            raise ValueError("a WARC record ends in its block")
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzipped) under path as responses() gives them: key (the record's id), record_id, target_uri, date, headers of the answer, payload, payload_digest.

    Files are dealt out whole and read as streams, a record at a time. The digest is the record's own where it states one. Other records, and answers that
    aren't HTTP, give no rows. The path must be one that pyarrow opens.
    """
    arrow_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    files = files.repartition(max(1, files.count()), "path")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                with store.open_input_stream(name, compression=None) as raw:
                    for row in _answers(gzip.open(raw) if name.endswith(".gz") else io.BufferedReader(raw)):
                        yield pa.RecordBatch.from_pylist([row], schema=_ANSWER)

    return files.mapInArrow(each, "key string, record_id string, target_uri string, date string, headers map<string,string>, payload string, payload_digest string")


def _answers(stream: BinaryIO) -> Iterator[dict]:
    for head, block in records_of(stream):
        if head.get("warc-type") != "response" or not block.startswith(b"HTTP/"):
            continue
        top, _, body = block.partition(b"\r\n\r\n")
        pairs = [line.decode("utf-8", "replace").partition(":") for line in top.split(b"\r\n")[1:]]
        headers = {k.strip(): v.strip() for k, _, v in pairs if k.strip()}
        text = _body(headers, body)
        stated = head.get("warc-payload-digest") or "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        yield {"key": head["warc-record-id"], "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date", WARC_DATE), "headers": list(headers.items()), "payload": text, "payload_digest": stated}


_ANSWER = pa.schema([(n, pa.map_(pa.string(), pa.string()) if n == "headers" else pa.string()) for n in ("key", "record_id", "target_uri", "date", "headers", "payload", "payload_digest")])
