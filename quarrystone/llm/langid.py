"""Language identification by fusing text likelihoods, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, hold
from .urls import host_of
from .warc import LANG, attribute, plain_text

#: Texts of each language that the n-gram model is fitted on, about.
FIT_ROWS = 300
#: A text's likelihood counts as that of so many n-grams at most, as neighbouring n-grams aren't independent: which of these is fitted on
#: labelled texts that the model hasn't seen, by their mean log posterior. The second holds where there are none.
EVIDENCE, UNFITTED = (8, 15, 30, 60, 120, 240, 480), 60
#: Rows of the level above that smooth a host's, domain's or suffix's counts, and a declaration's.
SMOOTH = 4.0
#: Below this posterior, or without any letter, a document is rejected.
LEAST = 0.5

_SLOTS = 1 << 16
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 1 << 20


def grams(raw: bytes | None) -> Iterator[np.ndarray]:
    """Slots of the byte trigrams of a text's words, each word between spaces; long texts in overlapping parts."""
    words = (raw or b"").translate(_LETTERS).split()
    if not words:
        return
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    for k in range(0, len(data) - 2, _CHUNK):
        x = data[k : k + _CHUNK + 2]
        yield ((x[:-2] * 40503 + x[1:-1] * 10007 + x[2:] * 101) * np.uint32(2654435761)) >> np.uint32(16)


class Model:
    """Languages, the logarithm of each trigram slot's share in each, and how many n-grams a text counts for at most."""

    def __init__(self, langs: list[str], table: np.ndarray, evidence: int = UNFITTED):
        self.langs, self.table, self.evidence = langs, table, evidence


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of all languages in labelled, from a bounded sample of (text, lang).

    Counted are the different texts of a language whose hash lies below a line, set so that about `rows` of its texts do. A model of those in the lower half
    tells by the others how much evidence a text is, and is then completed by them. Only these texts move, and a row of counts for each language and task of
    the few that hold them comes to the driver. The table takes 256 kB for each language, on the driver and in each task.
    """
    spark = labelled.sparkSession
    labelled = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    every = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    langs, least, most = sorted(every), -(1 << 63), (1 << 63) - 1
    step = {x: (1 << 64) * rows // max(1, every[x]) for x in langs}
    line = spark.createDataFrame([(x, min(most, least + min(1 << 64, step[x]) // 2), min(most, least + step[x])) for x in langs], "lang string, line long, last long")
    sample = labelled.join(F.broadcast(line), "lang").where("h <= last").dropDuplicates(["lang", "h"])
    sample = hold(sample.select("lang", "text", (F.col("h") <= F.col("line")).alias("fits")).coalesce(4), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for g in grams(text.encode("utf-8", "replace")):
                    found[lang] = found.get(lang, 0) + np.bincount(g, minlength=_SLOTS)
        for lang, n in found.items():
            slots = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([slots.astype("<u2").tobytes()]), pa.array([n[slots].astype("<i4").tobytes()])], names=["lang", "slots", "n"])

    counts, place = np.full((_SLOTS, len(langs)), 0.5, np.float32), {x: k for k, x in enumerate(langs)}

    def added(part: DataFrame) -> np.ndarray:
        for r in part.select("lang", "text").mapInArrow(count, "lang string, slots binary, n binary").toLocalIterator():
            counts[np.frombuffer(r["slots"], "<u2"), place[r["lang"]]] += np.frombuffer(r["n"], "<i4")
        return np.log(counts) - np.log(counts.sum(0, dtype=np.float64)).astype(np.float32)

    model = Model(langs, added(sample.where("fits")))
    if langs:
        model.evidence = _evidence(sample.where("not fits").select("lang", "text"), model)
        model.table = added(sample.where("not fits"))
    return model


def _evidence(unseen: DataFrame, model: Model) -> int:
    """Of EVIDENCE, that under which labelled texts that the model hasn't seen are likeliest."""
    scored = likelihoods(unseen, model).where("grams > 0")
    at = F.array_position(F.array(*[F.lit(x) for x in model.langs]), F.col("lang")).cast("int") - 1

    def log_posterior(most: int) -> Column:
        ll = F.transform("ll", lambda x: x * F.least(F.col("grams"), F.lit(most)))
        norm = F.aggregate(ll, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(ll)))
        return F.get(ll, at) - F.array_max(ll) - F.ln(norm)

    found = scored.agg(*[F.round(F.avg(log_posterior(e)), 9) for e in EVIDENCE]).first()
    return UNFITTED if found[0] is None else max(zip(found, (-e for e in EVIDENCE), strict=True))[1] * -1


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """rows with text replaced by grams (how many) and ll (mean log-likelihood in each language), in one pass."""
    arrow_batches(rows.sparkSession)
    langs, table = model.langs, model.table
    named = [c for c in rows.columns if c != "text"]
    rows = rows.select(*named, "text")
    shared = rows.sparkSession.sparkContext.broadcast(table)  # 256 kB a language

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, lls = [], []
            texts = b.column(len(named))
            for raw in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist():
                many, ll = 0, np.zeros(len(langs))
                for g in grams(raw):
                    if len(g) > 4096:
                        ll += np.bincount(g, minlength=_SLOTS) @ shared.value
                    else:
                        ll += shared.value[g].sum(0)
                    many += len(g)
                n.append(many)
                lls.append((ll / max(1, many)).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(named)], pa.array(n, pa.int64()), pa.array(lls, pa.list_(pa.float64()))], names=[*named, "grams", "ll"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(each, f"{kinds}, grams long, ll array<double>")


def _shares(total: Column, counts: Column, above: Column) -> Column:
    """Counts smoothed by the level above."""
    return F.zip_with(counts, above, lambda c, p: (c + SMOOTH * p) / (total + SMOOTH))


def fuse(scored: DataFrame, langs: list[str], evidence: int = UNFITTED) -> DataFrame:
    """scored (grams, ll, declared, host, domain, suffix) with lang, posterior and accepted.

    The log of each language's posterior is the text's tempered log-likelihood, plus the log of how often
    that language's texts declare what this one declares, plus the log of its host's prior. Declarations and priors are
    counted by the language that the text alone suggests; hosts are smoothed by their domain, domains by their suffix, suffixes
    by all. Counting is summed before each shuffle, so a hot host does no harm.
    """
    n = len(langs)
    guess = F.when((F.col("grams") > 0) & F.lit(n > 0), F.array_position("ll", F.array_max("ll")).cast("int") - 1)
    scored = hold(scored.withColumn("guess", guess), "likelihoods")
    known = scored.where("guess is not null")
    keys = ["host", "domain", "suffix"]
    tally = hold(known.groupBy(*keys, "guess").agg(F.count("*").cast("double").alias("n")), "hosts")

    def summed(by: list[str], name: str) -> DataFrame:
        each = tally.groupBy(*by, "guess").agg(F.sum("n").alias("n")).groupBy(*by)
        rows = each.agg(F.sum("n").alias(f"{name}_n"), F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("m"))
        places = F.sequence(F.lit(0), F.lit(max(1, n) - 1))
        return rows.withColumn(f"{name}_c", F.transform(places, lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))).drop("m")

    hosts, domains, ends = summed(keys, "host"), summed(keys[1:], "domain"), summed(keys[2:], "suffix")
    everything = {r["guess"]: r["n"] for r in tally.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
    total = sum(everything.values())
    overall = F.array(*[F.lit((everything.get(k, 0.0) + 1) / (total + n)) for k in range(n)] or [F.lit(1.0)])
    priors = hosts.join(domains, ["domain", "suffix"]).join(ends, "suffix")
    by_suffix = _shares(F.col("suffix_n"), F.col("suffix_c"), overall)
    by_domain = _shares(F.col("domain_n"), F.col("domain_c"), by_suffix)
    priors = hold(priors.select("host", "domain", "suffix", _shares(F.col("host_n"), F.col("host_c"), by_domain).alias("prior")), "priors")
    said = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in langs] or [F.lit("")]), F.col("declared")).cast("int"), F.lit(-1))  # 0: another language
    scored = scored.withColumn("said", said)
    pairs = scored.where("guess is not null and said >= 0").groupBy("guess", "said").count().collect()  # a row for two languages that meet
    seen = np.zeros((max(1, n), n + 1))
    for r in pairs:
        seen[r["guess"], r["said"]] = r["count"]
    seen = np.log((seen + SMOOTH / (n + 1)) / (seen.sum(1, keepdims=True) + SMOOTH))
    declares = scored.sparkSession.createDataFrame([(k, seen[:, k].tolist()) for k in range(n + 1)], "said int, declares array<double>")
    rows = scored.join(priors, keys, "left").join(F.broadcast(declares), "said", "left")
    prior = F.transform(F.coalesce("prior", overall), lambda p: F.ln(p))
    declared = F.coalesce("declares", F.array_repeat(F.lit(0.0), max(1, n)))
    text = F.transform("ll", lambda x: x * F.least(F.col("grams"), F.lit(evidence)))
    log = F.zip_with(F.zip_with(text, declared, lambda a, b: a + b), prior, lambda a, b: a + b)
    rows = rows.withColumn("log", log).withColumn("top", F.array_max("log"))
    norm = F.aggregate("log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    named = F.element_at(F.array(*[F.lit(x) for x in langs] or [F.lit("")]), F.array_position("log", F.col("top")).cast("int"))
    posterior = F.when(F.col("guess").isNotNull(), 1 / norm).otherwise(F.lit(0.0))
    rows = rows.withColumn("posterior", posterior).withColumn("accepted", posterior >= LEAST)
    return rows.withColumn("lang", F.when(F.col("guess").isNotNull(), named).otherwise("und")).drop("ll", "guess", "said", "prior", "declares", "log", "top")


def _host_parts(host: Column) -> dict[str, Column]:
    parts = F.split(host, r"\.")
    dotted = F.size(parts) > 1
    return {"domain": F.when(dotted, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(""), "suffix": F.when(dotted, F.element_at(parts, -1)).otherwise("")}


def evidence_of_documents(docs: DataFrame) -> DataFrame:
    """Documents as evidence: their source is the host, their lang what they declare, which may be wrong; they have no address."""
    host = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), host.alias("host")).withColumns({"domain": F.lit(""), "suffix": F.lit("")})


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """Pages as evidence: their visible text, the language of their markup, and their host with its domain and suffix."""
    declared = F.lower(F.regexp_extract(attribute(F.col("html"), LANG), "^[A-Za-z]+", 0))
    rows = pages.select("page_id", plain_text(F.col("html")).alias("text"), F.when(declared != "", declared).alias("declared"), host_of(F.col("url")).alias("host"))
    return rows.withColumns(_host_parts(F.col("host")))


def identify(evidence: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row for each row of evidence: its columns without the text, and lang, posterior, accepted.

    labelled (text, lang) trains the text model on a bounded sample. A null or empty text, or one without letters, is "und" with
    posterior 0 and rejected; null declarations and hosts say nothing; repeated rows count each for themselves. An empty
    table gives no rows; with no labelled text all rows are rejected.
    """
    model = fit(labelled, fit_rows)
    scored = likelihoods(evidence, model)
    return fuse(scored if model.langs else scored.withColumn("grams", F.lit(0).cast("long")), model.langs, model.evidence)


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is known, whole and unchanged.

    Null and empty texts, and those without letters, go; a null or repeated doc_id is told from others by its text, and rows alike in both are
    judged apart only by what they declare: all go if one does. An empty table stays empty.
    """
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    rows = evidence_of_documents(docs).withColumn("__text_key", F.xxhash64("text"))
    out = identify(rows, docs.select("text", "lang")).where(~F.col("accepted")).select(F.col("doc_id").alias("__bad_id"), F.col("__text_key").alias("__bad_key")).distinct()
    gone = keyed["doc_id"].eqNullSafe(F.col("__bad_id")) & (keyed["__text_key"] == F.col("__bad_key"))
    return keyed.join(out, gone, "left_anti").select(*docs.columns)
