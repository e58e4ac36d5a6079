"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, fmindex, langid, mixture, negatives, records, simhash, surrogates, unigram, urls, voronoi, warc
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_pareto_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"), preference=mixture.by_length(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken", "inclusion")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    evidence = langid.evidence_of_documents(docs).unionByName(langid.evidence_of_pages(table(spark, sf_dir, "pages")), allowMissingColumns=True)
    return langid.identify(evidence, docs.select("text", "lang"))


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fmindex.digest(fmindex.mark(docs, table(spark, sf_dir, "benchmark"), keep_text=False))


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, keep_text=False)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return voronoi.top_k(rows, rows.where(F.col("vec_id") % 100 == 0))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(encoded, BYTES, public_tokenizers.PATTERN))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pareto_mixture, op2_url_filter, op3_pii_surrogates, op4_language_fusion, op5_fm_decontamination, op6_unigram_counts, op7_token_records, op8_simhash_near_dedup, op9_voronoi_knn, op10_warc_derivatives, op11_fill_in_middle, op12_byte_bpe, op13_hard_negatives)
    return {f.__name__: f for f in every}


_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
with base as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size from documents),
sums as (select source, sum(size)::bigint as source_size from base group by source),
placed as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
  2.0::double * source_size as cap from sums),
filling as (select *, row_number() over f as nth,
  (1.5::double * (sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0::double))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from placed window f as (order by cap / weight, source nulls last)),
line as (select level from filling where cap > level * weight order by nth limit 1),
goals as (select f.source, f.source_size, least(f.cap, coalesce((select level from line) * f.weight, f.cap)) as target from filling f),
banded as (select *, pow(2.0::double, (length(bin(size)) // 2)::double) as liking from base),
cells as (select source, liking, sum(size)::bigint as words from banded group by source, liking),
stops as (select c.*, g.source_size, g.target, (g.target - 2.0::double * coalesce(sum(words) over (partition by c.source order by liking desc rows between unbounded preceding and 1 preceding), 0)::double)
    / nullif(sum(words * liking) over (partition by c.source order by liking rows between unbounded preceding and current row), 0) as level
  from cells c join goals g on c.source is not distinct from g.source),
settled as (select *, first_value(case when level * liking <= 2 then level end ignore nulls) over (partition by source order by liking desc rows between unbounded preceding and unbounded following) as line from stops),
parts as (select source, liking, source_size, target, words, greatest(least(coalesce(line * liking, 2.0::double), 2.0::double), 0::double) as rate from settled),
odds as (select *, floor(rate + 1e-12)::bigint as certain, greatest(rate - floor(rate + 1e-12), 0::double) as inclusion from parts),
lacks as (select source, any_value(target) - sum(certain * words)::double as lack from odds group by source),
ranked as (select b.*, p.source_size, p.target, p.certain, p.inclusion, l.lack,
  (('0x' || substr(md5('20:' || b.doc_id::varchar), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double as u
  from banded b join odds p on b.source is not distinct from p.source and b.liking = p.liking join lacks l on b.source is not distinct from l.source),
drawn as (select *, coalesce(sum(size) over (partition by source order by (u / (1 - u)) / (inclusion / (1 - inclusion)), doc_id rows between unbounded preceding and 1 preceding), 0) as before
  from ranked where inclusion > 0),
picked as (select doc_id, size, source_size, target, inclusion, (certain + case when before + size / 2.0::double <= lack then 1 else 0 end) * size as taken from drawn
  union all select doc_id, size, source_size, target, inclusion, certain * size from ranked where not inclusion > 0)
select doc_id, size, source_size, target, taken::bigint as taken, inclusion from picked
"""

_OP5 = r"""
with folded as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null and item_id is not null),
wins as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from items where len(w) > 0)),
sizes as (select distinct n from wins),
places as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from folded, sizes where len(w) >= n),
grams as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as g from places),
found as (select g.doc_id, g.k, g.n, i.item_id from grams g join wins i on g.n = i.n and g.g = i.g),
hits as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(k, k + n)) as p from found) group by doc_id),
named as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from found) group by doc_id)
select f.doc_id, len(f.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from folded f left join hits h on f.doc_id = h.doc_id left join named n on f.doc_id = n.doc_id
"""

_OP9 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 10
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_entities() -> str:
    """All named entities as a map, a no-break space as a space. The rule that reads the beginning of an unknown name without a semicolon has no place here."""
    pairs = [(name, " " if sign == "\xa0" else sign) for name, sign in html5.items()]
    return f"map([{', '.join(_quoted('&' + k) for k, _ in pairs)}], [{', '.join(_quoted(v) for _, v in pairs)}])"


def _sql_resolved(text: str) -> str:
    number = "try_cast(case when lower(x[3]) = 'x' then '0x' || regexp_extract(x, '[0-9A-Fa-f]+', 0) else regexp_extract(x, '[0-9]+', 0) end as int)".replace("regexp_extract(x, '[0-9A-Fa-f]+'", "regexp_extract(x[4:], '[0-9A-Fa-f]+'")
    sign = f"case when x[1] <> '&' then x when x[2] = '#' then case when {number} = 160 then ' ' else coalesce(chr({number}), x) end else coalesce(ents[x], x) end"
    return f"array_to_string(list_transform(regexp_extract_all({text}, '&#[xX][0-9A-Fa-f]+;?|&#[0-9]+;?|&[0-9A-Za-z]+;?|[^&]+|&'), lambda x: {sign}), '')"


def _sql_joined(text: str) -> str:
    text = rf"regexp_replace(regexp_replace({text}, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_bare(html: str) -> str:
    text = f"regexp_replace({html}, '{warc.HIDDEN}', ' ', 'g')"
    return f"regexp_replace(regexp_replace({text}, '{warc.BREAKS}', chr(10), 'g'), '{warc.TAG}', ' ', 'g')"


def _sql_text(html: str) -> str:
    """plain_text() as SQL."""
    return _sql_joined(_sql_resolved(_sql_bare(html)))


def _sql_value(text: str, pattern: str) -> str:
    return " || ".join(f"regexp_extract({text}, '{pattern}', {k})" for k in (1, 2, 3))


def _sql_urn(*parts: str) -> str:
    h = f"md5(concat_ws(chr(10), {', '.join(parts)}))"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {k}, {n})" for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_VALUE = warc.VALUE.replace("'", "''")
_ANCHOR = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{_VALUE}[^>]*>(.*?)</a\s*>"
_LANG = warc.LANG.replace("'", "''")

_OP10 = rf"""
with ents as (select {_sql_entities()} as ents),
answers as (select page_id, {_sql_urn("'response'", "coalesce(page_id::varchar, '')", "coalesce(url, '')", "sha256(coalesce(html, ''))")} as refers_to, url as target_uri, coalesce(html, '') as h,
  regexp_replace(coalesce(html, ''), '{warc.HIDDEN}', ' ', 'g') as shown, 'sha256:' || sha256(coalesce(html, '')) as source_digest, ents from pages, ents),
found as (select *, regexp_extract_all(shown, '{_ANCHOR}', 0) as anchors from answers),
blocks as (select page_id, 'conversion' as type, 'text/plain; charset=utf-8' as content_type, refers_to, target_uri, source_digest, {_sql_text("h")} as block from found
  union all select page_id, 'metadata', 'application/json', refers_to, target_uri, source_digest, json_object('envelope', json_object('refers_to', refers_to, 'target_uri', target_uri, 'payload_digest', source_digest),
    'headers', json_object('Content-Type', 'text/html; charset=utf-8', 'Content-Length', strlen(h)::varchar), 'title', {_sql_text("regexp_extract(shown, '(?is)<title[^>]*>(.*?)</title>', 1)")},
    'lang', {_sql_value("shown", _LANG)}, 'links', to_json(list_transform(anchors, lambda m: {_sql_resolved("(" + _sql_value("m", _ANCHOR) + ")")})),
    'link_texts', to_json(list_transform(anchors, lambda m: {_sql_text(f"regexp_extract(m, '{_ANCHOR}', 4)")})))::varchar from found)
select page_id, type, {_sql_urn("type", "refers_to")} as record_id, refers_to, target_uri, '{warc.WARC_DATE}' as date, source_digest, content_type, 'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block from blocks
"""


_OP11 = """
with cut as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as w, sha256('1:' || doc_id::varchar) as s from documents),
drawn as (select *, len(w)::bigint as n, ('0x' || substr(s, 1, 8))::bigint as h1, ('0x' || substr(s, 9, 8))::bigint as h2, ('0x' || substr(s, 17, 8))::bigint as h3, ('0x' || substr(s, 25, 8))::bigint as h4 from cut),
formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, array_to_string(w[1:a], '') as p, array_to_string(w[a + 1:b], '') as m, array_to_string(w[b + 1:], '') as x from formed)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from parts
"""


_OP13 = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double))::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
ranked as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from pairs where same),
found as (select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
  row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) as rank
  from ranked p join pairs n on p.place <= 5 and not n.same and p.anchor_id = n.anchor_id and 100 * n.score between 30 * p.score and 90 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from found where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_hard_negatives": _OP13, "op11_fill_in_middle": _OP11, "op1_pareto_mixture": _OP1, "op5_fm_decontamination": _OP5, "op9_voronoi_knn": _OP9, "op10_warc_derivatives": _OP10}
