"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrystone.llm import fmindex, graph, langid, mixture, queries, records, simhash, surrogates, unigram, urls, voronoi, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, spans int, mix_turn int, pii_key int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, 7, 7, 7) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "Gamma", "délta", "x1", "of", "the", "Ωmega", "tail,", "end."]
    prose = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 4, 5, 9, 10, 11, 40, 40, 300)]
    return [*prose, prose[8], prose[9] + " more", "", None, "   \t\n", "word " * 20000]


# ---- 8


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _components(prints):
    label = dict(enumerate(range(len(prints))))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if bin(prints[a] ^ prints[b]).count("1") <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates(spark, texts):
    rows = [(100 - k, t, "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(_docs(spark, [*rows, rows[0]])).collect()}
    prints = [_fingerprint(t) for _, t, _ in rows]
    label = _components(prints)
    for k, (i, _, _) in enumerate(rows):
        assert got[i]["fingerprint"] == f"{prints[k]:016x}"
        assert got[i]["component_id"] == min(rows[j][0] for j in label if label[j] == label[k])
    kept = simhash.keep_one(_docs(spark, [*rows, rows[0], (None, "alone here", "s")])).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({r["component_id"] for r in got.values()})
    assert sum(r["doc_id"] is None for r in kept) == 1 and {r["fp"] for r in kept} == {7}
    assert simhash.near_duplicates(_docs(spark, [])).count() == 0


def test_one_stays_of_each_group_whatever_the_ids(spark):
    rng = np.random.default_rng(8)
    own = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(8)]
    rows = [(None, t, "s") for t in own[:5]] + [(7, own[5], "s"), (7, own[6], "s"), (9, own[7], "s"), (9, own[7], "s"), (None, own[7], "s"), (3, own[7], "s")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(_docs(spark, rows)).collect()]
    want = [(None, t) for t in own[:5]] + [(7, own[5]), (7, own[6]), (3, own[7])]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_tiles_link_what_all_pairs_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    x = np.unique(np.concatenate([base, near]))
    x = x[np.lexsort([x, np.bitwise_count(x)])]
    a, b = x[:250], x[250:]
    found = [simhash.compare_tiles(*p, block=32) for p in ((a, None), (b, None), (a, b))]
    forest, place = simhash.Forest(len(x)), {v: k for k, v in enumerate(x.tolist())}
    for u, v in found:
        forest.join(np.array([place[k] for k in u.tolist()], np.int64), np.array([place[k] for k in v.tolist()], np.int64))
    i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4)
    whole = simhash.Forest(len(x))
    whole.join(i, j)
    assert (forest.up == whole.up).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)] + [(200, k) for k in range(201, 260)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100) | dict.fromkeys(range(200, 260), 200)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 5


def _marks(texts, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    for t in texts:
        words, hit, named = fold(t), set(), set()
        for i, item in items:
            w = fold(item)
            n = min(10, len(w))
            for k in range(len(w) - n + 1 if w else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[k : k + n]:
                        hit |= set(range(p, p + n))
                        named.add(i)
        yield len(words), len(hit), sorted(map(str, named))


@pytest.mark.parametrize("block_bytes", [fmindex.BLOCK_BYTES, 40])
def test_decontamination(spark, block_bytes):
    item = "One two three four five six seven eight nine ten eleven Zwölf"
    items = [(7, item), (12, "short item"), (30, ""), (31, None), (None, "nothing here"), (5, "one two three four five six seven eight nine ten"), (7, item)]
    texts = [item, f"x {item.upper().replace('WÖLF', 'wölf')}, y", "a short-item; SHORT item", "one two three four five six seven eight nine", None, "", f"{item} {item} " * 3, "short " * 5000 + "item", "Item short"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = _docs(spark, [(k, t, "s") for k, t in enumerate(texts)]).drop("spans").withColumn("Items", F.lit(1))
    got = {r["doc_id"]: r for r in fmindex.digest(fmindex.mark(docs, bench, block_bytes=block_bytes, keep_text=False)).collect()}
    for k, (n, hit, named) in enumerate(_marks(texts, [x for x in items if x[0] and x[1]])):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(named), hit > 0), texts[k]
        assert r["items_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
    both = _docs(spark, [(k, t, "s") for k, t in enumerate(texts)])
    assert {(r["spans"], r["fp"]) for r in fmindex.clean(both, bench).collect()} == {(7, 7)}
    assert {r["doc_id"] for r in fmindex.clean(docs, bench).collect()} == {k for k, (_, hit, _) in enumerate(_marks(texts, [x for x in items if x[0] and x[1]])) if not hit}
    assert fmindex.mark(_docs(spark, []).drop("spans"), bench).count() == 0
    empty = fmindex.digest(fmindex.mark(docs, bench.limit(0))).collect()
    assert not any(r["contaminated"] for r in empty) and len(empty) == len(texts)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 4, 3000), 0)
    index = fmindex.FMIndex(text, 4)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        want = [k for k in range(len(text) - 2) if (text[k : k + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_items_may_have_any_ids_and_scrubbing_removes_their_windows(spark):
    items = [("q/1", "one two three four five six seven eight nine ten eleven"), ("q/1", "short item"), (None, "x"), ("ü,2", "ten eleven"), ("e", None)]
    texts = ["Say: one two three four five six seven eight nine ten eleven, twelve", "a short-item here", None, "", "clean"]
    docs, bench = _docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), spark.createDataFrame(items, "item_id string, text string")
    marked = {r["doc_id"]: r["items"] for r in fmindex.mark(docs.drop("spans"), bench).collect()}
    assert marked == {0: ["q/1", "ü,2"], 1: ["q/1"], 2: [], 3: [], 4: []}
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["spans"]) for r in fmindex.scrub(docs, bench).collect()}
    assert got == {0: ("Say: , twelve", 11, 7), 1: ("a  here", 2, 7), 2: (None, 0, 7), 3: ("", 0, 7), 4: ("clean", 0, 7)}
    assert fmindex.scrub(docs.limit(0), bench).count() == 0


def test_windows_take_memory_in_proportion_to_the_items():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = [b"w%d" % k for k in range(5000)]
    items = [(str(k), b" ".join(words[j] for j in rng.integers(0, 5000, 400))) for k in range(500)]
    tracemalloc.start()
    phrases = fmindex.Phrases(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    size = sum(len(t) for _, t in items)
    assert held < 20 * size and peak < 60 * size and len(phrases.by_length[0][1]) == 500 * 391


def test_cut_removes_spans():
    assert fmindex.cut("Keep this, DROP that now. Ünd keep", [(2, 5)]) == "Keep this, . Ünd keep"


# ---- 7


def test_records_round_trip(spark, texts, tmp_path):
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(3, "twice", "s"), (None, "no id", "s"), (50, "it's <|endoftext|> (done)!! 3D, É,´ x.'s don't ÀB…", "s")]
    shards = records.write_records(_docs(spark, rows), f"file://{tmp_path}/r", queries.TOKENIZER)
    got = records.read_records(spark, f"file://{tmp_path}/r", shards).collect()
    plain = Tokenizer.from_file(queries.TOKENIZER)
    got = sorted(map(tuple, got), key=lambda r: r[1])
    want, start = [], 0
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((i, n, c) for i, _, n, c in got), key=str) == sorted(want, key=str)
    assert [i for i, *_ in got] == sorted((i for i, *_ in got), key=lambda i: (i is not None, i or 0))
    for _, at, n, _ in got:
        assert at == start
        start += n
    again = list(records.shuffled(f"{tmp_path}/r", 4))
    assert len(again) == len(rows) and sum(len(ids) for _, ids in again) == start
    assert [i for i, _ in again] != [g[0] for g in got]
    assert json.loads((tmp_path / "r/manifest.json").read_text())["tokens"] == start
    assert records.encode_and_read(_docs(spark, []), queries.TOKENIZER).count() == 0


def test_a_damaged_record_is_told(spark, tmp_path):
    shards = records.write_records(_docs(spark, [(1, "some text", "s")]), str(tmp_path / "r"), queries.TOKENIZER)
    path = next((tmp_path / "r").glob("*.rec"))
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, str(tmp_path / "r"), shards).collect()
    assert records.unmasked(records.masked(b"abc")) == zlib.crc32(b"abc")


def test_texts_of_any_letters_are_encoded_as_the_library_does():
    rng = np.random.default_rng(7)
    every = np.array([x for x in range(0x110000) if not 0xD800 <= x < 0xE000])
    near = np.array([ord(x) for x in "'.,!?;:-()<|> \t\ns tdrevmlHWTYJKAE12\u0301\u0307\u0308\u030c\u030a\u0331\u0130\u03a3\u03c2\u095e\u09dd\u0a5a\u0f57\x85\xa0\x1c\u2003"])
    one = lambda n: "".join(map(chr, np.where(rng.random(n) < 0.3, rng.choice(every, n), rng.choice(near, n)).tolist()))
    texts = [one(int(n)) for n in rng.integers(1, 40, 20000)] + ["Merhaba \u0130. d\u00fcnya", "\u095e! H\u0331e", "<|endoftext|>it's <|ENDOFTEXT|>'S", "x" * 5000 + " \u4e2d" * 3, "\u4e2d" * 3000]
    plain = Tokenizer.from_file(queries.TOKENIZER)
    got = records.Coder(queries.TOKENIZER).encode([t.encode() for t in texts])
    for t, ids, want in zip(texts, got, plain.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == want.ids, ascii(t)


def test_files_of_other_rules_get_whole_texts(tmp_path):
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), ["The Cat, it's HERE  now\n\n x", "", None, "e\u0301 <|endoftext|>a b", "x" * 3000 + " y"]
    file = json.loads(open(queries.TOKENIZER, encoding="utf-8").read())
    cased = tmp_path / "cased.json"
    cased.write_text(json.dumps(file | {"normalizer": {"type": "NFC"}}), encoding="utf-8")
    spaced = tmp_path / "spaced.json"
    spaced.write_text(json.dumps(file | {"added_tokens": [*file["added_tokens"], {**file["added_tokens"][0], "content": "<|a b|>", "id": 49408}]}), encoding="utf-8")
    assert records.splits_at_spaces(queries.TOKENIZER) and not any(map(records.splits_at_spaces, (path, str(cased), str(spaced))))
    for other in (path, str(cased), str(spaced)):
        code, plain = records.Coder(other), Tokenizer.from_file(other)
        for t, ids in zip(texts, code.encode([t and t.encode() for t in texts]), strict=True):
            assert np.frombuffer(ids, code.kind).tolist() == plain.encode(t or "", add_special_tokens=False).ids, (other, t)


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(records, "REMEMBERED", 500)
    monkeypatch.setattr(records, "LONG", 6)
    c, plain = records.Coder(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    for t in ("a b c d", "e f g h i j k a b", "A, b. c! d?", "l m n a", "longest-word a b", "a verylongword, b"):
        assert np.frombuffer(c.encode([t.encode()])[0], c.kind).tolist() == plain.encode(t, add_special_tokens=False).ids


# ---- 9


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[5][1]) for k in range(40)] + [(500, None), (501, [None] * 6), (502, [float("nan")] * 6), (503, [float("inf")] * 6), (504, [1.0, 2.0]), (None, rows[1][1]), (600, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = voronoi.top_k(df, df.where("vec_id % 100 = 0"), pivots=20).collect()
    good = [(i, np.floor(1024 * np.pad(np.array(v, np.float64), (0, 6 - len(v)))).astype(np.int64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = set()
    for q, x in good:
        if q % 100 == 0:
            best = sorted(((-int(x @ y), i) for i, y in good if i != q))[:10]
            want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert voronoi.top_k(df.limit(0), df.limit(0)).count() == 0
    twice = df.where("vec_id < 30").unionByName(df.where("vec_id = 0")).unionByName(df.where("vec_id = 0"))
    assert sorted(r["vec_id"] for r in voronoi.top_k(twice, twice.where("vec_id = 0"), k=29).collect()) == list(range(1, 30))
    small = pytest.MonkeyPatch()
    small.setattr(voronoi, "PACK", 16)
    small.setattr(voronoi, "AT_ONCE", 2)
    small.setattr(voronoi, "QUERY_GROUP", 2)
    assert {tuple(r) for r in voronoi.top_k(df, df.where("vec_id % 100 = 0"), pivots=20).collect()} == want
    small.undo()
    few = df.where("vec_id < 3")
    assert voronoi.top_k(few, few.where("vec_id = 0")).count() == 2


# ---- 1


def test_mixture(spark, texts):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(["w"] * int(n)), s) for k, (n, s) in enumerate(zip(rng.integers(0, 60, 400), rng.choice(["a", "b", "c", "d", None, "e"], 400, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]), strict=True))]
    got = mixture.mix(_docs(spark, rows)).collect()
    assert len(got) == 400 and got and {tuple(r) for r in mixture.mix(_docs(spark, rows[::-1])).collect()} == {tuple(r) for r in got}
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    names = sorted(s for s in size if s) + [None]
    weight, full, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, {}, 1.5 * sum(size.values())
    while True:  # targets that stop pass the excess on
        rest = [s for s in names if s not in full]
        share = {s: (left - sum(full.values())) * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * size[s]]
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
    want = full | share
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2 + 1e-9
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)
    assert {(r["mix_turn"], r["size"]) for r in mixture.mixed(_docs(spark, rows)).select("mix_turn", "size").collect()} == {(7, 7)}
    out = mixture.mixed(_docs(spark, rows)).groupBy("doc_id").count().collect()
    copies = {r["doc_id"]: r["copies"] for r in got if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in out} == copies
    for odd in ([], [(1, None, "a")], [(1, "", None), (1, "", None)]):
        assert [r["taken"] for r in mixture.mix(_docs(spark, odd)).collect()] == [0] * len(odd)


def test_preferences_make_inclusion_unequal(spark):
    rows = [(k, "w " * (5 + k % 7), "ab"[k % 2]) for k in range(3000)]
    got = mixture.mix(_docs(spark, rows), weights=(1.0, 1.0), share=0.3, preference=F.when(F.col("doc_id") % 3 == 0, 3.0).otherwise(1.0)).collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 6
        much, less = (np.mean([r["copies"] > 0 for r in mine if (r["doc_id"] % 3 == 0) == m]) for m in (True, False))
        assert much == pytest.approx(3 * less, rel=0.25)
        assert len({round(r["inclusion"], 9) for r in mine}) == 2


def test_documents_are_included_as_often_as_their_inclusion_says(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "w " * int(n), "ab"[k % 2]) for k, n in enumerate(rng.choice([1, 3, 6, 20, 70, 300], 12000))]
    docs = _docs(spark, rows)
    got = mixture.mix(docs, weights=(1.0, 1.0), share=0.4, preference=mixture.by_length(F.col("text"))).toPandas()
    assert (got.groupby("source").taken.sum() - got.groupby("source").target.first()).abs().max() <= 150
    cells = got.groupby(["source", "size"]).agg(rows=("size", "count"), inclusion=("inclusion", "first"), spread=("inclusion", "nunique"), copies=("copies", "mean"))
    assert len(set(cells.inclusion.round(9))) >= 6 and (cells.spread == 1).all()
    whole = np.floor(cells.copies + 1e-9).clip(upper=1) * (cells.inclusion == 0)
    error = np.sqrt(cells.inclusion * (1 - cells.inclusion) / cells.rows)
    assert ((cells.copies - whole - cells.inclusion).abs() <= 5 * error + 0.02).all()  # the fixed size adds a little
    for s, part in got.groupby("source"):  # and expected words come to the target
        expected = ((part.inclusion + (part.copies - part.inclusion).round().where(part.inclusion == 0, 0)) * part["size"]).sum()
        assert expected == pytest.approx(part.target.iloc[0], rel=1e-6), s


def test_repeated_rows_are_taken_as_often_as_the_mix_takes_them(spark):
    same = [(1, "w " * 10, "a")] * 7
    for rows in (same, same + [(2, "w " * 10, "a")] * 4, [(None, "w " * 3, "a")] * 5 + [(None, "x " * 3, "a")] * 5 + same):
        docs = _docs(spark, rows).withColumn("lang", F.concat("lang", (F.rand(3) * 3).cast("int").cast("string")))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        want = {(r["doc_id"], r["content"]): r["n"] for r in mixture.mix(docs).groupBy("doc_id", "content").agg(F.sum("copies").alias("n")).collect()}
        out = mixture.mixed(docs)
        got = {(r["doc_id"], r["content"]): r["n"] for r in out.groupBy("doc_id", F.xxhash64("text").alias("content")).agg(F.count("*").alias("n")).collect()}
        assert got == want and out.schema == docs.schema
        often, before = ({tuple(r)[:-1]: r["count"] for r in d.groupBy("doc_id", "text", "lang").count().collect()} for d in (out, docs))
        assert all(often.get(k, 0) <= 2 * n for k, n in before.items()) and set(often) <= set(before)


# ---- 2


def test_url_rules(spark):
    rows = ["http://x.com/en/7", "https://EXAMPLE.com/en/71", "http://a.example.net/de/8", "http://b.net/de/8", "ftp://org/es/", "http://org.evil/es/1", "http://notexample.com/en/7?a", None, "no scheme/en/", "http://h?q/en/", "http://ülk.ORG/es/#x", "a://b://c.com/en/"]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("score", F.lit("x"))).collect()}
    for k, u in enumerate(rows):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(r), v, r) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, max(fit)[2] if fit else None), u
        if fit:
            assert got[k]["verdict"] == max(fit)[1]
        assert got[k]["verdict"] in ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_trees_hold_out(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = [(f"http://{word()}-{word()}{rng.integers(10, 99)}.example.org/{word()}?a=1&b=2", 1) if k % 4 == 0 else (f"https://{word()}.example.com/{word()}/{word()}", 0) for k in range(800)]
    labelled = spark.createDataFrame(rows[:400], "url string, label int")
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows[400:])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labelled, rules=()).collect()}
    assert np.mean([got[k] == ("block" if y else "allow") for k, (_, y) in enumerate(rows[400:])]) > 0.97


def test_rates_by_brute_force_leave_out_the_own_fold(spark, monkeypatch):
    rows = [(f"http://{h}/{k}", int(h.startswith("b"))) for k, h in enumerate(["a.x.com", "b.x.com", "b.y.com", "c.y.org", "b.y.org", "x", "a.x.com", "b.x.com"] * 3)]
    known = spark.createDataFrame(rows, "url string, label int").withColumn("host", urls.host_of(F.col("url")))
    known = known.withColumn("suffixes", urls.suffixes("host")).withColumn("fold", urls._fold("host"))
    held = [r.asDict() for r in known.collect()]
    means = [0.1, 0.2, 0.3, 0.4, 0.5]
    want = {}
    for r in held:
        for k, s in enumerate(r["suffixes"]):
            other = [q["label"] for q in held if q["fold"] != r["fold"] and q["suffixes"][k] == s]
            want[r["url"], k] = (sum(other) + urls.SMOOTH * means[r["fold"]]) / (len(other) + urls.SMOOTH)
    for rows_at_most in (urls.BROADCAST_ROWS, 0):
        monkeypatch.setattr(urls, "BROADCAST_ROWS", rows_at_most)
        got = urls._with_rates(known, urls._rates(known), {0: 9, 1: 9, 2: 9}, means).collect()
        assert len(got) == len(held)
        for r in got:
            assert [r[f"rate{k}"] for k in range(3)] == pytest.approx([want[r["url"], k] for k in range(3)])


def test_no_label_of_a_url_s_own_host_has_a_say(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 30}.example.com/{k}") for k in range(300)], "page_id long, url string")
    label = lambda of: pages.select("url", of.cast("int").alias("label"))
    bad = F.regexp_extract("url", r"h(\d+)", 1).cast("int") % 3 == 0
    got, turned = ({r["page_id"]: r["score"] for r in urls.judge(pages, label(x), rules=()).collect()} for x in (bad, F.when(F.col("url").contains("//h7."), ~bad).otherwise(bad)))
    assert all(got[k] == turned[k] for k in range(7, 300, 30)) and got != turned
    long = spark.createDataFrame([(1, "http://a.b/" + "x" * 300_000), (2, "http://" + "y." * 2000 + "c/"), (3, "")], "page_id long, url string")
    assert {r["verdict"] for r in urls.judge(long).collect()} == {"allow"}


def test_entropy_and_counts_of_a_url():
    got = dict(zip(urls.FEATURES, urls.lexical("http://a-1.b.org/x/yy?q=1&r=2#f", "a-1.b.org"), strict=True))
    text = "http://a-1.b.org/x/yy?q=1&r=2#f"
    entropy = -sum(text.count(c) / len(text) * np.log2(text.count(c) / len(text)) for c in set(text))
    assert got == pytest.approx({"length": len(text), "host_length": 9, "path_length": 5, "depth": 2, "labels": 3, "digits": 3 / len(text), "host_digits": 1 / 9, "hyphens": 1, "entropy": entropy, "host_entropy": got["host_entropy"], "parameters": 2, "longest_label": 3})


# ---- 3


def test_surrogates(spark):
    key = "k"
    texts = [
        "Mail ann.b@mail1.example.com or ANN.B@MAIL1.EXAMPLE.COM, not bob@mail1.example.com.", "Call +1 (017) 555-7713; again +1 017 555 7713!", "Card 4845168114407329 but not 4845168114407320 nor 9807915762804490.",
        "Host 97.51.17.173, not 1.2.3.4.5 or 999.1.1.1", "Mr. John Smith met Mrs Smith and Frau Özil. MR. JOHN SMITH", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "Господин Иванов", "nothing here 12", None, "", "ann.b@mail1.example.com " * 3000]
    docs = _docs(spark, [(k, t, "s") for k, t in enumerate(texts)] + [(0, texts[0], "s")]).withColumn("n_replaced", F.lit("x"))
    rows = surrogates.replace(docs, key).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(texts) + 1 and set(rows[0].asDict()) == set(docs.columns)
    a, b, c = re.findall(r"[\w.]+@[\w.]+\w", got[0])
    assert a.upper() == b and a != c and a.split("@")[1] == c.split("@")[1] and "mail1" not in got[0] and a.endswith(".example")
    p, q = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]).group(), re.search(r"\+1 \d{3} \d{3} \d{4}", got[1]).group()
    assert re.sub(r"\D", "", p) == re.sub(r"\D", "", q) != "10175557713"
    card = re.match(r"Card (\d{16}) but not 4845168114407320 nor 9807915762804490\.", got[2]).group(1)
    assert card[0] == "4" and card != "4845168114407329" and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(card))) % 10 == 0
    assert re.match(r"Host 10\.\d+\.\d+\.\d+, not 1\.2\.3\.4\.5 or 999\.1\.1\.1", got[3])
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Frau (\w+)\. MR\. JOHN SMITH", got[4])
    assert m and m.group(2) == m.group(3) != m.group(4) and m.group(1) != "John" and m.group(1)[-1] in "nrsl"
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[5]) and got[5] != texts[5]
    assert re.fullmatch(r"Господин [А-Я][а-я]+", got[6]) and got[6] != texts[6]
    assert got[7] == texts[7] and got[8] is None and got[9] == ""
    assert got[10] == (a + " ") * 3000
    assert {r["doc_id"]: r["text"] for r in surrogates.replace(docs, key).collect()} == got
    assert {r["text"] for r in surrogates.replace(docs, "other").collect()} != {r["text"] for r in rows}
    assert surrogates.replace(_docs(spark, [])).count() == 0


def test_surrogates_stay_distinct(spark):
    # names of one gender and script have few short forms, fewer than the entities here; those that clash are made again, and longer
    names = spark.range(150_000).select(F.lit("name female Latin").alias("type"), F.concat(F.lit("n"), "id").alias("canon"))
    few = spark.range(26).select(F.lit("local a.b").alias("type"), F.char(F.col("id") + 97).alias("canon"))
    ssn = spark.range(3000).select(F.lit("ssn").alias("type"), (F.col("id") + 900000000).cast("string").alias("canon"))
    got = surrogates.assign(names.unionByName(few).unionByName(ssn), "k").toPandas()
    assert len(got) == 153_026 and not got.duplicated(["type", "canon"]).any() and not got.duplicated(["type", "surrogate"]).any()
    assert not set(zip(got.type, got.canon, strict=True)) & set(zip(got.type, got.surrogate, strict=True))
    again = {tuple(r) for r in surrogates.assign(few.unionByName(few.limit(0)), "k").collect()}
    assert again == {tuple(r) for r in got[got.type == "local a.b"].itertuples(index=False)}


def test_surrogates_keep_country_script_case_and_form(spark):
    pairs = [
        ("+49 30 123 4567", r"\+49 \d\d \d{3} \d{4}"), ("+351 21 123 4567", r"\+351 \d\d \d{3} \d{4}"), ("+49 30 123 456", r"\+49 \d\d \d{3} \d{3}"), ("+33 61 22 34 56 78", r"\+33( \d\d){5}"),
        ("030 1234567", r"0\d\d \d{7}"), ("(212) 555-0123", r"\([2-9]\d\d\) \d{3}-\d{4}"), ("Ann.Bee@Mail.com", r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.example"), ("ann@site.org", r"[a-z]{3}@[a-z]{4}\.example"),
        ("Κύριος Παπαδόπουλος", r"Κύριος [Α-Ω][α-ω]+"), ("μαρία@όνομα.gr", r"[α-ω]{5}@[α-ω]{5}\.example"), ("السيدة فاطمة", "السيدة [\u0620-\u064a]+"), ("श्री कुमार", "श्री [\u0900-\u097f]+"), ("Herr 王小明", "Herr [\u4e00-\u9fff]+"),
        ("Dr. Jane Roe", r"Dr\. [A-Z][a-z]+ [A-Z][a-z]+"), ("Mr. Jean-Luc Picard", r"Mr\. [A-Z][a-z]+-[A-Z][a-z]+ [A-Z][a-z]+"), ("Mrs O'Neil", r"Mrs [A-Z][a-z]+'[A-Z][a-z]+"), ("3782 822463 10005", r"37\d\d \d{6} \d{5}"), ("MR@SITE.ORG", r"[A-Z]{2}@[A-Z]{4}\.EXAMPLE"),
    ]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace(_docs(spark, [(k, f"see {a}, and", "s") for k, (a, _) in enumerate(pairs)]), "k").collect()}
    for k, (a, form) in enumerate(pairs):
        out = got[k].removeprefix("see ").removesuffix(", and")
        assert re.fullmatch(form, out) and out != a, (a, out)


def test_surrogates_by_brute_force(spark):
    """Distinct entities stay distinct and equal ones equal over random texts, whatever their spelling, and nothing else changes."""
    rng = np.random.default_rng(11)
    locals_, sites = ["ann", "bob.c", "d", "e"], ["mail.com", "mail.org", "x.de", "y.de"]
    people = [f"{t} {g} {f}" for t in ("Mr.", "Frau", "Dr.") for g in ("Jo", "Kim") for f in ("Lee", "Ray")]
    made = [*(f"{a}@{b}" for a in locals_ for b in sites), *people, *(f"10.0.0.{k}" for k in range(9)), *(f"+4930{k:07d}" for k in range(9))]
    texts = [" ; ".join(x.upper() if "@" in x and rng.random() < 0.4 else x for x in rng.choice(made, 12)) for _ in range(60)]
    got = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in surrogates.replace(_docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), "k").collect()}
    seen = {}
    for k, t in enumerate(texts):
        before, after = t.split(" ; "), got[k][0].split(" ; ")
        assert got[k][1] == len(before) == len(after)
        for a, b in zip(before, after, strict=True):
            if a[0].isalpha() and "@" not in a:  # names: the parts are the entities
                assert a.split()[0] == b.split()[0]
                seen.setdefault(("given", a.split()[1]), set()).add(b.split()[1])
                seen.setdefault(("family", a.split()[2]), set()).add(b.split()[2])
            elif "@" in a:
                seen.setdefault(("email", a.lower()), set()).add(b.lower())
                seen.setdefault(("domain", a.lower().split("@")[1]), set()).add(b.lower().split("@")[1])
                assert a.isupper() == b.isupper()
            else:
                seen.setdefault((a[:2], a), set()).add(b)
    assert all(len(v) == 1 for v in seen.values())
    for kind in {k[0] for k in seen}:
        values = [(k[:-1], next(iter(v))) for k, v in seen.items() if k[0] == kind]
        assert len(values) == len(set(values)) and not {v for _, v in values} & {k[-1] for k in seen if k[0] == kind}


# ---- 4


def test_language_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = langid.identify(langid.evidence_of_documents(docs), docs.select("text", "lang")).collect()
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert len(rows) == len(truth) and np.mean([truth[r["doc_id"]] == r["lang"] for r in rows]) > 0.98
    odd = _docs(spark, [(1, None, "a"), (2, "", None), (3, "123 !!", "a"), (4, "le la les une des", None)]).withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"]: r for r in langid.identify(langid.evidence_of_documents(odd), docs.select("text", "lang")).collect()}
    assert [got[k]["lang"] for k in (1, 2, 3)] == ["und"] * 3 and not any(got[k]["accepted"] for k in (1, 2, 3)) and got[4]["lang"] == "fr"
    assert langid.identify(langid.evidence_of_documents(odd), docs.select("text", "lang").limit(0)).where("accepted").count() == 0
    assert langid.keep_known(odd.limit(0)).count() == 0


def test_host_priors_and_declarations_decide_short_texts(spark):
    scored = [("h1.fr", "x.fr", "fr", None, 400, [-9.0, -2.0])] * 50 + [("h2.uk", "x.uk", "uk", None, 400, [-2.0, -9.0])] * 50
    scored += [("h1.fr", "x.fr", "fr", None, 2, [-5.0, -5.0]), ("h2.uk", "x.uk", "uk", None, 2, [-5.0, -5.0]), ("new.fr", "x.fr", "fr", None, 2, [-5.0, -5.0])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(scored)], "doc_id long, host string, domain string, suffix string, declared string, grams long, ll array<double>")
    got = {r["doc_id"]: r["lang"] for r in langid.fuse(df, ["en", "fr"]).collect()}
    assert (got[100], got[101], got[102]) == ("fr", "en", "fr")


def test_fusion_by_brute_force(spark):
    """Posteriors over random evidence, with wrong and unknown declarations, hot and new hosts, against the formula in plain loops."""
    rng = np.random.default_rng(6)
    langs, rows = ["de", "en", "fr"], []
    for k in range(300):
        true = int(rng.integers(3))
        said = langs[true] if rng.random() < 0.6 else str(rng.choice([*langs, "xx"]))
        d = int(rng.integers(6))
        host, domain, suffix = f"h{rng.integers(3)}.d{d}.s{d % 2}", f"d{d}.s{d % 2}", f"s{d % 2}"
        n = int(rng.choice([0, 1, 5, 200]))
        ll = [float(x) for x in np.where(np.arange(3) == true, -4.0, -4.3) + rng.normal(0, 0.2, 3)]
        rows.append((k, host, domain, suffix, said if rng.random() < 0.8 else None, n, ll))
    df = spark.createDataFrame(rows, "doc_id long, host string, domain string, suffix string, declared string, grams long, ll array<double>")
    got = {r["doc_id"]: r for r in langid.fuse(df, langs, evidence=30).collect()}
    guess = {r[0]: int(np.argmax(r[6])) for r in rows if r[5] > 0}
    tally = lambda column, value: np.array([sum(g == c for k, g in guess.items() if rows[k][column] == value) for c in range(3)], float)
    everything = np.array([sum(g == c for g in guess.values()) for c in range(3)], float)
    overall = (everything + 1) / (everything.sum() + 3)
    smooth = lambda n, above: (n + langid.SMOOTH * above) / (n.sum() + langid.SMOOTH)
    place = lambda said: None if said is None else langs.index(said) + 1 if said in langs else 0
    seen = np.zeros((3, 4))
    for k, g in guess.items():
        if rows[k][4] is not None:
            seen[g, place(rows[k][4])] += 1
    seen = np.log((seen + langid.SMOOTH / 4) / (seen.sum(1, keepdims=True) + langid.SMOOTH))
    decided = 0
    for k, host, domain, suffix, said, n, ll in rows:
        if not n:
            assert (got[k]["lang"], got[k]["posterior"], got[k]["accepted"]) == ("und", 0, False)
            continue
        prior = smooth(tally(1, host), smooth(tally(2, domain), smooth(tally(3, suffix), overall)))
        log = np.array(ll) * min(n, 30) + np.log(prior) + (0 if said is None else seen[:, place(said)])
        p = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
        assert got[k]["lang"] == langs[int(p.argmax())] and got[k]["posterior"] == pytest.approx(p.max(), rel=1e-9)
        decided += int(p.argmax()) != guess[k]
    assert decided > 5  # declarations and hosts have a say


def test_text_outweighs_wrong_declarations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200")
    wrong = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang")))
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    model = langid.fit(docs.select("text", "lang"))
    assert model.evidence in langid.EVIDENCE
    none = langid.identify(langid.evidence_of_documents(docs.withColumn("lang", F.lit(None).cast("string"))), docs.select("text", "lang"))
    for rows in (langid.identify(langid.evidence_of_documents(wrong), docs.select("text", "lang")), none):
        assert np.mean([truth[r["doc_id"]] == r["lang"] for r in rows.collect()]) > 0.97
    named = docs.withColumn("doc_id", F.concat(F.lit("id"), "doc_id"))  # ids of any type
    assert langid.keep_known(named).count() > 0.95 * docs.count()


def test_pages_as_evidence(spark):
    html = '<html lang="DE-at"><head><style>p{}</style></head><body><p>Und das</p></body></html>'
    pages = spark.createDataFrame([(1, "http://a.b.example.at/x", html), (2, None, None)], "page_id long, url string, html string")
    r = {x["page_id"]: x for x in langid.evidence_of_pages(pages).collect()}
    assert (r[1]["declared"], r[1]["host"], r[1]["domain"], r[1]["suffix"], r[1]["text"]) == ("de", "a.b.example.at", "example.at", "at", "Und das")
    assert r[2]["host"] == "" and r[2]["declared"] is None


# ---- 6


def test_unigram_counts(spark, texts):
    from tokenizers import models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), *unigram.piece_vocabulary(queries.PIECES)]
    plain = Tokenizer(models.Unigram(vocabulary[1:] + [("<unk>", -99.0)], len(vocabulary) - 1, False))
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace("▁", "always")])
    more = [*texts, "über \u3000straße\u2003naïve 日本語日本語 𝔘𝔫𝔦 \x1c x\x85y", "\U0001f9ff\U0001f9ff\U0001f9fe ok \u0378\u0379a"]
    low = min(s for _, s in vocabulary[1:])
    c = unigram.counter(queries.PIECES)
    assert c.unknown == low - 10
    c.unknown = min(low, -99.0) - 10  # the library counts the unknown piece's score as well
    try:
        want = [len(plain.encode(t or "").ids) for t in more]
        assert [c.count(t) for t in more] == want
    finally:
        c.unknown = low - 10
        c.known.clear()
    got = unigram.count_tokens(_docs(spark, [(k, t, "s") for k, t in enumerate(more)]).withColumn("N_tokens", F.lit(0)), queries.PIECES).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: c.count(t) for k, t in enumerate(more)}


def test_ties_go_to_the_earliest_start():
    from tokenizers import models

    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("c", -1.0), ("abc", -3.0), ("bc", -2.0)]
    plain, c = Tokenizer(models.Unigram([*vocabulary, ("?", -9.0)], 6, False)), unigram.Counter([*vocabulary, ("?", -9.0)])
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = "".join(rng.choice(list("abcdx"), rng.integers(1, 9)))
        assert c.pieces(word) == len(plain.encode(word).ids), word


# ---- 10


def test_derivatives(spark):
    html = '<html lang="en"><head><title>A &amp; B</title><script>var x="</p>";</script></head><body><!-- no --><p>One<br>two &lt;3&nbsp;</p><a class="k" href="/x?a=1">L</a> <A HREF="http://y/">M</A></body></html>'
    pages = spark.createDataFrame([(1, "http://h/p", html), (2, None, None), (1, "http://h/p", html)], "page_id long, url string, html string").withColumn("type", F.lit("x"))
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6 and len({r["record_id"] for r in rows}) == 4
    meta = next(r for r in rows if r["key"] == 1 and r["type"] == "metadata")
    text = next(r for r in rows if r["key"] == 1 and r["type"] == "conversion")
    doc = json.loads(meta["block"])
    assert doc["links"] == ["/x?a=1", "http://y/"] and doc["title"] == "A & B" and doc["lang"] == "en"
    assert doc["envelope"]["refers_to"] == meta["refers_to"] == text["refers_to"] and doc["headers"]["Content-Length"] == str(len(html.encode()))
    assert text["block"] == "A & B\nOne\ntwo <3\nL M"
    for r in rows:
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest() and r["content_length"] == len(r["block"].encode())
        assert r["source_digest"] == "sha256:" + hashlib.sha256((html if r["key"] == 1 else "").encode()).hexdigest()
    record = next(bytes(r["record"]).decode() for r in warc.as_warc(warc.derivatives(warc.responses(pages))).collect() if b"A & B\nOne" in r["record"])
    head, block = record.split("\r\n\r\n", 1)
    assert f"WARC-Refers-To: {text['refers_to']}" in head and block == text["block"] + "\r\n\r\n"


def _members(data):
    """The gzip members of a file, each decompressed."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data)
        data = d.unused_data


def _strict(record):
    """Headers and block of one record's bytes, with nothing left over."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.0"
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    assert rest[n:] == b"\r\n\r\n"
    return headers, rest[:n]


def test_written_warc_read_back_strictly(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/p", "<p>x</p>\r\n\r\n"), (2, "http://h/\r\nX: y", "é <a href=/q>z</a>"), (3, None, None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses(pages))
    assert warc.write_warc(made, str(tmp_path / "w")) == 6 and warc.write_warc(made.limit(0), str(tmp_path / "none")) == 0
    want = {r["record_id"]: r for r in made.collect()}
    got = [_strict(m) for f in (tmp_path / "w").glob("part-*.warc.gz") for m in _members(f.read_bytes())]
    assert len(got) == 6 and {h["WARC-Record-ID"] for h, _ in got} == set(want)
    for headers, block in got:
        r = want[headers["WARC-Record-ID"]]
        assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Type"] == r["type"] and headers["X-Source-Payload-Digest"] == r["source_digest"]
        assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() == r["block_digest"] and block.decode() == r["block"]
        assert ("WARC-Target-URI" in headers) == (r["target_uri"] is not None)
    assert not list((tmp_path / "w").glob(".attempt*"))


def test_response_records_are_read_with_their_headers(spark, tmp_path):
    import gzip

    def record(kind, n, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{n}>", "WARC-Date": f"2024-01-0{n}T00:00:00Z", "WARC-Target-URI": f"http://h/{n}", "Content-Length": len(block), **more}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    latin = "<html lang='fr'><p>caf\u00e9</p>".encode("latin-1")
    packed = gzip.compress(b"<p>packed</p>")
    chunked = b"3\r\n<p>\r\n5;x=y\r\nab</p\r\n1\r\n>\r\n0\r\n\r\n"
    answers = [
        record("warcinfo", 1, b"software: x\r\n"),
        record("response", 2, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nServer: s\r\n\r\n" + latin, **{"WARC-Payload-Digest": "sha1:ABC"}),
        record("response", 3, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed),
        record("response", 4, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked),
        record("request", 5, b"GET / HTTP/1.1\r\n\r\n"),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.warc.gz").write_bytes(b"".join(gzip.compress(a) for a in answers[:3]))
    (tmp_path / "a/two.warc").write_bytes(b"".join(answers[3:]))
    rows = {r["record_id"]: r for r in warc.read_warc(spark, str(tmp_path / "a")).collect()}
    assert {k: r["payload"] for k, r in rows.items()} == {"<urn:uuid:2>": "<html lang='fr'><p>caf\u00e9</p>", "<urn:uuid:3>": "<p>packed</p>", "<urn:uuid:4>": "<p>ab</p>"}
    assert rows["<urn:uuid:2>"]["headers"] == {"Content-Type": "text/html; charset=ISO-8859-1", "Server": "s"} and rows["<urn:uuid:2>"]["payload_digest"] == "sha1:ABC"
    assert rows["<urn:uuid:3>"]["date"] == "2024-01-03T00:00:00Z" and rows["<urn:uuid:3>"]["target_uri"] == "http://h/3"
    made = {(r["refers_to"], r["type"]): json.loads(r["block"]) if r["type"] == "metadata" else r["block"] for r in warc.derivatives(warc.read_warc(spark, str(tmp_path / "a"))).collect()}
    assert made["<urn:uuid:2>", "conversion"] == "caf\u00e9" and made["<urn:uuid:2>", "metadata"]["headers"]["Server"] == "s" and made["<urn:uuid:2>", "metadata"]["envelope"]["payload_digest"] == "sha1:ABC"
    import io

    with pytest.raises(ValueError, match="ends in its block"):
        list(warc.records_of(io.BytesIO(answers[1][:-30])))


def test_pages_that_are_not_closed_and_references_of_all_kinds(spark):
    pages = [
        ("<p>a<script>var x = '<a href=no>';", "a", []), ("a<!-- b <a href='no'>c", "a", []), ("<style>p{}", "", []), ("x<SCRIPT src=a></SCRIPT >y", "x y", []),
        ("<a href='/x?a=1&amp;b=2' class=k>one<a href=/y>two", "one two", [("/x?a=1&b=2", "one"), ("/y", "two")]), ("&eacute;&#233;&#xE9;&notit;&#0;&bogus;&#128;", "\u00e9\u00e9\u00e9\u00acit;\ufffd&bogus;\u20ac", []),
        ("<area href=no><a name=x>n</a><a data-href=no href=\"q\">  q\n r </a>", "n q\nr", [("q", "q\nr")]), ("word " * 200_000, ("word " * 200_000).strip(), []), ("", "", []), (None, "", []),
    ]
    df = spark.createDataFrame([(k, "u", h) for k, (h, _, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {(r["key"], r["type"]): r["block"] for r in warc.derivatives(warc.responses(df)).collect()}
    for k, (html, text, links) in enumerate(pages):
        doc = json.loads(got[k, "metadata"])
        assert got[k, "conversion"] == text, html[:60]
        assert list(zip(doc["links"], doc["link_texts"], strict=True)) == links, html[:60]
    assert warc.derivatives(warc.responses(df.limit(0))).count() == 0


def test_all_languages_are_fitted(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    rows = []
    for k in range(70):
        own = ["".join(rng.choice(letters, 6)) for _ in range(12)]
        rows += [(k * 10 + d, " ".join(rng.choice(own, 40)), f"l{k:02}", "s", 0, 0, 0, 0, 0, 0) for d in range(4 if k == 69 else 5)]
    docs = spark.createDataFrame(rows, DOCS)
    got = langid.identify(langid.evidence_of_documents(docs), docs.select("text", "lang")).collect()
    assert len(got) == len(rows) and all(r["accepted"] and r["lang"] == r["declared"] for r in got)


def test_copies_do_not_thin_the_fitted_sample(spark):
    texts = [(f"ab{k} cd{k}", "en") for k in range(30)] * 200 + [("le la les", "fr")]
    model = langid.fit(spark.createDataFrame(texts, "text string, lang string"), 60)
    langs, table = model.langs, model.table
    heard = np.concatenate(list(langid.grams(b"ab1 cd1")))
    assert langs == ["en", "fr"] and (table[heard, 0] - table[:, 0].min() > np.log(2 * 30)).any()


def test_derivatives_are_whole(spark):
    html = "<html lang='fr'><body><p>&copy; 2024 &middot; caf&eacute; &#8364; &amp;lt;</p><a href='/one'>First <b>link</b></a><a class=k href=/two>2&nbsp;&eacute;</a></body></html>"
    pages = spark.createDataFrame([(1, "http://h/p", html)], "page_id long, url string, html string")
    got = {r["type"]: r["block"] for r in warc.derivatives(warc.responses(pages)).collect()}
    doc = json.loads(got["metadata"])
    assert doc["lang"] == "fr" and doc["links"] == ["/one", "/two"] and doc["link_texts"] == ["First link", "2 é"]
    assert got["conversion"].startswith("© 2024 · café € &lt;\n")
    row = langid.evidence_of_pages(pages).first()
    assert row["declared"] == "fr" and row["text"] == got["conversion"]
