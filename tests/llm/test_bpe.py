"""Byte-level BPE against the library, appends and edits against encoding anew."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from quarrystone.llm import bpe, queries

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
WORDS = ["alpha", " beta", "  ", "\n", "\n\n ", "délta", "it's", "WE'LL", "12345", "语言处理", "😀", " ", "\x00", "....", "--", "ß", " \t x", "ſ", "ाी", "aaaaaaaaaa"]


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", FILES)
def test_texts_as_the_library_encodes_them(name):
    path = public_tokenizers.path(name)
    code, lib, rng = bpe.coder(path, public_tokenizers.PATTERN), library(path), random.Random(1)
    texts = ["".join(rng.choice(WORDS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in rng.choices([*range(0xD800), *range(0xE000, 0x110000)], k=20)) for _ in range(1000)]
    texts += ["".join(rng.choice("abcdefgh tion'") for _ in range(200)) for _ in range(1000)]
    texts += [c * 5000 for c in (" ", "a", "-", "=", "\n", "é", "9", "語", "the")]
    for t in texts:
        ids, chars, tokens = code.encode(t, True)
        assert ids.tolist() == lib.encode_ordinary(t), t
        assert chars.sum() == len(t) and tokens.sum() == len(ids)


@pytest.mark.parametrize("name", FILES)
def test_pairs_go_together_as_merging_says(name):
    v, rng = bpe.coder(public_tokenizers.path(name), public_tokenizers.PATTERN).vocabulary, random.Random(5)
    every = list(v.tokens)
    runs = [r for t, r in v.ranks.items() if len(set(t)) <= 2]
    for k in range(60_000):
        a, b = (rng.choice(runs if k % 3 == 0 else every[:2000] if k % 3 == 1 else every) for _ in range(2))
        assert v.together(a, b) == (v.merged(v.tokens[a] + v.tokens[b]) == [a, b]), (a, b)
    assert all(v.merged(t) == [r] for t, r in v.ranks.items())


def test_tokens_that_merging_never_gives():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"zabcd": 259}  # zabcd has no merge
    code = bpe.Coder(ranks, public_tokenizers.PATTERN)
    for t in ("abc", "zabcd", "zabcdzabcd", "aabcbc", "abab"):
        whole = code.vocabulary.ranks.get(t.encode())
        assert code.encode(t)[0].tolist() == ([whole] if whole is not None else code.vocabulary.merged(t.encode()))


def test_long_texts_are_split_by_stretches(monkeypatch):
    code, rng = bpe.coder(public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN), random.Random(2)
    monkeypatch.setattr(bpe, "STRETCH", 16)
    for _ in range(2000):
        t = "".join(rng.choice([*WORDS, " " * 20, "z" * 40]) for _ in range(rng.randrange(20)))
        assert [p for some in code.split(t) for p in some] == code.pattern.findall(t)


def test_appends_and_edits_of_bytes():
    v, rng = bpe.coder(public_tokenizers.path(FILES[0]), public_tokenizers.PATTERN).vocabulary, random.Random(3)
    for _ in range(200):
        data, held = b"", bpe.Prefixes(v)
        for _ in range(12):
            more = "".join(rng.choice(WORDS) for _ in range(rng.randrange(3))).encode()
            at = rng.randrange(len(data) + 1)
            gone = rng.randrange(len(data) - at + 1) if rng.random() < 0.3 else 0
            if rng.random() < 0.4:
                held.append(more)
                data += more
            else:
                held.edit(at, gone, more)
                data = data[:at] + more + data[at + gone :]
            anew = bpe.Prefixes(v, data)
            assert held.last == anew.last and held.ids() == anew.ids()
            if len(data) < 150:
                assert held.ids() == v.merged(data)
    held = bpe.Prefixes(v, b"the quick brown fox " * 5000)
    held.worked = 0
    held.edit(50_000, 3, b"slow")
    assert 0 < held.worked < 500


def test_documents(spark):
    path = public_tokenizers.path(FILES[0])
    lib = library(path)
    texts = [None, "", "Hello there, it's 2024!", "語" * 40_000, " " * 100_000, "word " * 200_000, "." * 300_000, "x" * 300_000, "a\x00b\r\n"]
    rows = [(k % 8, t, 1) for k, t in enumerate(texts)] + [(None, "no id", 1), (2, texts[2], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digest(bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [lib.encode_ordinary(t or "") for _, t, _ in rows]
    want = [(i, len(n), sha(" ".join(map(str, n)).encode()), sha((t or "").encode())) for (i, t, _), n in zip(rows, ids, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.digest(bpe.decode(bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)).count() == 0
    odd = spark.createDataFrame([("a", [1, 2]), ("b", [10**8]), ("c", None), ("d", [])], "doc_id string, ids array<int>")
    found = {r["doc_id"]: r["decoded"] for r in bpe.decode(odd, path, public_tokenizers.PATTERN).collect()}
    assert found == {"a": lib.decode_bytes([1, 2]), "b": None, "c": None, "d": b""}


def test_edits_of_documents(spark):
    path, rng = public_tokenizers.path(FILES[0]), random.Random(4)
    lib, rows = library(path), []
    for k in range(300):
        t = "".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))
        at = len(t) if k % 3 == 0 else rng.randrange(len(t) + 2)
        rows.append((k, t, at, rng.randrange(6) * (k % 2), rng.choice([*WORDS, ""])))
    rows += [(300, None, None, None, None), (301, "The cat sat. " * 20_000, 130_000, 3, "dog"), (302, "b", 0, 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at long, removed long, inserted string")
    made = bpe.encode(docs, path, public_tokenizers.PATTERN, shape=True).join(docs, "doc_id")
    got = {r["doc_id"]: r for r in bpe.edit(made, path, public_tokenizers.PATTERN).collect()}
    for k, t, at, removed, inserted in rows:
        t = t or ""
        at = min(at or 0, len(t))
        new = t[:at] + (inserted or "") + t[at + (removed or 0) :]
        assert got[k]["text"] == new and got[k]["ids"] == lib.encode_ordinary(new)
        assert sum(got[k]["piece_chars"]) == len(new) and sum(got[k]["piece_tokens"]) == len(got[k]["ids"])
    assert got[301]["remade"] < 400


def test_query_equals_the_library(spark):
    root = "/root/testdata/sf0.001"
    lib = library(queries.BYTES)
    want = []
    for r in spark.read.parquet(f"{root}/documents.parquet").collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    got = queries.queries()["op12_byte_bpe"](spark, root)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
