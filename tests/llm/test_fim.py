"""Fill-in-middle against a regular expression's tokens."""

import hashlib
import random
import re

from quarrystone.llm import fim


def brute(doc_id, text):
    text = text or ""
    w = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(w) + 1) for x in h[:2])
    p, m, x = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(w), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(w), "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return len(w), "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


def test_texts_are_cut_as_tokens_say():
    rng = random.Random(3)
    signs = "abZ <>PSM\n\té語😀\0é1_"
    for k in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.choice((0, 1, 2, 7, 40))))
        n, form, before, between, out = fim.transform_text(t.encode(), fim.draws(k))
        assert (n, form, before, between, out.decode()) == brute(k, t)


def test_ranks_are_selected():
    rng = random.Random(4)
    for width in (1, 2, 63, 64, 65, 1000):
        marks = rng.getrandbits(width) | 1
        places = [k for k in range(width) if marks >> k & 1]
        assert [fim.select(marks, r, width) for r in range(len(places) + 2)] == [*places, width, width]


def test_documents_with_all_odd_cases(spark):
    texts = [None, "", "a", "語" * 5, "<P>", "x <S> y", "<", "<<P", "P>", "word " * 200_000, "." * 1_000_000, "z" * 1_000_000, "é" * 9]
    rows = [(k, t, 0, "x") for k, t in enumerate(texts * 12)] + [(5, texts[3], 0, "x"), (None, "no id here", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = fim.transform(docs)
    want = sorted(((i, *brute(i, t)) for i, t, _, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    found = fim.digest(got).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in found) == sorted((str(i), sha(t)) for i, t, _, _ in rows)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.digest(fim.transform(docs.limit(0))).count() == 0
    named = spark.createDataFrame([("k1", "some text here", 1)], "doc_id string, text string, output int")
    assert tuple(fim.transform(named).first()) == ("k1", *brute("k1", "some text here"))
