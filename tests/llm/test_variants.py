"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from semspark.llm import variants

SCHEMA = "doc_id long, text string, word string, n long, key string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def brute(rows, every=31):
    counts = Counter()
    for i, t, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def awkward(seed=2):
    rng = random.Random(seed)
    stems = ["information", "kilometre", "étranger", "aaaaaaaa", "STRAßENBAHN", "conversation", "conversations", "abcdefg", "ÿÀ÷×àáâ"]

    def changed(w):
        k, kind = rng.randrange(len(w)), rng.randrange(4)
        return w if kind == 0 else w[:k] + w[k + 1 :] if kind == 1 else w[:k] + rng.choice("aezqé") + w[k + (kind == 2) :]

    texts = [None, "", "short one", "x" * 5000 + " " + "y" * 5000, "caféāteria āinformation中kilometre", "infor-mation's information_information1information"]
    for _ in range(150):
        texts.append(rng.choice([" ", ", ", "\n", "—"]).join(changed(w) if rng.random() < 0.3 else w for w in rng.choices(stems, [60, 30, 20, 10, 10, 40, 2, 5, 5], k=rng.randint(1, 40))))
    rows = list(enumerate(texts)) + [(None, texts[10]), (7, texts[7]), (7, texts[7])]
    return [(i, t, "clash", 7, "clash") for i, t in rows]


@pytest.mark.parametrize("most", [4096, 4])
def test_variants(spark, most):
    """Short lists too, so that stretches are halved down to single places."""
    rows = awkward()
    got = variants.variants(spark.createDataFrame(rows, SCHEMA).repartition(3), every=5, most=most).collect()
    want = brute(rows, 5)
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
    assert sum(w[1] is not None for w in want) > 10 and any(w[1] is not None and w[1] != w[2] for w in brute(rows, 31) + want)


def test_chains_are_followed_to_their_roots(spark):
    chain = ["abcdefghi", "abcdefghj", "abcdefgkj", "abcdefmkj"]
    text = " ".join(" ".join([w] * n) for w, n in zip(chain, (2, 20, 200, 2000)))
    got = {r.word: r.root for r in variants.variants(spark.createDataFrame([(1, text, "", 0, "")], SCHEMA), every=1 << 40).collect()}
    assert got == dict.fromkeys(chain, chain[-1])


def test_no_rows(spark):
    assert variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert variants.variants(spark.createDataFrame([(1, "nothing often enough", "", 0, "")], SCHEMA)).count() == 0


def test_lists_meet_each_pair_once(spark):
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(400)})
    vocabulary = spark.createDataFrame([(w, 2 + k % 7) for k, w in enumerate(words)], "word string, n long")
    for most in (4096, 10):
        got = {r.word: (r.n_near, r.near) for r in variants.near_words(vocabulary, most).collect()}
        for k, w in enumerate(words):
            near = [(-(2 + j % 7), v) for j, v in enumerate(words) if one_edit(v, w)]
            assert got.get(w) == ((len(near), min(near)[1]) if near else None)


@pytest.mark.parametrize("walked", [5, 1 << 16])
def test_near_pairs(monkeypatch, walked):
    monkeypatch.setattr(variants, "WALKED", walked)
    rng = random.Random(walked)
    rows = sorted({(rng.randint(0, 2), "".join(rng.choice("abzÿ") for _ in range(rng.randint(1, 6)))) for _ in range(250)})
    letters, size = variants._letters([w for _, w in rows])
    i, j = variants.near_pairs(np.array([g for g, _ in rows]), letters, size)
    want = sorted((a, b) for a, (g, v) in enumerate(rows) for b, (h, w) in enumerate(rows) if g == h and one_edit(v, w))
    assert sorted(zip(i.tolist(), j.tolist())) == want
