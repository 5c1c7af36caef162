"""The pipeline and the queries without SQL, on the smallest tables, against brute force and the libraries."""

import hashlib
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from semspark.llm import bpe, bpe_codec, quality, queries
from semspark.llm import common as C

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near_duplicates(rows):
    """Ids that stay: the smallest of each class."""
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in rows if (w := words_of(r.text))}
    parent = {r.doc_id: r.doc_id for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sets, 2):
        if len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i for i in parent if root(i) == i}


def cut_texts(rows):
    first = {}
    for r in rows:
        w = words_of(r.text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, r.doc_id), r.doc_id)
    out = {}
    for r in rows:
        w = words_of(r.text)
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < r.doc_id for x in range(k, k + 13)}
        out[r.doc_id] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r.text
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def clean_ids(rows, items):
    windows = set()
    for t in items:
        w = plain_words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(x) for x in windows}
    return {r.doc_id for r in rows if not any(tuple(w[k : k + n]) in windows for w in [plain_words(r.text)] for n in sizes for k in range(len(w) - n + 1))}


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe_codec.RANKS), special_tokens={})


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = C.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = C.stored(stage(spark, docs, SF), "stage")
        out.append((name, docs, docs.collect()))
    return out


def test_stages_against_brute_force(spark, stages):
    docs = C.table(spark, SF, "documents")
    net = quality.fitted(docs, C.table(spark, SF, "labels"))
    raw = docs.collect()
    good = {r.doc_id for r in raw if net.score(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0] >= quality.THRESHOLD}
    rows = [got for _, _, got in stages]
    assert {r.doc_id for r in rows[0]} == good and 0 < len(good) < len(raw)
    assert {r.doc_id for r in rows[1]} == near_duplicates(rows[0])
    assert {r.doc_id: r.text for r in rows[2]} == cut_texts(rows[1])
    assert all(r.n_chars == len(r.text) for r in rows[2])
    items = [r.text for r in C.table(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in rows[3]} == clean_ids(rows[2], items)
    enc, texts = library(), {r.doc_id: r.text for r in rows[3]}
    assert {r.doc_id: bytes(r.ids) for r in rows[4]} == {i: np.array(enc.encode_ordinary(t), "<u4").tobytes() for i, t in texts.items()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows[4])
    assert all(df.columns == docs.columns for _, df, _ in stages[:-1])


def test_run_is_its_stages(spark, stages):
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in stages[-1][2])


def test_queries_without_sql(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = {r.doc_id: r.text for r in C.table(spark, SF, "documents").collect()}
    counts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op6_token_counts"](spark, SF).collect()}
    want = {i: (len(t.encode()), len(counts.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
    assert got == {i: (b, n, n > 512) for i, (b, n) in want.items()}
    enc = library()
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op7_bpe_codec"](spark, SF).collect()}
    ids = {i: np.array(enc.encode_ordinary(t), "<u4") for i, t in texts.items()}
    assert coded == {i: (len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in ids.items()}
    for name in ("op1_toxicity", "op5_quality"):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert {r.doc_id for r in rows} == set(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


ODD = [None, "", " \n\t", "one", "word " * 50_000, "x" * 100_000, "a clean text of some words that nobody else has at all", "a clean text of some words that nobody else has at all"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_any_row(spark, stage):
    """Null and blank texts, a null id, repeated rows, two texts of one id, long texts, clashing names, and no rows: each stage ends, and keeps the columns of its input."""
    rows = [(k, t, "en", "s", len(t or ""), "clash", 1) for k, t in enumerate(ODD)] + [(None, "no id here", "en", "s", 10, "clash", 1), (3, "one", "en", "s", 3, "clash", 1), (3, "another text of this id", "en", "s", 3, "clash", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, counts string, key int"
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, spark.createDataFrame(rows, schema), SF)
    got = out.collect()
    last = stage == len(corpus_pipeline.STAGES) - 1
    assert last or out.columns == [c.split()[0] for c in schema.split(", ")]
    ids = [r.doc_id for r in got]
    if stage == 1:  # one of each id and text, and of equal texts the first
        assert sorted(map(str, ids)) == sorted(map(str, [0, 3, 3, 4, 5, 6, None, *[k for k in (1, 2) if k in ids]]))
    elif stage:
        assert len(got) == len(rows)
    assert run(spark, spark.createDataFrame([], schema), SF).count() == 0
