"""The operators against brute force, on small tables made awkward: nulls, empties, copies, ties, long texts, clashing names."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspark.llm import bpe, bpe_codec, chat, components, decontaminate, quality, shingles, substrings, token_counts, toxicity, vectors, warc
from semspark.llm import common as C

SCHEMA = "doc_id long, text string, lang string, n_words long, _text string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def awkward(seed=3):
    """Texts with copies, near copies, shared passages, blanks and nulls."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "漢字", "don't", "<|endoftext|>", "1,5"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = make(20)
    texts = [None, "", " \t\n", "one", "one two three", make(12), make(13), passage, passage, f"{make(30)}  {passage}\n{make(5)}", f"{passage} {passage} {make(9)}"]
    long = make(400)
    texts += [long, long.replace("w1 ", "w2 ", 2), long + " tail", make(3000), "x" * 3000, " " * 500, passage.upper()]
    texts += [make(rng.randint(1, 60)) for _ in range(20)]
    return [(i, t, "en", 7, "clash") for i, t in enumerate(texts)] + [(None, passage, "en", 7, "clash"), (5, texts[5], "en", 7, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_removed(rows):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for k in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for k in range(len(w) - 12 if i is not None else 0):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        left = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"group_rows": 3, "bucket_bytes": 500}])
def test_substrings(docs, options):
    rows = docs.select("doc_id", "text", "lang")
    got = [tuple(r) for r in substrings.deduplicated(rows, **options).select("doc_id", "counts.*").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_removed(awkward())))


def test_substrings_keep_columns_that_clash(docs, none):
    out = substrings.deduplicated(docs.withColumn("counts", F.lit("clash")), C.free_name(docs.withColumn("counts", F.lit(1)), "counts"))
    assert out.columns == [*docs.columns, "counts", "counts_"] and out.count() == docs.count()
    assert substrings.deduplicated(none).count() == 0 and substrings.longest_repeats(none).count() == 0


def test_substrings_tell_the_texts_of_one_id_apart(spark):
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))
    shared, own = make(40), [make(30) for _ in range(6)]
    rows = [(5, f"{own[0]} {shared}"), (5, f"{shared} {own[1]}"), (5, own[2]), (2, f"{own[3]} {own[2]}"), (9, f"{shared} {shared}"), (5, own[2])] + [(7, shared)] * 30
    got = sorted(str(tuple(r)) for r in substrings.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), group_rows=4).select("doc_id", "counts.*").collect())
    assert got == sorted(str(x) for x in brute_removed(rows))


def brute_longest(rows):
    out = {}
    n = 13
    while True:
        seen = {}
        for i, t, *_ in rows:
            w = words_of(t)
            for k in range(len(w) - n + 1 if i is not None else 0):
                seen.setdefault(tuple(w[k : k + n]), set()).add((i, t))
        several = [x for x in seen.values() if len({i for i, _ in x}) > 1]
        if not several:
            return out
        out |= dict.fromkeys(set().union(*several), n)
        n *= 2


@pytest.mark.parametrize("kind", ["mixed", "one length", "one word"])
def test_longest_repeats_double_until_none_survives(spark, kind):
    """Words of one length too, and a text of one word over and over."""
    rng = random.Random(2)
    word = {"mixed": lambda: f"w{rng.randrange(10**6)}", "one length": lambda: f"{rng.randrange(10**5):05}", "one word": lambda: "a"}[kind]
    make = lambda n: " ".join(word() for _ in range(n))
    passage, copy = make(150), make(600)
    rows = [(1, f"{make(50)} {passage} {make(300)}"), (2, f"{make(70)} {passage}"), (3, make(200)), (4, copy), (6, copy), (None, copy), (7, None), (8, "short text"), (9, passage[:200]), (3, copy[:300]), (10, make(26)), (11, make(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", substrings.row_key().alias("key"))
    texts = {(r.doc_id, r.key): r.text for r in df.collect()}
    for options in ({}, {"group_rows": 2, "bucket_bytes": 900}):
        got = {(r.id, texts[r.id, r.row]): r.longest for r in substrings.longest_repeats(df.drop("key"), **options).collect()}
        assert got == brute_longest(rows)


def test_equal_documents_of_words_of_one_length(spark):
    for n in (3, 5, 6):
        text = " ".join("abcdefgh"[(k * k + n) % 8] * n + str(k % 7) for k in range(600))
        got = substrings.longest_repeats(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).collect()
        assert [r.longest for r in got] == [416, 416]


def test_levels_double():
    assert substrings.levels(13) == [4, 7, 13] and substrings.levels(4) == [4] and all(b <= 2 * a for n in range(1, 60) for a, b in zip(substrings.levels(n), substrings.levels(n)[1:]))


def test_shingle_join(docs, none):
    sets = {}
    rows = [(i, t) for i, t, *_ in awkward() if i is not None and words_of(t)]
    for i, t in rows:
        w = words_of(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    flat = [(i, s) for i, some in sets.items() for s in some]
    links, parent = dict.fromkeys(sets, 0), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(flat, 2):
        if len(a & b) * 10 >= 8 * len(a | b):
            links[i] += 1
            if i != j:
                links[j] += 1
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_links, r.class_id) for r in shingles.joined(docs, block_rows=4, bucket_rows=3).collect() if r.doc_id is not None}
    assert all(got[i] == (links[i], root(i)) for i in sets) and got[0] == (0, 0)
    kept = shingles.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (_, c) in got.items() if i == c)
    assert shingles.joined(none).count() == 0


def test_shingle_join_tells_the_texts_of_one_id_apart(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(90)) for _ in range(60)) for _ in range(4)]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (9, texts[1] + " tail"), (7, texts[2]), (3, texts[2] + " tail"), (8, texts[3]), (7, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in shingles.joined(df).collect())
    assert got == sorted([(7, 0, 7, True), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (7, 1, 3, False), (3, 1, 3, True), (8, 0, 8, True), (7, 0, 7, True), (7, 0, 7, True)])
    kept = [(r.doc_id, (r.text or "").strip()) for r in shingles.one_of_each(df).collect()]
    assert sorted(kept) == sorted([(7, texts[0]), (7, texts[1]), (3, texts[2] + " tail"), (8, texts[3]), (7, "")])


def test_shingle_classes_reach_through_a_larger_id(spark):
    words = [f"w{i}" for i in range(100)]
    ends = lambda a, b: " ".join([f"{a}{i}" for i in range(8)] + words + [f"{b}{i}" for i in range(8)])
    rows = [(1, ends("a", "m")), (2, ends("n", "b")), (3, ends("n", "m"))]
    got = {r.doc_id: (r.n_links, r.class_id) for r in shingles.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 1)}


def test_prefixes_are_shortened_until_the_recall_is_met():
    assert shingles.shortened([(8, 1.0, 100)], 0.9995, 16, 8, 4) == 8
    pairs = lambda s: [(x, s, round(1e6 * (shingles.matched(s, x, 16) - (shingles.matched(s, x + 1, 16) if x < 8 else 0)))) for x in range(4, 9)]
    turns = {s: shingles.shortened(pairs(s), 0.9995, 16, 8, 4) for s in (0.95, 0.9, 0.85, 0.8)}
    assert turns == {0.95: 8, 0.9: 8, 0.85: 5, 0.8: 4}
    assert abs(shingles.measured_recall(pairs(0.8), 8, 16) - shingles.matched(0.8, 8, 16)) < 1e-3
    assert shingles.shortened([], 0.9995, 16, 8, 4) == 4


def test_runs_of_a_trie_are_joined_longest_prefix_first():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (5, 128)).astype(np.uint8)
    sketch = np.repeat(base, 20, 0)
    sketch[rng.random(sketch.shape) < 0.05] = 7
    label = np.sort(rng.integers(0, 3, (100, 8)).astype(np.uint8).view("S8").ravel()).view(np.uint8).reshape(-1, 8)
    a, b = shingles._reached(sketch, label, 0.6 * 128)
    root = components_of(100, zip(a.tolist(), b.tolist()))
    assert [root[i] for i in range(100)] == [i // 20 * 20 for i in range(100)] and len(a) < 300


def components_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def vector_rows(seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 8))
    near = base[:25] + rng.normal(size=(25, 8)) * 0.12
    hot = base[:1] + rng.normal(size=(60, 8)) * 0.01
    some = [[float(x) for x in v] for v in np.concatenate([base, near, hot, base[:3], base[3:5] * 4])]
    bad = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] * 8, some[0][:5], [1e-200] * 8, [1e200] * 8]
    return [(i, v, 0) for i, v in enumerate(some + bad)] + [(None, some[0], 0)]


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 16, "sample": 20}])
def test_vector_links(spark, options):
    rows = vector_rows()
    fine = {i: np.array(v) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in fine.items()}
    want = {i: set() for i, _, _ in rows if i is not None}
    for i, j in itertools.combinations(fine, 2):
        if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
            want[i].add(j)
            want[j].add(i)
    out = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int"), **options).collect()
    got = {r.vec_id: r for r in out if r.vec_id is not None}
    assert len(out) == len(rows) and all(not r.kept for r in out if r.vec_id is None)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, want.values()))
    assert all(got[i].n_links <= len(want[i]) for i in want)
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in want)


def test_vectors_of_one_id_keep_their_own_links(spark):
    near = lambda v: [v[0], v[1], v[2] + 0.05]
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    out = vectors.linked(spark.createDataFrame([(5, a), (5, b), (1, near(a)), (9, near(b))], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 5, True), (9, 1, 5, False)]


def test_planted_pairs_are_found_over_many_leaves(spark):
    """Pairs at the threshold in 64 dimensions, among vectors enough for several leaves and levels of each tree."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=(600, 64))
    aside -= (aside * base[:600]).sum(1, keepdims=True) * base[:600]
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, (600, 1))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, cosine * base[:600] + np.sqrt(1 - cosine**2) * aside]))]
    out = vectors.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf_rows=128, sample=1024).collect()
    linked = {r.vec_id: r for r in out if r.n_links}
    assert len(linked) >= 0.99 * 1200 and all(r.n_links == 1 and r.component_id == k % 3000 for k, r in linked.items())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200), (5, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and 200 not in got


def brute_hits(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for words, item in windows:
        for k in range(len(w) - len(words) + 1):
            if tuple(w[k : k + len(words)]) == words:
                hit |= set(range(k, k + len(words)))
                items.add(item)
    return len(w), len(hit), sorted(items, key=str)


@pytest.mark.parametrize("block_words", [10**6, 25])
def test_decontamination(spark, docs, none, block_words):
    rows = awkward()
    items = [(1, " ".join(words_of(rows[9][1])[30:45])), (2, "One two"), (3, None), (4, ""), (12, rows[7][1].upper()), (12, rows[7][1]), (5, "w1"), (6, "漢字 é")]
    windows = []
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        windows += [(tuple(w[k : k + 10]), str(item)) for k in range(max(1, len(w) - 9) if w else 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(str((r.doc_id, r.n_words, r.n_hit, r.items_sha256)) for r in decontaminate.report(docs, bench, block_words=block_words).collect())
    want = []
    for i, t, *_ in rows:
        n, hit, found = brute_hits(t, windows)
        want.append(str((i, n, hit, hashlib.sha256(",".join(found).encode()).hexdigest())))
    assert got == sorted(want)
    clean = decontaminate.uncontaminated(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns and clean.count() == sum(", 0, '" in x for x in want)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.report(none, bench).count() == 0


def fuzz_texts():
    rng = random.Random(5)
    parts = ["'", "s", "re", "ve", "ll", " ", "  ", "\n", "\t", "a", "B", "é", "1", "!", "%%", "<|endoftext|>", "漢", "́", "\x1c", "\0", "՘", "😀", " the", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 4000, " " * 300, "don't'll's"]


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = fuzz_texts()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (16, 128):
        got = {r.doc_id: r for r in token_counts.token_counts(rows, chunk=chunk).collect()}
        assert [got[i].n_tokens for i in range(len(texts))] == want
        assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]


@pytest.mark.parametrize(("chunk_chars", "dealt_chars"), [(8, 1 << 16), (50, 120), (8, 16), (1 << 16, 1 << 16)])
def test_codec(spark, chunk_chars, dealt_chars):
    import public_tokenizers
    import tiktoken

    texts = fuzz_texts() + ["same text that is long enough"] * 2
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(bpe_codec.RANKS), special_tokens={})
    rows = spark.createDataFrame([(min(i, 405), t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = bpe_codec.coded(rows, chunk_chars=chunk_chars, dealt_chars=dealt_chars).collect()
    got = sorted((r.doc_id, bytes(r.ids), bytes(r.bytes)) for r in out)
    want = sorted((min(i, 405), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in enumerate(texts))
    assert got == want
    back = bpe_codec.decoded(spark.createDataFrame([(1, want[0][1])], "doc_id long, ids binary")).first()
    assert bytes(back.bytes) == want[0][2]


def test_chat_round_trip(spark):
    nasty = ["", None, "</s>", "<s> x </s>", "<\\/s>", "<\\\\/s> [/INST]", "[ROLE: [/INST] ]", "[ROLE:<s>] [/ROLE]", " </s", "[INST] a [/INST] b", "é😀\n\\"]
    roles = ["user", "assistant", "system", "to] ol", None]
    rows = [(c, t, r, x) for c, (r, k) in enumerate(itertools.product(roles, range(2))) for t, x in enumerate(nasty[k:] + nasty)]
    rows += [(99, 0, "user", "twice"), (99, 0, "user", "twice"), (99, None, "assistant", "first"), (None, 1, "user", "nobody's")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.formatted(df).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        assert [(t.role, t.text) for t in out[conv].turns] == [(r, x) for _, r, x in mine]
        spans = [out[conv].formatted[s.start : s.start + s.size] for s in out[conv].loss]
        undone = spark.createDataFrame([(s,) for s in spans] or [("",)], "s string").select(chat.unescape(F.col("s")).alias("s")).collect()
        assert [u.s for u in undone if spans] == [x for _, r, x in mine if r == "assistant"]
    assert chat.formatted(df.limit(0)).count() == 0
    said = {r.conv_id: r.said for r in chat.under_mask(chat.formatted(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        assert said[conv] == "".join(x for _, r, x in mine if r == "assistant")


def test_chat_digests_show_a_wrong_mask(spark):
    long = "[INST] </s> \\ é" * 40_000
    rows = [(1, 0, "user", "hi", "clash"), (1, 1, "assistant", "well </s> then", "clash"), (1, 2, "assistant", long, "clash")]
    chats = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    right = chat.digests(chats).first()
    assert right.loss_chars == len("well </s> then" + long) and right.loss_sha256 == hashlib.sha256(("well </s> then" + long).encode()).hexdigest()
    moved = chats.withColumn("mask", F.transform("mask", lambda s: F.when(s.isNotNull(), F.struct((s["start"] + 1).alias("start"), s["size"].alias("size")))))
    assert chat.digests(moved).first().loss_sha256 != right.loss_sha256


PAGES = "page_id long, url string, html string, start long, bytes string"


def pages_of(spark):
    pages = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(600)] + [(7, "http://other", "y")] * 3 + [(None, None, None), (8, "http://h/8", "x" * 8)]
    pages += [(5, "http://hot", str(k)) for k in range(150)] + [(5, "http://hot", "equal")] * 150 + [(1000, "http://long", "é" * 400_000)]
    return spark.createDataFrame([(*p, 1, "clash") for p in pages], PAGES).repartition(3), len(pages)


def test_warc_audit_finds_every_fault(spark):
    df, count = pages_of(spark)
    replica = warc.written(warc.records(df), file_records=100)
    plan = warc.manifest(replica)
    rows = replica.collect()
    assert len(rows) == count and max(sum(r.file == 0 and r.part == p for r in rows) for p in range(9)) < 200
    for part in {(r.file, r.part) for r in rows}:
        mine = sorted((r for r in rows if (r.file, r.part) == part), key=lambda r: r.nth)
        assert [r.start for r in mine] == list(itertools.accumulate([0, *(len(r.bytes) for r in mine)]))[:-1]
        assert all(r.sha == hashlib.sha256(r.bytes).hexdigest() and r.size == len(r.bytes) for r in mine)
    assert warc.audit(plan, warc.leaves(replica)).count() == 0
    bad = warc.damaged(replica, every=20)
    for options in ({}, {"fan": 2, "range_bytes": 1000}):
        found = {(r.file, r.part, r.start): (r.size, r.mine, r.other) for r in warc.audit(plan, warc.leaves(bad), **options).collect()}
        there = {(r.file, r.part, r.start): bytes(r.bytes) for r in bad.collect()}
        was = {(r.file, r.part, r.start): bytes(r.bytes) for r in rows}
        sha = lambda b: None if b is None else hashlib.sha256(b).hexdigest()
        want = {k: (len(was.get(k, there.get(k))), sha(was.get(k)), sha(there.get(k))) for k in was.keys() | there.keys() if was.get(k) != there.get(k)}
        assert found == want and len(want) > 50 and {(a is None, b is None) for _, a, b in want.values()} == {(False, False), (False, True), (True, False)}
    assert warc.audit(plan.limit(0), warc.leaves(replica).limit(0)).count() == 0
    assert warc.audit(plan, warc.leaves(replica).limit(0)).count() == count
    assert warc.written(warc.records(df.limit(0))).count() == 0


def test_warc_audit_tells_copies_apart(spark):
    """One copy of each page damaged, or lost, of two; and records where the manifest has none."""
    df = spark.createDataFrame([(i, f"http://h/{i}", "x" * i) for i in range(60) for _ in range(2)], "page_id long, url string, html string")
    replica = warc.written(warc.records(df))
    plan = warc.manifest(replica)
    even = F.col("nth") % 2 == 0
    changed = replica.withColumn("bytes", F.when(even, F.concat(F.expr("substring(bytes, 1, size - 5)"), F.lit(b"~"))).otherwise(F.col("bytes")))
    want = {(r.file, r.part, r.start) for r in replica.where(even).collect()}
    for bad in (changed, replica.where(~even)):
        assert {(r.file, r.part, r.start) for r in warc.audit(plan, warc.leaves(bad)).collect()} == want and len(want) == 60
    more = spark.createDataFrame([(0, 0, 10**7, b"extra"), (35, 2, 0, b"new file"), (0, 0, 0, b"a second row at this place"), (0, 0, 10**8, None)], "file long, part int, start long, bytes binary")
    out = warc.audit(plan, warc.leaves(replica.select(more.columns).unionByName(more))).collect()
    assert sorted((r.file, r.start, r.mine is None) for r in out) == [(0, 0, False), (0, 10**7, True), (0, 10**8, True), (35, 0, True)] and all(r.other for r in out)


def labelled(spark):
    rng = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(700):
        toxic, good = i % 4 == 0, i % 3 != 0
        say = [" ".join(rng.choice(plain) for _ in range(8)) + "." for _ in range(rng.randint(1, 9))]
        if toxic:
            say[rng.randrange(len(say))] = f"you are a {rng.choice(['scum', 'moron'])} {rng.choice(plain)}."
        text = " ".join(say) if good else " | ".join(rng.choice(plain) for _ in range(60))
        docs.append((i, text if good or not toxic else text + " you scum", "en"))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, "en"), (1001, "", "en"), (None, "you scum", "en"), (1002, "w1 " * 40_000, "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    for run, column in ((toxicity.toxicity, "toxic"), (quality.quality, "quality")):
        out = run(docs, labels)
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        held = out.where("held_out").join(labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(column).alias("y")), "doc_id").where("y is not null")
        right = held.where("predicted = y").count() / held.count()
        assert right > 0.9, (column, right)
    spans = [r for r in toxicity.toxicity(docs, labels).where("doc_id = 0").collect()]
    text = docs.where("doc_id = 0").first().text or ""
    assert any("scum" in text[s.start : s.end] or "moron" in text[s.start : s.end] for s in spans[0].sentences)


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark)
    few = docs.limit(5)
    assert quality.keep_good(few, labels.limit(0)).count() == 5
    assert toxicity.toxicity(few, labels.limit(0)).count() == 5 and quality.quality(docs.limit(0), labels).count() == 0


def test_scores_against_plain_loops(spark):
    """The noisy-or over sentences and the network over chunks, one byte and one word at a time."""
    rng, np_rng = random.Random(4), np.random.default_rng(4)
    texts = ["", "one", "You are. A scum! Really scum scum\nyes", "é漢 x" * 400, "".join(chr(rng.randrange(32, 127)) for _ in range(1700)), "a b. " * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    net = quality.Network(3)
    net.p["out"][:], net.p["conv_b"][:], net.p["hidden_b"][:] = (np_rng.normal(size=net.p[k].shape) for k in ("out", "conv_b", "hidden_b"))
    p = {k: v.astype(float) for k, v in net.p.items()}
    for text, got in zip(texts, net.score(data, at)):
        raw, start, described = list(text.encode()), 0, []
        while True:
            chunk = [raw[i] if i < len(raw) else 256 for i in range(start, start + quality.CHUNK)]
            best = [-np.inf] * quality.FILTERS
            for cell in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP):
                seen = np.concatenate([p["embed"][c] for c in chunk[cell : cell + quality.WIDTH]])
                best = [max(b, float(seen @ p["conv"][:, f])) for f, b in enumerate(best)]
            pooled = [max(0.0, b + p["conv_b"][f]) for f, b in enumerate(best)]
            described.append([max(0.0, sum(pooled[f] * p["hidden"][f, h] for f in range(quality.FILTERS)) + p["hidden_b"][h]) for h in range(quality.HIDDEN)])
            if start + quality.CHUNK >= len(raw):
                break
            start += quality.STRIDE
        both = [max(d[h] for d in described) for h in range(quality.HIDDEN)] + [sum(d[h] for d in described) / len(described) for h in range(quality.HIDDEN)]
        z = sum(b * w for b, w in zip(both, p["out"])) + p["out_b"][0]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4, text[:20]
    model = toxicity.Model(np.abs(np_rng.normal(size=toxicity.BUCKETS + 1)) * 0.2, -2.0)
    score, doc, start, end, prob = model.score(data, at)
    features, sentence, _, _, _ = toxicity.featurise(data, at)
    said, before = [], [1.0] * len(texts)
    for d, text in enumerate(texts):
        raw, here = text.encode(), at[d]
        for m in re.finditer(rb"[^.!?\n]+", raw):
            words = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", m[0]))
            if words:
                said.append((d, here + m.start() + words[0].start(), here + m.start() + words[-1].end()))
    assert said == list(zip(doc.tolist(), start.tolist(), end.tolist()))
    for i, d in enumerate(doc.tolist()):
        z = sum(float(model.weights[f]) for row in features[sentence == i] for f in row) - 2.0
        assert abs(prob[i] - 1 / (1 + np.exp(-z))) < 1e-6
        before[d] *= 1 - 1 / (1 + np.exp(-z))
    assert all(abs(score[d] - (1 - q)) < 1e-6 for d, q in enumerate(before))


def test_training_samples_are_bounded_in_rows_and_bytes(spark):
    from semspark.llm import samples

    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(4000)] + [(50, "x" * 300_000), (51, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    drawn, share = samples.labelled_sample(docs, labels, "toxic", 4, 2, 15)
    rows = drawn.collect()
    assert len({r.doc_id for r in rows}) == len(rows) <= 30 and all(len(r.text) < 300_000 for r in rows) and 0 < share < 1


def test_empty_tables_and_clashing_names(spark):
    """Of those operators that have no test of these by themselves."""
    bare = spark.createDataFrame([], "doc_id long, text string, n_tokens string, key int, ids int, _text int, n_bytes int")
    assert token_counts.token_counts(bare).count() == 0 and bpe_codec.coded(bare).count() == 0
    vector = spark.createDataFrame([], "vec_id long, embedding array<double>, node int, leaf int, component_id int")
    assert vectors.linked(vector).count() == 0
    row = spark.createDataFrame([(1, "a b", "x", 1, 1, 1, 1)], bare.schema)
    assert token_counts.token_counts(row).first().n_tokens == 2 and len(bpe_codec.coded(row).first().ids) == 8
    one = spark.createDataFrame([(1, [1.0, 0.0], 1, 1, 1), (2, [1.0, 0.01], 1, 1, 1)], vector.schema)
    assert {(r.vec_id, r.n_links, r.component_id) for r in vectors.linked(one).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_long_texts_are_searched_and_joined_whole(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-10] + ["end"] * 10)), (3, " ".join(words[10_000:]))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(words[4090:4102])), (2, " ".join(words[-10:]))], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (20_000, 22, 2), 2: (20_000, 12, 1), 3: (10_000, 10, 1)}
    assert {r.doc_id: (r.n_links, r.class_id) for r in shingles.joined(docs).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def test_gradients():
    rng = np.random.default_rng(0)
    net = quality.Network(1)
    net.p["out"][:] = rng.normal(size=net.p["out"].shape)
    data = rng.integers(0, 256, 1500).astype(np.uint8)
    codes, doc = quality.chunks(data, np.array([0, 700, 1500]))
    y, w = np.array([0.0, 1.0], np.float32), np.ones(2, np.float32)

    def loss():
        z = np.log(1 / net.score(data, np.array([0, 700, 1500])) - 1) * -1
        return np.mean(np.logaddexp(0, z) - y * z)

    g = net.gradients(codes, doc, y, w)
    for name in ("out", "hidden", "conv", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.05 * abs(g[name][at]) + 1e-3
