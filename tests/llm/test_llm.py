"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, caps, media, minhash, packing, passages, repair, secrets, toxicity, warc
from sparkloom.llm.common import likely
from sparkloom.llm.components import components

SF = "/root/testdata/sf0.001"
#: Columns whose names operators use inside.
CLASH = ("key", "rep", "component", "id", "seed", "doc", "batch", "score", "_id", "words", "label", "n")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def edge_texts():
    base = words(90, 1)
    near = base.split()
    near[40] = "changed"
    return {1: base, 2: base, 3: " ".join(near), 4: None, 5: "", 6: "  \n\t ", 7: "two words", 8: "TWO words", 9: words(30_000, 2), 10: "é" * 50 + " ß", 11: words(5, 3), 12: "<|endoftext|> a  b"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*edge_texts().items(), (7, "two words"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in CLASH if c != "doc_id"})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def reachable(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rng = random.Random(5)
    edges = [(a, a + 1) for a in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = reachable({i for e in real for i in e}, real)
    assert got == want
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# op 10


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_of_edge_texts(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, 80).collect()}
    texts = edge_texts()
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert all(by_id[i][1] == len(shingles(t)) for i, t in texts.items())
    assert {i: by_id[i][2] for i in texts} == {i: {2: 1, 3: 1, 8: 7}.get(i, i) for i in texts}
    assert (None, 1, None, True) in got
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for group in range(6):
        base = words(rng.randint(20, 200), group).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = reachable(sets, links)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == want


def test_ids_of_several_sets_are_on_their_own(spark):
    base = words(60, 3)
    rows = [(1, base), (1, base), (2, base), (2, words(50, 4)), (3, base), (4, base), (4, None), (5, None), (5, "")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True)]


def test_odd_sketches_estimate():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    for share in (0.95, 0.85, 0.7):
        k = int(1000 * 2 * share / (1 + share))
        b = np.concatenate([a[:k], rng.integers(0, 2**63, 1000 - k, dtype=np.uint64)])
        x, y = minhash.odd_sketch(minhash._samples([np.unique(a), np.unique(b)])).view(np.uint64)
        flips = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + minhash.BITS / (4 * minhash.HASHES) * np.log(1 - 2 * flips / minhash.BITS)
        assert abs(estimate - share) < 0.1


# op 1


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 16))
    x = centres[rng.integers(0, 8, 300)] + 0.12 * rng.standard_normal((300, 16))
    rows = [(k, [float(v) for v in x[k]], k % 3) for k in range(300)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, rows[0][1][:5], 0), (906, [], 0), (907, [float("inf")] * 16, 2), (908, [v * 1e200 for v in rows[0][1]], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("vector", F.lit(1)).withColumn("filter", F.lit(2))
    got = {r.vec_id: r for r in caps.similar_vectors(df).collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in [*rows, (908, rows[0][1], 0)]}
    label = {i: y for i, _, y in [*rows, (908, None, 0)]}
    links = [(a, b) for a, b in itertools.combinations(u, 2) if label[a] == label[b] and u[a] @ u[b] >= 0.98]
    want = reachable(u, links)
    assert len(links) > 100
    for i in u:
        assert (got[i].n_links, got[i].component_id) == (sum(i in e for e in links), want[i])
    for i in (900, 901, 902, 903, 904, 905, 906, 907, None):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert caps.similar_vectors(df.limit(0)).count() == 0


def test_list_decoding_finds_every_exceeding_filter():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((50, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = caps.block_scores(x, 7)
    bounds = rng.uniform(-0.1, 0.4, 50)
    whole = (scores[0][:, :, None] + scores[1][:, None, :]).reshape(50, -1)
    row, number = caps.exceeding_filters(scores, bounds)
    assert set(zip(row.tolist(), number.tolist(), strict=True)) == {(int(a), int(b)) for a, b in zip(*np.nonzero(whole >= bounds[:, None]), strict=True)}
    assert (caps.best_filters(scores)[0] == whole.argmax(1)).all()


def test_probes_are_few_and_meet_every_link():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # Partners at exactly the threshold, in random directions.
    e = rng.standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    for codewords, share in ((9, 0.25), (40, 0.05)):
        (f, s), (g, r) = (caps.best_filters(caps.block_scores(v, codewords)) for v in (x, y))
        row, number = caps.exceeding_filters(caps.block_scores(x, codewords), caps.probe_bounds(s, 0.98, 64))
        back, there = caps.exceeding_filters(caps.block_scores(y, codewords), caps.probe_bounds(r, 0.98, 64))
        assert len(row) < share * codewords**2 * len(x)
        met = set(zip(row.tolist(), number.tolist(), strict=True)), set(zip(back.tolist(), there.tolist(), strict=True))
        assert all((k, f[k]) in met[1] if s[k] > r[k] else (k, g[k]) in met[0] for k in range(len(x)))


def test_equal_vectors_count_once_for_each_row(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, w, 0), (3, [5.0, -1.0, 0.0], 0), (4, v, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in caps.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 3, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 1, False), (3, 3, 1, False), (4, 0, 4, True)]


# ops 3 and 8


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_is_the_library(tokenizer):
    rng = random.Random(3)
    letters = list("aabbcc  \n\t'sll 're0123€é中   !!??aaaaaa") + ["<|endoftext|>", "ha", "  ", "\n\n", "\x85", "\x1c", " "]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(2000)] + ["", "a" * 5001, " " * 77, "<|endoftext|>", "x<|endoftext|> <|endoftext|>y"]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.Encoder(bpe.bpe(bpe.vocabulary_path()).encode_chunks), repair.library_encoder(bpe.vocabulary_path())):
        assert [x.tolist() for x in encoder(texts[:700])] == want[:700]
        assert [x.tolist() for x in encoder(texts)] == want
    model = bpe.bpe(bpe.vocabulary_path())
    assert [model.decode(x) for x in want] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_columns(docs, none, tokenizer):
    rows = bpe.round_trip_digests(docs).collect()
    assert len(rows) == docs.count()
    texts = edge_texts()
    for r in rows:
        if r.doc_id in texts:
            text = texts[r.doc_id] or ""
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text", "score"))).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.round_trip_digests(none).count() == 0


def test_repair_shards(docs, none, tokenizer):
    index = repair.write_ids(docs)
    got = repair.id_digests(index).collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    lists = {r.start: r.ids for r in repair.read_ids(index).collect()}
    assert all(zlib.crc32(np.array(lists[s], "<u4").tobytes()) == c for _, s, _, c in want)
    some = {(r.doc_id, r.start): r.ids for r in repair.read_ids(index, [2, 9, 12, 404]).collect()}
    assert some == {(d, s): lists[s] for d, s, _, _ in want if d in (2, 9, 12)}
    assert repair.read_ids(index, []).count() == 0
    assert repair.id_digests(repair.write_ids(none)).count() == 0


def test_grammars_are_lossless():
    rng = np.random.default_rng(7)
    for n, most in itertools.product((0, 1, 2, 9, 5000), (1, 2, 40)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        g = repair.grammar(ids)
        assert (repair.expand(*g) == ids).all()
        for a, b in ((0, n), (n // 3, n // 2), (max(n - 1, 0), 1)):
            assert (repair.expand_range(*g, a, b) == ids[a : a + b]).all()
    for ids in (np.tile(rng.permutation(50), 400), rng.zipf(1.4, 30_000) % 300, np.zeros(10_000, int)):
        terminals, rules, symbols = repair.grammar(ids.astype(np.uint32))
        pairs = {}
        at = 0
        while at + 1 < len(symbols):
            pairs[symbols[at], symbols[at + 1]] = pairs.get((symbols[at], symbols[at + 1]), 0) + 1
            at += 2 if at + 2 < len(symbols) and symbols[at] == symbols[at + 1] == symbols[at + 2] else 1
        # Replacement has gone on until no pair is frequent.
        assert max(pairs.values(), default=0) < repair.LEAST and len(rules)
        assert (repair.expand(terminals, rules, symbols) == ids).all()


# op 6


def test_media(docs, none):
    rows = media.media_digests(docs).collect()
    assert len(rows) == docs.count()
    texts = edge_texts()
    for r in rows:
        if r.doc_id in texts:
            raw = (texts[r.doc_id] or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            stored = media.wav_header(len(payload)) + payload
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
            assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert media.media_digests(none).count() == 0


def test_cuts_follow_the_content():
    data = np.random.default_rng(0).bytes(300_000)
    a, b = media.cuts(data), media.cuts(b"x" * 777 + data)
    assert len({x + 777 for x in a} & set(b)) > 0.8 * len(a)
    sizes = np.diff([0, *a])
    assert sizes.max() <= media.MOST and (sizes[:-1] >= media.LEAST).all() and sum(sizes) == len(data)


# op 9


def test_warc(spark):
    long = "<p>é" + "x" * 1500
    rows = [(1, "u", long), (2, None, long), (3, "ü b", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 1_000_000), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("file", F.lit(2))
    index = warc.write_warc(df)
    got = {r.page_id: r for r in warc.read_warc(index).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = i in (1, 2)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert (None if got[i].payload is None else bytes(got[i].payload)) == (None if revisit else raw)
    assert warc.read_warc(index.where("page_id = 4")).count() == 1
    assert warc.read_warc(warc.write_warc(df.limit(0))).count() == 0


def test_warc_of_a_page_crawled_twice(spark):
    old, new, third = "o" * 1500, "n" * 1500, "t" * 1500
    # Page 1 revisits page 3 with one payload, is a response with another, and the response that page 0 revisits.
    rows = [(1, "u", old), (3, "u", old), (1, "u", new), (0, "u", new), (1, "u", "short"), (1, "u", third), (2, "u", third), (1, "u", None)]
    index = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"))
    sha = {h: hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
    want = [(1, sha[old], "revisit", 3), (3, sha[old], "response", None), (1, sha[new], "response", None), (0, sha[new], "revisit", 1), (1, sha["short"], "response", None), (1, sha[third], "revisit", 2), (2, sha[third], "response", None), (1, sha[None], "response", None)]
    got = [(r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(index).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# op 4


def test_passages(spark, docs, none):
    shared, other = words(70, 50), words(55, 51)
    edited = shared.split()
    edited[20:22] = ["new"]
    texts = {20: words(40, 60) + " " + shared + " " + words(30, 61), 21: words(33, 62) + "\n" + shared + "\t" + words(20, 63), 22: " ".join(edited) + " " + words(90, 64), 23: words(200, 65), 24: words(30, 66) + " " + other, 25: other + " " + words(45, 67), 26: words(40, 68) + " " + " ".join(shared.split()[:30])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("n_chars", F.length("text"))
    found = passages.repeated_passages(df).collect()
    assert {i for r in found for i in (r.doc_id, r.other_id)} == {20, 21, 22, 24, 25}
    exact = next(r for r in found if (r.doc_id, r.other_id) == (21, 20))
    assert (exact.start_word, exact.end_word, exact.other_start, exact.equal_words) == (33, 103, 40, 70)
    left = {r.doc_id: r for r in passages.deduplicated(df, spark.createDataFrame(found)).collect()}
    assert left[20].text == texts[20] and left[23].text == texts[23] and left[26].text == texts[26]
    assert left[21].text == words(33, 62) + "\n" + words(20, 63)
    assert all(len(r.text) == r.n_chars for r in left.values())
    small = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.other_id) for r in small} >= {(2, 1), (3, 1)} and {r.doc_id for r in small} == {2, 3}
    assert passages.repeated_passages(none).count() == 0


def test_every_shared_run_is_found(table):
    df = table("documents")
    texts = {r.doc_id: r.text.encode().lower().split() for r in df.collect()}
    holders = {}
    for i, w in texts.items():
        for k in range(len(w) - 50):
            holders.setdefault(tuple(w[k : k + 51]), set()).add(i)
    want = {i for h in holders.values() if len(h) > 1 for i in h}
    found = passages.repeated_passages(df).collect()
    assert want <= {i for r in found for i in (r.doc_id, r.other_id)}


def shared_words(texts):
    """The places of each text that lie in 50 words which a text of a smaller number holds too."""
    holders = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    return {(i, p) for h in holders.values() for i, k in h if i > min(h)[0] for p in range(k, k + 50)}


def test_texts_that_no_chain_asks_for_are_not_shuffled(spark):
    rows = spark.range(20_000).select("id", F.col("id").cast("string").alias("text")).union(spark.sql("select null, 'no id'"))
    ids = spark.range(7, 20_000, 97).select((F.col("id") + 0).alias("id"))
    got = likely(rows.withColumnRenamed("id", "doc_id"), "doc_id", ids)
    found = [r.doc_id for r in got.collect()]
    assert got.columns == ["doc_id", "text"] and len(found) == len(set(found)) < 2 * 207 and set(range(7, 20_000, 97)) <= set(found)
    assert likely(rows, "id", ids.limit(0)).count() == 0
    docs = rows.select(F.col("id").alias("doc_id"), "text")
    chains = spark.createDataFrame([(1, 0, 0, [0, 9], [0, 9])], "doc long, other long, number int, xs array<int>, ys array<int>")
    slices = passages._slices(docs, chains)
    assert slices.count() == 2 and "_bits" in slices._jdf.queryExecution().toString()


def test_passages_of_frequent_lines(spark):
    rng = random.Random(11)
    lines = [words(rng.randint(12, 30), 900 + k) for k in range(12)]
    texts = {}
    # The lines stand alone in the first and last documents; runs of them only in those between.
    for k, line in enumerate(lines):
        for i in (k, 500 + k):
            texts[i] = f"{words(40, i)} {line} {words(40, 1000 + i)}"
    for i in range(100, 130):
        at = rng.randrange(8)
        texts[i] = f"{words(rng.randint(0, 60), i)} {' '.join(lines[at : at + rng.randint(2, 5)])} {words(30, 2000 + i)}"
    # An equal run whose seeds stand elsewhere but for one in the middle.
    run = words(400, 77).split()
    texts[200] = texts[201] = " ".join(run)
    for k in range(0, 400, 30):
        for i in (20 + k // 30, 600 + k // 30):
            texts[i] = f"{words(40, 3000 + i)} {' '.join(run[k : k + 45])} {words(40, 4000 + i)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = passages.repeated_passages(df).collect()
    raw = {i: t.encode().lower().split() for i, t in texts.items()}
    covered = {(r.doc_id, p) for r in found for p in range(r.start_word, r.end_word)}
    assert shared_words(raw) <= covered
    for r in found:
        if r.equal_words == r.end_word - r.start_word == r.other_end - r.other_start:
            assert raw[r.doc_id][r.start_word : r.end_word] == raw[r.other_id][r.other_start : r.other_end]


def test_passages_that_stand_twice(spark):
    shared, line = words(60, 80), words(12, 81)
    with_line = " ".join([*words(24, 82).split(), *line.split(), *words(18, 83).split()])
    texts = {
        1: f"{words(30, 84)} {shared} {words(30, 85)}",
        2: f"{shared} {words(40, 86)} {shared} {words(9, 87)} {shared}",
        3: f"{words(12, 88)} {with_line}",
        4: f"{line} {words(33, 89)} {line} {words(20, 90)} {with_line} {words(8, 91)}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = passages.repeated_passages(df)
    raw = {i: t.encode().lower().split() for i, t in texts.items()}
    covered = {(r.doc_id, p) for r in found.collect() for p in range(r.start_word, r.end_word)}
    assert shared_words(raw) <= covered
    left = {r.doc_id: r.text for r in passages.deduplicated(df, found).collect()}
    assert left[1] == texts[1] and left[3] == texts[3]
    assert left[2].split() == f"{words(40, 86)} {words(9, 87)}".split()
    assert left[4].split() == f"{line} {words(33, 89)} {line} {words(20, 90)} {words(8, 91)}".split()
    # The same with the copies in the smaller document: nothing of it goes, every place is reported.
    turned = spark.createDataFrame([(1, texts[2]), (2, texts[1])], "doc_id long, text string")
    places = {(r.other_start, r.other_end) for r in passages.repeated_passages(turned).collect()}
    assert places == {(0, 60), (100, 160), (169, 229)}


def best_chain(x, y):
    """The best score of a chain, by trying all."""
    n = len(x)
    score = [0.0] * n
    for i in sorted(range(n), key=lambda k: (x[k], y[k])):
        steps = [score[j] - passages.GAP_COST / 2 * (x[i] - x[j] + y[i] - y[j]) for j in range(n) if x[j] < x[i] and y[j] < y[i]]
        score[i] = passages.K + max([0.0, *steps])
    return max(score)


def test_chains_are_the_best(spark):
    rng = np.random.default_rng(6)
    for _ in range(150):
        n = int(rng.integers(1, 25))
        x, y = np.sort(rng.integers(0, 120, n)), rng.integers(0, 120, n)
        if rng.random() < 0.4:
            x, y = np.unique(x), np.sort(rng.choice(120, len(np.unique(x)), replace=False))
        parts = passages.chain(x, y)
        assert sorted(k for p in parts for k in p) == list(range(len(x)))
        first = parts[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in itertools.pairwise(first))
        got = passages.K * len(first) - passages.GAP_COST / 2 * (x[first[-1]] - x[first[0]] + y[first[-1]] - y[first[0]])
        assert got == pytest.approx(best_chain(x.tolist(), y.tolist()))


def common_words(a, b):
    row = [0] * (len(b) + 1)
    for w in a:
        before = 0
        for j, v in enumerate(b, 1):
            row[j], before = (before + 1 if w == v else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_edited_passages(spark):
    """Passages of 80 words with words replaced, left out and put in: at least 0.9 of those that keep LEAST_SHARE are found."""
    rng = random.Random(13)
    vocabulary = words(4000, 400).split()
    rows, meant = [], {}
    for rate in (0.0, 0.03, 0.06, 0.1, 0.15):
        for kind in ("replaced", "mixed"):
            for _ in range(25):
                passage = rng.choices(vocabulary, k=80)
                copy = []
                for w in passage:
                    what = rng.random() if kind == "mixed" else 0.0
                    if rng.random() >= rate:
                        copy.append(w)
                    elif what < 0.5:
                        copy.append("new" + rng.choice(vocabulary))
                    elif what < 0.75:
                        copy += [w, "more" + rng.choice(vocabulary)]
                i = len(rows)
                rows += [(i, " ".join([*rng.choices(vocabulary, k=70), *passage, *rng.choices(vocabulary, k=90)])), (i + 1, " ".join([*rng.choices(vocabulary, k=40), *copy, *rng.choices(vocabulary, k=60)]))]
                same = common_words(passage, copy)
                if same >= passages.MIN_WORDS and same >= passages.LEAST_SHARE * max(len(passage), len(copy)):
                    meant.setdefault(rate, []).append(i + 1)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.doc_id, r.other_id) for r in found}
    assert all(b == a - 1 and a % 2 for a, b in pairs)
    for rate, ids in meant.items():
        assert sum((i, i - 1) in pairs for i in ids) >= 0.9 * len(ids), rate


def test_ids_of_several_texts_and_clashing_columns(spark):
    shared = words(80, 31)
    rows = [(1, shared), (2, words(20, 32) + " " + shared), (2, words(90, 33)), (3, shared + " " + words(9, 34)), (3, shared + " " + words(9, 34))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(k) for k, c in enumerate(("id", "spans", "_id", "_spans", "c0", "key", "words", "place"))})
    found = passages.repeated_passages(df)
    assert {(r.doc_id, r.start_word, r.end_word, r.other_id) for r in found.collect()} == {(3, 0, 80, 1)}
    left = passages.deduplicated(df, found)
    assert left.columns == df.columns
    assert sorted((r.doc_id, len(r.text.split())) for r in left.collect()) == [(1, 80), (2, 90), (2, 100), (3, 9), (3, 9)]


def test_chains_climb():
    x, y = np.array([0, 10, 20, 30, 200]), np.array([100, 110, 50, 130, 131])
    assert passages.chain(x, y)[0] == [0, 1, 3]


# op 5


def test_secrets(spark, docs, none):
    model = secrets.train(secrets.example_findings(spark))
    held = secrets.judged(secrets.example_findings(spark, 9000).where(F.pmod(F.xxhash64("text"), F.lit(7)) == 0), ["is_secret"], model).toPandas()
    assert ((held.confidence >= 0.5) == (held.is_secret == 1)).mean() > 0.97
    key, sha = hashlib.sha1(b"k").hexdigest(), hashlib.sha1(b"c").hexdigest()
    rows = [(1, f'the token = "{key}" is'), (2, f"see commit {sha} there"), (3, None), (4, ""), (5, f"{key} " * 3), (6, "plain words only"), (None, f'token = "{key}"')]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "secret": F.lit("s"), "n_chars": F.length("text")})
    found = secrets.secrets(df, model)
    assert {(r.doc_id, r.secret) for r in found.where("doc_id is null or doc_id < 5").collect()} == {(1, key), (None, key)}
    out = {r.doc_id: r for r in secrets.redacted(df, found).collect()}
    assert out[1].text == f'the token = "{secrets.MASK}" is' and out[2].text == rows[1][1] and out[3].text is None
    assert out[1].n_chars == len(out[1].text) and len(out) == len(rows)
    assert secrets.secrets(none, model).count() == 0 and secrets.secrets(docs, model).count() == 0


# op 7


def test_toxicity(spark, docs, none):
    rng = random.Random(8)
    bad = ["grumfle", "snotwick", "blurgard"]
    rows, labels = [], []
    for i in range(900):
        w = words(40, i).split()
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    hidden = [(2000, "gr0mfle".replace("0", "u") + " word"), (2001, words(20, 5) + " s n o t w i c k " + words(9, 6)), (2002, words(9, 7) + " blurg@rd"), (2003, words(9, 8) + " grummmmfle"), (2004, words(30, 9)), (2005, None), (2006, "")]
    df = spark.createDataFrame(rows + hidden, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(1)})
    y = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, y).collect()}
    held = [i for i, _ in labels if toxicity.is_held_out(i)]
    assert all(got[i].held_out == (i in set(held)) for i, _ in labels)
    assert np.mean([got[i].predicted == int(i % 3 == 0) for i in held]) > 0.97
    assert all(got[i].predicted == 1 for i in (2000, 2001, 2002, 2003))
    assert all(got[i].predicted == 0 for i in (2004, 2005, 2006))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.toxicity(docs, y.limit(0)).count() == docs.count()
    assert toxicity.toxicity(none, y).count() == 0


def test_what_a_task_keeps_of_words_is_bounded():
    held = toxicity._Words(np.zeros((toxicity.SIZE,) * 3), np.empty(0, np.int64), np.empty(0))
    most = 0
    for k in range(8):
        texts = [f"word{k}x{i} again" for i in range(60_000)]
        x = held.evidence_of(texts)
        assert x.shape == (60_000, 2) and not x.any()
        most = max(most, sum(sys.getsizeof(x) + sum(map(sys.getsizeof, x)) for x in vars(held).values() if isinstance(x, dict)))
    assert most < 30e6


def test_combined_disguises_are_read(spark):
    plain = "idiot clown ass shit " * 30 + words(300, 12)
    model = toxicity.character_model(spark.createDataFrame([(plain,)], "text string"))
    for raw, meant in (("i d ! o t", "idiot"), ("s h ! t", "shit"), ("!diot", "idiot"), ("(lown", "clown"), ("a$$", "ass"), ("@$$", "ass"), ("iiddiioott", "idiot"), ("idiiot", "idiot"), ("! d i 0 t", "idiot")):
        assert meant in [w for r in toxicity.readings(toxicity.raw_words(raw), model) for w in r], raw
    assert toxicity.readings(["clown!", "2024", "***"], model)[0][0] == "clown" and toxicity.readings(["2024", "***"], model) == [["2024"], []]


def test_readings_are_the_likeliest_of_the_lattice(spark):
    model = toxicity.character_model(spark.createDataFrame([("idiot clown ass trash fool " * 20 + words(400, 14),)], "text string"))
    rng = random.Random(15)

    def cost(parts):
        total, x, y = sum(p for _, p in parts), 0, 0
        for c in "".join(m for m, _ in parts) + " ":
            z = 0 if c == " " else toxicity._CODE.get(c, toxicity.SIZE - 1)
            if z or y:
                total += model[x, y, z]
                x, y = (y, z) if z else (0, 0)
        return total

    for _ in range(200):
        raw = "".join(rng.choices("idots1@$!*0-aa", k=rng.randint(1, 7)))
        lattice = toxicity._options(raw)
        ways = [(cost(parts), "".join(m for m, _ in parts).split()) for parts in itertools.product(*lattice)]
        least = min(c for c, _ in ways)
        assert toxicity.restored(raw, model) in [w for c, w in ways if c <= least + 1e-9]
    doubled = [w[:k] + w[k] + w[k:] for w in ("idiot", "clown", "abcdef", "fool") for k in range(len(w)) if w[k] not in w[:k] + w[k + 1 :]]
    doubled = [w for w in doubled if len(toxicity._TWICE.findall(w)) == 1]
    assert [[x] for x in toxicity._once(doubled, model)] == [toxicity.restored(w, model, 2) for w in doubled]


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01


def test_columns_of_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "some words", "a", 5), (2, None, "b", 6)], "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit("kept") for c in ("score", "restored", "ids", "decoded", "_id", "_secrets", "secrets", "id", "c0", "c1", "made")})
    model = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    clean = model.clean(df)
    assert clean.columns == df.columns and [r.score for r in clean.collect()] == ["kept"] * 2
    scored = model.score(df)
    assert scored.columns.count("score") == 1 and all(0 <= r.score <= 1 for r in scored.collect())
    assert {r.doc_id: r.restored for r in toxicity.restored_text(df, model.characters).collect()} == {1: "some words", 2: ""}
    back = bpe.decode(bpe.encode(df)).collect()
    assert {r.doc_id: r.decoded for r in back} == {1: "some words", 2: ""} and all(r.score == "kept" for r in back)
    out = secrets.redacted(df, spark.createDataFrame([(1, "words")], "doc_id long, secret string"))
    assert out.columns == df.columns and {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (f"some {secrets.MASK}", 13), 2: (None, 6)}


def test_odd_words_are_read_in_time():
    model = np.ones((toxicity.SIZE,) * 3)
    for w in ("_" * 5000, "*" * 100_000 + "a", "a" + "_-" * 20_000 + "é", "a1" * 20_000, "%" * 9, "..a..b..", "@", "a" * 50_000):
        assert isinstance(toxicity.readings([w], model)[0], list)
    assert toxicity.stripped("((Word!!)") == "word" and toxicity.stripped("$tup1d!") == "$tup1d" and toxicity.stripped("of%%%") == "of"


# op 2


def test_buckets_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, b = int(rng.integers(1, 9)), int(rng.integers(1, 5))
        x, c = np.sort(rng.choice(40, n, replace=False)), rng.integers(1, 6, n)

        def padding(ends, x=x, c=c):
            return sum(int(k) * (min(e for e in ends if e >= v) - int(v)) for v, k in zip(x, c, strict=True))

        best = min(padding([*s, x[-1]]) for r in range(b) for s in itertools.combinations(x[:-1], r))
        ends = packing.bucket_lengths(x, c, b)
        assert len(ends) <= b and padding(ends) == best


def test_batches(docs, none):
    rows = packing.packed(docs, budget=100).collect()
    assert len(rows) == docs.count()
    texts = edge_texts()
    assert all(r.n_tokens == len((texts[r.doc_id] or "").encode().split()) for r in rows if r.doc_id in texts)
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert len({r.padded_length for r in b}) == 1 and all(r.n_tokens <= r.padded_length for r in b)
        assert sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].padded_length <= 100
    assert packing.packed(none).count() == 0


def test_batches_of_token_ids(spark):
    rng = random.Random(9)
    rows = [(k, [rng.randint(1, 99) for _ in range(rng.choice([0, 1, 5, 17, 300, 20_001]))]) for k in range(80)] + [(900, None), (None, [7])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumns({"place": F.lit(1), "batch_id": F.lit("x"), "n_tokens": F.lit(9)})
    got = packing.padded_batches(df, budget=1000).collect()
    seen = []
    for b in got:
        assert len(b.doc_ids) == 1 or len(b.doc_ids) * b.padded_length <= 1000
        assert max(map(sum, b.attention)) == b.padded_length
        for d, ids, mask in zip(b.doc_ids, b.input_ids, b.attention, strict=True):
            n = sum(mask)
            assert len(ids) == len(mask) == b.padded_length and mask == [1] * n + [0] * (len(mask) - n) and not any(ids[n:])
            seen.append((d, ids[:n]))
    assert sorted(seen, key=str) == sorted(((d, ids or []) for d, ids in rows), key=str)
    assert packing.padded_batches(df.limit(0)).count() == 0


# the shared folder


def test_shared_folder_without_a_setting(spark):
    from types import SimpleNamespace

    from sparkloom.llm import common

    def session(master, value=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: value or default), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}", _jsc=spark.sparkContext._jsc), _jvm=spark._jvm)

    one = common.shared_folder(session("local[2]"))
    assert one.startswith("file:///") and common.shared_folder(session("local[2]")) == one
    with pytest.raises(ValueError, match="share"):
        common.shared_folder(session("spark://host:7077"))
    assert common.shared_folder(session("spark://host:7077", "hdfs://host/x/")) == "hdfs://host/x"
    assert common.shared_folder(session("spark://host:7077", "/some/where")).startswith("file:/")


def test_only_small_tables_are_broadcast(spark):
    from sparkloom.llm import common

    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("s"), F.array(F.lit("ab")).alias("a"))
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(common.sized(df)) and not hinted(common.sized(df, 100_000))


def test_planted_secrets(spark):
    """Tokens planted in the documents, whatever stands around: all are found, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    planted = {(r.doc_id, m) for r in docs.where(F.lower("text").contains("token")).select("doc_id", "text").collect() for m in re.findall(r'(?i)\btoken = "([0-9a-f]{40})"', r.text)}
    found = {(r.doc_id, r.secret) for r in secrets.secrets(docs).collect()}
    assert len(planted) > 30 and len(planted & found) >= 0.99 * len(planted) and len(planted & found) >= 0.95 * len(found)


def plain_features(word, before, after):
    """The features of a candidate that is a whole word, computed another way."""
    def kind(c):
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else ""

    steps = sum(bool(kind(a)) and bool(kind(b)) and kind(a) != kind(b) for a, b in itertools.pairwise(word))
    covered, rest = 0, word.lower()
    while rest:
        hit = next((w for w in secrets.DICTIONARY if rest.startswith(w)), "")
        covered, rest = covered + len(hit), rest[max(len(hit), 1) :]
    said = " ".join(before[-2:]) + " "
    return {
        "length": len(word),
        "transitions": steps / len(word),
        "digits": sum(c.isdigit() for c in word) / len(word),
        "capitals": sum(c.isupper() for c in word) / len(word),
        "different": len(set(word)) / len(word),
        "dictionary": covered / len(word),
        "key_before": float(bool(re.search(secrets.KEY_WORDS, said))),
        "hash_before": float(bool(re.search(secrets.HASH_WORDS, said))),
        "key_after": float(bool(re.search(secrets.KEY_WORDS, after))),
        "hex_only": float(set(word) <= set("0123456789abcdef")),
    }


def test_features_of_candidates(spark):
    rng = random.Random(21)
    rows, want = [], {}
    for k in range(120):
        word = "".join(rng.choices(["a1", "Zx", "key", "9", "user", "F0", "b-", "data2"], k=rng.randint(8, 14)))
        before, after = rng.choices(["token", "the", "commit", "secret", "la", "uuid"], k=3), rng.choice(["password", "and", "then"])
        if re.fullmatch(r"[A-Za-z0-9+/_=\-]{16,}", word) and re.search("[0-9]", word):
            rows.append((k, " ".join([*before, word, after])))
            want[k] = plain_features(word, before, after)
    got = {r.k: r for r in secrets.candidates(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    assert set(got) == set(want) and len(want) > 60
    for k, features in want.items():
        for name, value in features.items():
            assert got[k][name] == pytest.approx(value), (k, name, got[k].secret)
