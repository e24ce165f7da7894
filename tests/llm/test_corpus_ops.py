"""Divergence audit, decontamination and ranked search against brute force; words that weak hashes took for equal."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, divergence, fmindex, maxtree, minhash, passages, repair
from sparkloom.llm import words as W

CLASH = ("key", "id", "n", "term", "spans", "items", "n_words", "rank", "score", "_spans")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def sentence(rng, n, letters="abcd"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 2))) for _ in range(n))


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


# op 11


def audit(rows, least, ranks):
    """rows: (lang, source, text)"""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= least)
        v = len(kept)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        everything = sum(count.values(), Counter())

        def share(c, t):
            return 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v)

        p = {s: {t: share(c, t) for t in kept} for s, c in count.items()}
        q = {t: share(everything, t) for t in kept}
        for s in count:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ü", None]), rng.choice([sentence(rng, 20), sentence(rng, 8, "xyzÄß"), "WORD" * 40 + " Word1word", "", None])) for _ in range(150)]
    rows += [("fr", "only", "a b"), ("it", "p", ""), ("it", "q", None), ("en", "hot", sentence(rng, 3000))] + rows[:20]
    docs = clashing(spark.createDataFrame(rows, "lang string, source string, text string").repartition(5))
    for least, ranks in ((3, 5), (30, 50)):
        got = sorted(tuple(r) for r in divergence.divergence(docs, least, ranks).collect())
        assert got == audit(rows, least, ranks)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([[0, 10**13], [7, 3]])
    want = [[1 + 10**9 * (c + 5) // (n + 50) for c, n in zip(row, (10**14, 10**14), strict=True)] for row in counts.tolist()]
    assert divergence.shares(counts, np.array([10**14, 10**14]), 10).tolist() == want


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    raw, _, first, last, _ = W.word_spans(pa.array(["alphabetical othersortof alphabetical abc alphabetisch"]))
    monkeypatch.setattr(divergence, "range_hashes", lambda raw, a, b: np.where(b - a > 7, np.uint64(1), np.uint64(2)))
    codes, one = divergence._numbered_terms(raw, first, last)
    assert [codes.tolist().index(c) for c in codes] == [0, 1, 0, 3, 4] and len(one) == 4


# op 12


def leaks(texts, items):
    """For each text: words, hit words, items."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = pattern.findall(lower(t))
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for t in texts:
        w = pattern.findall(lower(t))
        hit, of = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    of |= windows[x]
        out.append((len(w), hit, sorted(of)))
    return out


@pytest.mark.parametrize("sizes", [(1 << 20, 512, 8 << 20), (300, 16, 64)])
def test_contamination(spark, monkeypatch, sizes):
    monkeypatch.setattr(fmindex, "SHARD", sizes[0])
    monkeypatch.setattr(fmindex, "PIECE", sizes[1])
    monkeypatch.setattr(fmindex, "BLOCK_BYTES", sizes[2])
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.choice([4, 10, 13, 30]))) for k in range(20)] + [(20, None), (21, ""), (22, " ,.; "), (None, "lost words"), (3, sentence(rng, 12)), (100, "Same Text, as before here"), (101, "same text as BEFORE here")]
    texts = [sentence(rng, 60) for _ in range(40)] + [None, "", "...", "one", "same text as before here", "x" * 9000]
    texts += [f"{sentence(rng, 9)} {t.upper() if k % 2 else t}, {sentence(rng, 5)}" for k, (_, t) in enumerate(items) if t] + [sentence(rng, 4000) + " " + items[3][1] + " " + items[3][1]] * 2
    docs = clashing(spark.createDataFrame([(k // 2 if k else None, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(2))
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    rows = fmindex.contamination(docs, bench).collect()
    want = leaks([r.text for r in rows], [x for x in items if x[0] is not None])
    for r, (n, hit, of) in zip(rows, want, strict=True):
        covered = {w for s in r.spans for w in range(s.first_word, s.last_word)}
        assert (r.n_words, covered, r["items"]) == (n, hit, of)
        assert all(a.last_word < b.first_word for a, b in zip(r.spans, r.spans[1:], strict=False))
        for s in r.spans:
            piece = r.text.encode()[s.start : s.end].decode()
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(piece))) == s.last_word - s.first_word
    assert sum(bool(w[1]) for w in want) > 20 and any(not w[1] for w in want)
    clean = fmindex.decontaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(texts)
    assert {r.text for r in clean.where("text = '' or text is null or text = 'one'").collect()} >= {None, "", "one"}
    none = bench.limit(0)
    assert fmindex.contamination(docs, none).where("size(spans) > 0 or size(items) > 0").count() == 0
    assert fmindex.contamination(docs.limit(0), bench).count() == 0


def test_fm_index_against_search_in_plain():
    rng = np.random.default_rng(3)
    for n, most in ((1, 3), (50, 2), (3000, 3), (5000, 40)):
        row = rng.integers(0, most + 1, n)
        plain = row.tolist()
        index = fmindex.FmIndex(row, most)
        patterns = np.array([[-1] * (5 - m) + rng.integers(1, most + 1, m).tolist() for m in rng.integers(1, 6, 100)])
        for p, low, high in zip(patterns.tolist(), *index.search(patterns), strict=True):
            q = [x for x in p if x >= 0]
            want = [k for k in range(n - len(q) + 1) if plain[k : k + len(q)] == q]
            assert max(high - low, 0) == len(want)
            assert sorted(index.locate(np.arange(low, max(high, low))).tolist()) == want


# op 13


def best(rows, items, limit):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(pattern.findall(lower(t)))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(pattern.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c, n in docs:
            m = 10 + 90 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(64, 1 << 14, 8 << 20), (2, 25, 40)])
def test_ranked(spark, monkeypatch, sizes):
    monkeypatch.setattr(maxtree, "LEAF", sizes[0])
    monkeypatch.setattr(maxtree, "RANGE_DOCS", sizes[1])
    monkeypatch.setattr(maxtree, "BLOCK_BYTES", sizes[2])
    monkeypatch.setattr(maxtree, "FAN", 3)
    rng = random.Random(6)
    texts = [sentence(rng, rng.randint(1, 40), "abcdefg") for _ in range(300)] + ["", None, "...", "Ärger ÄRGER 12ab", "zz " * 5000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(k + 1000, texts[k % 7]) for k in range(60)] + [(None, "ab zz"), (5, texts[5])]
    items = [(k, sentence(rng, rng.randint(1, 12), "abcdefgh")) for k in range(12)] + [(50, None), (51, "?"), (None, "ab"), (52, "Ärger zz ZZ"), (53, "unknownterm"), (3, "ab ba")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(tuple(r) for r in maxtree.ranked(docs, bench, 4).collect())
    assert got == best(rows, [x for x in items if x[0] is not None], 4)
    assert maxtree.ranked(docs.limit(0), bench).count() == 0
    assert maxtree.ranked(docs, bench.limit(0)).count() == 0


# words


def thue_morse(doublings):
    one, two = "abba", "baab"
    for _ in range(doublings):
        one, two = one + two, two + one
    return one, two


def test_thue_morse_words_differ(spark):
    one, two = thue_morse(9)
    assert len(one) == 2048 and not set(W.word_hashes(one)) & set(W.word_hashes(two))
    shingles = minhash.shingle_sets(pa.array([one, two]), 5)
    assert not set(shingles[0]) & set(shingles[1])
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 85).collect()} == {1: 1, 2: 2, 3: 1}
    library = __import__("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in ((1, one), (2, two))}
    ids[3] = ids[1]
    for r in bpe.round_trip_digests(docs).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest()
    for r in repair.id_digests(repair.write_ids(docs)).collect():
        assert r.n_tokens == len(ids[r.doc_id]) + 1
    # Words by words: the texts share no run, though all their words are equal in pairs under a polynomial modulo 2**64.
    rows = [(k, " ".join(f"{w}{j}" for j in range(60))) for k, w in ((1, one), (2, two))]
    assert passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    same = rows + [(3, rows[0][1])]
    assert passages.repeated_passages(spark.createDataFrame(same, "doc_id long, text string")).count() > 0


def test_hashes_of_words_of_all_lengths():
    rng = random.Random(1)
    some = list({bytes(rng.choices(b"ab", k=n)) for n in (1, 6, 7, 8, 9, 13, 14, 15, 63, 64, 65, 66, 200, 1000) for _ in range(40)})
    raw, _, first, last, _ = W.word_spans(pa.array([b" ".join(some).decode()]))
    assert len(set(W.range_hashes(raw, first, last).tolist())) == len(some)
    known = W.Vocabulary(some[::2])
    assert known.find(raw, first, last).tolist() == [k // 2 if k % 2 == 0 else -1 for k in range(len(some))]


def test_chunks_of_one_hash_have_their_own_ids(monkeypatch):
    rng = random.Random(2)
    texts = [sentence(rng, 50, "abcdefghijklmnop") + " internationalisation organisations" for _ in range(20)]
    plain = bpe._hashes
    monkeypatch.setattr(bpe, "_hashes", lambda raw, a, b, x, y: np.where(b - a > 7, np.uint64(5), plain(raw, a, b, x, y)))
    encoder = bpe.Encoder(bpe.bpe(bpe.vocabulary_path()).encode_chunks)
    library = __import__("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    for _ in range(2):
        got = [x.tolist() for x in encoder(pa.array(texts))]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_of_fifty_words():
    h = np.random.default_rng(1).integers(0, 2**63, 200, dtype=np.uint64)
    runs = W.grams(h, 50)
    assert len(set(runs.tolist())) == 151
    assert all(W.grams(h[k : k + 50], 50)[0] == runs[k] for k in (0, 77, 150))


def test_edited_passages_of_frequent_parts(spark):
    """Passages of 96 words made of phrases of 16, each of which stands in an earlier document, with words replaced: at least 0.9 of those that keep LEAST_SHARE are found."""
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(5000)]
    for rate in (0.0, 0.06, 0.1, 0.15):
        rows, meant = [], []
        pairs = []
        for _ in range(60):
            phrases = [rng.choices(vocabulary, k=16) for _ in range(6)]
            rows += [" ".join([*rng.choices(vocabulary, k=30), *p, *rng.choices(vocabulary, k=30)]) for p in phrases]
            whole = [w for p in phrases for w in p]
            copy = [w if rng.random() >= rate else "new" + rng.choice(vocabulary) for w in whole]
            pairs.append((whole, copy))
        for whole, copy in pairs:
            i = len(rows)
            rows += [" ".join([*rng.choices(vocabulary, k=50), *t, *rng.choices(vocabulary, k=50)]) for t in (whole, copy)]
            if sum(a == b for a, b in zip(whole, copy, strict=True)) >= passages.LEAST_SHARE * len(whole):
                meant.append((i + 1, i))
        found = {(r.doc_id, r.other_id) for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
        share = sum(m in found for m in meant) / len(meant)
        print(rate, len(meant), share)
        assert share >= 0.9, rate
        assert all(b == a - 1 and b >= 360 for a, b in found)
