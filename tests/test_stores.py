"""Stored indexes, the versioned store, ingestion, and passes over sorted rows, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graph, ingest, neighbours, retrieval, search_index, spans
from sparkloom.sources import versioned
from sparkloom.streaming import stateful

# full text


def texts(n, seed, letters="abcde"):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(enumerate(texts(700, 1))) + [(900, ""), (901, None), (902, "Dragon dragon draco"), (903, "dragon fire"), (904, "draco fire fire")]
    return dict(rows), spark.createDataFrame(rows, "id long, text string").repartition(3)


@pytest.fixture(scope="module", params=[(32, 250_000, 4_000_000), (4, 500, 3000)])
def index(corpus, request):
    old = search_index.SLOT, search_index.FILE_ROWS, search_index.FOLDER_ROWS
    search_index.SLOT, search_index.FILE_ROWS, search_index.FOLDER_ROWS = request.param
    yield search_index.SearchIndex(search_index.tokenised(corpus[1].where("text is not null"), "id", "text"))
    search_index.SLOT, search_index.FILE_ROWS, search_index.FOLDER_ROWS = old


def bm25(docs, terms):
    words = {i: t.lower().split() for i, t in docs.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    out = Counter()
    for t in set(terms):
        df = sum(t in w for w in words.values())
        for i, w in words.items():
            if tf := w.count(t):
                out[i] += np.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


def test_the_best_documents_come_from_few_blocks(corpus, index):
    for terms, k in ((["aa"], 5), (["aa", "dragon", "e"], 10), (["absent"], 3), (["fire", "absent"], 10)):
        want = sorted(bm25(corpus[0], terms).items(), key=lambda x: (-x[1], x[0]))[:k]
        got = [(r.id, r.score) for r in index.top(terms, k).collect()]
        assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    assert {r.id: r.score for r in index.bm25(["aa", "e"], every=True).collect()}.keys() == {i for i, t in corpus[0].items() if t and {"aa", "e"} <= set(t.split())}
    if index.slots > 100:
        weights = index.weights(["aa"])
        assert index.open_slots(weights, [], 5, lambda b: index._scores(b, weights)).count() < index.slots / 5


def test_blocks_hold_every_posting_once(corpus, index):
    want = {(t, i, c) for i, text in corpus[0].items() if text for t, c in Counter(text.lower().split()).items()}
    rows = index.postings().collect()
    assert {(r.term, r.id, r.tf) for r in rows} == want and len(rows) == len(want)
    assert index.n == len(corpus[0]) - 1


def test_phrases_groups_and_exclusions(corpus, index):
    docs = {i: t.lower().split() for i, t in corpus[0].items() if t is not None}

    def holds(w, phrase):
        return any(w[k : k + len(phrase)] == phrase for k in range(len(w)))

    for groups, phrases, without in (([["aa", "bb"], ["e"]], [], ["cc"]), ([["a", "b"]], [["c", "d"]], []), ([], [["a", "a"]], ["b"]), ([], [["dragon", "dragon", "draco"]], [])):
        terms = [t for g in (*groups, *phrases) for t in g]
        scores = bm25(corpus[0], terms)
        fits = [i for i, w in docs.items() if all(set(g) & set(w) for g in groups) and all(holds(w, p) for p in phrases) and not set(without) & set(w)]
        want = sorted(fits, key=lambda i: (-scores[i], i))[:8]
        rows = index.ranked(groups, phrases, without, 8, window=5).collect()
        assert [r.id for r in rows] == want
        for r in rows:
            counts = [sum(x in terms for x in docs[r.id][k : k + 5]) for k in range(len(docs[r.id]))]
            best = max(c for k, c in enumerate(counts) if docs[r.id][k] in terms)
            assert r.start == min(k for k, c in enumerate(counts) if c == best and docs[r.id][k] in terms)


def test_words_are_corrected_from_stored_deletions(spark):
    rows = [(k, "adventure adventure dragon dragons wizard") for k in range(3)] + [(7, "dragoon")]
    index = search_index.SearchIndex(search_index.tokenised(spark.createDataFrame(rows, "id long, text string"), "id", "text"))
    for _ in range(2):
        assert index.corrected(["advanturre", "dragn", "wizards", "dragon", "adv", "zzzzzzz"]) == ["adventure", "dragon", "wizard", "dragon", "adv", "zzzzzzz"]
    assert [r.word for r in index.starting("Dr", 5).collect()] == ["dragon", "dragons", "dragoon"]
    assert index.starting("d", 5).count() == 0


def test_an_index_sees_rows_that_came_later(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "first word")], "id long, text string").write.parquet(path)
    assert search_index.index_of(spark.read.parquet(path), "id", "text").bm25(["word"]).count() == 1
    again = search_index.index_of(spark.read.parquet(path), "id", "text")
    assert again is search_index.index_of(spark.read.parquet(path), "id", "text")
    spark.createDataFrame([(2, "second word")], "id long, text string").write.mode("append").parquet(path)
    assert search_index.index_of(spark.read.parquet(path), "id", "text").bm25(["word"]).count() == 2


# neighbours


def test_neighbours_from_few_cells(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0]), (5004, [None] * 24)]
    index = neighbours.VectorIndex(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    assert index.n == 4000 and len(index.centres) == 20
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for q in range(0, 200, 20):
        want = np.argsort(1 - unit @ unit[q], kind="stable")[:20]
        got = index.nearest(x[q].tolist(), 20, share=0.2, least=4).collect()
        found += len(set(want.tolist()) & {r.id for r in got})
        assert got[0].id == q and all(abs(r.distance - (1 - unit[r.id] @ unit[q])) < 1e-9 for r in got)
        read = index.candidates(x[q].tolist(), 10_000, 4)
        assert {r.cell for r in read.select("cell").distinct().collect()} <= set(index.probed(x[q].tolist(), 4))
    assert found >= 190
    assert index.nearest([0.0] * 24, 5).count() == 0
    assert neighbours.VectorIndex(spark.createDataFrame([], "id long, v array<double>"), "id", "v").nearest([1.0], 5).count() == 0


def test_recall_on_the_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    index = neighbours.VectorIndex(v, "vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    ids = np.array(sorted(rows))
    unit = np.stack([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found = sum(len(set(ids[np.argsort(1 - unit @ unit[q], kind="stable")[:20]].tolist()) & {r.id for r in index.nearest(rows[ids[q]].tolist(), 20).collect()}) for q in range(10))
    assert found >= 190


# store


def chunk_rows(spark, item, n, word="text"):
    return spark.createDataFrame([(item, k, f"{word} {k}") for k in range(n)], "item_id string, chunk_index int, content string")


def vector_rows(spark, item, n, width=3, value=1.0):
    return spark.createDataFrame([(item, k, [value] * width) for k in range(n)], "item_id string, chunk_index int, embedding array<double>")


def test_chunks_and_vectors_are_seen_together_or_not_at_all(spark):
    store = versioned.chunk_store(spark)
    assert store.read("chunks") is None and store.versions() == []
    assert versioned.ingest_chunks(store, chunk_rows(spark, "a", 4), vector_rows(spark, "a", 4)) == 4
    for bad in (vector_rows(spark, "b", 3), vector_rows(spark, "b", 5), vector_rows(spark, "x", 4), vector_rows(spark, "b", 2).unionByName(vector_rows(spark, "b", 4).where("chunk_index > 1").withColumn("embedding", F.lit([1.0])))):
        with pytest.raises(ValueError):
            versioned.ingest_chunks(store, chunk_rows(spark, "b", 4), bad)
    with pytest.raises(ValueError):
        versioned.ingest_chunks(store, chunk_rows(spark, "b", 4), vector_rows(spark, "b", 4), width=7)
    assert store.latest() == 1 and store.read("chunks").count() == 4 and {r.item_id for r in store.read("items").collect()} == {"a"}
    versioned.ingest_chunks(store, chunk_rows(spark, "a", 2, "new"), vector_rows(spark, "a", 2))
    assert {r.content for r in store.read("chunks").collect()} == {"new 0", "new 1"}
    assert store.read("chunks", 1).count() == 4
    assert versioned.update_vectors(store, vector_rows(spark, "a", 9, 3, 5.0)) == 2
    assert {tuple(r.embedding) for r in store.read("chunks").collect()} == {(5.0, 5.0, 5.0)}


def test_a_crash_between_stage_and_commit_changes_nothing(spark, monkeypatch):
    store = versioned.chunk_store(spark)
    versioned.ingest_chunks(store, chunk_rows(spark, "a", 3))
    commit = versioned.Store.commit
    monkeypatch.setattr(versioned.Store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        versioned.ingest_chunks(store, chunk_rows(spark, "a", 9, "lost"))
    monkeypatch.setattr(versioned.Store, "commit", commit)
    again = versioned.chunk_store(spark, store.path)
    assert again.read("chunks").count() == 3 and again.read("items").first().chunks == 3
    # A manifest whose writer died over it is no version, and its number isn't used again.
    stream = store._fs.create(store._path(f"{store.path}/manifests/{2:012d}.json"), False)
    stream.write(bytearray(b'{"version": 2, "fol'))
    stream.close()
    assert again.latest() == 1
    assert versioned.ingest_chunks(again, chunk_rows(spark, "b", 1)) == 1 and again.versions() == [1, 3]


def test_of_two_writers_one_fails(spark):
    store = versioned.chunk_store(spark)
    one, two = store.stage(chunk_rows(spark, "a", 1), "chunks"), store.stage(chunk_rows(spark, "b", 1), "chunks")
    store.commit([one], 0)
    with pytest.raises(versioned.Conflict):
        store.commit([two], 0)
    assert {r.item_id for r in store.read("chunks").collect()} == {"a"}


def test_deletes_in_pages_and_compaction(spark):
    store = versioned.Store(spark, {"t": ["k"]})
    assert store.delete("t", F.lit(True)) == (0, 0)
    store.commit([store.stage(spark.range(2500).select(F.col("id").alias("k"), (F.col("id") % 5).alias("v")), "t")], 0)
    assert store.delete("t", F.col("v") < 4, 1000) == (2000, 2)
    store.upsert("t", spark.createDataFrame([(4, 77), (None, 1)], "k long, v long"))
    store.upsert("t", spark.createDataFrame([(None, 2)], "k long, v long"))
    rows = {(r.k, r.v) for r in store.read("t").collect()}
    assert len(rows) == 501 and (4, 77) in rows and (None, 2) in rows and (None, 1) not in rows
    before = store.latest()
    store.compact("t")
    assert {(r.k, r.v) for r in store.read("t").collect()} == rows and store.read("t", before).count() == 501
    with pytest.raises(ValueError):
        store.stage(spark.range(3), "t")


# ingestion


def plain_pages(pages, size, least, overlap):
    """Chunks of one item's pages (page, text), in ASCII."""
    out, held, ids = [], "", []

    def cut(text):
        t = text[:size]
        for marks in (["\n\n"], [". "], ["! "], ["? "], [".\n"], ["!\n"], ["?\n"]):
            for m in marks:
                if t.rfind(m) > size // 2:
                    return t.rfind(m) + len(m)
        return t.rfind(" ") + 1 if " " in t else size

    for page, text in pages:
        text = (text or "").strip()
        if not text:
            continue
        if held and len(held) + len(text) + 1 > 2 * size:
            out.append((held, list(ids)))
            held, ids = "", []
        held = f"{held}\n{text}" if held else text
        ids.append(f"p{page}")
        while len(held) > size:
            c = cut(held)
            out.append((held[:c], list(ids)))
            held = held[(c - overlap if c > overlap else c) or c :]
    if len(held) >= least and held:
        out.append((held, list(ids)))
    return out


def test_page_chunks(spark):
    rng = random.Random(3)
    items = {i: [(p, rng.choice([None, " ", "word " * rng.randint(1, 60), "Some text. " * rng.randint(1, 90), "a\n\nb" * 50, "x" * 700])) for p in range(rng.randint(0, 40))] for i in ("a", "b", "c")}
    rows = [(i, p, f"p{p}", t) for i, pages in items.items() for p, t in pages]
    rng.shuffle(rows)
    got = ingest.page_chunks(spark.createDataFrame(rows, "item_id string, page long, raw_id string, text string"), ingest.Sizes(200, 30, 400, 20)).orderBy("item_id", "chunk_index").collect()
    for i, pages in items.items():
        mine = [r for r in got if r.item_id == i]
        assert [(r.content, r.source_ids) for r in mine] == plain_pages(pages, 200, 30, 20)
        said = {p: (t or "").strip() for p, t in pages}
        for r in mine:
            assert r.content[-15:].strip() in said[r.page_end] + " " or "\n" in r.content[-16:]
            assert f"p{r.page_end}" in r.source_ids
    texts_ = ingest.page_chunks(spark.createDataFrame([("ä", 1, "p1", "äöü" * 500)], "item_id string, page long, raw_id string, text string"), ingest.Sizes(101, 0, 200, 11)).collect()
    assert {c for r in texts_ for c in r.content} == set("äöü")


def test_only_changed_pages_are_ingested_again(spark):
    store = versioned.Store(spark, {"raw": ["item_id", "page"], "chunks": ["item_id", "chunk_index"], "items": ["item_id"]})
    sizes = ingest.Sizes(50, 1, 100, 5)
    first = [("a", p, f"page {p} of a. " * 3) for p in range(6)] + [("b", 0, "only page"), ("b", 1, None)]
    frame = lambda rows: spark.createDataFrame(rows, "item_id string, page long, text string")
    pages, chunks = ingest.ingest_pages(store, frame(first), sizes)
    assert pages == 8 and chunks == store.read("chunks").count()
    assert ingest.ingest_pages(store, frame(first), sizes) == (0, 0)
    version = store.latest()
    assert ingest.ingest_pages(store, frame([("b", 0, "another page"), ("b", 1, None)]), sizes) == (1, 1)
    assert store.latest() == version + 2 and store.read("raw").count() == 8
    assert {r.content for r in store.read("chunks").where("item_id = 'b'").collect()} == {"another page"}
    # A page less, and a run that dies between the phases.
    with pytest.raises(RuntimeError):
        old = ingest.chunk_pending
        try:
            ingest.chunk_pending = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
            ingest.ingest_pages(store, frame(first[:5]), sizes)
        finally:
            ingest.chunk_pending = old
    assert {r.item_id: r.status for r in store.read("items").collect()} == {"a": "processing", "b": "ready"}
    assert ingest.chunk_pending(store, sizes) > 0 and store.read("raw").where("item_id = 'a'").count() == 5
    assert {r.item_id: (r.status, r.pages) for r in store.read("items").collect()} == {"a": ("ready", 5), "b": ("ready", 2)}
    ids = {i for r in store.read("chunks").where("item_id = 'a'").collect() for i in r.source_ids}
    assert ids == {f"a-p{p}" for p in range(5)}


def test_section_chunks(spark):
    rows = [
        (1, 0, 1, "CHAPTER ONE", True, "text", False), (1, 1, 1, "alpha " * 30, False, "text", False), (1, 2, 2, "Section A", True, "text", False), (1, 3, 2, "beta " * 30, False, "text", False),
        (1, 4, 2, "stat block " * 10, False, "block", True), (1, 5, 3, "Part Two", True, "text", False), (1, 6, 3, "gamma. " * 60, False, "table", True), (1, 7, 3, None, False, "text", False), (1, 8, 3, "tail", False, "text", False), (2, 0, 1, None, None, None, None),
    ]
    elements = spark.createDataFrame(rows, "item_id long, place int, page int, text string, header boolean, kind string, atomic boolean")
    got = ingest.section_chunks(elements, ingest.Sizes(100, 20, 160, 0)).orderBy("item_id", "chunk_index").collect()
    assert [(r.kind, r.section_path) for r in got][:3] == [("text", ["CHAPTER ONE"]), ("text", ["CHAPTER ONE", "Section A"]), ("block", ["CHAPTER ONE", "Section A"])]
    assert all(r.section_path == ["Part Two"] for r in got[3:]) and {r.kind for r in got[3:]} == {"table"}
    assert " ".join(r.content for r in got if r.kind == "table").count("gamma.") >= 60
    packed = [(1, k, 1, f"line number {k} here", False, "text", False) for k in range(40)]
    chunks = [r.content for r in ingest.section_chunks(spark.createDataFrame(packed, elements.schema), ingest.Sizes(100, 10, 160, 0)).orderBy("chunk_index").collect()]
    assert all(len(c) <= 160 for c in chunks)
    for a, b in zip(chunks, chunks[1:], strict=False):
        # Twelve per cent of the target, from a word on.
        rest = a[-12:].partition(" ")[2]
        assert b.startswith(rest)


def test_presets():
    assert ingest.Sizes() == ingest.Sizes(1200, 300, 2400, 150)
    assert ingest.Sizes.small() == ingest.Sizes(600, 150, 1200, 75) and ingest.Sizes.large() == ingest.Sizes(2400, 600, 4800, 300)
    assert ingest.Sizes.of_tokens() == ingest.Sizes(1200, 300, 2400, 160)


# passes over sorted rows


def test_one_key_holds_all_rows(spark):
    rng = random.Random(9)
    values = [rng.uniform(-60, 60) for _ in range(20_000)]
    rows = spark.createDataFrame([("hot", k, v) for k, v in enumerate(values)] + [(None, 1, 5.0), ("cold", 1, -500.0)], "g string, o long, v double").repartition(7)
    now, mean = 50.0, values[0]
    for v in values:
        now = max(min(now + v, 100.0), -100.0)
        mean = mean * 0.9 + v * 0.1
    got = {r.g: (r.final, r.n) for r in graph.clamped_fold(rows, "g", "o", "v", 50, -100, 100).collect()}
    assert got["hot"] == (pytest.approx(now, abs=1e-6), 20_000) and got[None] == (55.0, 1) and got["cold"] == (-100.0, 1)
    averages = {r.g: r.average for r in stateful.moving_average(rows, "g", "o", "v", 0.9, None).collect()}
    assert averages == {"hot": pytest.approx(mean), None: 5.0, "cold": -500.0}


def test_spans_of_one_group(spark):
    rng = random.Random(2)
    rows = [("g", s := rng.randint(0, 9000), s + rng.randint(0, 12), rng.randint(0, 20) / 20) for _ in range(3000)]
    kept = []
    for _, s, e, c in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if not any(a < e and s < b for _, a, b, _ in kept if a < b) or s >= e and not any(a < e and s < b for _, a, b, _ in kept):
            kept.append(("g", s, e, c))
    got = spans.without_overlaps(spark.createDataFrame(rows, "g string, s int, e int, c double"), "g", "s", "e", "c").collect()
    assert sorted(tuple(r) for r in got) == sorted(kept)


def test_long_chains_of_groups(spark):
    rows = [(k, m) for k in range(300) for m in (k, k + 1)] + [(1000, 5000), (1001, 5000), (2000, 7)]
    got = {r.m: r.g for r in spans.united(spark.createDataFrame(rows, "g long, m long"), "g", "m").collect()}
    assert got == {**dict.fromkeys(range(301), 0), 5000: 1000}


@pytest.mark.parametrize("batch", ["1", "10", "10000"])
def test_alerts_at_any_batch_size(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spark.createDataFrame([("a", 10 * k) for k in range(700)] + [("b", 5), (None, 1)], "k string, t long").select("k", F.timestamp_seconds("t").alias("t"))
        got = stateful.alerts_once(rows, "k", "t", 3600).groupBy("k").count().collect()
        assert {r.k: r["count"] for r in got} == {"a": 2, "b": 1, None: 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_preprocessed_search_corrects_both_sides(spark):
    docs = spark.createDataFrame([(k, "dragon fire" if k % 2 else "goblin gold") for k in range(20)], "id long, text string")
    index = search_index.SearchIndex(search_index.tokenised(docs, "id", "text"))
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "id long, v array<double>")
    asked = []

    def embed(text):
        asked.append(text)
        return spark.createDataFrame([([3.0, 1.0],)], "asked array<double>")

    rows = retrieval.preprocessed(index, vectors, "id", "v", "  Dragn\tGOLD ", embed, {"gold": ["fire"]}, retrieval.Hybrid(0.5, 0.5, 5, 0.0)).collect()
    assert asked == ["dragon gold"] and len(rows) == 5 and rows[0].id == 3


def test_an_index_is_written_without_a_sort_before_its_shuffle(spark):
    # Up to 200 files the shuffle's writer keeps no rows in memory, so it can't spill.
    rows = spark.range(6000).select(F.concat(F.lit("w"), (F.col("id") % 900).cast("string")).alias("k"), "id")
    kept = search_index.Sorted(rows, "k", ["id"], [], 300 * search_index.FILE_ROWS, "few-files")
    assert kept.folders > 1 and len(kept.rows().inputFiles()) <= 200 and kept.rows().count() == 6000
    assert {r.id for r in kept.of(["w7", "w11"]).collect()} == {k for k in range(6000) if k % 900 in (7, 11)}


def test_few_rows_of_a_frequent_term_are_shuffled(spark):
    index = search_index.SearchIndex(search_index.tokenised(spark.createDataFrame([(k, "one two one") for k in range(640)], "id long, text string").coalesce(1), "id", "text"))
    assert index.blocks.rows().count() == 2 * 640 // search_index.SLOT
    held = search_index._opened(index.blocks.of(["one"]), positions=True).collect()
    assert {r.id for r in held} == set(range(640)) and {(r.tf, r.size, *r.positions) for r in held} == {(2, 3, 0, 2)}
    assert {(r.word, r.n) for r in index.dictionary().collect()} == {("one", 1280), ("two", 640)}


def test_words_are_corrected_without_a_table_of_deletions(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcé", k=rng.randint(3, 11))) for _ in range(400)})
    rows = [(k, f"{w} " * rng.randint(2, 4)) for k, w in enumerate(words)]
    index = search_index.SearchIndex(search_index.tokenised(spark.createDataFrame(rows, "id long, text string"), "id", "text"))
    counts = {r.word: r.n for r in index.dictionary().collect()}
    # Nothing is written for a query.
    monkeypatch.setattr(search_index, "Sorted", None)
    monkeypatch.setattr(search_index, "stored", None)
    asked = ["".join(rng.choices("abcé", k=rng.randint(4, 11))) for _ in range(80)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def nearest(word):
        if len(word) < 5 or word in counts:
            return word
        near = [(d, -n, w) for w, n in counts.items() if len(w) >= 4 and (d := edits(word, w)) <= (1 if len(word) < 9 else 2)]
        return min(near, key=lambda x: (x[:2], x[2].encode()))[2] if near else word

    got = index.corrected(asked)
    assert got == [nearest(w) for w in asked] and sum(a != b for a, b in zip(asked, got, strict=True)) > 10


def test_rows_of_the_last_deletions_are_read_without_a_join(spark):
    store = versioned.Store(spark, {"raw": ["k"]})

    def joins():
        return store.read("raw")._jdf.queryExecution().optimizedPlan().toString().count("Join")

    def held():
        return "".join(sorted(r.v for r in store.read("raw").collect()))

    store.upsert("raw", spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string"))
    assert joins() == 0 and held() == "abc"
    store.upsert("raw", spark.createDataFrame([(2, "d"), (3, "e"), (None, "f")], "k long, v string"))
    assert joins() == 1 and held() == "adef"
    store.commit([store.stage(spark.createDataFrame([(4, "g")], "k long, v string"), "raw")], store.latest())
    assert joins() == 1 and held() == "adefg"
    store.delete("raw", F.col("v").isin("d", "g"))
    assert held() == "aef"


def test_a_term_is_one_row_for_many_slots(spark):
    rows = [(k, "one two" + " two" * (k % 3)) for k in range(640)]
    index = search_index.SearchIndex(search_index.tokenised(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", "text"))
    blocks = index.blocks
    assert spark.read.parquet(blocks.sorted.path).count() == 2 * -(-640 // (search_index.SLOT * search_index.TOGETHER))
    assert blocks.rows().select("term", "slot").distinct().count() == 2 * 640 // search_index.SLOT == blocks.rows().count()
    heads = {(r.term, r.slot): r.most for r in blocks.heads(["one", "two"]).collect()}
    assert heads == {(r.term, r.slot): r.most for r in blocks.rows().collect()}
    for r in index.postings().withColumn("gain", index._gain(F.col("tf"), F.col("size"))).collect():
        assert r.tf == (1 if r.term == "one" else 1 + r.id % 3) and r.size == 2 + r.id % 3 and r.gain <= max(heads.values())
