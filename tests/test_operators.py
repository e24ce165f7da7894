"""Operators on small tables of their own: edge cases, invariants, streams."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import analytics, documents, extraction, graph, querytext, relational, retrieval, spans
from sparkloom.sources import files, sinks
from sparkloom.streaming import stateful


def test_chunks_cover_the_text_in_order(spark):
    text = " ".join(f"word{k}." for k in range(900))
    rows = documents.overlapping_chunks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "k long, t string"), "k", "t").orderBy("key", "number").collect()
    assert {r.key for r in rows} == {1}
    assert rows[0].start == 0 and rows[-1].end == len(text)
    assert all(a.end - 100 == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert all(text[r.start : r.end] == r.chunk and len(r.chunk) <= 1200 for r in rows)


def test_packed_sentences_keep_all_words(spark):
    text = "One two. Three four! Five six? " + "x" * 50 + ". End."
    rows = documents.packed_sentences(spark.createDataFrame([(1, text)], "k long, t string"), "k", "t", 20).orderBy("number").collect()
    assert " ".join(r.chunk for r in rows) == text
    assert all(len(r.chunk) <= 20 or " " not in r.chunk for r in rows)


def test_rank_fusion_formula_and_threshold_before_division(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("y", 0)], "id string, rank int")
    rows = {r.id: r.score for r in retrieval.rank_fusion([(0.5, a), (0.5, b)], 10).collect()}
    assert rows["y"] == 1.0 and rows["x"] == pytest.approx((0.5 / 61) / (0.5 / 62 + 0.5 / 61))
    assert retrieval.rank_fusion([(0.5, a), (0.5, b)], 10, least=0.1).count() == 0


def test_minimum_and_maximum_of_equal_scores(spark):
    rows = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "id string, s double")
    assert [r.n for r in rows.select(relational.normalised(rows, "s", "min_max").alias("n")).collect()] == [1.0, 1.0]
    assert [r.n for r in rows.select(relational.normalised(rows, "s", "z_score").alias("n")).collect()] == [0.0, 0.0]


def test_chains_report_cycles_and_depth(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 5), (5, 4)] + [(k, k - 1 if k > 100 else None) for k in range(100, 115)]
    found = {r.id: (r.path, r.problem) for r in graph.chains(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()}
    assert found[3] == ([1, 2, 3], None)
    assert found[4][1] == found[5][1] == "cycle"
    assert found[110][1] is None and found[111][1] == "depth"
    assert len(found) == len(rows)


def test_corrections_keep_known_and_short_words(spark):
    known = spark.createDataFrame([("dragon", 5), ("dagger", 9), ("adventure", 3)], "word string, n long")
    typed = spark.createDataFrame([("dragn",), ("dragon",), ("dag",), ("advanture",), ("zzzzzz",)], "word string")
    found = {r.word: (r.best, r.distance) for r in querytext.corrections(typed, known).collect()}
    assert found == {"dragn": ("dragon", 1), "advanture": ("adventure", 1)}


def test_dice_and_dates(spark):
    row = spark.range(1).select(T.dice(F.lit("2d6+3")).alias("a"), T.dice(F.lit("d%")).alias("b"), T.dice(F.lit("six")).alias("c"), T.date_plus(F.lit(1), F.lit(1), F.lit(1), F.lit(-1)).alias("d")).first()
    assert (row.a.least, row.a.most, row.a.average) == (5, 15, 10.0)
    assert row.b.most == 100 and row.c is None
    assert tuple(row.d) == (0, 12, 30)


def test_upsert_prefers_the_new_row_of_equal_versions(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 1)], "k int, v string, n int")
    assert {(r.k, r.v) for r in sinks.upserted(old, new, ["k"], "n").collect()} == {(1, "c"), (2, "b"), (3, "e")}


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b\nc")], "k int, v string")
    sinks.export(rows, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first().v == "a;b c"
    sinks.export(rows, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).first().v == "a,b\nc"
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "x"), "xml")


def test_summaries_of_an_empty_log(spark):
    log = spark.createDataFrame([], "query string, results_count int, selected_index int, cache_hit boolean, response_ms int, created_at timestamp")
    one = analytics.search_summary(log, 24).first()
    assert (one.searches, one.click_rate, one.avg_ms) == (0, 0.0, 0.0)
    assert analytics.trending_queries(log, 5).count() == 0


def test_alerts_once_in_a_stream_and_in_a_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(minutes=m)) for m in (0, 30, 59, 61, 100, 125)] + [("b", start)]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    batch = {(r.k, r.t) for r in stateful.alerts_once(df, "k", "t").collect()}
    assert batch == {("a", rows[0][1]), ("a", rows[3][1]), ("a", rows[5][1]), ("b", start)}
    df.orderBy("t").coalesce(1).write.option("maxRecordsPerFile", 3).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.alerts_once(stream, "k", "t").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.k, r.t) for r in spark.table("alerts").collect()} == batch


def test_hourly_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(minutes=20 * k), 1.0) for k in range(9)], "t timestamp, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stateful.hourly(stream, "t", "v").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.hour, r.cost) for r in spark.table("hours").collect()} == {(r.hour, r.cost) for r in stateful.hourly(df, "t", "v").collect()}


def test_elements_stay_whole(spark):
    rows = [(1, 0, "a. b.", False), (1, 1, "c.", False), (1, 2, "x" * 30, True), (1, 3, "d. " * 20, False), (2, 0, None, False)]
    got = documents.packed_elements(spark.createDataFrame(rows, "k int, o int, t string, alone boolean"), "k", "o", "t", F.col("alone"), 20).orderBy("k", "chunk_number").collect()
    assert [r.chunk for r in got][:2] == ["a.\nb.\nc.", "x" * 30]
    assert all(len(r.chunk) <= 20 for r in got[2:]) and sum(r.chunk.count("d.") for r in got) == 20


def test_best_splits_prefer_near_and_strong_boundaries(spark):
    from sparkloom.operators import extraction

    text = "a" * 90 + ".\n\n" + "B" * 200
    row = extraction.best_splits(spark.createDataFrame([(1, text), (2, "short"), (3, "z" * 300)], "k long, t string"), "k", "t", 100, 50).orderBy("key").collect()
    assert (row[0].kind, row[0].place) == ("blank line", 93) and (row[1].kind, row[1].place) == ("fallback", 100)


def test_zip_and_as_of_joins_keep_rows_without_partner(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "g long, a string")
    b = spark.createDataFrame([(1, 7), (3, 8)], "g long, b long")
    got = {(r.g, r.place, r.a, r.b) for r in spans.zipped(a, b, "g", ["a"], ["b"]).collect()}
    assert got == {(1, 0, "x", 7), (1, 1, "y", None), (2, 0, "z", None), (3, 0, None, 8)}
    rows = spark.createDataFrame([(1, 5, 1), (1, 1, 2), (2, 9, 3)], "k long, t long, i long")
    quotes = spark.createDataFrame([(1, 2, 1, 10.0), (1, 4, 2, None), (1, 6, 3, 30.0)], "k long, t long, i long, v double")
    assert {(r.i, r.v) for r in spans.as_of(rows, quotes, "k", "t", "i", "v").collect()} == {(1, None), (2, None), (3, None)}
    assert {(r.i, r.v) for r in spans.as_of(rows, quotes.where("v is not null"), "k", "t", "i", "v").collect()} == {(1, 10.0), (2, None), (3, None)}


def test_groups_unite_through_others(spark):
    rows = [(k, f"t{k}") for k in range(1, 9)] + [(k, f"t{k + 1}") for k in range(1, 8)] + [(50, "other"), (51, "other"), (60, None)]
    got = {r.m: r.g for r in spans.united(spark.createDataFrame(rows, "g long, m string"), "g", "m").collect()}
    assert all(got[f"t{k}"] == 1 for k in range(1, 9)) and got["other"] == 50


def test_query_variants_and_preparation(spark):
    q = spark.createDataFrame([(["the", "hp", "of", "dragon"],)], "w array<string>")
    assert q.select(querytext.variants(F.col("w"), {"hp": "hit points"}, {"dragon": ["wyrm", "hp"]}).alias("t")).first().t == ["hp", "hit points", "dragon", "wyrm"]
    raw = spark.createDataFrame([(1, "  Dragn  FIRE "), (2, ""), (3, None)], "id long, query string")
    known = spark.createDataFrame([("dragon", 3), ("fire", 2)], "word string, n long")
    synonyms = spark.createDataFrame([("fire", "flame", 1), ("fire", "blaze", 2)], "word string, synonym string, priority int")
    got = {r.id: (r.corrected, r.expanded) for r in querytext.prepared(raw, known, synonyms, 1).collect()}
    assert got == {1: ("dragon fire", "dragon AND (fire OR flame)")}


def test_alerts_within_the_silence_are_left_out(spark):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=m)) for k in ("a", None) for m in (0, 30, 59, 60, 61, 125)]
    got = stateful.alerts_once(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t").collect()
    assert sorted((r.k is None, (r.t - start).seconds // 60) for r in got) == sorted((k, m) for k in (False, True) for m in (0, 60, 125))


def test_dictionaries_synonyms_and_layouts(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Dragon 5\nfire 2\n\nbroken line here\ndragon 4\n")
    (tmp_path / "pairs.txt").write_text("red dragon 3\nRed Dragon 1\nalone 9\n")
    (tmp_path / "same.toml").write_text('[multi_way]\nHP = ["hit points", "health"]\n[one_way]\ndragon = ["wyrm"]\n')
    (tmp_path / "page.json").write_text('{"pages": [{"page": 1, "elements": [{"role": "title", "text": "A", "x": 1, "y": 2}, {"role": "body", "text": "B", "x": 1, "y": 3}]}, {"page": 2, "elements": []}]}')
    (tmp_path / "picture.PNG").write_bytes(b"x")
    assert {(r.word, r.n) for r in files.frequencies(spark, f"{tmp_path}/words.txt", 2.0).collect()} == {("dragon", 18), ("fire", 4)}
    assert [(r.pair, r.n) for r in files.pair_frequencies(spark, f"{tmp_path}/pairs.txt").collect()] == [("red dragon", 4)]
    same = {(r.word, r.synonym) for r in files.synonyms(spark, f"{tmp_path}/same.toml").collect()}
    assert same == {("hp", "hit points"), ("hp", "health"), ("hit points", "hp"), ("hit points", "health"), ("health", "hp"), ("health", "hit points"), ("dragon", "wyrm")}
    elements = files.layout_elements(spark, f"{tmp_path}/page.json")
    assert [(r.page, r.text) for r in files.layout_pages(elements).collect()] == [(1, "A\nB")]
    assert [r.text for r in files.layout_elements(spark, f"{tmp_path}/page.json", ("body",)).collect()] == ["B"]
    assert {r.path.rsplit("/", 1)[-1] for r in files.supported(spark, str(tmp_path)).collect()} == {"words.txt", "pairs.txt", "same.toml", "page.json"}
    assert files.field_of("Damage") == "damage_types" and files.field_of("colour") == "metadata"


def test_backups_can_be_brought_back(spark, tmp_path):
    folder = f"file://{tmp_path}/backup"
    files.backup({"a": spark.range(3), "b": spark.range(4)}, folder, 1)
    files.backup({"a": spark.range(7)}, folder, 2)
    assert [(r.version, r.name) for r in files.backups(spark, folder).collect()] == [(2, "a"), (1, "a"), (1, "b")]
    assert files.restored(spark, folder, 1, "a").count() == 3
    with pytest.raises(Exception, match="(?i)already exists"):
        files.backup({"a": spark.range(1)}, folder, 2)


def test_abbreviations_end_no_sentence(spark):
    text = "Dr. Who met Mrs. Hudson in Jan. at noon. J. Smith left! Was it so? See e.g. this one."
    got = spark.createDataFrame([(text,)], "t string").select(documents.sentences(F.col("t")).alias("s")).first().s
    assert got == ["Dr. Who met Mrs. Hudson in Jan. at noon.", "J. Smith left!", "Was it so?", "See e.g. this one."]


def test_a_fold_of_several_batches(spark):
    # Literals and coalesced values exclude nulls; two batches in a task.
    rows = spark.range(0, 25_000, 1, 1).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") % 7 - 3).cast("double").alias("v"))
    got = graph.clamped_fold(rows, "g", "o", "v", 50, -100, 100).collect()
    now = 50.0
    for k in range(25_000):
        now = max(min(now + k % 7 - 3, 100.0), -100.0)
    assert [(r.final, r.n) for r in got] == [(now, 25_000)]


def test_an_average_of_several_batches(spark):
    rows = spark.range(0, 25_000, 1, 1).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("v"))
    now = 50.0
    for k in range(25_000):
        now = now * 0.9 + k % 7 * 0.1
    assert [r.average for r in stateful.moving_average(rows, "g", "o", "v", 0.9, 50).collect()] == [pytest.approx(now)]


def test_digits_at_the_ends_of_pieces_stay(spark):
    text = "Reouti anatha. 19.37.233.111 2. 22!"
    row = spark.createDataFrame([(text, "0 | 10 | 21 | 1")], "t string, l string").select(documents.sentences(F.col("t")).alias("s"), documents.table_cells(F.col("l")).alias("c")).first()
    assert row.s == ["Reouti anatha.", "19.37.233.111 2.", "22!"] and row.c == ["0", "10", "21", "1"]


def test_letters_beyond_ascii_end_a_word_as_in_sql(spark):
    row = spark.createDataFrame([("etion | lesétionler, les_ and thé", "partÉ one")], "t string, l string").select(
        extraction.contexts(F.col("t"), {"a": {"les": 0.8}, "b": {"and": 0.5}})[0].alias("c"), extraction.attributes(F.col("t"), {"x": ["les", "th", "an"]}).alias("a"), documents.header_level(F.col("l")).alias("h")
    ).first()
    assert tuple(row.c) == ("a", 1.3) and row.a.x == ["les", "th"] and row.h == 1


def test_chains_of_any_depth(spark):
    rows = [(k, k - 1 if k else None) for k in range(24)] + [(30, 31), (31, 30)]
    found = {r.id: (r.path, r.problem) for r in graph.chains(spark.createDataFrame(rows, "id long, parent long"), "id", "parent", None).collect()}
    assert all(found[k] == (list(range(k + 1)), None) for k in range(24))
    assert found[30][1] == found[31][1] == "cycle" and len(found) == len(rows)


def test_traits_come_down_from_any_depth(spark):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(20)], "id long, parent long")
    traits = spark.createDataFrame([(0, "eyes", 1), (5, "eyes", 2), (0, "hair", 3)], "id long, name string, value int")
    found = graph.inherited(graph.chains(nodes, "id", "parent", None).where("problem is null"), traits, "name", "value")
    assert {(r.name, r.value) for r in found.where("id = 19").collect()} == {("eyes", 2), ("hair", 3)}
