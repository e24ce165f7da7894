"""Mentions, references, completions, lines of streams, nested differences and rolls on small tables."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import completion, documents, mentions, nested, querytext
from sparkloom.sources import markup
from sparkloom.streaming import stateful

WORDS = ["ash", "élan", "ice", "ice storm", "storm", "storm giant", "giant", "a_b", "x2"]


def plain_mentions(text, entries):
    """All places of all terms, then the greedy choice, one by one."""
    low = "".join(c if c == "İ" else c.lower() for c in text or "")
    every = []
    for term, label, confidence in entries:
        for m in re.finditer(rf"(?<!\w)(?={re.escape(term.lower())}(?!\w))", low):
            every.append((-confidence, -len(term), m.start(), label, term.lower()))
    kept = []
    for c, long, start, label, term in sorted(every):
        if all(start - long <= s or e <= start for s, e, *_ in kept):
            kept.append((start, start - long, -c, term, label))
    return sorted(kept)


@pytest.mark.parametrize("most", [8 << 20, 60])
def test_mentions_are_those_of_a_plain_search(spark, most):
    r = random.Random(3)
    texts = [(k, r.choice(["", " "]).join(r.choice([*WORDS, "Giant", "ÉLAN", "-", "ice,", "İ", " "]) + r.choice([" ", " ", ""]) for _ in range(30))) for k in range(60)]
    texts += [(100, None), (101, ""), (102, "ice storm giant " * 3000)]
    entries = [(w, "one" if len(w) < 5 else "two", r.choice([0.5, 0.7, 0.9])) for w in WORDS] + [("ice", "three", 0.7)]
    vocabulary = spark.createDataFrame([*entries, (None, "none", 0.5), ("", "none", 0.5), ("x2", None, 0.5)], "term string, label string, confidence double")
    got = {}
    for row in mentions.mentions(spark.createDataFrame(texts, "start long, t string"), "start", "t", vocabulary, most).toDF("k", "a", "b", "c", "term", "label").collect():
        got.setdefault(row.k, []).append((row.a, row.b, row.c, row.term, row.label))
    assert {k: sorted(v) for k, v in got.items()} == {k: want for k, t in texts if (want := plain_mentions(t, entries))}


def test_an_empty_vocabulary_has_no_mentions(spark):
    none = spark.createDataFrame([], "term string, label string, confidence double")
    assert mentions.mentions(spark.createDataFrame([(1, "a")], "k long, t string"), "k", "t", none).count() == 0


@pytest.mark.parametrize("text, want", [
    ("For more details, see page 47.", [("page", "47", 47, 47, 0.95)]),
    ("Please refer to page 12 for the rules", [("page", "12", 12, 12, 0.95)]),
    ("(page 99)", [("page", "99", 99, 99, 0.85)]),
    ("(p.42)", [("page", "42", 42, 42, 0.9)]),
    ("See pp. 15-20 for", [("page", "15-20", 15, 20, 0.95)]),
    ("Refer to pages 47 and 48.", [("page", "47", 47, 47, 0.95), ("page", "48", 48, 48, 0.95)]),
    ("See page 10 and page 20 for more.", [("page", "10", 10, 10, 0.95), ("page", "20", 20, 20, 0.85)]),
    ("Refer to Chapter VII for magic", [("chapter", "VII", 7, 7, 0.95)]),
    ("chapter IIII and chapter mix", []),
    ("Roll on Table 4-1, fig. 2.3; Appendix B", [("table", "4-1", None, None, 0.95), ("figure", "2.3", None, None, 0.9), ("appendix", "B", None, None, 0.85)]),
    ('see section "Wild Magic"', [("section", "Wild Magic", None, None, 0.95)]),
    ("homepage 12, table5a, page " + "9" * 30, [("page", "9" * 30, None, None, 0.85)]),
    ("", []),
])
def test_references(text, want):
    found = mentions.references_in(text)
    assert [r[:5] for r in found] == want
    assert all(0 <= r[5] < r[6] <= len(text) for r in found)


def test_roman_numerals():
    assert [mentions.roman(x) for x in ("IV", "XIX", "MCMXC", "IIX", "VX", "IC")] == [4, 19, 1990, None, None, None]


def test_completions_of_short_and_long_prefixes(spark):
    words = [("attack", 9), ("attic", 9), ("attend", 3), ("attendant", 8), ("at", 1), ("bold", 2), ("", 5), (None, 1)]
    store = completion.Completions(spark.createDataFrame(words, "word string, n long"), deep=3, most=3)

    def of(*args, **more):
        return [r.word for r in store.of(*args, **more).orderBy("rank").collect()]

    assert of("AT", 3) == ["attack", "attic", "attendant"] and of("atten", 2) == ["attendant", "attend"]
    assert of("zz", 3) == [] and of("zzzz", 3) == []
    assert of("att", 3, first=["attack roll", "Attic", "bold"]) == ["attack roll", "attic", "attack"]
    with pytest.raises(ValueError):
        store.of("a", 4)
    asked = spark.createDataFrame([("at",)] * 50 + [("attend",), ("",), (None,), ("q",)], "partial string")
    got = sorted((r.partial, r.rank, r.word) for r in store.completed(asked, 2).collect())
    assert got == [("at", 1, "attack"), ("at", 2, "attic"), ("attend", 1, "attendant"), ("attend", 2, "attend")]


def test_queries_are_explained(spark):
    known = spark.createDataFrame([("dragon", 5), ("spell", 3)], "word string, n long")
    synonyms = spark.createDataFrame([("dragon", "wyrm", 1), ("dragon", "drake", 2)], "word string, synonym string, priority int")
    asked = spark.createDataFrame([(1, "Dragn  con"), (2, "spell ac"), (3, "  "), (4, None)], "id long, query string")
    got = {r.id: r for r in completion.enhanced(asked, known, synonyms, {"ac": "armor class"}, {"con": ["constitution", "convention"]}).collect()}
    assert got[1].corrected == "dragon con" and got[1].expanded == "(dragon OR wyrm OR drake) AND con"
    assert [tuple(c) for c in got[1].corrections] == [("dragn", "dragon", 1)]
    assert [tuple(h) for h in got[1].hints] == [("correction", "dragn -> dragon"), ("synonym", "dragon: wyrm, drake"), ("context", "con")]
    assert tuple(got[1].clarification) == ("con", ["constitution", "convention"])
    assert got[2].expanded == "spell AND (ac OR armor class)" and got[2].clarification is None
    assert got[3].corrected == got[4].corrected == "" and not got[3].enhanced and not got[4].hints


PIECES = [(k, n, text[a : a + cut]) for k, text, cut in [("a", 'data: {"k": 1}\r\n\n: note\n{"k": 2}\ndata: [DONE]\ndata: {"k": 3', 3), ("b", '{"k": 4}\n{"k": \n{"k": 5}\n', 5), (None, '{"k": 6}\n', 100)] for n, a in enumerate(range(0, len(text), cut))]


def test_frames_of_a_log_and_of_a_stream_are_the_same(spark, tmp_path):
    schema = "k string, n long, piece string"
    whole = stateful.frames(spark.createDataFrame([*PIECES, ("a", -1, None)], schema), "k", "n", "piece", "k int")
    want = sorted((str(r.k), r.number, r.event.k if r.event else None, r.done) for r in whole.collect())
    assert want == [("None", 0, 6, False), ("a", 0, 1, False), ("a", 3, 2, False), ("a", 4, None, True), ("b", 0, 4, False), ("b", 2, 5, False)]
    # Each file is a micro-batch; cuts lie inside the frames, and most batches end none.
    for at in range(0, len(PIECES), 7):
        spark.createDataFrame(PIECES[at : at + 7], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.frames(stream, "k", "n", "piece", "k int").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((str(r.k), r.number, r.event.k if r.event else None, r.done) for r in rows) == want
    assert len([p for p in query.recentProgress if p.numInputRows]) > 1


def test_differences_at_any_depth(spark):
    rows = [
        (1, '{"a": {"b": {"c": {"d": 1, "e": [1, 2]}}}, "x": null}', '{"x": 0, "a": {"b": {"c": {"e": [2, 1], "f": null}}}}'),
        (2, '{"b": 1, "a": "1"}', '{"a": "1", "b": 1}'),
        (3, '{"a": "1"}', '{"a": 1}'),
        (4, None, '{"a": 1}'), (5, "not json", None), (6, "[1]", "2"), (7, '{"a": {}}', '{"a": {"b": {}}}'),
    ]
    found = nested.differences(spark.createDataFrame(rows, "path long, old string, new string"), "path", "old", "new").toDF("id", "path", "change", "old", "new")
    assert sorted(tuple(r) for r in found.collect()) == sorted([
        (1, "a.b.c.d", "removed", "1", None), (1, "a.b.c.e", "modified", "[1,2]", "[2,1]"), (1, "a.b.c.f", "added", None, "null"), (1, "x", "modified", "null", "0"),
        (3, "a", "modified", '"1"', "1"), (4, "", "added", None, '{"a":1}'), (6, "", "modified", "[1]", "2"), (7, "a.b", "added", None, "{}"),
    ])


def test_rolls_report_cycles_depth_and_gaps(spark):
    entries = [("a", 1, 6, "A", "b"), ("b", 1, 3, "", "c"), ("b", 4, 6, "B", "a"), ("c", 1, 6, "C", None), ("c", 2, 6, "other", None), ("s", 1, 6, "S", "s"), ("d0", 1, 6, "x", "d1"), ("d1", 1, 6, "", "d2"), ("d2", 1, 6, "y", "c")]
    rolls = [(1, "a", 2), (2, "c", 9), (3, "s", 1), (4, "d0", 1), (5, "a", 5), (6, "none", 1), (7, "c", None)]
    table = spark.createDataFrame(entries, "table string, low int, high int, text string, nested string")
    got = {r.id: (r.depth, r.text, r.problem) for r in nested.rolled(spark.createDataFrame(rolls, "id long, table string, roll int"), table, lambda i, t, depth: F.when(i == 5, 4).otherwise(3), most=2).collect()}
    assert got == {1: (2, "A: C", None), 2: (0, None, "no entry"), 3: (0, None, "cycle"), 4: (2, None, "depth"), 5: (1, None, "cycle"), 6: (0, None, "no entry"), 7: (0, None, "no entry")}


def test_what_a_query_asks_for(spark):
    words = {"damage": ["fire", "cold"], "creature": ["undead", "dragon"]}
    rows = [(1, 'monsters CR 1/4 to 5 not undead "Red Dragon"'), (2, "cr 3 fire levels 2-4"), (3, "firearm level 99999999999"), (4, None), (5, "")]
    asked = querytext.asked_for(F.col("q"), words, {"fire": ["cold"]})
    got = {r.id: r.a for r in spark.createDataFrame(rows, "id long, q string").select("id", asked.alias("a")).collect()}
    assert got[1].quoted == ["Red Dragon"] and got[1].negated == ["undead"] and tuple(got[1].challenge) == (0.25, 5.0) and got[1].level is None
    assert [tuple(a) for a in got[1].attributes] == [("creature", "undead"), ("creature", "dragon")] and got[1].rest == "monsters Red Dragon"
    assert tuple(got[2].challenge) == (3.0, 3.0) and tuple(got[2].level) == (2, 4) and got[2].rest == "fire" and got[2].expanded == "fire (NOT cold)"
    assert got[3].attributes == [] and tuple(got[3].level) == (None, None)
    assert got[4] == got[5] and got[4].rest == got[4].expanded == "" and got[4].quoted == [] and got[4].challenge is None


def test_links_are_counted(spark):
    refs = spark.createDataFrame([(1, "page", "3"), (1, "page", "3"), (2, "page", "4-1"), (3, "page", "9"), (4, "table", "1")], "key long, kind string, target string")
    catalogue = spark.createDataFrame([("page", "3", "a"), ("page", "4", "b")], "kind string, target string, title string")
    got = {r.kind: tuple(r)[1:] for r in documents.link_report(refs, documents.linked_references(refs, catalogue)).collect()}
    assert got == {"page": (3, 2, 1, 1, 2 / 3), "table": (1, 0, 0, 1, 0.0)}


def test_texts_of_xml(spark):
    rows = [(1, "<a>x<b c='1'/>y &amp;lt; z</a>"), (2, "<a><![CDATA[1 < 2 &lt;]]> </a><!-- <![CDATA[no]]> -->"), (3, None), (4, ""), (5, "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>")]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k long, x string").select("k", markup.xml_text(F.col("x")).alias("t")).collect()}
    assert got == {1: "x y &lt; z", 2: "1 < 2 &lt;", 3: None, 4: "", 5: "&b;"}


def test_texts_of_mail(spark):
    parts = "\n".join(["From: =?utf-8?q?Ren=C3=A9?= <r@example.org>", "To: a@example.org, b@example.org", "Date: Mon, 1 Jan 2024 10:00:00 +0000", "MIME-Version: 1.0", 'Content-Type: multipart/mixed; boundary="x"', "", "--x", "Content-Type: text/html; charset=latin-1", "Content-Transfer-Encoding: quoted-printable", "", "<p>caf=E9</p>", "--x", "Content-Type: text/plain", "Content-Disposition: attachment; filename=a.txt", "", "no", "--x--", ""])
    rows = [(1, parts), (2, None), (3, "no header at all"), (4, "Content-Type: text/plain; charset=none-such\n\nbody"), (5, "Subject:\n\n" + "word " * 100000)]
    got = {r.receivers: r for r in markup.mail_texts(spark.createDataFrame(rows, "receivers long, raw string"), "receivers", "raw").toDF("receivers", "subject", "sender", "to", "sent", "text", "attachments").collect()}
    assert got[1].sender == "René <r@example.org>" and got[1].text == "café" and got[1].attachments == ["a.txt"] and got[1].to == "a@example.org, b@example.org"
    assert got[2].text == "" and got[2].subject is None and got[4].text == "body" and len(got[5].text) == 500000 and len(got) == 5


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.6, 0.8])
def test_alike_words_are_all_found(spark, least):
    """Also where more than two edits are allowed, in letters of several bytes, and in repeats and nulls."""
    r = random.Random(7)
    words = {"", "a", "é", "ééééé", "eéééé"}
    for size in (4, 9, 20, 31):
        for _ in range(5):
            word = "".join(r.choice("abé") for _ in range(size))
            words.add(word)
            for edits in (1, 3, 4, 6):
                other = list(word)
                for _ in range(edits):
                    k = r.randrange(len(other))
                    other[k : k + 1] = r.choice(["", "x", other[k] + "y"])
                words.add("".join(other) or "z")
    table = spark.createDataFrame([(w, 1) for w in [*words, *words, None]], "word string, likeness int")
    got = {(a, b) for a, b, _ in querytext.alike(table, least).collect()}
    size = {w: len(w.encode()) for w in words}
    want = {(a, b) for a in words for b in words if a.encode() < b.encode() and 1 - plain_distance(a, b) / max(size[a], size[b], 1) >= least}
    assert got == want and len(want) > 50


def test_regions_surest_first(spark):
    beast = "Goblin\nArmor Class 15\nHit Points 7 (2d6)\nSpeed 30 ft.\nSTR 8 (-1) DEX 14 (+2)\nLanguages Common"
    texts = [None, "", "Tip: short", beast, "Variant: read aloud, what you see and what you hear!", "Warning: it bites! \n  Keep out.", "A plain line of some length."]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", documents.regions(F.col("t")).alias("r")).orderBy("k").collect()
    assert [[x.kind for x in row.r] for row in rows] == [[], [], [], ["stat block"], ["read-aloud", "sidebar"], ["callout"], []]
    assert rows[4].r[0].confidence == 1.0 and rows[4].r[1].confidence == 0.9
    strict = spark.createDataFrame([(texts[4],)], "t string").select(documents.regions(F.col("t"), 0.95).alias("r")).first().r
    assert [x.kind for x in strict] == ["read-aloud"]


def test_sanitised_texts(spark):
    texts = ["a < b & 'c'", "plain", "<script>", "nul\0", "x" * 30, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", querytext.sanitised(F.col("t"), 20).alias("s")).orderBy("k").collect()
    assert [tuple(r.s) for r in rows] == [(None, "a &lt; b &amp; &#x27;c&#x27;", True), (None, "plain", False), ("markup", None, None), ("nul", None, None), ("too long", None, None), (None, None, None)]


def test_confidence_and_kind_of_links(spark):
    rows = [(0.5, "Longsword", "A longsword cuts.", "Arms", "item"), (0.97, "x", "x", "x", "table"), (0.2, "Player's Book", "none", "book", None), (0.2, "owl", None, None, None), (None, "owl", "owl", "owl", "spell"), (-1.0, "q", "", "t", "text")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, score double, q string, content string, title string, kind string")
    got = table.select("n", documents.link_confidence(F.col("score"), F.col("q"), F.col("content"), F.col("title"), F.col("kind")).alias("c"), documents.linked_kind(F.col("kind"), F.col("content")).alias("k")).orderBy("n").collect()
    assert [r.c and round(r.c, 6) for r in got] == [0.65, 1.0, 0.25, 0.2, None, 0.0]
    assert [r.k for r in got] == ["item", "term", "term", "term", "spell", "term"]


def test_a_block_is_trimmed_once_for_all_tests(spark):
    rows = spark.createDataFrame([("x",)], "t string").where("rand() > -1").select(documents.regions(F.col("t")).alias("r"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_chunks_leave_a_task_in_small_batches(spark):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = documents.overlapping_chunks(Rows(), "k", "t")
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["one two three. " * 300] * 1000)], names=["key", "text"])
    sizes = [b.num_rows for b in run(iter([batch]))]
    assert len(sizes) == 4 and max(sizes) <= 256 * 5 and sum(sizes) == 1000 * sizes[0] // 256


def test_equal_texts_are_read_once(spark, monkeypatch):
    texts = ["See page 4 and tables 1, 2", None, "", "nothing", "Chapter IV"]
    rows = spark.createDataFrame([(k, texts[k % 5]) for k in range(20_000)], "id long, t string").coalesce(1)
    for least, count in ((0.0, 16_000), (0.9, 4000)):
        got = [tuple(r) for r in mentions.references(rows, "id", "t", least).collect()]
        want = [(k, *r) for k in range(20_000) for r in mentions.references_in(texts[k % 5] or "") if r[4] >= least]
        assert len(got) == count and sorted(got, key=lambda r: (r[0], r[2])) == sorted(want, key=lambda r: (r[0], r[2]))
    asked, plain = [], mentions.references_in
    monkeypatch.setattr(mentions, "references_in", lambda text: asked.append(text) or plain(text))
    known, long = {}, "page 7" + " " * mentions.KEPT_LENGTH
    for text in ("Chapter IV", "Chapter IV", long, long):
        assert mentions._read(text, known, 0.0) == plain(text)
    assert asked == ["Chapter IV", long, long] and list(known) == ["Chapter IV"]
