"""A stored full-text index: blocks of postings with bounds and positions, and a table of terms.

Documents are dealt into slots of up to ``SLOT``, task by task.  A block has the postings of one
term in one slot: ids, frequencies, sizes and positions, and the greatest weight
that any of them can give.  Blocks lie in folders by hash of the term, sorted by
term and slot, and are cut into files by number, so a word of every document is
many files and a query reads the row groups of its own terms.  The best
``k`` documents come from two rounds: the slots with the highest sums of bounds give a
k-th score, and only slots whose sum reaches it are read then.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from sparkloom.functions import text as T
from sparkloom.sources.tables import shared_path, stored

#: BM25's saturation and length normalisation.
K1, B = 1.2, 0.75
#: Documents of a slot; rows of a file and of a folder; bytes of a row group.
SLOT, FILE_ROWS, FOLDER_ROWS, GROUP_BYTES = 32, 250_000, 4_000_000, 2 << 20
#: Files that a task of a shuffle can write to without a sort of its rows in memory; beyond them files grow up to so many times ``FILE_ROWS``.
FEW_FILES, LARGER = 200, 32
#: Slots whose blocks of one term are a row; what a row has of each block.
TOGETHER, _BLOCKS = 32, ["apart", "postings", "length", "most"]
#: Slots with open blocks that are sent to all tasks at most.
FEW_SLOTS = 1_000_000


def tokenised(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), T.tokens(F.col(text)).alias("words"))


def _packing(mean: float, kind: DataType):
    """Documents (id, words) as blocks: each task deals its documents into slots in the order they come, and packs them before anything is shuffled.

    ``data`` has the frequencies of a block's postings, then the sizes of their documents, then all places, each as its
    distance from the place before in the same document.  A row has a term's blocks of ``TOGETHER`` slots one behind the
    other (``_split`` parts them), from ``slot`` on, and of each block its slot's distance from that, its postings, the length of
    its data and its bound: most blocks have one posting, and a row of each would be mostly frame.
    """
    ids_of = pa.int64() if kind.typeName() == "long" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for whole in batches:
            for low in range(0, whole.num_rows, TOGETHER * SLOT):
                batch = whole.slice(low, TOGETHER * SLOT)
                lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                slots = -(-len(sizes) // SLOT)
                first += slots
                if not sizes.sum():
                    continue
                coded = lists.flatten().dictionary_encode()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = coded.indices.to_numpy().astype(np.int64) * slots + owner // SLOT
                order = np.argsort(key, kind="stable")
                key, owner, place = key[order], owner[order], place[order]
                block = np.append(True, key[1:] != key[:-1])
                start = np.flatnonzero(block | np.append(True, owner[1:] != owner[:-1]))
                tf = np.diff(np.append(start, len(key)))
                apart = np.diff(place, prepend=0)
                apart[start] = place[start]
                of = owner[start]
                heads = np.flatnonzero(block[start])
                size = sizes[of]
                most = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)), heads)
                counts = np.diff(np.append(heads, len(start)))
                words = np.diff(np.append(start[heads], len(key)))
                data = _merged(counts, tf, size, apart, words)
                ids = batch.column(0).take(pa.array(of))
                at = key[start[heads]]
                rows = np.flatnonzero(np.append(True, at[1:] // slots != at[:-1] // slots))
                blocks, postings = np.append(rows, len(at)), np.append(heads, len(start))
                # Rounded up: a bound stays one.
                each = [(at % slots).astype(np.int8), counts.astype(np.int32), (2 * counts + words).astype(np.int32), np.nextafter(most.astype(np.float32), np.float32(np.inf))]
                lists_ = [*((blocks, pa.array(x)) for x in each), (postings[blocks], ids.cast(ids_of) if ids_of else ids), (np.append(0, np.cumsum(2 * counts + words))[blocks], data)]
                terms = coded.dictionary.take(pa.array(at[rows] // slots)).cast(pa.string())
                slot = pa.array(np.full(len(rows), first - slots))
                yield pa.RecordBatch.from_arrays([terms, slot, *(pa.ListArray.from_arrays(pa.array(c.astype(np.int32)), x) for c, x in lists_)], names=["term", "slot", *_BLOCKS, "ids", "data"])

    return run


def _parts(postings: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where each list of blocks starts, and where frequencies, sizes and places stand in it."""
    base = np.append(0, np.cumsum(2 * postings + words))
    tf = np.arange(postings.sum()) + np.repeat(base[:-1] - (np.cumsum(postings) - postings), postings)
    place = np.arange(words.sum()) + np.repeat(base[:-1] + 2 * postings - (np.cumsum(words) - words), words)
    return base, tf, tf + np.repeat(postings, postings), place


def _merged(postings: np.ndarray, tf: np.ndarray, size: np.ndarray, apart: np.ndarray, words: np.ndarray) -> pa.Array:
    base, *at = _parts(postings, words)
    data = np.empty(base[-1], np.int32)
    for where, values in zip(at, (tf, size, apart), strict=True):
        data[where] = values
    return pa.array(data)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of rows, a row for each."""
    for whole in batches:
        for low in range(0, whole.num_rows, 1000):
            batch = whole.slice(low, 1000)
            n = np.diff(batch.column(2).offsets.to_numpy())
            of = np.repeat(np.arange(len(n)), n)
            apart, postings, length, most, ids, data = (c.flatten() for c in batch.columns[2:])
            cuts = [pa.array(np.append(0, np.cumsum(x.to_numpy())).astype(np.int32)) for x in (postings, length)]
            slot = pa.array(batch.column(1).to_numpy()[of] + apart.to_numpy())
            lists = [pa.ListArray.from_arrays(c, x) for c, x in zip(cuts, (ids, data), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), slot, most, *lists], names=["term", "slot", "most", "ids", "data"])


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


class Sorted:
    """Rows stored by a string key: in folders by its hash, dealt out in a folder by hash of the key and ``also``, sorted in each file by both and ``then``.

    A key of many rows is thus in all files of its folder, and one of few costs a look at their footers.
    """

    def __init__(self, rows: DataFrame, key: str, also: list[str], then: list[str], count: int, name: str) -> None:
        self.spark, self.key = rows.sparkSession, key
        per = FOLDER_ROWS // FILE_ROWS
        total = max(1, min(-(-count // FILE_ROWS), FEW_FILES), -(-count // (LARGER * FILE_ROWS)))
        self.folders = -(-total // per)
        self.path = shared_path(self.spark, name)
        files = total // self.folders
        folder = _folder(F.col(key), self.folders)
        file = folder * files + F.pmod(F.xxhash64(F.lit(7), key, *also), F.lit(files)).cast("int")
        # Sorted by folder first, as the writer would do otherwise, once more.
        kept = rows.withColumn("folder", folder) if self.folders > 1 else rows
        dealt = kept.repartitionById(self.folders * files, file).sortWithinPartitions(*(["folder"] if self.folders > 1 else []), key, *also, *then)
        (dealt.write.partitionBy("folder") if self.folders > 1 else dealt.write).option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(self.path)
        self._whole = self.spark.read.schema(dealt.schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._whole.drop("folder")

    def of(self, keys: list[str]) -> DataFrame:
        """The rows of some keys, from their folders' row groups."""
        whole = self._whole
        if self.folders > 1 and keys:
            folders = self.spark.createDataFrame([(k,) for k in keys], "k string").select(_folder(F.col("k"), self.folders)).distinct()
            whole = whole.where(F.col("folder").isin([r[0] for r in folders.collect()]))
        return whole.where(F.col(self.key).isin(keys)).drop("folder")


class Blocks:
    """The stored blocks of an index; they are stored and shuffled with those of ``TOGETHER`` slots in one row."""

    def __init__(self, words: DataFrame, mean: float, count: int) -> None:
        kind = words.schema["id"].dataType.simpleString()
        packed = f"term string, slot long, apart array<tinyint>, postings array<int>, length array<int>, most array<float>, ids array<{kind}>, data array<int>"
        self._schema = f"term string, slot long, most float, ids array<{kind}>, data array<int>"
        self.sorted = Sorted(words.select("id", "words").mapInArrow(_packing(mean, words.schema["id"].dataType), packed), "term", ["slot"], [], count, "blocks")

    def rows(self) -> DataFrame:
        """(term, slot, most, ids, data) of all blocks."""
        return self.sorted.rows().mapInArrow(_split, self._schema)

    def of(self, keys: list[str]) -> DataFrame:
        """The blocks of some terms."""
        return self.sorted.of(keys).mapInArrow(_split, self._schema)

    def heads(self, keys: list[str]) -> DataFrame:
        """(term, slot, most) of the blocks of some terms; no postings are read."""
        rows = self.sorted.of(keys).select("term", "slot", F.explode(F.arrays_zip("apart", "most")).alias("b"))
        return rows.select("term", (F.col("slot") + F.col("b.apart")).alias("slot"), F.col("b.most").cast("double").alias("most"))


class SearchIndex:
    """The index of a corpus of tokenised documents (id, words), in the shared folder."""

    def __init__(self, words: DataFrame) -> None:
        self.spark = words.sparkSession
        size = F.size(F.coalesce("words", F.array().cast("array<string>")))
        one = words.agg(F.count("*").alias("n"), F.avg(size).alias("mean"), F.sum(size).alias("words")).first()
        self.n, self.mean = one.n, one.mean or 1.0
        self.slots = max(1, -(-self.n // SLOT))
        self.blocks = Blocks(words, self.mean, (one.words or 0) // 2)
        # Of a posting, its frequency, its size and as many places as the frequency says.
        terms = self.blocks.sorted.rows().groupBy("term").agg(F.sum(F.size("ids")).alias("df"), F.sum(F.size("data") - 2 * F.size("ids")).alias("n"))
        self.terms = stored(terms.repartitionByRange("term").sortWithinPartitions("term"), "terms")

    def _gain(self, tf: Column, size: Column) -> Column:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(self.mean)))

    def postings(self) -> DataFrame:
        """(term, id, size, tf) of the whole index."""
        return _opened(self.blocks.rows()).select("term", "id", "size", "tf")

    def weights(self, terms: list[str]) -> dict[str, float]:
        """The inverse document frequency of each term that the corpus has."""
        idf = F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return dict(self.terms.where(F.col("term").isin(terms)).select("term", idf).collect())

    def _weighed(self, rows: DataFrame, weights: dict[str, float]) -> DataFrame:
        table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else F.create_map().cast("map<string,double>")
        return rows.withColumn("weight", table[F.col("term")])

    def bounds(self, weights: dict[str, float], groups: list[list[str]]) -> DataFrame:
        """(slot, bound): the highest score that a document of a slot can reach, of slots with a term of every group."""
        heads = self._weighed(self.blocks.heads(list(weights)), weights)
        sums = heads.groupBy("slot").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"), F.collect_set("term").alias("held"))
        for group in groups:
            sums = sums.where(F.arrays_overlap("held", F.array(*map(F.lit, group))))
        return sums.select("slot", "bound")

    def _scores(self, blocks: DataFrame, weights: dict[str, float], positions: bool = False) -> DataFrame:
        """(id, score, held): documents of some blocks with their terms, and with ``places`` of each if asked for."""
        rows = self._weighed(_opened(blocks, positions), weights)
        extra = [F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("places")] if positions else []
        return rows.groupBy("id").agg(F.sum(F.col("weight") * self._gain(F.col("tf"), F.col("size"))).alias("score"), F.count("*").alias("held"), F.collect_set("term").alias("terms"), *extra)

    def open_slots(self, weights: dict[str, float], groups: list[list[str]], k: int, keep) -> DataFrame:
        """(slot) of all slots that may hold one of the ``k`` best documents that ``keep`` lets through.

        The bounds, a row for each slot with a term, are read twice; the
        driver gets the first ``k`` slots, whose documents give a k-th score, and that.
        """
        bounds = self.bounds(weights, groups)
        first = [r.slot for r in bounds.orderBy(F.desc("bound"), "slot").limit(k).collect()]
        got = keep(self.blocks.of(list(weights)).where(F.col("slot").isin(first)))
        best = [r.score for r in got.orderBy(F.desc("score")).limit(k).select("score").collect()]
        # Sums in another order may differ in their last bits.
        return bounds.where(F.col("bound") * (1 + 1e-9) >= best[-1]).select("slot") if len(best) == k else bounds.select("slot")

    def _read(self, weights: dict[str, float], slots: DataFrame) -> DataFrame:
        blocks = self.blocks.of(list(weights))
        # A number for each open slot: a bound of its own by the number of slots.
        return blocks.join(F.broadcast(slots) if self.slots <= FEW_SLOTS else slots, "slot", "left_semi")

    def bm25(self, terms: list[str], every: bool = False) -> DataFrame:
        """(id, score) of all documents that hold any, or every, term."""
        weights = self.weights(terms)
        scores = self._scores(self.blocks.of(list(weights)), weights)
        return (scores.where(F.col("held") == len(set(terms))) if every else scores).select("id", "score")

    def top(self, terms: list[str], k: int) -> DataFrame:
        """(id, score) of the ``k`` documents with the highest BM25 scores, equal ones by id; blocks that can't change them aren't read."""
        weights = self.weights(terms)
        slots = self.open_slots(weights, [], k, lambda blocks: self._scores(blocks, weights))
        return self._scores(self._read(weights, slots), weights).select("id", "score").orderBy(F.desc("score"), "id").limit(k)

    def holding(self, groups: list[list[str]]) -> DataFrame:
        """(id) of the documents with a term of every group; positions aren't read."""
        asked = sorted({t for g in groups for t in g})
        rows = _opened(self.blocks.of(asked)).groupBy("id").agg(F.collect_set("term").alias("held"))
        return rows.where(reduce(Column.__and__, (F.arrays_overlap("held", F.array(*map(F.lit, g))) for g in groups))).select("id")

    def ranked(self, groups: list[list[str]], phrases: list[list[str]], excluded: list[str], k: int, window: int | None = 12) -> DataFrame:
        """(id, score, start) of the ``k`` best documents by BM25 over all terms that hold a term of every group, every phrase and no excluded term.

        ``start`` is the place, from 0, of the first of the word windows of that length with the most
        terms; without a window there is no start, and without phrases no position is read.  Words of a phrase stand one behind the other, by their positions.
        """
        needed = [*groups, *([w] for p in phrases for w in p)]
        asked = sorted({t for g in needed for t in g})
        weights = self.weights(asked)
        without = sorted(set(excluded))

        def keep(blocks: DataFrame) -> DataFrame:
            rows = self._scores(blocks, weights, positions=bool(window or phrases))
            held = F.col("terms")
            for group in needed:
                rows = rows.where(F.arrays_overlap(held, F.array(*map(F.lit, group))))
            for phrase in phrases:
                heads = [_shifted(F.col("places")[w], j) for j, w in enumerate(phrase)]
                rows = rows.where(F.size(reduce(F.array_intersect, heads)) > 0)
            if without:
                gone = _opened(self.blocks.of(without)).select("id")
                rows = rows.join(gone, "id", "left_anti")
            return rows

        slots = self.open_slots(weights, needed, k, keep)
        best = keep(self._read(weights, slots)).orderBy(F.desc("score"), "id").limit(k)
        if not window:
            return best.select("id", "score")
        sorted_ = F.array_sort(F.flatten(F.map_values("places")))
        counted = F.transform("_p", lambda p, j: F.struct((-F.size(F.filter(F.slice("_p", j + 1, window), lambda x: x < p + window))).alias("n"), p.alias("p")))
        return best.withColumn("_p", sorted_).select("id", "score", F.array_min(counted)["p"].alias("start"))

    def dictionary(self, least: int = 2) -> DataFrame:
        """(word, n) of words of two characters and more that aren't numbers and come ``least`` times."""
        return self.terms.where((F.length("term") >= 2) & ~F.col("term").rlike(r"^\p{N}+$") & (F.col("n") >= least)).select(F.col("term").alias("word"), "n")

    def starting(self, prefix: str, k: int) -> DataFrame:
        """(word) of terms that start with a prefix of two characters or more, the shortest first; the table's row groups without the prefix aren't read."""
        rows = self.terms.where(F.col("term").startswith(prefix.lower())) if len(prefix) >= 2 else self.terms.limit(0)
        return rows.select(F.col("term").alias("word")).orderBy(F.length("word"), "word").limit(k)

    def corrected(self, words: list[str]) -> list[str]:
        """A query's words, those of five letters and more that the dictionary lacks by their nearest word in it.

        Under nine letters one edit is allowed, else two; of equally near words the commonest, then the first.  The dictionary is
        read once for all words of a query and each is compared with those of about its length, so that nothing is written and
        only the nearest word of each is shuffled.
        """
        asked = sorted({w for w in words if len(w) >= 5})
        known = {r.word for r in self.dictionary().where(F.col("word").isin(asked)).collect()}
        open_ = [w for w in asked if w not in known]
        if not open_:
            return words
        edits = {w: 1 if len(w) < 9 else 2 for w in open_}
        # A few rows for each word of the query.
        lengths = self.spark.createDataFrame([(w, e, n) for w, e in edits.items() for n in range(len(w) - e, len(w) + e + 1)], "typed string, edits int, size int")
        listed = self.dictionary().where(F.length("word") >= 4).withColumn("size", F.length("word"))
        distance = F.levenshtein("typed", "word")
        near = listed.join(F.broadcast(lengths), "size").withColumn("distance", distance).where(F.col("distance") <= F.col("edits"))
        first = near.groupBy("typed").agg(F.min(F.struct("distance", (-F.col("n")).alias("less"), "word")).alias("best"))
        best = dict(first.select("typed", "best.word").collect())
        return [best.get(w, w) for w in words]


def deletions(rows: DataFrame, name: str, wide: int) -> DataFrame:
    """A row for each string that is left of ``name`` when up to one letter, from ``wide`` letters on up to two, are taken out, as ``_left``."""
    def without_one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))

    one = rows.withColumn("_d", without_one(F.col(name)))
    two = F.when(F.length(name) >= wide, F.flatten(F.transform("_d", without_one))).otherwise(F.array().cast("array<string>"))
    return one.select(*rows.columns, F.explode(F.array_distinct(F.concat(F.array(name), "_d", two))).alias("_left"))


def _opened(blocks: DataFrame, positions: bool = False) -> DataFrame:
    """A row for each posting of some blocks."""
    n = F.size("ids")
    if positions:
        kind = blocks.schema["ids"].dataType.elementType.simpleString()
        return blocks.select("term", "ids", "data").mapInArrow(_placed, f"term string, id {kind}, tf int, size int, positions array<int>")
    each = blocks.select("term", F.explode(F.arrays_zip("ids", F.slice("data", F.lit(1), n).alias("tfs"), F.slice("data", n + 1, n).alias("sizes"))).alias("p"))
    return each.select("term", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.sizes").alias("size"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks as postings with their places."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, length = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in batch.columns[1:])
        data = batch.column(2).flatten().to_numpy()
        _, *at = _parts(n, length - 2 * n)
        tf, size, apart = (data[where] for where in at)
        cuts = np.append(0, np.cumsum(tf, dtype=np.int64))
        run = np.append(0, np.cumsum(apart, dtype=np.int64))
        places = run[1:] - np.repeat(run[cuts[:-1]], tf)
        lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(places.astype(np.int32)))
        term = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
        yield pa.RecordBatch.from_arrays([term, batch.column(1).flatten(), pa.array(tf), pa.array(size), lists], names=["term", "id", "tf", "size", "positions"])


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p - by)


def snippet(words: Column, start: Column, terms: list[str], window: int = 12, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The words of a window, the terms among them marked."""
    return F.array_join(F.transform(F.slice(words, start + 1, window), lambda w: F.when(w.isin(terms), F.concat(F.lit(before), w, F.lit(after))).otherwise(w)), " ")


def files_state(df: DataFrame) -> tuple:
    """What the files behind a table are: their names, sizes and times."""
    spark: SparkSession = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


_indexes: dict[tuple, SearchIndex] = {}


def index_of(docs: DataFrame, key: str, text: str) -> SearchIndex:
    """The index of a table of files, built once for an application and the files as they are now."""
    at = (docs.sparkSession.sparkContext.applicationId, key, text, files_state(docs))
    if at not in _indexes:
        _indexes[at] = SearchIndex(tokenised(docs, key, text))
    return _indexes[at]
