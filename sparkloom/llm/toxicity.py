"""Toxicity of texts behind a noisy channel.

1. A character trigram model is counted over the words of the whole corpus: each
   task adds up the cells of its rows, Spark adds up the tasks.
2. A word that shows signs of disguise (digits or symbols among letters, letters
   thrice or more in a row, letters set apart by spaces) is a lattice: each
   character may stand for itself, for the letters it is drawn like, for a word
   boundary or for nothing, each at a cost.  Viterbi's algorithm finds the
   likeliest reading under the trigram model.  Other words have one reading.
3. Restored words are scored by their character n-grams: how much likelier each
   is in toxic than in clean texts, less one standard error, learnt from at most
   ``TRAIN_ROWS`` labelled rows of each class; a logistic model over a text's
   strongest words gives the score.  What it is fitted on is the evidence that
   each labelled text would have if its own n-grams hadn't been counted.

Labels are read only of rows whose crc32 of doc_id, as text, modulo 5 isn't 0.
Neither labels nor language, source or id is an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import mixed, numbered, odd_numbers, saved, trimmed
from sparkloom.llm.words import by_bytes

#: Labelled rows that the classifier is fitted on, of each class.
TRAIN_ROWS = 20_000
#: Pseudo-rows that stand for no evidence; standard errors taken off a weight; least weight of an n-gram that counts; least toxic rows that hold it, and their least share.
PRIOR_ROWS, DOUBT, LEAST_WEIGHT, LEAST_ROWS, LEAST_PART = 10.0, 1.0, 1.0, 3, 0.001
#: Words whose letters a task counts together.
COUNTED_WORDS = 100_000
#: Characters of the words whose weights a task keeps, words that are read together; n-grams that it holds before it hands their counts on.
KEPT_CHARS, READ_WORDS, HELD_GRAMS = 1_000_000, 4_000, 500_000
#: Bytes of texts that are read together.
READ_BYTES = 1 << 18
GRAMS = (5, 6)
#: Strongest words of a text that count together.
TOP = 3

# The letters of the character model, and what symbols are drawn like.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou"}

#: Codes: 0 is a word's boundary, the last one any other letter.
SIZE = len(LETTERS) + 2
_CODES = np.zeros(0x10000, np.uint8)
_CODES[[ord(c) for c in LETTERS]] = np.arange(1, SIZE - 1)
_CODE = {c: k for k, c in enumerate(LETTERS, 1)}
_PLACES = odd_numbers(8, 77)

#: Costs (negative log-probabilities) of the channel: drawing a letter as a symbol, putting in a symbol that looks like a letter, or another one, a mark that ends a word, one among single letters, repeating a letter.
DRAWN, PUT_IN, PARTED, ENDED, ENDED_SINGLE, REPEATED = 1.0, 9.0, 0.5, 2.5, 7.0, 0.7
_MARKS = ".,;:!?\"'()[]{}|«»…"
_PLAIN = re.compile(r"[^\W\d_]+")
_SINGLES = re.compile(r"[^\W_](?:[\W_]+[^\W_])+")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_TWICE = re.compile(r"([^\W\d_])\1")


def _codes(words: list[str]) -> np.ndarray:
    """Codes of words, a boundary before each and after the last."""
    raw = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
    low = _CODES[np.minimum(raw, 0xFFFF)]
    return np.where((low == 0) & (raw != 0), SIZE - 1, low)


def stripped(word: str) -> str:
    """A raw word in lower case without the marks around it."""
    word = word.strip(_MARKS).lower()
    if word.isalpha():
        return word
    lo, hi = 0, len(word)
    while lo < hi and not (word[lo].isalnum() or word[lo] in "_@$"):
        lo += 1
    while lo < hi and not (word[hi - 1].isalnum() or word[hi - 1] == "_"):
        hi -= 1
    return word[lo:hi]

    """A raw word in lower case with those marks around it that may be drawn letters, but for exclamation marks at its end; empty if it is one character throughout or has digits alone."""
def edged(word: str) -> str:
    """A raw word in lower case with those marks around it that may be drawn letters; empty if it is one character throughout or has digits alone."""
    word = word.lower().rstrip("!")
    lo, hi = 0, len(word)
    while lo < hi and not (word[lo].isalnum() or word[lo] in LOOKS_LIKE):
        lo += 1
    while lo < hi and not (word[hi - 1].isalnum() or word[hi - 1] in LOOKS_LIKE):
        hi -= 1
    word = word[lo:hi]
    return "" if len(set(word)) < 2 or word.isdigit() else word


def is_disguised(word: str) -> bool:
    """Whether a stripped word has more than one reading."""
    return not _PLAIN.fullmatch(word) and any(map(str.isalpha, word)) or _THRICE.search(word) is not None


def character_model(docs: DataFrame) -> np.ndarray:
    """Negative log-probabilities [a, b, c] of c after a and b, from all words of all rows; an empty corpus gives equal ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SIZE**3, np.int64)
        words: Counter[str] = Counter()

        def flush() -> None:
            plain: Counter[str] = Counter()
            for w, n in words.items():
                w = w.lower() if w.isalpha() else stripped(w)
                if w.isalpha() and not _THRICE.search(w):
                    plain[w] += n
            if plain:
                c = _codes(list(plain)).astype(np.int64)
                weight = np.repeat(np.fromiter(plain.values(), np.int64, len(plain)), [len(w) + 1 for w in plain])
                before = np.concatenate([[0], c[:-2]])
                before[c[:-1] == 0] = 0
                first = c[:-1] == 0
                cells[:] += np.bincount((np.where(first, 0, before) * SIZE + c[:-1]) * SIZE + c[1:], weight, SIZE**3).astype(np.int64)
            words.clear()

        for batch in by_bytes(batches, 0, READ_BYTES):
            for text in batch.column(0).to_pylist():
                if text:
                    words.update(text.split())
            if len(words) > COUNTED_WORDS:
                flush()
        flush()
        k = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cells[k])], names=["cell", "n"])

    # One row for each cell, whatever the size of the corpus.
    found = docs.select(F.col("text").cast("string")).mapInArrow(trimmed(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    cells = np.zeros(SIZE**3)
    cells[found["cell"]] = found["n"]
    three = cells.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def _options(raw: str, least: int = 3) -> list[list[tuple[str, float]]]:
    """The lattice of a disguised word: at each step the strings that may be meant (a space is a boundary), with costs; letters count as repeated from ``least`` in a row."""
    steps: list[list[tuple[str, float]]] = []
    ended = ENDED_SINGLE if _SINGLES.fullmatch(raw) else ENDED
    k = 0
    while k < len(raw):
        c = raw[k]
        end = k + 1
        while end < len(raw) and raw[end] == c:
            end += 1
        if c.isalpha():
            if end - k >= least:
                steps.append([(c, REPEATED), (c + c, 2 * REPEATED)])
            else:
                steps += [[(c, 0.0)]] * (end - k)
        else:
            drawn = [(x, DRAWN) for x in LOOKS_LIKE.get(c, "")]
            many = [(x + x, 2 * DRAWN) for x, _ in drawn] if end - k > 1 else []
            like = bool(drawn) and c != "*"
            steps.append([*drawn, *many, ("", PUT_IN if like else PARTED), (" ", PUT_IN if like else ended)])
        k = end
    return steps


def restored(raw: str, model: np.ndarray, least: int = 3) -> list[str]:
    """The likeliest words that a disguised word, or a run of single letters, is meant to be."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in _options(raw, least):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in states.items():
            for meant, price in options:
                x, y, total = a, b, cost + price
                for c in meant:
                    z = 0 if c == " " else _CODE.get(c, SIZE - 1)
                    if z or y:  # two boundaries are one
                        total += model[x, y, z]
                        x, y = (y, z) if z else (0, 0)
                if (x, y) not in after or total < after[x, y][0]:
                    after[x, y] = (total, (path, meant) if meant else path)
        states = after
    ends = [(cost + (model[a, b, 0] if b else 0.0), path) for (a, b), (cost, path) in states.items()]
    path = min(ends, key=lambda e: e[0])[1]
    parts: list[str] = []
    while path:
        path, meant = path
        parts.append(meant)
    return "".join(reversed(parts)).split()


def raw_words(text: str | None) -> list[str]:
    """The words of a text; a run of three or more single letters, or symbols like them, is one, with its spaces."""
    words = (text or "").split()
    lengths = list(map(len, words))
    if lengths.count(1) < 3:
        return words
    single = np.flatnonzero(np.array(lengths) == 1)
    if not (single[2:] - single[:-2] == 2).any():
        return words
    out: list[str] = []
    k = 0
    while k < len(words):
        end = k
        while end < len(words) and lengths[end] == 1 and (words[end].isalnum() or words[end] in LOOKS_LIKE):
            end += 1
        if end - k >= 3 and any(map(str.isalpha, words[k:end])):
            out.append(" ".join(words[k:end]))
        else:
            end = k + 1
            out.append(words[k])
        k = end
    return out


def _costs(words: list[str], model: np.ndarray) -> np.ndarray:
    """Negative log-probabilities of words."""
    c = _codes(words).astype(np.int64)
    first = c[:-1] == 0
    before = np.where(first, 0, np.append(0, c[:-2]))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.add.reduceat(model[before, c[:-1], c[1:]], np.cumsum(sizes) - sizes)


def _once(words: list[str], model: np.ndarray) -> list[str]:
    """Words with one doubled letter as their lattice of two ways reads them: as they stand or with the letter once."""
    if not words:
        return []
    single = [_TWICE.sub(r"\1", w) for w in words]
    shorter = _costs(single, model) + REPEATED < _costs(words, model) + 2 * REPEATED
    return [s if less else w for w, s, less in zip(words, single, shorter.tolist(), strict=True)]


def readings(raw: list[str], model: np.ndarray) -> list[list[str]]:
    """The words that each raw word stands for: its likeliest reading, and those with marks around it as letters and with doubled letters as single ones."""
    out = []
    doubled: list[tuple[int, str]] = []
    for k, r in enumerate(raw):
        if r.isalpha() and not _TWICE.search(w := r.lower()):
            out.append([w])
            continue
        w, e = stripped(r), edged(r)
        found = (restored(w, model) if " " in w or is_disguised(w) else [w]) if w else []
        if e and e != w:
            found += [x for x in restored(e, model, 2) if x not in found]
        if len(twice := _TWICE.findall(w)) == 1 and w.isalpha() and not _THRICE.search(w):
            doubled.append((k, w))
        elif twice:
            found += [x for x in restored(w, model, 2) if x not in found]
        out.append(found)
    for (k, _), x in zip(doubled, _once([w for _, w in doubled], model), strict=True):
        if x not in out[k]:
            out[k].append(x)
    return out


def with_column(docs: DataFrame, name: str, kind: str, make: Callable[[list[str | None]], list | np.ndarray]) -> DataFrame:
    """The rows of ``docs`` with a column made of ``text``, slice by slice; a column of that name is replaced, others stay whatever their names."""
    plain, names = numbered(docs, name)
    inner, place = plain.columns, names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, place, READ_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(make(batch.column(place).to_pylist()))], names=[*inner, "made"])

    return plain.mapInArrow(trimmed(run), plain.withColumn("made", F.lit(None).cast(kind)).schema).toDF(*names, name)


def restored_text(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with ``restored``, the words of the text as they are read, joined by spaces; a null text has none."""
    return with_column(docs, "restored", "string", lambda texts: [" ".join(w for r in readings(raw_words(t), model) for w in r) for t in texts])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram) numbers of the character n-grams of words with their boundaries; shorter words count whole."""
    c = _codes(words).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(words)), lengths + 1)
    inside = np.arange(len(owner)) - starts[owner]
    parts = [mixed(c[np.minimum(np.arange(len(owner)) + k, len(c) - 1)] * _PLACES[k]) for k in range(GRAMS[-1])]
    rows, grams = [], []
    for n in GRAMS:
        width = np.minimum(lengths + 2, n)
        wide = width[owner]
        h = np.zeros(len(owner), np.uint64)
        for k in range(n):
            h += np.where(k < wide, parts[k], np.uint64(n if n == GRAMS[0] else 0))
        keep = inside <= (lengths + 2 - width)[owner]
        if n > GRAMS[0]:
            keep &= (lengths + 2 >= n)[owner]
        rows.append(owner[keep])
        grams.append(mixed(h[keep]).view(np.int64))
    return np.concatenate(rows), np.concatenate(grams)


class _Words:
    """Weights of raw words, kept up to a bound: those seen lately, and those seen since as many other characters before."""

    def __init__(self, model: np.ndarray, grams: np.ndarray, weights: np.ndarray) -> None:
        self._model, self._sorted, self._weights = model, grams, weights
        self._kept: dict[str, float] = {}
        self._before: dict[str, float] = {}
        self._chars = 0

    def learn(self, texts: list[list[str]]) -> None:
        seen: set[str] = set()
        for t in texts:
            seen.update(t)
        if self._chars > KEPT_CHARS:
            self._kept, self._before, self._chars = {}, self._kept, 0
        raw = []
        for w in seen - self._kept.keys():
            if (known := self._before.get(w)) is None:
                raw.append(w)
            else:
                self._kept[w] = known
            self._chars += len(w)
        for lo in range(0, len(raw), READ_WORDS):
            part = raw[lo : lo + READ_WORDS]
            # Most words weigh nothing and share one zero.
            self._kept.update(zip(part, (x or 0.0 for x in self._weigh(part).tolist()), strict=True))

    def _weigh(self, raw: list[str]) -> np.ndarray:
        out = np.zeros(len(raw))
        if not len(self._sorted):
            return out
        read = readings(raw, self._model)
        owner = np.repeat(np.arange(len(raw)), list(map(len, read)))
        words = [w for r in read for w in r]
        if words:
            rows, grams = _grams(words)
            at = np.minimum(np.searchsorted(self._sorted, grams), len(self._sorted) - 1)
            hit = self._sorted[at] == grams
            np.maximum.at(out, owner[rows[hit]], self._weights[at[hit]])
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """What the logistic model sees of a text: its strongest word and its ``TOP`` strongest together, whatever its length."""
        w = np.fromiter(map(self._kept.__getitem__, words), np.float64, len(words))
        strong = np.sort(w[w > 0])[::-1][:TOP]
        return np.array([strong[0], strong.sum()]) if len(strong) else np.zeros(2)


    def evidence_of(self, texts: list[str | None]) -> np.ndarray:
        """The evidence of each text, a row for each."""
        raw = list(map(raw_words, texts))
        self.learn(raw)
        return np.array([self.evidence(t) for t in raw]).reshape(-1, 2)


def _remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    """Fitted parts: the character model, the n-grams with their weights, and the logistic weights."""

    def __init__(self, characters: np.ndarray, grams: np.ndarray, weights: np.ndarray, logistic: np.ndarray) -> None:
        self.characters, self.grams, self.weights, self.logistic = characters, grams, weights, logistic

    def score(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` with ``score`` (0 to 1) of ``text``, in place of a column of that name; null and empty texts have that of no evidence."""
        return with_column(docs, "score", "double", self._scorer())

    def clean(self, docs: DataFrame, below: float = 0.5) -> DataFrame:
        """The rows of ``docs`` with a score under ``below``, in their own columns."""
        inner = [f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)]
        return self.score(docs.toDF(*inner)).where(F.col("score") < below).drop("score").toDF(*docs.columns)

    def _scorer(self) -> Callable[[list[str | None]], np.ndarray]:
        characters, grams, weights, logistic = self.characters, self.grams, self.weights, self.logistic
        held: list[_Words] = []

        def make(texts: list[str | None]) -> np.ndarray:
            if not held:
                held.append(_Words(characters, grams, weights))
            z = held[0].evidence_of(texts) @ logistic[:-1] + logistic[-1]
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return make


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` (doc_id, text) that aren't held out, at most ``train_rows`` of each class.

    The rows taken are those with the smallest hash of doc_id.  A doc_id that is
    labelled twice counts as toxic if one label says so.  Null labels count for
    nothing.  Without labelled rows of both classes every score is the same.
    """
    characters = character_model(docs)
    one = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = one.where(_remainder() != 0)
    chosen = None
    for t in (0, 1):
        part = known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * train_rows keys.
    chosen = saved(chosen, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    train = saved(texts.select("text", "toxic"), "labelled").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    none = ToxicityModel(characters, np.empty(0, np.int64), np.empty(0), np.array([0.0, 0.0, -2.0]))
    if len(sizes) < 2:
        return none

    def counted(wanted: np.ndarray | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams, counts, held = [], [], 0
            for batch in by_bytes(batches, 0, READ_BYTES):
                found = []
                for text in batch.column(0).to_pylist():
                    words = list({w for r in readings(list(set(raw_words(text))), characters) for w in r})
                    if words:
                        g = np.unique(_grams(words)[1])
                        found.append(g if wanted is None else g[wanted[np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)] == g])
                if found:
                    g, n = np.unique(np.concatenate(found), return_counts=True)
                    grams.append(g)
                    counts.append(n)
                    held += len(g)
                if held > HELD_GRAMS:
                    yield added(grams, counts)
                    grams, counts, held = [], [], 0
            if held:
                yield added(grams, counts)

        def added(grams: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
            g, at = np.unique(np.concatenate(grams), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(np.bincount(at, np.concatenate(counts), len(g)).astype(np.int64))], names=["gram", "n"])

        return count

    def rows_of(t: int, wanted: np.ndarray | None) -> DataFrame:
        return train.where(F.col("toxic") == t).select("text").mapInArrow(trimmed(counted(wanted)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))

    # A text's n-grams divided by LEAST_PART bound these rows, whatever the number of texts.
    toxic = rows_of(1, None).where(F.col("n") >= max(LEAST_ROWS, LEAST_PART * sizes[1])).toPandas().sort_values("gram")
    if not len(toxic):
        return none
    grams, pos = toxic["gram"].to_numpy(), toxic["n"].to_numpy()
    clean = rows_of(0, grams).toPandas().set_index("gram")["n"]
    neg = clean.reindex(grams).fillna(0).to_numpy()

    def kept(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return grams[weight >= LEAST_WEIGHT], weight[weight >= LEAST_WEIGHT]

    def evidence(t: int) -> pd.DataFrame:
        without = (characters, *kept(_weights(pos - t, neg - (1 - t), sizes[1] - t, sizes[0] - (1 - t))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _Words(*without)
            for batch in by_bytes(batches, 0, READ_BYTES):
                x = words.evidence_of(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["strongest", "top"])

        return train.where(F.col("toxic") == t).select("text").mapInArrow(trimmed(run), "strongest double, top double").toPandas().assign(toxic=t)

    seen = pd.concat([evidence(0), evidence(1)])
    return ToxicityModel(characters, *kept(_weights(pos, neg, sizes[1], sizes[0])), _logistic(seen[["strongest", "top"]].to_numpy(), seen["toxic"].to_numpy()))


def _weights(pos: np.ndarray, neg: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """How much likelier n-grams are in toxic rows, as logarithms less DOUBT standard errors; 0 where too few toxic rows hold one."""
    share = toxic / max(toxic + clean, 1)
    p, n = PRIOR_ROWS * share, PRIOR_ROWS * (1 - share)
    ratio = np.log((pos + p) / (toxic + p)) - np.log((neg + n) / (clean + n))
    doubt = DOUBT * np.sqrt(1 / (pos + 0.5) + 1 / (neg + n))
    return np.where(pos >= max(LEAST_ROWS, LEAST_PART * toxic), ratio - doubt, 0.0)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; a row without doc_id isn't held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = fit(docs, labels).score(rows)
    return scored.select("doc_id", F.coalesce(_remainder() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
