"""Packing documents into padded batches of optimal length buckets.

The histogram of lengths over all documents is one aggregation; it has a row for
each different length, whatever the number of documents.  Dynamic programming
over it finds the bucket boundaries with the least padding: the cost of a bucket
is concave, so the best last boundary moves monotonically and each round is
solved by divide and conquer, all intervals of a depth at once.  Batches form
inside each bucket: as many documents as its length fits into the token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import saved

BUCKETS, BUDGET = 16, 65536
#: Documents of a bucket that are numbered together.
SHARD_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Words of a text between ASCII white space; a null or blank text has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")), F.lit(0)).cast("long")


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Ascending upper lengths of at most ``buckets`` buckets with the least padding in all; the last is the greatest length."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    if not n:
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Padding of the lengths from number i up to, without, number j, in one bucket."""
        return x[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])

    best = np.append(0.0, cost(np.zeros(n, np.int64), np.arange(1, n + 1)))
    cut_at = []
    for k in range(2, min(buckets, n) + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        # Intervals of ends still to be solved, with the range of their last boundaries.
        lo, hi, first, last = (np.array([v]) for v in (k, n, k - 1, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(last, j - 1) - first + 1
            begin = np.cumsum(size) - size
            i = np.arange(size.sum()) - np.repeat(begin - first, size)
            total = best[i] + cost(i, np.repeat(j, size))
            least = np.minimum.reduceat(total, begin)
            hit = np.flatnonzero(total == np.repeat(least, size))
            at = i[hit[np.searchsorted(hit, begin)]]
            new[j], cut[j] = least, at
            lo, hi, first, last = np.append(lo, j + 1), np.append(j - 1, hi), np.append(first, at), np.append(at, last)
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        cut_at.append(cut)
        best = new
    ends, j = [n], n
    for cut in reversed(cut_at):
        j = int(cut[j])
        ends.append(j)
    return [int(x[j - 1]) for j in reversed(ends)]


def _placed(rows: DataFrame, buckets: int, budget: int) -> DataFrame:
    """Saved ``rows`` (doc_id, n_tokens and others) with bucket, padded_length, batch_id and place."""
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toPandas()
    ends = bucket_lengths(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets) or [0]
    bounds = F.array(*(F.lit(e).cast("long") for e in ends))
    number = F.size(F.filter(bounds, lambda e: e < F.col("n_tokens")))
    counts = {e: 0 for e in ends}
    for s, n in zip(histogram["n_tokens"], histogram["n"], strict=True):
        counts[ends[int(np.searchsorted(ends, s))]] += int(n)
    parts = F.element_at(F.array(*(F.lit(-(-max(n, 1) // SHARD_ROWS)) for n in counts.values())), F.col("bucket") + 1)
    dealt = rows.withColumn("bucket", number).withColumn("padded_length", F.element_at(bounds, F.col("bucket") + 1)).withColumn("shard", F.pmod(F.xxhash64("doc_id"), parts))
    fits = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1))), F.lit(1))
    row = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    placed = dealt.withColumn("row", row).withColumn("fits", fits)
    batch = F.concat_ws("-", "bucket", "shard", F.floor(F.col("row") / F.col("fits")))
    return placed.withColumn("batch_id", batch).withColumn("place", (F.col("row") % F.col("fits")).cast("long")).drop("shard", "row", "fits")


def packed(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, padded_length, batch_id, place) of every row of ``docs``.

    ``length`` is the number of tokens of a row, by default the words of text;
    null counts as 0.  bucket is the number of the length bucket, padded_length
    its length, which is that of its longest row; batch_id names a batch of that
    bucket and place the row's place in it from 0.  padded_length times the rows
    of a batch is at most ``budget``, unless a single row is longer.  Batches of
    one bucket are filled in order of doc_id within shards of about SHARD_ROWS
    rows, so all but the last of a shard are full.  Rows that repeat a doc_id are
    rows of their own.
    """
    size = F.coalesce((n_words(F.col("text")) if length is None else length).cast("long"), F.lit(0).cast("long"))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_tokens")), "lengths")
    return _placed(rows, buckets, budget).select("doc_id", "n_tokens", "bucket", "padded_length", "batch_id", "place")


def padded_batches(docs: DataFrame, ids: str = "ids", pad: int = 0, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(batch_id, padded_length, doc_ids, input_ids, attention) of the batches that rows (doc_id and a column of token ids) form.

    input_ids has an array of padded_length ids for each document, filled up with
    ``pad``, and attention one of 1 for ids and 0 for filling, in the order of
    doc_ids.  Null ids are none.  A batch holds about ``budget`` ids, or one longer
    document.
    """
    listed = F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>"))
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(listed).cast("long").alias("n_tokens"), listed.alias("ids")), "ids")
    one = F.struct("place", "doc_id", "ids", "n_tokens")
    batches = _placed(rows, buckets, budget).groupBy("batch_id", "padded_length").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    rest = lambda r: (F.col("padded_length") - r["n_tokens"]).cast("int")
    filled = F.transform("rows", lambda r: F.concat(r["ids"], F.array_repeat(F.lit(pad), rest(r))))
    seen = F.transform("rows", lambda r: F.concat(F.array_repeat(F.lit(1), r["n_tokens"].cast("int")), F.array_repeat(F.lit(0), rest(r))))
    return batches.select("batch_id", "padded_length", F.col("rows.doc_id").alias("doc_ids"), filled.alias("input_ids"), seen.alias("attention"))
