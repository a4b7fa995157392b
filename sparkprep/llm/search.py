"""Reversed lexical search: the queries are indexed, the documents stream past.

1. The items' terms are numbered and make an inverted index (term -> items). It is
   broadcast in blocks of items of at most ``BLOCK`` postings each, whatever the
   number of items, so its size is bounded; a block is one pass over the documents.
2. One pass turns each document into its length and the counts of the terms that
   the block knows (a narrow written table); sums over it give N, L and df.
3. A second pass over that narrow table scores each document against the items of
   its terms only, and keeps a heap of the best ``k`` documents per item and task.
4. Heaps are merged in two steps, first by item and group of tasks, then by item,
   so that no task sees more than k rows of each of its inputs.

Scores are sums of integers held in doubles; all stay below 2**53, where doubles
are exact, as long as an item has fewer than 200,000 distinct terms; items with
more are added up as 64-bit integers.

Each row of the items is an item of its own, also if ids or texts repeat or are
null; an item without terms has no hits. Each row of the documents is a document;
null and empty texts have no terms and do not count in N. Equal scores go by
ascending document id, null ids last. Empty tables give no rows. Texts of any
length are read whole; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, saved, shipped, sliced, text_bytes

K = 10
BLOCK = 1_000_000           # postings of the index that a task holds at a time
_CHUNK = 1_000_000          # postings scored at a time
_GROUPS = 64                # groups of tasks in which heaps meet first
_EXACT_TERMS = 200_000
_NULL_ID = (1 << 63) - 1

# ASCII letters and digits and every other byte of UTF-8 belong to a term, A-Z lower-cased.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

ORACLE = r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
size AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM terms WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM size),
tf AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM terms) GROUP BY ALL),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL),
weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, nn),
part AS (
  SELECT wanted.item_id, tf.doc_id,
         w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * n * nn) // ll))) AS x
  FROM wanted JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total),
hit AS (SELECT item_id, doc_id, CAST(sum(x) AS BIGINT) AS score FROM part GROUP BY ALL HAVING sum(x) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM hit)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def terms_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split() if raw else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def numbered_items(items: DataFrame) -> DataFrame:
    """item (a number of the row), item_id, text, size in bytes: written once."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return saved(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "text",
                             F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")), "search-items")


def blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in parts whose terms (at most half their bytes) fit ``most``
    postings; an item beyond that alone is a part of its own."""
    heavy = F.col("size") > 2 * most
    total = items.filter(~heavy).agg(F.sum("size")).first()[0] or 0
    # hashing spreads items evenly; parts are filled to half on average
    n = max(1, math.ceil(total / most))
    part = F.pmod(F.xxhash64("item"), F.lit(n))
    return ([items.filter(~heavy & (part == i)) for i in range(n)]
            + [items.filter(F.col("item") == r.item) for r in items.filter(heavy).select("item").toLocalIterator()])


def inverted(items: list) -> tuple[dict[bytes, int], list[list[int]]]:
    """Numbers of the terms, and per term the positions in ``items`` that hold it."""
    number: dict[bytes, int] = {}
    postings: list[list[int]] = []
    for at, r in enumerate(items):
        for term in set(terms_of((r.text or "").encode())):
            t = number.setdefault(term, len(number))
            if t == len(postings):
                postings.append([])
            postings[t].append(at)
    return number, postings


def term_counts(docs: DataFrame, number) -> DataFrame:
    """doc_id, n (terms of the document), t (numbers of known terms), tf."""
    def run(batches):
        import pyarrow as pa
        get = number.value.get
        for b in batches:
            sizes, known, freq = [], [], []
            for raw in text_bytes(b.column("text")):
                terms = terms_of(raw)
                sizes.append(len(terms))
                c = Counter(map(get, terms))
                c.pop(None, None)
                known.append(list(c))
                freq.append(list(c.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(known, pa.list_(pa.int32())),
                 pa.array(freq, pa.list_(pa.int64()))], names=["doc_id", "n", "t", "tf"])

    return saved(id_text(docs).mapInArrow(sliced(run), "doc_id long, n long, t array<int>, tf array<long>")
                 .filter(F.col("n") > 0), "search-counts")


def document_frequencies(counts: DataFrame) -> DataFrame:
    """t, df; a task counts its own documents before anything is shuffled."""
    def run(batches):
        import pyarrow as pa
        seen: Counter = Counter()
        for b in batches:
            seen.update(b.column("t").flatten().to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())],
                                         names=["t", "df"])
    return counts.select("t").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df").alias("df"))


class Heaps:
    """The best ``k`` documents of each item: (score, -id), smallest first."""

    def __init__(self, n_items: int, k: int):
        import numpy as np
        self.k, self.heaps = k, defaultdict(list)
        self.least = np.ones(n_items, dtype=np.int64)       # a score below it cannot enter

    def update(self, items, scores, ids) -> None:
        import numpy as np
        may = np.flatnonzero(scores >= self.least[items])
        for item, score, minus in zip(items[may].tolist(), scores[may].tolist(), (-ids[may]).tolist()):
            heap = self.heaps[item]
            if len(heap) < self.k:
                heapq.heappush(heap, (score, minus))
            elif (score, minus) > heap[0]:
                heapq.heapreplace(heap, (score, minus))
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def scorer(weights, begin, items, n_items: int, n_docs: int, n_terms: int, exact_floats: bool):
    """scores(rows, t, tf, n): the (row, item, score) with a score above 0, where a
    row's terms are t[i], tf[i] for rows[i] and its document has n[row] terms."""
    import numpy as np
    size = np.diff(begin)

    def scores(rows, t, tf, n):
        m = 100 - 90 + (90 * n * n_docs) // n_terms
        x = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
        many = size[t]
        ends = np.cumsum(many)
        posting = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[t] - (ends - many), many)
        cell = np.repeat(rows, many) * n_items + items[posting]
        x = np.repeat(x, many)
        cells = len(n) * n_items
        if exact_floats:
            total = np.bincount(cell, weights=x, minlength=cells).astype(np.int64)
        else:
            total = np.zeros(cells, dtype=np.int64)
            np.add.at(total, cell, x)
        hit = np.flatnonzero(total > 0)
        return hit // n_items, hit % n_items, total[hit]

    return scores


def best_of_block(counts: DataFrame, index, k: int) -> DataFrame:
    """at (position of the item in its block), score, doc_id: the heaps of all tasks."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        weights, begin, items, n_items, n_docs, n_terms, exact = index.value
        heaps, scores = Heaps(n_items, k), scorer(*index.value)
        per_term = np.diff(begin)

        def cuts(sizes, work):
            """Rows in runs of at most _CHUNK postings and dense cells (a row at least)."""
            at, sofar = 0, 0
            for r, w in enumerate((np.add.reduceat(np.append(work, 0), np.minimum(np.cumsum(sizes) - sizes, len(work)))
                                   * (sizes > 0) + n_items).tolist()):
                if sofar and sofar + w > _CHUNK:
                    yield at, r
                    at, sofar = r, 0
                sofar += w
            if at < len(sizes):
                yield at, len(sizes)

        for b in batches:
            sizes = b.column("t").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            t, tf = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "tf"))
            n = b.column("n").to_numpy()
            ids = b.column("doc_id").fill_null(_NULL_ID).to_numpy()
            ends = np.cumsum(sizes)
            for lo, hi in cuts(sizes, per_term[t]):
                first, last = ends[lo] - sizes[lo], ends[hi - 1]
                row, item, score = scores(np.repeat(np.arange(hi - lo), sizes[lo:hi]), t[first:last], tf[first:last], n[lo:hi])
                heaps.update(item, score, ids[lo:hi][row])
        found = [(at, score, -minus) for at, heap in heaps.heaps.items() for score, minus in heap]
        at, score, doc = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(score, pa.int64()),
             pa.array([None if d == _NULL_ID else d for d in doc], pa.int64())], names=["at", "score", "doc_id"])

    return counts.mapInArrow(run, "at int, score long, doc_id long")


def merged(heaps: DataFrame, k: int) -> DataFrame:
    """``heaps`` with rank 1 to k per item."""
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = heaps.withColumn("_group", F.spark_partition_id() % _GROUPS)
    for by in (("at", "_group"), ("at",)):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return part.drop("_group")


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item (a number of the row of ``items``), item_id, rank, doc_id, score."""
    import numpy as np
    spark = docs.sparkSession
    shipped(spark)
    out = None
    for part in blocks(numbered_items(items), block):
        rows = part.collect()                   # a block's items, bounded by its postings
        number, postings = inverted(rows)
        known = spark.sparkContext.broadcast(number)
        counts = term_counts(docs, known)
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(number), dtype=np.int64)
        for r in document_frequencies(counts).collect():        # a row per term of the block
            weights[r.t] = weight(n_docs, r.df)
        begin = np.cumsum([0] + [len(p) for p in postings])
        holders = np.array([at for p in postings for at in p], dtype=np.int64)
        exact = np.bincount(holders, minlength=1).max() < _EXACT_TERMS
        index = spark.sparkContext.broadcast((weights, begin, holders, len(rows), n_docs, n_terms, exact))
        best = merged(best_of_block(counts, index, k), k)
        names = spark.createDataFrame([(at, r.item, r.item_id) for at, r in enumerate(rows)],
                                      "at int, item long, item_id long")
        found = best.join(names, "at").select("item", "item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
