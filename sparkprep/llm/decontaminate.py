"""Benchmark decontamination by spaced seeds.

Words are hashed; fixed masks of span ``SPAN`` pick seven of eleven positions,
so a seed still matches when words at the ignored positions were substituted.
Seeds of the benchmark and of the documents are joined on their hash; around
each hit the two texts are laid side by side on that diagonal, and the best
segment (a match counts +1, a substitution -2) decides: an overlap holds
``MIN_MATCH`` equal words or more.

A bitmap of the benchmark's seeds (fixed size, whatever the benchmark's) keeps
documents' other seeds out of the join; a full bitmap would only cost time.
Matched pairs come back per document and item.

Items shorter than a mask have one seed each, of all their words, and are found
where a document has exactly these words in a row; for that, documents also get
the seeds of the lengths that such items have. Items of fewer than ``LEAST`` words
are found only in documents of just these words: one word that occurs somewhere is
no evidence.

Null and empty texts have no seeds. Words are compared with A-Z lower-cased. Null
ids of documents and items are reported as null; repeated rows give their pairs
once per id and text. Very long texts are searched whole; an empty table gives no
rows; ties between equally good overlaps go to the longer one; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mix64, saved, settled, shipped, sliced, text_bytes, word_count, WordHash, words

# Fixed masks: 1 = the word takes part in the seed.
MASKS = ("11100101011", "11011000111", "10110110101", "11010011011")
SPAN = 11
MIN_MATCH = 11
LEAST = 5             # words of an item that may be found inside a longer document
SUBSTITUTION = -2
CONTEXT = 40          # words kept on either side of a document's hits
JOIN_GAP = 120        # hits closer than this share one stretch of context
BITMAP_BITS = 25      # two bits of it stand for a seed


def seeds(h):
    """(mask number, position) -> seed, as one array per mask."""
    import numpy as np
    n = len(h) - SPAN + 1
    if n <= 0:
        return []
    out = []
    for m, mask in enumerate(MASKS):
        acc = np.full(n, np.uint64(m + 1))
        for o, bit in enumerate(mask):
            if bit == "1":
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[o:o + n]
        out.append(mix64(acc))
    return out


def short_seeds(h, lengths) -> list:
    """Seeds of all runs of k words, for each k of ``lengths`` (of the whole text, for k below LEAST)."""
    import numpy as np
    out = []
    for k in lengths:
        n = len(h) - k + 1
        if n <= 0 or k < LEAST and n > 1:
            out.append(np.zeros(0, dtype=np.uint64))
            continue
        acc = np.full(n, np.uint64(1000 + k))
        for o in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[o:o + n]
        out.append(mix64(acc))
    return out


def best_segment(a, b) -> tuple[int, int]:
    """Equal words and length of the best-scoring aligned segment."""
    import numpy as np
    score = np.where(a == b, 1, SUBSTITUTION)
    run = np.concatenate([[0], np.cumsum(score)])
    gain = run - np.minimum.accumulate(run)
    end = int(np.argmax(gain))
    start = int(np.argmin(run[:end + 1]))
    return int((score[start:end] == 1).sum()), end - start


def benchmark_seeds(bench: DataFrame) -> DataFrame:
    """item_id, seed, off of every seed, distinct."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        cache = WordHash()
        for b in batches:
            item, seed, off = [], [], []
            for i, t in zip(b.column("item_id").to_pylist(), text_bytes(b.column("text"))):
                h = hash_words(words(t or b""), cache)
                for s in seeds(h) if len(h) >= SPAN else short_seeds(h, [len(h)] if len(h) else []):
                    item += [i] * len(s)
                    seed.append(s.view(np.int64))
                    off.append(np.arange(len(s), dtype=np.int32))
            if item:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.int64()), pa.array(np.concatenate(seed)), pa.array(np.concatenate(off))],
                    names=["item_id", "seed", "off"])
    return bench.mapInArrow(run, "item_id long, seed long, off int").distinct()


def benchmark_words(bench: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        cache = WordHash()
        for b in batches:
            h = [hash_words(words(t or b""), cache).tobytes() for t in text_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(h, pa.binary())], names=["item_id", "item"])
    return bench.mapInArrow(run, "item_id long, item binary")


def short_lengths(bench: DataFrame) -> list[int]:
    """Lengths in words, below SPAN, that items have (ten numbers at most)."""
    n = word_count(F.col("text"))
    return sorted(r.n for r in bench.select(n.alias("n")).filter((F.col("n") > 0) & (F.col("n") < SPAN)).distinct().collect())


def stretches(docs: DataFrame, bitmap, lengths: list[int]) -> DataFrame:
    """Stretches of documents around seeds that the bitmap lets through:
    doc_id, text_hash, words (hashes as bytes), seed and its place in the stretch."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        cache, bits = WordHash(), np.frombuffer(bitmap.value, dtype=np.uint8)
        here = lambda slot: (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        second, low = np.uint64(64 - 2 * BITMAP_BITS), np.uint64((1 << BITMAP_BITS) - 1)
        first = np.uint64(64 - BITMAP_BITS)
        for b in batches:
            rows = []
            for i, th, t in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(),
                                text_bytes(b.column("text"))):
                h = hash_words(words(t or b""), cache)
                at, seed = [], []
                for s in (seeds(h) + short_seeds(h, lengths)):
                    ok = np.flatnonzero(here((s >> first).astype(np.int64)))
                    ok = ok[here(((s[ok] >> second) & low).astype(np.int64)) == 1]
                    at.append(ok)
                    seed.append(s[ok])
                if not at or not sum(map(len, at)):
                    continue
                at, seed = np.concatenate(at), np.concatenate(seed).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > JOIN_GAP) + 1):
                    lo = max(0, int(at[part[0]]) - CONTEXT)
                    hi = int(at[part[-1]]) + SPAN + CONTEXT
                    rows.append((i, th, h[lo:hi].tobytes(), seed[part], (at[part] - lo).astype(np.int32)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[4] for r in rows], pa.list_(pa.int32()))],
                    names=["doc_id", "text_hash", "words", "seeds", "places"])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    return d.mapInArrow(sliced(run), "doc_id long, text_hash long, words binary, seeds array<long>, places array<int>")


def verify(pairs: DataFrame) -> DataFrame:
    """matched and length of each (words, item, diagonal)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            out = []
            for w, item, diagonal in zip(b.column("words").to_pylist(), b.column("item").to_pylist(),
                                         b.column("diagonal").to_pylist()):
                w, item = np.frombuffer(w, np.uint64), np.frombuffer(item, np.uint64)
                lo, hi = max(0, diagonal), min(len(w), diagonal + len(item))
                out.append(best_segment(w[lo:hi], item[lo - diagonal:hi - diagonal]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), b.column("item_id"),
                 pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32())],
                names=["doc_id", "text_hash", "item_id", "matched", "length"])
    return pairs.mapInArrow(run, "doc_id long, text_hash long, item_id long, matched int, length int")


def contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, matched, length: every document that holds a
    passage of a benchmark item, with the best overlap of each such pair."""
    spark = docs.sparkSession
    shipped(spark)
    # a number of its own for each row of the benchmark: ids may repeat or be null
    named = saved(bench.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("name"),
                               F.col("text").cast("string").alias("text")), "benchmark-items")
    bench = named.select(F.col("item").alias("item_id"), "text")
    bs = saved(benchmark_seeds(bench), "benchmark-seeds")
    first = F.shiftrightunsigned("seed", 64 - BITMAP_BITS)
    second = F.shiftrightunsigned("seed", 64 - 2 * BITMAP_BITS).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    slots = bs.select(F.explode(F.array(first.cast("int"), second.cast("int"))).alias("s")).distinct()
    bits = bytearray(1 << BITMAP_BITS - 3)
    for r in slots.toLocalIterator():       # at most 2^BITMAP_BITS numbers
        bits[r.s >> 3] |= 1 << (r.s & 7)
    st = saved(stretches(docs, spark.sparkContext.broadcast(bytes(bits)), short_lengths(bench))
               .withColumn("stretch", F.monotonically_increasing_id()), "decontamination-stretches")
    hits = (st.select("stretch", F.explode(F.arrays_zip("seeds", "places")).alias("x"))
            .select("stretch", F.col("x.seeds").alias("seed"), F.col("x.places").alias("place"))
            .join(bs, "seed")
            .select("stretch", "item_id", (F.col("place") - F.col("off")).alias("diagonal")).distinct())
    pairs = (hits.join(st.select("stretch", "doc_id", "text_hash", "words"), "stretch")
             .join(benchmark_words(bench), "item_id"))
    found = verify(pairs.select("doc_id", "text_hash", "item_id", "words", "item", "diagonal"))
    enough = F.least(F.lit(MIN_MATCH), word_count(F.col("text")))
    return (found.join(named.withColumnRenamed("item", "_item"), F.col("item_id") == F.col("_item"))
            .filter(F.col("matched") >= enough)
            .groupBy("doc_id", "text_hash", F.col("name").alias("item_id"))
            .agg(F.max(F.struct("matched", "length")).alias("x"))
            .select("doc_id", "text_hash", "item_id", "x.matched", "x.length"))


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a benchmark passage, same columns."""
    bad = settled(docs.sparkSession, lambda: contaminated(docs, bench).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "contaminated-rows")
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) \
        & (F.xxhash64(docs["text"].cast("string")) == bad["_th"])
    return docs.join(bad, on, "left_anti")
