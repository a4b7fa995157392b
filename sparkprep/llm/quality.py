"""Quality rules with adaptive thresholds.

Per document a few plain measures are taken. Fixed cutoffs are replaced by
thresholds per (language, source), read from mergeable quantile sketches: values
are counted in logarithmic bins (a DDSketch: merging adds bin counts, and every
quantile is right to within ``ACCURACY`` of its value), so the sketches are an
ordinary distributed aggregation and do not depend on row order. The thresholds
are joined back to the measures and filter the documents.

A measure is judged by Tukey fences, the quartiles widened by ``FENCE`` quartile
ranges, in both directions. A group that is too small (fewer than ``BEYOND``
documents beyond a quantile), or whose quartiles are equal, is judged by the
merged sketch of its language: by its quartiles, and where these are equal (a
measure that is mostly zero) by the first of the wider ``TAILS`` that differ, with
the fence that a normal distribution would have; then likewise by that of all
documents. A measure equal for all but a thousandth of them rejects nothing.

Null texts count as empty (0 words: they fail the base rule). Null languages
and sources form groups of their own. Repeated rows are measured alike; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, saved, shingle_hashes, shipped, sliced, text_bytes, WordHash

MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20      # the base rule
ACCURACY = 0.01                             # relative error of a sketch
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
SMALLEST = 1e-4                             # smaller values share the zero bin
FENCE = 3.0                                 # widths of the quartile range
TAILS = (0.25, 0.05, 0.01, 0.001)           # quantiles from both ends, the quartiles first
BEYOND = 5                                  # documents beyond a quantile that is trusted
MEASURES = ("word_len", "symbol_share", "dup_line_share", "repeat_share")
LOW = ("word_len",)                         # measures with a lower limit as well
ZERO = -(1 << 20)                           # the bin of zero

_SCHEMA = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, "
           "n_lines long, n_dup_lines long, n_repeat_words long")
_SYMBOLS = b"#*$%&|<>"


def _repeat_words(ws: list[bytes], cache: WordHash) -> int:
    """Words inside 5-word windows that occur twice or more in the text."""
    import numpy as np
    if len(ws) < 6:
        return 0
    h = shingle_hashes(hash_words(ws, cache))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    edges = np.zeros(len(ws) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + 5, -1)
    return int((np.cumsum(edges) > 0).sum())


def _measure(text: bytes, cache: WordHash) -> tuple:
    ws = text.split()
    joined = b"".join(ws)
    symbols = sum(text.count(bytes([c])) for c in _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    # continuation bytes do not begin a code point
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    return len(ws), chars, symbols, len(lines), len(lines) - len(set(lines)), _repeat_words(ws, cache)


def measures(docs: DataFrame) -> DataFrame:
    """One narrow row per document with the base measures."""
    shipped(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        cache = WordHash()
        for b in batches:
            rows = [_measure(t or b"", cache) for t in text_bytes(b.column("text"))]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source")]
                + [pa.array(c, pa.int64()) for c in cols],
                names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines",
                       "n_dup_lines", "n_repeat_words"])

    d = docs.select(*[F.col(c).cast(t).alias(c) for c, t in
                      (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))])
    return d.mapInArrow(sliced(run), _SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _values() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {"word_len": F.col("word_chars") / n,
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n}


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the mergeable sketches as rows. Only
    documents that pass the base rule are learned from."""
    bin_of = lambda v: F.when(v <= SMALLEST, ZERO).otherwise(
        F.ceil(F.log(v) / math.log(GAMMA))).cast("int")
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bin_of(v).alias("bin")) for k, v in _values().items()])
    return (m.filter(~base_failed()).select("lang", "source", F.explode(each).alias("x"))
            .groupBy("lang", "source", "x.measure", "x.bin").agg(F.count("*").alias("n")))


def quantiles(sketch: DataFrame, qs: dict[str, float], key=("lang", "source", "measure")) -> DataFrame:
    """Quantiles of each (lang, source, measure), one column per name in ``qs``,
    and n, the number of values."""
    upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(*key))})
    value = F.when(F.col("bin") == ZERO, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    s = s.withColumn("value", value)
    at = lambda q: F.min(F.when(F.col("upto") > q * (F.col("all") - 1), F.col("value")))
    return s.groupBy(*key).agg(F.first("all").alias("n"), *[at(q).alias(name) for name, q in qs.items()])


def thresholds(sketch: DataFrame) -> DataFrame:
    """lang, source and <measure>_low / <measure>_high limits, one row a group
    (null: no limit)."""
    # sketches merge: group, language, all
    none = F.lit(None).cast("string")
    each = F.array(*[F.struct(F.lit(k).alias("level"), a.alias("lang"), b.alias("source")) for k, (a, b) in
                     enumerate(((F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)))])
    merged = (sketch.select("measure", "bin", "n", F.explode(each).alias("x"))
              .groupBy("x.level", "x.lang", "x.source", "measure", "bin").agg(F.sum("n").alias("n")))
    qs = {f"{side}{k}": q for k, p in enumerate(TAILS) for side, q in (("a", p), ("z", 1 - p))}
    q = quantiles(merged, qs, ("level", "lang", "source", "measure"))
    z = [-NormalDist().inv_cdf(p) for p in TAILS]
    limits = []
    for k, p in enumerate(TAILS):
        a, b = F.col(f"a{k}"), F.col(f"z{k}")
        fence = ((2 * FENCE + 1) * z[0] / z[k] - 1) / 2         # FENCE for the quartiles
        trusted = (F.col("n") * p >= BEYOND) & (b > a)
        limits.append(F.when(trusted if k == 0 else trusted & (F.col("level") > 0),
                             F.struct((a - fence * (b - a)).alias("low"), (b + fence * (b - a)).alias("high"))))
    q = q.select("level", "lang", "source", "measure", F.coalesce(*limits).alias("limits"))
    pick = lambda m: F.max(F.when(F.col("measure") == m, F.col("limits")))
    out, best = sketch.select("lang", "source").distinct(), {m: [] for m in MEASURES}
    for k, on in enumerate((("lang", "source"), ("lang",), ())):
        t = q.filter(F.col("level") == k).groupBy(*on).agg(*[pick(m).alias(f"{m}_{k}") for m in MEASURES])
        t = t.withColumnsRenamed({c: f"_{c}" for c in on})
        match = F.lit(True)
        for c in on:
            match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(t, match, "left").drop(*[f"_{c}" for c in on])
        for m in MEASURES:
            best[m].append(F.col(f"{m}_{k}"))
    limits = {m: F.coalesce(*best[m]) for m in MEASURES}
    return out.select("lang", "source", *[limits[m].high.alias(f"{m}_high") for m in MEASURES],
                      *[limits[m].low.alias(f"{m}_low") for m in LOW])


def judge(docs: DataFrame) -> DataFrame:
    """Measures of every document with base_failed and kept."""
    m = saved(measures(docs), "quality-measures")
    t = thresholds(saved(sketches(m), "quality-sketches")).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    d = m.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    v = _values()
    outside = F.lit(False)      # no limit compares as null: not outside
    for k in MEASURES:
        outside = outside | F.coalesce(v[k] > F.col(f"{k}_high"), F.lit(False))
    for k in LOW:
        outside = outside | F.coalesce(v[k] < F.col(f"{k}_low"), F.lit(False))
    return (d.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & ~outside)
            .drop("_lang", "_source"))
