"""Toxicity scores: gradient-boosted trees over dense features, isotonic
calibration.

Each text becomes a dozen rates: lexicon densities (a given lexicon, its
respelled forms, and a lexicon learned from labels), lexicon words near the
second person, capitals, punctuation and obfuscation. Labels are split by a hash
of the id: the learned lexicon, the trees and the calibration each use rows of
their own, so that none is fitted to what another has seen. Labels, language,
source and id are never features.

``MAX_LEXICON_DOCS`` and ``MAX_TRAIN_ROWS`` bound the labelled rows that are
learned from (hash order, so a fixed sample); every text is scored.

Null and empty texts have no words: all rates are 0 and they are scored like any
other. Repeated rows get equal scores; an id with several labels counts as toxic
if any of them says so; null labels and null ids teach nothing. With no usable
labels, or one class only, all get the share of toxic labels (0 if none), kept
below the threshold: what cannot tell texts apart must not reject them. Where the
calibration part lacks a class, or its isotonic fit has one step only (the trees
do not order texts they have not seen), scores are no rates: they keep their order
and are scaled to stay below the threshold.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_text, saved, settled, shipped, sliced, text_bytes

HELD_OUT, FOLDS = 2, 4          # crc32(id) mod 4 == 2 is never learned from
LEXICON_FOLD, TREE_FOLD, CALIBRATION_FOLD = 0, 1, 3
THRESHOLD = 0.3
MAX_LEXICON_DOCS = 20_000
MAX_TRAIN_ROWS = 100_000
LEARNED_WORDS = 300             # size of the learned lexicon
TREES, DEPTH, STEP = 20, 4, 0.2
NEAR = 5                        # words between a lexicon word and the second person

# Insults and abusive words of everyday English.
LEXICON = """arsehole asshole bastard bitch clown coward creep crap cretin damn degenerate despicable dimwit
disgrace disgusting dumb dumbass dunce filth fool fraud freak garbage hate hateful hideous horrible idiot idiots
idiotic ignorant imbecile jerk kill liar loser losers lowlife lunatic maggot moron morons moronic nasty nonsense
parasite pathetic pig pigs psycho rat repulsive retard revolting rotten scum scumbag shit shut sick sickening slime
stupid sucker sucks swine terrible trash trashy twit ugly useless vermin vile weirdo worthless wretch""".split()
# Second-person words of English, German, French and Spanish.
SECOND = """you your yours yourself yourselves u ur du dich dir dein deine deinen euch euer tu te toi ton ta tes vous
votre vos usted ustedes ti contigo vosotros""".split()

_LEET = str.maketrans("01345@$!7", "oieasasit")
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|-_~`/\\+=^"
_INSIDE = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d+[^\W_]|^\d+[^\W\d_]{3,}", re.UNICODE)
LEX, RESPELLED, YOU, OBFUSCATED, CAPITALS, LEARNED, MARKED, DIGITS = (1 << k for k in range(8))

FEATURES = ("log_words", "lexicon", "log_lexicon", "respelled", "learned", "log_learned", "second", "near_second",
            "capital_words", "capital_letters", "exclaimed", "punctuation", "obfuscated", "digits")


class WordMarks(dict):
    """word as written -> bit set of what it is, remembered up to a limit."""
    LIMIT = 200_000

    def __init__(self, learned=()):
        super().__init__()
        self.lexicon, self.second, self.learned = frozenset(LEXICON), frozenset(SECOND), frozenset(learned)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip(_EDGES)
        low = core.lower()
        bits = 0
        if low in self.lexicon:
            bits |= LEX
        elif low:
            plain = "".join(c for c in low.translate(_LEET) if c.isalpha())
            if plain in self.lexicon:
                bits |= RESPELLED
        if low in self.second:
            bits |= YOU
        if low in self.learned:
            bits |= LEARNED
        if len(core) > 1 and core.isupper():
            bits |= CAPITALS
        if _INSIDE.search(core):
            bits |= OBFUSCATED
        if "!" in word or "?" in word:
            bits |= MARKED
        if low.isdigit():
            bits |= DIGITS
        self[word] = bits
        return bits


def features_of(text: str, marks: WordMarks) -> list[float]:
    import numpy as np
    ws = text.split()
    n = len(ws)
    if not n:
        return [0.0] * len(FEATURES)
    m = np.fromiter(map(marks.__getitem__, ws), dtype=np.int64, count=n)
    share = lambda bit: float(((m & bit) > 0).sum()) / n
    lex = np.flatnonzero(m & (LEX | RESPELLED | LEARNED))
    you = np.flatnonzero(m & YOU)
    near = 0
    if len(lex) and len(you):
        k = np.searchsorted(you, lex)
        right = np.abs(you[np.minimum(k, len(you) - 1)] - lex)
        left = np.abs(lex - you[np.maximum(k - 1, 0)])
        near = int((np.minimum(left, right) <= NEAR).sum())
    letters = sum(map(len, ws))
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks_n = sum(map(text.count, ".,;:!?*#$%&|<>@_-"))
    return [float(np.log1p(n)), share(LEX), float(np.log1p(((m & LEX) > 0).sum())), share(RESPELLED),
            share(LEARNED), float(np.log1p(((m & LEARNED) > 0).sum())), share(YOU), near / n, share(CAPITALS),
            upper / letters, share(MARKED), marks_n / letters, share(OBFUSCATED), share(DIGITS)]


def usable_labels(labels: DataFrame) -> DataFrame:
    """_id, label, part: one row per labelled id outside the held-out part."""
    part = fold(F.col("_id"), FOLDS)
    return (labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("double").alias("label"))
            .filter("_id is not null and label is not null").groupBy("_id").agg(F.max("label").alias("label"))
            .withColumn("part", part).filter(F.col("part") != HELD_OUT))


def _bounded(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, chosen by a hash of the id."""
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def learned_lexicon(docs: DataFrame, labels: DataFrame, n_labels: int) -> list[str]:
    """Words that are far more frequent in toxic texts of the lexicon's part:
    at least 4 toxic texts, and 20 times the share of the other texts."""
    few = _bounded(labels.filter(F.col("part") == LEXICON_FOLD), n_labels // (FOLDS - 1), MAX_LEXICON_DOCS)

    def distinct_words(batches):
        import pyarrow as pa
        for b in batches:
            out, toxic = [], []
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                ws = {w.strip(_EDGES).lower() for w in (t or "").split()} - {""}
                out += ws
                toxic += [y] * len(ws)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.float64())],
                                             names=["word", "label"])

    # bounded by MAX_LEXICON_DOCS, whatever the table's size
    rows = docs.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("text", "label")
    n = few.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    if not n.t or n.t == n.n:
        return []
    t, c = F.sum("label"), F.sum(1 - F.col("label"))
    lift = ((t + 0.5) / (n.t + 1)) / ((c + 0.5) / (n.n - n.t + 1))
    words = (rows.mapInArrow(distinct_words, "word string, label double").groupBy("word")
             .agg(t.alias("t"), lift.alias("lift")).filter("t >= 4 and lift >= 20")
             .orderBy(F.desc("t"), "word").limit(LEARNED_WORDS))
    return [r.word for r in words.collect()]


def features(docs: DataFrame, learned: list[str], *keep: str) -> DataFrame:
    """``keep`` columns (of type long) and the feature array of every row."""
    def run(batches):
        import pyarrow as pa
        marks = WordMarks(learned)
        for b in batches:
            x = [features_of(t or "", marks) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(x, pa.list_(pa.float64()))],
                                             names=[*keep, "x"])
    return docs.select(*keep, "text").mapInArrow(sliced(run), ", ".join(f"{c} long" for c in keep) + ", x array<double>")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every row."""
    spark = docs.sparkSession
    shipped(spark)
    d = id_text(docs).withColumn("text_hash", F.xxhash64("text"))
    known = saved(usable_labels(labels), "toxic-labels")
    n_labels = known.count()
    x = saved(features(d, learned_lexicon(d, known, n_labels), "doc_id", "text_hash"), "toxic-features")
    # labels are filtered before the join; only its bounded result is read by few tasks
    chosen = _bounded(known.filter(F.col("part") != LEXICON_FOLD), n_labels, MAX_TRAIN_ROWS)
    train = saved(x.join(chosen, F.col("doc_id") == F.col("_id")).select("_id", "part", "label", "x"), "toxic-train")
    train = train.coalesce(4).withColumn("v", array_to_vector("x")).drop("x")
    trees, calibration = train.filter(F.col("part") == TREE_FOLD), train.filter(F.col("part") == CALIBRATION_FOLD)
    out = x.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)))
    count = {(r.part, r.label): r["count"] for r in train.groupBy("part", "label").count().collect()}
    both = lambda part: count.get((part, 0.0)) and count.get((part, 1.0))
    if not both(TREE_FOLD):
        share = known.agg(F.avg("label")).first()[0] or 0.0
        score = F.lit(min(float(share), THRESHOLD - 0.01))      # a constant accuses no text
    else:
        model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP,
                              subsamplingRate=1.0, seed=1).fit(trees)
        raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
        out = raw(out.withColumn("v", array_to_vector("x")))
        score = F.col("raw") * (THRESHOLD - 0.01)               # uncalibrated: an order, no verdict
        if both(CALIBRATION_FOLD):
            iso = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated")
            steps = iso.fit(raw(calibration).select("raw", "label"))
            if max(steps.predictions) > min(steps.predictions):
                out = steps.transform(out.drop("prediction"))
                # isotonic steps tie scores; the trees' own order is kept inside a step
                score = F.col("calibrated") * 0.999 + F.col("raw") * 0.001
    score = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", "text_hash", "held_out", score.alias("score"),
                      F.when(score >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic, same columns."""
    bad = settled(docs.sparkSession, lambda: scored(docs, labels).filter("predicted = 1").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).distinct(), "toxic-rows")
    on = docs["doc_id"].cast("long").eqNullSafe(bad["_id"]) \
        & (F.xxhash64(docs["text"].cast("string")) == bad["_th"])
    return docs.join(bad.hint("merge"), on, "left_anti")     # the same plan at all sizes
