"""Mixing sources to target weights by weighted sampling without replacement
(JVM only).

Every document gets an exponential key -ln(u) / w, u from a hash of the row and
w its quality weight; taking keys in ascending order inside a source is
Efraimidis-Spirakis sampling. Whole epochs of a source come first; the rest of
its budget is a prefix of the key order. The prefix is found without sorting a
source: sizes are summed per coarse key bucket, then per fine bucket inside the
one coarse bucket the budget ends in, and only the rows of that fine bucket are
ordered.

Null texts have size 0; a null source is a source of its own (ordered last);
null ids are sampled like any other row; repeated rows (same id and text) share a
key, and where the budget ends among them the first of them are taken; an empty
table gives no rows. Texts of any length count whole; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, saved, word_count

WEIGHTS = (5.0, 2.0, 1.0)     # of the sources in order, repeating
SHARE = 1.5                   # of all words
MOST_EPOCHS = 2.0             # a source's target is at most so many times its size
SEED = "mix-1"
COARSE, FINE = 1 << 12, 1 << 24
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """1 for clean prose, falling to 0.25 as symbols fill the text."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    symbols = n - F.length(F.translate(t, SYMBOLS, ""))
    return F.greatest(F.lit(0.25), 1.0 - 4.0 * symbols / F.greatest(n, F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from the first 13 hex digits of an md5 of seed, id and text."""
    h = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                          F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _key and its coarse and fine buckets."""
    t = F.col("text").cast("string")
    d = docs.withColumns({"_size": word_count(t),
                          "_key": -F.log(uniform(F.col("doc_id"), t, seed)) / quality_weight(t)})
    v = 1.0 - F.exp(-F.col("_key"))
    return d.withColumns({"_coarse": F.least(F.floor(v * COARSE), F.lit(COARSE - 1)).cast("int"),
                          "_fine": F.least(F.floor(v * FINE), F.lit(FINE - 1)).cast("int")})


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_EPOCHS) -> DataFrame:
    """source, source_size -> + target, epochs, rest. Budgets above ``most``
    epochs are cut and their excess reshared by weight until none is above:
    sources are capped in ascending order of size per weight. One row per
    source, so the windows here see a handful of rows."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    n = (F.row_number().over(by_source) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), n + 1)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    t = (sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
         .withColumns({"total": share * F.sum("source_size").over(everything),
                       "all_w": F.sum("w").over(everything),
                       "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
                       "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0))})
         .withColumn("capped", F.col("cap") / F.col("w")
                     <= (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before"))))
    capped = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    t = t.withColumns({"c": capped("cap"), "cw": capped("w")})
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.col("w") * (F.col("total") - F.col("c")) / (F.col("all_w") - F.col("cw")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("target", target).withColumn("epochs", epochs.cast("long"))
    return t.select("source", "source_size", "target", "epochs",
                    (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _crossing(sums: DataFrame, bucket: str, start: Column) -> DataFrame:
    """The bucket of each source in which the running size passes its rest:
    source, <bucket>_cut, and the size before it. ``start``: size already spent."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    end = start + F.sum("s").over(w)
    return (sums.withColumn("end", end).filter(F.col("end") > F.col("rest"))
            .groupBy("source").agg(F.min(F.struct(bucket, (F.col("end") - F.col("s")).alias("before"))).alias("x"))
            .select("source", F.col(f"x.{bucket}").alias(f"{bucket}_cut"), F.col("x.before").alias(f"{bucket}_before")))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    r = right.withColumnRenamed("source", "_src")
    return left.join(r, F.col("source").eqNullSafe(F.col("_src")), how).drop("_src")


def plan(narrow: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, source, _size, _key, _coarse, _fine): the per-source
    plan and the keys taken in the buckets where budgets end."""
    n = narrow
    per_source = saved(targets(n.groupBy("source").agg(F.sum("_size").alias("source_size")), **options), "mix-targets")
    rest = per_source.select("source", "rest")
    coarse = n.groupBy("source", "_coarse").agg(F.sum("_size").alias("s"))
    cut = _crossing(_same_source(coarse, rest), "_coarse", F.lit(0.0))
    cut = saved(_same_source(per_source, cut, "left"), "mix-cuts")
    inside = _same_source(n, cut.select("source", "rest", "_coarse_cut", "_coarse_before")) \
        .filter(F.col("_coarse") == F.col("_coarse_cut"))
    fine = inside.groupBy("source", "_fine").agg(F.sum("_size").alias("s"), F.first("rest").alias("rest"),
                                                 F.first("_coarse_before").alias("_coarse_before"))
    fine_cut = _crossing(fine, "_fine", F.col("_coarse_before"))
    cut = saved(_same_source(cut, fine_cut, "left"), "mix-cuts")
    # rows that are copies of each other (same id and text) share a key and stand as one line
    w = Window.partitionBy("source").orderBy("_key", F.col("doc_id").asc_nulls_last(), "_size") \
        .rowsBetween(Window.unboundedPreceding, 0)
    lines = (_same_source(n, cut.select("source", F.col("rest").alias("_rest"), "_fine_cut", "_fine_before"))
             .filter(F.col("_fine") == F.col("_fine_cut"))
             .groupBy("source", "_key", "doc_id", "_size", "_rest", "_fine_before").agg(F.count(F.lit(1)).alias("m")))
    lines = lines.withColumn("start", F.col("_fine_before") + F.sum(F.col("m") * F.col("_size")).over(w)
                             - F.col("m") * F.col("_size"))
    # the copy that the budget ends in is taken if that comes nearer to it
    fit = F.ceil((F.col("_rest") - F.col("start")) / F.col("_size") - 0.5)
    fit = F.when(F.col("_size") > 0, F.least(F.greatest(fit, F.lit(0)), F.col("m"))).otherwise(
        F.when(F.col("start") < F.col("_rest"), F.col("m")).otherwise(0))
    edge = lines.withColumn("q", fit.cast("long")).filter("q > 0").select("source", "_key", "q", "m")
    return cut, saved(edge, "mix-edge")


def _first_copies(narrow: DataFrame, part: DataFrame) -> DataFrame:
    """_row of the first q rows of each line (source, _key, q) of ``part``. Copies are
    counted per part of the written table, then numbered inside each part, so a
    line of very many copies is spread over its parts."""
    p = part.select(F.col("source").alias("_src"), F.col("_key").alias("_line"), "q")
    rows = (narrow.join(p, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_key") == F.col("_line")))
            .select("_src", "_line", "q", "_row", F.shiftright("_row", 33).alias("_part")))
    line = ("_src", "_line")
    before = Window.partitionBy(*line).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (rows.groupBy(*line, "_part").agg(F.count(F.lit(1)).alias("c"))
             .withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
             .select(F.col("_src").alias("_s"), F.col("_line").alias("_l"), F.col("_part").alias("_p"), "before"))
    inside = F.row_number().over(Window.partitionBy(*line, "_part").orderBy("_row"))
    return (rows.withColumn("i", inside)
            .join(parts, F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_line") == F.col("_l")) & (F.col("_part") == F.col("_p")))
            .filter(F.col("before") + F.col("i") <= F.col("q")).select(F.col("_row").alias("_taken")))


def copies(rows: DataFrame, cut: DataFrame, edge: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target and _copies (how often the mix takes the row).
    ``cut`` has a row per source and ``edge`` the lines of one fine bucket per
    source; the planner broadcasts them if their measured size allows it.
    ``numbered``: a written table of the rows of the lines that a budget ends in
    (default: of all rows)."""
    d = _same_source(rows, cut.select("source", "source_size", "target", "epochs", "_coarse_cut", "_fine_cut"), "left")
    e = edge.filter("q = m").select(F.col("source").alias("_src"), F.col("_key").alias("_edge_key"))
    d = d.join(e, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_key") == F.col("_edge_key")), "left")
    partial = (F.col("_coarse") < F.col("_coarse_cut")) \
        | ((F.col("_coarse") == F.col("_coarse_cut")) & (F.col("_fine") < F.col("_fine_cut"))) \
        | F.col("_edge_key").isNotNull()
    part = edge.filter("q < m")
    if not part.isEmpty():          # a budget ends among copies: at most one line per source
        d = d.join(_first_copies((rows if numbered is None else numbered).select("source", "_key", "_row"), part), F.col("_row") == F.col("_taken"), "left")
        partial = partial | F.col("_taken").isNotNull()
    return d.withColumn("_copies", F.col("epochs") + F.when(partial, 1).otherwise(0)) \
        .drop("_src", "_edge_key", "_coarse_cut", "_fine_cut", "epochs", "_taken")


NARROW = ("doc_id", "source", "_size", "_key", "_coarse", "_fine")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken."""
    d = id_text(docs, F.col("source").cast("string").alias("source"))
    narrow = saved(keyed(d, seed).select(*NARROW, F.monotonically_increasing_id().alias("_row")), "mix-keys")
    out = copies(narrow, *plan(narrow, **options))
    return out.select("doc_id", F.col("_size").alias("size"), "source", "source_size", "target",
                      (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as it is taken, same
    columns. Only keys and sizes are written and shuffled; rows are read again with
    their keys. Those of a line that a budget ends in (one per source) are written."""
    d = keyed(id_text(docs, F.col("source").cast("string").alias("source"), F.struct("*").alias("_doc")), seed) \
        .select(*NARROW, "_doc")
    cut, edge = plan(saved(d.select(*NARROW), "mix-keys"), **options)
    part, lines = edge.filter("q < m"), None
    if not part.isEmpty():
        p = part.select(F.col("source").alias("_src"), F.col("_key").alias("_line"))
        on = F.col("source").eqNullSafe(F.col("_src")) & (F.col("_key") == F.col("_line"))
        lines = saved(d.join(p, on, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "mix-lines")
        d = d.join(p, on, "left_anti").withColumn("_row", F.lit(-1).cast("long")).unionByName(lines)
    out = copies(d, cut, edge, lines)
    copy = F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))
    return out.select("_doc", copy).select("_doc.*")


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    -ln((CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
    / greatest(0.25, 1.0 - 4.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', '')))
                          / greatest(length(coalesce(text, '')), 1)) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(2.0 * source_size) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap / w <= (total - cap_before) / (all_w - w_before) AS capped FROM c),
g AS (SELECT *, sum(CASE WHEN capped THEN cap ELSE 0.0 END) OVER () AS cc, sum(CASE WHEN capped THEN w ELSE 0.0 END) OVER () AS cw FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * (total - cc) / (all_w - cw) END AS target FROM g),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - rest < rest - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
