"""Stand-in inputs derived from the test tables, in two spellings.

Each fixture exists as a Spark DataFrame builder (used by the registered
queries) and as DuckDB SQL (used by the oracles). Both read the given tables,
so their size grows with the scale factor. Every join here is on a unique key
(one partner per row); none emits all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from ..sources.files import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# examples: one example record per document (news, headline, ... , ecnc)
# ---------------------------------------------------------------------------
def examples(spark: SparkSession, sf_dir: str, extra=()) -> DataFrame:
    """``extra`` names further documents columns to carry along."""
    d = table(spark, sf_dir, "documents")
    part = lambda n: F.split_part(d.text, F.lit("."), F.lit(n))
    n_chars = d.n_chars.cast("string")
    return d.select(
        d.doc_id.alias("idx"),
        d.text.alias("news"),
        part(1).alias("headline"),
        F.concat(F.lit("____ "), part(1)).alias("masked_headline"),
        n_chars.alias("ans"),
        F.concat(F.lit("  "), part(2), F.lit(" ")).alias("summary"),
        part(3).alias("rationale_hg"),
        F.concat(F.lit(" "), n_chars, F.lit(" - 1 ")).alias("rationale_cal"),
        F.when(d.doc_id % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" "), d.source, F.lit(" "), d.lang, F.lit(" "))).alias("ecnc"),
        *extra,
    )


EXAMPLES_SQL = """
SELECT doc_id AS idx,
       text AS news,
       split_part(text, '.', 1) AS headline,
       concat('____ ', split_part(text, '.', 1)) AS masked_headline,
       CAST(n_chars AS VARCHAR) AS ans,
       concat('  ', split_part(text, '.', 2), ' ') AS summary,
       split_part(text, '.', 3) AS rationale_hg,
       concat(' ', CAST(n_chars AS VARCHAR), ' - 1 ') AS rationale_cal,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE concat(' ', source, ' ', lang, ' ') END AS ecnc
FROM documents"""


# ---------------------------------------------------------------------------
# sidecar: positional stage-1 outputs, shorter than the examples (the last
# tenth is missing) so that truncating and strict alignment can be seen.
# ---------------------------------------------------------------------------
def sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # uncorrelated scalar subquery, counted from the file as stored
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(F.count(F.lit(1))).scalar()
    return (d.where(F.col("doc_id") * 10 < n * 9)
            .select(F.col("doc_id").alias("idx"),
                    F.concat(F.lit(" focus "), F.col("source"), F.lit(" ")).alias("text")))


def full_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage-1 output per example, for queries that do not study truncation."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.concat(F.lit(" focus "), F.col("source"), F.lit(" ")).alias("text"))


FULL_SIDECAR_SQL = """
SELECT doc_id AS idx, concat(' focus ', source, ' ') AS text FROM documents"""

SIDECAR_SQL = """
SELECT doc_id AS idx, concat(' focus ', source, ' ') AS text
FROM documents WHERE doc_id * 10 < 9 * (SELECT count(*) FROM documents)"""


# ---------------------------------------------------------------------------
# pairs: preference pairs (news, chosen, rejected). The article is any document
# that has two successors; chosen and rejected are the next two documents by id.
# Each join is on a unique key, so the result is linear in the input.
# ---------------------------------------------------------------------------
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # All sides are keyed by the pair, so each text is shuffled once per role and
    # the pairs joined first stay where they are for the second join.
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    role = lambda place, name: d.select(
        F.try_subtract("doc_id", F.lit(place).cast("long")).alias("pair_id"), F.col("text").alias(name))
    return role(0, "news").join(role(1, "chosen"), "pair_id").join(role(2, "rejected"), "pair_id")


PAIRS_SQL = """
SELECT g.doc_id AS pair_id, g.text AS news, c.text AS chosen, r.text AS rejected
FROM documents g
JOIN documents c ON c.doc_id = g.doc_id + 1
JOIN documents r ON r.doc_id = g.doc_id + 2"""


# ---------------------------------------------------------------------------
# attempts: repeated generations per prompt, numbered per user by event order.
# Numbering uses the skew-safe per-group position (a hot user is split across
# tasks), not a window over one partition per user.
# ---------------------------------------------------------------------------
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.order import with_position
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    text = (F.when((F.col("event_id") % 3 == 1) | (F.col("user_id") % 7 == 0),
                   F.concat(F.col("event_type"), F.lit(" none")))
            .when(F.col("event_id") % 3 == 0, F.concat(F.col("props"), F.lit(" "), F.col("props")))
            .otherwise(F.col("props")))
    base = e.select(F.col("user_id").alias("idx"), "event_id", text.alias("text"))
    return (with_position(base, ["event_id"], partition_by=["idx"], name="attempt")
            .select("idx", "attempt", "text"))


ATTEMPTS_SQL = """
SELECT user_id AS idx,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS attempt,
       CASE WHEN event_id % 3 = 1 OR user_id % 7 = 0 THEN concat(event_type, ' none')
            WHEN event_id % 3 = 0 THEN concat(props, ' ', props)
            ELSE props END AS text
FROM events"""


# ---------------------------------------------------------------------------
# gold / predictions for numeral accuracy
# ---------------------------------------------------------------------------
def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    gt = (F.when(e.event_id % 10 == 0, F.lit("1000"))
          .otherwise(F.regexp_extract(e.props, "([0-9]+)", 1)))
    return e.select(e.event_id.alias("idx"), gt.alias("gt"), (e.event_id % 2).cast("int").alias("num_type"))


GOLD_SQL = """
SELECT event_id AS idx,
       CASE WHEN event_id % 10 = 0 THEN '1000' ELSE regexp_extract(props, '([0-9]+)', 1) END AS gt,
       CAST(event_id % 2 AS INT) AS num_type FROM events"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = (F.when(e.event_id % 5 == 0, F.lit("total 1,000"))
            .when(e.event_id % 7 == 0, F.concat(e.props, F.lit(" 12")))
            .otherwise(F.concat(F.lit("total "), e.props)))
    return e.select(e.event_id.alias("idx"), text.alias("text"))


PREDICTIONS_SQL = """
SELECT event_id AS idx,
       CASE WHEN event_id % 5 = 0 THEN 'total 1,000'
            WHEN event_id % 7 = 0 THEN concat(props, ' 12')
            ELSE concat('total ', props) END AS text FROM events"""


# ---------------------------------------------------------------------------
# rouge_pairs: each turn scored against the next turn of the same conversation
# ---------------------------------------------------------------------------
def rouge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a = c.select("conv_id", "turn", F.col("text").alias("hyp"))
    b = c.select(F.col("conv_id").alias("b_conv"), F.col("turn").alias("b_turn"), F.col("text").alias("ref"))
    cond = (F.col("b_conv") == F.col("conv_id")) & (F.col("b_turn") == F.col("turn") + 1)
    return (a.join(b, cond)
            .select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "hyp", "ref"))


ROUGE_PAIRS_SQL = """
SELECT a.conv_id * 100 + a.turn AS pair_id, a.text AS hyp, b.text AS ref
FROM conversations a JOIN conversations b
  ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""


# ---------------------------------------------------------------------------
# candidates: turn 0 is the reference text, later turns are candidates
# ---------------------------------------------------------------------------
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    ref = c.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("ref"))
    cand = c.where(F.col("turn") > 0).select("conv_id", F.col("turn").alias("rep"),
                                              F.col("text").alias("candidate"))
    return (cand.join(ref, "conv_id")
            .select(F.col("conv_id").alias("idx"), "rep", "ref", "candidate"))


CANDIDATES_SQL = """
SELECT a.conv_id AS idx, b.turn AS rep, a.text AS ref, b.text AS candidate
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id
WHERE a.turn = 0 AND b.turn > 0"""


SQL = {
    "examples": EXAMPLES_SQL,
    "full_sidecar": FULL_SIDECAR_SQL, "sidecar": SIDECAR_SQL,
    "pairs": PAIRS_SQL,
    "attempts": ATTEMPTS_SQL,
    "gold": GOLD_SQL,
    "predictions": PREDICTIONS_SQL,
    "rouge_pairs": ROUGE_PAIRS_SQL,
    "candidates": CANDIDATES_SQL,
}


def with_fixtures(sql: str, *names: str, extra: dict | None = None) -> str:
    """Prefix an oracle query with the fixture CTEs it names (then ``extra``
    CTEs, name -> SQL, which may refer to them)."""
    parts = [f"{n} AS ({SQL[n]}\n)" for n in names] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
