"""Batch generation over a table (GN3), generation with a numeral retry
(GN4) and attempt selection over stored attempts (WN2).

The model is caller-supplied: ``make_model()`` is called once per Python
worker and returns ``model(prompts: list[str], attempt: int) -> list[str]``
giving the full generated text (prompt echo included, as text-generation
pipelines return it). Rendering, replication, partitioning, batching, prompt
removal and writing all stay in Spark; only the model call runs in Python.
"""

from __future__ import annotations

import re
from typing import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NUMERAL_PATTERN, WS29, has_single_number, strip_prompt
from .align import replicate
from .messages import prompt_messages, render

ModelFactory = Callable[[], Callable[[list, int], list]]

MAX_RETRIES = 20  # retries after the first attempt (21 attempts in all)


class EchoModel:
    """Deterministic stand-in model for tests and dry runs.

    For a prompt of length L it answers "answer <L + attempt>" once the
    attempt reaches L % 4, and "answer <L> and <attempt>" (two numerals)
    before that; prompts with L % 7 == 0 never give a single numeral.
    """

    def __call__(self, prompts: list, attempt: int = 0) -> list:
        out = []
        for p in prompts:
            n = len(p)
            if n % 7 != 0 and attempt >= n % 4:
                out.append(f"{p}  answer {n + attempt} ")
            else:
                out.append(f"{p}  answer {n} and {attempt} ")
        return out


def echo_model() -> EchoModel:
    return EchoModel()


# The model of this Python worker, by the name of its factory. With worker reuse
# (Spark's default) a model is loaded once per worker, not per task; a second
# model (another stage) takes the place of the first.
_MODELS: dict = {}


def _model_name(make_model: ModelFactory) -> bytes:
    from pyspark import cloudpickle
    return cloudpickle.dumps(make_model)     # tells partials and callable objects apart


def _model_for(make_model: ModelFactory, name: bytes | None = None):
    name = name or _model_name(make_model)
    if name not in _MODELS:
        _MODELS.clear()
        _MODELS[name] = make_model()
    return _MODELS[name]


def _chunks(seq, size):
    for i in range(0, len(seq), size):
        yield seq[i:i + size]


def _single_numeral(text: str, _pat=re.compile(NUMERAL_PATTERN)) -> bool:
    return len(_pat.findall(text)) == 1


def model_texts(model, prompts: list, num_check: bool, max_retries: int) -> tuple[list, list]:
    """One batch through the model: texts, and retries of each. With ``num_check``
    the prompts whose cleaned text lacks its one numeral are tried again."""
    gen, n_try = list(model(prompts, 0)), [0] * len(prompts)
    todo = range(len(prompts)) if num_check else ()
    for a in range(max_retries + 1):
        if a and todo:
            for i, g in zip(todo, model([prompts[i] for i in todo], a)):
                gen[i], n_try[i] = g, a
        todo = [i for i in todo if not _single_numeral(gen[i][len(prompts[i]):].strip(WS29))]
        if not todo:
            break
    return gen, n_try


def batch_generate(df: DataFrame, make_model: ModelFactory, prompt: str = "prompt",
                   batch_size: int = 16, num_check: bool = False, max_retries: int = MAX_RETRIES,
                   out: str = "generated") -> DataFrame:
    """GN3/GN4: one generation per row, in batches of ``batch_size`` inside each
    partition. With ``num_check`` a row is regenerated (up to ``max_retries``
    more times) until its cleaned output holds exactly one numeral; the last
    output is kept if none does. Adds ``out`` (raw text) and ``attempts``."""
    from pyspark.sql.types import IntegerType, StringType, StructType
    from ..session import few_rows, ship_package
    ship_package(df.sparkSession)
    few_rows(df.sparkSession)
    schema = StructType(list(df.schema.fields)).add(out, StringType()).add("attempts", IntegerType())

    name = _model_name(make_model)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from sparkprep.operators.generate import _model_for, model_texts
        model = _model_for(make_model, name)

        def generated(pdf):
            prompts = pdf[prompt].fillna("None").astype(str).tolist()
            texts, tries = [], []
            for chunk in _chunks(prompts, batch_size):
                gen, n_try = model_texts(model, chunk, num_check, max_retries)
                texts.extend(gen)
                tries.extend(n_try)
            return pdf.assign(**{out: texts, "attempts": tries})

        held = None         # rows that do not fill a model batch yet, whatever the cuts of the input
        for pdf in batches:
            held = pdf if held is None or not len(held) else pd.concat([held, pdf])
            full = len(held) // batch_size * batch_size
            if full:
                yield generated(held[:full])
                held = held[full:]
        if held is not None and len(held):
            yield generated(held)

    return df.mapInPandas(run, schema)


def generate(df: DataFrame, make_model: ModelFactory, messages: str = "messages", k: int = 1,
             batch_size: int = 16, num_check: bool = False, key: str = "idx",
             partitions: int | None = None) -> DataFrame:
    """Stage inference over a table: PJ2 -> PJ3 -> GN1 (k per row) -> GN3 -> PJ7.

    ``partitions`` (the counterpart of a worker-process count) spreads the
    prompts evenly over that many tasks, each running one model instance;
    by default the input's partitioning is kept (no shuffle).

    Returns (key, rep, prompt, text, attempts): the output is keyed, never
    positional, so it can be re-joined in any order. A sampling model gives
    new texts each time the plan runs: write or checkpoint the output before
    using it more than once.
    """
    prompts = df.select(key, render(prompt_messages(messages), add_generation_prompt=True).alias("prompt"))
    reps = replicate(prompts, k, key=key).drop("pos")
    if partitions:
        reps = reps.repartition(partitions)
    raw = batch_generate(reps, make_model, "prompt", batch_size, num_check)
    return raw.select(key, "rep", "prompt", strip_prompt("generated", "prompt").alias("text"), "attempts")


def generate_resumable(df: DataFrame, make_model: ModelFactory, path: str, messages: str = "messages", k: int = 1,
                       batch_size: int = 16, num_check: bool = False, key: str = "idx",
                       max_retries: int = MAX_RETRIES) -> DataFrame:
    """``generate`` into the shared folder ``path``, model batch by model batch.

    The prompts are written there once, dealt into numbered batches; every batch
    that the model has finished is one file, put in place whole. A run, be it
    the first, one after a crash or a repeated task, generates the batches that
    have no file yet, so a lost run costs at most the batches that were at the
    model, and no text or attempt count of a finished one is ever made again.
    Another input than the first run's fails. Returns what ``generate`` does.
    """
    from pyspark.errors import AnalysisException
    from ..session import few_rows, ship_package
    from ..sources.sinks import _folder
    spark = df.sparkSession
    ship_package(spark)
    few_rows(spark)
    reps = replicate(df.select(key, render(prompt_messages(messages), add_generation_prompt=True).alias("prompt")),
                     k, key=key).select(key, "rep", "prompt")
    digest = [F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(key, "rep", "prompt").cast("decimal(20,0)")), F.lit(0))]
    todo = f"{path}/prompts"
    try:
        prompts = spark.read.parquet(todo)
    except AnalysisException:
        row = F.monotonically_increasing_id()
        batch = F.shiftleft(F.shiftright(row, 33), 33).bitwiseOR(F.floor(row % (1 << 33) / batch_size))
        reps.withColumns({"_row": row, "_batch": batch}).write.mode("overwrite").parquet(todo)
        prompts = spark.read.parquet(todo)
    if tuple(prompts.agg(*digest).first()) != tuple(reps.agg(*digest).first()):
        raise ValueError(f"{path} holds the outputs of another input")

    def finished() -> DataFrame:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "batch-*.parquet")
        return listed.load(path).select(F.regexp_extract("path", r"batch-([0-9]+)\.parquet$", 1).cast("long").alias("_batch"))

    name, keyed = _model_name(make_model), prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        import uuid
        from pyarrow import fs
        from sparkprep.operators.generate import _model_for, model_texts
        system, folder = _folder(f"{path}/done")
        system.create_dir(folder, recursive=True)

        def whole():
            """The rows of one batch at a time, whatever the cuts of the input."""
            held = None
            for pdf in batches:
                held = pdf if held is None else pd.concat([held, pdf])
                last = held["_batch"].iloc[-1] if len(held) else None
                for number, rows in held[held["_batch"] != last].groupby("_batch", sort=False):
                    yield number, rows
                held = held[held["_batch"] == last]
            if held is not None and len(held):
                yield held["_batch"].iloc[0], held

        for number, rows in whole():
            target = f"{folder}/batch-{number}.parquet"
            if system.get_file_info(target).type == fs.FileType.NotFound:       # else an earlier attempt of this task did it
                gen, n_try = model_texts(_model_for(make_model, name), rows["prompt"].fillna("None").tolist(), num_check, max_retries)
                table = pa.Table.from_pandas(rows[[key, "rep", "prompt"]].assign(generated=gen, attempts=n_try), preserve_index=False)
                part = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    pq.write_table(table.set_column(4, "attempts", table["attempts"].cast(pa.int32())), out)
                system.move(part, target)
            yield pd.DataFrame({"_batch": [number]})

    left = (prompts.join(finished(), "_batch", "left_anti").repartition("_batch").sortWithinPartitions("_batch", "_row"))
    left.mapInPandas(run, "_batch long").write.format("noop").mode("overwrite").save()
    fields = f"{key} {keyed}, rep {prompts.schema['rep'].dataType.simpleString()}, prompt string, generated string, attempts int"
    done = spark.read.schema(fields).option("pathGlobFilter", "batch-*.parquet").parquet(f"{path}/done")
    return done.select(key, "rep", "prompt", strip_prompt("generated", "prompt").alias("text"), "attempts")


def preview_generate(df: DataFrame, make_model: ModelFactory, sample_num: int, messages: str = "messages",
                     key: str = "idx", seed: int = 42, num_check: bool = False) -> DataFrame:
    """GN4 preview: ``sample_num`` seeded examples generated (with the numeral
    retry if asked) beside their user content and ground truth."""
    from .order import preview
    few = preview(df.select(key, messages), key, sample_num, seed)
    out = generate(few, make_model, messages, 1, num_check=num_check, key=key)
    truth = few.select(key, F.element_at(messages, 2)["content"].alias("user"),
                       F.element_at(messages, 3)["content"].alias("ground_truth"))
    return truth.join(out.select(key, F.col("text").alias("generated"), "attempts"), key)


def select_attempt(df: DataFrame, key: str = "idx", attempt: str = "attempt", text: str = "text",
                   max_attempt: int = MAX_RETRIES, num_check: bool = True) -> DataFrame:
    """WN2: per key, the first attempt whose text has exactly one numeral;
    if none does, the last attempt (attempts beyond ``max_attempt`` are
    ignored). Without ``num_check`` attempt 0 is taken.

    A grouped aggregation with partial aggregation: a key with very many
    attempts is combined map-side before the shuffle.
    """
    d = df.where(F.col(attempt) <= max_attempt)
    if not num_check:
        return d.where(F.col(attempt) == 0).select(key, attempt, text)
    ok = has_single_number(F.col(text))
    first_ok = F.min(F.when(ok, F.struct(F.col(attempt).alias("a"), F.col(text).alias("t"))))
    last = F.max(F.struct(F.col(attempt).alias("a"), F.col(text).alias("t")))
    g = d.groupBy(key).agg(first_ok.alias("_f"), last.alias("_l"))
    chosen = F.coalesce(F.col("_f"), F.col("_l"))
    return g.select(key, chosen["a"].cast("bigint").alias(attempt), chosen["t"].alias(text))
