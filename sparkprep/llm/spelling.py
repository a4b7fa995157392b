"""Spelling variants: exact neighbours at one edit through a trie-node pair dictionary.

1. Words are counted per document (``corpus_words``): one aggregation.
2. The words are sorted forwards and, in a second sort, from their ends. In
   sorted order a word shares with the word before it exactly the trie nodes of
   their common prefix, so every node gets its integer while a task reads its
   range (``numbered``). The path that runs from one range into the next is the
   only thing that two tasks number twice; one row per range goes to the driver
   to tell which numbers are the same node.
3. A word of L code points then is 2 L + 1 integer pairs (prefix node, suffix
   node): L pairs that skip one code point and L + 1 that skip none. Two words of
   equal length differ by one replacement exactly if they share a skipping pair;
   a word is another one with a code point inserted exactly if its skipping
   pair is the other's plain pair. Pairs meet in one shuffle on the integers.
   No string is compared and nothing is verified afterwards.
4. A pair is shared by at most one word per code point of the alphabet and
   one plain word, so its group is bounded by the alphabet (90 code points in
   the query). Each member takes its count of neighbours and its best one
   from the group; pairs of words are not written out. In a run of equal code
   points every deletion gives the same word, so only the first one counts.
5. Forms are followed to the last by pointer doubling. Each step multiplies the
   count by 10 at least, so five rounds follow any chain of 64-bit counts.

Null texts have no words; a null id is written as the empty string in the hash
of a run. Empty texts and tables give no rows. Repeated rows count each time.
Ties between equal counts go to the word that is smallest in code-point order. A
text or a run of any length is taken whole; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved, shipped, sliced

RUN = "[A-Za-zÀ-ÿ]"
DAMAGE = 31                 # one run in so many loses a code point
LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_FACTOR = 10
_PLACE_BITS = 40
_HELD = 150_000             # distinct words that a task counts before it hands them on
PLAIN, SKIP, LATER_SKIP = 0, 1, 3


def damaged(run: str, prefix_crc: int, every: int = DAMAGE) -> str:
    """``run`` without one code point if its hash says so, else as it is."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts, damaged as described, with their counts."""
    # a shorter run cannot give a word, so only runs of the least length match
    runs = re.compile(f"{RUN}{{{least_length},}}")

    def count(batches):
        import pyarrow as pa
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["word", "n"])
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                start = zlib.crc32(b"%d:" % i if i is not None else b":")
                # bytes.lower() changes A-Z only
                for run, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = damaged(run, start)
                    if len(word) >= least_length:
                        seen[word] += n
                if len(seen) >= _HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return (id_text(docs).mapInArrow(sliced(count), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def common_prefix(a: str, b: str) -> int:
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    k = 0
    while a[k] == b[k]:
        k += 1
    return k


def numbered(words: DataFrame, name: str, backward: bool) -> tuple[DataFrame, dict]:
    """``words`` with, per word, its place ``{name}_at`` in the sorted range
    ``{name}_range`` and the numbers ``{name}_nodes`` of its trie path, root first;
    and what ``join_ranges`` tells of the ranges."""
    key = F.reverse("word") if backward else F.col("word")
    columns = words.columns
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in words.schema]
                       + [f"{name}_range int", f"{name}_at long", f"{name}_nodes array<long>"])

    def number(batches):
        import numpy as np
        import pyarrow as pa
        last, path, at, node = None, [], 0, 0
        for b in batches:
            flat, ends = [], [0]
            for w in b.column("_key").to_pylist():
                shared = common_prefix(last, w) + 1 if last is not None else 0
                new = len(w) + 1 - shared
                path = path[:shared] + list(range(node, node + new))
                node += new
                last = w
                flat.extend(path)
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in columns]
                + [b.column("_range"), pa.array(np.arange(at, at + b.num_rows, dtype=np.int64)),
                   pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                names=columns + [f"{name}_range", f"{name}_at", f"{name}_nodes"])
            at += b.num_rows

    ranged = (words.withColumn("_key", key).repartitionByRange("_key").sortWithinPartitions("_key")
              .withColumn("_range", F.spark_partition_id()))
    table = saved(ranged.mapInArrow(sliced(number), schema), f"spelling-{name}")
    row = F.struct("word", F.col(f"{name}_nodes").alias("nodes"))
    ends = (table.groupBy(f"{name}_range")
            .agg(F.min_by(row, f"{name}_at").alias("first"), F.max_by(row, f"{name}_at").alias("last"),
                 F.max(F.array_max(f"{name}_nodes")).alias("most"))
            .orderBy(f"{name}_range").collect())       # one row per range
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    return table, join_ranges([(r[0], turn(r.first.word), turn(r.last.word), r.last.nodes, r.most) for r in ends])


def join_ranges(ends: list[tuple]) -> dict[int, tuple[int, list[int]]]:
    """Per range (id, first word, last word, path of the last word, highest node):
    what to add to its nodes, and the numbers of the nodes that its first word
    shares with the range before (its own numbers of these are 0, 1, ...)."""
    out, node, last, last_path = {}, 0, None, []
    for i, first, final, path, most in ends:
        shared = last_path[:common_prefix(last, first) + 1] if last is not None else []
        out[i] = (node, shared)
        last, last_path = final, [shared[x] if x < len(shared) else x + node for x in path]
        node += most + 1
    return out


def path_numbers(own, of, known: dict):
    """The corpus-wide numbers of trie nodes that the ranges ``of`` call ``own``."""
    import numpy as np
    most = max(known, default=0) + 1
    add, length, begin = (np.zeros(most, dtype=np.int64) for _ in range(3))
    flat = [0]
    for r, (first, shared) in known.items():
        add[r], length[r], begin[r] = first, len(shared), len(flat)
        flat.extend(shared)
    out = own + add[of]
    same = np.flatnonzero(own < length[of])
    out[same] = np.asarray(flat, dtype=np.int64)[begin[of[same]] + own[same]]
    return out


def node_pairs(table: DataFrame, forward: dict, backward: dict) -> DataFrame:
    """p, s (nodes), w (the word's place in code-point order), n, kind: every
    pair of every word, with one code point skipped or none."""
    ranges = table.sparkSession.sparkContext.broadcast((forward, backward))

    def emit(batches):
        import numpy as np
        import pyarrow as pa
        fw, bw = ranges.value

        def nodes(b, name, known):
            col = b.column(f"{name}_nodes")
            size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(b.column(f"{name}_range").to_numpy(), size)
            return path_numbers(col.flatten().to_numpy(zero_copy_only=False), of, known), size

        for b in batches:
            if not b.num_rows:
                continue
            pre, size = nodes(b, "f", fw)
            back, _ = nodes(b, "b", bw)
            ends = np.cumsum(size)
            begins = ends - size
            at = np.arange(len(pre)) - np.repeat(begins, size)
            suf = back[np.repeat(ends, size) - 1 - at]              # node of the suffix that starts at each position
            w = np.repeat(b.column("w").to_numpy(), size)
            n = np.repeat(b.column("n").to_numpy(), size)
            code = np.frombuffer("".join(b.column("word").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            inner = at < np.repeat(size, size) - 1                   # positions that hold a code point
            run = np.zeros(len(code), dtype=bool)
            run[1:] = code[1:] == code[:-1]
            run[at[inner] == 0] = False
            skip = np.flatnonzero(inner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([pre, pre[skip]])), pa.array(np.concatenate([suf, suf[skip + 1]])),
                 pa.array(np.concatenate([w, w[skip]])), pa.array(np.concatenate([n, n[skip]])),
                 pa.array(np.concatenate([np.full(len(pre), PLAIN), np.where(run, LATER_SKIP, SKIP)]).astype(np.int8))],
                names=["p", "s", "w", "n", "kind"])

    return table.select("w", "word", "n", "f_range", "f_nodes", "b_range", "b_nodes").mapInArrow(
        sliced(emit), "p long, s long, w long, n long, kind byte")


def neighbours(pairs: DataFrame) -> DataFrame:
    """w, n_near, best (n, -w of the near word of largest count)."""
    groups = (pairs.groupBy("p", "s").agg(F.collect_list(F.struct("w", "n", "kind")).alias("m"))
              .filter(F.size("m") > 1))

    def of(x):
        near = F.filter("m", lambda y: (y.w != x.w) & (y.kind + x.kind != PLAIN + LATER_SKIP))
        return F.struct(x.w.alias("w"), F.size(near).alias("near"),
                        F.array_max(F.transform(near, lambda y: F.struct(y.n.alias("n"), (-y.w).alias("minus")))).alias("best"))

    return (groups.select(F.inline(F.transform("m", of))).filter(F.col("near") > 0)
            .groupBy("w").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")))


def last_forms(forms: DataFrame) -> DataFrame:
    """w, form, root from w, form: pointers doubled until none moves."""
    now = saved(forms.select("w", "form", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("w").alias("via"), F.col("root").alias("beyond"))
        moved = saved(now.join(step, F.col("root") == F.col("via"), "left")
                      .select("w", "form", F.coalesce("beyond", "root").alias("root"),
                              F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        now = moved.drop("moved")
        if moved.filter("moved").limit(1).count() == 0:
            return now


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (distinct
    word, n). The form is the near word of largest n, if that is at least
    ``factor`` times the word's own."""
    shipped(words.sparkSession)
    words = words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
    table, forward = numbered(words, "f", backward=False)
    # the word's own number follows code-point order
    table = table.withColumn("w", F.shiftleft(F.col("f_range").cast("long"), _PLACE_BITS) + F.col("f_at")).drop("f_at")
    table, backward = numbered(table, "b", backward=True)
    near = neighbours(node_pairs(table, forward, backward))
    known = table.select("w", "word", "n")
    known = saved(known.join(near, "w", "left"), "spelling-words")
    forms = (known.filter(F.col("best.n") >= factor * F.col("n"))
             .select("w", (-F.col("best.minus")).alias("form")))
    chains = last_forms(forms)
    name = known.select(F.col("w").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    root = known.select(F.col("w").alias("root"), F.col("word").alias("root_word"))
    chains = chains.join(name, "form").join(root, "root").select("w", "form_word", "root_word", "form_n")
    return known.join(chains, "w", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def groups(docs: DataFrame) -> DataFrame:
    """``variants`` of the words of all texts."""
    shipped(docs.sparkSession)
    return variants(saved(corpus_words(docs), "spelling-counts"))
