"""Text scores by logistic context mixing of bit predictors.

A text is a sequence of tokens (words with A-Z lower-cased, then one end). Each
token is a path of binary decisions: the ``HEAD`` most frequent training tokens,
the end and an escape are leaves of one Huffman tree; an escaped token is spelled
over a second tree of its bytes (or drawn from the rare training tokens; the two
are mixed). Every decision is predicted by several
predictors, each from counts under a hashed context (none, the last one, two and
three symbols) and the tree node; their stretched probabilities are
summed with weights that a gate selects (how much is known of the
first two hashed contexts), squashed, and refined by an adaptive table over gate and probability.
The log of all decisions is the score; -score / bytes * log2(10) the bits per
byte.

Learning, from training texts only, in passes over all of them:
1. token counts (also the unigram base score);
2. decision counts per hashed slot, summed over the tasks' tables;
3. weights and refinement, learned online (one gradient step per block of
   decisions) on texts of a hash part that step 2 left out, then averaged over
   the tasks by their number of decisions.
The tables have a fixed size (``SLOTS``), like any hashed model's; what is
shuffled to fill them grows with the corpus. A spelled token's score depends on
the token alone, so it is computed once per distinct token and joined, the most
frequent ones by a shipped table, the others by a shuffle join.

Null and empty texts hold the end only. Null ids hash like the empty string;
repeated rows count and score alike; other columns are ignored. With no training
texts the counts are all zero and every decision costs one bit (an escape, then
spelling), which is still a proper score.
"""

from __future__ import annotations

import heapq
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_text, saved, shipped, sliced
from .tokencount import most_frequent

FOLDS, HELD_OUT = 5, 1
HEAD = 40_000               # leaves of the word tree
SHIPPED = 200_000           # rare tokens whose scores the tasks hold
SLOTS = 1 << 19             # per context order
DEPTHS = (1, 2, 3)          # symbols that the hashed contexts look back
ORDERS = len(DEPTHS)
MIX_PARTS, MIX_PART = 16, 1     # texts in 1 of 16 hash parts train the mixer, the others the counts
BLOCK = 1024                # decisions per online step
RATE = 0.05
GATES, BUCKETS = 16, 33
HELD = 250_000              # tokens after which a task sums up; it hands on what is then more than twice this


# ---- trees -----------------------------------------------------------------

def huffman(freq: list[int]):
    """For each symbol its path: arrays (start, length) into nodes and bits."""
    import numpy as np
    n = len(freq)
    heap = [(max(int(f), 1), k) for k, f in enumerate(freq)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n, np.int64)
    side = np.zeros(2 * n, np.int8)
    top = n
    while len(heap) > 1:
        (fa, a), (fb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = top
        side[b] = 1
        heapq.heappush(heap, (fa + fb, top))
        top += 1
    root = top - 1
    nodes, bits, start, length = [], [], np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(n):
        path, x = [], k
        while x != root:
            path.append((int(parent[x]) - n, int(side[x])))
            x = int(parent[x])
        start[k], length[k] = len(nodes), len(path)
        for node, bit in reversed(path):
            nodes.append(node)
            bits.append(bit)
    return start, length, np.array(nodes, np.int64), np.array(bits, np.int8), max(n - 1, 1)


class Tree:
    def __init__(self, freq: list[int]):
        import numpy as np
        self.start, self.length, nodes, bits, self.n_nodes = huffman(freq)
        self.path = (2 * nodes + bits).astype(np.int32)

    def decisions(self, symbols):
        """node, its hash and bit of every decision, and how many each symbol has."""
        import numpy as np
        n = np.take(self.length, symbols)
        at = np.repeat(np.take(self.start, symbols) - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        path = np.take(self.path, at, mode="clip")      # places are valid; the default mode copies
        node = path >> 1
        spread = node.astype(np.uint64)
        spread *= np.uint64(0x9E3779B97F4A7C15)
        path &= 1
        return node, spread, path, n

    def counts(self, times):
        """Decisions per node and bit (at 2 * node + bit) of symbols met ``times`` times."""
        import numpy as np
        return np.bincount(self.path, weights=np.repeat(times, self.length), minlength=2 * self.n_nodes)


def contexts(symbols, first):
    """Hashes of the last ``DEPTHS`` symbols before each; ``first`` marks where a
    new sequence begins."""
    import numpy as np
    from .common import mix64
    prev, out = np.zeros(len(symbols), np.uint64), []
    place = np.arange(len(symbols)) - np.maximum.accumulate(np.where(first, np.arange(len(symbols)), 0))
    acc = np.zeros(len(symbols), np.uint64)
    for k in range(1, max(DEPTHS) + 1):
        prev = np.zeros(len(symbols), np.uint64)
        prev[k:] = symbols[:-k].astype(np.uint64) + np.uint64(1)
        prev[place < k] = 0
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + prev + np.uint64(k))
        if k in DEPTHS:
            out.append(acc * np.uint64(0xD6E8FEB86659FD93))
    return out


def slots(context, spread, n):
    """Slot of each decision in a context's table; symbol i has ``n[i]`` of them."""
    import numpy as np
    s = np.repeat(context, n)
    s += spread
    s >>= np.uint64(64 - SLOTS.bit_length() + 1)
    return s.view(np.int64)


# ---- model -----------------------------------------------------------------

class Mixer:
    """A tree with its tables: stretched probabilities and confidence per slot,
    mixing weights per gate, refinement per gate and probability bucket."""

    def __init__(self, tree: Tree, counts: list | None):
        import numpy as np
        self.tree, self.tables = tree, []
        for k in range(ORDERS + 1):
            size = tree.n_nodes if k == 0 else SLOTS
            n = counts[k] if counts is not None else np.zeros((2, size))
            n0, n1 = n[0].astype(np.float32), n[1].astype(np.float32)
            st = np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)
            if k in (1, 2):     # beside it what the slot adds to the gate: one place in memory is looked up, not two
                conf = np.floor(np.minimum(np.log2(n0 + n1 + 1), 3))
                st = np.stack([st, conf * np.float32(4 if k == 2 else 1)], axis=1)
            self.tables.append(st)
        self.weights = np.tile(np.array([0.8, 0.3, 0.2, 0.2], np.float32), (GATES, 1))
        self.refined = None

    def inputs(self, symbols, ctx):
        """Stretched predictions (predictors x decisions), gate, bit, decisions per symbol."""
        import numpy as np
        node, spread, bit, n = self.tree.decisions(symbols)
        x = np.empty((ORDERS + 1, len(node)), np.float32)
        np.take(self.tables[0], node, out=x[0], mode="clip")
        gate = np.zeros(len(node), np.float32)
        for k in range(1, ORDERS + 1):
            s = slots(ctx[k - 1], spread, n)
            if k in (1, 2):
                both = np.take(self.tables[k], s, axis=0, mode="clip")
                x[k] = both[:, 0]
                gate += both[:, 1]
            else:
                np.take(self.tables[k], s, out=x[k], mode="clip")
        return x, gate.astype(np.int64), bit, n

    def stretched(self, x, gate):
        """The mixed prediction of each decision before it is squashed."""
        import numpy as np
        weights = np.ascontiguousarray(self.weights.T)
        z = x[0] * np.take(weights[0], gate, mode="clip")
        for k in range(1, ORDERS + 1):
            z += x[k] * np.take(weights[k], gate, mode="clip")
        return np.clip(z, -12, 12, out=z)

    def cost(self, x, gate, bit):
        """log10 probability of each decision."""
        import numpy as np
        z = self.stretched(x, gate)
        p = np.exp(-z)
        p += 1
        np.divide(1, p, out=p)
        if self.refined is not None:
            z += 12
            z *= np.float32((BUCKETS - 1) / 24)
            lo = z.astype(np.int32)
            np.minimum(lo, BUCKETS - 2, out=lo)
            at = gate * BUCKETS
            at += lo
            p += np.take(self.refined, at, mode="clip")
            part = z - lo                       # in doubles from here on
            part *= np.take(self.steps, at, mode="clip")
            part += p
            part *= 0.5
            p = part
        np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
        p -= (1 - bit).astype(p.dtype)          # p, or p - 1 for a 0
        np.abs(p, out=p)
        return np.log10(p, out=p)

    def learn(self, x, gate, bit, seen):
        """Online steps over blocks of decisions; ``seen`` gathers refinement counts."""
        import numpy as np
        for i in range(0, len(bit), BLOCK):
            xb, gb, yb = x[:, i:i + BLOCK], gate[i:i + BLOCK], bit[i:i + BLOCK].astype(np.float32)
            z = self.stretched(xb, gb)
            error = yb - 1 / (1 + np.exp(-z))
            n = np.bincount(gb, minlength=GATES)
            for k in range(ORDERS + 1):
                step = np.bincount(gb, weights=error * xb[k], minlength=GATES)
                self.weights[:, k] += RATE * (step / np.sqrt(np.maximum(n, 1))).astype(np.float32)
            at = gb * BUCKETS + np.rint((z + 12) * ((BUCKETS - 1) / 24)).astype(np.int64)
            seen[0] += np.bincount(at, minlength=GATES * BUCKETS)
            seen[1] += np.bincount(at, weights=yb, minlength=GATES * BUCKETS)

    def finish(self, weights, seen):
        """Averaged weights and summed refinement counts of all tasks."""
        import numpy as np
        if weights is not None:
            self.weights = weights.astype(np.float32)
        if seen is not None:
            z = np.tile(np.linspace(-12, 12, BUCKETS), GATES)
            prior = 1 / (1 + np.exp(-z))
            self.refined = ((seen[1] + 20 * prior) / (seen[0] + 20)).astype(np.float32)
            self.steps = np.append(np.diff(self.refined), np.float32(0))
        return self


CHUNK = 10_000              # symbols whose decisions are in memory together


def slices(batch, rows: int = 512):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def chunks(symbols, first, most: int = CHUNK):
    """Slices of a long symbol array with their contexts (which look back
    across the cuts): bounded memory however long a text is."""
    ctx = contexts(symbols, first)
    for lo in range(0, len(symbols), most):
        at = slice(lo, lo + most)
        yield at, symbols[at], [c[at] for c in ctx]


def _pieces(symbols, n, most: int = 60_000):
    """Groups of sequences with a bounded number of symbols together, from
    concatenated symbols and the length of each sequence: symbols, where a sequence
    begins, lengths. Longer sequences are groups of their own."""
    import numpy as np
    end = np.cumsum(n)
    lo, begin = 0, 0
    while lo < len(n):
        hi = max(int(np.searchsorted(end, begin + most, side="right")), lo + 1)
        part, upto = n[lo:hi], int(end[hi - 1])
        first = np.zeros(upto - begin, bool)
        first[(end[lo:hi] - part - begin)[part > 0]] = True
        yield symbols[begin:upto], first, part
        lo, begin = hi, upto


def coded(column):
    """The words of an Arrow column of texts: number of each word among the distinct
    ones, these (an Arrow array of bytes), and the number of words per text. Arrow's
    ASCII functions have the rules of ``common.words``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string())))
    found = lists.flatten().cast(pa.binary())
    text = pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(found, b"")         # white space at the ends leaves empty ones
    found, text = found.filter(full), text[full.to_numpy(zero_copy_only=False)]
    distinct = found.dictionary_encode()
    return distinct.indices.to_numpy().astype(np.int64), distinct.dictionary, np.bincount(text, minlength=len(column))


def looked_up(get, tokens, other: int):
    """``get`` of each of an Arrow array of bytes, ``other`` where it has none."""
    import numpy as np
    keys = tokens.to_numpy(zero_copy_only=False).tolist()       # a fifth of the time of to_pylist
    return np.fromiter(map(get, keys, repeat(other)), np.int64, len(keys))


def with_ends(symbols, n, end: int):
    """Concatenated sequences of lengths ``n``, each with ``end`` behind it."""
    import numpy as np
    out = np.full(len(symbols) + len(n), end, np.int64)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n + 1) - 1] = False
    out[inside] = symbols
    return out, n + 1


def fitted(rows: DataFrame, columns: tuple, symbols_of, tree: Tree) -> Mixer:
    """Counts, weights and refinement from ``rows``; ``symbols_of(batch)`` gives
    the symbols of an Arrow batch's sequences and their lengths; the column
    ``mixing`` tells the rows of step 3."""
    import numpy as np
    spark = rows.sparkSession
    sizes = [tree.n_nodes] + [SLOTS] * ORDERS
    shipped_tree = spark.sparkContext.broadcast(tree)

    def count(batches):
        import pyarrow as pa
        tree = shipped_tree.value
        held = [np.zeros(2 * z, np.int64) for z in sizes]       # of slot s: bit 0 at 2s, bit 1 at 2s + 1
        met = np.zeros(len(tree.length), np.int64)
        any_rows = False
        for b in batches:
            any_rows = any_rows or b.num_rows > 0
            for s, first, _ in (p for x in slices(b) for p in _pieces(*symbols_of(x))):
                met += np.bincount(s, minlength=len(met))
                for _, s, ctx in chunks(s, first):
                    _, spread, bit, n = tree.decisions(s)
                    for k in range(1, ORDERS + 1):
                        at = slots(ctx[k - 1], spread, n)
                        at <<= 1
                        at |= bit
                        np.add.at(held[k], at, 1)
        if any_rows:        # a row per table and part of it, so that sums meet in many tasks
            held[0] += tree.counts(met).astype(np.int64)
            step = 1 << 16
            for k, t in enumerate(held):
                for lo in range(0, sizes[k], step):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([lo], pa.int32()),
                         pa.array([t[2 * lo:2 * (lo + step)].astype(np.uint32).tobytes()], pa.binary())],
                        names=["k", "lo", "n"])

    def summed(batches):
        import pyarrow as pa
        total = {}
        for b in batches:
            for k, lo, n in zip(*(b.column(c).to_pylist() for c in ("k", "lo", "n"))):
                v = np.frombuffer(n, np.uint32).astype(np.uint64)
                total[k, lo] = total[k, lo] + v if (k, lo) in total else v
        for (k, lo), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([lo], pa.int32()),
                                              pa.array([v.tobytes()], pa.binary())], names=["k", "lo", "n"])

    schema = "k int, lo int, n binary"
    tables = saved(rows.filter(~F.col("mixing")).select(*columns).mapInArrow(sliced(count), schema)
                   .repartition("k", "lo").mapInArrow(sliced(summed), schema), "bit-counts")
    counts = [np.zeros((2, z), np.float64) for z in sizes]
    for r in tables.toLocalIterator():          # a fixed number of rows
        n = np.frombuffer(bytes(r.n), np.uint64).reshape(-1, 2).T
        counts[r.k][:, r.lo:r.lo + n.shape[1]] += n
    model = Mixer(tree, counts)
    shipped_model = spark.sparkContext.broadcast(model)

    def mix(batches):
        import copy
        import pyarrow as pa
        m = copy.copy(shipped_model.value)
        m.weights = m.weights.copy()
        seen, n = np.zeros((2, GATES * BUCKETS)), 0
        for b in batches:
            for s, first, _ in (p for x in slices(b) for p in _pieces(*symbols_of(x))):
                for _, s, ctx in chunks(s, first):
                    x, gate, bit, _ = m.inputs(s, ctx)
                    m.learn(x, gate, bit, seen)
                    n += len(bit)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([(m.weights.astype(np.float64) * n).ravel().tolist()], pa.list_(pa.float64())),
                 pa.array([seen.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "w", "seen"])

    learned = rows.filter("mixing").select(*columns).mapInArrow(sliced(mix), "n long, w array<double>, seen array<double>")
    sums = (learned.select(F.explode(F.array(
        F.struct(F.lit("n").alias("c"), F.array(F.col("n").cast("double")).alias("v")),
        F.struct(F.lit("w").alias("c"), F.col("w").alias("v")), F.struct(F.lit("s").alias("c"), F.col("seen").alias("v")))).alias("x"))
        .select("x.c", F.posexplode("x.v").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).collect())
    got = {c: np.array([r.v for r in sorted((r for r in sums if r.c == c), key=lambda r: r.i)]) for c in "nws"}
    if not len(got["n"]) or not got["n"][0]:
        return model
    return model.finish((got["w"] / got["n"][0]).reshape(GATES, ORDERS + 1), got["s"].reshape(2, -1))


def cost_of(model: Mixer, symbols, lengths):
    """log10 probability of each sequence, from concatenated symbols and lengths."""
    import numpy as np
    out = []
    for s, first, n in _pieces(symbols, lengths):
        number, cost = np.repeat(np.arange(len(n)), n), np.zeros(len(n))
        for at, s, ctx in chunks(s, first):
            x, gate, bit, each = model.inputs(s, ctx)
            cost += np.bincount(np.repeat(number[at], each), weights=model.cost(x, gate, bit), minlength=len(n))
        out.append(cost)
    return np.concatenate(out) if out else np.empty(0)


# ---- the operator ----------------------------------------------------------

SPELL_END = 256


def spelled_symbols(tokens):
    """The bytes and end of each token of an Arrow array, concatenated, and the lengths."""
    import numpy as np
    import pyarrow.compute as pc
    n = pc.binary_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    return with_ends(np.frombuffer(joined(tokens), np.uint8), n, SPELL_END)


def joined(tokens) -> bytes:
    return b"".join(tokens.to_numpy(zero_copy_only=False).tolist())


def escaped_cost(c, spelled, known_share: float, rare_total: int):
    """log10 probability of escaped tokens of training count ``c`` and log10
    spelling probability ``spelled``: the mixture, in the log domain."""
    import numpy as np
    cost = np.log10(1 - known_share) + spelled
    drawn = np.flatnonzero(c > 0)
    ln10 = np.log(10.0)
    cost[drawn] = np.logaddexp(ln10 * np.log10(known_share * c[drawn] / rare_total), ln10 * cost[drawn]) / ln10
    return cost


def token_table(d: DataFrame) -> DataFrame:
    """token (bytes), c (in training texts), freq (in all), of all words."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def summed(tables):         # in the order in which the tokens were first met, which numbers them later
            t = pa.concat_tables(tables)
            t = t.append_column("at", pa.array(np.arange(len(t)))).group_by("token", use_threads=False).aggregate(
                [("c", "sum"), ("freq", "sum"), ("at", "min")]).sort_by("at_min")
            return pa.table({"token": t["token"], "c": t["c_sum"], "freq": t["freq_sum"]})

        parts, new = ([], []), 0            # of training texts, of the others
        for b in (x for batch in batches for x in slices(batch)):
            text, held = b.column("text"), b.column("held_out")
            for own, tables, texts in zip((1, 0), parts, (text.filter(pc.invert(held)), text.filter(held))):
                at, distinct, _ = coded(texts)
                freq = np.bincount(at, minlength=len(distinct))
                tables.append(pa.table({"token": distinct, "c": freq * own, "freq": freq}))
                new += len(distinct)
            if new > HELD:
                new = 0
                for tables in parts:
                    tables[:] = [summed(tables)]
                if sum(len(t) for tables in parts for t in tables) > 2 * HELD:
                    for tables in parts:
                        yield from tables.pop().to_batches()
        for tables in filter(None, parts):
            yield from summed(tables).to_batches()
    return (d.select("text", "held_out").mapInArrow(sliced(run), "token binary, c long, freq long")
            .groupBy("token").agg(F.sum("c").alias("c"), F.sum("freq").alias("freq")))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte of every row."""
    import numpy as np
    spark = docs.sparkSession
    shipped(spark)
    d = id_text(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
    mixing = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(MIX_PARTS)) < MIX_PART
    ends = d.filter(~F.col("held_out")).count()
    vocab = saved(token_table(d), "lm-tokens")
    total = vocab.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n = (total.n or 0) + ends
    v = (total.v or 0) + (1 if ends else 0)

    # word tree: 0 the escape, 1 the end, then the frequent training tokens
    known = vocab.filter("c > 0").select("token", "c", F.col("c").alias("freq"))
    top = most_frequent(known, HEAD).select("token", "c").toArrow()
    head = {bytes(t): k + 2 for k, t in enumerate(top["token"].to_pylist())}
    head_c = np.array([0, ends, *top["c"].to_pylist()], np.int64)
    tree = Tree([max(n - int(head_c.sum()), 1), max(ends, 1), *head_c[2:].tolist()])
    shipped_head = spark.sparkContext.broadcast((head, head_c))

    def word_symbols(b):
        get = shipped_head.value[0].get
        at, distinct, n = coded(b.column("text"))
        return with_ends(looked_up(get, distinct, 0)[at], n, 1)

    train = d.filter(~F.col("held_out")).withColumn("mixing", mixing)
    word_model = fitted(train, ("text",), word_symbols, tree)

    # spelling model: bytes of the training tokens outside the head, each once
    rest = vocab.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t in head], "token binary")), "token", "left_anti") \
        if len(head) else vocab
    rest = saved(rest, "lm-rare-tokens")
    spell_rows = rest.filter("c > 0").withColumn("mixing", F.pmod(F.xxhash64("token", F.lit("mix")), F.lit(MIX_PARTS)) < MIX_PART)
    byte_freq = [1] * 257

    def bytes_of(batches):
        import pyarrow as pa
        for b in batches:
            n = np.bincount(np.frombuffer(joined(b.column("token")), np.uint8), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n, pa.int64())], names=["x", "n"])

    for r in (spell_rows.select("token").mapInArrow(sliced(bytes_of), "x int, n long").groupBy("x")
              .agg(F.sum("n").alias("n")).collect()):       # 256 rows at most
        byte_freq[r.x] += r.n
    byte_freq[SPELL_END] += spell_rows.count()

    def spell_symbols(b):
        return spelled_symbols(b.column("token"))

    spell_model = fitted(spell_rows, ("token",), spell_symbols, Tree(byte_freq))
    shipped_spell = spark.sparkContext.broadcast(spell_model)

    def spell(batches):
        import pyarrow as pa
        for b in batches:
            c = b.column("c").to_numpy(zero_copy_only=False)
            cost = escaped_cost(c, cost_of(shipped_spell.value, *spell_symbols(b)), known_share, rare_total)
            yield pa.RecordBatch.from_arrays([b.column("token"), b.column("c"), b.column("freq"), pa.array(cost, pa.float64())],
                                             names=["token", "c", "freq", "cost"])

    # an escaped token is one of the rare training tokens, or spelled: a mixture
    # by the share of rare occurrences that are not a token's only one
    r = rest.agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).first()
    rare_total = max(int(r.c or 0), 1)
    known_share = min(max(1 - r.once / rare_total, 0.05), 0.95) if r.c else 0.0

    spelled = saved(rest.select("token", "c", "freq").mapInArrow(
        sliced(spell), "token binary, c long, freq long, cost double"), "lm-spelled")
    shipped_words = spark.sparkContext.broadcast(word_model)
    denominator = n + 0.5 * (v + 1)
    often = most_frequent(spelled, SHIPPED).select("token", "c", "cost").toArrow()
    shipped_rare = spark.sparkContext.broadcast((
        {t: k for k, t in enumerate(often["token"].to_pylist())}, often["c"].to_numpy(), often["cost"].to_numpy()))

    def score(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        (heads, c), model = shipped_head.value, shipped_words.value
        base = np.log10((c + 0.5) / denominator)
        rare_at, rare_c, rare_cost = shipped_rare.value
        rare_base = np.log10((rare_c + 0.5) / denominator)
        get, get_rare = heads.get, rare_at.get
        for b in (x for batch in batches for x in slices(batch)):
            at, distinct, n = coded(b.column("text"))
            # each distinct word: its symbol, its place among the shipped rare ones, what it adds to the sums
            symbol = looked_up(get, distinct, 0)
            place = np.where(symbol > 0, -1, looked_up(get_rare, distinct, -1))
            there, in_head = np.flatnonzero(place >= 0), symbol > 0
            known, base_of, cost_of_word = in_head & (c[symbol] > 0), np.where(in_head, base[symbol], 0), np.zeros(len(distinct))
            known[there] = rare_c[place[there]] > 0
            base_of[there], cost_of_word[there] = rare_base[place[there]], rare_cost[place[there]]
            text = np.repeat(np.arange(len(n)), n)
            per_text = lambda of, at=at, text=text, n=n: np.bincount(text, weights=of[at], minlength=len(n))
            cost = cost_of(model, *with_ends(symbol[at], n, 1)) + per_text(cost_of_word)
            n_known, base_sum = per_text(known).astype(np.int64) + int(c[1] > 0), per_text(base_of) + base[1]
            # the other words of each text, once each
            other = np.flatnonzero(((place < 0) & ~in_head)[at])
            pair, freq = np.unique(text[other] * len(distinct) + at[other], return_counts=True)
            offsets = pa.array(np.searchsorted(pair, np.arange(len(n) + 1) * len(distinct)), pa.int32())
            rare = pa.ListArray.from_arrays(offsets, distinct.take(pa.array(pair % max(len(distinct), 1))))
            freq = pa.ListArray.from_arrays(offsets, pa.array(freq, pa.int64()))
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n + 1, pa.int64()), pa.array(n_known, pa.int64()),
                 pa.array(base_sum, pa.float64()), pa.array(cost, pa.float64()), size, rare, freq],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base", "cost", "n_bytes", "rare", "freq"])

    rows = d.mapInArrow(sliced(score), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, cost double, "
                               "n_bytes long, rare array<binary>, freq array<long>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    tail = (rows.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "freq")).alias("x"))
            .select("row", F.col("x.rare").alias("token"), F.col("x.freq").alias("f"))
            .join(spelled.drop("freq"), "token").groupBy("row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("f")).otherwise(0)).alias("k"),
                F.sum(F.col("f") * F.log10((F.col("c") + 0.5) / F.lit(float(denominator)))).alias("b"),
                F.sum(F.col("f") * F.col("cost")).alias("s")))
    out = rows.drop("rare", "freq").join(tail, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total_score = F.col("cost") + zero("s")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"),
                      F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"),
                      total_score.alias("score"),
                      (-total_score * F.log2(F.lit(10.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
