"""Removal of long repeated byte strings by column-wise construction.

Every 400-byte window has an anchor: the 32-byte string with the smallest hash
in it (leftmost of equals). Equal windows have equal anchors at equal places, so
texts are cut into pieces - the bytes of neighbouring windows that share one
anchor - and only pieces of the same anchor can share a window. Pieces are dealt
by anchor; equal pieces are counted, not moved (a piece met twice is repeated
whole), and anchors met once are dropped before any text moves.

Inside an anchor the different pieces are laid over each other with their
anchors aligned, and the collection is built column by column from the right:
each round inserts one symbol per piece in front of its suffix. The round's
symbols in suffix order are the newest segment of the collection's
Burrows-Wheeler transform; a stable sort by them gives the next suffix order,
and the common prefix of neighbours is one more than the least common prefix
between their tails (0 across different symbols). A window is repeated if its
suffix shares 400 bytes or more with a neighbour. Because aligned columns only
ever compare with themselves, a round reads and writes just the newest segment,
front to back; pieces stream in from sorted shuffle files, ``BATCH_PIECES`` at a
time, and tables between the steps lie in the shared folder (a task's own disk
is not used).

An anchor with more than ``SPLIT_PIECES`` different pieces (a passage in very
many contexts) is split exactly: its windows are dealt again by ``CORES`` of
columns, keyed by the bytes that all windows of a core have in common, then, if
still too many, window by window, where equal pieces are equal windows.

Texts are UTF-8 bytes; null and short texts lose nothing. Repeated rows are
copies of each other (all are removed, as contracts of this kind ask). Rows are
told apart by id and text hash, so null and repeated ids work. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, saved, shipped, sliced, text_bytes

LENGTH = 400
ANCHOR = 32
SEGMENT = 8_000_000           # windows looked at together in one very long text
BATCH_PIECES = 8_000
SPLIT_PIECES = 8_000
CORES = (48, 1)               # columns dealt together, first and second split
KEY = ("doc", "text_hash")


def _symbols():
    import numpy as np
    return np.random.default_rng(400).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchor_hashes(b, table):
    """Hash of the 32 bytes from every position (doubling from single bytes)."""
    import numpy as np
    from .common import mix64
    h, width = table[b], 1
    factor = 0x9E3779B97F4A7C15
    while width < ANCHOR:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor = factor * factor + 2 & (1 << 64) - 1 | 1
        width *= 2
    return mix64(h)


def runs(b, table, length: int = LENGTH):
    """Runs of windows with one anchor: (first window, windows, anchor position,
    anchor hash) arrays of a byte array."""
    import numpy as np
    n = len(b) - length + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    out = []
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        h = anchor_hashes(b[lo:hi + length - 1], table)
        # upper 40 bits of the hash, then the place: the minimum is the leftmost smallest
        m = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        span, width = length - ANCHOR + 1, 1
        while width * 2 <= span:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < span:
            m = np.minimum(m[:len(m) - (span - width)], m[span - width:])
        at = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        count = np.diff(np.append(first, len(at)))
        out.append((first + lo, count, at[first] + lo, h[at[first]]))
    return tuple(np.concatenate(x) for x in zip(*out))


_PIECES = ("doc long, text_hash long, anchor long, piece long, start int, len int, lead int, step int, times int")


def piece_rows(docs: DataFrame) -> DataFrame:
    """One narrow row per piece: its anchor, the hash of its bytes, where it
    starts, its length and the bytes before the anchor. Equal pieces in even
    steps (periodic text) are one row with ``times``."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        table = _symbols()
        for batch in batches:
            cols = [[] for _ in range(9)]

            def out():
                types = [pa.int64()] * 4 + [pa.int32()] * 5
                names = [x.split()[0] for x in _PIECES.split(", ")]
                made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(cols, types)], names=names)
                for c in cols:
                    c.clear()
                return made

            held = 0
            for doc, th, text in zip(batch.column("doc").to_pylist(), batch.column("text_hash").to_pylist(),
                                     text_bytes(batch.column("text"))):
                if not text or len(text) < LENGTH:
                    continue
                start, count, at, anchor = runs(np.frombuffer(text, np.uint8), table)
                size = count + LENGTH - 1
                view = memoryview(text)
                piece = np.fromiter((xxhash.xxh3_64_intdigest(view[s:s + z]) for s, z in zip(start.tolist(), size.tolist())),
                                    np.uint64, len(start))
                # fold equal neighbours
                new = np.ones(len(start), bool)
                new[1:] = (piece[1:] != piece[:-1]) | (anchor[1:] != anchor[:-1]) | (size[1:] != size[:-1])
                gap = np.diff(start, prepend=start[0])
                new[2:] |= ~new[1:-1] & (gap[2:] != gap[1:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(start)))
                step = np.where(times > 1, gap[np.minimum(first + 1, len(start) - 1)], 0)
                k = len(first)
                for c, v in zip(cols, (np.full(k, doc), np.full(k, th), anchor[first].view(np.int64),
                                       piece[first].view(np.int64), start[first], size[first],
                                       (at - start)[first], step, times)):
                    c.append(v)
                held += k
                if held > 200_000:
                    yield out()
                    held = 0
            if held:
                yield out()
    return docs.select("doc", "text_hash", "text").mapInArrow(sliced(run), _PIECES)


def _cut_pieces(texts: DataFrame) -> DataFrame:
    """Rows (anchor, piece, lead, bytes) from texts with their wanted pieces."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            rows = []
            for text, wanted in zip(text_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
                rows += [(w["anchor"], w["piece"], w["lead"], text[w["start"]:w["start"] + w["len"]]) for w in wanted]
            for i in range(0, len(rows), 20_000):
                part = rows[i:i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
                     pa.array([r[2] for r in part], pa.int32()), pa.array([r[3] for r in part], pa.binary())],
                    names=["anchor", "piece", "lead", "bytes"])
    return texts.mapInArrow(run, "anchor long, piece long, lead int, bytes binary")


def repeated_windows(pieces: list, length: int = LENGTH) -> list:
    """For pieces (group number, bytes before the anchor, bytes), ascending by
    group: a boolean array per piece, True for each window that another piece of
    the group holds too. Column-wise construction as described above."""
    import numpy as np
    n = len(pieces)
    group = np.array([p[0] for p in pieces], np.int64)
    lead = np.array([p[1] for p in pieces], np.int64)
    size = np.array([len(p[2]) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    base = np.cumsum(size) - size
    left, right = -lead, size - lead            # columns [left, right) of each piece
    marks = [np.zeros(z - length + 1, bool) for z in size]
    flat = np.zeros(int((size - length + 1).sum()), bool)
    offset = np.cumsum(size - length + 1) - (size - length + 1)
    entering = np.argsort(-right, kind="stable")
    entered = 0
    order = np.empty(0, np.int64)               # pieces by (group, suffix from the last column on)
    lcp = np.empty(0, np.int32)                 # with the one before; 0 at a group's first
    for column in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        upto = entered
        while upto < n and right[entering[upto]] > column:
            upto += 1
        if upto > entered:                      # empty suffixes come before all others of their group
            new = np.sort(entering[entered:upto])
            at = np.searchsorted(group[order], group[new], side="left")
            order = np.insert(order, at, new)
            where = at + np.arange(len(new))
            lcp = np.insert(lcp, at, 0)
            lcp[np.minimum(where + 1, len(lcp) - 1)] = 0
            entered = upto
        stay = left[order] <= column
        if not stay.all():                      # pieces that begin to the right are complete
            kept = np.flatnonzero(stay)
            if not len(kept):
                order, lcp = order[:0], lcp[:0]
                continue
            # the prefix shared across the ones taken out is the least among them
            lcp = np.minimum.reduceat(lcp[:kept[-1] + 1], np.concatenate([[0], kept[:-1] + 1]))
            order = order[kept]
        symbol = text[base[order] + column + lead[order]]       # this round's segment of the transform
        key = group[order] * 256 + symbol
        move = np.argsort(key, kind="stable")
        same = np.empty(len(move), bool)
        same[0] = False
        same[1:] = key[move][1:] == key[move][:-1]
        shared = np.zeros(len(move), np.int32)
        k = np.flatnonzero(same)
        if len(k):
            lo, hi = move[k - 1] + 1, move[k] + 1
            near = hi - lo == 1
            least = lcp[lo]                     # neighbours before, neighbours now
            far = np.flatnonzero(~near)
            if len(far):
                edges = np.empty(2 * len(far), np.int64)
                edges[0::2], edges[1::2] = lo[far], hi[far]
                least[far] = np.minimum.reduceat(np.append(lcp, 0), edges)[0::2]
            shared[k] = least + 1
        order, lcp = order[move], shared
        again = lcp >= length
        again[:-1] |= again[1:]
        hit = order[again]
        if len(hit):
            flat[offset[hit] + column + lead[hit]] = True
    for i in range(n):
        marks[i] = flat[offset[i]:offset[i] + size[i] - length + 1]
    return marks


def _intervals(mark) -> list[tuple[int, int]]:
    """[from, to) of covered bytes for marked windows, joined where they overlap."""
    import numpy as np
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > LENGTH)
    first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
    return list(zip(first.tolist(), (last + LENGTH).tolist()))


_FOUND = "anchor long, piece long, s int, e int"


def _build(pieces: DataFrame) -> DataFrame:
    """anchor, piece, s, e: byte ranges of pieces (anchor, piece, lead, bytes)
    that are covered by windows found in another piece of the anchor. Anchors
    are whole in a partition and sorted, and are built some thousand pieces at
    a time."""
    def run(batches):
        import pyarrow as pa
        held, names = [], []

        def flush(n):
            found = []
            for (a, p), mark in zip(names[:n], repeated_windows(held[:n])):
                found += [(a, p, s, e) for s, e in _intervals(mark)]
            del held[:n], names[:n]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                names=["anchor", "piece", "s", "e"])

        number, last = 0, None
        for batch in batches:
            for a, p, lead, b in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "lead", "bytes"))):
                if a != last:
                    number, last = number + 1, a
                    if len(held) >= BATCH_PIECES:
                        yield flush(len(held))
                held.append((number, lead, b))
                names.append((a, p))
        if held:
            yield flush(len(held))
    return pieces.select("anchor", "piece", "lead", "bytes").mapInArrow(run, _FOUND)


def _split(pieces: DataFrame, columns: int) -> DataFrame:
    """Pieces cut into runs of ``columns`` windows at fixed places relative to
    the anchor, with a new anchor: place and the bytes every window there has in
    common. Adds from (place in the parent) and keeps the parent's name."""
    def run(batches):
        import pyarrow as pa
        import xxhash
        for batch in batches:
            rows = []
            for a, p, c, lead, b in zip(*(batch.column(x).to_pylist() for x in ("anchor", "piece", "c", "lead", "bytes"))):
                windows = len(b) - LENGTH + 1
                w = 0
                while w < windows:
                    place = (w - lead) // columns
                    end = min(windows, (place + 1) * columns + lead)
                    core = b[(place + 1) * columns + lead - 1:place * columns + lead + LENGTH]
                    sub = b[w:end + LENGTH - 1]
                    key = xxhash.xxh3_64_intdigest(core, seed=(a ^ place) & (1 << 64) - 1)
                    rows.append((a, p, w, c, key - (1 << 63), xxhash.xxh3_64_intdigest(sub) - (1 << 63), lead - w, sub))
                    w = end
                if len(rows) > 5000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    def _rows(rows):
        import pyarrow as pa
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                          names=["pa", "pp", "from", "c", "anchor", "piece", "lead", "bytes"])
    return pieces.mapInArrow(run, "pa long, pp long, from int, c long, anchor long, piece long, lead int, bytes binary")


def found_ranges(pieces: DataFrame, level: int = 0) -> DataFrame:
    """anchor, piece, s, e for distinct pieces (anchor, piece, c = times met,
    lead, bytes). Anchors with too many pieces are split and dealt again."""
    per = pieces.groupBy("anchor").agg(F.count("*").alias("d"))
    pieces = pieces.join(per.filter("d > 1"), "anchor")
    small = pieces.filter(F.col("d") <= SPLIT_PIECES)
    found = _build(small.repartition(F.col("anchor")).sortWithinPartitions("anchor", "piece"))
    if level >= len(CORES):
        return found
    large = pieces.filter(F.col("d") > SPLIT_PIECES)
    if large.isEmpty():
        return found
    subs = saved(_split(large.select("anchor", "piece", "c", "lead", "bytes"), CORES[level]), "split-pieces")
    distinct = subs.groupBy("anchor", "piece").agg(F.sum("c").alias("c"), F.first("lead").alias("lead"),
                                                   F.first("bytes").alias("bytes"))
    distinct = saved(distinct, "split-distinct")
    whole = distinct.filter("c > 1").select("anchor", "piece", F.lit(0).alias("s"), F.length("bytes").alias("e"))
    inner = whole.union(found_ranges(distinct.filter("c >= 1"), level + 1))
    mapped = (subs.select("pa", "pp", "from", "anchor", "piece").join(inner, ["anchor", "piece"])
              .select(F.col("pa").alias("anchor"), F.col("pp").alias("piece"),
                      (F.col("from") + F.col("s")).cast("int").alias("s"), (F.col("from") + F.col("e")).cast("int").alias("e")))
    return found.union(mapped)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (id or a stand-in for null, text hash)."""
    d = id_text(docs)
    return d.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash": F.xxhash64("text")})


def repeated_ranges(d: DataFrame) -> DataFrame:
    """doc, text_hash, ranges (array of s, e): bytes to remove, not yet joined."""
    rows = saved(piece_rows(d), "pieces")
    often = rows.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor")
    rows = saved(rows.join(often, "anchor"), "shared-pieces")
    # equal pieces meet as counts, and one place of each
    met = rows.groupBy("anchor", "piece").agg(
        F.sum("times").alias("c"), F.min(F.struct(*KEY, "start", "len", "lead")).alias("at"))
    met = saved(met, "distinct-pieces")
    several = met.groupBy("anchor").agg(F.count("*").alias("d")).filter("d > 1").select("anchor")
    wanted = (met.join(several, "anchor")
              .groupBy("at.doc", "at.text_hash")
              .agg(F.collect_list(F.struct("anchor", "piece", "at.start", "at.len", "at.lead")).alias("wanted")))
    texts = d.select(*KEY, "text").join(wanted, list(KEY))
    cut = _cut_pieces(texts.select("text", "wanted")).dropDuplicates(["anchor", "piece"])
    pieces = saved(cut.join(met.select("anchor", "piece", "c"), ["anchor", "piece"]), "piece-bytes")
    inside = saved(found_ranges(pieces), "found-ranges")
    whole = rows.join(met.filter("c > 1").select("anchor", "piece"), ["anchor", "piece"]) \
        .select(*KEY, F.col("start").alias("s"), (F.col("start") + (F.col("times") - 1) * F.col("step") + F.col("len")).alias("e"))
    part = rows.join(inside.join(met.filter("c = 1").select("anchor", "piece"), ["anchor", "piece"]), ["anchor", "piece"]) \
        .select(*KEY, (F.col("start") + F.col("s")).alias("s"), (F.col("start") + F.col("e")).alias("e"))
    return whole.union(part).groupBy(*KEY).agg(F.collect_set(F.struct("s", "e")).alias("ranges"))


def _stripped(d: DataFrame, with_text: bool) -> DataFrame:
    def run(batches):
        import hashlib
        import pyarrow as pa
        for batch in batches:
            out = []
            for text, ranges in zip(text_bytes(batch.column("text")), batch.column("ranges").to_pylist()):
                text = text or b""
                spans = []
                for s, e in sorted((r["s"], r["e"]) for r in ranges or ()):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(text[at:s])
                    at = e
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans,
                            kept if with_text else None))
            cols = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.string()),
                    pa.array([o[4] for o in out], pa.list_(pa.list_(pa.int64()))), pa.array([o[5] for o in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])
    return d.select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
             "spans array<array<long>>, kept binary")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ([from, to) of
    removed bytes) and, on request, the kept bytes."""
    shipped(docs.sparkSession)
    d = keyed(docs)
    ranges = saved(repeated_ranges(d), "repeated-ranges")
    return _stripped(d.join(ranges, list(KEY), "left"), with_text)
