"""MinHash near-duplicate groups.

1. Each text's 5-word shingles are hashed; ``BANDS * ROWS`` universal hashes
   (a*x + b over 64 bits, upper half kept) give its minima. Texts with the same
   shingle set form one class, and only one text per class goes on.
2. Bands of the signature are the buckets. A class is compared with the leader
   of each of its buckets (the member that is found in the largest buckets: in
   a group of edited copies, the original). A pair's signatures must agree well
   (signature verification), then the full shingle sets decide.
3. Components by alternating large-star and small-star over the links.
4. In buckets whose members are still in different components, the members of
   different components are compared block by block on their full sets, and the
   components are joined once more: no link between components is lost, while
   groups that hang together cost one comparison per member and bucket.

A pair misses all bands with probability 4e-7 at 85 % similarity, 5e-5 at 80 %.

Texts without words (null, empty, white space) have no shingles and stay alone.
Rows with a null id are alone as well and get no component. Rows that share an
id are one document, linked with whatever any of its texts is linked with.
Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, id_text, saved, settled, shingle_hashes, shipped, sliced, text_bytes, WordHash, words

SHINGLE = 5
LINK = 85                  # percent of the union, unless the caller names another
BANDS, ROWS = 25, 5
SEED = 7
BLOCK = 384                # members of an open bucket that one task holds, twice at most
STRIP = 16_384             # shingles looked at together inside a block
WANTED_BITS = 24           # of the bitmap of ids whose texts are read again


def agree(link: int) -> int:
    """Of ``BANDS * ROWS`` minima: sets of ``link`` % similarity agree in fewer
    places with p < 1e-6."""
    n, p, below, k = BANDS * ROWS, link / 100, 0.0, 0
    while k < n and (below := below + math.comb(n, k) * p ** k * (1 - p) ** (n - k)) < 1e-6:
        k += 1
    return k


def hash_family(n: int = BANDS * ROWS, seed: int = SEED):
    import numpy as np
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_set(text: bytes, cache: WordHash):
    """Sorted distinct shingle hashes."""
    import numpy as np
    return np.unique(shingle_hashes(hash_words(words(text), cache), SHINGLE))


def minima(s, a, b):
    """The smallest value of every hash over the set, as 32-bit numbers."""
    import numpy as np
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(s), 2048):
        block = ((a[:, None] * s[None, i:i + 2048] + b[:, None]) >> np.uint64(32)).astype(np.uint32)
        out = np.minimum(out, block.min(axis=1))
    return out


def band_keys(m):
    """One bucket key per band from the minima of many texts (a row each)."""
    import numpy as np
    from .common import mix64
    m = m.reshape(len(m), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(m), axis=0)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash (of the whole set), bands (bucket keys) and
    sig (the low byte of every minimum), one row per input row. Empty sets have
    no bands."""
    shipped(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        cache, (a, b) = WordHash(), hash_family()
        for batch in batches:
            n, key, bands, sig = [], [], [], []
            for t in text_bytes(batch.column("text")):
                s = shingle_set(t or b"", cache)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                m = minima(s, a, b)
                bands.append(band_keys(m[None, :])[0] if len(s) else [])
                sig.append(m.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "bands", "sig"])

    return id_text(docs).mapInArrow(
        sliced(run), "doc_id long, n_shingles long, set_hash binary, bands array<long>, sig binary")


def _agreement(pairs: DataFrame, link: int) -> DataFrame:
    """Pairs (a, b, ga, gb) whose signatures agree in ``agree(link)`` places or more."""
    least = agree(link)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
                    for c in ("ga", "gb"))
            ok = pa.array((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])
    return pairs.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, text of the wanted (cls, rep, set_hash): one text that has the class's
    set. A bitmap of fixed size over the ids lets the scan pass on little else."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << WANTED_BITS)).cast("int").alias("s")
    bits = bytearray(1 << WANTED_BITS - 3)
    for r in wanted.select(slot).distinct().toLocalIterator():      # at most 2^WANTED_BITS numbers
        bits[r.s >> 3] |= 1 << (r.s & 7)
    bitmap = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def let_through(batches):
        import numpy as np
        import pyarrow as pa
        seen = np.frombuffer(bitmap.value, dtype=np.uint8)
        for batch in batches:
            s = np.asarray(batch.column("s"))
            yield batch.filter(pa.array(((seen[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)))

    def of_class(batches):
        import pyarrow as pa
        import xxhash
        cache = WordHash()
        for batch in batches:
            ok = [xxhash.xxh3_128_digest(shingle_set(t or b"", cache).tobytes()) == h for t, h in
                  zip(text_bytes(batch.column("text")), batch.column("set_hash").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in ("cls", "text")],
                                             names=["cls", "text"])

    few = (docs.filter("doc_id is not null")
           .select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << WANTED_BITS)).cast("int").alias("s"))
           .mapInArrow(let_through, "doc_id long, text string, s int"))
    # a merge join at all sizes: a broadcast would put both Python steps into one task, and
    # a second worker a core that stays for all later stages
    return (few.join(wanted.hint("merge"), F.col("doc_id") == F.col("rep")).select("cls", "text", "set_hash")
            .mapInArrow(of_class, "cls long, text string").dropDuplicates(["cls"]))


def _similar(pairs: DataFrame, link: int) -> DataFrame:
    """Pairs (a, b, ta, tb) of texts whose full shingle sets are linked."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        cache, last = WordHash(), (None, None)
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column("a").to_pylist(), text_bytes(batch.column("ta")), text_bytes(batch.column("tb"))):
                if a != last[0]:
                    last = a, shingle_set(x, cache)
                x, y = last[1], shingle_set(y, cache)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= link * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])
    return pairs.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id) of every id in ``links`` (a, b), by
    alternating large-star and small-star until no edge changes. Each round is
    two aggregations; a hub's edges are minimised map-side before they meet."""
    edges = saved(links.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
                  .distinct(), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y"))
        if large:
            both = both.union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m"))
        low = low.withColumn("m", F.least("x", "m"))
        j = both.join(low, "x")
        # large-star: larger neighbours to the minimum; small-star: the smaller ones and itself
        j = j.filter("y > x") if large else j
        out = j.select(F.col("y").alias("p"), F.col("m").alias("q"))
        if not large:
            out = out.union(low.select(F.col("x").alias("p"), F.col("m").alias("q")))
        return (out.filter("p <> q").select(F.least("p", "q").alias("v"), F.greatest("p", "q").alias("u")).distinct())

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        edges = saved(star(saved(star(edges, True), "large-star"), False), "small-star")
        after = state(edges)
        if after == before:
            break
        before = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) of classes that are links: signatures, then full sets."""
    sig = lambda c: classes.select(F.col("cls").alias(c), F.col("sig").alias(f"g{c}"))
    near = saved(_agreement(pairs.join(sig("a"), "a").join(sig("b"), "b"), link), "near-pairs")
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}"))
    return _similar(near.join(side("b"), "b").join(side("a"), "a"), link)


def _open(buckets: DataFrame, of: DataFrame | None) -> DataFrame:
    """Buckets (key, cls, weight) whose members are in several components, with
    component and n, the bucket's size."""
    b = buckets.withColumn("component", F.col("cls")) if of is None else \
        buckets.join(of, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = b.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                 F.count("*").alias("n")).filter("lo <> hi")
    return b.join(mixed.select("key", "n"), "key")


def block_links(rows: list[tuple], link: int = LINK) -> list[tuple[int, int]]:
    """Links between members (cls, component, side, text) of different
    components, just enough to connect what is connected. Sides 0 and 1 are two
    blocks of a bucket, of which only pairs across are looked at; with one side,
    all are. Intersections of all pairs are products of 0/1 matrices over the
    shingles that occur twice, a strip of columns at a time."""
    import numpy as np
    cache = WordHash()
    sets = [shingle_set(r[3], cache) for r in rows]
    size = np.array([len(x) for x in sets], np.int64)
    comp = np.array([r[1] for r in rows], np.int64)
    side = np.array([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), size)
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    owner, col = owner[shared], col[shared]
    both = np.zeros((len(rows), len(rows)), np.float32)
    if len(col):
        order = np.argsort(col, kind="stable")
        owner = owner[order]
        col = np.cumsum(np.append(0, np.diff(col[order]) > 0))          # numbered without holes
        for lo in range(0, int(col[-1]) + 1, STRIP):
            at = slice(*np.searchsorted(col, [lo, lo + STRIP]))
            strip = np.zeros((len(rows), min(STRIP, int(col[-1]) + 1 - lo)), np.float32)
            strip[owner[at], col[at] - lo] = 1
            both += strip @ strip.T
    both = both.astype(np.int64)
    ok = 100 * both >= link * (size[:, None] + size[None, :] - both)
    ok &= comp[:, None] != comp[None, :]
    if side.any():
        ok &= side[:, None] != side[None, :]
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(ok)))):
        a, b = find(int(comp[x])), find(int(comp[y]))
        if a != b:
            root[a] = b
            out.append((rows[x][0], rows[y][0]))
    return out


def _compared(opened: DataFrame, texts: DataFrame, link: int) -> DataFrame:
    """Links (a, b) across components inside the open buckets. A bucket is cut
    into blocks of about ``BLOCK`` members, and every two blocks meet in one
    group, so a group is small however large the bucket."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    d = (opened.select("key", "cls", "component", own.alias("own"), blocks.alias("blocks"))
         .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
         .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "component",
                 (F.col("own") > F.least("own", "other")).cast("int").alias("side")))

    def run(batches):
        import pyarrow as pa
        group, rows = None, []

        def done():
            found = block_links(rows, link) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "cls", "component", "side")]
            for k, i, j, cls, component, side, text in zip(*cols, text_bytes(batch.column("text"))):
                if group != (k, i, j):
                    if rows:
                        yield done()
                    group, rows = (k, i, j), []
                rows.append((cls, component, side, text))
        if rows:
            yield done()

    return (d.join(texts, "cls").select("key", "i", "j", "cls", "component", "side", "text")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long"))


def class_links(classes: DataFrame, docs: DataFrame, link: int) -> DataFrame:
    """Links (a, b) between classes, enough of them for the components.

    First every bucket compares its members with its leader: that joins nearly
    all groups. In buckets whose members are still in several components, all
    members of different components are compared, block by block, on their full
    sets; only links that join components leave a block."""
    bands = saved(classes.select("cls", F.explode("bands").alias("key")), "bands")
    size = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = saved(bands.join(size, "key"), "shared-bands")
    weight = shared.groupBy("cls").agg(F.sum("n").alias("weight"))
    buckets = saved(shared.select("cls", "key").join(weight, "cls"), "weighted-bands")
    texts = saved(_texts(docs, saved(buckets.select("cls").distinct().join(
        classes.select("cls", "rep", "set_hash"), "cls"), "member-classes")), "member-texts")
    leaders = buckets.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cls")).alias("c"))).alias("x")) \
        .select("key", (-F.col("x.c")).alias("leader"))
    pairs = (buckets.join(leaders, "key").filter("cls <> leader")
             .select(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).distinct())
    links = saved(_linked(pairs, classes, texts, link), "leader-links")
    of = saved(components(links).select(F.col("id").alias("cls"), "component"), "class-components")
    opened = saved(_open(buckets, of), "open-bands")
    return links.union(saved(_compared(opened, texts, link).distinct(), "block-links"))


def groups(docs: DataFrame, link: int = LINK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row. Texts are linked at
    ``link`` % similarity."""
    d = id_text(docs)
    rows = saved(signatures(d), "signatures")
    real = rows.filter("n_shingles > 0 and doc_id is not null")
    # one class per distinct set, numbered when it is written
    classes = real.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
                                           F.first("sig").alias("sig"))
    classes = saved(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    links = class_links(classes, d, link)
    of = saved(real.select("doc_id", "set_hash").join(classes.select("set_hash", "cls"), "set_hash")
               .select("doc_id", "cls").distinct(), "document-classes")
    # an id with several texts joins their classes
    shared = (of.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).filter("a <> z")
              .join(of, "doc_id").select("a", F.col("cls").alias("b")))
    comp = components(links.union(shared)).select(F.col("id").alias("cls"), "component")
    of = of.join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    first = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = of.join(first, "component").select("doc_id", "component_id").distinct()
    out = rows.select("doc_id", "n_shingles").join(ids.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _row_hash(d: DataFrame):
    """64-bit hash of all columns. Spark's hash passes over nulls, so where they
    are is hashed as well, and nested values are hashed as JSON."""
    parts = []
    for c, kind in d.dtypes:
        value = F.col(f"`{c}`")
        parts += [F.to_json(value) if kind.startswith(("array<", "map<", "struct<")) else value, value.isNull()]
    return F.xxhash64(*parts)


def one_of_each(docs: DataFrame, link: int = LINK) -> DataFrame:
    """One row of each group of near copies, same columns; of each group the first
    row of the scan stays. Rows are told apart by a 64-bit hash of all their columns,
    so copies that share an id, or have none, are a group as well, and no copy of the
    texts is written. Rows alike in every column are one document of which one stays,
    unless they have no words. (Different rows of one hash would count as one
    document: in 15 million rows some such pair exists with a probability of 6e-6.)"""
    spark = docs.sparkSession
    own = docs.select(F.struct("*").alias("_doc"), _row_hash(docs).alias("_hash"))

    def marked() -> DataFrame:
        """_hash and whether it stays, of the rows that go and of alike rows."""
        rows = saved(own.select("_hash", F.monotonically_increasing_id().alias("_row")), "row-hashes")
        rows = rows.groupBy("_hash").agg(F.min("_row").alias("_row"), F.count(F.lit(1)).alias("n"))
        grouped = groups(own.select(F.col("_hash").alias("doc_id"), F.col("_doc.text").alias("text")), link)
        of = saved(grouped.filter("n_shingles > 0").select(F.col("doc_id").alias("_hash"), "component_id").distinct()
                   .join(rows, "_hash"), "row-components")
        first = of.groupBy("component_id").agg(F.min("_row").alias("_first"))
        of = of.join(first, "component_id").withColumn("stays", F.col("_row") == F.col("_first"))
        return of.filter("not stays or n > 1").select("_hash", "stays")

    marks = settled(spark, marked, "near-copies")
    out = own.join(marks, "_hash", "left_anti").select("_doc.*")
    alike = marks.filter("stays")
    if not alike.isEmpty():
        one = own.join(alike, "_hash", "left_semi").groupBy("_hash").agg(F.first("_doc").alias("_doc"))
        out = out.union(one.select("_doc.*"))
    return out
