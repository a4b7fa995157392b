"""Training-order materialisation of token ids as fixed-stride binary shards.

1. Texts become 16-bit token ids, each text followed by the end id, cut into
   sequences of ``LENGTH`` ids inside a task (the last one of a task is padded).
   The sequences are written once; a sequence's index is its file's offset plus
   its row in the file, so numbering needs counts per file but no sort.
2. A keyed Feistel permutation with cycle-walking maps indices 0..n-1 one to one
   onto slots 0..n-1: the training order, reproducible from key and n.
3. Slots are dealt by range, ``PER_SHARD`` to a partition, sorted, and written
   as one file per shard: every record is LENGTH little-endian 16-bit ids and a
   line feed, so record r of a shard starts at r * STRIDE. A reader resumes at
   any slot by arithmetic alone.

Null and empty texts add only their end id; null ids, repeated rows and further
columns do not matter; an empty table writes no shards and gives no rows.
"""

from __future__ import annotations

import zlib
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import id_text, saved, shipped, sliced
from .tokencount import PRE_TOKEN, check_model

LENGTH = 1024
PER_SHARD = 8192
TEXTS = 250                 # texts whose words are looked up together
WORDS = 1 << 16             # words whose ids are put together at a time
END, PAD = 2, 0
KEY = 20240917
ROUNDS = 4


def stride(length: int = LENGTH) -> int:
    return 2 * length + 1


class PieceIds:
    """Ids of pre-tokens without their first space, remembered up to a limit and
    kept between the tasks of one worker. Words are an Arrow array, so that those of
    a whole batch are looked up at once; number 0 is the end of a text, number k the
    word k - 1, and its ids lie at ``start[k]``, ``length[k]`` of them."""
    LIMIT = 300_000
    _by_path: dict[str, PieceIds] = {}

    def __init__(self, path: str):
        import numpy as np
        import pyarrow as pa
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.space = [self.sp.piece_to_id("▁")]
        self.words, self.uses = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.ids, self.start, self.length = np.array([END], "<u2"), np.array([0]), np.array([1])

    @classmethod
    def of(cls, path: str) -> PieceIds:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    @classmethod
    def forget(cls) -> None:
        cls._by_path.clear()

    def halve(self) -> None:
        """Forget all but the words that were in the most batches."""
        import numpy as np
        import pyarrow as pa
        keep = np.sort(np.argsort(-self.uses, kind="stable")[:self.LIMIT // 2])
        self.words, self.uses = self.words.take(pa.array(keep)), self.uses[keep] // 2
        k = np.append(0, keep + 1)
        self.ids, n = self.ids_of(k), self.length[k]
        self.start, self.length = np.cumsum(n) - n, n

    def learn(self, new) -> None:
        import numpy as np
        import pyarrow as pa
        got = self.sp.encode(new.to_numpy(zero_copy_only=False).tolist(), num_threads=1)
        got = [ids or self.space for ids in got]
        n = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(n) - n)
        self.length = np.append(self.length, n)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(got), "<u2", int(n.sum())))
        self.words, self.uses = pa.concat_arrays([self.words, new]), np.append(self.uses, np.zeros(len(new), np.int64))

    def numbers(self, words):
        """The number of each of the distinct ``words``; valid until the next call."""
        import numpy as np
        import pyarrow.compute as pc
        at = pc.index_in(words, value_set=self.words)
        if len(self.words) + at.null_count > self.LIMIT and len(self.words):
            self.halve()
            at = pc.index_in(words, value_set=self.words)
        known, new = len(self.words), words.filter(pc.is_null(at))
        if len(new):
            self.learn(new)
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = known + np.arange(len(new))
        self.uses[at] += 1
        return at + 1

    def ids_of(self, numbers):
        """The ids of the numbers, one after the other."""
        import numpy as np
        n = self.length[numbers]
        place = np.arange(int(n.sum())) + np.repeat(self.start[numbers] - (np.cumsum(n) - n), n)
        return self.ids[place]


def keys_of(text: str | None) -> list[str]:
    """The keys of a text's pre-tokens: the tokenizer puts a space in front of
    its input anyway."""
    if not text:
        return []
    return [t[1:] for t in PRE_TOKEN.findall(" " + text)]


def keys_of_all(texts):
    """``keys_of`` of an Arrow array of texts: texts whose spaces stand alone between
    words are just split."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    keys = pc.split_pattern(texts, " ")
    odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, "  |▁|^ | $|^$"), True).to_numpy(zero_copy_only=False))
    if len(odd):
        others = pa.array([keys_of(t) for t in texts.take(pa.array(odd)).to_pylist()], keys.type)
        order = np.arange(len(texts))
        order[odd] = len(texts) + np.arange(len(odd))
        keys = pa.concat_arrays([keys, others]).take(pa.array(order))
    return keys


# Sequences wait compressed until they are written; a dictionary trained on a
# bounded sample (the first texts) makes up for their shortness.
DICTIONARY_BYTES, SAMPLE_TEXTS, SAMPLE_SEQUENCES, LEVEL = 1 << 16, 500, 1500, 6


class Packer:
    """Compresses and restores the ids of one sequence."""

    def __init__(self, dictionary: bytes):
        import zstandard
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=d).compress
        self.unpack = zstandard.ZstdDecompressor(dict_data=d).decompress


def trained(docs: DataFrame, path: str, length: int) -> bytes:
    """A compression dictionary, or none where the sample is too small."""
    import pyarrow as pa
    import zstandard
    plain = Packer(b"")
    # an Arrow table goes to the tasks as it is; rows would pass through further Python
    # workers, which stay and then fill their own ``PieceIds``
    rows = id_text(docs).take(SAMPLE_TEXTS)
    first = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array([r.doc_id for r in rows], pa.int64()),
                                                        "text": pa.array([r.text for r in rows], pa.string())}))
    rows = sequences(first, path, length).select("ids").take(SAMPLE_SEQUENCES)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [plain.unpack(bytes(r.ids)) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def sequences(docs: DataFrame, path: str, length: int = LENGTH, dictionary: bytes = b"") -> DataFrame:
    """doc_ids, n_tokens, ids (compressed bytes) and crc: fixed-length sequences in the
    order of the input's tasks. A text may span sequences."""
    shipped(docs.sparkSession)
    check_model(path)

    def run(batches):
        import pyarrow as pa
        import numpy as np
        pieces, pack = PieceIds.of(path), Packer(dictionary).pack
        buffer, owners = bytearray(), []        # owners: (doc_id, end of its ids in buffer)
        size = 2 * length

        def cut(n: int):
            """The first n sequences of the buffer as a batch."""
            out, first = [], 0
            for k in range(n):
                upto = (k + 1) * size
                own = []
                while first < len(owners):
                    own.append(owners[first][0])
                    if owners[first][1] > upto:
                        break
                    first += 1
                piece = bytes(buffer[k * size:upto])
                full = piece.ljust(size, bytes([PAD]))
                out.append((own, len(piece) // 2, pack(full), zlib.crc32(full)))
            del buffer[:n * size]
            owners[:] = [(d, e - n * size) for d, e in owners[first:]]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.int32()),
                 pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.int64())],
                names=["doc_ids", "n_tokens", "ids", "crc"])

        for part in batches:
            keys = keys_of_all(part.column("text").cast(pa.string()))
            n_words = keys.value_lengths().to_numpy()
            words = keys.flatten().dictionary_encode()
            numbers = pieces.numbers(words.dictionary)[words.indices.to_numpy()]
            numbers = np.insert(numbers, np.cumsum(n_words), 0)
            n_ids = np.cumsum(pieces.length[numbers])[np.cumsum(n_words + 1) - 1]
            owners += zip(part.column("doc_id").to_pylist(), (len(buffer) + 2 * n_ids).tolist())
            for at in range(0, len(numbers), WORDS):
                buffer += pieces.ids_of(numbers[at:at + WORDS]).tobytes()
            if len(buffer) >= 256 * size:
                yield cut(len(buffer) // size)
        if buffer:
            yield cut(-(-len(buffer) // size))

    return id_text(docs).mapInArrow(sliced(run, TEXTS), "doc_ids array<long>, n_tokens int, ids binary, crc long")


def feistel(index, n: int, key: int = KEY):
    """Slots of an array of indices below n: a permutation of 0..n-1. Halves of
    equal width cover at most 4 n values; a value that falls outside is sent
    through again until it is inside, which keeps the map one to one."""
    import numpy as np
    from .common import mix64
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & (1 << 64) - 1) for r in range(ROUNDS)]
    slot = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(slot))
    while len(todo):
        x = slot[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        slot[todo] = (left << shift) | right
        todo = todo[slot[todo] >= np.uint64(n)]
    return slot.astype(np.int64)


def numbered(seqs: DataFrame) -> tuple[DataFrame, int]:
    """Adds the dense index of each sequence of a written table, and their number."""
    d = seqs.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    per_file = d.groupBy("_file").agg(F.count("*").alias("n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    offsets = saved(per_file.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "sequence-offsets")
    n = offsets.agg(F.sum("n")).first()[0] or 0
    d = d.join(offsets.drop("n"), "_file").withColumn("index", F.col("offset") + F.col("_row"))
    return d.drop("_file", "_row", "offset"), n


def slotted(seqs: DataFrame, key: int = KEY, per_shard: int = PER_SHARD, length: int = LENGTH) -> tuple[DataFrame, int]:
    """Adds slot, shard and byte offset in the shard; also the number of sequences."""
    d, n = numbered(seqs)

    @F.pandas_udf("long")
    def slot_of(index):
        import pandas as pd
        return pd.Series(feistel(index.to_numpy(), n, key))

    d = d.withColumn("slot", slot_of("index"))
    return d.withColumns({"shard": F.expr(f"cast(slot div {per_shard} as int)"),
                          "offset": (F.col("slot") % per_shard) * stride(length)}), n


def write_shards(slots: DataFrame, n: int, path: str, dictionary: bytes, per_shard: int = PER_SHARD) -> None:
    """One file per shard (part number = shard number) of raw records."""
    def unpacked(batches):
        import pyarrow as pa
        PieceIds.forget()       # the sequences are written: the worker's memory is free again
        unpack = Packer(dictionary).unpack
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([unpack(x) for x in b.column("ids").to_pylist()], pa.binary())], names=["ids"])

    shards = max(1, -(-n // per_shard))
    (slots.select("slot", "shard", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
     .select("ids").mapInArrow(sliced(unpacked), "ids binary")
     # the text writer puts out a value's bytes as they are and a line feed
     .select(F.col("ids").cast("string").alias("value")).write.text(path))


def read_shard(spark: SparkSession, path: str, shard: int, first: int = 0, length: int = LENGTH,
               per_shard: int = PER_SHARD):
    """RDD of (slot, ids) of one shard in slot order, from slot ``first`` on."""
    import numpy as np

    def one(x):
        record, r = x
        return shard * per_shard + r, np.frombuffer(record[:2 * length], dtype="<u2").tolist()

    records = spark.sparkContext.binaryRecords(f"{path}/part-{shard:05d}-*", stride(length))
    return records.zipWithIndex().filter(lambda x: shard * per_shard + x[1] >= first).map(one)


def materialise(docs: DataFrame, path: str, out: str | None = None, key: int = KEY,
                length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Write the shards under ``out`` (default: a fresh folder in the shared
    folder) and return one row per sequence: slot, shard, offset, n_tokens,
    crc (of the record's ids) and doc_ids."""
    spark = docs.sparkSession
    dictionary = trained(docs, path, length)
    seqs = saved(sequences(docs, path, length, dictionary), "sequences")
    slots, n = slotted(seqs, key, per_shard, length)
    if n:
        write_shards(slots, n, out or scratch_path(spark, "shards"), dictionary, per_shard)
    return slots.select("slot", "shard", "offset", "n_tokens", "crc", "doc_ids")
