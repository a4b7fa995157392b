"""Byte-level BPE encoding by corpus-level merge replay, and decoding.

``Merges.replay`` encodes a set of distinct pre-tokens at once. An inverted index
holds the positions of all adjacent token pairs whose bytes make a token, by the
rank of that token. Ranks are taken in rising order; a merge touches only its two
neighbours, whose new pairs enter the index. A merge can make a pair of a lower
rank than the one at work (the same bytes, cut differently); that is then next in its
pre-token, so the result is that of merging the lowest rank of each pre-token
first, leftmost first.

1. The distinct pre-tokens of the corpus are counted (one aggregation).
2. The most frequent ones, at most ``HEAD`` (so a proven bound), are replayed once
   for the whole corpus and their ids are broadcast.
3. Tasks read texts in slices. The distinct pre-tokens of a slice that are not
   among these, few and each found in few texts, are replayed together in the same
   way. Neither texts nor ids are shuffled.

A pre-token that is itself a token is not merged but taken as it is.

Null texts count as empty: no ids, and decoding gives no bytes. Texts and
pre-tokens of any length are taken whole. Repeated rows and null ids are treated
row by row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, saved, shipped, sliced
from .tokencount import most_frequent

HEAD = 300_000              # pre-tokens whose ids are broadcast
_HELD = 300_000             # distinct pre-tokens that a task counts before it hands them on
_RARE = 200_000             # other pre-tokens that a worker remembers, each of at most
_RARE_LENGTH = 64           # so many characters
_SHIFT = 20                 # bits of a token number in a pair
_LONG = 200                 # bytes from which a pre-token is merged by lists, not in sweeps
_WINDOWS = 8                # windows of ranks
STOP = (1 << _SHIFT) - 1    # stands between words, in no pair
NONE = 1 << _SHIFT
_CLASS = re.compile(r"\\p\{\w+\}|\\[sS]|\\.|.", re.S)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines 'base64 rank'."""
    import base64
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    tokens = [ranks[i] for i in range(len(ranks))]
    if len(set(tokens)) != len(tokens) or len(tokens) >= STOP or {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError("not a byte-level rank file: ranks must be dense and cover all bytes")
    return tokens


def distinct(parts: list):
    """The sorted distinct values of some integer arrays."""
    import numpy as np
    x = np.sort(np.concatenate(parts), kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Merges:
    """The merges of a vocabulary: token pair -> rank, for every way to cut a token in two tokens."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        get = self.ids.get
        self.pairs = {(a << _SHIFT) | b: i for i, t in enumerate(tokens) for k in range(1, len(t))
                      if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None}
        self.keys = np.fromiter(self.pairs, dtype=np.int64, count=len(self.pairs))
        self.ranks = np.fromiter(self.pairs.values(), dtype=np.int64, count=len(self.pairs))
        order = np.argsort(self.keys)
        self.keys, self.ranks = self.keys[order], self.ranks[order]

    def rank(self, left, right):
        """Rank of each token pair, ``NONE`` where the vocabulary has none."""
        import numpy as np
        pair = (left << _SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        import numpy as np
        whole = [self.ids.get(w) for w in words]
        open_words = [w for w, i in zip(words, whole) if i is None]
        if not open_words:
            return [[i] for i in whole]
        if not len(self.keys):
            done = iter([self.byte[list(w)].tolist() for w in open_words])
            return [[i] if i is not None else next(done) for i in whole]
        # all words in one row of positions, a stop after each and one in front
        size = np.fromiter(map(len, open_words), dtype=np.int64, count=len(open_words))
        begin = np.cumsum(size + 1) - size
        raw = np.frombuffer(b"\0" + b"\0".join(open_words) + b"\0", dtype=np.uint8)
        token = self.byte[raw]
        token[begin[0] - 1], token[begin + size] = STOP, STOP
        owner = np.zeros(len(raw), dtype=np.int64)
        owner[begin] = 1
        owner = np.cumsum(owner)
        rank = np.append(self.rank(token[:-1], token[1:]), NONE)
        long = np.append(False, size > _LONG)[owner]
        pairs = rank < NONE
        self._sweep(token, rank, owner, np.flatnonzero(pairs & ~long))
        if long.any():
            self._merge_long(token, rank, owner, np.flatnonzero(pairs & long))
        kept = token >= 0
        kept[begin[0] - 1], kept[begin + size] = False, False
        ends = np.cumsum(np.add.reduceat(kept, begin)).tolist()
        flat = token[kept].tolist()
        done = iter([flat[a:b] for a, b in zip([0, *ends], ends)])
        return [[i] if i is not None else next(done) for i in whole]

    def _sweep(self, token, rank, owner, index) -> None:
        """Replay the merges of ``index`` (positions of pairs) for short words, many words
        at a time. Ranks are taken in windows, lowest first; inside a window each sweep
        merges the leftmost pair of lowest rank of every word that has one. Words do
        not meet, so the order that counts, that inside each word, is that of the ranks."""
        import numpy as np
        after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
        edges = np.unique(np.quantile(rank[index], np.arange(1, _WINDOWS) / _WINDOWS).astype(np.int64)) if len(index) else []
        later = [index]
        for most in [*edges, NONE - 1]:
            index = distinct(later)
            now = rank[index] <= most
            later, index = [index[~now & (rank[index] < NONE)]], index[now]
            while len(index):
                r, w = rank[index], owner[index]
                first = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
                lowest = np.flatnonzero(r == np.repeat(np.minimum.reduceat(r, first), np.diff(np.append(first, len(w)))))
                at = index[lowest[np.append(True, w[lowest][1:] != w[lowest][:-1])]]
                gone = after[at]
                nxt, prev = after[gone], before[at]
                token[at], token[gone] = rank[at], -1
                rank[gone] = NONE
                after[at], before[nxt] = nxt, at
                rank[at], rank[prev] = self.rank(token[at], token[nxt]), self.rank(token[prev], token[at])
                touched = np.concatenate([at, prev])
                here = rank[touched]
                later.append(touched[(here > most) & (here < NONE)])
                index = distinct([index, touched])
                index = index[rank[index] <= most]

    def _merge_long(self, token, rank, owner, index) -> None:
        """The same for long words, with a list of positions per rank."""
        import numpy as np
        order = index[np.argsort(rank[index], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[order])) + 1
        lists = {int(rank[p[0]]): p.tolist() for p in np.split(order, cuts)} if len(order) else {}
        plain = token.tolist()
        self._merge(plain, lists, owner.tolist())
        token[:] = plain

    def _merge(self, token: list[int], index: dict[int, list[int]], owner: list[int]) -> None:
        """Replay all merges of the index on ``token``; merged-away positions become -1."""
        rank_of = self.pairs.get
        after = list(range(1, len(token) + 1))
        before = list(range(-1, len(token) - 1))
        todo = list(index)
        heapq.heapify(todo)
        while todo:
            rank = heapq.heappop(todo)
            positions = index.pop(rank)
            positions.sort()
            waits, later = -1, []
            for p in positions:
                if owner[p] == waits:
                    later.append(p)
                    continue
                left = token[p]
                q = after[p]
                if left < 0 or rank_of((left << _SHIFT) | token[q]) != rank:
                    continue                        # a neighbour has changed since
                token[p], token[q] = rank, -1
                after[p] = nxt = after[q]
                before[nxt] = p
                prev = before[p]
                for at, new in ((prev, rank_of((token[prev] << _SHIFT) | rank)), (p, rank_of((rank << _SHIFT) | token[nxt]))):
                    if new is None:
                        continue
                    if new in index:
                        index[new].append(at)
                    else:
                        index[new] = [at]
                        heapq.heappush(todo, new)
                    if new < rank:
                        waits = owner[p]
            if later:
                if rank in index:
                    index[rank].extend(later)
                else:
                    index[rank] = later
                    heapq.heappush(todo, rank)


def latin_pattern(pattern: str) -> str | None:
    """``pattern`` for texts of code points below 256, its classes written out, which
    the standard library matches faster; None if it has other escapes."""
    import regex
    out, inside = [], False
    for part in _CLASS.findall(pattern):
        if part[0] == "\\" and len(part) > 1:
            if part[1] not in "psS" or inside and part == "\\S":
                return None
            chars = "".join(re.escape(chr(c)) for c in range(256) if regex.match(part, chr(c)))
            part = chars if inside else f"[{chars}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


def splitter(pattern: str):
    """text -> its matches of ``pattern``."""
    import regex
    find = regex.compile(pattern).findall
    narrow = latin_pattern(pattern)
    if narrow is None:
        return find
    find_narrow = re.compile(narrow).findall

    def split(text: str) -> list[str]:
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return find(text)
        return find_narrow(text)
    return split


def vocabulary(docs: DataFrame, pattern: str) -> DataFrame:
    """token, freq: one row per distinct pre-token of the corpus."""
    def distinct(batches):
        import pyarrow as pa
        split = splitter(pattern)
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                              names=["token", "freq"])
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(split(t))
                if len(seen) >= _HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return saved(docs.select(F.col("text").cast("string").alias("text"))
                 .mapInArrow(sliced(distinct), "token string, freq long")
                 .groupBy("token").agg(F.sum("freq").alias("freq")), "bpe-vocabulary")


_MERGES: dict = {}


def shared_tokens(spark: SparkSession, tokens: list[bytes]):
    """The vocabulary for all tasks, with a name by which a worker knows it."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, tokens))


def merges_of(shared) -> Merges:
    """The merges of a shared vocabulary, built once per worker; one is kept."""
    name, tokens = shared.value
    if name not in _MERGES:
        _MERGES.clear()
        _MERGES[name] = Merges(tokens)
    return _MERGES[name]


def replayed(vocab: DataFrame, tokens) -> DataFrame:
    """token, ids of the rows of ``vocab``."""
    def run(batches):
        import pyarrow as pa
        merges = merges_of(tokens)
        for b in batches:
            ids = merges.replay([t.encode() for t in b.column("token").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("token"), pa.array(ids, pa.list_(pa.int32()))], names=["token", "ids"])
    return vocab.select("token").mapInArrow(run, "token string, ids array<int>")


class Encoder:
    """Ids of texts, a slice of texts at a time."""

    def __init__(self, merges: Merges, head: dict[str, bytes], pattern: str):
        self.merges, self.head, self.split = merges, head, splitter(pattern)
        self.rare: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as 32-bit integers."""
        import numpy as np
        found = [self.split(t) for t in texts]
        if len(self.rare) > _RARE:
            self.rare.clear()
        new = list(set().union(*found) - self.head.keys() - self.rare.keys())
        ids = self.merges.replay([token.encode() for token in new])
        here = {token: np.array(i, dtype=np.int32).tobytes() for token, i in zip(new, ids)}
        self.rare.update(here)
        head, rare = self.head.get, self.rare.__getitem__
        out = [b"".join([head(token) or rare(token) for token in tokens]) for tokens in found]
        for token in new:
            if len(token) > _RARE_LENGTH:
                del self.rare[token]
        return out


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, head: int = HEAD) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``docs``."""
    import numpy as np
    spark = docs.sparkSession
    shipped(spark)
    shared = shared_tokens(spark, tokens)
    top = replayed(most_frequent(vocabulary(docs, pattern), head), shared).toArrow()
    known = spark.sparkContext.broadcast(
        {t: np.array(i, dtype=np.int32).tobytes() for t, i in zip(top["token"].to_pylist(), top["ids"].to_pylist())})

    def run(batches):
        import numpy as np
        import pyarrow as pa
        encoder = Encoder(merges_of(shared), known.value, pattern)
        for b in batches:
            out = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.cumsum([0] + [len(i) // 4 for i in out])
            flat = np.frombuffer(b"".join(out), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(sliced(run), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """``encoded`` (doc_id, ids) with the bytes that the ids stand for."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(tokens)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        tokens = shared.value
        size = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        for b in batches:
            col = b.column("ids")
            flat = col.flatten().to_numpy(zero_copy_only=False)
            many = np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            raw = b"".join(map(tokens.__getitem__, flat.tolist()))
            place = np.append(0, np.cumsum(size[flat]))[np.append(0, np.cumsum(many))]
            out = pa.Array.from_buffers(pa.large_binary(), b.num_rows,
                                        [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), col, out.cast(pa.binary())], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(sliced(run), "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the ids and of the decoded bytes."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
