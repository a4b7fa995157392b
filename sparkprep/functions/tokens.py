"""Token-level column functions: the default token counter (UD2), word tokens
for unigram overlap (SC13), and the pluggable tokenizer hook."""

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS29

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# A default token is a maximal run of characters that are not whitespace in
# the str.isspace() sense. TOKEN_PATTERN states that as a regex (used by the
# SQL oracles); the Spark side maps every whitespace character to a space with
# translate() and splits on the space, which gives the same tokens about ten
# times faster than the negated-class regex.
_WS_CLASS = "".join(f"\\x{{{ord(c):04x}}}" for c in WS29)
TOKEN_PATTERN = f"[^{_WS_CLASS}]+"
_SPACES = " " * len(WS29)

# Unigram-overlap tokens: lower-case, every run of characters outside a-z0-9
# is a separator.
OVERLAP_SEPARATOR = "[^a-z0-9]+"

# Contractions split by the word tokenizer before overlap scoring. Only splits
# that cut an alphanumeric run change the overlap tokens: "n't" endings and
# the fixed pairs below (cannot, gimme, gonna, gotta, lemme, wanna, 'tis, 'twas).
CONTRACTION_RULES = [
    (r"(?i)([a-z])(n't)\b", "$1 $2"),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gim)(me)\b", "$1 $2"),
    (r"(?i)\b(gon)(na)\b", "$1 $2"),
    (r"(?i)\b(got)(ta)\b", "$1 $2"),
    (r"(?i)\b(lem)(me)\b", "$1 $2"),
    (r"(?i)\b(wan)(na)(?=\s)", "$1 $2"),
    (r"(?i)(^|\s)('t)(is|was)\b", "$1$2 $3"),
]
# A literal (lower-case) substring every match of the rule above contains.
CONTRACTION_KEYS = ["n't", "cannot", "gimme", "gonna", "gotta", "lemme", "wanna", "'t"]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced(c) -> Column:
    """Every whitespace character replaced by a plain space."""
    return F.translate(_c(c), WS29, _SPACES)


def word_tokens(c) -> Column:
    """Whitespace-delimited tokens as an array (default tokenizer)."""
    return F.array_remove(F.split(spaced(c), " "), "")


def token_count(c) -> Column:
    """UD2 default: number of whitespace-delimited tokens (null for null)."""
    return F.when(_c(c).isNotNull(), F.size(word_tokens(c)))


def _edge_is_token(c, first: bool) -> Column:
    ch = F.substring(_c(c), 1, 1) if first else F.substring(_c(c), -1, 1)
    return (F.length(ch) > 0) & (F.length(F.translate(ch, WS29, "")) > 0)


def concat_token_count(a, b, count_a: Column | None = None, count_b: Column | None = None) -> Column:
    """Token count of concat(a, b) from the two counts: the last token of
    ``a`` and the first of ``b`` fuse when no whitespace separates them."""
    ca = token_count(a) if count_a is None else count_a
    cb = token_count(b) if count_b is None else count_b
    fuse = (_edge_is_token(a, False) & _edge_is_token(b, True)).cast("int")
    return ca + cb - fuse


# ---------------------------------------------------------------------------
# Tokens with their place in the text: counts, ids, and cuts that keep the text
# ---------------------------------------------------------------------------
def let(value, body):
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Words:
    """The default rule (white-space words), JVM side. Cuts keep the text's own
    characters: white space maps to single spaces one for one, so a joined run
    of parts is as long as the text it stands for."""

    array = staticmethod(word_tokens)
    count = staticmethod(token_count)

    @staticmethod
    def _cut(c, n: int, take) -> Column:
        text = _c(c)

        def of(parts):
            # places (from 0) of the parts that are words
            at = F.filter(F.transform(parts, lambda x, i: F.when(x != "", i)), lambda i: i.isNotNull())
            return F.when(F.size(at) > n, take(text, parts, at)).otherwise(text)
        return let(F.split(spaced(text), " "), of)

    def last(self, c, n: int) -> Column:
        """From the start of the n-th last word to the end of the text; the
        whole text if it has no more words."""
        if n <= 0:
            return F.when(token_count(c) > 0, F.lit("")).otherwise(_c(c))
        return self._cut(c, n, lambda text, parts, at: F.right(text, F.length(F.array_join(
            F.slice(parts, F.element_at(at, -n) + 1, F.size(parts)), " "))))

    def first(self, c, n: int) -> Column:
        """From the start of the text to the end of its n-th word."""
        if n <= 0:
            return F.when(token_count(c) > 0, F.lit("")).otherwise(_c(c))
        return self._cut(c, n, lambda text, parts, at: F.left(text, F.length(F.array_join(
            F.slice(parts, 1, F.element_at(at, n) + 1), " "))))


WORDS = Words()

# text batch -> per text (ids, starts, ends): 0-based code points, end exclusive
SpanBatch = Callable[[list], list]
SPANS = "array<struct<id:int,start:int,end:int>>"
EDGE = "struct<n:int,at:int>"           # tokens of a text, and the offset of a cut (null: none)
SLICE_CHARS = 1 << 20                   # text that a tokenizer is given at a time


class TokenHook:
    """A tokenizer as column functions. ``make()`` is called once per Python
    worker and gives a function from a list of texts to one (ids, starts, ends)
    per text; it is given few texts at a time (``text_slices``), nulls left out.

    ``array`` gives ids, ``spans`` ids with their offsets, ``count`` their number.
    ``last`` and ``first`` keep n tokens and cut the text itself at an offset; a
    token that holds part of a character keeps the whole character. Counts and cuts
    hand back one or two numbers per text, never its tokens.
    """

    def __init__(self, make: Callable[[], SpanBatch]):
        import uuid
        import pyarrow as pa
        from pyspark.sql import SparkSession
        from ..session import few_rows, ship_package
        active = SparkSession.getActiveSession()
        if active is not None:
            ship_package(active)
            few_rows(active)
        name = uuid.uuid4().hex

        @F.arrow_udf(SPANS)
        def spans(texts: pa.Array) -> pa.Array:
            from sparkprep.functions.tokens import spans_array
            return spans_array(name, make, texts)

        @F.arrow_udf("array<int>")
        def ids(texts: pa.Array) -> pa.Array:
            from sparkprep.functions.tokens import spans_array
            return spans_array(name, make, texts, ids_only=True)

        @F.arrow_udf("int")
        def number(texts: pa.Array) -> pa.Array:
            from sparkprep.functions.tokens import counts_array
            return counts_array(name, make, texts)

        def edge(n: int, first: bool):
            @F.arrow_udf(EDGE)
            def edges(texts: pa.Array) -> pa.Array:
                from sparkprep.functions.tokens import edges_array
                return edges_array(name, make, texts, n, first)
            return edges

        self._spans, self._ids, self._number, self._edge = spans, ids, number, edge

    def spans(self, c) -> Column:
        return self._spans(_c(c))

    def array(self, c) -> Column:
        return self._ids(_c(c))

    def count(self, c) -> Column:
        return self._number(_c(c))

    def last(self, c, n: int) -> Column:
        text, edge = _c(c), self._edge(n, False)(_c(c))
        kept = F.lit("") if n <= 0 else F.right(text, F.length(text) - edge["at"])
        return F.when(edge["n"] > max(n, 0), kept).otherwise(text)

    def first(self, c, n: int) -> Column:
        text, edge = _c(c), self._edge(n, True)(_c(c))
        kept = F.lit("") if n <= 0 else F.left(text, edge["at"])
        return F.when(edge["n"] > max(n, 0), kept).otherwise(text)


_MADE: dict = {}
_MADE_MOST = 2              # tokenizers that a worker keeps


def made_once(name: str, make):
    """The worker's tokenizer of this name; the one used longest ago makes way."""
    if name not in _MADE:
        while len(_MADE) >= _MADE_MOST:
            _MADE.pop(next(iter(_MADE)))
        _MADE[name] = make()
    _MADE[name] = _MADE.pop(name)
    return _MADE[name]


def text_slices(values: list):
    """Runs of consecutive texts of bounded length together (a longer text alone),
    so that the tokens of few texts exist at a time."""
    held, chars = [], 0
    for t in values:
        if held and (chars + len(t or "") > SLICE_CHARS or len(held) >= 1000):
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t or "")
    if held:
        yield held


def tokenized(name: str, make, values: list):
    """Per slice of the texts what the worker's tokenizer gives for each of them
    (None for null)."""
    for part in text_slices(values):
        known = [t for t in part if t is not None]
        got = iter(made_once(name, make)(known) if known else [])
        yield [None if t is None else next(got) for t in part]


def spans_array(name: str, make, texts, ids_only: bool = False):
    """One Arrow batch through the worker's tokenizer: ids with their offsets."""
    import numpy as np
    import pyarrow as pa
    values = texts.to_pylist()
    sizes, chunks = [0], [[] for _ in range(1 if ids_only else 3)]
    for part in tokenized(name, make, values):
        sizes.extend(len(x[0]) if x is not None else 0 for x in part)
        for k, out in enumerate(chunks):
            out.extend(np.asarray(x[k], dtype=np.int32) for x in part if x is not None and len(x[k]))

    flat = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=np.int32)) for c in chunks]
    inner = flat[0] if ids_only else pa.StructArray.from_arrays(flat, names=["id", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), inner,
                                    mask=pa.array([t is None for t in values], pa.bool_()))


def counts_array(name: str, make, texts):
    """The number of tokens of each text (null for null)."""
    import pyarrow as pa
    return pa.array([None if x is None else len(x[0]) for part in tokenized(name, make, texts.to_pylist()) for x in part],
                    pa.int32())


def edges_array(name: str, make, texts, n: int, first: bool):
    """The number of tokens of each text, and where the n-th of them ends (``first``)
    or the n-th last begins."""
    import pyarrow as pa
    count, at = [], []
    for part in tokenized(name, make, texts.to_pylist()):
        for x in part:
            count.append(None if x is None else len(x[0]))
            cut = n > 0 and x is not None and len(x[0]) > n
            at.append(int(x[2][n - 1] if first else x[1][-n]) if cut else None)
    return pa.StructArray.from_arrays([pa.array(count, pa.int32()), pa.array(at, pa.int32())], names=["n", "at"])


def utf8_tokens(offset: int = 3) -> TokenHook:
    """Byte tokenizer: the id of a byte of the text is its value plus ``offset``
    (the ids below it are a vocabulary's special tokens)."""
    def make():
        import numpy as np

        def batch(texts):
            out = []
            for t in texts:
                raw = np.frombuffer(t.encode(), dtype=np.uint8)
                char = np.cumsum((raw & 0xC0) != 0x80) - 1      # a character begins at each byte but 10xxxxxx
                out.append((raw.astype(np.int32) + offset, char, char + 1))
            return out
        return batch
    return TokenHook(make)


def _shipped_file(path: str):
    """``path`` for executors: sent with ``addFile``, no shared folder needed."""
    import os
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is not None:
        active.sparkContext.addFile(path)
    name = os.path.basename(path)

    def here():
        from pyspark import SparkFiles
        sent = SparkFiles.get(name)
        return sent if os.path.exists(sent) else path
    return here


def tokenizer_file(path: str, add_special_tokens: bool = False) -> TokenHook:
    """A tokenizer JSON file (the ``tokenizers`` format); special tokens have the
    empty span that the library gives them."""
    here = _shipped_file(path)

    def make():
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(here())

        def batch(texts):
            return [(e.ids, [s for s, _ in e.offsets], [t for _, t in e.offsets])
                    for e in tok.encode_batch(texts, add_special_tokens=add_special_tokens)]
        return batch
    return TokenHook(make)


def piece_model_file(path: str) -> TokenHook:
    """A sentencepiece model file."""
    here = _shipped_file(path)

    def make():
        import numpy as np
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=here())

        def batch(texts):
            out = []
            for text, found in zip(texts, sp.encode(texts, return_type="proto", num_threads=1)):
                pieces = list(found.pieces)
                begin, end = [p.begin for p in pieces], [p.end for p in pieces]     # in bytes
                if not text.isascii():
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    char = np.cumsum((raw & 0xC0) != 0x80) - 1
                    last = char[-1] + 1
                    begin, end = ([int(char[b]) if b < len(raw) else last for b in begin],
                                  [int(char[e - 1]) + 1 if e > b else int(char[b]) if b < len(raw) else last
                                   for b, e in zip(begin, end)])
                out.append(([p.id for p in pieces], begin, end))
            return out
        return batch
    return TokenHook(make)


TokenCounter = Callable[[Column], Column]


def pandas_token_counter(make_tokenizer: Callable[[], Callable[[str], list]]) -> TokenCounter:
    """A tokenizer of one text at a time (text -> ids) as a token counter; one
    that takes batches is better given to ``TokenHook``."""
    def make():
        one = make_tokenizer()

        def batch(texts):
            ids = [[0] * len(one(t)) for t in texts]
            return [(i, i, i) for i in ids]
        return batch
    return TokenHook(make).count


def overlap_tokens(c, split_contractions: bool = True) -> Column:
    """SC13: tokens for unigram overlap: strip, strip quotes, split the
    contractions the word tokenizer splits, lower-case, keep runs of a-z0-9."""
    from .text import strip_quotes
    t = strip_quotes(c)
    if split_contractions:
        # A rule can only match where its key occurs, and the rules only
        # insert spaces, so the regex chain runs only on texts whose
        # lower-cased original holds some key: same result, no regex pass
        # on most texts. (One guard, not one per rule: nesting a guard per
        # rule would double the expression at every step.)
        low = F.lower(t)
        any_key = low.contains(CONTRACTION_KEYS[0])
        for key in CONTRACTION_KEYS[1:]:
            any_key = any_key | low.contains(key)
        chained = t
        for pat, rep in CONTRACTION_RULES:
            chained = F.regexp_replace(chained, F.lit(pat), F.lit(rep))
        t = F.when(any_key, chained).otherwise(t)
    t = F.regexp_replace(F.lower(t), F.lit(OVERLAP_SEPARATOR), F.lit(" "))
    # array_remove, not filter(): higher-order functions are evaluated
    # without code generation, and would pull this whole expression with them
    return F.array_remove(F.split(t, " "), "")


def tokenizer_file_counter(path: str, add_special_tokens: bool = False) -> TokenCounter:
    """UD2 with a real tokenizer: a ``Column -> Column`` token counter for
    ``length_profile`` / ``pair_length_profile`` from a tokenizer JSON file."""
    return tokenizer_file(path, add_special_tokens).count
