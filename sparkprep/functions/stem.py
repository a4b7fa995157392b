"""Porter suffix stripping of tokens (SC14).

Two modes: ``"extended"`` (default) adds the later refinements that the
widely used NLTK implementation applies by default -- a few irregular forms,
``ies``/``ied`` on four-letter words, ``y -> i`` only after a consonant that
is not the first letter, the ``bli``/``logi``/``fulli`` rules, ``alli`` taken
off before the other second-step rules and two-letter consonant-vowel-consonant ends; ``"original"`` is the published
1980 algorithm. Only tokens longer than three characters are stemmed, as
unigram-overlap scorers do.

``porter_stem`` is the plain function, ``stem_column`` the same as a column
expression.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import let

_VOWELS = set("aeiou")


def _cons(w: str, i: int) -> bool:
    ch = w[i]
    if ch in _VOWELS:
        return False
    if ch == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _m(stem: str) -> int:
    """Number of VC sequences in the stem."""
    n, i, L = 0, 0, len(stem)
    while i < L and _cons(stem, i):
        i += 1
    while i < L:
        while i < L and not _cons(stem, i):
            i += 1
        if i >= L:
            break
        n += 1
        while i < L and _cons(stem, i):
            i += 1
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str, extended: bool = False) -> bool:
    if extended and len(w) == 2:
        return not _cons(w, 0) and _cons(w, 1)
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _replace(w: str, rules, cond) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if cond(stem) else w
    return w


# The suffix tables of the published algorithm, in its order.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
          ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
          ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP2_EXTENDED = [(("bli", "ble") if suf == "abli" else (suf, rep)) for suf, rep in _STEP2] + [("fulli", "ful")]
# Irregular forms mapped directly in the extended mode.
_IRREGULAR = {"skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie",
              "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
              "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
              "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(word: str, mode: str = "extended") -> str:
    ext = mode == "extended"
    if ext and word in _IRREGULAR:
        return _IRREGULAR[word]
    w = word
    if len(w) <= 2:
        return w
    # step 1a
    if ext and w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    flag = False
    if ext and w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, flag = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, flag = w[:-3], True
    if flag:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _m(w) == 1 and _cvc(w, ext):
            w += "e"
    # step 1c
    if w.endswith("y"):
        stem = w[:-1]
        if (len(stem) > 1 and _cons(stem, len(stem) - 1)) if ext else _has_vowel(stem):
            w = stem + "i"
    # step 2; the extended mode takes "alli" off first and goes on with what is left
    if ext and w.endswith("alli") and _m(w[:-4]) > 0:
        w = w[:-2]
    if ext and w.endswith("logi"):
        if _m(w[:-3]) > 0:
            w = w[:-1]
    else:
        w = _replace(w, _STEP2_EXTENDED if ext else _STEP2, lambda s: _m(s) > 0)
    # step 3
    w = _replace(w, _STEP3, lambda s: _m(s) > 0)
    # step 4
    for suf in _STEP4:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _m(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        if _m(stem) > 1 or (_m(stem) == 1 and not _cvc(stem, ext)):
            w = stem
    # step 5b
    if _m(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def stem_token(tok: str) -> str:
    return porter_stem(tok) if len(tok) > 3 else tok

# ---------------------------------------------------------------------------
# The same stems as column expressions (no Python in the plan)
# ---------------------------------------------------------------------------
# Words carry a mark: a y that counts as a consonant is written Y. Then vowels
# are [aeiouy], all other characters consonants, and the measure is a pattern.
_ABOVE_0 = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_ABOVE_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]"
_IS_1 = "^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]*$"
_VOWEL = "[aeiouy]"
_DOUBLE = r"([^aeiouy])\1$|yY$"
_CVC = "[^aeiouy][aeiouy][^aeiouywxY]$"
_VC = "^[aeiouy][^aeiouy]$"


def _alternatives(suffixes) -> str:
    """Any of the suffixes; anchored at the end, the longest one matches."""
    return "(" + "|".join(suffixes) + ")$"


def _may_end(w: Column, suffixes) -> Column:
    """A cheap test that leaves out most words that end in none of the suffixes."""
    return F.right(w, F.lit(2)).isin(sorted({s[-2:] for s in suffixes}))


def _less(w: Column, n: int) -> Column:
    return F.left(w, F.length(w) - n)


def _suffix_step(w: Column, rules: list[tuple[str, str]]) -> Column:
    """The suffix that ends the word replaced, if what stands before has a measure above 0."""
    found = F.regexp_extract(w, _alternatives([s for s, _ in rules]), 1)

    def replace(x):
        stem = F.left(w, F.length(w) - F.length(x))
        new = F.element_at(F.create_map(*[F.lit(v) for rule in rules for v in rule]), x)
        return F.when((x != "") & stem.rlike(_ABOVE_0), F.concat(stem, new)).otherwise(w)
    return F.when(_may_end(w, [s for s, _ in rules]), let(found, replace)).otherwise(w)


def _step_1(w: Column, ext: bool) -> Column:
    plural = F.when(w.endswith("s"), F.regexp_replace(w, "(ss|i)es$|([^s])s$", "$1$2")).otherwise(w)
    if ext:
        plural = F.when(w.endswith("ies") & (F.length(w) == 4), F.left(w, F.lit(3))).otherwise(plural)

    def past(w):
        def mend(stem):
            cvc = stem.rlike(f"{_CVC}|{_VC}" if ext else _CVC)
            return (F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e")))
                    .when(stem.rlike(_DOUBLE) & ~stem.rlike("[lsz]$"), _less(stem, 1))
                    .when(stem.rlike(_IS_1) & cvc, F.concat(stem, F.lit("e"))).otherwise(stem))
        eed = F.when(_less(w, 3).rlike(_ABOVE_0), _less(w, 1)).otherwise(w)
        out = F.when(w.endswith("eed"), eed)
        if ext:
            out = (F.when(w.endswith("ied"), F.when(F.length(w) == 4, _less(w, 1)).otherwise(_less(w, 2)))
                   .when(w.endswith("eed"), eed))
        return (out.when(w.endswith("ed") & _less(w, 2).rlike(_VOWEL), let(_less(w, 2), mend))
                .when(w.endswith("ing") & _less(w, 3).rlike(_VOWEL), let(_less(w, 3), mend)).otherwise(w))

    def final_y(w):
        turns = ((w.endswith("y") | w.endswith("Y"))
                 & (w.rlike("^.+[^aeiouy].$") if ext else _less(w, 1).rlike(_VOWEL)))
        return F.when(turns, F.concat(_less(w, 1), F.lit("i"))).otherwise(w)
    return let(let(plural, past), final_y)


def _step_2(w: Column, ext: bool) -> Column:
    if not ext:
        return _suffix_step(w, _STEP2)
    alli = F.when(w.endswith("alli") & _less(w, 4).rlike(_ABOVE_0), _less(w, 2)).otherwise(w)
    logi = lambda w: F.when(_less(w, 3).rlike(_ABOVE_0), _less(w, 1)).otherwise(w)
    return let(alli, lambda w: F.when(w.endswith("logi"), logi(w)).otherwise(_suffix_step(w, _STEP2_EXTENDED)))


def _step_4(w: Column) -> Column:
    def cut(x):
        stem = F.left(w, F.length(w) - F.length(x))
        may = (x != "") & stem.rlike(_ABOVE_1) & ((x != "ion") | stem.rlike("[st]$"))
        return F.when(may, stem).otherwise(w)
    found = F.regexp_extract(w, _alternatives(_STEP4), 1)
    return F.when(_may_end(w, _STEP4), let(found, cut)).otherwise(w)


def _step_5(w: Column, ext: bool) -> Column:
    def final_e(w):
        stem = _less(w, 1)
        goes = stem.rlike(_ABOVE_1) | (stem.rlike(_IS_1) & ~stem.rlike(f"{_CVC}|{_VC}" if ext else _CVC))
        return F.when(w.endswith("e") & goes, stem).otherwise(w)
    return let(final_e(w), lambda w: F.when(w.endswith("ll") & w.rlike(_ABOVE_1), _less(w, 1)).otherwise(w))


def stem_column(w: Column, mode: str = "extended") -> Column:
    """Stem of a lower-case token; tokens of up to three characters stay."""
    ext = mode == "extended"
    marked = F.when(w.contains("y"), F.regexp_replace(F.regexp_replace(w, "(^|[aeiou])y", "$1Y"), "yy", "yY")).otherwise(w)
    out = let(marked, lambda w: _step_1(w, ext))
    for step in (lambda w: _step_2(w, ext), lambda w: _suffix_step(w, _STEP3), _step_4, lambda w: _step_5(w, ext)):
        out = let(out, step)
    out = F.translate(out, "Y", "y")
    if ext:
        irregular = F.create_map(*[F.lit(v) for rule in _IRREGULAR.items() for v in rule])
        out = F.coalesce(F.try_element_at(irregular, w), out)
    return F.when(F.length(w) > 3, out).otherwise(w)
