"""Short and nameless benchmark items, copies without ids, and the stages of the
pipeline, each against brute force; texts of several megabytes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, mixing, neardup, quality, repeats, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    items = [(1, prose(rnd, 30)), (2, prose(rnd, 10)), (3, prose(rnd, 7)), (None, prose(rnd, 9)), (4, prose(rnd, 4)),
             (5, "single"), (6, ""), (7, None), (2, prose(rnd, 40)), (8, prose(rnd, 11)), (9, prose(rnd, 5))]
    docs = [(i, prose(rnd, 300)) for i in range(20)]
    for k, (_, t) in enumerate(items):
        docs.append((100 + k, f"{prose(rnd, 50)} {(t or '').upper() if t and 'w' in t else t or ''} {prose(rnd, 50)}"))
        docs.append((200 + k, t))
    # all but the last word of a short item, and a short item with one word changed
    short = items[1][1].split()
    docs += [(300, f"{prose(rnd, 20)} {' '.join(short[:-1])} {prose(rnd, 20)}"),
             (301, f"{prose(rnd, 20)} {' '.join([*short[:4], 'other', *short[5:]])} {prose(rnd, 20)}"),
             (302, f"a {items[4][1]} b"), (303, "the single word"), (None, f"no id {items[2][1]}")]
    return docs, items


def test_items_of_any_length_are_found_whole(spark, texts):
    docs, items = texts
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("name", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    want = set()
    for doc, text in docs:
        w = (text or "").lower().split()
        for item, t in items:
            q = (t or "").lower().split()
            if not q:
                continue
            if len(q) >= decontaminate.LEAST:
                hit = any(w[i:i + len(q)] == q for i in range(len(w) - len(q) + 1))
            else:
                hit = w == q
            if hit:
                want.add((doc, item))
    assert got == want
    assert {(204, 4), (205, 5)} <= got and (303, 5) not in got and (302, 4) not in got


def test_clean_keeps_all_other_documents(spark, texts):
    docs, items = texts
    d = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(range(20)) | {300, 301, 302, 303} <= kept and not kept & {100, 101, 102, 103, 200, 201, 202, 203, 204}


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    rnd = random.Random(3)
    a, b, c = prose(rnd, 200), prose(rnd, 200), prose(rnd, 200)
    near = " ".join([*a.split()[:190], *prose(rnd, 10).split()])
    rows = [(7, a)] * 3 + [(None, a)] * 4 + [(8, near), (None, b), (None, b), (9, c), (9, prose(rnd, 200)), (10, None), (10, ""), (11, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).withColumn("_row", F.lit("clash"))
    got = neardup.one_of_each(df, 80)
    assert got.columns == df.columns
    kept = Counter(r.text for r in got.collect())
    assert sum(kept[t] for t in (a, near)) == 1 and kept[b] == 1 and kept[c] == 1
    assert kept[None] == 1 and kept[""] == 2        # texts without words are linked with nothing


def test_labels_join_without_narrowing_the_features(spark):
    rows = [(i, f"text {i} " + ("you idiot" if i % 3 == 0 else "fine weather"), "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and held
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in held)


def base_by_hand(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    import re
    t = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {i + j for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for j in range(5)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_base_columns_match_brute_force(spark):
    rnd = random.Random(4)
    made = [" ".join(rnd.choice(["a", "b", "c#", "été", "x\x1cy", " ", "|"]) for _ in range(rnd.randrange(80)))
            .replace("c# b", rnd.choice(["\n", "\n\n", "\r\n", "\x0b"])) for _ in range(200)]
    made += [None, "", " \n ", "same\nsame\nother\nsame", "one two three four five " * 3, "word " * 400_000, "#" * 100]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(made)], SCHEMA)
    for r in quality.judge(docs).collect():
        want = base_by_hand(made[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_texts_of_megabytes(spark):
    """Whole texts: near copies, repeated passages and benchmark items far into long texts."""
    rnd = random.Random(6)
    long = prose(rnd, 400_000)                                     # over 2 MB
    item, passage = prose(rnd, 30), prose(rnd, 120)
    rows = [(1, long), (2, " ".join([*long.split()[:-40], *prose(rnd, 40).split()])), (3, f"{prose(rnd, 300_000)} {item} {passage} end"),
            (4, f"short {passage} tail"), (5, prose(rnd, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    groups = {r.doc_id: r.component_id for r in neardup.groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    found = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert [r.doc_id for r in found.collect()] == [3]
    gone = {r.doc_id: r for r in repeats.remove_repeats(docs, True).collect()}
    assert gone[4].n_removed >= len(passage) and gone[3].n_removed >= len(passage) and gone[5].n_removed == 0
    assert gone[1].n_removed > 2_000_000
    for i, t in rows:
        assert gone[i].kept_sha256 == hashlib.sha256(bytes(gone[i].kept)).hexdigest()
    assert {r.doc_id: r.size for r in mixing.mix(docs).collect()} == {i: len(t.split()) for i, t in rows}


@pytest.mark.parametrize("rows_of_one", [500, 3])
def test_mix_of_repeated_rows_reaches_its_targets(spark, rows_of_one):
    """A source of equal rows, beside others: taken words differ from the target by less than one text."""
    rnd = random.Random(8)
    same = [(1, "ten words are in this text as you can see", "en", "a", 1)] * rows_of_one
    rows = same + [(10 + i, prose(rnd, rnd.randrange(1, 30)), "en", rnd.choice(["b", "c", None]), 1) for i in range(300)]
    rows += [(900, None, "en", "b", 1), (900, None, "en", "b", 1), (901, "", "en", "c", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert r.taken in (0, r.size, 2 * r.size)
    for source, rs in by.items():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs), source
        assert rs[0].source_size == sum(r.size for r in rs)
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))
    taken = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed_rows(docs).collect())
    sizes = Counter()
    for (i, t, source), n in taken.items():
        sizes[source] += n * len((t or "").split())
    assert sizes == Counter({source: sum(r.taken for r in rs) for source, rs in by.items()})
