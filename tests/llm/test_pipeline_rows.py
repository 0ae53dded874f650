"""Stages of the pipeline on near copies, and on null and repeated ids."""

import random

import pytest

import corpus_pipeline as C
from tapeline.llm import near_copies
from tapeline.llm.common import keyed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], SCHEMA).repartition(3)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_texts(seed=5):
    """Texts of 120 words in crowds of edited copies, on both sides of the limit."""
    rng = random.Random(seed)
    out = []
    for crowd, edits in ((25, 1), (12, 2), (12, 3), (6, 6), (30, 0)):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for k in range(crowd):
            w = [f"w{rng.randrange(5000)}" for _ in range(120)] if not edits else list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(120)] = f"x{rng.randrange(9000)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block_rows", [8, 2048])
def test_near_copies(spark, block_rows):
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = [find(x) for x in range(len(texts))]
    # all bits, so that the comparison of the shingles alone decides
    docs = keyed(frame(spark, list(enumerate(texts))), "k")
    got = near_copies.near_copies(docs, "k", budget=64, block_rows=block_rows).collect()
    name = {r["first"].row: r["first"].doc_id for r in got}
    assert {r["first"].doc_id: name[r.component] for r in got} == {i: want[i] for i in name.values()}
    assert {texts[i] for i in name.values()} == set(texts) and len(name) == len(set(texts))
    kept = {r.doc_id for r in C.near_duplicates(spark, docs.drop("k"), None).collect()}
    assert kept >= set(want) and len(kept) <= len(set(want)) + 1  # 18 bits
    assert near_copies.near_copies(docs.where("false"), "k").count() == 0


def odd_ids():
    """Null ids, and one id of several rows: different texts, and equal rows."""
    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, prose(80)) for i in range(20)] + [(None, prose(90)), (None, prose(70)), (3, prose(60)), (3, prose(65))]
    twin = (4, prose(75))
    return [*rows, twin, twin, (40, rows[20][1])]


def test_odd_ids(spark):
    rows = odd_ids()
    docs = frame(spark, rows)
    # the text of the first null id is also that of 40, which has an id and stays; equal rows are copies
    two = C.near_duplicates(spark, docs, None)
    alone = sorted({r for r in rows if r != rows[20]}, key=repr)
    assert two.columns == docs.columns and sorted(((r.doc_id, r.text) for r in two.collect()), key=repr) == alone
    # a text without its copy is left as it is, once for each row
    unique = [r for r in rows if r[1] != rows[20][1]]
    three = C.repeated_bytes(spark, frame(spark, unique), None)
    assert sorted(((r.doc_id, r.text) for r in three.collect()), key=repr) == sorted(unique, key=repr)
    # one source has its own size as its target, so about as many words come out, of the same rows
    four = C.mixed(spark, frame(spark, unique), None).collect()
    texts = {(r.doc_id, w) for r in four for w in r.text.split()}
    assert texts <= {(i, w) for i, t in unique for w in t.split()}
    total = sum(len(t.split()) for _, t in unique)
    assert abs(sum(len(r.text.split()) for r in four) - total) <= 0.15 * total and {r.doc_id for r in four} >= {None, 3, 4}


ODD = "doc_id long, text string, lang string, source string, n_chars long, _whole int, _pieces string, _copy int, _row_key long, row_key string, `a.b` string, c1 string, copy string, m map<string,int>, TEXT string, whole int, pieces string"


@pytest.mark.parametrize("stage", ["language", "near_duplicates", "repeated_bytes", "mixed"])
def test_clashing_columns(spark, stage):
    """Columns named like those that stages use, with dots, twins by case, and a map come out as they went in."""
    rng = random.Random(2)
    lang = {"en": "the of and to in that with for", "de": "der die und das nicht mit für von"}
    more = lambda i: (i, "p", 7, -i, f"k{i}", f"a{i}", "c", "d", {"x": i, "y": 1}, "upper", 3, "q")
    rows = [(i, " ".join(rng.choices(lang[x].split(), k=60)) + f" {i}", x, "s", 5, *more(i)) for i in range(40) for x in [("en", "de")[i % 2]]]
    rows += [(None, rows[0][1], None, None, None, *more(99)), (50, None, "en", None, None, *more(50)), rows[3], (51, "", "en", "s", 0, *[None] * 12)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = spark.createDataFrame(rows, ODD).repartition(3)
        got = getattr(C, stage)(spark, docs, None)
        assert got.columns == docs.columns and got.schema.simpleString() == docs.schema.simpleString()
        found = got.collect()
        extra = {repr(r[5:]) for r in docs.collect()}
        assert found and {repr(r[5:]) for r in found} <= extra
        if stage == "repeated_bytes":
            assert all(r.n_chars == len(r.text) for r in found)
        assert getattr(C, stage)(spark, docs.drop("n_chars"), None).count() == len(found)
        assert getattr(C, stage)(spark, docs.where("false"), None).count() == 0
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
