"""Suffix arrays and byte-window removal against brute force."""

import random

import numpy as np
import pytest

from tapeline.llm import suffix_dedup, suffix_groups

SCHEMA = "doc_id long, text string, chunk string, n_bytes int, at string"


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(60):
        texts = [[rng.integers(1, 2 + rng.integers(1, 4), size=rng.integers(0, 40)) if rng.random() < 0.7 else np.tile(rng.integers(1, 4, size=2), 9) for _ in range(rng.integers(1, 5))] for _ in range(rng.integers(1, 6))]
        blocks = [[0, *[y for x in block for y in (*x, 0)]] for block in texts]
        code, edges = np.concatenate(blocks), np.cumsum([0, *map(len, blocks)])
        got = suffix_groups.suffix_arrays(code, edges)
        tail = lambda i: tuple(code[i : i + np.argmin(code[i:])])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            assert sorted(got[a:b]) == list(range(a, b))
            assert [tail(i) for i in got[a:b]] == sorted(tail(i) for i in range(a, b))


def brute(rows, n):
    least = {}
    for i, text, *_ in rows:
        data, own = (text or "").encode(), float("inf") if i is None else i
        for p in range(len(data) - n + 1):
            key = data[p : p + n]
            least[key] = min(least.get(key, (own, p)), (own, p))
    out = []
    for i, text, *_ in rows:
        data, own = (text or "").encode(), float("inf") if i is None else i
        gone = [False] * len(data)
        for p in range(len(data) - n + 1):
            if least[data[p : p + n]] < (own, p):
                gone[p : p + n] = [True] * n
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("crowd,chunk_bytes,n", [(256, 1 << 22, 100), (3, 1500, 100), (1, 900, 40), (3, 1500, 20)])
def test_suffix_dedup(spark, crowd, chunk_bytes, n):
    rng = random.Random(4)
    prose = lambda k: "".join(rng.choice("ab çé日n  \n") for _ in range(k))
    shared, base = prose(170), prose(700)
    rows = [(i, prose(rng.randint(0, 300)), "c", 1, None) for i in range(0, 30, 2)]
    rows += [(i, prose(rng.randint(0, 90)) + shared + prose(rng.randint(0, 90)), "c", 1, "x") for i in range(31, 60)]
    for i in range(60, 80):  # near copies
        k = rng.randrange(len(base))
        rows.append((i, base[:k] + prose(2) + base[k + 1 :], None, None, None))
    rows += [(i, base, "c", 1, None) for i in (80, 81, 82, 5)]
    rows += [(90, "abc" * 150, "c", 1, None), (91, "x" * 450, "c", 1, None), (92, "bca" * 100 + shared + shared, "c", 1, None), (93, None, None, None, None), (94, "", None, None, None)]
    rows += [(None, base, "c", 1, None), (None, None, None, None, None), (95, prose(9000) + base, "c", 1, None), (96, shared, "c", 1, None), (96, "é" + shared, "c", 1, None)]
    rows += [(97, prose(3)[:3] + shared[:90], "c", 1, None), (98, base, "c", 1, None), (98, base, "c", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup.suffix_dedup(df, n, chunk_bytes, crowd).collect()
    plain = sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got), key=repr)
    assert plain == sorted(brute(rows, n), key=repr)
    assert suffix_dedup.suffix_dedup(df.where("false"), n).count() == 0
