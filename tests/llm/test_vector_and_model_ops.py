"""Mixing, top-k search, vector groups, language ID, HTML and the pipeline, against brute force and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tapeline.llm import embedding_dedup, html_text, language_id, mixing, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def test_mixing(spark):
    rng = random.Random(1)
    sizes = {"a": 30, "b": 200, "c": 60, "é": 90, None: 40}
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 80))), "en", rng.choices(list(sizes), sizes.values())[0], 1, 1) for i in range(600)]
    rows += [(1000, None, "en", "a", 1, 1), (1001, "", None, "empty", None, None), (None, "x y z", "en", "b", 1, 1), (5, "x y", "en", "b", 1, 1), (5, "x y", "en", "b", 1, 1), (1002, "w " * 9000, "en", "c", 1, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert len(got) == len(rows)
    size = {}
    for _, text, _, source, *_ in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        rest, w = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            free.discard(s)
    target |= {s: rest * weight[s] / w for s in free}
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 32 * 8 + 0.02 * target[s], s
    assert mixing.mix(df.where("false")).count() == 0


def test_draws_are_multinomial(spark):
    """Counts of a source over the shards spread as its binomial does, and a shard's counts fill it."""
    sources = spark.createDataFrame([(0, 80_000, 30_000.0), (1, 40_000, 60_000.0), (2, 30_000, 60_000.0)], "sid int, source_size long, target double")
    rows = mixing.draws(sources, block=10, shard_slots=100, seed=3)[0].collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, {})[r.sid] = r.n
    assert len(shards) == 150 and all(sum(x.values()) == 100 for x in shards.values())
    for sid, share in ((0, 0.2), (1, 0.4), (2, 0.4)):
        n = np.array([x.get(sid, 0) for x in shards.values()])
        want = 100 * share * (1 - share)
        assert abs(n.mean() - 100 * share) < 4 * (want / 150) ** 0.5 and 0.6 * want < n.var() < 1.5 * want
    pair = np.corrcoef([x.get(1, 0) for x in shards.values()], [x.get(2, 0) for x in shards.values()])[0, 1]
    assert abs(pair + 2 / 3) < 0.2  # multinomial: -sqrt(0.4 * 0.4 / (0.6 * 0.6))


def test_mixed_texts(spark):
    """What the pipeline's stage emits has the words that the mix takes, also of few long texts."""
    import corpus_pipeline as C

    rng = random.Random(4)
    text = lambda k: " ".join(f"w{rng.randrange(999)}" for _ in range(k))
    rows = [(i, t := text(k), "en", s, len(t)) for i, (k, s) in enumerate([(4000, "a"), (3000, "a"), (5000, "b"), (20, "b"), (700, "c"), (1, "c"), (0, "c"), (900, None)])]
    rows += [(1, "one two", "en", "a", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    got, texts = {}, {r[0]: r[1] for r in rows}
    for r in C.mixed(spark, docs, None).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and (set(r.text.split()) <= set(texts[r.doc_id].split()) or r.doc_id == 1)
    assert got == {k: n for k, n in want.items() if n}
    assert C.mixed(spark, docs.where("false"), None).count() == 0


VEC = "vec_id long, embedding array<float>, label int, v string, dim int"


def vectors(n=260, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for k in range(60, 120):  # near copies
        base[k] = base[rng.integers(60)] + 0.05 * rng.standard_normal(dim)
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3), "x", 1) for i, v in enumerate(base)]
    rows += [(i, rows[4][1], rows[4][2], "x", 1) for i in (300, 301, 400)]
    bad = [None, [0.0] * dim, [1.0] * (dim - 1) + [float("nan")], [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], []]
    rows += [(500 + i, v, 1, None, None) for i, v in enumerate(bad)] + [(600, rows[3][1], None, "x", 1), (None, rows[3][1], 0, "x", 1), (601, [-x for x in rows[2][1]], 2, "x", 1), (602, [0.0] * dim, 2, "x", 1)]
    return rows


def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("shard_rows,block_rows", [(10_000, 2048), (50, 3)])
def test_top_k(spark, shard_rows, block_rows):
    from pyspark.sql import functions as F

    rows = vectors()
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if i is not None and good(v)]
    want = []
    for q, a in whole:
        if q % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    df = spark.createDataFrame(rows, VEC).repartition(4)
    got = topk_search.top_k(df, F.expr("vec_id % 10 = 0"), 10, shard_rows=shard_rows, block_rows=block_rows).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk_search.top_k(df.where("false"), F.expr("vec_id % 10 = 0")).count() == 0


@pytest.mark.parametrize("cell_rows,block_rows", [(8192, 2048), (40, 7)])
def test_embedding_groups(spark, cell_rows, block_rows):
    rows = vectors()
    able = [good(v) and any(v) and i is not None and label is not None for i, v, label, *_ in rows]
    n, near = len(rows), {}
    for a in range(n):
        for b in range(a):
            if able[a] and able[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    near.setdefault(a, set()).add(b)
                    near.setdefault(b, set()).add(a)
    want = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            todo += [y for y in near.get(todo.pop(), ()) if y not in seen and not seen.add(y)]
        root = min((rows[x][0] for x in seen if rows[x][0] is not None), default=None)
        want.append((rows[a][0], len(near.get(a, ())), root, rows[a][0] is None or rows[a][0] == root))
    df = spark.createDataFrame(rows, VEC).repartition(4)
    got = embedding_dedup.embedding_groups(df, 0.93, cell_rows=cell_rows, block_rows=block_rows, margin=0.6).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert embedding_dedup.embedding_groups(df.where("false")).count() == 0


def test_recall_of_production_settings(spark):
    """The share of true links that small cells still find."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    few = embedding_dedup.embedding_groups(df, 0.93, cell_rows=128).agg({"n_links": "sum"}).first()[0]
    rows = df.where("label is not null and embedding is not null").collect()
    true = 0
    for label in {r.label for r in rows}:
        x = np.array([r.embedding for r in rows if r.label == label], float)
        x = x[np.isfinite(x).all(axis=1)]
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        true += int((x @ x.T >= 0.93).sum()) - len(x)
    assert few >= 0.97 * true


def test_network_gradients():
    rng = np.random.default_rng(0)
    net, x, y = language_id.Network(3), rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    for w in net._weights():
        w *= 0.5
    loss = lambda: -np.log(net.probabilities(x)[0][:, y, np.arange(5)].astype(float)).sum()
    keep = ([], [])
    p, states = net.probabilities(x, keep)
    p[:, y, np.arange(5)] -= 1
    error = np.matmul(net.out.T, p)
    h = language_id.HIDDEN
    grads = net.forward.learn(x, keep[0], error[:, :h]) + net.backward.learn(x[::-1], keep[1], error[::-1, h:]) + [np.einsum("tcb,thb->ch", p, states)]
    for w, g in zip(net._weights(), grads, strict=False):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[i]
        w[i] = old + 1e-2
        up = loss()
        w[i] = old - 1e-2
        down = loss()
        w[i] = old
        assert g[i] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-2)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(9001, None, "en", None, 1), (9002, "123 !? 456", "en", None, 1), (9003, "", None, None, 1), (None, "the of and", None, None, None)], docs.schema)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    both = docs.unionByName(odd)
    got = language_id.language_id(both).collect()
    assert len(got) == len(lang) + 4
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in {"und", *lang.values()}
        assert (r.lang_pred == "und") == (r.doc_id in (9001, 9002, 9003))
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    kept = language_id.keep_known(both)
    assert kept.columns == docs.columns and kept.where("doc_id in (9001, 9002, 9003)").count() == 0 and kept.count() >= 0.99 * len(lang)
    assert {r.lang_pred for r in language_id.language_id(odd.where("doc_id < 9003")).collect()} == {"und"}
    assert language_id.language_id(docs.where("false")).count() == 0


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain &amp; <b>bold</b>", "plain & bold"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<div>a</div><div>b</div>", "a\nb"),
        ("<ul><li>x<li>y<ol start=3><li>q<li>r</ol></ul>", "- x\n- y\n\n  3. q\n  4. r"), ("x<script>no</script><style>no</style><!-- no -->y", "xy"),
        ("<p hidden>no</p><div style='DISPLAY : none'>no</div><i aria-hidden=true>no</i>yes", "yes"), ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"), ("<table><tr><td rowspan=2>1<td>22<td>3<tr><td>4<td>5</table>", "1  22  3\n   4   5"),
        ("<title>no</title><details><summary>s</summary>no</details>", "s"), ("a < b and <b", "a < b and"), ("<blockquote>q</blockquote>", "> q"), ("<div>" * 3000 + "deep", "deep"), ("<a title='<p>'>t</a>", "t"),
    ],
)
def test_html(page, text):
    out = html_text.render(page or "")
    assert out == text


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (None, None, None, None), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, html_text.html_text(df).collect()), key=repr) == sorted([(1, "a"), (None, ""), (1, "a")], key=repr)
    assert html_text.html_text(df.where("false")).count() == 0


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline(spark):
    """Each stage of the pipeline on a small table, by what its operator says and by brute force."""
    import base64

    import public_tokenizers
    import tiktoken
    from test_suffix_dedup import brute

    import corpus_pipeline as C

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 260").unionByName(spark.createDataFrame([(9001, "12 34 !!", "en", "src1", 8)], "doc_id long, text string, lang string, source string, n_chars long"))
    one = C.language(spark, docs, None).cache()
    assert one.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {9001}
    two = C.near_duplicates(spark, one, None).cache()
    sets = {r.doc_id: _shingles(r.text) for r in one.collect()}
    ids, root = sorted(sets), {i: i for i in sets}
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert sorted(r.doc_id for r in two.collect()) == sorted({*root.values()})
    three = C.repeated_bytes(spark, two, None).cache()
    want = {i: kept.decode(errors="ignore") for i, _, _, _, kept in brute([(r.doc_id, r.text) for r in two.collect()], 100)}
    assert {r.doc_id: r.text for r in three.collect()} == want and all(r.n_chars == len(r.text) for r in three.collect())
    four = C.mixed(spark, three, None).cache()
    assert four.columns == docs.columns
    words = {}
    for r in four.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {r.doc_id: r.taken for r in mixing.mix(three).collect() if r.taken}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, enc.encode_ordinary(r.text))).encode()).hexdigest()) for r in four.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in C.tokens(spark, four, None).collect()) == want
    assert C.run(spark, "/root/testdata/sf0.001").count() > 0
