"""Word, SimHash, token-store and byte-BPE operators against brute force on small and awkward tables."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeline.llm import byte_bpe, simhash, substring_dedup, token_store

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, n_words int"


def awkward(seed=3):
    rng = random.Random(seed)
    words = ["ab", "Çé", "x", "the", "of", "%%%", "日本", "don't"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(40)
    rows = [(i, prose(rng.randint(0, 60)), "en", "s", "c", 1) for i in range(0, 40, 2)]
    rows += [(i, prose(5) + "\n" + shared + "\t" + prose(5), "en", "s", None, 1) for i in range(41, 60, 2)]
    rows += [(60, shared, None, None, None, None), (61, shared, "en", "s", "c", 1), (7, shared, "en", "s", "c", 1), (62, shared + " " + shared, "en", "s", "c", 2)]
    rows += [(None, shared, "en", "s", "c", 1), (None, None, None, None, None, None), (70, "", "en", "s", "c", 1), (71, None, "en", "s", "c", 1)]
    rows += [(72, " \x0b\t\n", "en", "s", "c", 1), (73, prose(6000), "en", "s", "c", 1), (73, shared, "en", "s", "c", 1), (74, "a\xa0b\x1cc d", "en", "s", "c", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("n,seed", [(13, 7), (13, 3), (5, 7), (30, 7)])
def test_substring_dedup(spark, n, seed):
    rows = awkward()
    least = {}
    for i, text, *_ in rows:
        w = words_of(text)
        for k in range(len(w) - n + 1):
            key, own = tuple(w[k : k + n]), float("inf") if i is None else i
            least[key] = min(least.get(key, own), own)
    want = []
    for i, text, *_ in rows:
        w, own = words_of(text), float("inf") if i is None else i
        gone = {j for k in range(len(w) - n + 1) if least[tuple(w[k : k + n])] < own for j in range(k, k + n)}
        want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = substring_dedup.substring_dedup(frame(spark, rows), n, seed, chunk_bytes=2000).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert substring_dedup.substring_dedup(frame(spark, []), n, seed).count() == 0


def brute_components(fps, budget):
    ids = list(range(len(fps)))
    find = lambda x: x if ids[x] == x else find(ids[x])
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= budget:
                ids[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_simhash(spark):
    rows = awkward()
    got = simhash.simhash_groups(frame(spark, rows), task_rows=4).collect()

    def one(text):
        line = (text or "").encode().translate(simhash.LOWER).split()
        sh = [b" ".join(line[i : i + 3]) for i in range(max(1, len(line) - 2))] if line else []
        hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [one(r[1]) for r in rows]
    root = brute_components(fps, 2)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = [(r[0], f - (1 << 64) if f >> 63 else f, least.get(k)) for r, f, k in zip(rows, fps, root, strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    kept = sorted(r[0] for r in simhash.simhash_dedup(frame(spark, rows)).select("doc_id").collect())
    assert kept == sorted({x for x in least.values()})


@pytest.mark.parametrize("task_rows", [3, 64, 100_000])
def test_trie_join_finds_every_link(spark, task_rows):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    near = [int(b) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) * int(rng.integers(2)) for b in np.repeat(base, 6)]
    fps = sorted({int(b) for b in base} | set(near) | {0, 1, 7, (1 << 64) - 1})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, task_rows).collect()
    place = {f: i for i, f in enumerate(signed)}
    ids = list(range(len(fps)))
    find = lambda x: x if ids[x] == x else find(ids[x])
    for a, b in links:
        assert ids is not None and place[a] != place[b]
        ids[find(place[a])] = find(place[b])
    groups = lambda roots: sorted(sorted(i for i, r in enumerate(roots) if r == k) for k in set(roots))
    assert groups([find(i) for i in range(len(fps))]) == groups(brute_components(fps, 2))


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 5, 1000, 4097):
        keys = np.arange(n, dtype=np.int64) * 7 - 3
        index = token_store.build_index(keys)
        assert (token_store.look_up(keys, *index) == np.arange(n)).all()
        assert len(index[1]) == n and sorted(index[2].tolist()) == list(range(n))
        absent = token_store.look_up(keys + 1, *index)
        assert n < 10 or (absent < 0).mean() > 0.99


def test_token_store(spark):
    rows = awkward()
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    encoded = sorted(((i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0))
    got = token_store.token_store(frame(spark, rows), path, shard_ids=300).collect()
    total = 0
    want = {}
    for i, ids in encoded:
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == k) for k in want}
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == total
        total += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [i for i, _ in encoded]
    assert token_store.token_store(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("memo", [60, 600_000])
def test_encoder(memo, monkeypatch):
    """Characters that normalisation takes apart, joins or gives another class; a table that starts anew; words and other runs."""
    monkeypatch.setattr(token_store, "MEMO", memo)
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    t = Tokenizer.from_file(path)
    some = "abZ09 .,!?'|<>-\n\t\x01\x7f" + "é\u0130\u212a\ufb1d\u05d9\u05b4\u0301\u1100\u1161\u11a8\u4e00\xbd\u2160\u3000\u200b\xdf\u03a3\u03c2\u0345\U0001d165\u0958"
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    got = token_store.Encoder(path).encode([x.encode() for x in texts], 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_get_tokens(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = awkward()
    folder = f"file://{tmp_path}/tokens"
    token_store.write_tokens(frame(spark, rows), path, folder, shard_ids=300)
    text = dict((r[0], r[1]) for r in rows if r[0] != 73)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in token_store.get_tokens(spark, folder, [60, 41, 5, 71, 1000]).collect()}
    assert got == {k: t.encode(text[k] or "", add_special_tokens=False).ids + [2] for k in (60, 41, 71)}


def test_get_many_tokens(spark, tmp_path):
    """A hundred thousand keys, most of them absent, far apart and beside null ids; a single key reads a single file."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, f"text {k}", "en", "s", "c", 1) for i in range(3000) for k in [i * 7 if i < 2900 else -(1 << 62) + i * 10**13]] + [(None, "none", "en", "s", "c", 1)] * 50
    folder = f"file://{tmp_path}/tokens"
    token_store.write_tokens(frame(spark, rows), path, folder, shard_ids=40)
    shards = spark.read.schema(token_store.SHARD).parquet(folder)
    keys = spark.range(100_000).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(k,) for k in (None, 7, -(1 << 62) + 2950 * 10**13, (1 << 63) - 1, -(1 << 63))], "doc_id long"))
    got = token_store.get_tokens(spark, folder, keys)
    t = Tokenizer.from_file(path)
    want = {k: t.encode(text, add_special_tokens=False).ids + [2] for k, text, *_ in rows if k is not None and 0 <= k or k == -(1 << 62) + 2950 * 10**13}
    assert {r.doc_id: r.ids for r in got.collect()} == want
    met = token_store.find_shards(shards, keys)
    assert met.count() < 110_000 and shards.count() > 200  # a key meets a shard or two, not all
    assert token_store.find_shards(shards, keys.where("doc_id = 7")).select("file").distinct().count() == 1
    assert token_store.get_tokens(spark, folder, []).count() == 0


def test_token_shards_of_one_key(spark, tmp_path):
    """Many rows of null and of one doc_id still make shards of a bounded size, and a key leads to one row."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, f"some words {i} of a text", "en", "s", "c", 1) for i in range(400) for k in (None, 7)]
    folder = f"file://{tmp_path}/tokens"
    token_store.write_tokens(frame(spark, rows), path, folder, shard_ids=200)
    shards = spark.read.parquet(folder)
    assert shards.count() > 10 and shards.agg({"n_ids": "max"}).first()[0] < 250
    got = token_store.token_digest(spark, folder).collect()
    assert sorted((r.doc_id is None) for r in got) == [False] * 400 + [True] * 400
    starts = sorted((r.start, r.n_tokens, r.doc_id is None) for r in got)
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:i]) for i in range(800)] and [x for _, _, x in starts] == [False] * 400 + [True] * 400
    assert [r.doc_id for r in token_store.get_tokens(spark, folder, [7, 8]).collect()] == [7]


def test_byte_bpe(spark):
    rows = awkward() + [(200, "ﬀ 🙂🙂 � naïve'll 12345   \n\n x▁y", "en", "s", "c", 1)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := enc.encode_ordinary(x or "")), hexed(",".join(map(str, ids)).encode()), hexed((x or "").encode())) for i, x, *_ in rows]
    got = byte_bpe.bpe_digest(frame(spark, rows), path, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    encoded = byte_bpe.bpe_encode(frame(spark, rows), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.bpe_decode(encoded, path, public_tokenizers.PATTERN).collect()
    assert sorted(((r.doc_id, bytes(r.data)) for r in decoded), key=repr) == sorted(((r[0], (r[1] or "").encode()) for r in rows), key=repr)
    assert byte_bpe.bpe_digest(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0
