"""Alignment of two tokenizers against plain loops over tokens, over awkward texts."""

import collections
import json
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tapeline.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, a binary, n_a string, groups long"


def texts(n=120, seed=4):
    rng = random.Random(seed)
    words = ["the", "House", " ", "naïve", "日本語", "don't", "4200", "<|endoftext|>", "</s>", "<0x41>", "x" * 30, "…", "\n\n", "\t", "🙂", "é", "́", "\x00", "Straße", "  two", "\r\n", "ﬁ"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.choice([1, 3, 20, 200]))), b"", "a", 1) for i in range(n)]
    rows += [(500 + i, rows[3][1], None, None, None) for i in range(40)] + [(2, rows[2][1], b"", "a", 1), (None, "no id", b"", "a", 1), (None, None, None, None, None)]
    return rows + [(600, None, b"", "a", 1), (601, "", b"", "a", 1), (602, "a▁b", b"", "a", 1), (603, "long words " * 20000, b"", "a", 1), (604, " ", b"", "a", 1)]


def byte_of_character():
    """As the byte-level alphabet is defined: printable Latin-1 stands for itself, the others follow from U+0100."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = byte_of_character()
    vocab = {i: t for t, i in json.load(open(A))["model"]["vocab"].items()}
    docs = []
    for i, text, *_ in rows:
        ids_a, ids_b, want = [], [], b" " + (text or "").encode()
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spans = []
        for ids, data in ((ids_a, lambda t: bytes(byte[c] for c in vocab[t])), (ids_b, lambda t: bytes([int(b.id_to_piece(t)[1:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode())):
            own, at, whole = [], 0, b""
            for t in ids:
                own.append((at, at + len(data(t)), t))
                at, whole = own[-1][1], whole + data(t)
            spans.append(own if whole == want else None)
        docs.append((i, *(spans if None not in spans else ([], []))))
    counts, found = collections.Counter(), []
    for i, sa, sb in docs:
        links, j = [], 0
        for x, y, t in sa:
            while j and sb[j - 1][1] > x:
                j -= 1
            while j < len(sb) and sb[j][0] < y:
                if sb[j][1] > x:
                    links.append((t, sb[j][2]))
                j += 1
        groups, own_a, own_b, j = [], [], [], 0
        for _, y, t in sa:
            own_a.append(str(t))
            while j < len(sb) and sb[j][1] <= y:
                own_b.append(str(sb[j][2]))
                j += 1
            if sb[j - 1][1] == y:
                groups.append(",".join(own_a) + "|" + ",".join(own_b))
                own_a, own_b = [], []
        counts.update(set(links))
        found.append((i, len(sa), len(sb), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return counts, [(i, na, nb, g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), text) for i, na, nb, g, links, text in found]


@pytest.mark.parametrize("parts,shard_keys,group", [(3, 1 << 20, 1 << 22), (9, 40, 500)])
def test_align(spark, monkeypatch, parts, shard_keys, group):
    rows = texts()
    counts, want = brute(rows)
    assert sum(n for _, n, *_ in want) > 1000 and sum(not n for _, n, *_ in want) >= 4
    monkeypatch.setattr(alignment, "GROUP_BYTES", group)
    docs = spark.createDataFrame(rows, DOCS).repartition(parts)
    got = alignment.align(docs, A, B, shard_keys).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    tokens = alignment.write_aligned_tokens(docs, A, B, alignment.shared_dir(spark))
    found = alignment.pair_counts(spark, alignment.count_pairs(tokens, (A, B), shard_keys), (A, B)).collect()
    assert {(r.a, r.b): r.n for r in found} == counts and len(found) == len(counts)


def test_nothing_to_align(spark):
    docs = spark.createDataFrame(texts(4), DOCS)
    assert alignment.align(docs.where("false"), A, B).count() == 0
    assert [tuple(r)[1:] for r in alignment.align(docs.where("text is null"), A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
