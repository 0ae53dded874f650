"""Language of whole texts, by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads the UTF-8 bytes of a text in both directions, gives every position a probability for each
language, and the mean of them over all positions is the document's. It is trained by backpropagation through time on
a bounded sample of labelled rows (``sample_docs`` texts of each language, a stretch of ``sample_chars`` characters each), on the driver; its few thousand
parameters go to the tasks. Texts are predicted where they are read, without a shuffle: a text is cut into stretches of
at most ``STRETCH`` bytes, each read from a fresh state, and thousands of stretches are read in step. Every byte of every
text is read; a very long text only gives more stretches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, ready

HIDDEN = 8
STRETCH = 96
AT_ONCE = 4096
NONE = "und"


class Reader:
    """One direction: a gated recurrent layer whose inputs are bytes. Arrays hold features by stretches."""

    def __init__(self, rng: np.random.Generator):
        self.table = (rng.standard_normal((3 * HIDDEN, 256)) * 0.3).astype(np.float32)
        self.gates = (rng.standard_normal((3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)

    def read(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each position; data is positions by stretches. keep gets what ``learn`` needs."""
        h = np.zeros((HIDDEN, data.shape[1]), np.float32)
        out = np.empty((len(data), *h.shape), np.float32)
        two = 2 * HIDDEN
        for t, x in enumerate(data):
            a, u = self.table.take(x, axis=1), self.gates @ h
            zr = a[:two]
            zr += u[:two]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n = np.multiply(r, u[two:])
            n += a[two:]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), n, u[two:].copy()))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def learn(self, data: np.ndarray, keep: list, error: np.ndarray) -> list[np.ndarray]:
        """Gradients of table and gates from the errors of the states, backwards through time."""
        back, gates, steps = np.zeros_like(error[0]), np.zeros_like(self.gates), []
        for t in range(len(data) - 1, -1, -1):
            h, z, r, n, u = keep[t]
            d = error[t] + back
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            pushed = np.concatenate((dz, dr, dn * r))
            gates += pushed @ h.T
            back = d * z + self.gates.T @ pushed
            steps.append(np.concatenate((dz, dr, dn)))
        steps = np.concatenate(steps[::-1], axis=1)
        flat = data.ravel()
        return [np.stack([np.bincount(flat, row, 256) for row in steps]).astype(np.float32), gates]


class Network:
    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.forward, self.backward = Reader(rng), Reader(rng)
        self.out = (rng.standard_normal((classes, 2 * HIDDEN)) * 0.1).astype(np.float32)
        self.bias = np.zeros((classes, 1), np.float32)

    def _weights(self) -> list[np.ndarray]:
        return [self.forward.table, self.forward.gates, self.backward.table, self.backward.gates, self.out, self.bias]

    def probabilities(self, data: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """By position, class and stretch; and the states they come from."""
        a = self.forward.read(data, keep and keep[0])
        b = self.backward.read(data[::-1], keep and keep[1])[::-1]
        states = np.concatenate((a, b), axis=1)
        p = np.matmul(self.out, states)
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p, states

    def train(self, data: np.ndarray, labels: np.ndarray, steps: int, batch: int, rate: float, seed: int = 6) -> None:
        """data: stretches by positions, all full. Cross-entropy at every position, by Adam."""
        rng = np.random.default_rng(seed)
        mean, square = [np.zeros_like(w) for w in self._weights()], [np.zeros_like(w) for w in self._weights()]
        for step in range(1, steps + 1):
            some = rng.integers(len(data), size=batch)
            x, y, keep = np.ascontiguousarray(data[some].T), labels[some], ([], [])
            p, states = self.probabilities(x, keep)
            p[:, y, np.arange(batch)] -= 1
            p /= p.shape[0] * batch / 50  # a scale that Adam undoes
            error = np.matmul(self.out.T, p)
            grads = self.forward.learn(x, keep[0], error[:, :HIDDEN])
            grads += self.backward.learn(x[::-1], keep[1], error[::-1, HIDDEN:])
            grads += [np.einsum("tcb,thb->ch", p, states), p.sum(axis=(0, 2))[:, None]]
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for w, g, m, s in zip(self._weights(), grads, mean, square, strict=True):
                g = np.clip(g, -5, 5)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of each text, which isn't empty."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        pieces = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        base = (np.cumsum(size) - size)[doc]
        start, end = base + nth * size[doc] // pieces[doc], base + (nth + 1) * size[doc] // pieces[doc]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        total = np.zeros((len(texts), len(self.out)))
        order = np.argsort(end - start, kind="stable")  # stretches of like length together
        for i in range(0, len(order), AT_ONCE):
            own = order[i : i + AT_ONCE]
            length = end[own] - start[own]
            step = np.arange(length.max())[:, None]
            p, _ = self.probabilities(flat[np.minimum(start[own] + step, len(flat) - 1)])
            if length.min() < length.max():
                p *= (step < length)[:, None, :]
            np.add.at(total, doc[own], p.sum(axis=0, dtype=np.float64).T)
        return total / size[:, None]


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents that is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train_language_id(docs: DataFrame, sample_docs: int = 400, sample_chars: int = 768, steps: int = 260, batch: int = 192) -> tuple[list[str], Network | None]:
    """The languages, by code point, and a network trained on rows that aren't held out and have text and lang."""
    docs = pick(docs, doc_id="doc_id", text="text", lang="lang").where("text is not null and lang is not null and text <> ''")
    docs = docs.where(~held_out(F.col("doc_id")))
    counts = dict(docs.groupBy("lang").count().collect())  # one row a language
    if not counts:
        return [], None
    languages = sorted(counts)
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limit = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(int(min(1.0, sample_docs / counts[k]) * (1 << 30))))])
    place = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - sample_chars)).cast("int")
    rows = docs.where(hashed < limit[F.col("lang")]).select("lang", F.substring(F.col("text"), place + 1, F.lit(sample_chars)).alias("part"), hashed.alias("h"))
    data, labels = [], []
    for lang, part, _ in sorted(rows.collect(), key=lambda r: (r.h, r.lang, r.part)):
        b = np.frombuffer(part.encode(), np.uint8)
        b = np.resize(b, max(STRETCH, len(b)))  # short ones are repeated
        for i in range(0, len(b) - STRETCH + 1, STRETCH):
            data.append(b[i : i + STRETCH])
            labels.append(languages.index(lang))
    network = Network(len(languages))
    network.train(np.array(data), np.array(labels), steps, batch, 0.02)
    return languages, network


def _predict(languages: list[str], network: Network | None, column: str):
    def apply(batches):
        for batch in batches:
            texts = batch.column(column).to_pylist()
            able = [i for i, x in enumerate(texts) if x and network is not None and any(map(str.isalpha, x))]
            label, score = [NONE] * len(texts), np.zeros(len(texts))
            group, size = [], 0
            for i in [*able, None]:  # about 8 MB at once
                if i is not None:
                    group.append(i)
                    size += len(texts[i])
                if group and (i is None or size > 1 << 23):
                    p = network.documents([texts[j].encode() for j in group])
                    for j, row in zip(group, p, strict=True):
                        label[j], score[j] = languages[int(row.argmax())], min(1.0, float(row.max()))
                    group, size = [], 0
            out = pa.Table.from_batches([batch]).append_column("lang_pred", pa.array(label, pa.string())).append_column("score", pa.array(score, pa.float64()))
            yield from out.to_batches()

    return apply


def predict(docs: DataFrame, languages: list[str], network: Network | None) -> DataFrame:
    """All columns of docs, renamed to c0, c1 and so on, with lang_pred and score."""
    ready(docs)
    at = docs.columns.index("text")
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    flat = flat.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
    return flat.mapInArrow(_predict(languages, network, f"c{at}"), f"{schema}, lang_pred string, score double")


def language_id(docs: DataFrame, **training) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document.

    lang_pred is a learnt language, with the mean probability of its positions as score; ``und`` and 0 if the text is null,
    has no letter, or no labelled text could be learnt from. Predictions see nothing but the text. held_out is false
    for a null doc_id. Repeated rows are predicted each; empty table: no rows; other columns go.
    """
    languages, network = train_language_id(docs, **training)
    own = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long"), "text")
    return predict(own, languages, network).select(F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.4, **training) -> DataFrame:
    """The rows of docs, all columns, whose language was told: not ``und``, and with at least this score."""
    languages, network = train_language_id(docs, **training)
    good = predict(docs, languages, network).where((F.col("lang_pred") != NONE) & (F.col("score") >= least_score))
    return good.drop("lang_pred", "score").toDF(*docs.columns)
