"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run
over each chunk, as sums of one weight row for each byte and offset, and are max-pooled within the
chunk. Of the pooled values, the mean, the largest and the smallest over the document's chunks
enter one logistic unit, whose output is the probability of label 1. Trained on a bounded sample
of the training rows (SAMPLE documents).

Nulls: a null text counts as empty; an empty text is one chunk of padding. Repeated rows are scored
each. Other columns are passed by. Without labels of both kinds every score is the share of
label 1 (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, id_bucket, labelled_sample, pieces, text_of

SAMPLE = 3000
CHUNK = 384
STEP = 352
WIDTH = 6
FILTERS = 16
STEPS = 1000
BATCH = 32


def chunks(text: str):
    """The text's bytes as rows of CHUNK, the last padded with 0; the row beginnings are STEP apart."""
    import numpy as np

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(1, -(-max(0, len(data) - (CHUNK - STEP)) // STEP))
    flat = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    flat[: len(data)] = data
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK), (STEP, 1))


class Net:
    """Filters (offset, byte, filter), and the logistic unit over the pooled values."""

    def __init__(self, seed: int = 3):
        import numpy as np

        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.out = r.normal(0, 0.2, 3 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.constant: float | None = None

    def convolve(self, rows):
        """The filters' values at every position of every chunk."""
        import numpy as np

        n = CHUNK - WIDTH + 1
        z = np.take(self.filters[0], rows[:, :n], axis=0)
        part = np.empty_like(z)
        for o in range(1, WIDTH):
            np.take(self.filters[o], rows[:, o : n + o], axis=0, out=part, mode="clip")
            z += part
        return z

    def pooled(self, rows):
        """Each chunk's largest value by filter, a block of chunks at a time."""
        import numpy as np

        return np.concatenate([np.tanh(self.convolve(rows[i : i + 64]).max(axis=1)) for i in range(0, len(rows), 64)])

    def features(self, top, starts):
        import numpy as np

        lengths = np.diff(np.append(starts, len(top)))[:, None]
        return np.concatenate([np.add.reduceat(top, starts) / lengths, np.maximum.reduceat(top, starts), np.minimum.reduceat(top, starts)], axis=1)

    def scores(self, texts: list[str]):
        import numpy as np

        if self.constant is not None:
            return np.full(len(texts), self.constant)
        cut = [chunks(t) for t in texts]
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        top = np.concatenate([self.pooled(c) for c in cut]) if len(cut) == 1 else self.pooled(np.concatenate(cut))
        logit = (self.features(top, starts) @ self.out + self.bias).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def train(texts: list[str], labels: list[int]) -> Net:
    """Fit a net; the order of the rows decides the batches, so that reruns agree."""
    import numpy as np

    net = Net()
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    r = np.random.default_rng(5)
    ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    params = [net.filters, net.out, net.bias]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    cols = np.arange(FILTERS)
    for step in range(1, STEPS + 1):
        pick = np.concatenate([r.choice(ones, BATCH // 2), r.choice(zeros, BATCH // 2)])
        cut = [chunks(texts[i]) for i in pick]
        starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
        ends = np.append(starts[1:], starts[-1] + len(cut[-1]))
        rows = np.concatenate(cut)
        where, top = [], []
        for i in range(0, len(rows), 64):
            z = net.convolve(rows[i : i + 64])
            at = z.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        where, top = np.concatenate(where), np.tanh(np.concatenate(top))
        x = net.features(top, starts)
        p = 1 / (1 + np.exp(-np.clip(x @ net.out + net.bias, -30, 30)))
        g = (p - y[pick]) / BATCH
        dx = g[:, None] * net.out
        dtop = np.zeros_like(top)
        for d, (a, b) in enumerate(zip(starts, ends)):
            dtop[a:b] += dx[d, :FILTERS] / (b - a)
            dtop[a + top[a:b].argmax(axis=0), cols] += dx[d, FILTERS : 2 * FILTERS]
            dtop[a + top[a:b].argmin(axis=0), cols] += dx[d, 2 * FILTERS :]
        dz = dtop * (1 - top**2)
        df = np.zeros_like(net.filters)
        line = np.arange(len(rows))[:, None]
        for o in range(WIDTH):
            np.add.at(df[o], (rows[line, where + o], cols[None, :]), dz)
        rate = 0.02 * min(1.0, 3 * (1 - step / (STEPS + 1)))
        for q, d, m in zip(params, [df, g @ x, g.sum(keepdims=True)], moments):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            q -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
        net.out -= rate * 1e-3 * net.out
    net.bias += np.float32(np.log(len(ones) / len(zeros)))  # batches hold as many of either kind
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Net:
    """A net trained on at most ``sample`` labelled documents."""
    texts, y, _ = labelled_sample(docs, labels, "quality", sample)
    return train(texts, y)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for ids, texts in pieces(batches, ["doc_id", "text"], 600_000):
            s = model.scores([text_of(t) for t in texts])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(s)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = arrow_map(rows, run, "doc_id long, score double")
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score")


def accepted(docs: DataFrame, net: Net, least: float = 0.7) -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = shared.value
        for batch in batches:
            keep = []
            for (texts,) in pieces([pa.record_batch([batch.column(batch.schema.get_field_index("text"))], ["text"])], ["text"], 600_000):
                keep += (model.scores([text_of(t) for t in texts]) >= least).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)
