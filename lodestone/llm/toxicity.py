"""Toxicity: a convolutional text classifier in numpy, trained on all labelled rows by Spark.

Words (lower-case letters A-Z folded, marks at their ends stripped) are embedded by two hashes into
two small tables, side by side, so that two words share an embedding only if both hashes agree.
Filters of 1, 2 and 3 words run over the whole text; each filter's maximum, cut at zero, enters
one logistic unit.

Every labelled training row is learned from, whatever its length. Rows are dealt by the hash of their
id into shards of some SHARD documents. Counts of words by label, added over all shards, start the
embeddings; then, in each of ROUNDS rounds, every shard starts from the shared weights, descends over
all its documents, and the weights' changes are averaged over the documents of all shards (iterative
parameter mixing). The sums are of integers, so that reruns agree. A fifth of the training rows, by
hash, stays outside; their scores, counted by language on a grid of GRID cells, give the thresholds.
A language with few toxic rows there takes the threshold of all.

Nulls: a null text counts as empty; an empty text gets the score of no words. Repeated rows are
scored and learned from each. Other columns are passed by. Without labels of both kinds every score
is the share of label 1 (0.5 without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, scratch
from .common import arrow_map, id_bucket, id_filter, pieces, summed, text_of, training_labels, words_of

BUCKETS = 1 << 16
DIM = 4
WIDTHS = (1, 2, 3)
FILTERS = 8
BATCH = 48
#: Documents of a shard, on average, and words from which a shard takes another row.
SHARD = 1024
SHARD_WORDS = 1_000_000
ROUNDS = 5
#: Steps of a shard in a round at least; one pass over its documents otherwise.
STEPS = 40
#: Units of one in the sums of weights' changes.
UNIT = 1 << 24
#: Cells of the grid of scores, equally wide in log-odds.
GRID = 4096
PADS = max(WIDTHS) - 1
#: Word positions whose activations are held at a time.
POSITIONS = 16_384
_MARKS = b".,;:!?#*$%&\"'()[]{}<>|-_/\\"


def hashed(text: str):
    """Two table rows for each word of a text."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    h = np.fromiter((xxh3_64_intdigest(w.strip(_MARKS)) for w in words_of(text, lower=True)), dtype=np.uint64)
    low = (h & np.uint64(BUCKETS - 1)).astype(np.int32)
    high = ((h >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int32)
    return low, high


class Model:
    """Weights and the forward pass; row BUCKETS of a table is the padding, always zero."""

    def __init__(self, seed: int = 7):
        import numpy as np

        r = np.random.default_rng(seed)
        self.tables = [r.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32) for _ in range(2)]
        for t in self.tables:
            t[BUCKETS] = 0
        self.filters = [r.normal(0, 0.4, (w, 2 * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, dtype=np.float32)
        self.constant: float | None = None

    def parameters(self):
        """All weights, to be changed in place."""
        return [*self.tables, *self.filters, self.shift, self.out, self.bias]

    def flat(self):
        import numpy as np

        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat) -> "Model":
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def prime(self, seen, share: float, prior: float = 10.0):
        """Start the first number of each embedding at its bucket's smoothed log-odds of label 1.

        ``seen`` is the sum of occurrences() over all documents, ``share`` that of label 1. Filters
        then find telling words at once; descent on their maxima alone meets rare ones late.
        """
        import numpy as np

        for k, table in enumerate(self.tables):
            odds = np.log(seen[k, 1] + prior * share) - np.log(seen[k, 0] + prior * (1 - share)) - np.log(share / (1 - share))
            table[:BUCKETS, 0] += odds.astype(np.float32)
            for f in self.filters:
                f[:, k * DIM] = np.abs(f[:, k * DIM])

    def lay(self, docs):
        """Row numbers of all documents end to end, each with its padding, and where each begins."""
        import numpy as np

        low, high, starts, lengths, at = [], [], [], [], 0
        pad = np.full(PADS, BUCKETS, dtype=np.int32)
        for a, b in docs:
            if not len(a):
                a = b = np.full(1, BUCKETS, dtype=np.int32)
            low += [a, pad]
            high += [b, pad]
            starts.append(at)
            lengths.append(len(a))
            at += len(a) + PADS
        return np.concatenate(low), np.concatenate(high), np.array(starts), np.array(lengths)

    def activations(self, low, high):
        """The filters' values at every position, and the embeddings."""
        import numpy as np

        x = np.concatenate([self.tables[0][low], self.tables[1][high]], axis=1)
        n = len(x) - PADS
        z = np.empty((n, len(WIDTHS) * FILTERS), dtype=np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            part = x[:n] @ f[0]
            for o in range(1, w):
                part += x[o : n + o] @ f[o]
            z[:, k * FILTERS : (k + 1) * FILTERS] = part
        return z, x

    def peaks(self, low, high, starts, lengths):
        """Each document's maximum of every filter, and the position where it is first reached."""
        import numpy as np

        stops, d, cols = starts + lengths, 0, np.arange(len(WIDTHS) * FILTERS)
        top = np.full((len(starts), len(cols)), -np.inf, dtype=np.float32)
        where = np.zeros(top.shape, dtype=np.int64)
        for s in range(0, int(stops[-1]), POSITIONS):
            e = min(s + POSITIONS, len(low) - PADS)
            z, _ = self.activations(low[s : e + PADS], high[s : e + PADS])
            while d < len(starts) and starts[d] < e:
                a, b = max(starts[d], s), min(stops[d], e)
                if a < b:
                    at = z[a - s : b - s].argmax(axis=0)
                    value = z[a - s + at, cols]
                    better = value > top[d]
                    top[d] = np.where(better, value, top[d])
                    where[d] = np.where(better, a + at, where[d])
                if stops[d] > e:  # a long text goes on in the next block
                    break
                d += 1
        return top, where

    def scores(self, docs):
        """The probability of each document; ``docs`` are pairs from hashed()."""
        import numpy as np

        if self.constant is not None:
            return np.full(len(docs), self.constant)
        low, high, starts, lengths = self.lay(docs)
        stops, d = starts + lengths, 0
        top = np.full((len(docs), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        for s in range(0, int(stops[-1]), POSITIONS):
            e = min(s + POSITIONS, len(low) - PADS)
            z, _ = self.activations(low[s : e + PADS], high[s : e + PADS])
            while d < len(docs) and starts[d] < e:
                a, b = max(starts[d], s), min(stops[d], e)
                if a < b:
                    top[d] = np.maximum(top[d], z[a - s : b - s].max(axis=0))
                if stops[d] > e:  # a long text goes on in the next block
                    break
                d += 1
        logit = np.maximum(top + self.shift, 0) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def occurrences(docs, y):
    """By table, label and bucket, how many documents hold a word of the bucket."""
    import numpy as np

    seen = np.zeros((2, 2, BUCKETS), dtype=np.int64)
    for d, label in zip(docs, y):
        for k in range(2):
            seen[k, int(label), np.unique(d[k])] += 1
    return seen


def descend(model: Model, docs, y, seed: int, turn: int) -> None:
    """Train ``model`` in place on one shard's documents for round ``turn``: each of them once at least.

    Half of a batch is of either label. A shard of one label alone fills half batches, and leaves the bias to others.
    """
    import numpy as np

    r = np.random.default_rng([11, seed, turn])
    half = BATCH // 2
    kinds = [k for k in (np.flatnonzero(y == 1), np.flatnonzero(y == 0)) if len(k)]
    steps = max(STEPS, *[-(-len(k) // half) for k in kinds])
    # every document comes as often as any other of its label, or once more
    draws = [np.concatenate([r.permutation(k) for _ in range(-(-steps * half // len(k)))])[: steps * half].reshape(steps, half) for k in kinds]
    squares = [np.full(BUCKETS + 1, 1e-4, dtype=np.float32) for _ in range(2)]
    dense = [*model.filters, model.shift, model.out] + [model.bias] * (len(kinds) == 2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in dense]
    for step in range(1, steps + 1):
        pick = np.concatenate([d[step - 1] for d in draws])
        low, high, starts, lengths = model.lay([docs[i] for i in pick])
        top, where = model.peaks(low, high, starts, lengths)
        h = top + model.shift
        live = h > 0
        h = np.where(live, h, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.bias, -30, 30)))
        g = ((p - y[pick]) / BATCH).astype(np.float32)
        dz = g[:, None] * model.out * live
        grads, rows, back = [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, model.filters)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            df = np.zeros_like(f)
            for o in range(w):
                at = where[:, own] + o
                x = np.concatenate([model.tables[0][low[at]], model.tables[1][high[at]]], axis=2)
                df[o] = np.einsum("dfe,df->ef", x, dz[:, own])
                rows.append(at.ravel())
                back.append((dz[:, own, None] * f[o].T[None]).reshape(-1, 2 * DIM))
            grads.append(df)
        grads += [dz.sum(axis=0), g @ h, g.sum(keepdims=True)]
        rate = 0.01 * min(1.0, 4 * (1 - (turn + (step - 1) / steps) / ROUNDS))
        for q, d, m in zip(dense, grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            change = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
            q -= change if q is model.bias else change + rate * 1e-3 * q
        at, grad = np.concatenate(rows), np.concatenate(back)
        for table, square, rows, part in ((model.tables[0], squares[0], low[at], grad[:, :DIM]), (model.tables[1], squares[1], high[at], grad[:, DIM:])):
            unique, inverse = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(inverse, part[:, c], len(unique)) for c in range(DIM)], axis=1).astype(np.float32)
            square[unique] += (total**2).mean(axis=1)
            table[unique] -= 0.1 * total / np.sqrt(square[unique])[:, None]
            table[BUCKETS] = 0


def started(seen, n: int, toxic: int) -> Model:
    """The model before descent, of ``n`` documents, so many of them toxic; a constant without both labels."""
    model = Model()
    if not 0 < toxic < n:
        model.constant = toxic / n if n else 0.5
    else:
        model.prime(seen, toxic / n)
    return model


def finished(model: Model, n: int, toxic: int) -> Model:
    """Batches were half toxic; the bias takes the true share back."""
    import numpy as np

    model.bias += np.float32(np.log(toxic / (n - toxic)))
    return model


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit a model to one shard in memory."""
    import numpy as np

    y = np.array(labels, dtype=np.float32)
    n, toxic = len(y), int(y.sum())
    docs = [hashed(t) for t in texts]
    model = started(occurrences(docs, y), n, toxic)
    if model.constant is not None:
        return model
    for turn in range(ROUNDS):
        descend(model, docs, y, 0, turn)
    return finished(model, n, toxic)


def sharded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows as shards: shard (below 0: for thresholds), labels, langs, lengths and the words' two hashes.

    A row of the result is a shard, or a part of one with more than SHARD_WORDS words. Texts stay where
    they are: words are hashed behind a filter of labelled ids, and the hashes are joined with the labels.
    """
    import numpy as np

    known = training_labels(labels, "toxic")
    count = known.count()
    bit, held = id_filter(known, "_id", count)
    bits = docs.sparkSession.sparkContext.broadcast(held)

    def words(batches):
        names = ["_doc", "_lang", "_low", "_high"]
        for ids, langs, texts in pieces(marked(batches), names[:2] + ["_text"], 600_000):
            found = [hashed(text_of(t)) for t in texts]
            low, high = [[d[k].astype("<u2").tobytes() for d in found] for k in range(2)]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], names)

    def marked(batches):
        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_bit")).to_numpy()
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    def joined(batches):
        held, size, names = [], 0, ["shard", "labels", "langs", "lengths", "low", "high"]

        def row():
            _, y, langs, low, high = zip(*held)
            cols = [[held[0][0]], [bytes(y)], [list(langs)], [np.array([len(x) // 2 for x in low], "<i8").tobytes()], [b"".join(low)], [b"".join(high)]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()])], names)

        for batch in batches:
            for doc in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_shard", "_label", "_lang", "_low", "_high")]):
                if held and (doc[0] != held[0][0] or size > 2 * SHARD_WORDS):
                    yield row()
                    held, size = [], 0
                held.append(doc)
                size += len(doc[3])
        if held:
            yield row()

    doc = F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("_doc"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("_text"), bit(doc).alias("_bit"))
    rows = rows.filter(F.col("_doc").isNotNull() & (id_bucket(F.col("_doc"), 4) != 2))
    hashes = arrow_map(rows, words, "_doc long, _lang string, _low binary, _high binary")
    # one plan at every size: a broadcast of the labels would grow with them
    training = hashes.join(known.hint("merge"), F.col("_doc") == F.col("_id")).withColumn("_label", (F.col("_label") > 0).cast("int"))
    many = max(1, count // SHARD)
    deal = F.xxhash64("_doc", F.lit("shard"))
    dealt = training.withColumn("_shard", F.when(F.pmod(F.xxhash64("_doc", F.lit("part")), F.lit(5)) < 4, F.pmod(deal, F.lit(many))).otherwise(-1 - F.pmod(deal, F.lit(many))))
    order = ["_shard", F.xxhash64("_doc"), "_doc", "_label", F.coalesce("_lang", F.lit("")), "_low", "_high"]
    schema = "shard long, labels binary, langs array<string>, lengths binary, low binary, high binary"
    out = scratch(arrow_map(dealt.repartition("_shard").sortWithinPartitions(*order), joined, schema), "toxic-words", "zstd")
    release(known)
    return out


def shards_of(batches):
    """Of each row of sharded(): its number, documents as pairs of hashes, labels, languages."""
    import numpy as np

    for batch in batches:
        for i in range(batch.num_rows):
            number, y, langs, lengths, low, high = [batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("shard", "labels", "langs", "lengths", "low", "high")]
            at = np.cumsum(np.frombuffer(lengths, "<i8"))[:-1]
            docs = list(zip(np.split(np.frombuffer(low, "<u2"), at), np.split(np.frombuffer(high, "<u2"), at)))
            yield number, docs, np.frombuffer(y, np.uint8).astype(np.float32), langs


def trained(shards: DataFrame) -> Model:
    """The model of all shards."""
    import numpy as np

    sc = shards.sparkSession.sparkContext

    def count(batches):
        for _, docs, y, _ in shards_of(batches):
            yield np.concatenate([[len(y), int(y.sum())], occurrences(docs, y).ravel()]).astype(np.int64)

    counts = summed(shards, count)
    n, toxic = (0, 0) if counts is None else counts[:2].tolist()
    model = started(None if counts is None else counts[2:].reshape(2, 2, BUCKETS), n, toxic)
    if model.constant is not None:
        return model
    flat = model.flat()
    for turn in range(ROUNDS):
        shared = sc.broadcast(flat)

        def change(batches, turn=turn, shared=shared):
            for number, docs, y, _ in shards_of(batches):
                mine = Model().load(shared.value)
                descend(mine, docs, y, number, turn)
                yield np.rint((mine.flat().astype(np.float64) - shared.value) * (UNIT * len(y))).astype(np.int64)

        flat = (flat + summed(shards, change) / (UNIT * n)).astype(np.float32)
        shared.unpersist()
    return finished(model.load(flat), n, toxic)


def edges():
    """The grid's limits: scores of a cell are at least its limit, and less than the next."""
    import numpy as np

    inner = 1 / (1 + np.exp(-np.linspace(-30, 30, GRID - 1)))
    return np.concatenate([[0.0], inner, [1.0]])


def calibrate(shards: DataFrame, model: Model, least: int = 20) -> dict[str, float]:
    """The threshold of best F1 for each language with ``least`` toxic rows, and for all (''). A language has GRID counts at most."""
    import numpy as np

    shared = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        from collections import Counter

        limits, seen = edges(), Counter()
        for _, docs, y, langs in shards_of(batches):
            for k in range(0, len(docs), BATCH):
                cells = np.searchsorted(limits, shared.value.scores(docs[k : k + BATCH]), side="right") - 1
                for lang, cell, label in zip(langs[k : k + BATCH], np.minimum(cells, GRID - 1).tolist(), y[k : k + BATCH].tolist()):
                    seen.update([(name, cell, int(label)) for name in {lang or "", ""}])
        names, cells, found = [list(c) for c in zip(*seen)] or [[], [], []]
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(cells, pa.int32()), pa.array(found, pa.int32()), pa.array(list(seen.values()), pa.int64())], ["lang", "cell", "label", "n"])

    cells = arrow_map(shards, run, "lang string, cell int, label int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hit"))
    by, down = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("cell"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    toxic = F.sum("hit").over(by)
    f1 = 2 * F.sum("hit").over(upto) / (F.sum("n").over(upto) + toxic)
    ranked = cells.select("lang", "cell", F.lead("cell").over(down).alias("after"), toxic.alias("toxic"), f1.alias("f1"))
    wanted = ranked.filter((F.col("toxic") >= F.when(F.col("lang") == "", 1).otherwise(least)))
    best = wanted.groupBy("lang").agg(F.max_by(F.struct("cell", "after"), F.struct("f1", "cell")).alias("at"))
    limits = edges()
    # halfway to the next scores
    out = {r["lang"]: float(limits[r["at"]["cell"]] + (0.0 if r["at"]["after"] is None else limits[r["at"]["after"] + 1])) / 2 for r in best.collect()}
    return {"": 0.5} | out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, dict[str, float]]:
    """A model and the thresholds by language, from all labelled training rows."""
    shards = sharded(docs, labels)
    model = trained(shards.filter("shard >= 0"))
    limits = calibrate(shards.filter("shard < 0"), model)
    release(shards)
    return model, limits


def score(docs: DataFrame, model: Model, thresholds: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, threshold (the language's) and flagged for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model, thresholds))

    def run(batches):
        net, limits = shared.value
        for ids, langs, texts in pieces(batches, ["doc_id", "lang", "text"], 600_000):
            s = net.scores([hashed(text_of(t)) for t in texts]).tolist()
            t = [limits.get(lang or "", limits[""]) for lang in langs]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(s), pa.array(t), pa.array([a >= b for a, b in zip(s, t)])], ["doc_id", "score", "threshold", "flagged"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    out = arrow_map(rows, run, "doc_id long, score double, threshold double, flagged boolean")
    return out.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "threshold", "flagged")
