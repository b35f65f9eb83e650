"""LM scoring: a subword lattice over an existing vocabulary.

A text is its lower-cased (A-Z) words and one end. A word's probability is the sum over all ways to
cut it into pieces of the vocabulary of the product of the pieces' probabilities, by a forward
recursion in log space; the text's is the product over its words and the end. No piece spans a
word's edge, so words are scored once for the whole corpus. Characters that no piece holds are
spelled in bytes.

The vocabulary file's scores are merge ranks; they start as log weights by Zipf's law. One step of
expectation maximisation on the training words (expected uses of each piece over all cuts, by
forward and backward sums) gives the probabilities; the expected uses are held as integers, so
that they add up to the same in any order. The base score is a word unigram with add-one counts.

Counts of frequent words (at most HEAD, by a threshold on the count) are sent to every task; the
rest of each text's words meet their counts in a shuffle join, so that nothing that grows with the
corpus is broadcast.

Nulls: a null text counts as empty (one end); a null id counts as the empty text in the split.
Repeated rows count and are scored each. Other columns are passed by. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .common import arrow_map, id_bucket, pieces, text_of, words_of

HEAD = 100_000
#: Words that a task counts before it hands them on.
COUNTED = 200_000
UNIT = 1 << 20
LN10 = math.log(10)
END = "</s>"
_SPACE = "▁"


class Lattice:
    """Log probabilities (natural) of pieces, and the sums over all cuts of a word."""

    def __init__(self, names: list[str], logs: list[float]):
        self.names, self.logs = names, logs
        self.end = logs[names.index(END)]
        self.spelled = [0] * 256
        self.number: dict[str, int] = {}
        for i, name in enumerate(names):
            if name.startswith("<0x") and len(name) == 6:
                self.spelled[int(name[3:5], 16)] = i
            elif not (name.startswith("<") and name.endswith(">") and len(name) > 2):
                self.number[name] = i
        # beginnings of pieces that aren't pieces themselves end a search no sooner than needed
        self.next: dict[str, int] = {name[:k]: -1 for name in self.number for k in range(1, len(name))} | self.number

    @classmethod
    def from_file(cls, path: str) -> "Lattice":
        """Zipf weights by the order of the file's scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        weights = [1 / (10 + abs(model.get_score(i))) for i in range(len(names))]
        total = math.log(sum(weights))
        return cls(names, [math.log(w) - total for w in weights])

    def forward(self, word: str, keep: list | None = None) -> list[list[float]]:
        """For each place in a word, the log probabilities of the cuts that end there, by last piece.

        The sum over a place's list is its forward value, by which all pieces that begin there are
        weighted. With ``keep``, a list for each place gets (begin, piece or -1 for a spelled character).
        """
        s = _SPACE + word
        n = len(s)
        ends: list[list[float]] = [[0.0]] + [[] for _ in range(n)]
        get, logs, number = self.next.get, self.logs, self.number
        for i in range(n):
            alpha = self.add(ends[i])
            for j in range(i + 1, n + 1):
                p = get(s[i:j])
                if p is None:
                    break
                if p >= 0:
                    ends[j].append(alpha + logs[p])
                    if keep is not None:
                        keep[j].append((i, p))
            if s[i] not in number:
                ends[i + 1].append(alpha + sum([logs[self.spelled[b]] for b in s[i].encode()]))
                if keep is not None:
                    keep[i + 1].append((i, -1))
        return ends

    @staticmethod
    def add(terms: list[float]) -> float:
        if len(terms) == 1:
            return terms[0]
        m = max(terms)
        return m + math.log(sum([math.exp(t - m) for t in terms]))

    def log_probability(self, word: str) -> float:
        return self.add(self.forward(word)[-1])

    def uses(self, word: str, times: int, total: dict[int, int]) -> None:
        """Add to ``total`` the expected uses (in units) of pieces over all cuts of ``times`` copies of a word.

        A piece's share of what ends at its end is its term of the forward sum there; walking back,
        what ends anywhere is what begins there in cuts of the whole word.
        """
        keep: list[list[tuple[int, int]]] = [[] for _ in range(len(word) + 2)]
        ends = self.forward(word, keep)
        through = [0.0] * len(ends)
        through[-1] = float(times * UNIT)
        for j in range(len(ends) - 1, 0, -1):
            terms = ends[j]
            if len(terms) == 1:
                shares = (through[j],)
            else:
                m = max(terms)
                weights = [math.exp(t - m) for t in terms]
                scale = through[j] / sum(weights)
                shares = [w * scale for w in weights]
            for (i, p), part in zip(keep[j], shares):
                through[i] += part
                if p >= 0:
                    total[p] = total.get(p, 0) + int(part + 0.5)
                else:
                    for b in (_SPACE + word)[i].encode():
                        total[self.spelled[b]] = total.get(self.spelled[b], 0) + int(part + 0.5)

    def refit(self, uses: dict[int, int], ends: int) -> "Lattice":
        """The next model: expected uses with a tenth added to each piece."""
        weights = [uses.get(i, 0) / UNIT + 0.1 for i in range(len(self.names))]
        weights[self.names.index(END)] += ends
        total = math.log(sum(weights))
        return Lattice(self.names, [math.log(w) - total for w in weights])


def _training(doc_id):
    return id_bucket(doc_id, 7) != 2


def counted(docs: DataFrame) -> DataFrame:
    """token, c: every word of all texts and how often the training texts hold it."""

    def run(batches):
        from collections import Counter

        seen, other = Counter(), set()

        def rows():
            tokens = list(seen) + [t for t in other if t not in seen]
            counts = list(seen.values()) + [0] * (len(tokens) - len(seen))
            seen.clear()
            other.clear()
            return pa.record_batch([pa.array(tokens, pa.binary()), pa.array(counts, pa.int64())], ["token", "c"])

        for train, texts in pieces(batches, ["train", "text"]):
            for t, x in zip(train, texts):
                (seen if t else other).update(words_of(text_of(x), lower=True))
            if len(seen) + len(other) > COUNTED:
                yield rows()
        if seen or other:
            yield rows()

    each = docs.select(_training(F.col("doc_id")).alias("train"), F.col("text").cast("string").alias("text"))
    return arrow_map(each, run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def expected(tokens: DataFrame, lattice: Lattice) -> dict[int, int]:
    """Expected uses of each piece; at most one row for each piece comes to the driver."""
    shared = tokens.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        model, total = shared.value, {}
        for batch in batches:
            for token, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                model.uses(token.decode(), c, total)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([str(x) for x in total.values()])], ["piece", "uses"])

    rows = arrow_map(tokens.filter("c > 0").select("token", "c"), run, "piece int, uses string")
    return {r["piece"]: int(r["uses"]) for r in rows.groupBy("piece").agg(F.sum(F.col("uses").cast("decimal(38,0)")).alias("uses")).collect()}


def weighed(tokens: DataFrame, lattice: Lattice) -> DataFrame:
    """token, h (64-bit hash), c and lat (log10 probability) of every word."""
    shared = tokens.sparkSession.sparkContext.broadcast(lattice)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        model = shared.value
        for batch in batches:
            words = batch.column(0).to_pylist()
            lat = [model.log_probability(w.decode()) / LN10 for w in words]
            h = [xxh3_64_intdigest(w) - (1 << 63) for w in words]
            yield pa.record_batch([batch.column(0), pa.array(h, pa.int64()), batch.column(1), pa.array(lat, pa.float64())], ["token", "h", "c", "lat"])

    return arrow_map(tokens.select("token", "c"), run, "token binary, h long, c long, lat double")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words of at least some count, chosen so that there are at most ``most``."""
    drop = F.greatest(F.length(F.bin("c")) - 6, F.lit(0))
    floor = F.call_function("shiftleft", F.call_function("shiftright", F.col("c"), drop), drop)
    sizes = words.groupBy(floor.alias("least")).agg(F.count("*").alias("n")).collect()  # a few hundred rows
    total, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["least"]):
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return words.filter(F.lit(False) if least is None else F.col("c") >= least)


def _parts(docs: DataFrame, head: dict[bytes, tuple[int, float]]) -> DataFrame:
    """A row a document: sums over frequent words, and the others' hashes and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        from collections import Counter

        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        known, get = shared.value, shared.value.get
        logs = {w: (math.log10(c + 1), lat, c > 0) for w, (c, lat) in known.items()}
        get = logs.get
        row = TaskContext.get().partitionId() << 40
        for ids, texts in pieces(batches, ["doc_id", "text"]):
            out = [[] for _ in range(8)]
            for i, t in zip(ids, texts):
                words = words_of(text_of(t), lower=True)
                base = lat = 0.0
                n_known = 0
                hashes, times = [], []
                for w, n in Counter(words).items():
                    x = get(w)
                    if x is None:
                        hashes.append(xxh3_64_intdigest(w) - (1 << 63))
                        times.append(n)
                    else:
                        base += n * x[0]
                        lat += n * x[1]
                        n_known += n * x[2]
                for column, value in zip(out, (row, i, len(words) + 1, n_known, base, lat, hashes, times)):
                    column.append(value)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], ["row", "doc_id", "n_tokens", "known", "base", "lat", "h", "n"])

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(each, run, "row long, doc_id long, n_tokens long, known long, base double, lat double, h array<long>, n array<int>")


def score(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    tokens = scratch(counted(docs), "tokens")
    ends = docs.filter(_training(F.col("doc_id"))).count()
    seen = tokens.agg(F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).collect()[0]
    total, distinct = seen["n"] + ends, seen["v"] + (ends > 0)
    lattice = Lattice.from_file(path)
    lattice = lattice.refit(expected(tokens, lattice), ends)
    words = scratch(weighed(tokens, lattice), "words")
    head = {bytes(r["token"]): (r["c"], r["lat"]) for r in frequent(words, HEAD).select("token", "c", "lat").collect()}
    parts = scratch(_parts(docs, head), "parts")
    tail = parts.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    j = tail.join(words.select(F.col("h").alias("of"), "c", F.col("lat").alias("of_lat")), F.col("h") == F.col("of"))
    sums = j.groupBy(F.col("row").alias("of_row")).agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"),
        F.sum(F.col("n") * F.col("of_lat")).alias("more_lat"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
    )
    out = parts.drop("h", "n").join(sums, F.col("row") == F.col("of_row"), "left")
    more = lambda c: F.coalesce(F.col(f"more_{c}"), F.lit(0))
    base = F.col("base") + more("base") + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return out.select(
        "doc_id",
        (~_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + more("known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("lat") + more("lat") + F.lit(lattice.end / LN10)).alias("score"),
    )
