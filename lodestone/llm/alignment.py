"""Tokens of two tokenizers over the same bytes: groups between shared ends, links, and how often pairs link.

Both tokenizers encode a space and the text: A is a byte-level BPE file of the tokenizers library, B a
sentencepiece model, which adds that space. The ends of a document's tokens are two rising lists of
byte offsets. Groups come from dividing and conquering: near the middle of an interval a common end is
looked for, the end of one A token after another, outwards, each by bisection in the ends of B; where one
is found, both halves are treated likewise; an interval without one is a leaf, and leaves are the groups.
All intervals of a level are searched at once, those of all texts of a batch on one axis, on which
documents' borders are shared ends. Nothing is shared inside a leaf, so its links, the pairs of tokens
whose bytes overlap, are as many as its tokens less one: one for each stretch between two ends of either kind.

Pairs are counted within each task, then added by pair. A bounded number of the most frequent pairs,
found by a histogram of counts, goes to all tasks with counts and marks of the best; the rarer pairs of
documents meet theirs by a join, in which no pair is more frequent than those.

Nulls: null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens: zeros and
an empty groups_sha256. Each row counts, repeated ones too. Other columns are passed by. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .byte_tokens import ByteTokenizer, Remembered, read_text, tokenizer_for
from .common import arrow_map, pieces, text_of

#: Pairs that are broadcast at most; 17 bytes each.
HEAD = 1 << 18
#: Distinct pairs that a counting task holds before it sends them on.
HELD = 1_000_000
#: Single steps outwards from the middle; then windows that double.
STEPS = 16


def byte_of_character() -> dict[str, int]:
    """Bytes of the characters that byte-level vocabularies write for them: printable Latin-1 is itself, the rest follow from U+0100 on."""
    out, more = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(0x100 + more)] = b
            more += 1
    return out


class PieceTokenizer(Remembered):
    """A sentencepiece BPE model that puts a space before a text and has no piece with a space behind other characters.

    So no merge reaches from a word to the space after it: spaces and the word behind them are a part.
    """

    def __init__(self, model: bytes):
        import numpy as np
        import sentencepiece

        self.library = b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces_ = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.data = [_byte_piece(p) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_)]
        self.sizes = np.fromiter(map(len, self.data), np.int64)
        crossing = any("▁" in p.lstrip("▁") for i, p in enumerate(pieces_) if not b.is_control(i) and not b.is_unknown(i))
        self.split = (lambda t: [t] if t else []) if crossing else re.compile(" *[^ ]+| +").findall
        self.together = not crossing
        self.forget()

    def joins(self, part: str) -> bool:
        """Spaces and a word."""
        return self.together and part[0] == " " and part[-1] != " "

    def joined(self, parts: list[str]) -> list[int]:
        return self.library.encode("".join(parts)[1:], num_threads=1)

    def apart(self, parts: list[str]) -> list[list[int]]:
        # an empty text gets no space: spaces alone are read behind a letter
        first = len(self.library.encode("a", num_threads=1))
        return [x if p[-1] != " " else x[first:] for p, x in zip(parts, self.library.encode([p[1:] if p[-1] != " " else "a" + p for p in parts], num_threads=1))]

    def whole(self, text: str) -> bool:
        return False


@dataclass
class Pair:
    """Both tokenizers, and every token's bytes."""

    a: ByteTokenizer
    b: PieceTokenizer
    a_bytes: list[bytes]
    b_bytes: list[bytes]

    def __post_init__(self):
        import numpy as np

        self.a_len = np.fromiter(map(len, self.a_bytes), np.int64)
        self.b_len = np.fromiter(map(len, self.b_bytes), np.int64)
        names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: What is written for an id: the id, and a comma, a bar or a semicolon.
        self.names = [n + c for c in ",|;" for n in names]
        self.sizes = len(names)


def _byte_piece(piece: str) -> bytes:
    return bytes([int(piece[3:-1], 16)])


_pairs: dict[tuple[str, str], Pair] = {}


def pair_for(a_path: str, b_path: str, pattern: str, a_data, b_data) -> Pair:
    """This worker process's tokenizers, from broadcasts of both files."""
    if (a_path, b_path) not in _pairs:
        a = tokenizer_for(a_path, False, pattern, a_data)
        code = byte_of_character()
        vocabulary = {i: t for t, i in a.library.get_vocab(with_added_tokens=False).items()}
        a_bytes = [bytes(map(code.__getitem__, vocabulary[i])) if i in vocabulary else b"" for i in range(max(vocabulary) + 1)]
        b = PieceTokenizer(b_data.value)
        _pairs[a_path, b_path] = Pair(a, b, a_bytes, b.data)
    return _pairs[a_path, b_path]


def shared_cuts(a_ends, b_ends, a_first, a_last):
    """Indices of A tokens whose end is one of B's too, inside intervals; by divide and conquer.

    a_ends, b_ends: rising ends. a_first, a_last: for each starting interval (whose own last end is shared) its
    first A token and its last; that last isn't among the results.
    """
    import numpy as np

    cuts = []
    lo, hi = a_first, a_last  # an interval's inner ends are those of the A tokens lo .. hi - 1
    top = len(b_ends) - 1

    def shared(k):
        return b_ends[np.minimum(np.searchsorted(b_ends, a_ends[k]), top)] == a_ends[k]

    while True:
        open_ = lo < hi
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            break
        middle = (lo + hi - 1) // 2
        cut = np.full(len(lo), -1, np.int64)
        left = np.arange(len(lo))  # intervals still searched
        for t in range(STEPS):
            if not len(left):
                break
            for side in (t, -t) if t else (0,):
                k = middle[left] + side
                inside = (k >= lo[left]) & (k < hi[left])
                at, k = left[inside], k[inside]
                good = shared(k)
                cut[at[good]] = k[good]
                left = left[cut[left] < 0]
        left = left[(middle[left] - STEPS >= lo[left]) | (middle[left] + STEPS < hi[left])]
        for i in left.tolist():  # long stretches without a shared end
            cut[i] = _outwards(shared, int(lo[i]), int(hi[i]), int(middle[i]))
        found = cut >= 0
        cut, lo, hi = cut[found], lo[found], hi[found]
        cuts.append(cut)
        lo, hi = np.concatenate([lo, cut + 1]), np.concatenate([cut, hi])
    return np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, np.int64)


def _outwards(shared, lo: int, hi: int, middle: int) -> int:
    """The shared end nearest to the middle of lo .. hi - 1 from STEPS on, in windows that double; -1 without one."""
    import numpy as np

    near, width = STEPS, STEPS
    while middle - near >= lo or middle + near < hi:
        best = -1
        for k in (np.arange(max(lo, middle - near - width + 1), middle - near + 1)[::-1], np.arange(middle + near, min(hi, middle + near + width))):
            good = k[shared(k)] if len(k) else k
            if len(good) and (best < 0 or abs(int(good[0]) - middle) < abs(best - middle)):
                best = int(good[0])
        if best >= 0:
            return best
        near, width = near + width, 2 * width
    return -1


def aligned_batch(pair: Pair, texts: list[str]):
    """For a list of texts: n_a, n_b, n_groups, n_links, groups (None without tokens), and per text its pairs (a * size of B + b) with how often each links."""
    import numpy as np

    given = [" " + t if t else "" for t in texts]
    a_ids, a_many, _ = pair.a.encode(given)
    b_ids, b_many, fits = pair.b.encode(given)
    fits &= a_many > 0
    n_a, n_b = np.where(fits, a_many, 0), np.where(fits, b_many, 0)
    groups, links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    written: list[str | None] = [None] * len(texts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    if not fits.any():
        return n_a, n_b, groups, links, written, found
    a = a_ids[np.repeat(fits, a_many)].astype(np.int64)
    b = b_ids[np.repeat(fits, b_many)].astype(np.int64)
    a_ends, b_ends = np.cumsum(pair.a_len[a]), np.cumsum(pair.b_len[b])
    docs = np.flatnonzero(fits)
    a_last = np.cumsum(n_a[docs]) - 1
    cuts = shared_cuts(a_ends, b_ends, a_last + 1 - n_a[docs], a_last)
    a_close = np.sort(np.concatenate([cuts, a_last]))  # last A token of each group
    b_close = np.searchsorted(b_ends, a_ends[a_close])
    owner = np.searchsorted(a_last, a_close)  # which of docs
    groups[docs] = np.bincount(owner, minlength=len(docs))
    # what is written: each group's A ids, a bar, its B ids, a semicolon
    a_sep, b_sep = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_sep[a_close], b_sep[b_close] = 1, 2
    each_group = np.arange(len(a_close))
    a_group, b_group = np.repeat(each_group, np.diff(a_close, prepend=-1)), np.repeat(each_group, np.diff(b_close, prepend=-1))
    b_before = np.concatenate([[0], b_close[:-1] + 1])
    place_a = np.arange(len(a)) + b_before[a_group]
    place_b = np.arange(len(b)) + a_close[b_group] + 1
    line = np.empty(len(a) + len(b), np.int64)
    line[place_a], line[place_b] = a + a_sep * pair.sizes, b + b_sep * pair.sizes
    names, end = pair.names, np.cumsum(n_a[docs] + n_b[docs])
    start = 0
    for n, e in zip(docs.tolist(), end.tolist()):
        written[n] = "".join(map(names.__getitem__, line[start:e].tolist()))[:-1]
        start = e
    # a link for each stretch of bytes up to an end of either kind; both lists are sorted, so that this is a merge
    order = np.argsort(np.concatenate([a_ends, b_ends]), kind="stable")
    of_a = order < len(a)
    value = np.where(of_a, a_ends[np.minimum(order, len(a) - 1)], b_ends[np.maximum(order - len(a), 0)])
    last = np.flatnonzero(np.append(value[1:] != value[:-1], True))  # the last of equal ends
    i = np.concatenate([[0], np.cumsum(of_a)[last[:-1]]])  # ends of A before
    j = np.concatenate([[0], np.cumsum(~of_a)[last[:-1]]])
    links[docs] = np.diff(np.searchsorted(value[last], a_ends[a_last], "right"), prepend=0)
    of = np.repeat(np.arange(len(docs)), links[docs])
    size = len(pair.b_bytes)
    both = len(pair.a_bytes) * size
    if both * len(docs) < 1 << 63:
        each, times = np.unique(of * both + a[i] * size + b[j], return_counts=True)
        edges = np.searchsorted(each, np.arange(len(docs) + 1) * both)
        for d, n in enumerate(docs.tolist()):
            found[n] = (each[edges[d] : edges[d + 1]] - d * both, times[edges[d] : edges[d + 1]])
    else:
        for d, n in enumerate(docs.tolist()):
            mine = of == d
            found[n] = np.unique(a[i[mine]] * size + b[j[mine]], return_counts=True)
    return n_a, n_b, groups, links, written, found


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and each document's pairs with how often they link, as bytes of little-endian uint32 (uint64 for pairs of larger vocabularies)."""
    sc = docs.sparkSession.sparkContext
    with open(b_path, "rb") as f:
        b_data = sc.broadcast(f.read())
    a_data = sc.broadcast(read_text(a_path))

    def run(batches):
        pair = pair_for(a_path, b_path, pattern, a_data, b_data)
        wide = pair_type(len(pair.a_bytes) * len(pair.b_bytes))
        for ids, texts in pieces(batches, ["doc_id", "text"], 1_500_000):
            n_a, n_b, groups, links, written, found = aligned_batch(pair, [text_of(t) for t in texts])
            digests = ["" if w is None else hashlib.sha256(w.encode()).hexdigest() for w in written]
            del written
            cols = [pa.array(ids, pa.int64()), *map(pa.array, (n_a, n_b, groups, links)), pa.array(digests, pa.string())]
            cols += [pa.array([p.astype(wide).tobytes() for p, _ in found], pa.binary()), pa.array([t.astype("<u4").tobytes() for _, t in found], pa.binary())]
            yield pa.record_batch(cols, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def pair_type(size: int) -> str:
    """The numpy type of pair numbers below ``size``."""
    return "<u4" if size <= 1 << 32 else "<u8"


def sizes(a_path: str, b_path: str) -> tuple[int, int]:
    """How many ids A and B have."""
    import json

    import sentencepiece

    return 1 + max(json.loads(read_text(a_path))["model"]["vocab"].values()), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def pair_counts(rows: DataFrame, wide: str) -> DataFrame:
    """pair, n: how many links of all documents hold each pair; tasks add up first."""

    def run(batches):
        import numpy as np

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            parts, times = [keys], [counts]
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(np.frombuffer(p, wide).astype(np.int64))
                times.append(np.frombuffer(t, "<u4").astype(np.int64))
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate(times), len(keys)).astype(np.int64)
            if len(keys) > HELD:
                yield pa.record_batch([pa.array(keys), pa.array(counts)], ["pair", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.record_batch([pa.array(keys), pa.array(counts)], ["pair", "n"])

    return arrow_map(rows.select("pairs", "times"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def head_of(scored: DataFrame, bound: int) -> int:
    """The least count whose pairs, with all more frequent ones, are no more than ``bound``; by bins of a sixteenth of an octave."""
    bins = scored.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, held = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        held += r["pairs"]
        if held > bound:
            break
        least = r["least"]
    return least


def cross_alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every document."""
    import numpy as np

    size_a, size_b = sizes(a_path, b_path)
    wide = pair_type(size_a * size_b)
    rows = scratch(aligned(docs, a_path, b_path, pattern).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = scratch(pair_counts(rows, wide), "pair-counts")
    best = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("n").alias("most"))
    scored = counts.join(best, F.col("pair") % size_b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    scored = scratch(scored, "pairs-scored")
    least = head_of(scored, head)
    top = sorted(scored.filter(F.col("n") >= least).collect())
    known = docs.sparkSession.sparkContext.broadcast((np.array([r["pair"] for r in top], np.int64), np.array([r["n"] for r in top], np.int64), np.array([r["best"] for r in top], bool)))
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches):
        pairs, n, is_best = known.value
        for batch in batches:
            row, pair, times, total, hits, first = [], [], [], [], [], []
            for k, (r, p, t) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("row", "pairs", "times")])):
                p, t = np.frombuffer(p, wide).astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, p), max(len(pairs) - 1, 0))
                hit = pairs[at] == p if len(pairs) else np.zeros(len(p), bool)
                at, own = at[hit], t[hit]
                miss = np.flatnonzero(~hit)
                row.append(np.full(1 + len(miss), r))
                # a document's own row meets no pair; its number keeps such rows apart
                pair.append(np.concatenate([[-1 - r], p[miss]]))
                times.append(np.concatenate([[0], t[miss]]))
                total.append(np.concatenate([[int((own * n[at]).sum())], np.zeros(len(miss), np.int64)]))
                hits.append(np.concatenate([[int(own[is_best[at]].sum())], np.zeros(len(miss), np.int64)]))
                first.append(np.concatenate([[k], np.full(len(miss), -1)]))
            if row:
                where = np.concatenate(first)
                index = pa.array(np.maximum(where, 0), mask=where < 0)
                cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in (row, pair, times, total, hits)]
                yield pa.record_batch([*cols, *[batch.column(c).take(index) for c in kept], pa.array(where >= 0)], ["row", "pair", "times", "total", "hits", *kept, "own"])

    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own boolean"
    parts = arrow_map(rows, run, f"row long, pair long, times long, total long, hits long, {kinds}")
    rare = scored.filter(F.col("n") < least).withColumnRenamed("pair", "of")
    met = parts.join(rare, F.col("pair") == F.col("of"), "left")
    total = F.sum(F.col("total") + F.coalesce(F.col("times") * F.col("n"), F.lit(0)))
    hits = F.sum(F.col("hits") + F.when(F.col("best"), F.col("times")).otherwise(0))
    one = F.max(F.when(F.col("own"), F.struct(*kept))).alias("one")
    out = met.groupBy("row").agg(one, total.alias("count_sum"), hits.alias("n_best"))
    return out.select(*[F.col(f"one.{c}").alias(c) for c in kept[:5]], "n_best", "count_sum", "one.groups_sha256")
