"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database per partition.

Merge rule: within a pre-token, the adjacent pair whose concatenation has the lowest rank is
contracted, leftmost first, until no pair has a rank. A pre-token that is itself in the
vocabulary is that token. The merge table holds every split of a token into two tokens.

One recursion step contracts the leftmost lowest pair of each word. A pre-token of 256 bytes or more is
first cut wherever no token of the vocabulary that occurs in it reaches across: no merge can, so that
its parts are encoded by themselves. In parts that are still as long, a step may contract more pairs. A
rank is "calm" if no merge of the part's own bytes that takes its token in has a lower or equal rank;
then contracting further copies of that pair cannot make a better pair come first, and all its
non-overlapping copies in the part are contracted in the same step, left to right. That keeps runs such
as a million equal letters at a few steps, with the same result as one at a time.

The query that encodes words also decodes their ids, by ordered aggregation of the tokens' bytes. A
text's decoded bytes are those that its ids give, pre-token by pre-token. decode() does the same from
columns of ids.

Nulls: a null text counts as empty and gives no ids. Repeated rows give repeated results; other
columns are passed by. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, text_of

#: Distinct pre-tokens of a generation, and their characters; a worker remembers two generations at most.
REMEMBERED = 250_000
REMEMBERED_CHARS = 4_000_000
#: Bytes of unknown pre-tokens that one recursive query takes at most (one pre-token at least).
QUERY_BYTES = 150_000
#: Rows of token positions that one recursion keeps; it starts again from its last step.
STEP_ROWS = 1_500_000
#: Bytes from which a pre-token is cut into parts, and a part takes a query of its own.
LONG = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken rank file (fixed size: that of the vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(left, right, merged) for every split of a token into two tokens."""
    rows = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.append((a, b, rank))
    return rows


#: Rows in order, so that the aggregates (one thread, which keeps their order) join them as they come.
_END = """
), last AS (SELECT word, max(level) AS level FROM step GROUP BY word)
SELECT word, string_agg(name, ',') AS ids, string_agg(hex, '') AS decoded, any_value(level) = $1 AS unfinished
FROM (
    SELECT o.word, o.level, v.name, v.hex
    FROM (SELECT s.word, s.level, s.tok FROM step s JOIN last USING (word, level) ORDER BY (s.word::BIGINT << 32) + s.pos) o
    LEFT JOIN vocabulary v ON v.id = o.tok)
GROUP BY word
"""

#: For words of fewer than LONG bytes: the leftmost pair of lowest rank in each step. A row is a
#: token position with its right neighbour and the pair's merge. The right one of two contracted
#: positions stays, since it knows what follows; only it and the position before join the merges anew.
_ENCODE = (
    """
WITH RECURSIVE step(word, pos, nxt, tok, ntok, merged, level) AS (
    SELECT s.word, s.pos, s.nxt, s.tok, s.ntok, m.merged, 0
    FROM start s LEFT JOIN merges m ON m.a = s.tok AND m.b = s.ntok
  UNION ALL (
    WITH lowest AS (
        SELECT word, min((merged * 256 + pos) * 256::BIGINT + nxt) AS packed
        FROM step WHERE merged IS NOT NULL AND level < $1 GROUP BY word
    ), best AS (
        SELECT word, (packed >> 16)::INTEGER AS merged, ((packed >> 8) & 255)::INTEGER AS gone, (packed & 255)::INTEGER AS pos
        FROM lowest
    ), after AS (
        SELECT s.word, s.pos, s.level + 1 AS level, s.merged,
               CASE WHEN s.nxt = b.gone THEN b.pos ELSE s.nxt END AS nxt,
               CASE WHEN s.pos = b.pos THEN b.merged ELSE s.tok END AS tok,
               CASE WHEN s.nxt = b.gone THEN b.merged ELSE s.ntok END AS ntok,
               s.pos = b.pos OR coalesce(s.nxt = b.gone, false) AS changed
        FROM step s JOIN best b USING (word) WHERE s.pos <> b.gone
    )
    SELECT n.word, n.pos, n.nxt, n.tok, n.ntok, CASE WHEN changed THEN m.merged ELSE n.merged END, n.level
    FROM after n LEFT JOIN merges m ON m.a = CASE WHEN changed THEN n.tok END AND m.b = n.ntok)
"""
    + _END
)

#: For longer words: all copies of a calm pair in one step.
_ENCODE_LONG = (
    """
WITH RECURSIVE step(word, pos, tok, level) AS (
    SELECT word, pos, tok, 0 FROM start
  UNION ALL
    SELECT word, pos, tok, level FROM (
        WITH pairs AS (  -- token positions joined, beside their right neighbours, with the merges
            SELECT s.word, s.pos, s.rn, s.tok, s.level, m.merged, m.calm,
                   min(m.merged) OVER (PARTITION BY s.word) AS low
            FROM (SELECT *, lead(tok) OVER w AS nxt, row_number() OVER w AS rn FROM step
                  WINDOW w AS (PARTITION BY word ORDER BY pos)) s
            LEFT JOIN own_merges m ON m.a = s.tok AND m.b = s.nxt
        ), marked AS (  -- pairs of the word's lowest rank; place: from the last position without one
            SELECT word, pos, tok, level, merged, calm, merged IS NOT DISTINCT FROM low AS hit,
                   rn - coalesce(max(CASE WHEN merged IS DISTINCT FROM low THEN rn END) OVER w, 0) AS place,
                   count(CASE WHEN merged IS NOT DISTINCT FROM low THEN 1 END) OVER w AS nth
            FROM pairs WHERE low IS NOT NULL AND level < $1
            WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING)
        ), chosen AS (  -- of overlapping copies, every other one from the left
            SELECT *, hit AND (CASE WHEN calm THEN place % 2 = 1 ELSE nth = 1 END) AS take FROM marked
        ), swallowed AS (
            SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone
            FROM chosen
        )
        SELECT word, pos, CASE WHEN take THEN merged ELSE tok END AS tok, level + 1 AS level
        FROM swallowed WHERE NOT gone
    )
"""
    + _END
)

#: The merges that a part can take, whose bytes are its own, and which of them are calm.
_OWN = """
CREATE OR REPLACE TEMP TABLE own_merges AS
WITH own AS (SELECT m.* FROM merges m SEMI JOIN can ON can.tok = m.merged),
least AS (SELECT tok, min(merged) AS low FROM (SELECT a AS tok, merged FROM own UNION ALL SELECT b, merged FROM own) GROUP BY tok)
SELECT o.a, o.b, o.merged, coalesce(l.low > o.merged, true) AS calm
FROM own o LEFT JOIN least l ON l.tok = o.merged
"""

_DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS decoded
FROM tokens t JOIN vocabulary v ON v.id = t.tok GROUP BY t.doc
"""


def ascii_form(pattern: str) -> str | None:
    """The pattern for texts of ASCII alone, for the quicker module re; None where it isn't known."""
    sets = {"L": "A-Za-z", "N": "0-9", "s": r"\x09-\x0d\x20"}
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            found = re.match(r"\\p\{([LN])\}|\\([sS])", pattern[i:])
            if not found or (inside and found[2] == "S"):
                return None
            kind = found[1] or found[2]
            out.append(sets[kind.replace("S", "s")] if inside else f"[{'^' * (kind == 'S')}{sets[kind.replace('S', 's')]}]")
            i += found.end()
            continue
        if c in "[]":
            inside = c == "["
        out.append(c)
        i += 1
    return "".join(out)


class Codec:
    """The ranks, and a DuckDB database with the merge table and the vocabulary for one partition."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import regex

        self.ranks = ranks
        self.any_text = regex.compile(pattern).findall
        plain = ascii_form(pattern)
        self.ascii_text = re.compile(plain).findall if plain else self.any_text
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        #: Pre-token to its ids joined by commas, a semicolon and the bytes that these decode to, in one object
        #: since that takes less memory; the last two generations.
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0
        self.token = {rank: data for data, rank in ranks.items()}
        self.prefixes: set[bytes] = set()
        self.db = None

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return self.ascii_text(text) if text.isascii() else self.any_text(text)

    def open(self) -> "Codec":
        """Make the database; close() gives its memory back, what is remembered stays."""
        import tempfile

        import duckdb

        # only a part of more than some 100,000 bytes exceeds the limit; it then spills, until close()
        self.spill = tempfile.TemporaryDirectory(prefix="lodestone-bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": self.spill.name})
        # tables to the right are built and those to the left run through: sorted rows stay in order
        self.db.execute("SET disabled_optimizers='build_side_probe_side'")
        rows = merge_rows(self.ranks)
        table = pa.table([pa.array(c, pa.int32()) for c in zip(*rows)] or [pa.array([], pa.int32())] * 3, ["a", "b", "merged"])
        self.db.register("raw", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM raw")
        self.db.unregister("raw")
        words = pa.table([pa.array(list(self.ranks.values()), pa.int32()), pa.array([t.hex() for t in self.ranks])], ["id", "hex"])
        self.db.register("raw", words)
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, CAST(id AS VARCHAR) AS name, hex FROM raw")
        self.db.unregister("raw")
        return self

    def close(self) -> None:
        self.db.close()
        self.db = None
        self.spill.cleanup()

    def contract(self, words: list[bytes]) -> Iterator[tuple[bytes, str, bytes]]:
        """(word, its ids joined by commas, the bytes they decode to), by the recursive query."""
        import numpy as np

        short = all(len(w) < LONG for w in words)
        if not short:
            held = set().union(*words)
            can = pa.table([pa.array([rank for t, rank in self.ranks.items() if held.issuperset(t)], pa.int32())], ["tok"])
            self.db.register("can", can)
            self.db.execute(_OWN)
            self.db.unregister("can")
        number = np.arange(len(words))
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        tok = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        while len(number):
            word = np.repeat(np.arange(len(number), dtype=np.int32), lengths)
            pos = np.arange(len(word), dtype=np.int32) - np.repeat(np.cumsum(lengths) - lengths, lengths).astype(np.int32)
            last = np.append(word[1:] != word[:-1], True)
            following = [pa.array(pos + 1, mask=last), pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last)]
            self.db.register("start", pa.table([pa.array(word), pa.array(pos), pa.array(tok), *following], ["word", "pos", "tok", "nxt", "ntok"]))
            # a recursion keeps the rows of all its steps, so long words take several
            levels = max(4, STEP_ROWS // max(1, len(word)))
            again = []
            for i, ids, decoded, unfinished in self.db.execute(_ENCODE if short else _ENCODE_LONG, [levels]).fetchall():
                if unfinished:
                    again.append((number[i], np.array(ids.split(","), dtype=np.int32)))
                    continue
                data = bytes.fromhex(decoded)
                if data != words[number[i]]:
                    raise RuntimeError(f"ids {ids} do not decode to {words[number[i]]!r}")
                yield words[number[i]], ids, data
            self.db.unregister("start")
            number = np.array([i for i, _ in again], dtype=np.int64)
            lengths = np.array([len(ids) for _, ids in again], dtype=np.int64)
            tok = np.concatenate([ids for _, ids in again]) if again else tok[:0]

    def parts(self, data: bytes) -> list[bytes]:
        """A pre-token cut where no token that occurs in it reaches across."""
        if len(data) < LONG or len(set(data)) <= 8:  # runs of few bytes have hardly a cut, but long tokens
            return [data]
        if not self.prefixes:
            self.prefixes = {t[:i] for t in self.ranks for i in range(2, len(t) + 1)}
        out, start, reach = [], 0, 1
        for s in range(len(data)):
            if s >= reach:
                out.append(data[start:s])
                start = s
            e = s + 2
            while e <= len(data) and (piece := data[s:e]) in self.prefixes:
                if e > reach and piece in self.ranks:
                    reach = e
                e += 1
            reach = max(reach, s + 1)
        return [*out, data[start:]]

    def learn(self, parts: set[str]) -> None:
        """Encode pre-tokens not met before."""
        new = [p for p in parts if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED or self.chars > REMEMBERED_CHARS:  # the last generation stays at hand
            self.old, self.known, self.chars = self.known, {}, 0
            new = list(parts)
        self.chars += sum(map(len, new))
        words, cut = [], {}
        for p in new:
            if (held := self.old.get(p)) is not None:
                self.known[p] = held
                continue
            word = p.encode("utf-8", "replace")
            rank = self.ranks.get(word)
            if rank is not None:
                self.known[p] = b"%d;%b" % (rank, self.token[rank])
            elif len(word) < LONG:
                words.append((p, word))
            else:
                cut[p] = self.parts(word)
        ids, data = self.contracted({w for _, w in words}.union(*cut.values()))
        for p, w in words:
            self.known[p] = b"%b;%b" % (ids[w].encode(), data[w])
        for p, these in cut.items():
            self.known[p] = b"%b;%b" % (",".join(map(ids.__getitem__, these)).encode(), b"".join(map(data.__getitem__, these)))

    def contracted(self, words: set[bytes]) -> tuple[dict[bytes, str], dict[bytes, bytes]]:
        """Each word's ids and what they decode to; short words share queries."""
        ids, data = {}, {}
        batches, size = [[]], 0
        for w in words:
            if len(w) >= LONG:
                batches.insert(0, [w])
                continue
            if size > QUERY_BYTES:
                batches.append([])
                size = 0
            batches[-1].append(w)
            size += len(w)
        for batch in batches:
            for w, i, d in self.contract(batch):
                ids[w], data[w] = i, d
        return ids, data

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text, its ids joined by commas, and the bytes that these ids decode to."""
        split = [self.split(t) for t in texts]
        every = set().union(*split) if split else set()
        self.learn(every)
        cut = {p: self.known[p].partition(b";")[::2] for p in every}
        for parts in split:
            ids, data = zip(*map(cut.__getitem__, parts)) if parts else ((), ())
            yield b",".join(ids).decode(), b"".join(data)

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, by ordered aggregation over joined positions."""
        import numpy as np

        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        doc = np.repeat(np.arange(len(ids)), lengths)
        pos = np.arange(len(doc))
        tok = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=len(doc))
        self.db.register("tokens", pa.table([pa.array(doc), pa.array(pos), pa.array(tok)], ["doc", "pos", "tok"]))
        out = [b""] * len(ids)
        for i, decoded in self.db.execute(_DECODE).fetchall():
            out[i] = bytes.fromhex(decoded)
        self.db.unregister("tokens")
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec_for(path: str, pattern: str, ranks) -> Codec:
    """This worker process's codec; what it remembers serves the partitions that follow.

    ranks: a broadcast of the vocabulary's ranks, so that only the driver reads the file.
    """
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(ranks.value, pattern)
    return _codecs[path, pattern].open()


def encode(docs: DataFrame, path: str, pattern: str, digest: bool = False) -> DataFrame:
    """Encode every whole text.

    Returns doc_id, n_tokens and ids (array<int>); with ``digest``, instead of the ids, the
    SHA-256 of the decimal ids joined by commas and of the decoded bytes.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        with closing(codec_for(path, pattern, ranks)) as codec:
            for ids, texts in pieces(batches, ["doc_id", "text"], 1_500_000):
                counts, left, right = [], [], []
                for joined, data in codec.encode([text_of(t) for t in texts]):
                    counts.append(joined.count(",") + 1 if joined else 0)
                    if digest:
                        left.append(hashlib.sha256(joined.encode()).hexdigest())
                        right.append(hashlib.sha256(data).hexdigest())
                    else:
                        left.append([int(x) for x in joined.split(",")] if joined else [])
                cols = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64())]
                if digest:
                    yield pa.record_batch([*cols, pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.record_batch([*cols, pa.array(left, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    rest = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, f"doc_id long, n_tokens long, {rest}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every list of ids: doc_id, data. A null list decodes to no bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        with closing(codec_for(path, pattern, ranks)) as codec:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    ids = [x or [] for x in part.column(1).to_pylist()]
                    yield pa.record_batch([part.column(0), pa.array(codec.decode(ids), pa.binary())], ["doc_id", "data"])

    return arrow_map(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, data binary")
