"""Token files, periodic runs and alignment against the libraries, brute force and round trips, with hard inputs."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries as Q

HARD = [(5, None), (None, "x y"), (3, ""), (3, ""), (7, "<|endoftext|> and  <s> x▁y"), (8, "naïve 🙂 日本語\t\n\n  x " * 40), (9, "a" * 4000), (10, "ab" * 900 + " c"), (2, "the end. " * 300), (2, "the end. " * 299), (11, "don't 's 12345  \r\n ...")]


@pytest.fixture(scope="module")
def hard(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(HARD, "doc_id long, text string")
    for name in ("ids", "key", "row", "pair", "scale", "start"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def expected_files(docs):
    tok, at, out = library(), 0, []
    ids = [(d, [*e.ids, 2]) for (d, _), e in zip(docs, tok.encode_batch([t or "" for _, t in docs], add_special_tokens=False))]
    for d, x in ids:
        out.append((d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    return out


def test_token_files_equal_the_library(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = Q.QUERIES["op11_token_files"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == expected_files(docs)


def test_token_files_of_hard_rows(spark, hard, empty, tmp_path):
    from lodestone.llm.token_files import read, write

    path = P.path("byte_bpe_50k.json")
    write(hard, f"{tmp_path}/a", path, P.PATTERN, end=2)
    got = read(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(HARD)
    tok = library()
    want = Counter((d, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in HARD)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    write(empty, f"{tmp_path}/b", path, P.PATTERN, end=2)
    assert read(spark, f"{tmp_path}/b").collect() == []


def test_codes_round_trip():
    from lodestone.llm.token_files import STEP, packed_ids, unpacked_ids

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 17, 1000, 4 * STEP + 3):
        x = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) >> r.integers(0, 32, n, dtype=np.uint32)
        control, data = packed_ids(x)
        assert len(control) == -(-n // 4) and len(data) == int(sum(1 if v < 1 << 8 else 2 if v < 1 << 16 else 3 if v < 1 << 24 else 4 for v in x.tolist()))
        for k, v in enumerate(x[:20].tolist()):
            assert (control[k // 4] >> 2 * (k % 4)) & 3 == max(0, (v.bit_length() - 1) // 8)
        same = unpacked_ids(control, data, n, _Same())
        assert (same == x).all()


class _Same:
    """A table of ids in which every rank is itself."""

    def __getitem__(self, ranks):
        return ranks


def test_remembered_parts_equal_whole_texts():
    import sentencepiece
    from lodestone.llm import byte_tokens
    from lodestone.llm.alignment import PieceTokenizer

    r = random.Random(3)
    texts = ["".join(r.choice("ab 's'12é\n\t .,日🙂  \x1c\x85\xa0") for _ in range(r.randint(0, 60))) for _ in range(1500)] + [t or "" for _, t in HARD]
    tok = library()
    ours = byte_tokens.ByteTokenizer(byte_tokens.read_text(P.path("byte_bpe_50k.json")), True, P.PATTERN)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        ours_b = PieceTokenizer(f.read())
    for k in range(0, len(texts), 400):
        part = texts[k : k + 400]
        flat, many, _ = ours.encode(part)
        assert [x.tolist() for x in np.split(flat, np.cumsum(many)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in part]
        flat, many, fits = ours_b.encode([" " + t if t else "" for t in part])
        for t, x, ok in zip(part, np.split(flat, np.cumsum(many)[:-1]), fits):
            whole = sp.encode(t)
            data = b"".join(bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in whole)
            assert ok == (data == (" " + t if t else "").encode())
            assert not ok or x.tolist() == whole


def plain_runs(w):
    """Every period, every stretch."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic_texts(seed, many):
    r, out = random.Random(seed), []
    for _ in range(many):
        w = []
        while len(w) < r.randint(0, 500):
            k = r.random()
            if k < 0.4:
                u = [f"u{r.randint(0, r.choice([1, 2, 5]))}" for _ in range(r.randint(1, r.choice([3, 20, 70])))]
                w += (u * r.randint(1, 9))[: r.randint(1, 300)]
            elif k < 0.7:
                w += [f"w{r.randint(0, 30)}" for _ in range(r.randint(1, 40))]
            elif w:
                w += w[r.randint(0, len(w)) :]
        out.append(w)
    return out


def test_periodic_runs_equal_every_stretch(spark):
    from lodestone.llm.periods import periodic_runs

    own = dict(enumerate(periodic_texts(5, 150))) | {1000: ["a"] * 5000, 1001: ["a", "b"] * 700 + ["c"] + ["a", "b"] * 700, 1002: []}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in own.items()], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in periodic_runs(df, lambda doc, words: words).collect()}
    assert len(got) == len(own)
    some = 0
    for i, w in own.items():
        runs = plain_runs(w) if i < 1000 else [(0, 5000, 1)] if i == 1000 else [(0, 1400, 2), (1401, 1400, 2)] if i == 1001 else []
        some += len(runs)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        r = got[i]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, q, 1000 * n // q)
        else:
            assert r["start"] is None and r["exponent_milli"] is None
    assert some > 60


def test_periodic_runs_of_hard_rows(spark, hard, empty):
    from lodestone.llm.periods import periodic_runs, repeated_tail

    rows = periodic_runs(hard, repeated_tail).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in HARD)
    nothing = hashlib.sha256(b"").hexdigest()
    assert all((r["n_runs"], r["collapsed_sha256"]) == (0, nothing) for r in rows if r["doc_id"] in (3, 5))
    assert sorted((r["start"], r["length"], r["period"]) for r in rows if r["doc_id"] == 2) == [(0, 598, 2), (0, 600, 2)]
    assert periodic_runs(empty, repeated_tail).collect() == []


def test_tails_repeat_by_the_id():
    from lodestone.llm.periods import repeated_tail

    words = [b"w%d" % i for i in range(50)]
    changed = 0
    for doc in range(400):
        h = zlib.crc32(str(doc).encode())
        got = repeated_tail(doc, words)
        if h % 10:
            assert got == words
            continue
        changed += 1
        a, p = (h // 10) % 50, 1 + (50 - (h // 10) % 50) // (3 + h // 10 % 8)
        assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert changed > 20 and repeated_tail(None, []) == []


def plain_alignment(docs):
    """A walk along both tokenizers' ends for every document, and counts over all."""
    import sentencepiece
    from lodestone.llm.alignment import byte_of_character

    tok, code = library(), byte_of_character()
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    per, counts = [], Counter()
    for _, t in docs:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        x = [bytes(code[c] for c in tok.id_to_token(i)) for i in a]
        y = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(x) == b"".join(y) == (" " + t).encode():
            per.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(v) for v in x]), np.cumsum([len(v) for v in y])
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            n, m = int((ends_a <= end).sum()), int((ends_b <= end).sum())
            groups.append(",".join(map(str, a[i:n])) + "|" + ",".join(map(str, b[j:m])))
            for k in range(i, n):
                for z in range(j, m):
                    if ends_a[k] - len(x[k]) < ends_b[z] and ends_b[z] - len(y[z]) < ends_a[k]:
                        links.append((a[k], b[z]))
            i, j = n, m
        per.append((len(a), len(b), groups, links))
        counts.update(links)
    top = {}
    for (_, z), n in counts.items():
        top[z] = max(top.get(z, 0), n)
    rows = []
    for (d, _), p in zip(docs, per):
        if p is None:
            rows.append((d, 0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((d, p[0], p[1], len(p[2]), len(p[3]), sum(counts[v] == top[v[1]] for v in p[3]), sum(counts[v] for v in p[3]), hashlib.sha256(";".join(p[2]).encode()).hexdigest()))
    return rows, counts


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_alignment_equals_a_plain_walk(spark, hard, sf, head):
    """With no pair, some and all of them among the broadcast ones."""
    from lodestone.llm.alignment import cross_alignment

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + HARD
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pair", F.lit("clash")).repartition(3)
    want, counts = plain_alignment(docs)
    assert len(counts) > 1000
    got = cross_alignment(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, head=head)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want)


def test_alignment_of_no_rows(spark, empty):
    from lodestone.llm.alignment import cross_alignment

    assert cross_alignment(empty, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).collect() == []


def test_shared_cuts_are_found_however_sparse():
    from lodestone.llm.alignment import shared_cuts

    r = np.random.default_rng(7)
    for n, keep in [(1, 1.0), (2, 0.5), (50, 0.5), (3000, 0.01), (3000, 0.0), (40_000, 0.0002)]:
        for _ in range(5):
            a = np.cumsum(r.integers(1, 4, n))
            b = np.unique(np.concatenate([a[r.random(n) < keep], np.setdiff1d(r.integers(1, a[-1] + 1, n // 2), a), a[-1:]]))
            cuts = shared_cuts(a, b, np.array([0]), np.array([n - 1]))
            assert cuts.tolist() == np.flatnonzero(np.isin(a[:-1], b)).tolist()


def test_pretokens_are_encoded_once():
    """240,000 words, met twice: what is remembered is small enough that they stay at hand."""
    import public_tokenizers as P
    from lodestone.llm.bpe import Codec, read_ranks

    asked = []

    class Counted(Codec):
        def contracted(self, words):
            asked.append(len(words))
            return super().contracted(words)

    codec = Counted(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN).open()
    words = [" " + "".join("qxzjvkwp"[n >> 3 * k & 7] for k in range(6)) for n in range(240_000)]
    texts = ["".join(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    first = [x for t in texts for x in codec.encode([t])]
    many = sum(asked)
    assert many > 200_000 and [x for t in texts for x in codec.encode([t])] == first
    assert sum(asked) == many and [d.decode() for _, d in first] == texts
    codec.close()


def test_token_files_remember_more_than_the_alignment(spark, monkeypatch):
    """A worker that holds one tokenizer keeps its parts where one that holds two would start anew."""
    import public_tokenizers as P
    import pyarrow as pa
    from lodestone.llm import byte_tokens as B, token_files

    monkeypatch.setattr(B, "REMEMBERED", 100)
    path, made = P.path("byte_bpe_50k.json"), []

    def caught(rows, run, schema):
        made.append(run)
        return rows

    monkeypatch.setattr(token_files, "arrow_map", caught)
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    token_files.encoded(docs, path, P.PATTERN, 2, 60_000)
    tok = B.tokenizer_for(path, True, P.PATTERN, type("Held", (), {"value": B.read_text(path)}))
    tok.forget()
    texts = [" ".join(f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(150)), "once more"]
    batch = [pa.record_batch([pa.array([n]), pa.array([t])], ["doc_id", "text"]) for n, t in enumerate(texts)]
    list(made[0](iter(batch)))
    assert len(tok.index) > 150
