"""Ids of texts by the tokenizers library, with each worker's known pre-tokens kept at hand.

The library splits a text into pre-tokens and encodes each by itself. Here the split is the same
pattern's, the library encodes every distinct pre-token once, and ids of whole texts are gathered
with numpy. A text that holds a special token's string, where those count, is left to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens, and characters of pre-tokens, that are remembered at most; then memory starts anew.
REMEMBERED = 600_000
REMEMBERED_CHARS = 12_000_000
#: So many times as much where one tokenizer is all that a worker holds.
ALONE = 2


def latin_form(plain: str) -> str:
    """ascii_form()'s pattern for texts of which LATIN is all, with their letters, numbers and white space in its sets."""
    held: dict[str, list[int]] = {"L": [], "N": []}
    for c in range(0x80, LATIN_END):
        held.setdefault(unicodedata.category(chr(c))[0], []).append(c)

    def ranges(codes: list[int]) -> str:
        out, k = "", 0
        while k < len(codes):
            e = k
            while e + 1 < len(codes) and codes[e + 1] == codes[e] + 1:
                e += 1
            out += chr(codes[k]) + ("-" + chr(codes[e]) if e > k else "")
            k = e + 1
        return out

    wide = plain.replace("A-Za-z", "A-Za-z" + ranges(held["L"])).replace("0-9", "0-9" + ranges(held["N"]))
    return wide.replace(r"\x09-\x0d\x20", r"\x09-\x0d\x20\x85\xa0")


#: Characters of Latin texts: those below LATIN_END, and dashes, quotes and currency signs, which are neither letters, numbers nor white space.
LATIN_END = 0x250
LATIN = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


class _Index(dict):
    """Numbers of keys in the order of their first use; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Remembered:
    """Ids of texts from parts that a tokenizer encodes each by itself: every distinct part is encoded once and kept.

    A subclass has split(text), a text's parts; joins(part), whether parts may stand side by side in one text, which
    is then split between them again; joined(parts) and apart(parts), their ids together and each; sizes, bytes of
    every id; and whole(text), whether a text is left to whole_ids(text).
    """

    #: How many times REMEMBERED and REMEMBERED_CHARS are kept.
    times = 1

    def forget(self) -> None:
        import numpy as np

        self.index, self.chars = _Index(), 0
        self.pool, self.starts, self.lengths, self.fits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def learn(self) -> None:
        """Encode the parts noted since; those that may stand side by side make one result, cut by the bytes that ids and parts have."""
        import numpy as np

        new, self.index.new = self.index.new, []
        if not new:
            return
        near = [n for n, t in enumerate(new) if self.joins(t)]
        flat, lengths = np.zeros(0, np.uint32), np.zeros(len(new), np.int64)
        if near:
            words = [new[n] for n in near]
            flat = np.array(self.joined(words), np.uint32)
            ends = np.cumsum(pc.binary_length(pa.array(words, pa.string())).to_numpy().astype(np.int64))
            reached = np.cumsum(self.sizes[flat])
            cuts = np.searchsorted(reached, ends)
            if len(reached) and reached[-1] == ends[-1] and (reached[np.minimum(cuts, len(reached) - 1)] == ends).all():
                lengths[near] = np.diff(cuts + 1, prepend=0)
            else:  # not a split that keeps parts whole
                near, flat = [], flat[:0]
        alone = np.ones(len(new), bool)
        alone[near] = False
        rest = np.flatnonzero(alone)
        ids = self.apart([new[n] for n in rest.tolist()]) if len(rest) else []
        lengths[rest] = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = np.empty(len(new), np.int64)
        order = np.concatenate([np.array(near, np.int64), rest])  # as their ids lie in the pool
        starts[order] = len(self.pool) + np.cumsum(lengths[order]) - lengths[order]
        self.pool = np.concatenate([self.pool, flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths[rest].sum()))])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])
        if self.data is not None:  # whether a part's ids give back its bytes; parts side by side are compared at once
            byte = self.data.__getitem__
            good = np.ones(len(new), bool)
            doubtful = rest.tolist()
            if near and b"".join(map(byte, flat.tolist())) != "".join(words).encode():
                doubtful = range(len(new))
            for n in doubtful:
                at = starts[n]
                good[n] = b"".join(map(byte, self.pool[at : at + lengths[n]].tolist())) == new[n].encode()
            self.fits = np.concatenate([self.fits, good])
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str]):
        """All ids in one array (uint32), how many each text has, and whether each text's ids give back its bytes (where ``data`` is known)."""
        import numpy as np

        if len(self.index) > self.times * REMEMBERED or self.chars > self.times * REMEMBERED_CHARS:
            self.forget()
        whole = {n for n, t in enumerate(texts) if self.whole(t)}
        parts = [[] if n in whole else self.split(t) for n, t in enumerate(texts)]
        many = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(many.sum()))
        del parts
        self.learn()
        counts = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(counts)])
        flat = self.pool[np.repeat(self.starts[at] - upto[:-1], counts) + np.arange(upto[-1])]
        of = np.concatenate([[0], np.cumsum(many)])
        edges = upto[of]
        fits = None
        if self.data is not None:
            bad = np.concatenate([[0], np.cumsum(~self.fits[at])])
            fits = bad[of[1:]] == bad[of[:-1]]
        if not whole:
            return flat, np.diff(edges), fits
        out = [np.array(self.whole_ids(t), np.uint32) if n in whole else flat[edges[n] : edges[n + 1]] for n, t in enumerate(texts)]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64), fits


class ByteTokenizer(Remembered):
    """A byte-level BPE tokenizer file (its JSON text); ``special``: special tokens' strings in texts are those tokens."""

    def __init__(self, data: str, special: bool, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        from .bpe import ascii_form

        before = json.loads(data)["pre_tokenizer"]
        if before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
            raise ValueError("not a byte-level tokenizer without prefix space")
        self.library = Tokenizer.from_str(data)
        self.library.encode_special_tokens = not special
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.any_text = regex.compile(pattern).findall
        plain = ascii_form(pattern)
        self.ascii_text = re.compile(plain).findall if plain else self.any_text
        self.latin_text = re.compile(latin_form(plain)).findall if plain else self.any_text
        vocabulary = self.library.get_vocab()
        #: Bytes of every id: its text has a character for each. Byte-level ids always give back a text.
        self.sizes, self.data = np.zeros(1 + max(vocabulary.values()), np.int64), None
        for t, i in vocabulary.items():
            self.sizes[i] = len(t)
        self.forget()

    def split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_text(text)
        return self.any_text(text) if LATIN.search(text) else self.latin_text(text)

    def joins(self, part: str) -> bool:
        """One space, and more without another."""
        return part[0] == " " and len(part) > 1 and not part[1].isspace()

    def joined(self, parts: list[str]) -> list[int]:
        return self.library.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids

    def apart(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(parts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def whole_ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


_tokenizers: dict[tuple[str, bool], ByteTokenizer] = {}


def tokenizer_for(path: str, special: bool, pattern: str, data) -> ByteTokenizer:
    """This worker process's tokenizer. data: a broadcast of the file's text, so that only the driver reads it."""
    if (path, special) not in _tokenizers:
        _tokenizers[path, special] = ByteTokenizer(data.value, special, pattern)
    return _tokenizers[path, special]


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
