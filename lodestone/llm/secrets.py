"""Secret scans with built-in expressions only.

Base kinds are patterns (assign, access, hex). The method adds spans of high entropy: candidates
are runs of a character class (entropy_hex: hexadecimal digits of either case; entropy_text:
letters, digits and + / _ -) of at least WINDOW characters that hold a digit and a letter. A window
of WINDOW characters slides over the candidate; its character counts change by one character in and
one out, and so does the sum of count * log2(count), held as an integer in units of 2**-20 bit so
that it is exact. Windows of at least the class's entropy are flagged and overlapping ones merged.
Candidates that are an allowed value as a whole are passed over; allowed parts are cut out before
candidates are looked for, so that what stands beside them is judged by itself. Of flagged spans, the parts that no
span of an earlier kind covers are added, so that text beside a base match does not stay.

Runs of few characters seldom reach what entropy_text asks for. So the candidates of entropy_text
are searched again for the runs of each narrower class (NARROW), which + / _ - and characters of
other classes end, and each class has its own least entropy: what at least 99 % of random strings of
WINDOW characters reach. To leave names and paths alone, a run must also change between letters and
digits, or from lower to upper case, once in every CHANGES characters.

Positions come from the lengths of what lies between the matches, summed up in two levels, so that
texts with many matches stay linear.

Nulls: a null text counts as empty and has no spans. Repeated rows are scanned each. Other columns
are passed by. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

WINDOW = 20
#: Base kinds in their order: pattern, group whose length counts, least length.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Entropy kinds: pattern of candidates, alphabet, least bits a character in a window.
CLASSES = {
    "entropy_hex": (r"(?<![A-Za-z0-9+/_-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_-])", "0123456789abcdefABCDEF", 3.0),
    "entropy_text": (r"[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.9),
}
#: Narrower kinds, within candidates of entropy_text: pattern of runs, alphabet, least bits a character in a window, what a run must hold.
_BOTH = ("[a-z]", "[A-Z]")
NARROW = {
    "random_hex": (r"[0-9a-fA-F]{20,}", CLASSES["entropy_hex"][1], 2.85, ()),
    "random_base32": (r"[A-Z2-7]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 3.25, ()),
    "random_lower": (r"[a-z0-9]{20,}", "abcdefghijklmnopqrstuvwxyz0123456789", 3.35, ()),
    "random_upper": (r"[A-Z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.35, ()),
    "random_alnum": (r"[A-Za-z0-9]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.6, _BOTH),
    "random_text": (CLASSES["entropy_text"][0], CLASSES["entropy_text"][1], 3.6, _BOTH),
}
CHANGES = 12
_CHANGE = r"[a-z](?=[A-Z])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
#: Candidates that are one of these as a whole are no secrets: UUIDs, known digests.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(d41d8cd98f00b204e9800998ecf8427e|da39a3ee5e6b4b0d3255bfef95601890afd80709)$",
)
#: Parts that belong to no candidate, with their lengths: words of examples, runs in order.
ALLOWED_PARTS = {r"[Ee][Xx][Aa][Mm][Pp][Ll][Ee]": 7, r"0123456789": 10, r"abcdefghijkl|ABCDEFGHIJKL": 12}
KINDS = [*BASE, *CLASSES, *NARROW]
UNIT = 1 << 20


def quoted(s: str) -> str:
    """A Spark SQL literal; raw, so that backslashes stay."""
    if "'" not in s:
        return f"r'{s}'"
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in s.split("'")) + ")"


def weights() -> list[int]:
    """count * log2(count) for 0 to WINDOW, in units."""
    return [0] + [round(c * math.log2(c) * UNIT) for c in range(1, WINDOW + 1)]


def running(g: str, block: int = 128) -> str:
    """SQL of the running sums of an int array: within blocks, after the sums of whole blocks."""
    chunks = f"transform(sequence(0, (size({g}) - 1) div {block}), c -> slice({g}, c * {block} + 1, {block}))"
    before = f"aggregate({chunks}, named_struct('t', 0, 'r', cast(array() as array<int>)), (a, x) -> named_struct('t', a.t + aggregate(x, 0, (u, v) -> u + v), 'r', concat(a.r, array(a.t))), a -> a.r)"
    inner = "aggregate(x, named_struct('t', o, 'r', cast(array() as array<int>)), (a, v) -> named_struct('t', a.t + v, 'r', concat(a.r, array(a.t + v))), a -> a.r)"
    return f"flatten(zip_with({chunks}, {before}, (x, o) -> {inner}))"


def gaps(found: str, pattern: str, text: str = "_t") -> str:
    """SQL of the distance of each match's start from the start of the one before."""
    return f"slice(zip_with(transform(split({text}, {pattern}, -1), p -> length(p)), concat(array(0), transform({found}, m -> length(m))), (p, m) -> p + m), 1, size({found}))"


def flagged(candidate: str, alphabet: str, least: float) -> str:
    """SQL of the merged flagged windows of a candidate, as structs of start and end."""
    f = "array(" + ", ".join(f"{w}L" for w in weights()) + ")"
    most = round(WINDOW * math.log2(WINDOW) * UNIT) - math.ceil(least * WINDOW * UNIT)
    codes = f"transform(regexp_extract_all({candidate}, '.', 0), ch -> instr('{alphabet}', ch) - 1)"
    # an array of one array, so that the codes are made once
    steps = f"transform(array({codes}), q -> zip_with(q, slice(concat(array_repeat(-1, {WINDOW}), q), 1, size(q)), (a, b) -> named_struct('i', a, 'o', b)))[0]"
    change = f"if(x.i = x.o, 0L, {f}[a.c[x.i] + 1] - {f}[a.c[x.i]] + if(x.o < 0, 0L, {f}[a.c[greatest(x.o, 0)] - 1] - {f}[a.c[greatest(x.o, 0)]]))"
    counts = "if(x.i = x.o, a.c, transform(a.c, (v, k) -> v + if(k = x.i, 1, 0) - if(k = x.o, 1, 0)))"
    flag = f"(a.n + 1 >= {WINDOW} AND a.s + ({change}) <= {most}L)"
    begin = f"a.n + 1 - {WINDOW}"
    start = f"named_struct('n', 0, 'c', array_repeat(0, {len(alphabet)}), 's', 0L, 'b', -1, 'e', -1, 'r', cast(array() as array<struct<b:int,e:int>>))"
    step = (
        f"named_struct('n', a.n + 1, 'c', {counts}, 's', a.s + ({change}),"
        f" 'b', if({flag} AND (a.b < 0 OR {begin} > a.e), {begin}, a.b), 'e', if({flag}, a.n + 1, a.e),"
        f" 'r', if({flag} AND a.b >= 0 AND {begin} > a.e, concat(a.r, array(named_struct('b', a.b, 'e', a.e))), a.r))"
    )
    return f"aggregate({steps}, {start}, (a, x) -> {step}, a -> if(a.b >= 0, concat(a.r, array(named_struct('b', a.b, 'e', a.e))), a.r))"


def beside(cover: str, new: str, kind: str) -> str:
    """SQL of the parts of the spans ``new`` (apart from one another) that no span of ``cover`` covers, in one sweep over both.

    t: how far the cover has reached; b, e: what is left of the latest new span; r: parts so far.
    """
    part = lambda a, b: f"concat(a.r, array(named_struct('s', {a}, 'k', {kind}, 'e', {b})))"
    both = f"array_sort(concat(transform({cover}, x -> named_struct('s', x.s, 'new', false, 'e', x.e)), transform({new}, x -> named_struct('s', x.s, 'new', true, 'e', x.e))))"
    starts = f"named_struct('t', a.t, 'b', greatest(x.s, a.t), 'e', x.e, 'r', if(a.b < a.e, {part('a.b', 'a.e')}, a.r))"
    covers = f"named_struct('t', greatest(a.t, x.e), 'b', if(x.s < a.e, greatest(a.b, x.e), a.b), 'e', a.e, 'r', if(x.s < a.e AND a.b < x.s, {part('a.b', 'x.s')}, a.r))"
    return f"aggregate({both}, named_struct('t', 0, 'b', 0, 'e', 0, 'r', {_NONE}), (a, x) -> if(x.new, {starts}, {covers}), a -> if(a.b < a.e, {part('a.b', 'a.e')}, a.r))"


_SPANS = "array<struct<s:int,k:int,e:int>>"
_NONE = f"cast(array() as {_SPANS})"


def spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """The rows with _base and _all: arrays of spans (s, k: number in KINDS, e), in order."""
    d = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    bare = "_t"  # spaces of the same length end candidates and keep places
    for pattern, length in ALLOWED_PARTS.items():
        bare = f"regexp_replace({bare}, '{pattern}', '{' ' * length}')"
    d = d.withColumn("_u", F.expr(f"if(_t rlike '{'|'.join(ALLOWED_PARTS)}', {bare}, _t)"))
    d = d.select("*", *[F.expr(f"regexp_extract_all({'_t' if k in BASE else '_u'}, {quoted(p[0])}, 0)").alias(f"_m_{k}") for k, p in {**BASE, **CLASSES}.items()])
    starts = []
    for kind, (pattern, *_) in {**BASE, **CLASSES}.items():
        at = F.expr(f"if(size(_m_{kind}) = 0, cast(array() as array<int>), {gaps(f'_m_{kind}', quoted(pattern), '_t' if kind in BASE else '_u')})")
        starts.append(at.alias(f"_g_{kind}"))
    d = d.select("*", *starts, F.expr(f"if(size(_m_assign) = 0, cast(array() as array<string>), regexp_extract_all(_t, {quoted(BASE['assign'][0])}, 2))").alias("_v_assign"))
    d = d.select("*", *[F.expr(f"if(size(_m_{k}) = 0, cast(array() as array<int>), {running(f'_g_{k}')})").alias(f"_s_{k}") for k in [*BASE, *CLASSES]])
    found = []
    for n, (kind, (_, group, least)) in enumerate(BASE.items()):
        held = "_v_assign" if group else f"_m_{kind}"
        each = f"zip_with(zip_with(_m_{kind}, {held}, (m, v) -> named_struct('l', length(m), 'v', length(v))), _s_{kind}, (x, s) -> named_struct('s', s, 'k', {n}, 'e', s + x.l, 'v', x.v))"
        found.append(f"transform(filter({each}, x -> x.v >= {least}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))")
    d = d.withColumn("_base", F.expr(f"array_sort(concat({', '.join(found)}))"))
    allow = quoted("|".join(f"(?:{p})" for p in allowed)) if allowed else None
    held = "m.m rlike '[0-9]' AND m.m rlike '[A-Za-z]'" + (f" AND NOT m.m rlike {allow}" if allow else "")
    d = d.select("*", *[F.expr(f"filter(zip_with(_m_{k}, _s_{k}, (m, s) -> named_struct('m', m, 's', s)), m -> {held})").alias(f"_c_{k}") for k in CLASSES])
    runs = []
    for kind, (pattern, *_) in NARROW.items():
        p = quoted(pattern)
        found = f"regexp_extract_all(m.m, {p}, 0)"
        runs.append(F.expr(f"transform(_c_entropy_text, m -> named_struct('s', m.s, 'f', {found}, 'g', {gaps(found, p, 'm.m')}))").alias(f"_r_{kind}"))
    d = d.select("*", *runs)
    runs = []
    for kind, (*_, more) in NARROW.items():
        runs_held = f"{held} AND size(regexp_extract_all(m.m, '{_CHANGE}', 0)) * {CHANGES} >= length(m.m)" + "".join(f" AND m.m rlike '{c}'" for c in more)
        each = f"transform(filter(_r_{kind}, r -> size(r.f) > 0), r -> zip_with(r.f, {running('r.g')}, (f, o) -> named_struct('m', f, 's', r.s + o)))"
        runs.append(F.expr(f"filter(flatten({each}), m -> {runs_held})").alias(f"_c_{kind}"))
    d = d.select("*", *runs)
    found = []
    for n, (kind, (_, alphabet, least, *_)) in enumerate({**CLASSES, **NARROW}.items(), len(BASE)):
        found.append((kind, f"if(size(_c_{kind}) = 0, {_NONE}, flatten(transform(_c_{kind}, m -> transform({flagged('m.m', alphabet, least)}, r -> named_struct('s', m.s + r.b, 'k', {n}, 'e', m.s + r.e)))))"))
    d = d.select("*", *[F.expr(x).alias(f"_f_{k}") for k, x in found])
    # each character is the earliest kind's; one fold over all kinds, so that a pushed filter can't multiply it
    kinds = [*CLASSES, *NARROW]
    each = ", ".join(f"named_struct('k', {n}, 'f', _f_{kind})" for n, kind in enumerate(kinds, len(BASE)))
    none = " AND ".join(f"size(_f_{kind}) = 0" for kind in kinds)
    d = d.withColumn("_all", F.expr(f"if({none}, _base, array_sort(aggregate(array({each}), _base, (c, y) -> if(size(y.f) = 0, c, concat(c, {beside('c', 'y.f', 'y.k')})))))"))
    return d.drop(*[f"_{x}_{k}" for x in "mgscrf" for k in KINDS], "_v_assign", "_u")


def listed(column: str) -> str:
    """SQL of spans as kind:start:end, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, and the spans of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = [F.expr(f"cast(size(filter(_base, x -> x.k = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return spans(rows).select("doc_id", *counts, F.expr(f"sha2({listed('_base')}, 256)").alias("base_sha256"), F.expr(listed("_all")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced by ``mark``; all columns stay."""
    used = ["text", "n_chars"] if "n_chars" in docs.columns else ["text"]
    merged = (
        "aggregate(_all, cast(array() as array<struct<b:int,e:int>>), (a, x) -> if(size(a) > 0 AND element_at(a, -1).e > x.s,"
        " concat(slice(a, 1, size(a) - 1), array(named_struct('b', element_at(a, -1).b, 'e', greatest(element_at(a, -1).e, x.e)))),"
        " concat(a, array(named_struct('b', x.s, 'e', x.e)))))"
    )
    d = spans(packed(docs, *used)).withColumn("_cut", F.expr(merged))
    ends = "concat(array(0), transform(_cut, x -> x.e))"
    begins = "concat(transform(_cut, x -> x.b), array(length(_t)))"
    text = F.expr(f"if(size(_cut) = 0, text, array_join(zip_with({ends}, {begins}, (a, b) -> substring(_t, a + 1, b - a)), {quoted(mark)}))")
    out = d.withColumn("text", text)
    if "n_chars" in used:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.size("_cut") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return unpacked(out, docs, *used)
