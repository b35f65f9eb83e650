"""The queries opN_<name> over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    """Register a query under its name."""

    def keep(f):
        QUERIES[name] = f
        return f

    return keep


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digest=True)


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"))


def _bin(v: str) -> str:
    from .quality_rules import DIGITS

    return f"(({v}) >> greatest(length(bin({v})) - {DIGITS}, 0)) << greatest(length(bin({v})) - {DIGITS}, 0)"


def _op1_sql() -> str:
    from .quality_rules import MEASURES, PRIOR, SPREAD, UNITS

    parts = []
    for m, (top, bottom, both) in MEASURES.items():
        v = f"CASE WHEN {bottom} > 0 THEN {top} * 10000 // {bottom} ELSE 0 END"
        low = f"-{SPREAD}" if both else "NULL"
        parts.append(f"SELECT row, doc_id, lang, source, base_failed, '{m}' AS measure, {low} AS low, CAST({v} AS BIGINT) AS v FROM judged")

    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
grams AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM grams) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY row),
line AS (SELECT row, unnest(lines) AS line FROM w),
copied AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
counted AS (
  SELECT w.row, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(regexp_replace(text, '[A-Za-z0-9\x20\x09-\x0D]|[^\x00-\x7F]', '', 'g')) AS BIGINT) AS n_marks,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
    CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS BIGINT) AS n_stutters
  FROM w LEFT JOIN covered v USING (row) LEFT JOIN copied c USING (row)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
measured AS ({" UNION ALL ".join(parts)}),
binned AS (SELECT lang, source, measure, CAST({_bin("v")} AS BIGINT) AS bin FROM measured WHERE NOT base_failed),
own AS (SELECT lang, source, measure, bin, count(*) AS n FROM binned GROUP BY ALL),
of_lang AS (SELECT lang, measure, bin, sum(n)::BIGINT AS n FROM own GROUP BY ALL),
share AS (SELECT measure, bin, n * {UNITS} // (sum(n) OVER (PARTITION BY measure))::BIGINT AS s FROM (SELECT measure, bin, sum(n)::BIGINT AS n FROM own GROUP BY ALL)),
size AS (SELECT lang, measure, sum(n)::BIGINT + {PRIOR} AS total FROM of_lang GROUP BY ALL),
lang_mix AS (SELECT lang, measure, bin, sum(w)::BIGINT AS w FROM (SELECT lang, measure, bin, n * {UNITS} AS w FROM of_lang UNION ALL SELECT lang, size.measure, bin, {PRIOR} * s FROM size JOIN share ON size.measure = share.measure) GROUP BY ALL),
mix AS (SELECT lang, source, measure, bin, sum(w)::BIGINT AS w FROM (SELECT lang, source, measure, bin, n * {UNITS} AS w FROM own
  UNION ALL SELECT g.lang, g.source, g.measure, m.bin, {PRIOR} * m.w // z.total FROM (SELECT DISTINCT lang, source, measure FROM own) g JOIN lang_mix m ON g.lang IS NOT DISTINCT FROM m.lang AND g.measure = m.measure JOIN size z ON g.lang IS NOT DISTINCT FROM z.lang AND g.measure = z.measure) GROUP BY ALL),
chosen AS (
  SELECT lang, source, measure, min(CASE WHEN upto * 4 >= total THEN bin END) AS q1, min(CASE WHEN upto * 2 >= total THEN bin END) AS q2
  FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM mix) GROUP BY ALL),
verdict AS (
  SELECT m.row, bool_and(q2 = q1 OR coalesce(v <= q2 + {SPREAD} * (q2 - q1) AND (low IS NULL OR v >= q2 + low * (q2 - q1)), true)) AS fine
  FROM measured m LEFT JOIN chosen c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source AND m.measure = c.measure GROUP BY m.row)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_capitals, n_stutters, base_failed, NOT base_failed AND fine AS kept
FROM judged JOIN verdict USING (row)"""


ORACLES["op1_quality_rules"] = _op1_sql()


@query("op7_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op7_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      * CASE WHEN size > 0 THEN (size + length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) / size ELSE 1.0::DOUBLE END AS key
  FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
u AS (
  SELECT *, sum(source_size) OVER () AS total, sum(3 * source_size) OVER o - 3 * source_size AS met, sum(weight) OVER () - sum(weight) OVER o + weight AS rest
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, (total - met)::DOUBLE / rest::DOUBLE AS rate FROM u),
common AS (SELECT arg_min(rate, 3 * source_size / weight) AS rate FROM r WHERE rate * weight <= 3 * source_size),
t AS (SELECT source, source_size, coalesce(least(3.0 * source_size::DOUBLE, weight * common.rate), 3.0 * source_size::DOUBLE) AS target FROM r, common),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(floor(target + 0.5) / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
f AS (SELECT *, floor(target + 0.5)::BIGINT - epochs * source_size AS rest FROM e),
p AS (
  SELECT k.*, f.source_size, f.target, f.epochs, f.rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY k.source, key, doc_id, size) AS words
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN rest > 0 AND 2 * (upto - words) + words <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    model, thresholds = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, thresholds)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query("op4_quality_net")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_net import fit, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query("op5_neighbours")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op3_secrets")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def _op3_sql() -> str:
    """Positions from the texts between matches; every window's entropy counted on its own; each character is the earliest kind's."""
    from math import ceil, log2

    from .secrets import ALLOWED, ALLOWED_PARTS, BASE, CHANGES, CLASSES, KINDS, NARROW, UNIT, WINDOW, weights

    quote = lambda s: "'" + s.replace("'", "''") + "'"
    assign = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    folded = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    assign = assign.replace("password|passwd|secret|token|api_?key", folded)
    start = "list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    # each search: kind, number, pattern, group that counts, least length
    searches = [("assign", 0, assign, 1, 8), ("access", 1, "AKIA[A-Z0-9]+", 0, 16), ("hex", 2, "[0-9a-f]+", 0, 32)]
    searches += [(k, len(BASE) + n, "[A-Za-z0-9+/_-]+", 0, WINDOW) for n, k in enumerate(CLASSES)]
    parts = []
    for kind, n, pattern, group, least in searches:
        of = "text" if n < len(BASE) else "bare"
        parts.append(f"""SELECT row, '{kind}' AS kind, {n} AS k, i, m[i] AS found, v[i] AS held, {least} AS least, {start} AS s
          FROM (SELECT row, unnest(range(1, len(m) + 1)) AS i, m, p, v FROM (
            SELECT row, regexp_extract_all({of}, {quote(pattern)}, 0) AS m, regexp_extract_all({of}, {quote(pattern)}, {group}) AS v, regexp_split_to_array({of}, {quote(pattern)}) AS p FROM d
            WHERE regexp_matches({of}, {quote(pattern if kind == "assign" else pattern[:-1] + "{" + str(least - 4 * (kind == "access")) + ",}")})))
          WHERE length(v[i]) >= {least}""")
    allow = " OR ".join(f"regexp_matches(found, {quote(p)})" for p in ALLOWED)
    fit = f"regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]') AND NOT ({allow})"
    changes = "len(list_filter(range(1, length(found)), lambda x: regexp_matches(substr(found, x, 2), '^([a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z])$')))"
    runs = []
    for n, (kind, (pattern, _, _, more)) in enumerate(NARROW.items(), len(BASE) + len(CLASSES)):
        also = "".join(f" AND regexp_matches(found, {quote(c)})" for c in more)
        runs.append(f"""SELECT row, '{kind}' AS kind, {n} AS k, c * 65536 + i AS c, m[i] AS found, s + {start} AS s
          FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT row, c, s, regexp_extract_all(found, {quote(pattern)}, 0) AS m, regexp_split_to_array(found, {quote(pattern)}) AS p FROM wide WHERE k = {len(BASE) + 1}))
          WHERE {fit.replace("found", "m[i]")} AND {changes.replace("found", "m[i]")} * {CHANGES} >= length(m[i]){also.replace("found", "m[i]")}""")
    bare = "coalesce(text, '')"
    for p, length in ALLOWED_PARTS.items():
        bare = f"regexp_replace({bare}, {quote(p)}, {quote(' ' * length)}, 'g')"
    most = round(WINDOW * log2(WINDOW) * UNIT)
    need = [0] * len(BASE) + [most - ceil(c[2] * WINDOW * UNIT) for c in [*CLASSES.values(), *NARROW.values()]]
    names = [k for k in KINDS]
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {bare} AS bare FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
base AS (SELECT row, kind, k, s, s + length(found) AS e FROM hits WHERE k < {len(BASE)}),
wide AS (SELECT row, kind, k, i AS c, found, s FROM hits WHERE k >= {len(BASE)} AND {fit} AND (k > {len(BASE)} OR regexp_full_match(found, '[0-9a-fA-F]+'))),
tried AS (SELECT * FROM wide UNION ALL {" UNION ALL ".join(runs)}),
win AS (SELECT row, k, s, c, j, list_sum(list_transform(map_values(list_histogram(string_split(substr(found, j, {WINDOW}), ''))), lambda c: {weights()}[(c + 1)::BIGINT])) AS t
  FROM (SELECT *, unnest(range(1, length(found) - {WINDOW} + 2)) AS j FROM tried)),
lit AS (SELECT DISTINCT row, k, unnest(range((s + j - 1)::BIGINT, (s + j - 1 + {WINDOW})::BIGINT)) AS p FROM win WHERE t <= {need}[k + 1]),
own AS (SELECT row, p, min(k) AS k FROM lit WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = lit.row AND b.s <= lit.p AND lit.p < b.e) GROUP BY row, p),
more AS (SELECT row, k, min(p) AS s, max(p) + 1 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY row, k ORDER BY p) AS isle FROM own) GROUP BY row, k, isle),
every AS (SELECT row, kind, k, s, e FROM base UNION ALL SELECT row, {names}[k + 1], k, s, e FROM more),
by_row AS (SELECT row,
    count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {len(BASE)}) AS own,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM every GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_row USING (row)"""


ORACLES["op3_secrets"] = _op3_sql()


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


ORACLES["op8_near_duplicates"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(words, ' ') AS shingle FROM d WHERE len(words) BETWEEN 1 AND 3
    UNION ALL
    SELECT doc_id, array_to_string(words[i:i + 3], ' ') FROM (SELECT doc_id, words, unnest(range(1, len(words) - 2)) AS i FROM d WHERE len(words) > 3))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.id AS component_id, d.doc_id = c.id AS kept
FROM d JOIN (SELECT doc_id, min(other) AS id FROM reach GROUP BY doc_id) c USING (doc_id) LEFT JOIN n USING (doc_id)"""


@query("op2_lattice_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .lattice import score

    return score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op6_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan

    return scan(table(spark, sf_dir, "documents"))


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ..session import scratch_folder
    from .token_files import read, write

    folder = scratch_folder(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end=2)
    return read(spark, folder, ids=False)


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periods import periodic_runs, repeated_tail

    return periodic_runs(table(spark, sf_dir, "documents"), repeated_tail)


# every pair of equal words of a document; pairs of one distance in a row are a stretch of that period
ORACLES["op12_periodic_runs"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS own,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda x, c: list_reduce(list_prepend(xor(x, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h
  FROM documents),
g AS (SELECT *, h // 10 AS g, len(own) AS n FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
w AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN h % 10 = 0 AND n > 0
    THEN own[1:a] || list_transform(range(0, n - a), lambda k: own[a + k % (1 + (n - a) // (3 + g % 8)) + 1]) ELSE own END AS words
  FROM a),
each AS MATERIALIZED (SELECT row, i, words[i + 1] AS word FROM (SELECT row, words, unnest(range(0, len(words))) AS i FROM w)),
pairs AS (SELECT x.row, y.i - x.i AS q, x.i FROM each x JOIN each y ON x.row = y.row AND x.word = y.word AND x.i < y.i),
isles AS (SELECT row, q, min(i) AS s, max(i) + 1 + q AS e FROM (
    SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS isle FROM pairs) GROUP BY row, q, isle
  HAVING count(*) >= greatest(24 - q, 2 * q)),
runs AS MATERIALIZED (SELECT row, s, e - s AS n, min(q) AS q FROM isles GROUP BY row, s, e),
listed AS (SELECT row, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    arg_max(struct_pack(s := s, n := n, q := q), (n::DOUBLE / q, -s, -q)) AS best FROM runs GROUP BY row),
gone AS (SELECT DISTINCT row, i FROM (SELECT row, unnest(range(s + q, s + n)) AS i FROM runs)),
kept AS (SELECT e.row, string_agg(word, ' ' ORDER BY e.i) AS kept FROM each e ANTI JOIN gone USING (row, i) GROUP BY e.row)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.n // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)"""


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import cross_alignment

    a, b = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return cross_alignment(table(spark, sf_dir, "documents"), a, b, public_tokenizers.PATTERN)
