"""String functions as column expressions, with the same result on code points in every engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.strip and re's \s see it.
SPACE = r"[\s\x1c-\x1f]"
#: Line ends as str.splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(x: Column) -> Column:
    """Unicode white space removed at both ends."""
    return F.regexp_replace(x, f"(?U)^{SPACE}+|{SPACE}+$", "")


def norm_ws(x: Column) -> Column:
    """Runs of white space become one space; none at the ends; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), f"(?U){SPACE}+", " "))


def ascii_fold(x: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(x, _UPPER, _LOWER)


def like(x: Column, q: str) -> Column:
    """``x LIKE '%q%'`` where only A-Z fold; % and _ in q are wildcards, backslashes are plain."""
    folded = "".join(_LOWER[_UPPER.index(c)] if c in _UPPER else c for c in q)
    return ascii_fold(x).like("%" + folded.replace("\\", "\\\\") + "%")


def snippet(x: Column, q: str, width: int = 60) -> Column:
    """About ``width`` characters around the first place of q (any case), or the beginning."""
    at = F.instr(F.lower(x), q.lower()) - 1
    begin = F.greatest(F.lit(0), at - width // 2)
    end = F.least(F.length(x), begin + width)
    begin = F.greatest(F.lit(0), end - width)
    found = F.substring(x, begin + 1, F.greatest(end - begin, F.lit(0)))
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit("")).when(at < 0, strip(F.substring(x, 1, width))).otherwise(strip(found))


def hay(title: Column, other: Column, q: str) -> Column:
    """What a snippet is cut from: the title if it holds q, else the other text."""
    return F.when(F.coalesce(F.contains(F.lower(title), F.lit(q.lower())), F.lit(False)) & (title != ""), title).otherwise(F.coalesce(other, F.lit("")))


def lines(x: Column) -> Column:
    """The lines of a text; a line end at the very end begins no line; no text has no lines."""
    parts = F.split(F.coalesce(x, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def first_line(x: Column) -> Column:
    """The first line that isn't blank, stripped; empty if there is none."""
    return F.coalesce(F.get(F.filter(F.transform(lines(x), strip), lambda s: s != ""), F.lit(0)), F.lit(""))


def ellipsis(x: Column, n: int) -> Column:
    """At most n characters, and … where something was cut."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…"))).otherwise(x)


def arxiv_id(x: Column) -> Column:
    """The number of an arXiv address, without its version; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?i)arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def doi(x: Column) -> Column:
    """The first DOI in a text without closing punctuation; null if there is none."""
    found = F.regexp_extract(x, r"(?i)\b(10\.\d{4,9}/[-._;()/:a-z0-9]+)\b", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;)]+$", ""), F.lit(""))


def doi_key(x: Column) -> Column:
    """A DOI without resolver or label, in lower case, for comparing."""
    return F.lower(F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))


def arxiv_key(x: Column) -> Column:
    """An arXiv number without address, file end or version, in lower case, for comparing."""
    bare = F.regexp_replace(strip(F.coalesce(x, F.lit(""))), r"(?i)^(?:https?://arxiv\.org/(?:abs|pdf)/|arxiv:\s*)", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\.pdf$", ""), r"(?i)v\d+$", ""))


@F.pandas_udf(StringType())
def title_key(x: pd.Series) -> pd.Series:
    """NFKC, case folded, everything but word characters to one space (Spark has no NFKC)."""
    import re
    import unicodedata

    return x.map(lambda s: re.sub(r"\W+", " ", unicodedata.normalize("NFKC", s or "").casefold()).strip())


def ascii_title_key(x: Column) -> Column:
    """title_key for ASCII titles, in built-in functions."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9_]+", " "))


def strip_json_fences(x: Column) -> Column:
    """A reply without the code fence and the word json around it."""
    t = strip(x)
    body = F.when(F.instr(t, "\n") > 0, F.regexp_replace(t, r"^[^\n]*\n", "")).otherwise(t)
    body = strip(F.when(F.endswith(body, F.lit("```")), F.left(body, F.length(body) - 3)).otherwise(body))
    body = F.when(F.startswith(body, F.lit("json")), strip(F.substring(body, 5, 1 << 30))).otherwise(body)
    return F.when(F.startswith(t, F.lit("```")), body).otherwise(t)


def safe_filename(x: Column) -> Column:
    """A file name: forbidden characters to _, no spaces or dots at the ends, 100 characters."""
    t = F.when(F.coalesce(x, F.lit("")) == "", F.lit("export")).otherwise(x)
    t = F.regexp_replace(F.regexp_replace(t, r'[\\/:*?"<>|\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.left(F.when(t == "", F.lit("export")).otherwise(t), F.lit(100))


def content_disposition(name: Column) -> Column:
    """The header of a download: an ASCII name and the full name, percent-encoded."""
    plain = F.regexp_replace(name, r"[^\x20-\x7e]", "_")
    plain = F.when(plain == "", F.lit("export.md")).otherwise(plain)
    full = F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    full = F.replace(F.replace(full, F.lit("*"), F.lit("%2A")), F.lit("%2F"), F.lit("/"))
    return F.concat(F.lit('attachment; filename="'), plain, F.lit("\"; filename*=UTF-8''"), full)


def render(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} replaced, one name after the other; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def selection_of(prompt: Column) -> Column:
    """What stands between ---SELECTION--- and the next ---, else the first 200 characters."""
    mark = "---SELECTION---"
    rest = F.substring(prompt, F.instr(prompt, mark) + len(mark), F.lit(1 << 30))
    end = F.instr(rest, "---")
    return F.when(F.instr(prompt, mark) > 0, strip(F.when(end > 1, F.substring(rest, F.lit(1), end - 1)).otherwise(rest))).otherwise(strip(F.left(prompt, F.lit(200))))


def year(x: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(x, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def new_id(*parts: Column) -> Column:
    """A 16-digit hexadecimal id from a natural key: reruns give the same."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def iso_seconds(x: Column) -> Column:
    """A timestamp as ISO-8601 text in UTC with seconds."""
    return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def joined(rows: Column, sep: str, by: str, value: str) -> Column:
    """An aggregate: values joined in the order of ``by`` (a struct column with both)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r[value]), sep)
