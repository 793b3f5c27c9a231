"""Column builders for cleaning text and codes. All are narrow and run on static and streaming frames alike."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that mean "missing", and the literal for an unknown feature.
MISSING_WORDS = ("nan", "<na>", "none", "null")
UNKNOWN = "unknown"
# Digraphs for lower-case letters.
DIGRAPHS = {"æ": "ae", "ø": "oe", "å": "aa", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "œ": "oe"}
CODE_PATTERN = r"^[A-Z]\d{2}\.\d{3}$"
LEVELS = {"chapter": 1, "group": 2, "block": 3, "category": 5, "code": 7}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def null_if_missing(c) -> Column:
    """Trimmed text; null where it is empty or a word for "missing"."""
    t = F.trim(_c(c).cast("string"))
    return F.when((t == "") | F.lower(t).isin(*MISSING_WORDS), None).otherwise(t)


def pick(df, i: int | None) -> Column:
    """Column by position; null where there is none."""
    return _c(df.columns[i]) if i is not None and 0 <= i < len(df.columns) else F.lit(None).cast("string")


def format_age(c) -> Column:
    """Age to two decimals without trailing zeros; `unknown` where it is no number."""
    v = F.round(F.expr("try_cast(trim({0}) as double)".format(c)) if isinstance(c, str) else _c(c).try_cast("double"), 2)
    fits = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    short = F.regexp_replace(F.when(fits, v).cast("decimal(38,2)").cast("string"), r"\.?0+$", "")
    return F.when(~fits | v.isNull(), UNKNOWN).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(short)


def map_category(c, mapping: dict[str, str]) -> Column:
    """Mapped value by exact, then by lower-cased key, else `unknown`."""
    v = _c(c)
    exact = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    lower = F.create_map(*[F.lit(x) for k, w in mapping.items() for x in (k.lower(), w)]) if len({k.lower() for k in mapping}) == len(mapping) else exact
    return F.coalesce(F.try_element_at(exact, v), F.try_element_at(lower, F.lower(v)), F.lit(UNKNOWN))


def dots_to_spaces(c) -> Column:
    """A dot between two word characters becomes a space."""
    return F.regexp_replace(_c(c), r"(?U)(?<=\w)\.(?=\w)", " ")


def build_text(fields: Sequence[tuple[str, Column]], main: str, separator: str = " | ") -> Column:
    """`name: value` parts joined; the bare value if only the main field is asked for."""
    names = [n for n, _ in fields]
    if not names or len(set(names)) != len(names):
        raise ValueError("field names must be given once each")
    if names == [main]:
        return F.coalesce(fields[0][1], F.lit(UNKNOWN))
    return F.concat_ws(separator, *[F.concat(F.lit(f"{n}: "), F.coalesce(v, F.lit(UNKNOWN))) for n, v in fields])


def render_request(fields: Sequence[tuple[str, Column]], separator: str = " | ") -> Column:
    """As build_text, without fields that are null or unknown."""
    return F.concat_ws(separator, *[F.when(v.isNotNull() & (v != UNKNOWN), F.concat(F.lit(f"{n}: "), v)) for n, v in fields])


def collect_codes(columns: Sequence[Column], fallback: Column | None = None, max_labels: int | None = None) -> Column:
    """Distinct non-null codes in column order; the fallback column if there are none (or one label is wanted)."""
    single = F.array_compact(F.array(fallback)) if fallback is not None else F.array().cast("array<string>")
    if max_labels == 1:
        return single
    many = F.array_distinct(F.array_compact(F.array(*columns)))
    return F.when(F.size(many) > 0, many).otherwise(single)


def join_label(codes, separator: str = ",") -> Column:
    return F.array_join(_c(codes), separator)


def single_label(codes) -> Column:
    """The only label, or null."""
    return F.when(F.size(_c(codes)) == 1, F.element_at(_c(codes), 1))


def normalise_code(c) -> Column:
    """Trimmed, upper-cased; empty for missing."""
    return F.coalesce(F.upper(null_if_missing(c)), F.lit(""))


def normalise_shape(c) -> Column:
    """Codes with a letter, two digits, a dot and digits get three digits after the dot; others stay."""
    v = _c(c)
    rough = v.rlike(r"^[A-Z]\d{2}\.\d+$")
    return F.when(rough, F.concat(F.substring(v, 1, 4), F.rpad(F.substring(v, 5, 3), 3, "0"))).otherwise(v)


def coerce_codes(c, separator: str = ",") -> Column:
    """Codes of a list literal, a separated string or a scalar, normalised; blanks go, repeats stay."""
    t = F.trim(F.coalesce(_c(c), F.lit("")))
    inner = F.when(t.startswith("["), F.regexp_replace(t, r"^\[|\]$|[\"']", "")).otherwise(t)
    sep = F.when(t.startswith("["), F.lit(",")).otherwise(F.lit(separator))
    return F.filter(F.transform(F.split(inner, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))), normalise_code), lambda x: x != "")


def prefixes(codes, n: int) -> Column:
    """Distinct prefixes of n characters."""
    return F.array_distinct(F.transform(_c(codes), lambda x: F.substring(x, 1, n)))


def parent_code(c) -> Column:
    return F.substring(_c(c), 1, 5)


def is_valid_code(c) -> Column:
    return F.coalesce(_c(c).rlike(CODE_PATTERN), F.lit(False))


def parse_predictions(c, separator: str = ",") -> Column:
    """struct(valid, invalid): the output's parts by shape, in order."""
    parts = F.filter(F.transform(F.split(F.coalesce(_c(c), F.lit("")), F.lit(f"\\Q{separator}\\E")), lambda x: F.trim(x)), lambda x: x != "")
    return by_shape(parts)


def extract_field(c, prefix: str, separator: str = " | ") -> Column:
    """The rest of the first part that starts with the prefix; null if none does."""
    parts = F.filter(F.split(_c(c), F.lit(f"\\Q{separator}\\E")), lambda x: x.startswith(prefix))
    return F.try_element_at(F.transform(parts, lambda x: F.substr(x, F.lit(len(prefix) + 1))), F.lit(1))


def all_fields(c, separator: str = " | ") -> Column:
    """Map of all `k: v` parts; of a key that repeats the first counts."""
    parts = F.filter(F.split(_c(c), F.lit(f"\\Q{separator}\\E")), lambda x: x.contains(": "))
    pairs = F.transform(parts, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("k"), F.expr("1").cast("int").alias("one"), x.alias("x")))
    firsts = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    value = lambda k: F.element_at(F.filter(parts, lambda x: F.substring_index(x, ": ", 1) == k), 1)
    return F.map_from_arrays(firsts, F.transform(firsts, lambda k: F.substr(value(k), F.length(k) + 3)))


def group_key(c) -> Column:
    """First part without its leading `word:`, accents and case folded, punctuation as spaces, spaces squashed."""
    return F.pandas_udf(_group_keys, StringType())(_c(c))


def _group_keys(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import re
    import unicodedata

    lead, odd, gaps = re.compile(r"^\s*\w+:\s*"), re.compile(r"[^\w\s]|_"), re.compile(r"\s+")

    def fold(t: str | None) -> str | None:
        if t is None:
            return None
        t = lead.sub("", t.split("|", 1)[0])
        t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).casefold()
        return gaps.sub(" ", odd.sub(" ", t)).strip()

    for s in texts:
        yield s.map(fold)


def squash_ws(c) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def expand_digraphs(c) -> Column:
    out = _c(c)
    for k, v in DIGRAPHS.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def sanitise_key(c) -> Column:
    """Other characters than letters, digits, `_` and `-` become `_`; blank becomes `unknown`."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(t == "", UNKNOWN).otherwise(t)


def padded(c, n: int) -> Column:
    """A number with zeros in front to n digits; longer ones stay whole."""
    t = _c(c).cast("string")
    return F.lpad(t, F.greatest(F.lit(n), F.length(t)), F.lit("0"))


def preview(c, n: int) -> Column:
    t = squash_ws(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, max(0, n - 3)), F.lit("..."))).otherwise(t)


# Prefixes and pattern of sources that aren't registers, and a fenced JSON block.
SYNTHETIC_SOURCE, BOOK_PREFIX = "^synthetic_.*multicod", "masterlist_"
FENCED_JSON = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"


def is_real_source(c) -> Column:
    s = F.coalesce(_c(c), F.lit(""))
    return (F.trim(s) != "") & ~s.rlike(SYNTHETIC_SOURCE) & ~s.startswith(BOOK_PREFIX)


def _closed(marks: list[tuple[int, str]], strings: bool) -> list[tuple[int, int]]:
    """(begin, end) of the widest closed brace pairs; with `strings`, braces and quotes inside an object's strings don't count."""
    opened: list[int] = []
    found: list[tuple[int, int]] = []
    quoted = False
    for at, mark in marks:
        if mark == '"':
            quoted = strings and bool(opened) and not quoted
        elif quoted or mark[0] == "\\":
            continue
        elif mark == "{":
            opened.append(at)
        elif opened:
            begin = opened.pop()
            while found and found[-1][0] > begin:  # inside this one
                found.pop()
            found.append((begin, at + 1))
    return found


def _objects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import json
    import re

    marks = re.compile(r'\\.|["{}]', re.DOTALL)

    def first(text: str | None) -> str | None:
        if not text or '"code' not in text:
            return None
        found = [(m.start(), m[0]) for m in marks.finditer(text)]
        for strings in (True, False):
            for begin, end in _closed(found, strings):
                own = text[begin:end]
                if '"codes"' in own or '"code"' in own:
                    try:
                        json.loads(own)
                    except (ValueError, RecursionError):
                        continue
                    return own
        return None

    for s in texts:
        yield s.map(first)


def first_object(c) -> Column:
    """The first brace-balanced object literal that names codes and parses; null if there is none.

    One pass over braces, quotes and escapes: objects may nest and hold strings with braces. Braces that are never
    closed don't count; what their stray quotes would hide is looked for again without regard to strings.
    """
    return F.pandas_udf(_objects, StringType())(_c(c))


def parse_json_answers(c, most: int = 3) -> Column:
    """Codes of the last fenced JSON block that parses; without one, of the first object literal that names codes and parses.

    A list `codes` with members counts, else a string `code`.
    """
    fenced = F.filter(F.transform(F.regexp_extract_all(_c(c), F.lit(FENCED_JSON), F.lit(1)), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull())
    last = F.try_element_at(fenced, F.lit(-1))
    bare = F.try_parse_json(first_object(F.when(last.isNull(), _c(c))))
    best = F.coalesce(last, bare)
    named = F.try_variant_get(best, "$.codes", "array<string>")
    legacy = F.trim(F.try_variant_get(best, "$.code", "string"))
    listed = F.slice(F.filter(F.transform(named, lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return F.when(F.size(named) > 0, listed).when(F.coalesce(legacy, F.lit("")) != "", F.array(legacy)).otherwise(F.array().cast("array<string>"))


def by_shape(codes) -> Column:
    """struct(valid, invalid): codes with the right shape and others, in order."""
    return F.struct(F.filter(_c(codes), is_valid_code).alias("valid"), F.filter(_c(codes), lambda x: ~is_valid_code(x)).alias("invalid"))


def uniform(*key) -> Column:
    """A draw in [0, 1) from md5 of the joined key, the same wherever the row is."""
    digest = F.md5(F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def keyed_hash(*key) -> Column:
    """md5 of the joined key, for orders and thresholds."""
    return F.md5(F.concat_ws(":", *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in key]).cast("binary"))
