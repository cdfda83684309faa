"""Text column functions: white space, counts, tokens and small value rules."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from citegrain.functions import patterns as P

# Words that carry no topic.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "that", "this", "what", "how", "can", "are", "into",
    "page", "html", "www", "https", "http", "co", "jp", "com", "new", "vehicles", "vehicle",
    "cars", "car", "details", "specifications", "model", "models",
)

# Key names whose values are credentials.
SECRET_KEYS = (
    "access_token", "authorization", "auth", "token", "pat", "pat_token", "api_key", "secret", "password",
)
REDACTED = "[REDACTED]"

TRUNCATION_MARKER = "\n...[truncated]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def constants(values) -> Column:
    """Fixed strings as one array literal; Spark folds the split once, at planning time."""
    return F.split(F.lit("\x01".join(values)), "\x01")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_ws(c: Column | str) -> Column:
    """Remove Unicode white space at both ends."""
    return F.trim(col(c), F.lit(P.WS_CHARS))


# P.WS in Java's form, where three ranges tell most other characters apart.
WS_RUN = r"[\x{09}-\x{20}\x{85}\x{a0}\x{1680}-\x{3000}&&" + P.WS + "]+"


def compact(c: Column | str) -> Column:
    """One line, single blanks, no blank ends; NULL becomes ''."""
    return F.trim(F.regexp_replace(text_or_empty(c), WS_RUN, " "))


def compact_limited(c: Column | str, limit: int) -> Column:
    t = compact(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.left(t, F.lit(limit))), F.lit("..."))).otherwise(t)


def compact_block(c: Column | str) -> Column:
    """Blanks squeezed within lines, at most one empty line between paragraphs."""
    t = F.replace(text_or_empty(c), F.lit("\u00a0"), F.lit(" "))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip_ws(t)


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape_entities(c: Column | str) -> Column:
    """Decode HTML entities; only values holding '&' carry a payload to Python."""
    value = col(c)
    return F.coalesce(_unescape(F.when(F.contains(value, F.lit("&")), value)), value)


def clean_value(c: Column | str, max_len: int | None = None, entities: bool = True) -> Column:
    """Entity-free single-line text, cut to ``max_len`` without a blank end."""
    t = compact(unescape_entities(c) if entities else c)
    if not max_len:
        return t
    return F.when(F.length(t) > max_len, F.rtrim(F.left(t, F.lit(max_len)))).otherwise(t)


def lines(c: Column | str) -> Column:
    return F.split(text_or_empty(c), P.LINE_BREAK)


def word_or_cjk_count(c: Column | str) -> Column:
    """Latin/number tokens plus every CJK character."""
    return F.regexp_count(text_or_empty(c), F.lit(P.WORD_OR_CJK))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(P.WORD + "+"))


def cjk_char_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(P.CJK))


def latin_word_count(c: Column | str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(P.LATIN_WORD))


def wordish_count(c: Column | str) -> Column:
    """Latin words plus half of the CJK characters."""
    return (latin_word_count(c) + F.floor(cjk_char_count(c) / 2)).cast("int")


def blank_split_count(c: Column | str) -> Column:
    """Pieces between white space."""
    count = lambda t: F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
    return let(compact(c), count)


def match_tokens(c: Column | str) -> Column:
    """Distinct lower-case tokens of three or more characters."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(f"[{P.TOKEN_CHARS}]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 3))


def keyword_tokens(*columns: Column | str, extra_stop=()) -> Column:
    """Topic tokens in order, duplicates kept, stop words and single characters dropped."""
    joined = F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in columns]))
    stop = constants((*STOP_WORDS, *[s.strip().lower() for s in extra_stop if s and s.strip()]))
    found = F.regexp_extract_all(joined, F.lit(f"[{P.TOKEN_CHARS}{P.PROLONGED_MARK}]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def terms_present(c: Column | str, terms) -> Column:
    """How many of the terms occur at least once, ignoring case."""
    wanted = [t.lower() for t in terms if t]
    if not wanted:
        return F.lit(0)
    count = lambda low: F.size(F.filter(constants(wanted), lambda t: F.contains(low, t)))
    return let(F.lower(text_or_empty(c)), count)


def any_term(low: Column, terms) -> Column:
    """Whether a lower-cased text holds one of the terms; stops at the first found."""
    return let(low, lambda text: F.exists(constants(terms), lambda t: F.contains(text, t)))


def occurrences(low: Column, term: str) -> Column:
    """Non-overlapping occurrences of a fixed term in already lower-cased text."""
    shorter = F.length(F.replace(low, F.lit(term), F.lit("")))
    found = F.when(F.contains(low, F.lit(term)), ((F.length(low) - shorter) / len(term)).cast("int"))
    return F.when(low.isNotNull(), F.coalesce(found, F.lit(0)))


def first_present(*columns: Column | str) -> Column:
    """First value that is neither NULL nor '' (zero and false count as present)."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def first_text(*columns: Column | str) -> Column:
    """First column holding something besides white space, '' when none does."""
    return F.coalesce(*[F.when(strip_ws(c) != "", col(c)) for c in columns], F.lit(""))


def percent_text(c: Column | str) -> Column:
    """Whole percentages without decimals, others as they are, bad values as 0."""
    number = col(c).cast("double")
    return F.when(number.isNull(), "0").when(
        number == F.floor(number), number.cast("bigint").cast("string")
    ).otherwise(number.cast("string"))


def is_secret_key(key: Column) -> Column:
    k = F.lower(key)
    return k.isin(*SECRET_KEYS) | k.endswith("_token") | F.contains(k, F.lit("access_token"))


def redact_map(c: Column | str) -> Column:
    """Replace the values of credential-like keys of a map<string,string>."""
    return F.transform_values(
        col(c), lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(v)
    )


def truncate(c: Column | str, limit: int, marker: str = TRUNCATION_MARKER) -> Column:
    value = col(c)
    if limit <= 0:
        return value
    cut = F.rtrim(F.left(value, F.lit(limit)), F.lit(P.WS_CHARS))
    return F.when(F.length(value) > limit, F.concat(cut, F.lit(marker))).otherwise(value)
