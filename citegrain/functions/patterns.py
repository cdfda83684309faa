"""Regex fragments shared by the column functions.

Everything is written in the common subset of Java regex and RE2, with explicit
code points, so one pattern means the same thing in Spark and in a SQL check.
"""

# Unicode white space (Java's \s alone is ASCII).
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# The same characters as a string, for trimming without a regex.
WS_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Every character that ends a line, CR LF counting once.
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# One word character in the Unicode sense.
WORD = r"[\p{L}\p{N}_]"

# Kana, CJK extension A and CJK unified ideographs.
CJK = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"

# Lower-case letters, digits, hiragana, katakana and kanji: the token alphabet.
TOKEN_CHARS = r"a-z0-9\x{4e00}-\x{9fa5}\x{3041}-\x{3093}\x{30a1}-\x{30f3}"
PROLONGED_MARK = r"\x{30fc}"

LATIN_WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"
WORD_OR_CJK = r"[A-Za-z0-9][A-Za-z0-9_\-']*|[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"

ABSOLUTE_URL = r"^https?://[^/?#]+"
URL_AUTHORITY = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
URL_PATH = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
URL_SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.-]*):"
URL_QUERY = r"^[^?#]*\?([^#]*)"
