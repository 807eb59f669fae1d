"""Text and token column functions. All are JVM expressions with linear, non-recursive patterns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str counts as space and as line end, spelled for Java: its Unicode \s lacks the four
# ASCII separators, and \v is its class of vertical space. One predicate is much faster than a union.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"[\v\x1c-\x1e]"
WORD_CHAR = r"[\p{L}\p{N}_]"
_UNICODE = "(?U)"

# The same characters listed one by one, for engines with other classes.
SPACE_CHARS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END_CHARS = r"\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}"

# The character alphabet (ids start at 1) and the token pattern of the TF-IDF model.
ALPHABET = string.printable
TFIDF_TOKEN = r"""([A-Za-z_][\p{L}\p{N}_]*|[!#$%&*+:\-./<=>?@\\^_|~]+|[ \t(),;{}\[\]"'`])"""

COMMENT = r"/\*(?s:.*?)\*/|//[^\n]*"
# Words of letters (and non-decimal numerals); decimal digits split them.
ALPHABETIC = r"[\p{L}\p{Nl}\p{No}_]+"


def _replace(c: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def trim_space(c: Column) -> Column:
    return _replace(c, rf"{_UNICODE}\A{SPACE}+|{SPACE}+\z", "")


def collapse_whitespace(c: Column) -> Column:
    return _replace(c, f"{_UNICODE}{SPACE}+", " ")


def strip_all_whitespace(c: Column) -> Column:
    return _replace(c, f"{_UNICODE}{SPACE}+", "")


def strip_comments(c: Column) -> Column:
    """Delete block and line comments, then newlines and tabs. Strings get no special treatment."""
    return F.translate(_replace(c, COMMENT, ""), "\n\t", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; text that ends in a line end has no extra empty line."""
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    body = F.when(F.rlike(F.right(c, F.lit(1)), F.lit(LINE_END)), F.left(c, F.length(c) - 1)).otherwise(c)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_END, -1))


def longer_than(c: Column, n: int) -> Column:
    return F.length(c) > n


def in_length_band(c: Column, above: int = 10, below: int = 151) -> Column:
    return (F.length(c) > above) & (F.length(c) < below)


def has_statement(c: Column, mark: str = ";") -> Column:
    return F.contains(c, F.lit(mark))


def path_basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def path_suffix(c: Column) -> Column:
    """Lower-cased last suffix; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(c, r"[^/]\.([^./]+)$", 1))


def concat_non_null(*cols: Column) -> Column:
    return F.when(F.coalesce(*cols).isNotNull(), F.concat_ws(",", *cols))


# --- character sequences -----------------------------------------------------------------------

# Alphabet position by ASCII code.
_POSITIONS = [ALPHABET.find(chr(code)) + 1 for code in range(128)]


_NOT_IN_ALPHABET = r"[^\t-\r\x20-\x7e]"


def _positions(c: Column) -> Column:
    """Position of each ASCII character; 0 outside the alphabet."""
    by_code = F.array(*[F.lit(p) for p in _POSITIONS])
    return F.transform(F.split(c, ""), lambda ch: F.element_at(by_code, F.ascii(ch) + 1))


def char_ids(c: Column) -> Column:
    """1-based alphabet position of every character; other characters are dropped."""
    return F.filter(_positions(_replace(c, _NOT_IN_ALPHABET, "")), lambda i: i > 0)


def pad_ids(ids: Column, n: int, side: str = "right", fill: int = 0) -> Column:
    """Exactly ``n`` ids: long input keeps its last ``n``, short input is filled on ``side``."""
    kept = F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)
    gap = F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(ids), F.lit(0)))
    return F.concat(kept, gap) if side == "right" else F.concat(gap, kept)


def char_sequence(c: Column, n: int = 150) -> Column:
    """``pad_ids(char_ids(c), n)``, cut and padded as text so that only ``n`` characters become ids."""
    kept = F.right(_replace(c, _NOT_IN_ALPHABET, ""), F.lit(n))
    return _positions(F.rpad(kept, n, "\0"))


# --- tokens ------------------------------------------------------------------------------------

def rf_clean_text(c: Column) -> Column:
    """Delete words of one repeated letter, then words of one letter."""
    # What counts as such a word.
    start, end = f"(?<!{WORD_CHAR})", f"(?!{WORD_CHAR})"
    c = _replace(c, rf"{start}([A-Za-z])\1+{end}", "")
    return _replace(c, f"{start}[A-Za-z]{end}", "")


def code_tokens_regex(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TFIDF_TOKEN), 1)


def simple_tokens(c: Column) -> Column:
    """Lower-case alphabetic tokens of 2 to 15 characters that do not start with ``_``."""
    words = F.regexp_extract_all(F.lower(c), F.lit(ALPHABETIC), 0)
    return F.filter(words, lambda w: F.length(w).between(2, 15) & ~F.startswith(w, F.lit("_")))


# Alternatives start with different characters, except that comments precede operators. A quote that
# never closes on its line is a token of its own, as is any other single character.
C_OPERATOR = r"->\*?|\+\+|--|<<=?|>>=?|&&|\|\||::|##|\.\.\.|\.\*|[\-+*/%&|^<>=!]="
C_TOKEN = "|".join([
    r"[\p{L}_][\p{L}\p{N}_]*",
    r"\.?[0-9](?:[eEpP][+\-]|[0-9A-Za-z_.])*",
    r'"[^"\n]*"', r"'[^'\n]*'",
    COMMENT,
    C_OPERATOR,
    f"[^{SPACE_CHARS}]",
])
# Escapes inside literals are hidden behind Unicode noncharacters while tokens are cut, so that
# literals match without the backtracking that overflows the stack on long escaped strings.
_HIDE = [("\\\\", "\ufdd0"), ('\\"', "\ufdd1"), ("\\'", "\ufdd2")]


def code_tokens_c(c: Column) -> Column:
    """C tokens (comments included) with the spaces inside each token removed."""
    for text, mark in _HIDE:
        c = F.replace(c, F.lit(text), F.lit(mark))
    tokens = F.regexp_extract_all(c, F.lit(f"[{SPACE_CHARS}]*({C_TOKEN})"), 1)

    def restore(token: Column) -> Column:
        token = F.replace(token, F.lit(" "), F.lit(""))
        for text, mark in _HIDE:
            token = F.replace(token, F.lit(mark), F.lit(text))
        return token

    return F.transform(tokens, restore)


def normalize_text(c: Column, space: str = "Ä") -> Column:
    """Drop combining accent marks (composed letters stay), then show spaces as a marker character."""
    return F.replace(_replace(c, r"\p{Mn}+", ""), F.lit(" "), F.lit(space))
