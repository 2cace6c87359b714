"""Text functions as column expressions; Python is used only for the rare texts that need Unicode tables Spark lacks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The characters that count as white space, for regular expressions of Java and RE2.
WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WHITE_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
#: Texts without any of these, and without white space at either end, are canonical as they are, if all their characters lie below U+0300.
_LOOSE = (*"\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", "  ", " \n", "\n ", "```", "~~~")
#: Chat markers.
USER, ASSISTANT, SYSTEM, END = "<|user|>", "<|assistant|>", "<|system|>", "<|end|>"
_FENCE = re.compile(r"\s*(?:```|~~~)")
_TOKEN = re.compile(r"[a-z0-9]+(?:[._/-][a-z0-9]+)*")


def strip(c: Column) -> Column:
    """Without white space, of any script, at both ends."""
    return F.btrim(c, F.lit(_WHITE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_WHITE_CHARS))


def word_list(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WHITE}]+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(word_list(c)).cast("long")


def normalize_text(text: str) -> str:
    """Canonical form of a text: NFC, LF line ends, no blank lines around, prose lines with single blanks; code keeps its inner and leading white space."""
    out, fenced = [], False
    for line in re.split(r"\r\n|\r|\n", unicodedata.normalize("NFC", text)):
        if fenced or line.startswith(("    ", "\t")):
            out.append(line.rstrip())
        else:
            out.append(re.sub(r"[ \t]+", " ", line).strip())
        fenced ^= bool(_FENCE.match(line))
    return "\n".join(out).strip("\n")


@F.pandas_udf(StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def is_canonical(c: Column) -> Column:
    """Whether a text surely is in canonical form as it is: in NFC because all is below U+0300, nothing to strip, and no fence."""
    loose = c.rlike(r"[^\x00-\x{2ff}]")  # the rest by plain searches: a pattern of alternatives, or of many ranges, takes ten times as long
    for part in _LOOSE:
        loose |= F.contains(c, F.lit(part))
    for white in " \n":
        loose |= F.startswith(c, F.lit(white)) | F.endswith(c, F.lit(white))
    return ~loose


def normalize(c: Column) -> Column:
    """``normalize_text`` as an expression. Texts that are canonical as they are never reach Python; the others go there in Arrow batches."""
    return F.coalesce(_normalized(F.when(~is_canonical(c), c)), c)  # so that a text is tested once


def singular(token: Column) -> Column:
    """A light singular: -ies to -y, and a final s dropped but for -ss and -us, in tokens of over four letters."""
    long = F.length(token) > 4
    return F.when(long & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y"))).when(
        long & token.endswith("s") & ~token.endswith("ss") & ~token.endswith("us"), F.substring(token, F.lit(1), F.length(token) - 1)
    ).otherwise(token)


@F.pandas_udf(StringType())
def _fold_rare(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def folded(c: Column) -> Column:
    """NFKC and case-folded. ASCII and Latin-1 letters (but ß) need only be lower-cased."""
    rare = c.rlike(r"[^\x00-\x7f\xc0-\xde\xe0-\xff]")
    return F.coalesce(_fold_rare(F.when(rare, c)), F.lower(c))


def overlap_tokens(c: Column) -> Column:
    """Tokens for comparing wording: case, punctuation and plurals don't count."""
    return F.transform(F.regexp_extract_all(folded(normalize(c)), F.lit(_TOKEN.pattern), F.lit(0)), singular)


def rubric_text(c: Column) -> Column:
    """Folded, with white space made single."""
    return F.array_join(word_list(folded(c)), " ")


def json_string(c: Column) -> Column:
    """A JSON string literal in canonical form: only quotes, backslashes and control characters are escaped, in lower-case hexadecimal."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\b", "\\b"), ("\t", "\\t"), ("\n", "\\n"), ("\f", "\\f"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for code in set(range(32)) - {8, 9, 10, 12, 13}:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out), F.lit('"'))


def json_object(**members: Column) -> Column:
    """A canonical JSON object of members that are JSON texts already: keys sorted, no blanks."""
    parts = [p for i, k in enumerate(sorted(members)) for p in (F.lit(f'{"," if i else "{"}"{k}":'), members[k])]
    return F.concat(*(parts or [F.lit("{")]), F.lit("}"))


def digest(json: Column) -> Column:
    return F.sha2(json, 256)


def logical_name(c: Column) -> Column:
    """A relative path with slashes, without empty and '.' parts; null for absolute paths, drive letters and '..'."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1), lambda p: (p != "") & (p != "."))
    bad = c.rlike(r"\A(?:[A-Za-z]:|[/\\])") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def chat_text(user: Column, assistant: Column) -> Column:
    return F.concat(F.lit(f"{USER}\n"), user, F.lit(f"\n{ASSISTANT}\n"), assistant, F.lit(f"\n{END}"))


def chat_prompt(history: Column, message: Column) -> Column:
    """Past (user, assistant) turns and an open assistant turn."""
    past = F.transform(history, lambda h: chat_text(h["user"], h["assistant"]))
    return F.array_join(F.concat(past, F.array(F.concat(F.lit(f"{USER}\n"), message, F.lit(f"\n{ASSISTANT}\n")))), "\n")


#: Labels that may trail an answer.
TRAILING = r"(?:(?:Reinforcement|Stack contrast|Queue contrast|Hygiene note)\s+\d+|Command note(?:\s+\d+)?|Check\s+\d+)\.?"


def clean_response(c: Column) -> Column:
    """An answer up to its first chat marker, stripped, and without trailing labels, however many."""
    cut = F.regexp_replace(c, r"(?s)<\|(?:end|user|assistant)\|>.*\z", "")
    space = f"[{WHITE}]"
    labels = TRAILING.replace(r"\s", space)
    return strip(F.regexp_replace(strip(cut), rf"(?i)(?:{space}+{labels}{space}*)+\z", ""))


def is_degenerate(c: Column) -> Column:
    """Blank, or nothing but ASCII punctuation and white space."""
    return c.rlike(rf"\A[{WHITE}!-/:-@\[-`{{-~]*\z")


def plain_words(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))


def opening(c: Column, words: int = 8) -> Column:
    return F.array_join(F.slice(plain_words(c), 1, words), " ")


def phrase_count(c: Column, phrase: str) -> Column:
    """Occurrences, without overlap, in the lower-cased text."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def preview(c: Column, width: int = 120) -> Column:
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, width)


def safe_value(c: Column, width: int = 80) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def length_bucket(words: Column) -> Column:
    return F.when(words <= 12, "1-12").when(words <= 24, "13-24").when(words <= 40, "25-40").otherwise("41+")


def clean_field(c: Column) -> Column:
    """Null as empty, LF line ends, stripped."""
    return strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")))


def token_estimate(chars: Column) -> Column:
    return F.floor(chars / 4).cast("long")
