"""Label and list-text functions, all as built-in Spark expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placemetrics.functions.semantics import as_column, half_even

__all__ = [
    "title_case", "to_ascii", "replace_all", "clean_packed", "clean_members", "slug",
    "slug_names", "drop_parenthesised", "percent_label", "comma_label", "money_label",
    "times_label", "ratio_label", "rank_label", "CITY_RULES", "DECLINED_ANSWERS",
]

# Words a title keeps in lower case unless they come first.
SMALL_WORDS = [
    "a", "and", "are", "as", "at", "be", "but", "by", "en", "for", "from", "if", "in",
    "into", "is", "nor", "not", "of", "on", "or", "per", "so", "than", "that", "the", "to",
    "v", "v.", "via", "vs", "vs.", "with",
]

# Words a title leaves exactly as written.
UNTOUCHED_WORDS = [
    "above", "after", "all", "along", "also", "among", "any", "both", "can", "few",
    "it", "less", "log", "many", "more", "over", "some", "their", "then", "this",
    "under", "until", "using", "von", "when", "where", "which", "will", "without",
    "yet", "you", "your",
]

# Letters whose plain form is longer than one character or that
# have no decomposition of their own.
PLAIN_FORMS = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th",
    "Ĳ": "IJ", "ĳ": "ij", "ŉ": "'n", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o",
    "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ł": "L", "ł": "l",
    "Ŋ": "N", "ŋ": "n", "Ŧ": "T", "ŧ": "t", "ĸ": "q", "ſ": "s",
}

# City spellings, applied from the first rule to the last.
CITY_RULES = [
    (r"Kitchener.*", "Kitchener - Cambridge - Waterloo"),
    (r"Ottawa.*Gatineau.*", "ottawa - gatineau"),
    (r",.*", ""),
    (r"-", " - "),
    (r"Qu.*bec", "quebec city"),
    (r"Montr.*al", "montreal"),
]

# Answers that say nothing about the respondent.
DECLINED_ANSWERS = r"(I don.t know|I prefer not to say)"

_SMALL = f"^({'|'.join(re.escape(w) for w in SMALL_WORDS)})$"
# Inner capitals, single characters, words left as written, words in quotation marks.
_UNTOUCHED = rf"^(\p{{Alpha}}.*\p{{Upper}}.*|.|{'|'.join(UNTOUCHED_WORDS)}|'.*')$"
_TOKEN = r'([ \-/"()\n\t]|[^ \-/"()\n\t]+)'


def title_case(column: Column | str) -> Column:
    """Title case that keeps small words, inner capitals and single letters (rule N23)."""
    tokens = F.regexp_extract_all(as_column(column), F.lit(_TOKEN), 1)

    def cased(token: Column, index: Column, all_tokens: Column) -> Column:
        small = F.lower(token).rlike(_SMALL)
        before = F.get(all_tokens, index - 1)
        two_before = F.get(all_tokens, index - 2)
        starts_clause = F.coalesce(
            ((before == " ") & two_before.rlike("[-:]$")) | (before == '"'), F.lit(False))
        lowered = small & (index > 0) & ~starts_clause
        untouched = token.rlike(_UNTOUCHED)
        upper_first = F.concat(F.upper(F.substring(token, 1, 1)),
                               F.substring(token, 2, 2147483647))
        return (F.when(lowered, F.lower(token)).when(untouched, token)
                .otherwise(F.when(token.rlike("^[a-z]"), upper_first).otherwise(token)))

    # The outer one-element transform names the token array once, so that the
    # inner lambda can look back without splitting the text again.
    cased_tokens = F.transform(
        F.array(tokens), lambda ts: F.transform(ts, lambda t, i: cased(t, i, ts)))
    return F.when(as_column(column).isNotNull(),
                  F.array_join(F.get(cased_tokens, F.lit(0)), ""))


#: Blocks with Latin letters: first and last code point.
LATIN_BLOCKS = ((0x00C0, 0x024F), (0x0250, 0x02AF), (0x1D00, 0x1D7F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F),
                (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))
# The base letters that a letter's Unicode name tells: one, or the two of a ligature.
_NAMED = re.compile(r"LATIN (CAPITAL|SMALL|LETTER SMALL CAPITAL) (?:(?:LETTER|LIGATURE) )?"
                    r"(?:DOTLESS |LONG )?([A-Z]|A[AEOUVY]|DZ|IJ|L[JL]|NJ|O[EOU]|TZ|VY)(?: WITH .*| DIGRAPH.*)?")


def plain_letter(letter: str) -> str:
    """The letters of A-Z behind a Latin letter; itself where neither form nor name tells any."""
    if letter in PLAIN_FORMS:
        return PLAIN_FORMS[letter]
    parts = unicodedata.normalize("NFKD", letter)
    base = "".join(c for c in parts if not unicodedata.combining(c))
    if base != letter and base.isascii() and base.isalpha():
        return base
    named = _NAMED.fullmatch(unicodedata.name(base if len(base) == 1 else letter, ""))
    if not named:
        return letter
    return named[2].lower() if named[1] == "SMALL" else named[2]


# Punctuation and signs with a plain form.
PLAIN_PUNCTUATION = {
    "\u00a0": " ", "\u2002": " ", "\u2003": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
    "‘": "'", "’": "'", "‚": ",", "‛": "'", "“": '"', "”": '"', "„": ",,", "‟": '"',
    "‹": "<", "›": ">", "«": "<<", "»": ">>", "′": "'", "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
    "…": "...", "·": ".", "•": "*", "×": "*", "÷": "/", "¡": "!", "¿": "?",
    "©": "(C)", "®": "(R)", "™": "TM", "¼": " 1/4", "½": " 1/2", "¾": " 3/4",
}


#: Every letter and sign with another, plain form.
PLAIN = {c: plain_letter(c) for first, last in LATIN_BLOCKS for c in map(chr, range(first, last + 1))
         if c.isalpha()} | PLAIN_FORMS | PLAIN_PUNCTUATION
PLAIN = {c: plain for c, plain in PLAIN.items() if plain != c}
_SINGLE = {c: plain for c, plain in PLAIN.items() if len(plain) == 1}
_LONGER = {c: plain for c, plain in PLAIN.items() if len(plain) > 1}
_PLAIN_RUN = r"[\x00-\x7F]+|[^\x00-\x7F]"


def _sql(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _where_not_plain(step: str) -> str:
    """A SQL lambda: ``step`` of a text ``t`` that is not ASCII, else the text."""
    return f"t -> CASE WHEN t RLIKE {_sql(r'[^\x00-\x7F]')} THEN {step} ELSE t END"


def _fold_step() -> str:
    longer = "str_to_map({}, {}, {})".format(
        _sql("\n".join(f"{c}\t{plain}" for c, plain in _LONGER.items())), _sql("\n"), _sql("\t"))
    runs = f"regexp_extract_all(t, {_sql(_PLAIN_RUN)}, 0)"
    joined = f"array_join(transform({runs}, run -> coalesce(try_element_at({longer}, run), run)), '')"
    rest = f"regexp_replace({joined}, {_sql(r'([A-Za-z])[\u0300-\u036F]+')}, {_sql('$1')})"
    single = f"translate(t, {_sql(''.join(_SINGLE))}, {_sql(''.join(_SINGLE.values()))})"
    return _where_not_plain(f"get(transform(array({single}), {_where_not_plain(rest)}), 0)")


_FOLD = _fold_step()


def to_ascii(column: Column | str) -> Column:
    """Latin letters, quotes, dashes and signs in ASCII; marks after letters go (rule N24).

    One pass over the text replaces all letters with a single plain letter.  What is not plain
    then is cut into plain runs and single signs, which are looked up in one map of longer forms,
    and marks go.  The map is a constant and the step one parsed text, so that building the
    expression costs little however many columns are folded; one-element transforms name the
    text, so that no step is worked out twice.
    """
    return F.get(F.call_function("transform", F.array(as_column(column)), F.expr(_FOLD)), F.lit(0))


def replace_all(column: Column | str, rules: Iterable[tuple[str, str]]) -> Column:
    """Regex replacements in the order given; later rules see earlier results."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, as_column(column))


def clean_packed(column: Column | str, unwanted: str = DECLINED_ANSWERS) -> Column:
    """Drop unwanted answers from a ``;``-packed list and tidy the separators.

    One separator is stripped from each end before runs are collapsed, so a list
    that ended in two unwanted answers keeps one empty member.
    """
    return replace_all(column, [(unwanted, ""), (r"^;|;$", ""), (r";+", ";")])


def clean_members(column: Column | str, unwanted: str = DECLINED_ANSWERS) -> Column:
    """``clean_packed`` for an array column."""
    return F.split(clean_packed(F.array_join(as_column(column), ";"), unwanted), ";", -1)


def drop_parenthesised(column: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_column(column), r"\(.*\)", ""))


def slug(column: Column | str) -> Column:
    """Lower-case key with blanks as underscores."""
    return F.lower(F.regexp_replace(as_column(column), " ", "_"))


def slug_names(names: Sequence[str]) -> list[str]:
    """Header texts as unique lower-case identifiers."""
    result: list[str] = []
    seen: dict[str, int] = {}
    for name in names:
        plain = unicodedata.normalize("NFD", name.rstrip(" "))
        plain = "".join(c for c in plain if not unicodedata.combining(c)).lower()
        key = re.sub(r"_+", "_", re.sub(r"[^0-9a-z_]", "", plain.replace(" ", "_")))
        if not key or key[0].isdigit():
            key = f"x{key}"
        count = seen.get(key, 0)
        seen[key] = count + 1
        result.append(key if count == 0 else f"{key}{count}")
    return result


def percent_label(column: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(half_even(as_column(column) * 100, digits), digits), F.lit("%"))


def comma_label(column: Column | str, digits: int = 0) -> Column:
    return F.format_number(half_even(column, digits), digits)


def money_label(column: Column | str, prefix: str = "C$") -> Column:
    return F.concat(F.lit(prefix), comma_label(column, 0))


def times_label(column: Column | str, digits: int = 2) -> Column:
    return F.concat(F.format_number(half_even(column, digits), digits), F.lit("x"))


def ratio_label(column: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(half_even(column, digits), digits), F.lit(":1"))


def rank_label(rank: Column | str, label: Column | str) -> Column:
    return F.concat(as_column(rank).cast("string"), F.lit(". "), as_column(label))
