"""Text expressions: tokens, sentences, accents, substrings, normalised names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: A small stopword list.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def spaced(text: Column) -> Column:
    """tokens() as one string with a space between each two: smaller to write, and handed to Python as a whole. See parted()."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TOKEN.replace("[", "[^"), " "))


def parted(spaced: Column) -> Column:
    """tokens() from spaced()."""
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def spaced_lines(text: Column) -> Column:
    """tokens() as one string, a space between each two and a line feed behind it where a line of the text ends between them; the string may begin and end with these."""
    other, inline = r"[^\p{L}\p{N}]", r"[^\n\p{L}\p{N}]"
    # one match for all that stands between two tokens; it never gives back, so that long stretches take one pass
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"(?={other}){inline}*+(\n?){other}*+", " $1")


def marked(spaced: Column, phrase: list[str], mark: str = "*") -> Column:
    """spaced() or spaced_lines() with the mark behind each token that is part of the phrase (one token at least), of overlapping places and of such over line ends too."""
    begins, gap, ends = r"(?<![^ \n])", r" \n?", "(?![^ ])"
    terms = [*map(_quoted, phrase)]
    # a match is one token, so that places may share tokens; what stands before is asked last
    parts = [f"{t}{ends}(?={''.join(gap + x for x in terms[k + 1 :])}{ends})(?<={begins}{gap.join(terms[: k + 1])})" for k, t in enumerate(terms)]
    return F.regexp_replace(spaced, f"{begins}(?:{'|'.join(parts)})", f"$0{mark}")


def words(text: Column) -> Column:
    """Lower-case parts between white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def cased(text: Column) -> Column:
    """Runs of letters and digits as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


#: Tokenizers by name: a text column to an array of terms.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"tokens": tokens, "words": words, "cased": cased}


def register_tokenizer(name: str, tokenizer: Callable[[Column], Column]) -> None:
    if name in TOKENIZERS:
        raise ValueError(f"there is a tokenizer {name}")
    TOKENIZERS[name] = tokenizer


def tokenizer(name: str) -> Callable[[Column], Column]:
    if name not in TOKENIZERS:
        raise KeyError(f"no tokenizer {name}; known: {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name]


def visible(html: Column) -> Column:
    """What a page shows: without scripts, styles, comments and tags, white space compacted."""
    bare = F.regexp_replace(strip_comments(html), r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return compact_spaces(F.regexp_replace(bare, r"<[^>]*>", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value made once: the optimizer may write a column's expression out wherever the column stands, inside lambdas too, but not a lambda's variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts that end at a full stop, an exclamation or a question mark, or at a line's end."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: s != "")


def between(text: Column, left: str, right: str) -> Column:
    """What stands between the first left and the next right; null without both."""
    return F.nullif(F.regexp_extract(text, f"(?s){_quoted(left)}(.*?){_quoted(right)}", 1), F.lit(""))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def take_before(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def take_after_last(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, -1)


def compact_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->", " ")


def _folds() -> tuple[str, str]:
    """Letters with marks of the Latin, Greek and Cyrillic blocks, and the letters without them: those that decompose into one base and marks alone."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = [c for c in parts if not unicodedata.combining(c)]
        if len(parts) > 1 and len(base) == 1:
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _folds()


def fold_accents(text: Column) -> Column:
    """Letters without their marks: precomposed ones, and combining marks behind any letter."""
    return F.translate(F.regexp_replace(text, "[\u0300-\u036f]", ""), MARKED, PLAIN)


def normal_name(text: Column) -> Column:
    """A title as a dictionary form: no parenthesis, blanks for underscores, lower case, no accents."""
    return fold_accents(F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"\(.*$", ""), "_", " "))))


def links(html: Column) -> Column:
    """array of struct(href, text) of the anchors of a page."""
    whole = F.regexp_extract_all(html, F.lit(r'(?s)<a href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(whole, lambda a: F.struct(F.regexp_extract(a, '<a href="([^"]*)"', 1).alias("href"), F.regexp_extract(a, "(?s)<a [^>]*>(.*?)</a>", 1).alias("text")))


def categories(text: Column) -> Column:
    """The parts between commas of what stands in parentheses, trimmed."""
    inner = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))
    return F.filter(F.flatten(F.transform(inner, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))), lambda y: y != "")


def json_unescaped(text: Column) -> Column:
    """A text between the quotes of a JSON string, without its escapes; null if it is none."""
    return F.from_json(F.concat(F.lit('{"x":"'), text, F.lit('"}')), "x string")["x"]


def url_encoded(text: Column) -> Column:
    return F.url_encode(text)


def url_decoded(text: Column) -> Column:
    return F.try_url_decode(text)


def take_after(text: Column, mark: str) -> Column:
    """What stands behind the first mark; the whole text without one."""
    return F.when(F.instr(text, mark) > 0, F.substr(text, F.instr(text, mark) + len(mark))).otherwise(text)


def take_before_last(text: Column, mark: str) -> Column:
    """What stands before the last mark; the whole text without one."""
    parts = F.size(F.split(text, _quoted(mark))) - 1
    return F.when(parts > 0, F.substr(text, F.lit(1), F.char_length(text) - F.char_length(F.substring_index(text, mark, -1)) - len(mark))).otherwise(text)


def remove_front(text: Column, mark: str) -> Column:
    return F.when(text.startswith(mark), F.substr(text, F.lit(len(mark) + 1))).otherwise(text)


def remove_back(text: Column, mark: str) -> Column:
    return F.when(text.endswith(mark), F.substr(text, F.lit(1), F.char_length(text) - len(mark))).otherwise(text)


def counts_of(values: Column) -> Column:
    """Map from each value of an array to how often it stands there; sorted first, so that it takes one pass."""
    runs = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("key"), i.alias("at"))), lambda p: F.coalesce(F.get(s, p["at"] - 1) != p["key"], F.lit(True)))
    ends = lambda s, r: F.transform(r, lambda p, k: F.struct(p["key"].alias("key"), (F.coalesce(F.get(r, k + 1)["at"], F.size(s)) - p["at"]).alias("value")))
    return F.map_from_entries(let(F.array_sort(values), lambda s: let(runs(s), lambda r: ends(s, r))))


def merged_maps(a: Column, b: Column) -> Column:
    """Two maps of numbers added."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def string_hash(text: Column) -> Column:
    """The 32-bit hash of a string's UTF-16 units by which h becomes 31 h + unit: what hash-numbered vocabularies count by."""
    code = F.transform(F.split(text, ""), lambda c: F.call_function("ascii", c).cast("long"))
    pair = lambda c: F.array(55296 + F.shiftright(c - 65536, 10), 56320 + (c - 65536).bitwiseAND(1023))
    units = F.flatten(F.transform(F.filter(code, lambda c: c > 0), lambda c: F.when(c > 65535, pair(c)).otherwise(F.array(c))))
    h = F.aggregate(units, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
