"""Personal data with offset-preserving deobfuscation.

Base detectors read the text as it is. Transducers then rewrite disguises (homoglyphs and full-width
forms, invisible characters, spelled digits, bracketed or spelled "at" and "dot", "plus"), the same
detectors read the normalised text, and each span found there is mapped back to source characters.
A span is added only if it rests on a rewritten character and touches no base span of its kind.

One map over the documents without a shuffle; every detector takes time in proportion to the text,
whatever the text, so very long texts need no cut.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows give repeated
rows; offsets are code points of the source, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As the contract's pattern: a match can begin inside a run of digits only if it could begin at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

# Letters of other scripts and the ASCII letters they look like, in natural order.
ARMENIAN = dict(zip("\u0563\u0566\u0570\u0578\u057d\u0585", "gqhnuo", strict=True))
CYRILLIC = dict(zip("\u0405\u0406\u0408АВЕКМНОРСТУХавекморсух\u0455\u0456\u0458\u04bb\u04c0\u04cf\u0501\u051b\u051d", "SIJABEKMHOPCTYXabekmopcyxsijhIldqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ\u03f2", "ABEZHIKMNOPTYXaikvopuxc", strict=True))
LATIN = dict(zip("\u0131\u0251\u0261\u210e\u212a", "iaghK", strict=True))
#: Full-width forms stand at a fixed distance from ASCII, mathematical letters are thirteen alphabets in a row (each A-Z, a-z); the other digits' blocks begin at these code points.
HOMOGLYPHS = {ord(k): v for k, v in (ARMENIAN | CYRILLIC | GREEK | LATIN).items()}
HOMOGLYPHS |= {0xFF01 + k: chr(0x21 + k) for k in range(94)} | {0x1D400 + k: chr((65, 97)[k // 26 % 2] + k % 26) for k in range(13 * 52)}
HOMOGLYPHS |= {start + k: str(k) for start in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
HOMOGLYPHS |= {0x00A0: " ", 0x2007: " ", 0x202F: " ", 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2024: ".", 0x3002: "."}
ODD = frozenset(map(chr, HOMOGLYPHS))
#: Soft hyphen, zero-width space, non-joiner and joiner, word joiner, byte order mark.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

# The English names of the digits.
NAMES = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
NAME = "(?:" + "|".join(NAMES) + ")"
DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
AT = r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?"
#: After a bare " at " these begin no host.
COMMON = "(?:a|all|an|any|each|every|her|his|its|least|most|my|our|that|the|their|these|this|those|your)"
#: Before a bare " at " and a host with a plain dot these are no name of a mailbox, whatever stands before them.
ORDINARY = "|".join(["and", "are", "at", "back", "be", "by", "call", "here", "him", "is", "it", "me", "online", "or", "out", "page", "site", "that", "them", "there", "this", "up", "us", "was", "website", "you"])
#: What announces an address, right before a mailbox.
LABEL = r"(?:address|contact|e-?mail|mail|reach|write)(?:s|ed|es|ing)?"
# Top-level domains that a host with a plain dot must end with, the general ones and those of larger countries.
TOP_LEVEL = frozenset("com org net edu gov mil int info biz name pro io dev app ai co me tv ac ae ar at au be bg br ca ch cl cn cz de dk eg es eu fi fr gr hk hu id ie il in ir is it jp kr lt lu lv mx my ng nl no nz pe ph pl pt ro rs ru sa se sg si sk th tr tw ua uk us vn za".split())
#: One mark that parts digits.
GAP = "[ -]"
#: What is rewritten. A bare " at " counts only before a host with a disguised dot, or where _address() holds;
#: a digit's name only beside another, a figure or a disguised dot.
REWRITE = re.compile(
    rf"(?P<at>{AT})|(?P<bare>(?<=[A-Za-z0-9])\sat\s(?!{COMMON}\b)(?=[A-Za-z0-9-]+(?:(?:{DOT}|\.)[A-Za-z0-9-]+)*(?:{DOT}|\.)[A-Za-z]{{2,}}\b))"
    rf"|(?P<dot>(?<=[A-Za-z0-9]){DOT}(?=[A-Za-z0-9]))|(?P<plus>\bplus\s(?=[0-9]|{NAME}\b))"
    rf"|(?P<digits>\b{NAME}(?:{GAP}{NAME})+\b|(?<=[0-9]{GAP}){NAME}\b|\b{NAME}(?={GAP}[0-9])|(?<=dot\s){NAME}\b|(?<=[\])}}>]){NAME}\b|(?<=[\])}}>]\s){NAME}\b|\b{NAME}(?={DOT}))",
    re.IGNORECASE,
)
NOT_SEEN = re.compile(f"[{INVISIBLE}]+")
#: One of these stands in the case-folded form of every text that a transducer can change, but for look-alikes; quicker to look for.
TRIGGER = re.compile(
    rf"[\[({{<]\s?(?:at|dot|@|\.)|\sdot\s|\sat\s[a-z0-9-]+(?:{DOT}|\.)|[{INVISIBLE}]|plus\s(?:[0-9]|{NAME})|{NAME}(?:{GAP}(?:[0-9]|{NAME})|{DOT})|(?:[0-9]{GAP}|dot\s|[\])}}>]\s?){NAME}"
)
#: A word before a bare " at " that is made as mailboxes are: letters with a digit or with an inner dot, underscore, plus or percent sign.
MAILBOX = re.compile(r"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9._%+-]*[A-Za-z])[A-Za-z0-9-]*(?:[0-9._%+][A-Za-z0-9._%+-]*)?[A-Za-z0-9]$")
MADE = re.compile(r"[0-9]|(?<=[A-Za-z0-9])[._%+]")
NAMED = re.compile(rf"\b{LABEL}[\s:=,(<\"'-]+(?:(?:to|via|address)[\s:=,(<\"'-]+)?(?!(?:{ORDINARY})$)[A-Za-z-]+$", re.IGNORECASE)
PLAIN_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?![A-Za-z0-9-]|\sdot\s)")
#: Characters before a bare " at " that are looked at.
BEFORE = 64
ANY_NAME = re.compile(NAME, re.IGNORECASE)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, from each @ outwards."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            floor = m.end()
            out.append((start, floor))
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    digits = NOT_DIGIT.sub("", s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def _is_phone(s: str) -> bool:
    return 8 <= len(NOT_DIGIT.sub("", s)) <= 15


def detect(text: str) -> list[list[tuple[int, int]]]:
    """Spans for each of KINDS."""
    found = [emails(text), [], [], []]
    if DIGIT.search(text):
        for k, pattern, holds in ((1, IP, _is_ip), (2, CARD, _is_card), (3, PHONE, _is_phone)):
            found[k] = [m.span() for m in pattern.finditer(text) if holds(m[0])]
    return found


class Transducer:
    """A text with some parts replaced, and the way back: runs of characters kept or replaced."""

    def __init__(self, source: str, parts: Iterable[tuple[int, int, str]]):
        self.begins, self.runs, out, at, n = [], [], [], 0, 0
        for start, end, new in parts:
            for text, a, b, kept in ((source[at:start], at, start, True), (new, start, end, False)):
                if text or not kept:
                    self.begins.append(n)
                    self.runs.append((a, b, kept))
                    out.append(text)
                    n += len(text)
            at = end
        self.begins.append(n)
        self.runs.append((at, len(source), True))
        self.text = "".join(out) + source[at:]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether it holds anything replaced."""
        first = bisect_right(self.begins, start) - 1
        last = bisect_right(self.begins, end - 1) - 1
        a, _, kept = self.runs[first]
        b0, b1, kept_last = self.runs[last]
        a = a + start - self.begins[first] if kept else a
        b = b0 + end - self.begins[last] if kept_last else b1
        return a, b, any(not kept for _, _, kept in self.runs[first : last + 1])


def _odd(text: str) -> bool:
    return not (text.isascii() or ODD.isdisjoint(text))


def _address(text: str, at: int, host: str) -> bool:
    """Whether a bare " at " that begins there and a host with plain dots are an address, by their structure: the host ends in a known top-level
    domain, in lower case unless all of it is in upper case, and what stands before is made like a mailbox or announced."""
    top = host.rpartition(".")[2]
    if top.lower() not in TOP_LEVEL or not (top.islower() or host.isupper()):
        return False
    before = text[max(0, at - BEFORE) : at]
    m = MAILBOX.search(before)
    return bool(m and MADE.search(m[0]) or NAMED.search(before))


def _disguises(text: str) -> Iterator[tuple[int, int, str]]:
    for m in REWRITE.finditer(text):
        kind = m.lastgroup
        if kind == "bare" and (host := PLAIN_HOST.match(text, m.end())) and not _address(text, m.start(), host[0]):
            continue
        new = {"at": "@", "bare": "@", "dot": ".", "plus": "+"}.get(kind)
        yield m.start(), m.end(), "".join(NAMES[x.lower()] for x in ANY_NAME.findall(m[0])) if new is None else new


class Normalised:
    """A text after three transducers: look-alikes, one character for one; invisible characters go; disguises are rewritten."""

    def __init__(self, source: str):
        same = source.translate(HOMOGLYPHS) if _odd(source) else source
        self.changed = [i for i, (a, b) in enumerate(zip(source, same, strict=True)) if a != b] if same is not source else []
        self.seen = Transducer(same, ((m.start(), m.end(), "") for m in NOT_SEEN.finditer(same)))
        self.plain = Transducer(self.seen.text, _disguises(self.seen.text))
        self.text = self.plain.text

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether it holds anything rewritten."""
        a, b, rewritten = self.plain.back(start, end)
        a, b, gone = self.seen.back(a, b)
        return a, b, rewritten or gone or bisect_right(self.changed, b - 1) > bisect_right(self.changed, a - 1)


def added(text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Spans that show only in the normalised text."""
    if not (_odd(text) or TRIGGER.search(text.casefold())):
        return [[], [], [], []]
    plain = Normalised(text)
    out = []
    for spans, old in zip(detect(plain.text), base, strict=True):
        begins, new = [a for a, _ in old], []
        for span in spans:
            a, b, rewritten = plain.back(*span)
            k = bisect_right(begins, b - 1)
            if rewritten and not (k and old[k - 1][1] > a):
                new.append((a, b))
        out.append(new)
    return out


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: key, n_email, n_ip, n_card, n_phone (base spans), base (base spans as text), spans (all), n_added."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(key), F.col(text))
    counts = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    schema = T.StructType([chosen.schema[0], *counts, T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch[1]:
                t = value.as_py() or ""
                base = detect(t)
                more = added(t, base)
                rows.append((*map(len, base), joined(base), joined([sorted(a + b) for a, b in zip(base, more, strict=True)]), sum(map(len, more))))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([batch[0], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

    return chosen.mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
