"""Joins of intervals of places in documents, and spans of markup.

Intervals are half-open. A join's key is the document and a bucket of WIDTH places: an interval goes to the buckets it touches, a
place to its own, so that a document of any length is dealt over many keys, and rows meet only where they are near.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN

#: Places of a bucket. Lines and slices are about as long; longer intervals are copied once a bucket.
WIDTH = 64


def _bucket(place: Column, width: int) -> Column:
    return F.floor(place / width)


def _spread(intervals: DataFrame, begin: Column, end: Column, width: int) -> DataFrame:
    return intervals.withColumn("__bucket", F.explode(F.sequence(_bucket(begin, width), _bucket(F.greatest(end - 1, begin), width))))


def stabbed(places: DataFrame, intervals: DataFrame, width: int = WIDTH) -> DataFrame:
    """All columns of places (doc_id, pos, ...) and of intervals (doc_id, begin, end, ...): a row for each place and interval that holds it.

    Intervals without a place hold none. A place is in one bucket, so each pair comes once.
    """
    filled = _spread(intervals.filter("end > begin"), F.col("begin"), F.col("end"), width)
    return places.withColumn("__bucket", _bucket(F.col("pos"), width)).join(filled, ["doc_id", "__bucket"]).filter("pos >= begin and pos < end").drop("__bucket")


def overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, begin, end, start, size and all else of left (doc_id, begin, end) and right (doc_id, start, size): a row for each two that overlap.

    Two that share several buckets count in the one where the later of them begins.
    """
    a = _spread(left, F.col("begin"), F.col("end"), width)
    b = _spread(right, F.col("start"), F.col("start") + F.col("size"), width)
    later = _bucket(F.greatest("begin", "start"), width)
    return a.join(b, ["doc_id", "__bucket"]).filter((F.col("begin") < F.col("start") + F.col("size")) & (F.col("start") < F.col("end")) & (F.col("__bucket") == later)).drop("__bucket")


#: Elements that never hold anything.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Comments; scripts and styles whole; tags; tokens. As text, so that the queries' SQL can use it too.
MARKUP = r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|" + TOKEN
_SCAN = regex.compile(MARKUP, regex.S)
_NAME = regex.compile(r"</?([a-z][a-z0-9:-]*)")


def scanned(text: str) -> tuple[list[str], list[tuple[str, int, int, int, int]]]:
    """Tokens of a lower-case page and its spans: tag, number in order of opening tags, first token, token behind the last, tags open around it.

    A closing tag ends the last open one of its name, so that spans may cross; one without an open tag is passed over; tags that
    stay open end with the text. Void elements, scripts and styles are empty. What isn't a name behind a bracket is no tag.
    """
    tokens: list[str] = []
    spans: list[list] = []
    opened: dict[str, list[int]] = {}
    depth = 0
    for m in _SCAN.finditer(text):
        piece = m[0]
        if piece[0] != "<":
            tokens.append(piece)
        elif name := _NAME.match(piece):
            if piece[1] == "/":
                if own := opened.get(name[1]):
                    spans[own.pop()][3] = len(tokens)
                    depth -= 1
                continue
            spans.append([name[1], len(spans), len(tokens), len(tokens), depth])
            if name[1] not in VOID and not (name[1] in ("script", "style") and "</" in piece):
                opened.setdefault(name[1], []).append(len(spans) - 1)
                depth += 1
    for own in opened.values():
        for k in own:
            spans[k][3] = len(tokens)
    return tokens, [tuple(s) for s in spans]


#: Pages whose tokens and spans a task holds at once.
PAGES = 32


def marked_up(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, terms, spans (array of tag, no, begin, end, depth) for each page: one pass over its text. A null text has none of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("tag", pa.string()), *((c, pa.int64()) for c in ("no", "begin", "end", "depth"))]))
        for batch in (whole.slice(at, PAGES) for whole in batches for at in range(0, len(whole), PAGES)):
            found = [scanned(t or "") for t in batch[1].to_pylist()]
            spans = pa.array([[dict(zip(("tag", "no", "begin", "end", "depth"), s, strict=True)) for s in spans] for _, spans in found], kind)
            yield pa.record_batch([batch[0], pa.array([t for t, _ in found], pa.list_(pa.string())), spans], names=["doc_id", "terms", "spans"])

    rows = pages.select(F.col(key).cast("long").alias("doc_id"), F.lower(html).alias("html"))
    return rows.mapInArrow(run, "doc_id long, terms array<string>, spans array<struct<tag:string,no:bigint,begin:bigint,end:bigint,depth:bigint>>")


def markup_spans(pages: DataFrame, tags: list[str] | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, tag, no, begin, end, depth of the given tags (None: all) in pages."""
    rows = marked_up(pages, key, html).select("doc_id", F.inline("spans"))
    return rows if tags is None else rows.filter(F.col("tag").isin(tags))
