"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash (hash and displace) resolves whole pre-tokens that are in the
vocabulary. A pre-token that is not there is merged from its bytes: the bytes form a doubly linked
list and a heap gives the adjacent pair of the lowest rank, leftmost first; ranks come from the same
perfect hash. A task remembers what recent pre-tokens came to, up to a fixed number of bytes, and
forgets it at its end, so that reused Python workers keep nothing for the stages that follow.

The driver reads the vocabulary file (its size is checked) and broadcasts the hash; the work is one
map over the documents without any shuffle.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; every
input row gives one output row, repeated rows included; long texts are split at safe places (between
a character and white space after it), so that the list of pre-tokens stays bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: A vocabulary file beyond this size is refused rather than broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
#: Pre-tokens, or byte pairs, of one generation that a task remembers; two generations are kept. And the longest one kept, in bytes.
MEMO, LONGEST = 150_000, 64
#: Characters after which a long text is split at the next safe place.
PIECE = 1 << 18
#: Bytes of results after which a batch is handed over.
OUT_BYTES = 8 << 20


#: An odd constant by which displacements are spread (2^32 over the golden ratio).
SPREAD = 0x9E3779B1
#: Stands for no rank.
NONE = -1


class PerfectHash:
    """Minimal perfect hash over byte strings: as many slots as keys; a lookup takes one hash and one comparison."""

    def __init__(self, ranks: dict[bytes, int]):
        self.n = n = len(ranks)
        self.n_buckets = n // 4 + 1
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in ranks:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.n_buckets, []).append((h, key))
        free = set(range(n))
        for b, entries in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(entries) == 1:  # a bucket with one key names its slot outright
                slots = [free.pop()]
                self.shift[b] = -slots[0] - 1
            else:
                d = 0
                while True:
                    slots = [((h >> 17) ^ d * SPREAD) % n for h, _ in entries]
                    if len(set(slots)) == len(slots) and free.issuperset(slots):
                        break
                    d += 1
                self.shift[b] = d
                free.difference_update(slots)
            for slot, (_, key) in zip(slots, entries, strict=True):
                self.keys[slot], self.values[slot] = key, ranks[key]

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.n_buckets]
        slot = -d - 1 if d < 0 else ((h >> 17) ^ d * SPREAD) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class Recent(dict):
    """What keys came to: the keys of late in the mapping itself, those of the generation before in older.

    A key that is asked for again moves to the young generation, so frequent keys outlive rare ones.
    """

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def value_of(self, key: str | bytes) -> int | bytes:
        raise NotImplementedError

    def __missing__(self, key: str | bytes) -> int | bytes:
        value = self.older.get(key)
        if value is None:
            value = self.value_of(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Ranks(Recent):
    """Ranks of neighbours' bytes taken together, NONE if they are no entry."""

    def __init__(self, vocabulary: PerfectHash):
        super().__init__()
        self.vocabulary = vocabulary

    def value_of(self, pair: bytes) -> int:
        rank = self.vocabulary.get(pair)
        return NONE if rank is None else rank


class Codec(Recent):
    """Encodes and decodes; as a mapping it holds the packed ids of pre-tokens."""

    def __init__(self, vocabulary: PerfectHash, pattern: str):
        super().__init__()
        self.vocabulary, self.pattern, self.ranks = vocabulary, regex.compile(pattern), Ranks(vocabulary)
        self.packed = {v: v.to_bytes(4, "little") for v in vocabulary.values}
        self.bytes_of = dict(zip(vocabulary.values, vocabulary.keys, strict=True))

    def value_of(self, token: str) -> bytes:
        raw = token.encode("utf-8", "replace")
        whole = self.vocabulary.get(raw)
        return self.packed[whole] if whole is not None else self.merged(raw)

    def merged(self, raw: bytes) -> bytes:
        """Ids of a pre-token that isn't in the vocabulary: a heap over linked bytes."""
        n, rank = len(raw), self.ranks.__getitem__
        bits = n.bit_length()
        low = (1 << bits) - 1
        stop = list(range(1, n + 1))  # where the part that begins at i ends; 0 once it is merged into its left
        before = list(range(-1, n))  # where the part to the left begins
        # An entry of the heap is one integer: rank, begin of the pair, its end.
        heap = [((r << bits | i) << bits) + i + 2 for i in range(n - 1) if (r := rank(raw[i : i + 2])) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end, i = entry & low, entry >> bits & low
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue  # one of the two has changed since
            stop[i], stop[j] = end, 0
            if end < n:
                before[end] = i
                k = stop[end]
                if (r := rank(raw[i:k])) >= 0:
                    heappush(heap, (r << bits | i) << bits | k)
            if (left := before[i]) >= 0 and (r := rank(raw[left:end])) >= 0:
                heappush(heap, (r << bits | left) << bits | end)
        out, i, packed = [], 0, self.packed
        while i < n:
            k = stop[i]
            if (r := rank(raw[i:k])) < 0:
                raise ValueError(f"the vocabulary lacks the byte string {raw[i:k]!r}")
            out.append(packed[r])
            i = k
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(b"".join(map(self.__getitem__, self.pattern.findall(text, a, b))) for a, b in pieces(text))

    def decode(self, packed: bytes) -> bytes:
        of, view = self.bytes_of, memoryview(packed).cast("I")
        return b"".join(b"".join(map(of.__getitem__, view[k : k + PIECE].tolist())) for k in range(0, len(view), PIECE))


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Spans that cover text and end where a match of the pattern must end: before white space that follows something else."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + PIECE, n)
        while end < n and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        yield start, end
        start = end


def load(spark: SparkSession, vocabulary_path: str) -> PerfectHash:
    """The vocabulary of a rank file (base64 bytes and rank a line), read by Spark from wherever it lies."""
    path = vocabulary_path if "://" in vocabulary_path else f"file://{vocabulary_path}"
    try:
        data = open(vocabulary_path, "rb").read(MAX_VOCABULARY_BYTES + 1)  # noqa: SIM115
    except OSError:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_path} has over {MAX_VOCABULARY_BYTES} bytes")
    return PerfectHash({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())})


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, n_tokens, ids (packed, little-endian unsigned 32-bit), decoded (the bytes they stand for).

    decoded comes from the ids alone, so that a round trip can be compared with the text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(spark, vocabulary_path))
    chosen = docs.select(F.col(key), F.col(text))
    schema = T.StructType([chosen.schema[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            start, held, ids, back = 0, 0, [], []
            for at in range(batch.num_rows):
                packed = codec.encode(batch[1][at].as_py() or "")
                ids.append(packed)
                back.append(codec.decode(packed))
                held += len(packed) + len(back[-1])
                if held >= OUT_BYTES or at + 1 == batch.num_rows:
                    yield pa.record_batch([batch[0].slice(start, len(ids)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=schema.names)
                    start, held, ids, back = at + 1, 0, [], []

    return chosen.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (bytes) for each row of packed ids; null ids decode to no bytes. An id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load(spark, vocabulary_path))
    chosen = encoded.select(F.col(key), F.col(ids))
    schema = T.StructType([chosen.schema[0], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value, pattern)
        for batch in batches:
            yield pa.record_batch([batch[0], pa.array([codec.decode(x.as_py() or b"") for x in batch[1]], pa.binary())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """n_tokens and the SHA-256 of ids and of decoded bytes."""
    return encoded.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(encode(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
