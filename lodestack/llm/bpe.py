"""Byte-level BPE encoding and decoding with forced-boundary splitting.

No merge joins two bytes that stand side by side in no token of the vocabulary, so a cut between them is certain.
A pretoken falls into fragments at such cuts; each is merged by itself and the results are concatenated. Fragments are short and
repeat, so most are looked up. Spark deals the documents; a task keeps bounded tables of what it has merged.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import documents

#: The characters that count as white space in the pretoken pattern, and the pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
FINE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^SPACE\p{L}\p{N}]+|[SPACE]+(?![^SPACE])|[SPACE]+".replace("SPACE", SPACE)
LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
#: Every match is one or more whole pretokens: a space opens a pretoken whenever other than white space follows it, and a
#: run of letters ends one unless what follows may be a letter too.
COARSE = re.compile(f" ?[{LATIN}]++(?![^\\x00-\\u024f])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
CACHE_ENTRIES = 350_000
CACHE_KEY = 64
#: Fragments of up to so many bytes are merged by plain scans.
SHORT = 64
NONE = 1 << 62
DEFAULT = "byte_bpe_50k.json"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Memo(dict):
    """A bounded table of results; when it is full it starts anew."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_KEY:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


class Vocabulary:
    """The bytes of each token of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._read(json.load(f))

    def _read(self, spec: dict) -> None:
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.token_bytes = [b""] * (max([*self.tokens.values(), *self.special.values()]) + 1)
        for t, i in [*self.tokens.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.token_bytes[i] = t

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids outside the vocabulary add nothing, broken UTF-8 becomes U+FFFD."""
        known = len(self.token_bytes)
        if ids and not 0 <= min(ids) <= max(ids) < known:
            ids = [i for i in ids if 0 <= i < known]
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class ByteBpe(Vocabulary):
    def _read(self, spec: dict) -> None:
        super()._read(spec)
        letters, tokens, model = byte_letters(), self.tokens, spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        as_bytes = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in pairs]
        # the pair a, b under a << 20 | b: its rank above 20 bits, the merged token below
        self.merge = {tokens[a] << 20 | tokens[b]: rank << 20 | tokens[a + b] for rank, (a, b) in reversed(list(enumerate(as_bytes)))}
        self.byte_ids = [tokens[bytes([b])] for b in range(256)]
        self.inside = bytearray(1 << 16)
        for t in tokens:
            for a, b in zip(t, t[1:], strict=False):
                self.inside[a << 8 | b] = 1
        self.fine = regex.compile(FINE)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.fragments = Memo(self._word), Memo(self._fragment, CACHE_ENTRIES // 4)

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of a pretoken between byte pairs that no token holds."""
        inside, start, before, out = self.inside, 0, -1, []
        for k, c in enumerate(piece):
            if k and not inside[before << 8 | c]:
                out.append(piece[start:k])
                start = k
            before = c
        out.append(piece[start:])
        return out

    def _fragment(self, fragment: bytes) -> bytes:
        ids = [self.byte_ids[b] for b in fragment]
        return array("i", self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)).tobytes()

    def _merged(self, ids: list[int]) -> list[int]:
        """Merge the pair of least rank, the leftmost first, until none is left."""
        get = self.merge.get
        found = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (least := min(found)) < NONE:
            i = found.index(least)
            ids[i : i + 2] = [new] = [least & 0xFFFFF]
            del found[i]
            if i:
                found[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(found):
                found[i] = get(new << 20 | ids[i + 1], NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for fragments of any length."""
        n, get = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := get(ids[i] << 20 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = found & 0xFFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get(new << 20 | ids[k], NONE)) < NONE:
                    heapq.heappush(heap, (found, i, new, ids[k]))
            if (h := before[i]) >= 0 and (found := get(ids[h] << 20 | new, NONE)) < NONE:
                heapq.heappush(heap, (found, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        letters = word[1:] if word[0] == " " else word
        pieces = [word] if letters.isalpha() else self.fine.findall(word)
        return b"".join([self.fragments[f] for piece in pieces for f in self.cuts(piece.encode("utf-8", "surrogatepass"))])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, COARSE.findall(text)))
        parts = self.split_special.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else b"".join(map(self.words.__getitem__, COARSE.findall(p))) for k, p in enumerate(parts))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One for each Python worker and file."""
    return ByteBpe(path)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what stands in memory beside them."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow string column one by one, null as empty; bytes that aren't UTF-8 become U+FFFD."""
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encoded(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    """The ids of each text, null as empty."""
    found = [bpe.encode(t) for t in texts_of(texts)]
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))


def decoded(known: Vocabulary, ids: pa.ListArray) -> pa.Array:
    """The text of each list of ids, null as empty."""
    flat = ids.values.fill_null(-1).to_numpy()
    ends = ids.offsets.to_numpy().tolist()
    return pa.array([known.decode(flat[i:j].tolist()) if ok else "" for i, j, ok in zip(ends, ends[1:], ids.is_valid().to_pylist(), strict=False)], pa.string())


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """docs with the token ids of column `text` in an array<int> column `ids`.

    A null text has no ids, like an empty one. A column that is already named `ids` is replaced. Every row is encoded by itself, so repeated rows
    and ties need no rule; an empty table gives no rows.
    """
    path = path or public_tokenizers.path(DEFAULT)
    rest = [c for c in docs.columns if c != ids]
    source = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([*batch.columns, encoded(tokenizer(path), batch.column(at))], [*rest, ids])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """rows with the text of column `ids` in a string column `text`, which replaces one of that name. Null ids give an empty text."""
    path = path or public_tokenizers.path(DEFAULT)
    rest = [c for c in rows.columns if c != text]
    source = rows.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch([*batch.columns, decoded(vocabulary(path), batch.column(at))], [*rest, text])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for docs(doc_id, text).

    A null text is empty: no tokens, and the digests of nothing. Rows are taken one by one, so repeated rows agree and doc_id may be null. An
    empty table gives no rows; other columns, whatever their names, aren't read. One pass, so that a core runs one Python worker and the
    ids are not sent back to be decoded.
    """
    path = path or public_tokenizers.path(DEFAULT)
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = encoded(tokenizer(path), batch.column(1))
            yield pa.record_batch([batch.column(0), ids, decoded(tokenizer(path), ids)], ["doc_id", "ids", "decoded"])

    both = source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
