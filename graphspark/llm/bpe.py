"""BPE encoding and decoding (operator 2).

Encoder: an Aho-Corasick automaton over the vocabulary finds the tokens that start at each byte of a pre-token (those of one byte
are read off). A walk takes the longest token that fits after the one before it; where none fits it drops the last token and tries
that one's next shorter rival. Places that were given up are marked, so a place is tried once and the walk is linear. Two tokens fit
when merging their joint bytes by rank gives these two back: the table is filled as pairs appear, and has for a token and the longest
one beside it the rival that fits. A row of tokens that fit pairwise is the row that the merges give. Decoder: one byte string of all tokens with an offset table; ids become byte ranges of it.

Ids are packed as little-endian unsigned 32-bit integers in a binary column (``unpack`` turns them into an array). The vocabulary
file (1.5 MB, fixed) is read by the driver and broadcast.

Edge cases: null and empty texts have no ids and decode to the empty text; texts of any length are encoded whole, and a pre-token of
any length in linear time; ids outside the vocabulary decode to nothing; of merges with equal rank in a pre-token the one further left
comes first; repeated rows and null ids are rows of their own; an empty table gives an empty result; extra columns are kept as they are;
an output name that the input has already raises ``ValueError``.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, small_batches

#: The pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_PAIRS, CACHE_BYTES = 200_000, 250_000, 48
#: Where a token's id stands for no token.
NONE = -1


def byte_alphabet() -> dict[str, int]:
    """Character in a vocabulary file -> byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder over one vocabulary; a Python worker keeps it."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex

        spec = json.loads(vocabulary)
        alphabet = byte_alphabet()
        # Bytes are held as Latin-1 strings, one character each, as the automaton takes strings; all tables share one string a token.
        as_bytes = lambda token: sys.intern("".join(chr(alphabet[c]) for c in token))
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.rank = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[as_bytes(left), as_bytes(right)] = n
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pretokens = regex.compile(PRETOKEN).findall
        # The walk goes by ids; these lists have a place for each id.
        self.tokens = [""] * (max(self.ids.values(), default=-1) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.sizes, self.reach, self.packed = [len(t) for t in self.tokens], [len(t) - 1 for t in self.tokens], [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), NONE) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if len(token) > 1:
                self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.single = [self.ids.get(chr(b), NONE) for b in range(256)]  # most matches would be single bytes: these are read off
        self.made: dict[str, tuple] = {}  # token -> rank and halves of the merge that makes it
        for (left, right), n in self.rank.items():
            self.made.setdefault(sys.intern(left + right), (n, left, right))
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, int] = {}
        self.words = Words(self)
        pieces = {i: t.encode("latin-1") for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        sizes = np.array([len(pieces.get(i, b"")) for i in range(max(pieces, default=-1) + 1)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(sizes))), np.uint8)

    def merged(self, text: str) -> list[str]:
        """Plain merging by rank, for a pair's few bytes."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """What stands at the token's left (0) or right (1) edge while it is merged: parts, each with the rank of the merge that takes it up."""
        known = self.edges[side].get(token)
        if known is None:
            known = [(sys.intern(token), math.inf)]
            while (at := known[-1][0]) in self.made:
                rank, *halves = self.made[at]
                known.append((halves[side], rank))
            known.reverse()
            self.edges[side][sys.intern(token)] = known
        return known

    def fits(self, left: str, right: str) -> bool:
        """Whether the two stay apart: no merge over the border comes before the merges that take up what stands beside it."""
        if not left:
            return self.merged(right) == [right]
        before, after, i, j = self.edge(left, 1), self.edge(right, 0), 0, 0
        while True:
            (x, x_taken), (y, y_taken) = before[i], after[j]
            over = self.rank.get((x, y), math.inf)
            if over < x_taken and over <= y_taken:  # of equal merges the one further left comes first
                return False
            if x_taken == y_taken == math.inf:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1

    def follow(self, before: int, token: int) -> int:
        """The longest token that ``token`` begins with, itself included, that fits after ``before`` (``NONE``: at the start); ``NONE`` if none does."""
        place = before * len(self.tokens) + token
        known = self.pairs.get(place)
        if known is None:
            left, known = "" if before == NONE else self.tokens[before], token
            while known != NONE and not self.fits(left, self.tokens[known]):
                known = self.shorter[known]
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            self.pairs[place] = known
        return known

    def encode_pretoken(self, raw: bytes) -> list[int]:
        total, reach, sizes, pairs, n = len(raw), self.reach, self.sizes, self.pairs, len(self.tokens)
        longest = [*map(self.single.__getitem__, raw), NONE]
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end - reach[token]] = token  # of the tokens that start here, longer ones end later
        taken, given_up, at, before, token = [], bytearray(total + 1), 0, NONE, longest[0]
        while at < total:
            while token != NONE:
                fitting = pairs.get(before * n + token)
                token = self.follow(before, token) if fitting is None else fitting
                if token == NONE or not given_up[at + sizes[token]]:
                    break
                token = self.shorter[token]
            if token != NONE:
                taken.append(token)
                before = token
                at += sizes[token]
                token = longest[at]
            elif taken:  # nothing fits after the last token: this place is given up, and a shorter last token is tried
                given_up[at] = 1
                last = taken.pop()
                at -= sizes[last]
                before, token = taken[-1] if taken else NONE, self.shorter[last]
            else:
                raise ValueError("the vocabulary lacks a byte")
        return taken

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.split_special or not any(s in text for s in self.special):
            return b"".join(map(self.words.__getitem__, self.pretokens(text)))
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else b"".join(map(self.words.__getitem__, self.pretokens(part)))
            for part in self.split_special.split(text)
        )

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4").astype(np.int64)
        ids = ids[ids < len(self.offsets) - 1]
        if not len(ids):
            return ""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        return self.bytes[np.repeat(start - (ends - size), size) + np.arange(ends[-1])].tobytes().decode("utf-8", "replace")


class Words(dict):
    """Packed ids of pre-tokens seen lately, bounded in number and length: when full they become the older half, whose words come back as they are met."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            codec = self.codec
            packed = b"".join([codec.packed[i] for i in codec.encode_pretoken(word.encode())])
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed


def codec_of(vocabulary) -> Codec:
    """The worker's codec for a broadcast vocabulary."""
    return keep(("bpe", hash(vocabulary.value)), lambda: Codec(vocabulary.value))


def share_vocabulary(spark: SparkSession, path: str | None = None):
    """Broadcast a vocabulary file; by default the public ``byte_bpe_50k.json``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _with_column(df: DataFrame, source: str, field: T.StructField, run) -> DataFrame:
    if field.name in df.columns:
        raise ValueError(f"the input has a column {field.name} already")
    schema = T.StructType([*df.schema.fields, field])
    kind = pa.binary() if field.dataType == T.BinaryType() else pa.string()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run(batch.column(source)), kind)], [*batch.schema.names, field.name])

    return small_batches(df).mapInArrow(each, schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", vocabulary=None) -> DataFrame:
    """``df`` with a binary column of packed token ids of the whole text."""
    shared = vocabulary or share_vocabulary(df.sparkSession)
    return _with_column(df, text, T.StructField(out, T.BinaryType()), lambda texts: [codec_of(shared).encode(t.as_py()) for t in texts])


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", vocabulary=None) -> DataFrame:
    """``df`` with the text of the packed ids; bytes that are no UTF-8 become U+FFFD."""
    shared = vocabulary or share_vocabulary(df.sparkSession)
    return _with_column(df, ids, T.StructField(out, T.StringType()), lambda rows: [codec_of(shared).decode(r.as_py()) for r in rows])


def unpack(ids: str | Column) -> Column:
    """Packed ids as ``array<bigint>``."""
    digits = F.hex(F.col(ids) if isinstance(ids, str) else ids)
    byte = lambda i, k: F.substring(digits, i * 8 + k * 2 + 1, 2)
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(0), (F.length(digits) / 8).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.conv(F.concat(*(byte(i, k) for k in (3, 2, 1, 0))), 16, 10).cast("long"))


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of tokens and SHA-256 of the packed ids and of the decoded text."""
    shared = share_vocabulary(docs.sparkSession, path)
    both = decode(encode(docs.select("doc_id", "text"), vocabulary=shared).drop("text"), vocabulary=shared)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
