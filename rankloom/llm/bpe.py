"""Byte-level BPE with the tokenizers library: encoding with offsets, and decoding, over Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, tune, with_made

#: Characters of text handed to the library at once: it holds about a hundred bytes for each token of a call.
CALL_CHARS = 1 << 18
#: Characters of matches, and 32 for each, that a worker remembers with their ids.
KNOWN_CHARS = 1 << 25
#: Texts with other characters are split by the library: of these letters, digits and spaces no Unicode version differs.
OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the library that merges by rank, as text.

    pattern: one of the byte-level family, whose matches hold no white space but a leading space, or only white space.

    Rank files list tokens, not merges. Every way to split a token into two tokens is given as a merge at the token's
    rank, so that, as with ranks, any neighbours whose concatenation is a token can merge.
    """
    chars = byte_characters()
    name = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append([name[token[:cut]], name[token[cut:]]])
    return json.dumps({
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": None,
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
        ]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges},
    })


class Codec:
    """Encoder and decoder of a worker process."""

    _made: dict[str, Codec] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        of = {c: b for b, c in enumerate(byte_characters())}
        vocab = parsed["model"]["vocab"]
        table: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for word, rank in vocab.items():
            table[rank] = bytes(of[c] for c in word)
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = None if "(?<" in pattern else regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.room = KNOWN_CHARS
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    @classmethod
    def of(cls, spec: str) -> Codec:
        key = hashlib.md5(spec.encode()).hexdigest()
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, by the library; a null text is empty. Texts go to the library in calls of CALL_CHARS or one text,
        and of these each match of the pattern that is not known from before, once."""
        part: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            part.append(text or "")
            size += len(part[-1])
            if size >= CALL_CHARS or i + 1 == len(texts):
                yield from self._call(part)
                part, size = [], 0

    def _matches(self, text: str) -> list[str] | None:
        """The pattern's matches; None where the library splits the text."""
        if self.pattern is None or len(text) > CALL_CHARS or not text.isascii() and OTHER.search(text):
            return None
        found = self.pattern.findall(text)
        return found if sum(map(len, found)) == len(text) else None

    def _call(self, part: list[str]) -> Iterator[np.ndarray]:
        split = [self._matches(t) for t in part]
        own = set().union(*(m for m in split if m is not None))
        new = [m for m in own if m not in self.known]
        if sum(map(len, new)) + 32 * len(new) > self.room:
            self.known, self.room, new = {}, KNOWN_CHARS, list(own)
        self.room -= sum(map(len, new)) + 32 * len(new)
        found = self.tokenizer.encode_batch_fast(new + [t for t, m in zip(part, split) if m is None], add_special_tokens=False)
        for m, e in zip(new, found):
            self.known[m] = np.array(e.ids, "<u4").tobytes()
        whole = iter(found[len(new) :])
        for m in split:
            yield np.array(next(whole).ids, "<u4") if m is None else np.frombuffer(b"".join(map(self.known.__getitem__, m)), "<u4")

    def offsets(self, ids: np.ndarray, text: str | None) -> np.ndarray:
        """(n, 2): the characters of text that each id touches, from the first to after the last.

        An id's bytes are known, and so is the character that each byte of the text belongs to; an id that holds a part of
        a character has the whole character, as the library gives it.
        """
        if not len(ids):
            return np.zeros((0, 2), np.int64)
        stop = np.cumsum(self.lengths[ids])
        start = stop - self.lengths[ids]
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return np.stack([char[start], char[stop - 1] + 1], axis=1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; a character split over tokens is whole again in the bytes. Unknown ids raise IndexError."""
        ids = ids.astype(np.int64)
        n = self.lengths[ids]
        total = int(n.sum())
        shift = np.repeat(self.begin[ids] - (np.cumsum(n) - n), n)
        return self.bytes[shift + np.arange(total)].tobytes()

    def decode_text(self, ids: np.ndarray) -> str:
        """As text; bytes that are no whole character become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")


def _shared(df: DataFrame, spec: str):
    return df.sparkSession.sparkContext.broadcast(spec)  # as large as the vocabulary, whatever the data


def encode(df: DataFrame, spec: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """df with `ids` (array of int) and, if asked for, `starts` and `ends` (character offsets).

    A null text is encoded as an empty one: no ids. Texts of any length are encoded whole; other columns pass through,
    those with the new names are replaced; repeated rows and empty tables need no care.
    """
    tune(df.sparkSession)
    shared = _shared(df, spec)

    @F.arrow_udf("ids array<int>, starts array<long>, ends array<long>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(shared.value)
        for t in texts:
            own = t.to_pylist()
            found = list(codec.encode(own))
            at = [codec.offsets(x, text) if offsets else None for x, text in zip(found, own)]
            ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            ends = [pa.array([None if o is None else o[:, k] for o in at], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.StructArray.from_arrays([ids, *ends], ["ids", "starts", "ends"])

    return with_made(df, run(quoted(text_col).cast("string")), ["ids", "starts", "ends"] if offsets else ["ids"])


def decode(df: DataFrame, spec: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded` (bytes) and `decoded_text`; null ids give null."""
    tune(df.sparkSession)
    shared = _shared(df, spec)

    @F.arrow_udf("decoded binary, decoded_text string")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(shared.value)
        for c in columns:
            raw = [None if x is None else codec.decode(np.array(x, np.uint32)) for x in c.to_pylist()]
            text = [None if x is None else x.decode("utf-8", "replace") for x in raw]
            yield pa.StructArray.from_arrays([pa.array(raw, pa.binary()), pa.array(text, pa.string())], ["decoded", "decoded_text"])

    return with_made(df, run(quoted(ids_col)), ["decoded", "decoded_text"])


def digest(df: DataFrame, spec: str, text_col: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256, decoded_sha256 and offsets_sha256: encodes and decodes in one pass, without moving the
    ids. offsets_sha256 is of the (start, end) character offsets as little-endian unsigned 32-bit integers, in turn."""
    tune(df.sparkSession)
    shared = _shared(df, spec)
    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "offsets_sha256": pa.string()}

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(shared.value)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for t in texts:
            own = t.to_pylist()
            rows = [(len(ids), sha(ids.tobytes()), sha(codec.decode(ids)), sha(codec.offsets(ids, text).astype("<u4").tobytes())) for ids, text in zip(codec.encode(own), own)]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    return with_made(df, run(quoted(text_col).cast("string")), list(kinds))
