"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, quoted, tune, with_made

#: Texts of each language that are learned from, at most: a bounded sample of labelled rows. A dictionary has DICT_BYTES, to
#: which all these texts give equal shares, in pieces of PIECE bytes spread evenly over the whole of a text.
TEXTS, DICT_BYTES, PIECE = 400, 110 << 10, 256
#: A text is compressed in blocks of this size; later blocks would otherwise be matched with the text itself.
BLOCK_BYTES, LEVEL = 4096, 5
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def letters(data: bytes) -> bytes:
    """UTF-8 with A-Z lower-cased and each run of other ASCII characters as one space: markup says nothing of a language."""
    out = _FOLD[np.frombuffer(data, np.uint8)]
    gap = out == 32
    gap[1:] &= out[:-1] == 32
    gap[:1] &= out[:1] == 32
    return out[~gap].tobytes()


def spread(data: bytes, size: int) -> bytes:
    """Up to size bytes of data: all of it, or pieces that are spread evenly over it."""
    if len(data) <= size:
        return data
    n = max(1, size // PIECE)
    starts = np.linspace(0, len(data) - size // n, n).astype(int)
    return b" ".join(data[a : a + size // n] for a in starts)


def shares(sizes: list[int], total: int) -> list[int]:
    """How much each may give so that all give as much as they have or the same share, and no more than total in all."""
    out, left = [0] * len(sizes), total
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    for k, i in enumerate(order):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def learn_dictionaries(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """A raw-content dictionary of DICT_BYTES at most for every language of df, from up to TEXTS of its texts.

    Texts are taken in the order of a hash of the id, then of the text; null languages, and null and empty texts, are left
    out. A language whose texts have no letters gets a dictionary of blanks. An empty table gives no dictionary.

    The labels are counted first, without the texts; one pass over the texts then serves all languages: rows beyond four
    times a language's sample go by their hash before anything moves. What the driver gets, and each worker holds, grows
    with the number of languages, by DICT_BYTES each for the dictionaries.
    """
    tune(df.sparkSession)
    text, lang = quoted(text_col).cast("string"), quoted(lang_col).cast("string")
    h = F.pmod(F.when(quoted(id_col).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(quoted(id_col))), F.lit(1 << 40))
    counts = {r.lang: r["count"] for r in df.where(lang.isNotNull()).groupBy(lang.alias("lang")).count().collect()}
    if not counts:
        return {}
    rows = df.where(lang.isNotNull() & (F.length(text) > 0)).select(lang.alias("lang"), h.alias("h"), text.alias("text"))
    # each text may give four times its equal share, as shorter texts leave room
    told = [(k, (4 * TEXTS << 40) // max(n, 4 * TEXTS), max(PIECE, 4 * DICT_BYTES // min(n, TEXTS))) for k, n in counts.items()]
    bounds = df.sparkSession.createDataFrame(told, "lang string, bound long, most long")

    @F.arrow_udf("binary")
    def pieces(texts: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([spread(letters(t.encode("utf-8", "surrogatepass")), n) for t, n in zip(texts.to_pylist(), most.to_pylist())], pa.binary())

    # a row a language: less than the dictionaries that each worker holds
    near = rows.join(F.broadcast(bounds), "lang").where("h <= bound").select("lang", "h", pieces("text", "most").alias("piece"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "piece"))
    some = near.withColumn("place", place).where(F.col("place") <= TEXTS).select("lang", "place", "piece").collect()
    by: dict[str, list[tuple[int, bytes]]] = {}
    for r in some:
        by.setdefault(r.lang, []).append((r.place, bytes(r.piece)))
    out = {}
    for name, found in sorted(by.items()):
        own = [p for _, p in sorted(found)]
        part = shares([len(p) + 1 for p in own], DICT_BYTES)
        out[name] = b" ".join(spread(p, max(0, n - 1)) for p, n in zip(own, part))[:DICT_BYTES].ljust(8)
    return out


class Compressors:
    """The compressors of a worker, one a language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.by_lang = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by_lang.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and relative margin of the runner-up, by size over all blocks; ties go to the first name."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        data = letters(text.encode("utf-8", "surrogatepass"))
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.by_lang]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        return self.langs[best], (second - sizes[best]) / second


def identify_language(df: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.002) -> DataFrame:
    """df with lang_pred, score (the margin, 0 to 1) and accepted (a language is known and the margin is at least min_margin).

    lang_pred is `und` for a null text, one without a letter, and where nothing was learned. Every whole text is
    compressed, block by block. Columns of df that bear one of the three names are replaced; all others, of any type,
    pass through; repeated rows each get their answer; an empty table gives an empty one.
    """
    tune(df.sparkSession)

    @F.arrow_udf("lang string, score double")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compressors = Compressors(dictionaries)
        for t in texts:
            found = [compressors.predict(x) for x in t.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

    (own,) = fresh(df, "found")
    rows = df.withColumn(own, predict(quoted(text_col).cast("string")))
    lang, score = F.col(own)["lang"], F.col(own)["score"]
    made = F.struct(lang.alias("lang_pred"), score.alias("score"), ((lang != UNKNOWN) & (score >= min_margin)).alias("accepted"))
    return with_made(rows, made, ["lang_pred", "score", "accepted"]).drop(own)
