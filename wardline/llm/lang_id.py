"""Language identification by compression.

Each language has a dictionary, raw text joined from a bounded sample of
labelled documents.  Texts are read as their words in lower case, letters
only, each word once, so that marks and repetition say nothing.  A text's words
are cut into pieces, every piece is compressed by zstandard with each
dictionary, and the language whose dictionary gives the fewest bytes in total
is chosen.  A text is rejected when its margin, the
share of bytes by which the best beats the second, is narrow, or when nothing
can be said.

The sample is bounded by a parameter: of each language, the ``SAMPLES``
texts with the least hash give a slice of ``SLICE`` characters each, from a
place drawn from the hash.  It is reduced before the
exchange and is the only thing that reaches the driver: languages x SAMPLES x
SLICE characters.  All texts are classified whole.

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; with no labelled text at all every text is.  With one language the
score is 1.  Ties go to the language with more labelled documents, then to the
first in code-point order.
Null languages are not learned.  Very long texts are compressed piece by
piece.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm import wordhash as wh

SAMPLES = 128
SLICE = 1024
LEVEL = 12
PIECE = 1024  # bytes
MARGIN = 0.004
UNKNOWN = "und"


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", samples: int = SAMPLES, size: int = SLICE) -> dict[str, bytes]:
    """The dictionaries: language to raw text, at most ``samples`` x ``size`` characters each."""
    text = rows[text_col].cast("string")
    drawn = rows.where(rows[lang_col].isNotNull() & text.rlike(r"\p{L}")).select(
        rows[lang_col].cast("string").alias("lang_"), text.alias("text_"), F.xxhash64(text).alias("hash_")
    )
    room = F.greatest(F.char_length("text_") - size, F.lit(0)) + 1
    place = F.pmod(F.shiftright("hash_", 20), room.cast("long")).cast("int")
    drawn = drawn.select("lang_", "hash_", F.substring(F.col("text_"), place + 1, F.lit(size)).alias("slice_"))
    # Copies of one text count once, or a large group of them would fill the sample.
    nth = F.row_number().over(Window.partitionBy("lang_").orderBy("hash_"))
    chosen = drawn.select("lang_", "hash_").distinct().withColumn("nth_", nth).where(F.col("nth_") <= samples)
    taken = drawn.join(chosen, ["lang_", "hash_"]).groupBy("lang_", "nth_").agg(F.min("slice_").alias("slice_")).collect()
    sizes = {row["lang_"]: row["count"] for row in drawn.groupBy("lang_").count().collect()}
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in taken:
        parts.setdefault(row["lang_"], []).append((row["nth_"], row["slice_"]))
    order = sorted(parts, key=lambda lang: (-sizes[lang], lang))
    return {lang: " ".join(letters(part) for _, part in sorted(parts[lang])).encode() for lang in order}


_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> str:
    """All words of a text in lower case, in order, letters only."""
    return " ".join(_OTHER.sub(" ", text).lower().split())


def compressed_sizes(text: bytes, packers: list, piece: int = PIECE) -> np.ndarray:
    """Total bytes of a text under every dictionary."""
    parts = [text[at : at + piece] for at in range(0, len(text), piece)]
    return np.array([sum(len(pack(part)) for part in parts) for pack in packers], np.float64)


def _packers(dictionaries: dict[str, bytes], level: int) -> list:
    out = []
    for raw in dictionaries.values():
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        packer = zstandard.ZstdCompressor(
            level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        out.append(packer.compress)
    return out


def judge(sizes: np.ndarray) -> tuple[int, float, float]:
    """(best, score, margin) of one text's sizes.

    The score is the best language's share when every byte saved halves the
    odds of the others.
    """
    best = int(np.argmin(sizes))
    if len(sizes) == 1:
        return best, 1.0, 1.0
    others = np.delete(sizes, best)
    margin = float((others.min() - sizes[best]) / others.min())
    score = float(1.0 / (1.0 + np.sum(np.exp2(-np.minimum(others - sizes[best], 1000.0)))))
    return best, score, margin


def _classify(dictionaries: dict[str, bytes], level: int, margin: float):
    names = list(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = _packers(dictionaries, level) if names else []
        for batch in wh.small_batches(batches, "text_"):
            texts = batch.column("text_").fill_null("")
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            langs, scores, margins = [], [], []
            for text, usable in zip(texts, lettered, strict=True):
                if usable and packers:
                    best, score, gap = judge(compressed_sizes(letters(text.as_py()).encode(), packers))
                    langs.append(names[best])
                else:
                    langs.append(UNKNOWN)
                    score = gap = 0.0
                scores.append(score)
                margins.append(gap)
            gaps = np.array(margins)
            rejected = (gaps < margin) | np.array([lang == UNKNOWN for lang in langs], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gaps, pa.float64()), pa.array(rejected)],
                names=["row", "lang_pred", "score", "margin", "rejected"],
            )

    return run


def predict(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", keep: Column | None = None, level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """(row, lang_pred, score, margin, rejected) of every row; ``row`` is ``keep``, by default a struct of all columns."""
    kept = F.struct("*") if keep is None else keep
    rows = df.select(kept.alias("row"), df[text_col].cast("string").alias("text_"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_classify(dictionaries, level, margin), f"row {kind}, lang_pred string, score double, margin double, rejected boolean")
