"""Language by compression: the smallest size under a zstandard dictionary of each language wins.

The dictionary of a language is raw content: pieces of text of a bounded sample of its documents
(``DOCUMENTS`` distinct texts, ``PIECES`` pieces of at most ``PIECE`` characters, ``DICTIONARY`` bytes). A text
is compressed whole, in blocks of ``BLOCK`` bytes so that the dictionary and not the text's own past
decides, once with each dictionary; letter case is ignored. The score is how much smaller the best total is than the second best,
scaled to 0 to 1; below ``MARGIN`` the answer counts as rejected. Ties go to the language with more documents.

A null text, or one without a letter, is ``und`` with score 0 and rejected, and so is every text if nothing was
learned. With one language learned, every other text is that language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiercurve.llm.common import bounded_sample, fields, remainder

DOCUMENTS, PIECES, PIECE, DICTIONARY, BLOCK, LEVEL = 400, 1000, 500, 128 << 10, 2 << 10, 5
MARGIN = 0.02
UNKNOWN = "und"


def dictionaries(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """The dictionary of each language, those with more documents first."""
    known = docs.where(learn & F.col("text").isNotNull()).select("lang", "text")
    sample, counts = bounded_sample(known, "lang", F.col("text"), DOCUMENTS, repeated=True)
    pieces = sample.distinct().select("lang", F.explode(F.expr(f"regexp_extract_all(text, '[^\\\\n]{{1,{PIECE}}}', 0)")).alias("piece")).distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    rows = pieces.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIECES).orderBy("lang", "place").collect()
    out: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        out[lang] = b"\n".join(r["piece"].lower().encode() for r in rows if r["lang"] == lang)[-DICTIONARY:]
    return out


def sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> list[int]:
    blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def language(docs: DataFrame, learn: Column) -> DataFrame:
    """``(doc_id, lang_pred, score, rejected)`` of every row of ``docs``; ``learn`` says whose ``lang`` may be used."""
    known = dictionaries(docs.select("doc_id", "text", "lang"), learn)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(known)
        compressors = []
        for content in known.values():
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)
            )
        for batch in batches:
            best, scores = [], []
            for text in batch.column("text").to_pylist():
                if not names or not text or not any(map(str.isalpha, text)):
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                found = np.array(sizes(text.lower().encode(), compressors), float)
                winner = int(found.argmin())
                rest = np.delete(found, winner)
                best.append(names[winner])
                scores.append(float(1 - np.exp(-10 * (1 - found[winner] / rest.min()))) if len(rest) else 1.0)
            score = np.array(scores)
            columns = [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score), pa.array(score < 1 - np.exp(-10 * MARGIN))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    out = fields([docs.schema["doc_id"]], "lang_pred string, score double, rejected boolean")
    return docs.select("doc_id", "text").mapInArrow(told, out)


def query(docs: DataFrame) -> DataFrame:
    """Predictions with held-out rows marked: those whose remainder is 2 are not learned from."""
    key = remainder(F.col("doc_id"), 4)
    return language(docs, key != 2).select("doc_id", F.coalesce(key == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
