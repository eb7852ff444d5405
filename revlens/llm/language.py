"""Language ID by compression.

Per language one zstandard raw-content dictionary is filled from a bounded sample of
labelled texts. A text is cut into chunks, each chunk is compressed with every language's
dictionary, and the language with the smallest sum wins. Letters are lower-cased and
everything between words becomes one blank first, so that shouting and marks don't hide
the language. Where the margin to the second best is narrow, ``rejected`` is set (the best
guess is still returned in ``lang_pred``).

Bounds: the sample is at most ``PER_LANG`` texts for each of the ``LANGS`` most frequent
languages, a dictionary at most ``DICT_BYTES``; the model broadcast is their product. All
texts are classified whole, chunk by chunk. No shuffle but the sample's.

Defined cases: null text or a text without letters is ``und`` with score 0; ties go to the
language with more training rows; without any labelled row every text is ``und``; null
``doc_id`` is neither learned from nor held out; an empty table gives an empty result;
repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import documents

PER_LANG = 1000
LANGS = 256
DICT_BYTES = 256 << 10
LEVEL = 9
CHUNK = 4096
NARROW = 0.02

_BETWEEN = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-cased words joined by single blanks; empty if the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return b""
    return _BETWEEN.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_lang: int = PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, most frequent first, from ``labelled`` (text, lang), a bounded sample."""
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()
    if not counts:
        return {}
    # Rows whose hash lies below their language's threshold: a few times per_lang of each,
    # so that the ranking that follows meets no more, however frequent a language is.
    top = labelled.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, 4.0 * per_lang / r["count"])) for r in counts], "lang string, share double"
    )
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    some = rows.join(F.broadcast(top), "lang").withColumn("draw", draw).where("draw < share")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    filled: dict[str, bytearray] = {r["lang"]: bytearray() for r in counts}
    for r in some.withColumn("at", rank).where(F.col("at") <= per_lang).orderBy("lang", "at").toLocalIterator():
        if len(filled[r["lang"]]) < dict_bytes:
            filled[r["lang"]] += normal(r["text"]) + b"\n"
    return {lang: bytes(b[:dict_bytes]) for lang, b in filled.items() if b.strip()}


class Classifier:
    """Compressors of one task, one per language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.order = list(dictionaries)
        self.by = []
        for content in dictionaries.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(
                zstandard.ZstdCompressor(
                    dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        data = normal(text)
        if not data or not self.by:
            return "und", 0.0, True
        size = [sum(len(c.compress(data[i : i + CHUNK])) for i in range(0, len(data), CHUNK)) for c in self.by]
        best = min(range(len(size)), key=size.__getitem__)  # the first of equals: the more frequent
        if len(size) == 1:
            return self.order[0], 1.0, False
        second = min(size[:best] + size[best + 1 :])
        score = (second - size[best]) / second
        return self.order[best], score, score < NARROW


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score (relative margin, 0 to 1), rejected per row of ``docs`` (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = Classifier(model.value)
        for p in parts:
            found = [judged(t) for t in p["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": p["doc_id"],
                    "held_out": p["held_out"],
                    "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "rejected": [f[2] for f in found],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInPandas(
        judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return classify(docs, train(known))
