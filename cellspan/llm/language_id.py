"""Language identification by compression with per-language dictionaries.

Each language has a raw-content zstandard dictionary made of training texts.  A text
is compressed, block by block, with every dictionary; the language whose dictionary
gives the smallest total is chosen, and the choice is marked as rejected where the
margin to the next language is narrow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, slices

#: Content of a dictionary; the learner takes no more of a language than this.
DICT_BYTES = 96 << 10
#: A text is compressed in blocks, each against the fresh dictionary.
BLOCK_BYTES = 4 << 10
#: Candidate texts per language from which a dictionary is filled.
DICT_TEXTS = 400
#: Largest part of a dictionary that one text may give.
TEXT_SHARE = 1 << 10
LEVEL = 9
MIN_MATCH = 3
MIN_MARGIN = 0.02
UNDETERMINED = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letters_of(text: str) -> bytes:
    """Lower-cased runs of letters, one space between: marks and digits say little."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def _piece(text: str) -> Column:
    """``TEXT_SHARE`` characters of a text from a place that its hash draws; short texts whole."""
    start = F.pmod(F.xxhash64(text, F.lit(1)), F.greatest(F.length(text) - TEXT_SHARE + 1, F.lit(1)))
    return F.substring(text, start.cast("int") + 1, F.lit(TEXT_SHARE))


def learn_dictionaries(train: DataFrame, lang: str = "lang", text: str = "text", dict_bytes: int = DICT_BYTES, texts: int = DICT_TEXTS) -> dict[str, bytes]:
    """Dictionary content per language, most frequent language first.

    Counts per language cover all rows.  The number of distinct texts (estimated) sets,
    per language, a hash threshold that lets about ``4 * texts`` of them through; of these
    the ``texts`` smallest by hash are read, however many copies each has.  A text gives
    ``TEXT_SHARE`` bytes at most, from a place anywhere in it that its hash draws.  So the
    learner reads at most ``texts`` texts a language at any size of the input, and all
    texts of a small one.
    Rows with a null language or a null or empty text are not learnt from.
    """
    rows = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    order = F.xxhash64("text")
    tally = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(order).alias("d"))
    counts = {r["lang"]: max(1, r["d"]) for r in tally.orderBy(F.desc("n"), "lang").limit(BROADCAST_BYTES // dict_bytes + 1).collect()}
    if len(counts) * dict_bytes > BROADCAST_BYTES:
        raise ValueError(f"more than {BROADCAST_BYTES // dict_bytes} languages need too much for their dictionaries; lower dict_bytes")
    # the share of each language's distinct texts stands in the filter: texts aren't moved for it
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 4.0 * texts / n))).otherwise(share)
    drawn = rows.where((F.pmod(order, F.lit(1 << 20)) / F.lit(float(1 << 20))) < share)
    drawn = drawn.select("lang", _piece("text").alias("data"), order.alias("h")).dropDuplicates(["lang", "h"])
    ranked = drawn.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= texts)
    out: dict[str, bytearray] = {n: bytearray() for n in counts}
    for r in ranked.orderBy("lang", F.desc("r")).toLocalIterator():
        data = letters_of(r["data"])[:TEXT_SHARE] + b" "
        if len(out[r["lang"]]) + len(data) <= dict_bytes:
            out[r["lang"]] += data
    return {k: bytes(v) for k, v in out.items()}


class CompressionClassifier:
    """Compressed size of a text under every language's dictionary."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL):
        self.langs = list(content)
        self.coders = []
        for name in self.langs:
            params = zstandard.ZstdCompressionParameters.from_level(level, source_size=BLOCK_BYTES, dict_size=len(content[name]), min_match=MIN_MATCH, write_content_size=False)
            data = zstandard.ZstdCompressionDict(content[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(compression_params=params, dict_data=data))

    def sizes(self, text: str) -> list[int]:
        data = letters_of(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin).  The margin is relative to the next size.

        The score is the smallest size's share of the odds ``2 ** (-excess)`` where
        the excess is counted in hundredths of the smallest size.
        """
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, 0.0
        sizes = self.sizes(text)
        least = min(sizes)
        score = 1.0 / sum(2.0 ** -min(1000.0, 100.0 * (s - least) / least) for s in sizes)
        rest = sorted(sizes)[1:2]
        margin = (rest[0] - least) / rest[0] if rest else 1.0
        return self.langs[sizes.index(least)], score, margin


def identify_languages(docs: DataFrame, content: dict[str, bytes], key: str = "doc_id", text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Per row: key, lang_pred, score (0 to 1), margin, rejected (margin is narrow).

    ``und`` with score 0 for a null text, one without any letter, or no languages at
    all.  Ties go to the language with more training rows.  Rows keep their
    multiplicity; null keys are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(shared.value)
        for piece in slices(batches):
            done = [model.classify(t) for t in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.float64()), pa.array([d[2] for d in done], pa.float64())], ["key", "lang_pred", "score", "margin"])

    out = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, margin double")
    return out.withColumnRenamed("key", key).withColumn("rejected", (F.col("lang_pred") != UNDETERMINED) & (F.col("margin") < min_margin))
