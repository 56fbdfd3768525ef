"""Language identification by compression: the dictionary that encodes a text smallest names its language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import map_batches, pieces, table

UNKNOWN = "und"
#: The learned sample: at most so many documents of a language, and so many bytes of each, in pieces from all over its text.
SAMPLE_DOCS, SAMPLE_BYTES, SNIPPETS = 512, 512, 4
#: Bytes of a text that are encoded at once; each block meets the whole dictionary again.
BLOCK, LEVEL = 2048, 6
#: A block is encoded after pieces of its language's sample, of so many bytes, and what it adds is counted: entropy coding
#: needs a start, and sizes would tie. One piece does for each REPEAT bytes that the block falls short of, up to all.
PIECES, PIECE, REPEAT = 8, 256, 1024
#: The most languages that can be learned.
MAX_LANGUAGES = 1000
#: A prediction is marked as rejected where the second smallest encoding is larger by less than this part.
MIN_MARGIN = 0.02

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The words of a text in lower case, one space between them; empty if it has no letter."""
    if text is None:
        return b""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return words.encode("utf-8", "ignore") if any(map(str.isalpha, words)) else b""


def snippets(words: bytes) -> bytes:
    """Up to SAMPLE_BYTES of a text: evenly spaced pieces from its first byte to its last."""
    if len(words) <= SAMPLE_BYTES:
        return words
    size = SAMPLE_BYTES // SNIPPETS
    starts = [i * (len(words) - size) // (SNIPPETS - 1) for i in range(SNIPPETS)]
    return b" ".join(words[i : i + size] for i in starts)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a sample of at most SAMPLE_DOCS documents of each.

    The sample is by the hash of key and text, so it is the same in every run, its size doesn't grow with the table, and
    a key that comes often counts once for each of its texts. Rows with a null language, key or text aren't learned from.
    """
    rows = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("k is not null and t is not null and l is not null")
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    scale = 1 << 40
    part = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        part = F.when(F.col("l") == lang, F.lit(min(scale, scale * SAMPLE_DOCS // n))).otherwise(part)
    drawn = rows.withColumn("h", F.xxhash64("k", "t")).where(F.pmod("h", F.lit(scale)) < part).select("l", "h", "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([snippets(letters(x)) for x in b.column(2).to_pylist()], pa.binary())], ["l", "h", "s"])

    # Repeated rows merge before they are numbered, so a language has about SAMPLE_DOCS rows here, and then no more.
    each = map_batches(drawn, cut, "l string, h long, s binary").where("s <> X''").distinct()
    numbered = each.withColumn("i", F.row_number().over(Window.partitionBy("l").orderBy("h", "s"))).where(F.col("i") <= SAMPLE_DOCS)
    found: dict[str, list] = {}
    for r in numbered.collect():
        found.setdefault(r.l, []).append((r.i, bytes(r.s)))
    texts = {lang: b" ".join(s for _, s in sorted(x)) for lang, x in found.items()}
    return {lang: t for lang, t in sorted(texts.items()) if len(t) >= 8}


def _encoder(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs, self.coders = sorted(dictionaries), []
        for x in self.langs:
            sample = dictionaries[x]
            pieces = [sample[i * PIECE : (i + 1) * PIECE] + b" " for i in range(PIECES)]
            # Pieces aren't part of the dictionary, unless it would be too small without them.
            rest = sample[PIECES * PIECE :]
            e = _encoder(rest if len(rest) >= 8 else sample)
            self.coders.append((e, pieces, [len(e.compress(p)) for p in pieces]))

    def sizes(self, words: bytes) -> list[tuple[float, str]]:
        """Bytes that each language takes for the text, smallest first: of each block, the mean of what it adds after some pieces."""
        cost = [0.0] * len(self.langs)
        for k, at in enumerate(range(0, len(words), BLOCK)):
            block = words[at : at + BLOCK]
            n = min(PIECES, -(-REPEAT // len(block)))
            for i, (e, pieces, alone) in enumerate(self.coders):
                cost[i] += sum(len(e.compress(pieces[(k + j) % PIECES] + block)) - alone[(k + j) % PIECES] for j in range(n)) / n
        return sorted((max(1.0, c), x) for c, x in zip(cost, self.langs, strict=True))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        words = letters(text)
        if not words or not self.langs:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(words)
        if len(sizes) == 1:
            return sizes[0][1], 1.0, False
        margin = 1 - sizes[0][0] / sizes[1][0]
        return sizes[0][1], margin / (margin + MIN_MARGIN), margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for each row of docs.

    score is margin / (margin + MIN_MARGIN), where margin is by what part the best encoding is smaller than the
    second; rejected marks margins under MIN_MARGIN, and ties go to the first language by name. A null text, or one
    without a letter, is `und`, score 0, rejected; so is everything when no language was learned. Texts are read
    whole, in blocks. Repeated rows and null ids each give a row; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for b in pieces(batches):
            lang, score, rejected = zip(*(classify(x) for x in b.column(1).to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    found = identify(docs, learn(docs.where(fold != 0)))
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
