"""Operator 5: language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled texts. Texts are lower-cased
and ASCII non-letters become single spaces, so that case, digits and punctuation say nothing. A text
is encoded with every dictionary, in pieces of ``PIECE`` bytes that together cover it, and takes the
language whose encoding is smallest; ``score`` is the margin (1 - smallest / second smallest, 0 to 1). A
margin under ``MARGIN`` is narrow: ``keep_identified`` rejects such documents.

Training uses a bounded sample: about ``SAMPLE_DOCS`` documents a language, chosen by a hash, of each a piece
of ``SAMPLE_CHARS`` characters that begins anywhere in the text, up to ``DICT_BYTES`` a language; with very
many languages each gets an equal part of ``MODEL_BYTES``. Prediction sees whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0. Equal sizes choose the language
first in alphabetical order, with score 0. With one learned language, the score is 1 where it applies;
with none, every prediction is ``und``. A language of no more than a few letters is filled up with spaces. More
than ``MAX_LANGUAGES`` languages raise an error: they are no languages. A null lang or doc_id trains nothing. Repeated rows are
predicted alike; an empty table gives no rows. Result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagegrain.llm.columns import pack, unpack
from pagegrain.sources.pages import spread

DICT_BYTES = 128 << 10
SAMPLE_DOCS = 200
SAMPLE_CHARS = 2000
MODEL_BYTES = 64 << 20
MAX_LANGUAGES = 10_000
PIECE = 8192
LEVEL = 6
MARGIN = 0.005
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS_ONLY).split())


def held_out() -> Column:
    """Whether a document is kept out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from the rows with a lang, a doc_id and a text that are not held out."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    # What is collected is bounded as the model is: with many languages, fewer and shorter pieces of each.
    dict_bytes = min(dict_bytes, MODEL_BYTES // len(sizes))
    chars = min(SAMPLE_CHARS, 2 * dict_bytes)
    wanted = min(sample_docs, -(-4 * dict_bytes // chars))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    shares = docs.sparkSession.createDataFrame([(lang, int(min(1.0, wanted / n) * (1 << 40))) for lang, n in sizes.items()], "lang string, share long")
    begin = 1 + F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.lit(1), F.length("text") - chars + 1))
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id").join(F.broadcast(shares), "lang").filter(draw < F.col("share"))
    rows = rows.select("lang", F.substring(F.col("text"), begin.cast("int"), F.lit(chars)).alias("text"), draw.alias("draw"), "doc_id")
    found: dict[str, bytearray] = {lang: bytearray() for lang in sizes}
    for r in sorted(rows.collect(), key=lambda r: (r.draw, r.doc_id, r.text)):
        if len(found[r.lang]) < dict_bytes:
            found[r.lang] += normalise(r.text) + b" "
    return {lang: bytes(x[:dict_bytes]).ljust(9) for lang, x in sorted(found.items()) if x}


def _encoders(model: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, raw in sorted(model.items()):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str | None, encoders: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    if not text or not encoders or not _LETTER.search(text):
        return UNKNOWN, 0.0
    raw = normalise(text)
    pieces = [raw[at : at + PIECE] for at in range(0, len(raw), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in encoders)
    return sizes[0][1], 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone."""
    docs = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = _encoders(sent.value)
        for batch in batches:
            found = [classify(t.as_py(), encoders) for t in batch.column("text")]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def keep_identified(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` without the documents whose language is unknown or won by a narrow margin."""
    kept = identify(pack(docs, "text"), model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= margin))
    return unpack(kept, docs.columns, "text")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
