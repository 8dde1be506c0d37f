"""Language identification by compression with a dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, slices, text_of

#: Bytes of text compressed at once; longer texts are sums over their pieces.
PIECE = 4096
#: Bytes to spaces: ASCII but for letters. Case, digits and marks say little of a language.
PLAIN = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")


def language_samples(docs: DataFrame, learn: Column, per_language: int = 400, chars: int = 600) -> dict[str, tuple[bytes, float]]:
    """For each language a raw-content dictionary and the language's share of the documents to learn from.

    A dictionary holds texts of about `per_language` documents, spread over all by a hash of the id.

    At most `chars` characters of a document's middle go in. The documents are
    taken where `learn` holds, the language is not null and the text not empty.
    The dictionaries are the model: bounded by the number of languages times
    per_language times chars, whatever the input.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & (F.length(text_of()) > 0))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = {k: 2.0 * per_language / n for k, n in counts.items()}
    limits = F.create_map(*(F.lit(x) for k, v in sorted(share.items()) for x in (k, v)))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    middle = F.substring(F.col("text"), F.greatest(F.lit(1), (F.length("text") / 2 - chars / 2).cast("int")), F.lit(chars))
    some = known.where(place < F.element_at(limits, F.col("lang"))).select("lang", F.xxhash64("doc_id", F.lit(2)).alias("h"), middle.alias("text"))
    texts: dict[str, list[str]] = {}
    for r in some.orderBy("lang", "h", "text").collect():
        if len(own := texts.setdefault(r["lang"], [])) < per_language:
            own.append(r["text"])
    return {k: (b"\n".join(map(plain, v)), counts[k] / sum(counts.values())) for k, v in sorted(texts.items())}


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


def sizes(text: bytes, coders: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """The compressed size of the whole text under each dictionary."""
    parts = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in parts) for c in coders], np.int64)


def identify_languages(docs: DataFrame, samples: dict[str, tuple[bytes, float]], least_margin: float = 0.02, level: int = 5) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) for each document.

    A text, in lower case and without digits and ASCII marks, is compressed with
    each language's dictionary, and the language with
    the smallest result is chosen, the first by name of equals. margin is how much
    smaller it is than the second, as a share of the second; below
    `least_margin` the choice is marked as rejected. score is the posterior
    share of the choice when each saved bit counts as evidence, tempered. A null
    text, one without a letter, or any text when no language was learned is
    `und`, score 0 and rejected. Long texts are compressed whole, in pieces.
    Repeated rows each get their own result. Other columns are not read.
    """
    languages = list(samples)
    prior = np.array([-np.log2(share) / 8 for _, share in samples.values()])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = []
        for content, _ in samples.values():
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            coders.append(zstandard.ZstdCompressor(dict_data=words, compression_params=params))
        for batch in slices(batches):
            best, score, margin = [], [], []
            for text in batch.column("text").to_pylist():
                if not languages or text is None or not LETTER.search(text):
                    best.append("und")
                    score.append(0.0)
                    margin.append(0.0)
                    continue
                size = sizes(plain(text), coders) + prior
                order = np.argsort(size, kind="stable")
                gain = (size - size[order[0]]) / max(1.0, size[order[0]])
                best.append(languages[order[0]])
                score.append(float(1 / np.exp(-50 * gain).sum()))
                margin.append(float(1 - size[order[0]] / size[order[1]]) if len(order) > 1 else 1.0)
            rejected = [m < least_margin for m in margin]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(chosen, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean")


def learnable(by: int = 4, out: int = 2) -> Column:
    """Rows to learn from: crc32 of the id as text modulo `by` is not `out`."""
    return F.coalesce(remainder("doc_id", by) != out, F.lit(False))
