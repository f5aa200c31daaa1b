"""Language identification by compression: the dictionary that shortens a text most names its language.

Per language a zstandard raw-content dictionary is made of a bounded sample of labelled texts. A text is lower-cased,
stripped of ASCII signs and digits, cut into pieces of a few kilobytes (all of them are used) and compressed with
each dictionary; pieces keep the dictionary's part in the result as large for long texts as for short ones. Where that leaves two
languages close (short or repetitive texts) the distinct words are encoded once more with a finer search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import give_back, hashed_below, slices, stored

#: Bounds of the sample that the dictionaries are fitted on, per language.
SAMPLE_TEXTS = 96
DICTIONARY_BYTES = 96 << 10
PIECE_BYTES = 2048
LEVEL = 3
#: Below this margin the distinct words of a text are encoded again, with matches from three bytes on.
SECOND_LOOK = 0.05
UNDETERMINED = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def clean(text: str) -> bytes:
    """Lower-cased words with one space between; ASCII signs and digits count as space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language -> raw dictionary content, from (text, lang); rows without text or language are left out.

    Languages come in order of their distinct texts, most first: ties of ``identify`` go to the more frequent one.

    The sample is ``texts`` different texts of each language at most, chosen by their hash.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("h")
    keys = stored(known.select("lang", "h").distinct(), "keys")
    counts = stored(keys.groupBy("lang").count(), "counts")
    order_of = [r["lang"] for r in counts.orderBy(F.desc("count"), "lang").toLocalIterator()]
    some = keys.join(counts, "lang").where(hashed_below(F.col("h"), F.col("count"), texts)).select("lang", "h")
    least = stored(some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= texts).drop("k"), "sample")
    rows = known.join(least, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    share = max(1, size // texts)
    fitted: dict[str, list[bytes]] = {}
    for r in rows.orderBy("lang", "h").toLocalIterator():
        fitted.setdefault(r["lang"], []).append(clean(r["text"]))
    out = {}
    for lang in order_of:
        all_texts = fitted.get(lang, [])
        room, cut = size, []
        for n, t in enumerate(sorted(all_texts, key=len)):  # short texts leave their room to longer ones
            take = t[:max(share, room // (len(all_texts) - n))]
            cut.append(take)
            room -= len(take)
        if content := b" ".join(c for c in cut if c)[:size]:
            out[lang] = content
    return out


@lru_cache(maxsize=4)
def _compressors(langs: tuple[tuple[str, bytes], ...], fine: bool) -> list[zstandard.ZstdCompressor]:
    kind = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, **kind)
    if fine:
        params = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=18, hash_log=18, search_log=6, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTULTRA, **kind)
    out = []
    for _, content in langs:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d))
    return out


def _sizes(tools: list[zstandard.ZstdCompressor], pieces: list[bytes]) -> tuple[np.ndarray, float]:
    """Encoded bytes by language, and the margin of the shortest."""
    size = np.array([sum(len(z.compress(p)) for p in pieces) for z in tools], dtype=float)
    best = int(size.argmin())
    rest = np.delete(size, best)
    return size, float(rest.min() / size[best] - 1) if len(rest) else 1.0


def _pieces(text: bytes) -> list[bytes]:
    """About ``PIECE_BYTES`` each, ended at a space if there is one."""
    out, at = [], 0
    while len(text) - at > PIECE_BYTES * 3 // 2:
        end = text.find(b" ", at + PIECE_BYTES, at + 2 * PIECE_BYTES)
        end = at + PIECE_BYTES if end < 0 else end
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.002,
             doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected) and the columns of ``keep``: one row per input row.

    ``lang_pred`` is ``und`` if the text is null or has no letter, or if nothing was learned. ``margin`` is the part
    by which the second shortest encoding is longer than the shortest; below ``min_margin`` the text is rejected, as
    is ``und``. ``score`` is a softmax over encoded lengths per piece, 0 for ``und``. Texts made of letters that no
    language uses still get the shortest encoding's language; ties go to the first of
    ``dictionaries``.
    """
    langs = tuple(dictionaries.items())
    names = [n for n, _ in langs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, "text"):
            out: list[tuple[str, float, float, bool]] = []
            for t in raw:
                s = t.decode("utf-8", "replace")
                if not names or not has_letter(s):
                    out.append((UNDETERMINED, 0.0, 0.0, True))
                    continue
                pieces = _pieces(words := clean(s))
                size, margin = _sizes(_compressors(langs, False), pieces)
                if margin < SECOND_LOOK:
                    pieces = _pieces(b" ".join(dict.fromkeys(words.split(b" "))))
                    size, margin = _sizes(_compressors(langs, True), pieces)
                best = int(size.argmin())
                weight = np.exp(-(size - size[best]) / len(pieces) / 8)
                out.append((names[best], float(1 / weight.sum()), margin, margin < min_margin))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_()),
                 *(part[f"kept_{k}"] for k in range(len(keep)))],
                ["doc_id", "lang_pred", "score", "margin", "rejected", *(f"kept_{k}" for k in range(len(keep)))])
        _compressors.cache_clear()  # their workspaces are large, and the worker goes on to other tasks
        give_back()

    src = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"), *(docs[c].alias(f"kept_{k}") for k, c in enumerate(keep)))
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds[doc_id]}, lang_pred string, score double, margin double, rejected boolean", *(f"kept_{k} {kinds[c]}" for k, c in enumerate(keep))])
    return src.mapInArrow(run, schema).toDF("doc_id", "lang_pred", "score", "margin", "rejected", *keep)


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
