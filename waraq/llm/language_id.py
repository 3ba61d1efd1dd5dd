"""Language identification by bit-sliced n-gram filters.

One Bloom filter per language, stored side by side: slot s of a table holds one bit for each of eight languages, so a
lookup of an n-gram's slots and one AND return all languages that contain it. Per document and language the set bits
are counted; the count expected from the filter's false positives alone is taken off; the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.llm.textops import by_bytes, fold_of, splitmix, utf8_of
from waraq.runtime import bound_batches, free_name

GRAM, SLOT_BITS, HASHES = 4, 20, 3
_LETTERS = np.array([b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte 4-grams of each text in lower case, with every run of non-letters as one space, and the rows' offsets."""
    padded = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(array, "")), "", " ")
    data, offsets = utf8_of(padded)
    data = _LETTERS[data]
    space = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1]] = True
    data = data[keep]
    offsets = np.r_[0, np.cumsum(keep)][offsets]
    wide = data.astype(np.uint32)
    n = max(0, len(wide) - GRAM + 1)
    grams = wide[:n].copy()
    for k in range(1, GRAM):
        grams |= wide[k : n + k] << np.uint32(8 * k)
    ends = np.maximum(offsets[1:] - GRAM + 1, offsets[:-1])
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, offsets[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)[:n] > 0
    return grams[inside], np.r_[0, np.cumsum(ends - offsets[:-1])]


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    h = splitmix(grams.astype(np.uint64))
    return [((h >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]


def build_filters(grams_by_lang: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """One uint8 table per eight languages, and each language's false-positive rate."""
    tables = [np.zeros(1 << SLOT_BITS, np.uint8) for _ in range(-(-len(grams_by_lang) // 8))]
    rates = []
    for lang, grams in enumerate(grams_by_lang):
        bit = np.uint8(1 << lang % 8)
        for slots in slots_of(grams):
            tables[lang // 8][slots] |= bit
        rates.append(float(((tables[lang // 8] & bit) > 0).mean()) ** HASHES)
    return tables, np.array(rates)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        langs = batch.column(0)
        for lang in pc.unique(langs).to_pylist():
            grams, _ = grams_of(batch.column(1).filter(pc.equal(langs, lang)))
            found, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, train_docs: int = 8000, max_grams: int = 60_000, min_count: int = 4, ratio: float = 0.3, max_langs: int = 256) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Language names, filter tables and false-positive rates, from about ``train_docs`` documents with a language.

    Every language gets an equal part of the sample, all its documents if they are fewer, so rare languages are learned
    alike at every size of the corpus. A language's filter takes its ``max_grams`` most frequent n-grams that occur ``min_count`` times, at a share of at
    least ``ratio`` times the largest share in any language. Of more than ``max_langs`` values of lang the most frequent are
    learned, so a dirty column neither reaches the driver nor thins out the sample. Rows with crc32(doc_id) mod 4 = 2 are never learned from.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null").filter(fold_of(F.col("doc_id"), 4) != 2)
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()}
    if not sizes:
        return [], [], np.zeros(0)
    each = max(1, train_docs // len(sizes))
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, each / n) * (1 << 20)))])
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < F.element_at(shares, F.col("lang")))
    counts = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    good = shares.filter((F.col("n") >= min_count) & (F.col("share") >= ratio * F.col("most"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_grams)
    table = good.select("lang", "gram").toPandas()
    names = sorted(sizes)
    tables, rates = build_filters([table["gram"][table["lang"] == name].to_numpy().astype(np.uint32) for name in names])
    return names, tables, rates


def language_counts(array: pa.Array, tables: list[np.ndarray], rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, languages) n-gram counts less the expected false positives, and the rows' numbers of n-grams."""
    grams, offsets = grams_of(array)
    slots = slots_of(grams)
    total = np.diff(offsets)
    out = np.zeros((len(total), len(rates)))
    for t, filters in enumerate(tables):
        mask = filters[slots[0]]
        for s in slots[1:]:
            mask &= filters[s]
        for lang in range(8 * t, min(8 * t + 8, len(rates))):
            hits = np.diff(np.r_[0, np.cumsum((mask >> np.uint8(lang % 8)) & np.uint8(1), dtype=np.int64)][offsets])
            out[:, lang] = np.maximum(0, (hits - total * rates[lang]) / (1 - rates[lang] + 1e-9))
    return out, total


def _predict(names: list[str], tables: list[np.ndarray], rates: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, 4 << 20):
            text = batch.column(2)
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False), bool)
            if names:
                counts, _ = language_counts(text, tables, rates)
                best = counts.argmax(axis=1)
                top, every = counts.max(axis=1), counts.sum(axis=1)
                score = np.where(letter & (every > 0), top / np.maximum(every, 1e-9), 0.0)
                lang = [names[b] if ok else "und" for b, ok in zip(best, letter)]
            else:
                score, lang = np.zeros(len(text)), ["und"] * len(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, from whole texts only.

    lang_pred is ``und`` if the text is null or has no letter (then score is 0), or if nothing could be learned. score
    is the language's part of all languages' corrected counts. Ties, and texts without a known n-gram: the
    first language by name, the latter with score 0. Null ids and repeated rows: scored like any other. Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    names, tables, rates = learn(docs, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(_predict(names, tables, rates), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, wanted: list[str], **options) -> DataFrame:
    """``docs`` whose predicted language is wanted; all columns stay.

    Null and letterless texts, and all texts if nothing could be learned, are ``und``: they stay only if that is wanted.
    Null ids, ties and repeated rows: each row by its text. Very long texts count whole. Empty table: no rows.
    """
    names, tables, rates = learn(docs, **options)
    model = docs.sparkSession.sparkContext.broadcast((names, tables, rates))  # a table of 2**20 bytes for eight languages
    column = free_name(docs, "lang_pred")

    @F.pandas_udf("string")
    def predict(text):
        import pandas as pd

        none = pa.nulls(len(text), pa.int64())
        batch = pa.RecordBatch.from_arrays([none, none, pa.array(text, pa.string(), from_pandas=True)], ["doc_id", "held_out", "text"])
        found = [out.column(2) for out in _predict(*model.value)(iter([batch]))]
        return pd.Series([x for part in found for x in part.to_pylist()], dtype=object)

    return docs.withColumn(column, predict("text")).filter(F.col(column).isin(wanted)).drop(column)
