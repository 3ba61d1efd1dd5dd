"""Exact deduplication by composable polynomial fingerprints.

A text is hashed in chunks of ``CHUNK`` bytes, all chunks of a batch in one matrix product. Chunk hashes of a document
combine by length-shifted arithmetic, ``H(a + b) = H(a) * B**len(b) + H(b)`` modulo a 31-bit prime, so a huge document is
never hashed as one string. Four (prime, base) residues and the length form the fingerprint. Rows whose fingerprints are equal
are then compared chunk by chunk with the row that stays; rows of a fingerprint that holds different texts are told
apart by their SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.bloom import passing
from waraq.llm.components import join_groups
from waraq.llm.textops import by_bytes, texts_of
from waraq.runtime import bound_batches, free_name, materialize

CHUNK = 1024
PIECE = 4 << 20
COMPARE_CHUNK = 1 << 16
#: (prime, base) of each residue: the largest primes below 2**31, with arbitrary bases.
RESIDUES = ((2147483647, 1103515245), (2147483629, 1220703125), (2147483587, 916132832), (2147483579, 387420489))
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

_space_run = re.compile(r"[\x20\x09-\x0D]+")
_to_space = {c: " " for c in range(9, 14)}


def normalise(text: str) -> str:
    text = text.translate(_to_space) if any(c in text for c in "\t\n\v\f\r") else text
    return _space_run.sub(" ", text) if "  " in text else text


def _weights(chunk: int) -> np.ndarray:
    """B**(chunk-1-i) mod p for each byte position i and residue; products with bytes stay exact in a float64."""
    out = np.zeros((chunk, len(RESIDUES)), np.float64)
    for r, (p, b) in enumerate(RESIDUES):
        w = 1
        for i in range(chunk - 1, -1, -1):
            out[i, r] = w
            w = w * b % p
    return out


def chunk_hashes(data: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all chunks of all byte strings, and each string's number of chunks. Strings are padded on the left:
    leading zeros do not change a polynomial's value."""
    chunk = len(weights)
    counts = np.array([-(-len(d) // chunk) for d in data], np.int64)
    flat = np.frombuffer(b"".join(b"\0" * (int(c) * chunk - len(d)) + d for c, d in zip(counts, data)), np.uint8)
    hashes = flat.reshape(-1, chunk).astype(np.float64) @ weights
    return np.mod(hashes, [p for p, _ in RESIDUES]).astype(np.int64), counts


def combine(left: int, right: int, right_bytes: int, prime: int, base: int) -> int:
    """The hash of a + b from those of a and b."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def fingerprints(data: list[bytes], chunk: int = CHUNK, weights: np.ndarray | None = None, piece: int = PIECE) -> list[tuple[int, ...]]:
    """The residues of each byte string. About ``piece`` bytes are hashed at once: a longer string is hashed in pieces of
    its own that are combined, so the memory beside the strings is bounded."""
    weights = _weights(chunk) if weights is None else weights
    out: list[tuple[int, ...]] = []
    held: list[bytes] = []
    size = 0
    for d in data:
        if held and size + len(d) > piece:
            out += _fingerprints(held, chunk, weights)
            held, size = [], 0
        if len(d) > piece:
            whole = (0,) * len(RESIDUES)
            for at in range(0, len(d), piece):
                part = d[at : at + piece]
                (own,) = _fingerprints([part], chunk, weights)
                whole = tuple(combine(a, b, len(part), p, base) for a, b, (p, base) in zip(whole, own, RESIDUES))
            out.append(whole)
        else:
            held.append(d)
            size += len(d)
    return out + _fingerprints(held, chunk, weights) if held else out


def _fingerprints(data: list[bytes], chunk: int, weights: np.ndarray) -> list[tuple[int, ...]]:
    hashes, counts = chunk_hashes(data, weights)
    shift = [pow(b, chunk, p) for p, b in RESIDUES]
    primes = [p for p, _ in RESIDUES]
    ends = counts.cumsum()
    acc = np.zeros((len(data), len(RESIDUES)), np.int64)
    for step in range(int(counts.max(initial=0))):  # the step-th chunk of every string that has one
        live = np.flatnonzero(counts > step)
        acc[live] = (acc[live] * shift + hashes[ends[live] - counts[live] + step]) % primes
    return [tuple(int(x) for x in row) for row in acc]


def _fingerprint_rows(chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _weights(chunk)
        for batch in by_bytes(batches, 1):
            data = [normalise(t).encode() for t in texts_of(batch.column(1))]
            prints = fingerprints(data, chunk, weights)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([a << 31 | b for a, b, _, _ in prints], pa.int64()),
                    pa.array([c << 31 | d for _, _, c, d in prints], pa.int64()),
                    pa.array([len(d) for d in data], pa.int64()),
                    pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                ],
                ["doc_id", "raw_hash", "fp_a", "fp_b", "n_bytes", "text_sha256"],
            )

    return run


PRINT = ["fp_a", "fp_b", "n_bytes"]


def fingerprint_table(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One small row per document: doc_id, raw_hash, fp_a, fp_b, n_bytes, text_sha256, uid. Written to the shared folder."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("raw_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = rows.mapInArrow(_fingerprint_rows(chunk), f"doc_id {kind}, raw_hash long, fp_a long, fp_b long, n_bytes long, text_sha256 string")
    return materialize(prints.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")


def _chunks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Normalised chunks of the given rows' texts. Texts that are no member's are left out before the exchange."""
    own = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_hash"), "text", F.monotonically_increasing_id().alias("spot"))
    own = passing(own, "d_hash", members, "raw_hash")
    own = own.select("d_id", "d_hash", "spot", F.encode(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_RUN, " "), "UTF-8").alias("body"))
    joined = own.join(members.hint("merge"), F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("raw_hash")))
    last = (F.greatest(F.octet_length("body"), F.lit(1)) - 1) / COMPARE_CHUNK
    return joined.select(*PRINT, "n", "first", "spot", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no"), "body").select(
        *PRINT, "n", "first", "spot", "chunk_no", F.substring("body", F.col("chunk_no") * COMPARE_CHUNK + 1, F.lit(COMPARE_CHUNK)).alias("chunk")
    )


def _copies(prints: DataFrame, keys: list[str], total: int) -> DataFrame:
    """keys, n, keep (uid and doc_id of the row that stays) of each group of more than one row. Written."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    return materialize(prints.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("keep")).filter("n > 1"), "groups", rows=total // 2)


def colliding_fingerprints(docs: DataFrame, prints: DataFrame, copies: DataFrame, total: int) -> DataFrame:
    """Fingerprints that hold different texts, found by comparing each row's chunks with those of the row that stays. A large group is dealt over parts of a bounded number of rows, each
    of which gets the chunks of the row that stays.
    """
    found = join_groups(prints, copies.select(*PRINT, "n", F.col("keep.uid").alias("keep_uid")), PRINT, "n", total)
    members = materialize(found.groupBy("doc_id", "raw_hash", *PRINT, "n").agg(F.max(F.col("uid") == F.col("keep_uid")).alias("first")), "members", rows=total)
    rows_per_part = min(16_384, max(64, total // 1000))
    parts = F.ceil(F.col("n") / rows_per_part).cast("int")
    chunks = _chunks(docs, members)
    first = chunks.filter("first").groupBy(*PRINT, "n", "chunk_no").agg(F.first("chunk").alias("kept_chunk"))
    first = first.select(*PRINT, "chunk_no", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "kept_chunk")
    rest = chunks.filter("not first").withColumn("part", F.pmod(F.xxhash64("spot"), parts).cast("int"))
    compared = rest.join(first, [*PRINT, "chunk_no", "part"], "left")
    return compared.groupBy(*PRINT).agg(F.bool_and(F.col("chunk").eqNullSafe(F.col("kept_chunk"))).alias("same")).filter("not same").select(*PRINT)


def group_rows(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, raw_hash, keep_id, group_size, kept, text_sha256, for every row of ``docs``."""
    prints = fingerprint_table(docs, chunk)
    total = prints.count()
    copies, keys = _copies(prints, PRINT, total), PRINT
    clash = colliding_fingerprints(docs, prints, copies, total)
    if not clash.isEmpty():
        mark = materialize(clash, "collisions").withColumn("clash", F.lit(True))
        told = F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit(""))
        prints, keys = prints.join(mark, PRINT, "left").withColumn("told", told), [*PRINT, "told"]
        copies = _copies(prints, keys, total)
    alone = F.col("n").isNull()
    return join_groups(prints, copies, keys, "n", total, "left").select(
        "doc_id",
        "raw_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n")).alias("group_size"),
        (alone | (F.col("uid") == F.col("keep.uid"))).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """Group documents whose texts are equal after each run of ASCII white space becomes one space.

    Returns doc_id, keep_id, group_size, kept, text_sha256, one row per row of ``docs``. Of equal texts the row with the
    smallest doc_id stays; of rows that repeat that id and text, one. Null text counts as empty. A null doc_id sorts
    last, and is keep_id only where the group has no other. Empty table: no rows. Other columns are not read.
    """
    return group_rows(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns stay.

    Null text counts as empty. Rows that repeat id and text: one stays. A null id stays only where its group has no
    other. Very long texts are compared whole. Empty table: no rows.
    """
    rows = materialize(group_rows(docs).select("doc_id", "raw_hash", "kept"), "exact-decisions")
    kept = rows.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("raw_hash").alias("k_hash")).distinct()
    h = free_name(docs, "raw_hash")
    hashed = docs.withColumn(h, F.xxhash64("text"))
    same = lambda r, a, b: hashed["doc_id"].eqNullSafe(r[a]) & (hashed[h] == r[b])
    out = hashed.join(kept, same(kept, "k_id", "k_hash"), "left_semi")
    repeats = rows.groupBy("doc_id", "raw_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("r_id"), F.col("raw_hash").alias("r_hash"))
    if not repeats.isEmpty():  # rows that repeat both id and text: the joins above cannot tell them apart
        again = lambda how: out.join(repeats, out["doc_id"].eqNullSafe(repeats["r_id"]) & (out[h] == repeats["r_hash"]), how)
        out = again("left_anti").unionByName(again("left_semi").dropDuplicates(["doc_id", h]))
    return out.drop(h)
