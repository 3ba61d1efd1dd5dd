"""Alignment of two tokenizers over the bytes they share.

Both tokenizers cut the same bytes. Inside a task, cumulative sums of token lengths give where tokens end, the ends that
both have in common (``intersect1d``) cut a text into groups, ``searchsorted`` tells each token its group, and tokens of
one group are linked. Equal tokens of a group are counted first, so that links of a group are expanded (by ``repeat``)
only for different pairs.

The corpus count of a pair of ids is the number of documents that hold it. It is summed in two shuffles: by pair and salt,
then by pair. Documents meet the counts again without an exchange for the pairs that most documents are made of: those
of the highest counts, as many as fit in a table of fixed size, are broadcast. The links of all other pairs, each of which
is rare by that choice, are exchanged by pair and summed up by document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waraq.llm.packing import PieceEncoder, default_vocabulary
from waraq.llm.textops import by_bytes, texts_of
from waraq.runtime import bound_batches, materialize

SALTS = 16
#: Most pairs whose counts are broadcast, at 17 bytes each; the links of others are exchanged.
BROADCAST_PAIRS = 1 << 19
MEMO_UNITS = 200_000
_UNIT = re.compile(" *[^ ]+| +")


class UnitEncoder:
    """Ids of a sentence-piece BPE model whose pieces hold a space only in front, remembered by word.

    As no piece goes from a letter to a space, spaces and the word after them are encoded alike alone and in a text.
    A model that has such a piece encodes whole texts.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.pieces = [self._bytes_of(i) for i in range(n)]
        self.by_unit = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(n))
        #: a single space is an empty text to the model
        self.memo = {" ": np.array([self.model.piece_to_id("▁")], "<u4").tobytes()}

    def _bytes_of(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self.model.encode(texts, num_threads=1)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers. The model puts a space in front of a text."""
        if not self.by_unit:
            return self._encode(texts)
        rows = [_UNIT.findall(" " + t) if t and "▁" not in t else [] for t in texts]
        if len(self.memo) > MEMO_UNITS:
            self.memo = {" ": self.memo[" "]}
        fresh = list(set().union(*rows).difference(self.memo))
        self.memo.update(zip(fresh, self._encode([u[1:] for u in fresh])))
        word = self.memo.__getitem__
        # the model takes the mark of a space in a text for a space, so these texts have other units
        return [self._encode([t])[0] if "▁" in t else b"".join(map(word, row)) for t, row in zip(texts, rows)]


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


class Aligner:
    """Both tokenizers, with the bytes of every id and the texts that a digest is made of."""

    def __init__(self, vocabulary: str, pattern: str, model: str):
        self.first, self.second = PieceEncoder(vocabulary, pattern), UnitEncoder(model)
        tokens = self.first.token_bytes()
        self.bytes_of = _objects([*tokens, *self.second.pieces])
        self.shift = len(tokens)  # ids of the second tokenizer follow those of the first
        self.length = np.array([len(b) for b in self.bytes_of], np.int64)
        names = [str(i).encode() for i in range(self.shift)] + [str(i).encode() for i in range(len(self.second.pieces))]
        self.marked = _objects([n + mark for n in names for mark in (b",", b"|", b";", b"")])

    def _joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text in both tokenizers; none where a text is empty or its bytes do not come back."""
        none = np.zeros(0, np.int64)
        out = []
        for t, b in zip(texts, self.second.encode_batch(texts)):
            a, b = self.first.ids_of(" " + t).astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            whole = (" " + t).encode()
            out.append((a, b) if t and self._joined(a) == whole and self._joined(b + self.shift) == whole else (none, none))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The group of each token of either side, and the number of groups."""
        end_a, end_b = np.cumsum(self.length[a]), np.cumsum(self.length[b + self.shift])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        return np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), len(cuts)

    def digest(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> str:
        """SHA-256 of the ids by group: ``a1,a2|b1;a3|b2,b3``."""
        if not len(a):
            return ""
        group = np.r_[of_a, of_b]
        side = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
        order = np.argsort(group * 2 + side, kind="stable")
        ids, group, side = np.r_[a, b + self.shift][order], group[order], side[order]
        mark = np.zeros(len(ids), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
        mark[-1] = 3
        return hashlib.sha256(b"".join(self.marked[ids * 4 + mark].tolist())).hexdigest()


def linked_pairs(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of ids that share a group, as ``a << 32 | b`` in order, and the links of each.

    Tokens of one group and id are counted first; what is expanded are a group's different ids on either side."""
    none = np.zeros(0, np.int64)
    if not groups:
        return none, none
    key_a, times_a = np.unique(of_a << 32 | a, return_counts=True)
    key_b, times_b = np.unique(of_b << 32 | b, return_counts=True)
    group_a = key_a >> 32
    start_b = np.searchsorted(key_b >> 32, np.arange(groups + 1))
    width = start_b[group_a + 1] - start_b[group_a]  # ids of the other side that each (group, id) meets
    left = np.repeat(np.arange(len(key_a)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start_b[group_a], width)
    pair = (key_a[left] & 0xFFFFFFFF) << 32 | (key_b[right] & 0xFFFFFFFF)
    links = times_a[left] * times_b[right]
    pairs, at = np.unique(pair, return_inverse=True)
    return pairs, np.bincount(at, weights=links, minlength=len(pairs)).astype(np.int64) if links.sum() < 1 << 53 else _exact_sums(at, links, len(pairs))


def _exact_sums(at: np.ndarray, links: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, links)
    return out


_aligners: dict[tuple, Aligner] = {}


def _align_rows(key: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        aligner = _aligners[key]
        for batch in by_bytes(batches, 2, 1 << 20):
            rows, pairs, links = [], [], []
            for a, b in aligner.encode(texts_of(batch.column(2))):
                of_a, of_b, n = aligner.groups(a, b)
                p, m = linked_pairs(a, b, of_a, of_b, n)
                rows.append((len(a), len(b), n, int(m.sum()), aligner.digest(a, b, of_a, of_b)))
                pairs.append(p)
                links.append(m)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (pairs, links)]
            n_a, n_b, groups, n_links, digest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n_a, n_b, groups, n_links)), pa.array(digest), *lists],
                ["spot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
            )

    return run


def default_tokenizers() -> tuple[str, str, str]:
    """Ranks and pattern of the public byte-level BPE, and the model of the public sentence-piece BPE."""
    import public_tokenizers

    return (*default_vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def aligned_tokens(docs: DataFrame, tokenizers: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: spot (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the different pairs
    (``a << 32 | b``) with the links of each. Written to the shared folder."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("spot"), "doc_id", "text")
    schema = f"spot long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    return materialize(rows.mapInArrow(_align_rows(tokenizers or default_tokenizers()), schema), "aligned", codec="zstd")


def pair_counts(aligned: DataFrame, salts: int = SALTS) -> DataFrame:
    """pair, n (documents that hold it), best (whether n is the highest of the pair's first id). Written."""
    salted = aligned.select(F.explode("pairs").alias("pair"), F.pmod(F.col("spot"), F.lit(salts)).alias("salt"))
    once = salted.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = once.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # an id meets at most as many others as there are ids
    return materialize(counts.select("pair", "n", (F.col("n") == most).alias("best")), "pair-counts")


def _threshold(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` pairs reach, read off a histogram by powers of two and then within one of them."""
    if counts.count() <= most:
        return 0
    low, high = 1, counts.agg(F.max("n")).first()[0] + 1  # reached by more than ``most`` pairs, and by none
    while high - low > 1:  # sixteen probes at a time, in one aggregate
        probes = sorted({low + (high - low) * i // 17 for i in range(1, 17)} - {low, high}) or [(low + high) // 2]
        reached = counts.agg(*[F.count_if(F.col("n") >= p).alias(f"p{i}") for i, p in enumerate(probes)]).first()
        low = max([low, *(p for p, r in zip(probes, reached) if r > most)])
        high = min([high, *(p for p, r in zip(probes, reached) if r <= most)])
    return high


def _sum_known(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.asarray(batch.column("pairs").offsets, np.int64)
            own = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            links = batch.column("links").flatten().to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            known = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
            n = np.zeros(len(own), np.int64)
            top = np.zeros(len(own), bool)
            n[known], top[known] = counts[at[known]], best[at[known]]
            rest = np.r_[0, np.cumsum(~known)][ends]
            sums = [np.diff(np.r_[0, np.cumsum(x)][ends]) for x in (n * links, top * links)]
            lists = [pa.ListArray.from_arrays(pa.array(rest.astype(np.int32)), pa.array(x[~known])) for x in (own, links)]
            keep = [batch.column(c) for c in ("spot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x.astype(np.int64)) for x in sums), *lists], ["spot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "count_sum", "n_best", "pairs", "links"])

    return run


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, tokenizers: tuple[str, str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Align the tokens of two tokenizers in every document, and hold its links against the counts of the whole corpus.

    ``tokenizers``: ranks and pattern of a byte-level BPE (A), path of a sentence-piece model (B). A reads a space and the
    text, B the text. Byte offsets at which tokens of both end cut them into groups; links are all pairs of an A and a B
    token of one group. Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has the highest count of
    its A id, ties included), count_sum (the links' counts, summed), groups_sha256; one row per row of ``docs``.

    Null and empty texts, and texts whose tokens do not give back their bytes: zeros and ''. Literal special tokens are
    plain text. Null ids: a row like any other. Repeated rows: each counts as a document. Very long texts: whole.
    Empty table: no rows. Other columns are not read.
    """
    aligned = aligned_tokens(docs, tokenizers)
    counts = pair_counts(aligned)
    least = _threshold(counts, broadcast_pairs)
    known = counts.filter(F.col("n") >= least).toPandas().sort_values("pair")  # at most ``broadcast_pairs`` rows
    held = known["pair"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"spot long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long, pairs array<long>, links array<long>"
    summed = aligned.mapInArrow(_sum_known(*held), schema)
    if least == 0:
        return summed.select(*COLUMNS)
    summed = materialize(summed, "summed")
    rare = summed.select("spot", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("spot", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links"))
    met = rare.join(counts.filter(F.col("n") < least), "pair")
    more = met.groupBy("spot").agg(F.sum(F.col("n") * F.col("links")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"))
    joined = summed.drop("pairs", "links").join(more, "spot", "left")
    added = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return joined.select(*[added("count_sum", "more_sum") if c == "count_sum" else added("n_best", "more_best") if c == "n_best" else F.col(c) for c in COLUMNS])
