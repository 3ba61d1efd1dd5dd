"""Packing by concatenate and cut.

Pass one turns every document into token ids inside its input partition and keeps, beside each document, the tokens
before it in the partition. The partitions' totals, one number each, are summed up to global offsets. Pass two cuts the
endless concatenation at every multiple of the window, so a document that crosses a boundary leaves a record on either
side. Only the last sequence needs padding.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.textops import by_bytes, texts_of
from waraq.runtime import bound_batches, materialize

WINDOW, END_ID, MEMO_WORDS = 2048, 1, 200_000
ENCODE_BYTES = 2 << 20
_WHITE = re.compile(r"\s")
#: Runs of Unicode white space that are cut out before the pattern sees them: its look-ahead would run out of stack over very long ones.
_LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class PieceEncoder:
    """Token ids of byte-level BPE, remembered by word.

    A cut before a single space, or before and after a single newline, between two other characters is a cut of the
    pre-tokenizer too, so words with the space or newline before them are encoded on their own, all new ones of a batch
    in two calls. Texts with any other white space are encoded whole. ``added`` texts are single tokens wherever they stand.
    """

    def __init__(self, vocabulary: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max([*ranks.values(), *(i for _, i in added)]) >= 1 << 16:
            raise ValueError(f"ids are kept in 16 bits, and {vocabulary} has larger ones")
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))
        self.added = tuple(text for text, _ in added)
        self.opens = {c: np.zeros(1 << 16, bool) for c in " \n"}  # ids that begin with the character
        for token, i in ranks.items():
            if token[:1] in (b" ", b"\n"):
                self.opens[token[:1].decode()][i] = True
        self.memo: dict[str, bytes] = {}

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id of the vocabulary, in order; ids that it leaves out have none."""
        out = [b""] * self.encoding.n_vocab
        for token, i in self.ranks.items():
            out[i] = token
        return out

    def ids_of(self, text: str) -> np.ndarray:
        """The ids of a text. The pattern makes one piece of a run of white space, less its last character where a word
        follows; long runs become that piece here, and what is around them is encoded on its own."""
        parts, at = [], 0
        for run in _LONG_WHITE.finditer(text):
            alone = run.end() == len(text) or text.startswith(self.added, run.end())
            end = run.end() - (not alone)
            parts += [self._plain(text[at : run.start()]), np.array(self.encoding._encode_single_piece(text[run.start() : end]), "<u2")]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u2")

    def _learn(self, words: list[str], before: str) -> None:
        """Remember words, each encoded with ``before`` in front; a word's ids end where the next id opens with it."""
        if words:
            ids = self.ids_of(before + before.join(words))
            cuts = np.flatnonzero(self.opens[before][ids]) * 2
            whole = ids.tobytes()
            keys = words if before == " " else [before + w for w in words]
            self.memo.update(zip(keys, (whole[a:b] for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(whole)])), strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit numbers."""
        rows = [("\n" + t).replace("\n", " \n").split(" ")[1:] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = set().union(*rows).difference(self.memo)
        for before in " \n":
            words = [w.removeprefix("\n") for w in fresh if w.startswith("\n") == (before == "\n")]
            self._learn([w for w in words if w and not _WHITE.search(w)], before)
        word = self.memo.__getitem__
        out = []
        for t, row in zip(texts, rows):
            try:
                out.append(b"".join(map(word, row))[2:] if t else b"")  # without the newline put before the text
            except KeyError:
                out.append(self.ids_of(t).tobytes())
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


_encoders: dict[tuple, PieceEncoder] = {}


def _encoder(*key) -> PieceEncoder:
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def default_vocabulary() -> tuple[str, str]:
    """Path of the public byte-level BPE ranks (those of byte_bpe_50k.json, without its added tokens), and its pre-tokenizer's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def default_added() -> tuple[tuple[str, int], ...]:
    """Text and id of the added tokens of byte_bpe_50k.json, which a text's literal becomes."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def _tokenise(vocabulary: str, pattern: str, added: tuple[tuple[str, int], ...], end_id: int):
    if not 0 <= end_id < 1 << 16:
        raise ValueError("the end id must fit in 16 bits")
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern, added)
        part, before, row = TaskContext.get().partitionId(), 0, 0
        for batch in by_bytes(batches, 1, ENCODE_BYTES):
            ids = [x + tail for x in encoder.encode_batch(texts_of(batch.column(1)))]
            counts = np.array([len(x) // 2 for x in ids], np.int64)
            starts = before + counts.cumsum() - counts
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())],
                ["doc_id", "part", "before", "doc_tokens", "ids"],
            )
            before += int(counts.sum())
            row += len(ids)

    return run


def tokenise(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pass one: doc_id, part, before (tokens before it in its partition), doc_tokens, ids (uint16), in the shared folder."""
    bound_batches(docs.sparkSession)
    path, pat, added = (*default_vocabulary(), default_added()) if vocabulary is None else (vocabulary, pattern, ())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_tokenise(path, pat, added, end_id), f"doc_id {kind}, part long, before long, doc_tokens long, ids binary")
    return materialize(rows, "token-ids", codec="zstd")


def _cut(base: dict[int, int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 4):
            index, start, length, crc, tokens, sequence, offset = [], [], [], [], [], [], []
            for i, (part, before, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)))):
                at = base[part] + before
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                done = 0
                while done < n:
                    room = window - (at + done) % window
                    take = min(room, n - done)
                    index.append(i)
                    start.append(done)
                    length.append(take)
                    crc.append(zlib.crc32(wide[4 * done : 4 * (done + take)]))
                    tokens.append(n)
                    sequence.append((at + done) // window)
                    offset.append((at + done) % window)
                    done += take
            ids_col = batch.column(0).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_col, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, sequence, offset))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, pattern: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens, one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its ids, then ``end_id``.
    Null or empty text: just ``end_id``. Null ids and repeated rows: packed like any other. Very long texts: cut into as
    many pieces as needed. A vocabulary passed in has no added tokens. Empty table: no rows. Other columns are not read. Every sequence but the last is full.
    Vocabularies with ids over 65,535 raise an error.
    """
    rows = tokenise(docs, vocabulary, pattern, end_id)
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").collect()  # one number per input partition
    base, before = {}, 0
    for r in totals:
        base[r["part"]] = before
        before += r["n"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut(base, window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
