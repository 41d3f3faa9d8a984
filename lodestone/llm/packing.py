"""Packing: tokens of all documents concatenated and cut into fixed windows.

First pass: tokenise, and sum up tokens within each partition.  Second pass: prefix sums
over the partitions' totals place every document in one global stream, which is cut at
multiples of the window; a document that crosses a cut gets a piece on either side.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, lean, remembered

END = 2
_REMEMBERED = 1_200_000  # distinct words whose ids a worker keeps, about 200 MB, while it tokenises
BATCH_BYTES = 4 << 20  # of texts that a worker gets at once
_GROUP = 1000  # partitions in a group of the two-level prefix sums


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand
    for themselves, the others follow 255 in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_AS_WRITTEN = _byte_characters()


def _letters(word: str) -> str | None:
    """A word of letters alone as the tokenizer's steps before its merges leave it: composed,
    each letter in lower case, one character a byte.  None for any other word."""
    if not word.isalpha():
        return None
    folded = "".join(c.lower() for c in unicodedata.normalize("NFC", word))
    return folded.encode().decode("latin-1").translate(_AS_WRITTEN) if folded.isalpha() else None


class _Words(dict):
    """UTF-8 words without ASCII blanks, to their ids.

    The tokenizer never joins what blanks separate, so a text's ids are its words' ids.  It
    folds case and parts letters from punctuation, so a word that is new only by these has
    its ids from known ones.  Added tokens are found before case is folded, so a word that
    holds one but for its case goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # reading it anew copies it
        steps = json.loads(self.tokenizer.to_str())
        self.plain = [n["type"] for n in steps["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and any(
            x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in steps["pre_tokenizer"]["pretokenizers"]
        )
        self.added = [t["content"].lower().encode() for t in steps["added_tokens"]]
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        if word.isascii() and (low := word.lower()) != word and not any(t in low for t in self.added):
            out = self[low]
        elif word[-1:] in b".,;:!?" and (word[:-1].isalpha() or _letters(word[:-1].decode())):
            out = self[word[:-1]] + self[word[-1:]]
        elif self.plain and (piece := _letters(word.decode())):
            out = np.array([t.id for t in self.model.tokenize(piece)], self.kind).tobytes()
        else:
            out = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, self.kind).tobytes()
        self[word] = out
        return out


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


remembered.append(_words.cache_clear)


def encode(text: bytes, path: str, end: int = END) -> np.ndarray:
    """The ids of a text, and then ``end``."""
    words = _words(path)
    tail = np.array([end], words.kind).tobytes()
    return np.frombuffer(b"".join(map(words.__getitem__, text.split())) + tail, words.kind)


def _tokenise(path: str, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])

    @partial(lean, remembers=True)
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column("text")
            for low in range(0, batch.num_rows, 500):
                rows = [encode(t.as_py() or b"", path, end) for t in texts[low : low + 500]]
                sizes = np.array([len(r) for r in rows], np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                n = len(rows)
                yield pa.record_batch([batch.column("doc_id")[low : low + n], pa.array([part] * n, pa.int64()), pa.array(starts), pa.array(sizes), pa.array([r.itemsize == 4 for r in rows]), pa.array([r.tobytes() for r in rows], pa.binary())], schema=schema)

    return tokenise


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(window: int):
    names = [c.split()[0] for c in _PIECES.split(", ")]

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, sizes = batch.column("place").to_numpy(), batch.column("doc_tokens").to_numpy()
            firsts = place // window
            counts = (place + sizes - 1) // window - firsts + 1
            row = np.repeat(np.arange(len(place)), counts)
            sequence = firsts[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = np.maximum(place[row], sequence * window)
            stop = np.minimum((place + sizes)[row], (sequence + 1) * window)
            start, length = begin - place[row], stop - begin
            ids, wide = batch.column("ids"), batch.column("wide").to_pylist()
            crc, at, values = np.empty(len(row), np.int64), -1, None
            for j, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), length.tolist(), strict=True)):
                if r != at:
                    at, values = r, np.frombuffer(ids[r].as_buffer(), "<u4" if wide[r] else "<u2")
                crc[j] = zlib.crc32(values[s : s + n].astype("<u4").tobytes())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, sizes[row], sequence, begin - sequence * window))], names=names)

    return cut


def pack(docs: DataFrame, window: int = 4096, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Sequences of ``window`` tokens; only the last one is shorter.

    ``vocabulary``: path of a tokenizer file that every executor has; word_bpe_49k.json of
    the public tokenizers by default.

    Returns a row for each piece: doc_id, start (its document's ids before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens, sequence_id
    and offset (its place there).  A document is its ids and then ``end``: a null or empty
    text is ``end`` alone.  Rows are packed one by one, so repeated rows and null ids give
    their own pieces; other columns are not read.  The order is that of the written
    token table.
    """
    if vocabulary is None:
        from public_tokenizers import path

        vocabulary = path("word_bpe_49k.json")
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    tokens = scratch.keep(texts.mapInArrow(_tokenise(vocabulary, end), "doc_id long, part long, before long, doc_tokens long, wide boolean, ids binary"), BATCH_BYTES)
    # Prefix sums within groups of partitions, and over the groups' totals.
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).withColumn("g", F.floor(F.col("part") / _GROUP))
    groups = totals.groupBy("g").agg(F.sum("n").alias("n"))
    earlier = groups.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("base"))
    within = totals.withColumn("base_part", F.sum("n").over(Window.partitionBy("g").orderBy("part")) - F.col("n"))
    offsets = within.join(earlier, "g").select("part", (F.col("base") + F.col("base_part")).alias("offset"))
    placed = tokens.join(scratch.keep(offsets), "part").withColumn("place", F.col("offset") + F.col("before"))
    return placed.select("doc_id", "place", "doc_tokens", "wide", "ids").mapInArrow(_cut(window), _PIECES)


__all__ = ["encode", "pack"]
