"""Concatenate-and-cut packing: documents as one token stream, cut into windows of fixed length.

Pass 1 tokenises each partition, ends each document with id 0 and writes the ids with
the document's running offset inside its partition. The partitions' token totals
are summed up (one row per partition), which gives every document its global
offset; pass 2 reads the written ids, adds the partition's offset and cuts each
document at the multiples of the window. A window over a partition's edge is
made of boundary records from both sides, joined by their sequence id only where
sequences are assembled. No text or token is shuffled, only the last window
has padding, and no task sees more than one Arrow batch.

Defined cases: an added token's string in a text is that token's id, as in the file's library; a null or empty
text is the single id 0; null ids and repeated rows are packed like any other; an empty table gives an empty
result; further columns are left aside.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall.llm.rows import once_per_process, written

WINDOW = 1024
END = 0               # id after each document
CACHED_WORDS = 400_000
ROWS_PER_BATCH = 512


def byte_bpe(path: str):
    """The tokenizer of a byte-level BPE file, as an encoder of ordinary text.

    The file's own library builds an object with offsets and strings for each token; the same merges run
    several times faster from the ranks in the file's vocabulary (ids in merge order). Added tokens are no part
    of it: ``encoder`` cuts the text at them.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    byte_of = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError(f"the merges of {path} are not in the order of their pieces' ids")
    # The pre-tokenizer's split; a fixed value of byte-level BPE files with this pre-tokenizer.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that the file's library finds in the text itself, before any other splitting."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    for t in added:
        if any(t.get(flag) for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {t['content']!r} of {path} has a flag that is not supported")
    return {t["content"]: t["id"] for t in added}


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Ids (as bytes) of text pieces, each encoded once; emptied when it has ``CACHED_WORDS``."""

    def __init__(self, encode: Callable[[str], list[int]], prefix: str):
        super().__init__()
        self.encode, self.prefix = encode, prefix

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[piece] = np.array(self.encode(self.prefix + piece), "<u4").tobytes()
        return ids


def encoder(path: str) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit).

    The text is cut at the file's added tokens first, the longest of those that begin at a place. In what is
    between them, a space after a character that is no white space starts a new pre-token, so the text is cut
    before each of them and the pieces are encoded on their own.
    """
    added = {content: np.array([i], "<u4").tobytes() for content, i in added_tokens(path).items()}
    cuts = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    encode = byte_bpe(path).encode_ordinary
    first, later = Words(encode, ""), Words(encode, " ")

    def ordinary(text: str) -> bytes:
        pieces = text.split(" ")
        if all(pieces) and not any(p[-1].isspace() for p in pieces[:-1]):
            return first[pieces[0]] + b"".join([later[p] for p in pieces[1:]])
        joined: list[str] = []  # a space after white space stays with the piece before
        for i, p in enumerate(pieces):
            if i and (not joined[-1] or joined[-1][-1].isspace()):
                joined[-1] += " " + p
            else:
                joined.append(p)
        if not joined[0] and len(joined) == 1:
            return b""
        return first[joined[0]] + b"".join([later[p] for p in joined[1:]])

    def ids_of(text: str) -> bytes:
        out, at = [], 0
        for found in cuts.finditer(text):
            out += [ordinary(text[at:found.start()]), added[found[0]]]
            at = found.end()
        return b"".join([*out, ordinary(text[at:])])

    return ids_of if added else ordinary


def tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, part, start_in_part, doc_tokens, ids`` of ``docs(doc_id, text)``; ids end with ``END``."""
    end = np.array([END], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = once_per_process(("byte bpe", tokenizer), lambda: encoder(tokenizer))
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(at, ROWS_PER_BATCH)
                ids = [ids_of(t.as_py() or "") + end for t in batch.column(1)]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.cumsum(lengths) - lengths
                start += int(lengths.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(lengths),
                     pa.array(ids, pa.binary())], names=["doc_id", "part", "start_in_part", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        encode, "doc_id long, part int, start_in_part long, doc_tokens long, ids binary")


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Each document's pieces in the windows; their ids are in ``ids`` (little-endian unsigned 32-bit)."""
    table = written(tokens(docs, tokenizer), "tokens")
    # One row per partition of pass 1: its total and, by a running sum, the tokens before it.
    totals = table.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))
    placed = table.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("before") + F.col("start_in_part")).alias("place"), "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(at, ROWS_PER_BATCH)
                place, total = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                first, last = place // window, (place + total - 1) // window
                n = last - first + 1
                row = np.repeat(np.arange(len(n)), n)
                sequence = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.maximum(sequence * window, place[row])
                end = np.minimum((sequence + 1) * window, place[row] + total[row])
                start = begin - place[row]
                ids = [x.as_buffer() for x in batch.column(3)]
                parts = [memoryview(ids[r])[4 * s:4 * (s + k)].tobytes() for r, s, k in zip(row, start, end - begin)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(end - begin), pa.array(parts, pa.binary()),
                     pa.array(total[row]), pa.array(sequence), pa.array(begin - sequence * window)],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(cut, PIECES)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequence_id, ids, n_tokens``: every window filled from its pieces, padded with ``END`` to ``window``.

    A window has at most ``window`` pieces, so a group is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = cut.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("n_tokens"))
    whole = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    padding = F.unhex(F.repeat(F.lit("0" * 8), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return joined.select("sequence_id", F.concat(whole, padding).alias("ids"), "n_tokens")
