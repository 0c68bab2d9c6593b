"""SentencePiece models run by the tokenizers library.

The model protobuf is read field by field; from it come the normaliser, the
metaspace marker, the scores (unigram scores as they are, or the merge order of a
BPE model: of two merges the one whose result scores higher goes first) and
byte fallback. Where no piece has the marker after another character, words (a run of
markers and what follows) are independent, so each distinct word is encoded once
per worker, new ones in batches on several threads; otherwise whole texts are
encoded. Each newly encoded word (or text) is also encoded by the sentencepiece
library; a row's ``parity`` says whether all of its parts agreed.

Defined cases: a null or empty text has no ids and decodes to the empty text; the marker character in a
text decodes as a space (so does the original library), which ``round_trip`` takes into account; repeated
rows are encoded alike; an empty table gives an empty result; further columns are left aside.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall.llm.rows import once_per_process

MARK = "▁"
UNIGRAM, BPE = 1, 2                                  # trainer_spec.model_type
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types
THREADS = 2
CACHED_WORDS = 100_000  # in each of two generations
ROWS_PER_BATCH = 256


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""
    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i:i + size], i + size
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i:i + size], i + size
        else:
            raise ValueError("not a SentencePiece model")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN)

    @property
    def words_apart(self) -> bool:
        return (self.dummy_prefix and self.escape_spaces and not self.trim_spaces and not self.charsmap
                and not any(MARK in p.lstrip(MARK) for p in self.pieces))


def parse_model(data: bytes) -> Model:
    """The parts of a ModelProto that encoding needs; defaults are those of the format."""
    m = Model()
    for number, value in proto_fields(data):
        if number == 1:
            own = dict(proto_fields(value))
            m.pieces.append(own[1].decode())
            m.scores.append(struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0])
            m.types.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(proto_fields(value))
            m.kind, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
            m.unknown_surface = own.get(44, m.unknown_surface.encode()).decode()
        elif number == 3:
            own = dict(proto_fields(value))
            m.charsmap = own.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {m.kind}: only unigram and BPE models are supported")
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best result first."""
    ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t in (NORMAL, USER)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-m.scores[i], i, left, right))
    return [(m.pieces[a], m.pieces[b]) for _, _, a, b in sorted(found)]


def build(m: Model, normalise: bool = True):
    """The tokenizers object; with ``normalise=False`` its input is already in marker form."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(m.pieces, m.scores)), unk_id=m.unknown, byte_fallback=m.byte_fallback)
    else:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        model = models.BPE(vocab=vocab, merges=merges(m), unk_token=m.pieces[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
    tokenizer = Tokenizer(model)
    if normalise:
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.trim_spaces:
            steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip(True, True)]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if m.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
    return tokenizer


class Codec:
    """Encoder and decoder of one model in one worker."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ["RAYON_NUM_THREADS"] = str(threads)  # read when the library starts its threads
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.model = parse_model(data)
        self.apart = self.model.words_apart
        self.tokenizer = build(self.model, normalise=not self.apart)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.alone = [self.model.pieces.index(MARK)] if MARK in self.model.pieces else []
        self.known: dict[str, bytes] = {}   # ids of parts seen lately
        self.older: dict[str, bytes] = {}   # those of the generation before
        self.odd: set[str] = set()          # parts on which the libraries disagree
        self.surface = surfaces(self.model)

    def parts(self, text: str) -> list[str]:
        if not text:
            return []
        return re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if self.apart else [text]

    def learn(self, parts: set[str]) -> None:
        """Ids of all ``parts`` into ``known``; encodes those of neither generation."""
        if len(self.known) + len(parts) > CACHED_WORDS:
            self.older, self.known = self.known, {}
        for part in parts & self.older.keys():
            self.known[part] = self.older[part]
        fresh = list(parts.difference(self.known))
        if not fresh:
            return
        ours = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
        theirs = self.original.encode([p[1:].replace(MARK, " ") if self.apart else p for p in fresh], num_threads=self.threads)
        for part, own, other in zip(fresh, ours, theirs):
            ids = own.ids
            # The marker alone: the original library adds no prefix to an empty text.
            if ids != other and not (self.apart and part == MARK and ids == self.alone):
                self.odd.add(part)
            self.known[part] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids (little-endian unsigned 32-bit) and parity of each text."""
        parts = [self.parts(t) for t in texts]
        self.learn(set().union(*parts))
        return [(b"".join(map(self.known.__getitem__, own)), self.odd.isdisjoint(own)) for own in parts]

    def decode(self, ids: np.ndarray) -> str:
        return surface_text(self.surface, self.model.dummy_prefix, ids)


def surfaces(m: Model) -> list[bytes]:
    """What each id decodes to."""
    return [bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL
            else m.unknown_surface.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()
            for piece, kind in zip(m.pieces, m.types)]


def surface_text(surface: list[bytes], dummy_prefix: bool, ids: np.ndarray) -> str:
    text = b"".join(map(surface.__getitem__, ids.tolist()))
    return (text[1:] if dummy_prefix and text.startswith(b" ") else text).decode("utf-8", "replace")


RESULT = "at struct<file:string,row:bigint>, doc_id long, text_crc32 long, ids binary, parity boolean, decoded_crc32 long"


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(source: DataFrame, model_path: str, threads: int = THREADS) -> DataFrame:
    """``at, doc_id, text_crc32, ids, parity, decoded_crc32`` for each row of ``located(docs)``; ids are little-endian unsigned 32-bit.

    The ids are decoded again: ``decoded_crc32`` is of the text they give, ``text_crc32`` of the one
    they should give (markers in the text count as spaces).
    The model file is read once on the driver and broadcast (its size is that of the vocabulary).
    """
    shared = source.sparkSession.sparkContext.broadcast(model_bytes(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once_per_process(("sentencepiece", hash(shared.value), threads), lambda: Codec(shared.value, threads))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                batch = whole.slice(at, ROWS_PER_BATCH)
                texts = [t.as_py() or "" for t in batch.column("text")]
                out = codec.encode(texts)
                sums = [zlib.crc32(t.replace(MARK, " ").encode()) for t in texts]
                back = [zlib.crc32(codec.decode(np.frombuffer(x[0], "<u4")).encode()) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("at"), batch.column("doc_id"), pa.array(sums, pa.int64()),
                     pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.bool_()),
                     pa.array(back, pa.int64())], names=["at", "doc_id", "text_crc32", "ids", "parity", "decoded_crc32"])

    return source.select("at", F.col("doc.doc_id").cast("long").alias("doc_id"), "doc.text").mapInArrow(run, RESULT)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (with ``ids``) and the ``decoded`` text."""
    model = parse_model(model_bytes(model_path))
    shared = encoded.sparkSession.sparkContext.broadcast((surfaces(model), model.dummy_prefix))

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: surface_text(*shared.value, np.frombuffer(x, "<u4")))

    return encoded.withColumn("decoded", text_of("ids"))
