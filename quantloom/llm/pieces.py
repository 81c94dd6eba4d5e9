"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its pieces, scores, normaliser settings and byte fallback are
rebuilt as a ``tokenizers`` tokenizer: a unigram model from the scores, or, for a BPE model, merges
ordered by the score of the piece they make. Whole texts are encoded in multithreaded batches. Where
the normaliser changes nothing and no piece has the metaspace marker behind another character, text
is encoded in chunks that begin at markers instead, and a worker encodes a chunk once while it is
cached. What is encoded is verified against the sentencepiece library, whose ids stand where the two
differ. Decoding is a table of each id's bytes.

Defined cases: null is an empty text; an empty text has no ids and decodes to itself; a marker
character in a text decodes as a blank, as in the library; a text decodes to its normal form, which
differs from it where the model's normaliser changes it; repeated rows give repeated rows; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import in_batches

#: Chunks that a worker keeps, in each of two generations; chunks encoded as one text; threads of a batch.
CACHE_CHUNKS, JOINED_CHUNKS, THREADS = 300_000, 500, 2
#: Fixed values of the model format: piece kinds, model kinds, the metaspace marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARKER = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(field number, value)`` of a protobuf message: integers, or the bytes of any other wire type."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a model file says: pieces with scores and kinds, model kind, and normaliser settings."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_blanks_removed: bool = True
    marker_behind: bool = False

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        model = cls()
        for number, value in message(data):
            if number == 1:
                own = dict(message(value))
                model.pieces.append(own[1].decode())
                model.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                model.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                own = dict(message(value))
                model.kind, model.byte_fallback, model.marker_behind = own.get(3, UNIGRAM), bool(own.get(35, 0)), bool(own.get(24, 0))
            elif number == 3:
                own = dict(message(value))
                model.charsmap = own.get(2, b"")
                model.dummy_prefix, model.extra_blanks_removed = bool(own.get(3, 1)), bool(own.get(4, 1))
        return model

    def tokenizer(self):
        """The rebuilt ``tokenizers.Tokenizer``."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = self.kinds.index(UNKNOWN)
        if self.kind == UNIGRAM:
            core = models.Unigram(list(zip(self.pieces, self.scores)), unk_id=unknown, byte_fallback=self.byte_fallback)
        else:
            vocab = {p: i for i, p in enumerate(self.pieces)}
            core = models.BPE(vocab, self._merges(vocab), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(core)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.extra_blanks_removed:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Replace(Regex(r"(?<=.)\z"), MARKER) if self.marker_behind else normalizers.Prepend(MARKER))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
        if not self.joined():
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARKER}*[^{MARKER}]+|{MARKER}+"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix])
        return out

    def joined(self) -> bool:
        """Whether a piece has a marker behind another character, so that it may reach over words."""
        return any(re.search(f"[^{MARKER}]{MARKER}", p) for p in self.pieces)

    def _merges(self, vocab: dict[str, int]) -> list[tuple[str, str]]:
        """Every way to make a piece of two pieces, best-scored piece first, ties in order of ids."""
        usable = {p for p, k in zip(self.pieces, self.kinds) if k in (NORMAL, USER_DEFINED, UNUSED)}
        found = []
        for piece in usable:
            for cut in range(1, len(piece)):
                if piece[:cut] in usable and piece[cut:] in usable:
                    found.append((-self.scores[vocab[piece]], vocab[piece], vocab[piece[:cut]], vocab[piece[cut:]], piece[:cut], piece[cut:]))
        return [own[-2:] for own in sorted(found)]

    def chunked(self) -> bool:
        """Whether texts may be encoded in chunks: nothing to normalise, and no piece reaches over words."""
        return not self.charsmap and self.dummy_prefix and not self.marker_behind and not self.extra_blanks_removed and not self.joined()

    def byte_table(self) -> list[bytes]:
        """What each id decodes to."""
        out = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            else:
                out.append(b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARKER, " ").encode())
        return out


class PieceCodec:
    """Encodes and decodes texts with a model file, in chunks if the model allows; ``differs`` holds chunks on which the two libraries disagree."""

    def __init__(self, path: str, threads: int = THREADS) -> None:
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true"
        import sentencepiece

        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        self.chunked, self.strips = self.model.chunked(), self.model.dummy_prefix or self.model.extra_blanks_removed
        self.tokenizer, self.table = self.model.tokenizer(), self.model.byte_table()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.differs: set[str] = set()

    @staticmethod
    def chunks(text: str | None) -> list[str]:
        """The text in chunks, each without the one marker with which it begins."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [c[1:] for c in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ")

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bool]]:
        """Little-endian 32-bit ids of each text, and whether both libraries agree on them.

        The model's own library has the last word: where they differ its ids are returned.
        """
        if not self.chunked:
            return self._whole([t or "" for t in texts])
        if len(self.new) > CACHE_CHUNKS:
            self.old, self.new = self.new, {}
        split = [self.chunks(t) for t in texts]
        wanted = set().union(*split).difference(self.new)
        kept = self.old.keys() & wanted
        self.new.update((w, self.old[w]) for w in kept)
        self._learn(list(wanted.difference(kept)))
        find, differs = self.new.__getitem__, self.differs
        return [b"".join(map(find, own)) for own in split], [not differs or differs.isdisjoint(own) for own in split]

    def _whole(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        mine = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        known = [np.array(i, "<u4").tobytes() for i in self.library.encode(texts, num_threads=1)]
        same = [a == b for a, b in zip(mine, known)]
        return [a if ok else b for a, b, ok in zip(mine, known, same)], same

    def _learn(self, fresh: list[str]) -> None:
        single = [[c] for c in fresh if c[:1] in ("", " ")]
        fresh = [c for c in fresh if c[:1] not in ("", " ")]
        groups = [fresh[k : k + JOINED_CHUNKS] for k in range(0, len(fresh), JOINED_CHUNKS)] + single
        encoded = self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)
        for own, e in zip(groups, encoded):
            if own == [""]:
                ids, cuts = np.array([self.model.pieces.index(MARKER)], "<u4"), [0, 1]
            else:
                ids = np.array(e.ids, "<u4")
                begins = np.cumsum([0, *(len(c) + 1 for c in own)]) - 1
                starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(ids))
                cuts = [0, *np.searchsorted(starts, begins[1:-1]).tolist(), len(ids)]
            raw = ids.tobytes()
            for c, a, b in zip(own, cuts, cuts[1:]):
                self.new[c] = raw[4 * a : 4 * b]
        check = [c for g in groups for c in g if c]
        for c, ids in zip(check, self.library.encode(check, num_threads=1)):
            if (raw := np.array(ids, "<u4").tobytes()) != self.new[c]:
                self.new[c] = raw
                self.differs.add(c)

    def decode(self, raw: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        data = b"".join(map(self.table.__getitem__, np.frombuffer(raw, "<u4").tolist()))
        if self.strips:
            data = data.removesuffix(b" ") if self.model.marker_behind else data.removeprefix(b" ")
        return data.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded, parity``: the ids, the text they decode to, and agreement of both libraries."""
    schema = "doc_id {}, ids array<int>, n_tokens long, decoded string, parity boolean".format(docs.schema["doc_id"].dataType.simpleString())
    return in_batches(docs).select("doc_id", "text").mapInArrow(_encoder(model, False), schema)


def piece_report(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip, parity`` of each document."""
    schema = "doc_id {}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean".format(docs.schema["doc_id"].dataType.simpleString())
    return in_batches(docs).select("doc_id", "text").mapInArrow(_encoder(model, True), schema)


def _encoder(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                ids, parity = own.encode(texts)
                decoded = [own.decode(i) for i in ids]
                counts = np.array([len(i) // 4 for i in ids], np.int64)
                n, same = pa.array(counts), pa.array(parity)
                if digests:
                    crc = pa.array([zlib.crc32(i) for i in ids], pa.int64())
                    sha = [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for d in decoded]
                    trip = [d == (t or "") for d, t in zip(decoded, texts)]
                    columns = {"doc_id": part.column(0), "n_tokens": n, "ids_crc32": crc, "decoded_sha256": pa.array(sha), "round_trip": pa.array(trip), "parity": same}
                else:
                    ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                    columns = {"doc_id": part.column(0), "ids": lists, "n_tokens": n, "decoded": pa.array(decoded, pa.string()), "parity": same}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run
