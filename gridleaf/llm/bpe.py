"""Byte-level BPE with a sentencepiece model that is made from the rank file.

The model is serialised directly: every rank's bytes, each mapped to a visible
character, are a piece of score -rank; normalisation is the identity. A text
is cut by the pattern, each distinct cut is encoded by the model once in a
task, and ids are decoded by the inverse of the byte map.

Defined results: null texts are empty texts, and an empty text has no ids; very
long texts are cut and encoded whole; of equal scores the model merges the
leftmost pair, as the library does; rows are independent, so repeated rows
repeat their result; empty tables give empty results; other columns are
ignored, or kept where asked for, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .common import map_batches


def byte_map() -> dict[int, str]:
    """Printable characters stand for themselves, other bytes for those from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, in the order of their ranks."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in rows}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 127 | (128 if n > 127 else 0))
        n >>= 7
        if not n:
            return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: a message or string, a varint, or a float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialised(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces (1), trainer (2) and normaliser (3)."""
    chars = byte_map()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(chars[b] for b in token).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    size, none = len(tokens), 2**64 - 1
    trainer = _field(3, bpe) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


def _class(pattern: str, below: int) -> str:
    """The characters below a code point that a regex property takes, as a class for re."""
    import regex

    return "".join(f"\\u{i:04x}" for i in range(below) if regex.match(pattern, chr(i)))


#: Characters of remembered cuts, at most, when a text begins.
KEPT = 16_000_000
#: Texts below this code point are cut by an equal pattern of the quicker standard module.
PLAIN = 0x250


def plain_cut(pattern: str):
    """findall of the standard module for PATTERN of the public vocabulary over
    characters below PLAIN, or None for another pattern. The classes are taken
    from the regex module, so both agree on every character."""
    if pattern != r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
        return None
    letter, number, space = (_class(p, PLAIN) for p in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+").findall


class Codec:
    """Encodes texts to ids and back."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.cut, self.quick = regex.compile(pattern).findall, plain_cut(pattern)
        self.plain = re.compile(f"[\\x00-\\u{PLAIN - 1:04x}]*").fullmatch
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised(tokens))
        self.visible = byte_map()
        back = {ord(c): b for b, c in self.visible.items()}
        pieces = (self.model.id_to_piece(i) for i in range(len(tokens)))
        self.parts = {str(i): bytes(map(back.__getitem__, map(ord, piece))) for i, piece in enumerate(pieces)}
        self.whole = {token: str(i) for i, token in enumerate(tokens)}
        self.known: dict[str, str] = {}
        self.held = 0
        self.parted = f" {len(tokens)} "

    def _learn(self, cuts: set[str]) -> None:
        """Encode cuts by the model; one that is itself a token takes no merges."""
        raw = {cut: cut.encode() for cut in cuts}
        self.known |= {cut: self.whole[b] for cut, b in raw.items() if b in self.whole}
        rest = [cut for cut, b in raw.items() if b not in self.whole]
        shown = [raw[cut].decode("latin-1").translate(self.visible) for cut in rest]
        # A space stands for no byte, so no merge crosses it: it parts the cuts of one call and comes out as the unknown id.
        for i in range(0, len(rest), 256):
            ids = " ".join(map(str, self.model.encode(" ".join(shown[i : i + 256]), num_threads=1)))
            self.known |= zip(rest[i : i + 256], ids.split(self.parted), strict=True)

    def encode(self, text: str) -> str:
        """Decimal ids joined by one space."""
        cuts = self.quick(text) if self.quick and self.plain(text) else self.cut(text)
        if len(self.known) > 400_000 or self.held > KEPT:
            self.known.clear()
            self.held = 0
        new = set(cuts).difference(self.known)
        if new:
            self._learn(new)
            self.held += sum(map(len, new))
        return " ".join(map(self.known.__getitem__, cuts))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids.split(" "))) if ids else b""


_CODECS: dict[tuple, Codec] = {}


def codec_for(tokens: list[bytes], pattern: str) -> Codec:
    """This process's codec for a vocabulary; a worker keeps it between tasks."""
    key = (len(tokens), hashlib.sha256(b"\n".join(tokens)).digest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(tokens, pattern)
    return _CODECS[key]


def encoded(docs: DataFrame, path: str, pattern: str, keep: Iterable[str] = ()) -> DataFrame:
    """doc_id, the columns to keep, n_tokens, ids (decimal, joined by one
    space), decoded (bytes) and exact (whether they are the text's) of each row."""
    tokens, at = docs.sparkSession.sparkContext.broadcast(read_ranks(path)), list(keep)

    def make():
        codec = codec_for(tokens.value, pattern)

        def work(x):
            ids = [codec.encode(t or "") for t in x["text"]]
            back = [codec.decode(s) for s in ids]
            exact = [b == (t or "").encode() for b, t in zip(back, x["text"], strict=True)]
            return {"doc_id": x["doc_id"], **{c: x[c] for c in at}, "n_tokens": [s.count(" ") + 1 if s else 0 for s in ids], "ids": ids, "decoded": back, "exact": exact}

        return work

    kinds = dict(docs.dtypes)
    return map_batches(docs.select("doc_id", *at, "text"), ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in at), "n_tokens long, ids string, decoded binary, exact boolean"]), make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs; the ids themselves stay in the task."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def make():
        codec = codec_for(tokens.value, pattern)

        def work(x):
            out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in x["text"]:
                ids = codec.encode(t or "")
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
            return out

        return work

    return map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
