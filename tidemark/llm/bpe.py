"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts text into pieces; no merge crosses their borders.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Different pieces that a task remembers.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: itself if it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def load(file: str) -> dict:
    """A vocabulary file: read on the driver, a few MB, sent along with the functions that use it."""
    with open(file, encoding="utf-8") as f:
        return json.load(f)


class Coder:
    """Encodes and decodes as a vocabulary tells (see load).

    A piece is encoded from left to right, at each place by the longest token of an Aho-Corasick automaton that may follow
    the token before. Two tokens may follow each other if the merges of their joint bytes end in just these two. Where
    none may, the last token gives way to its longest shorter prefix; places that led nowhere are not tried again, so the
    work is linear. The merges' own result is the only sequence whose neighbours all may follow each other.
    """

    def __init__(self, told: dict):
        back = {c: b for b, c in enumerate(byte_letters())}
        model = told["model"]
        self.id = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        size = max([*self.id.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in self.id.items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        #: Of a token, the two it is merged from; of such a pair, (rank, token).
        self.halves, self.merged = {}, {}
        to_bytes = lambda s: bytes(back[c] for c in s)
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.id[to_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            token = self.id[self.bytes[a] + self.bytes[b]]
            if (a, b) not in self.merged:
                self.merged[a, b] = (rank, token)
            self.halves.setdefault(token, (a, b, rank))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.id.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The offset table: token i is blob[starts[i] : starts[i] + lengths[i]].
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.cut = regex.compile(PIECES).findall
        self.apart = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's joint bytes leave just a, b."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            found = self.pairs[a, b] = self._may_follow(a, b)
        return found

    def _may_follow(self, a: int, b: int) -> bool:
        limit = 1 << 62  # a merge across the border of this rank or later comes too late
        while True:
            rank, token = self.merged.get((a, b), (limit, -1))
            if rank < limit:
                return False
            # Take the later of the two last merges back, and look again at the border as it was before it.
            ra, rb = (self.halves.get(x, (0, 0, -1))[2] for x in (a, b))
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:
                limit, b = rb + 1, self.halves[b][0]  # of equal merges the one further left comes first

    def piece(self, text: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        raw = text.encode()
        whole = self.id.get(raw)
        if whole is not None and self._whole(whole):
            return whole.to_bytes(4, "little")
        n = len(raw)
        longest = [0] * n
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            start = end + 1 - (length := len(self.bytes[token]))
            if length > longest[start]:
                longest[start] = length
        out: list[int] = []
        at, length, dead = 0, longest[0], bytearray(n + 1)
        while at < n:
            # the longest token here, no longer than `length`, that may follow and leads to a place not given up
            while length:
                token = self.id.get(raw[at : at + length])
                if token is not None and not dead[at + length] and (not out or self.may_follow(out[-1], token)):
                    break
                length -= 1
            if length:
                out.append(token)
                at += length
                length = longest[at] if at < n else 0
            else:
                dead[at] = 1
                length = len(self.bytes[out.pop()])
                at -= length
                length -= 1
        return np.array(out, dtype="<u4").tobytes()

    def _whole(self, token: int) -> bool:
        return token in self.halves or len(self.bytes[token]) == 1

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers. Strings of special tokens become those tokens."""
        known, out = self.known, []
        for i, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for p in self.cut(part):
                ids = known.get(p)
                if ids is None:
                    ids = self.piece(p)
                    if len(known) >= REMEMBERED:
                        known.clear()
                    if len(p) < 64:
                        known[p] = ids
                out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of a text from its ids, gathered by the offset table; what isn't UTF-8 becomes U+FFFD."""
        at = np.frombuffer(ids, dtype="<u4")
        out = []
        for i in range(0, len(at), 1 << 20):
            part = at[i : i + (1 << 20)]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            places = np.arange(ends[-1]) + np.repeat(self.starts[part] - (ends - lengths), lengths)
            out.append(self.blob[places].tobytes())
        return b"".join(out).decode("utf-8", "replace").encode()


def encode_column(text: Column, vocabulary: str) -> Column:
    """array<int> of a text's ids; null texts have none."""
    told = load(vocabulary)

    @F.arrow_udf("array<int>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(told)
        for texts in batches:
            ids = [np.frombuffer(coder.encode(t or ""), dtype="<i4") for t in texts.to_pylist()]
            yield pa.array(ids, pa.list_(pa.int32()))

    return of(text)


def decode_column(ids: Column, vocabulary: str) -> Column:
    """The text of array<int> ids."""
    told = load(vocabulary)

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(told)
        for some in batches:
            yield pa.array([coder.decode(np.array(i if i is not None else [], dtype="<u4").tobytes()).decode() for i in some.to_pylist()], pa.string())

    return of(ids)


def round_trip(docs: DataFrame, vocabulary: str, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: the digests of the ids and of the decoded text.

    Null texts count as empty: 0 tokens. Repeated rows each come back; an empty table gives no rows. No exchange: a task
    reads its rows once, holds one batch of texts and a bounded memory of pieces. The file at the path `vocabulary` is
    read by the driver and sent along.
    """
    vocab = load(vocabulary)

    @F.arrow_udf("n long, ids string, decoded string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = Coder(vocab)
        for texts in batches:
            n, a, b = [], [], []
            last = None  # copies that a mix makes of a document stand side by side: the work of the first does for all
            for t in texts.to_pylist():
                if not n or t != last:
                    ids, last = coder.encode(t or ""), t
                    told = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids) if ids else b"").hexdigest())
                for column, value in zip((n, a, b), told, strict=True):
                    column.append(value)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n", "ids", "decoded"])

    done = docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("r"))
    return done.select("doc_id", F.col("r.n").alias("n_tokens"), F.col("r.ids").alias("ids_sha256"), F.col("r.decoded").alias("decoded_sha256"))
