"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking over longest matches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlens.llm.frames import arrow_batch, slices, table

MARK = "▁"  # stands for a space in pieces
#: Parts of texts whose ids a Python worker remembers, and the longest that it does; others are encoded each time.
KEPT_PARTS = 400_000
KEPT_CHARS = 40
_KEPT_PAIRS = 1_000_000
_SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """Encoder and decoder for a merge-type model with identity normalisation, a leading space and byte pieces.

    The encoding is the one that merging the best-scored pair again and again gives. It is found from left to right:
    at each place the longest piece (by Aho-Corasick) is tried, then its next shorter prefixes; a piece is taken if
    merging it with the one before again gives the same two pieces; places from which no way leads on are kept in a
    bit field, and the last piece is taken back when none fits.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.byte = [0] * 256
        self.rank: dict[str, tuple[float, int]] = {}
        self.unknown = model.unk_id()
        crossing = False
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                self.text[i] = b" \xe2\x81\x87 "
            elif not model.is_control(i):
                self.rank[piece] = (-model.get_score(i), i)
                self.text[i] = piece.replace(MARK, " ").encode()
                crossing |= bool(re.search(f"[^{MARK}]{MARK}", piece))
        if crossing or model.normalize("A  b") != f"{MARK}A {MARK}b":
            raise ValueError("this model joins words or normalises texts; the encoder is for models that do not")
        self.of = {piece: i for piece, (_, i) in self.rank.items()}
        self.piece = {i: piece for piece, i in self.of.items()}
        machine = ahocorasick.Automaton()
        for piece, i in self.of.items():
            machine.add_word(piece, (len(piece), i))
        machine.make_automaton()
        self.machine = machine
        self.shorter = [-1] * n  # a piece's longest proper prefix that is a piece
        for piece, i in self.of.items():
            self.shorter[i] = next((self.of[piece[:m]] for m in range(len(piece) - 1, 0, -1) if piece[:m] in self.of), -1)
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[str, int, bytes]] = {}
        self.older: dict[str, tuple[str, int, bytes]] = {}
        self.length = [len(self.piece.get(i, "")) for i in range(n)]
        self.name = [str(i) for i in range(n)]
        self.chars = {x for x in self.of if len(x) == 1}

    def merged(self, text: str) -> list[str]:
        """The definition: merge the pair of neighbours with the best-scored joint piece, the leftmost of equals."""
        symbols = list(text)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                rank = self.rank.get(symbols[i] + symbols[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the text of both pieces again gives these two pieces."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self.merged(a + b) == [a, b]
            if len(self.pairs) >= _KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def alone(self, token: int) -> bool:
        """Whether merging a piece's own text gives the piece."""
        known = self.pairs.get(-1 - token)
        if known is None:
            known = self.pairs[-1 - token] = self.merged(self.piece[token]) == [self.piece[token]]
        return known

    def _known(self, text: str) -> list[int]:
        """Ids of a text of which every character is a piece."""
        n = len(text)
        longest = [-1] * n
        size = [0] * n
        for end, (m, i) in self.machine.iter(text):
            if m > size[begin := end - m + 1]:
                size[begin], longest[begin] = m, i
        length, shorter, pairs = self.length, self.shorter, self.pairs
        closed: bytearray | None = None  # the bit field of places from which no way leads on
        taken: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                to = at + length[token]
                if closed is None or not closed[to >> 3] >> (to & 7) & 1:
                    if last < 0:
                        if self.alone(token):
                            break
                    elif (known := pairs.get(last << 20 | token)) or known is None and self.fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                if to == n:
                    return taken
                at, last = to, token
                token = longest[at]
            else:  # no piece fits here: close the place and take the last piece back
                if closed is None:
                    closed = bytearray((n >> 3) + 1)
                closed[at >> 3] |= 1 << (at & 7)
                token = taken.pop()
                last = taken[-1] if taken else -1
                at -= length[token]
                token = shorter[token]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part that starts with marks and has none later; characters without a piece become byte pieces."""
        if self.chars.issuperset(part):
            return self._known(part)
        ids: list[int] = []
        run = 0
        for i, char in enumerate(part):
            if char not in self.chars:
                if i > run:
                    ids += self._known(part[run:i])
                ids += [self.byte[x] for x in char.encode("utf-8", "replace")]
                run = i + 1
        if run < len(part):
            ids += self._known(part[run:])
        return ids

    def part(self, part: str) -> tuple[str, int, bytes]:
        """A part's ids as text, their number and what they decode to; kept in two generations, of which the older goes."""
        found = self.older.get(part)
        if found is None:
            ids = self.encode_part(part)
            found = ",".join([self.name[i] for i in ids]), len(ids), b"".join([self.text[i] for i in ids])
        if len(part) <= KEPT_CHARS:
            if len(self.parts) >= KEPT_PARTS:
                self.older, self.parts = self.parts, {}
            self.parts[part] = found
        return found

    def split(self, text: str) -> list[str]:
        return _SPLIT.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for i in self.encode_part(part)]

    def decode(self, ids: list[int]) -> str:
        """The pieces' text with marks as spaces and byte pieces as UTF-8, without the first leading space."""
        return b"".join([self.text[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
        known = self.parts.get
        parts = [known(x) or self.part(x) for x in self.split(text)]
        decoded = b"".join([x[2] for x in parts]).removeprefix(b" ").decode("utf-8", "replace")
        return sum([x[1] for x in parts]), hashlib.sha256(",".join([x[0] for x in parts]).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def codec(model_path: str) -> Codec:
    """One codec for each Python worker and model."""
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row; null and empty texts have no ids and decode to an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in slices(batch):
                ids = [own.encode(x or "") for x in part["text"].to_pylist()]
                yield arrow_batch(schema, part["doc_id"], ids, [own.decode(x) for x in ids])

    return _texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, ids array<int>, decoded string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, without carrying the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in slices(batch):
                yield arrow_batch(schema, part["doc_id"], *zip(*[own.digest(x) for x in part["text"].to_pylist()], strict=True))

    return _texts(docs, id_col, text_col).mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`encode_digests` of every document: null and empty texts have no ids, repeated rows and null ids stay, an empty table gives an empty one."""
    return encode_digests(table(spark, sf_dir, "documents"), default_model())
