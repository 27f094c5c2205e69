"""SentencePiece encoding and decoding, exact, by backtracking.

A sequence of pieces is the merge-type (BPE) encoding of a text just if every piece encodes to itself and every two
neighbours, joined and merged anew, give those two again. The encoder therefore needs no merge queue over the text: it
takes the longest piece at a position (one Aho-Corasick pass finds them all), checks it against the piece before by
re-merging the pair (remembered), falls back to the next shorter piece, and steps back where none fits. A bitfield of
positions from which no encoding can go on keeps that linear.

No piece holds a word mark behind another character (checked when the model is read), so merges never cross the start
of a run of word marks, and the runs with what follows them are encoded separately and remembered.

Null texts count as empty; an empty text has no ids. Repeated rows give repeated results, other columns are ignored.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

MARK = "▁"
#: Remembered words and pairs in a worker; when full, the memory starts anew. Results don't depend on it.
REMEMBERED = 200_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The vocabulary and the switches of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for field, value in _fields(data):
            if field == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
            raise ValueError("only merge-type (BPE) models with byte fallback are supported")
        if normalizer.get(2, b"") or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models that leave the text as it is but for escaped spaces are supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        if UNUSED in self.kinds or USER_DEFINED in self.kinds:
            raise ValueError("unused and user-defined pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a word mark behind another character")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is no piece itself")


class Encoder:
    """Encodes and decodes whole texts; what it remembers of them is a task's own (see ``renewed``)."""

    def __init__(self, path: str):
        import ahocorasick

        self.model = m = Model(path)
        self.score = {p: m.scores[i] for p, i in m.ids.items()}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.matcher = ahocorasick.Automaton()
        for p in m.ids:
            if self._merged(p) == [p]:  # a piece that merges never make can't be used
                self.matcher.add_word(p, (len(p), p))
        self.matcher.make_automaton()
        self.shorter: dict[str, str | None] = {}
        self.characters = {p for p in m.ids if len(p) == 1}
        self.inside = {p[i : i + 2] for p in m.ids for i in range(len(p) - 1)}
        self.runs = re.compile(f"{MARK}+[^{MARK}]*")
        self.surface = [p.replace(MARK, " ").encode() for p in m.pieces]
        for i, k in enumerate(m.kinds):
            if k in (CONTROL, UNKNOWN):
                self.surface[i] = b"" if k == CONTROL else " ⁇ ".encode()
        self.byte_of = {i: b for b, i in m.bytes.items()}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        self.decimal = [str(i) for i in range(len(m.pieces))]

    def renewed(self) -> Encoder:
        """This vocabulary with nothing remembered, for one task; workers outlive that, and other stages need their memory."""
        out = copy.copy(self)
        out.words, out.pieces, out.fits = {}, {}, {}
        return out

    def _merged(self, text: str) -> list[str]:
        """The encoding by its definition: join the two neighbours with the best score, the leftmost first, again and again."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[left, right] = self._merged(left + right) == [left, right]
        return known

    def _next_shorter(self, piece: str) -> str | None:
        """The longest usable piece that begins ``piece`` and isn't all of it."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.matcher), None)
        return self.shorter[piece]

    def _backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the vocabulary."""
        longest: list[str | None] = [None] * len(text)
        for end, (n, piece) in self.matcher.iter(text):  # ends ascend: what comes later from a start is longer
            longest[end + 1 - n] = piece
        dead = bytearray(len(text) // 8 + 1)  # the bitfield of failed positions
        out: list[str] = []
        at, piece = 0, longest[0]
        while at < len(text):
            end = at + len(piece)
            if not dead[end >> 3] >> (end & 7) & 1 and (not out or self._compatible(out[-1], piece)):
                out.append(piece)
                at = end
                piece = longest[at] if at < len(text) else None
                continue
            piece = self._next_shorter(piece)
            while piece is None:
                dead[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                piece = self._next_shorter(last)
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a text that begins with word marks and has none further on (or that stands first)."""
        inside, pieces = self.inside, self.pieces
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]  # no piece holds both sides
        if not cuts:
            known = tuple(self._part(word))
        else:
            ids: list[int] = []
            for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
                part = word[a:b]
                got = pieces.get(part)
                if got is None:
                    got = self._part(part)
                    if len(part) <= 64:
                        if len(pieces) > REMEMBERED:
                            pieces.clear()
                        pieces[part] = got
                ids += got
            known = tuple(ids)
        if len(word) <= 64:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            self.words[word] = known
        return known

    def _part(self, part: str) -> list[int]:
        if self.characters.issuperset(part):
            index = self.model.ids
            return [index[p] for p in self._backtrack(part)]
        return [self.model.bytes[b] for b in part.encode()]  # a character that no piece holds stands alone

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        head, mark, rest = text.partition(MARK)
        ids = list(self._word(head)) if head else []
        words, miss = self.words, self._word
        if not mark:
            return ids
        parts = [MARK + w for w in rest.split(MARK)] if MARK + MARK not in text and text[-1] != MARK else self.runs.findall(mark + rest)
        for w in parts:
            ids += words.get(w) or miss(w)
        return ids

    def decode(self, ids: list[int]) -> str:
        """What the library's decode returns: bytes become characters, those that are no UTF-8 one U+FFFD each."""
        data = b"".join(map(self.surface.__getitem__, ids))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = self._decode_broken(ids)
        return text[1:] if self.model.dummy_prefix and ids and self.model.pieces[ids[0]][:1] == MARK else text

    def _decode_broken(self, ids: list[int]) -> str:
        parts: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            parts.append(_utf8(bytes(held)))
            held.clear()
            parts.append(self.surface[i].decode() if i is not None else "")
        return "".join(parts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One vocabulary for each worker process, kept from task to task."""
    return Encoder(path)


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = "", 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out, at = out + data[at : at + n].decode(), at + n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out, at = out + "�", at + 1
        return out


def tokenize(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids themselves (array of int)
    and the decoded text. The model's path is one that every executor has.
    """
    fields = [pa.field(id_col, pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if keep_ids:
        fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())]

    def start():
        coder = encoder(model_path).renewed()

        def step(keys, texts):
            out: list[list] = [[] for _ in fields]
            for key, text in zip(keys, texts, strict=True):
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                row = [key, len(ids), hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, value in zip(out, row + [ids, decoded] * keep_ids, strict=True):
                    column.append(value)
            return out

        return step

    ddl = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_rows(docs.withColumn(id_col, docs[id_col].cast("long")), [id_col, text_col], start, pa.schema(fields), ddl)
