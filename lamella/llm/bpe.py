"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut only where no vocabulary piece can cross: before white space that follows a non-blank. The cuts are
encoded by the library, each different one once while it stays in a bounded cache, and the ids of all texts of a
batch are gathered by array look-ups. A text with rarer white space, where engines differ about runs, is encoded whole.
Decoding maps each id to its bytes through the byte table (256 bytes onto printable characters, reversed); characters
that ids split are whole again once bytes are joined, and ``as_text`` holds back an unfinished one between chunks.

One narrow pass: no exchange; memory is bounded by an Arrow batch of at most 4 MB (or one text, whatever its length) and the
cache, of at most ``KEEP`` cuts and ``KEEP_CHARS`` characters.

Defined results: null text counts as empty, with no ids; a very long text is encoded whole; special tokens' strings are ordinary text; repeated rows are
encoded alike; an empty table gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lamella.llm.common import importable, lean

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: A cut of a byte-level text: blanks and what follows them.
CUTS = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Characters that some engine takes for white space and another does not, or that stand beside the blanks above.
RARE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
#: Where any of these stands, a text is not made of words with one blank before each.
UNEVEN = ["  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x01"]
#: Different cuts that a worker keeps and their characters, their longest length, and characters encoded at a time.
KEEP, KEEP_CHARS, LONG, SLICE = 400_000, 16 << 20, 64, 4 << 20
#: Words of letters, with signs after them or not, and how many of them are encoded at a time.
SIMPLE, SIGNS, BLOCK = r"^\p{L}+[,.;:!?$&%#*]*$", r"[,.;:!?$&%#*]$", 500


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from ``start`` on, ``size`` of them, for each pair, one after another."""
    ends = np.cumsum(size)
    return np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)


def byte_table() -> dict[str, int]:
    """Character -> byte: printable bytes stand for themselves, the others follow from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of many texts at once. ``words``: cut at blanks, for a vocabulary that drops white space."""

    def __init__(self, path: str, words: bool = False) -> None:
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = not words
        self.words = words
        vocabulary = self.own.get_vocab()
        #: by id: does the piece end a word, or begin with a blank?
        self.mark = np.zeros(max(vocabulary.values()) + 1, bool)
        self.mark[[k for piece, k in vocabulary.items() if (piece.endswith("</w>") if words else piece.startswith("\u0120"))]] = True
        #: cut -> its number; by number: where its ids lie in ``pool``, how many, and how often it came lately
        self.at: dict[str, int] = {}
        self.chars = 0
        self.pool, self.start, self.size, self.uses = (np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def odd(self, text: str) -> list[str] | None:
        """Keys of the cuts of a text that is not made of words with plain blanks between; None for one that is."""
        if any(c in text for c in RARE[:4]) or not text.isascii() and any(c in text for c in RARE):
            return [text if self.words else "\x01" + text]
        if not self.words and any(x in text for x in UNEVEN):
            return ["\x01" + u for u in CUTS.findall(text)]
        return None

    def cuts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Keys of the cuts of all texts; for each text, where they begin and how many. A bare key of a byte-level text
        stands for a blank and the key."""
        odd = [self.odd(t) for t in texts]
        even = np.array([o is None for o in odd])
        plain = [t for t, o in zip(texts, odd, strict=True) if o is None]
        if self.words:
            split = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        else:
            split = pc.split_pattern(pa.array(["\x00" + t.replace("\n", " \n") for t in plain], pa.large_string()), " ")
        rest = [o for o in odd if o is not None]
        keys = pa.concat_arrays([split.flatten(), pa.array(itertools.chain.from_iterable(rest), pa.large_string())])
        n = np.zeros(len(texts), np.int64)
        n[even] = np.diff(split.offsets.to_numpy())
        n[~even] = [len(o) for o in rest]
        start = np.zeros(len(texts), np.int64)
        for some, before in ((even, 0), (~even, int(n[even].sum()))):
            start[some] = before + np.cumsum(n[some]) - n[some]
        return keys, start, n

    def plain(self, key: str) -> str:
        """The cut that a key stands for."""
        if self.words or key[:1] == "\n":
            return key
        return key[1:] if key[:1] in ("\x00", "\x01") else " " + key

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        values, counts, group, size = [], [], [], 0
        for i, text in enumerate(texts):
            group.append(text)
            size += len(text)
            if size >= SLICE or i == len(texts) - 1:
                v, c = self._encode(group)
                values.append(v)
                counts.append(c)
                group, size = [], 0
        if not values:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        return np.concatenate(values), np.concatenate(counts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cuts, first, n = self.cuts(texts)
        coded = cuts.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.at.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            base, fresh = len(self.size), [keys[i] for i in new.tolist()]
            values, size = self.fresh(coded.dictionary.take(pa.array(new)), fresh)
            number[new] = np.arange(base, base + len(new))
            self.at.update(zip(fresh, range(base, base + len(new)), strict=True))
            self.chars += sum(map(len, fresh))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
            self.pool = np.concatenate([self.pool, values])
            self.size = np.concatenate([self.size, size])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        index = number[coded.indices.to_numpy()[ranges(first, n)]]
        each = self.size[index]
        values = self.pool[ranges(self.start[index], each)]
        counts = np.diff(np.concatenate([[0], np.cumsum(each)])[np.cumsum(n)], prepend=0)
        self.uses += np.bincount(index, minlength=len(self.size))
        if len(self.at) > KEEP or self.chars > KEEP_CHARS or len(self.pool) > 8 * KEEP:
            self._shrink()
        return values, counts

    def fresh(self, column: pa.Array, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all keys one after another, number of ids of each key).

        Simple words go to the library many at once, with a blank between. Where each word's ids begin or end shows in
        the pieces: with words' ends a piece that ends a letter run or a run of signs, else a piece that begins with a
        blank. No word has fewer such pieces than is expected of it, so their sum tells whether all have as many; a
        block where the sum differs is encoded word by word, as are all other keys.
        """
        simple = pc.match_substring_regex(column, SIMPLE if self.words else r"^[^\x00\x01\n]").to_numpy(zero_copy_only=False)
        marks = np.ones(len(keys), np.int64)
        if self.words:
            marks += pc.match_substring_regex(column, SIGNS).to_numpy(zero_copy_only=False)
        many = np.flatnonzero(simple)
        blocks = [many[i : i + BLOCK] for i in range(0, len(many), BLOCK)]
        lead = "" if self.words else " "
        joined = self.own.encode_batch_fast([lead + " ".join([keys[i] for i in b.tolist()]) for b in blocks], add_special_tokens=False)
        found, size, at = [], np.zeros(len(keys), np.int64), []
        single = [np.flatnonzero(~simple)]
        for block, got in zip(blocks, joined, strict=True):
            ids, due = np.array(got.ids, np.int32), np.cumsum(marks[block])
            where = np.flatnonzero(self.mark[ids])
            if len(where) != due[-1]:
                single.append(block)
                continue
            size[block] = np.diff(where[due - 1] + 1, prepend=0) if self.words else np.diff(where, append=len(ids))
            found.append(ids)
            at.append(block)
        left = np.concatenate(single)
        own = [x.ids for x in self.own.encode_batch_fast([self.plain(keys[i]) for i in left.tolist()], add_special_tokens=False)]
        size[left] = np.fromiter(map(len, own), np.int64, len(own))
        order = np.concatenate([*at, left])  # keys in the order of their ids
        begins = np.zeros(len(keys), np.int64)
        begins[order] = np.cumsum(size[order]) - size[order]
        values = np.concatenate([*found, np.fromiter(itertools.chain.from_iterable(own), np.int32, int(size[left].sum()))])
        return values[ranges(begins, size)], size

    def _shrink(self) -> None:
        """Keep the cuts that came most, half of what may be kept by number and by characters, and none of the long ones."""
        keys = [u for u in self.at if len(u) <= LONG]
        old = np.fromiter((self.at[u] for u in keys), np.int64, len(keys))
        top = np.argsort(-self.uses[old], kind="stable")[: KEEP // 2]
        size = np.fromiter(map(len, keys), np.int64, len(keys))[top]
        top = top[: np.searchsorted(np.cumsum(size), KEEP_CHARS // 2)]
        old = old[top]
        size = self.size[old]
        self.pool = self.pool[ranges(self.start[old], size)]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, self.uses[old] // 2
        self.at = {keys[k]: i for i, k in enumerate(top.tolist())}
        self.chars = sum(map(len, self.at))


@functools.lru_cache(maxsize=4)
def encoder(path: str, words: bool = False) -> Encoder:
    return Encoder(path, words)


@functools.lru_cache(maxsize=2)
def decoder(path: str) -> list[bytes]:
    """Id -> bytes."""
    to_byte = byte_table()
    vocabulary = encoder(path).own.get_vocab()
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, k in vocabulary.items():
        table[k] = bytes(to_byte[c] for c in piece) if all(c in to_byte for c in piece) else piece.encode()
    return table


def decode(ids, path: str = BYTE_BPE) -> bytes:
    return b"".join(map(decoder(path).__getitem__, ids))


def as_text(chunks: Iterator[bytes]) -> Iterator[str]:
    """Decoded chunks as text: a character that a chunk's end splits comes with the next chunk."""
    import codecs

    held = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        yield held.decode(chunk)
    yield held.decode(b"", True)


def texts_of(column: pa.Array) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def encode(docs: DataFrame, text: str = "text", path: str = BYTE_BPE, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` without ``text`` and with ``ids`` (array of int); with ``offsets``, also ``starts`` and ``ends``, each
    id's code points in the text; with ``decoded``, also the bytes that the ids decode to."""
    importable(docs.sparkSession)
    ints = T.ArrayType(T.IntegerType())
    extra = [("ids", ints), *([("starts", ints), ("ends", ints)] if offsets else []), *([("decoded", T.BinaryType())] if decoded else [])]
    docs = docs.drop(*(n for n, _ in extra if n != text))  # columns of these names are replaced
    rest = docs.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = texts_of(batch.column(text))
            if offsets:
                own = enc.own.encode_batch(texts, add_special_tokens=False)
                rows = [x.ids for x in own]
                more = [pa.array([[o[k] for o in x.offsets] for x in own], pa.list_(pa.int32())) for k in (0, 1)]
                ids = pa.array(rows, pa.list_(pa.int32()))
            else:
                values, counts = enc.encode(texts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids, more = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)), []
            if decoded:
                table = decoder(path)
                flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
                more.append(pa.array([b"".join([table[i] for i in flat[a:b].tolist()]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()))
            keep = [k for k, name in enumerate(batch.schema.names) if name != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids, *more], [*(batch.schema.names[k] for k in keep), *(n for n, _ in extra)])

    return docs.mapInArrow(lean(run), T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in extra)]))


def token_counts(docs: DataFrame, text: str = "text", path: str = BYTE_BPE, name: str = "n_tokens") -> DataFrame:
    """``docs`` without ``text`` and with the number of ids; the ids themselves stay in the worker."""
    docs = docs.drop(name)
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, counts = encoder(path).encode(texts_of(batch.column(text)))
            keep = [k for k, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(counts, pa.int64())], [*(batch.schema.names[k] for k in keep), name])

    return docs.mapInArrow(lean(run), T.StructType([*docs.drop(text).schema.fields, T.StructField(name, T.LongType())]))
