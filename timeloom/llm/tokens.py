"""Tokenisers inside tasks: exact BPE ids by words, and word-piece counts by a linear longest-match automaton.

The file of a public tokeniser is a parameter; every executor reads its own copy.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8_parts

#: Bytes of remembered words in a worker, and what an entry takes besides its word and ids; bound memory, not results.
ROOM, ENTRY = 128 << 20, 250
#: Marks for words seen before; they start anew once a quarter is set. A power of two; changes no result.
SEEN = 1 << 22
#: Bytes of texts in one unit of work.
SLICE = 1 << 19
#: White space that Python and the tokeniser see alike, and what needs the tokeniser itself on the whole text:
#: separators that only Python counts as space, and the marks of special tokens.
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Marks that may follow a word and are one unit of their own; the apostrophe is not among them.
_MARKS = ".,;:!?*$%&#|()-"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ---- exact ids -----------------------------------------------------------------------------------------------------


class WordIds:
    """Ids of whole texts as little-endian 32-bit bytes. The tokeniser parts words at white space and looks at nothing
    beyond a word, so each distinct word of some texts is encoded once, and remembered from the second texts on that hold
    it: most distinct words never come back. A worker's tasks share what it remembers."""

    _shared: dict[str, "WordIds"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[n for piece, n in vocabulary.items() if piece.endswith("</w>")]] = True
        self.memory: dict[str, bytes] = {}
        self.held = 0
        self.seen, self.marked = bytearray(SEEN), 0

    @classmethod
    def shared(cls, path: str) -> WordIds:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, units: list[str]) -> dict[str, bytes]:
        """Ids of units that the tokeniser takes as one word each, many at a time: a word's last id closes it."""
        out = {}
        for at in range(0, len(units), 1024):
            part = units[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokeniser parts words in a way of its own")
            data, begin = ids.tobytes(), 0
            for unit, end in zip(part, (4 * ends).tolist()):
                out[unit] = data[begin:end]
                begin = end
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Put the ids of new words, and of the units they are made of, into memory; returns what was put."""
        memory, cased, marked, units, odd = self.memory, [], [], set(), []
        for word in words:
            core = word.rstrip(_MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0130"):
                low = core.lower()
                if low not in memory:
                    units.add(low)
                if len(core) < len(word):
                    marks = word[len(core) :]
                    if marks not in memory:
                        units.add(marks)
                    marked.append((word, low, marks))
                elif low != word:
                    cased.append((word, low))
            else:
                odd.append(word)
        known = self.plain(list(units))
        memory.update(known)
        learnt = [*known, *[word for word, _ in cased], *[word for word, _, _ in marked], *odd]
        for word, low in cased:
            memory[word] = memory[low]
        for word, low, marks in marked:
            memory[word] = memory[low] + memory[marks]
        for word, encoding in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else ()):
            memory[word] = np.array(encoding.ids, "<u4").tobytes()
        return learnt

    def settle(self, learnt: list[str]) -> None:
        """Forget of the new words those not seen before, and all once there is no room: frequent ones come back soon."""
        memory, seen = self.memory, self.seen
        for word in learnt:
            at = hash(word) & SEEN - 1
            if seen[at]:
                self.held += ENTRY + len(word) + len(memory[word])
            else:
                seen[at] = 1
                self.marked += 1
                del memory[word]
        if self.marked > SEEN // 4:
            self.seen, self.marked = bytearray(SEEN), 0
        if self.held > ROOM:
            self.memory, self.held = {}, 0

    def texts(self, texts: list[str]) -> list[bytes]:
        words = [None if any(mark in text for mark in _WHOLE) else text.split() for text in texts]
        new = set().union(*[own for own in words if own is not None])
        learnt = self.learn(new.difference(self.memory))
        find = self.memory.__getitem__
        out = [self.encoded(text) if own is None else b"".join(map(find, own)) for text, own in zip(texts, words)]
        self.settle(learnt)
        return out


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, capacity: int = 4096, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document (its ids, then ``end_id``): doc_id, piece, start, length,
    ids_crc32 (unsigned) and, if ``with_ids``, ids.

    Null text is empty: one piece that holds ``end_id``. Rows that repeat an id give pieces of their own, each row by
    itself; a null id stays null. An empty table gives an empty result. Further columns are not read, so none clashes.
    """
    path = path or default_vocabulary()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if with_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    tail, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        coder = WordIds.shared(path)
        for part in slices(batches, SLICE):
            row, rows = [], []
            for doc, ids in enumerate(coder.texts(part.column("text").to_pylist())):
                ids += tail
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    row.append(doc)
                    rows.append((at // step, at // 4, len(piece) // 4, zlib.crc32(piece)) + ((np.frombuffer(piece, "<i4"),) if with_ids else ()))
            if rows:
                columns = [pa.array(c, f[1]) for c, f in zip(zip(*rows), fields[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row))] + columns, names=[f[0] for f in fields])

    return texts.mapInArrow(run, ddl)


# ---- word-piece counts ---------------------------------------------------------------------------------------------


class PieceCounter:
    """Greedy longest-match-first piece counts of words in one pass over their bytes.

    The trie of the vocabulary has a failure link and a popped-token count at each node: when a node v has no child for
    the next byte, the greedy pieces that are certain by then are popped - only their number is kept - and matching goes
    on at the link, which spells what those pieces leave of v. Words end with a mark (-1) of their own, so pieces that
    close a word and others are told apart; the mark alone is a piece of no tokens, so that a word may also end in a
    piece that has no closing form.
    """

    def __init__(self, pieces: list[tuple[int, ...]]) -> None:
        children: list[dict[int, int]] = [{}]
        final = [False]
        spelled: list[tuple[int, int]] = [(-2, -2)]  # parent and symbol
        for piece in [*pieces, (-1,)]:
            node = 0
            for symbol in piece:
                following = children[node].get(symbol)
                if following is None:
                    following = len(children)
                    children[node][symbol] = following
                    children.append({})
                    final.append(False)
                    spelled.append((node, symbol))
                node = following
            final[node] = True
        self.children = children
        # breadth first, as links of a node rest on links of shorter ones
        link, popped = [-1] * len(children), [0] * len(children)
        level = list(children[0].values())
        while level:
            later: list[int] = []
            for node in level:
                later.extend(children[node].values())
                if final[node]:  # the whole node is one piece
                    link[node], popped[node] = 0, int(spelled[node] != (0, -1))
                    continue
                parent, symbol = spelled[node]
                at, count = link[parent], popped[parent]
                while at >= 0 and symbol not in children[at]:
                    count += popped[at]
                    at = link[at]
                if at >= 0:
                    link[node], popped[node] = children[at][symbol], count
            level = later
        self.link, self.popped = link, popped

    _shared: dict[str, "PieceCounter"] = {}

    @classmethod
    def shared(cls, path: str) -> PieceCounter:
        """The counter of a vocabulary file, built once a worker."""
        if path not in cls._shared:
            cls._shared[path] = cls(vocabulary_pieces(path))
        return cls._shared[path]

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, or -1 if no sequence of greedy pieces spells it."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for symbol in (*word, -1):
            following = children[node].get(symbol)
            while following is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return -1
                following = children[node].get(symbol)
            node = following
        while node > 0:  # what is left of the word
            total += popped[node]
            node = link[node]
        return total if node == 0 else -1


#: The printable bytes that stand for themselves in byte-level vocabularies; the others are written as
#: the characters from U+0100 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    return {chr(b): b for b in _PLAIN} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}


def vocabulary_pieces(path: str) -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary with word ends as byte sequences; -1 closes a word."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    value = byte_values()
    pieces = []
    for piece in vocabulary:
        ends = piece.endswith("</w>") and piece != "</w>"
        body = piece.removesuffix("</w>") if ends else piece
        if body and all(c in value for c in body):
            pieces.append(tuple(value[c] for c in body) + ((-1,) if ends else ()))
    return pieces


def piece_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens (greedy word pieces) and n_unknown (words that no pieces spell,
    one token each).

    Words are runs of anything but the six ASCII blanks with A-Z lower-cased. Null and empty texts have no words. Every
    row is counted by itself, repeated ids or not; an empty table gives an empty result; further columns are not read.
    """
    path = path or default_vocabulary()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        counter = PieceCounter.shared(path)
        memory: dict[bytes, int] = {}
        held = 0
        for batch in slices(batches, SLICE):
            if held > ROOM:
                memory, held = {}, 0
            raw, offsets = utf8_parts(batch.column("text"))
            data = raw.tobytes()
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                words = data[a:b].lower().split()
                counts = list(map(memory.get, words))
                if None in counts:
                    for at, known in enumerate(counts):
                        if known is None:
                            word = words[at]
                            if word not in memory:
                                memory[word] = counter.count(word)
                                held += ENTRY + len(word)
                            counts[at] = memory[word]
                total = sum(counts)
                unknown = counts.count(-1)
                rows.append((len(words), total + 2 * unknown, unknown))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
