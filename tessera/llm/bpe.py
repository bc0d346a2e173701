"""Byte-level BPE through a token automaton: encode by table transitions, decode by arc labels.

The automaton accepts exactly the token sequences that BPE produces. Its states are
the vocabulary's tokens (a state means "this token was emitted last"), its arcs are
labelled with tokens. It is defined by one gadget per merge (a, b) -> c, applied in
merge order to an automaton that starts with one state and all arcs for each byte:

* c becomes a state with the outgoing arcs that b has just before the gadget;
* the arc a -> b is deleted, as that pair is now spelled c;
* every remaining arc x -> a gets a parallel arc x -> c.

A sequence of tokens is what BPE makes of its text exactly if each of its neighbours are
joined by an arc. So every beginning of a word has one last token, and the automaton is
deterministic over bytes: its state after a byte is the longest end of what was read that
begins a token, with the last token of the text up to each place in that end. A transition
picks the one token that ends here and has an arc from the last token before it. Encoding
is one table look-up a byte, then the last tokens are read from the end of the word.

The table is compiled on first use, as all arcs together would hold |V|^2 bits (316 MB for
50,257 tokens): a new transition decides its arcs by unrolling the gadgets backwards from
the younger of the two states, in a few steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, small_batches, texts

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
PRE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHE_ENTRIES = 300_000
STATES, CELLS = 100_000, 1_000_000  # compiled at most; then the tables are begun anew, with equal results


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> str:
    """The tokenizer file's JSON; it has a fixed size (1.3 MB), so it travels with the plan."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable Latin-1 bytes as themselves,
    the others as U+0100 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """The automaton of one merge list. encode(word) gives ids, label(id) gives bytes."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in letters for c in token)}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: token for token, i in self.ids.items()}
        self.labels |= {i: text.encode() for text, i in self.specials.items()}
        for text in self.specials:
            self.ids.pop(text.encode(), None)
        self.born: dict[int, int] = {}  # the merge that makes a token; bytes are there from the start
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.gadgets: dict[int, int] = {}  # deleted arc -> the merge that deletes it
        raw = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        for rank, (a, b) in enumerate(raw):
            left, right = (bytes(letters[c] for c in x) for x in (a, b))
            self._add_gadget(rank, left, right)
        usable = {self.labels[i] for i in self.born} | {bytes([b]) for b in range(256)}
        self.states = {token: i for token, i in self.ids.items() if token in usable}
        self.begins = {token[:n] for token in self.states for n in range(len(token) + 1)}
        self.cells: dict[int, bool] = {}
        self.table: dict[int, int] = {}  # state and byte -> state
        self.numbers: dict[tuple[bytes, tuple[int, ...]], int] = {}
        self.known: list[tuple[bytes, tuple[int, ...]]] = []  # of each state: the end that begins a token, the last tokens along it
        self._state(b"", (-1,))

    def _add_gadget(self, rank: int, left: bytes, right: bytes) -> None:
        a, b, c = self.ids[left], self.ids[right], self.ids[left + right]
        if c not in self.born:
            self.born[c], self.left[c], self.right[c] = rank, a, b
        self.gadgets.setdefault(a << 20 | b, rank)

    def arc(self, a: int, b: int) -> bool:
        """Whether the finished automaton has the arc a -> b."""
        cell = a << 20 | b
        known = self.cells.get(cell)
        if known is None:
            if len(self.cells) >= CELLS:
                self.cells.clear()
            known = self.cells[cell] = self._unroll(a, b)
        return known

    def _unroll(self, a: int, b: int) -> bool:
        born, gadgets = self.born, self.gadgets
        before = len(gadgets) + 1  # gadgets below this rank have been applied
        while True:
            if gadgets.get(a << 20 | b, before) < before:
                return False
            made_a, made_b = born.get(a, -1), born.get(b, -1)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:  # a's arcs were copied from its right part before its gadget deleted one
                before, a = made_a, self.right[a]
            else:  # b's arcs run parallel to those that its left part kept after its gadget
                before, b = made_b + 1, self.left[b]

    def _state(self, end: bytes, last: tuple[int, ...]) -> int:
        """The number of a state; a full table is begun anew, with the start state first."""
        number = self.numbers.get((end, last))
        if number is None:
            if len(self.known) >= STATES:
                self.table.clear()
                self.numbers.clear()
                self.known.clear()
                self._state(b"", (-1,))
            number = self.numbers[end, last] = len(self.known)
            self.known.append((end, last))
        return number

    def _compile(self, state: int, byte: int) -> int:
        """The transition of a state by a byte."""
        end, last = self.known[state]
        end += bytes([byte])
        while end not in self.begins:
            end = end[1:]
        for n in range(len(end), 0, -1):
            token = self.states.get(end[-n:])
            if token is not None and (last[-n] < 0 or self.arc(last[-n], token)):
                break
        else:
            raise ValueError(f"byte {byte} is not in the vocabulary")
        before = len(self.known)
        there = self._state(end, (*last, token)[-len(end) - 1 :])
        if len(self.known) >= before:  # else the table was begun anew and the state left has no number
            self.table[state << 8 | byte] = there
        return there

    def encode(self, word: bytes) -> list[int]:
        """The ids of one pre-split word."""
        table, known, labels = self.table, self.known, self.labels
        state, ends = 0, []
        for byte in word:
            there = table.get(state << 8 | byte)
            state = self._compile(state, byte) if there is None else there
            ends.append(known[state][1][-1])
        path, at = [], len(ends)
        while at:
            path.append(ends[at - 1])
            at -= len(labels[path[-1]])
        return path[::-1]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined; bytes that are not UTF-8 read as U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


class TextEncoder:
    """Whole texts to int32 ids through caches of blank-delimited chunks and pre-split words.

    A blank followed by a visible character always begins a new pre-split word, so texts
    are cut there and equal chunks are encoded once. Texts in which a blank is followed by
    white space or the end are pre-split as a whole. `word` encodes one pre-split word.
    """

    def __init__(self, word: Callable[[str], bytes], specials: dict[str, int], entries: int = CACHE_ENTRIES):
        self.word, self.specials, self.entries = word, specials, entries
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    def _word(self, word: str) -> bytes:
        if len(self.words) >= 4 * self.entries:
            self.words.clear()
        ids = self.words[word] = self.word(word)
        return ids

    def _split_words(self, text: str) -> bytes:
        """Of a text without special strings."""
        get = self.words.get
        return b"".join([get(word) or self._word(word) for word in PRE_SPLIT.findall(text)])

    def _chunk(self, chunk: str) -> bytes | None:
        """Of a blank and the chunk; None if white space or nothing follows the blank. Letters alone, or
        letters and one mark after them, need no pattern to be split. Chunks of words that are met for
        the first time are not kept: most of them never come again."""
        words = self.words
        if chunk.isalpha():
            word, mark = " " + chunk, ""
        elif not chunk or chunk[0].isspace():
            return self._keep(chunk, None)
        elif chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
            word, mark = " " + chunk[:-1], chunk[-1]
        else:
            return self._keep(chunk, self._split_words(" " + chunk))
        ids = words.get(word)
        end = words.get(mark) or self._word(mark) if mark else b""
        return self._word(word) + end if ids is None else self._keep(chunk, ids + end)

    def _keep(self, chunk: str, ids: bytes | None) -> bytes | None:
        if len(self.chunks) >= self.entries:
            self.chunks.clear()
        self.chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if self.cut and self.cut.search(text):
            packed = {s: np.int32(i).tobytes() for s, i in self.specials.items()}
            return np.frombuffer(b"".join([packed[x] if x in packed else self._split_words(x) for x in self.cut.split(text)]), np.int32)
        first, *rest = text.split(" ")
        known = self.chunks.get
        parts = [known(x) or self._chunk(x) for x in rest]
        if None in parts:
            return np.frombuffer(self._split_words(text), np.int32)
        return np.frombuffer(b"".join([self._split_words(first), *parts]), np.int32)


_LOADED: dict[int, tuple[TokenAutomaton, TextEncoder]] = {}


def automaton(vocabulary: str) -> tuple[TokenAutomaton, TextEncoder]:
    """Compiled once for each Python worker."""
    key = hash(vocabulary)
    if key not in _LOADED:
        _LOADED.clear()
        machine = TokenAutomaton(vocabulary)
        packed = {i: np.int32(i).tobytes() for i in machine.labels}
        _LOADED[key] = machine, TextEncoder(lambda word: b"".join([packed[i] for i in machine.encode(word.encode("utf-8", "surrogatepass"))]), machine.specials)
    return _LOADED[key]


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decode: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns id_col, ids array<int> and, with decode, decoded string. Null and empty texts
    have no ids and decode to the empty text; repeated rows are encoded each; other columns
    of docs are not read, so their names cannot clash. A map without a shuffle; memory is
    bounded by the caches and the longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(path or vocabulary_path()))
    key_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key_type}, ids array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, encoder = automaton(shared.value)
        for batch in slices(batches, 128):
            ids = [encoder.encode(text) for text in texts(batch, 1)]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decode:
                columns.append(pa.array([machine.decode(x.tolist()) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and the text that the ids spell. Null or empty ids give the empty text."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path or vocabulary_path()))
    key_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = automaton(shared.value)
        for batch in slices(batches, 128):
            decoded = [machine.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {key_type}, decoded string")
