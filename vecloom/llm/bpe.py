"""Byte-level BPE encoding and decoding by tree concatenation.

A text longer than `leaf` characters is cut in halves, these again; the leaves are encoded on their own, then joined
upwards. Two facts make a join exact:

- Pretokens (the runs that the vocabulary's pattern cuts) are found from left to right and look at most two characters
  beyond their end. So in a left half all that ends three characters before the cut holds for the whole, and where a
  window that starts there meets a border of the right half, everything from there on is the right half's. The window
  grows until it meets one.
- Within one long pretoken, a token sequence is the encoding if each neighbouring pair is. A window of tokens on both
  sides of the join is encoded anew and grows until its first and last tokens are those that the halves have there.

Short pretokens are kept in a bounded cache. Characters on whose class the pattern library and the tokenizer library
disagree (letters of newer Unicode versions) are found by a probe of each new character; a text that has one is encoded
by the tokenizer library as a whole.

Defined results: null is the empty text (no ids, empty decoded text); equal texts have equal ids; empty tables give no
rows; other columns are not read. Added tokens in a text are encoded as their own id, as the library does by default.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

LEAF = 4096
LONG_PRETOKEN = 256
#: Pretokens in each of the two generations of a worker's cache.
CACHE = 100_000
REACH = 3


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Fixed value: the pattern of byte-level pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def join_pieces(find: Callable[[str], list[str]], text: str, mid: int, hi: int, left: list[str], right: list[str]) -> list[str]:
    """The pretokens of both halves of text[:hi], of which left ends and right starts at mid."""
    a, k = mid, len(left)
    while k and a > mid - REACH:
        k -= 1
        a -= len(left[k])
    width = 64
    while True:
        b = min(hi, mid + width)
        window = find(text[a:b])
        borders, at = {}, mid
        for j, piece in enumerate(right):
            if at > b:
                break
            borders[at] = j
            at += len(piece)
        if b == hi:
            borders[hi] = len(right)
        at = a
        for i, piece in enumerate(window):
            if at >= mid and at in borders and (at <= b - REACH or b == hi):
                return left[:k] + window[:i] + right[borders[at] :]
            at += len(piece)
        if b == hi:
            return left[:k] + window
        width *= 2


def tree_pieces(find: Callable[[str], list[str]], text: str, leaf: int = LEAF) -> list[str]:
    """find(text), from leaves of at most `leaf` characters."""

    def build(lo: int, hi: int) -> list[str]:
        if hi - lo <= leaf:
            return find(text[lo:hi])
        mid = (lo + hi) // 2
        part = text[lo:hi]
        return join_pieces(find, part, mid - lo, hi - lo, build(lo, mid), build(mid, hi))

    return build(0, len(text))


def tree_tokens(encode: Callable[[bytes], list[int]], length: Callable[[int], int], word: bytes, leaf: int = LONG_PRETOKEN) -> list[int]:
    """encode(word) of one pretoken, from leaves; length(id): bytes of a token."""

    def build(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(word[lo:hi])
        mid = (lo + hi) // 2
        left, right = build(lo, mid), build(mid, hi)
        k = 4
        while True:
            tail, head = left[-k:], right[:k]
            a, b = mid - sum(map(length, tail)), mid + sum(map(length, head))
            window = encode(word[a:b])
            if (a == lo or window[:2] == tail[:2]) and (b == hi or window[-2:] == head[-2:]):
                return left[: len(left) - len(tail)] + window + right[len(head) :]
            k *= 2

    return build(0, len(word))


class Cache(dict):
    """The ids of pretokens as bytes; what was not used while CACHE others came is forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= LONG_PRETOKEN:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encodes and decodes as the tokenizer file at `path` says. One for each Python worker."""

    def __init__(self, path: str, leaf: int = LEAF, long_pretoken: int = LONG_PRETOKEN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf, self.long = leaf, long_pretoken
        self.find = regex.compile(PATTERN).findall
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in self.alphabet.items()}
        added = self.library.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = {t.content: i for i, t in added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.bytes_of = {i: t.encode() if t in self.added else bytes(back[c] for c in t) for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.merge = self._piece_encoder()
        self.cache = Cache(self._pretoken)
        table = [self.bytes_of[i] for i in range(len(self.bytes_of))]
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_start = np.concatenate(([0], np.cumsum([len(t) for t in table])))
        self.agreed: dict[str, bool] = {}

    def _agree(self, ch: str) -> bool:
        """Whether both libraries put this character in the same class."""
        text = f"a{ch}1{ch}!{ch}{ch} b"
        cut, at = [], 0
        for piece in self.find(text):
            cut.append((at, at + len(piece)))
            at += len(piece)
        return [x for _, x in self.library.pre_tokenizer.pre_tokenize_str(text)] == cut

    def _trusted(self, text: str) -> bool:
        if text.isascii():
            return True
        for ch in set(text):
            if ch > "\x7f":
                ok = self.agreed.get(ch)
                if ok is None:
                    ok = self.agreed[ch] = self._agree(ch)
                if not ok:
                    return False
        return True

    def _piece_encoder(self) -> Callable[[bytes], list[int]]:
        """Merges of one piece: by rank where the vocabulary numbers merged tokens in the order of its merges, else by the library."""
        model = json.loads(self.library.to_str())["model"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)) and not model.get("ignore_merges"):
            import tiktoken

            ranks = {self.bytes_of[i]: i for t, i in model["vocab"].items() if t not in self.added}
            return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        return lambda piece: [t.id for t in self.library.model.tokenize("".join(map(self.alphabet.__getitem__, piece)))]

    def _pretoken(self, piece: str) -> bytes:
        word = piece.encode()
        ids = self.merge(word) if len(word) <= self.long else tree_tokens(self.merge, lambda i: len(self.bytes_of[i]), word, self.long)
        return array("i", ids).tobytes()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as 32-bit integers."""
        if not text:
            return b""
        if not self._trusted(text):
            return array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        out = []
        for segment in self.split(text) if self.split else (text,):
            if segment in self.added:
                out.append(array("i", [self.added[segment]]).tobytes())
                continue
            pieces = self.find(segment) if len(segment) <= self.leaf else tree_pieces(self.find, segment, self.leaf)
            out.append(b"".join(map(self.cache.__getitem__, pieces)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens, and where each token's end."""
        start = self.token_start[ids]
        size = self.token_start[ids + 1] - start
        end = np.cumsum(size)
        return self.token_bytes[np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)], end

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64))[0].tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and the text decoded from these ids. The file at `path` must be there on all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in slices(batch, text_col):
                coded = [c.encode_bytes(t) for t in part.column(text_col).to_pylist()]
                ids = np.frombuffer(b"".join(coded), np.int32)
                cut = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded])))
                data, end = c.decode_bytes(ids.astype(np.int64))
                at = np.concatenate(([0], end))[cut]
                text = data.tobytes()
                decoded = [text[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
                yield pa.record_batch([part.column(id_col), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
