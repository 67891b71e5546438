"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Encoding.  A merge list allows only a bounded influence of later bytes on earlier tokens
(``sufficient_lookahead``).  Bytes of a piece enter a buffer; a token that ends at least that many bytes
before the end of what has been read can no longer change and is emitted.  So a piece of any length needs
a buffer of the lookahead plus one block.  Pieces come from the pattern that splits text before merging,
cut block by block at a place where white space follows something else, where no piece can continue.
Most pieces are short and come from a bounded cache.

Decoding.  Token bytes enter an incremental UTF-8 state machine, block by block; an incomplete code point
waits for the next block; bytes that are no UTF-8 become U+FFFD.

Defined cases: a null text is the empty text and has no tokens; repeated rows are encoded each; other
columns are not touched, results are ``doc_id`` and the columns named in the functions.  Strings of
special tokens in a text become those tokens.  A null list of ids decodes to the empty text.
"""

from __future__ import annotations

import codecs
import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern that splits text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than single blanks and line ends between words: such texts take the pattern.
UNEVEN = regex.compile(r"[^\S \n]|[ \n][ \n]|[ \n]\Z")
SAFE_CUT = regex.compile(r"(?<=\S)(?=\s)")

#: Code points of a text taken at once, bytes added to a long piece at once, entries of a cache.
TEXT_BLOCK = 1 << 18
PIECE_BLOCK = 4096
CACHE_ENTRIES = 150_000
CACHED_LENGTH = 48
#: Bytes of results in one Arrow batch.
BATCH_BYTES = 8 << 20
#: A merge rule is one number: its rank times this, plus the id that it makes.
IDS = 1 << 24
NO_RULE = 1 << 62


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes that must follow a token before it is final, whatever comes after.

    Take two texts with a common beginning, and follow the merges by rank.  What differs begins at some
    place, first the end of the common part.  It moves left only where a rule (u, v) merges in one text
    across that place, and then by the length of u.  The next rule to move it has a higher rank, and its
    right part begins at that u: u stands on the left edge of its derivation.  The longest such chain,
    counted in bytes, bounds how far a difference can reach.
    """
    reach: dict[bytes, int] = {}
    derived: dict[bytes, list[bytes]] = {}
    longest = 0

    def on_left_edge(token: bytes) -> set[bytes]:
        seen, todo = {token}, [token]
        while todo:
            for u in derived.get(todo.pop(), ()):
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        return seen

    for u, v in merges:
        length = len(u) + max((reach.get(t, 0) for t in on_left_edge(v)), default=0)
        reach[u] = max(reach.get(u, 0), length)
        longest = max(longest, length)
        derived.setdefault(u + v, []).append(u)
    return longest


class Cache(dict):
    """Ids of pieces as packed bytes; bounded, keeping what the last generation used."""

    def __init__(self, encode, prefix: str, entries: int = CACHE_ENTRIES):
        self.encode, self.prefix, self.entries, self.old = encode, prefix, entries, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(self.prefix + piece) if piece or self.prefix else b""
            if len(piece) > CACHED_LENGTH:
                return found
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Transducer:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        back = {s: b for b, s in symbols.items()}
        raw = lambda token: bytes(back[c] for c in token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab = model["vocab"]
        self.byte_ids = [vocab[symbols[b]] for b in range(256)]
        self.rules = {(vocab[a], vocab[b]): rank * IDS + vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.token_bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = raw(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.pieces = regex.compile(PIECES)
        self.split_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.by_piece = Cache(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), "")
        self.by_word = {prefix: Cache(self.encode_pieces, prefix) for prefix in ("", " ", "\n")}

    def merge(self, raw: bytes) -> list[int]:
        """Tokens of a whole byte string: merges by rank, the leftmost of equal rank first."""
        ids = [self.byte_ids[b] for b in raw]
        rules, none = self.rules, NO_RULE
        if len(ids) <= 100:
            ranks = [rules.get(p, none) for p in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) != none:
                i = ranks.index(best)
                new = ids[i] = best % IDS
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = rules.get((ids[i - 1], new), none)
                if i < len(ranks):
                    ranks[i] = rules.get((new, ids[i + 1]), none)
            return ids
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        todo = [(rules[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]
        heapq.heapify(todo)
        while todo:
            rule, i, pair = heapq.heappop(todo)
            j = after[i]
            if ids[i] != pair[0] or j < 0 or ids[j] != pair[1]:
                continue
            ids[i], ids[j], k = rule % IDS, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (p := (ids[i], ids[k])) in rules:
                    heapq.heappush(todo, (rules[p], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in rules:
                heapq.heappush(todo, (rules[p], h, p))
        return [x for x in ids if x >= 0]

    def encode_piece(self, raw: bytes) -> Iterator[int]:
        """Tokens of one piece, emitted once they are stable."""
        if len(raw) <= self.lookahead + PIECE_BLOCK:
            yield from self.merge(raw)
            return
        buffer = b""
        for start in range(0, len(raw), PIECE_BLOCK):
            buffer += raw[start : start + PIECE_BLOCK]
            end, stable = 0, len(buffer) - self.lookahead
            if start + PIECE_BLOCK >= len(raw):
                stable = len(buffer)
            for token in self.merge(buffer):
                if end + len(self.token_bytes[token]) > stable:
                    break
                end += len(self.token_bytes[token])
                yield token
            buffer = buffer[end:]

    def encode_pieces(self, text: str) -> bytes:
        return b"".join(map(self.by_piece.__getitem__, self.pieces.findall(text)))

    def packed_block(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if UNEVEN.search(text):
            return self.encode_pieces(text)
        out, first = [], self.by_word[""]
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out.extend(map(self.by_word[" "].__getitem__, words[1:]))
            first = self.by_word["\n"]
        return b"".join(out)

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text as packed 32-bit integers, block by block."""
        start = 0
        for special in [*(self.split_special.finditer(text) if self.split_special and any(t in text for t in self.special) else ()), None]:
            end = special.start() if special else len(text)
            while start < end:
                stop = end
                if end - start > TEXT_BLOCK and (cut := SAFE_CUT.search(text, start + TEXT_BLOCK, end)):
                    stop = cut.start()
                yield self.packed_block(text[start:stop])
                start = stop
            if special:
                yield np.array([self.special[special[0]]], np.int32).tobytes()
                start = special.end()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.encode_blocks(text)), np.int32).tolist()

    def decode(self, ids: list[int], block: int = 1 << 16) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.token_bytes.__getitem__
        parts = [machine.decode(b"".join(map(table, ids[i : i + block]))) for i in range(0, len(ids), block)]
        return "".join([*parts, machine.decode(b"", True)])


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64))).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text, in the tasks that read it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            done, start, size = [], 0, 0
            for i, text in enumerate(batch.column("text")):
                packed = b"".join(coder.encode_blocks(text.as_py() or ""))
                done.append(packed)
                size += len(packed)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(done)), id_lists(done)], ["doc_id", "ids"])
                    done, start, size = [], i + 1, 0

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column decoded, the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            ids, start, done, size = batch.column("ids"), 0, [], 0
            values, offsets = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            for i in range(batch.num_rows):
                text = coder.decode(values[offsets[i] : offsets[i + 1]].tolist())
                done.append(text)
                size += len(text)
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(done))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(done, pa.string())], ["doc_id", "ids", "decoded"])
                    done, start, size = [], i + 1, 0

    id_type = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, ids array<int>, decoded string")
