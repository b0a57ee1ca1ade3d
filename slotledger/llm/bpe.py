"""Byte-level BPE: array pre-tokenisation, cached pair merging, and decoding.

Each code point becomes a class; classes act on the open token's state as functions
from state to state, packed two bits a state into one byte. Composition of such
functions is associative, so a blocked prefix scan gives the state at every character
without a regex or a loop over characters. Many texts are scanned as one array with
a class of its own between them.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows
are encoded alike; text length is bounded only by the worker's memory for one text; columns other than doc_id
and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from slotledger.llm.common import slices

RANKS = "byte_bpe_50k.tiktoken"
SPACE, LETTER, NUMBER, OTHER, BLANK, END = range(6)
#: What is open after a character: nothing that a token can go on from, a blank that joins what follows, a word, other signs.
NONE, BLANK_OPEN, WORD_OPEN, OTHER_OPEN = range(4)
AFTER = {SPACE: NONE, LETTER: WORD_OPEN, NUMBER: WORD_OPEN, OTHER: OTHER_OPEN, BLANK: BLANK_OPEN, END: NONE}
SENTINEL = 0x110000
SLAB = 1 << 20
BLOCK = 64
CACHED = 1 << 19


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, SENTINEL)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(name, every):
            out[points[m.start() : m.end()]] = kind
    out[0x20], out[SENTINEL] = BLANK, END
    return out


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Each class as a packed function of the state; and what two packed functions, one after the other, give."""
    step = np.array([sum(AFTER[k] << 2 * s for s in range(4)) for k in range(6)], np.uint8)
    f = np.arange(256, dtype=np.uint16)
    out = np.zeros((256, 256), np.uint16)  # first, second
    for s in range(4):
        mid = f >> 2 * s & 3
        out |= (f[None, :] >> 2 * mid[:, None] & 3) << 2 * s
    return step, out.astype(np.uint8)


def scan(steps: np.ndarray) -> np.ndarray:
    """The state after each character, from NONE: blocked inclusive scan under composition."""
    _, then = tables()
    n = len(steps)
    identity = np.uint8(0b11100100)
    pad = np.full(-n % BLOCK, identity, np.uint8)
    grid = np.concatenate([steps, pad]).reshape(-1, BLOCK).T.copy()
    for k in range(1, BLOCK):
        grid[k] = then[grid[k - 1], grid[k]]
    ends = grid[-1].copy()
    d = 1
    while d < len(ends):
        ends[d:] = then[ends[:-d], ends[d:]]
        d *= 2
    before = np.concatenate([[identity], ends[:-1]]).astype(np.uint8)
    return (then[before[None, :], grid] & 3).T.reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where the tokens of PATTERN begin, in an array of code points with SENTINEL after each text."""
    kind = classes()[points]
    state = scan(tables()[0][kind])
    before = np.concatenate([[NONE], state[:-1]])
    prior = np.concatenate([[END], kind[:-1]]).astype(np.uint8)
    nxt = np.concatenate([kind[1:], [END]]).astype(np.uint8)
    white = (kind == SPACE) | (kind == BLANK)
    start = np.where(white, ~((prior == SPACE) | (prior == BLANK)), (before != BLANK_OPEN) & (kind != prior))
    # the last of several white characters before a word stands apart: alone, or with the word if it is a blank
    start |= white & (nxt != SPACE) & (nxt != BLANK) & (nxt != END)
    start |= kind == END
    at = np.flatnonzero(points == 0x27)
    if at.size:
        at = at[(before[at] == NONE) | (before[at] == WORD_OPEN)]
        far = np.append(points, [SENTINEL, SENTINEL])
        a, b = far[at + 1], far[at + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two] + 3] = True
    return start


class Pieces(dict):
    """Bytes of a pre-token -> its ids, little-endian 32-bit; misses are merged and kept."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHED:
            self.clear()
        got = self.ranks.get(piece)
        ids = merge(piece, self.ranks) if got is None else [got]
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i
    back = list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not live[i] or mid >= to or mid >= n or end[mid] != to or not live[mid]:
            continue
        end[i], live[mid] = to, False
        if to < n:
            back[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (j := back[i]) >= 0 and (r := ranks.get(piece[j:to])) is not None:
            heapq.heappush(heap, (r, j, to))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


@lru_cache(2)
def codec(path: str) -> tuple[Pieces, list[bytes]]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    back = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        back[i] = piece
    return Pieces(ranks), back


def encode(texts: list[str], path: str) -> list[tuple[bytes, np.ndarray]]:
    """For each text: its ids as little-endian 32-bit integers, and the byte offsets where its pre-tokens begin."""
    pieces, _ = codec(path)
    points = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le"), "<u4"), np.uint32(SENTINEL)) for t in texts])
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    width[points == SENTINEL] = 0
    at = np.concatenate([[0], np.cumsum(width)])
    begins = np.flatnonzero(boundaries(points))
    stops = np.flatnonzero(points[begins] == SENTINEL)
    offsets = at[begins]
    cuts = offsets.tolist()
    raw = "".join(texts).encode()
    out, first = [], 0
    for stop in stops.tolist():
        own = cuts[first : stop + 1]
        ids = b"".join(map(pieces.__getitem__, [raw[a:b] for a, b in zip(own, own[1:])]))
        out.append((ids, offsets[first:stop] - offsets[first]))
        first = stop + 1
    return out


def decode(ids: bytes, path: str) -> bytes:
    _, back = codec(path)
    return b"".join(map(back.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def slabs(texts: list[str], most: int = SLAB) -> Iterator[list[str]]:
    """Runs of texts with about ``most`` characters."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit) and offsets (byte offsets of pre-tokens) of each row's whole text."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches):
        for b in slices(batches):
            got = [x for s in slabs(b["text"].fillna("").tolist()) for x in encode(s, path)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [x[0] for x in got], "offsets": [x[1] for x in got]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, offsets array<bigint>")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and hashes of each row's ids, and of the bytes to which they decode; ids do not leave the worker."""
    path = path or public_tokenizers.path(RANKS)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches):
        for b in slices(batches):
            ids = [x[0] for s in slabs(b["text"].fillna("").tolist()) for x in encode(s, path)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [sha(x) for x in ids], "decoded_sha256": [sha(decode(x, path)) for x in ids]})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
