"""Packing by Karmarkar-Karp multiway differencing.

Documents become ids and an end id. Whole windows are cut off a document's start; what
is left is cut into parts of at most ``part`` tokens. Pieces, whole windows among them, are dealt at random into groups
of bounded size, and within a group the differencing method gives windows of nearly equal
sums: it keeps partial partitions of the pieces over all windows, takes the two with
the largest spread and joins the large sums of one with the small sums of the other. If a
window exceeds the capacity, one more window is allowed and the method runs again.

The tokenizer takes the strings of its special tokens, such as ``<|endoftext|>``, for ordinary text, as the
vocabularies' own description sets it, so that no text can forge an end.

Defined results: a null or empty text is the end id alone; an empty table gives no rows;
repeated rows, also of one doc_id or none, are packed each for itself and dealt over all groups; a text of any
length is encoded whole, and a long document's windows
are dealt over many groups; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotledger.llm.common import cut, slices

MODEL = "word_bpe_49k.json"
END = np.array([1], "<u4").tobytes()
LENGTH = 2048
PART = 256
WINDOWS = 128  # that a group fills on average
CACHED = 1 << 20
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(2)
def model(path: str) -> tuple[Tokenizer, dict[bytes, bytes], np.ndarray]:
    """The tokenizer, a store of words' ids, and which ids end a word."""
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    last = np.zeros(t.get_vocab_size(), bool)
    last[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
    return t, {}, last


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers.

    The model drops white space and no token spans it, so words are encoded once and kept.
    """
    tokenizer, known, last = model(path)
    words = [t.encode().split() for t in texts]
    new = [w for w in set().union(*words) if w not in known]
    if len(known) + len(new) > CACHED:
        known.clear()
        new = list(set().union(*words))
    plain, ends, odd = [], [], []
    for w in new:
        t = w.decode()
        core = t.rstrip(".,;:!?")
        if core.lower().isalpha():
            plain.append(t)
            ends.append(1 + (core != t))
        else:
            odd.append(t)
    for i in range(0, len(plain), 512):  # letters, and the signs after them, each end where an id ends a word
        some = plain[i : i + 512]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        at = (np.flatnonzero(last[ids]) + 1)[np.cumsum(ends[i : i + 512]) - 1].tolist()
        raw = ids.tobytes()
        known.update(zip(map(str.encode, some), [raw[4 * a : 4 * b] for a, b in zip([0, *at], at)], strict=True))
    for t, e in zip(odd, tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
        known[t.encode()] = np.array(e.ids, "<u4").tobytes()
    return [b"".join(map(known.__getitem__, w)) for w in words]


def spans(n: int, length: int, part: int) -> list[tuple[int, int]]:
    whole = n - n % length
    return [(i, length) for i in range(0, whole, length)] + [(i, min(part, n - i)) for i in range(whole, n, part)]


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, part: int = PART) -> DataFrame:
    path = path or public_tokenizers.path(MODEL)

    def run(batches):
        for b in slices(batches):
            rows = []
            texts, ids = b["text"].fillna("").tolist(), b["doc_id"].tolist()
            for k in range(0, len(texts), 256):
                for d, got in zip(ids[k : k + 256], encode(texts[k : k + 256], path)):
                    got += END
                    n = len(got) // 4
                    rows += [(d, i, m, zlib.crc32(got[4 * i : 4 * (i + m)]), n) for i, m in spans(n, length, part)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInPandas(run, PIECES.format(docs.schema["doc_id"].dataType.simpleString()))


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """``k`` lists of positions in ``sizes`` with nearly equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    # a partial partition: sums in falling order, less the least; its number in ``joined``
    first = np.zeros(k, np.int64)
    heap = []
    for i, n in enumerate(sizes):
        sums = first.copy()
        sums[0] = n
        heap.append((-n, i, sums))
    heapq.heapify(heap)
    joined = []
    while len(heap) > 1:
        _, a, sums = heapq.heappop(heap)
        _, b, more = heapq.heappop(heap)
        sums = sums + more[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        heapq.heappush(heap, (-int(sums[0]), len(sizes) + len(joined), sums))
        joined.append((a, b, order))
    # from the last join down: the window of each place in a partial partition
    at = {heap[0][1]: np.arange(k)}
    for n in reversed(range(len(joined))):
        a, b, order = joined[n]
        own = np.empty(k, np.int64)
        own[order] = at.pop(len(sizes) + n)
        at[a], at[b] = own, own[::-1]
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(len(sizes)):
        out[at[i][0]].append(i)
    return out


def windows(sizes: list[int], length: int = LENGTH) -> list[list[int]]:
    k = -(-sum(sizes) // length)
    while True:
        out = differencing(sizes, k)
        if max((sum(sizes[i] for i in x) for x in out), default=0) <= length:
            return [x for x in out if x]
        k += 1


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, part: int = PART) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    got = cut(pieces(docs, path, length, part))
    total = got.agg(F.sum("length")).first()[0] or 0
    groups = max(1, total // (length * WINDOWS))
    names = got.columns

    def run(key, x):
        x = x.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = x["length"].to_numpy()
        sequence, offset = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for n, own in enumerate(windows(sizes.tolist(), length)):
            sequence[own], offset[own] = n, np.cumsum(sizes[own]) - sizes[own]
        return x[names].assign(sequence_id=int(key[0]) * (1 << 32) + sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in got.schema) + ", sequence_id long, offset long"
    # ``got`` is read from files, so that a row has the same number in each attempt
    dealt = got.withColumn("_g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_g").applyInPandas(run, schema)
