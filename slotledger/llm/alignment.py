"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often in the corpus.

Tokens' byte lengths are summed to their ends (cumsum); ends that both have cut a text into groups
(intersect1d), and each token's group is found by its end (searchsorted). A token's links are the
other tokenizer's tokens whose byte ranges overlap its own, a run between two searched positions, which
repeat and a running index expand. All of this runs over the tokens of many runs at once, each
after the last one.

Neither tokenizer has a token that goes from a sign other than white space on to a space (A by its pattern, B by its
vocabulary, which is looked through), so a text is encoded in runs
that start with a space after such a sign. Both tokenizers' tokens end where a run does, so a text's groups and links are those of its runs, and short runs' are kept.

A text's distinct pairs of ids are counted over the corpus in two stages: sums by pair and salt, where all rows
of a map task share a salt, then by pair. A pair that makes over 1 in ``HOT`` of all links is among at most ``HOT``
such, which are broadcast to the texts' links; the others meet theirs by a shuffle in which no pair is hot.

Defined results: texts that are null or empty, or whose joined token bytes differ from space + text in either
tokenizer, have no tokens: zeros, and '' for the hash. Strings of special tokens are ordinary text. Repeated rows count as
documents each. Text length is bounded only by the worker's memory for one text. Columns other than doc_id and text are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slotledger.llm.common import cut, slices

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: White space as Unicode has it.
SPACES = "\t-\r \x85\xa0  -     　"
#: From a space to the next one that follows a sign other than white space; spaces at a text's end stay with its last run.
RUN = re.compile(f" (?:[^ ]+|(?<=[{SPACES}]) | (?= *\\Z))*")
MARK = "▁"
#: Runs that are kept, and as many older ones; the longest of them; texts of a piece of a batch; signs that are encoded together.
CACHED, SHORT, ROWS, PART = 1 << 18, 64, 200, 1 << 15
#: A pair of ids as one integer: A's id above B's.
SHIFT = 15
HOT, SALTS = 20_000, 64


def byte_level() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their tokens, and the ids of short runs."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        signs, vocab = byte_level(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(map(signs.__getitem__, token)) if all(c in signs for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes)]
        numbers = [str(i) for x in (self.a_bytes, self.b_bytes) for i in range(len(x))]
        self.shown = np.array([[n + sign for n in numbers] for sign in ",|;"], object)  # ids of A, then of B, before each sign
        if any(re.search(f"[^{SPACES}{MARK}][ {MARK}]", p) for p in pieces):
            raise ValueError(f"{b} has pieces that go on over a space")
        self.known: dict[str, tuple[str, bytes, int]] = {}
        self.older: dict[str, tuple[str, bytes, int]] = {}

    def encoded(self, runs: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
        """The runs (each from a space to a sign other than white space, but for single ones) whose tokens' bytes are their own, and the ids of all of them by both, in pieces."""
        text = "".join(runs)
        a, b, raw = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]), text.encode()
        if b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw:
            return runs, [np.array(a, np.int64)], [np.array(b, np.int64)]
        if len(runs) == 1:
            return [], [], []
        one, two = self.encoded(runs[: len(runs) // 2]), self.encoded(runs[len(runs) // 2 :])
        return one[0] + two[0], one[1] + two[1], one[2] + two[2]

    def learn(self, runs: list[str]) -> dict[str, tuple[str, bytes, int]]:
        """What each run gives: its groups as text, its links as pairs of ids, and its numbers of tokens and groups. A run whose tokens' bytes differ from it isn't there."""
        good, a, b = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        part, size = [], 0
        for run in [r for r in runs if MARK not in r]:
            alone = run[-1] in SPACES  # what follows could join its white space
            part += [] if alone else [run]
            size += len(run)
            for p in ([run],) * alone + (part,) * (size > PART):
                for into, found in zip((good, a, b), self.encoded(p) if p else ([], [], [])):
                    into += found
            if size > PART:
                part, size = [], 0
        for into, found in zip((good, a, b), self.encoded(part) if part else ([], [], [])):
            into += found
        return dict(zip(good, aligned([len(r.encode()) for r in good], np.concatenate(a), np.concatenate(b), self)))

    def texts(self, texts: list[str | None]) -> list[list[tuple[str, bytes, int]]]:
        """What the runs of each text give, nothing where it has no tokens."""
        runs = [RUN.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        new = set().union(*runs) - self.known.keys()
        self.known |= {k: self.older[k] for k in new & self.older.keys()}  # what is still met stays
        found = self.learn(sorted(new - self.known.keys()))
        self.known |= {k: v for k, v in found.items() if len(k) <= SHORT}
        out = []
        for own in runs:
            got = [self.known.get(r) or found.get(r) for r in own]
            out.append([] if None in got else got)
        return out


@lru_cache(1)
def pair(a: str, b: str) -> Pair:
    return Pair(a, b)


def aligned(sizes: list[int], a: np.ndarray, b: np.ndarray, p: Pair) -> list[tuple[str, bytes, int]]:
    """Of runs of so many bytes, one after the other, which the tokens a and b cover: groups (each closed by ;), links, and the numbers of a, b and groups in one integer."""
    ends = np.cumsum(np.array(sizes, np.int64))
    end_a, end_b = np.cumsum(p.sizes[0][a]), np.cumsum(p.sizes[1][b])
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)  # the ends of runs are among them
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    # the tokens of b that overlap each of a: from the first that ends after its start to the first that doesn't end before its end
    first, last = np.searchsorted(end_b, end_a - p.sizes[0][a], "right"), np.searchsorted(end_b, end_a)
    n = last - first + 1
    before = np.cumsum(n) - n
    left = np.repeat(np.arange(len(a)), n)
    right = np.arange(len(left)) - before[left] + first[left]
    links = (a[left] << SHIFT | b[right]).astype("<i4").tobytes()
    # a group's ids of a, then those of b: each with the sign that follows it
    side = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    closes = np.append(side[1:] != side[:-1], [True] * min(len(side), 1))
    sign = np.where(closes, 1 + side % 2, 0)
    shown = np.concatenate([a, b + len(p.a_bytes)])[order]
    parts = p.shown[sign, shown].tolist()
    at_a, at_b, at_g = (np.searchsorted(x, ends, "right") for x in (end_a, end_b, cuts))
    at_l = np.append(before, len(left))[at_a]
    out, i, j, g, m = [], 0, 0, 0, 0
    for i2, j2, g2, m2 in zip(at_a.tolist(), at_b.tolist(), at_g.tolist(), at_l.tolist()):
        out.append(("".join(parts[i + j : i2 + j2]), links[4 * m : 4 * m2], (i2 - i) << 80 | (j2 - j) << 40 | g2 - g))
        i, j, g, m = i2, j2, g2, m2
    return out


def summed(got: list[tuple[str, bytes, int]]) -> tuple:
    """n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and how often each is linked, of a text's runs."""
    if not got:
        return 0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int32)
    made, links, n = "".join([g[0] for g in got]), np.frombuffer(b"".join([g[1] for g in got]), "<i4"), sum([g[2] for g in got])
    pairs, times = np.unique(links, return_counts=True)
    low = (1 << 40) - 1
    return n >> 80, n >> 40 & low, n & low, len(links), hashlib.sha256(made[:-1].encode()).hexdigest(), pairs, times.astype(np.int32)


COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def tokenised(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, A's id above ``SHIFT`` bits of B's) and times of each row."""
    a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)

    def run(batches):
        p = pair(a, b)
        for part in slices(batches, ROWS):
            if len(part):
                out = pd.DataFrame([summed(got) for got in p.texts(part["text"].tolist())], columns=[c.split()[0] for c in COLUMNS.split(", ")])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {COLUMNS}")


def counted(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many texts each pair of ``links`` (a row for each text and pair) is, and whether no other of A's id is in more."""
    some = links.groupBy("pair", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.count("*").alias("n"))
    n = cut(some.groupBy("pair").agg(F.sum("n").alias("n")))
    most = n.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("n").alias("most"))  # at most a row for each id of A
    return n.withColumn("a", F.shiftright("pair", SHIFT)).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    rows = cut(tokenised(docs, a, b).withColumn("uid", F.monotonically_increasing_id()))
    links = rows.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("uid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    counts = cut(counted(links))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("n") * HOT > total))  # fewer than HOT
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    often = links.join(hot, "pair").groupBy("uid").agg(*sums)
    rest = links.join(hot, "pair", "left_anti").join(counts.where(F.col("n") * HOT <= total), "pair").groupBy("uid").agg(*sums)
    both = often.unionByName(rest).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("pairs", "times").join(both, "uid", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", none("n_best"), none("count_sum"), "groups_sha256")
