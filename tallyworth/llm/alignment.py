"""Align the tokens that two tokenizers give for one text, by the bytes that they cover.

Both tokenizers cut a text at a single space between two other characters, so chunks between such spaces are encoded
once and remembered. The ends of the tokens of a block of documents make two sorted lists. Merging them is divided by
merge-path partitioning: a binary search along each of a row of diagonals finds how many ends of either list come before
it, so that the pieces between diagonals hold equally many ends however long single documents are, and can be merged
without regard to each other. Every distinct end closes one overlap of an A token with a B token; an end of both lists
closes a group. A piece numbers its groups from its own start, and the counts of the pieces before it stitch them.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import written
from tallyworth.llm.packing import _bytes_of_characters

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Ends in a piece of the merge; characters of a block of documents; chunks that a worker remembers.
PIECE = 1 << 16
BLOCK = 1 << 20
REMEMBERED = 300_000
# Pairs of ids up to which their counts are sent to all tasks; beyond, they are joined by a shuffle.
SENT_PAIRS = 3_000_000

# Fixed value: the pre-tokeniser pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RARE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = "\u2581"


class _Pair:
    """Both tokenizers, the bytes of their tokens, and the chunks seen so far with their ids in two pools."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(first)
        special = {t.content for t in whole.get_added_tokens_decoder().values()}
        stand_ins = _bytes_of_characters()
        words = {bytes(stand_ins[c] for c in word): i for word, i in whole.get_vocab(with_added_tokens=False).items() if word not in special}
        self.a = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=words, special_tokens={})
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, i in words.items():
            self.a_bytes[i] = word
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        # Pieces with a space after another character would let merges cross chunks.
        self.cuts = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        self.known: dict[str, int] = {}
        self.a_pool, self.b_pool = array("I"), array("I")
        self.a_starts, self.b_starts, self.same = array("q", [0]), array("q", [0]), array("b")

    def chunks(self, text: str) -> list[str]:
        """The text in chunks that are encoded apart, without the space before each."""
        if not self.cuts:
            return [text]
        odd = text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text or _RARE.search(text)
        return _CUT.split(text) if odd else text.split(" ")

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks with a space before each; `same` tells whether its bytes come back from both."""
        a_bytes, b_bytes, number = self.a_bytes, self.b_bytes, len(self.same)
        for chunk, others in zip(chunks, self.b.encode(chunks, num_threads=1)):
            spaced = " " + chunk
            ids, plain = self.a.encode_ordinary(spaced), spaced.encode()
            self.same.append(b"".join([a_bytes[i] for i in ids]) == plain and b"".join([b_bytes[i] for i in others]) == plain)
            self.a_pool.extend(ids)
            self.b_pool.extend(others)
            self.a_starts.append(len(self.a_pool))
            self.b_starts.append(len(self.b_pool))
            self.known[chunk] = number
            number += 1

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """For all chunks: whether they come back, how many A and B ids they have, and all ids of those that do."""
        kept = len(self.same)
        found = list(map(self.known.get, chunks))
        if None in found:
            self._learn(list(dict.fromkeys(c for c, x in zip(chunks, found) if x is None)))
            found = list(map(self.known.get, chunks))
        numbers = np.array(found, dtype=np.int64)
        same = np.array(self.same, dtype=bool)[numbers]
        a, n_a = _gathered(np.array(self.a_pool, dtype=np.int64), np.array(self.a_starts), numbers)
        b, n_b = _gathered(np.array(self.b_pool, dtype=np.int64), np.array(self.b_starts), numbers)
        if len(self.same) > max(kept, REMEMBERED):
            self._forget(max(kept, REMEMBERED))
        return same, n_a, n_b, a, b

    def _forget(self, kept: int) -> None:
        """Only the first `kept` chunks stay known; a dict keeps the order in which they came."""
        while len(self.known) > kept:
            self.known.popitem()
        del self.same[kept:], self.a_starts[kept + 1 :], self.b_starts[kept + 1 :]
        del self.a_pool[self.a_starts[-1] :], self.b_pool[self.b_starts[-1] :]


def _gathered(pool: np.ndarray, starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of a pool one after the other, and their lengths."""
    sizes = (starts[1:] - starts[:-1])[numbers]
    before = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts[numbers] - before, sizes) + np.arange(int(sizes.sum()))], sizes


@cache
def _pair(first: str, second: str) -> _Pair:
    return _Pair(first, second)


def diagonal(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many ends of `a` are among the first `at` ends of the merged lists, for each of `at`; equal ends: `a` first."""
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # a[middle] belongs to the first `at` ends if it is not above the end of b that would take its place.
        taken = a[np.minimum(middle, len(a) - 1)] <= b[np.clip(at - 1 - middle, 0, len(b) - 1)]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low


def merged_piece(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, ...]:
    """The overlaps and groups of the piece that merges a[a0:a1] with b[b0:b1].

    Gives the A and B tokens of its overlaps, the group of each of its A and B tokens, and how many groups its A ends
    close. Groups count from the piece's start; a B end whose equal A end closed the piece before is in group -1. One end
    on either side is looked at where equal ends fall into two pieces.
    """
    own_a, own_b = a[a0:a1], b[b0 : b1 + 1]
    above = np.searchsorted(own_b, own_a, "left")
    last = b0 + above
    a_closes = (last < len(b)) & (b[np.minimum(last, len(b) - 1)] == own_a)
    low = max(0, a0 - 1)
    before = low + np.searchsorted(a[low:a1], b[b0:b1], "left")
    shared = (before < a1) & (a[np.minimum(before, len(a) - 1)] == b[b0:b1])
    over_a = np.concatenate([np.arange(a0, a1), before[~shared]])
    over_b = np.concatenate([last, np.arange(b0, b1)[~shared]])
    closed = np.concatenate([[0], np.cumsum(a_closes)])
    b_groups = closed[np.maximum(before - a0, 0)] - (shared & (before < a0))
    return over_a, over_b, closed[:-1], b_groups, int(closed[-1])


def merged(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The A and B tokens of all overlaps, and the group of every A and B token, from two lists of ends."""
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, piece), total)
    a_at = diagonal(a, b, at) if len(a) and len(b) else np.minimum(at, len(a))
    b_at = at - a_at
    over_a, over_b, a_groups, b_groups, groups = [], [], [], [], 0
    for a0, a1, b0, b1 in zip(a_at, a_at[1:], b_at, b_at[1:]):
        x, y, own_a, own_b, closed = merged_piece(a, b, a0, a1, b0, b1)
        over_a.append(x)
        over_b.append(y)
        a_groups.append(groups + own_a)
        b_groups.append(groups + own_b)
        groups += closed
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in (over_a, over_b, a_groups, b_groups))


@cache
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids below `size` as the low bytes of a number, and how many there are."""
    texts = [str(i).encode() for i in range(size)]
    return np.array([int.from_bytes(t, "little") for t in texts], dtype=np.uint64), np.array([len(t) for t in texts], dtype=np.uint64)


def rendered(a_ids: np.ndarray, b_ids: np.ndarray, a_groups: np.ndarray, b_groups: np.ndarray, groups: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The text `a1,a2|b1;a3|b2,b3;` of all groups as bytes, and the place where each group starts, with the end last.

    An id (below `size`, of seven digits at most) and the sign after it fill the low bytes of one number; its zero bytes
    are left out at the end.
    """
    digits, sizes = _digits(size)
    in_a, in_b = np.bincount(a_groups, minlength=groups), np.bincount(b_groups, minlength=groups)
    ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
    ids = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
    ids[np.arange(len(a_ids)) + (ends_b - in_b)[a_groups]] = a_ids
    ids[np.arange(len(b_ids)) + ends_a[b_groups]] = b_ids
    signs = np.full(len(ids), ord(","), dtype=np.uint64)
    signs[ends_a + ends_b - in_b - 1] = ord("|")
    signs[ends_a + ends_b - 1] = ord(";")
    own = sizes[ids]
    flat = (digits[ids] | (signs << (own * np.uint64(8)))).astype("<u8").view(np.uint8)
    places = np.concatenate([[0], np.cumsum(own.astype(np.int64) + 1)])
    return flat[flat != 0], places[np.concatenate([[0], ends_a + ends_b])]


def _block(pair: _Pair, texts: list[str | None], piece: int) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of every text."""
    chunks, sizes, words = [], [], len(pair.b_bytes)
    for text in texts:
        own = pair.chunks(text) if text else []
        chunks += own
        sizes.append(len(own))
    out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
    if not chunks:
        return out
    same, chunk_a, chunk_b, a, b = pair.encode(chunks)
    doc_of_chunk = np.repeat(np.arange(len(texts)), sizes)
    bad = np.bincount(doc_of_chunk[~same], minlength=len(texts)) > 0
    a, b = a[np.repeat(~bad[doc_of_chunk], chunk_a)], b[np.repeat(~bad[doc_of_chunk], chunk_b)]
    good = np.flatnonzero(~bad & (np.array(sizes) > 0))
    if not len(good):
        return out
    n_a = np.bincount(doc_of_chunk, chunk_a, len(texts)).astype(np.int64)[good]
    n_b = np.bincount(doc_of_chunk, chunk_b, len(texts)).astype(np.int64)[good]
    over_a, over_b, a_groups, b_groups = merged(np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b]), piece)
    groups = int(a_groups[-1]) + 1
    text, starts = rendered(a, b, a_groups, b_groups, groups, max(len(pair.a_bytes), words))
    group_ends = np.append(0, a_groups[np.cumsum(n_a) - 1] + 1)
    doc_of_link = np.repeat(np.arange(len(good)), n_a)[over_a]
    n_links = np.bincount(doc_of_link, minlength=len(good))
    span = len(pair.a_bytes) * words
    keys, times = np.unique(doc_of_link * span + a[over_a] * words + b[over_b], return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(good) + 1) * span)
    pairs, whole = keys % span, text.data
    for i, k in enumerate(good):
        lo, hi, own = group_ends[i], group_ends[i + 1], slice(cuts[i], cuts[i + 1])
        digest = hashlib.sha256(whole[starts[lo] : starts[hi] - 1]).hexdigest()
        out[k] = (int(n_a[i]), int(n_b[i]), int(hi - lo), int(n_links[i]), digest, pairs[own], times[own])
    return out


def aligned(docs: DataFrame, first: str, second: str, piece: int = PIECE) -> DataFrame:
    """Per row: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    `pairs` holds the different linked id pairs of the document as `a * (ids of B) + b`, `times` how often each is linked.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(first, second)
        for batch in batches:
            at, texts, size = 0, [], 0
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py()
                texts.append(text)
                size += len(text or "")
                if size >= BLOCK or k == batch.num_rows - 1:
                    yield _table(batch.slice(at, len(texts)), _block(pair, texts, piece))
                    at, texts, size = k + 1, [], 0

    def _table(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found))
        plain = [pa.array(c, type=pa.int64()) for c in columns[:4]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in columns[5]])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(t))) for c, t in ((columns[5], np.int64), (columns[6], np.int32))]
        names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *plain, pa.array(columns[4], type=pa.string()), *lists], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    numbers = "n_a long, n_b long, n_groups long, n_links long"
    return numbered.mapInArrow(each, f"row long, doc_id {kind}, {numbers}, groups_sha256 string, pairs array<bigint>, times array<int>")


def pair_counts(found: DataFrame, words: int) -> DataFrame:
    """pair, documents (that hold it linked), best (whether no other pair of its A id is in more)."""
    counts = written(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents")), "alignment-counts")
    a = F.floor(F.col("pair") / words).cast("long").alias("a")
    most = counts.groupBy(a).agg(F.max("documents").alias("most"))
    both = counts.withColumn("a", a).join(most, "a")
    return both.select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, first: str, second: str, piece: int = PIECE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row.

    `first` and `second` are files of a byte-level vocabulary and of a sentencepiece model. Null and empty texts, and
    texts that either tokenizer does not give back byte by byte, have zeros and an empty groups_sha256. Rows that
    share a doc_id, and rows without one, count as documents of their own. No rows give no rows; other columns are left out.

    Documents of a pair are counted by one aggregation. The counts go to all tasks if there are at most SENT_PAIRS of
    them, else the pairs of all documents meet them in a shuffled join.
    """
    words = len(_pair(first, second).b_bytes)
    found = written(aligned(docs, first, second, piece), "alignment-rows")
    counts = written(pair_counts(found, words), "alignment-pairs")
    sent = F.broadcast(counts) if counts.count() <= SENT_PAIRS else counts
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    scored = links.join(sent, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("documents")).cast("long").alias("count_sum"),
    )
    plain = found.drop("pairs", "times").join(scored, "row", "left").na.fill(0, ["n_best", "count_sum"])
    return plain.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
