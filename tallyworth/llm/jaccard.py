"""Near duplicates by the Jaccard similarity of their word shingles, without losing a link.

1. Every text becomes its set of shingle hashes. Equal sets are one class with one representative.
2. The whole corpus as one group. A set that links shares many hashes with some other set, and a good part of them is
   among its smallest hashes. So every set sends its smallest hashes, and only sets of which enough also stand among the
   smallest of another set stay in question.
3. Partition. The universe of hashes is cut into so many slices that two sets that link must agree in a whole slice
   (or in two thirds of one) of their size class. Sets that agree there form a group. Agreement in almost empty
   slices says little, so there the sets carry a bit map, and two of them stay together only if their maps allow a link.
4. The groups that touch become candidate components. Inside one, documents are put into small groups by their smallest
   hash; a matrix of tokens by groups gives, for each document, a bound of its overlap with every group; only groups
   that can reach the threshold are opened, and their members compared exactly.
5. The links found make the components.

A candidate component of more than OPEN hashes is opened in pairs of blocks, each pair in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import shuffle_partitions, written
from tallyworth.llm.components import components
from tallyworth.llm.shingles import chunks, mixed, raw_bytes, shingle_sets

# Sizes within a class differ by this factor at most; a slice with at most so many hashes is weak.
CLASS_RATIO, WEAK = 1.5, 1
# Hashes of a candidate component that one task opens; documents of a group; hashes that a task hands on at once.
OPEN, GROUP, HANDED_ON = 1_000_000, 32, 500_000
# Cells of a matrix of tokens by sets up to which it is held as numbers.
CELLS = 6_000_000
# Bits of a map: two for three hashes tell sets apart that have nothing in common.
LEAST_MAP, MOST_MAP = 256, 16384

_SETS, _HITS, _PREFIX, _STRONG, _FEEBLE = 0, 1, 2, 3, 4
SET = np.dtype([("doc", "<i8"), ("known", "u1"), ("n", "<i8"), ("d1", "<u8"), ("d2", "<u8")])
_BLOBS = "kind int, bucket int, width int, blob binary"


def _blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["kind", "bucket", "width", "blob"])


def _edges(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of every run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.append(first[1:], len(sorted_values))


def shared_ahead(size: int, num: int, den: int) -> int:
    """Hashes that two linked sets, the smaller of this size, share at least among their smallest ones."""
    return max(1, min((den - num) * size // den, -(-num * size // den)))


def smallest_needed(size: int, num: int, den: int) -> int:
    """How many of its smallest hashes a set has to send for that."""
    return size - -(-num * size // den) + shared_ahead(size, num, den)


def _smallest(words: int, num: int, den: int, buckets: int):
    """Sets in short, and the smallest hashes of each, as packed arrays by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs, parts, held = set(), [], [], 0

        def hand_on() -> list[tuple[int, int, int, bytes]]:
            ids = np.array(docs, dtype=np.int64)
            owner = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(p) for p in parts])
            print_ = np.concatenate(parts).astype(np.uint32)  # the low half of a hash: a chance match only asks for more work
            bucket = (print_ % np.uint32(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            owner, print_, bucket = owner[order], print_[order], bucket[order]
            rows = []
            for a, b in zip(*_edges(bucket)):
                used, place = np.unique(owner[a:b], return_inverse=True)
                blob = ids[used].tobytes() + place.astype(np.uint32).tobytes() + print_[a:b].tobytes()
                rows.append((_PREFIX, int(bucket[a]), len(used), blob))
            return rows

        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = raw_bytes(batch.column(1))
            for first, last in chunks(offsets):
                short = np.zeros(last - first, dtype=SET)
                found = shingle_sets(raw, offsets[first : last + 1], words)
                for row, doc, tokens in zip(short, ids[first:last], found):
                    d1 = mixed(tokens).sum(dtype=np.uint64)
                    d2 = mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    row["doc"], row["known"] = doc or 0, doc is not None
                    row["n"], row["d1"], row["d2"] = len(tokens), d1, d2
                    key = (int(d1), int(d2))
                    # Of equal sets in a task one is enough here; their class is found by the digest.
                    if doc is not None and len(tokens) and key not in seen:
                        seen.add(key)
                        docs.append(doc)
                        parts.append(tokens[: smallest_needed(len(tokens), num, den)])
                        held += len(parts[-1])
                rows = [(_SETS, first % buckets, 0, short.tobytes())]
                if held > HANDED_ON:
                    rows += hand_on()
                    docs, parts, held = [], [], 0
                yield _blobs(rows)
        if docs:
            yield _blobs(hand_on())

    return run


_FOUND = "kind int, doc_id long, n long, d1 long, d2 long"
_FOUND_TYPES = [pa.int32()] + [pa.int64()] * 4


def _found(kind: int, docs, n, d1=None, d2=None) -> pa.RecordBatch:
    none = pa.nulls(len(docs), pa.int64())
    columns = [pa.array(np.full(len(docs), kind, dtype=np.int32)), docs, pa.array(n), none if d1 is None else pa.array(d1), none if d2 is None else pa.array(d2)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _FOUND.split(", ")])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets as rows; and, per document, how many of its hashes in this bucket another document has, too."""
    owners, docs, prints, known = [], [], [], 0
    for batch in batches:
        for kind, width, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "width", "blob"))):
            if kind == _SETS:
                sets = np.frombuffer(blob, dtype=SET)
                ids = pa.array(sets["doc"], mask=sets["known"] == 0)
                yield _found(_SETS, ids, sets["n"], sets["d1"].view(np.int64), sets["d2"].view(np.int64))
            else:
                half = (len(blob) - 8 * width) // 2
                docs.append(np.frombuffer(blob, dtype=np.int64, count=width))
                owners.append(np.frombuffer(blob, dtype=np.uint32, offset=8 * width, count=half // 4).astype(np.int64) + known)
                prints.append(np.frombuffer(blob, dtype=np.uint32, offset=8 * width + half))
                known += width
    if docs:
        doc, owner, print_ = np.concatenate(docs), np.concatenate(owners), np.concatenate(prints)
        order = np.argsort(print_, kind="stable")
        owner, print_ = owner[order], print_[order]
        first, last = _edges(print_)
        ids = doc[owner]
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        hits = np.bincount(owner[np.repeat(several, last - first)], minlength=len(doc))
        some = hits > 0
        yield _found(_HITS, pa.array(doc[some]), hits[some].astype(np.int64))


@cache
def _bounds() -> list[int]:
    """First size of every size class."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


@cache
def _slices(size_class: int, num: int, den: int) -> tuple[int, int, np.ndarray] | None:
    """Slices, parts per slice and inner borders of the parts; None if only equal sets can link in this class."""
    largest = _bounds()[size_class + 1] - 1
    apart = 2 * largest * (den - num) // (den + num)
    if not apart:
        return None
    # High thresholds: some slice is equal. Lower ones: some slice differs by one hash at most, so two of its three parts are equal.
    parts = 1 if 100 * num >= 85 * den else 3
    slices = apart + 1 if parts == 1 else apart // 2 + 1
    borders = [(i << 64) // (slices * parts) for i in range(1, slices * parts)]
    return slices, parts, np.array(borders, dtype=np.uint64)


def _classes(size: int, num: int, den: int) -> Iterator[int]:
    """The size class of a set, and those above that hold sets it can link to."""
    bounds = _bounds()
    own = int(np.searchsorted(bounds, size, "right")) - 1
    yield own
    while bounds[own + 1] * num <= size * den:
        own += 1
        yield own


def _map_bits(size_class: int) -> int:
    bits = LEAST_MAP
    while 3 * bits < 2 * _bounds()[size_class + 1] and bits < MOST_MAP:
        bits *= 2
    return bits


def bit_map(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=bool)
    out[(tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out)


def signatures(tokens: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per size class: the class, the signatures of its slices, and how many hashes each stands for."""
    spread = None
    for size_class in _classes(len(tokens), num, den):
        plan = _slices(size_class, num, den)
        if plan is None:
            continue
        slices, parts, borders = plan
        if spread is None:
            spread = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(tokens + np.uint64(1)))))
        cuts = np.concatenate(([0], np.searchsorted(tokens, borders), [len(tokens)]))
        sums = (spread[cuts[1:]] - spread[cuts[:-1]]).reshape(slices, parts)
        held = np.diff(cuts).reshape(slices, parts)
        if parts > 1:  # one part at a time is left out
            sums, held = sums.sum(axis=1, keepdims=True, dtype=np.uint64) - sums, held.sum(axis=1, keepdims=True) - held
        place = mixed(np.arange(sums.size, dtype=np.uint64) + np.uint64((size_class + 1) << 40))
        yield size_class, mixed(sums.ravel() + place), held.ravel()


class _Outgoing:
    """Signatures of a task, handed on as packed arrays by bucket."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.strong: list[tuple[np.ndarray, int]] = []
        self.feeble: dict[int, list[bytes]] = {}
        self.held = 0

    def add(self, doc: int, tokens: np.ndarray, num: int, den: int) -> None:
        for size_class, found, counts in signatures(tokens, num, den):
            weak = counts <= WEAK
            self.strong.append((found[~weak], doc))
            self.held += len(found)
            if weak.any():
                bits = bit_map(tokens, _map_bits(size_class))
                tail = np.array([doc, len(tokens)], dtype=np.int64).tobytes() + bits.tobytes()
                self.feeble.setdefault(len(bits), []).extend(s.tobytes() + tail for s in found[weak])
                self.held += int(weak.sum()) * len(tail) // 16

    def rows(self) -> list[tuple[int, int, int, bytes]]:
        out = []
        if self.strong:
            found = np.concatenate([s for s, _ in self.strong])
            docs = np.repeat(np.array([d for _, d in self.strong], dtype=np.int64), [len(s) for s, _ in self.strong])
            bucket = (found % self.buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            found, docs, bucket = found[order], docs[order], bucket[order]
            if len(bucket):
                out += [(_STRONG, int(bucket[a]), 0, found[a:b].tobytes() + docs[a:b].tobytes()) for a, b in zip(*_edges(bucket))]
        for width, items in self.feeble.items():
            by: dict[int, list[bytes]] = {}
            for item in items:
                by.setdefault(int.from_bytes(item[:8], "little") % int(self.buckets), []).append(item)
            out += [(_FEEBLE, b, width, b"".join(x)) for b, x in by.items()]
        self.strong, self.feeble, self.held = [], {}, 0
        return out


def _signed_sets(words: int, num: int, den: int, buckets: int):
    """The signatures of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Outgoing(buckets)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, offsets = raw_bytes(batch.column(1))
            for first, last in chunks(offsets):
                for doc, tokens in zip(ids[first:last], shingle_sets(raw, offsets[first : last + 1], words)):
                    out.add(doc, tokens, num, den)
                    if out.held > HANDED_ON:
                        yield _blobs(out.rows())
        yield _blobs(out.rows())

    return run


def _stars(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest document of every key with each other document of that key."""
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    first, last = _edges(keys)
    leader = np.repeat(np.minimum.reduceat(docs, first), last - first)
    other = leader != docs
    return leader[other], docs[other]


def group_by_maps(maps: np.ndarray, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """A group number per set: sets that a chain of pairs joins, each of which could link, share one.

    Of two sets that link, each misses so few hashes from the other as their sizes allow; it misses at least as many as
    its map has bits outside the other's. A set is compared with those that no group has yet.
    """
    order = np.argsort(sizes, kind="stable")
    words, sizes = np.ascontiguousarray(maps[order]).view(np.uint64), sizes[order]
    group = np.arange(len(words))
    left = group.copy()
    while len(left):
        reached, left = [int(left[0])], left[1:]
        home = reached[0]
        while reached and len(left):
            i = reached.pop()
            # Ascending sizes: those of which neither is too large for the other.
            a = int(np.searchsorted(den * sizes[left], num * sizes[i], "left"))
            b = int(np.searchsorted(num * sizes[left], den * sizes[i], "right"))
            near = left[a:b]
            missed = np.bitwise_count(words[i] & ~words[near]).sum(axis=1, dtype=np.int64)
            fits = (num + den) * missed <= den * sizes[i] - num * sizes[near]
            near = near[fits]
            missed = np.bitwise_count(words[near] & ~words[i]).sum(axis=1, dtype=np.int64)
            near = near[(num + den) * missed <= den * sizes[near] - num * sizes[i]]
            if len(near):
                group[near] = home
                reached += near.tolist()
                left = left[group[left] != home]
    out = np.empty_like(group)
    out[order] = group
    return out


def _candidates(num: int, den: int):
    """Candidate links from all signatures of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, feeble = [], {}
        for batch in batches:
            for kind, width, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "width", "blob"))):
                if kind == _STRONG:
                    half = len(blob) // 2
                    strong.append((np.frombuffer(blob[:half], dtype=np.uint64), np.frombuffer(blob[half:], dtype=np.int64)))
                else:
                    feeble.setdefault(width, []).append(blob)
        found = []
        if strong:
            found.append(_stars(np.concatenate([s for s, _ in strong]), np.concatenate([d for _, d in strong])))
        for width, blobs in feeble.items():
            table = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 24 + width)
            keys = np.ascontiguousarray(table[:, :8]).view(np.uint64).ravel()
            about = np.ascontiguousarray(table[:, 8:24]).view(np.int64)
            order = np.argsort(keys, kind="stable")
            for a, b in zip(*_edges(keys[order])):
                if b - a > 1:
                    rows = order[a:b]
                    groups = group_by_maps(table[rows, 24:], about[rows, 1], num, den)
                    found.append(_stars(groups, about[rows, 0]))
        if found:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def linked(sets: list[np.ndarray], num: int, den: int, group: int = GROUP, cells: int = CELLS) -> np.ndarray:
    """A label per set; sets that a chain of links joins share one.

    Sets are put into groups of `group` by their smallest hash, and the matrix of tokens by groups bounds the overlap of
    each set with the members of each group. Only groups that can reach the threshold are opened. The matrix is dense
    where it has few cells, else a list of groups per token; the labels are the same.
    """
    count = len(sets)
    labels = np.arange(count)
    if count < 2:
        return labels
    sizes = np.array([len(s) for s in sets])
    similar = np.lexsort((sizes, [int(s[0]) if len(s) else 0 for s in sets]))  # near copies mostly share the smallest hash
    sets, sizes = [sets[i] for i in similar], sizes[similar]
    universe, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    shared = np.bincount(token, minlength=len(universe)) > 1  # other hashes are in no overlap
    columns = int(shared.sum())
    matrix = _DenseMatrix if count * columns <= cells else _SparseMatrix
    found = matrix(token, shared, sizes, ends, group)
    order = np.lexsort((np.arange(count), sizes))
    order = order[sizes[order] > 0]
    group_of, firsts = np.arange(count) // group, np.arange(0, count, group)
    lowest, highest = np.minimum.reduceat(labels, firsts), np.maximum.reduceat(labels, firsts)
    for at in range(0, len(order), found.at_once):
        queries = order[at : at + found.at_once]
        # A group that is joined to the set as a whole has nothing to tell, whatever it holds.
        joined = (lowest == labels[queries, None]) & (highest == labels[queries, None])
        if joined.all():
            continue
        opened = ~joined & (den * found.bounds(queries) >= num * sizes[queries, None])
        if not opened.any():
            continue
        inside = np.flatnonzero(opened.any(axis=0)[group_of])
        both = found.overlaps(queries, inside)
        changed = False
        for q, groups, own in zip(queries, opened, both):
            other = groups[group_of[inside]] & (labels[inside] != labels[q]) & (sizes[inside] >= sizes[q])
            hit = inside[other & (den * own >= num * (sizes[q] + sizes[inside] - own))]
            if len(hit):
                labels[np.isin(labels, labels[hit])] = labels[q]
                changed = True
        if changed:
            lowest, highest = np.minimum.reduceat(labels, firsts), np.maximum.reduceat(labels, firsts)
    out = np.empty(count, dtype=labels.dtype)
    out[similar] = labels
    return out


class _DenseMatrix:
    """Tokens by groups, and tokens by sets, as numbers 0 and 1."""

    at_once = 64

    def __init__(self, token, shared, sizes, ends, group):
        column = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sizes)), sizes)
        kept = shared[token]
        self.sets = np.zeros((len(sizes), int(shared.sum())), dtype=np.float32)
        self.sets[row[kept], column[token[kept]]] = 1
        self.groups = np.maximum.reduceat(self.sets, np.arange(0, len(sizes), group), axis=0)

    def bounds(self, queries):
        return self.sets[queries] @ self.groups.T

    def overlaps(self, queries, inside):
        return self.sets[queries] @ (self.sets if len(inside) == len(self.sets) else self.sets[inside]).T


class _SparseMatrix:
    """The groups of every token, and the tokens of every set."""

    at_once = 1

    def __init__(self, token, shared, sizes, ends, group):
        self.token, self.ends, self.sizes = token, ends, sizes
        group_of = np.arange(len(sizes)) // group
        self.count = int(group_of[-1]) + 1
        cell = np.unique(token.astype(np.int64) * self.count + np.repeat(group_of, sizes))
        self.holders = cell % self.count
        self.at = np.searchsorted(cell // self.count, np.arange(len(shared) + 1))
        self.mark = np.zeros(len(shared), dtype=np.int64)

    def _own(self, q):
        return self.token[self.ends[q] : self.ends[q + 1]]

    def bounds(self, queries):
        own = self._own(queries[0])
        starts, lengths = self.at[own], self.at[own + 1] - self.at[own]
        index = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        return np.bincount(self.holders[index], minlength=self.count)[None, :]

    def overlaps(self, queries, inside):
        if not len(inside):
            return np.zeros((1, 0), dtype=np.int64)
        own, (a, b) = self._own(queries[0]), inside[[0, -1]]
        self.mark[own] = 1
        running = np.concatenate(([0], np.cumsum(self.mark[self.token[self.ends[a] : self.ends[b + 1]]])))
        self.mark[own] = 0
        return np.diff(running[self.ends[a : b + 2] - self.ends[a]])[None, inside - a]


def _open(words: int, num: int, den: int):
    """Exact links inside each (component, block, block); rows arrive sorted by these."""

    def close(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = _stars(linked(sets, num, den), np.array(ids, dtype=np.int64))
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j"))))
            docs = batch.column("doc_id").to_pylist()
            raw, offsets = raw_bytes(batch.column("text"))
            for first, last in chunks(offsets):
                found = shingle_sets(raw, offsets[first : last + 1], words)
                for key, doc, tokens in zip(keys[first:last], docs[first:last], found):
                    if key != now:
                        if len(ids) > 1:
                            yield close(ids, sets)
                        now, ids, sets = key, [], []
                    ids.append(doc)
                    sets.append(tokens)
        if len(ids) > 1:
            yield close(ids, sets)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, open_hashes: int = OPEN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs` (doc_id, text).

    Two documents link if den * intersection >= num * union of their shingle sets; the component is the smallest
    doc_id that links reach. Documents without words have no shingles and link with nothing, themselves apart. Rows
    that share a doc_id are one node. Rows without a doc_id get no component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = plain.mapInArrow(_smallest(words, num, den, buckets), _BLOBS).repartition(buckets, "bucket")
    table = written(sent.mapInArrow(_repeated, _FOUND), "shingle-sets")
    sets = table.filter(f"kind = {_SETS}").select("doc_id", "n", "d1", "d2")
    filled = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # Written first, so that the join is one that Spark splits where very many sets are equal.
    classes = written(filled.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "set-classes")
    stands_for = written(filled.join(classes, ["n", "d1", "d2"]).select("doc_id", "rep", "n"), "stands-for")

    hits = table.filter(f"kind = {_HITS}").groupBy("doc_id").agg(F.sum("n").alias("hits"))
    partner = F.ceil(F.col("n") * num / den).cast("long")  # the size of the smallest set that can link
    enough = F.greatest(F.lit(1), F.least(F.floor(partner * (den - num) / den), F.ceil(partner * num / den)))
    asked = stands_for.join(hits, "doc_id").filter(F.col("hits") >= enough).select(F.col("rep").alias("doc_id")).distinct()
    texts = written(plain.join(asked, "doc_id"), "texts-in-question")

    signed = texts.mapInArrow(_signed_sets(words, num, den, buckets), _BLOBS).repartition(buckets, "bucket")
    pairs = written(signed.mapInArrow(_candidates(num, den), "a long, b long").distinct(), "candidates")
    near = written(components(pairs), "candidate-components")

    members = near.join(stands_for.filter("doc_id = rep").select(F.col("rep").alias("node"), "n").distinct(), "node")
    sums = members.groupBy("component").agg(F.sum("n").alias("hashes"))
    blocks = F.ceil(F.col("hashes") / open_hashes).cast("int")
    dealt = members.join(sums, "component").select("node", "component", blocks.alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: other != F.col("block")),
            lambda other: F.struct(F.least("block", other).alias("i"), F.greatest("block", other).alias("j")),
        )
    )
    tasks = written(dealt.withColumn("block", block).select(F.col("node").alias("doc_id"), "component", F.explode(each).alias("_t")).select("doc_id", "component", "_t.*"), "openings")
    opened = texts.join(tasks, "doc_id").repartition(buckets, "component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id")
    links = written(opened.mapInArrow(_open(words, num, den), "a long, b long"), "links-found")
    own = components(links)
    # A document that several rows of different texts share is one node: its classes join.
    shared = stands_for.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high")
    if shared.limit(1).count():
        ties = stands_for.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        own = components(links.unionByName(ties))
    final = stands_for.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(own.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = final.select("doc_id", F.coalesce("component", "rep").alias("_component"))
    return sets.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs` without those whose component has a document with a smaller id."""
    found = near_duplicates(docs, words, num, den)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))
