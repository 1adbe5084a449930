"""Remove passages that were already there: every byte covered by a string of LENGTH bytes that also starts earlier.

1. Anchors. Of the grams in every window of LENGTH bytes the one with the smallest hash is the window's anchor, so equal
   windows have equal anchors at equal places. Windows with the same anchor form one context; a text has a context
   for about every 35 bytes. Contexts travel as hashes, in packed arrays.
2. Equal contexts. Of several equal contexts all but the first are covered. In each task this is settled before the
   shuffle, so that a text that is there a million times sends no more rows than there are tasks.
3. Suffixes. Anchors that stand in different contexts, and only these, are read again from the texts. The suffixes that
   start in their windows are sorted (by doubling ranks), equal ones by position. In that order the previous and next smaller
   positions of a suffix give its longest previous factor: it reaches LENGTH exactly if the neighbour before it is
   equal, as that neighbour then starts earlier. Such windows are covered; the first of each run stays.
4. The covered ranges of each document are merged and cut out.

An anchor in more than HOT different contexts (the border of a passage in very many texts) is split by its windows, so
that its suffixes spread over all tasks; such windows travel, like contexts, as two hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworth.llm.common import shuffle_partitions, written
from tallyworth.llm.shingles import chunks, mixed, powers, raw_bytes

LENGTH, GRAM = 100, 32
HOT = 4096
# Contexts that a task hands on, or sorts, at once.
HANDED_ON, SORTED = 400_000, 16_000

_RANDOM = np.random.default_rng(31337)
_VALUES = [_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_LOW = np.uint64(0xFFFFFFFF)

ANCHOR = np.dtype([("key", "<u8"), ("same", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("span", "<u2")])
CUT = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("doc", "<i8"), ("key", "<u8"), ("at", "<u4"), ("span", "<u2"), ("hot", "u1")])

_ANCHORS, _CUTS, _ASKS, _CONTEXTS = 0, 1, 2, 3
_BLOBS = "kind int, bucket int, blob binary"


def context_type(length: int) -> np.dtype:
    return np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("span", "<u2"), ("text", "u1", (2 * length - GRAM,))])


def smallest_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbouring values."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(raw: np.ndarray, offsets: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The contexts of the texts of a chunk; windows never cross texts."""
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]
    n = len(raw)
    filled = np.diff(offsets) >= length
    if not filled.any():
        return np.zeros(0, dtype=ANCHOR)
    up, down = powers(n + 1)
    sums = np.zeros((2, n + 1), dtype=np.uint64)
    for total, values in zip(sums, _VALUES):
        np.cumsum(values[raw] * up[:n], out=total[1:])
    grams = n - GRAM + 1
    gram = mixed((sums[0, GRAM:] - sums[0, :grams]) * down[:grams])
    # Half a hash, then the place from the right: of equal hashes in a window the last one is the smallest value.
    ranked = (gram & ~_LOW) | (_LOW - np.arange(grams, dtype=np.uint64))
    chosen = (_LOW - (smallest_ahead(ranked, length - GRAM + 1) & _LOW)).astype(np.int64)
    change = np.zeros(n - length + 2, dtype=np.int32)
    np.add.at(change, offsets[:-1][filled], 1)
    np.add.at(change, offsets[1:][filled] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:-1]) > 0)
    anchor = chosen[start]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    low, high = start[first], start[np.append(first[1:] - 1, len(start) - 1)]
    place = anchor[first]
    shape = mixed(((place - low).astype(np.uint64) << np.uint64(32)) | (high - low).astype(np.uint64))
    out = np.zeros(len(first), dtype=ANCHOR)
    row = np.searchsorted(offsets, low, "right") - 1
    out["key"] = gram[place]
    out["same"] = mixed((sums[1, high + length] - sums[1, low]) * down[low] + shape)
    out["doc"], out["at"], out["span"] = docs[row], low - offsets[row], high - low
    return out


def split_copies(found: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first context of every class of equal ones, by key; and the ranges that the others cover."""
    order = np.lexsort((found["at"], found["doc"], found["same"], found["key"]))
    found = found[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found["key"][1:] != found["key"][:-1]) | (found["same"][1:] != found["same"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    # A row that repeats a doc_id is the same document, not a later one.
    later = (found["doc"] != found["doc"][head]) | (found["at"] != found["at"][head])
    return found[new], cuts_of(found[later], length)


def cuts_of(contexts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(contexts), dtype=CUT)
    out["doc"], out["start"] = contexts["doc"], contexts["at"]
    out["end"] = contexts["at"] + contexts["span"] + np.uint32(length)
    return out


def merged(cuts: np.ndarray) -> np.ndarray:
    """Overlapping and touching ranges of a document as one, in order."""
    if not len(cuts):
        return cuts
    cuts = cuts[np.lexsort((cuts["start"], cuts["doc"]))]
    rank = np.cumsum(np.concatenate(([0], cuts["doc"][1:] != cuts["doc"][:-1]))).astype(np.int64) << 33
    end = np.maximum.accumulate(rank + cuts["end"])
    new = np.concatenate(([True], rank[1:] + cuts["start"][1:] > end[:-1]))
    first = np.flatnonzero(new)
    out = cuts[first]
    out["end"] = (end - rank)[np.append(first[1:] - 1, len(cuts) - 1)]
    return out


def suffix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the first `length` bytes at every place of the text by doubling; places near the end mean nothing."""
    width, rank = 8, np.zeros(len(text) - 7, dtype=np.uint64)
    for i in range(8):
        rank = (rank << np.uint64(8)) | text[i : len(text) - 7 + i].astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while width < length:
        step = min(width, length - width)
        pair = (rank[: len(rank) - step] << np.uint64(32)) | rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        width += step
    return rank


def with_equals(contexts: np.ndarray, length: int) -> np.ndarray:
    """The contexts but for those of which every window has a hash of its own: a window without its equal needs no rank."""
    text, windows = contexts["text"], contexts["text"].shape[1] - length + 1
    up, down = powers(text.shape[1])
    sums = np.zeros((len(contexts), text.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_VALUES[0][text] * up, axis=1, out=sums[:, 1:])
    inside = np.arange(windows) <= contexts["span"][:, None]
    owner = np.nonzero(inside)[0]
    hashes = mixed(((sums[:, length:] - sums[:, :windows]) * down[:windows])[inside])
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    several = np.zeros(len(contexts), dtype=bool)
    several[owner[order[1:][equal]]] = several[owner[order[:-1][equal]]] = True
    return contexts[several]


def covered_windows(contexts: np.ndarray, length: int) -> np.ndarray:
    """Ranges of the windows of the contexts whose longest previous factor reaches `length`."""
    if len(contexts) > 1:
        contexts = with_equals(contexts, length)
    if len(contexts) < 2:
        return np.zeros(0, dtype=CUT)
    size = contexts["text"].shape[1]
    rank = suffix_ranks(np.concatenate((contexts["text"].ravel(), np.zeros(length, dtype=np.uint8))), length)
    spans = contexts["span"].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(contexts)), spans)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(spans) - spans, spans)
    suffix = rank[owner * size + inside]
    doc, at = contexts["doc"][owner], contexts["at"][owner] + inside.astype(np.uint32)
    order = np.lexsort((at, doc, suffix))  # the suffix array of the windows, equal suffixes by position
    sorted_rank = suffix[order]
    new = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    # The previous smaller position of all but the first of a run is in the run: their factor reaches the length.
    later = (doc[order] != doc[head]) | (at[order] != at[head])
    hit = np.sort(order[later])
    out = np.zeros(len(hit), dtype=CUT)
    out["doc"], out["start"], out["end"] = doc[hit], at[hit], at[hit] + np.uint32(length)
    return merged(out)


def _dealt(kind: int, items: np.ndarray, by: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """The items as packed arrays by bucket."""
    if not len(items):
        return []
    bucket = (mixed(by.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    items, bucket = items[order], bucket[order]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(kind, int(bucket[a]), items[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(items)])]


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], ["kind", "bucket", "blob"])


def _gathered(batches: Iterator[pa.RecordBatch], types: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    blobs: dict[int, list[bytes]] = {kind: [] for kind in types}
    for batch in batches:
        for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist()):
            blobs[kind].append(blob)
    return {kind: np.frombuffer(b"".join(x), dtype=types[kind]) for kind, x in blobs.items()}


def _find_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def hand_on() -> pa.RecordBatch:
            firsts, cuts = split_copies(np.concatenate(held), length)
            cuts = merged(cuts)
            return _batch(_dealt(_ANCHORS, firsts, firsts["key"], buckets) + _dealt(_CUTS, cuts, cuts["doc"], buckets))

        for batch in batches:
            docs = np.array(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            raw, offsets = raw_bytes(batch.column(1))
            for first, last in chunks(offsets):
                own = anchors(raw, offsets[first : last + 1], docs[first:last], length)
                held.append(own)
                size += len(own)
                if size > HANDED_ON:
                    yield hand_on()
                    held, size = [], 0
        if size:
            yield hand_on()

    return run


def _settle(length: int, buckets: int, hot: int):
    """Equal contexts of all tasks; what is left to read again goes to the bucket of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, {_ANCHORS: ANCHOR, _CUTS: CUT})
        firsts, cuts = split_copies(found[_ANCHORS], length)
        cuts = merged(np.concatenate((cuts, found[_CUTS])))
        if len(cuts):
            yield _batch(_dealt(_CUTS, cuts, cuts["doc"], buckets))
        if len(firsts):
            first = np.flatnonzero(np.concatenate(([True], firsts["key"][1:] != firsts["key"][:-1])))
            count = np.diff(np.append(first, len(firsts)))
            count = np.repeat(count, count)
            open_ = firsts[count > 1]
            asks = np.zeros(len(open_), dtype=ASK)
            for name in ("doc", "key", "at", "span"):
                asks[name] = open_[name]
            asks["hot"] = count[count > 1] > hot
            if len(asks):
                yield _batch(_dealt(_ASKS, asks, asks["doc"], buckets))

    return run


_PER_DOC = "doc_id long, cuts binary, asks binary"


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged ranges and questions of each document of a bucket."""
    found = _gathered(batches, {_CUTS: CUT, _ASKS: ASK})
    cuts, asks = merged(found[_CUTS]), found[_ASKS][np.argsort(found[_ASKS]["doc"], kind="stable")]
    docs = np.union1d(cuts["doc"], asks["doc"])
    slices = []
    for items in (cuts, asks):
        a, b = np.searchsorted(items["doc"], docs, "left"), np.searchsorted(items["doc"], docs, "right")
        slices.append([items[i:j].tobytes() if j > i else None for i, j in zip(a, b)])
    yield pa.RecordBatch.from_arrays(
        [pa.array(docs, type=pa.int64()), pa.array(slices[0], type=pa.binary()), pa.array(slices[1], type=pa.binary())], ["doc_id", "cuts", "asks"]
    )


def _read_contexts(length: int, buckets: int):
    """The contexts that are asked for, with their bytes; hot ones window by window, as hashes."""
    kind = context_type(length)
    room = 2 * length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, windows, size = [], [], 0

        def hand_on() -> pa.RecordBatch:
            rows = []
            if plain:
                all_ = np.concatenate(plain)
                rows += _dealt(_CONTEXTS, all_, all_["key"], buckets)
            if windows:
                # Copies of a window within the task are settled here.
                firsts, cuts = split_copies(np.concatenate(windows), length)
                cuts = merged(cuts)
                rows += _dealt(_ANCHORS, firsts, firsts["key"], buckets) + _dealt(_CUTS, cuts, cuts["doc"], buckets)
            return _batch(rows)

        for batch in batches:
            raw, offsets = raw_bytes(batch.column("text"))
            for i, (doc, blob) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("asks").to_pylist())):
                text = np.concatenate((raw[offsets[i] : offsets[i + 1]], np.zeros(room, dtype=np.uint8)))
                asks = np.frombuffer(blob, dtype=ASK)
                asks = asks[asks["at"].astype(np.int64) + asks["span"] + length <= offsets[i + 1] - offsets[i]]
                own, hot = asks[asks["hot"] == 0], asks[asks["hot"] == 1]
                if len(own):
                    at, span = own["at"].astype(np.int64), own["span"].astype(np.int64)
                    out = np.zeros(len(at), dtype=kind)
                    inside = np.arange(room)
                    content = text[at[:, None] + inside]
                    content[inside >= (span + length)[:, None]] = 0
                    out["doc"], out["at"], out["span"], out["text"], out["key"] = doc, at, span, content, own["key"]
                    plain.append(out)
                    size += out.nbytes
                if len(hot):
                    windows.append(_windows(text, doc, hot, length))
                    size += windows[-1].nbytes
                if size > HANDED_ON // 8 * kind.itemsize:
                    yield hand_on()
                    plain, windows, size = [], [], 0
        if size:
            yield hand_on()

    return run


def _windows(text: np.ndarray, doc: int, asks: np.ndarray, length: int) -> np.ndarray:
    """Every window of the contexts of a text as one of no span, known by two hashes of its bytes."""
    count = asks["span"].astype(np.int64) + 1
    at = np.repeat(asks["at"].astype(np.int64), count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first, last = int(at.min()), int(at.max()) + length
    up, down = powers(last - first)
    out = np.zeros(len(at), dtype=ANCHOR)
    for name, values in zip(("key", "same"), _VALUES):
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(values[text[first:last]] * up, out=sums[1:])
        out[name] = mixed((sums[at + length - first] - sums[at - first]) * down[at - first])
    out["doc"], out["at"] = doc, at
    return out


def _sort_suffixes(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, {_CONTEXTS: context_type(length), _ANCHORS: ANCHOR, _CUTS: CUT})
        cuts = [found[_CUTS], split_copies(found[_ANCHORS], length)[1]]
        contexts = found[_CONTEXTS]
        order = np.argsort(contexts["key"], kind="stable")
        keys = contexts["key"][order]
        at = 0
        while at < len(keys):  # whole keys only: equal windows have equal anchors
            end = int(np.searchsorted(keys, keys[min(at + SORTED, len(keys)) - 1], "right"))
            cuts.append(covered_windows(contexts[order[at:end]], length))
            at = end
        all_ = merged(np.concatenate(cuts))
        if len(all_):
            yield _batch(_dealt(_CUTS, all_, all_["doc"], buckets))

    return run


def _ranges(blobs: list[bytes | None], n: int) -> np.ndarray:
    """Merged ranges within a text of n bytes."""
    cuts = np.frombuffer(b"".join(b for b in blobs if b), dtype=CUT)
    cuts = cuts[cuts["start"] < n].copy()
    cuts["doc"] = 0
    cuts["end"] = np.minimum(cuts["end"], n)
    return merged(cuts)


_LEFT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut_out(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = raw_bytes(batch.column("text"))
            out = []
            for i, blobs in enumerate(zip(batch.column("cuts").to_pylist(), batch.column("more").to_pylist())):
                own = raw[offsets[i] : offsets[i + 1]]
                cuts = _ranges(list(blobs), len(own))
                starts, ends = [0, *cuts["end"].tolist()], [*cuts["start"].tolist(), len(own)]
                kept = b"".join(own[a:b].tobytes() for a, b in zip(starts, ends))
                out.append((len(own), len(own) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(c, type=k) for c, k in zip(zip(*out), (pa.int64(),) * 3 + (pa.string(), pa.binary()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_bytes else 5]
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns][: len(names)], names)

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes left) per row of `docs` (doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts earlier: in a document with a smaller id, or
    earlier in the same one. Strings are those of the input and never cross documents. Null counts as empty. Rows that repeat a doc_id
    are the same document; a row without doc_id is left as it is. Kept bytes may end inside a character. An empty table
    gives an empty result.
    """
    if not GRAM < length <= GRAM + 60_000:
        raise ValueError(f"the length must be above {GRAM}")
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known = plain.filter("doc_id IS NOT NULL")
    found = known.mapInArrow(_find_anchors(length, buckets), _BLOBS).repartition(buckets, "bucket")
    settled = written(found.mapInArrow(_settle(length, buckets, hot), _BLOBS), "contexts-settled")
    per_doc = written(settled.repartition(buckets, "bucket").mapInArrow(_by_document, _PER_DOC), "documents-settled")

    asked = known.join(per_doc.filter("asks IS NOT NULL").select("doc_id", "asks"), "doc_id")
    contexts = asked.mapInArrow(_read_contexts(length, buckets), _BLOBS).repartition(buckets, "bucket")
    sorted_ = written(contexts.mapInArrow(_sort_suffixes(length, buckets), _BLOBS), "suffixes-settled")
    more = written(sorted_.repartition(buckets, "bucket").mapInArrow(_by_document, _PER_DOC), "suffix-cuts")

    both = per_doc.filter("cuts IS NOT NULL").select("doc_id", "cuts").join(
        more.select("doc_id", F.col("cuts").alias("more")), "doc_id", "full"
    )
    schema = _LEFT + (", kept binary" if with_bytes else "")
    return plain.join(both, "doc_id", "left").mapInArrow(_cut_out(with_bytes), schema)
