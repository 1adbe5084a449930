"""Pack tokenised documents into sequences of a fixed length, into as few as can be.

Pieces are counted by length, so that the packing problem that the driver solves has at most one entry per length,
however many documents there are. Bin completion takes the largest length left, enumerates the fillings of the room
beside it that no piece left would fit into, and repeats the chosen filling as often as the counts allow, or less often.
The search backtracks over fillings, prunes by the waste that the best solution so far allows, and starts from best fit. Documents then take their places
by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyworth.llm.common import written
from tallyworth.operators.row_index import add_row_index

LENGTH = 1024
END = 2
VOCABULARY = "byte_bpe_50k.json"
# Words whose ids a worker remembers; and the search steps after which the best packing so far is taken.
REMEMBERED = 150_000
MOST_STEPS = 20_000

# The pre-tokeniser of the vocabulary, for texts of ASCII and Latin letters; other texts go to the tokenizer whole.
_PLAIN = re.compile("[^\\x00-\\x1b\\x20-\\x7e\\xa1-\\u024f]")
_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_S = "\\x09-\\x0d\\x20"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def _bytes_of_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@cache
def _whole(path: str):
    """The tokenizer itself, for the few texts that the merges of single words do not cover."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _tokenizer(path: str):
    """The tokenizer's merges for single words, the words seen so far and the special tokens."""
    import tiktoken

    about = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in about["added_tokens"] if t["special"]}
    stand_ins = _bytes_of_characters()
    ranks = {bytes(stand_ins[c] for c in word): i for word, i in about["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), {}, special


def token_bytes(text: str, path: str) -> bytes:
    """The ids of a text as little-endian 32-bit numbers, without the closing id."""
    merges, known, special = _tokenizer(path)
    if _PLAIN.search(text) or any(s in text for s in special):
        return np.array(_whole(path).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    words = _WORD.findall(text)
    try:
        return b"".join([known[w] for w in words])
    except KeyError:
        out = []
    for word in words:
        ids = known.get(word)
        if ids is None:
            ids = array("I", merges.encode_ordinary(word)).tobytes()
            if len(known) < REMEMBERED:
                known[word] = ids
        out.append(ids)
    return b"".join(out)


def pieces_of(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """piece, start, length and checksum: only texts above `length` are cut, the first piece may be shorter."""
    total = len(ids) // 4
    first = total if total <= length else total % length or length
    starts = [0, *range(first, total, length)]
    ends = [*starts[1:], total]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(starts, ends))]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row; null text counts as empty."""
    closing = np.array([END], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                own = pieces_of((token_bytes(text, path) if text else b"") + closing, length)
                ids += [doc] * len(own)
                found += own
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(columns[0], type=pa.int32()), *(pa.array(c, type=pa.int64()) for c in columns[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fillings(room: int, counts: dict[int, int], slack: int, after: tuple[int, ...] | None = None) -> Iterator[tuple[int, ...]]:
    """All ways to fill `room` up to a gap of at most `slack` from the counted sizes, the least gap first.

    Sizes may repeat as often as they are counted, in fillings of any number of sizes. Equal gaps come with larger
    sizes first. With `after`, a filling, only those that follow it come. The sums that the sizes from each one down
    can make are held as bits, so that the search runs into no dead ends but those on the way to `after`.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    if after is None and room in counts and sizes and sizes[0] == room:
        yield (room,)
        after = (room,)
    mask = (1 << room + 1) - 1
    sums = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        reached, left, part = sums[i + 1], min(counts[sizes[i]], room // sizes[i]), 1
        while left:
            part = min(part, left)
            reached |= reached << part * sizes[i] & mask
            left, part = left - part, part * 2
        sums[i] = reached

    def exact(target: int, after: tuple[int, ...] | None) -> Iterator[tuple[int, ...]]:
        """The fillings of just `target`, in falling order."""
        held = Counter(after or ())
        # so long as the choices are those of `after`, no more of a size may be taken than it holds
        bound_to = 0 if after is None else next((i for i, s in enumerate(sizes) if any(x > s and not counts.get(x) for x in held)), len(sizes))
        tight = after is not None
        taken: list[tuple[int, int]] = []
        i, rest = 0, target
        while True:
            while rest and i < len(sizes):
                size = sizes[i]
                tight = tight and i < bound_to
                if size <= rest:
                    most = min(counts[size], rest // size, held[size] if tight else rest)
                    often = next((k for k in range(most, -1, -1) if sums[i + 1] >> rest - k * size & 1), -1)
                    if often < 0:
                        break
                    if often:
                        taken.append((i, often))
                        rest -= often * size
                    tight = tight and often == held[size]
                elif held[size]:
                    tight = False
                i += 1
            if not rest:
                filling = tuple(sizes[k] for k, often in taken for _ in range(often))
                if filling != after:
                    yield filling
            tight = False
            while taken:
                i, often = taken.pop()
                rest += often * sizes[i]
                fewer = next((k for k in range(often - 1, -1, -1) if sums[i + 1] >> rest - k * sizes[i] & 1), -1)
                if fewer >= 0:
                    if fewer:
                        taken.append((i, fewer))
                        rest -= fewer * sizes[i]
                    i += 1
                    break
            else:
                return

    start = 0 if after is None else room - sum(after)
    for gap in range(start, min(slack, room) + 1):
        if sums[0] >> room - gap & 1:
            yield from exact(room - gap, after if gap == start else None)


def best_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counted lengths: (filling, times). The first incumbent.

    Each piece, from the largest down, goes to the fullest sequence that has room for it. Sequences that are filled
    alike are counted together.
    """
    # by room left: the fillings that leave it, with how often
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if times:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((filling, times))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                room, filling, times = length, (), left
            else:
                room = rooms[at]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            # the sequence just added to is the fullest one, until it has no room for this size
            each = min(room // size, left)
            used = min(times, left // each)
            put(room - each * size, filling + (size,) * each, used)
            if filling:
                put(room, filling, times - used)
            left -= used * each
    return [entry for room in rooms for entry in open_[room]]


def lower_bound(counts: dict[int, int], length: int = LENGTH) -> int:
    """No packing has fewer sequences: sizes above half never share one, and small sizes only fill what these leave."""
    n, total = np.zeros(length + 1, dtype=np.int64), sum(s * k for s, k in counts.items())
    for size, k in counts.items():
        n[size] = k
    sizes, half = np.arange(length + 1), length // 2
    best = -(-total // length)
    for k in range(1, half + 1):
        alone, beside, small = n[length - k + 1 :].sum(), slice(half + 1, length - k + 1), slice(k, half + 1)
        room = (n[beside] * (length - sizes[beside])).sum()
        best = max(best, int(alone + n[beside].sum() + max(0, -(-((n[small] * sizes[small]).sum() - room) // length))))
    return best


def pack_counts(counts: dict[int, int], length: int = LENGTH, steps: int = MOST_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with how often each is used; together they hold every counted length.

    Depth-first over fillings of the largest length left, each as often as it can be and then less often. Fillings of
    the same length follow each other in the order of `fillings`, so that no set of them is met twice. A branch ends
    when its waste exceeds what a better solution than the incumbent allows, or when a piece left would fit its gap.
    The search ends at the lower bound or after `steps` branches.
    """
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    total = sum(s * n for s, n in counts.items())
    least = lower_bound(counts, length)
    incumbent = best_fit(counts, length)
    fewest = sum(n for _, n in incumbent)
    if fewest == least:
        return incumbent
    left, chosen, wasted, done = dict(counts), [], 0, 0

    def options(largest: int) -> Iterator[tuple[tuple[int, ...], int]]:
        beside = {s: n for s, n in left.items() if n}
        beside[largest] -= 1
        after = chosen[-1][0][1:] if chosen and chosen[-1][0][0] == largest else None
        for filling in fillings(length - largest, beside, (fewest - 1) * length - total - wasted, after):
            whole = Counter((largest, *filling))
            for times in range(min(left[s] // k for s, k in whole.items()), 0, -1):
                yield (largest, *filling), times

    def apply(filling: tuple[int, ...], times: int, sign: int) -> None:
        nonlocal wasted
        for s in filling:
            left[s] -= sign * times
        wasted += sign * times * (length - sum(filling))

    # per level: the fillings that are still to be tried
    stack = [options(max(counts))]
    while stack and done < steps:
        done += 1
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if chosen:
                apply(*chosen.pop(), -1)
            continue
        filling, times = option
        apply(filling, times, 1)
        chosen.append(option)
        if not any(left.values()):
            used = sum(n for _, n in chosen)
            if used < fewest:
                incumbent, fewest = list(chosen), used
                if fewest == least:
                    break
        elif wasted <= (fewest - 1) * length - total and min(s for s, n in left.items() if n) > length - sum(filling):
            stack.append(options(max(s for s, n in left.items() if n)))
            continue
        apply(*chosen.pop(), -1)
    return incumbent


def _slots(solution: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per place of a filling: length, first rank, number of ranks, first sequence, ranks per sequence, offset.

    A place (filling, size) that holds a size k times gives k rows; rank r of a row sits in sequence first + r - first rank.
    """
    out, used, sequence = [], {}, 0
    for filling, times in solution:
        for size, offset in zip(filling, accumulate((0, *filling))):
            start = used.get(size, 0)
            out.append((size, start, start + times, sequence, offset))
            used[size] = start + times
        sequence += times
    return out


def packed(found: DataFrame, length: int = LENGTH, steps: int = MOST_STEPS) -> DataFrame:
    """The pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Full pieces are sequences of their own. Every sequence is filled without gaps from 0. Pieces of equal length
    change places freely; repeated rows are packed each. No pieces give no sequences.
    """
    spark = found.sparkSession
    numbered = written(add_row_index(found, "length", "doc_id", "piece", name="_at"), "packing-order")
    sizes = {r["length"]: (r["n"], r["first"]) for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect()}
    solution = pack_counts({s: n for s, (n, _) in sizes.items()}, length, steps)
    slots = _slots(solution)
    places = [(size, sizes[size][1] + a, sizes[size][1] + b, sequence, offset) for size, a, b, sequence, offset in slots]
    # One row per place of a filling: their number depends on the lengths, not on the documents.
    table = spark.createDataFrame(places, "_size long, _from long, _to long, _sequence long, offset long")
    there = (numbered["length"] == table["_size"]) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    joined = numbered.join(F.broadcast(table), there)
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_at") - F.col("_from")).alias("sequence_id"), "offset"
    )


def pack(docs: DataFrame, path: str, length: int = LENGTH, steps: int = MOST_STEPS) -> DataFrame:
    """Every row of `docs` (doc_id, text) tokenised, cut and packed. Rows without text hold only the closing id."""
    return packed(written(pieces(docs, path, length), "pieces"), length, steps)
