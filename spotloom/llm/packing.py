"""Packing documents into training sequences: a configuration linear program over the length histogram.

1. Documents become token ids with an end id; longer ones than a sequence are cut, the first piece taking the odd rest.
2. The lengths' histogram, of at most `capacity` numbers, comes to the driver. A configuration is a multiset of
   lengths that fits in a sequence. The linear program (cover all pieces by the fewest configurations) is solved by
   multiplicative weights: each length's price falls as it is covered, and a knapsack dynamic program finds the
   configurations of highest price, which are then used some more.
3. Uses are rounded up, and configurations are trimmed of lengths that have run out; the room this leaves is filled by
   an exact knapsack over the pieces left. At last the emptiest sequences, with at most one piece in ten, are packed
   anew by best fit where that saves sequences.
4. Pieces are numbered within their length (counts by task first, so that a length with very many pieces is never
   in one task), and a piece's number says its sequence and its place.

Defined cases: a null or empty text is the end id alone; rows are packed one by one, so repeated ids repeat pieces; an
empty table gives no rows; texts of any length are encoded whole. Ids are those of `tokenizers` at its defaults, so added
tokens of the file found in a text have their own ids. Byte-level files whose ids follow their merges are read into a faster
engine; any other file is left to the library. Which of equally long pieces goes where is set by task and row, and says nothing.
Other columns of the input, also ones that differ from the wanted only in case, do no
harm.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotloom.llm import frames

#: Lengths in ascending order, each with how often it is used.
Configuration = tuple[tuple[int, int], ...]
#: How fast prices fall with coverage, what share of a length one step may use, how far a length may be covered ahead of
#: the rest, how near to the dearest a configuration must be, steps of the program, and how often it is solved.
ETA, STEP, AHEAD, NEAR, STEPS, ROUNDS = 4.0, 0.1, 0.25, 0.03, 100, 4
#: Configurations tried for a sequence whose pieces are not all left, and the share of pieces (one in so many) that may be
#: packed anew.
TRIES, MEND = 8, 10
#: Sequences that are packed anew a few at a time: of those that are, the emptiest; how many together, and how often.
SPARE, EMPTIEST, FEW, TIMES = 2000, 500, 12, 300


#: What pre-tokenizers of kind ByteLevel split a text by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _by_rank(spec: dict) -> bool:
    """Whether a tokenizers file means byte-level BPE by PATTERN whose ids are in the order of its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding"):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    if any(t[k] for t in spec.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    ids = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    return min(ids, default=0) >= 0 and all(a < b for a, b in zip(ids[:-1], ids[1:], strict=True))


def encoder(spec: dict) -> tiktoken.Encoding:
    """The byte-level BPE vocabulary of a tokenizers file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Texts up to this length can't hold a run of white space too long for the pattern's search, which steps back in it.
SAFE = 100_000
#: White space as the pattern has it; a run of two or more is one piece, but for its last character where text follows.
_RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class Encoder:
    """The ids that a tokenizers file gives a text with add_special_tokens=False."""

    def __init__(self, bpe: tiktoken.Encoding, added: dict[str, int]) -> None:
        self.bpe, self.added = bpe, added
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def _plain(self, text: str) -> list[np.ndarray]:
        out, at = [], 0
        if len(text) > SAFE:
            for m in _RUNS.finditer(text):
                end = m.end() if m.end() == len(text) else m.end() - 1
                out += [self.bpe.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(self.bpe._encode_single_piece(text[m.start() : end]), np.uint32)]
                at = end
        return [*out, self.bpe.encode_to_numpy(text[at:], disallowed_special=())]

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= SAFE and not any(t in text for t in self.added):
            return self.bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        out, at = [], 0
        for m in self.split.finditer(text) if self.split else ():
            out += [*self._plain(text[at : m.start()]), np.array([self.added[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, *self._plain(text[at:])]).astype("<u4")


class Slow:
    """The same by the tokenizers library itself, for files of any other kind."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def whole_encoder(path: str) -> Encoder | Slow:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return Encoder(encoder(spec), {t["content"]: t["id"] for t in spec.get("added_tokens", ())}) if _by_rank(spec) else Slow(path)


class Knapsack:
    """The dearest filling of every room up to capacity by pieces of given prices, any number of each."""

    def __init__(self, prices: np.ndarray, capacity: int) -> None:
        self.capacity, self.lengths = capacity, np.flatnonzero(prices > 0)
        value, lengths = prices[self.lengths], self.lengths
        self.best, self.last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
        for room, k in enumerate(np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()):
            if not room:
                continue
            self.best[room] = self.best[room - 1]
            if k:
                sums = value[:k] + self.best[room - lengths[:k]]
                at = k - 1 - int(sums[::-1].argmax())  # the longest of equals
                if sums[at] > self.best[room] + 1e-12:
                    self.best[room], self.last[room] = sums[at], lengths[at]
        #: The price of the dearest configuration with at least one piece of each length.
        self.worth = value + self.best[capacity - lengths]

    def configuration(self, length: int) -> Configuration:
        """The dearest configuration that holds a piece of a length."""
        out, room = {length: 1}, self.capacity - length
        while room > 0:
            if piece := int(self.last[room]):
                out[piece] = out.get(piece, 0) + 1
            room -= piece or 1
        return tuple(sorted(out.items()))


def configuration_program(counts: np.ndarray, capacity: int, seed: int = 0) -> dict[Configuration, float]:
    """Configurations and how often each is used: a fractional cover of all pieces by few sequences.

    A length's price falls as it is covered (multiplicative weights). In each step one knapsack program prices the
    configurations around every length; those within NEAR of the dearest are used some more, so that no length is
    covered by more than STEP of its pieces in a step. Lengths covered AHEAD of the rest cost nothing and are left out.
    """
    have = np.flatnonzero(counts)
    if not len(have):
        return {}
    n, size = counts[have], have * counts[have]
    slight = 1 + 1e-6 * np.random.default_rng(seed).random(len(have))
    covered, uses = np.zeros(capacity + 1), {}
    for _ in range(STEPS):
        share = covered[have] / n
        prices = np.zeros(capacity + 1)
        prices[have] = np.where(share > share @ size / size.sum() + AHEAD, 0.0, have / capacity * np.exp(-ETA * (share - share.min())) * slight)
        sack = Knapsack(prices, capacity)
        moved = np.zeros(capacity + 1)
        for i in np.argsort(-sack.worth, kind="stable").tolist():
            if sack.worth[i] < (1 - NEAR) * sack.worth.max():
                break
            c = sack.configuration(int(sack.lengths[i]))
            use = min((STEP * counts[x] - moved[x]) / times for x, times in c)
            if use > 0 and all(times <= counts[x] for x, times in c):
                uses[c] = uses.get(c, 0.0) + use
                for x, times in c:
                    moved[x] += use * times
        covered += moved
    scale = size.sum() / max(covered[have] @ have, 1e-12)
    return {c: x * scale for c, x in uses.items()}


def fullest(left: np.ndarray, room: int) -> dict[int, int]:
    """The fullest choice of the pieces left for a room; of the longest ones where several are as full."""
    lengths, reach, mask = np.flatnonzero(left[: room + 1]).tolist(), [1], (1 << room + 1) - 1
    for x in lengths:
        r, most, k = reach[-1], min(int(left[x]), room // x), 1
        while most > 0:
            k = min(k, most)
            r |= (r << x * k) & mask
            most, k = most - k, 2 * k
        reach.append(r)
    t, out = reach[-1].bit_length() - 1, {}
    for x, r in zip(reversed(lengths), reversed(reach[:-1]), strict=True):
        times = next(j for j in range(min(int(left[x]), t // x), -1, -1) if r >> (t - j * x) & 1)
        if times:
            out[x], t = times, t - times * x
    return out


def rounded(uses: dict[Configuration, float], counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and multiplicities that use up counts exactly: the program's uses, rounded up and trimmed.

    Sequences are taken by their longest piece, longest first. Configurations whose pieces are all left are used as they
    are, up to their rounded use. Then each goes on without the pieces that have run out, whose room gets the fullest
    choice of pieces left.
    """
    left, out = counts.astype(np.int64).copy(), []
    total = lambda c: sum(x * times for x, times in c)
    by_longest: dict[int, list[Configuration]] = {}
    for c in sorted(uses, key=lambda c: (-total(c), sum(times for _, times in c), -uses[c], c)):
        by_longest.setdefault(c[-1][0], []).append(c)
    for longest in np.flatnonzero(left)[::-1].tolist():
        own = by_longest.get(longest, [])
        for c in own:
            m = min(math.ceil(uses[c]), *(int(left[x]) // times for x, times in c)) if total(c) == capacity else 0
            if m > 0:
                out.append((dict(c), m))
                for x, times in c:
                    left[x] -= times * m
        while left[longest]:
            best = None
            for c in own[:TRIES] or [((longest, 1),)]:
                held = {x: k for x, times in c if (k := min(times, int(left[x])))}
                for x, k in held.items():
                    left[x] -= k
                room = capacity - total(held.items())
                more = fullest(left, room)
                for x, k in held.items():
                    left[x] += k
                gap = room - total(more.items())
                if best is None or gap < best[0]:
                    best = gap, {x: held.get(x, 0) + more.get(x, 0) for x in held | more}
                if not gap:
                    break
            _, c = best
            m = max(1, min(int(left[x]) // times for x, times in c.items()) // 2)
            out.append((c, m))
            for x, times in c.items():
                left[x] -= times * m
    return out


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations and multiplicities by best fit, longest pieces first; like bins are filled together."""
    room: dict[int, list[tuple[dict[int, int], int]]] = {}
    mask = 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            fits = mask >> length
            if fits:
                left = length + (fits & -fits).bit_length() - 1
                held, m = room[left].pop()
                if not room[left]:
                    del room[left]
                    mask &= ~(1 << left)
            else:
                left, held, m = capacity, {}, max(1, n // (capacity // length))
            each = min(left // length, n)
            k = min(m, n // each)
            for content, times, space in ((held | {length: held.get(length, 0) + each}, k, left - each * length), (held, m - k, left)):
                if times and content:
                    room.setdefault(space, []).append((content, times))
                    mask |= 1 << space
            n -= each * k
    return [x for bins in room.values() for x in bins]


def mended(planned: list[tuple[dict[int, int], int]], capacity: int, most: int) -> list[tuple[dict[int, int], int]]:
    """planned, with its emptiest sequences and those of most pieces packed anew by best fit, if that takes fewer.

    At most `most` pieces are packed anew; the program has placed all others.
    """
    gap = lambda c: capacity - sum(x * times for x, times in c.items())
    pieces = lambda c: sum(c.values())
    held, pool, rest = 0, [], []
    for c, m in sorted(planned, key=lambda x: (gap(x[0]) < 4, -gap(x[0]) if gap(x[0]) >= 4 else -pieces(x[0]))):
        k = min(m, max(0, most - held) // pieces(c))
        held += k * pieces(c)
        pool += [(c, k)] * (k > 0)
        rest += [(c, m - k)] * (m > k)
    counts = np.zeros(capacity + 1, np.int64)
    for c, k in pool:
        for x, times in c.items():
            counts[x] += times * k
    again = best_fit(counts, capacity)
    return rest + again if sum(m for _, m in again) < sum(k for _, k in pool) else planned


def repacked(planned: list[tuple[dict[int, int], int]], capacity: int, least: int) -> list[tuple[dict[int, int], int]]:
    """planned, with a few sequences at a time packed anew, where that takes fewer or leaves its room in fewer places.

    Room that is gathered in one sequence is what lets another go. The two emptiest of at most SPARE sequences and some
    drawn from the others are filled by their longest piece and the fullest choice to go with it, or by best fit; all is
    bounded, and seeded. As few sequences as `least` end it.
    """
    rng = np.random.default_rng(3)
    room = lambda c: capacity - sum(x * times for x, times in c.items())
    order = sorted(range(len(planned)), key=lambda i: -room(planned[i][0]))
    order, drawn = order[:EMPTIEST], rng.permutation(order[EMPTIEST:]).tolist()
    bins, taken = [], {}
    for i in order + drawn:
        taken[i] = min(planned[i][1], SPARE - len(bins))
        bins += [planned[i][0]] * taken[i]
        if len(bins) == SPARE:
            break
    rest = [(c, m - taken.get(i, 0)) for i, (c, m) in enumerate(planned) if m > taken.get(i, 0)]
    others = sum(m for _, m in rest)
    worth = lambda some: (len(some), -sum((capacity - room(c)) ** 2 for c in some))
    for _ in range(TIMES):
        if len(bins) + others <= least or len(bins) < 2:
            break
        empty = sorted(range(len(bins)), key=lambda i: -room(bins[i]))[:2]
        pick = {*empty, *rng.choice(len(bins), min(FEW, len(bins)), replace=False).tolist()}
        counts = np.zeros(capacity + 1, np.int64)
        for i in pick:
            for x, times in bins[i].items():
                counts[x] += times
        again = min(([c for c, m in new for _ in range(m)] for new in (rounded({}, counts, capacity), best_fit(counts, capacity))), key=worth)
        if worth(again) < worth([bins[i] for i in pick]):
            bins = [c for i, c in enumerate(bins) if i not in pick] + again
    return rest + [(c, 1) for c in bins]


def plan(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (length: times) and multiplicities that use up counts exactly.

    The program is solved and rounded up to ROUNDS times with prices that differ slightly, and the fewest sequences are
    taken, some of which are packed anew; as few as there are full sequences of tokens end the search.
    """
    rest, whole = counts.astype(np.int64).copy(), int(counts[capacity])
    rest[capacity] = 0
    least = -(-int(rest @ np.arange(capacity + 1)) // capacity)
    best: list[tuple[dict[int, int], int]] | None = None
    for seed in range(ROUNDS if least else 0):
        found = mended(rounded(configuration_program(rest, capacity, seed), rest, capacity), capacity, int(counts.sum()) // MEND)
        found = repacked(found, capacity, least)
        if best is None or sum(m for _, m in found) < sum(m for _, m in best):
            best = found
        if sum(m for _, m in best) == least:
            break
    return ([({capacity: 1}, whole)] if whole else []) + (best or [])


class Placement:
    """Where the i-th piece of a length goes."""

    def __init__(self, configurations: list[tuple[dict[int, int], int]], capacity: int) -> None:
        rows, used, base = [], np.zeros(capacity + 1, np.int64), 0
        for c, m in configurations:
            offset = 0
            for length in sorted(c, reverse=True):
                rows.append((length, used[length], base, c[length], offset))
                used[length] += c[length] * m
                offset += c[length] * length
            base += m
        rows.sort()
        self.sequences = base
        self.table = np.array(rows, np.int64).reshape(len(rows), 5)
        self.keys = (self.table[:, 0] << 48) + self.table[:, 1]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by length and number within it."""
        length = length.astype(np.int64)
        row = self.table[np.searchsorted(self.keys, (length << 48) + number, "right") - 1]
        t = number - row[:, 1]
        return row[:, 2] + t // row[:, 3], row[:, 4] + t % row[:, 3] * length


def cut(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces: id, piece, start, length, ids_crc32, and task and nth, by which those of a length are numbered."""
    df = frames.pick(docs, id=id_col, text=text_col)
    kind = df.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = whole_encoder(tokenizer).encode, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in frames.small(batches):
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.append(encode(text.as_py()) if text.is_valid else end[:0], end)
                a, b, n = 0, len(ids) % capacity or capacity, 0
                while a < len(ids):
                    row.append(i)
                    piece.append(n)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    nth.append(int(seen[b - a]))
                    seen[b - a] += 1
                    a, b, n = b, b + capacity, n + 1
            cells = [pa.array(x, pa.int64()) for x in (piece, start, length, crc, nth)]
            cells[0] = cells[0].cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *cells, pa.array(np.full(len(row), task, np.int32))], ["id", "piece", "start", "length", "ids_crc32", "nth", "task"])

    return df.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, nth bigint, task int")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset. tokenizer is a path."""
    scratch = frames.Scratch(docs.sparkSession)
    pieces = scratch.keep(cut(docs, id_col, text_col, tokenizer, capacity, end_id), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    by_task = scratch.keep(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "by-task")
    for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    placement = Placement(plan(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(first, ["length", "task"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("number"))
    kind = pieces.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(placement)  # at most a few rows a configuration, however many documents

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sequence, offset = shared.value.place(batch.column(3).to_numpy(), batch.column(5).to_numpy())
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = numbered.mapInArrow(lambda batches: map(one, batches), f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
