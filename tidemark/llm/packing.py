"""Packing documents into fixed-length sequences: best fit, then swap-based local search.

A document's ids and an end id are cut only if they exceed the capacity: the first piece takes the remainder,
the others are full. Full pieces are sequences of their own. The rest are dealt by hash into groups of about
``GROUP`` pieces, each packed in one task: best-fit decreasing; then local search between underfull sequences.
It climbs: documents move, or are exchanged one for one or two for one, from the emptiest sequences first and
always so that the sum of squared fills grows, until no exchange helps. Emptied sequences are gone; the search ends at once where no packing has fewer. In the last
round, where that leaves more sequences than the total needs, ``SHAKES`` random exchanges of the same kinds follow,
which may also lower the squared fills, by ever less (``HEAT``), and another climb.

Sequences left with a larger gap than the round's limit (``GAP`` at first, doubled each round) are opened again,
and their pieces go to the next round with fewer groups, until one group is left. Each round's pieces (a few
numbers each, no ids) are written to the shared folder.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.memory import lean
from tidemark.session import materialize

CAPACITY, END = 1024, 2
#: Pieces that one task packs at a time.
GROUP = 50_000
#: Sequences with a larger gap are packed again in the second round.
GAP = 1
#: Random exchanges that the last group's search tries between climbs. More may save another sequence; what the
#: limit leaves is within 2 sequences of the bound at 1,000 pieces and 0.03 % above it at 50,000.
SHAKES = 1_000_000
#: By how much squared fill an exchange may lower the sum, at the first and the last of them (a scale, as of heat).
HEAT = (1000.0, 100.0)
#: Widest difference of two sizes that a random exchange considers, and share of exchanges with the emptiest sequence.
REACH, EMPTIEST = 40, 0.2


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item numbers. Sequences are found by gap through a bit set of open gaps."""
    open_bins: dict[int, list[int]] = {}
    bits, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = bits >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            k = open_bins[gap].pop()
            if not open_bins[gap]:
                bits ^= 1 << gap
            bins[k].append(i)
        else:
            gap, k = capacity, len(bins)
            bins.append([i])
        if gap - s:
            open_bins.setdefault(gap - s, []).append(k)
            bits |= 1 << (gap - s)
    return bins


class Search:
    """Local search over underfull sequences. What they can give back is indexed by size and gap, so a step lists none of it."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(sizes[b].sum()) for b in self.bins], dtype=np.int64)
        self._clear()

    def _clear(self) -> None:
        #: By number of items and size: the gaps of sequences that can give it back, as bits, and those sequences by gap.
        self.gaps: list[dict[int, int]] = [{}, {}, {}]
        self.at: list[dict[tuple[int, int], dict[int, None]]] = [{}, {}, {}]

    def _offers(self, k: int) -> list[set[int]]:
        """Sizes that a sequence can give: nothing, one item, two."""
        own = Counter(int(self.sizes[i]) for i in self.bins[k])
        return [{0}, set(own), {x + y for x in own for y in own if x < y or x == y and own[x] > 1}]

    def _index(self, k: int, enter: bool) -> None:
        gap = self.capacity - int(self.fill[k])
        if not gap or gap == self.capacity:
            return  # nothing fits into a full one, and nothing is gained by filling an empty one
        for gaps, at, sizes in zip(self.gaps, self.at, self._offers(k)):
            for s in sizes:
                if enter:
                    at.setdefault((s, gap), {})[k] = None
                    gaps[s] = gaps.get(s, 0) | 1 << gap
                else:
                    del at[s, gap][k]
                    if not at[s, gap]:
                        del at[s, gap]
                        gaps[s] ^= 1 << gap

    def improve(self, steps: int | None = None) -> None:
        """Exchanges until none raises the sum of squared fills, or ``steps`` of them; stops earlier once the total needs every sequence that is left."""
        least = -(-int(self.fill.sum()) // self.capacity)
        left = int((self.fill > 0).sum())
        self._clear()
        live = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist()
        for k in live:
            self._index(k, True)
        changed = True
        while changed:
            changed = False  # since every sequence was last tried
            heap = [(int(self.fill[k]), k) for k in live if 0 < self.fill[k] < self.capacity]
            heapify(heap)
            while heap and left > least and (steps is None or steps > 0):
                fill, k = heappop(heap)
                if fill != self.fill[k]:
                    continue  # entered again since
                target = self._exchange(k)
                if target is None:
                    continue
                changed, steps = True, steps and steps - 1
                left -= not self.fill[k]
                for x in (k, target):
                    if 0 < self.fill[x] < self.capacity:
                        heappush(heap, (int(self.fill[x]), x))
            changed = changed and left > least and (steps is None or steps > 0)

    def shake(self, steps: int = SHAKES, seed: int = 0) -> None:
        """Random exchanges; one that lowers the sum of squared fills passes with a chance that falls with the loss and with time."""
        rnd = random.Random(seed).random
        sizes, bins, capacity = self.sizes.tolist(), self.bins, self.capacity
        home = {i: k for k, b in enumerate(bins) for i in b}
        items = sorted(home, key=sizes.__getitem__)
        ordered, n = [sizes[i] for i in items], len(items)
        gap = (capacity - self.fill).tolist()
        left, least = sum(g < capacity for g in gap), -(-int(self.fill.sum()) // capacity)
        heat, cool = HEAT[0], (HEAT[1] / HEAT[0]) ** (1000 / max(steps, 1))
        emptiest = 0
        for step in range(steps if n else 0):
            if step % 1000 == 0:
                heat *= cool
                emptiest = max((g, k) for k, g in enumerate(gap) if g < capacity)[1]
            if rnd() < EMPTIEST and bins[emptiest]:
                source = emptiest
                i = bins[source][int(rnd() * len(bins[source]))]
            else:
                i = items[int(rnd() * n)]
                source = home[i]
            own, given, size = bins[source], [i], sizes[i]
            if len(own) > 1 and rnd() < 0.3 and (j := own[int(rnd() * len(own))]) != i:  # two for one
                given.append(j)
                size += sizes[j]
            low, high = bisect_left(ordered, size - REACH), bisect_left(ordered, size + min(gap[source], REACH) + 1)
            if low >= high or rnd() < 0.1:  # a move
                target, back, d = int(rnd() * len(bins)), None, size
                if target == source or gap[target] < size or gap[target] == capacity:
                    continue
            else:
                back = items[low + int(rnd() * (high - low))]
                target, d = home[back], size - sizes[back]
                if target == source or d > gap[target] or -d > gap[source]:
                    continue
            gain = 2 * d * (gap[source] - gap[target] + d)
            if gain < 0 and rnd() >= math.exp(gain / heat):
                continue
            gap[source] += d
            gap[target] -= d
            for x in given:
                own.remove(x)
                bins[target].append(x)
                home[x] = target
            if back is not None:
                bins[target].remove(back)
                own.append(back)
                home[back] = source
            if not own:
                left -= 1
                if left <= least:
                    break
        self.fill = capacity - np.array(gap, dtype=np.int64)

    def _step(self, source: int, others: np.ndarray) -> bool:
        """The best exchange of ``source`` with one of ``others``, if any raises the sum of squared fills."""
        self._clear()
        for k in [source, *others.tolist()]:
            self._index(k, True)
        return self._exchange(source) is not None

    def _exchange(self, source: int) -> int | None:
        """Do the best exchange of ``source`` with an indexed sequence; that one, or None."""
        self._index(source, False)
        own, best, found = int(self.fill[source]), 0, None
        gives = self._offers(source)
        widest = max((bits.bit_length() - 1 for bits in self.gaps[0].values()), default=0)
        for given, sizes in enumerate(gives[1:], 1):
            for size in sizes:
                for back in (0, 1, 2) if given == 1 else (1,):  # two moves are single steps
                    gaps = self.gaps[back]
                    for d in (size,) if back == 0 else range(1, min(size - 1, widest) + 1):
                        fits = gaps.get(size - d, 0) >> d
                        if fits:  # the fullest one gains most
                            gap = d + (fits & -fits).bit_length() - 1
                            gain = d * (self.capacity - gap + d - own)
                            if gain > best:
                                best, found = gain, (given, size, back, d, gap)
        if found is None:
            self._index(source, True)
            return None
        given, size, back, d, gap = found
        target = next(iter(self.at[back][size - d, gap]))
        self._index(target, False)
        items, returned = self._pick(source, given, size), self._pick(target, back, size - d)
        self.bins[source] = [x for x in self.bins[source] if x not in items] + returned
        self.bins[target] = [x for x in self.bins[target] if x not in returned] + items
        self.fill[source] -= d
        self.fill[target] += d
        self._index(source, True)
        self._index(target, True)
        return target

    def _pick(self, k: int, number: int, size: int) -> list[int]:
        """So many items of a sequence, of so much size together."""
        first: dict[int, int] = {}
        for i in self.bins[k] if number else ():
            s = int(self.sizes[i])
            if number == 1 and s == size:
                return [i]
            if number == 2 and size - s in first:
                return [first[size - s], i]
            first.setdefault(s, i)
        return []


def pack(sizes: np.ndarray, capacity: int = CAPACITY, shakes: int = SHAKES) -> list[list[int]]:
    """Item numbers of each sequence; every size is between 1 and ``capacity``."""
    search = Search(sizes, best_fit(sizes, capacity), capacity)
    least = -(-int(sizes.sum()) // capacity)
    if len(search.bins) > least:
        search.improve()
    if shakes and sum(map(bool, search.bins)) > least:
        before = [list(b) for b in search.bins if b]
        search.shake(shakes)
        search.improve()
        if sum(map(bool, search.bins)) >= len(before):
            return before  # as climbed: with the larger sum of squared fills
    return [b for b in search.bins if b]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, piece, start, length, ids_crc32)``: every document's ids and ``end``, cut only where too long."""
    raw = docs.sparkSession.sparkContext.broadcast(bpe.read_vocabulary(path))
    last = int(end).to_bytes(4, "little")

    def cut(ids: bytes) -> list[tuple[int, int, int, int]]:
        n = len(ids) // 4
        first = n % capacity or min(n, capacity)
        starts = [0, *range(first, n, capacity)]
        return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, [*starts[1:], n]))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder_of(raw.value)
        for pdf in bpe.batches(parts):
            found = [cut(ids + last) for ids in encoder.encode([t or "" for t in pdf["text"]])]
            out = pd.DataFrame([x for xs in found for x in xs], columns=["piece", "start", "length", "ids_crc32"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").repeat([len(xs) for xs in found]).reset_index(drop=True))
            yield out

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInPandas(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _round(table: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` groups; adds sequence_id, offset and the sequence's fill."""
    columns = table.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batches = list(parts)  # one group: about GROUP rows of a few numbers
        if not batches:
            return
        pdf = pd.concat(batches, ignore_index=True)
        for group, own in pdf.sort_values(["grp", "doc_id", "piece", "ids_crc32", "row"], kind="stable").groupby("grp", sort=False):
            own = own.reset_index(drop=True)
            sizes = own["length"].to_numpy()
            seq, offset, fill = (np.zeros(len(own), dtype=np.int64) for _ in range(3))
            for k, items in enumerate(pack(sizes, capacity, SHAKES if groups == 1 else 0)):
                seq[items] = (number << 56) + (int(group) << 24) + k
                offset[items] = np.cumsum(sizes[items]) - sizes[items]
                fill[items] = sizes[items].sum()
            yield own[columns].assign(sequence_id=seq, offset=offset, fill=fill)

    # with the row's number, as rows may be equal in all else
    dealt = table.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row", F.lit(number)), F.lit(groups)).cast("int"))
    return dealt.repartitionById(groups, F.col("grp")).mapInPandas(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, fill long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``docs(doc_id, text)`` to one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are a piece with the end id alone; repeated rows are packed each; a null doc_id stays
    null; other columns are not read; an empty table gives no rows. Sequence numbers are arbitrary but unique.
    """
    table, _ = materialize(pieces(docs, path, capacity, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = table.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    left = table.where(F.col("length") < capacity)
    n, number, gap = left.count(), 0, GAP
    while n:
        groups = -(-n // GROUP)
        packed, _ = materialize(_round(left, groups, number, capacity), "packed")
        again = packed.where(F.col("fill") < capacity - gap)
        n = again.count() if groups > 1 and gap < capacity else 0
        out = out.unionByName((packed.where(F.col("fill") >= capacity - gap) if n else packed).drop("fill"))
        left, number, gap = again.select(*table.columns), number + 1, 2 * gap
    return out.drop("row")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``, 1024 tokens a sequence."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe.vocabulary_path())


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of all documents with their sequences."""
    return pack_documents(docs, bpe.vocabulary_path())
