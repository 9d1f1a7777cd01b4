"""Problem 9: filling containers of fixed capacity with documents measured in tokens, by swap-based local search.

Documents are dealt into blocks of bounded size by a hash of their id. Each block is filled best-fit by falling size;
then bins that aren't full exchange documents one for one, two for one, or move one, whenever that raises the sum of
squared fills, until no exchange among any of them does; bins that get empty are gone. What stays in bins with room goes
into the next round's fewer blocks, until one block holds all that is left or rounds fill hardly any bins more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlake.llm.encode import VOCABULARY, encode
from tierlake.plans.shared import cut

CAPACITY = 2048
#: About so many items a task packs, so that its memory and time are bounded.
BLOCK = 10_000
#: Bins with less room than this share of the capacity aren't unpacked again; what is unpacked is dealt anew while it falls below this share of what was dealt before.
ROOM, SHRINKS = 0.002, 0.9


def pieces(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, size) from (doc_id, n_tokens): one piece, or pieces of the capacity and the rest where a text is longer; none for 0 or null."""
    n = F.ceil(F.col("n_tokens") / capacity)
    each = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("piece"))
    return each.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("bigint") * capacity).cast("int").alias("size"))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, into the bin with the least room that holds it. Rooms are bits of one number."""
    rooms, by_room = 0, [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        size = sizes[item]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            held = by_room[room]
            at = held.pop()
            if not held:
                rooms &= ~(1 << room)
        else:
            at, room = len(bins), capacity
            bins.append([])
        bins[at].append(item)
        room -= size
        by_room[room].append(at)
        rooms |= 1 << room
    return bins


class _Shelf:
    """The bins that aren't full, and where among them documents and pairs of documents of a size are."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.capacity, self.sizes = capacity, sizes
        self.held: list[dict[int, list[int]]] = []
        self.fill: list[int] = []
        for b in bins:
            held: dict[int, list[int]] = {}
            for k in b:
                held.setdefault(sizes[k], []).append(k)
            self.held.append(held)
            self.fill.append(sum(sizes[k] for k in b))
        # by size: bins that have it; the sizes that some bin has as the bits of one number. One document, and two of one bin.
        self.where: tuple[list[set[int]], list[set[int]]] = ([set() for _ in range(capacity + 1)], [set() for _ in range(capacity + 1)])
        self.bits = [0, 0]

    def loose(self, i: int) -> bool:
        return 0 < self.fill[i] < self.capacity

    def _sums(self, i: int) -> tuple[list[int], list[int]]:
        one = sorted(self.held[i])
        two = {x + y for k, x in enumerate(one) for y in one[k + (len(self.held[i][x]) < 2) :] if x + y <= self.capacity}
        return one, list(two)

    def put(self, i: int) -> None:
        for kind, found in enumerate(self._sums(i)):
            for s in found:
                self.where[kind][s].add(i)
                self.bits[kind] |= 1 << s

    def take(self, i: int) -> None:
        for kind, found in enumerate(self._sums(i)):
            for s in found:
                self.where[kind][s].discard(i)
                if not self.where[kind][s]:
                    self.bits[kind] &= ~(1 << s)

    def _pairs(self, i: int, size: int) -> tuple[int, ...]:
        held = self.held[i]
        return next((x, size - x) for x in sorted(held) if size - x in held and (2 * x != size or len(held[x]) > 1))

    def donor(self, kind: int, most: int, above: int, i: int) -> tuple[int, int] | None:
        """(size, bin) of the largest document (or pair) of another bin of at most ``most`` and more than ``above`` whose move raises the sum of squares."""
        seen = self.bits[kind] & ((1 << most + 1) - 1)
        while seen:
            size = seen.bit_length() - 1
            gain = size - above
            if gain <= 0:
                return None
            for j in self.where[kind][size]:
                if j != i and self.fill[j] - self.fill[i] < gain:
                    return size, j
            seen &= ~(1 << size)
        return None

    def best(self, i: int) -> tuple[int, int, tuple[int, ...], tuple[int, ...]] | None:
        """(gain, donor, sizes to take in, sizes to give) of the exchange that fills the room of bin i most: a document moves in, or one comes for one, two for one, or one for two."""
        room, found, most = self.capacity - self.fill[i], None, 0
        one, two = self._sums(i)
        for give, kinds in [((), (0, 1)), *(((x,), (0, 1)) for x in one), *((None if x in one else x, (0,)) for x in two)]:
            if give is None:
                continue
            out = give if isinstance(give, int) else sum(give)
            for kind in kinds:
                got = self.donor(kind, min(self.capacity, out + room), out + most, i)
                if got:
                    size, j = got
                    most = size - out
                    found = (most, j, (size,) if kind == 0 else self._pairs(j, size), self._pairs(i, give) if isinstance(give, int) else give)
                    if most == room:
                        return found
        return found

    def exchange(self, i: int, j: int, come: tuple[int, ...], go: tuple[int, ...]) -> None:
        self.take(i), self.take(j)
        for a, b, moved in ((j, i, come), (i, j, go)):
            for s in moved:
                k = self.held[a][s].pop()
                if not self.held[a][s]:
                    del self.held[a][s]
                self.held[b].setdefault(s, []).append(k)
        gain = sum(come) - sum(go)
        self.fill[i] += gain
        self.fill[j] -= gain
        for x in (i, j):
            if self.loose(x):
                self.put(x)


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins after exchanges that raise the sum of squared fills, until none does; bins that get empty are gone.

    The fullest bin that isn't full takes the exchange with any other such bin that fills its room most. Each exchange raises
    the sum, which is a bounded integer, so the search ends by itself.
    """
    shelf = _Shelf(bins, sizes, capacity)
    todo = [(-shelf.fill[i], i) for i in range(len(bins)) if shelf.loose(i)]
    for _, i in todo:
        shelf.put(i)
    heapify(todo)
    stuck: set[int] = set()  # bins without an exchange; all are asked again in the end until none has one
    changed = False
    while todo or changed:
        if not todo:
            todo = [(-shelf.fill[i], i) for i in stuck if shelf.loose(i)]
            heapify(todo)
            stuck, changed = set(), False
            continue
        at, i = heappop(todo)
        if -at != shelf.fill[i] or not shelf.loose(i):
            continue
        found = shelf.best(i)
        if found is None:
            stuck.add(i)
            continue
        _, j, come, go = found
        shelf.exchange(i, j, come, go)
        changed = True
        stuck.discard(j)
        for x in (i, j):
            if shelf.loose(x):
                heappush(todo, (-shelf.fill[x], x))
    return [[k for held in h.values() for k in held] for h in shelf.held if h]


def pack_block(ids: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers of one block, in an order that only depends on the items."""
    order = sorted(range(len(ids)), key=lambda k: (sizes[k], ids[k] is None, ids[k] or 0))
    bins = best_fit([sizes[k] for k in order], capacity)
    return [[order[k] for k in b] for b in local_search(bins, [sizes[k] for k in order], capacity)]


PACKED = "doc_id bigint, piece int, size int, container string, fill int"


def _filler(turn: int, capacity: int):
    def fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        ids, piece, size = (held.column(c).to_pylist() for c in ("doc_id", "piece", "size"))
        out: list[tuple] = []
        for k, items in enumerate(pack_block(ids, size, capacity)):
            full = sum(size[i] for i in items)
            out += [(ids[i], piece[i], size[i], f"{turn}-{key[0].as_py()}-{k}", full) for i in items]
        cols = list(zip(*out)) if out else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "size", "container", "fill"])

    return fill


def pack(sizes: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, piece, size, container, fill) from (doc_id, n_tokens): the container of each piece and how full it is.

    Texts without tokens (null, empty) take no room and have no row. Only texts longer than the capacity have several
    pieces. Rows of one doc_id that stand twice are two items. An empty table gives no rows.
    """
    todo = cut(pieces(sizes, capacity))
    n = todo.count()
    done: list[DataFrame] = []
    for turn in count():
        blocks = max(1, -(-n // block))
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(blocks)).cast("int"))
        packed = cut(dealt.groupBy("block").applyInArrow(_filler(turn, capacity), PACKED))
        loose = F.col("fill") < capacity * (1 - ROOM)
        left = packed.where(loose).count() if blocks > 1 else 0
        if blocks == 1 or not left or left > SHRINKS * n:
            return reduce(DataFrame.union, [*done, packed])
        done.append(packed.where(~loose))
        todo, n = packed.where(loose).select("doc_id", "piece", "size"), left


def containers(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``pack`` of the texts of ``docs``, measured in tokens of the vocabulary without special tokens."""
    return pack(encode(docs, vocabulary, ids=False), capacity)


def split_documents(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id): documents that were put into more than one container, the only ones longer than one."""
    return containers(docs, vocabulary, capacity).where("piece > 0").select("doc_id").distinct()
