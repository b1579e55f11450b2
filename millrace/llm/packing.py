"""Best-fit packing of documents into fixed contexts by bin-completion branch and bound."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import integer_id, table
from .mixing import token_count

CAPACITY = 2048
PIECES_PER_SHARD = 4096
#: Steps of the search in one shard: sizes tried in fillings, and bins opened. Nothing else bounds the enumeration.
STEPS = 400_000


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of ``lengths`` by bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > lengths[i]:
            insort(room, (free - lengths[i], b))
    return bins


def exact_fillings(ascending: list[int], counts: dict[int, int], space: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Every choice of the remaining sizes whose sum is ``space``, larger sizes first; ends when ``steps[0]`` is used up."""
    reach = [0]  # what the sizes before each place sum up to
    for s in ascending:
        reach.append(reach[-1] + s * counts[s])

    def grow(at: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield chosen
            return
        at = min(at, bisect_right(ascending, left))
        # A level for each distinct size, so the depth is below the square root of twice the space.
        while at > 0 and reach[at] >= left:
            at -= 1
            s = ascending[at]
            for k in range(min(counts[s], left // s), 0, -1):
                if steps[0] <= 0:
                    return
                steps[0] -= 1
                yield from grow(at, left - k * s, chosen + (s,) * k)

    yield from grow(len(ascending), space, ())


def undominated(filling: tuple[int, ...], ascending: list[int], counts: dict[int, int], waste: int) -> bool:
    """Whether no remaining size fits into the waste, and none can take the place of a smaller one of the filling."""
    used: dict[int, int] = {}
    for s in filling:
        used[s] = used.get(s, 0) + 1
    for s in [0, *used]:
        for t in ascending[bisect_right(ascending, s) : bisect_right(ascending, s + waste)]:
            if counts[t] > used.get(t, 0):
                return False
    return True


def fillings(sizes: list[int], counts: dict[int, int], space: int, slack: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
    """Every undominated choice of the remaining ``sizes`` (distinct, descending) that wastes at most ``slack`` of ``space``.

    Fullest first, each found when asked for, so that perfect fillings cost no enumeration of the others.
    """
    ascending = sizes[::-1]
    for waste in range(min(slack, space) + 1):
        if steps[0] <= 0:
            return
        steps[0] -= 1
        for filling in exact_fillings(ascending, counts, space - waste, steps):
            if undominated(filling, ascending, counts, waste):
                yield filling


def bin_completion(lengths: list[int], capacity: int = CAPACITY, steps: int = STEPS) -> list[list[int]]:
    """Indices of ``lengths`` (each at most ``capacity``) by bin, in as few bins as the search finds.

    The incumbent is best-fit decreasing. While it needs more bins than the total length forces, a depth-first search
    fills one bin at a time around the largest remaining length, fullest undominated filling first, and abandons a
    branch as soon as its waste exceeds what a packing with one bin less could afford. ``steps`` bounds the search;
    the incumbent is always a complete packing.
    """
    best = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = -(-total // capacity)
    if len(best) <= bound or not lengths:
        return best
    counts: dict[int, int] = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    sizes = sorted(counts, reverse=True)
    answer: list[tuple[int, ...]] | None = None
    target = len(best) - 1
    budget = [steps]

    def take(items: tuple[int, ...], by: int) -> None:
        for s in items:
            if s not in counts or counts[s] == 0:
                insort(sizes, s, key=lambda x: -x)
                counts[s] = 0
            counts[s] += by
            if counts[s] == 0:
                sizes.remove(s)

    # An explicit stack, as a shard holds more bins than Python's recursion allows. An entry is an open bin: its largest
    # length, its fillings (made when asked for), the waste before it and the filling in place.
    stack: list[list] = []
    waste, descend = 0, True
    while True:
        if descend and not sizes:
            answer, target = [(head, *filling) for head, _, _, filling in stack], len(stack) - 1
            if len(stack) <= bound:
                break
        elif descend:
            if budget[0] <= 0:
                break
            budget[0] -= 1
            head = sizes[0]
            take((head,), -1)
            slack = target * capacity - total - waste
            stack.append([head, fillings(sizes, counts, capacity - head, slack, budget), waste, None])
        if not stack:
            break
        head, rest, before, placed = stack[-1]
        if placed is not None:
            take(placed, 1)
        filling = next(rest, None)
        waste = before + capacity - head - sum(filling or ())
        descend = filling is not None and waste <= target * capacity - total
        if descend:
            take(filling, -1)
            stack[-1][3] = filling
        else:
            take((head,), 1)
            stack.pop()
    if answer is None:
        return best
    by_size: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        by_size.setdefault(lengths[i], []).append(i)
    return [[by_size[s].pop() for s in b] for b in answer]


_OUT = "doc_id long, piece int, token_start long, n_tokens long, shard long, bin int, bin_offset int"


def pack(
    docs: DataFrame,
    capacity: int = CAPACITY,
    pieces_per_shard: int = PIECES_PER_SHARD,
    steps: int = STEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A bin for every token of every document: one row per document, or per piece of a longer one.

    A text of more than ``capacity`` tokens is cut into full contexts and a rest. Rows are spread over shards of about
    ``pieces_per_shard`` rows by a hash of id and length; each shard is packed on its own (``bin_completion``), so work
    grows in proportion to the corpus and at most one bin per shard is left unfilled beyond what the lengths force.
    Only ids and token counts are shuffled.

    Defined cases: null and empty texts have no tokens and no row; a text of any length is cut into as many pieces as
    it needs; a null id is packed like any other and an id that is no integer is a ValueError; repeated rows are packed
    each; where equal lengths compete for a place the smaller id comes first, and the earlier piece of a document; an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    sized = docs.select(integer_id(docs, id_col).alias("doc_id"), token_count(F.col(text_col)).alias("n_tokens"))
    shards = docs.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(pieces_per_shard))).alias("n_shards"))
    sharded = (
        sized.filter("n_tokens > 0")
        .crossJoin(F.broadcast(shards))
        .select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.col("n_shards")).alias("shard"))
    )

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        shard = group.column("shard")[0].as_py()
        pieces = []
        for doc, n in zip(group.column("doc_id").to_pylist(), group.column("n_tokens").to_pylist()):
            for k, start in enumerate(range(0, n, capacity)):
                pieces.append((doc, k, start, min(capacity, n - start)))
        rows: list[tuple] = []
        for b, members in enumerate(bin_completion([p[3] for p in pieces], capacity, steps)):
            offset = 0
            for i in members:
                rows.append((*pieces[i], shard, b, offset))
                offset += pieces[i][3]
        columns = list(zip(*rows))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = ["doc_id", "piece", "token_start", "n_tokens", "shard", "bin", "bin_offset"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    # By a fixed number of partitions: the rows are few bytes but much work, and would be coalesced by their size.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sharded.repartition(parts, "shard").groupBy("shard").applyInArrow(solve, _OUT)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of 2,048 tokens for all documents."""
    return pack(table(spark, sf_dir, "documents"))
