"""Best-fit packing by a linear grouping scheme.

Texts become token ids plus one separator id.  Only a document longer than the
capacity is cut.  The plan is made from the histogram of piece lengths, which
has at most `capacity` rows whatever the size of the corpus:

1. lengths above a share of the capacity are sorted and cut into groups of
   equal cardinality; within a group every length is rounded up to the largest;
2. for those few sizes the configurations (multisets that fit) are optimised
   by column generation, with a knapsack as pricing problem;
3. the configurations' slots get the actual lengths of their groups;
4. what is left over and all small lengths go, longest first, to the fullest
   sequence they fit into.

The plan is a list of runs of equal sequences.  A piece finds its place from
its length and its rank among the pieces of that length; ranks come from
counts by (partition, length), so no length has to meet in one task.

Edge cases: a null or empty text is the separator alone; an empty table gives
no rows; null and repeated doc_ids are packed like any others, each row for
itself; only doc_id and text are read, so other columns can have any names.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import crc32, forgetting, materialise, partition_id
from inkspan.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048
SEPARATOR = 0
#: (lengths above this share of the capacity are large, number of groups); the plan with the fewest sequences is used.
SCHEMES = ((1 / 2, 64), (1 / 4, 40), (1 / 8, 24))


def solve_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[int, np.ndarray]]:
    """Whole multiples of configurations that don't exceed the demand: (times, items of each size)."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        prices = np.ones(n) @ inverse
        column = _best_configuration(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        direction, level = inverse @ column, inverse @ demand
        up = direction > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = np.maximum(level[up], 0) / direction[up]
        basis[:, int(np.argmin(ratio))] = column
    times = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    left = demand.astype(np.int64).copy()
    out = []
    for t, column in sorted(((int(t), basis[:, i].astype(np.int64)) for i, t in enumerate(times)), key=lambda x: -x[0]):
        used = column > 0
        t = min([t, *(left[used] // column[used]).tolist()]) if used.any() else 0
        if t > 0:
            left -= t * column
            out.append((t, column))
    return out


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    value = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    ascending, gain = sizes[order], prices[order]
    for c in range(int(ascending[0]), capacity + 1):
        k = int(np.searchsorted(ascending, c, side="right"))
        total = value[c - ascending[:k]] + gain[:k]
        i = int(np.argmax(total))
        if total[i] > value[c - 1] + 1e-12:
            value[c], pick[c] = total[i], order[i]
        else:
            value[c] = value[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return column


def plan_runs(histogram: dict[int, int], capacity: int, large_share: float, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal sequences: (how many, [(length, pieces of it in each), ...])."""
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    if full := left.pop(capacity, 0):
        runs.append((full, [(capacity, 1)]))
    large = sorted((x for x in left if x > capacity * large_share), reverse=True)
    if large:
        total = sum(left[x] for x in large)
        share, queues, met = max(1, -(-total // groups)), [[]], 0
        for x in large:  # equal cardinality: a length may be split between groups
            n = left[x]
            while n:
                take = min(n, share - met)
                queues[-1].append([x, take])
                met, n = met + take, n - take
                if met == share:
                    queues.append([])
                    met = 0
        queues = [q for q in queues if q]
        merged: dict[int, list] = {}
        for q in queues:  # groups with the same largest length are one size
            merged.setdefault(q[0][0], []).extend(q)
        sizes = np.array(sorted(merged, reverse=True))
        demand = np.array([sum(n for _, n in merged[s]) for s in sizes.tolist()], dtype=float)
        for times, column in solve_configurations(sizes, demand, capacity):
            slots = [s for s, k in zip(sizes.tolist(), column.tolist(), strict=True) for _ in range(k)]
            _substitute(times, slots, merged, runs)
        left.update(dict.fromkeys(large, 0))
        for q in merged.values():
            for x, n in q:
                left[x] += n
    return _best_fit(runs, left, capacity)


def _substitute(times: int, slots: list[int], queues: dict[int, list], runs: list) -> None:
    """Give each slot `times` actual pieces of its group, longest first; a run ends where a slot's length changes."""
    taken = []
    for s in slots:
        need, own = times, []
        while need:
            x, n = queues[s][0]
            k = min(n, need)
            own.append([x, k])
            need -= k
            if k == n:
                queues[s].pop(0)
            else:
                queues[s][0][1] -= k
        taken.append(own)
    while times:
        step = min(own[0][1] for own in taken)
        contents: dict[int, int] = {}
        for own in taken:
            contents[own[0][0]] = contents.get(own[0][0], 0) + 1
            own[0][1] -= step
            if not own[0][1]:
                own.pop(0)
        runs.append((step, list(contents.items())))
        times -= step


def _best_fit(runs: list, left: dict[int, int], capacity: int) -> list:
    by_room: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, count: int, contents: list) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((count, contents))

    for count, contents in runs:
        put(capacity - sum(x * k for x, k in contents), count, contents)
    for x in sorted((x for x in left if left[x] > 0), reverse=True):
        n = left[x]
        while n:
            at = bisect_left(rooms, x)
            if at < len(rooms):
                room = rooms[at]
                count, contents = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(at)
            else:
                room, contents = capacity, []
                count = -(-n // (capacity // x))
            each = room // x
            whole = min(count, n // each)
            if whole:
                put(room - each * x, whole, [*contents, (x, each)])
                n -= whole * each
            rest = count - whole
            if rest and n:
                put(room - n * x, 1, [*contents, (x, n)])
                n, rest = 0, rest - 1
            if rest and contents:
                put(room, rest, contents)
    return [r for room in rooms for r in by_room[room]]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, schemes=SCHEMES) -> list:
    """The runs of the scheme that needs the fewest sequences; none is better than one with no room to spare."""
    best, least = None, 0
    bound = -(-sum(k * v for k, v in histogram.items()) // capacity)
    for share, groups in schemes:
        runs = plan_runs(histogram, capacity, share, groups)
        n = sum(c for c, _ in runs)
        if best is None or n < least:
            best, least = runs, n
        if least == bound:
            break
    return best


def _entries(runs: list) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, pieces in each sequence), sorted."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, contents in runs:
        offset = 0
        for x, k in contents:
            first = rank.get(x, 0)
            rows.append((x, first, sequence, offset, k))
            rank[x] = first + count * k
            offset += x * k
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, separator: int = SEPARATOR, include_ids: bool = False) -> DataFrame:
    """One row for each piece, with its task and its rank among that task's pieces of its length."""
    key = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", key), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * include_ids
    )
    end = np.array([separator], dtype="<u4").tobytes()

    def cut(batches):
        import pyarrow as pa

        encode, task, seen = encoder(vocabulary).encode, partition_id(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            kept, at = [], []
            for i, text in enumerate(b.column(1)):
                ids = encode(text.as_py()) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    n = len(part) // 4
                    at.append(i)
                    for c, v in zip(rows[1:], (k // (4 * capacity), k // 4, n, crc32(part), task, int(seen[n])), strict=True):
                        c.append(v)
                    seen[n] += 1
                    if include_ids:
                        kept.append(part)
            names = [f.name for f in schema.fields]
            columns = [b.column(0).take(pa.array(at, pa.int64()))] + [pa.array(r, t) for r, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * include_ids, names=names)

    return docs.select("doc_id", "text").mapInArrow(forgetting(cut), schema)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, include_ids: bool = False) -> DataFrame:
    """Pack every document; with include_ids, each piece's ids as little-endian unsigned 32-bit bytes."""
    cut = materialise(pieces(docs, vocabulary or default_vocabulary(), capacity, separator, include_ids), "pieces")
    counts = cut.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    by_length = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = _entries(make_plan(histogram, capacity))
    ranked = cut.join(before, ["task", "length"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * include_ids
    schema = T.StructType([*(cut.schema[n] for n in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        import pyarrow as pa

        key = (plan[:, 0] << 44) + plan[:, 1]
        for b in batches:
            length, rank = b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy()
            e = plan[np.searchsorted(key, (length << 44) + rank, side="right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            nth = rank - e[:, 1]
            k = np.maximum(e[:, 4], 1)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(e[:, 2] + nth // k), pa.array(e[:, 3] + nth % k * length)], names=[f.name for f in schema.fields])

    return ranked.select(*names, (F.col("nth") + F.col("before")).alias("rank")).mapInArrow(forgetting(place), schema)
