"""Filling containers of a fixed capacity with texts measured in tokens, by histogram packing with non-negative least squares.

Only the histogram of sizes decides, so the plan costs the same for any number of texts: combinations of up to three
different sizes that fill a window below the capacity are enumerated; how often each is used is the non-negative
least-squares solution against the histogram, found by active sets (so at most one combination per size is used) and
rounded by largest remainders, again on what is left while that places anything; what remains is packed best fit first,
in runs of equal containers. Above CLASSES tokens the enumeration sees sizes in classes, rounded up; items never are:
the plan takes each class's items largest first, and tops the space left up with the smallest items' best fit.

Texts are then matched to slots by their rank among the texts of their size. No text moves for that: ranks are
counted while tokenising, per partition, and completed by per-partition offsets.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a text is split before byte pairs are merged, for rank files of the 50k byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY = 512
WINDOW = 0  # combinations must fill the capacity up to so many tokens
CLASSES = 512  # classes of sizes that the enumeration sees at most (CLASSES ** 2 / 12 combinations of three sizes)
LEAST_CLASS = 4  # smaller items than this many classes are kept for topping up: rounding would waste too much of them
ROUNDS = 8
MAX_CAPACITY = 1 << 20  # bound of the histogram and of the plan on the driver, an error beyond


def token_counter(path: str, split: str = SPLIT) -> Callable[[str], int]:
    """Counts a text's tokens: a rank file (.tiktoken, with ``split``) or a tokenizer's JSON. Special tokens' texts are ordinary text."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda text: len(whole.encode(text, add_special_tokens=False).ids)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    encoding = tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def sized_items(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, tokens, part, rank): the items to pack, written.

    A text of more than ``capacity`` tokens, and no other, is divided: full pieces and a rest. ``rank`` counts the items of
    one size within the partition ``part``. NULL and empty texts are one item of 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = token_counter(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.array([tokens(t) if t else 0 for t in texts], np.int64)
            count = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(texts)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            size = np.minimum(capacity, sizes[row] - piece * capacity)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.searchsorted(ordered, ordered)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - first + seen[ordered]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "tokens", "part", "rank"],
            )

    schema = "doc_id bigint, piece int, start bigint, tokens int, part int, rank bigint"
    return written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, schema), "items")


def combinations(sizes: np.ndarray, capacity: int, window: int = WINDOW) -> np.ndarray:
    """All multisets of one to three of ``sizes`` with a sum in [capacity - window, capacity]; unused places are 0."""
    there = np.zeros(capacity + 1, bool)
    there[sizes] = True
    s = np.flatnonzero(there)
    s = s[s > 0]
    found = []
    for total in range(capacity - window, capacity + 1):
        if total > 0 and there[total]:
            found.append(np.array([[total, 0, 0]]))
        b = s[(total - s >= s) & (total - s > 0)]
        b = b[there[total - b]]
        found.append(np.stack([total - b, b, np.zeros_like(b)], 1))
        for c in s[s * 3 <= total]:
            b = s[(s >= c) & (total - c - s >= s)]
            b = b[there[total - c - b]]
            found.append(np.stack([total - c - b, b, np.full_like(b, c)], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def multiples(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(combinations, copies of the first size): as many of one size as the capacity holds, or one less, and up to two others that fill the rest."""
    there = np.zeros(capacity + 1, bool)
    there[sizes] = True
    s = np.flatnonzero(there)
    found, copies = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for a in s[s > 0]:
        for n in {capacity // a, capacity // a - 1} - {0, 1}:
            rest = capacity - n * a
            b = s[(s > 0) & (s * 2 <= rest)]
            b = b[there[rest - b]]
            rows = [np.stack([np.full_like(b, a), rest - b, b], 1)]
            if rest == 0 or there[rest]:
                rows.append(np.array([[a, rest, 0]]))
            found += rows
            copies.append(np.full(sum(map(len, rows)), n))
    return np.concatenate(found), np.concatenate(copies)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray, copies: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 minimising the squared, size-weighted misfit of the combinations' total to the histogram.

    By active sets: the combination with the steepest descent enters, those that would fall below zero leave. The
    solution is basic: no more combinations than sizes are above zero. ``copies``: how often each first size is taken.
    """
    m = len(combos)
    x = np.zeros(m)
    if not m:
        return x
    n = len(histogram)
    times = np.ones((m, 3))
    times[:, 0] = 1 if copies is None else copies
    weight = np.sqrt(np.arange(n) / n)
    w = np.where(combos > 0, weight[combos], 0.0) * times
    target = weight * histogram
    matrix = np.zeros((n, 0))
    active: list[int] = []
    barred = np.zeros(m, bool)
    residual = target.copy()
    least = 1e-9 * max(1.0, float(np.abs(target).max()))
    for _ in range(4 * n):
        gradient = (w * residual[combos]).sum(axis=1) / np.sqrt((w * w).sum(axis=1))
        gradient[active] = 0
        gradient[barred] = 0
        j = int(gradient.argmax())
        if gradient[j] <= least:
            break
        column = np.zeros((n, 1))
        np.add.at(column[:, 0], combos[j], w[j])
        active.append(j)
        matrix = np.hstack([matrix, column])
        while True:
            gram = matrix.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-10
            z = np.linalg.solve(gram, matrix.T @ target)
            if z[-1] <= 0 and x[j] == 0:  # no progress with it
                barred[j] = True
                active.pop()
                matrix = matrix[:, :-1]
                break
            if (z > 0).all():
                x[active] = z
                barred[:] = False
                break
            now = x[active]
            low = z <= 0
            step = float((now[low] / (now[low] - z[low])).min())
            now = np.maximum(0.0, now + step * (z - now))
            now[low & (now < 1e-12)] = 0.0
            x[active] = now
            keep = now > 0
            if keep.all():
                keep[np.flatnonzero(low)[now[low].argmin()]] = False
                x[np.array(active)[~keep]] = 0.0
            active, matrix = [k for k, stays in zip(active, keep) if stays], matrix[:, keep]
            if not active:
                break
        residual = target - matrix @ x[active]
    return x


def _rounded(x: np.ndarray, needs: list[dict[int, int]], left: np.ndarray) -> list[tuple[int, int]]:
    """[(combination, repeats)] with whole repeats: floors first, then one more by largest remainder, while items last. Takes them from ``left``."""
    taken: dict[int, int] = {}
    whole = np.floor(x + 1e-6).astype(np.int64)
    for wanted in (whole, None):
        for k in np.argsort(-(x if wanted is not None else x - whole), kind="stable"):
            most = int(wanted[k]) if wanted is not None else int(x[k] - whole[k] > 1e-6)
            if most <= 0:
                if x[k] <= 1e-6:
                    break
                continue
            n = min(most, *(int(left[s]) // c for s, c in needs[k].items()))
            if n > 0:
                taken[k] = taken.get(k, 0) + n
                for s, c in needs[k].items():
                    left[s] -= n * c
    return list(taken.items())


class _Left:
    """What is left of a histogram; the largest size there up to a limit is found by path compression."""

    def __init__(self, histogram: np.ndarray):
        self.n = [int(v) for v in histogram]
        self.n[0] = 0
        self.lower = list(range(len(self.n)))

    def largest(self, limit: int) -> int:
        """0 if there is none."""
        path = []
        s = min(limit, len(self.n) - 1)
        while s > 0 and not (self.lower[s] == s and self.n[s]):
            path.append(s)
            s = self.lower[s] if self.lower[s] != s else s - 1
        for p in path:
            self.lower[p] = s
        return s


def packing_plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int], str]]:
    """[(repeats, {size: items of it per container}, way)]: every item of the histogram exactly once, no sum above ``capacity``.

    ``way``: 'full' (one item fills it), 'solved' (by least squares) or 'greedy'.
    """
    items = np.asarray(histogram, np.int64).copy()
    items[0] = 0
    plan: list[tuple[int, dict[int, int], str]] = []
    if items[capacity]:
        plan.append((int(items[capacity]), {capacity: 1}, "full"))
        items[capacity] = 0
    width = -(-capacity // CLASSES)
    edge = capacity // width  # the capacity in classes, rounded down while sizes are rounded up
    of = -(-np.arange(capacity + 1) // width)
    seen = (np.arange(capacity + 1) >= LEAST_CLASS * width) | (width == 1)
    classes = np.bincount(of, np.where(seen, items, 0), minlength=edge + 2).astype(np.int64)[: edge + 1]
    queues = {int(c): [[int(s), int(items[s])] for s in np.flatnonzero((of == c) & seen & (items > 0))] for c in np.flatnonzero(classes)}
    solved: list[tuple[int, dict[int, int]]] = []
    for _ in range(ROUNDS):
        sizes = np.flatnonzero(classes)
        singles = combinations(sizes, edge)
        singles = singles[singles[:, 1] > 0]
        many, copies = multiples(sizes, edge)
        combos, copies = np.concatenate([singles, many]), np.concatenate([np.ones(len(singles), np.int64), copies])
        x = repeat_counts(combos, classes.astype(np.float64), copies)
        needs = []
        for (a, b, c), n in zip(combos[x > 1e-6].tolist(), copies[x > 1e-6].tolist()):
            need: dict[int, int] = {}
            for s, k in ((a, n), (b, 1), (c, 1)):
                if s:
                    need[s] = need.get(s, 0) + k
            needs.append(need)
        counted = _rounded(x[x > 1e-6], needs, classes)
        for k, repeats in counted:
            while repeats:  # the classes' items, largest first; equal containers at once
                content: dict[int, int] = {}
                once = []
                for c, n in needs[k].items():
                    queue, at = queues[c], len(queues[c]) - 1
                    while n:
                        here = min(n, queue[at][1])
                        once.append((c, at, here))
                        n -= here
                        at -= 1
                times = min(repeats, *(queues[c][at][1] // here for c, at, here in once))
                for c, at, here in once:
                    size = queues[c][at][0]
                    content[size] = content.get(size, 0) + here
                    queues[c][at][1] -= here * times
                    items[size] -= here * times
                for c in needs[k]:
                    while queues[c] and not queues[c][-1][1]:
                        queues[c].pop()
                    queues[c] = [q for q in queues[c] if q[1]]
                solved.append((times, content))
                repeats -= times
        if not counted:
            break
    left = _Left(items)
    todo = solved[::-1]
    while todo:  # containers of classes may have space left: the largest items that fit
        repeats, content = todo.pop()
        s = left.largest(capacity - sum(z * k for z, k in content.items()))
        if not s:
            plan.append((repeats, content, "solved"))
            continue
        n = min(repeats, left.n[s])
        if n < repeats:
            todo.append((repeats - n, content))
        left.n[s] -= n
        todo.append((n, {**content, s: content.get(s, 0) + 1}))
    while first := left.largest(capacity):  # best fit decreasing on the rest, equal containers at once
        content, free, s = {first: 1}, capacity - first, first
        while free:
            s = left.largest(min(free, s))
            while s and content.get(s, 0) >= left.n[s]:
                s = left.largest(s - 1)
            if not s:
                break
            # one item of a size at a time at first keeps containers mixed
            k = 1 if len(content) < 2 else min(left.n[s] - content.get(s, 0), free // s)
            content[s] = content.get(s, 0) + k
            free -= s * k
        repeats = min(left.n[z] // k for z, k in content.items())
        plan.append((repeats, content, "greedy"))
        for z, k in content.items():
            left.n[z] -= repeats * k
    return plan


def packed(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, tokens, container, offset, way): every text's place.

    ``start``: first token of the piece in its text, ``offset``: its first token in the container, ``way``: how the
    container was filled, see :func:`packing_plan`. Texts without tokens need no container (NULL). Repeated rows are
    placed each; an empty table gives no rows; other columns are ignored.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity not between 1 and {MAX_CAPACITY}")
    spark = docs.sparkSession
    items = sized_items(docs, capacity, tokenizer, doc_id, text)
    counts = items.groupBy("tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("tokens").agg(F.sum("n").alias("n")).collect():  # at most capacity + 1 rows
        histogram[r["tokens"]] = r["n"]
    slots, base = [], 0
    for repeats, content, way in packing_plan(histogram, capacity):
        at = 0
        for s, k in sorted(content.items(), reverse=True):
            slots.append((s, repeats * k, base, repeats, at, ("full", "solved", "greedy").index(way)))
            at += s * k
        base += repeats
    # slots in order of size; their number follows the number of sizes and combinations, whatever the number of texts
    table = np.array(sorted(slots, key=lambda r: r[0]), np.int64).reshape(-1, 6)
    first = np.cumsum(histogram) - histogram - histogram[0]  # items of smaller sizes, those without tokens left out
    shared = spark.sparkContext.broadcast((table, np.cumsum(table[:, 1]), first))
    before = Window.partitionBy("tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = items.join(offsets, ["tokens", "part"]).select("doc_id", "piece", "start", "tokens", (F.col("before") + F.col("rank")).alias("rank"))
    ways = pa.array(["full", "solved", "greedy"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, upto, first = shared.value
        for batch in batches:
            tokens = batch.column("tokens").to_numpy()
            rank = batch.column("rank").to_numpy() + first[tokens]
            none = tokens == 0
            k = np.minimum(np.searchsorted(upto, rank, side="right"), max(0, len(slots) - 1))
            size, items, base, repeats, at, way = (slots[k] if len(slots) else np.ones((len(k), 6), np.int64)).T
            within = rank - (upto[k] - items if len(slots) else 0)
            columns = {
                "container": pa.array(base + within % repeats, mask=none),
                "offset": pa.array((at + within // repeats * size).astype(np.int32), mask=none),
                "way": ways.take(pa.array(way, mask=none)),
            }
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "tokens")), *columns.values()], names=["doc_id", "piece", "start", "tokens", *columns])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, tokens int, container bigint, offset int, way string")


def packing_report(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(items, containers, tokens, unused_share, solved_share): ``solved_share`` of the items that don't fill a container alone were placed by least squares."""
    of = lambda way: F.count(F.when(F.col("way") == way, 1))
    r = places.agg(
        F.count(F.lit(1)).alias("items"), (F.coalesce(F.max("container"), F.lit(-1)) + 1).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        (of("solved") / F.greatest(of("solved") + of("greedy"), F.lit(1))).alias("solved_share"),
    )
    return r.select("items", "containers", "tokens", (1 - F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("unused_share"), "solved_share")


def packing_faults(places: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(documents, incomplete, beyond, overlapping, divided): what is wrong with a packing of unique ids; all but the first should be 0.

    Texts whose pieces don't cover all their tokens, items beyond a container's end, items on an earlier item's place,
    texts divided without need.
    """
    by_text = Window.partitionBy("doc_id").orderBy("piece")
    texts = places.withColumn("gap", F.col("start") != F.coalesce(F.sum("tokens").over(by_text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    texts = texts.groupBy("doc_id").agg(F.max(F.col("gap").cast("int")).alias("gap"), F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("size"))
    texts = texts.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("gap"), F.lit(0)).alias("incomplete"), F.count(F.when((F.col("pieces") > 1) & (F.col("size") <= capacity), 1)).alias("divided"))
    end = F.col("offset") + F.col("tokens")
    along = Window.partitionBy("container").orderBy("offset")
    inside = places.filter(F.col("container").isNotNull()).select("*", (F.lag(end).over(along) > F.col("offset")).alias("on"))
    inside = inside.agg(F.count(F.when(end > capacity, 1)).alias("beyond"), F.count(F.when(F.col("on"), 1)).alias("overlapping"))
    one = F.lit(1).alias("one")
    return texts.select("*", one).join(F.broadcast(inside.select("*", one)), "one").select("documents", "incomplete", "beyond", "overlapping", "divided")
