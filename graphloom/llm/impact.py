"""Exact top-k search over an impact-ordered index, score at a time.

Components are integers, floor(256 * x). In each task the vectors of a block get, for every
dimension and both directions, postings in descending order of their lead: how far the component
lies above the dimension's least value, or below its greatest one for queries that are negative
there. Leads are quantised to levels of 2**LEVEL_BITS, and the postings of a level form a segment.
A query takes segments in descending order of impact (its weight times the segment's greatest lead)
and adds their postings' impacts to the vectors' sums.

The index is built once and written, a block a row; queries are searched for a block at a time, and
a block's answers are written before the next is read.

At checkpoints the search may stop, on this proof: what a vector has not yet been given in a
dimension is at most the next segment's impact, so its sum plus those bounds is an upper bound; the
k-th best of some exact scores is a lower bound for members of the answer. If few vectors have upper
bounds that reach it, just these possible members are scored exactly. Otherwise the search goes on
with the next segments, to the last if need be, after which the bounds are the scores.

Defined results: which vectors take part is said in `usable` (zero vectors do), and vectors of
different lengths are searched apart; ties go to the smaller vec_id; scores are exact 64-bit
integers, and one beyond them becomes the nearest; fewer candidates than k give fewer rows; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize, table
from .vectors import Found, lengths, matrix, query_blocks, search_all, usable

SCALE = 256
LEVEL_BITS = 3
CHECKPOINTS = (0.5, 0.6, 0.7, 0.8, 1.0)  # shares of the postings
BLOCK_ROWS = 8192  # of a block, or so many that it holds BLOCK_VALUES components
BLOCK_VALUES = 1 << 22
WIDE = 1 << 52  # components beyond are scored in unbounded integers
LONG = (1 << 63) - 1
FEW = 24  # a stop leaves at most 1 / FEW of the vectors as possible members


class ImpactIndex:
    """Postings of one block of integer vectors; a list is (dimension, direction)."""

    def __init__(self, vectors, order=None):
        """vectors are whole numbers; order holds each dimension's rows from its greatest component to its least."""
        import numpy as np

        self.exact = bool(np.abs(vectors).max(initial=0) < WIDE)
        self.vectors = vectors = vectors.astype(np.int64) if self.exact else np.array([[int(x) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)
        if not self.exact:
            return
        self.order_down = np.argsort(-vectors, axis=0, kind="stable").T.astype(np.uint16) if order is None else order
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.reach = np.maximum(np.abs(self.low), np.abs(self.high)).astype(float)
        self.order, self.lead, self.stops, self.tops, self.sizes = [], [], [], [], []
        for d in range(vectors.shape[1]):
            down = self.order_down[d].astype(np.intp)
            ranked = vectors[down, d]
            for order, lead in ((down, ranked - self.low[d]), (down[::-1], self.high[d] - ranked[::-1])):
                level = lead >> LEVEL_BITS
                starts = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
                self.order.append(order)
                self.lead.append(lead)
                self.stops.append(np.append(starts[1:], len(order)))
                self.tops.append(lead[starts])
                self.sizes.append(self.stops[-1] - starts)
        self.places = np.empty(len(vectors) * vectors.shape[1], np.intp)
        self.values = np.empty(len(self.places))

    def _segments(self, query):
        """The query's lists, and its segments in descending order of impact: list, impact, and how many postings they come to."""
        import numpy as np

        lists = np.array([2 * d + int(w < 0) for d, w in enumerate(query) if w], np.intp)
        of = np.repeat(lists, [len(self.tops[i]) for i in lists])
        size = np.concatenate([self.sizes[i] for i in lists])
        impact = np.concatenate([self.tops[i] * abs(int(query[i // 2])) for i in lists])
        rank = np.argsort(-impact, kind="stable")  # within a list impacts fall, so its segments stay in order
        return lists, of[rank], np.append(impact[rank], 0), np.cumsum(size[rank])

    def top(self, query, k: int, own, floor: int, ids):
        """(ids, scores) of the k best rows of the block other than the row at place own (-1: none); rows certainly below floor may be missing.

        Every posting is added once, to its vector's sum and count. A vector still lacks lists less
        count postings, none of which has more impact than the next segment, nor all of them more
        than the next segments of all lists together: that gives its upper bound. Sums are 64-bit
        integers, or doubles where no sum reaches 2**53; a block or query beyond 64 bits is scored whole.
        """
        import numpy as np

        n = len(self.vectors)
        alive = np.ones(n, bool)
        if own >= 0:
            alive[own] = False
        rows = np.flatnonzero(alive)
        most = np.abs(np.asarray(query, float))
        widest = float((most * np.maximum(self.reach, 1)).sum()) if self.exact else float("inf")  # no score or sum is farther from 0, no bound over twice that
        if widest >= 2**61:
            whole = [sum(int(x) * int(w) for x, w in zip(v, query, strict=True)) for v in self.vectors[rows].tolist()]
            order = sorted(range(len(rows)), key=lambda i: (-whole[i], ids[rows[i]]))[:k]
            return ids[rows[order]], np.array([min(max(whole[i], -LONG), LONG) for i in order], np.int64)
        query = np.asarray(query).astype(np.int64)

        def answer(rows):
            scores = self.vectors[rows] @ query
            order = np.lexsort((ids[rows], -scores))[:k]
            return ids[rows][order], scores[order]

        if not query.any() or len(rows) <= 4 * k:
            return answer(rows)
        lists, of, impact, postings = self._segments(query)
        offset = sum(int(w) * int(self.low[d] if w > 0 else self.high[d]) for d, w in enumerate(query))
        weight = np.abs(query)[lists // 2]
        sums, counts = np.full(n, offset, np.int64), np.zeros(n, np.int64)
        narrow = widest < 2**52
        values = self.values if narrow else self.values.view(np.int64)
        done, taken = np.zeros(2 * len(query), np.intp), 0
        for share in CHECKPOINTS:
            before, taken = taken, int(np.searchsorted(postings, share * postings[-1])) + 1
            reached = done + np.bincount(of[before:taken], minlength=len(done))
            used, bounds = 0, 0
            for i, w in zip(lists.tolist(), weight.tolist(), strict=True):
                stops, r = self.stops[i], reached[i]
                if r < len(stops):
                    bounds += w * int(self.tops[i][r])
                a, b = (int(stops[x - 1]) if x else 0 for x in (done[i], r))
                if a < b:
                    self.places[used : used + b - a] = self.order[i][a:b]
                    np.multiply(self.lead[i][a:b], w, out=values[used : used + b - a])
                    used += b - a
            done = reached
            if narrow:
                sums += np.bincount(self.places[:used], values[:used], n).astype(np.int64)
            else:
                np.add.at(sums, self.places[:used], values[:used])
            if share < CHECKPOINTS[-1]:
                counts += np.bincount(self.places[:used], minlength=n)
                upper = sums + (np.minimum((len(lists) - counts) * int(impact[taken]), bounds) if widest * len(lists) < 2**61 else bounds)
            else:
                upper = sums
            upper[~alive] = -LONG
            likely = np.argpartition(-upper, 4 * k - 1)[: 4 * k]
            known = np.sort(self.vectors[likely[alive[likely]]] @ query)[::-1]
            least = max(floor, int(known[k - 1])) if len(known) >= k else floor
            possible = np.flatnonzero((upper >= least) & alive)
            if share == CHECKPOINTS[-1] or len(possible) <= max(4 * k, n // FEW):
                return answer(possible)


INDEX = "rows binary, ids binary, vectors binary, dimensions int, postings binary"


def build_index(rows: DataFrame, n: int, count: int) -> DataFrame:
    """The vectors of length n in blocks, a row each, with the order of their postings, as a written table."""
    held = max(256, min(BLOCK_ROWS, BLOCK_VALUES // n))
    blocks = -(-count // held)
    block = F.pmod(F.xxhash64("row", F.lit(3)), F.lit(blocks)).cast("int")
    dealt = rows.where(F.col("n") == n).select(block.alias("block"), "row", "vec_id", "v").repartition(blocks, "block").sortWithinPartitions("block", "row")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def settle(row, ids, v):
            for i in range(0, len(row), 2 * held):  # a block is larger by chance only
                at = slice(i, i + 2 * held)
                index = ImpactIndex(v[at])
                packed = [row[at].tobytes(), ids[at].tobytes(), v[at].tobytes(), n, index.order_down.tobytes() if index.exact else b""]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if x is n else pa.binary()) for x in packed], names=["rows", "ids", "vectors", "dimensions", "postings"])

        parts, now = [], None
        for b in batches:
            number = b.column("block").to_numpy()
            for at in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(number)) + 1):
                if len(at):
                    if parts and number[at[0]] != now:
                        yield from settle(*map(np.concatenate, zip(*parts, strict=True)))
                        parts = []
                    now, part = number[at[0]], b.slice(int(at[0]), len(at))
                    parts.append((part.column("row").to_numpy(), part.column("vec_id").to_numpy(), matrix(part.column("v"))))
        if parts:
            yield from settle(*map(np.concatenate, zip(*parts, strict=True)))

    return materialize(dealt.mapInArrow(run, INDEX), "impact-index")


def search(sent, k: int):
    """The function that gives the k best of a task's blocks for every query."""

    def run(batches):
        import numpy as np

        (rows, ids, queries), _ = sent.value
        found = Found(len(ids), k, np.int64)
        own = {r: q for q, r in enumerate(rows.tolist())}
        for b in batches:
            for i in range(b.num_rows):
                row, vec_ids = (np.frombuffer(b.column(c)[i].as_py(), np.int64) for c in ("rows", "ids"))
                d = b.column("dimensions")[i].as_py()
                packed = b.column("postings")[i].as_py()
                index = ImpactIndex(np.frombuffer(b.column("vectors")[i].as_py(), np.float64).reshape(-1, d), np.frombuffer(packed, np.uint16).reshape(d, -1) if packed else None)
                here = {own[r]: p for p, r in enumerate(row.tolist()) if r in own}
                for q, query in enumerate(queries):
                    seen = found.scores[q]
                    floor = int(seen[k - 1]) if len(seen) >= k else -LONG
                    found.add(q, *index.top(query, k, here.get(q, -1), floor, vec_ids))
        yield from found.batches(rows, ids)

    return run


def _quantised(x):
    """floor(SCALE * x) as a double; from 2**52 on every double is whole."""
    scaled = x * F.lit(float(SCALE))
    return F.when(F.abs(scaled) < F.lit(float(1 << 52)), F.floor(scaled).cast("double")).otherwise(F.least(F.greatest(scaled, F.lit(-1.7e308)), F.lit(1.7e308)))


def exact_top(vectors: DataFrame, k: int = 5, modulus: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the k greatest inner products of the quantised vectors."""
    rows = usable(vectors, True, "impact-rows").withColumn("v", F.transform("v", _quantised))

    def searches():
        for n, count in lengths(rows):
            index = build_index(rows, n, count)
            for queries in query_blocks(rows.where(F.col("n") == n), n, modulus):
                yield index, queries, None

    return search_all(searches(), search, k, "long", vectors.sparkSession)


def op6_topk(spark, sf_dir):
    return exact_top(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.id AS id, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: CAST(p[1] AS HUGEINT) * CAST(p[2] AS HUGEINT))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
