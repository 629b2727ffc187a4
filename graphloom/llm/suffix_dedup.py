"""Repeated-window removal by a depth-limited radix sort of suffixes.

Only the first DEPTH bytes of a suffix count, so a suffix is its window, and two suffixes fall into
one group exactly when their windows are equal. The sort goes by most significant digit, and a group
that holds one suffix is never refined:

* digit 1 is the window's anchor, the leftmost least hash among its GRAM-byte substrings. Suffixes
  that follow each other mostly share its place, so they are one run (anchor, first suffix, count);
* digit 2 is the whole stretch of text that a run's windows cover. Runs equal in both digits are
  equal window by window. If an anchor has one stretch only, its group is done;
* the remaining digits are the windows' own fingerprints, taken only for runs whose anchor has
  several stretches.

In every pass the map side sorts its own share first: what has an earlier equal in the same share is
marked there and not sent, so a passage in any number of documents sends one row per share, however
hot it is. Digits are compared by fingerprints, of 128 bits for runs (two 64-bit polynomials in
different bases, over different random values of the bytes) and 96 bits for windows, not byte by byte:
a row with its bytes for every suffix would be a hundred times the input. Texts themselves move once,
for the joins by document. The number of tasks follows the bytes of the texts (TASK_BYTES).

Of equal windows the one with the smallest (doc_id, start) stays; all bytes that the others cover go.

Defined results: a null text is empty; a null doc_id comes before all others; rows that repeat a
doc_id with the same text are one document, listed as often as they occur; rows of one doc_id with
different texts are documents of their own in the order of their SHA-256; texts shorter than the
depth lose nothing; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize, partitions, released, table

DEPTH = 100
GRAM = 50
CHUNK_BYTES = 1 << 20  # of text hashed at once
SHARE_BYTES = 12 << 20  # of text that is sorted together on the map side
SHARE_WINDOWS = 1 << 20
RUNS_PER_BUCKET = 1_000_000
TASK_BYTES = 12 << 20  # of text for every task of an exchange
ROUTED = "kind int, bucket int, doc binary, pos binary, len binary, one binary, two binary"
FOUND = "block int, kind int, doc binary, pos binary, len binary"
BY_DOC = "doc long, kind int, pos binary, len binary"
FLUSH = 1 << 21  # rows held back to be packed together
RUN, MARK, SPLIT = 0, 1, 2  # kinds: runs under way to their bucket, windows to remove, runs to refine


class Hasher:
    """Polynomial hashes modulo 2**64 of substrings of a byte array, all at once; every byte value stands for a random number of its own."""

    def __init__(self, seed: int):
        import numpy as np

        self.np, self.base = np, (0x9E3779B97F4A7C15 + 2 * seed * 0xC2B2AE3D27D4EB4F) % 2**64 | 1
        self.value = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int, base: int):
        np = self.np
        p, k = np.ones(n, np.uint64), 1
        b = np.array([base], np.uint64)
        while k < n:
            m = min(k, n - k)
            p[k : k + m] = p[:m] * (p[k - 1 : k] * b)
            k += m
        return p

    def prefix(self, data):
        np, n = self.np, len(data)
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * CHUNK_BYTES)
            self.up, self.down = self._powers(size, self.base), self._powers(size, pow(self.base, -1, 2**64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        return sums

    def of(self, sums, start, length):
        """Hashes of the substrings at start of the given length(s)."""
        return scramble((sums[start + length] - sums[start]) * self.down[start])


def scramble(x):
    import numpy as np

    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(data, ends, depth: int, gram: int, one: Hasher, two: Hasher):
    """Runs of the windows in data, whose documents end at ends: (first window, count, anchor, stretch hash)."""
    import numpy as np

    PLACE = np.uint64(2 * CHUNK_BYTES - 1)
    n = len(data)
    count = n - depth + 1
    none = np.zeros(0, np.int64)
    if count <= 0:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    a = one.prefix(data)
    at = np.arange(n - gram + 1)
    grams = one.of(a, at, gram)
    # The place fills the low bits, so that of equal hashes the leftmost is the anchor.
    low, width, wide = (grams & ~PLACE) | at.astype(np.uint64), 1, depth - gram + 1
    while width * 2 <= wide:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if wide > width:
        low = np.minimum(low[: len(low) - (wide - width)], low[wide - width :])
    whole = np.ones(count, bool)  # windows that stay inside a document
    for e in ends[:-1]:
        whole[max(0, e - depth + 1) : min(e, count)] = False
    new = np.ones(count, bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[1:] | ~whole[:-1]
    begins = np.flatnonzero(new)
    size = np.diff(np.append(begins, count))
    keep = whole[begins]
    begins, size = begins[keep], size[keep]
    b = two.prefix(data)
    return begins, size, grams[(low[begins] & PLACE).astype(np.int64)], two.of(b, begins, size - 1 + depth)


def _groups(*keys):
    """Order by keys (the first counts most), and where a new value of all but the last two keys begins."""
    import numpy as np

    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = False
        for k in keys[:-2]:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, new


def first_and_rest(one, two, doc, pos):
    """Of rows with equal (one, two): a mask of the first by (doc, pos), and one of those that come after it."""
    import numpy as np

    order, new = _groups(one, two, doc, pos)
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    first, rest = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    rest[order] = (doc[order] != doc[head]) | (pos[order] != pos[head])
    return first, rest


def several(one, two):
    """A mask of the rows whose `one` comes with more than one value of `two`."""
    import numpy as np

    if not len(one):
        return np.zeros(0, bool)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    stop = np.append(start[1:], len(a)) - 1
    out = np.zeros(len(a), bool)
    out[order] = np.repeat(b[start] != b[stop], stop - start + 1)
    return out


def _bucket_rows(buckets: int, kind: int, doc, pos, length, one, two):
    """Rows of ROUTED, one per bucket that occurs, with the columns packed."""
    import numpy as np

    where = (scramble(one + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.diff(where[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield (kind, int(where[part[0]]), doc[part].tobytes(), pos[part].astype(np.int32).tobytes(), length[part].astype(np.int32).tobytes(), one[part].tobytes(), two[part].tobytes())


def _aside(kind: int, doc, pos, length):
    """A batch of ROUTED with one row, of what needs no bucket."""
    import numpy as np

    packed = (doc.tobytes(), pos.astype(np.int32).tobytes(), length.astype(np.int32).tobytes())
    return _batch([(kind, -1, *packed, b"", b"")] if len(doc) else [], ROUTED)


def _batch(rows, names: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _chunks(docs):
    """Lists of (doc, offset in it, bytes) of about CHUNK_BYTES; a longer text comes in pieces that share DEPTH - 1 bytes."""
    held, size = [], 0
    for doc, text in docs:
        at = 0
        while True:
            piece = text[at : at + CHUNK_BYTES]
            if len(piece) >= DEPTH:
                held.append((doc, at, piece))
                size += len(piece)
                if size >= CHUNK_BYTES:
                    yield held
                    held, size = [], 0
            if at + CHUNK_BYTES >= len(text):
                break
            at += CHUNK_BYTES - DEPTH + 1
    if held:
        yield held


def _texts(batches, *more):
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("doc", "text", *more)], strict=True):
            yield (row[0], (row[1] or "").encode("utf-8", "surrogatepass"), *row[2:])


def _concat(parts, dtype):
    import numpy as np

    return np.concatenate(parts).astype(dtype, copy=False) if parts else np.zeros(0, dtype)


def _first_pass(buckets: int):
    """Documents to runs; what a share can decide alone is marked or set aside for refinement at once."""

    def run(batches):
        import numpy as np

        one, two = Hasher(1), Hasher(2)
        share, size = [], 0

        def settle():
            doc, pos, length = (_concat([s[i] for s in share], np.int64) for i in range(3))
            a, b = (_concat([s[i] for s in share], np.uint64) for i in (3, 4))
            first, rest = first_and_rest(a, b, doc, pos)
            yield _aside(MARK, doc[rest], pos[rest], length[rest])
            doc, pos, length, a, b = (x[first] for x in (doc, pos, length, a, b))
            torn = several(a, b)
            yield _aside(SPLIT, doc[torn], pos[torn], length[torn])
            # Of a torn anchor one row goes out, with length 0: it tells the bucket that the anchor is torn.
            seen, at = np.unique(a[torn], return_index=True)
            told = np.flatnonzero(torn)[at]
            whole = ~torn
            yield _batch(
                list(
                    _bucket_rows(
                        buckets, RUN, np.append(doc[whole], doc[told]), np.append(pos[whole], pos[told]), np.append(length[whole], np.zeros(len(seen), np.int64)), np.append(a[whole], seen), np.append(b[whole], b[told])
                    )
                ),
                ROUTED,
            )

        for chunk in _chunks(_texts(batches)):
            data = np.frombuffer(b"".join(c[2] for c in chunk), np.uint8)
            ends = np.cumsum([len(c[2]) for c in chunk])
            begins, length, a, b = runs_of(data, ends.tolist(), DEPTH, GRAM, one, two)
            of = np.searchsorted(ends, begins, side="right")
            shift = np.array([c[1] for c in chunk]) - np.append(0, ends[:-1])
            share.append((np.array([c[0] for c in chunk], np.int64)[of], begins + shift[of], length, a, b))
            size += len(data)
            if size >= SHARE_BYTES:
                yield from settle()
                share, size = [], 0
        if share:
            yield from settle()

    return run


def _by_bucket(batches, blocks: int, decide):
    """Gathers the rows of each bucket, which arrive together, and yields batches of FOUND with what decide makes of them.

    decide returns tuples (kind, doc, pos, length) of arrays. They are packed by block, a hash of
    the document, over many buckets.
    """
    import numpy as np

    held, bucket = [], None
    waiting, n = [], 0

    def settle():
        doc = np.frombuffer(b"".join(r[2] for r in held), np.int64)
        pos, length = (np.frombuffer(b"".join(r[i] for r in held), np.int32).astype(np.int64) for i in (3, 4))
        one = np.frombuffer(b"".join(r[5] for r in held), np.uint64)
        two = np.frombuffer(b"".join(r[6] for r in held), np.uint64 if sum(len(r[6]) for r in held) == 8 * len(one) else np.uint32)
        return decide(doc, pos, length, one, two)

    def flush():
        rows = []
        for kind in (MARK, SPLIT):
            doc, pos, length = (_concat([w[i] for w in waiting if w[0] == kind], np.int64) for i in (1, 2, 3))
            where = (scramble(doc.view(np.uint64) + np.uint64(1)) % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((pos, doc, where))
            doc, pos, length, where = doc[order], pos[order], length[order], where[order]
            # Windows that follow each other become one run.
            new = np.ones(len(doc), bool)
            if kind == MARK:
                new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + length[:-1])
            at = np.flatnonzero(new)
            length = np.add.reduceat(length, at) if len(at) else length
            doc, pos, where = doc[at], pos[at], where[at]
            cut = np.flatnonzero(np.diff(where)) + 1
            for part in np.split(np.arange(len(doc)), cut) if len(doc) else []:
                rows.append((int(where[part[0]]), kind, doc[part].tobytes(), pos[part].astype(np.int32).tobytes(), length[part].astype(np.int32).tobytes()))
        return _batch(rows, FOUND)

    for b in batches:
        for i in range(b.num_rows):
            r = tuple(b.column(c)[i].as_py() for c in range(b.num_columns))
            if r[0] != RUN:
                found = [(r[0], np.frombuffer(r[2], np.int64), *(np.frombuffer(x, np.int32).astype(np.int64) for x in r[3:5]))]
            else:
                found = []
                if bucket is not None and r[1] != bucket:
                    found = settle()
                    held = []
                bucket = r[1]
                held.append(r)
            waiting += found
            n += sum(len(f[1]) for f in found)
            if n >= FLUSH:
                yield flush()
                waiting, n = [], 0
    if held:
        waiting += settle()
    if waiting:
        yield flush()


def _second_pass(blocks: int):
    """Buckets of anchors to marks and splits."""

    def decide(doc, pos, length, one, two):
        import numpy as np

        torn = several(one, two)
        torn |= np.isin(one, np.unique(one[length == 0]))
        real = length > 0
        doc, pos, length, one, two, torn = (x[real] for x in (doc, pos, length, one, two, torn))
        first, rest = first_and_rest(one, two, doc, pos)
        split = first & torn
        return [(MARK, doc[rest], pos[rest], length[rest]), (SPLIT, doc[split], pos[split], length[split])]

    return lambda batches: _by_bucket(batches, blocks, decide)


def _last_pass(blocks: int):
    """Buckets of windows to marks."""

    def decide(doc, pos, length, one, two):
        _, rest = first_and_rest(one, two, doc, pos)
        return [(MARK, doc[rest], pos[rest], length[rest])]

    return lambda batches: _by_bucket(batches, blocks, decide)


def _regroup(batches):
    """Rows of FOUND, sorted by block, to one row of BY_DOC for each document and kind."""
    import numpy as np

    def settle(held):
        rows = []
        for kind in (MARK, SPLIT):
            doc = np.frombuffer(b"".join(r[2] for r in held if r[1] == kind), np.int64)
            pos, length = (np.frombuffer(b"".join(r[i] for r in held if r[1] == kind), np.int32) for i in (3, 4))
            order = np.lexsort((pos, doc))
            cut = np.flatnonzero(np.diff(doc[order])) + 1
            rows += [(int(doc[part[0]]), kind, pos[part].tobytes(), length[part].tobytes()) for part in (np.split(order, cut) if len(order) else [])]
        return _batch(rows, BY_DOC)

    held, block = [], None
    for b in batches:
        for i in range(b.num_rows):
            r = tuple(b.column(c)[i].as_py() for c in range(b.num_columns))
            if block is not None and r[0] != block:
                yield settle(held)
                held = []
            block = r[0]
            held.append(r)
    if held:
        yield settle(held)


def _spread(pos, length):
    """All positions of the runs, and the run that each belongs to."""
    import numpy as np

    of = np.repeat(np.arange(len(pos)), length)
    return pos[of] + np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length), of


def _window_pass(buckets: int):
    """Documents with runs to refine, to window fingerprints by bucket."""

    def run(batches):
        import numpy as np

        one, two = Hasher(3), Hasher(4)
        share, size = [], 0

        def settle():
            doc, pos = (_concat([s[i] for s in share], np.int64) for i in (0, 1))
            a, b = _concat([s[2] for s in share], np.uint64), _concat([s[3] for s in share], np.uint32)
            first, rest = first_and_rest(a, b, doc, pos)
            ones = np.ones(len(doc), np.int64)
            yield _aside(MARK, doc[rest], pos[rest], ones[rest])
            yield _batch(list(_bucket_rows(buckets, RUN, doc[first], pos[first], ones[first], a[first], b[first])), ROUTED)

        for doc, text, packed_pos, packed_len in _texts(batches, "pos", "len"):
            pos = np.frombuffer(b"".join(packed_pos), np.int32).astype(np.int64)
            length = np.frombuffer(b"".join(packed_len), np.int32).astype(np.int64)
            order = np.argsort(pos, kind="stable")
            pos, length = pos[order], length[order]
            data = np.frombuffer(text, np.uint8)
            at = 0
            while at < len(data):  # pieces of the text, each with the runs that begin in it
                here = slice(*np.searchsorted(pos, [at, at + CHUNK_BYTES]))
                p, n = pos[here], length[here]
                if len(p):
                    stop = int((p + n).max()) - 1 + DEPTH
                    piece = data[at:stop]
                    w, _ = _spread(p - at, n)
                    w = np.unique(w)
                    share.append((np.full(len(w), doc, np.int64), w + at, one.of(one.prefix(piece), w, DEPTH), (two.of(two.prefix(piece), w, DEPTH) & np.uint64(0xFFFFFFFF)).astype(np.uint32)))
                    size += len(w)
                    if size >= SHARE_WINDOWS:
                        yield from settle()
                        share, size = [], 0
                at += CHUNK_BYTES
        if share:
            yield from settle()

    return run


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_ranges(n: int, pos, length):
    """Begins and ends of the maximal stretches covered by windows that start in the runs (pos, length)."""
    import numpy as np

    order = np.argsort(pos, kind="stable")
    start, stop = pos[order], pos[order] + length[order] - 1 + DEPTH
    reach = np.maximum.accumulate(stop)
    new = np.append(True, start[1:] > reach[:-1])
    begins = start[new]
    ends = np.append(reach[np.flatnonzero(new)[1:] - 1], reach[-1])
    return begins, np.minimum(ends, n)


def _report(batches):
    import hashlib

    import numpy as np
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    for b in batches:
        rows = []
        for text, packed_pos, packed_len in zip(*[b.column(c).to_pylist() for c in ("text", "pos", "len")], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            removed = spans = 0
            kept = data
            if packed_pos:
                begins, ends = removed_ranges(len(data), *[np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (packed_pos, packed_len)])
                removed, spans = int((ends - begins).sum()), len(begins)
                cuts = zip(np.append(0, ends).tolist(), np.append(begins, len(data)).tolist(), strict=True)
                kept = b"".join(data[x:y] for x, y in cuts)
            rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(batches):
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(n, n + b.num_rows), pa.int64())], names=[*b.schema.names, "part", "no"])
        n += b.num_rows


def _keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc, doc_id, text) with one number per document that grows with doc_id, and the bytes of all texts."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = base.select("doc_id", F.xxhash64(text).alias("same"), F.octet_length(text).alias("n"))
    per_id = ids.groupBy("doc_id").agg(F.sum("n").alias("n"), (F.min("same") != F.max("same")).alias("differs"))
    total, differs = per_id.agg(F.sum("n"), F.max(F.col("differs") | F.col("doc_id").isNull())).first()
    if not differs:
        return base.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), "doc_id", "text"), total or 0
    rows = base.select("doc_id", F.sha2(text, 256).alias("same")).distinct()
    placed = materialize(
        rows.repartitionByRange(partitions(spark), "doc_id", "same").sortWithinPartitions("doc_id", "same").mapInArrow(_numbered, "doc_id long, same string, part int, no long"), "dedup-ids"
    )
    offsets, n = [], 0
    for part, count in sorted(placed.groupBy("part").count().collect()):  # one row per partition
        offsets.append((part, n))
        n += count
    numbers = placed.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").select("doc_id", "same", (F.col("no") + F.col("before")).alias("doc"))
    left = base.withColumn("same", F.sha2(text, 256))
    number = materialize(numbers, "dedup-numbers").select(F.col("doc_id").alias("number_id"), "same", "doc")
    joined = left.join(number, (left["doc_id"].eqNullSafe(number["number_id"])) & (left["same"] == number["same"]))
    return materialize(joined.select("doc", left["doc_id"], "text"), "dedup-docs"), total or 0


def dedup_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    keyed, total = _keyed(docs)
    tasks = max(partitions(docs.sparkSession), -(-total // TASK_BYTES))
    buckets = max(tasks, -(-total * 2 // ((DEPTH - GRAM + 1) * RUNS_PER_BUCKET)))
    # What needs no bucket travels with the runs, spread at random.
    spread = F.when(F.col("bucket") >= 0, F.col("bucket").cast("long")).otherwise(-1 - F.pmod(F.xxhash64("doc", "pos"), F.lit(1 << 40)))

    def routed(df: DataFrame, emit, decide) -> DataFrame:
        """One row per document and kind, through the buckets and then through blocks of documents."""
        sent = df.mapInArrow(released(emit), ROUTED).withColumn("to", spread).repartition(tasks, "to").sortWithinPartitions("to", "bucket").drop("to")
        return sent.mapInArrow(released(decide), FOUND).repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(released(_regroup), BY_DOC)

    first = materialize(routed(keyed.select("doc", "text"), _first_pass(buckets), _second_pass(buckets)), "dedup-runs")
    texts = keyed.select("doc", "doc_id", "text").repartition(tasks, "doc")
    packed = lambda df: df.repartition(tasks, "doc").groupBy("doc").agg(F.collect_list("pos").alias("pos"), F.collect_list("len").alias("len"))
    # The same columns as below, so that both joins can read one exchange of the texts.
    refined = texts.join(packed(first.where(F.col("kind") == SPLIT)), "doc").select("doc", "doc_id", "text", "pos", "len")
    marks = routed(refined, _window_pass(buckets), _last_pass(buckets)).unionByName(first.where(F.col("kind") == MARK))
    marked = texts.join(packed(marks), "doc", "left").select("doc_id", "text", "pos", "len")
    return marked.mapInArrow(released(_report), "doc_id long, " + REPORT)


def op1_suffix_dedup(spark, sf_dir):
    return dedup_windows(table(spark, sf_dir, "documents"))
