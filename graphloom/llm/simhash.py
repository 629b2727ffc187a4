"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. A segment, filled up to 23 bits,
is decoded by the perfect binary Golay code: every word has one codeword within distance 3 (its
own), and a word at distance 3 has five more at distance 4. Two facts follow. If two words differ in
one bit, the own codeword of either is among the codewords within distance 4 of the other. If they
differ in two, there is a word between them, whose own codeword both have within distance 4.

Of four differing bits in three segments, either two segments have at most one each, or one has none
and the others two each. So a fingerprint gets these keys, at most 51:

* for each pair of segments, (any near codeword, own codeword) and (own codeword, any near one);
* for each segment, its bits as they are and any near codeword of the next segment.

Fingerprints with a common key are compared exactly. Equal fingerprints count once. A bucket is
searched breadth first: a step compares some members with those not yet reached and hands on only
the edges by which members are first reached, so a bucket of m fingerprints yields fewer than m
edges, and tight groups are done in few steps. No link between components of a bucket is lost.

Defined results: a null or blank text has fingerprint 0; a null doc_id takes part, but a component's
id is the smallest doc_id that is not null (null if there is none); repeated rows are answered each;
an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .support import materialize, release_memory, released, spare, table

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
BLOCK = 256
HASHES = 1 << 17  # unpacked at once


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, unsigned."""
    import numpy as np
    import xxhash

    digest, seed, width = xxhash.xxh64_intdigest, SEED, SHINGLE
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size) - 1
    start = stop - size + 1
    if len(words) > width:
        start, stop = start[: 1 - width], stop[width - 1 :]
    else:
        start, stop = start[:1], stop[-1:]
    n = len(start)
    found = np.fromiter((digest(joined[i:j], seed) for i, j in zip(start.tolist(), stop.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, HASHES):
        part = found[i : i + HASHES]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(texts):
    """Series of texts to a series of signed fingerprints; equal texts of a batch are hashed once."""
    import numpy as np
    import pandas as pd

    known: dict = {}
    out = np.empty(len(texts), np.uint64)
    for i, t in enumerate(texts):
        if t not in known:
            known[t] = fingerprint(t)
        out[i] = known[t]
    return pd.Series(out.view(np.int64))


def fingerprint_column(column):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                yield _fingerprints(texts)
        finally:
            release_memory()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(column)


class Golay:
    """The own codeword of every 23-bit word, and the further ones at distance 4, as 12-bit indices."""

    def __init__(self):
        from itertools import combinations

        import numpy as np

        def syndrome(word: int) -> int:
            for bit in range(22, 10, -1):
                if word >> bit & 1:
                    word ^= GENERATOR << (bit - 11)
            return word

        self.of_index = np.array([syndrome(i << 11) for i in range(4096)], np.int64)
        single = [syndrome(1 << i) for i in range(23)]
        self.leader = np.zeros(2048, np.int64)
        further: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(1, 5):
            for bits in combinations(range(23), weight):
                s = word = 0
                for i in bits:
                    s, word = s ^ single[i], word | 1 << i
                if weight < 4:
                    self.leader[s] = word
                else:
                    further[s].append(word)
        self.further = np.full((2048, 5), -1, np.int64)
        for s, words in enumerate(further):
            if len(words) == 5:
                self.further[s] = words

    def near(self, words):
        """Indices of the codewords within distance 4, own first, -1 where there is none: an array of six columns."""
        import numpy as np

        s = self.of_index[words >> 11] ^ (words & 0x7FF)
        more = self.further[s]
        found = np.empty((len(words), 6), np.int64)
        found[:, 0] = (words ^ self.leader[s]) >> 11
        found[:, 1:] = np.where(more < 0, -1, (words[:, None] ^ more) >> 11)
        return found


def keys_of(prints, code: Golay):
    """Keys of unsigned fingerprints: an array with a row each, -1 where there is no key."""
    import numpy as np

    words = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = [code.near(w) for w in words]
    out = []
    for family, (i, j) in enumerate(((0, 1), (1, 2), (2, 0))):
        both = lambda x, y, family=family: np.where((x < 0) | (y < 0), -1, (family << 40) | (x << 12) | y)
        out += [both(near[i], near[j][:, :1]), both(near[i][:, :1], near[j][:, 1:])]
        whole = words[i][:, None]
        out.append(np.where(near[j] < 0, -1, ((3 + family) << 40) | (whole << 12) | near[j]))
    return np.concatenate(out, axis=1)


def _emit_keys(batches):
    import numpy as np
    import pyarrow as pa

    code = Golay()
    for b in batches:
        prints = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(prints), 20_000):
            part = prints[i : i + 20_000]
            keys = keys_of(part.view(np.uint64), code)
            yes = keys >= 0
            yield pa.RecordBatch.from_arrays([pa.array(keys[yes]), pa.array(np.repeat(part, yes.sum(axis=1)))], names=["key", "fp"])


def bucket_edges(prints):
    """Edges that connect what links of at most RADIUS bits connect among distinct fingerprints."""
    import numpy as np

    left = prints
    edges = []
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            step, frontier = frontier[:BLOCK], frontier[BLOCK:]
            reached = np.full(len(left), -1, np.int64)
            for i in range(0, len(left), 1 << 14):
                close = np.bitwise_count(step[:, None] ^ left[None, i : i + (1 << 14)]) <= RADIUS
                hit = close.any(axis=0)
                reached[i : i + (1 << 14)][hit] = close[:, hit].argmax(axis=0)
            new = reached >= 0
            edges.append((step[reached[new]], left[new]))
            frontier, left = np.concatenate([frontier, left[new]]), left[~new]
    return edges


def _links(batches):
    """Rows (key, fp) sorted by key to edges (a, b) between linked fingerprints."""
    import numpy as np
    import pyarrow as pa

    def settle(keys, prints):
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        found = []
        for m in (2, 3, 4, 5, 6, 7, 8):  # small buckets, all of one size at once
            rows = start[size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    a, b = prints[rows + i], prints[rows + j]
                    near = np.bitwise_count(a ^ b) <= RADIUS
                    found.append((a[near], b[near]))
        for at, m in zip(start[size > 8].tolist(), size[size > 8].tolist(), strict=True):
            found += bucket_edges(np.unique(prints[at : at + m]))
        if not found:
            return
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])

    held_keys, held_prints, n = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held_keys.append(b.column(0).to_numpy(zero_copy_only=False))
        held_prints.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        n += b.num_rows
        if n < 200_000:
            continue
        keys, prints = np.concatenate(held_keys), np.concatenate(held_prints)
        cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
        if cut:
            yield from settle(keys[:cut], prints[:cut])
        held_keys, held_prints = [keys[cut:]], [prints[cut:]]
        n = 0
    if held_keys:
        keys, prints = np.concatenate(held_keys), np.concatenate(held_prints)
        if len(keys):
            yield from settle(keys, prints)


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of prints (columns fp and doc_id), as a written table."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    keyed = distinct.select("fp").mapInArrow(released(_emit_keys), "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    roots = connected_components(keyed.mapInArrow(released(_links), "a long, b long"))
    rooted = materialize(distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    return materialize(rooted.join(ids, "root").select("fp", "component_id"), "simhash-components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text").cast("string")).alias("fp")), "simhash-prints")
    found = prints.join(fingerprint_components(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each component one row with the smallest doc_id.

    A group is a component of linked fingerprints, as in near_duplicates. Of random texts of 100 to 200
    words whose five-word shingles are 0.8 or more alike, a third to nine tenths lie more than RADIUS
    bits apart, the more the less alike they are; such copies stay unless a third text links them.

    A component whose ids are all null keeps one row as well. Columns are those of docs.
    """
    row, print_ = spare(docs, "__row"), spare(docs, "__fp")
    printed = materialize(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(print_, fingerprint_column(F.col("text").cast("string"))), "simhash-docs")
    prints = printed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(print_).alias("fp"), F.col(row).alias("row"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row"))
    per_print = materialize(prints.groupBy("fp").agg(F.min(first).alias("first")), "simhash-firsts")
    component = F.coalesce(F.col("component_id"), F.lit(-1 << 63))
    kept = per_print.join(fingerprint_components(prints), "fp").groupBy(component.alias("component")).agg(F.min("first").alias("first"))
    # The hashed side is row numbers; texts are neither sorted nor held.
    rows = materialize(kept.select(F.col("first.row").alias(row)), "simhash-kept")
    return printed.join(rows.hint("shuffle_hash"), row, "left_semi").select(docs.columns)


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
