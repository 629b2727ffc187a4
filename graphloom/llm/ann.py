"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each codebook. Codebooks
are trained one after the other, by k-means on what the earlier ones leave over, on a sample of at
most TRAIN_ROWS vectors (those with the smallest hash of their id). Encoding keeps the BEAM best
partial sums per vector. The index holds each vector's codes and the squared norm of its
approximation, so that one table of query-codeword products scores by inner product, distance or
cosine. Each task scores the codes of its vectors for a block of queries by table lookup, reranks the
SHORTLIST best of every BLOCK_ROWS exactly in double precision, and hands on its k best; a window
merges them.

Every vector is indexed and scored, and the shortlists grow with the input. Queries are searched for
a block at a time, and a block's answers are written before the next is read.

Defined results: which vectors take part is said in `usable`, and vectors of different lengths are
searched apart, with codebooks of their own; ties go to the smaller vec_id; fewer candidates than k
give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import materialize, table
from .vectors import Found, lengths, matrix, query_blocks, search_all, usable

BOOKS = 16
WORDS = 256
BEAM = 3
TRAIN_ROWS = 8192
TRAIN_STEPS = 6
SHORTLIST = 160
BLOCK_ROWS = 4096  # a shortlist for every so many vectors
SEED = 7


def train(sample):
    """BOOKS codebooks as an array (book, word, dimension)."""
    import numpy as np

    rng, left, books = np.random.default_rng(SEED), np.asarray(sample, np.float32).copy(), []
    for _ in range(BOOKS):
        words = left[rng.choice(len(left), min(WORDS, len(left)), replace=False)].copy()
        for step in range(TRAIN_STEPS):
            near = (left @ words.T * 2 - (words**2).sum(axis=1)).argmax(axis=1)
            if step < TRAIN_STEPS - 1:
                n = np.bincount(near, minlength=len(words))
                order = np.argsort(near, kind="stable")
                some = np.flatnonzero(n)
                words[some] = np.add.reduceat(left[order], np.cumsum(n)[some] - n[some], axis=0) / n[some, None]
        left -= words[near]
        books.append(words)
    return np.stack(books)


def encode(vectors, books):
    """Codes (row, book) by beam search, and the squared norm of what they add up to."""
    import numpy as np

    x = np.asarray(vectors, np.float32)
    n, width = len(x), min(BEAM, books.shape[1])
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    rows = np.arange(n)[:, None]
    for words in books:
        beams = left.shape[1]
        error = (left**2).sum(axis=2, keepdims=True) - 2 * (left.reshape(-1, x.shape[1]) @ words.T).reshape(n, beams, -1) + (words**2).sum(axis=1)
        flat = error.reshape(n, -1)
        keep = np.argpartition(flat, width - 1, axis=1)[:, :width]
        beam, word = keep // len(words), keep % len(words)
        left = left[rows, beam] - words[word]
        codes = np.concatenate([codes[rows, beam], word[:, :, None].astype(np.uint8)], axis=2)
    first = (left**2).sum(axis=2).argmin(axis=1)
    rest = left[np.arange(n), first]
    return codes[np.arange(n), first], ((x - rest) ** 2).sum(axis=1)


def build_index(rows: DataFrame, n: int) -> tuple[DataFrame, object]:
    """The vectors of length n with codes and norm2 as a written table, and the codebooks."""
    import numpy as np

    rows = rows.where(F.col("n") == n)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(TRAIN_ROWS).select("v").toArrow()
    books = train(np.concatenate([matrix(c) for c in sample.column("v").chunks if len(c)]))
    sent = rows.sparkSession.sparkContext.broadcast(books)  # BOOKS * WORDS codewords, whatever the input

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                codes, norm2 = encode(matrix(part.column("v")), sent.value)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "vec_id", "v")], packed, pa.array(norm2.astype(np.float64))], names=["row", "vec_id", "v", "codes", "norm2"])

    return materialize(rows.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, v array<double>, codes binary, norm2 double"), "ann-index"), books


def search(measure: str = "inner"):
    """The function that gives the k best of a task's vectors for every query, exactly scored."""

    def task(sent, k: int):
        def run(batches):
            import numpy as np

            (rows, ids, queries), books = sent.value
            asked = np.asarray(queries, np.float32)
            found = Found(len(ids), k, np.float64)
            for b in (whole.slice(i, BLOCK_ROWS) for whole in batches for i in range(0, whole.num_rows, BLOCK_ROWS)):
                row, vec_ids, v = (b.column("row").to_numpy(zero_copy_only=False), b.column("vec_id").to_numpy(zero_copy_only=False), matrix(b.column("v")))
                codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(len(v), -1).T.copy()
                norm2 = b.column("norm2").to_numpy(zero_copy_only=False).astype(np.float32)
                exact2 = (v**2).sum(axis=1)
                for at in range(0, len(ids), 32):
                    tables = np.einsum("qd,mwd->qmw", asked[at : at + 32], books, optimize=True)
                    for j, lookup in enumerate(tables):
                        q = at + j
                        near = lookup[0].take(codes[0])
                        for m in range(1, len(codes)):
                            near += lookup[m].take(codes[m])
                        if measure == "l2":
                            near = 2 * near - norm2
                        elif measure == "cosine":
                            near = near / np.sqrt(np.maximum(norm2, 1e-30))
                        short = np.argpartition(-near, SHORTLIST)[: SHORTLIST + 1] if len(near) > SHORTLIST + 1 else np.arange(len(near))
                        short = short[row[short] != rows[q]]
                        score = v[short] @ queries[q]
                        if measure == "l2":
                            score = 2 * score - exact2[short] - (queries[q] ** 2).sum()
                        elif measure == "cosine":
                            score = score / np.sqrt(exact2[short] * (queries[q] ** 2).sum())
                        found.add(q, vec_ids[short], score)
            yield from found.batches(rows, ids)

        return run

    return task


def nearest(vectors: DataFrame, k: int = 20, modulus: int = 20, measure: str = "inner") -> DataFrame:
    """query_id, rank, vec_id and score: for each row whose id is divisible by modulus, the k nearest others found."""
    rows = usable(vectors, False, "ann-rows")

    def searches():
        for n, _ in lengths(rows):
            index, books = build_index(rows, n)
            for queries in query_blocks(rows.where(F.col("n") == n), n, modulus):
                yield index, queries, books

    return search_all(searches(), search(measure), k, "double", vectors.sparkSession)


def op3_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))
