"""Dependencies of shortest paths on arrays.

The nodes are numbered in order of a hash, the arcs written as rows of numbers in raw files of the scratch
folder, and each task counts the paths of its own sources one after another. Files are mapped, so of the
graph's size a task holds only vectors over the nodes, and those lie in files too above HELD nodes. Work is
the arcs once out and once back a source, however many steps a path has; the driver sees counts and names.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import scratch_folder, written

PARTS = 64  # files of the index and of the arcs; a power of two
SHIFT = 64 - PARTS.bit_length() + 1
HELD = 1 << 24  # nodes up to which vectors are held in memory
ROWS = 200_000  # edges that are numbered together
PIECE = 1 << 19  # arcs that are looked at together
BLOCK = 1 << 16  # numbers in a row of totals
UNSEEN, MET = 3, 4  # levels of nodes not reached, and of those that the present step reaches
TASKS = 12  # at most; each hands over a number per node


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def _mapped(store, path: str, kind: str):
    """An array over a file; one of a distant store is copied to a temporary file that has no name."""
    import numpy as np
    from pyarrow import fs

    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.TemporaryFile() as copy, store.open_input_stream(path) as f:
        while part := f.read(1 << 24):
            copy.write(part)
        copy.flush()
        return np.memmap(copy, kind, "r")


def _vector(n: int, kind: str, held: int):
    import numpy as np

    if n <= held:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+")


def _hashes(c, salt: int):
    """Two independent hashes of an id: the first gives its number, the second tells ids apart that share the first."""
    return F.xxhash64(F.lit(2 * salt), c), F.xxhash64(F.lit(2 * salt + 1), c)


def _index(ids: DataFrame, salt: int, folder: str) -> list[tuple] | None:
    """Per part (first number, how many, name) of files of the sorted hashes of ids (id); None if two ids share the first hash."""

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        part = name = last = None
        files, rows = [], []
        for b in batches:
            h, g = (np.asarray(c) for c in b.columns)
            if not len(h):
                continue
            before = np.concatenate([[h[0] if last is None else last[0]], h[:-1]]), np.concatenate([[g[0] if last is None else last[1]], g[:-1]])
            new = h != before[0]
            if last is None:
                new[0] = True
            clash = int((~new & (g != before[1])).sum())
            last = h[-1], g[-1]
            h, g = h[new], g[new]
            p = (h >> SHIFT) + PARTS // 2
            for q in np.unique(p):
                if q != part:
                    for f in files:
                        f.close()
                    part, name = q, uuid.uuid4().hex
                    files = [store.open_output_stream(f"{base}/{name}.{x}") for x in "hg"]
                    rows.append([int(q), name, 0, 0])
                for f, x in zip(files, (h, g), strict=True):
                    f.write(np.ascontiguousarray(x[p == q]).data)
                rows[-1][2] += int((p == q).sum())
            if rows:
                rows[-1][3] += clash
        for f in files:
            f.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["part", "name", "n", "clashes"])

    h, g = _hashes(F.col("id"), salt)
    rows = ids.where("id is not null").select(h.alias("h"), g.alias("g")).repartition(2 * PARTS, F.shiftright("h", SHIFT)).sortWithinPartitions("h", "g")
    found = sorted(rows.mapInArrow(write, "part long, name string, n long, clashes long").collect())  # a row per part
    if any(r.clashes for r in found):
        return None
    names, first = {r.part: r for r in found}, 0
    out = []
    for p in range(PARTS):
        out.append((first, names[p].n if p in names else 0, names[p].name if p in names else None))
        first += out[-1][1]
    return out


def _lookup(index: list[tuple], folder: str):
    """A function from hashes to numbers, -1 for an id that has none."""
    import numpy as np

    store, base = _store(folder)
    files = [(first, *(_mapped(store, f"{base}/{name}.{x}", "<i8") for x in "hg")) if name else None for first, _, name in index]

    def numbers(h, g):
        u, back = np.unique(h, return_inverse=True)
        cut = np.searchsorted((u >> SHIFT) + PARTS // 2, np.arange(PARTS + 1))
        out, of = np.full(len(u), -1, np.int64), np.zeros(len(u), np.int64)
        for p, file in enumerate(files):
            if file and cut[p] < cut[p + 1]:
                x = slice(cut[p], cut[p + 1])
                at = np.minimum(np.searchsorted(file[1], u[x]), len(file[1]) - 1)
                out[x], of[x] = np.where(file[1][at] == u[x], file[0] + at, -1), file[2][at]
        return np.where(of[back] == g, out[back], -1)

    return numbers


def _arcs(edges: DataFrame, index: list[tuple], salt: int, folder: str, width: int) -> list:
    """Files of the distinct arcs in both directions, a part for each `width` numbers: (part, name) of where a number's arcs start, and their targets. Part -1: some end has no number."""

    def number(batches):
        import numpy as np
        import pyarrow as pa

        numbers, kept, n = _lookup(index, folder), [], 0

        def keys():
            hs, gs, ht, gt = (np.concatenate(c) for c in zip(*kept, strict=True))
            a, b = np.split(numbers(np.concatenate([hs, ht]), np.concatenate([gs, gt])), 2)
            k = np.unique(np.where((a < 0) | (b < 0), -1, np.concatenate([(a << 32) | b, (b << 32) | a]).reshape(2, -1)))
            return pa.RecordBatch.from_arrays([pa.array(k)], ["k"])

        for batch in batches:
            kept.append([np.asarray(c) for c in batch.columns])
            n += batch.num_rows
            if n >= ROWS:
                yield keys()
                kept, n = [], 0
        if n:
            yield keys()

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        part = target = degrees = None
        rows, last, missing = [], -1, 0

        def close():
            target.close()
            with store.open_output_stream(f"{base}/{rows[-1][1]}.at") as f:
                f.write(np.concatenate([[0], np.cumsum(degrees)]).astype("<i8").data)

        for b in batches:
            k = np.asarray(b.column(0))
            missing += int((k < 0).sum())
            k = k[k >= 0]
            if not len(k):
                continue
            new = k != np.concatenate([[last], k[:-1]])
            last = k[-1]
            k = k[new]
            source = k >> 32
            p = source // width
            for q in np.unique(p):
                if q != part:
                    if target is not None:
                        close()
                    part, degrees = q, np.zeros(width, np.int64)
                    rows.append((int(q), uuid.uuid4().hex))
                    target = store.open_output_stream(f"{base}/{rows[-1][1]}.to")
                here = p == q
                s = source[here] - q * width
                degrees[s[0] : s[-1] + 1] += np.bincount(s - s[0])
                target.write((k[here] & 0xFFFFFFFF).astype("<i4").data)
        if target is not None:
            close()
        rows += [(-1, "")] if missing else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string()))], ["part", "name"])

    ends = edges.where("source <> target").select(*[x.alias(f"{c}{i}") for c in ("source", "target") for i, x in enumerate(_hashes(F.col(c), salt))])
    keys = ends.mapInArrow(number, "k long").repartition(2 * PARTS, F.expr(f"shiftright(k, 32) div {width}")).sortWithinPartitions("k")
    return [(r.part, r.name) for r in keys.mapInArrow(write, "part long, name string").collect()]  # a row per part


def _shares(nodes, parts: dict, width: int):
    """Sorted numbers by the part that they lie in: (begin, end, starts and targets of the part's arcs, the number it begins with)."""
    import numpy as np

    bounds = np.minimum(np.arange(PARTS + 1) * width, np.iinfo(nodes.dtype).max).astype(nodes.dtype)  # of the same type, else the level is copied
    cut = np.searchsorted(nodes, bounds)
    for p in np.flatnonzero(np.diff(cut)):
        if p in parts:
            yield int(cut[p]), int(cut[p + 1]), parts[p], p * width


def _pieces(own, start, target, piece: int):
    """(first, length of each one's share, targets) of up to `piece` arcs of a part's numbers at a time; a node's arcs may be shared out."""
    import numpy as np

    first = start[own]
    cum = np.concatenate([[0], np.cumsum(start[own + 1] - first)])
    first = first - cum[:-1]
    for at in range(0, int(cum[-1]), piece):
        end = min(at + piece, int(cum[-1]))
        i, j = int(np.searchsorted(cum, at, "right")) - 1, int(np.searchsorted(cum, end, "left"))
        length = np.minimum(cum[i + 1 : j + 1], end) - np.maximum(cum[i:j], at)
        yield i, length, target[np.arange(at, end) + np.repeat(first[i:j], length)]


def _add_owed(source: int, parts: dict, width: int, level, paths, order, total, piece: int) -> None:
    """total += what source owes to each node but itself. level is UNSEEN and paths 0 everywhere, before and after.

    level holds distances modulo 3, which tells a node's neighbours apart: they are one nearer, as near, or one farther.
    Levels are gone through a part at a time, so nothing besides the four vectors grows with the nodes of a level.
    """
    import numpy as np

    level[source], paths[source], order[0] = 0, 1.0, source
    ends, few = [0, 1], len(level) // 64
    while ends[-1] > ends[-2]:
        level_nodes, fresh, n, end = order[ends[-2] : ends[-1]], [], 0, ends[-1]
        for x, y, (start, target), low in _shares(level_nodes, parts, width):
            here = level_nodes[x:y]
            for i, length, w in _pieces(here - low, start, target, piece):
                on = level[w] >= UNSEEN
                w = w[on]
                np.add.at(paths, w, np.repeat(paths[here[i : i + len(length)]], length)[on])
                w = w[level[w] == UNSEEN]
                level[w] = MET
                n += len(w)
                if n <= few:
                    fresh.append(w)
        # Few are sorted, many are found by a look at all.
        if n <= few:
            found = [np.unique(np.concatenate(fresh))] if fresh else []
        else:
            fresh, found = [], (np.flatnonzero(level[low : low + width] == MET) + low for low in range(0, len(level), width))
        for new in found:
            level[new] = (len(ends) - 1) % 3
            order[end : end + len(new)] = new
            end += len(new)
        ends.append(end)
    last = len(ends) - 3  # of the last level that has nodes
    for d in range(last, 0, -1):
        level_nodes = order[ends[d] : ends[d + 1]]
        for x, y, (start, target), low in _shares(level_nodes, parts, width):
            here = level_nodes[x:y]
            due = np.zeros(len(here))
            for i, length, w in _pieces(here - low, start, target, piece) if d < last else ():
                on = np.flatnonzero(level[w] == (d + 1) % 3)
                share = np.zeros(len(w))
                share[on] = paths[w[on]]
                due[i : i + len(length)] += np.add.reduceat(share, np.concatenate([[0], np.cumsum(length)[:-1]]))
            own = paths[here]
            due *= own
            total[here] += due
            paths[here] = (1 + due) / own  # what the level before needs of this one
    if ends[-1] > len(level) // 4:
        level[:], paths[:] = UNSEEN, 0.0
    else:
        level[order[: ends[-1]]], paths[order[: ends[-1]]] = UNSEEN, 0.0


def dependencies(nodes: DataFrame, edges: DataFrame, sources: list[str], piece: int = PIECE, held: int = HELD) -> DataFrame | None:
    """(id, total) of nodes, null off the shortest undirected paths from sources; None without sources.

    total sums, over the sources, Brandes' dependency on the node; a source owes itself nothing. An id given twice as a source counts twice.
    """
    spark = nodes.sparkSession
    ids, whole, at, salts = nodes.select("id"), False, None, count()
    while True:
        salt = next(salts)
        folder = f"{scratch_folder(spark)}/paths-{uuid.uuid4().hex}"
        store, base = _store(folder)
        store.create_dir(base)
        at = _index(ids, salt, folder)
        if at is None:  # two ids share a 64-bit hash: once more with another
            store.delete_dir(base)
            continue
        n = at[-1][0] + at[-1][1]
        if n >= 1 << 31:
            raise ValueError("numbers of nodes are held in 31 bits")
        width = max(1, -(-n // PARTS))
        arcs = _arcs(edges, at, salt, folder, width)
        if whole or all(p >= 0 for p, _ in arcs):
            break
        # Some ends are no nodes, but paths go through them.
        store.delete_dir(base)
        ids, whole = ids.union(edges.select("source")).union(edges.select("target")), True
    tasks = min(len(sources), TASKS, max(2, spark.sparkContext.defaultParallelism))
    h, g = _hashes(F.col("id"), salt)
    keys = [(r.h, r.g) for r in spark.createDataFrame([(s,) for s in sources], "id string").select(h.alias("h"), g.alias("g")).collect()] if sources else []

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        for mine in [t for b in batches for t in b.column(0).to_pylist()]:
            store, base = _store(folder)
            parts = {p: (_mapped(store, f"{base}/{name}.at", "<i8"), _mapped(store, f"{base}/{name}.to", "<i4")) for p, name in arcs}
            own = np.array(keys[mine::tasks], np.int64).reshape(-1, 2)
            numbers = _lookup(at, folder)(own[:, 0], own[:, 1])
            level, paths, order, total = (_vector(n, k, held) for k in ("i1", "f8", "i4", "f8"))
            level[:] = UNSEEN
            for s in numbers[numbers >= 0]:
                _add_owed(int(s), parts, width, level, paths, order, total, piece)
            del level, paths, order
            for i in range(0, n, BLOCK):
                if total[i : i + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i : i + BLOCK].tobytes()])], ["first", "totals"])

    def add_up(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        held_at, have = None, None

        def rows():
            out = []
            for first, size, name in at:
                lo, hi = max(first, held_at), min(first + size, held_at + len(have))
                if lo < hi:
                    out.append(_mapped(store, f"{base}/{name}.h", "<i8")[lo - first : hi - first])
            on = have > 0
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)[on]), pa.array(have[on])], ["h", "total"])

        for b in batches:
            for first, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                more = np.frombuffer(part.as_buffer(), "<f8")
                if first == held_at:
                    have += more
                    continue
                if have is not None:
                    yield rows()
                held_at, have = first, more.copy()
        if have is not None:
            yield rows()

    if not sources or not n:
        store.delete_dir(base)
        return None
    blocks = spark.range(0, tasks, 1, tasks).mapInArrow(walk, "first long, totals binary")
    out = written(blocks.repartition("first").sortWithinPartitions("first").mapInArrow(add_up, "h long, total double"), "owed")
    store.delete_dir(base)
    return nodes.select("id", h.alias("h")).join(out, "h", "left").select("id", "total")
