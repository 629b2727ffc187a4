"""Partitions of large graphs on arrays in mapped files.

The nodes are numbered in the order of their ids and the arcs lie as rows of numbers in raw files of the
scratch folder, a part for each range of numbers. A round of moves is one job: each task maps the arcs of its
own parts, holds the communities of all nodes and their masses, which lie in files too above HELD nodes, and
writes the new communities of its own nodes. The moves are those of communities.local_moves, with the same
result; levels of few pairs are finished by one task. The driver sees names of files and counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import communities as C
from .paths import HELD, PARTS, SHIFT, _mapped, _store, _vector
from .scratch import scratch_folder

ROWS = 1_000_000  # pairs that are numbered together
LOAD, NODE = 1_000_000, 16  # a part ends when its arcs, and so many for each node, come to LOAD
NAMES = 100_000  # rows of a batch of results


@dataclass(frozen=True)
class Space:
    """Where files lie, how many tasks share a pass, and above how many nodes vectors lie in files."""

    spark: object
    folder: str
    tasks: int
    held: int


@dataclass(frozen=True)
class Vector:
    """A vector over the nodes of a level, in files (first, name)."""

    kind: str
    n: int
    files: tuple


@dataclass(frozen=True)
class Level:
    """n numbers; bounds: where parts begin, and n; parts: (part, name, kind of the weights) in order; shares: the ranges of parts of the tasks."""

    n: int
    bounds: tuple
    parts: tuple
    shares: tuple
    pairs: int
    total: float


def _save(store, base: str, x, kind: str) -> str:
    import numpy as np

    name = uuid.uuid4().hex
    with store.open_output_stream(f"{base}/{name}") as f:
        f.write(np.ascontiguousarray(x, kind).data)
    return name


def _load(store, base: str, v: Vector, held: int, lo: int = 0, hi: int | None = None):
    """The numbers lo to hi of a vector."""
    hi = v.n if hi is None else hi
    out = _vector(hi - lo, v.kind, held)
    for i, (first, name) in enumerate(v.files):
        after = v.files[i + 1][0] if i + 1 < len(v.files) else v.n
        if first < hi and lo < after:
            x = _mapped(store, f"{base}/{name}", v.kind)
            a, b = max(lo, first), min(hi, after)
            out[a - lo : b - lo] = x[a - first : b - first]
    return out


def _jobs(space: Space, tasks: list, function, schema: str) -> list:
    """The rows that function(store, base, task) gives for each task."""
    folder = space.folder

    def run(batches):
        import pyarrow as pa

        store, base = _store(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                rows = list(function(store, base, tasks[i]))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types())], names)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [c.split()[1] for c in schema.split(", ")]

    def types():
        import pyarrow as pa

        return [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k] for k in kinds]

    return space.spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema).collect()


def _whole(kind: str, n: int, rows) -> Vector:
    return Vector(kind, n, tuple(sorted((r.first, r.name) for r in rows)))


def _drop(space: Space, *things) -> None:
    """Deletes the files of vectors and levels that are no longer read."""
    store, base = _store(space.folder)
    for x in things:
        for name in [f[1] for f in x.files] if isinstance(x, Vector) else [f"{name}.{end}" for _, name, _ in x.parts for end in ("at", "to", "w")] if x else []:
            store.delete_file(f"{base}/{name}")


def _rows(make) -> list:
    """The rows of make(), whose shuffles go with the query and not only when the driver collects its garbage."""
    conf, name = SparkSession.getActiveSession().conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return make().collect()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def _names(space: Space, ids: DataFrame, salt: int) -> tuple:
    """Files of ids (id, n) in their order, a tuple of (first, how many, name), how many ids, the bounds of parts, and whether the first id is null."""
    folder, load = space.folder, LOAD

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        name, files, at, so_far, rows, void, of, cuts = uuid.uuid4().hex, {}, 0, 0, 0, 0, None, [0]
        for b in batches:
            if not b.num_rows:
                continue
            if not files:
                files, of = {x: store.open_output_stream(f"{base}/{name}.{x}") for x in ("off", "str", "h", "bits")}, b.column(4)[0].as_py()
                files["off"].write(np.zeros(1, "<i8").data)
            void += b.column(0).null_count
            c = b.column(0).fill_null("").cast(pa.large_string())
            offsets = np.frombuffer(c.buffers()[1], "<i8")[c.offset : c.offset + len(c) + 1]
            files["off"].write(np.ascontiguousarray(offsets[1:] - offsets[0] + at).data)
            if offsets[-1] > offsets[0]:
                files["str"].write(c.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0])))
            at += int(offsets[-1] - offsets[0])
            for x, i in (("h", 1), ("bits", 2)):
                files[x].write(np.ascontiguousarray(np.asarray(b.column(i)), "<i8").data)
            full = so_far + np.cumsum(np.asarray(b.column(3)) + NODE)
            cuts += (np.flatnonzero(np.diff(full // load, prepend=so_far // load)) + rows + 1).tolist()
            so_far, rows = int(full[-1]), rows + len(c)
        for f in files.values():
            f.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (of, name, rows, void, cuts)], ["of", "name", "rows", "void", "cuts"])

    hashed = F.xxhash64(F.lit(salt), "id") if salt else F.xxhash64("id")
    ordered = ids.orderBy("id").select("id", hashed.alias("h"), F.xxhash64("id").alias("bits"), "n", F.spark_partition_id().cast("long").alias("of"))
    found, first, out = sorted(_rows(lambda: ordered.mapInArrow(write, "of long, name string, rows long, void long, cuts array<long>"))), 0, []
    bounds = []
    for r in found:
        out.append((first, r.rows, r.name))
        bounds += [first + x for x in r.cuts if x < r.rows]
        first += r.rows
    return tuple(out), first, (*bounds, first), any(r.void for r in found)


def _index(space: Space, names: tuple) -> list | None:
    """Files of the sorted hashes and their numbers (part, name); None if two ids share a hash."""
    folder = space.folder

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        for b in batches:
            for first, rows, name in (names[i] for i in b.column(0).to_pylist()):
                every = _mapped(store, f"{base}/{name}.h", "<i8")
                for at in range(0, rows, ROWS):
                    h = np.array(every[at : at + ROWS])
                    order = np.argsort(h)
                    h, v = h[order], (order + first + at).astype("<i4")
                    cut = np.searchsorted((h >> SHIFT) + PARTS // 2, np.arange(PARTS + 1))
                    there = np.flatnonzero(np.diff(cut))
                    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([h[cut[p] : cut[p + 1]].tobytes() for p in there]), pa.array([v[cut[p] : cut[p + 1]].tobytes() for p in there])], ["part", "h", "v"])

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        rows = []
        for p, (hs, vs) in _grouped(batches):
            h, v = np.concatenate([np.frombuffer(x, "<i8") for x in hs]), np.concatenate([np.frombuffer(x, "<i4") for x in vs])
            order = np.argsort(h)
            h = h[order]
            name = _save(store, base, h, "<i8")
            with store.open_output_stream(f"{base}/{name}.v") as f:
                f.write(v[order].data)
            rows.append((p, name, int((h[1:] == h[:-1]).sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["part", "name", "clashes"])

    dealt = space.spark.range(0, len(names), 1, len(names)).mapInArrow(deal, "part long, h binary, v binary")
    found = _rows(lambda: dealt.repartition(PARTS, "part").sortWithinPartitions("part").mapInArrow(write, "part long, name string, clashes long"))
    return None if any(r.clashes for r in found) else sorted((r.part, r.name) for r in found)


def _grouped(batches):
    """(part, columns of what was dealt to it) of batches in the order of parts."""
    part, kept = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != part:
                if kept:
                    yield part, list(zip(*kept, strict=True))
                part, kept = row[0], []
            kept.append(row[1:])
    if kept:
        yield part, list(zip(*kept, strict=True))


def _lookup(store, base: str, index: list):
    """A function from hashes to numbers, -1 for what has none."""
    import numpy as np

    files = {p: (_mapped(store, f"{base}/{name}", "<i8"), _mapped(store, f"{base}/{name}.v", "<i4")) for p, name in index}

    def numbers(h):
        u, back = np.unique(h, return_inverse=True)
        cut, out = np.searchsorted((u >> SHIFT) + PARTS // 2, np.arange(PARTS + 1)), np.full(len(u), -1, np.int64)
        for p in np.flatnonzero(np.diff(cut)):
            if p in files:
                x = slice(cut[p], cut[p + 1])
                at = np.minimum(np.searchsorted(files[p][0], u[x]), len(files[p][0]) - 1)
                out[x] = np.where(files[p][0][at] == u[x], files[p][1][at], -1)
        return out[back]

    return numbers


def _reduced(key, w, how: str):
    import numpy as np

    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[start], (np.maximum if how == "max" else np.add).reduceat(w[order], start)


def _kind(w) -> str:
    import numpy as np

    if ((w >= 0) & (w < 65536) & (w == np.floor(w))).all():
        return "u1" if w.max() < 256 else "<u2"
    return "<f4" if (w.astype("<f4") == w).all() else "<f8"


def _blobs(a, b, w, bounds: tuple, how: str):
    """Pairs as arcs in both directions, in a row for each part: (part, kind of the weights, steps of the sources, targets, weights)."""
    import numpy as np
    import pyarrow as pa

    rows = []
    if len(a):
        key, w = _reduced(np.minimum(a, b) << 32 | np.maximum(a, b), w, how)
        back = (key & 0xFFFFFFFF) << 32 | key >> 32
        apart = back != key
        key, w = np.concatenate([key, back[apart]]), np.concatenate([w, w[apart]])
        order = np.argsort(key)
        key, w = key[order], w[order]
        source = key >> 32
        cut = np.searchsorted(source, np.array(bounds))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            i, j = int(cut[p]), int(cut[p + 1])
            kind = _kind(w[i:j])
            rows.append((p, kind, np.diff(source[i:j], prepend=bounds[p]).astype("<u4").tobytes(), (key[i:j] & 0xFFFFFFFF).astype("<i4").tobytes(), w[i:j].astype(kind).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["part", "kind", "source", "target", "weight"])


DEALT = "part long, kind string, source binary, target binary, weight binary"


def _level(space: Space, dealt: DataFrame, n: int, bounds: tuple, how: str) -> Level:
    """The level of arcs dealt to its parts."""
    folder = space.folder

    def write(batches):
        import numpy as np
        import pyarrow as pa

        store, base = _store(folder)
        rows = []
        for p, (kinds, sources, targets, weights) in _grouped(batches):
            source = np.concatenate([np.cumsum(np.frombuffer(x, "<u4"), dtype=np.int64) for x in sources])
            key, w = source << 32 | np.concatenate([np.frombuffer(x, "<i4") for x in targets]), np.concatenate([np.frombuffer(x, k).astype("f8") for x, k in zip(weights, kinds, strict=True)])
            key, w = _reduced(key, w, how)
            source, target, kind = key >> 32, key & 0xFFFFFFFF, _kind(w)
            name = uuid.uuid4().hex
            for end, x in (("at", np.searchsorted(source, np.arange(bounds[p + 1] - bounds[p] + 1)).astype("<i8")), ("to", target.astype("<i4")), ("w", w.astype(kind))):
                with store.open_output_stream(f"{base}/{name}.{end}") as f:
                    f.write(x.data)
            once = source + bounds[p] <= target
            rows.append((p, name, kind, len(key), int(once.sum()), float(w[once].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64()))], ["part", "name", "kind", "arcs", "pairs", "weight"])

    many = len(bounds) - 1
    dealt = dealt.repartition(max(1, min(many, 1024)), "part").sortWithinPartitions("part")
    found = {r.part: r for r in _rows(lambda: dealt.mapInArrow(write, "part long, name string, kind string, arcs long, pairs long, weight double"))}
    # Ranges of parts of about as many arcs and nodes.
    load = [4 * (bounds[p + 1] - bounds[p]) + (found[p].arcs if p in found else 0) for p in range(many)]
    cuts, so_far = [0], 0
    for p, x in enumerate(load):
        if so_far >= sum(load) * len(cuts) / space.tasks and p > cuts[-1]:
            cuts.append(p)
        so_far += x
    shares = tuple(zip(cuts, [*cuts[1:], many], strict=True))
    return Level(n, bounds, tuple((p, r.name, r.kind) for p, r in sorted(found.items())), shares, sum(r.pairs for r in found.values()), sum(r.weight for r in found.values()))


def _ranges(level: Level) -> list:
    """(lo, hi, parts) of the tasks of a pass."""
    return [(level.bounds[x], level.bounds[y], tuple(p for p in level.parts if x <= p[0] < y)) for x, y in level.shares]


def _pieces(store, base: str, parts, bounds: tuple, piece: int):
    """(lo, hi, starts, targets, weights) of the arcs of parts, up to `piece` at a time, a node's together."""
    import numpy as np

    for p, name, kind in parts:
        at, to, w = _mapped(store, f"{base}/{name}.at", "<i8"), _mapped(store, f"{base}/{name}.to", "<i4"), _mapped(store, f"{base}/{name}.w", kind)
        lo, end = 0, bounds[p + 1] - bounds[p]
        while lo < end:
            hi = max(lo + 1, min(end, int(np.searchsorted(at, at[lo] + piece, "right")) - 1))
            arcs = slice(int(at[lo]), int(at[hi]))
            yield bounds[p] + lo, bounds[p] + hi, np.array(at[lo : hi + 1] - at[lo]), to[arcs], w[arcs].astype("f8")
            lo = hi


def _inside(v, other, fences):
    """Which arcs lie inside all fences: both ends in one field of 0 or more."""
    on = None
    for fence in fences:
        here = fence[v]
        one = (here == fence[other]) & (here >= 0)
        on = one if on is None else on & one
    return on


def _strength(space: Space, level: Level, fences: list, piece: int) -> tuple:
    """k of the nodes inside fences, whether they have arcs or loops there, the sum of k, how many nodes and how many pairs."""
    held, bounds, n = space.held, level.bounds, level.n

    def run(store, base, task):
        import numpy as np

        lo, hi, parts = task
        around = [_load(store, base, f, held) for f in fences]
        k, there, pairs = np.zeros(hi - lo), np.zeros(hi - lo, "u1"), 0
        for x, y, first, other, w in _pieces(store, base, parts, bounds, piece):
            v = np.repeat(np.arange(x, y), np.diff(first))
            if around:
                on = _inside(v, other, around)
                v, other, w = v[on], other[on], w[on]
            loop = v == other
            k[x - lo : y - lo] = np.bincount(v - x, np.where(loop, 2 * w, w), y - x)
            there[x - lo : y - lo] = np.bincount(v - x, minlength=y - x) > 0
            pairs += int((v <= other).sum())
        yield lo, _save(store, base, k, "<f8"), _save(store, base, there, "u1"), float(k.sum()), int(there.sum()), pairs

    rows = _jobs(space, _ranges(level), run, "first long, k string, there string, sum double, nodes long, pairs long")
    vector = lambda kind, c: Vector(kind, n, tuple(sorted((r.first, r[c]) for r in rows)))
    return vector("<f8", "k"), vector("u1", "there"), sum(r["sum"] for r in rows), sum(r.nodes for r in rows), sum(r.pairs for r in rows)


def _degree(space: Space, level: Level, home: Vector, piece: int) -> Vector:
    """How many arcs of each node lie inside its community."""
    held, bounds, n = space.held, level.bounds, level.n

    def run(store, base, task):
        import numpy as np

        lo, hi, parts = task
        community, degree = _load(store, base, home, held), np.zeros(hi - lo, "<i4")
        for x, y, first, other, _ in _pieces(store, base, parts, bounds, piece):
            v = np.repeat(np.arange(x, y), np.diff(first))
            degree[x - lo : y - lo] = np.bincount(v[(v != other) & (community[v] == community[other])] - x, minlength=y - x)
        yield lo, _save(store, base, degree, "<i4")

    return _whole("<i4", n, _jobs(space, _ranges(level), run, "first long, name string"))


def _mass(store, base: str, community, k: Vector, held: int):
    import numpy as np

    mass = _vector(k.n, "<f8", held)
    for at in range(0, k.n, 1 << 20):
        end = min(k.n, at + (1 << 20))
        np.add.at(mass, community[at:end], _load(store, base, k, held, at, end))
    return mass


def _moves(space: Space, level: Level, start: Vector, bits: Vector, fences: list, k: Vector, nodes: int, total: float, resolution: float, piece: int) -> Vector:
    """communities.local_moves(): the communities after rounds of moves inside fences; nodes: how many have arcs or loops."""
    held, bounds, n, labels, quiet = space.held, level.bounds, level.n, start, 0

    def rounds(labels, turn):
        def run(store, base, task):
            import numpy as np

            lo, hi, parts = task
            community, around = _load(store, base, labels, held), [_load(store, base, f, held) for f in fences]
            mass, own_k = _mass(store, base, community, k, held), _load(store, base, k, held, lo, hi)
            may = (_load(store, base, bits, held, lo, hi) >> turn) & 1 == 0
            after, moved = np.array(community[lo:hi]), 0
            for x, y, first, other, w in _pieces(store, base, parts, bounds, piece):
                # Those that may not move in this round need not be weighed.
                free = np.flatnonzero(may[x - lo : y - lo])
                on, v = np.repeat(may[x - lo : y - lo], np.diff(first)), np.repeat(np.arange(x, y), np.diff(first))
                on &= v != other
                if around:
                    on &= _inside(v, other, around)
                if not on.any():
                    continue
                go, target = C.best_moves(free + x, v[on], other[on], w[on], community, own_k[free + x - lo], mass, total, resolution)
                after[free[go] + x - lo] = target[go]
                moved += int(go.sum())
            yield lo, _save(store, base, after, "<i4"), moved

        return run

    for turn in range(C.ROUNDS):
        rows = _jobs(space, _ranges(level), rounds(labels, turn), "first long, name string, moved long")
        if turn:
            _drop(space, labels)
        labels = _whole("<i4", n, rows)
        quiet = quiet + 1 if sum(r.moved for r in rows) <= C.SETTLED * nodes else 0
        if quiet == 2:
            break
    return labels


def _count(space: Space, labels: Vector, real: Vector) -> int:
    """How many communities the real nodes are in."""
    held = space.held

    def run(store, base, _):
        import numpy as np

        there = _vector(labels.n, "u1", held)
        for at in range(0, labels.n, 1 << 20):
            end = min(labels.n, at + (1 << 20))
            there[_load(store, base, labels, held, at, end)[_load(store, base, real, held, at, end) > 0]] = 1
        yield (int(np.count_nonzero(there)),)

    return _jobs(space, [0], run, "n long")[0].n


def _compose(space: Space, member: Vector | None, found: Vector) -> Vector:
    """found of what a node of the graph lies in."""
    if member is None:
        return found
    held = space.held
    step = max(1, -(-member.n // space.tasks))

    def run(store, base, lo):
        whole = _load(store, base, found, held)
        yield lo, _save(store, base, whole[_load(store, base, member, held, lo, min(member.n, lo + step))], "<i4")

    return _whole("<i4", member.n, _jobs(space, list(range(0, member.n, step)), run, "first long, name string"))


def _contract(space: Space, level: Level, found: Vector, parts: Vector, bits: Vector, real: Vector, fences: list, piece: int) -> tuple:
    """(level, number there of each node, start, bits, real) of the nodes that parts make, each starting in the community of found it lies in."""
    held, bounds, n, every, load = space.held, level.bounds, level.n, level.parts, LOAD

    def run(store, base, _):
        import numpy as np

        community, part = _load(store, base, found, held), _load(store, base, parts, held)
        # Numbers without gaps, in the same order; communities may be named after numbers that are no node.
        mark = _vector(n, "u1", held)
        mark[part], mark[community] = 1, 1
        rank = _vector(n, "<i4", held)
        np.cumsum(mark, dtype="<i4", out=rank)
        rank -= 1
        size = int(rank[-1]) + 1
        to = _save(store, base, rank[part], "<i4")
        start, least, there = _vector(size, "<i4", held), _vector(size, "<i8", held), _vector(size, "u1", held)
        start[:], least[:] = size, np.iinfo(np.int64).max
        for at in range(0, n, 1 << 20):
            end = min(n, at + (1 << 20))
            on = np.flatnonzero(_load(store, base, real, held, at, end))
            p = rank[part[at:end][on]]
            np.minimum.at(start, p, rank[community[at:end][on]])
            np.minimum.at(least, p, _load(store, base, bits, held, at, end)[on])
            there[p] = 1
        none = np.flatnonzero(there == 0)
        start[none], least[none] = none, 0
        names = to, _save(store, base, start, "<i4"), _save(store, base, least, "<i8"), _save(store, base, there, "u1")
        least[:] = NODE
        for p, name, _ in every:
            np.add.at(least, rank[part[bounds[p] : bounds[p + 1]]], np.diff(_mapped(store, f"{base}/{name}.at", "<i8")))
        full = np.cumsum(least, out=least) // load
        yield size, *names, " ".join(map(str, [0, *(np.flatnonzero(np.diff(full)) + 1).tolist(), size]))

    row = _jobs(space, [0], run, "n long, to string, start string, bits string, real string, bounds string")[0]
    size, to = row.n, Vector("<i4", n, ((0, row.to),))
    shares, folder, wide = _ranges(level), space.folder, tuple(map(int, row.bounds.split()))

    def deal(batches):
        import numpy as np

        store, base = _store(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                new, around, kept, many = _load(store, base, to, held), [_load(store, base, f, held) for f in fences], [], 0
                for x, y, first, other, w in _pieces(store, base, shares[i][2], bounds, piece):
                    v = np.repeat(np.arange(x, y), np.diff(first))
                    on = v <= other
                    if around:
                        on &= _inside(v, other, around)
                    p, q = new[v[on]].astype(np.int64), new[other[on]].astype(np.int64)
                    key, w = _reduced(np.minimum(p, q) << 32 | np.maximum(p, q), w[on], "sum") if on.any() else (p, w[on])
                    kept.append((key, w))
                    many += len(key)
                    if many >= ROWS:
                        key, w = (np.concatenate(c) for c in zip(*kept, strict=True))
                        kept, many = [], 0
                        yield _blobs(key >> 32, key & 0xFFFFFFFF, w, wide, "sum")
                if kept:
                    key, w = (np.concatenate(c) for c in zip(*kept, strict=True))
                    yield _blobs(key >> 32, key & 0xFFFFFFFF, w, wide, "sum")

    dealt = space.spark.range(0, len(shares), 1, len(shares)).mapInArrow(deal, DEALT)
    vector = lambda kind, name: Vector(kind, size, ((0, name),))
    return _level(space, dealt, size, wide, "sum"), to, vector("<i4", row.start), vector("<i8", row.bits), vector("u1", row.real)


def _finish(space: Space, level: Level, start: Vector, bits: Vector, real: Vector, fences: list, total: float, resolution: float, refine: bool, levels: int, before: int | None, piece: int) -> Vector:
    """The last home of each node of a level of few pairs, in one task."""
    held, bounds, n, every = space.held, level.bounds, level.n, level.parts

    def run(store, base, _):
        import numpy as np

        around, kept = [_load(store, base, f, held) for f in fences], []
        for x, y, first, other, w in _pieces(store, base, every, bounds, piece):
            v = np.repeat(np.arange(x, y), np.diff(first))
            on = v <= other
            if around:
                on &= _inside(v, other, around)
            kept.append((v[on], other[on].astype(np.int64), w[on]))
        a, b, w = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        community = _load(store, base, start, held)
        nodes = np.flatnonzero(_load(store, base, real, held))
        names = np.unique(np.concatenate([nodes, community[nodes]]))
        at, own, low = np.searchsorted(names, nodes), np.arange(len(names), dtype=np.int32), np.zeros(len(names), np.int64)
        own[at], low[at] = np.searchsorted(names, community[nodes]), _load(store, base, bits, held)[nodes]
        ends = [np.searchsorted(names, x).astype(np.int32) for x in (a, b)]
        home = C._levels(ends[0], ends[1], w, at, own, low, total, resolution, refine, levels, before)
        out = _vector(n, "<i4", held)
        out[:] = community
        out[nodes] = names[home[at]]
        yield (_save(store, base, out, "<i4"),)

    return Vector("<i4", n, ((0, _jobs(space, [0], run, "name string")[0].name),))


def _partition(space: Space, graph: Level, single: Vector, bits: Vector, fence: Vector | None, resolution: float, refine: bool, few: int, piece: int) -> Vector:
    """The last home of each node, before communities fall apart into their connected parts; inside fence, if there is one."""
    level, start, member, before, real, total = graph, single, None, None, None, None
    for turn in range(C.LEVELS):
        fences = [fence] if fence and not turn else []
        k, there, mass, nodes, pairs = _strength(space, level, fences, piece)
        total = mass / 2 if total is None else total
        if not total:
            return single
        if real is None:
            real = there
        else:
            _drop(space, there)
        if pairs <= few:
            found = _finish(space, level, start, bits, real, fences, total, resolution, refine, C.LEVELS - turn, before, piece)
            home = _compose(space, member, found)
            break
        found = _moves(space, level, start, bits, fences, k, nodes, total, resolution, piece)
        _drop(space, k)
        size = _count(space, found, real)
        home = _compose(space, member, found)
        if size == before or turn == C.LEVELS - 1:
            break
        if member is not None:
            _drop(space, home)
        before, parts = size, found
        if refine:
            within = [*fences, found]
            k, there, _, nodes, _ = _strength(space, level, within, piece)
            own = single if level is graph else _counted(space, level.n)
            parts = _moves(space, level, own, bits, within, k, nodes, total, resolution, piece)
            _drop(space, k, there, *[own] * (level is not graph))
        after, to, *new = _contract(space, level, found, parts, bits, real, fences, piece)
        _drop(space, real, found, *[parts] * refine, *[start, bits, level] * (level is not graph))
        start, bits, real = new
        joined = _compose(space, member, to)
        if member is not None:
            _drop(space, member, to)
        level, member = after, joined
    if level is not graph:
        _drop(space, level)
    return home


def _counted(space: Space, n: int) -> Vector:
    """0, 1, 2 and so on."""

    def run(store, base, lo):
        import numpy as np

        yield lo, _save(store, base, np.arange(lo, min(n, lo + (1 << 22))), "<i4")

    return _whole("<i4", n, _jobs(space, list(range(0, n, 1 << 22)), run, "first long, name string"))


def _parts(space: Space, level: Level, home: Vector, piece: int) -> Vector:
    """The connected parts of communities, named after their smallest number: each name is hooked to its smallest neighbour, until none has one."""
    held, bounds, n, tasks = space.held, level.bounds, level.n, _ranges(level)
    names = _counted(space, n)

    def hook(names):
        def run(store, base, task):
            import numpy as np

            community, name, kept = _load(store, base, home, held), _load(store, base, names, held), []
            for x, y, first, other, _ in _pieces(store, base, task[2], bounds, piece):
                v = np.repeat(np.arange(x, y), np.diff(first))
                p, q = name[v], name[other]
                on = (q < p) & (community[v] == community[other])
                if on.any():
                    p, q = p[on].astype(np.int64), q[on].astype(np.int64)
                    key = np.sort(p << 32 | q)
                    p = key >> 32
                    kept.append(key[np.concatenate([[True], p[1:] != p[:-1]])])
            key = np.sort(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
            p = key >> 32
            key = key[np.concatenate([[True], p[1:] != p[:-1]])] if len(key) else key
            yield _save(store, base, key, "<i8"), len(key)

        return run

    def follow(names, files):
        def run(store, base, _):
            import numpy as np

            name = _load(store, base, names, held)
            for f in files:
                key = _mapped(store, f"{base}/{f}", "<i8")
                np.minimum.at(name, key >> 32, (key & 0xFFFFFFFF).astype("<i4"))
            while True:
                again = name[name]
                if (again == name).all():
                    break
                name = again
            yield 0, _save(store, base, name, "<i4")

        return run

    while True:
        rows = _jobs(space, tasks, hook(names), "name string, n long")
        files, before = [r.name for r in rows if r.n], names
        if files:
            names = _whole("<i4", n, _jobs(space, [0], follow(names, files), "first long, name string"))
            _drop(space, before)
        _drop(space, Vector("<i8", 0, tuple((0, r.name) for r in rows)))
        if not files:
            return names


def _select(space: Space, home: Vector, degree: Vector | None, limit: int) -> tuple:
    """(a fence around the communities to split, how many they are): those above limit, or with degree (arcs inside of each node) the large and loose ones."""
    held = space.held

    def run(store, base, _):
        import numpy as np

        community = _load(store, base, home, held)
        size = _vector(home.n, "<i8", held)
        np.add.at(size, community, 1)
        if degree is None:
            which = size > limit
        else:
            arcs = _vector(home.n, "<i8", held)
            np.add.at(arcs, community, _load(store, base, degree, held))
            which = (size >= C.COHESION_LEAST) & (arcs / 2 / np.maximum(size * (size - 1.0) / 2, 1.0) < C.COHESION_FLOOR)
        yield _save(store, base, np.where(which[community], community, -1), "<i4"), int(which.sum())

    row = _jobs(space, [0], run, "name string, n long")[0]
    return Vector("<i4", home.n, ((0, row.name),)), row.n


def _rejoin(space: Space, home: Vector, fence: Vector, parts: Vector) -> Vector:
    """parts inside the fence, home elsewhere."""
    held = space.held

    def run(store, base, _):
        import numpy as np

        yield 0, _save(store, base, np.where(_load(store, base, fence, held) >= 0, _load(store, base, parts, held), _load(store, base, home, held)), "<i4")

    return _whole("<i4", home.n, _jobs(space, [0], run, "first long, name string"))


class Partitioned:
    """Pairs (a, b, weight), numbered and laid out in files; of repeated pairs `how` (max or sum) counts."""

    def __init__(self, pairs: DataFrame, how: str):
        spark = pairs.sparkSession
        self.few, self.piece = C.LEVEL, C.SLICE
        ids = pairs.select(F.col("a").cast("string").alias("id")).union(pairs.select(F.col("b").cast("string"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        salt, index = 0, None
        while index is None:  # once more with another hash if two ids share one
            folder = f"{scratch_folder(spark)}/partition-{uuid.uuid4().hex}"
            store, base = _store(folder)
            store.create_dir(base)
            self.space = space = Space(spark, folder, max(6, 2 * spark.sparkContext.defaultParallelism), HELD)
            self.names, self.n, bounds, self.void = _names(space, ids, salt)
            if not self.n:
                self.level = None
                return
            if self.n >= 1 << 31:
                raise ValueError("numbers of nodes are held in 31 bits")
            index = _index(space, self.names)
            for _, _, name in self.names:
                store.delete_file(f"{base}/{name}.h")
            if index is None:
                salt += 1
        hashed = (lambda c: F.xxhash64(F.lit(salt), F.col(c).cast("string"))) if salt else (lambda c: F.xxhash64(F.col(c).cast("string")))

        def number(batches):
            import numpy as np

            store, base = _store(folder)
            numbers, kept, n = _lookup(store, base, index), [], 0

            def blobs():
                a, b, w = (np.concatenate(c) for c in zip(*kept, strict=True))
                p, q = np.split(numbers(np.concatenate([a, b])), 2)
                return _blobs(p, q, w, bounds, how)

            for b in batches:
                kept.append([np.asarray(c) for c in b.columns])
                n += b.num_rows
                if n >= ROWS:
                    yield blobs()
                    kept, n = [], 0
            if n:
                yield blobs()

        dealt = pairs.select(hashed("a").alias("a"), hashed("b").alias("b"), F.col("weight").cast("double").alias("weight")).mapInArrow(number, DEALT)
        self.level = _level(space, dealt, self.n, bounds, how)
        self.bits = Vector("<i8", self.n, tuple((first, f"{name}.bits") for first, _, name in self.names))
        for _, name in index:
            store.delete_file(f"{base}/{name}")
            store.delete_file(f"{base}/{name}.v")

    def partition(self, resolution: float, refine: bool, split_of: int | None = None) -> Vector:
        """The communities of the nodes; with split_of the large and loose ones are split as communities.split_large and split_loose do."""
        space, level, piece = self.space, self.level, self.piece
        single = _counted(space, self.n)
        home = _parts(space, level, _partition(space, level, single, self.bits, None, resolution, refine, self.few, piece), piece)
        for what in ("large", "loose") if split_of is not None else ():
            degree = _degree(space, level, home, piece) if what == "loose" else None
            fence, n = _select(space, home, degree, max(10, int(split_of * 0.25)))
            if n:
                again = _partition(space, level, single, self.bits, fence, resolution, True, self.few, piece)
                home = _rejoin(space, home, fence, _parts(space, level, again, piece))
        _drop(space, level)
        return home

    def rows(self, home: Vector | None = None) -> DataFrame:
        """(id, community) of the communities home, or (id)."""
        folder, names, void, held = self.space.folder, self.names, self.void, self.space.held

        def run(batches):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            store, base = _store(folder)
            files = {}

            def of(numbers):
                u, back = np.unique(numbers, return_inverse=True)
                cut, out = np.searchsorted(u, [first for first, _, _ in names] + [names[-1][0] + names[-1][1]]), []
                for i in np.flatnonzero(np.diff(cut)):
                    first, rows, name = names[i]
                    if i not in files:
                        files[i] = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(_mapped(store, f"{base}/{name}.off", "<i8")), pa.py_buffer(_mapped(store, f"{base}/{name}.str", "u1")))
                    out.append(files[i].take(pa.array(u[cut[i] : cut[i + 1]] - first)))
                found = pa.concat_arrays(out).take(pa.array(back)).cast(pa.string())
                return pc.if_else(pa.array(numbers == 0), pa.scalar(None, pa.string()), found) if void else found

            for b in batches:
                for first, rows, _ in (names[i] for i in b.column(0).to_pylist()):
                    for at in range(first, first + rows, NAMES):
                        end = min(first + rows, at + NAMES)
                        columns = [of(np.arange(at, end))] + ([of(_load(store, base, home, held, at, end))] if home else [])
                        yield pa.RecordBatch.from_arrays(columns, ["id", "community"][: len(columns)])

        many = len(names)
        return self.space.spark.range(0, many, 1, many).mapInArrow(run, "id string, community string" if home else "id string")
