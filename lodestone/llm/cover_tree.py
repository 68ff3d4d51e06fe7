"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

On the unit sphere, cosine >= c means a distance of at most ``sqrt(2 - 2c)``. The
vectors of a label are cut in cells around pivots, the top of the tree: points of
the data, each the farthest from those before. Pairs of cells go on if their
covering radii, and the planes between their pivots, let them hold a pair that close. In a task,
the vectors of a cell form nested nets with halving radii, and pairs of nodes
descend together: a pair whose centres are farther apart than the threshold and
both radii is pruned, and one whose centres and radii stay inside the threshold
links all its vectors without listing them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, releasing
from .components import connected_components

SLACK = 1e-9
PIVOTS = 128


class CoverTree:
    """Nested nets over unit vectors. ``levels[k]`` has centres (row numbers), their covering radii, and for each node of the level above where its children lie."""

    def __init__(self, x: np.ndarray, top: float = 1.0, depth: int = 4) -> None:
        self.x = x
        n = len(x)
        order = np.arange(n)
        bounds = np.array([0, n])
        self.starts: list[np.ndarray] = [bounds]
        self.centres: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.radii: list[np.ndarray] = [np.array([2.0])]
        self.children: list[np.ndarray] = []
        radius = top / 2
        for _ in range(depth):
            new_bounds, centres, radii, kids = [0], [], [], [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                groups = _net(x, order[lo:hi], radius)
                at = lo
                for members, centre, r in groups:
                    order[at : at + len(members)] = members
                    at += len(members)
                    new_bounds.append(at)
                    centres.append(centre)
                    radii.append(r)
                kids.append(len(centres))
            bounds = np.array(new_bounds)
            self.starts.append(bounds)
            self.centres.append(np.array(centres, np.int64))
            self.radii.append(np.array(radii))
            self.children.append(np.array(kids))
            radius /= 2
            if len(bounds) == n + 1:
                break
        self.order = order


def _net(x, members, radius):
    """Greedy net: ``(members, centre, covering radius)`` of each ball. Close pairs are found by one matrix product for each block of candidates."""
    if len(members) == 1:
        return [(members, members[0], 0.0)]
    left = np.ones(len(members), bool)
    v = x[members]
    limit = 1 - radius * radius / 2  # least cosine inside the ball
    out = []
    for lo in range(0, len(members), 1024):
        block = np.arange(lo, min(lo + 1024, len(members)))
        block = block[left[block]]
        if not len(block):
            continue
        rest = np.flatnonzero(left)
        near = v[block] @ v[rest].T >= limit
        lonely = near.sum(1) == 1
        for i in np.flatnonzero(lonely):
            left[block[i]] = False
            out.append((members[block[i] : block[i] + 1], members[block[i]], 0.0))
        for i in np.flatnonzero(~lonely):
            if left[block[i]]:
                mine = rest[near[i] & left[rest]]
                left[mine] = False
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (v[mine] @ v[block[i]])))
                out.append((members[mine], members[block[i]], float(d.max())))
    return out


def dual_traversal(a: CoverTree, b: CoverTree, least: float):
    """Yield ``(rows of a, rows of b, whole)``: linked pairs, or two sets all of whose pairs are linked. With ``a is b`` a pair comes once, and a set may come with itself."""
    t = np.sqrt(2 - 2 * least)
    stack = [(0, 0, 0, 0)]  # level and node of each
    while stack:
        i, p, j, q = stack.pop()
        mirrored = a is b and i == j and p == q
        # the finer one waits
        ka = a.children[i][p : p + 2] if i < len(a.children) else None
        kb = b.children[j][q : q + 2] if j < len(b.children) else None
        if ka is None and kb is None:
            yield from _leaves(a, i, p, b, j, q, least, mirrored)
            continue
        if ka is None or (kb is not None and not mirrored and b.radii[j][q] > a.radii[i][p]):
            us, ui = np.array([p]), i
        else:
            us, ui = np.arange(*ka), i + 1
        if mirrored:
            vs, vj = us, ui
        elif us[0] == p and ui == i and kb is not None:
            vs, vj = np.arange(*kb), j + 1
        else:
            vs, vj = np.array([q]), j
        cu, ru = a.x[a.centres[ui][us]], a.radii[ui][us]
        for lo in range(0, len(vs), 2048):
            part = vs[lo : lo + 2048]
            cv, rv = b.x[b.centres[vj][part]], b.radii[vj][part]
            for mo in range(0, len(us), 2048):
                if mirrored and lo + 2048 <= mo:
                    continue
                cosine = cu[mo : mo + 2048] @ cv.T
                reach = t + ru[mo : mo + 2048, None] + rv[None, :] + SLACK
                close = cosine >= np.where(reach < 2, 1 - reach * reach / 2, -2)
                for r, c in zip(*np.nonzero(close), strict=True):
                    u, w = int(us[mo + r]), int(part[c])
                    if mirrored and u > w:
                        continue
                    na, nb = _size(a, ui, u), _size(b, vj, w)
                    if na == 1 and nb == 1:
                        if not (mirrored and u == w):
                            yield from _leaves(a, ui, u, b, vj, w, least, False)
                        continue
                    d = float(np.sqrt(max(0.0, 2 - 2 * cosine[r, c]))) + a.radii[ui][u] + b.radii[vj][w]
                    if d + SLACK <= t:
                        yield _rows(a, ui, u), _rows(b, vj, w), True
                    else:
                        stack.append((ui, u, vj, w))


def _size(tree, i, p):
    return int(tree.starts[i][p + 1] - tree.starts[i][p])


def _rows(tree, i, p):
    return tree.order[tree.starts[i][p] : tree.starts[i][p + 1]]


def _leaves(a, i, p, b, j, q, least, mirrored):
    ra, rb = _rows(a, i, p), _rows(b, j, q)
    for lo in range(0, len(ra), 2048):
        hit = np.einsum("ik,jk->ij", a.x[ra[lo : lo + 2048]], b.x[rb]) >= least if len(ra) * len(rb) < 64 else a.x[ra[lo : lo + 2048]] @ b.x[rb].T >= least
        r, c = np.nonzero(hit)
        r += lo
        if mirrored:
            r, c = r[r < c], c[r < c]
        if len(r):
            yield ra[r], rb[c], False


def _unit(least: float):
    def run(batches):
        at, held = None, []

        def close():
            code = pa.concat_arrays([h[0] for h in held])
            copies = np.concatenate([h[1] for h in held]).astype(np.int64)
            block = np.concatenate([h[2] for h in held])
            x = np.concatenate([h[3] for h in held])
            n = len(code)
            links, up = np.zeros(n, np.int64), np.arange(n)

            def find(i):
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            def union(i, j):
                i, j = find(i), find(j)
                up[max(i, j)] = min(i, j)

            i, j = at[1], at[2]
            if i == j:
                tree = CoverTree(x)
                found = dual_traversal(tree, tree, least)
                sides = (np.arange(n), np.arange(n))
            else:
                sides = (np.flatnonzero(block == i), np.flatnonzero(block == j))
                if not len(sides[0]) or not len(sides[1]):
                    return None
                found = dual_traversal(CoverTree(x[sides[0]]), CoverTree(x[sides[1]]), least)
            for ra, rb, whole in found:
                ra, rb = sides[0][ra], sides[1][rb]
                if not whole:
                    np.add.at(links, ra, copies[rb])
                    np.add.at(links, rb, copies[ra])
                    for p, q in zip(ra.tolist(), rb.tolist(), strict=True):
                        union(p, q)
                elif i == j and len(ra) == len(rb) and (ra == rb).all():
                    links[ra] += copies[ra].sum() - copies[ra]
                    for q in ra.tolist():
                        union(q, int(ra[0]))
                else:
                    links[ra] += copies[rb].sum()
                    links[rb] += copies[ra].sum()
                    for q in [*ra.tolist(), *rb.tolist()]:
                        union(q, int(ra[0]))
            root = np.array([find(k) for k in range(n)])
            some = links > 0
            return pa.RecordBatch.from_arrays([code.filter(pa.array(some)), code.take(pa.array(root[some])), pa.array(links[some])], names=["a", "b", "links"])

        for batch in batches:
            label, i, j, copies, block = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4, 5))
            flat = batch.column(6)
            cuts = np.flatnonzero((label[1:] != label[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(label)], strict=True):
                if hi == lo:
                    continue
                key = (label[lo], int(i[lo]), int(j[lo]))
                if key != at and held:
                    if (made := close()) is not None:
                        yield made
                    held = []
                at = key
                held.append((batch.column(3).slice(lo, hi - lo), copies[lo:hi], block[lo:hi], flat.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)))
        if held and (made := close()) is not None:
            yield made

    return run


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; what isn't a vector gets None."""
    out: list[np.ndarray | None] = []
    for v in column:
        v = v.as_py()
        u = None
        if v and None not in v:
            x = np.array(v, float)
            norm = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
            if norm > 0 and np.isfinite(norm):
                u = x / norm
        out.append(u)
    return out


def _prepared(batches):
    for batch in batches:
        units = [None if u is None else u.tolist() for u in _units(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "x"])


def far_points(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it: every prefix is the top of a cover tree."""
    chosen, cosine = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        at = int(cosine.argmin())
        if cosine[at] >= 1 - SLACK:
            break
        chosen.append(at)
        cosine = np.maximum(cosine, x @ x[at])
    return x[chosen]


def data_pivots(classes: DataFrame, sample: int = 4096) -> dict[int, np.ndarray]:
    """For each number of components the pivots, from a sample of at most ``sample`` vectors: those whose codes come first."""
    rows = classes.select("code", "x").orderBy("code").limit(sample).collect()  # bounded: sample
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["x"]), []).append(r["x"])
    return {dim: far_points(np.array(x), PIVOTS) for dim, x in by.items()}


def _placed(pivots: dict[int, np.ndarray], least: float):
    """The cell of each vector, how far it lies from the cell's pivot, and the cells that may hold a vector it links with.

    Those in another cell lie beyond the plane halfway between the two pivots;
    cells whose plane is farther than the threshold are left out.
    """
    t = float(np.sqrt(2 - 2 * least)) + SLACK

    def run(batches):
        for batch in batches:
            power = batch.column(1).to_numpy()
            flat = batch.column(2)
            cell, reach, visits = np.zeros(len(power), np.int64), np.full(len(power), 2.0), [None] * len(power)
            dims = pa.compute.list_value_length(flat).to_numpy(zero_copy_only=False)
            for dim, k in {(int(d), int(p)) for d, p in zip(dims, power, strict=True)}:
                rows = np.flatnonzero((dims == dim) & (power == k))
                p = pivots.get(dim, np.zeros((0, dim)))[: 1 << k]
                if k == 0 or not len(p):
                    for r in rows:
                        visits[r] = [0]
                    continue
                x = flat.take(pa.array(rows)).flatten().to_numpy().reshape(-1, dim)
                apart = np.sqrt(np.maximum(SLACK, 2 - 2 * (p @ p.T)))
                cosine = x @ p.T
                own = cosine.argmax(1)
                most = np.take_along_axis(cosine, own[:, None], 1)
                cell[rows] = own
                reach[rows] = np.sqrt(np.maximum(0, 2 - 2 * most[:, 0]))
                may = (most - cosine) / apart[own] <= t
                may[np.arange(len(rows)), own] = True
                for r, m in zip(rows, may, strict=True):
                    visits[r] = np.flatnonzero(m).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(reach), pa.array(visits, pa.list_(pa.int64()))], names=["code", "cell", "reach", "visits"])

    return run


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", *, least: float = 0.93, block: int = 8192) -> DataFrame:
    """One row for each input row: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null, they have the same
    number of components, and their cosine in double precision is ``least`` or
    more. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label, link with nothing and keep their own
    component. ``n_links`` counts the other rows that a row links with; equal
    unit vectors are one vector with copies, so a group of copies is never
    expanded. Repeated rows are copies. Null identifiers never name a component
    unless nothing else is there. An empty table gives an empty result; further
    columns, with whatever names, are ignored.

    A label with over ``block`` vectors is cut in cells around pivots, and cells
    in blocks. Two blocks meet if the balls and the planes between their pivots
    let them, with only those vectors that the planes let go.
    """
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"), F.col(label).alias("label"))
    kind = source.schema["label"].dataType.simpleString()
    ready = materialize(
        source.mapInArrow(releasing(_prepared), f"vec_id long, label {kind}, x array<double>")
        .withColumn("code", F.when(F.col("x").isNotNull() & F.col("label").isNotNull(), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("x"))), 256))),
        "cover-vectors",
    )
    linked = ready.where("code is not null")
    # of 256 bits, codes stand for label and vector all through
    classes = linked.groupBy("code").agg(F.min("vec_id").alias("lowest"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("x").alias("x"))
    classes = materialize(classes.withColumn("dim", F.size("x")), "cover-classes")
    pivots = data_pivots(classes)
    group = ["label", "dim"]
    sizes = classes.groupBy(*group).agg(F.count("*").alias("n"))
    # as many cells as blocks, a power of two, up to the number of pivots
    power = F.least(F.lit(int(np.log2(PIVOTS))), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / block)))).cast("int")
    sizes = sizes.withColumn("power", power).drop("n")
    placed = classes.join(sizes, group).select("code", "power", "x", "label", "dim")
    where = placed.select("code", "power", "x").mapInArrow(releasing(_placed(pivots, least)), "code string, cell long, reach double, visits array<long>")
    member = materialize(where.join(classes.select("code", "label", "dim", "copies", "x"), "code"), "cover-placed")
    cells = materialize(member.groupBy(*group, "cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")), "cover-cells")
    cells = cells.withColumn("slices", F.ceil(F.col("n") / block).cast("int"))
    member = member.join(cells.select(*group, "cell", "slices"), [*group, "cell"]).withColumn("block", F.col("cell") * 1000003 + F.pmod(F.xxhash64("code"), F.col("slices")))
    blocks = cells.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).select(*group, "cell", "radius", (F.col("cell") * 1000003 + F.col("slice")).alias("block"))
    other = blocks.select(*group, F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("block").alias("block2"))
    reach = float(np.sqrt(2 - 2 * least)) + SLACK
    far = [(dim, i, j, float(np.sqrt(max(0.0, 2 - 2 * c)))) for dim, p in pivots.items() for i, row in enumerate(p @ p.T) for j, c in enumerate(row)]
    apart = vectors.sparkSession.createDataFrame(far or [(0, 0, 0, 0.0)], "dim int, cell long, cell2 long, apart double")  # bounded: PIVOTS squared for each number of components of the sample
    pairs = blocks.join(other, group).where(F.col("block") <= F.col("block2")).join(apart, ["dim", "cell", "cell2"], "left")
    pairs = pairs.where(F.coalesce("apart", F.lit(0.0)) <= F.col("radius") + F.col("radius2") + reach)
    ends = [*group, F.col("block").alias("i"), F.col("block2").alias("j")]
    sides = pairs.select("block", F.col("cell2").alias("to"), *ends).unionByName(pairs.where("block <> block2").select(F.col("block2").alias("block"), F.col("cell").alias("to"), *ends))
    units = member.join(sides, [*group, "block"]).where(F.array_contains("visits", F.col("to")))
    units = units.withColumn("unit", F.concat_ws("|", "dim", F.col("label").cast("string")))
    keys = ["unit", "i", "j"]
    found = units.select(*keys, "code", "copies", "block", "x").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(releasing(_unit(least)), "a string, b string, links long")
    found = materialize(found, "cover-links")
    counts = found.groupBy(F.col("a").alias("code")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("a", "b")).withColumnRenamed("node", "code")
    named = classes.select("code", "lowest", "copies").join(counts, "code", "left").join(parts, "code", "left").withColumn("component", F.coalesce("component", "code"))
    names = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = named.join(names, "component").select("code", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    rows = ready.select("vec_id", F.coalesce("code", F.concat(F.lit("-"), F.col("vec_id").cast("string"))).alias("code"))
    return rows.join(named, "code", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )
