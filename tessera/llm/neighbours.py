"""The k most similar vectors of every vector, by shifted space-filling curves.

Equal unit vectors form one class, which is searched once for all its members. Each curve projects the unit vectors to a few dimensions (a rotation and shift
of its own within the principal subspace), quantises them and takes the Hilbert index as key. Short codes, not vectors, are range partitioned by (curve, key)
and numbered in that order; windows of equal numbers of positions, each with the positions just before and after it, are compared within, and the curves' lists
are merged. Then lists are refined by neighbours of neighbours. At last the vectors of the finalists are fetched and ranked by exact cosine, and members
take the smallest ids of the classes found. Positions, windows and groups depend on the rows alone, so the answer is the same for any partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import checked_join, materialise, positioned

DIM, K = 64, 5
#: Curves, principal dimensions they lie in, projected dimensions and bits of each; measured recall is in the README.
CURVES, PRINCIPAL, PROJECTED, BITS, SEED = 8, 24, 8, 7, 77
#: Positions in a window and on either side of it; rounds of refinement of up to 100,000 rows; length of the lists that are refined.
WINDOW, HALO, ROUNDS, KEEP = 256, 64, 2, 16
#: Candidates that a group of refinement passes on for each of its rows (a window passes on twice as many); rows that name a pivot in one group (more are spread over several groups).
OFFERED, CROWD = 4, 64
#: Most of a list that takes part in refinement; what a similarity of codes may be off (five standard errors of a byte a dimension).
EDGES, SLACK = 16, 6e-3


def rounds_for(rows: int) -> int:
    """Rounds of refinement for so many rows: one more for every tenfold of 100,000, since lists of curves alone get worse as a table grows."""
    return max(ROUNDS, int(np.ceil(np.log10(max(rows, 1)))) - 5 + ROUNDS)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of every row of an integer matrix with values below 2**bits (at most 63 bits in all)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the highest bit down
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) != 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(on, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, axes: np.ndarray, mean: np.ndarray, projected: int = PROJECTED, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Keys of unit vectors on one curve: a random rotation of the scaled principal ``axes``, shifted and quantised."""
    rng = np.random.default_rng([seed, curve])
    turn = np.linalg.qr(rng.normal(size=(axes.shape[1], min(projected, axes.shape[1]))))[0]
    z = np.round((unit - mean) @ axes @ turn / 6.0 + 0.5 + rng.uniform(-0.08, 0.08, turn.shape[1]), 9)
    return hilbert(np.clip(z * (1 << bits), 0, (1 << bits) - 1), bits)


def principal(classes: DataFrame, dim: int, most: int = PRINCIPAL) -> tuple[np.ndarray, np.ndarray]:
    """The principal axes of all unit vectors, scaled to the root of unit spread, and their mean.

    Every task sums the products of its rows in whole numbers, so the sums don't depend on the partitioning; a row per matrix cell is gathered
    (dim * (dim + 1) numbers, whatever the table's size).
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim + 1, dim), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                u = np.rint(_unit(_matrix(b.column(0).slice(at, 8192), dim)) * (1 << 15))
                total += (np.concatenate([u, np.ones((len(u), 1))], 1).T @ u).astype(np.int64)  # exact: below 2**53
                n += len(u)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "v"])

    cells = classes.select("vec").mapInArrow(sums, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toPandas().sort_values("cell")["v"].to_numpy()
    if not len(cells) or not cells[-1]:
        return np.eye(dim)[:, :most], np.zeros(dim)
    n, total = float(cells[-1]), cells[:-1].reshape(dim + 1, dim) / float(1 << 15)
    mean = total[dim] / n
    spread, axes = np.linalg.eigh(total[:dim] / (1 << 15) / n - np.outer(mean, mean))
    spread, axes = np.maximum(spread[::-1][:most], 1e-12), axes[:, ::-1][:, :most]
    axes = axes * np.where(np.abs(axes).max(axis=0) == axes.max(axis=0), 1.0, -1.0)
    return axes / np.sqrt(np.sqrt(spread)) / np.sqrt(np.sqrt(spread)).mean(), mean


def usable(vectors: DataFrame, dim: int = DIM, id_col: str = "chunk_no", vec_col: str = "vec") -> DataFrame:
    """``id, vec`` with one row per id: vectors of ``dim`` finite values that aren't all zero. Of several, the greatest array."""
    v = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.filter(ok).groupBy(F.col(id_col).alias("id")).agg(F.max(v).alias("vec"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares of very large and very small values finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_LIST = "id long, others binary, sims binary"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.Array]]:
    """Columns of sorted batches, cut so that rows that agree in the first ``keys`` columns stay together."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        same = np.ones(t.num_rows, bool)
        for k in range(keys):
            col = t.column(k).to_numpy()
            same &= col == col[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield [c.combine_chunks() for c in t.slice(0, cut).columns]
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.columns]


def _codes(col: pa.Array, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(ids: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """One row for each run of equal ids (sorted): its others and similarities as bytes."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(first, len(ids))[1:]
    o, s = others.astype(np.int64).tobytes(), sims.astype(np.float32).tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[first], pa.int64()), pa.array([o[8 * a : 8 * b] for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([s[4 * a : 4 * b] for a, b in zip(first, ends, strict=True)], pa.binary())],
        names=["id", "others", "sims"],
    )


def _unpacked(ids: np.ndarray, others: pa.Array, sims: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o, s = others.to_pylist(), sims.to_pylist()
    return np.repeat(ids, [len(x) // 8 for x in o]), np.frombuffer(b"".join(o), np.int64), np.frombuffer(b"".join(s), np.float32)


def _top(sim: np.ndarray, most: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the greatest ``most`` similarities of every row, masked ones (below -2) left out; ties go to the column of smaller rank."""
    if sim.shape[1] > most:
        col = np.argpartition(rank - (np.rint(sim * 1e5).astype(np.int64) << 20), most - 1, axis=1)[:, :most]
    else:
        col = np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
    value = np.take_along_axis(sim, col, 1)
    r, k = np.nonzero(value > -2)
    return r, col[r, k], np.round(value[r, k], 5)


def _windows(dim: int, window: int, offered: int):
    """Compares each window's own rows with all rows of its group. Columns: curve, window, pos, id, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for curve, win, pos, ids, code in _runs(batches, 2):
            curve, win, pos, ids, x = curve.to_numpy(), win.to_numpy(), pos.to_numpy(), ids.to_numpy(), _codes(code, dim)
            edge = np.flatnonzero(np.concatenate([[True], (win[1:] != win[:-1]) | (curve[1:] != curve[:-1])]))
            found = []
            for a, b in zip(edge, np.append(edge[1:], len(ids)), strict=True):
                own = a + np.flatnonzero(pos[a:b] // window == win[a])
                sim = x[own] @ x[a:b].T
                sim[np.arange(len(own)), own - a] = -9
                r, c, v = _top(sim, offered, np.argsort(np.argsort(ids[a:b])))
                found.append((ids[own][r], ids[a:b][c], v))
            yield _packed(*(np.concatenate(f) for f in zip(*found, strict=True)))

    return run


def _merge(keep: int):
    """Lists of one id, one list: the greatest ``keep`` similarities, each other id once. Columns: id, others, sims, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, sims in _runs(batches, 1):
            i, o, s = _unpacked(ids.to_numpy(), others, sims)
            group = np.cumsum(np.concatenate([[False], i[1:] != i[:-1]]))
            value = (s + np.float32(2)).view(np.uint32).astype(np.int64)  # positive floats sort like their bits
            order = np.lexsort((o, (group << 32) - value))
            i, o, s = i[order], o[order], s[order]
            fresh = np.concatenate([[True], (i[1:] != i[:-1]) | (o[1:] != o[:-1])])  # a pair has one value wherever it was met
            i, o, s = i[fresh], o[fresh], s[fresh]
            new = np.concatenate([[True], i[1:] != i[:-1]])
            place = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            yield _packed(i[place < keep], o[place < keep], s[place < keep])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        i, o, _ = _unpacked(b.column(0).to_numpy(), b.column(1), b.column(2))
        new = np.concatenate([[True], i[1:] != i[:-1]]) if len(i) else np.zeros(0, bool)
        use = np.arange(len(i)) - np.flatnonzero(new)[np.cumsum(new) - 1] < EDGES
        yield pa.RecordBatch.from_arrays([pa.array(i[use]), pa.array(o[use])], names=["id", "other"])


def _meet(dim: int, offered: int):
    """All members of a pivot's group meet; each takes what exceeds its floor. Columns: pivot, part, member, floor, code; groups of like size at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, part, member, floor, code in _runs(batches, 2):
            pivot, part, member, floor = pivot.to_numpy(), part.to_numpy(), member.to_numpy(), floor.to_numpy()
            new = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])])
            once = new | np.concatenate([[True], member[1:] != member[:-1]])
            x, member, floor, new = _codes(code.filter(pa.array(once)), dim), member[once], floor[once], new[once]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(member)))
            padded = -(-size // 8) * 8
            found = []
            for p in np.unique(padded):
                of = np.flatnonzero(padded == p)
                for some in np.array_split(of, -(-len(of) * p * p // 4_000_000)):
                    at = start[some][:, None] + np.arange(p)
                    there = np.arange(p) < size[some][:, None]
                    at = np.where(there, at, 0)
                    z = x[at]
                    sim = z @ z.transpose(0, 2, 1)
                    sim[:, np.arange(p), np.arange(p)] = -9
                    sim[~(there[:, :, None] & there[:, None, :])] = -9
                    sim[sim <= floor[at][:, :, None]] = -9
                    r, c, v = _top(sim.reshape(-1, p), offered, np.arange(p))  # members are sorted
                    found.append((member[at.ravel()[r]], member[at[r // p, c]], v))
            i, o, s = (np.concatenate(f) for f in zip(*found, strict=True))
            order = np.argsort(i, kind="stable")
            yield _packed(i[order], o[order], s[order])

    return run


def _refined(lists: DataFrame, codes: DataFrame, dim: int, keep: int) -> DataFrame:
    """One round: the rows that a pivot lists, those that list it and itself meet; what they find is merged into their lists.

    A pivot that more than CROWD rows list has several groups, each with its own share of them, so no group grows with the table.
    """
    edges = lists.mapInArrow(_edges, "id long, other long")
    parts = edges.groupBy(F.col("other").alias("pivot")).agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).filter("parts > 1")
    parts = materialise(parts, "parts")
    known = codes.join(lists.select("id", F.octet_length("others").alias("bytes"), "sims"), "id", "left").mapInArrow(_floors(keep), "id long, floor float, code binary")
    known = materialise(known, "known")
    own = known.select(F.col("id").alias("pivot"), F.col("id").alias("member"), "floor", "code")
    lists_it = edges.join(known, "id").select(F.col("other").alias("pivot"), F.col("id").alias("member"), "floor", "code")
    listed = edges.join(known.withColumnRenamed("id", "other"), "other").select(F.col("id").alias("pivot"), F.col("other").alias("member"), "floor", "code")
    spread_out = checked_join(lists_it, parts, "pivot", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"), F.lit(0)))
    in_all = checked_join(own.unionByName(listed), parts, "pivot", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
    cols = ["pivot", "part", "member", "floor", "code"]
    groups = spread_out.select(*cols).unionByName(in_all.select(*cols)).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    found = groups.mapInArrow(_meet(dim, OFFERED), _LIST)
    return materialise(lists.unionByName(found).repartition("id").sortWithinPartitions("id").mapInArrow(_merge(keep), _LIST), "lists")


def _floors(keep: int):
    """Adds the least similarity of a full list, -2 for others. Columns: id, code, bytes, sims."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            floor = [float(np.frombuffer(s, np.float32).min()) if s is not None and n == 8 * keep else -2.0 for n, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(floor, pa.float32()), b.column(1)], names=["id", "floor", "code"])

    return run


def _finalists(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, o, s = _unpacked(b.column(0).to_numpy(), b.column(1), b.column(2))
            if not len(i):
                continue
            new = np.concatenate([[True], i[1:] != i[:-1]])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            place, at = np.arange(len(i)) - first, np.minimum(first + k - 1, len(i) - 1)
            kth = np.where(i[at] == i, s[at], -2.0)
            use = (place < k) | (s >= kth - SLACK)
            yield pa.RecordBatch.from_arrays([pa.array(i[use]), pa.array(o[use])], names=["id", "other"])

    return run


def _cosines(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sim = np.einsum("ij,ij->i", _unit(_matrix(b.column(2), dim)), _unit(_matrix(b.column(3), dim)))  # in double precision
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(np.clip(sim, -1, 1), 12))], names=["id", "other", "similarity"])

    return run


def knn(vectors: DataFrame, k: int = K, dim: int = DIM, curves: int = CURVES, window: int = WINDOW, halo: int = HALO, rounds: int | None = None, keep: int = KEEP, id_col: str = "chunk_no", vec_col: str = "vec") -> DataFrame:
    """``id, other, similarity, rank``: the k most similar other vectors of every usable one, by cosine.

    Null, all-zero, too short and non-finite vectors take no part; a row delivered twice counts once; ties go to the smaller id; fewer than k others
    give fewer rows. Vectors whose unit vectors agree to 12 digits are one class: it is searched as one row, only its k + 1 smallest ids are gathered,
    and its members' neighbours within it are exact. A row is compared with ``window + 2 * halo`` rows on every curve and with some (2 * EDGES)**2 in a round,
    of which there are :func:`rounds_for` its size; what is shuffled are codes of a byte a dimension, and the vectors of about k finalists of every row.
    """
    keep = max(keep, k + 2)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes, mean = frame.value
        for b in batches:
            if b.num_rows:
                unit = _unit(_matrix(b.column(1), dim))
                raw = np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8).tobytes()  # the direction alone counts
                code = pa.array([raw[i : i + dim] for i in range(0, len(raw), dim)], pa.binary())
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(curve_keys(unit, c, axes, mean)), b.column(0), code], names=["curve", "key", "id", "code"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                same = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in _unit(_matrix(b.column(1), dim)).round(12) + 0.0]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), b.column(0), b.column(1)], names=["cls", "id", "vec"])

    rows = usable(vectors, dim, id_col, vec_col).select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    classed = materialise(rows.mapInArrow(classify, "cls binary, id long, vec array<float>"), "vectors")
    first = F.row_number().over(Window.partitionBy("cls").orderBy("id"))
    classes = classed.withColumn("r", first).filter(F.col("r") <= k + 1).groupBy("cls").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(classes, "classes")
    n = max(classes.count(), 1)
    frame = vectors.sparkSession.sparkContext.broadcast(principal(classes, dim))  # two small matrices
    placed = positioned(classes.select("id", "vec").mapInArrow(keys, "curve int, key long, id long, code binary"), ["curve", "key", "id"])
    pos = F.pmod("g", F.lit(n))  # every class has one place on every curve
    placed = placed.select("curve", "id", "code", pos.alias("pos"))
    reach = F.sequence(F.greatest(F.expr(f"(pos - {halo}) div {window}"), F.lit(0)), F.expr(f"(pos + {halo}) div {window}"))
    grouped = placed.select("curve", F.explode(reach).alias("win"), "pos", "id", "code").repartition("curve", "win").sortWithinPartitions("curve", "win", "pos")
    lists = grouped.mapInArrow(_windows(dim, window, 2 * OFFERED), _LIST).repartition("id").sortWithinPartitions("id").mapInArrow(_merge(keep), _LIST)
    lists = materialise(lists, "lists")
    codes = placed.filter("curve = 0").select("id", "code")
    for _ in range(rounds_for(n) if rounds is None else rounds):
        lists = _refined(lists, codes, dim, keep)
    vecs = classes.select("id", "vec")
    pairs = lists.mapInArrow(_finalists(k), "id long, other long").join(vecs.select(F.col("id").alias("other"), F.col("vec").alias("theirs")), "other").join(vecs, "id")
    found = pairs.select("id", "other", "vec", "theirs").mapInArrow(_cosines(dim), "id long, other long, similarity double")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    found = found.withColumn("rank", best).filter(F.col("rank") <= k)
    several = classes.filter(F.size("ids") > 1).select("cls", "id", "ids")
    if not several.limit(1).count():
        return found
    # the k best classes hold the k best rows, since each gives at least its smallest id
    others = found.join(several.select(F.col("id").alias("other"), "ids"), "other", "left").select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "similarity")
    own = several.select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("similarity"))
    near = materialise(others.unionByName(own).withColumn("rank", best).filter(F.col("rank") <= k + 1), "near")
    alone = near.join(several.select("id"), "id", "left_anti").filter(F.col("rank") <= k)
    lists = near.join(several.select("id"), "id", "left_semi").groupBy(F.col("id").alias("head")).agg(F.array_sort(F.collect_list(F.struct("rank", "other", "similarity"))).alias("near"))
    members = checked_join(classed.select("cls", "id"), several.select("cls", F.col("id").alias("head")), "cls")
    listed = checked_join(members, materialise(lists, "heads"), "head").select("id", F.posexplode(F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)).alias("at", "x"))
    return alone.select("id", "other", "similarity", "rank").unionByName(listed.select("id", "x.other", "x.similarity", (F.col("at") + 1).alias("rank")))


def close_pairs(neighbours: DataFrame, least: float = 0.9) -> DataFrame:
    """``chunk_a, chunk_b``, smaller first, once each: neighbours of at least the given similarity."""
    return neighbours.filter(F.col("similarity") >= least).select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()
