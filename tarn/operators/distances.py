"""Distances between vectors: pairs, samples of pairs, blocks, and the Gram form for dense tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared(a: str | Column, b: str | Column) -> Column:
    """Sum of squared differences of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(squared(a, b))


def rms(a: str | Column, b: str | Column, k: int) -> Column:
    return F.sqrt(squared(a, b) / k)


#: Bytes of vectors, as doubles, that a tile holds at most; the tiles that a table below that is cut into, so that pairs of
#: them are shared among tasks; cells of distances that a task holds at once, at most so many beside each other, and that it adds up feature
#: by feature.
TILE_BYTES, TILES, BLOCK, SIDE, STRIP = 8 << 20, 24, 1 << 17, 1 << 9, 1 << 14


#: The same for nearest neighbours and listed pairs, whose tasks hold a few rows' distances besides two tiles: what is sent,
#: rows and candidates, grows with the number of tiles alone.
NEAR_BYTES, NEAR_TILES = 32 << 20, 8


def tile_size(df: DataFrame, vector: str, most: int = TILES, held: int = TILE_BYTES) -> int:
    """Rows of a tile: a ``most``-th of the table, in the bounds of ``held`` bytes; no fewer than 64."""
    n, width = df.agg(F.count("*"), F.max(F.size(vector))).first()
    return max(64, min(math.ceil(n / most), held // (8 * max(width or 1, 1))))


def tiles(df: DataFrame, ident: str, vector: str, size: int, group: str | None = None) -> DataFrame:
    """``tile, rows``: rows packed ``size`` at most to a tile, in the global order of the id."""
    from tarn.operators.ordered import row_numbers

    numbered = row_numbers(df.select(F.col(ident).alias("id"), F.col(vector).alias("v"), (F.lit(0) if group is None else F.col(group)).alias("g")), ["id"])
    return numbered.groupBy(F.floor(F.col("ord") / size).alias("tile")).agg(F.sort_array(F.collect_list(F.struct("id", "v", "g"))).alias("rows"))


def _tile_pairs(t: DataFrame) -> DataFrame:
    """``i, j, x, y``: every pair of tiles with i <= j once. The tiles are written in a file each, and a task reads the pairs of
    some files with some: no row is sent once for each tile, so the scratch that is taken doesn't grow with the number of tiles."""
    from tarn.sources.storage import materialize

    t = materialize(t, "tiles", rows=1)
    x, y = (t.select(F.col("tile").cast("long").alias(at), F.col("rows").alias(rows)) for at, rows in ("ix", "jy"))
    return x.hint("shuffle_replicate_nl").join(y, F.col("i") <= F.col("j")).select("i", "j", "x", "y")


def _read(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a tile."""
    ids, v = rows.flatten()[:2]
    length = v.value_lengths().to_numpy(zero_copy_only=False)
    if len(v) and not (length == length[0]).all():
        raise ValueError("distances need vectors of one length")
    return ids.to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by differences, added up feature after feature: the same on every machine."""
    out, step = np.zeros((len(a), len(b))), max(1, STRIP // max(1, len(b)))
    columns = np.ascontiguousarray(b.T)
    for at in range(0, len(a), step):
        part = out[at : at + step]
        for x, y in zip(a[at : at + step].T, columns, strict=True):
            d = np.subtract.outer(x, y)
            part += np.multiply(d, d, out=d)
    return out


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(_squares(a, b))


def _gram(a: np.ndarray, b: np.ndarray, blocks: int = 1) -> np.ndarray:
    """Squared distances as |a|^2 + |b|^2 - 2ab, summed over ``blocks`` of the features; negative rounding is clipped."""
    total = 0.0
    for x, y in zip(np.array_split(a, blocks, axis=1), np.array_split(b, blocks, axis=1), strict=True):
        part = (-2 * x) @ y.T
        part += (x**2).sum(1)[:, None]
        part += (y**2).sum(1)[None]
        total = part if blocks == 1 else total + part
    return np.maximum(total, 0.0, out=total)


def _exact(a: np.ndarray, b: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Squared distances of the pairs ``at`` by differences, added up as ``_squares`` does."""
    out = np.zeros(len(at[0]))
    for x, y in zip(a.T, b.T, strict=True):
        d = x[at[0]] - y[at[1]]
        out += d * d
    return out


def _fast(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``_squares`` to some 1e-12 of each value: by the Gram form, and by differences where that would cancel."""
    d2 = _gram(a, b)
    near = np.nonzero(d2 < 1e-3 * ((a**2).sum(1).max(initial=0.0) + (b**2).sum(1).max(initial=0.0)))
    for k in range(0, len(near[0]), BLOCK):
        at = near[0][k : k + BLOCK], near[1][k : k + BLOCK]
        d2[at] = _exact(a, b, at)
    return d2


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """``ids, vectors, other ids, other vectors, same, group, other group`` of some rows of a tile against some of a tile, SIDE
    others at most so that a block stays in a core's cache; ``same`` if they begin with the same rows."""
    of = {c: batch.column(batch.schema.get_field_index(c)) for c in ("i", "j", "x", "y")}
    for k in range(batch.num_rows):
        one = of["i"][k].as_py() == of["j"][k].as_py()
        x, y = of["x"][k].values, of["y"][k].values
        (ia, a), (ib, b) = _read(x), _read(y)
        codes = pa.concat_arrays([x.flatten()[2], y.flatten()[2]]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        ga, gb = codes[: len(ia)], codes[len(ia) :]
        step = BLOCK // SIDE
        for at in range(0, len(ia), step):
            rows = slice(at, at + step)
            for first in range(at if one else 0, len(ib), SIDE):
                others = slice(first, first + SIDE)
                yield ia[rows], a[rows], ib[others], b[others], one and first == at, ga[rows], gb[others]


def _once(same: bool, d: np.ndarray) -> np.ndarray:
    """The cells of a block that are pairs counted once, as a list."""
    return d[np.triu_indices(*d.shape[:1], 1, d.shape[1])] if same else d.ravel()


def _batch(kind: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)


def _paired(df: DataFrame, ident: str, found: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], t: DataFrame) -> DataFrame:
    """``a, b, d`` of the blocks of all pairs of tiles: ``found`` gives squared distances and which cells are kept."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    kind = df.schema[ident].dataType
    out = StructType([StructField("a", kind), StructField("b", kind), StructField("d", DoubleType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ia, a, ib, b, same, _, _ in _blocks(batch):
                d2, keep = found(a, b)
                if same:
                    keep &= np.triu(np.ones(keep.shape, bool), 1)
                at = np.nonzero(keep)
                yield _batch(schema, ia[at[0]], ib[at[1]], np.sqrt(d2[at]))

    return _tile_pairs(t).mapInArrow(run, out)


def all_pairs(df: DataFrame, ident: str, vector: str, size: int | None = None, most: float | None = None) -> DataFrame:
    """``a, b, d`` for a < b: Euclidean distances by differences, one task's work being some pairs of tiles.

    All pairs are looked at, so the work is the input's square; every row is read once for each tile, and there are NEAR_TILES
    of them until they are full. With ``most`` only pairs at most so far apart leave the task: the Gram form leaves out
    those that are clearly farther, differences decide on the others.
    """

    def found(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if most is None:
            d2 = _squares(a, b)
            return d2, np.ones(d2.shape, bool)
        d2 = _gram(a, b)
        near = np.nonzero(d2 <= most * most * (1 + 1e-9) + 1e-9 * ((a**2).sum(1)[:, None] + (b**2).sum(1)[None]))
        keep, exact = np.zeros(d2.shape, bool), _exact(a, b, near)
        d2[near], keep[near] = exact, np.sqrt(exact) <= most
        return d2, keep

    return _paired(df, ident, found, tiles(df, ident, vector, size or tile_size(df, vector, NEAR_TILES, NEAR_BYTES)))


def gram_pairs(df: DataFrame, ident: str, vector: str, scale: float = 1.0, blocks: int = 4, size: int | None = None) -> DataFrame:
    """As ``all_pairs``, by D2 = |a|^2 + |b|^2 - 2ab summed over ``blocks`` of the features; ``scale`` divides D2. Negative
    rounding is clipped."""

    def found(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d2 = _gram(a, b, blocks) / scale
        return d2, np.ones(d2.shape, bool)

    return _paired(df, ident, found, tiles(df, ident, vector, size or tile_size(df, vector)))


def pair_parts(df: DataFrame, ident: str, vector: str, names: list[str], part: Callable[[np.ndarray, np.ndarray, Callable], tuple], size: int | None = None) -> DataFrame:
    """``n`` and the doubles ``names`` that ``part(a, b, once)`` makes of each block of all pairs, for results that add up: no
    pair leaves its task. ``once`` takes the cells of a block's matrix that are pairs, each once, as a list."""
    schema = pa.schema([("n", pa.int64()), *[(c, pa.float64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ia, a, ib, b, same, _, _ in _blocks(batch):
                n = sum(range(len(ib) - len(ia), len(ib))) if same else len(ia) * len(ib)
                if n:
                    yield _batch(schema, [n], *[[float(x)] for x in part(a, b, lambda d, same=same: _once(same, d))])

    return _tile_pairs(tiles(df, ident, vector, size or tile_size(df, vector))).mapInArrow(run, "n long, " + ", ".join(f"{c} double" for c in names))


#: Bins of the distances of all pairs among which a percentile's is found.
BINS = 1 << 16


def pair_percentiles(df: DataFrame, ident: str, vector: str, percents: list[float], group: str | None = None, size: int | None = None) -> dict[bool | None, tuple[int, list[float]]]:
    """The number of pairs and the exact linear percentiles of their distances, for the pairs of one group, of two, and with a
    null group; without ``group`` all are of one.

    Two passes over all pairs: counts of BINS bins, which are added up, and the distances in the few bins that hold a wanted
    rank, which are put in order. So no pair table is made, and what is held doesn't grow with the number of distances.
    """
    from tarn.operators.ordered import row_numbers
    from tarn.sources.storage import materialize

    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    longest = df.select(norm.alias("r")).where(~F.isnan("r") & (F.col("r") < float("inf"))).agg(F.max("r")).first()[0] or 0.0
    scale, cells = BINS / (2 * longest or 1.0), 3 * (BINS + 1)
    met = _tile_pairs(tiles(df, ident, vector, size or tile_size(df, vector), group))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for _, a, _, b, same, ga, gb in _blocks(batch):
                d = _fast(a, b)
                np.sqrt(d, out=d)
                d *= scale
                whole = np.isfinite(d.sum())
                odd = None if whole else ~np.isfinite(d)
                np.minimum(d, BINS - 1, out=d)
                if odd is not None:
                    d[odd] = BINS
                cell = d.astype(np.int64)
                if group is not None:  # 0: one group, 1: two, 2: unknown
                    cell += (ga[:, None] != gb[None]) * np.int64(BINS + 1)
                    if (ga < 0).any() or (gb < 0).any():
                        cell = np.where((ga < 0)[:, None] | (gb < 0)[None], cell % (BINS + 1) + 2 * (BINS + 1), cell)
                yield a, b, same, cell

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for _, _, same, cell in placed(batches):
            total += np.bincount(_once(same, cell), minlength=cells)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    counts = np.zeros(cells, np.int64)
    for r in met.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # as many as bins at most
        counts[r["cell"]] = r["n"]
    upto = counts.reshape(3, -1).cumsum(1)
    ranks = {(k, r) for k in range(3) if upto[k, -1] for p in percents for r in (math.floor(p * (upto[k, -1] - 1)), math.ceil(p * (upto[k, -1] - 1)))}
    cell_of = {(k, r): int(np.searchsorted(upto[k], r, side="right")) + k * (BINS + 1) for k, r in ranks}
    wanted = np.zeros(cells, bool)
    wanted[list(cell_of.values())] = True

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, same, cell in placed(batches):
            hit = wanted[cell]
            if same:
                hit &= np.triu(np.ones(hit.shape, bool), 1)
            at = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([pa.array(cell[at]), pa.array(np.sqrt(_exact(a, b, at)))], ["cell", "d"])

    held = materialize(row_numbers(met.mapInArrow(pick, "cell long, d double"), ["cell", "d"], "nth"), "held")
    if held.count() != counts[wanted].sum():
        raise RuntimeError("executors differ in their rounding: the second pass found other pairs in a bin than the first")
    before = np.concatenate([[0], np.cumsum(np.where(wanted, counts, 0))])
    place = {key: int(before[c] + key[1] - (upto[key[0], c % (BINS + 1)] - counts[c])) for key, c in cell_of.items()}
    value = {r["nth"]: r["d"] for r in held.where(F.col("nth").isin(sorted(set(place.values())))).collect()}
    out = {}
    for k, same in enumerate((True, False, None)):
        if n := int(upto[k, -1]):
            ends = [(p * (n - 1), value[place[k, math.floor(p * (n - 1))]], value[place[k, math.ceil(p * (n - 1))]]) for p in percents]
            out[same] = n, [low if low == high else low + (high - low) * (at - math.floor(at)) for at, low, high in ends]
    return out


#: Cells of which the least stands for all where the k-th of a row is bounded.
STRIDE = 32


def _kth(d2: np.ndarray, k: int) -> np.ndarray:
    """For each row a bound of its k-th least cell that at least k cells meet: the k-th least of the minima of STRIDE cells."""
    n = d2.shape[1] // STRIDE
    if n >= 4 * k:
        d2 = np.fmin(np.fmin.reduce(d2[:, : n * STRIDE].reshape(len(d2), STRIDE, n), axis=1), np.inf)
    k = min(k, d2.shape[1])
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


#: Cells that a task holds at once where it looks for the least of each row, and of which those that may be are put in order together.
HELD, FOUND = 1 << 21, 1 << 17


def _least(u: np.ndarray, v: np.ndarray, k: int, same: bool, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``u``, places in ``v`` and distances of the ``k`` least of every row by differences, ties by place, among those that
    the Gram form can't tell from them; no row with itself if ``same``."""
    step, held, wait = max(1, HELD // max(1, len(v))), [], 0
    norms, longest = (u**2).sum(1), np.fmax.reduce((v**2).sum(1), initial=0.0)
    for at in range(0, len(u), step):
        d2 = _gram(u[at : at + step], v)
        if same:
            d2[np.arange(len(d2)), at + np.arange(len(d2))] = np.inf
        bound = _kth(d2, k)
        slack = 1e-9 * (norms[at : at + step] + longest) + 10.0**-digits * (2 * np.sqrt(bound) + 1)
        cells = np.flatnonzero(d2 <= (bound + slack)[:, None])
        cells = cells[np.isfinite(d2.ravel()[cells])]
        held.append((cells // len(v) + at, cells % len(v)))
        wait += len(cells)
        if wait >= FOUND or at + step >= len(u):
            row, place = (np.concatenate(x) for x in zip(*held, strict=True))
            d = np.round(np.sqrt(_exact(u, v, (row, place))), digits)
            order = np.lexsort((place, d, row))
            row, place, d = row[order], place[order], d[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            yield row[nth < k], place[nth < k], d[nth < k]
            held, wait = [], 0


def nearest(df: DataFrame, ident: str, vector: str, k: int, group: str | None = None, size: int | None = None, digits: int = 9) -> DataFrame:
    """``a, b, d``: the ``k`` nearest others of every row, in its group if one is given; ties by ``b`` at ``digits`` digits.

    Each pair of tiles keeps k candidates a row and direction, so n * k * tiles rows are shuffled and no pair table is made; the
    tiles themselves are read, not shuffled. With groups, rows are tiled by group, and groups of one id meet only their own tiles.
    """
    from tarn.operators.ordered import row_numbers

    size = size or tile_size(df, vector, NEAR_TILES, NEAR_BYTES)
    if group is None:
        met = _tile_pairs(tiles(df, ident, vector, size))
    else:
        numbered = row_numbers(df.select(F.col(group).alias("g"), F.col(ident).alias("id"), F.col(vector).alias("v")), ["g", "id"], "ord")
        first = numbered.groupBy("g").agg(F.min("ord").alias("first")).select(F.col("g").alias("of"), "first")
        placed = numbered.join(first, F.col("g").eqNullSafe(F.col("of"))).withColumn("tile", F.floor((F.col("ord") - F.col("first")) / size))
        t = placed.groupBy("g", "tile").agg(F.sort_array(F.collect_list(F.struct("id", "v", F.lit(0).alias("none")))).alias("rows"))
        last = placed.groupBy(F.col("g").alias("of")).agg(F.max("tile").alias("last"))
        sides = t.join(last, F.col("g").eqNullSafe(F.col("of")))
        left = sides.select("g", F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile"), F.col("last"))).alias("j"), F.col("rows").alias("x"))
        right = sides.select(F.col("g").alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tile"))).alias("i2"), F.col("tile").alias("j2"), F.col("rows").alias("y"))
        met = left.join(right, F.col("g").eqNullSafe(F.col("h")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))).select("i", "j", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (ia, a), (ib, b) = _read(batch.column(2)[n].values), _read(batch.column(3)[n].values)
                same = batch.column(0)[n].as_py() == batch.column(1)[n].as_py()
                for one, u, other, v in [(ia, a, ib, b)] if same else [(ia, a, ib, b), (ib, b, ia, a)]:
                    for row, place, d in _least(u, v, k, same, digits):
                        yield pa.RecordBatch.from_arrays([pa.array(one[row], type=types[0]), pa.array(other[place], type=types[0]), pa.array(d)], ["a", "b", "d"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind, types = dict(df.dtypes)[ident], [to_arrow_type(df.schema[ident].dataType)]
    found = met.mapInArrow(run, f"a {kind}, b {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def sampled(pairs: DataFrame, df: DataFrame, ident: str, vector: str) -> DataFrame:
    """Distances of the given pairs ``a, b`` alone; draws that repeat a pair stay repeated."""
    x = df.select(F.col(ident).alias("a"), F.col(vector).alias("x"))
    y = df.select(F.col(ident).alias("b"), F.col(vector).alias("y"))
    return pairs.join(x, "a").join(y, "b").withColumn("d", euclidean("x", "y")).drop("x", "y")


def mean_square(df: DataFrame, vector: str) -> DataFrame:
    """``mean`` of the squared distances of all pairs of rows, without the pairs: n times the sum of squares, less the square
    of the sum, place by place."""
    places = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    return places.agg((F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.max("n") * (F.max("n") - 1) / 2)).alias("mean"))


def total_squares(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """``<ident>, total``: the sum of each row's squared distances to all rows, without the pairs: by sums of the places, taken
    about their means so that nothing large cancels. Rows without a vector have no total and don't count."""
    rows = df.where(F.col(vector).isNotNull())
    places = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = places.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("_mean"))  # one row
    about = rows.crossJoin(F.broadcast(means)).select(ident, squared(vector, "_mean").alias("_r"))
    whole = about.agg(F.count("*").alias("_n"), F.sum("_r").alias("_q"))
    return about.crossJoin(F.broadcast(whole)).select(ident, (F.col("_n") * F.col("_r") + F.col("_q")).alias("total"))


def combined(g: Column, c: Column, o: Column, lam: float, weight: float, lam_o: float) -> Column:
    return F.sqrt(g * g + (lam * c) * (lam * c) + (weight * lam_o * o) * (weight * lam_o * o))


def summary(df: DataFrame, d: str, own: float, other: float) -> DataFrame:
    """Median, p90, p1 and the shares within two cuts, to four digits."""
    from tarn.operators.ordered import percentiles

    found = percentiles(df, d, [0.5, 0.9, 0.01])
    return df.agg(
        *[F.round(F.lit(x).cast("double"), 4).alias(n) for n, x in zip(("median", "p90", "p1"), found, strict=True)],
        F.round(F.avg((F.col(d) <= own).cast("int")), 4).alias("within_own"),
        F.round(F.avg((F.col(d) <= other).cast("int")), 4).alias("within_other"),
    )


def cut_at(df: DataFrame, d: str, percent: float = 1.0) -> float:
    """The percentile of ``d``, linear, rounded to four digits: the rounded value is what later steps use."""
    return round(df.agg(F.percentile(d, percent / 100)).first()[0], 4)


def laws(triples: DataFrame, df: DataFrame, ident: str, vector: str) -> DataFrame:
    """``triples, excess, asymmetric, not_zero, negative`` over drawn ``a, b, c``: the largest excess of a side over the other
    two, and how many distances break symmetry, the zero of equal items, and sign."""
    met = triples
    for name in "abc":
        met = met.join(df.select(F.col(ident).alias(name), F.col(vector).alias(f"v{name}")), name)
    d = lambda x, y: euclidean(f"v{x}", f"v{y}")
    sides = met.select(*[d(x, y).alias(x + y) for x, y in ("ab", "bc", "ac", "ba", "aa")])
    return sides.agg(F.count("*").alias("triples"), F.max(F.col("ac") - F.col("ab") - F.col("bc")).alias("excess"), F.count_if(F.col("ab") != F.col("ba")).alias("asymmetric"), F.count_if(F.col("aa") != 0).alias("not_zero"), F.count_if(F.col("ab") < 0).alias("negative"))
