"""The most similar vectors of every vector, by a permutation index.

Every vector is represented by its nearest pivots in order, nearest first, and
posted in the inverted files of the first ``posted`` of them.  Within an
inverted file candidates are ranked by the footrule distance of their pivot
orders; the best share ``keep`` of the file (CANDIDATES at least), with all
that tie with the last of them, is reranked by cosine; the inverted files'
answers are merged by one more aggregation.

How many pivots there are, how many of them post a vector and how much of a
file is reranked is fitted to the data: of a bounded sample (``SAMPLE`` vectors, by a hash of the id) the first
``PROBES`` are searched exactly against all rows, and of all settings under
which these probes meet ``target`` of their true neighbours in a file the one
of least work is taken.  Easy data get many small files, data without structure
few large ones, down to files that hold nearly everything.  All vectors are
indexed, all are queries.  ``exact_nearest`` is the exact way: a stated set of
queries, in blocks, against all rows.

A file is searched in blocks of rows, so its memory is linear in its size.  One
with more than ``file_rows`` vectors is cut into blocks of about half as many,
and every pair of blocks is searched in a task of its own: all that share a
file meet, whatever its size, and no task holds more than about ``file_rows``
vectors; work and shuffle of such a file grow with its square.  Copies, which
are vectors of one direction whatever their length, never meet in a file: they
are represented by one row and joined back at the end.

Defined cases: vectors that are null, of another size than ``dim``, all zero or
that hold null, NaN or an infinity take no part; length plays no role; rows of
one id count once (the last created, then the largest vector); a null id takes
no part; of fewer than two vectors there are no neighbours; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesselog.session import materialise, ship

ORDER, CANDIDATES, FILE_ROWS = 8, 100, 16_384
#: Vectors sampled to fit the index (half of them may become pivots), how many of them are searched exactly, and how often these must meet their neighbours.
SAMPLE, PROBES, TARGET, LOSS = 8192, 256, 0.99, 0.005
#: What a pair compared in a file, a pivot compared and a row posted cost, in nanoseconds.
PAIR_COST, PIVOT_COST, POST_COST = 30, 16, 8000
TIE = 1e-6
#: Unit vectors no further apart than SAME count as one direction; rescaling in single precision moves them by less.
SAME = TIE / 4
#: Copies are sought in cells of 1 / GRID, then in cells FINER times smaller, and so on.
GRID, FINER, ROUNDS = 2**12, 4, 4


def clean(index: DataFrame, dim: int = 64) -> DataFrame:
    """vec_id, embedding: the usable vectors, one for each id."""
    e = F.col("embedding")
    usable = (F.size(e) == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    when = F.col("created_at") if "created_at" in index.columns else F.lit(None).cast("timestamp")
    best = F.max(F.struct(when.alias("c"), "embedding")).alias("b")
    return index.where("vec_id is not null").groupBy("vec_id").agg(best).select("vec_id", F.col("b.embedding").alias("embedding")).where(usable)


def _units(rows: pa.Table | pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    flat = rows.column(column)
    flat = (flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat).flatten()
    got = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    got = got / np.abs(got).max(axis=1, keepdims=True, initial=1e-300)
    return got / np.sqrt((got * got).sum(1, keepdims=True))


def _cells(grid: int, dim: int):
    weights = np.random.default_rng(dim).integers(-(2**63), 2**63, size=dim, dtype=np.int64)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                unit = _units(batch, "embedding", dim)
                ends = pa.array(np.arange(0, unit.size + 1, dim, dtype=np.int32))
                cell = np.rint(unit * grid).astype(np.int64) @ weights  # a hash; the distances tell what falls together
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.ListArray.from_arrays(ends, pa.array(unit.astype(np.float32).reshape(-1))), pa.array(cell)], names=["vec_id", "embedding", "cell"])

    return run


def copies(rows: DataFrame, dim: int = 64) -> DataFrame:
    """vec_id, head, embedding (of length 1): head is the smallest id of the vectors of one direction.

    The first vector of a cell takes all that lie within SAME of it; the others
    of the cell go another round in smaller cells.  Those left after ROUNDS are
    copies where they are equal.  A direction cut by a cell's border has some
    heads more, which are neighbours of each other.
    """
    done, rest = None, rows
    for turn in range(ROUNDS):
        celled = materialise(rest.select("vec_id", "embedding").mapInArrow(_cells(GRID * FINER**turn, dim), "vec_id bigint, embedding array<float>, cell bigint"), f"cells{turn}")
        first = celled.groupBy("cell").agg(F.min(F.struct("vec_id", "embedding")).alias("first"))
        apart = F.aggregate(F.zip_with("embedding", "first.embedding", lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)
        head = F.when((F.col("vec_id") == F.col("first.vec_id")) | (apart <= SAME**2), F.col("first.vec_id"))
        judged = materialise(celled.join(first, "cell").select("vec_id", head.alias("head"), "embedding"), f"copies{turn}")
        found, rest = judged.where("head is not null"), judged.where("head is null")
        done = found if done is None else done.unionByName(found)
        if rest.isEmpty():
            return done
    equal = rest.groupBy("embedding").agg(F.min("vec_id").alias("head"))
    return done.unionByName(rest.drop("head").join(equal, "embedding").select("vec_id", "head", "embedding"))


def _pivot_orders(unit: np.ndarray, pivots: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` nearest pivots of each vector, nearest first, equal ones by number."""
    m = min(order, len(pivots))
    far = -(unit @ pivots.T)
    near = np.argpartition(far, m - 1, axis=1)[:, :m] if m < len(pivots) else np.tile(np.arange(m), (len(unit), 1))
    return np.take_along_axis(near, np.lexsort((near, np.take_along_axis(far, near, 1)), axis=1), 1).astype(np.int16)


def _orders(pivots: np.ndarray, order: int, dim: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch, "embedding", dim)
            near = _pivot_orders(unit.astype(np.float32), pivots, order)
            lists = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(a).reshape(-1), t))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), lists(unit.astype(np.float32), pa.float32()), lists(near, pa.int16())], names=["vec_id", "unit", "pivots"]
            )

    return run


def _best(probe_ids: np.ndarray, probes: np.ndarray, k: int, dim: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _units(batch, "embedding", dim)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            cos = probes @ unit.T
            cos[probe_ids[:, None] == ids[None, :]] = -2
            m = min(k, len(ids))
            least = np.partition(cos, len(ids) - m, axis=1)[:, len(ids) - m, None] - TIE
            at, of = np.nonzero((cos >= least) & (cos > -1.5))
            yield pa.RecordBatch.from_arrays([pa.array(probe_ids[at]), pa.array(ids[of]), pa.array(cos[at, of]), batch.column("embedding").take(pa.array(of))], names=["a", "b", "cosine", "embedding"])

    return run


def exact_nearest(rows: DataFrame, asked: pa.Table, k: int = 5, dim: int = 64) -> DataFrame:
    """a, b, cosine, embedding of b: the k most similar rows (vec_id, embedding) of each asked one (a bounded table of the same columns), exactly.

    The asked vectors go to every task, the rows stream past them, and k rows
    for each of them and batch leave a task; whatever lies within TIE of the
    k-th is there, too.
    """
    ship(rows.sparkSession)
    ids, unit = asked.column("vec_id").to_numpy(), _units(asked, "embedding", dim)
    parts = rows.select("vec_id", "embedding").mapInArrow(_best(ids, unit, k, dim), "a bigint, b bigint, cosine double, embedding array<float>")
    place = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = parts.withColumn("rn", F.row_number().over(place))
    kth = F.max(F.when(F.col("rn") == k, F.col("cosine"))).over(Window.partitionBy("a"))
    return ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("cosine") >= F.col("kth") - TIE)).select("a", "b", "cosine", "embedding")


class Footrule:
    """Footrule distances of n orders of m pivots, in blocks of rows.

    A pivot that an order lacks counts as standing behind its end; then each
    shared pivot brings the two orders nearer by the smaller of its two
    distances from the end, and only shared pivots have to be visited: the
    distance is m (m + 1) - 2 gain.
    """

    def __init__(self, pivots: np.ndarray):
        self.n, m = pivots.shape
        flat = pivots.reshape(-1)
        by = np.argsort(flat, kind="stable")
        self.groups = [(g // m, (m - g % m).astype(np.int16)) for g in np.split(by, np.flatnonzero(np.diff(flat[by])) + 1) if len(g) > 1]

    def gain(self, first: int, last: int) -> np.ndarray:
        """The gains of the orders first .. last - 1 against all."""
        gain = np.zeros((last - first, self.n), np.int16)
        for row, weight in self.groups:  # the rows of a group rise
            a, b = np.searchsorted(row, (first, last))
            if b > a:
                gain[np.ix_(row[a:b] - first, row)] += np.minimum.outer(weight[a:b], weight)
        return gain


def fit(n: int, sample: np.ndarray, probes: np.ndarray, neighbours: np.ndarray, of: np.ndarray, target: float = TARGET, file_rows: int = FILE_ROWS, order: int = ORDER) -> tuple[int, int, float]:
    """(pivots, posted, keep) of least work for n rows under which ``target`` of the probes' neighbours share a file with them.

    Pivots are the first vectors of the sample; the sizes of files are told by
    its second half.  ``of`` names the probe of each neighbour.  keep is the
    share of a file, best footrule first, that holds all but LOSS of those
    neighbours that share one.
    """
    half = max(1, len(sample) // 2)
    pool, rest = sample[:half], sample[half:][:2048]
    found, size = [], min(16, half)
    most = min(16, half)
    while True:
        files, a, b = (_pivot_orders(x, pool[:size], most).astype(np.int64) for x in (rest, probes, neighbours))
        for t in range(min(2, most), most + 1):
            met = (a[of, :t, None] == b[:, None, :t]).any((1, 2)).mean() if len(of) else 1.0
            if met >= target:
                counts = np.bincount(files[:, :t].reshape(-1), minlength=size) * (n / max(1, len(files)))
                work = (counts * np.maximum(counts, t * n / size)).sum() / n
                cost = PIVOT_COST * size + PAIR_COST * work + POST_COST * t + (PAIR_COST * n if t * n / size > file_rows else 0)
                found.append((cost, size, t, files, a, b))
                break
        if size >= half:
            break
        size = min(2 * size, half)
    if not found:
        return min(16, half), most, 1.0
    _, size, t, files, a, b = min(found, key=lambda x: x[:3])
    return size, t, _keep(files, a, b, of, t, max(order, t))


def _keep(files: np.ndarray, a: np.ndarray, b: np.ndarray, of: np.ndarray, t: int, order: int) -> float:
    """How much of a file, best footrule first, holds all but LOSS of the pairs (a[of], b) that share one of their first t pivots."""
    if not len(of) or not len(files):
        return 1.0
    m = min(order, files.shape[1])
    every = np.concatenate((files[:, :m], b[:, :m], a[:, :m]))
    ranker = Footrule(every)
    gain = ranker.gain(len(files) + len(b), len(every))
    ranks = np.ones(len(of))
    for i, p in enumerate(of):
        mine = gain[p, len(files) + i]
        shared = np.intersect1d(a[p, :t], b[i, :t])
        for f in shared:
            inside = gain[p, : len(files)][(files[:, :t] == f).any(1)]
            ranks[i] = min(ranks[i], ((inside >= mine).sum() + 1) / (len(inside) + 1))
    return float(np.quantile(ranks, 1 - LOSS))


def _split_files(posts: DataFrame, file_rows: int) -> DataFrame:
    """``posts`` (file, vec_id) with ``part``: overfull files in blocks of about half of ``file_rows``, each pair of blocks in a part of its own."""
    sizes = posts.groupBy("file").agg(F.count("*").alias("n"))
    over = materialise(sizes.where(F.col("n") > file_rows).select("file", F.ceil(2 * F.col("n") / file_rows).cast("int").alias("blocks")), "over")
    fine = posts.join(over, "file", "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    if over.isEmpty():
        return fine
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != F.col("block"))).alias("other")
    cells = posts.join(over, "file").withColumn("block", block).select(*posts.columns, "block", "blocks", others)
    part = F.least("block", "other").cast("bigint") * F.col("blocks") + F.greatest("block", "other")
    return fine.unionByName(cells.withColumn("part", part).drop("block", "blocks", "other"))


def _floor_of_best(gain: np.ndarray, best: int) -> np.ndarray:
    """For each row the largest value that at least ``best`` of its entries reach; entries are 0 or more, but -1 where they don't count."""
    top = int(gain.max(initial=0)) + 2
    counts = np.bincount((gain.astype(np.int64) + 1 + np.arange(len(gain))[:, None] * top).reshape(-1), minlength=len(gain) * top).reshape(len(gain), top)
    reach = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
    return (reach >= best).sum(1) - 2


def _search(k: int, candidates: int, dim: int, keep: float = 1.0, least: float = -1.0, block_cells: int = 1 << 21):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        by_id = np.argsort(ids)  # the same result whatever the order of arrival
        ids, rows = ids[by_id], rows.take(pa.array(by_id))
        n = len(ids)
        if n < 2:
            return pa.table({"a": pa.array([], pa.int64()), "near": pa.array([], _NEAR)})
        unit = _units(rows, "unit", dim)
        orders = rows.column("pivots").combine_chunks().flatten().to_numpy().reshape(n, -1)
        c = min(max(candidates, math.ceil(keep * n)), n - 1)
        ranker = Footrule(orders) if c < n - 1 else None
        step = max(1, block_cells // n)
        found = []
        for first in range(0, n, step):
            last = min(n, first + step)
            own = np.arange(last - first)
            cos = unit[first:last] @ unit.T
            if ranker is not None:
                gain = ranker.gain(first, last)
                gain[own, first + own] = -1
                cos[gain < _floor_of_best(gain, c)[:, None]] = -2
            cos[own, first + own] = -2
            kth = np.partition(cos, n - k, axis=1)[:, n - k, None] - TIE if n - 1 > k else -1.5
            at, of = np.nonzero((cos >= kth) & (cos >= least - TIE) & (cos > -1.5))
            found.append((first + at, of, cos[at, of]))
        at, of, cos = (np.concatenate(x) for x in zip(*found))
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
        near = pa.StructArray.from_arrays([pa.array(cos), pa.array(ids[of])], names=["cosine", "b"])
        return pa.table({"a": ids, "near": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), near)})

    return run


_NEAR = pa.list_(pa.struct([("cosine", pa.float64()), ("b", pa.int64())]))


def nearest(
    index: DataFrame,
    k: int = 5,
    dim: int = 64,
    pivots: int | None = None,
    posted: int | None = None,
    order: int = ORDER,
    candidates: int = CANDIDATES,
    file_rows: int = FILE_ROWS,
    target: float = TARGET,
    least: float = -1.0,
) -> tuple[DataFrame, DataFrame]:
    """(neighbours, copies).

    neighbours has a, b, cosine: of each distinct direction the k most similar
    other ones and whatever lies within TIE of the k-th, of those with a cosine
    of ``least`` or more, a and b the smallest ids of their copies; copies has
    vec_id and head, that smallest id.  ``pivots`` and ``posted`` are fitted
    where they aren't given.
    """
    spark = index.sparkSession
    ship(spark)
    known = copies(clean(index, dim), dim)
    members = known.select("vec_id", "head")
    heads = known.where("vec_id = head").select("vec_id", "embedding")
    n = heads.count()
    sample = heads.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double"), members
    unit = _units(sample, "embedding", dim).astype(np.float32)
    if pivots is None or posted is None:
        probes = sample.slice(0, PROBES)
        exact = exact_nearest(heads, probes, k, dim).where(F.col("cosine") >= least).toArrow()
        place = {int(x): i for i, x in enumerate(probes.column("vec_id").to_numpy())}
        of = np.array([place[int(x)] for x in exact.column("a").to_numpy()], np.int64)
        around = _units(exact, "embedding", dim).astype(np.float32) if len(of) else unit[:0]
        # a probe is no pivot: it would be nearest to itself
        pool = np.concatenate((unit[PROBES:], unit[:PROBES])) if len(unit) > 4 * PROBES else unit
        fitted = fit(n, pool, unit[:PROBES], around, of, target, file_rows, order)
    else:
        pool, fitted = unit, (pivots, posted, 1.0)
    pivots, posted, keep = min(pivots or fitted[0], len(pool)), posted or fitted[1], fitted[2]
    at = pool[:pivots]
    order = max(order, posted)
    schema = "vec_id bigint, unit array<float>, pivots array<smallint>"
    known = materialise(heads.mapInArrow(_orders(at, order, dim), schema), "orders")
    posts = known.select("vec_id", F.explode(F.slice("pivots", 1, posted)).alias("file"))
    files = _split_files(posts, file_rows).select("vec_id", "file", "part")
    ready = files.join(known.select("vec_id", "unit", "pivots"), "vec_id")
    found = ready.groupBy("file", "part").applyInArrow(_search(k, candidates, dim, keep, least), "a bigint, near array<struct<cosine:double,b:bigint>>")
    # partial answers of at most k and ties each meet per vector; equal b of several files count once
    merged = found.select("a", F.explode("near").alias("x")).groupBy("a", F.col("x.b").alias("b")).agg(F.max("x.cosine").alias("cosine"))
    place = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    ranked = merged.withColumn("rn", F.row_number().over(place))
    kth = F.max(F.when(F.col("rn") == k, F.col("cosine"))).over(Window.partitionBy("a"))
    return ranked.withColumn("kth", kth).where(F.col("kth").isNull() | (F.col("cosine") >= F.col("kth") - TIE)).select("a", "b", "cosine"), members


def close_classes(index: DataFrame, k: int = 5, least: float = 0.9, **settings) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs a < b of directions of cosine ``least`` or more of which one is among the k most similar of the other; members has vec_id, head, n.

    a and b are the heads of their copies, n the number of copies of the head.
    Whatever lies within TIE of the k-th counts too.  Copies of a vector are
    its most similar ones: where a vector has k other copies or more, only
    what is as near as these counts.
    """
    near, members = nearest(index, k, least=least, **settings)
    near = materialise(near, "near")
    sizes = members.groupBy("head").agg(F.count("*").alias("n"))
    members = materialise(members.join(sizes, "head"), "members")
    sizes = members.where("vec_id = head").select("head", "n")
    # places before a neighbour's class: own copies, then the classes that are more similar
    known = near.join(sizes.select(F.col("head").alias("b"), F.col("n").alias("n_b")), "b").join(sizes.select(F.col("head").alias("a"), F.col("n").alias("n_a")), "a")
    up = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    filled = known.withColumn("filled", F.col("n_a") - 1 + F.sum("n_b").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kth = F.when(F.col("n_a") > k, F.lit(1.0)).otherwise(F.max(F.when(F.col("filled") >= k, F.col("cosine"))).over(Window.partitionBy("a")))
    close = filled.withColumn("kth", kth).where((F.col("cosine") >= least) & (F.col("kth").isNull() | (F.col("cosine") >= F.col("kth") - TIE)))
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), members


#: Copies of one direction are expanded in blocks of so many, each pair of blocks in a row of its own.
BLOCK = 1000


def close_pairs(index: DataFrame, k: int = 5, least: float = 0.9, **settings) -> DataFrame:
    """vec_id_a < vec_id_b: the pairs of ``close_classes`` between all members, and those inside each class.

    This form has a row for each pair of copies, as many as there are; classes
    are cut into blocks of BLOCK members and expanded from pairs of blocks, so
    no task gathers a class.  ``close_classes`` has the same facts in a row for
    each vector and each pair of classes.
    """
    classes, members = close_classes(index, k, least, **settings)
    # members of a class are numbered in blocks without a window over the class: by a hash, about BLOCK each
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).cast("int")})
    one = dealt.select("head", "block", "vec_id")
    sizes = dealt.where("vec_id = head").select("head", "n", "blocks")
    inside = sizes.where("n > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), F.col("blocks").alias("x"), F.col("blocks").alias("y"))
    across = classes.join(sizes.select(F.col("head").alias("a"), F.col("blocks").alias("x")), "a").join(sizes.select(F.col("head").alias("b"), F.col("blocks").alias("y")), "b").select("a", "b", "x", "y")
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    cells = across.unionByName(inside).select("a", "b", steps("x").alias("x"), "y").select("a", "b", "x", steps("y").alias("y")).where("a <> b or x <= y")
    ma = one.select(F.col("head").alias("a"), F.col("block").alias("x"), F.col("vec_id").alias("va"))
    mb = one.select(F.col("head").alias("b"), F.col("block").alias("y"), F.col("vec_id").alias("vb"))
    every = cells.join(ma, ["a", "x"]).join(mb, ["b", "y"]).where("a <> b or x < y or va < vb")
    return every.select(F.least("va", "vb").alias("vec_id_a"), F.greatest("va", "vb").alias("vec_id_b"))
