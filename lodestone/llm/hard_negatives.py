"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join over inner products.

The largest inner products become the nearest neighbours once vectors are augmented: with M the greatest norm, x' = (x,
sqrt(M^2 - |x|^2)) and an anchor a' = (a, 0) lie |a|^2 + M^2 - 2 a.x apart. Rows and anchors belong to the cell of their
nearest pivot. An anchor's rows of interest have a score of at least some bound, so they lie within a radius of a',
and by the triangle inequality within that radius plus the anchor's own distance of its pivot. A row is sent to an anchor group only
if it lies within the group's greatest reach. There a block of rows meets a block of anchors as a matrix product, whose
best rows per anchor are merged by a window over all blocks.

Three joins: within cells, for a first bound on the scores of positives; the rows that may still be positives; and the
rows that may fall into the windows that the positives set. Cells are cut into blocks of rows, so a vector or a label
that very many rows share is many blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import checkpointed, discard, ship, table

POSITIVES, NEGATIVES, SHARE = 5, 5, 80
SCALE = 256
#: Components from which a row takes no part, so that every score is exact in a long.
LARGEST = 65_536.0
#: Pivots at least and at most, and anchors for each in between.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_ANCHORS = 8, 256, 1024
#: Rows and anchors of a block; anchors whose scores are held at a time.
ROW_BLOCK, ANCHOR_BLOCK, HELD = 1 << 14, 1 << 10, 64


def quantised(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(row, vec_id, label, q) of the rows that take part, written out, with whole components floor(SCALE * x)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    some = vectors.filter(F.col(ident).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)
    q = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return checkpointed(some.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), q.alias("q")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums are whole there, else in longs."""
    most = np.sqrt((a * a).sum(1).max(initial=0) * (x * x).sum(1).max(initial=0))
    if most < 1 << 52:
        return (a @ x.T).astype(np.int64)
    return a.astype(np.int64) @ x.astype(np.int64).T


class Cells:
    """Pivots in the augmented space, and distances to them."""

    def __init__(self, pivots: list[list[int]], width: int, norm: float):
        self.width, self.square = width, norm
        self.pivots = np.zeros((len(pivots), width))
        for i, p in enumerate(pivots):
            self.pivots[i, : len(p)] = p
        self.lift = np.sqrt(np.maximum(0, norm - (self.pivots**2).sum(1)))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.square - (x * x).sum(1)))
        return np.sqrt(np.maximum(0, 2 * self.square - 2 * (x @ self.pivots.T + lift[:, None] * self.lift)))

    def of_anchors(self, a: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + self.square - 2 * a @ self.pivots.T))


def _mapped(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(over, schema)


def cells_of(rows: DataFrame, pivots: int) -> Cells:
    """Pivots are the rows of the least hashes, a bounded number; the greatest square norm is taken over all rows."""
    norm = F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    width, square = rows.agg(F.max(F.size("q")), F.max(norm)).first()
    picked = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(pivots).select("q").collect()
    return Cells([list(p["q"]) for p in picked], width or 0, square or 0.0)


def placed(rows: DataFrame, cells: Cells, anchors: bool) -> DataFrame:
    """``rows`` with their cell and, for anchors, the distance of its pivot and their own square norm."""
    own = ", away double, square double" if anchors else ""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column(3), cells.width)
        d = cells.of_anchors(x) if anchors else cells.of_rows(x)
        cell = d.argmin(1)
        more = [pa.array(d[np.arange(len(d)), cell]), pa.array((x * x).sum(1))] if anchors else []
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), *more], names=[*batch.schema.names, "cell", *(["away", "square"] if anchors else [])])

    return _mapped(rows.select("row", "vec_id", "label", "q"), place, f"row long, vec_id long, label long, q array<int>, cell int{own}")


def _blocked(df: DataFrame, size: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``df`` with a ``block`` inside its cell, of about ``size`` rows, and the list of all (cell, block)."""
    counts = dict(df.groupBy("cell").count().collect())  # a row a pivot
    slices = {c: max(1, -(-n // size)) for c, n in counts.items()}
    many = F.lit(1) if not slices else F.element_at(F.create_map(*[F.lit(v) for kv in slices.items() for v in kv]), F.col("cell"))
    return df.withColumn("block", F.pmod(F.xxhash64("row"), many).cast("int")), [(c, b) for c, n in sorted(slices.items()) for b in range(n)]


def served(rows: DataFrame, cells: Cells, reach: dict[int, float], where: str) -> DataFrame:
    """``rows`` once for each anchor group (``to``) that they may serve: those of other cells, or of all, within its reach."""
    groups = np.array(sorted(reach), np.int64)
    far = np.array([reach[g] for g in groups.tolist()]) * (1 + 1e-9) + 1e-6

    def serve(batch: pa.RecordBatch) -> pa.RecordBatch:
        d = cells.of_rows(_matrix(batch.column(3), cells.width))[:, groups]
        hit = d <= far
        if where == "other":
            hit &= groups != batch.column(4).to_numpy()[:, None]
        row, to = np.nonzero(hit)
        out = batch.take(pa.array(row))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(groups[to].astype(np.int32))], names=[*batch.schema.names, "to"])

    columns = "row long, vec_id long, label long, q array<int>, cell int, block int"
    return _mapped(rows.select("row", "vec_id", "label", "q", "cell", "block"), serve, columns + ", to int")


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by lesser id, in that order."""
    some = np.arange(len(score))
    if len(score) > most:
        some = np.nonzero(score >= np.partition(score, len(score) - most)[len(score) - most])[0]
    return some[np.lexsort((ids[some], -score[some]))[:most]]


def _join(anchors: DataFrame, anchor_blocks: list, rows: DataFrame, row_blocks: list, pick: Callable, extra: list[str]) -> DataFrame:
    """(row, place, score, other) that ``pick`` finds where a block of anchors meets a block of rows of its ``to`` group."""
    per: dict[int, list[int]] = {}
    for g, b in anchor_blocks:
        per.setdefault(g, []).append(b)
    if not per:
        return anchors.sparkSession.createDataFrame([], "row long, place int, score long, other long")
    split = F.create_map(*[x for g, bs in per.items() for x in (F.lit(g), F.array(*map(F.lit, bs)))])
    met = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(b).alias("b")) for c, b in row_blocks])
    left = anchors.select("row", "vec_id", "label", "q", *extra, F.col("cell").alias("to"), F.col("block").alias("part"), F.explode(met).alias("m")).select("*", F.col("m.c").alias("cell"), F.col("m.b").alias("block")).drop("m")
    right = rows.select("row", "vec_id", "label", "q", "to", F.explode(F.element_at(split, F.col("to"))).alias("part"), "cell", "block")
    schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("other", pa.int64())])

    def local(a: pa.Table, x: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if a.num_rows and x.num_rows:
            width = max(int(t.column("q").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (a, x))
            am, xm = _matrix(a.column("q"), width), _matrix(x.column("q"), width)
            ids, labels = x.column("vec_id").to_numpy(), x.column("label").to_numpy()
            for lo in range(0, a.num_rows, HELD):
                scores = _products(am[lo : lo + HELD], xm)
                for i, (anchor, score) in enumerate(zip(a.slice(lo, HELD).drop_columns(["q"]).to_pylist(), scores)):
                    for place, best in pick(anchor, score, ids, labels):
                        out[0].extend([anchor["row"]] * len(best))
                        out[1].extend([place] * len(best))
                        out[2].extend(score[best].tolist())
                        out[3].extend(ids[best].tolist())
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    keys = ("to", "part", "cell", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(local, "row long, place int, score long, other long")


def _top(found: DataFrame, by: list[str], most: int, out: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "other")
    return found.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= most)


def _reach(anchors: DataFrame, least: str) -> dict[int, float]:
    """How far from a group's pivot a row can lie that reaches the score ``least`` at one of its anchors (null: any)."""
    radius = F.sqrt(F.greatest(F.lit(0.0), F.col("square") + F.col("norm") - 2 * F.col(least)))
    far = F.when(F.col(least).isNull(), float("inf")).otherwise(F.col("away") + radius)
    return dict(anchors.groupBy("cell").agg(F.max(far)).collect())  # a row a pivot


def mined(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE, every: int = 100, relabel: int | None = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; rows whose vec_id is divisible by ``relabel`` take the next
    of ``labels`` labels first. Defined cases: rows with a null vec_id, label, vector or component, a component that is not
    finite or is LARGEST or more take no part; a shorter vector is padded with zeros; ties go to the smaller vec_id; rows that
    share a vec_id count one by one, but none of them is a positive of an anchor of that vec_id; an anchor without positives, or
    whose windows are empty, has no rows; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = quantised(vectors)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    few = rows.filter(F.col("vec_id") % every == 0)
    count = few.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = cells_of(rows, min(MOST_PIVOTS, max(LEAST_PIVOTS, count // PIVOT_ANCHORS)))
    data, row_blocks = _blocked(checkpointed(placed(rows, cells, False)), ROW_BLOCK)
    anchors, anchor_blocks = _blocked(checkpointed(placed(few, cells, True)), ANCHOR_BLOCK)
    anchors = anchors.withColumn("norm", F.lit(cells.square))

    def same(anchor: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        some = np.nonzero((labels == anchor["label"]) & (ids != anchor["vec_id"]))[0]
        yield 0, some[_best(score[some], ids[some], positives)]

    def other(anchor: dict, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> Iterator[tuple]:
        differs = labels != anchor["label"]
        for w in anchor["windows"]:
            some = np.nonzero(differs & (100 * score >= share * w["score"]) & (score <= w["score"]))[0]
            yield w["place"], some[_best(score[some], ids[some], negatives)]

    # within cells: as many positives as there are bound the scores of the rest
    home = checkpointed(_top(_join(anchors, anchor_blocks, data.withColumn("to", F.col("cell")), row_blocks, same, []), ["row"], positives, "place"))
    bound = home.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == positives).drop("n")
    reach = _reach(anchors.join(bound, "row", "left"), "least")
    more = _join(anchors, anchor_blocks, served(data, cells, reach, "other"), row_blocks, same, [])
    found = checkpointed(_top(home.drop("place").unionByName(more.drop("place")), ["row"], positives, "place"))
    discard(home)
    # a window of scores for each positive that is not negative
    windows = found.filter("score >= 0").groupBy("row").agg(F.collect_list(F.struct("place", "score")).alias("windows"), F.min(F.ceil(F.col("score") * share / 100) - 1).alias("least"))
    asked = checkpointed(anchors.join(windows, "row"))
    reach = _reach(asked, "least")
    hard = _join(asked, anchor_blocks, served(data, cells, reach, "all"), row_blocks, other, ["windows"]) if reach else None
    if hard is None:
        hard = spark.createDataFrame([], "row long, place int, score long, other long")
    best = _top(hard, ["row", "place"], negatives, "rank").select("row", "place", "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("row", "place", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(best, ["row", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))
