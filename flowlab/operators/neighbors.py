"""Exact k nearest neighbours, nearest-neighbour voting and synthetic minority rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowlab.operators.sampling import class_counts, undersample
from flowlab.session import materialised
from flowlab.tables import numeric_matrix, ref, settled, tick, ticks

# A base table of at most this many numbers is shipped to the tasks in one piece.
SHIPPED_VALUES = 16_000_000
# A larger base table is cut into cells of about this many rows around pivots, at most so many of them.
CELL_ROWS, MAX_PIVOTS = 2_000, 4_096
# Query rows of one task of a cell, and base rows that it takes in at a time.
QUERY_ROWS, BASE_ROWS = 20_000, 4_096
# Rows of a class whose neighbours one task of synthetic rows finds.
FILL_ROWS = 1_000
# Distance cells held at a time.
CELLS = 4_000_000
# Candidate pairs measured exactly at a time.
PAIRS = 100_000


def nearest(queries, base, base_ids, k):
    """k nearest base rows of every query by Euclidean distance, then by id.

    A matrix product gives distances up to a known rounding error; every base row
    that might be among the k nearest within that error is then measured exactly.
    Returns query index, base index and distance arrays, k rows per query."""
    k = min(k, len(base))
    if k == 0 or len(queries) == 0:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    base_sq = (base * base).sum(axis=1)
    step = max(1, CELLS // len(base))
    found = []
    for start in range(0, len(queries), step):
        q = queries[start:start + step]
        q_sq = (q * q).sum(axis=1)
        rough = q_sq[:, None] + base_sq[None, :] - 2.0 * (q @ base.T)
        slack = 8.0 * base.shape[1] * np.finfo(float).eps * (q_sq + base_sq.max()) + 1e-300
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2.0 * slack
        qi, bj = np.nonzero(rough <= limit[:, None])
        distance = np.concatenate([
            np.sqrt(((base[bj[i:i + PAIRS]] - q[qi[i:i + PAIRS]]) ** 2).sum(axis=1))
            for i in range(0, len(qi), PAIRS)])
        order = np.lexsort((base_ids[bj], distance, qi))
        qi, bj, distance = qi[order], bj[order], distance[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
        best = place < k
        found.append((start + qi[best], bj[best], distance[best]))
    return tuple(np.concatenate(part) for part in zip(*found))


def knn_join(queries, base, k, query_id="id", base_id="id", vector="vector", carry=None,
             shipped_values=SHIPPED_VALUES, block_rows=CELL_ROWS):
    """query, neighbour, rank, distance[, carry] for the k nearest base rows.

    Only the k smallest ids of equal base vectors can ever be among the k nearest,
    so further copies go first. A base table whose size is checked to be small is
    shipped to the query tasks. A larger one is cut into cells around pivots, and base
    rows only go to query cells that they can be near to (``_pivot_pairs``), which gives
    the same result."""
    spark = queries.sparkSession
    carried = [] if carry is None else [carry]
    distinct = (base.select(ref(base_id).alias("neighbour"), ref(vector).alias("base_vector"),
                            *[ref(c).alias("carry") for c in carried])
                .withColumn("_copy", F.row_number().over(
                    Window.partitionBy("base_vector").orderBy("neighbour")))
                .where(F.col("_copy") <= k).drop("_copy"))
    probe = queries.select(ref(query_id).alias("query"), ref(vector).alias("vector"))
    types = dict(distinct.dtypes)
    schema = f"query {dict(probe.dtypes)['query']}, neighbour {types['neighbour']}, distance double"
    if carried:
        schema += f", carry {types['carry']}"
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("base_vector")).alias("p")).first()

    def neighbours(pdf, base_pdf, base_matrix):
        ids = base_pdf["neighbour"].to_numpy()
        q, b, d = nearest(np.stack(pdf["vector"].to_numpy()).astype(np.float64), base_matrix, ids, k)
        out = pd.DataFrame({"query": pdf["query"].to_numpy()[q], "neighbour": ids[b], "distance": d})
        if carried:
            out["carry"] = base_pdf["carry"].to_numpy()[b]
        return out

    if size["n"] * (size["p"] or 0) <= shipped_values:
        local = distinct.toPandas()
        matrix = np.stack(local.pop("base_vector").to_numpy()).astype(np.float64) if len(local) else np.empty((0, 0))
        shipped = spark.sparkContext.broadcast((local, matrix))

        def scan(batches):
            for pdf in batches:
                if len(pdf):
                    yield neighbours(pdf, *shipped.value)

        pairs = probe.mapInPandas(scan, schema)
    else:
        pairs = _pivot_pairs(probe, distinct, k, size["n"], block_rows, schema)
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def _matrix(column):
    """A list column of an Arrow batch as a float64 matrix."""
    return np.stack([np.asarray(v.values, dtype=np.float64) for v in column]) if len(column) else np.empty((0, 0))


def pivot_distances(x, pivots):
    """Distances to all pivots, as far above or below the true ones as rounding allows."""
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    slack = 8.0 * pivots.shape[1] * np.finfo(float).eps * square + 1e-300
    rough = square - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(rough - slack, 0.0)), np.sqrt(np.maximum(rough, 0.0) + slack)


def _smallest_reaches(df, shipped, k):
    """Per cell: rows, the largest distance to the pivot, and the k smallest; each task sends k numbers a
    cell at most."""
    def work(batches):
        pivots = shipped.value
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            _, high = pivot_distances(_matrix(batch.column("vector")), pivots)
            cell = high.argmin(axis=1)
            reach = high[np.arange(len(cell)), cell]
            for c in np.unique(cell):
                mine = reach[cell == c]
                n, most, least = held.get(c, (0, 0.0, np.empty(0)))
                held[c] = n + len(mine), max(most, mine.max()), np.sort(np.append(least, mine))[:k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()),
             pa.array([v[1] for v in held.values()], pa.float64()),
             pa.array([v[2].tolist() for v in held.values()], pa.list_(pa.float64()))], names=["cell", "n", "most", "least"])

    parts = df.select("vector").mapInArrow(work, "cell int, n bigint, most double, least array<double>")
    return parts.groupBy("cell").agg(
        F.sum("n").alias("n"), F.max("most").alias("most"),
        F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, k).alias("least")).collect()


def _farthest(pivots, query_cells, base_cells, k):
    """Per query cell a distance within which each of its queries has k base rows: from a query over
    both pivots to the rows nearest to the base pivot."""
    near = np.full((len(pivots), k), np.inf)
    for r in base_cells:
        near[r["cell"], :len(r["least"])] = r["least"]
    out = {}
    for r in query_cells:
        _, between = pivot_distances(pivots[r["cell"]][None, :], pivots)
        ways = (between[0][:, None] + near).ravel()
        out[r["cell"]] = r["most"] + (np.partition(ways, k - 1)[k - 1] if len(ways) >= k else np.inf)
    return out


def _tasks_of(cells, pivots, rows):
    """Per cell with queries the first of its tasks and how many it has: cells stand by their pivot's distance
    to the first pivot, and their queries in a row are cut into tasks of ``rows``."""
    _, way = pivot_distances(pivots[:1], pivots)
    out, before = {}, 0
    for r in sorted(cells, key=lambda r: (way[0][r["cell"]], r["cell"])):
        first, last = before // rows, (before + r["n"] - 1) // rows
        out[r["cell"]] = first, last - first + 1
        before += r["n"]
    return out


def _pivot_pairs(probe, base, k, n, cell_rows, schema):
    """The k nearest base rows of every query, by cells around pivots (exact).

    Queries belong to the cell of their nearest pivot. From the k smallest distances in every base cell
    follows how far the k-th neighbour of any query of a cell can be; a base row concerns a cell only
    if its distance to that cell's pivot is not larger than the cell's radius and this bound together.
    A task has the queries of several cells, or some of a large cell's, and is sent each base row that
    concerns any of them once: rows sent grow with the tasks, not with the cells. It holds its queries
    and the best k rows so far; base rows come in by their distance to the nearest pivot, and a row that
    can't beat any k-th distance of a cell any more is passed over there."""
    spark = base.sparkSession
    m = max(1, min(MAX_PIVOTS, n // cell_rows))
    chosen = base.select("base_vector", F.xxhash64("neighbour").alias("h")).orderBy("h").limit(m).collect()
    pivots = np.array([r["base_vector"] for r in chosen], dtype=np.float64)
    if not len(pivots):
        return spark.createDataFrame([], schema)
    probe = materialised(probe, "queries")
    base = materialised(base.withColumnRenamed("base_vector", "vector"), "base")
    shipped = spark.sparkContext.broadcast(pivots)
    query_cells = _smallest_reaches(probe, shipped, k)
    most = {r["cell"]: r["most"] for r in query_cells}
    bound = _farthest(pivots, query_cells, _smallest_reaches(base, shipped, k), k)
    parallel = spark.sparkContext.defaultParallelism
    rows_of_task = max(1, min(QUERY_ROWS, -(-sum(r["n"] for r in query_cells) // parallel)))
    plan = spark.sparkContext.broadcast((most, bound, _tasks_of(query_cells, pivots, rows_of_task)))
    types = {f.name: f.dataType for f in [*probe.schema, *base.schema]}
    carried = ["carry"] if "carry" in base.columns else []
    sent = ", ".join(["cell int", "part int", "far double", f"query {types['query'].simpleString()}",
                      f"neighbour {types['neighbour'].simpleString()}", "vector array<double>",
                      *[f"carry {types[c].simpleString()}" for c in carried]])
    names = ["cell", "part", "far", "query", "neighbour", "vector", *carried]

    def sent_batch(batch, rows, cell, part, far, kinds):
        """Rows of a batch under the common schema; columns of the other side are null."""
        taken = batch.take(pa.array(rows, pa.int64()))
        columns = {"cell": pa.array(cell, pa.int32()), "part": pa.array(part, pa.int32()), "far": pa.array(far, pa.float64()),
                   "vector": taken.column("vector").cast(pa.list_(pa.float64()))}
        for c in ("query", "neighbour", *carried):
            columns[c] = taken.column(c) if c in batch.schema.names else pa.nulls(len(rows), kinds[c])
        return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    kinds = {c: to_arrow_type(types[c]) for c in ("query", "neighbour", *carried)}

    def ask(batches):
        pivots, tasks_of = shipped.value, plan.value[2]
        for batch in batches:
            if batch.num_rows:
                _, high = pivot_distances(_matrix(batch.column("vector")), pivots)
                cell = high.argmin(axis=1)
                first, spreads = np.array([tasks_of[c] for c in cell]).T
                part = first + np.arange(len(cell)) * 7919 % spreads
                # queries come first: no distance is below zero
                yield sent_batch(batch, np.arange(len(cell)), cell, part, np.full(len(cell), -1.0), kinds)

    def offer(batches):
        pivots, (most, bound, tasks_of) = shipped.value, plan.value
        if not most:
            return
        cells = np.array(sorted(most, key=lambda c: tasks_of[c]), dtype=np.int64)
        limit = np.array([most[c] + bound[c] for c in cells]) * (1 + 1e-12)
        first, spreads = np.array([tasks_of[c] for c in cells]).T
        inside = [np.flatnonzero((first <= t) & (t < first + spreads)) for t in range(int((first + spreads).max()))]
        step = max(1, CELLS // len(cells))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                low, _ = pivot_distances(_matrix(batch.column("vector")), pivots[cells])
                low[low > limit] = np.inf
                for t, own in enumerate(inside):
                    far = low[:, own].min(axis=1)
                    row = np.flatnonzero(far < np.inf)
                    for a in range(0, len(row), BASE_ROWS):
                        cut = row[a:a + BASE_ROWS]
                        yield sent_batch(batch, cut, np.full(len(cut), -1), np.full(len(cut), t), far[cut], kinds)

    def answer(batches):
        pivots, (most, bound, _) = shipped.value, plan.value
        here, asked, states = None, [], None
        for batch in batches:
            part, far = (np.asarray(batch.column(c)) for c in ("part", "far"))
            asks = far < 0
            cut = 1 + np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1]))
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(part)]):
                if a == b:
                    continue
                if part[a] != here:
                    for state in states or ():
                        yield from state.rows(names, carried)
                    here, asked, states = part[a], [], None
                piece = batch.slice(a, b - a)
                if asks[a]:
                    asked.append(piece)
                    continue
                if states is None:
                    states = _states(asked, k, most, bound)
                    centres = pivots[[s.cell for s in states]]
                x = _matrix(piece.column("vector"))
                ids = np.array(piece.column("neighbour").to_pylist())
                carry = np.empty(len(ids), object)
                carry[:] = piece.column("carry").to_pylist() if carried else [None] * len(ids)
                low, _ = pivot_distances(x, centres) if states else (None, None)
                for place, state in enumerate(states):
                    near = np.flatnonzero(state.concerned(low[:, place]))
                    if len(near):
                        state.take(x[near], ids[near], carry[near])
        for state in states or ():
            yield from state.rows(names, carried)

    both = probe.mapInArrow(ask, sent).union(base.mapInArrow(offer, sent))
    return both.repartition(4 * parallel, "part").sortWithinPartitions("part", "far").mapInArrow(answer, schema)


def _states(asked, k, most, bound):
    """A state for each cell of a task's queries."""
    if not asked:
        return []
    rows = pa.Table.from_batches(asked).combine_chunks().to_batches()[0]
    cell = np.asarray(rows.column("cell"))
    return [_Nearest(rows.take(pa.array(np.flatnonzero(cell == c))), c, k, most[c], bound[c]) for c in np.unique(cell)]


class _Nearest:
    """The best k base rows so far of a task's queries of one cell."""

    def __init__(self, asked, cell, k, radius, bound):
        self.query, self.x = asked.column("query"), _matrix(asked.column("vector"))
        self.cell, self.k, self.radius, self.limit = cell, k, radius, (radius + bound) * (1 + 1e-12)
        self.q = np.empty(0, int)
        self.distance = np.empty(0)
        self.ids, self.carry = np.empty(0, object), np.empty(0, object)
        self.kth = np.inf

    def concerned(self, low):
        """Which base rows, by their least distance to the pivot, can be among the k nearest: a base row is no
        nearer to a query than its way to the pivot less the query's."""
        return (low <= self.limit) & (low - self.radius <= self.kth * (1 + 1e-9))

    def take(self, x, ids, carry):
        q, b, d = nearest(self.x, x, ids, self.k)
        kept = np.empty(len(ids), object)
        kept[:] = ids.tolist()
        self.q, self.distance = np.append(self.q, q), np.append(self.distance, d)
        self.ids, self.carry = np.append(self.ids, kept[b]), np.append(self.carry, carry[b])
        order = np.lexsort((np.array(self.ids.tolist()), self.distance, self.q))
        q = self.q[order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q, "left") < self.k]
        self.q, self.distance, self.ids, self.carry = (x[order] for x in (self.q, self.distance, self.ids, self.carry))
        if len(self.q) == self.k * len(self.x):
            self.kth = self.distance[self.k - 1::self.k].max()

    def rows(self, names, carried):
        columns = {"query": self.query.take(pa.array(self.q)), "neighbour": pa.array(self.ids.tolist()),
                   "distance": pa.array(self.distance)}
        if carried:
            columns["carry"] = pa.array(self.carry.tolist())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def knn_vote(neighbours):
    """Most frequent neighbour class per query; the smallest class wins ties."""
    votes = neighbours.groupBy("query", ref("carry").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query").agg(
        F.min(F.struct((-F.col("n")).alias("m"), "class")).getField("class").alias("prediction"))


def smote_targets(df, label, target=5_000):
    """Classes below the target with the number of synthetic rows they lack."""
    return class_counts(df, label).where((F.col("n") > 0) & (F.col("n") < target)).select(
        "label", "n", (F.lit(target) - F.col("n")).cast("bigint").alias("missing"))


def smote_draws(targets, k, seed=0):
    """label, start, pick, step of every synthetic row: number of the row it starts from, which of its k
    neighbours it goes to (from 0) and how far, from the md5 of seed, class and counter. The digest's
    first, second and third eight hexadecimal digits are the three draws."""
    counter = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("missing") - 1))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("label").cast("string"), F.col("counter").cast("string")))

    def draw(at):
        return F.conv(F.substring("digest", at, 8), 16, 10).cast("bigint")

    return (targets.select("label", "n", counter.alias("counter")).withColumn("digest", digest).select(
        "label", (draw(1) % F.col("n")).alias("start"), (draw(9) % k).cast("int").alias("pick"),
        (draw(17) / float(1 << 32)).alias("step")))


def _class_neighbours(numbered, features, k):
    """label, start, pick, x, y: the k nearest other rows of every row in its class (a row's ``place``; ties
    by place). A class has fewer rows than the target, and its rows are dealt over several tasks."""
    copies = numbered.withColumn("_parts", F.ceil(F.col("_n") / FILL_ROWS).cast("int")).withColumn(
        "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    names = [f"_f{i}" for i in range(len(features))]
    columns = copies.select(F.col("_class").alias("label"), "_part", "_parts", "place",
                            *[ref(f).alias(n) for f, n in zip(features, names)])
    kind = columns.schema["label"].dataType.simpleString()

    def near(pdf):
        pdf = pdf.sort_values("place", kind="stable")
        matrix = numeric_matrix(pdf, names)
        own = np.flatnonzero((pdf["place"] % pdf["_parts"] == pdf["_part"]).to_numpy())
        # one spare neighbour, since a row is its own nearest one
        q, b, _ = nearest(matrix[own], matrix, np.arange(len(matrix)), k + 1)
        q, b = q[own[q] != b], b[own[q] != b]
        pick = np.arange(len(q)) - np.searchsorted(q, q, "left")
        q, b, pick = q[pick < k], b[pick < k], pick[pick < k]
        return pd.DataFrame({"label": pdf["label"].iloc[0], "start": own[q], "pick": pick,
                             "x": list(matrix[own[q]]), "y": list(matrix[b])})

    return columns.groupBy("label", "_part").applyInPandas(
        near, f"label {kind}, start bigint, pick int, x array<double>, y array<double>")


def smote(df, label, features, target=5_000, k=5, seed=0, flag="synthetic"):
    """Fill every class below ``target`` rows up with rows on the line between a row and one of its k
    nearest neighbours in the class (fewer if the smallest class has no more rows). Features have no
    missing values.

    Rows of a class are numbered in the order of their features, and draws follow from seed, class and
    counter, so the result is the same in any engine. Classes are never collected: numbers, neighbours
    and draws are joined by class and number."""
    features = list(features)
    kept = df.selectExpr(*[f"cast({t} as double) as {t}" for t in ticks(features)], tick(label)).withColumn(
        flag, F.lit(False))
    targets = settled(smote_targets(df, label, target))
    least = targets.agg(F.min("n")).first()[0]
    if least is None:
        return kept
    if least < 2:
        raise ValueError("a class with a single row has no neighbour to interpolate with")
    k = min(k, least - 1)
    rare = targets.select(F.col("label").alias("_class"), F.col("n").alias("_n"))
    order = Window.partitionBy("_class").orderBy(*[ref(f) for f in features])
    numbered = kept.join(rare, ref(label) == F.col("_class")).withColumn("place", F.row_number().over(order) - 1)
    made = smote_draws(targets, k, seed).join(_class_neighbours(numbered, features, k), ["label", "start", "pick"])
    between = [(F.col("x")[i] + F.col("step") * (F.col("y")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)]
    return kept.unionByName(made.select(*between, F.col("label").alias(label), F.lit(True).alias(flag)))


# Strategy names as users compare them in published tables.
STRATEGIES = ("none", "class_weight", "undersample", "smote", "under+smote")


# What each strategy does to the training rows, in this order; class weights leave them as they are.
STEPS = {"none": (), "class_weight": (), "undersample": ("cut",), "smote": ("fill",), "under+smote": ("cut", "fill")}


def resample(strategy, train, label, ids, features, majority, keep=200_000, target=5_000, seed=0):
    """Rebalance the training rows; the test rows are never touched."""
    if strategy not in STEPS:
        raise ValueError(f"unknown strategy: {strategy}")
    steps = {"cut": lambda rows: undersample(rows, label, ids, majority, keep, seed),
             "fill": lambda rows: smote(rows, label, features, target, seed=seed)}
    for step in STEPS[strategy]:
        train = steps[step](train)
    return train


def resampled_counts(train, label, majority, keep=200_000, target=5_000):
    """Class sizes every strategy leads to, from one class count."""
    counts = class_counts(train, label)
    cut = F.when((F.col("label") == majority) & (F.col("n") > keep), F.lit(keep).cast("bigint")).otherwise(F.col("n"))

    def filled(n):
        return F.greatest(n, F.lit(target).cast("bigint"))

    return counts.select("label", F.inline(F.array(*[
        F.struct(F.lit(s).alias("strategy"), n.alias("n")) for s, n in
        [("none", F.col("n")), ("class_weight", F.col("n")), ("undersample", cut),
         ("smote", filled(F.col("n"))), ("under+smote", filled(cut))]])))
