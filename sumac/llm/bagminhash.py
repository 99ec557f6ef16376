"""Near duplicates by BagMinHash.

A text is the multiset of its SHINGLE-word runs (a shorter text: its words as one run). Of each run with weight w the
levels [0, 1), [1, 2), [2, 4), [4, 8) ... below w carry independent Poisson processes, seeded by run and level and thinned
where w cuts a level; each point falls on one of the registers, and a register keeps its earliest point. Two texts agree in
a register with the probability of their weighted Jaccard similarity. Points are drawn in rising order, and a process stops
once it can't lower any register of its text.

Texts that agree in a whole band of registers are candidates, and are linked if their multisets overlap by SIMILAR or more.
Each member of a bucket of candidates is first verified against one pivot; while a bucket holds several components,
ROUNDS - 1 further rounds take other pivots. What is then still undecided is decided exactly: a pair that is similar enough
shares one of its rarest runs, early enough in both texts' order of rarity, and every pair of two components that does is
verified. Equal texts count as one throughout. The classes are the connected components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumac.llm.text import binaries, bit_filter, blocks, by_block, field, in_filter, lists, mix, row_hashes, run_hashes, sheltered, stored, word_hashes, word_spans

#: Words of a run and the least weighted Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: A pair at SIMILAR shares no band with a probability of (1 - 0.8^5)^28, 2 in 100,000.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Rounds of pivots, and rows of two multisets that a task takes in at a time.
ROUNDS, PAIRS = 4, 500
#: Cells of the table of runs' frequencies (they only order the runs), and texts of a block that meet a run's others at once.
CELLS, DEALT = 1 << 20, 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bags(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, run's hash, weight) of the distinct runs of each row, and two independent hashes of each row's words (the first is 0 where it has none)."""
    n = len(at) - 1
    starts, ends, row = word_spans(data, at)
    words = word_hashes(data, starts, ends)
    edge = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(edge)
    first = np.flatnonzero((np.arange(len(words)) + SHINGLE <= edge[row + 1]) | ((size[row] < SHINGLE) & (np.arange(len(words)) == edge[row])))
    own = row[first]
    short = row_hashes(words, edge, seed=1)[own]
    runs = np.append(run_hashes(words, SHINGLE, seed=1), np.zeros(SHINGLE, np.uint64))[first]
    runs = np.where(size[own] < SHINGLE, short, runs)
    _, where, weight = np.unique(runs ^ mix(own.astype(np.uint64) + _STEP), return_index=True, return_counts=True)
    order = np.argsort(own[where], kind="stable")
    where, weight = where[order], weight[order]
    return own[where], runs[where], weight, *identities(data, starts, ends, words, edge)


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    whole = row_hashes(words, edge, seed=2)
    whole[whole == 0] = 1
    whole[np.diff(edge) == 0] = 0
    return whole, row_hashes(word_hashes(data, starts, ends, seed=1), edge, seed=3)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, runs: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The registers of n rows: the earliest points' times."""
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    unit = np.repeat(np.arange(len(runs)), levels)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(levels) - levels, levels)
    seed = mix(runs[unit] + level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    rate = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    own, share = row[unit], np.minimum(1.0, weight[unit] / rate - (level > 0))  # of the level that lies below the weight
    registers = np.full((n, REGISTERS), np.inf)
    flat = registers.ravel()
    time = np.zeros(len(unit))
    step = 0
    while len(unit):
        step += 1
        drawn = mix(seed + np.uint64(step * int(_STEP) % 2**64))
        time = time - np.log(_uniform(drawn)) / rate
        placed = mix(drawn)
        cell = own * REGISTERS + (placed & np.uint64(0xFFFFFF)).astype(np.int64) % REGISTERS
        kept = _uniform(mix(placed)) < share
        np.minimum.at(flat, cell[kept], time[kept])
        latest = registers.max(1)
        live = time < latest[own]
        unit, seed, rate, own, share, time = (x[live] for x in (unit, seed, rate, own, share, time))
    return registers


def signed(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """docs with node and other (two hashes of the text's words; node is null if it has none), size (runs) and bands (their hashes)."""

    def make(rows, data, at):
        row, runs, weight, whole, other = bags(data, at)
        n = len(rows)
        registers = signatures(row, runs, weight, n).view(np.uint64).reshape(n * BANDS, ROWS)
        total = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), n) * _STEP
        for k in range(ROWS):
            total = mix(total + registers[:, k])
        some = whole != 0
        size = np.bincount(row, weight, n).astype(np.int64)
        node = pa.array(whole.view(np.int64), mask=~some)
        return [node, pa.array(other.view(np.int64)), pa.array(size), lists(total.view(np.int64).reshape(n, BANDS)[some].ravel(), np.where(some, BANDS, 0), pa.int64())]

    return by_block(docs, make, [("node", T.LongType()), ("other", T.LongType()), ("size", T.LongType()), ("bands", T.ArrayType(T.LongType()))], text, keep)


def _bagged(docs: DataFrame, text: str, wanted: np.ndarray) -> DataFrame:
    """(node, other, bag) of the texts that the filter lets pass: each run and its number among equal ones as 64 bits, in order."""
    source = docs.select(field(docs, text).cast("string").alias("text"))

    def run(batches):
        for rows, data, at in blocks(batches, "text"):
            starts, ends, row = word_spans(data, at)
            edge = np.searchsorted(row, np.arange(len(rows) + 1))
            whole, _ = identities(data, starts, ends, word_hashes(data, starts, ends), edge)
            hit = np.flatnonzero(in_filter(wanted, whole) & (whole != 0))
            hit = hit[np.unique(whole[hit], return_index=True)[1]]
            if not len(hit):
                continue
            part = np.concatenate([data[at[k] : at[k + 1]] for k in hit])
            row, runs, weight, whole, other = bags(part, np.concatenate([[0], np.cumsum(at[hit + 1] - at[hit])]))
            nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
            own = np.repeat(row, weight)
            units = mix(np.repeat(runs, weight) + nth.astype(np.uint64) * _STEP)
            units = units[np.lexsort((units, own))]
            columns = [pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), binaries(units, np.bincount(own, minlength=len(hit)))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "other", "bag"])

    return source.mapInArrow(run, "node long, other long, bag binary")


def apart(frame: DataFrame, shared: DataFrame | None) -> DataFrame:
    """The frame (node, other, ...) with a node of its own for each text of those that share one; ``shared``: (node, first) of such nodes, None if there are none."""
    if shared is None:
        return frame
    met = frame.join(shared, "node", "left")
    return met.withColumn("node", F.when(F.col("other") != F.col("first"), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("first")


def shared_nodes(rows: DataFrame) -> DataFrame | None:
    """(node, first) of the nodes that are the hash of different texts, by their second hash; None if there are none."""
    met = rows.where("node is not null").groupBy("node").agg(F.min("other").alias("first"), F.max("other").alias("last")).where("first <> last")
    return None if met.isEmpty() else stored(met.drop("last"))


def _verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The pairs (node, pivot) whose multisets are similar enough."""
    both = pairs.join(bag, "node").withColumnRenamed("bag", "a").join(bag.select(F.col("node").alias("pivot"), F.col("bag").alias("b")), "pivot").select("node", "pivot", "a", "b")

    def run(batches):
        for rows in batches:
            like = []
            for a, b in zip(rows.column("a"), rows.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                like.append(shared >= SIMILAR * (len(x) + len(y) - shared) - 1e-9)
            keep = pa.array(like, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("node").filter(keep), rows.column("pivot").filter(keep)], ["node", "pivot"])

    return both.mapInArrow(run, "node long, pivot long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the edges: the least node of its component, by least labels and jumps to the label's label."""
    ends = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = stored(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("c")))
    while True:
        near = ends.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("d"))
        least = label.join(near, "u").select("u", F.least("c", "d").alias("e"), F.col("c").alias("old"))
        jump = least.select(F.col("u").alias("e"), F.col("e").alias("f"))
        new = stored(least.join(jump, "e").select("u", F.col("f").alias("c"), "old"))
        label = new.select("u", "c")
        if new.where("c <> old").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("c").alias("component"))


def _pivots(members: DataFrame, pick: Column, tested: DataFrame | None) -> DataFrame:
    """Of buckets with several components each member of another component than the pivot's, with the pivot; sizes must allow a link."""
    chosen = members.groupBy("bucket").agg(pick.alias("p"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket", "p.*")
    pairs = members.join(chosen, "bucket").where(
        (F.col("component") != F.col("pivot_component")) & (F.least("size", "pivot_size") >= SIMILAR * F.greatest("size", "pivot_size") - 1e-9)
    )
    pairs = pairs.select(F.least("node", "pivot").alias("node"), F.greatest("node", "pivot").alias("pivot")).distinct()
    return pairs if tested is None else pairs.join(tested, ["node", "pivot"], "left_anti")


def _frequencies(bag: DataFrame) -> np.ndarray:
    """How many units of the bags fall on each cell. Its size is fixed; cells that several share make the order less apt, not wrong."""

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for rows in batches:
            for a in rows.column("bag"):
                np.add.at(total, (np.frombuffer(a.as_buffer(), np.uint64) % np.uint64(CELLS)).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    got = bag.select("bag").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    total = np.zeros(CELLS, np.int64)
    total[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return total


def _rarest(bag: DataFrame, often: np.ndarray) -> DataFrame:
    """(unit, node, component, size, at) of the units that may be the first that a text shares with a similar one, in the order of
    their rarity: with SIMILAR of its units or more from there on."""

    def run(batches):
        for rows in batches:
            node, component = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component"))
            units, sizes, counts = [], [], []
            for a in rows.column("bag"):
                x = np.frombuffer(a.as_buffer(), np.uint64)
                count = int(len(x) - SIMILAR * len(x) + 1e-6) + 1
                units.append(x[np.lexsort((x, often[(x % np.uint64(CELLS)).astype(np.int64)]))[:count]])
                sizes.append(len(x))
                counts.append(len(units[-1]))
            if not units:
                continue
            first = np.repeat(np.cumsum(counts) - counts, counts)
            columns = [np.concatenate(units).view(np.int64), np.repeat(node, counts), np.repeat(component, counts), np.repeat(sizes, counts), np.arange(sum(counts)) - first]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["unit", "node", "component", "size", "at"])

    return bag.mapInArrow(run, "unit long, node long, component long, size long, at long")


def _rest(current: DataFrame, bag: DataFrame, tested: DataFrame) -> DataFrame | None:
    """The links among all texts of buckets that hold several components yet (of two texts: both have met), each pair of two
    components decided: those that share no rare unit, or only too late, can't be similar; all others are verified.

    The texts of a unit's largest component aren't joined with each other, and others meet the unit's texts in blocks, so that
    a hot unit is dealt over tasks.
    """
    several = current.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n")).where("least <> most and n > 2")
    left = stored(current.join(several.select("bucket"), "bucket", "left_semi").select("node", "component").distinct())
    if left.isEmpty():
        return None
    whole = stored(bag.join(left, "node"))
    rare = stored(_rarest(whole, _frequencies(whole)), PAIRS)
    of = rare.groupBy("unit", "component").agg(F.count("*").alias("n")).groupBy("unit")
    heads = of.agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count("*").alias("kinds"), (F.sum("n") - F.max("n")).alias("others")).where("kinds > 1")
    parts = F.ceil(F.col("others") / DEALT).cast("int")
    shared = stored(rare.join(heads.select("unit", "top", parts.alias("parts")), "unit"))
    a = shared.where("component <> top").select("unit", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"a_{c}") for c in ("node", "component", "size", "at")])
    b = shared.select("unit", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "top", "node", "component", "size", "at")
    after = F.least(F.col("size") - F.col("at"), F.col("a_size") - F.col("a_at"))
    close = (F.col("component") != F.col("a_component")) & ((F.col("component") == F.col("top")) | (F.col("a_node") < F.col("node")))
    met = a.join(b, ["unit", "part"]).where(close & (after * (1 + SIMILAR) >= SIMILAR * (F.col("size") + F.col("a_size")) - 1e-6))
    pairs = met.select(F.least("node", "a_node").alias("node"), F.greatest("node", "a_node").alias("pivot")).distinct()
    links = stored(_verified(pairs.join(tested, ["node", "pivot"], "left_anti"), bag), PAIRS)
    return None if links.isEmpty() else links


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The labels (node, component) after further links; None: there were none."""
    if labels is None:
        return components(links, "node", "pivot")
    named = labels.select(F.col("node").alias("n"), "component")
    a = links.join(named, F.col("node") == F.col("n"), "left").select(F.coalesce("component", "node").alias("node"), "pivot")
    b = a.join(named, F.col("pivot") == F.col("n"), "left").select("node", F.coalesce("component", "pivot").alias("pivot"))
    moved = components(b.where("node <> pivot"), "node", "pivot").withColumnsRenamed({"node": "from", "component": "to"})
    whole = labels.unionByName(links.select("node").union(links.select("pivot")).distinct().join(labels, "node", "left_anti").withColumn("component", F.col("node")))
    return stored(whole.join(moved, F.col("component") == F.col("from"), "left").select("node", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs with class_id (long: the least doc_id of the row's class), class_size (long: its rows) and kept (boolean: true for
    one row of each class, that with the least doc_id).

    A null text, or one without words, is alone in its class. Equal word sequences are one class, as are texts linked by a
    chain of near duplicates; two independent 64-bit hashes tell texts apart. Null ids come after all others; a class of such rows only has a null class_id. Of repeated
    rows one is kept. A column of docs that has the name of a new one is replaced. Jobs run while the result is made.
    """
    names = ["class_id", "class_size", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    source = docs.select(F.struct(*[field(docs, c) for c in keep]).alias("__row"), field(docs, doc_id).cast("long").alias("__id"), field(docs, text).cast("string").alias("__whole"))
    rows = stored(signed(source, "__whole", ["__row", "__id"]).withColumn("__at", F.monotonically_increasing_id()))  # numbered once, in the table
    shared_node = shared_nodes(rows)
    rows = apart(rows, shared_node)
    some = rows.where("node is not null")
    nodes = some.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    dealt = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    members = stored(dealt.join(shared, "bucket"))
    linked = _linked(docs, text, members, shared_node)

    best = F.struct(F.col("__id").isNull().alias("gone"), F.col("__id").alias("id"), F.col("__at").alias("at"))
    own = some.groupBy("node").agg(F.min(best).alias("best"), F.count("*").alias("n"))
    own = own.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = own.groupBy("component").agg(F.min("best").alias("b"), F.sum("n").alias("class_size"))
    found = own.select("node", "component").join(classes, "component").select(F.col("node").alias("__node"), F.col("b.id").alias("class_id"), "class_size", F.col("b.at").alias("__best"))
    slim = rows.select("__row", "__id", "__at", "node")
    out = slim.where("node is not null").join(found, F.col("node") == F.col("__node")).unionByName(slim.where("node is null"), allowMissingColumns=True)
    alone = F.col("__node").isNull()
    return out.select(
        *[F.col("__row")[c].alias(c) for c in keep],
        F.when(alone, F.col("__id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("__at") == F.col("__best"))).alias("kept"),
    )


def _linked(docs: DataFrame, text: str, members: DataFrame, shared: DataFrame | None) -> DataFrame:
    """(node, component) of the nodes that have links."""
    wanted = members.select("node") if shared is None else members.select("node").union(shared.select("node"))
    bag = stored(apart(_bagged(docs, text, bit_filter(wanted, "node")), shared).groupBy("node").agg(F.first("bag").alias("bag")))
    current, tested = members.withColumn("component", F.col("node")), None
    labels = None
    seat = F.struct(F.col("node").alias("pivot"), F.col("component").alias("pivot_component"), F.col("size").alias("pivot_size"))
    for k in range(ROUNDS):
        order = F.struct("node") if k == 0 else F.struct(F.xxhash64("node", "bucket", F.lit(k)), "node")
        pairs = stored(_pivots(current, F.min_by(seat, order), tested))
        if pairs.isEmpty():
            break
        links = stored(_verified(pairs, bag), PAIRS)
        tested = pairs if tested is None else stored(tested.unionByName(pairs))
        if links.isEmpty():
            continue
        labels = _merged(labels, links)
        current = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if tested is not None:
        links = _rest(current, bag, tested)
        labels = labels if links is None else _merged(labels, links)
    return labels if labels is not None else members.select("node", F.col("node").alias("component")).limit(0)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one of each class, with all their columns as they were."""
    frame, back = sheltered(docs, ["class_id", "class_size", "kept"])
    return back(near_duplicates(frame, text, doc_id).where("kept"))
