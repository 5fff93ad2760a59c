"""Near-duplicate documents by ProbMinHash over weighted five-word shingles, banding and verification.

A shingle is k consecutive words (a shorter text is one shingle); its weight is how often the text has
it. Each shingle is a unit-rate Poisson process of arrivals, the same in every document, that its weight
speeds up; an arrival goes to one of bands*rows registers and stays if it is the earliest there. A
shingle stops as soon as its next arrival is later than all registers. The share of equal registers
estimates the probability Jaccard similarity; equal bands make candidates; candidates that the estimate
does not rule out are verified exactly on the shingles. A text that repeats a shingle has a second sketch
with all weights 1, for the plain Jaccard similarity; for the others both sketches are the same, so keys of
either kind share buckets, and the better of the estimates counts. Two texts are linked if their probability
Jaccard similarity or the plain Jaccard similarity of their shingle sets is at least the threshold.

Scale: texts with the same words are first reduced to one node, so a group of exact copies costs nothing
more. No bucket is expanded into pairs. First each member is compared with its bucket's first; then, in buckets
that still hold several components, with the likeliest member of another component; what is then still
apart is verified inside the bucket's task, where each link joins two components, so a bucket of n members puts
out n - 1 links at most. A bucket is dealt to blocks of BLOCK members and BLOCK_SHINGLES shingles. In wave w its block
w meets the blocks from w on, so a wave's rows are at most twice the members; waves go on until no bucket has
both several components and blocks that have not met. Links and labels stay in tables; verified links are drawn to
each node's least neighbour, and later ones are between components, each once, before components are sought.

Probability of missing a pair at exactly 0.8 with 32 bands of 6: (1 - 0.8**6)**32, 6 in 100,000; at 0.85
it is 3 in ten million.

Defined cases: a null or wordless text is linked to nothing, not even to another; repeated rows are
copies, also under one id; a class's id is its smallest non-null document id, and of ties for the row that
stays the one with the least hash of its words; very long texts are sketched whole; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import checkpointed, discard, if_few
from ._text import Words, bounded_batches, mixed, sliced

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
HOT = 1_000_000  # rows of a key that is joined by a broadcast
SMALL = 100_000  # rows of 24 bytes that may be broadcast
MARGIN = 4.0  # standard deviations under the threshold at which an estimate rules a pair out (3 in 100,000)
BLOCK, BLOCK_SHINGLES = 4096, 1_500_000  # members of a bucket, and their shingles, that one task holds of each side
TEXT_SLICE = 1 << 19


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and counts, ordered by row and shingle."""
    n, h = len(words.hash), words.hash
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = words.first[words.row + 1] - np.arange(n)
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        inside = left > j
        sums[inside] += mixed(h[np.flatnonzero(inside) + j] + np.uint64(0x9E3779B97F4A7C15 * (j + 1) % (1 << 64)))
    starts = (left >= k) | (words.first[words.row] == np.arange(n))
    row, value = words.row[starts], mixed(sums[starts])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.concatenate([at, [len(row)]]))


def prob_minhash(rows: int, row: np.ndarray, value: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """For each of so many rows the shingles that hold its registers; 0 in rows without shingles."""
    times, held = np.full(rows * registers, np.inf), np.zeros(rows * registers, np.uint64)
    slowest = np.full(rows, np.inf)
    clock, alive, step = np.zeros(len(row)), np.arange(len(row)), 0
    while len(alive):
        width = 1 if len(alive) > 50_000 else min(32, max(1, 50_000 // len(alive)))
        steps = np.arange(step + 1, step + width + 1, dtype=np.uint64)
        random = mixed(value[alive][:, None] + steps[None, :] * np.uint64(0xA24BAED4963EE407))
        gaps = -np.log(((random >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight[alive][:, None]
        arrivals = clock[alive][:, None] + np.cumsum(gaps, axis=1)
        register = (mixed(random + np.uint64(0x9FB21C651E98DF25)) % np.uint64(registers)).astype(np.int64)
        early = arrivals <= slowest[row[alive]][:, None]
        place = (row[alive][:, None] * registers + register)[early]
        time, who = arrivals[early], np.broadcast_to(value[alive][:, None], arrivals.shape)[early]
        np.minimum.at(times, place, time)
        won = times[place] == time
        held[place[won]] = who[won]
        clock[alive] = arrivals[:, -1]
        touched = np.unique(row[alive])
        slowest[touched] = times.reshape(rows, registers)[touched].max(axis=1)
        alive = alive[arrivals[:, -1] <= slowest[row[alive]]]
        step += width
    return held.reshape(rows, registers)


def both_sketches(rows: int, row: np.ndarray, value: np.ndarray, count: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' sketches by count, the rows that repeat a shingle, and these rows' sketches with weight 1."""
    held = prob_minhash(rows, row, value, count.astype(np.float64), registers)
    repeats = np.unique(row[count > 1])
    own = np.isin(row, repeats)
    return held, repeats, prob_minhash(len(repeats), np.searchsorted(repeats, row[own]), value[own], np.ones(own.sum()), registers)


def band_keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    sums = held.reshape(-1, bands, rows) * (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(3)) ** np.uint64(5)
    return mixed(sums.sum(axis=2) + mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :]).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger of the estimates by count and by weight 1, of rows of two sketches of register bytes each."""
    half = a.shape[-1] // 2
    equal = np.maximum((a[..., :half] == b[..., :half]).mean(axis=-1), (a[..., half:] == b[..., half:]).mean(axis=-1))
    return (equal - 1 / 256) / (1 - 1 / 256)


def _twofold(column: list[bytes], registers: int) -> np.ndarray:
    """Sketches as rows of two; a row that has only one has it twice."""
    return np.frombuffer(b"".join(x if len(x) > registers else x + x for x in column), np.uint8).reshape(len(column), -1)


def _sketch(k: int, bands: int, rows: int, names: list[str]):
    def run(batches):
        for batch in sliced(batches, TEXT_SLICE):
            words = Words(batch.column(batch.schema.get_field_index("text")))
            row, value, count = shingles(words, k)
            held, repeats, plain = both_sketches(batch.num_rows, row, value, count, bands * rows)
            keys = [x.tobytes() for x in band_keys(held, bands, rows)]
            small = [x.tobytes() for x in held.astype(np.uint8)]
            for at, other, low in zip(repeats.tolist(), band_keys(plain, bands, rows), plain.astype(np.uint8), strict=True):
                keys[at] += other.tobytes()
                small[at] += low.tobytes()
            at = (np.arange(len(words.hash)) - words.first[words.row]).astype(np.uint64)
            whole = []
            for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words.hash + mixed(at + np.uint64(salt))), dtype=np.uint64)])
                whole.append((sums[words.first[1:]] - sums[words.first[:-1]]).view(np.int64))
            sizes = np.bincount(row, minlength=batch.num_rows)
            columns = [batch.column(0), batch.column(2), *(pa.array(x) for x in whole), pa.array(sizes, pa.int64()), pa.array(small, pa.binary()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _banded(batches):
    """node, key: each bucket of each node, once."""
    for batch in batches:
        raw = batch.column(1).to_pylist()
        key = np.frombuffer(b"".join(raw), np.int64)
        node = np.repeat(np.asarray(batch.column(0)), [len(x) // 8 for x in raw])
        order = np.lexsort((key, node))
        node, key = node[order], key[order]
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (key[1:] != key[:-1])])[: len(node)]
        yield pa.RecordBatch.from_arrays([pa.array(node[new], pa.int64()), pa.array(key[new], pa.int64())], names=["node", "key"])


def _evidence(k: int):
    def run(batches):
        for batch in sliced(batches, TEXT_SLICE):
            row, value, count = shingles(Words(batch.column(batch.schema.get_field_index("text"))), k)
            edges = np.searchsorted(row, np.arange(batch.num_rows + 1)).tolist()
            value, count = value.tobytes(), count.astype(np.int32).tobytes()
            cut = list(zip(edges[:-1], edges[1:], strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([value[8 * a : 8 * b] for a, b in cut], pa.binary()), pa.array([count[4 * a : 4 * b] for a, b in cut], pa.binary())], names=["node", "shingles", "counts"])

    return run


def similarities(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Probability Jaccard and plain Jaccard of two sorted shingle arrays a, b with weights x, y."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0, 0.0
    plain = len(i) / (len(a) + len(b) - len(i))
    x, y = x.astype(np.float64), y.astype(np.float64)
    u, v = x[i], y[j]
    order = np.argsort(u / v, kind="stable")
    u, v = u[order], v[order]
    # sum over all shingles of max(x_j / x_i, y_j / y_i): those with x_j / y_j at least x_i / y_i count by x
    above = np.cumsum(u[::-1])[::-1] + (x.sum() - u.sum())
    under = np.cumsum(v) - v + (y.sum() - v.sum())
    return float((1.0 / (above / u + under / v)).sum()), plain


def _verified(threshold: float):
    def run(batches):
        for batch in batches:
            a, x, b, y = ([np.frombuffer(v, t) for v in batch.column(k).to_pylist()] for k, t in ((2, np.uint64), (3, np.int32), (4, np.uint64), (5, np.int32)))
            keep = pa.array(np.flatnonzero([max(similarities(*pair)) >= threshold for pair in zip(a, x, b, y, strict=True)]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _plausible(least: float, registers: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_twofold(batch.column(k).to_pylist(), registers) for k in (2, 3))
                keep = pa.array(np.flatnonzero(estimates(a, b) >= least), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


PAIR = "a long, b long"


class Block:
    """The members of a bucket that one task holds: those of block lo, which meet those of block hi."""

    def __init__(self, key: tuple, group: list[tuple], least: float, registers: int):
        self.key, self.lo, self.hi, self.least = *key, least
        block, self.node, self.comp = (np.array([g[i] for g in group]) for i in (3, 4, 5))
        self.sig = _twofold([g[6] for g in group], registers)
        bands = [g[7] for g in group]
        longest = max(map(len, bands))
        self.bands = np.frombuffer(b"".join(x if len(x) == longest else x + x for x in bands), np.int64).reshape(len(group), -1)
        self.two = any(len(g[6]) > registers for g in group)
        self.left, self.right = np.flatnonzero(block == self.lo), np.flatnonzero(block == self.hi)

    def allowed(self, i: int, comp: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components that the sketches let i be near to, and how near; pairs of a smaller shared key left out."""
        j = self.right[comp[self.right] != comp[i]]
        if self.lo == self.hi:
            j = j[j != i] if both else j[self.node[j] > self.node[i]]
        likely = estimates(self.sig[j], self.sig[i])
        near = likely >= self.least
        j, likely = j[near], likely[near]
        if len(j):
            same = self.bands[j] == self.bands[i]
            if self.two:
                same |= np.roll(self.bands[j], self.bands.shape[1] // 2, axis=1) == self.bands[i]
            own = np.where(same, self.bands[i], np.iinfo(np.int64).max).min(axis=1) == self.key
            j, likely = j[own], likely[own]
        return j, likely


def _likeliest(block: Block, group: list[tuple]):
    """For each member its likeliest partner in another component."""
    for i in block.left.tolist():
        j, likely = block.allowed(i, block.comp, both=True)
        if len(j):
            x, y = int(block.node[i]), int(block.node[j[np.lexsort((block.node[j], -likely))[0]]])
            yield min(x, y), max(x, y)


def _concerned(block: Block, group: list[tuple]):
    """key, lo, hi, node of the members that may be near to one of another component."""
    some = np.zeros(len(group), dtype=bool)
    for i in block.left.tolist():
        j, _ = block.allowed(i, block.comp)
        some[i] |= len(j) > 0
        some[j] = True
    for x in block.node[some].tolist():
        yield block.key, block.lo, block.hi, x


def _joined(threshold: float):
    """Links that join components, verified on the members' shingles, of a block whose rows hold them."""

    def of_block(block: Block, group: list[tuple]):
        values = [np.frombuffer(g[8], np.uint64) for g in group]
        counts = [np.frombuffer(g[9], np.int32) for g in group]
        sizes = np.array([len(v) for v in values])
        repeats = np.array([c.max(initial=1) > 1 for c in counts])
        comp = block.comp.copy()
        for i in block.left.tolist():
            j, likely = block.allowed(i, comp)
            j = j[np.argsort(-likely, kind="stable")]
            at = 0
            while at < len(j):
                # as many as hold a million shingles, a few at first
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[j[at : at + 16 + 4 * at]]), 1_000_000)))
                some, at = j[at:to], to
                some = some[comp[some] != comp[i]]
                if not len(some):
                    continue
                flat = np.concatenate([values[x] for x in some])
                place = np.minimum(np.searchsorted(values[i], flat), sizes[i] - 1)
                common = np.add.reduceat((values[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                plain = common / (sizes[some] + sizes[i] - common)
                for x, alike in zip(some.tolist(), plain.tolist(), strict=True):
                    if comp[x] != comp[i] and (alike >= threshold or (repeats[x] or repeats[i]) and similarities(values[i], counts[i], values[x], counts[x])[0] >= threshold):
                        comp[comp == comp[x]] = comp[i]
                        yield min(int(block.node[i]), int(block.node[x])), max(int(block.node[i]), int(block.node[x]))

    return of_block


def _by_block(of_block, names: list[str], least: float, registers: int):
    """Runs of rows of one (key, lo, hi) to what of_block makes of each."""

    def made(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int32() if n in ("lo", "hi") else pa.int64()) for k, n in enumerate(names)], names=names)

    def run(batches):
        key, group, out = None, [], []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    if len(group) > 1:
                        out.extend(of_block(Block(key, group, least, registers), group))
                    key, group = r[:3], []
                group.append(r)
            if out:
                yield made(out)
                out = []
        if len(group) > 1:
            yield made(list(of_block(Block(key, group, least, registers), group)))

    return run


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], partners: str, most: int | None = None) -> DataFrame:
    """rows with the columns of table, which has a row for each of its keys, null where there is none.

    partners, a column of table, says how many rows a key has. Keys with more than most rows are few, as they share the rows, and are broadcast, so that
    none of them makes a task on its own; the others are joined by a shuffle.
    """
    hot = checkpointed(table.where(F.col(partners) > (most or HOT)))
    more = [c for c in table.columns if c not in keys]
    if hot.isEmpty():
        return rows.join(table, keys, "left")
    first = rows.join(if_few(hot), keys, "left")
    rest = first.where(F.col(partners).isNull()).select(rows.columns).join(table.where(F.col(partners) <= (most or HOT)), keys, "left")
    return first.where(F.col(partners).isNotNull()).select(*rows.columns, *more).unionByName(rest.select(*rows.columns, *more))


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links (a, b) lead to; only for nodes that have links."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    hubs = checkpointed(both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > HOT))
    flat = hubs.isEmpty()
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp"), F.lit(True).alias("moved")))
    while True:
        if flat:
            ends = both.join(labels, both.b == labels.node)
        else:
            ends = looked_up(both.withColumnRenamed("b", "node"), labels.select("node", "comp").join(if_few(hubs), "node", "left").fillna(0, ["degree"]), ["node"], "degree")
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        hop = labels.select(F.col("node").alias("to"), F.col("comp").alias("hop"))
        to = F.least("to", F.coalesce("hop", "to"))
        following = checkpointed(stepped.join(hop, "to", "left").select("node", to.alias("comp"), (to != F.col("was")).alias("moved")))
        discard(labels)
        labels = following
        if labels.where("moved").isEmpty():
            discard(both, hubs)
            return labels.drop("moved")


def star(links: DataFrame) -> DataFrame:
    """Links (a, b) with a < b and the same components, of which a node's are its least neighbour and those of that one; for links of few a for each b."""
    near = F.array_sort(F.collect_set("a"))
    to_least = F.transform(F.concat(F.slice("near", 2, F.size("near")), F.array("b")), lambda x: F.struct(F.col("near")[0].alias("a"), x.alias("b")))
    return links.groupBy("b").agg(near.alias("near")).select(F.inline(to_least)).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, comp) after more links: components of components, of whose links each is followed once, however many nodes have it."""
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    between = checkpointed(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if between.isEmpty():
        return labels
    further = components(between).toDF("comp", "to")
    moved = labels.join(if_few(further), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = further.toDF("node", "comp").join(labels.select("node"), "node", "left_anti")
    found = checkpointed(moved.unionByName(fresh))
    discard(between)
    return found


class Pairs:
    """Verification of candidate pairs of nodes."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, threshold: float, registers: int):
        self.docs, self.reps, self.k, self.threshold, self.registers = docs, reps, k, threshold, registers
        self.least = threshold - MARGIN * (threshold * (1 - threshold) / registers) ** 0.5

    def evidence(self, nodes: DataFrame) -> DataFrame:
        """node, shingles and counts of the nodes, from a text of each."""
        needed = checkpointed(nodes.join(self.reps.select("node", "doc_id", "tkey"), "node").select("node", F.col("doc_id").alias("_d"), F.col("tkey").alias("_t")))
        some = F.broadcast(needed) if needed.count() <= SMALL else needed
        found = self.docs.join(some, (F.col("tkey") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("node", "text")
        return checkpointed(found.mapInArrow(_evidence(self.k), "node long, shingles binary, counts binary").dropDuplicates(["node"]))

    def links(self, pairs: DataFrame) -> DataFrame:
        sig = self.reps.select("node", "sig")
        a, b = sig.toDF("a", "xa"), sig.toDF("b", "xb")
        near = checkpointed(pairs.join(a, "a").join(b, "b").select("a", "b", "xa", "xb").mapInArrow(_plausible(self.least, self.registers), PAIR))
        evidence = self.evidence(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        a, b = evidence.toDF("a", "sa", "ca"), evidence.toDF("b", "sb", "cb")
        found = checkpointed(near.join(a, "a").join(b, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(_verified(self.threshold), PAIR))
        discard(near, evidence)
        return found


class Buckets:
    """Buckets whose members are still in several components, dealt to blocks."""

    def __init__(self, shared: DataFrame, reps: DataFrame, check: Pairs):
        self.shared, self.reps, self.check = shared, reps, check
        self.schema = "key long, lo int, hi int, node long"

    def dealt(self, labels: DataFrame, wave: int) -> DataFrame | None:
        """Rows of the blocks that meet in this wave, or None if no bucket has such blocks left."""
        own = self.shared.join(labels, "node", "left").select("key", "node", "size", F.coalesce("comp", "node").alias("comp"))
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int")
        split = own.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), blocks.alias("blocks"))
        split = checkpointed(split.where((F.col("least") < F.col("most")) & (F.col("blocks") > wave)).select("key", "blocks"))
        if split.isEmpty():
            return None
        active = own.join(split, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).where(F.col("block") >= wave)
        first = active.where((F.col("block") == wave) & (F.col("blocks") > wave + 1)).withColumn("hi", F.explode(F.sequence(F.lit(wave), F.col("blocks") - 1)))
        others = active.where((F.col("block") > wave) | (F.col("blocks") == wave + 1)).withColumn("hi", F.col("block"))
        rows = first.unionByName(others).join(self.reps.select("node", "sig", "bands"), "node")
        return rows.select("key", F.lit(wave).cast("int").alias("lo"), "hi", "block", "node", "comp", "sig", "bands")

    def run(self, rows: DataFrame, of_block, schema: str) -> DataFrame:
        names = [part.split()[0] for part in schema.split(", ")]
        sorted_ = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        return sorted_.mapInArrow(_by_block(of_block, names, self.check.least, self.check.registers), schema)

    def likeliest(self, labels: DataFrame) -> DataFrame | None:
        """Candidates: of each member with the first block's likeliest of another component."""
        rows = self.dealt(labels, 0)
        return checkpointed(self.run(rows, _likeliest, PAIR).distinct()) if rows is not None else None

    def wave(self, labels: DataFrame, wave: int) -> DataFrame | None:
        """New links between components, from the blocks that meet in this wave."""
        rows = self.dealt(labels, wave)
        if rows is None:
            return None
        rows = checkpointed(rows)
        some = checkpointed(self.run(rows, _concerned, self.schema))
        evidence = self.check.evidence(some.select("node").distinct())
        full = rows.join(some, ["key", "lo", "hi", "node"], "left_semi").join(evidence, "node")
        full = full.select("key", "lo", "hi", "block", "node", "comp", "sig", "bands", "shingles", "counts")
        found = checkpointed(self.run(full, _joined(self.check.threshold), PAIR))
        discard(rows, some, evidence)
        return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """For each row: doc_id, class_id, copies (rows of the same words), kept.

    One row of each class is kept: that of the class's id, and of several such rows one with the least hash of its words.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tkey", F.xxhash64("text"))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("tkey", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n1", "n2", "size")), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.BinaryType())])
    sketched = checkpointed(texts.mapInArrow(_sketch(k, bands, rows, schema.names), schema).withColumn("rid", F.monotonically_increasing_id()))
    copied = sketched.where("size > 0").groupBy("n1", "n2").agg(F.min("rid").alias("first"), F.count(F.lit(1)).alias("copies"))
    copied = checkpointed(copied.where("copies > 1"))
    named = looked_up(sketched.select("rid", "doc_id", "n1", "n2"), copied, ["n1", "n2"], "copies")
    members = checkpointed(named.select("rid", "doc_id", "n1", F.coalesce("first", "rid").alias("node"), F.coalesce("copies", F.lit(1)).alias("copies")))
    others = members.where("rid != node").select("rid")
    reps = checkpointed(sketched.where("size > 0").join(others, "rid", "left_anti").select(F.col("rid").alias("node"), "doc_id", "tkey", "size", "sig", "bands"))
    discard(sketched)
    banded = reps.select("node", "bands").mapInArrow(_banded, "node long, key long")
    buckets = checkpointed(banded.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"))
    shared = checkpointed(banded.join(buckets, "key").join(reps.select("node", "size"), "node").select("key", "node", "first", "size"))
    check = Pairs(texts, reps, k, threshold, bands * rows)
    open_ = Buckets(shared, reps, check)
    pairs = shared.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(star(check.links(pairs)))
    if (pairs := open_.likeliest(labels)) is not None:
        labels, wave = merged(labels, check.links(pairs)), 0
        while (more := open_.wave(labels, wave)) is not None:
            labels, wave = merged(labels, more), wave + 1
    discard(shared, buckets)
    sizes = copied.select(F.col("first").alias("node"), F.col("copies").alias("rows"))
    found = looked_up(members, labels.join(sizes, "node", "left").fillna(1, ["rows"]), ["node"], "rows")
    found = checkpointed(found.select("rid", "doc_id", "n1", "copies", F.coalesce("comp", "node").alias("comp")))
    stays = F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "n1", "rid")).alias("stays")
    classes = checkpointed(found.groupBy("comp").agg(F.min("doc_id").alias("class_id"), stays, F.count(F.lit(1)).alias("rows")))
    return looked_up(found, classes, ["comp"], "rows").select("doc_id", "class_id", "copies", (F.col("rid") == F.col("stays")).alias("kept"))


def op2_prob_minhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
