"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles (five words, lower-case A-Z, words between white space; a text
of one to four words is one shingle; a text without words has none and joins nothing).

1. Documents with equal sets fall into one row; only these representatives go on.
2. Representatives that agree in one of ``BANDS`` bands of ``ROWS`` MinHash values share a bucket
   (a pair of similarity 0.8 shares none with probability 3e-6). Within a bucket, or two blocks of
   one that is too large, pairs compare MinHash values step by step; a pair is dropped when the
   posterior probability that its similarity reaches the threshold falls below ``TOLERANCE``. What
   stays is told as links to the smallest of a connected group, one for each member, not as pairs.
3. Connected components of these links hold all pairs to verify, and little else: boilerplate that
   chains buckets together has been pruned. Components are dealt in pairs of blocks of bounded
   size and similar set size (sizes that differ by more than the threshold cannot match). Only now
   sets are made, for members of components alone. Pairs within a task are pruned in the same way
   and verified exactly; no pair leaves it: only counts of links and a spanning forest do.
4. Connected components of the verified links are the classes.

MinHash values are kept as their lowest byte: unlike values agree with probability 1/256, which
the posterior takes into account.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common as C

U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
STEP = 32  # MinHash values compared between two looks at the posterior
TOLERANCE = 1e-7
#: Most representatives and most shingles in a block of sets; most representatives in one of signatures.
BLOCK_DOCS, BLOCK_SHINGLES, BLOCK_SIGNED = 400, 2_000_000, 1500
#: Pairs compared at once, and rows of whole groups held at once.
PAIRS, HELD = 400_000, 20_000
#: Most rows of block plans (about 40 bytes each) that are broadcast; more are shuffled.
BROADCAST_PLANS = 200_000
_A = C.mix64(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_B = C.mix64(np.arange(1, BANDS * ROWS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)).astype(np.uint32)


# --- sets and signatures ----------------------------------------------------------------------


def shingle_sets(docs: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each document, one after the other, and offsets."""
    buf, off = C.joined(docs)
    buf = C.LOWER[buf]
    s, e, first = C.word_spans(buf, off, C.NON_SPACE)
    if not len(s):
        return np.zeros(0, U), np.zeros(len(docs) + 1, np.int64)
    h = C.span_hash(C.prefix_hash(buf), s, e)
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(int))
    doc = np.repeat(np.arange(len(docs)), count)
    at = C.ragged(first[:-1], count)
    out = np.full(len(at), 1, U)
    end = first[1:][doc]
    for k in range(n):
        there = at + k < end
        out = np.where(there, C.mix64(out * U(0x9E3779B97F4A7C15) + h[np.minimum(at + k, len(h) - 1)]), out)
    order = np.lexsort((out, doc))
    out = out[order]
    keep = np.concatenate(([True], (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])))
    return out[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(docs)))))


def signatures(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets, one row each: lowest bytes of the MinHash values, and keys of the bands."""
    low = np.empty((len(off) - 1, BANDS * ROWS), np.uint8)
    keys = np.empty((len(off) - 1, BANDS), U)
    x = (sets ^ (sets >> U(32))).astype(np.uint32)
    for band in range(BANDS):
        key = np.full(len(off) - 1, band, U)
        for k in range(band * ROWS, (band + 1) * ROWS):
            v = x * _A[k] + _B[k]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(v, off[:-1])
            low[:, k] = (least ^ (least >> np.uint32(16))).astype(np.uint8)
            key = C.mix64(key * U(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return low, keys


def set_keys(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the sets, in two halves."""
    a, b = C.mix64(sets), C.mix64(sets ^ U(0x5851F42D4C957F2D))
    size = np.diff(off).astype(U)
    return C.mix64(np.add.reduceat(a, off[:-1]) + size), C.mix64(np.add.reduceat(b, off[:-1]) ^ size)


SIGNED = pa.schema([("doc_id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])
SIGNED_DDL = "doc_id long, a long, b long, n long, signature binary, bands array<long>"


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, set fingerprint, set size, signature, bands); a text without words has no signature."""

    def run(batches):
        for b in C.packed(batches):
            sets, off = shingle_sets(C.texts(b.column(1)))
            n = np.diff(off)
            full = np.flatnonzero(n)
            a, k, sig, bands = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), [None] * len(n), [None] * len(n)
            if len(full):
                own = np.append(off[:-1][full], off[-1])
                x, y = set_keys(sets, own)
                a[full], k[full] = x.astype(np.int64), y.astype(np.int64)
                for i, row, key in zip(full, *signatures(sets, own), strict=True):
                    sig[i], bands[i] = row.tobytes(), key.astype(np.int64)
            yield C.batch(SIGNED, b.column(0), a, k, n, pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64())))

    return docs.mapInArrow(run, SIGNED_DDL)


# --- connected components ---------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, component: its smallest id) of all ids in links (a, b).

    Labels start at each id's smallest neighbour; in each round, written to the shared folder, ids
    take the smallest label around them and then their label's label, so that chains shorten by
    half. Group-by minima combine before the shuffle; nothing is collected.
    """
    both = C.materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = C.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near, label.id == near.a, "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("new"))
        jump = label.select(F.col("id").alias("l"), F.col("label").alias("further"))
        new = C.materialize(step.join(jump, step.new == jump.l, "left").select("id", "old", F.least("new", "further").alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("id", F.col("label").alias("component"))
        label = new.select("id", "label")


# --- pruning and verification -----------------------------------------------------------------


def agreement(threshold: float) -> float:
    """Chance that the lowest bytes of a MinHash value agree, at that similarity."""
    return threshold + (1 - threshold) / 256


def least_matches(threshold: float = agreement(THRESHOLD), tolerance: float = TOLERANCE, most: int = BANDS * ROWS, step: int = STEP) -> dict[int, int]:
    """For n values compared, the fewest agreements at which a pair stays.

    With a uniform prior the posterior after m of n agreements is Beta(m + 1, n - m + 1); that it
    exceeds t has the probability that a binomial of n + 1 trials with chance t is at most m.
    """
    out = {}
    for n in range(step, most + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def prune(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs those that stay: by set size, then by the posterior step by step."""
    stay = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    i, j = i[stay], j[stay]
    agree = np.zeros(len(i), np.int32)
    for upto, least in least_matches(agreement(threshold), tolerance, sig.shape[1]).items():
        agree += (sig[i, upto - STEP : upto] == sig[j, upto - STEP : upto]).sum(1, dtype=np.int32)
        stay = agree >= least
        i, j, agree = i[stay], j[stay], agree[stay]
    return i, j


def pairs(first: np.ndarray, count: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """keep(i, j) over the pairs of each row i with rows first[i], ... (count[i] of them)."""
    out, ends, at = [], np.cumsum(count), 0
    while at < len(count):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + PAIRS, "right")))
        own = np.arange(at, stop)
        out.append(keep(np.repeat(own, count[own]), C.ragged(first[own], count[own])))
        at = stop
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in out)]), np.concatenate([none, *(y for _, y in out)])


def partners(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group and side; the earlier rows that each is to be compared with: of one
    block (side 0) all, of two blocks (1 and 2) those of the other."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(head, len(group)))
    ones = np.add.reduceat(side == 1, head)
    start = np.repeat(head, size)
    return start, np.where(side == 0, np.arange(len(group)) - start, np.where(side == 2, np.repeat(ones, size), 0))


def least_of_group(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that the pairs connect it to."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def verify(sets_a: list, sets_b: list, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact similarity of the pairs. Shingles of both blocks are numbered; few pairs for their
    first set go by intersection, many by one mask over the numbers."""
    if not len(i):
        return i, j
    every = np.unique(np.concatenate([*sets_a, *sets_b]))
    num_b = [np.searchsorted(every, x) for x in sets_b]
    flat, off = np.concatenate(num_b), np.concatenate(([0], np.cumsum([len(x) for x in num_b])))
    ok = np.zeros(len(i), bool)
    order = np.argsort(i, kind="stable")
    mask = np.zeros(len(every), np.int32)
    cut = np.flatnonzero(np.concatenate(([True], np.diff(i[order]) != 0, [True])))
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        own = order[s:e]
        a = np.searchsorted(every, sets_a[i[own[0]]])
        mask[a] = 1
        size = off[j[own] + 1] - off[j[own]]
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            n = size[k : k + 256]
            both = np.add.reduceat(mask[flat[C.ragged(off[j[part]], n)]], np.cumsum(n) - n)
            # similarity >= threshold, in whole numbers of shingles
            ok[part] = both >= threshold * (len(a) + n - both) - 1e-9
        mask[a] = 0
    return i[ok], j[ok]


LINKED = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
LINKED_DDL = "id long, other long, links long"


def whole_groups(batches, held: int = HELD):
    """Tables of about ``held`` rows that split no run of equal values in the first column."""
    rest, n = [], 0
    for b in batches:
        rest.append(b)
        n += b.num_rows
        if n < held:
            continue
        table = pa.Table.from_batches(rest)
        task = table.column(0).to_numpy()
        cut = int(np.searchsorted(task == task[-1], True)) if len(task) else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut).to_batches()
            n = len(task) - cut
    if rest:
        yield pa.Table.from_batches(rest)
    C.trim()


def _signatures_of(table: pa.Table) -> np.ndarray:
    raw = b"".join(table["signature"].to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(table.num_rows, -1)


def candidates(reps: DataFrame, threshold: float, tolerance: float, block: int) -> DataFrame:
    """Links (a, b) that connect all representatives whose pairs in buckets are not pruned."""
    keys = reps.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side")))
    many = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("own"), k).alias("x"), F.greatest(F.col("own"), k).alias("y"), F.when(F.col("own") == k, 0).when(F.col("own") < k, 1).otherwise(2).alias("side")))
    dealt = keys.join(buckets, "key").withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.select("id", "key", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)).alias("t")).select("id", F.xxhash64("key", "t.x", "t.y").alias("task"), "t.side")
    rows = dealt.join(reps.select("id", "n", "signature"), "id").select("task", "side", "id", "n", "signature")

    def run(batches):
        for t in whole_groups(batches):
            group, side, ids, n = (t.column(k).to_numpy() for k in range(4))
            sig = _signatures_of(t)
            i, j = pairs(*partners(group, side), lambda i, j, sig=sig, n=n: prune(sig, n, i, j, threshold, tolerance))
            label = least_of_group(len(ids), i, j)
            moved = np.flatnonzero(label != np.arange(len(ids)))
            link = np.unique(np.stack([ids[moved], ids[label[moved]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(link[:, 0], pa.int64()), pa.array(link[:, 1], pa.int64())], names=["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task", "side", "id").mapInArrow(run, "a long, b long").distinct()


def _verify_group(t: pa.Table, threshold: float, tolerance: float) -> tuple[list, list, list]:
    """Rows of one task, any number of (task, side, id, n, signature, sets), to links and counts."""
    side, ids, n = (t.column(k).to_numpy() for k in (1, 2, 3))
    sets = [np.frombuffer(x, U) for x in t["sets"].to_pylist()]
    sig = _signatures_of(t)
    i, j = pairs(*partners(np.zeros(len(ids), int), side), lambda i, j: prune(sig, n, i, j, threshold, tolerance))
    i, j = verify(sets, sets, i, j, threshold)
    count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    some = np.flatnonzero(count)
    label = least_of_group(len(ids), i, j)
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return [*ids[some].tolist(), *ids[moved].tolist()], [*[None] * len(some), *ids[label[moved]].tolist()], [*count[some].tolist(), *[0] * len(moved)]


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, block_signed: int = BLOCK_SIGNED) -> DataFrame:
    """Per row of docs: doc_id, class_id (smallest doc_id of its class), rep_id (smallest doc_id
    with the same set), n_copies (rows with the same set) and n_links (other sets whose similarity
    to its set is at least the threshold).

    Classes are the connected components of these links. Rows without words (null or empty texts)
    and rows with a null id are classes of their own, without links. Ids should be unique; rows
    with equal ids and sets count as copies.
    """
    signed = C.materialize(sign(C.id_text(docs, id_col, text_col)))
    some = signed.where(F.col("n") > 0)
    reps = some.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_copies"), *[F.first(c).alias(c) for c in ("n", "signature", "bands")])
    reps = C.materialize(reps.where(F.col("id").isNotNull()))
    group = components(candidates(reps, threshold, tolerance, block_signed))
    # small components are one task; members of large ones learn their blocks by size class
    size = F.floor(F.log(F.col("n")) / -math.log(threshold)).cast("long").alias("size")
    member = C.materialize(group.join(reps, "id").select("id", "component", "n", "signature", size))
    plan = block_plans(member, block_docs, block_shingles)
    placed = member.join(plan, ["component", "size"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    task = lambda sa, x, sb, y, side: F.struct(F.xxhash64("component", sa, x, sb, y).alias("task"), side.cast("int").alias("side"))
    s, minus = F.col("size"), F.lit(-1).cast("long")
    tasks = F.when(F.col("blocks").isNull(), F.array(task(minus, minus, minus, minus, F.lit(0)))).otherwise(
        F.concat(
            F.transform(span(F.col("blocks")), lambda k: task(s, F.least(own, k), s, F.greatest(own, k), F.when(own == k, 0).when(own < k, 1).otherwise(2))),
            F.transform(span(F.coalesce("blocks_up", F.lit(0).cast("long"))), lambda k: task(s, own, s + 1, k, F.lit(1))),
            F.transform(span(F.coalesce("blocks_down", F.lit(0).cast("long"))), lambda k: task(s - 1, k, s, own, F.lit(2))),
        )
    )
    placed = placed.select("id", "n", "signature", tasks.alias("tasks"))
    text = C.id_text(docs, id_col, text_col)
    placed = text.join(placed, text.doc_id == placed.id).select("id", "text", "n", "signature", "tasks")
    linked = C.materialize(_verified(placed, threshold, tolerance))
    classes = components(linked.where(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = linked.groupBy("id").agg(F.sum("links").alias("n_links"))
    rep = reps.join(classes, "id", "left").join(counts, "id", "left").select("a", "b", F.col("id").alias("rep_id"), F.coalesce("component", "id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = signed.select("doc_id", "a", "b", "n")
    full = named.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).join(rep, ["a", "b"]).select("doc_id", "class_id", "rep_id", "n_copies", "n_links")
    alone = named.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(alone)


def block_plans(member: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """(component, size, blocks, blocks_up, blocks_down) of the components that one task cannot
    hold; broadcast while there are few, so that a large component's members meet in no task."""
    count = member.groupBy("component", "size").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    large = count.groupBy("component").agg(F.sum("docs").alias("docs"), F.sum("shingles").alias("shingles")).where((F.col("docs") > block_docs) | (F.col("shingles") > block_shingles))
    blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("long")
    own = count.join(large.select("component"), "component", "left_semi").select("component", "size", blocks.alias("blocks"))
    up = own.select("component", (F.col("size") - 1).alias("size"), F.col("blocks").alias("blocks_up"))
    down = own.select("component", (F.col("size") + 1).alias("size"), F.col("blocks").alias("blocks_down"))
    plan = C.materialize(own.join(up, ["component", "size"], "left").join(down, ["component", "size"], "left"))
    return F.broadcast(plan) if plan.count() <= BROADCAST_PLANS else plan


def _verified(placed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(id, other, links): links of a spanning forest (other), or counts (other is null)."""
    tasks = pa.list_(pa.struct([("task", pa.int64()), ("side", pa.int32())]))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("tasks", tasks), ("sets", pa.binary())])

    def sets(batches):
        for b in C.packed(batches):
            flat, off = shingle_sets(C.texts(b.column(1)))
            yield C.batch(schema, b.column(0), b.column(2), b.column(3), b.column(4).cast(tasks), C.binary_column(flat, off[1:] * 8))

    def run(batches):
        for t in whole_groups(C.packed(batches, 5), 1000):
            group = t.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            out = [], [], []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                for column, own in zip(out, _verify_group(t.slice(s, e - s), threshold, tolerance), strict=True):
                    column += own
            yield C.batch(LINKED, *out)

    rows = placed.mapInArrow(sets, "id long, n long, signature binary, tasks array<struct<task: long, side: int>>, sets binary")
    dealt = rows.select(F.explode("tasks").alias("t"), "id", "n", "signature", "sets").select("t.task", "t.side", "id", "n", "signature", "sets")
    return dealt.repartition("task").sortWithinPartitions("task", "side", "id").mapInArrow(run, LINKED_DDL)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """docs, all columns, with only one row of each class: that of the smallest id, and of several
    rows with that id one. Rows with a null id and those without words stay."""
    numbered = C.materialize(docs.withColumn("__row", F.monotonically_increasing_id()))
    named = numbered.where(F.col(id_col).isNotNull()).select("__row", F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    joined = C.materialize(join(named, "__row", "text", **kw).select(F.col("doc_id").alias("__row"), "class_id"))
    first = joined.join(named.select("__row", "__id"), "__row").groupBy("class_id").agg(F.min(F.struct("__id", "__row")).alias("first"))
    gone = joined.join(first.select(F.col("first")["__row"].alias("__row")), "__row", "left_anti").select("__row")
    return numbered.join(gone, "__row", "left_anti").select(*docs.columns)
