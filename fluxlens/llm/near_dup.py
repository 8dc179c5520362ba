"""Near-duplicate documents: HyperMinHash sketches, bands of compressed registers, estimates, then exact sets.

A document is the set of its distinct five-word shingles. Documents with equal sets form a class, and only one document
of a class goes on, so a text copied a million times costs one row per copy and no pairs. Shingles fall into 128 buckets
by their leading bits; a bucket's register keeps the leading-zero count and ten mantissa bits of its smallest rest.
Empty buckets borrow a filled one by a fixed rule, then bands of registers, as many as the threshold asks for (24 of five
at 0.85), make the candidate buckets. Within a bucket the collision-corrected estimate rules pairs out, and the pairs left are confirmed on full sets.

First each document is compared with one other of its buckets only: of their smallest identifiers, the one met in most bands.
Confirmed links make first components, so a template with a million variants is one component after as many comparisons.
Then buckets are compared in blocks of bounded size, spread over tasks, but only between different components: a bucket
within one component is done, and in others the members of the largest component meet only the rest. Nothing is emitted per
pair: the first comparison emits documents that still have a possible partner, the second a spanning forest of the
confirmed links.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.components import connected_components
from fluxlens.llm.tasks import groups, pieces, settled, utf8
from fluxlens.llm.words import U64, mix, shingle_sets

SHINGLE_WORDS = 5
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Probability at most that a pair at the threshold meets in no band.
MISS = 1e-6
#: Members of one bucket that a task compares with as many others.
BLOCK = 512
#: A pair is confirmed unless its estimate lies this many standard deviations below the threshold.
DEVIATIONS = 4.5
#: Identifiers of up to this many candidates are broadcast to thin out the texts before they are shuffled.
BROADCAST_IDS = 4_000_000

_SKETCH = "id long, n_shingles long, set_a long, set_b long, registers binary, bands array<long>"


def _borrowed() -> np.ndarray:
    """For each bucket the others in the order in which it looks for a filled one."""
    rng = np.random.default_rng(20240101)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


_ORDER = _borrowed()


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers (0: empty bucket), one row for each set of sorted 64-bit hashes."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.asarray([len(s) for s in sets])
    if not sizes.sum():
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bucket = (values >> U64(64 - BUCKET_BITS)).astype(np.int64)
    slot = owner * BUCKETS + bucket
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    rest = values[first] << U64(BUCKET_BITS)
    zeros = np.minimum(63, 63 - np.floor(np.log2(np.maximum(rest, U64(1)).astype(np.float64))).astype(np.int64)).clip(0)
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> U64(64 - MANTISSA_BITS)
    out.reshape(-1)[slot[first]] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and registers of each: the longest bands that miss a pair at the threshold less often than MISS."""
    fitting = []
    for rows in range(1, BUCKETS + 1) if 0 < percent <= 100 else ():
        meets = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-meets)) if meets < 1 else 1
        if bands * rows <= BUCKETS:
            fitting.append((bands, rows))
    if not fitting:
        raise ValueError(f"{BUCKETS} registers find no pairs at {percent} percent reliably")
    return fitting[-1]


def bands_of(registers: np.ndarray, percent: int) -> np.ndarray:
    """One 64-bit key for each band; empty buckets borrow, so that small sets band as well as large ones."""
    filled = registers.copy()
    for row in np.flatnonzero((registers == 0).any(axis=1) & (registers != 0).any(axis=1)):
        have = registers[row] != 0
        empty = np.flatnonzero(~have)
        lenders = _ORDER[empty]
        filled[row, empty] = registers[row, lenders[np.arange(len(empty)), have[lenders].argmax(axis=1)]]
    bands, rows = banding(percent)
    keys = np.zeros((len(registers), bands), np.uint64)
    for band in range(bands):
        key = mix(np.full(len(registers), U64(band + 1)))
        for register in range(band * rows, (band + 1) * rows):
            key = mix(key ^ filled[:, register].astype(np.uint64))
        keys[:, band] = key
    return keys.view(np.int64)


def chance_match(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that registers of unrelated sets of these sizes agree: same leading-zero count, same mantissa."""
    total = 0.0
    for level in range(1, 40):
        low, high = 2.0 ** -level, 2.0 ** (1 - level)
        total = total + (np.exp(-n_a / BUCKETS * low) - np.exp(-n_a / BUCKETS * high)) * (np.exp(-n_b / BUCKETS * low) - np.exp(-n_b / BUCKETS * high))
    return total / (1 << MANTISSA_BITS)


def possible_partners(registers: np.ndarray, sizes: np.ndarray, row: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows after `row` that may reach the threshold with it, and their estimates."""
    mine, others = registers[row], registers[row + 1 :]
    used = ((others | mine) != 0).sum(axis=1)
    same = ((others == mine) & (mine != 0)).sum(axis=1)
    raw = same / np.maximum(used, 1)
    near = raw >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
    # sizes alone bound the similarity from above
    near &= np.minimum(sizes[row + 1 :], sizes[row]) >= threshold * np.maximum(sizes[row + 1 :], sizes[row])
    at = np.flatnonzero(near)
    by_chance = chance_match(float(sizes[row]), sizes[row + 1 :][at].astype(float))
    estimate = (raw[at] - by_chance) / (1 - by_chance)
    at, estimate = (x[estimate >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.maximum(used[at], 1))] for x in (at, estimate))
    return at + row + 1, estimate


def paired_estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Estimated similarity of row i of `a` with row i of `b`, -1 where it cannot reach the threshold."""
    used = np.maximum(((a | b) != 0).sum(axis=1), 1)
    raw = ((a == b) & (a != 0)).sum(axis=1) / used
    by_chance = chance_match(n_a.astype(float), n_b.astype(float))
    estimate = (raw - by_chance) / (1 - by_chance)
    fits = estimate >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / used)
    return np.where(fits & (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)), estimate, -1.0)


def _registers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _star_estimates(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (np.asarray(batch.column(c)) for c in ("n_shingles", "pivot_shingles"))
            estimate = paired_estimates(_registers(batch.column("registers")), _registers(batch.column("pivot_registers")), n_a, n_b, percent / 100)
            kept = pa.array(estimate >= 0)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(kept), batch.column("pivot").filter(kept)], ["id", "pivot"])

    return run


def _confirm_stars(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["pivot", "share"]):
            ids = np.asarray(group["id"])
            pivot = group["pivot"][0].as_py()
            sets = shingle_sets(utf8(group["text"]), SHINGLE_WORDS)
            centres = [s for s, i in zip(sets, ids, strict=True) if i == pivot]
            linked = []
            for mine, i in zip(sets, ids, strict=True):
                for centre in centres if i != pivot else ():
                    shared = len(np.intersect1d(centre, mine, assume_unique=True))
                    if 100 * shared >= percent * (len(centre) + len(mine) - shared):
                        linked.append(int(i))
                        break
            yield pa.RecordBatch.from_arrays([pa.array(linked, pa.int64()), pa.array([pivot] * len(linked), pa.int64())], ["a", "b"])

    return run


def _thinned(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the wanted identifiers only, before any shuffle where these are few enough to be broadcast."""
    return texts.join(F.broadcast(wanted), "id", "left_semi") if wanted.count() <= BROADCAST_IDS else texts


def _star_links(keys: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of documents to that smallest member of their buckets which they meet in most bands."""
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1")
    met = keys.join(pivots.select("key", "pivot"), "key").where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("bands_met"))
    nearest = met.groupBy("id").agg(F.max(F.struct("bands_met", "pivot")).alias("best")).select("id", "best.pivot")
    described = classes.select("id", "n_shingles", "registers")
    centres = described.toDF("pivot", "pivot_shingles", "pivot_registers")
    looked_at = nearest.join(described, "id").join(centres, "pivot").select("id", "pivot", "n_shingles", "registers", "pivot_shingles", "pivot_registers")
    best = settled(looked_at.mapInArrow(_star_estimates(percent), "id long, pivot long"))
    shares = best.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("shares"))
    dealt = best.join(shares, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("shares")).alias("share"), "id")
    rows = dealt.unionByName(dealt.select("pivot", "share", F.col("pivot").alias("id")).distinct())
    found = rows.join(_thinned(texts, rows.select("id").distinct()), "id")
    ordered = found.repartition("pivot", "share").sortWithinPartitions("pivot", "share")
    return ordered.mapInArrow(_confirm_stars(percent), "a long, b long")


def _sketch(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = shingle_sets(utf8(batch.column("text")), SHINGLE_WORDS)
            registers = registers_of(sets)
            bands = bands_of(registers, percent)
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array([int(np.add.reduce(s).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([int(np.add.reduce(mix(s)).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.reshape(-1))),
                ],
                ["id", "n_shingles", "set_a", "set_b", "registers", "bands"],
            )

    return run


def _pairs(
    registers: np.ndarray, bands: np.ndarray, sizes: np.ndarray, block: np.ndarray, first: np.ndarray, key: int, lo: int, hi: int, threshold: float
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row the later rows to confirm it with: possible partners of another first component that meet in no earlier band, or in no other task."""
    band = int((bands[0] == key).argmax())
    for row in range(len(registers) - 1):
        if (first[row + 1 :] == first[row]).all():
            continue
        at, estimate = possible_partners(registers, sizes, row, threshold)
        if len(at):
            fresh = first[at] != first[row]
            at, estimate = at[fresh], estimate[fresh]
        if lo != hi:
            fresh = block[at] != block[row]
            at, estimate = at[fresh], estimate[fresh]
        if len(at) and band:
            fresh = ~(bands[at, :band] == bands[row, :band]).any(axis=1)
            at, estimate = at[fresh], estimate[fresh]
        if len(at):
            yield row, at, estimate


def _candidates(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: tuple[list, ...] = ([], [], [], [], [], [])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "lo", "hi", "block", "first", "id"])
            for c in columns:
                c.clear()
            return out

        for group in groups(batches, ["key", "lo", "hi"]):
            n = group.num_rows
            if n < 2:
                continue
            registers = _registers(group["registers"])
            bands = np.asarray(group["bands"].combine_chunks().flatten()).reshape(n, -1)
            block, first, ids = (np.asarray(group[c]) for c in ("block", "first", "id"))
            key, lo, hi = (group[c][0].as_py() for c in ("key", "lo", "hi"))
            wanted = np.zeros(n, bool)
            for row, at, _ in _pairs(registers, bands, np.asarray(group["n_shingles"]), block, first, key, lo, hi, percent / 100):
                wanted[row] = True
                wanted[at] = True
            for i in np.flatnonzero(wanted):
                for column, value in zip(columns, (key, lo, hi, int(block[i]), int(first[i]), int(ids[i])), strict=True):
                    column.append(value)
            if len(columns[0]) >= 10_000:
                yield flush()
        yield flush()

    return run


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["key", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            sets = shingle_sets(utf8(group["text"]), SHINGLE_WORDS)
            registers = registers_of(sets)
            sizes = np.asarray([len(s) for s in sets])
            block, first = (np.asarray(group[c]) for c in ("block", "first"))
            key, lo, hi = (group[c][0].as_py() for c in ("key", "lo", "hi"))
            found = [(-e, row, int(a)) for row, at, est in _pairs(registers, bands_of(registers, percent), sizes, block, first, key, lo, hi, percent / 100) for a, e in zip(at, est, strict=True)]
            name = np.unique(first, return_inverse=True)[1].tolist()
            parent = list(range(group.num_rows))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            links = []
            for _, x, y in sorted(found):
                if root(name[x]) != root(name[y]):
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                        parent[root(name[y])] = root(name[x])
                        links.append((int(first[x]), int(first[y])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _by_block(frame: DataFrame) -> DataFrame:
    return frame.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * shared shingles >= percent * all shingles; a component is named by its smallest
    identifier, and `kept` marks the document of that name. A text without words (or null) has no shingles and stays
    alone. Rows with one identifier are one document. A row whose identifier is null belongs to its text's component
    and is kept only if no identified document has that component. Other columns are not read, so their names and
    nulls do not matter; an empty table gives no rows. A percentage that the sketches cannot hold (below 11) is refused.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sketches = settled(texts.mapInArrow(_sketch(percent), _SKETCH))
    classes = settled(
        sketches.where("n_shingles > 0 and id is not null")
        .groupBy("set_a", "set_b", "n_shingles", "registers", "bands")
        .agg(F.min("id").alias("id"))
    )
    keys = classes.select("id", F.explode("bands").alias("key"))
    stars = settled(_star_links(keys, classes, texts, percent))
    first = classes.select("id").distinct().join(connected_components(stars), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("first"))
    first = settled(first)
    known = keys.join(first, "id")
    parts = known.groupBy("key", "first").agg(F.count("*").alias("members"))
    split = parts.groupBy("key").agg(F.max(F.struct("members", "first")).alias("main"), F.sum("members").alias("members"), F.count("*").alias("parts")).where("parts > 1")
    rest_blocks = F.ceil((F.col("members") - F.col("main.members")) / BLOCK).cast("long")
    main_blocks = F.ceil(F.col("main.members") / BLOCK).cast("long")
    in_main = F.col("first") == F.col("main.first")
    hashed = F.xxhash64("id")
    met = (
        known.join(split.withColumns({"rest_blocks": rest_blocks, "main_blocks": main_blocks}), "key")
        .withColumn("block", F.when(in_main, F.col("rest_blocks") + F.pmod(hashed, F.col("main_blocks"))).otherwise(F.pmod(hashed, F.col("rest_blocks"))))
        .withColumn("last", F.col("rest_blocks") - 1 + F.when(in_main, 0).otherwise(F.col("main_blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        .select("key", "id", "first", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        .join(classes.select("id", "n_shingles", "registers", "bands"), "id")
    )
    candidates = settled(_by_block(met).mapInArrow(_candidates(percent), "key long, lo long, hi long, block long, first long, id long"))
    links = _by_block(candidates.join(_thinned(texts, candidates.select("id").distinct()), "id")).mapInArrow(_confirm(percent), "a long, b long")
    # links between first components, each named by its smallest identifier
    joined = connected_components(links).withColumnRenamed("node", "first")
    components = first.join(joined, "first", "left").select(F.col("id").alias("node"), F.coalesce("component", "first").alias("component"))
    named = classes.join(components, classes["id"] == components["node"], "left").select(
        "set_a", "set_b", F.coalesce("component", "id").alias("class_component")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("class_component")).otherwise(F.col("id"))
    return (
        sketches.select("id", "n_shingles", "set_a", "set_b")
        .join(named, ["set_a", "set_b"], "left")
        .select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def keep_one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 85) -> DataFrame:
    """The documents, all columns, without those that `near_duplicates` does not keep. Rows without identifier stay."""
    found = near_duplicates(documents, id_column, text_column, percent)
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents[id_column] == gone["__gone"], "left_anti")
