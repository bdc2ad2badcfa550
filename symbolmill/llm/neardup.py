"""Near-duplicate records by adaptive multi-match prefixes.

Every text becomes its set of distinct runs of five tokens. In one global order (rare first) two sets of Jaccard
similarity ``t`` or more share at least L runs among the first n - ceil(t n) + L of each, for any L. The prefix of each
document is lengthened (L is raised) while that lowers its estimated cost: entries posted plus candidates expected. A
pair is verified only if it shares as many prefix runs as the smaller of its two L, and so many that the rest of the sets
can still make up the overlap that its two sizes ask for. Candidates are therefore complete.

A run is at most as frequent as any token or token pair in it, so the order comes from the least count of these: two count
sketches of fixed size, of tokens and of pairs, over all documents. Their kinds grow far slower than the runs, and counts are kept
on a logarithmic scale, so that neither fills up with the data. Texts with equal tokens are one class: only its least id is
indexed, its members are joined back at the end.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolmill.llm.shingles import chunks, mix, shingles
from symbolmill.sources.tables import checked_broadcast, cut

WIDTH = 5
#: Counters of each of the two sketches, a byte each once merged: 8 MB in all, whatever the data's size.
SKETCH_BITS = 22
BLOCK_BITS = 16
#: Steps of the scale of counts in a doubling, and partial sketches that one task merges.
STEPS, FAN_IN = 8, 64
LEVELS = (1, 2, 3, 4, 6, 8)
#: Cost of verifying a candidate, in posted entries.
VERIFY = 20.0


def _pairs_of(t: np.ndarray) -> np.ndarray:
    """A number of each two neighbouring tokens."""
    with np.errstate(over="ignore"):
        return mix(t[:-1] * np.uint64(0x9E3779B97F4A7C15) + t[1:])


def _survey(width: int, least: int, bits: int):
    """Rows (rid, one, two, n) of each text with ``least`` tokens, and (block, places, counts) of the two sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "one", "two", "n", "block", "places", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        counts, shift = np.zeros(2 << bits, np.uint32), np.uint64(64 - bits)
        for b in batches:
            ids, texts = b.column("rid").to_numpy(), b.column("text").to_pylist()
            for i, j in chunks(texts):
                t, cuts, _, _ = shingles(texts[i:j], width)
                sizes = np.diff(cuts)
                keep = np.flatnonzero(sizes >= least)
                if not len(keep):
                    continue
                with np.errstate(over="ignore"):
                    place = np.arange(len(t), dtype=np.uint64) - np.repeat(cuts[:-1].astype(np.uint64), sizes)
                    one = np.add.reduceat(np.append(t * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), np.uint64(0)), cuts[:-1])
                    two = np.add.reduceat(np.append((t ^ np.uint64(0x5851F42D4C957F2D)) * (place * np.uint64(0xD1342543DE82EF95) + np.uint64(3)), np.uint64(0)), cuts[:-1])
                ok = np.repeat(sizes >= least, sizes)
                np.add.at(counts, (t[ok] >> shift).astype(np.int64), np.uint32(1))
                inside = ok[:-1] & (place[1:] > 0)
                np.add.at(counts, (_pairs_of(t)[inside] >> shift).astype(np.int64) + (1 << bits), np.uint32(1))
                k = len(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][keep]), pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), pa.array(sizes[keep].astype(np.int32)), *(pa.nulls(k, x) for x in types[4:])], names)
        for k in range(2 << (bits - BLOCK_BITS)):
            c = counts[k << BLOCK_BITS : (k + 1) << BLOCK_BITS]
            at = np.flatnonzero(c)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in types[:4]), pa.array([k], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([c[at].tobytes()])], names)

    return run, "rid bigint, one bigint, two bigint, n int, block int, places binary, counts binary"


def _add(pdf):
    total = np.zeros(1 << BLOCK_BITS, np.int64)
    for at, c in zip(pdf["places"], pdf["counts"]):
        total[np.frombuffer(at, np.uint16)] += np.frombuffer(c, np.uint32)
    at = np.flatnonzero(total)
    return pdf[["block"]].head(1).assign(places=at.astype(np.uint16).tobytes(), counts=np.minimum(total[at], (1 << 32) - 1).astype(np.uint32).tobytes())


def _merged(survey: DataFrame, bits: int) -> np.ndarray:
    """The sketches of all tasks as one array of steps of the scale; partial sketches are merged FAN_IN at a time before the last step."""
    parts = survey.filter("block is not null").select("block", "places", "counts", (F.spark_partition_id() / FAN_IN).cast("int").alias("part"))
    for keys in (["block", "part"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(_add, "block int, places binary, counts binary")
        parts = parts.withColumn("part", F.lit(0))
    steps = np.zeros(2 << bits, np.uint8)
    for r in parts.select("block", "places", "counts").toLocalIterator():  # at most 2^bits blocks' counters in all
        c = np.frombuffer(r["counts"], np.uint32).astype(float)
        steps[(r["block"] << BLOCK_BITS) + np.frombuffer(r["places"], np.uint16).astype(np.int64)] = np.minimum(np.round(STEPS * np.log2(c + 1)), 255)
    return steps


def _posts(width: int, least: int, t10: int, bits: int, sketch):
    """(key, rid, meta) of each prefix entry; keys are in the global order: estimated count first, then the run's own bits."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.frombuffer(sketch.value, np.uint8)
        others_of = 2.0 ** (np.arange(256) / STEPS) - 2  # other occurrences, by step
        levels = np.array(LEVELS)
        for b in batches:
            ids, texts = b.column("rid").to_numpy(), b.column("text").to_pylist()
            for i, j in chunks(texts):
                t, cuts, sh, sizes = shingles(texts[i:j], width)
                one = steps[(t >> shift).astype(np.int64)]
                two = steps[(_pairs_of(t) >> shift).astype(np.int64) + (1 << bits)] if len(t) > 1 else one[:0]
                seen = one[: len(sh)].copy()
                for k in range(1, width):
                    np.minimum(seen, one[k : k + len(sh)], out=seen)
                for k in range(width - 1):
                    np.minimum(seen, two[k : k + len(sh)], out=seen)
                keys = (seen.astype(np.uint64) << np.uint64(55)) | (sh >> np.uint64(9))
                out = []
                for rid, at, n in zip(ids[i:j].tolist(), cuts.tolist(), sizes.tolist()):
                    if n < least - width + 1:
                        continue
                    own = np.unique(keys[at : at + n])
                    need = -(-t10 * len(own) // 10)
                    base = len(own) - need
                    others = np.cumsum(np.maximum(others_of[(own[: base + levels[-1]] >> np.uint64(55)).astype(np.int64)], 0))
                    fit = levels[levels <= need]
                    ends = base + fit
                    cost = ends + VERIFY * others[ends - 1] / fit**2
                    best = int(np.argmin(cost))
                    out.append((rid, own[: ends[best]] << np.uint64(1) | np.uint64(rid & 1), len(own), int(levels[best])))
                if out:
                    lens = [len(k) for _, k, _, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([k for _, k, _, _ in out]).view(np.int64)),
                            pa.array(np.repeat([r for r, _, _, _ in out], lens)),
                            pa.array(np.repeat([n * 16 + v for _, _, n, v in out], lens).astype(np.int32)),
                        ],
                        ["key", "rid", "meta"],
                    )

    return run, "key bigint, rid bigint, meta int"


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("rid"), b.column("text").to_pylist()
            for i, j in chunks(texts):
                _, cuts, sh, sizes = shingles(texts[i:j], width)
                own = [np.unique(sh[a : a + n]).tobytes() for a, n in zip(cuts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(own, pa.binary())], ["rid", "runs"])

    return run, "rid bigint, runs binary"


def _verify(t10: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(10 * both >= t10 * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run, "a bigint, b bigint"


def near_duplicates(records: DataFrame, t10: int = 7, least: int = 60, width: int = WIDTH, bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of ``records(rid bigint, text string)`` at a similarity of ``t10``/10.

    links(a, b): pairs a < b of class representatives, each once. classes(rid, rep): every record that takes part and
    its class's least id. Rids with the same lowest bit are compared, others never are. Null texts and texts of fewer
    than ``least`` tokens (at least ``width``) take no part. A rid delivered again with the same text counts once. Empty
    input gives empty results; extra columns are ignored. Very long texts are sets like others.
    """
    spark = records.sparkSession
    if not width <= least or not 0 < t10 <= 10 or bits < BLOCK_BITS:
        raise ValueError("least must be width or more, t10 in 1..10, bits 16 or more")
    records = records.select(F.col("rid").cast("bigint").alias("rid"), "text").filter("rid is not null and text is not null")
    f, schema = _survey(width, least, bits)
    survey = cut(records.mapInArrow(f, schema))
    sketch = spark.sparkContext.broadcast(_merged(survey, bits).tobytes())

    named = survey.filter("rid is not null").withColumn("side", F.col("rid").bitwiseAND(1))
    reps = named.groupBy("side", "one", "two", "n").agg(F.min("rid").alias("rep"))
    classes = cut(named.join(reps, ["side", "one", "two", "n"]).select("rid", "rep").distinct())

    short = F.length("text") >= least  # a text of so many tokens has so many characters
    own = records.filter(short).join(checked_broadcast(classes.filter("rid <> rep").select("rid")), "rid", "left_anti")
    f, schema = _posts(width, least, t10, bits, sketch)
    posts = own.mapInArrow(f, schema)
    left = posts.select("key", F.col("rid").alias("a"), F.col("meta").alias("ma"))
    right = posts.select("key", F.col("rid").alias("b"), F.col("meta").alias("mb"))
    na, nb, la, lb = F.expr("ma div 16"), F.expr("mb div 16"), F.expr("ma % 16"), F.expr("mb % 16")
    # all common runs up to the earlier end of the two prefixes were counted; the set whose prefix ends there has only its rest left
    need = F.expr(f"({t10} * (ma div 16 + mb div 16) + {9 + t10}) div {10 + t10}")
    rest = F.greatest(F.expr(f"({t10} * (ma div 16) + 9) div 10") - la, F.expr(f"({t10} * (mb div 16) + 9) div 10") - lb)
    pairs = (
        left.join(right.hint("merge"), "key")
        .filter((F.col("a") < F.col("b")) & (na * t10 <= nb * 10) & (nb * t10 <= na * 10))
        .groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("ma").alias("ma"), F.first("mb").alias("mb"))
        .filter(F.col("shared") >= F.greatest(F.least(la, lb), need - rest)).select("a", "b")
    )
    pairs = cut(pairs)
    wanted = checked_broadcast(pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct())
    f, schema = _sets(width)
    sets = cut(records.join(wanted, "rid", "left_semi").mapInArrow(f, schema))
    f, schema = _verify(t10)
    both = pairs.join(sets.select(F.col("rid").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("runs").alias("y")), "b")
    links = both.select("a", "b", "x", "y").mapInArrow(f, schema).distinct()
    return links, classes


def all_pairs(links: DataFrame, classes: DataFrame) -> DataFrame:
    """Every pair (a, b), a < b, of records: links between classes spread over their members, and pairs within classes."""
    first, second = classes.select(F.col("rep").alias("a"), F.col("rid").alias("ra")), classes.select(F.col("rep").alias("b"), F.col("rid").alias("rb"))
    across = links.join(first, "a").join(second, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    several = classes.groupBy("rep").agg(F.count("*").alias("k")).filter("k > 1").select("rep")
    members = classes.join(several, "rep")
    within = members.select("rep", F.col("rid").alias("a")).join(members.select("rep", F.col("rid").alias("b")), "rep").filter("a < b").select("a", "b")
    return across.unionByName(within)


def components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(rid, group_id): the least id reachable over links, for every record that takes part.

    Labels spread along links and jump to their labels' labels each round, so rounds grow with the logarithm of a path.
    """
    both = cut(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")))
    label = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("g"))
    label = cut(label)
    while True:
        near = both.join(label.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        step = label.join(near, "u", "left").select("u", F.least("g", "m").alias("h"), "g")
        jump = step.select(F.col("u").alias("h"), F.col("h").alias("hh"))
        new = cut(step.join(jump, "h", "left").select("u", F.least("h", "hh").alias("n"), "g"))
        moved = new.filter("n <> g").limit(1).count()
        label = new.select("u", F.col("n").alias("g"))
        if not moved:
            break
    return classes.join(label, classes["rep"] == label["u"], "left").select("rid", F.coalesce("g", "rep").alias("group_id"))
