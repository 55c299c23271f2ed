"""SimHash near-duplicates, found with the generalised pigeonhole principle.

The bits of the fingerprints are put into partitions, correlated bits together. If two fingerprints
differ in at most ``distance`` bits and the thresholds of the partitions sum to ``distance`` less
the number of partitions plus 1 (a threshold of -1 skips its partition), then in some partition they
differ by at most its threshold. A dynamic programme gives out the thresholds, and the number of
partitions is chosen, by the estimated number of probes and candidates. Every fingerprint then
probes, in each partition, the values within the threshold of its own; a join finds the
fingerprints there and verifies the whole distance. Its condition also passes over pairs that an
earlier partition finds, so every link comes out once.

Links at small distances (at distance 1 a fingerprint has at most 64) are joined into groups first;
links inside such a group are not put out again, which keeps families of near copies from squaring.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import pick, spread_join, stored
from loomwright.llm.common import values as each_of
from loomwright.llm.components import components

BITS, SEED = 64, 42
#: Fingerprints drawn to estimate correlations and candidate counts, and pairs drawn from them.
SAMPLE, PAIRS = 20_000, 1_000_000
#: Cost of verifying a candidate, against writing a probe.
CANDIDATE_COST = 0.05
MOST_PARTITIONS = 8
#: Distances at which links are joined into groups before the given one.
FIRST_DISTANCES = (1, 4)


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle of so many words (of the whole text, if it has fewer; none without a word)."""
    import numpy as np
    import xxhash

    hashed = xxhash.xxh64_intdigest
    # On bytes, lower() changes A-Z alone and split() parts at 0x20 and 0x09-0x0D alone.
    found = text.encode("utf-8", "replace").lower().split()
    n = len(found)
    if not n:
        return []
    joined = b" ".join(found)
    if n <= words:
        return [hashed(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=n) + 1)
    starts = [0, *ends[: n - words].tolist()]
    return [hashed(joined[a : z - 1], SEED) for a, z in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def fingerprint(text: str, words: int) -> int:
    """The SimHash of a text: a bit is set if it is in over half of its shingles' hashes."""
    return simhash_of(shingle_hashes(text, words))


def simhash_of(values) -> int:
    """The SimHash of a text by the hashes of its shingles (a list or an array)."""
    import numpy as np

    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), 65_536):
        part = np.array(values[i : i + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for b in batches:
        found = np.array([fingerprint(t or "", words) for t in each_of(b.column(1))], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


@dataclass(frozen=True)
class Plan:
    masks: tuple[int, ...]
    thresholds: tuple[int, ...]

    def flips(self, i: int) -> list[int]:
        """The values within the threshold of 0 in partition i, as signed longs."""
        bits = [1 << b for b in range(BITS) if self.masks[i] >> b & 1]
        layers = [[0]]
        for _ in range(self.thresholds[i]):
            layers.append([x | b for x in layers[-1] for b in bits if b > x])
        return [_signed(x) for layer in layers for x in layer]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _groups(sample, count: int) -> list[list[int]]:
    """Bits in ``count`` groups of about equal size, correlated bits together."""
    import numpy as np

    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits.astype(np.float64) - bits.mean(axis=0)
    norm = np.sqrt((centred**2).sum(axis=0))
    close = np.abs(centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    np.fill_diagonal(close, 0)
    left, groups = list(range(BITS)), []
    for k in range(count, 0, -1):
        group = [max(left, key=lambda b: close[b, left].sum())]
        left.remove(group[0])
        while len(group) < math.ceil((len(left) + len(group)) / k):
            best = max(left, key=lambda b: close[b, group].mean())
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _thresholds(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """The least sum of costs[i][t + 1] over thresholds t from -1 that sum to ``total``, and those."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, given) in best.items():
            for t, more in enumerate(row, start=-1):
                if spent + t not in nxt or cost + more < nxt[spent + t][0]:
                    nxt[spent + t] = (cost + more, (*given, t))
        best = nxt
    return best[total]


def make_plan(sample, rows: int, distance: int) -> Plan:
    """The cheapest partitions and thresholds for so many rows, by a sample of their fingerprints (uint64)."""
    import numpy as np

    draw = np.random.default_rng(3)
    one, two = (sample[draw.integers(0, len(sample), PAIRS)] for _ in range(2))
    differ = (one ^ two)[one != two]
    plans = []
    for count in range(1, min(MOST_PARTITIONS, distance + 1) + 1):
        groups, costs = _groups(sample, count), []
        masks = tuple(sum(1 << b for b in g) for g in groups)
        for group, mask in zip(groups, masks, strict=True):
            apart = np.bitwise_count(differ & np.uint64(mask))
            row = [0.0]
            for t in range(distance + 1):
                ball = sum(math.comb(len(group), k) for k in range(t + 1))
                share = max(float((apart <= t).mean()) if len(apart) else 0.0, ball / 2.0 ** len(group))
                row.append(1 + ball + CANDIDATE_COST * share * rows)
            costs.append(row)
        cost, given = _thresholds(costs, distance - count + 1)
        plans.append((cost, Plan(masks, given)))
    return min(plans, key=lambda p: p[0])[1]


def _apart(mask: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(_signed(mask))))


def links(values: DataFrame, plan: Plan, distance: int) -> DataFrame:
    """(a, b), once for each two fingerprints (column fp, of distinct values; group) of other groups that differ by at most ``distance`` bits."""
    index, probes = [], []
    for i, mask in enumerate(plan.masks):
        if plan.thresholds[i] >= 0:
            own = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
            index.append(F.struct(F.lit(i).alias("i"), own.alias("value")))
            probes += [F.struct(F.lit(i).alias("i"), own.bitwiseXOR(F.lit(flip)).alias("value")) for flip in plan.flips(i)]
    right = values.select(F.col("fp").alias("b"), F.col("group").alias("gb"), F.explode(F.array(*index)).alias("at")).select(F.col("at.i").alias("j"), F.col("at.value").alias("here"), "b", "gb")
    left = values.select(F.col("fp").alias("a"), F.col("group").alias("ga"), F.explode(F.array(*probes)).alias("at")).select("at.i", "at.value", "a", "ga")
    new = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (_apart((1 << BITS) - 1) <= distance)
    for j, mask in enumerate(plan.masks):
        if plan.thresholds[j] >= 0:
            new &= (F.col("i") <= j) | (_apart(mask) > plan.thresholds[j])
    met = (F.col("i") == F.col("j")) & (F.col("value") == F.col("here"))
    return left.join(right, met & new).select("a", "b")


def plans_for(values: DataFrame, distance: int, first: tuple[int, ...] = FIRST_DISTANCES) -> list[tuple[int, Plan]]:
    """Distances at which links are looked for, one after the other, each with its plan; none without values.

    ``values`` has distinct fingerprints in column fp. A sample of about SAMPLE of them decides the
    cost alone: any plan finds the same links.
    """
    import numpy as np

    count = values.count()
    if not count:
        return []
    drawn = values.where(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < 1_000_000 * min(1.0, SAMPLE / count)).select("fp")
    sample = drawn.toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    sample = sample if len(sample) else np.array([0], dtype=np.uint64)
    return [(d, make_plan(sample, count, d)) for d in (*(d for d in first if d < distance), distance)]


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of each document.

    A document's component holds all that can be reached over fingerprints of at most ``distance``
    differing bits; its id is the smallest doc_id in it (null if all are null). Texts are taken
    whole, with A-Z lower-cased, as words between white space (0x20, 0x09-0x0D); a text with fewer
    words than a shingle counts as one shingle, texts without a word (empty or null) have fingerprint
    0 and are linked like any other. Repeats of a shingle count. Time and memory of a very long text
    grow with its length. Rows that repeat an id or a text have equal results; of an id in several
    components every row has its own text's. There are no ties to break. An empty table gives an
    empty result; columns are found by exact name, and others, whatever their names, are not looked at.
    For links by a similarity of texts see :mod:`loomwright.llm.set_similarity`.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = stored(rows.mapInArrow(functools.partial(_fingerprints, words=words), "doc_id long, fp long"), "fingerprints")
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-values")
    near = values.select("fp", F.col("fp").alias("group"))
    for within, plan in plans_for(values, distance):
        inside = near.where("fp <> group").select(F.col("fp").alias("a"), F.col("group").alias("b"))
        roots = components(links(near, plan, within).unionByName(inside)).withColumnRenamed("node", "fp")
        near = stored(values.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")), "fingerprint-groups")
    rooted = values.select("fp", "least").join(near, "fp")
    named = rooted.groupBy("group").agg(F.min("least").alias("component_id"))
    named = stored(spread_join(rooted, named, "group").select("fp", "component_id"), "components")
    return spread_join(rows, named, "fp").select("doc_id", "fp", "component_id")
