"""SimHash near-dedup by a similarity of texts: fingerprints first, then the same principle on whole shingle sets.

Two texts are linked if their sets of shingles share a part of at least ``t`` of their union. A
64-bit fingerprint cannot tell that alone, so links are found in two steps, and every one of them is
verified by whole sets:

1. Fingerprints within ``distance`` bits are found by the generalised pigeonhole principle
   (:mod:`loomwright.llm.simhash`). This joins most copies into groups.
2. What else there is, is found by the same principle on the sets, taken as vectors of one bit for
   each shingle. Sets of at most B and B / t shingles that are similar enough differ in at most
   D = (B + B / t) (1 - t) / (1 + t) bits. The bits are dealt by hash to more than D partitions of
   threshold 0, so some partitions of both are equal; a signature for each partition that is not
   empty is probed. If a set fills ``f`` partitions, two similar sets have f - D equal ones that are
   not empty, and pairs with fewer are passed over. A set that fills too few for that is dealt out
   again, by other hashes, until it fills enough. No similar pair is missed.

Signatures that hold one group alone end at once. Of the others, each text is first compared with
the text that it shares most signatures with among the smallest of each, which keeps families of near
copies from squaring. Texts that still share as many signatures with other groups as they need are few;
they are looked at by single shingles, of which two texts must share so many that they meet at rare ones,
with enough left from there on for the sizes of both (:func:`_postings`). Equal 64-bit hashes of
different shingles or sets are taken as equal.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import lean, pick, sized, spread_join, stored
from loomwright.llm.components import components
from loomwright.llm.simhash import links, plans_for, simhash_of
from loomwright.llm.words import mixed, rolled_shingles

if TYPE_CHECKING:
    import numpy as np

#: Bits by which fingerprints may differ in the first step. It decides the cost alone: the second step finds all links.
DISTANCE = 8
#: Distances at which links are looked for before.
FIRST_DISTANCES = (3,)
#: Texts, and bytes of text, whose shingles a worker holds at a time.
SLICE, SLICE_BYTES = 512, 400_000
#: Bits for each signature of a filter, and most bits of all.
FILTER_BITS, MOST_BITS = 16, 1 << 26
#: Signatures (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_SIGNATURES = 100_000
#: Below this similarity partitions would be so small that each shingle is one.
COARSE = 0.7
#: Taken off products that should be whole numbers.
TINY = 1e-9
#: A set that fills too few partitions for so many hashes in a row doesn't exist, but for a mistake.
MOST_SEEDS = 256
_KNOWN = "doc_id long, th long, node long, fp long"
_SIGNED = "node long, ga long, n int, scheme int, need int, signatures array<long>"


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Batches of rows with a last column text: all hashes of each text, the distinct ones in order, and a digest of those."""
    import numpy as np
    import xxhash

    for b in _slices(lean(batches)):
        every = rolled_shingles(b.column(b.num_columns - 1).to_pylist(), words)
        found = list(map(np.unique, every))
        yield b, every, found, np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], dtype=np.uint64).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows and, but for single rows, about SLICE_BYTES of text (the last column)."""
    import pyarrow.compute as pc

    for whole in batches:
        sizes, start, size = pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0).to_pylist(), 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE or size + n > SLICE_BYTES):
                yield whole.slice(start, i - start)
                start, size = i, 0
            size += n
        if sizes:
            yield whole.slice(start)


def _survey(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """doc_id, hash of the text, digest of its set, fingerprint."""
    import numpy as np

    for b, every, _, digests in _sets(batches, words):
        prints = np.array([simhash_of(h) for h in every], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests), pa.array(prints)], names=["doc_id", "th", "node", "fp"])


def _whole(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Digest and shingles of each text."""
    import numpy as np

    for _, _, found, digests in _sets(batches, words):
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate([*found, np.zeros(0, dtype=np.uint64)]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(digests), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "shingles"])


def size_classes(most: int, similarity: float) -> np.ndarray:
    """Least sizes of the classes: a set of one class is only similar to sets of this and the classes beside it."""
    import numpy as np

    edges = [1, 2]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, math.floor((edges[-1] - 1) / similarity + TINY) + 1))
    return np.array(edges, dtype=np.int64)


def class_scheme(least: int, most: int, similarity: float) -> tuple[int, int]:
    """(D, number of partitions) for pairs whose smaller set has ``least`` to ``most`` shingles."""
    differ = math.floor((most + math.floor(most / similarity + TINY)) * (1 - similarity) / (1 + similarity) + TINY)
    parts = differ + 1
    while differ:
        empty = (1 - 1 / parts) ** least
        if parts * (1 - empty) - math.sqrt(parts * empty * (1 - empty)) >= differ + 1 or parts >= 4 * least:
            break
        parts += max(1, parts // 64)
    return differ, parts


def signatures(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int, int, np.ndarray]]:
    """(place of the set, scheme, need, signatures) of each dealing of each set; empty sets have none.

    Two sets that are similar enough have, in some scheme that both have, as many signatures in
    common as either needs, and one at least.
    """
    import numpy as np

    if similarity < COARSE:
        return [(i, 0, math.ceil(similarity * len(x) - TINY), x) for i, x in enumerate(sets) if len(x)]
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    weights = mixed(flat ^ np.uint64(0x5851F42D4C957F2D))
    edges = size_classes(int(sizes.max(initial=0)), similarity)
    own = np.searchsorted(edges, sizes, side="right") - 1
    doc = np.flatnonzero(sizes)
    doc, scheme = np.concatenate([doc, doc]), np.concatenate([own[doc], own[doc] - 1])
    doc, scheme = doc[scheme >= 0], scheme[scheme >= 0]
    known = {c: class_scheme(int(edges[c]), int(edges[c + 1]) - 1, similarity) for c in np.unique(scheme).tolist()}
    out = []
    for seed in range(MOST_SEEDS):
        if not len(doc):
            return out
        differ, parts = (np.array([known[c][k] for c in scheme.tolist()], dtype=np.int64) for k in (0, 1))
        n = sizes[doc]
        base = np.concatenate([[0], np.cumsum(parts)])
        places = np.arange(n.sum()) + np.repeat(starts[doc] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        salt = mixed((scheme * MOST_SEEDS + seed + 1).astype(np.uint64))
        drawn = mixed(flat[places] ^ np.repeat(salt, n)) >> np.uint64(32)
        part = ((drawn * np.repeat(parts, n).astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], n)
        total = np.zeros(base[-1], dtype=np.uint64)
        np.add.at(total, part, weights[places])
        filled = np.bincount(part, minlength=base[-1]) > 0
        number = (np.arange(base[-1]) - np.repeat(base[:-1], parts)).astype(np.uint64)
        signed = mixed(total ^ mixed(number + np.repeat(salt, parts)))
        count = np.add.reduceat(filled, base[:-1], dtype=np.int64)
        need = count - differ
        kept = np.split(signed[filled], np.cumsum(count)[:-1])
        out += [(int(i), int(c) * MOST_SEEDS + seed, int(k), s) for i, c, k, s in zip(doc, scheme, need, kept, strict=True)]
        doc, scheme = doc[need <= 0], scheme[need <= 0]
    raise AssertionError("a set fills too few partitions")


def _bit_places(x, bits: int):
    """Two places of each signature in a filter of so many bits (a power of two)."""
    import numpy as np

    y = mixed(np.asarray(x).view(np.uint64))
    return y & np.uint64(bits - 1), (y >> np.uint64(32)) & np.uint64(bits - 1)


def _filter_words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Number and value of the 64-bit words of a filter that some signatures set."""
    import numpy as np

    for b in batches:
        at = np.unique(np.concatenate(_bit_places(b.column(0).to_numpy(), bits)))
        word, first = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
        value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(value.view(np.int64))], names=["word", "value"])


def _filter(signatures: DataFrame) -> tuple[int, np.ndarray]:
    """(number of bits, words) of a filter that lets all these signatures pass, and few others.

    It has FILTER_BITS for each signature, up to MOST_BITS (8 MB), beyond which it lets more others pass;
    a join follows it in any case.
    """
    import numpy as np

    bits = 1 << min(max(FILTER_BITS * signatures.count(), 64).bit_length(), MOST_BITS.bit_length() - 1)
    words = signatures.mapInArrow(functools.partial(_filter_words, bits=bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))
    got, out = words.toArrow(), np.zeros(bits >> 6, dtype=np.uint64)
    out[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
    return bits, out


def _dealt(batches: Iterator[pa.RecordBatch], words: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Group and signature, a row for each signature: no lists, which would be copied once more in the JVM."""
    import numpy as np

    for b, _, found, digests in _sets(batches, words):
        if made := signatures(found, similarity):
            given = np.array([int(d) if g is None else g for g, d in zip(b.column(0).to_pylist(), digests, strict=True)], dtype=np.int64)
            group = np.repeat(given[[x[0] for x in made]], [len(x[3]) for x in made])
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.concatenate([x[3] for x in made]).view(np.int64))], names=["ga", "sig"])


def _signed(batches: Iterator[pa.RecordBatch], words: int, similarity: float, shared) -> Iterator[pa.RecordBatch]:
    """Signatures of each text that pass a filter, in a row for each dealing."""
    import numpy as np

    schema = pa.schema([("node", pa.int64()), ("ga", pa.int64()), ("n", pa.int32()), ("scheme", pa.int32()), ("need", pa.int32()), ("signatures", pa.list_(pa.int64()))])
    for b, _, found, digests in _sets(batches, words):
        made = signatures(found, similarity)
        bits, passing = shared.value
        kept = []
        for i, scheme, need, s in made:
            one, two = (passing[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) for at in _bit_places(s, bits))
            if (both := (one & two).astype(bool)).any():
                kept.append((i, scheme, need, s[both]))
        made = kept
        if not made:
            continue
        at = np.array([x[0] for x in made])
        given = b.column(0).to_pylist()
        group = [int(digests[i]) if given[i] is None else given[i] for i in at]
        ends = pa.array(np.cumsum([0, *(len(x[3]) for x in made)]).astype(np.int32))
        flat = pa.array(np.concatenate([x[3] for x in made]).view(np.int64))
        columns = [pa.array(digests[at]), pa.array(group, pa.int64()), pa.array([len(found[i]) for i in at], pa.int32())]
        columns += [pa.array([x[k] for x in made], pa.int32()) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], schema=schema)


def _whole_sets(wanted: DataFrame, rows: DataFrame, known: DataFrame, total: int, words: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (distinct); only their texts are read again."""
    wanted = sized(stored(spread_join(known.select("node", "th"), wanted, "node", total).groupBy("node").agg(F.min("th").alias("th")), "wanted-sets"))
    texts = rows.join(wanted.select("th"), "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    made = functools.partial(_whole, words=words)
    whole = texts.mapInArrow(made, "node long, shingles array<long>").join(wanted.select("node"), "node", "left_semi")
    return stored(whole.dropDuplicates(["node"]), "whole-sets")


def _alike(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one, two = (whole.select(F.col("node").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    alike = F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common"))
    return stored(both.where(alike).select("a", "b"), "similar-sets")


def _verified(pairs: DataFrame, rows: DataFrame, known: DataFrame, total: int, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough; only the texts of these pairs are read again."""
    pairs = stored(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return _alike(pairs, _whole_sets(wanted, rows, known, total, words), similarity)


def _rooted(found: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, root) of all nodes that have a link: groups that are known already, joined by the links found since."""
    if groups is not None:
        one, two = (groups.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        found = found.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = stored(components(found), "tops")
    tops = tops.unionByName(tops.select(F.col("root").alias("node"), "root").distinct())
    if groups is None:
        return stored(tops, "set-groups")
    moved = groups.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stored(moved.unionByName(tops.join(groups, "node", "left_anti")), "set-groups")


def _possible(similarity: float) -> Column:
    """Of other groups, and of sizes that can be similar enough."""
    return (F.col("ga") != F.col("gb")) & (F.least("n", "nb") >= F.greatest("n", "nb") * similarity - TINY)


def _enough(met: DataFrame) -> DataFrame:
    """(a, b, c) of the pairs that share enough signatures (c) of a scheme, by a row for each shared one."""
    once = met.groupBy("a", "b", "scheme").agg(F.count(F.lit(1)).alias("c"), F.max(F.greatest("need", "needb")).alias("needed"))
    return once.where("c >= needed").groupBy("a", "b").agg(F.max("c").alias("c"))


def _mixed(rows: DataFrame) -> DataFrame:
    """The signatures (or shingles) that rows of several groups have."""
    return rows.groupBy("sig").agg(F.min("ga").alias("low"), F.max("ga").alias("high")).where("low <> high").select("sig")


def _hopeful(shared: DataFrame) -> DataFrame:
    """The texts that share as many signatures of a scheme with other groups as they need; similar ones of two groups both do."""
    left = shared.join(_mixed(shared), "sig", "left_semi")
    return left.groupBy("a", "scheme").agg(F.count(F.lit(1)).alias("have"), F.first("need").alias("need")).where("have >= need").select("a").distinct()


def _postings(sets: DataFrame, similarity: float) -> DataFrame:
    """(sig, a, ga, n, slack): the shingles at which a text can first meet a similar one of another group.

    ``sets`` has a, ga, shingles. Shingles that one group alone has are left out, then texts with fewer
    others than they need; both once more, as fewer texts share fewer shingles. Those of a text are
    put in one order for all, the rarest first. At the first one that two texts share, all they share
    are among the ``rest`` from there on of either, which must be the part of both sizes that similar
    sets share: slack is what a text's rest has over its own part, and the other's part must fit in.
    """
    own, part = Window.partitionBy("a"), similarity / (1 + similarity)
    left = sets.select("a", "ga", F.size("shingles").alias("n"), F.explode("shingles").alias("sig"))
    for _ in range(2):
        kept = left.join(_mixed(left), "sig", "left_semi").withColumn("have", F.count(F.lit(1)).over(own))
        left = stored(kept.where(F.col("have") >= F.col("n") * similarity - TINY).select("sig", "a", "ga", "n"), "shared-shingles")
    often = left.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    placed = left.join(often, "sig").withColumn("rest", F.row_number().over(own.orderBy(F.desc("often"), "sig")))
    placed = placed.where(F.col("rest") >= F.col("n") * similarity - TINY)
    return stored(placed.select("sig", "a", "ga", "n", (F.col("rest") - F.col("n") * part).alias("slack")), "postings")


def _meetable(postings: DataFrame, similarity: float) -> DataFrame:
    """The postings whose bounds some other group at the same shingle can meet: its least size, its greatest slack."""
    part = similarity / (1 + similarity)
    groups = stored(postings.groupBy("sig", "ga").agg(F.min("n").alias("n"), F.max("slack").alias("slack")), "posting-groups")
    first = groups.groupBy("sig").agg(F.min(F.struct("n", "ga")).alias("small"), F.max(F.struct("slack", "ga")).alias("wide"))
    # A group that has the least size, or the greatest slack, itself gets that of the others.
    others = groups.join(first, "sig")
    second = others.groupBy("sig").agg(
        F.min(F.when(F.col("ga") != F.col("small.ga"), F.col("n"))).alias("n2"),
        F.max(F.when(F.col("ga") != F.col("wide.ga"), F.col("slack"))).alias("slack2"),
        F.first("small").alias("small"),
        F.first("wide").alias("wide"),
    )
    bounds = second.where(F.col("n2").isNotNull())
    met = postings.join(bounds, "sig")
    size = F.when(F.col("ga") == F.col("small.ga"), F.col("n2")).otherwise(F.col("small.n"))
    room = F.when(F.col("ga") == F.col("wide.ga"), F.col("slack2")).otherwise(F.col("wide.slack"))
    fits = (F.col("slack") >= size * part - TINY) & (room >= F.col("n") * part - TINY)
    return stored(met.where(fits).select("sig", "a", "ga", "n", "slack"), "meetable-postings")


def _meetings(postings: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the texts of other groups that meet at a shingle where the slack of each has room for the other."""
    part = similarity / (1 + similarity)
    other = postings.select(F.col("sig").alias("at"), F.col("a").alias("b"), F.col("ga").alias("gb"), F.col("n").alias("nb"), F.col("slack").alias("slackb"))
    fits = (F.col("slack") >= F.col("nb") * part - TINY) & (F.col("slackb") >= F.col("n") * part - TINY)
    return postings.join(other, (F.col("sig") == F.col("at")) & (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & fits).select("a", "b")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of each document that shares its component with another row.

    Two documents are linked if the sets of their shingles of so many words share at least
    ``similarity`` of their union, and every such link is found; repeats of a shingle don't count,
    and texts without a word (empty or null) have equal, empty sets. A component holds all that can be
    reached over links; its id is the smallest doc_id in it (null if all are null). Shingles are those
    of :func:`loomwright.llm.words.rolled_shingles`, of whole texts; time and memory of a very long
    text grow with its length. Rows that repeat a text are in one component. There are no ties to
    break. An empty table gives an empty result; columns are found by exact name, and others, whatever
    their names, are not looked at.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    known = stored(rows.mapInArrow(functools.partial(_survey, words=words), _KNOWN), "set-digests")
    total = known.count()
    verified = functools.partial(_verified, rows=rows.select("th", "text"), known=known, total=total, words=words, similarity=similarity)

    # By fingerprints.
    nodes = stored(known.groupBy("node").agg(F.min("fp").alias("fp")), "sets")
    values = stored(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.max("node").alias("last")), "fingerprint-values")
    alike = spread_join(nodes, values.where("rep < last"), "fp", total).where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    groups = None
    for within, plan in plans_for(values, DISTANCE, FIRST_DISTANCES):
        near = values.select("fp", F.col("rep").alias("node"))
        near = near.withColumn("group", F.col("node")) if groups is None else near.join(groups, "node", "left").withColumn("group", F.coalesce("root", "node"))
        close = links(stored(near.select("fp", "group"), "fingerprint-groups"), plan, within)
        one, two = (values.select(F.col("fp").alias(k), F.col("rep").alias(f"rep{k}")) for k in "ab")
        close = close.join(one, "a").join(two, "b").select(F.col("repa").alias("a"), F.col("repb").alias("b"))
        groups = _rooted(verified(close if groups is not None else close.unionByName(alike)), groups)
    if groups is None:  # there are no rows
        return known.select("doc_id", F.col("doc_id").alias("component_id"))

    # By sets, whose signatures are made twice: what is needed of them is little, and all would be more than the texts.
    placed = stored(spread_join(known.select("node", "th"), groups, "node", total).select("th", F.col("root").alias("ga")).dropDuplicates(["th"]), "grouped-texts")
    given = rows.join(sized(placed), "th", "left").select("ga", "text")
    each = given.mapInArrow(functools.partial(_dealt, words=words, similarity=similarity), "ga long, sig long")
    mixed = stored(_mixed(each), "mixed-signatures")
    passing = rows.sparkSession.sparkContext.broadcast(_filter(mixed))  # at most MOST_BITS
    signed = given.mapInArrow(functools.partial(_signed, words=words, similarity=similarity, shared=passing), _SIGNED)
    each = signed.select(F.col("node").alias("a"), "ga", "n", "scheme", "need", F.explode("signatures").alias("sig"))
    few = mixed.count() <= BROADCAST_SIGNATURES
    shared = stored(each.join(F.broadcast(mixed) if few else mixed, "sig").distinct(), "shared-signatures")

    hubs = shared.groupBy("sig").agg(F.min(F.struct(F.col("a").alias("b"), F.col("ga").alias("gb"), F.col("n").alias("nb"), F.col("need").alias("needb"))).alias("h"))
    near = _enough(shared.join(hubs.select("sig", "h.*"), "sig").where(_possible(similarity)))
    best = near.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    groups = _rooted(verified(best), groups)

    left = shared.join(groups.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("ga", F.coalesce("root", "a")).drop("root")
    hopeful = stored(_hopeful(stored(left, "grouped-signatures")).withColumnRenamed("a", "node"), "hopeful-sets")
    whole = _whole_sets(hopeful, rows.select("th", "text"), known, total, words)
    sets = whole.join(groups, "node", "left").select(F.col("node").alias("a"), F.coalesce("root", "node").alias("ga"), "shingles")
    pairs = _meetings(_meetable(_postings(sets, similarity), similarity), similarity).distinct()
    roots = _rooted(_alike(stored(pairs, "pairs"), whole, similarity), groups)

    equal = known.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("node", F.col("node").alias("root"))
    roots = stored(roots.unionByName(equal.join(roots, "node", "left_anti")), "set-groups")
    members = stored(spread_join(known.select("doc_id", "node"), roots, "node", total).select("doc_id", "root"), "members")
    named = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return spread_join(members, named, "root").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that stay when each component of :func:`near_copies` keeps its smallest id.

    Rows of one id stay or go together; rows with a null id stay. Empty tables, very long texts and
    columns with clashing names as in :func:`near_copies`.
    """
    found = near_copies(docs, words, similarity, id_col, text_col)
    gone = stored(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    names = docs.columns
    plain = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    return plain.join(sized(gone), F.col(f"__c{names.index(id_col)}") == F.col("doc_id"), "left_anti").toDF(*names)
