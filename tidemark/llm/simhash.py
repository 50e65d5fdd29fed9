"""SimHash near-duplicates by multi-index hashing.

Words are the runs of bytes other than ``[\\x20\\x09-\\x0D]`` after A-Z is lower-cased; shingles are joined by one
space and hashed by XXH64 with seed 42.  A text with fewer words than a shingle has one shingle of them all; a text
without words (null counts as empty) has fingerprint zero, which links like any other.

Exact links (:func:`links_within_two`): a 64-bit fingerprint is two segments of 32 bits.  Of two fingerprints with at
most 2 differing bits, either the high segments differ in at most 1 bit or the low segments are equal.  So 33 points
of the Hamming ball around the high segment and the low segment itself are looked up in the segment tables and every
match is verified on all 64 bits.  Table entries with more than ``bucket`` fingerprints would give pairs that grow with
the square; for fingerprints that meet such an entry the ball of radius 1 over all 64 bits is enumerated instead: two
fingerprints are within 2 bits exactly when those balls share a point, and each point links its members to one of
them.  That is exact and linear.

Similar texts (:func:`near_duplicates`): the Jaccard similarity of the sets of five-word shingles is 0.8 or more.  At 0.8
fifteen of a hundred fingerprint bits differ, so no Hamming ball of a size that can be enumerated holds all such pairs.
Fingerprints therefore find the close pairs, and prefix filtering finds all others: texts order their distinct shingles
by one global order, rare ones first; of two texts with similarity s or more, the first ``n - ceil(s n) + 1`` shingles of
both share one.  Texts meet by those shingles.  First each text is compared with its fingerprint's neighbours and with one
text of each of its entries, so that copies become one component at a cost linear in their number; then all pairs of a
small entry that are still in different components are compared.  The texts of larger entries get new prefixes among
themselves, by the exact frequencies of all their shingles, so that what many of them have in common makes no two of them
meet; any two texts of a large entry are both among these.  Pairs in one component need no comparison, so the closure is
that of all pairs.  Bounds that never lose a pair come before the exact test: the sizes, the places of the shared
shingle in both orders, and the differing bits of parity bitmaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, materialise, sized, text_hash, text_or_empty
from tidemark.llm.graph import components

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 14
#: 64-bit words of a parity bitmap.
PARITY_WORDS = 8
#: Shingles, the most frequent of all texts, whose frequencies order the prefixes.
KEPT = 500_000
#: Bytes of texts or shingle sets that a Python worker gets at once.
BATCH_BYTES = "4m"
#: Texts of an entry that are compared with each other; those of larger entries meet by prefixes of exact frequencies.
CROWD = 32


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(line, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    return np.array([h(line[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit word whose bits are set in over half of ``hashes``; counted in blocks, so memory is bounded."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[k : k + _BLOCK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the 64-bit fingerprint (as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [majority(shingle_hashes(t.as_py(), size)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col).cast("long"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"{id_col} long, fp long")


def _ball(segment: Column, width: int) -> Column:
    """The segment and its neighbours at one bit, as an array of longs."""
    masks = F.array(*[F.lit(m) for m in [0, *(1 << k for k in range(width))]])
    return F.transform(masks, lambda m: segment.bitwiseXOR(m))


def links_within_two(fps: DataFrame, scratch: Scratch, bucket: int = 32) -> DataFrame:
    """u, v: pairs of the distinct fingerprints ``fps`` (fp: long) whose closure is that of all pairs at 2 or fewer bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)  # the second table's keys lie above the first's
    high = F.shiftrightunsigned("fp", 32)
    index = fps.select(F.explode(F.array(high, low)).alias("key"), "fp")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    # a crowded entry has one row without a fingerprint in place of its own rows
    few = index.join(sizes.where(F.col("n") <= bucket).select("key"), "key").select("key", F.col("fp").alias("other"))
    entries = few.unionByName(sizes.where(F.col("n") > bucket).select("key", F.lit(None).cast("long").alias("other")))
    probes = fps.select(F.explode(F.concat(_ball(high, 32), F.array(low))).alias("key"), "fp")
    # the tables grow with the corpus: never broadcast
    met = probes.join(entries.hint("merge"), "key").where(F.col("other").isNull() | (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= 2)).where("other is null or fp > other")
    met = scratch.keep(met.select("fp", "other").distinct(), "met")
    crowded = met.where("other is null").select("fp")
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in [0, *(1 << k for k in range(64))]])
    around = crowded.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    centre = around.groupBy("point").agg(F.min("fp").alias("other"))
    shared = around.join(centre, "point").where("fp <> other").select("fp", "other")
    return met.where("other is not null").unionByName(shared).distinct().select(F.col("fp").alias("u"), F.col("other").alias("v"))


def near_groups(docs: DataFrame, size: int = 3, bucket: int = 32) -> DataFrame:
    """doc_id, fingerprint, component_id, n_same: exact components at 2 or fewer differing bits, one row per row of ``docs``.

    Equal fingerprints are one node, so copies cost no links.  A component is named by its smallest doc_id; rows with a
    null id link like any other, and a component of such rows alone has a null name.
    """
    scratch = Scratch(docs.sparkSession)
    each = materialise(fingerprints(docs, size), "fingerprints")
    nodes = scratch.keep(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "nodes")
    found = components(links_within_two(nodes.select("fp"), scratch, bucket), scratch).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialise(placed.join(names, "component").select("fp", "component_id", "n_same"), "named")
    scratch.clear()
    return each.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def shingle_set(text: str, size: int) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(shingle_hashes(text, size))


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap with each hash's bit flipped: two sets differ in as many elements as their bitmaps in bits, or more."""
    bits = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % (64 * PARITY_WORDS), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def long_parity(hashes: np.ndarray) -> bytes:
    """A parity bitmap of a power of two bits, at least one for each hash, so that it tells long sets apart, too."""
    size = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_differs(a: bytes, b: bytes) -> int:
    """Differing bits of two such bitmaps, the longer one folded to the length of the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _frequencies(docs: DataFrame, size: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and counts of the most frequent shingles; they order the prefixes and decide no pair.

    Every shingle of every text is counted.  Those from the least count on that leaves :data:`KEPT` at most are returned.
    """

    texts = docs.select(text_or_empty().alias("text"))
    # ranges of the hashes by their first bits, of about a megabyte up to 10 GB of text
    bits = min(13, max(6, int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) >> 20).bit_length()))
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def cut(values: np.ndarray, hashes: np.ndarray) -> pa.Array:
        """The values as bytes, cut where the range of their (ascending) hashes changes."""
        ends = np.append(np.searchsorted(hashes, edges), len(hashes)).astype(np.int32) * 8
        return pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [shingle_set(t.as_py(), size) for t in b.column(0)]
            hashes, times = np.unique(np.concatenate([np.empty(0, np.uint64), *each]), return_counts=True)
            once, often = hashes[times == 1], hashes[times > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges), dtype=np.int32)), cut(once, once), cut(often, often), cut(times[times > 1].astype(np.int64), often)], ["part", "once", "often", "times"])

    def counted(part: pa.Table) -> pa.Table:
        once, often, times = (np.frombuffer(b"".join(part[c].to_pylist()), np.int64) for c in ("once", "often", "times"))
        hashes = np.concatenate([once, often])
        order = np.argsort(hashes)
        first = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] - 1)) if len(hashes) else order
        n = np.add.reduceat(np.concatenate([np.ones_like(once), times])[order], first) if len(hashes) else hashes
        return pa.table({"h": hashes[order][first][n > 1], "count": n[n > 1]})

    # a row for each range and batch: a row for each shingle would take the executors' memory
    cuts = texts.mapInArrow(ranges, "part int, once binary, often binary, times binary")
    counts = scratch.keep(cuts.groupBy("part").applyInArrow(counted, "h long, count long"), "frequencies")
    # a row for each count that occurs
    shingles, least = 0, None
    for row in sorted(counts.groupBy("count").agg(F.count("*").alias("shingles")).collect(), reverse=True):
        shingles += row["shingles"]
        if shingles > KEPT:
            break
        least = row["count"]
    found = (counts.where(F.col("count") >= least) if least else counts.limit(0)).toArrow()
    hashes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


_WORDS = [f"f{k}" for k in range(PARITY_WORDS)]


def _signatures(docs: DataFrame, size: int, tenths: int, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash, key (of the shingle set), n, fp, the bitmaps and the prefix of every text."""
    known, count = _frequencies(docs, size, scratch)
    schema = "doc_id long, text_hash long, key binary, n int, fp long, " + "".join(f"{n} long, " for n in _WORDS) + "wide binary, prefix array<long>"
    names = ["doc_id", "text_hash", "key", "n", "fp", *_WORDS, "wide", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, fps, maps, wide, prefixes = [], [], [], [], [], []
            for t in b.column(2):
                hashes = shingle_hashes(t.as_py(), size)
                s = np.unique(hashes)
                often = np.zeros(len(s), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, count[at], 0)
                first = np.argsort(often, kind="stable")[: len(s) + (-tenths * len(s)) // 10 + 1] if len(s) else []
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                fps.append(majority(hashes))
                maps.append(parity(s))
                wide.append(long_parity(s))
                prefixes.append(s[first].view(np.int64))
            columns = np.array(maps, np.int64).reshape(-1, PARITY_WORDS)
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            fps = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), fps, *(pa.array(np.ascontiguousarray(columns[:, k])) for k in range(PARITY_WORDS)), pa.array(wide, pa.binary()), prefix], names)

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), text_or_empty().alias("text")).mapInArrow(run, schema)


def _enough(differing: Column, tenths: int) -> Column:
    """Whether sets of ``m`` and ``n`` elements that differ in as many elements can have the similarity: (1 + s) d <= (1 - s) (m + n)."""
    return (10 + tenths) * differing <= (10 - tenths) * (F.col("m") + F.col("n"))


def _narrowed(pairs: DataFrame, nodes: DataFrame, tenths: int, scratch: Scratch) -> DataFrame:
    """node, other, d: the pairs (node, other) that their bitmaps do not rule out, with the differing bits."""
    left = nodes.select("node", F.col("n").alias("m"), *[F.col(n).alias(f"a{k}") for k, n in enumerate(_WORDS)])
    right = nodes.select(F.col("node").alias("other"), "n", *_WORDS)
    differing = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(n))) for k, n in enumerate(_WORDS)), F.lit(0))
    narrow = scratch.keep(pairs.join(left, "node").join(right, "other").where(_enough(differing, tenths)).select("node", "other", "m", "n"), "narrow")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [parity_differs(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(d, pa.int32())], ["node", "other", "m", "n", "d"])

    wide = narrow.join(nodes.select("node", F.col("wide").alias("x")), "node").join(nodes.select(F.col("node").alias("other"), F.col("wide").alias("y")), "other")
    found = wide.select("node", "other", "m", "n", "x", "y").mapInArrow(run, "node long, other long, m int, n int, d int")
    return found.where(_enough(F.col("d"), tenths)).select("node", "other", "d")


def _texts_of(needed: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """node, text: a text for each node of ``needed``; rows that repeat id and text give a node several equal ones."""
    needed = scratch.keep(needed.join(nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "node"), "needed")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"), text_or_empty().alias("text"))
    return texts.join(sized(needed), F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("node", "text")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, tenths: int, scratch: Scratch) -> DataFrame:
    """u, v: the ``pairs`` (node, other; a written table) whose shingle sets have a similarity of ``tenths`` / 10 or more, compared shingle by shingle."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], ["node", "data"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(10 * both >= tenths * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    needed = pairs.select("node").unionByName(pairs.select(F.col("other").alias("node"))).distinct()
    data = scratch.keep(_texts_of(needed, nodes, docs, scratch).mapInArrow(sets, "node long, data binary").dropDuplicates(["node"]), "sets")
    both = pairs.select("node", "other").join(data, "node").join(data.select(F.col("node").alias("other"), F.col("data").alias("with")), "other")
    return both.select(F.col("node").alias("u"), F.col("other").alias("v"), "data", "with").mapInArrow(compare, "u long, v long")


def _rare_first(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, tenths: int, scratch: Scratch) -> DataFrame:
    """key, node, n, at, component: prefixes of the texts ``crowd`` (node, n, component) among themselves, rarest shingles first.

    The frequencies are exact: every shingle of these texts is counted.  What a family of texts has in common therefore
    comes last in their orders, and texts below the similarity that share it meet no more.  Shingles of one text alone
    keep their places and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingle_set(t.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(s)], ["node", "key"])

    each = scratch.keep(_texts_of(crowd.select("node"), nodes, docs, scratch).dropDuplicates(["node"]).mapInArrow(run, "node long, key long"), "crowded")
    times = each.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    ordered = each.join(times, "key", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "key"))).alias("all"))
    length = F.size("all") - F.ceil(F.size("all") * tenths / 10).cast("int") + 1
    prefix = ordered.select("node", F.posexplode(F.slice("all", F.lit(1), length)).alias("at", "s")).where("s.times > 1")
    return prefix.join(crowd, "node").select(F.col("s.key").alias("key"), "node", "n", "at", "component")


def _reach(tenths: int) -> Column:
    """The most shingles a partner of a row (n, at) can have whose first shared shingle this is: all that follow are shared at best."""
    return F.floor((F.col("n") - F.col("at")) * (10 + tenths) / tenths) - F.col("n")


def near_duplicates(docs: DataFrame, size: int = 5, tenths: int = 8) -> DataFrame:
    """doc_id, text_hash, keep_id, kept: groups of documents linked by a similarity of ``tenths`` / 10 or more, a row per row of ``docs``.

    The similarity is the Jaccard similarity of the sets of ``size``-word shingles.  Equal sets are one node; null and
    empty texts form one group.  ``keep_id`` is the smallest doc_id of the group.  The row that is kept has that id and,
    where several texts have it, the smallest :func:`tidemark.llm._base.text_hash`; rows that repeat id and text are one
    document and are kept or not together.  Null ids are larger than any other; a group of them alone has a null keep_id.
    """
    scratch = Scratch(docs.sparkSession, BATCH_BYTES)
    each = scratch.keep(_signatures(docs, size, tenths, scratch), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal for equal keys
    nodes = each.groupBy("key").agg(F.min(row).alias("row"), *[one(c) for c in ("n", "fp", *_WORDS, "wide", "prefix")])
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()).select("node", "key", "row.doc_id", "row.text_hash", "n", "fp", *_WORDS, "wide", "prefix"), "nodes")

    # texts with fingerprints at 2 or fewer differing bits
    of_fp = scratch.keep(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    same = nodes.select("node", "fp").join(of_fp, "fp").where("node <> first").select("node", F.col("first").alias("other"))
    links = links_within_two(of_fp.select("fp"), scratch)
    close = links.join(of_fp.select(F.col("fp").alias("u"), F.col("first").alias("node")), "u").join(of_fp.select(F.col("fp").alias("v"), F.col("first").alias("other")), "v")
    close = same.unionByName(close.select("node", "other"))

    # entries: the texts that share a shingle of their prefixes, each with its place in the text's order
    rows = nodes.select("node", "n", F.posexplode("prefix").alias("at", "key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    rows = scratch.keep(rows.join(shared, "key"), "shared")
    heads = rows.groupBy("key").agg(F.min("n").alias("small"), F.min(F.struct("at", "node", "n")).alias("hub"))
    rows = scratch.keep(rows.join(heads, "key").where(_reach(tenths) >= F.col("small")).select("key", "node", "n", "at", "hub"), "entries")

    def possible(n: str, at: str, m: str, other_at: str) -> Column:
        """The sizes allow the similarity, and so does the number of shingles from the shared one on."""
        n, at, m, other_at = map(F.col, (n, at, m, other_at))
        return (10 * F.least(n, m) >= tenths * F.greatest(n, m)) & ((10 + tenths) * F.least(n - at, m - other_at) >= tenths * (n + m))

    hubs = rows.where(F.col("node") != F.col("hub.node")).where(possible("n", "at", "hub.n", "hub.at")).select("node", F.col("hub.node").alias("other"))
    found = scratch.keep(_narrowed(close.unionByName(hubs).distinct(), nodes, tenths, scratch), "near")
    # the likeliest link of each text; what it leaves apart is compared below
    best = scratch.keep(found.groupBy("node").agg(F.min_by("other", F.struct("d", "other")).alias("other")), "best")
    links = scratch.keep(_verified(best, nodes, docs, size, tenths, scratch), "links")
    first = components(links, scratch)
    named = rows.select("key", "node", "n", "at").join(first, "node", "left").select("key", "node", "n", "at", F.coalesce("component", "node").alias("component"))

    def between_components(entries: DataFrame) -> DataFrame:
        """The entries with texts of different components, and how many texts each has."""
        parts = entries.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("texts")).where("low <> high")
        return entries.join(parts.select("key", "texts"), "key")

    def pairs(entries: DataFrame) -> DataFrame:
        a, b = entries.alias("a"), entries.alias("b")
        apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.node") > F.col("b.node"))
        return a.join(b, apart & possible("a.n", "a.at", "b.n", "b.at")).select(F.col("a.node").alias("node"), F.col("b.node").alias("other"))

    named = scratch.keep(between_components(named), "apart")
    # two texts of a crowded entry are both in the crowd, whose own prefixes find all pairs within it
    crowd = scratch.keep(named.where(F.col("texts") > CROWD).select("node", "n", "component").distinct(), "crowd")
    ranked = scratch.keep(between_components(_rare_first(crowd, nodes, docs, size, tenths, scratch)), "ranked")
    rest = pairs(named.where(F.col("texts") <= CROWD)).unionByName(pairs(ranked)).distinct()
    rest = scratch.keep(_narrowed(rest, nodes, tenths, scratch), "rest")
    links = links.unionByName(_verified(rest, nodes, docs, size, tenths, scratch))
    found = components(links, scratch)
    placed = nodes.join(found, "node", "left").select("key", "doc_id", "text_hash", F.coalesce("component", "node").alias("component"))
    head = placed.groupBy("component").agg(F.min(row).alias("head"))
    named = placed.join(head, "component").select("key", "head")
    kept = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    out = each.select("doc_id", "text_hash", "key").join(named, "key").select("doc_id", "text_hash", F.col("head.doc_id").alias("keep_id"), kept.alias("kept"))
    out = materialise(out, "groups")
    scratch.clear()
    return out


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
