"""The prefix trie of conversations as intervals of their sorted order.

A conversation is a sequence of turns, a turn is known by a 128-bit digest of its role and text.  Conversations are sorted
by their digests (shorter ones first, then by id); ``lcp[i]`` is the number of turns that conversations i - 1 and i of that
order share from the beginning.  The members of a node of the trie are an interval ``[a, b)`` of the order.  Nodes with more
than one child, or with a conversation that ends there, are the nodes of the Cartesian tree of the lcp array: position i
stands for the interval from the nearest smaller value on its left to that on its right, and equal values in one interval
are one node.  Depths between a node and its parent have the node's interval and are filled in; a conversation's last,
unshared turns are a path of nodes with that one member.

Both nearest smaller values of all positions are found in parallel.  The order is cut into blocks (range partitions).  Each
block is swept once with a stack, which closes the intervals that lie within it.  What stays open are the values
that are a minimum of the block from its beginning or to its end, as many at most as the deepest conversation has turns.
For those the nearest block with a smaller minimum is looked up in the block minima, and the position in it among that
block's own minima, which are joined by block.  Members, leaves and shared code points of an interval are differences of
prefix sums, the smallest member is a minimum over parts of blocks and block minima.

The driver sees a few numbers a block.  A task sees one block; a conversation is one value (16 bytes a turn).  Texts are
digested where they are read and never shuffled.  The hash of the members that end at a node is a running one over their
ids in order: ids of one block are joined to one row first, so that even copies of one conversation that fill many blocks
are a few rows for the task that hashes them.

Null roles and texts count as empty; turns are ordered by number, null first, equal numbers by the digest of role and
text, and repeated rows are repeated turns.  Rows without a conversation id belong to none and are left out.  No
conversations have no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, materialise, table

#: Bytes of a turn's digest in a key.
TURN = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of role and text; the role's length tells where it ends."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns (array of digest, chars): each conversation's turns in order."""
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.char_length(F.coalesce("text", F.lit(""))).alias("chars"))
    each = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), turn.alias("t"))
    in_order = F.array_sort(F.collect_list("t"))
    return each.groupBy("conv_id").agg(F.transform(in_order, lambda t: F.struct(t.digest.alias("digest"), t.chars.alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation's first h turns replaced by those of the first conversation of its ``group`` ids; h is crc32(id) % ``most``.

    All h turns of its own are left out, even if the other has fewer or does not exist.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    both = turns.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % group).join(heads, "head_id", "left").withColumn("h", h)
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("h")))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """The number of turns that two keys have in common from the beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class Place:
    """What is known at a position: itself, its lcp, the sums before it, what it shares with the position before, its length."""

    __slots__ = ("pos", "lcp", "shared", "leaves", "own", "length")

    def __init__(self, pos: int, lcp: int, shared: int, leaves: int, own: int, length: int):
        self.pos, self.lcp, self.shared, self.leaves, self.own, self.length = pos, lcp, shared, leaves, own, length


class Interval:
    """A node of the Cartesian tree while a block is swept; ``a`` and ``b`` are its nearest smaller places, None outside the block."""

    __slots__ = ("value", "a", "b", "first", "last", "before", "begun", "least", "parent", "chain")

    def __init__(self, value: int, a: Place | None, here: Place, before: list[int], least: int):
        self.value, self.a, self.b, self.first, self.last, self.before = value, a, None, here, here, before
        self.begun, self.least, self.parent, self.chain = int(here.length > value), least, None, None


class Sweep:
    """One block: ``runs`` are paths of nodes with one interval, ``open`` the intervals that may go on outside.

    ``left`` and ``right`` are the lcp with the conversations before and after the block, -1 if there are none.
    """

    def __init__(self, keys: list[bytes], ids: list[int], chars: list[list[int]], left: int, right: int):
        self.ids, n = ids, len(ids)
        self.lengths = [len(k) // TURN for k in keys]
        lcps = [left, *(shared_turns(a, b) for a, b in zip(keys, keys[1:])), right]
        self.lcps, self.low = lcps, min(lcps[:n])
        #: (Interval, or the number of a conversation), and the interval that it hangs from (None: the block after)
        self.closed: list[Interval] = []
        self.paths: list[tuple[int, int, Interval | None]] = []
        self.open: list[Interval] = []
        stack: list[Interval] = []
        shared = leaves = 0
        hanging: list[tuple[int, int]] = []
        for i in range(n):
            value, following, length = lcps[i], lcps[i + 1], self.lengths[i]
            before = list(accumulate(chars[i], initial=0))
            here = Place(i, value, shared, leaves, before[value] if value > 0 else 0, length)
            waiting, carried = [], None
            while stack and stack[-1].value > value:
                done = stack.pop()
                done.b, carried = here, done
                below = stack[-1] if stack else None
                if below:
                    below.least = min(below.least, done.least)
                if below and below.value >= value:
                    done.parent = below
                else:
                    waiting.append(done)
                self._finish(done)
            if stack and stack[-1].value == value:
                entry = stack[-1]
                entry.least, entry.last = min(entry.least, ids[i]), here
                entry.begun += length > value
            else:
                a = stack[-1].last if stack else None
                least = min(ids[i], carried.least if carried else ids[a.pos] if a else ids[i])
                entry = Interval(value, a, here, before, least)
                stack.append(entry)
            for done in waiting:
                done.parent = entry
            for conversation, top in hanging:
                self.paths.append((conversation, top, entry))
            hanging = []
            top = max(value, following) + 1
            if length >= top:
                if value >= following:
                    self.paths.append((i, top, entry))
                else:
                    hanging.append((i, top))
            shared += here.own
            leaves += following < length
        for conversation, top in hanging:
            self.paths.append((conversation, top, None))
        self.shared, self.leaves = shared, leaves
        for k in range(len(stack) - 1, 0, -1):
            stack[k - 1].least = min(stack[k - 1].least, stack[k].least)
            stack[k].chain = "S"
        stack[0].chain = "PS"
        self.open += stack

    def _finish(self, done: Interval) -> None:
        if done.a is None:
            done.chain = "P"
            self.open.append(done)
        else:
            self.closed.append(done)

    def ends(self, start: int, stop: int) -> bytes:
        """Ids of the copies that begin at ``start``, up to ``stop`` at most, as text."""
        k = start + 1
        while k < stop and self.lcps[k] == self.lengths[k] == self.lengths[start]:
            k += 1
        return ",".join(map(str, self.ids[start:k])).encode()


_RUN = "conv_id long, top int, bottom int, n_convs long, n_children long, n_leaves long, base long, before array<long>, ends string, parent long, up_block int, up_chain string, up_value int"
_OPEN = "chain string, value int, first long, begun long, least long, low int, a_pos long, a_lcp int, a_shared long, a_leaves long, a_own long, a_length int, b_pos long, b_lcp int, b_shared long, b_leaves long"
#: What the minima of a block tell others: at the first place of a prefix minimum and at the last one of a suffix minimum.
_CHAINS = "p_pos long, p_shared long, p_leaves long, p_least long, s_pos long, s_shared long, s_leaves long, s_own long, s_length int, s_least long"
_BLOCK = "size long, shared long, leaves long, smallest long, minimum int"
_COPIES = "start_block int, start_pos long, copies binary"
SWEPT = f"kind string, block int, {_RUN}, {_OPEN}, {_CHAINS}, {_BLOCK}, {_COPIES}"
_NAMES = [f.split()[0] for f in SWEPT.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_ARROW = pa.schema([(n, _KINDS[t]) for n, t in (f.split() for f in SWEPT.split(", "))])


class Edge:
    """What a block must know of its neighbours: its number, the lcp on either side, and where the copies on its left edge begin."""

    def __init__(self, number: int, left: int, right: int, same_before: bool, same_after: bool, start_block: int):
        self.number, self.left, self.right, self.same_before, self.same_after, self.start_block = number, left, right, same_before, same_after, start_block


def swept_rows(keys: list[bytes], ids: list[int], chars: list[list[int]], edge: Edge) -> Iterator[dict]:
    """The rows of :data:`SWEPT` of one sorted block."""
    s, n = Sweep(keys, ids, chars, edge.left, edge.right), len(ids)
    me = edge.number

    def up(parent: Interval | None, value: int) -> dict:
        if value < 0:
            return {}
        if parent is None:
            return {"up_block": me + 1, "up_chain": "P", "up_value": value}
        return {"parent": parent.least} if parent.chain is None else {"up_block": me, "up_chain": parent.chain[0], "up_value": value}

    for e in s.closed:
        a, b, above = e.a, e.b, max(e.a.lcp, e.b.lcp)
        yield {
            "kind": "run", "block": me, "conv_id": e.least, "top": above + 1, "bottom": e.value, "n_convs": b.pos - a.pos, "n_children": e.begun + (a.length > e.value), "n_leaves": b.leaves - a.leaves,
            "base": b.shared - a.shared - a.own, "before": [e.before[d - 1] if d else 0 for d in range(above + 1, e.value + 1)],
            "ends": hashlib.sha256(s.ends(a.pos, b.pos)).hexdigest() if a.length == e.value else NO_ENDS, **up(e.parent, above),
        }
    for k, top, parent in s.paths:
        yield {"kind": "run", "block": me, "conv_id": ids[k], "top": top, "bottom": s.lengths[k], "n_convs": 1, "n_children": 0, "n_leaves": 1, "ends": hashlib.sha256(str(ids[k]).encode()).hexdigest(), **up(parent, top - 1)}

    least_before, least_from = [None, *accumulate(ids, min)], [*accumulate(reversed(ids), min)][::-1]
    last_start = n - 1
    while last_start and s.lcps[last_start] == s.lengths[last_start] == s.lengths[last_start - 1]:
        last_start -= 1
    for e in s.open:
        f, g, low = e.first, e.last, max(p.lcp for p in (e.a, e.b) if p) + 1 if e.a or e.b else 0
        row = {"kind": "open", "block": me, "chain": e.chain, "value": e.value, "first": f.pos, "begun": e.begun, "least": e.least, "low": low, "before": [e.before[d - 1] if d else 0 for d in range(low, e.value + 1)]}
        if e.a:
            row |= {"a_pos": e.a.pos, "a_lcp": e.a.lcp, "a_shared": e.a.shared, "a_leaves": e.a.leaves, "a_own": e.a.own, "a_length": e.a.length}
        if e.b:
            row |= {"b_pos": e.b.pos, "b_lcp": e.b.lcp, "b_shared": e.b.shared, "b_leaves": e.b.leaves}
        if "P" in e.chain:
            row |= {"p_pos": f.pos, "p_shared": f.shared, "p_leaves": f.leaves, "p_least": least_before[f.pos]}
        if "S" in e.chain:
            row |= {"s_pos": g.pos, "s_shared": g.shared, "s_leaves": g.leaves, "s_own": g.own, "s_length": g.length, "s_least": least_from[g.pos]}
            # a run of copies that others may need; one that goes on in the next block is put together below
            if g.lcp < g.length and not (edge.same_after and g.pos >= last_start):
                yield {"kind": "ends", "block": me, "start_pos": g.pos, "ends": hashlib.sha256(s.ends(g.pos, n)).hexdigest()}
        yield row
    whole = edge.same_before and edge.same_after and last_start == 0
    if edge.same_before:
        yield {"kind": "copies", "block": me, "start_block": edge.start_block, "copies": s.ends(0, n)}
    if edge.same_after and not whole:
        yield {"kind": "copies", "block": me, "start_block": me, "start_pos": last_start, "copies": s.ends(last_start, n)}
    yield {"kind": "block", "block": me, "size": n, "shared": s.shared, "leaves": s.leaves, "smallest": min(ids), "minimum": s.low}


def _table(rows: Iterator[dict]) -> pa.Table:
    columns: dict[str, list] = {n: [] for n in _NAMES}
    for r in rows:
        for n in _NAMES:
            columns[n].append(r.get(n))
    return pa.table({n: pa.array(columns[n], _ARROW.field(n).type) for n in _NAMES}, schema=_ARROW)


class RangeMinima:
    """Minima of stretches of an array, and the nearest smaller value before or after a place, in logarithmic time."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, above = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(above[:-half], above[half:]))
        self.size = len(values)

    def least(self, a: int, b: int) -> int | None:
        """The minimum of [a, b)."""
        if a >= b:
            return None
        level = (b - a).bit_length() - 1
        return int(min(self.levels[level][a], self.levels[level][b - (1 << level)]))

    def before(self, k: int, value: int) -> int:
        """The last place before ``k`` with a smaller value, -1 if there is none."""
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            while k >= step and self.levels[level][k - step] >= value:
                k -= step
        return k - 1

    def after(self, k: int, value: int) -> int:
        """The first place after ``k`` with a smaller value, the array's length if there is none."""
        k += 1
        for level in range(len(self.levels) - 1, -1, -1):
            step = 1 << level
            while k + step <= self.size and self.levels[level][k] >= value:
                k += step
        return k


def _edges(blocks: DataFrame) -> dict[int, Edge]:
    """The edge of each block that has rows; a few numbers a block reach the driver."""
    spark = blocks.sparkSession
    sides = blocks.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    known = sorted(r.block for r in sides.select("block").collect())
    if not known:
        return {}
    pairs = spark.createDataFrame(list(zip(known, [*known[1:], None])), "block int, following int")
    after = sides.join(pairs, "block").join(sides.select(F.col("block").alias("following"), F.col("low").alias("next")), "following", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(shared_turns(high, nxt) if nxt is not None else -1, nxt is not None and high == nxt, low == high) for low, high, nxt in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            shared, same, single = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared, pa.int32()), pa.array(same, pa.bool_()), pa.array(single, pa.bool_())], ["block", "shared", "same", "single"])

    found = {r.block: r for r in after.select("block", "low", "high", "next").mapInArrow(run, "block int, shared int, same boolean, single boolean").collect()}
    out: dict[int, Edge] = {}
    left, same, start, single = -1, False, 0, False
    for number, block in enumerate(known):
        r = found[block]
        start = (start if single else number - 1) if same else number
        out[block] = Edge(number, left, r.shared, same, r.same, start)
        left, same, single = r.shared, r.same, r.single
    return out


def _resolved(swept: DataFrame, scratch: Scratch) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """The open intervals with both ends, in places of the whole order, and the function that gives a place of the whole order."""
    spark = swept.sparkSession
    totals = sorted(swept.where("kind = 'block'").select("block", "size", "shared", "leaves", "smallest", "minimum").collect())
    size, shared, leaves, smallest, minimum = (np.array([r[k] for r in totals], np.int64) for k in range(1, 6))
    offsets = [[0, *np.cumsum(x).tolist()] for x in (size, shared, leaves)]
    n, all_shared, all_leaves = (x[-1] for x in offsets)
    known = F.broadcast(spark.createDataFrame([(k, *(x[k] for x in offsets)) for k in range(len(totals))], "block int, at long, at_shared long, at_leaves long"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima, ids = RangeMinima(minimum), RangeMinima(smallest)
        for b in batches:
            rows = []
            for block, value, a, z in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("block", "value", "a_pos", "b_pos"))):
                left = minima.before(block, value) if a is None and value >= 0 else None
                right = minima.after(block, value) if z is None and value >= 0 else None
                between = [x for x in (ids.least(left + 1, block) if left is not None else None, ids.least(block + 1, right) if right is not None else None) if x is not None]
                rows.append((left, right, min(between, default=None)))
            found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(x), t) for x, t in zip(found, (pa.int32(), pa.int32(), pa.int64())))], [*b.schema.names, "a_block", "b_block", "between"])

    fields = [f.split()[0] for f in f"{_OPEN}, {_CHAINS}".split(", ")]
    opened = swept.where("kind = 'open'").select("block", "before", *fields).join(known, "block")
    moved = {"pos": "at", "first": "at", "shared": "at_shared", "leaves": "at_leaves"}
    opened = opened.withColumns({f: F.col(f) + F.col(moved[f.split("_")[-1]]) for f in fields if f.split("_")[-1] in moved}).drop("at", "at_shared", "at_leaves")
    opened = scratch.keep(opened.mapInArrow(find, ", ".join(f"{c} {t}" for c, t in [*opened.dtypes, ("a_block", "int"), ("b_block", "int"), ("between", "bigint")])), "open")

    own = lambda side, names: F.collect_list(F.struct("value", *[F.col(f"{side}_{c}").alias(c) for c in names])).alias(f"{side}s")
    suffix = opened.where("chain like '%S'").groupBy(F.col("block").alias("a_block")).agg(own("s", ["pos", "shared", "leaves", "own", "length", "least"]))
    prefix = opened.where("chain like 'P%'").groupBy(F.col("block").alias("b_block")).agg(own("p", ["pos", "shared", "leaves", "least"]))
    smaller = lambda chain: F.array_max(F.filter(chain, lambda x: x.value < F.col("value")))
    both = opened.where("value >= 0").join(suffix, "a_block", "left").join(prefix, "b_block", "left").withColumn("sa", smaller(F.col("ss"))).withColumn("pb", smaller(F.col("ps")))
    last = F.col("b_block") >= len(totals)
    end = {"pos": F.lit(n), "shared": F.lit(all_shared), "leaves": F.lit(all_leaves)}
    a = {c: F.coalesce(f"a_{c}", f"sa.{c}") for c in ("pos", "shared", "leaves", "own", "length")}
    b = {c: F.coalesce(F.col(f"b_{c}"), F.when(last, end[c]).otherwise(F.col(f"pb.{c}"))) for c in end}
    least = F.least("least", "between", "sa.least", "pb.least")
    resolved = both.select(
        "block", "chain", "value", "first", "begun", "low", "before", *[x.alias(f"a_{c}") for c, x in a.items()], *[x.alias(f"b_{c}") for c, x in b.items()], least.alias("least"),
        F.coalesce("a_lcp", "sa.value").alias("a_lcp"), F.coalesce(F.col("b_lcp"), F.when(last, F.lit(-1)).otherwise(F.col("pb.value"))).alias("b_lcp"),
        F.when(F.col("a_pos").isNotNull(), F.col("block")).otherwise(F.col("a_block")).alias("a_block"), F.when(F.col("b_pos").isNotNull(), F.col("block")).otherwise(F.col("b_block")).alias("b_block"),
    )

    def place(frame: DataFrame, block: str, pos: str) -> DataFrame:
        at = known.select(F.col("block").alias("_block"), "at")
        return frame.join(at, F.col(block) == F.col("_block")).withColumn(pos, F.col(pos) + F.col("at")).drop("_block", "at")

    return scratch.keep(resolved, "resolved"), place


def _hashed_copies(pieces: DataFrame) -> DataFrame:
    """start_block, start_pos, ends: the running hash over the ids of each run of copies that spans blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int, int, str]] = []
        start = pos = state = None
        for b in batches:
            for block, at, piece in zip(*(c.to_pylist() for c in b.columns)):
                if block != start:
                    if state is not None:
                        done.append((start, pos, state.hexdigest()))
                    start, pos, state = block, at, hashlib.sha256(piece)
                else:
                    state.update(b"," + piece)
        if state is not None:
            done.append((start, pos, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.string()))], ["start_block", "start_pos", "ends"])

    dealt = pieces.repartition("start_block").sortWithinPartitions("start_block", "block").select("start_block", "start_pos", "copies")
    return dealt.mapInArrow(run, "start_block int, start_pos long, ends string")


def prefix_trie(turns: DataFrame, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, unique; turns: array of digest (hex), chars), one row each.

    conv_id is the smallest member, depth the number of turns from the root, parent_conv_id the parent's conv_id, n_convs the
    number of members, n_children that of children, n_leaves that of childless nodes in the subtree, saved_tokens the sum of
    (n_convs - 1) x code points of the last text over the subtree, ends_sha256 the hash of the ids that end at the node.
    ``blocks`` is the number of range partitions, by default that of the shuffle partitions.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark)
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), "")).alias("key"), F.transform("turns", lambda t: t.chars).alias("chars"))
    placed = scratch.keep(keys.repartitionByRange(blocks, "key", "conv_id").withColumn("block", F.spark_partition_id()), "blocks")
    edges = _edges(placed)

    def sweep(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("conv_id", "ascending")])
        return _table(swept_rows(rows["key"].to_pylist(), rows["conv_id"].to_pylist(), rows["chars"].to_pylist(), edges[key[0].as_py()]))

    swept = scratch.keep(placed.groupBy("block").applyInArrow(sweep, SWEPT), "swept")
    resolved, in_order = _resolved(swept, scratch)

    columns = ["conv_id", "top", "bottom", "n_convs", "n_children", "n_leaves", "base", "before", "ends", "parent", "up_block", "up_chain", "up_value"]
    whole = in_order(swept.where("kind = 'ends'").select("block", "start_pos", "ends"), "block", "start_pos")
    copies = in_order(_hashed_copies(swept.where("kind = 'copies'").select("block", "start_block", "start_pos", "copies")), "start_block", "start_pos")
    ends = whole.select("start_pos", "ends").unionByName(copies.select("start_pos", "ends")).withColumnRenamed("start_pos", "a_pos")
    # parts of one interval that several blocks have are one node
    one = lambda c: F.first(c).alias(c)  # noqa: E731  equal for all parts
    part = resolved.groupBy("a_pos", "b_pos").agg(F.sum("begun").alias("begun"), F.min_by(F.struct("low", "before"), "first").alias("texts"), *[one(c) for c in ("value", "least", "a_shared", "a_leaves", "a_own", "a_length", "b_shared", "b_leaves", "a_lcp", "b_lcp", "a_block", "b_block")])
    above = F.greatest("a_lcp", "b_lcp")
    from_a, some = F.col("a_lcp") >= F.col("b_lcp"), above >= 0
    top = above + 1
    joined = part.join(ends, "a_pos", "left").select(
        F.col("least").alias("conv_id"), top.alias("top"), F.col("value").alias("bottom"), (F.col("b_pos") - F.col("a_pos")).alias("n_convs"),
        (F.col("begun") + (F.col("a_length") > F.col("value")).cast("long")).alias("n_children"), (F.col("b_leaves") - F.col("a_leaves")).alias("n_leaves"),
        (F.col("b_shared") - F.col("a_shared") - F.col("a_own")).alias("base"), F.slice("texts.before", top - F.col("texts.low") + 1, F.col("value") - top + 1).alias("before"),
        F.when(F.col("a_length") == F.col("value"), F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends"), F.lit(None).cast("long").alias("parent"),
        F.when(some, F.when(from_a, F.col("a_block")).otherwise(F.col("b_block"))).alias("up_block"), F.when(some, F.when(from_a, F.lit("S")).otherwise(F.lit("P"))).alias("up_chain"), F.when(some, above).alias("up_value"),
    )
    runs = swept.where("kind = 'run'").select(columns).unionByName(joined.select(columns))
    chains = resolved.select("block", "value", "least", F.explode(F.split("chain", "")).alias("chain")).where("chain <> ''")
    chains = chains.select(F.col("block").alias("up_block"), F.col("chain").alias("up_chain"), F.col("value").alias("up_value"), F.col("least").alias("up"))
    runs = runs.join(chains, ["up_block", "up_chain", "up_value"], "left").withColumn("parent", F.coalesce("parent", "up"))
    # every depth of a run is a node
    nodes = runs.select("*", F.explode(F.sequence("top", "bottom")).alias("depth"))
    at_top, at_bottom = F.col("depth") == F.col("top"), F.col("depth") == F.col("bottom")
    saved = F.when(F.col("n_convs") == 1, F.lit(0)).otherwise(F.col("base") - (F.col("n_convs") - 1) * F.get("before", F.col("depth") - F.col("top")))
    out = nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(at_top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(at_bottom, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves", saved.cast("long").alias("saved_tokens"), F.when(at_bottom, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    out = materialise(out, "trie")
    scratch.clear()
    return out


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    turns = materialise(ordered_turns(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(rebuilt(turns))


#: Nodes as chained hashes of their turns, subtrees by the paths of each node's smallest member.
ORACLE_SQL = r"""
WITH RECURSIVE bits(v, c, k) AS (
  SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, xor(list_reduce(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::UBIGINT),
      lambda r, b: xor(r >> 8, t[(xor(r & 255, b) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM turns), tab),
placed AS (
  SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d
  FROM (SELECT c, 0 AS part, p, role, text FROM ids JOIN turns ON conv_id = c - c % 100 WHERE p < h
        UNION ALL SELECT c, 1, p, role, text FROM ids JOIN turns ON conv_id = c WHERE p >= h)),
path(c, d, id, up, chars) AS (
  SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM ids
  UNION ALL SELECT c, t.d, md5(path.id || length(t.role) || ':' || t.role || t.text), path.id, length(t.text)::BIGINT FROM path JOIN placed t USING (c) WHERE t.d = path.d + 1),
deep AS (SELECT c, max(d) AS d FROM path GROUP BY c),
node AS (SELECT d, id, any_value(up) AS up, min(c) AS c, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY d, id),
kids AS (SELECT d - 1 AS d, up AS id, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
ends AS (SELECT d, id, string_agg(c::VARCHAR, ',' ORDER BY c) AS list FROM path JOIN deep USING (c, d) GROUP BY ALL),
sums AS (
  SELECT a.d, a.id, sum((k IS NULL)::BIGINT) AS leaves, sum((n.n - 1) * n.chars) AS saved
  FROM node n LEFT JOIN kids USING (d, id) JOIN path a ON a.c = n.c AND a.d <= n.d GROUP BY a.d, a.id)
SELECT node.c AS conv_id, node.d AS depth, u.c AS parent_conv_id, node.n AS n_convs, coalesce(k, 0) AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(list, '')) AS ends_sha256
FROM node JOIN sums USING (d, id) LEFT JOIN kids USING (d, id) LEFT JOIN ends USING (d, id) LEFT JOIN node u ON u.d = node.d - 1 AND u.id = node.up
"""
