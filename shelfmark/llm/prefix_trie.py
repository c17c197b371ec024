"""Operator 13: the trie of conversations' prefixes, by composable fingerprints of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, small_batches, spread

#: Fingerprints are values of polynomials over the turns modulo this prime; they take SIZE bytes.
PRIME, SIZE = (1 << 127) - 1, 16
EMPTY = bytes(SIZE)
#: The contract's heads have at most this many turns, a base for each BASE conversations.
HEAD, BASE = 5, 100
#: Depths of a chain that are summed together, and conversation ids that are written out together.
PIECE, LISTED = 1 << 16, 1 << 16
NODE = ("depth", "node")


# --- the monoid: a sequence of k turns is the map x -> x * base ** k + value ------------------------------------


class Monoid:
    """Fingerprints of sequences of turns under a base that `seed` chooses. The product of two sequences'
    fingerprints is that of the one followed by the other, without a look at their turns."""

    def __init__(self, seed: int):
        self.key = seed.to_bytes(8, "little")
        self.base = int.from_bytes(hashlib.blake2b(b"base", key=self.key, digest_size=SIZE).digest(), "big") % PRIME

    def turn(self, role: str, text: str) -> int:
        data = role.encode()
        return int.from_bytes(hashlib.blake2b(len(data).to_bytes(8, "big") + data + text.encode(), key=self.key, digest_size=SIZE).digest(), "big") % PRIME

    def product(self, left: int, right: int, length: int) -> int:
        """`length` is that of the right one."""
        return (left * pow(self.base, length, PRIME) + right) % PRIME

    def rest(self, whole: int, head: int, length: int) -> int:
        """What follows the head in the whole; `length` is that of the rest."""
        return (whole - head * pow(self.base, length, PRIME)) % PRIME


def pack(value: int) -> bytes:
    return value.to_bytes(SIZE, "big")


def unpack(value: bytes) -> int:
    return int.from_bytes(value, "big")


# --- turns: places within conversations, and fingerprints of what goes before -----------------------------------

PIECES = "conv_id long, part int, at long, before binary, upto binary, role string, text string"


def _scan(seed: int):
    """Places and fingerprints within the rows of each conversation in a sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid, part = Monoid(seed), TaskContext.get().partitionId()
        conv, at, value = None, 0, 0
        for batch in batches:
            places, before, upto = [], [], []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, at, value = c, 0, 0
                places.append(at)
                before.append(pack(value))
                value = monoid.product(value, monoid.turn(role, text), 1)
                upto.append(pack(value))
                at += 1
            cols = [batch.column("conv_id"), pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), pa.array(before, pa.binary()), pa.array(upto, pa.binary()), batch.column("role").cast(pa.string()), batch.column("text").cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def _carry(seed: int):
    """What the parts of a conversation find before them, from all its parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = Monoid(seed)
        for batch in batches:
            rows = []
            for c, parts in zip(batch.column("conv_id").to_pylist(), batch.column("parts").to_pylist()):
                n, value = 0, 0
                for p in parts:
                    rows.append((c, p["part"], n, pack(value)))
                    n, value = n + p["n"], monoid.product(value, unpack(p["upto"]), p["n"])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["conv_id", "part", "n_before", "carry"])

    return run


def _composed(seed: int):
    """before and upto of rows, with what came before their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = Monoid(seed)
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in ("at", "n_before", "carry", "before", "upto")))
            out = [(a + (n or 0), b if not n else pack(monoid.product(unpack(c), unpack(b), a)), u if not n else pack(monoid.product(unpack(c), unpack(u), a + 1))) for a, n, c, b, u in rows]
            place, before, upto = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place, pa.int64()), pa.array(before, pa.binary()), pa.array(upto, pa.binary()), batch.column("role"), batch.column("text")], names=["conv_id", "at", "before", "upto", "role", "text"])

    return run


TURNS = "conv_id long, at long, before binary, upto binary, role string, text string"


def turns_of(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, at, before, upto, role, text) of each turn: its place in its conversation from 0, the fingerprints of
    the turns before it and of those up to it.

    Rows are dealt out by ranges of conversation and turn, so that a conversation with most of all rows takes
    many tasks; each scans its part, and the products of the parts of such a conversation are put before.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_tie": F.xxhash64("role", "text"), "_place": F.monotonically_increasing_id()})
    order = ["conv_id", F.col("_turn").asc_nulls_first(), "_tie", "_place"]
    dealt = rows.repartitionByRange(spread(spark), *order).sortWithinPartitions(*order)
    parts = settle(dealt.select("conv_id", "role", "text").mapInArrow(_scan(seed), PIECES), "trie-parts")
    totals = parts.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.max_by("upto", "at").alias("upto"))
    lists = totals.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "upto"))).alias("parts")).where(F.size("parts") > 1)
    carried = lists.mapInArrow(_carry(seed), "conv_id long, part int, n_before long, carry binary")
    return parts.join(carried, ["conv_id", "part"], "left").mapInArrow(_composed(seed), TURNS)


# --- rebuilt conversations --------------------------------------------------------------------------------------


def bases(turns: DataFrame) -> DataFrame:
    """(conv_id, h, n, own_head, head): a conversation's turns, how many of its first ones give way, their fingerprint,
    and (place, fingerprint) of its first HEAD turns."""
    h = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    own = F.max(F.when(F.col("at") == h, F.col("before")))
    first = F.sort_array(F.collect_list(F.when(F.col("at") < HEAD, F.struct("at", "upto"))))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"), own.alias("own_head"), first.alias("head")).withColumn("h", h)


def rebuilt(convs: DataFrame) -> DataFrame:
    """(conv_id, h, own_head, base, head, length): the symbolic form of each rebuilt conversation: the head's
    turns are the base's first ones, known by place and fingerprint, its own turns from h on follow."""
    base = convs.where(F.col("conv_id") % BASE == 0).select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    own = convs.select("conv_id", "h", "n", "own_head", (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    both = own.join(base, "base", "left")
    head = F.when(F.col("base_head").isNull(), F.array().cast("array<struct<at:bigint,upto:binary>>")).otherwise(F.slice("base_head", F.lit(1), F.col("h").cast("int")))
    both = both.withColumn("head", head)
    return both.select("conv_id", "h", "own_head", "base", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"))


MEMBERS = "conv_id long, depth long, node binary, parent binary, ref_conv long, ref_at long, chars long, is_end boolean"


def _suffix(seed: int):
    """Nodes of a conversation's own turns: head's product times that of the own turns from h up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        monoid = Monoid(seed)
        for batch in batches:
            out = []
            for c, at, before, upto, h, own, n_head, head, length in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "at", "before", "upto", "h", "own_head", "n_head", "head", "length"))):
                top, cut, k = unpack(head), unpack(own), at - h
                node = monoid.product(top, monoid.rest(unpack(upto), cut, k + 1), k + 1)
                parent = monoid.product(top, monoid.rest(unpack(before), cut, k), k)
                depth = n_head + k + 1
                out.append((depth, pack(node), pack(parent), depth == length))
            depth, node, parent, ends = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth, pa.int64()), pa.array(node, pa.binary()), pa.array(parent, pa.binary()), batch.column("conv_id"), batch.column("at"), batch.column("chars"), pa.array(ends, pa.bool_())], names=[c.split()[0] for c in MEMBERS.split(", ")])

    return run


def members(turns: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """A row (see MEMBERS) for each prefix of each rebuilt conversation; the last turn is told by a reference
    (ref_conv, ref_at) to where it is stored. The empty prefix has depth 0 and no parent."""
    root = plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(EMPTY).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_at"), F.lit(0).cast("long").alias("chars"), (F.col("length") == 0).alias("is_end"))
    heads = plans.select("conv_id", "base", "head", "length", F.posexplode("head").alias("k", "turn"))
    sizes = turns.where((F.col("at") < HEAD) & (F.col("conv_id") % BASE == 0)).select(F.col("conv_id").alias("base"), F.col("at").alias("k"), F.length("text").cast("long").alias("chars"))
    heads = heads.join(sizes, ["base", "k"]).select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), F.col("turn.upto").alias("node"), F.when(F.col("k") == 0, F.lit(EMPTY)).otherwise(F.col("head")[F.greatest(F.col("k") - 1, F.lit(0))]["upto"]).alias("parent"), F.col("base").alias("ref_conv"), F.col("k").cast("long").alias("ref_at"), "chars", (F.col("length") == F.col("k") + 1).alias("is_end"))
    top = plans.select("conv_id", "h", "own_head", F.size("head").cast("long").alias("n_head"), F.when(F.size("head") > 0, F.element_at("head", -1)["upto"]).otherwise(F.lit(EMPTY)).alias("head"), "length")
    own = turns.select("conv_id", "at", "before", "upto", F.length("text").cast("long").alias("chars")).join(top, "conv_id").where("at >= h")
    return root.unionByName(heads).unionByName(own.mapInArrow(_suffix(seed), MEMBERS))


def unequal(found: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes whose members don't all have the same parent and the same last turn, read by its references."""
    refs = found.where("depth > 0").select(*NODE, "parent", "ref_conv", "ref_at").distinct()
    stored = turns.select(F.col("conv_id").alias("ref_conv"), F.col("at").alias("ref_at"), "role", "text")
    each = refs.join(stored, ["ref_conv", "ref_at"]).groupBy(*NODE)
    return each.agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("parent", "role", "text") for f in (F.min, F.max))).where("min_parent <> max_parent OR min_role <> max_role OR min_text <> max_text")


# --- what ends at a node ----------------------------------------------------------------------------------------


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined conv_ids of each node in a sorted partition, in strings of LISTED ids at most."""
    part, seq, held, key, rows = TaskContext.get().partitionId(), 0, [], None, []

    def put():
        nonlocal seq, held
        if held:
            rows.append((*key, part, seq, ",".join(held)))
            seq, held = seq + 1, []

    def batch_of():
        out = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names=["depth", "node", "part", "seq", "ids"])

    for batch in batches:
        for d, node, c in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "conv_id"))):
            if (d, node) != key or len(held) >= LISTED:
                put()
                key = d, node
            held.append(str(c))
        yield batch_of()
    put()
    yield batch_of()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings in order, joined by commas, as they come."""
    key, sha, rows = None, None, []

    def batch_of():
        out = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.binary(), pa.string()))]
        rows.clear()
        return pa.RecordBatch.from_arrays(out, names=["depth", "node", "ends_sha256"])

    for batch in batches:
        for d, node, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "node", "ids"))):
            if (d, node) == key:
                sha.update(b",")
            else:
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (d, node), hashlib.sha256()
            sha.update(ids.encode())
        yield batch_of()
    if key is not None:
        rows.append((*key, sha.hexdigest()))
    yield batch_of()


def ends_of(found: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of nodes at which conversations end.

    A hash over a list is one chain of steps, but its ids come sorted from ranges of tasks, joined to strings,
    so that the task that hashes those of a node streams a row for each LISTED ids at most.
    """
    parts = spread(found.sparkSession)
    ids = found.where("is_end").select(*NODE, "conv_id").repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    strings = ids.mapInArrow(_listed, "depth long, node binary, part int, seq long, ids string")
    return strings.repartition(parts, *NODE).sortWithinPartitions(*NODE, "part", "seq").mapInArrow(_hashed, "depth long, node binary, ends_sha256 string")


# --- the trie ---------------------------------------------------------------------------------------------------


def _running(nodes: DataFrame) -> DataFrame:
    """nodes with `earlier`: the weights of the nodes above in the same owner's chain. Chains are cut into pieces of
    PIECE depths, whose sums are added up in a second step, so that a long chain is not one task's."""
    upto = (Window.unboundedPreceding, -1)
    rows = nodes.withColumn("_piece", F.shiftright("depth", PIECE.bit_length() - 1))
    inside = F.coalesce(F.sum("weight").over(Window.partitionBy("conv_id", "_piece").orderBy("depth").rowsBetween(*upto)), F.lit(0))
    sums = rows.groupBy("conv_id", "_piece").agg(F.sum("weight").alias("w"))
    sums = sums.select("conv_id", "_piece", F.coalesce(F.sum("w").over(Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(*upto)), F.lit(0)).alias("_before"))
    return rows.withColumn("_inside", inside).join(sums, ["conv_id", "_piece"]).withColumn("earlier", F.col("_before") + F.col("_inside")).drop("_piece", "_inside", "_before")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, any more) -> a row for each distinct prefix of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, as in the contract of op13. Turns of equal number stand in the order of a hash of role and
    text; equal rows all stay. Rows without conv_id belong to no conversation; null turns come first, null
    roles and texts are empty. c - c % 100 is Spark's, which is towards zero for negative ids. Columns of
    any other name are never read; an empty table gives no nodes, not even the root.

    No rebuilt conversation is written out: a prefix is the product of a base's head and of own turns, both
    known by fingerprint. Prefixes with one fingerprint are then held against each other by their stored
    last turns and their parents; were any to differ, all would be done anew under another base.
    Each node belongs to its smallest member, whose nodes make a chain down to its end. So sums over subtrees
    are sums over members of their chains' sums, less what lies above in the owner's chain: no step by depth.
    """
    for seed in count():
        turns = settle(turns_of(conversations, seed), "trie-turns")
        plans = settle(rebuilt(bases(turns)), "trie-plans")
        found = settle(members(turns, plans, seed), "trie-members")
        if unequal(found, turns).isEmpty():
            return _figures(found)


def _figures(found: DataFrame) -> DataFrame:
    nodes = found.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.max("chars").alias("chars"))
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars"))
    above = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = settle(nodes.join(above, [*NODE], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    chains = nodes.groupBy("conv_id").agg(F.sum("weight").alias("chain"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    below = found.select(*NODE, "conv_id").join(chains, "conv_id").groupBy(*NODE).agg(F.sum("chain").alias("chains"), F.sum("leaf").alias("n_leaves"))
    owner = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    rows = _running(nodes).join(below, [*NODE]).join(ends_of(found), [*NODE], "left").join(owner, ["depth", "parent"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("chains") - F.col("earlier")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
