"""N-gram Jaccard join over a token-group matrix.

1. Every text becomes the set of its distinct shingles.  Texts with equal sets are
   one class, kept by its smallest id, so copies meet once.
2. Classes that share one of four min-hashes, and are of like size, are compared in small cells.
   This finds nearly all links of near copies at the price of a few texts each; what it
   finds are components to begin with.  Nothing depends on it but the amount of work.
3. The classes of one component are groups of about ``GROUP`` members.  The matrix has a row
   (token, component) for the tokens in the prefixes of the members.  In one order of
   tokens for all, two sets that link share a token among their first n - ceil(t n) + 1.
   The order puts frequent tokens last; it is exact whatever the order, so the counts
   behind it may be estimates.
4. Two components that share a token, with sizes and places that leave room for enough
   overlap, are bound: a set may overlap a group in no more tokens than those whose bit
   is set in the union of the group's bitmaps.  Only members within the bound open
   the other component's groups.
5. Opened groups are compared on whole texts, and links become components.  At first a set asks only
   the best of a component's groups; only if that linked nothing of the two components it asks the rest.

Nulls, empty and blank texts have no shingles and link with nothing.  A null id is
the smallest.  Repeated rows are one class.  An empty table gives an empty result.
A class is known by its set and its texts by (id, hash), so rows with the same id (or
none) and different texts are documents of their own and share only what their texts
link; the id of a component is the smallest in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludomill.llm.components import Forest, components
from ludomill.llm.grouped import whole_groups
from ludomill.llm.words import Words, mix, text_parts
from ludomill.session import settle

PERCENT = 90
WIDTH = 3
GROUP = 64
# Queries compared with one group in one task.
OPENED = 512
# Bits of a set's bitmap: the power of two above twice its size, within these.
BITMAP = 2048
LARGEST_BITMAP = 1 << 16
# The order of tokens: counts per place of a token's top bits, of which the largest are kept.
PLACE_BITS = 22
ORDERED = 1 << 16
# Min-hashes of the cells.
SALTS = (0x51ED27, 0xA24BAED4, 0x9FB21C65, 0xE6546B64)
_NONE = -(1 << 63)


class Sets:
    """Distinct shingles of each text, sorted: those of text i are tokens[bounds[i]:bounds[i + 1]]."""

    def __init__(self, texts: pa.Array, width: int):
        n = len(texts)
        owner, hashes = Words(texts, lower=True).shingles(width)
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        self.owner, self.tokens = owner[first], hashes[first]
        self.bounds = np.searchsorted(self.owner, np.arange(n + 1))
        self.sizes = np.diff(self.bounds)

    def digests(self) -> list[bytes | None]:
        return [
            hashlib.blake2b(self.tokens[a:b].tobytes(), digest_size=16).digest() if b > a else None
            for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist())
        ]


def bitmaps(sets: Sets) -> list[bytes]:
    """A bitmap per text.  Larger ones fold onto smaller ones: bit b of one is bit b mod s of one of s bits."""
    wanted = np.maximum(BITMAP, np.minimum(LARGEST_BITMAP, 1 << np.ceil(np.log2(np.maximum(sets.sizes, 1) * 2)).astype(np.int64)))
    hashed = mix(sets.tokens + np.uint64(7)).astype(np.int64)
    out = [b""] * len(wanted)
    for bits in set(wanted.tolist()):
        rows = np.flatnonzero(wanted == bits)
        row_of = np.full(len(wanted), -1)
        row_of[rows] = np.arange(len(rows))
        own = row_of[sets.owner]
        used = own >= 0
        table = np.zeros((len(rows), bits), bool)
        table[own[used], hashed[used] & (bits - 1)] = True
        for row, packed in zip(rows.tolist(), np.packbits(table, axis=1)):
            out[row] = packed.tobytes()
    return out


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded to ``size`` bytes."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def _node(rep: int, digest: bytes) -> bytes:
    """A class as a node of the links; nodes sort by their smallest id."""
    return (rep - _NONE).to_bytes(8, "big") + digest


def _node_column() -> Column:
    # -2^63 comes first if the sign bit is turned over.
    return F.concat(F.unhex(F.lpad(F.hex(F.col("rep").bitwiseXOR(F.lit(_NONE))), 16, "0")), F.col("digest"))


def _places(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - PLACE_BITS)).astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo, hi in text_parts(batch.column("text")):
        yield batch.slice(lo, hi - lo)


def measured(docs: DataFrame, width: int) -> DataFrame:
    """Rows (doc_id, n, digest) of all documents, and rows (place, times) with the tokens counted per task."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("place", pa.int64()), ("times", pa.int64())]
        )
        times = np.zeros(1 << PLACE_BITS, np.int32)
        for batch in batches:
            for part in _texts(batch):
                ids, sets = part.column("doc_id"), Sets(part.column("text"), width)
                times += np.bincount(_places(sets.tokens), minlength=1 << PLACE_BITS).astype(np.int32)
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sets.sizes, pa.int64()), pa.array(sets.digests(), pa.binary()), none, none], schema=schema
                )
        # Rare places sort alike anyway, so only those a task saw more often than by chance are handed on.
        mean = times.mean()
        often = np.flatnonzero(times >= max(3, mean + 4 * np.sqrt(mean)))
        none = pa.nulls(len(often), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, pa.nulls(len(often), pa.binary()), pa.array(often), pa.array(times[often], pa.int64())], schema=schema
        )

    return docs.mapInArrow(measure, "doc_id long, n long, digest binary, place long, times long")


def class_rows(docs: DataFrame, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """One row per distinct set: digest, rep and hash (of its first text), n, min-hashes, bitmap, prefix tokens in order."""
    order = docs.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, times = order.value
        for batch in batches:
            for part in _texts(batch):
                sets = Sets(part.column("text"), width)
                some = np.flatnonzero(sets.sizes)
                if not len(some):
                    continue
                n, starts = sets.sizes[some], sets.bounds[some]
                least = [np.minimum.reduceat(mix(sets.tokens ^ np.uint64(salt)), starts) for salt in SALTS]
                keys = np.stack(least, 1).view(np.int64).ravel()
                maps = bitmaps(sets)
                weight = np.zeros(len(sets.tokens), np.int64)
                if len(places):
                    own = _places(sets.tokens)
                    at = np.minimum(np.searchsorted(places, own), len(places) - 1)
                    weight = np.where(places[at] == own, times[at], 0)
                by = np.lexsort((sets.tokens, weight, sets.owner))
                length = sets.sizes + (-percent * sets.sizes) // 100 + 1  # n - ceil(t n) + 1
                inside = np.arange(len(by)) - sets.bounds[sets.owner] < length[sets.owner]
                prefix = sets.tokens[by][inside].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(length[some])]).astype(np.int32)
                digests = sets.digests()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[i] for i in some], pa.binary()),
                        part.column("rep").take(pa.array(some)),
                        part.column("hash").take(pa.array(some)),
                        pa.array(n, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(SALTS)), pa.array(keys)),
                        pa.array([maps[i] for i in some], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)),
                    ],
                    names=["digest", "rep", "hash", "n", "keys", "bits", "tokens"],
                )

    found = docs.mapInArrow(
        rows, "digest binary, rep long, hash long, n int, keys array<bigint>, bits binary, tokens array<bigint>"
    )
    first = F.min_by(F.struct("rep", "hash", "n", "keys", "bits", "tokens"), F.struct("rep", "hash")).alias("x")
    return found.groupBy("digest").agg(first).select("digest", "x.*")


def _enough(shared, total, percent: int):
    """Whether sets of ``total`` tokens together that share so many link."""
    return shared * (100 + percent) >= total * percent


def cells(classes: DataFrame, percent: int, size: int) -> DataFrame:
    """gid, rep, hash, n, digest, bits: classes with a min-hash in common, in groups of about ``size``.

    A cell holds sets whose sizes fall into one interval; the intervals of every second
    min-hash are shifted by half.  Two sets of a large cell are in each of its groups and hold them together.
    """
    step = -np.log(percent / 100) if percent < 100 else 1.0
    interval = F.floor(F.log(F.col("n")) / step + F.col("k") % 2 * 0.5)
    rows = classes.select("digest", "n", F.posexplode("keys").alias("k", "least"))
    rows = rows.select("digest", F.xxhash64("k", "least", interval).alias("cell"))
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    rows = rows.join(settle(counts.filter("held > 1")), "cell")
    parts = F.ceil(F.col("held") / size).cast("int")
    own = F.array(F.pmod(F.xxhash64("digest"), parts).cast("int"))
    held_by_all = F.col("digest").isin(F.col("low"), F.col("high"))
    part = F.explode(F.when(held_by_all, F.sequence(F.lit(0), parts - 1)).otherwise(own)).alias("part")
    # Only the members of cells go on with their bitmaps.
    placed = rows.select("cell", "digest", part).select(F.xxhash64("cell", "part").alias("gid"), "digest")
    return settle(placed).hint("merge").join(classes.select("rep", "hash", "n", "digest", "bits"), "digest")


def plausible(rows: DataFrame, percent: int) -> DataFrame:
    """gid, rep, hash, digest of the members of a cell's groups that may link with another one, by their bitmaps."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["gid"]):
            keep = np.zeros(batch.num_rows, bool)
            sizes, maps = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("bits").to_pylist()
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                if b - a == 1:
                    continue
                size = min(map(len, maps[a:b]))
                table = np.stack([folded(m, size) for m in maps[a:b]]).view(np.uint64)
                n = sizes[a:b]
                missing = np.stack([np.bitwise_count(table[i] & ~table).sum(1) for i in range(b - a)]).astype(np.int64)
                most = np.minimum(n[:, None] - missing, n[None, :] - missing.T)
                may = _enough(most, n[:, None] + n[None, :], percent)
                np.fill_diagonal(may, False)
                keep[a:b] = may.any(1)
            yield batch.select(["gid", "rep", "hash", "digest"]).filter(pa.array(keep))

    rows = rows.repartition("gid").sortWithinPartitions("gid")
    return rows.mapInArrow(judge, "gid long, rep long, hash long, digest binary")


_MEMBER = ["rep", "hash", "n", "digest", "bits"]
_GROUPS = (
    "gid binary, comp binary, held long, lo int, hi int, bits binary, "
    "members array<struct<rep: bigint, hash: bigint, n: int, digest: binary, bits: binary>>, "
    "tokens array<struct<token: bigint, room: int>>"
)


def _matrix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrix rows of groups: their union, their members, and how much of a set can follow each prefix token."""
    for batch, starts in whole_groups(batches, ["gid"]):
        group = np.zeros(batch.num_rows, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        ends = np.append(starts[1:], batch.num_rows).astype(np.int32)
        n = batch.column("n").to_numpy(zero_copy_only=False)
        maps = batch.column("bits").to_pylist()
        unions = []
        for a, b in zip(starts.tolist(), ends.tolist()):
            size = min(map(len, maps[a:b]))
            unions.append(np.bitwise_or.reduce([folded(m, size) for m in maps[a:b]]).tobytes() if b - a > 1 else maps[a])
        lists = batch.column("tokens")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        room, owner = np.repeat(n, sizes) - place, np.repeat(group, sizes)
        order = np.lexsort((-room, tokens, owner))
        tokens, room, owner = tokens[order], room[order], owner[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        per_group = np.cumsum(np.bincount(owner[first], minlength=len(starts))).astype(np.int32)
        offsets = lambda e: pa.array(np.concatenate([[0], e]).astype(np.int32))
        members = pa.StructArray.from_arrays([batch.column(c) for c in _MEMBER], names=_MEMBER)
        pairs = pa.StructArray.from_arrays(
            [pa.array(tokens[first]), pa.array(room[first].astype(np.int32))], names=["token", "room"]
        )
        begins = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("gid").take(begins),
                batch.column("comp").take(begins),
                batch.column("held").take(begins),
                pa.array(np.minimum.reduceat(n, starts).astype(np.int32)),
                pa.array(np.maximum.reduceat(n, starts).astype(np.int32)),
                pa.array(unions, pa.binary()),
                pa.ListArray.from_arrays(offsets(ends), members),
                pa.ListArray.from_arrays(offsets(per_group), pairs),
            ],
            names=["gid", "comp", "held", "lo", "hi", "bits", "members", "tokens"],
        )


def groups_of(classes: DataFrame, roots: DataFrame, size: int) -> DataFrame:
    """The groups of each component (``comp``, of ``held`` classes); ``roots``: node, root."""
    counts = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("held"))
    both = roots.join(counts, "root")
    both = settle(both.union(counts.select("root", F.col("root").alias("node"), "held").select(both.columns)))
    placed = classes.withColumn("node", _node_column()).hint("merge").join(both, "node", "left")
    part = F.coalesce(F.pmod(F.xxhash64("digest"), F.ceil(F.col("held") / size)), F.lit(0))
    comp = F.coalesce("root", "node")
    gid = F.concat(comp, F.unhex(F.lpad(F.hex(part), 8, "0")))
    held = F.coalesce("held", F.lit(1)).alias("held")
    rows = settle(placed.select(gid.alias("gid"), comp.alias("comp"), held, "rep", "hash", "n", "digest", "bits", "tokens"))
    # A class by itself is a group where it is; only the others are brought together.
    alone = rows.filter("held = 1").mapInArrow(_matrix_rows, _GROUPS)
    more = rows.filter("held > 1").repartition("gid").sortWithinPartitions("gid").mapInArrow(_matrix_rows, _GROUPS)
    return alone.union(more)


def component_pairs(groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that share a prefix token with room for a link; a has no more classes than b."""
    rows = groups.select(F.xxhash64("comp").alias("comp"), "held", "lo", "hi", F.explode("tokens").alias("t"))
    rows = rows.select("comp", "held", "lo", "hi", "t.*")
    # One row per token and component.
    least, most = [F.min("lo").alias("lo"), F.max("hi").alias("hi")], F.max("room").alias("room")
    more = rows.filter("held > 1").groupBy("token", "comp", "held").agg(*least, most)
    rows = rows.filter("held = 1").unionByName(more)
    one = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("comp", "held", "lo", "hi", "room")])
    two = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("comp", "held", "lo", "hi", "room")])
    # Sizes within t of each other; then at the first shared token what is left must hold t / (1 + t) of both sizes.
    fits = (F.col("hi_a") * 100 >= F.col("lo_b") * percent) & (F.col("hi_b") * 100 >= F.col("lo_a") * percent)
    room = F.least("room_a", "room_b") * (100 + percent) >= (F.col("lo_a") + F.col("lo_b")) * percent
    before = (F.col("held_a") < F.col("held_b")) | ((F.col("held_a") == F.col("held_b")) & (F.col("comp_a") < F.col("comp_b")))
    # Lists make these rows look few to the planner; a broadcast of them would grow with the data.
    pairs = one.hint("merge").join(two, "token").filter(before & fits & room)
    return pairs.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()


def bound(groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(gid, own, other, over, rep, hash, digest): members of ``own`` that qualify to ask a group of ``other``, with the bound."""
    kept = ["gid", "own", "other", "over", "rep", "hash", "digest"]
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(kept, types)))

    def qualify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in kept}
            for row in batch.to_pylist():
                members = row["members"]
                sizes = np.array([m["n"] for m in members])
                missing = np.zeros(len(members), np.int64)
                for i, m in enumerate(members):
                    size = min(len(m["bits"]), len(row["bits"]))
                    missing[i] = np.bitwise_count(folded(m["bits"], size) & ~folded(row["bits"], size)).sum()
                over = sizes - missing
                needed = np.maximum(sizes, row["lo"])  # overlap of a link is at least t of the larger set
                good = (over * 100 >= needed * percent) & (sizes * percent <= row["hi"] * 100)
                for i in np.flatnonzero(good).tolist():
                    values = (row["gid"], row["own"], row["other"], int(over[i]), *[members[i][c] for c in ("rep", "hash", "digest")])
                    for c, value in zip(kept, values):
                        out[c].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    left = groups.select(F.xxhash64("comp").alias("a"), F.col("comp").alias("own"), "members")
    right = groups.select(F.xxhash64("comp").alias("b"), F.col("comp").alias("other"), "gid", "lo", "hi", "bits")
    asking = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("own", "other", "gid", "lo", "hi", "bits", "members")
    return asking.mapInArrow(qualify, "gid binary, own binary, other binary, over long, rep long, hash long, digest binary")


def opened(rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) of nodes that span the components among the texts of each (gid, part)."""

    def linked(batch: pa.RecordBatch) -> list[tuple[bytes, bytes]]:
        sets = Sets(batch.column("text"), width)
        digests = batch.column("digest").to_pylist()
        right = [d == e for d, e in zip(sets.digests(), digests)]
        reps, asks = batch.column("rep").to_pylist(), batch.column("asks").to_pylist()
        members = [i for i in range(len(reps)) if right[i] and not asks[i]]
        if not members:
            return []
        forest = Forest(len(reps))
        sizes = sets.sizes[members]
        own = np.concatenate([sets.tokens[sets.bounds[i] : sets.bounds[i + 1]] for i in members])
        slot = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(own, kind="stable")
        own, slot = own[order], slot[order]
        place = {m: k for k, m in enumerate(members)}
        for i in range(len(reps)):
            if not right[i]:
                continue
            tokens = sets.tokens[sets.bounds[i] : sets.bounds[i + 1]]
            lo, hi = np.searchsorted(own, tokens), np.searchsorted(own, tokens, side="right")
            runs = hi - lo
            at = np.repeat(lo - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
            shared = np.bincount(slot[at], minlength=len(members))
            for k in np.flatnonzero(shared * 100 >= percent * (sizes + len(tokens) - shared)).tolist():
                if k != place.get(i):
                    forest.join(i, members[k])
        roots = [forest.root(i) for i in range(len(reps))]
        pairs = [(i, r) for i, r in enumerate(roots) if digests[i] != digests[r]]
        return [(_node(reps[i], digests[i]), _node(reps[r], digests[r])) for i, r in pairs]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in whole_groups(batches, ["gid", "part"]):
            found: list[tuple[bytes, bytes]] = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                found += linked(batch.slice(a, b - a))
            columns = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    rows = rows.select("gid", "part", "rep", "digest", "asks", "text")
    return rows.repartition("gid", "part").sortWithinPartitions("gid", "part").mapInArrow(compare, "a binary, b binary")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, rep (the id, -2^63 for none), hash (of the text)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NONE)).alias("rep"), F.xxhash64("text").alias("hash"))


def _with_texts(calls: DataFrame, docs: DataFrame) -> DataFrame:
    wanted = settle(calls.select("rep", "hash").distinct())
    texts = docs.select("rep", "hash", "text").join(wanted, ["rep", "hash"], "left_semi")
    return calls.join(texts, ["rep", "hash"])


def answered(asks: DataFrame, groups: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Links between the sets that ask (gid, rep, hash, digest) and the members of the groups they ask."""
    columns = ["gid", "rep", "hash", "digest", "part"]
    parts = asks.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / OPENED).cast("int").alias("parts"))
    parts = settle(parts)
    listed = groups.select("gid", F.inline("members")).join(parts, "gid")
    answering = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asks.join(parts, "gid").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    calls = answering.select(*columns, F.lit(False).alias("asks")).union(asked.select(*columns, F.lit(True)))
    return opened(_with_texts(settle(calls), docs), percent, width)


def joined_classes(facts: DataFrame, docs: DataFrame, percent: int, width: int, group: int) -> DataFrame:
    """Per class: digest, rep and hash of its first text, node, root (the node that sorts first in its component)."""
    counted = facts.filter("place is not null").groupBy("place").agg(F.sum("times").alias("times"))
    top = np.array(
        [tuple(r) for r in counted.orderBy(F.desc("times"), "place").limit(ORDERED).collect()], np.int64
    ).reshape(-1, 2)
    top = top[np.argsort(top[:, 0])]
    classes = settle(class_rows(docs, width, percent, (top[:, 0], top[:, 1])))
    alike = settle(plausible(cells(classes, percent, group), percent))
    calls = alike.select("gid", F.lit(0).alias("part"), "rep", "hash", "digest", F.lit(False).alias("asks"))
    roots = settle(components(opened(_with_texts(calls, docs), percent, width)))
    groups = settle(groups_of(classes, roots, group))
    asking = settle(bound(groups, settle(component_pairs(groups, percent)), percent))
    best = asking.groupBy("digest", "other").agg(
        F.max_by(F.struct("gid", "rep", "hash"), F.struct("over", "gid")).alias("x")
    )
    best = settle(best.select("digest", "other", "x.*"))
    found = settle(answered(best, groups, docs, percent, width))
    # Components that have linked by now have nothing more to ask each other.
    ends = [roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    linked = found.join(ends[0], "a", "left").join(ends[1], "b", "left")
    linked = linked.select(F.coalesce("a_root", "a").alias("own"), F.coalesce("b_root", "b").alias("other"))
    linked = linked.union(linked.select("other", "own")).distinct()
    rest = asking.join(best.select("gid", "digest"), ["gid", "digest"], "left_anti").join(linked, ["own", "other"], "left_anti")
    rest = settle(rest.select("gid", "rep", "hash", "digest"))
    if not rest.isEmpty():
        found = found.union(answered(rest, groups, docs, percent, width))
    roots = settle(components(roots.toDF("a", "b").union(found)))
    classes = classes.select("digest", "rep", "hash", _node_column().alias("node")).join(roots, "node", "left")
    return settle(classes.withColumn("root", F.coalesce("root", "node")))


def similar(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, digest (of the set; null without words)."""
    docs = identified(docs)
    facts = settle(measured(docs.select("doc_id", "text"), width))
    least = F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_NONE))
    classes = joined_classes(facts, docs, percent, width, group).select("digest", least.alias("component"))
    rows = facts.filter("place is null")
    return rows.join(classes, "digest", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id"))
        .otherwise(F.nullif("component", F.lit(_NONE)))
        .alias("component_id"),
        "digest",
    )


def firsts(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """rep and hash, as of :func:`identified`, of the first text of every component; texts without words are in none."""
    docs = identified(docs)
    facts = settle(measured(docs.select("doc_id", "text"), width))
    return joined_classes(facts, docs, percent, width, group).filter("node = root").select("rep", "hash")
