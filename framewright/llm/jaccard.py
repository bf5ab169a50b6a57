"""Exact set-similarity join on word shingles with PartEnum signatures.

Sets are put into size bands whose ends differ by the similarity bound, so similar
sets lie in the same or in neighbouring bands; a pair is looked for in the instance of the
smaller set's band. There the bound on the Jaccard similarity becomes a bound k on the
symmetric difference. The shingle domain is cut by hash into n1 > k parts: two similar sets
differ in at most k parts and agree on all others, so they share the signature of one part
at least. A set of which so few parts hold anything that the agreement may lie in empty
parts alone has one signature more, so no pair is lost.

Similar sets agree on more parts than one, so each set keeps only its rarest
signatures, one more than the parts in which they may differ: a passage that very many documents
share then seldom makes them candidates. Sets that share a signature are candidates, in steps: each set against the
least set of its groups, then the pairs of different components within a group. Candidates pass a lower bound on the difference
(of bucket counts) and are then verified by exact intersection, so the links are
exact. Pairs inside one component are never listed: large groups of near copies cost
a star, not a square. Exact copies are one set from the start.

Only groups of up to GROUP_ROWS members are paired. A larger group takes a centre, and each
member is replaced by its symmetric difference from it, which cancels what the group has in common;
similar members' differences overlap, so prefixes of them (elements that the centre lacks come first)
are the signatures of finer groups, exactly. So it goes on, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import BLOOM_BITS, bloom, bounded, discard, in_bloom, release, saved, signed
from .textarrays import U64, Words, mix, slices

BUCKETS = 128
#: Bits of the parity sketch: in how many two sets differ is a lower bound of their symmetric difference.
PARITY_BITS = 512
_PART_SALT, _BAND_SALT, _SPARSE = U64(0x8CB92BA72F3D8DD7), U64(0xA24BAED4963EE407), U64(0xD6E8FEB86659FD93)

#: Signatures keep 48 bits, for less to shuffle; chance agreements make candidates, which the exact check rejects.
_CUT = U64(16)
_SIGNATURE = (1 << 48) - 1
#: Of one text in SAMPLED the signatures are counted first; those with a HOT_SHARE-th of all, and twice SAMPLE_LEAST sets at
#: least in the sample, are dealt over HOT_LOTS partitions by set. So at most HOT_SHARE signatures are known to all tasks.
SAMPLED, HOT_SHARE, SAMPLE_LEAST, HOT_LOTS = 16, 10_000, 4, 128


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    full, short = words.shingles(k), {j: words.shingles(j) for j in range(1, k)}
    for a, b in zip(words.row_at[:-1].tolist(), words.row_at[1:].tolist()):
        n = b - a
        if n >= k:
            s = np.sort(full[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif n:
            yield short[n][a : a + 1]
        else:
            yield np.zeros(0, np.uint64)


class Bands:
    """Size bands, and the bound k and part count n1 of the instance for pairs whose smaller set is in a band."""

    def __init__(self, percent: int):
        self.percent, self.ends, self.known = percent, [0], {}

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append((self.ends[-1] + 1) * 100 // self.percent)
        return int(np.searchsorted(self.ends, size))

    def instance(self, band: int) -> tuple[int, int]:
        """k bounds the symmetric difference; of n1 parts so many hold something, but rarely, that k do not cover them."""
        if band not in self.known:
            least, most = self.ends[band - 1] + 1, self.ends[band]
            k = n1 = (100 - self.percent) * (most + most * 100 // self.percent) // (100 + self.percent)
            limit = 2 * k + 1
            while n1 < limit and (not n1 or n1 - (empty := n1 * np.exp(-least / n1)) - 3.5 * np.sqrt(empty) < k + 1):
                n1 += 1
            self.known[band] = k, n1
        return self.known[band]


def _parts(s: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(band, k, part numbers, where each part that holds anything begins), as the smaller and the larger set of a pair."""
    band = bands.of(len(s))
    for b in (band, band - 1) if band > 1 else (band,):
        k, n1 = bands.instance(b)
        part = ((s >> U64(32)) * U64(n1)) >> U64(32)
        yield b, k, part, np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))


def spares(s: np.ndarray, bands: Bands) -> list[int]:
    """For both instances, how many signatures of its own a set may leave out: all but its k + 1 rarest.

    Similar sets with f and g filled parts agree on max(f, g) - k at least, so in any order common to all sets their k + 1 rarest share one.
    """
    found = [max(0, len(first) - k - 1) for _, k, _, first in _parts(s, bands)]
    return [*found, 0][:2]


def signatures(s: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of one set of sorted hashes, and of which of its two instances each is."""
    out, role = [], []
    spread = mix(s ^ _PART_SALT)
    for i, (b, k, part, first) in enumerate(_parts(s, bands)):
        sums = np.add.reduceat(spread, first)
        salt = np.array([b], np.uint64) * _BAND_SALT
        out.append(mix(sums + part[first] * _PART_SALT + salt) >> _CUT)
        if len(first) <= k:
            out.append(mix(_SPARSE + salt) >> _CUT)
        role.append(np.full(len(first) + (len(first) <= k), i, np.uint64))
    return np.concatenate(out), np.concatenate(role)


def _fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return mix(s ^ _BAND_SALT).sum(dtype=np.uint64), mix(s ^ _SPARSE).sum(dtype=np.uint64)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, _, data, offsets in slices(batch.column("text")):
        yield from enumerate(shingle_sets(Words(data, offsets, "space"), k), a)


def _describe(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            n, one, two, sketch, odd, spare = (np.zeros(batch.num_rows, t) for t in (np.int64, np.uint64, np.uint64, f"({BUCKETS},)u1", f"({PARITY_BITS},)?", "(2,)i4"))
            for i, s in _sets(batch, k):
                n[i] = len(s)
                one[i], two[i] = _fingerprint(s)
                if not len(s):
                    continue
                spare[i] = spares(s, bands)
                odd[i] = np.bincount((s >> U64(20)).astype(np.int64) & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1
                sketch[i] = np.minimum(np.bincount((s >> U64(12)).astype(np.int64) & (BUCKETS - 1), minlength=BUCKETS), 255)
            rows = pa.array([x.tobytes() for x in sketch], pa.binary())
            parity = pa.array(list(np.packbits(odd, axis=1).view(np.int64)), pa.list_(pa.int64()))
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n), signed(one), signed(two), rows, parity, pa.array(spare[:, 0]), pa.array(spare[:, 1])],
                ["doc_id", "n", "one", "two", "sketch", "parity", "spare0", "spare1"],
            )

    return run


def _sign(k: int, percent: int, hot=None):
    """(sig, one) of every set; those of hot signatures carry a lot in the bits above the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            sigs, owners, size = [], [], 0
            for _, s in _sets(batch, k):
                if not len(s):
                    continue
                one, two = _fingerprint(s)
                if (one, two) in seen:  # exact copies within a task are combined before the shuffle
                    continue
                seen.add((one, two))
                x, role = signatures(s, bands)
                if hot is not None and len(hot.value):
                    lot = ((one >> U64(8)) % U64(HOT_LOTS) + U64(1)) << U64(48)
                    x = np.where(hot.value[np.minimum(np.searchsorted(hot.value, x), len(hot.value) - 1)] == x, x | lot, x)
                sigs.append(x)
                owners.append((one & ~U64(1)) | role)  # the lowest bit tells the instance
                size += len(x)
                if size > 200_000:
                    yield pa.record_batch([signed(np.concatenate(sigs)), signed(np.concatenate(owners))], ["sig", "one"])
                    sigs, owners, size = [], [], 0
            if size:
                yield pa.record_batch([signed(np.concatenate(sigs)), signed(np.concatenate(owners))], ["sig", "one"])
            if len(seen) > 200_000:
                seen.clear()

    return run


def _hot(docs: DataFrame, k: int, percent: int):
    """Broadcasts the sorted signatures that the sample shows to be frequent, HOT_SHARE at most; this only steers who counts them."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    sampled = some.mapInArrow(_sign(k, percent), "sig long, one long").distinct().groupBy("sig").agg(F.count("*").alias("n"))
    sampled = saved(sampled.where(F.col("n") >= SAMPLE_LEAST), "sampled")
    total = sampled.agg(F.sum("n")).first()[0] or 0
    rows = sampled.where(F.col("n") >= max(2 * SAMPLE_LEAST, total // HOT_SHARE)).orderBy(F.desc("n"), "sig").limit(HOT_SHARE).collect()
    discard(sampled)
    return docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.sig for r in rows], np.uint64)))


#: Counts stop here, which bounds what is held of one signature; more frequent ones rank alike.
MANY = 20_000


def _counted(sig: np.ndarray, one: np.ndarray, gone: int) -> pa.RecordBatch:
    """Rows of whole signatures that have two values or a lot; `gone` values of the first one went before."""
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    length = np.diff(np.append(first, len(sig)))
    count = length.copy()
    count[0] += gone
    many = np.where(sig >> 48 > 0, MANY, np.minimum(np.repeat(count, length), MANY))
    pick = np.flatnonzero(many > 1)
    return pa.record_batch([pa.array(sig[pick]), pa.array(one[pick]), pa.array(many[pick])], ["sig", "one", "many"])


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, one) sorted by both: (sig, one, many), a row per sig and value, for each sig with two values at least or with a lot.

    many is the number of the sig's values, MANY at most, and MANY where the sig has a lot. Of a sig up to MANY rows and a batch are held.
    """
    sig, one, gone = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in chain(batches, [None]):
        if batch is not None:
            sig, one = (np.concatenate((held, batch.column(i).to_numpy())) for i, held in enumerate((sig, one)))
        if not len(sig):
            continue
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (one[1:] != one[:-1])))
        sig, one = sig[new], one[new]
        last = int(np.searchsorted(sig, sig[-1]))  # where the signature begins that may go on in the next batch
        held = gone if last == 0 else 0
        done = len(sig) if batch is None else len(sig) - 1 if len(sig) - last + held > MANY else last
        if done:
            yield _counted(sig[:done], one[:done], gone)
        gone = held + max(0, done - last)
        sig, one = sig[done:], one[done:]


#: Bytes of a shingle hash that are compared: a pair of sets of 1000 is miscounted with a chance below 1e-8.
ITEM_BYTES = 6
#: Members of a star that one row of its centre serves.
STAR_ROWS = 100
#: Rows of a comparison: its centre, a member, a member whose differences from the centre are wanted.
CENTRE, PLAIN, DEEPER = 0, 1, 2
#: Members of a group that are paired directly, so a row meets half as many others on average at most; larger groups are split by
#: differences from a centre, on so many levels; what is larger still on the last one is paired all the same.
GROUP_ROWS, LEVELS = 4096, 4


def _wanted_sets(k: int, wanted):
    """The shingle hashes, shortened, of the rows whose id is wanted; other texts are not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # repeated rows within a task go once
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(wanted.value, batch.column("slot").to_numpy())))
            ids, out, size = batch.column("doc_id").to_numpy(), [], 0
            for i, s in _sets(batch, k):
                if not len(s):
                    continue
                one, two = _fingerprint(s)
                if (ids[i], one) not in seen:
                    seen.add((ids[i], one))
                    out.append((ids[i], one, two, s.view(np.uint8).reshape(-1, 8)[:, 8 - ITEM_BYTES :].tobytes()))
                    size += len(s)
                if size > 1 << 18:
                    yield _pack(out)
                    out, size = [], 0
            if out:
                yield _pack(out)
            if len(seen) > 200_000:
                seen.clear()

    return run


def _pack(rows: list) -> pa.RecordBatch:
    ids, one, two, items = zip(*rows)
    return pa.record_batch([pa.array(np.array(ids, np.int64)), signed(np.array(one, np.uint64)), signed(np.array(two, np.uint64)), pa.array(items, pa.binary())], ["least_id", "one", "two", "items"])


def _unpack(items: bytes) -> np.ndarray:
    wide = np.zeros((len(items) // ITEM_BYTES, 8), np.uint8)
    wide[:, 8 - ITEM_BYTES :] = np.frombuffer(items, np.uint8).reshape(-1, ITEM_BYTES)
    return wide.view(np.uint64).ravel()


def _compared(percent: int):
    """Of rows (x, part, member, rep, items) by x, part and member, centres first: (a, b) of the pairs similar enough, with role 0.

    For members of kind DEEPER also (sig, b, n, role) of their signatures relative to x. With d the difference from x and k the most
    that similar sets differ in, the member whose d is smaller has one of its first k / 2 + 1 elements (role 3) among the first k + 1 of
    the other (role 2 or 3): their differences share (d + d' - k) / 2 elements, one at least as x is dissimilar to either.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = items = None
        for batch in batches:
            out, size = [], 0
            rows = zip(batch.column("x").to_pylist(), batch.column("part").to_pylist(), batch.column("member").to_pylist(), batch.column("rep").to_pylist(), batch.column("items"))
            for x, part, member, rep, packed in rows:
                if member == CENTRE:
                    if centre != (x, part):
                        centre, items = (x, part), _unpack(packed.as_py())
                    continue
                if centre != (x, part):
                    continue
                own = _unpack(packed.as_py())
                known = items[np.minimum(np.searchsorted(items, own), len(items) - 1)] == own
                both = int(known.sum())
                if 100 * both >= percent * (len(items) + len(own) - both):
                    out.append((x, rep, np.zeros(1, np.int64), 0, np.zeros(1, np.int32)))
                if member == DEEPER:
                    lacks = items[own[np.minimum(np.searchsorted(own, items), len(own) - 1)] != items]
                    first = np.concatenate((own[~known], lacks))[: (100 - percent) * len(own) // percent + 1]
                    sigs = mix(first ^ mix(np.array([x], np.int64).view(np.uint64))) >> _CUT
                    out.append((x, rep, sigs.view(np.int64), len(own), np.where(np.arange(len(first)) <= (100 - percent) * len(own) // (2 * percent), 3, 2).astype(np.int32)))
                    size += len(first)
                if size > 200_000:
                    yield _met_rows(out)
                    out, size = [], 0
            if out:
                yield _met_rows(out)

    return run


def _met_rows(out: list) -> pa.RecordBatch:
    x, rep, sigs, n, roles = zip(*out)
    times = [len(s) for s in sigs]
    spread = lambda v: pa.array(np.repeat(np.array(v, np.int64), times))
    return pa.record_batch([spread(x), spread(rep), pa.array(np.concatenate(sigs)), spread(n), pa.array(np.concatenate(roles))], ["a", "b", "sig", "n", "role"])


def _near_enough(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in ("sketch_x", "sketch_rep"))
            total = batch.column("n_x").to_numpy() + batch.column("n_rep").to_numpy()
            keep = np.abs(x - y).sum(1) * (100 + percent) <= total * (100 - percent)
            yield batch.select(["x", "rep"]).filter(pa.array(keep))

    return run


def describe(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row the size, 128-bit fingerprint, bucket counts, parities and spare signatures of its shingle set."""
    return docs.select("doc_id", "text").mapInArrow(
        _describe(k, percent), "doc_id long, n long, one long, two long, sketch binary, parity array<long>, spare0 int, spare1 int"
    )


class _Verifier:
    """Exact links among candidate pairs (x, rep) of set names; many may have the same x."""

    def __init__(self, docs: DataFrame, sets: DataFrame, k: int, percent: int):
        self.docs, self.sets, self.k, self.percent = docs, sets, k, percent

    def met(self, pairs: DataFrame, centred: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The links (a, b) among both kinds of pairs, and groups (sig, rep, n, role) by differences from the centres of the second."""
        side = lambda c: self.sets.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        near = (
            pairs.join(side("x"), "x")
            .join(side("rep"), "rep")
            .where(F.least("n_x", "n_rep") * 100 >= F.greatest("n_x", "n_rep") * self.percent)
            .select("x", "rep", "n_x", "n_rep", "sketch_x", "sketch_rep")
            .mapInArrow(_near_enough(self.percent), "x long, rep long")
        )
        if centred is not None:
            near = near.select("x", "rep", F.lit(PLAIN).alias("member")).union(centred.select("x", "rep", F.lit(DEEPER)))
        else:
            near = near.withColumn("member", F.lit(PLAIN))
        near = saved(near, "near")
        parts = near.groupBy("x").agg((F.floor(F.count("*") / STAR_ROWS) + 1).alias("parts"))
        member = near.join(parts, "x").select("x", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), "member", "rep")
        roles = member.union(member.select("x", "part", F.lit(CENTRE), F.col("x")).distinct())
        roles = saved(roles.join(self.sets.select("rep", "least_id", "one", "two"), "rep"), "roles")
        wanted = bloom(roles.select(F.xxhash64("least_id").alias("slot")).distinct(), "slot", BLOOM_BITS)
        texts = self.docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("slot"))
        items = texts.mapInArrow(_wanted_sets(self.k, wanted), "least_id long, one long, two long, items binary")
        rows = items.join(roles, ["least_id", "one", "two"]).select("x", "part", "member", "rep", "items")
        # A part has about STAR_ROWS members, however many its centre has.
        rows = rows.repartition("x", "part").sortWithinPartitions("x", "part", "member")
        found = saved(rows.mapInArrow(_compared(self.percent), "a long, b long, sig long, n long, role int"), "met")
        wanted.unpersist()
        discard(near, roles)
        return found.where("role = 0").select("a", "b"), found.where("role > 0").select("sig", F.col("b").alias("rep"), "n", "role")


def _rarer(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(sig, rep, n) of shared signatures, less each set's most frequent ones as far as it can spare them.

    The order by `many`, then sig, is the same for all sets; those that no other set has come last in it. The join and the window are
    both by name: one shuffle.
    """
    one = F.col("one")
    named = sets.select(one.bitwiseAND(F.lit(-2)).alias("name"), "rep", "n", "spare0", "spare1")
    rows = shared.select(F.col("sig").bitwiseAND(F.lit(_SIGNATURE)).alias("sig"), one.bitwiseAND(F.lit(-2)).alias("name"), one.bitwiseAND(F.lit(1)).alias("role"), "many").join(named, "name")
    place = F.row_number().over(Window.partitionBy("name", "role").orderBy(F.desc("many"), "sig"))
    spare = F.when(F.col("role") == 0, F.col("spare0")).otherwise(F.col("spare1"))
    return saved(rows.withColumn("place", place).where(F.col("place") > spare).select("sig", "rep", "n", F.lit(3).alias("role")), "groups")


def _by_component(groups: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return groups.withColumn("component", F.col("rep"))
    return groups.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _star(groups: DataFrame) -> DataFrame:
    """For each set the least set of another component that it shares most groups with."""
    least = groups.groupBy("sig").agg(F.min(F.struct("component", "rep")).alias("least"))
    pairs = groups.join(least, "sig").where("component <> least.component").select(F.col("least.rep").alias("x"), "rep")
    counted = pairs.groupBy("rep", "x").agg(F.count("*").alias("n"))
    best = counted.groupBy("rep").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("x"))
    return best.select("x", "rep")


def _split(by: DataFrame, level: int) -> DataFrame:
    """(sig, large, centre) of the groups that hold several components; large where its pairs are many for its members."""
    has = lambda bit: F.sum(F.col("role").bitwiseAND(F.lit(bit)) / bit)
    kinds = by.groupBy("sig").agg(
        F.min("component").alias("p"), F.max("component").alias("q"), has(1).alias("probes"), has(2).alias("others"), F.min(F.struct(F.xxhash64(F.lit(level), "rep").alias("h"), "rep")).alias("least")
    )
    large = (F.lit(level) < LEVELS) & (2 * F.col("probes") * F.col("others") > GROUP_ROWS * (F.col("probes") + F.col("others")))
    return saved(kinds.where("p <> q and probes > 0 and others > 0").select("sig", large.alias("large"), F.col("least.rep").alias("centre")), "kinds")


def _across(by: DataFrame, kinds: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs within the groups that are not large, of different components, of sizes and parities that may be similar."""
    rows = by.join(kinds.where("not large").select("sig"), "sig", "left_semi").join(sets.select("rep", "parity"), "rep")
    x, y = (rows.select("sig", *(F.col(c).alias(f"{c}_{r}") for c in ("rep", "component", "n", "parity", "role"))) for r in "ab")
    bit = lambda c, b: F.col(c).bitwiseAND(F.lit(b)) > 0
    once = (F.col("rep_a") < F.col("rep_b")) | ((F.col("rep_a") > F.col("rep_b")) & ~(bit("role_b", 1) & bit("role_a", 2)))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    apart = sum((F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    near = apart * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    pairs = x.where(bit("role_a", 1)).join(y.where(bit("role_b", 2)), "sig").where(once & (F.col("component_a") != F.col("component_b")) & fits & near)
    return pairs.select(F.least("rep_a", "rep_b").alias("x"), F.greatest("rep_a", "rep_b").alias("rep")).distinct()


def _centred(by: DataFrame, kinds: DataFrame) -> DataFrame:
    """(centre x, rep) of the members of large groups."""
    large = kinds.where("large").select("sig", F.col("centre").alias("x"))
    return by.select("sig", "rep").join(large, "sig").where("x <> rep").select("x", "rep").distinct()


def shingle_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs (doc_id long, text string, other columns ignored).

    A row's set: the distinct k-word shingles of its text, words being `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased;
    fewer words are one shingle. Two rows link if 100 * |intersection| >= percent * |union|; component_id is the
    smallest doc_id that links reach. Null, empty or wordless text: n_shingles 0, component_id its own doc_id.
    Repeated rows stay, one result row each. A row without doc_id names no component: it gets that of its set
    if a row with doc_id has the same set, else null, and gives no links. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    rows = saved(describe(docs, k, percent), "sets")
    sets = rows.where("n > 0 and doc_id is not null").groupBy("one", "two", "n").agg(F.min("doc_id").alias("least_id"), *(F.first(c).alias(c) for c in ("sketch", "parity", "spare0", "spare1")))
    # A set is named by its least doc_id; where repeated ids would name two sets alike, the others get a hash.
    nth = F.row_number().over(Window.partitionBy("least_id").orderBy("one", "two"))
    sets = saved(sets.withColumn("rep", F.when(nth == 1, F.col("least_id")).otherwise(F.xxhash64("one", "two"))), "named")
    named = docs.where("doc_id is not null")
    hot = _hot(named, k, percent)
    signed_rows = named.select("text").mapInArrow(_sign(k, percent, hot), "sig long, one long")
    shared = signed_rows.repartition("sig").sortWithinPartitions("sig", "one").mapInArrow(shared_rows, "sig long, one long, many long")
    groups = _rarer(shared, sets)
    hot.unpersist()
    release(docs.sparkSession)

    verify = _Verifier(docs, sets, k, percent)
    links, _ = verify.met(_star(_by_component(groups, None)))
    found = saved(components(links), "components")
    for level in range(LEVELS + 1):
        by = _by_component(groups, found)
        kinds = _split(by, level)
        last = kinds.where("large").isEmpty()
        new, finer = verify.met(_across(by, kinds, sets, percent), None if last else _centred(by, kinds))
        if not last or not new.isEmpty():
            links = links.union(new)
            found = saved(components(links), "components")
        discard(kinds)
        release(docs.sparkSession)
        if last:
            break
        groups = finer
    linked = found.join(sets.select(F.col("rep").alias("node"), "least_id"), "node")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    out = (
        rows.join(sets.select("one", "two", "n", "rep", "least_id"), ["one", "two", "n"], "left")
        .join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(least, "component", "left")
    )
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "least_id", alone).alias("component_id"))
