"""Near-duplicate records, by pigeonhole blocks of fingerprints and Hamming verification.

A record is the set of its shingles (runs of successive words). Its fingerprint is a
vector of minhash symbols, cut into blocks of ``rows`` symbols: records whose fingerprints
differ in fewer positions than there are blocks share a block, and at similarity s each
block is shared with probability s ** rows. Records are joined on blocks, pairs are
verified by the Hamming distance of their fingerprints with one bit kept of each symbol, and
the pairs left by their exact similarity.

Equal shingle sets are one class before blocks are joined, so groups of copies cost one
member. A block held by many classes, and a class of many records, is not enumerated in one
task but cut into fragments. Texts are never shuffled: the scan that needs them again knows
the records in checked pairs by a Bloom filter of fixed size and sends on their shingle hashes.

Defined results: a null title counts as nothing; rows without an id, with a null or empty body,
or with fewer words than a shingle, are similar to nothing. Ties at the threshold are pairs. A
repeated id with other words is another record; pairs of a record with itself do not count.
Ids may be of any type that can be ordered. The exact similarity compares 32-bit hashes of the
shingles: with one chance in 100,000 a pair's similarity is off by one shingle. A class is told
by 64 bits: among 10 billion different sets about 3 pairs are taken for equal. Only the named
columns are read.

``groups`` is the bounded form of the result (one row a record); ``linked_pairs`` has a row
for every pair, n (n - 1) / 2 for n records that are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.runtime import broadcast_if_small, expand_pairs, stage, unstage

#: Members of a block that one task pairs at once; larger blocks are cut into fragments.
BLOCK_MEMBERS = 64
#: Blocks of sets that a bucket should get, and that a task holds at most (16 bytes each).
BUCKET_PAIRS, HELD_PAIRS = 500_000, 8_000_000
#: Records of a class that meet in one task when its pairs are listed.
CLASS_MEMBERS = 2_048
#: Bits of the Bloom filter, at most; with more records than a twelfth of it, more shingles travel than needed.
FILTER_BITS = 1 << 28


@dataclass
class NearDuplicates:
    """``members``: (id, set_id, k1, k2); ``links``: (a, b, similarity) between different shingle sets, a < b."""

    members: DataFrame
    links: DataFrame


class _WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf_8"))
        return h


def shingler(words: int):
    """A function from arrays of titles and bodies to their shingle sets: (values, starts, rows).

    Set i holds the distinct 64-bit hashes of the runs of ``words`` words of row ``rows[i]``, sorted,
    from ``values[starts[i]]`` on; rows with fewer words have no set. Whole batches are taken apart at once.
    """
    known = _WordHashes()

    def run(titles: pa.Array, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text = pc.binary_join_element_wise(pc.fill_null(titles, ""), pc.fill_null(bodies, ""), " ")
        split = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(text), r"[^\p{L}\p{N}]+", " "), " ")
        found = split.flatten().dictionary_encode()
        hashes = np.array([known[w] for w in found.dictionary.to_pylist()], dtype=np.uint64)
        empty = np.array([w == "" for w in found.dictionary.to_pylist()], dtype=bool)
        codes = found.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
        full = ~empty[codes] if len(codes) else np.empty(0, dtype=bool)
        h, row = hashes[codes[full]], row[full]
        n = max(len(h) - words + 1, 0)
        s = h[:n].copy()
        with np.errstate(over="ignore"):
            for k in range(1, words):
                s = (s ^ (s >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + h[k : k + n]
            s ^= s >> np.uint64(28)
        inside = row[:n] == row[words - 1 : words - 1 + n]  # the run does not go on into the next row
        s, row = s[inside], row[:n][inside]
        if not len(s):
            return s, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        edge = np.flatnonzero(np.diff(row, prepend=-1))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(s)]):
            s[lo:hi].sort()
        first = np.zeros(len(s), dtype=bool)
        first[edge] = True
        keep = first | (np.diff(s, prepend=s[:1]) != 0)
        return s[keep], np.flatnonzero(first[keep]), row[edge]

    return run


def set_numbers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit number of each set of shingles; set i begins at ``starts[i]``."""
    with np.errstate(over="ignore"):
        mixed = values ^ (values >> np.uint64(29))
        return np.add.reduceat((mixed * np.uint64(0xBF58476D1CE4E5B9)) ^ (mixed >> np.uint64(32)), starts)


def bits_of(h: np.ndarray, size: int) -> np.ndarray:
    """Four positions of each hash in a filter of ``size`` bits, a power of two."""
    u = h.view(np.uint64)
    with np.errstate(over="ignore"):
        return np.stack([(u + np.uint64(j) * ((u >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1) for j in range(4)]).astype(np.int64)


def bloom_filter(ids: DataFrame, h: str, n: int) -> np.ndarray:
    """Filter of the ``n`` hashes of a column, built in chunks of 65,536 bits by the executors; at most FILTER_BITS come to the driver."""
    size = min(FILTER_BITS, 1 << max(16, (12 * n).bit_length()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(bits_of(batch.column(0).to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32))], names=["chunk", "at"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        chunk = np.zeros(1 << 16, dtype=np.uint8)
        chunk[table.column("at").to_numpy()] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], type=pa.int32()), "bits": pa.array([np.packbits(chunk).tobytes()])})

    rows = ids.select(h).mapInArrow(spread, "chunk int, at int").groupBy("chunk").applyInArrow(gather, "chunk int, bits binary")
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():
        out[r["chunk"] * 8192 : (r["chunk"] + 1) * 8192] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def may_contain(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = bits_of(h, len(bits) * 8)
    return (bits[at >> 3] & (np.uint8(128) >> (at & 7).astype(np.uint8)) != 0).all(axis=0)


def fingerprint(words: int, blocks: int, rows: int, seed: int, buckets: int):
    """Arrow batches (id, k1, k2, t, b) to rows (bucket, payload, set_id, member, id) for the join on blocks.

    A payload holds all (block, set) of a batch that fall into a bucket, as pairs of 64-bit numbers:
    a row of its own for each would cost the shuffle more than what is in it. One row a record carries (k1, k2, n, one bit a symbol) as 64-bit numbers in ``member`` and its id,
    so that the blocks need the texts only once.
    """
    rng = np.random.default_rng(seed)
    symbols = blocks * rows
    width = 3 + -(-symbols // 64)
    mult = rng.integers(0, 2**31, symbols, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    plus = rng.integers(0, 2**32, len(mult), dtype=np.uint64).astype(np.uint32)
    mixes = rng.integers(0, 2**63, 17, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weight = (np.uint64(1) << np.arange(64, dtype=np.uint64))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        runs = shingler(words)
        for batch in batches:
            values, starts, rows_with = runs(batch.column("t"), batch.column("b"))
            batch = batch.take(pa.array(rows_with))
            if not (count := batch.num_rows):
                continue
            sizes = np.diff(starts, append=len(values))
            set_id = set_numbers(values, starts)
            with np.errstate(over="ignore"):
                mixed = values ^ (values >> np.uint64(29))
                # symbols are linear in one of many mixes of a shingle: linear in the same one, they would not be independent
                xs = [((mixed ^ (mixed >> np.uint64(17 + j % 13))) * m >> np.uint64(32)).astype(np.uint32) for j, m in enumerate(mixes)]
                sig = np.empty((len(mult), count), dtype=np.uint32)
                for lo in range(0, count, 256):  # records at a time, so that the numbers stay in the processor's cache
                    hi = min(lo + 256, count)
                    own, at = [x[starts[lo] : starts[hi - 1] + sizes[hi - 1]] for x in xs], starts[lo:hi] - starts[lo]
                    line = np.empty(len(own[0]), dtype=np.uint32)  # one buffer: fresh ones would be new pages each time
                    for k in range(len(mult)):
                        np.multiply(own[k % len(own)], mult[k], out=line)
                        np.add(line, plus[k], out=line)
                        np.minimum.reduceat(line, at, out=sig[k, lo:hi])
                bit = ((sig * np.uint32(0x85EBCA6B)) >> np.uint32(31)).astype(np.uint64)
                member = np.empty((count, width), dtype=np.int64)
                for i, c in enumerate(("k1", "k2")):
                    member[:, i] = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                member[:, 2] = sizes
                for i in range(3, width):
                    own = bit[64 * (i - 3) : 64 * (i - 2)]
                    member[:, i] = (own * weight[: len(own)]).sum(0, dtype=np.uint64).view(np.int64)
                new = np.array([i for i, v in enumerate(set_id.tolist()) if not (v in seen or seen.add(v))], dtype=np.int64)
                if len(seen) > 500_000:
                    seen.clear()  # it only saves work: equal sets are told apart by their number anyway
                block = np.empty((len(new), blocks), dtype=np.uint64)
                for b in range(blocks):
                    h = np.full(len(new), (b + 1) * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
                    for r in range(rows):
                        h = (h ^ sig[b * rows + r, new]) * np.uint64(0xFF51AFD7ED558CCD)
                        h ^= h >> np.uint64(32)
                    block[:, b] = h
                spread = ((set_id * np.uint64(0x9E3779B97F4A7C15) + np.arange(count, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)
            pairs = np.stack([block.reshape(-1), np.repeat(set_id[new], blocks)], axis=1)
            home = (pairs[:, 0] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            edge = np.flatnonzero(np.diff(home[order], prepend=-1))
            ends = pa.py_buffer((np.append(edge, len(order)) * 16).astype(np.int32).tobytes())
            payload = pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, ends, pa.py_buffer(pairs[order].tobytes())])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * width), count, [None, pa.py_buffer(member.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([home[order][edge], spread])),
                    pa.concat_arrays([payload, pa.nulls(count, pa.binary())]),
                    pa.concat_arrays([pa.nulls(len(edge), pa.int64()), pa.array(set_id.view(np.int64))]),
                    pa.concat_arrays([pa.nulls(len(edge), pa.binary()), packed]),
                    pa.concat_arrays([pa.nulls(len(edge), batch.column("id").type), batch.column("id")]),
                ],
                names=["bucket", "payload", "set_id", "member", "id"],
            )

    return run


def paired_schema(symbols: int, id_type: str) -> str:
    """Columns of :func:`block_pairs`; s0, s1, ... hold the bits of the fingerprint."""
    return ", ".join([*(f"{c} long" for c in ("block", "a", "b", "k1", "k2", "n")), *(f"s{i} long" for i in range(-(-symbols // 64))), f"id {id_type}"])


def block_pairs(symbols: int):
    """A function from batches of :func:`fingerprint`, sorted by bucket, to batches of :func:`paired_schema`."""
    names = [c.split()[0] for c in paired_schema(symbols, "").split(", ")]
    return lambda batches: _block_pairs(batches, names)


def _block_pairs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs (null, a, b) within blocks of up to BLOCK_MEMBERS sets.

    Sets of larger blocks go on as (block, a, null), members as (null, set_id, null, ...). One
    bucket is held at a time; if one grows beyond HELD_PAIRS, all of its sets go on in that way.
    """
    width = len(names) - 4
    seen: set = set()

    def batch_of(k, a, b, extra=None, ids=None) -> pa.RecordBatch:
        cols = [pa.array(v, type=pa.int64()) for v in (k, a, b)]
        cols += [pa.nulls(len(k), pa.int64()) if extra is None else pa.array(np.ascontiguousarray(extra[:, i])) for i in range(width)]
        return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(k), id_type) if ids is None else ids], names=names)

    def open_rows(pairs: np.ndarray) -> pa.RecordBatch:
        return batch_of(pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()))

    def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate(held)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.flatnonzero(np.diff(pairs[:, 0], prepend=pairs[:1, 0] + 1))
        size = np.diff(new, append=len(pairs))
        a: list = []
        b: list = []
        for lo, n in zip(new[size > 1].tolist(), size[size > 1].tolist()):
            sets = list(dict.fromkeys(pairs[lo : lo + n, 1].tolist()))
            if len(sets) > BLOCK_MEMBERS:
                yield open_rows(np.stack([np.full(len(sets), pairs[lo, 0]), np.array(sets, dtype=np.int64)], axis=1))
                continue
            for i, x in enumerate(sets):
                for y in sets[i + 1 :]:
                    if (x, y) not in seen:
                        seen.add((x, y))
                        a.append(x), b.append(y)
        yield batch_of(pa.nulls(len(a), pa.int64()), a, b)
        if len(seen) > 500_000:
            seen.clear()

    bucket, held, amount, beyond, id_type = None, [], 0, False, None
    for batch in batches:
        id_type = batch.column("id").type
        is_member = batch.column("payload").is_null()
        if len(own := batch.filter(is_member)):
            extra = np.frombuffer(b"".join(own.column("member").to_pylist()), dtype=np.int64).reshape(-1, width)
            yield batch_of(pa.nulls(len(own), pa.int64()), own.column("set_id"), pa.nulls(len(own), pa.int64()), extra, own.column("id"))
        rest = batch.filter(pc.invert(is_member))
        for home, payload in zip(rest.column("bucket").to_pylist(), rest.column("payload").to_pylist()):
            if home != bucket:
                if held:
                    yield from close(held)
                bucket, held, amount, beyond = home, [], 0, False
            pairs = np.frombuffer(payload, dtype=np.int64).reshape(-1, 2)
            if not beyond:
                held.append(pairs)
                amount += len(pairs)
                if amount <= HELD_PAIRS:
                    continue
                pairs, held, beyond = np.concatenate(held), [], True
            yield open_rows(pairs)
    if held:
        yield from close(held)


def near_duplicates(df: DataFrame, id_col: str, title_col: str, body_col: str, copy_key: Column | None = None, words: int = 5, threshold: tuple[int, int] = (4, 5), blocks: int = 32, rows: int = 4, seed: int = 1) -> NearDuplicates:
    """Link records whose shingle sets have at least ``threshold`` (a fraction) of their union in common.

    ``copy_key``: a struct of two longs that tells exact copies, carried to ``members``;
    without it, no record is a copy of another.
    The chance to miss a pair at similarity s is (1 - s ** rows) ** blocks.
    """
    num, den = threshold
    key = F.struct(F.xxhash64(id_col).alias("k1"), F.xxhash64(F.lit(17), id_col).alias("k2")) if copy_key is None else copy_key
    base = df.select(F.col(id_col).alias("id"), key.alias("key"), F.col(title_col).alias("t"), F.col(body_col).alias("b")).where(F.col("id").isNotNull() & (F.length("b") > 0))
    kind = dict(base.dtypes)["id"]
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(2**30, max(conf, -(-df.count() * blocks // BUCKET_PAIRS)))
    marks = base.select("id", "key.k1", "key.k2", "t", "b").mapInArrow(fingerprint(words, blocks, rows, seed, buckets), f"bucket int, payload binary, set_id long, member binary, id {kind}")
    tasks = min(buckets, 50_000)
    both = stage(marks.repartitionById(tasks, F.col("bucket")).sortWithinPartitions("bucket").mapInArrow(block_pairs(blocks * rows), paired_schema(blocks * rows, kind)), "near-pairs", free=True)
    bits = [c for c in both.columns if c[0] == "s"]
    members = both.where("id is not null").select("id", F.col("a").alias("set_id"), "k1", "k2", "n", *bits)
    small = both.where("b is not null").select("a", "b")
    large = expand_pairs(both.where("block is not null").select("block", "a"), "block", "a").select("a", "b")

    # at similarity s two fingerprints differ in (1 - s) / 2 of their bits, less the shared block; leave 3.5 standard deviations
    share = (1 - num / den) / 2
    most = int(blocks * rows * share + 3.5 * (blocks * rows * share * (1 - share)) ** 0.5)
    one = members.groupBy("set_id").agg(F.min(F.struct("id", "n", *bits)).alias("m")).select("set_id", "m.*")
    x = one.select(F.col("set_id").alias("a"), F.col("id").alias("ida"), F.col("n").alias("na"), *[F.col(c).alias(f"a{c}") for c in bits])
    y = one.select(F.col("set_id").alias("b"), F.col("id").alias("idb"), F.col("n").alias("nb"), *[F.col(c).alias(f"b{c}") for c in bits])
    near = reduce(add, (F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in bits)) <= most
    fits = near & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    checked = small.unionByName(large).distinct().join(x, "a").join(y, "b").where(fits)
    checked = stage(checked.select("a", "b", "ida", "idb", "na", "nb"), "near-checked", free=True)

    # the exact similarity, from the shingles of one record of each set in a checked pair
    wanted = stage(checked.select(F.explode(F.array(F.xxhash64("ida"), F.xxhash64("idb"))).alias("h")).distinct(), "near-wanted")
    shared = df.sparkSession.sparkContext.broadcast(bloom_filter(wanted, "h", wanted.count()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shingler(words)
        for batch in batches:
            batch = batch.filter(pa.array(may_contain(shared.value, batch.column("h").to_numpy())))
            if batch.num_rows:
                values, starts, rows_with = runs(batch.column("t"), batch.column("b"))
            if batch.num_rows and len(rows_with):
                offsets = pa.array(np.append(starts, len(values)).astype(np.int32))
                hashes = pa.ListArray.from_arrays(offsets, pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows_with)), pa.array(set_numbers(values, starts).view(np.int64)), hashes], names=["id", "set_id", "s"])

    sets = base.select("id", F.xxhash64("id").alias("h"), "t", "b").mapInArrow(again, f"id {kind}, set_id long, s array<int>")
    sets = stage(sets, "near-sets")
    full = checked.join(sets.select(F.col("set_id").alias("a"), F.col("id").alias("ida"), F.col("s").alias("sa")), ["a", "ida"])
    full = full.join(sets.select(F.col("set_id").alias("b"), F.col("id").alias("idb"), F.col("s").alias("sb")), ["b", "idb"])
    full = full.withColumn("c", F.size(F.array_intersect("sa", "sb")))
    links = full.where(F.col("c") * den >= (F.col("na") + F.col("nb") - F.col("c")) * num)
    links = links.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity")).distinct()
    links = stage(links, "near-links", free=True)
    for done in (checked, wanted, sets):
        unstage(done)
    return NearDuplicates(members.select("id", "set_id", "k1", "k2"), links)


def linked_pairs(found: NearDuplicates) -> DataFrame:
    """(a, b) of all pairs of records that are linked, a < b, without exact copies of one another.

    A class of many records is cut into parts by the hash of the id; a pair of classes is
    listed part by part.
    """
    number = F.xxhash64("set_id", "k1", "k2").alias("class")
    parts = F.ceil(F.count("*") / CLASS_MEMBERS).cast("int").alias("parts")
    classes = stage(found.members.groupBy("set_id", "k1", "k2").agg(parts).select("set_id", "k1", "k2", number, "parts"), "near-classes")
    x = classes.select(F.col("set_id").alias("a"), F.col("k1").alias("xa"), F.col("k2").alias("ya"), F.struct("class", "parts").alias("ca"))
    y = classes.select(F.col("set_id").alias("b"), F.col("k1").alias("xb"), F.col("k2").alias("yb"), F.struct("class", "parts").alias("cb"))
    across = found.links.join(x, "a").join(y, "b").where("xa != xb or ya != yb").select("ca", "cb")
    within = expand_pairs(classes.select("set_id", F.struct("class", "parts").alias("c")), "set_id", "c").select(F.col("a").alias("ca"), F.col("b").alias("cb"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(f"{c}.parts") - 1))
    pairs = across.unionByName(within).select("ca", "cb", each("ca").alias("pa")).select(F.col("ca.class").alias("ca"), "pa", "cb", each("cb").alias("pb")).select("ca", "pa", F.col("cb.class").alias("cb"), "pb")

    hot = classes.where("parts > 1").select("class", "parts")  # at most a row for each CLASS_MEMBERS records
    rows = found.members.select("id", number).join(broadcast_if_small(hot), "class", "left")
    rows = rows.select("id", "class", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    one = rows.select(F.col("class").alias("ca"), F.col("part").alias("pa"), F.col("id").alias("ia"))
    two = rows.select(F.col("class").alias("cb"), F.col("part").alias("pb"), F.col("id").alias("ib"))
    pairs = pairs.join(one, ["ca", "pa"]).join(two, ["cb", "pb"])
    return pairs.where("ia != ib").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def groups(found: NearDuplicates) -> DataFrame:
    """(id, group_id, links): the connected component of each linked record and its number of linked shingle sets.

    Components by hash-to-min rounds over the links, each round written to the shared
    folder; copies of one shingle set are one node, and records without a link have none.
    """
    both = stage(found.links.select("a", "b").unionByName(found.links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near-both")
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    label = last = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")), "near-labels")
    while True:
        least = both.join(label.select(F.col("a").alias("b"), F.col("c").alias("d")), "b").groupBy("a").agg(F.min("d").alias("d"))
        new = label.join(least, "a").select("a", F.least("c", "d").alias("c"), F.col("c").alias("was"))
        # the label of the label halves the distance to the least node
        new = new.join(label.select(F.col("a").alias("c"), F.col("c").alias("up")), "c", "left").select("a", F.least("c", F.coalesce("up", "c")).alias("c"), "was")
        new = stage(new, "near-labels")
        unstage(last)
        last, label = new, new.select("a", "c")
        if new.where("c != was").isEmpty():
            break
    sets = label.join(degree, "a").select(F.col("a").alias("set_id"), F.col("c").alias("group_id"), "links")
    copies = found.members.groupBy("set_id").agg(F.count("*").alias("m"))
    alone = copies.where("m > 1").join(sets, "set_id", "left_anti").select("set_id", F.col("set_id").alias("group_id"), F.lit(0).cast("long").alias("links"))
    return found.members.select("id", "set_id").join(sets.unionByName(alone), "set_id").select("id", "group_id", "links")
