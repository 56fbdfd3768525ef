"""Set-similarity join of word shingles by PartEnum signatures."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, components, map_batches, pieces, table

#: A set leaves out projections of fewer elements, as far as spare parts allow: they agree by chance.
LEAST = 2
#: Shapes that are tried: differences allowed within a first-level part, second-level parts beyond these, and spare parts.
DIFFER, SECOND, SPARE = (1, 2, 3), (2, 3), (0.0, 0.06, 0.125, 0.25, 0.5)
#: What a projection without elements costs, in others, and what one of a single element costs.
WEAK = (60, 6)
#: Bits, at least, of the sketch that bounds how much two sets differ; larger sets have about as many as elements.
BITS = 1024
#: Sets of one signature that are compared in all pairs, and those that a block of a common signature aims at.
FEW, BLOCK = 8, 2048
#: Growth of set sizes from one size code to the next.
STEP = 1.05
#: Signatures (of 16 bytes, sorted in memory) that one range aims at, and ranges for each shuffle partition at least.
RANGE_ROWS, RANGES_PER_PARTITION = 500_000, 8
#: Signatures that a task holds before it sends them on, in ranges, and rows that it sends at once.
HELD, ROWS = 1 << 18, 1 << 14
_U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z in lower case, cut at space and the characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words; of all words where there are fewer; empty without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Bands:
    """Size bands of PartEnum for a Jaccard similarity of at least percent / 100.

    Band i holds the sizes low..high with high = low / similarity; two sets that are similar enough are of the same
    band or of neighbours. Instance i takes the sets of bands i and i + 1, which differ there in at most
    bound = high * (1 - similarity) / similarity elements.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.high, self.shapes = [1], [max(1, 100 // percent)], {}
        #: Size codes of similar sets differ by this at most.
        self.codes = math.ceil(math.log(100 / percent) / math.log(STEP))

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            self.low.append(self.high[-1] + 1)
            self.high.append(max(self.low[-1], self.low[-1] * 100 // self.percent))
        return int(np.searchsorted(self.high, size))

    def bound(self, band: int) -> int:
        return self.high[band] * (100 - self.percent) // self.percent

    def shape(self, band: int) -> Shape:
        """How an instance deals its domain: of all shapes within the bound, the one that costs least for sets of its middle size."""
        if band not in self.shapes:
            k, size = self.bound(band), 0.9 * self.high[band]
            found = []
            for differ in DIFFER:
                for extra in SECOND:
                    for spare in {int(x * (k // (differ + 1) + 1)) for x in SPARE}:
                        shape = Shape(k // (differ + 1) + 1 + spare, spare, differ + extra, differ)
                        mean = size * extra / (shape.parts * shape.second)
                        each, cost = len(shape.subsets), 0.0
                        for c in range(1, LEAST + 1):
                            weak = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(c))
                            # Parts with a projection of under c elements, beyond those that can be left out.
                            hit = shape.parts * min(1.0, each * weak)
                            cost += WEAK[c - 1] * each * max(0.0, hit + 1.5 * math.sqrt(hit) - spare)
                        found.append((shape.parts * each + cost, shape.parts * each, differ, extra, shape))
            self.shapes[band] = min(found, key=lambda x: x[:4])[4]
        return self.shapes[band]


class Shape:
    """First-level parts, spare ones among them, second-level parts of each, and how many of these may differ."""

    def __init__(self, parts: int, spare: int, second: int, differ: int):
        self.parts, self.spare, self.second, self.differ = parts, spare, second, differ
        #: The second-level parts of each projection: all but `differ`.
        self.subsets = np.array(list(itertools.combinations(range(second), second - differ)))


def signatures(elements: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures; any two different sets that are similar enough have one in common.

    In an instance with a bound of k, two sets differ in at most k elements. The feature domain is dealt by hash into
    first-level parts, and each of these into second-level parts. At most k // (differ + 1) first-level parts have over
    `differ` differences, so of k // (differ + 1) + 1 + spare parts, more than `spare` have no more. In such a part at most
    `differ` second-level parts differ, so some subset of all but `differ` of them is equal in both sets. All these
    subsets are enumerated; a signature is the hash of a set's projection onto one.

    A set leaves out its projections of under c elements, for the largest c up to LEAST for which at most `spare` parts have
    such projections. Of two similar sets let the first have the larger c: some part with an equal projection isn't
    among those parts of it, so that projection has c elements or more, and the second set keeps it too.

    Where k is 0 only equal sets are similar, which need no signature.
    """
    out = []
    band = bands.of(len(elements))
    for instance in (band, band - 1):
        if instance < 0 or not bands.bound(instance):
            continue
        shape = bands.shape(instance)
        seed = _U((instance + 1) * 0xD6E8FEB86659FD93 % 2**64)
        cells = shape.parts * shape.second
        cell = (mix(elements ^ seed) % _U(cells)).astype(np.int64)
        held = np.zeros(cells, np.uint64)
        np.add.at(held, cell, mix(elements + seed))
        project = lambda x: x.reshape(shape.parts, shape.second)[:, shape.subsets].sum(axis=2, dtype=x.dtype)  # noqa: B023, E731
        hashes, counts = project(held), project(np.bincount(cell, minlength=cells))
        hashes = mix(hashes ^ mix(np.arange(hashes.size, dtype=np.uint64).reshape(hashes.shape) + seed))
        weakest = counts.min(axis=1)
        least = next(c for c in range(LEAST, -1, -1) if (weakest < c).sum() <= shape.spare)
        out.append(hashes[counts >= least])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def size_code(size: int) -> int:
    return min(255, int(math.log(size) / math.log(STEP) + 1e-9))


#: A set's name in tables: its size code and 88 bits of a hash, so that 10^10 sets of one size code have none in common
#: but for one chance in some millions.
NAME = np.dtype([("head", "<u8"), ("tail", "<u4")])


def name_of(elements: np.ndarray) -> tuple[int, int]:
    """A set's name: its size code with 56 bits of a hash, and 32 bits more. Equal sets have equal names."""
    digest = hashlib.blake2b(elements.tobytes(), digest_size=11).digest()
    return size_code(len(elements)) << 56 | int.from_bytes(digest[:7], "little"), int.from_bytes(digest[7:], "little")


def packed(names: np.ndarray) -> pa.Array:
    """Names (n, 2) as bytes."""
    raw = np.empty(len(names), NAME)
    raw["head"], raw["tail"] = names[:, 0], names[:, 1]
    return pa.Array.from_buffers(pa.binary(NAME.itemsize), len(names), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def sketch(elements: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in buckets, a power of two of them, at least BITS, in words of 64 bits.

    Two sets differ in at least as many elements as their sketches in bits. Halves laid over each other, by exclusive
    or, are the sketch of half as many buckets.
    """
    bits = max(BITS, 1 << math.ceil(math.log2(len(elements) / 1.4))) if len(elements) else BITS
    odd = np.bincount((elements >> _U(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def may_be_similar(percent: int, a: str, b: str) -> Column:
    """Whether sets with columns a_bits, a_size, b_bits and b_size can be similar, by sizes and sketches.

    Similar sets have (100 + percent) * difference <= (100 - percent) * sum of sizes.
    """
    words = BITS // 64
    p, q = F.col(f"{a}_bits"), F.col(f"{b}_bits")
    least = F.least(F.size(p), F.size(q))
    folded = lambda v: F.when(F.size(v) > least, F.zip_with(F.slice(v, F.lit(1), least), F.slice(v, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(v)
    long = F.aggregate(F.zip_with(folded(p), folded(q), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    short = sum((F.bit_count(p[i].bitwiseXOR(q[i])) for i in range(words)), F.lit(0))
    apart = F.when((F.size(p) == words) & (F.size(q) == words), short).otherwise(long)
    x, y = F.col(f"{a}_size"), F.col(f"{b}_size")
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * apart <= (100 - percent) * (x + y))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Met:
    """Sets that share signatures: rows (sig, name), each once, in order of signature and size.

    Sets of one size stand in an order of the signature alone, so the members of a large group meet new neighbours in
    each signature that they share, and links soon join the group.
    """

    def __init__(self, sig: np.ndarray, name: np.ndarray, codes: int):
        order = np.lexsort((name[:, 1], name[:, 0], mix(name[:, 1] ^ sig), name[:, 0] >> _U(56), sig))
        sig, name = sig[order], name[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]).any(axis=1))[: len(sig)]
        self.sig, self.name, self.codes = sig[new], name[new], codes
        self.code = (self.name[:, 0] >> _U(56)).astype(np.int64)
        first = np.append(True, self.sig[1:] != self.sig[:-1])[: len(self.sig)]
        start = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        self.many = np.diff(np.append(start, len(first)))[group] > FEW
        #: Place of a row in its signature, and whether it begins a size code there.
        self.place = np.arange(len(first)) - start[group] if len(first) else group
        self.begins = first | (np.diff(self.code, prepend=-1) != 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows to compare: all pairs in signatures of at most FEW sets, neighbours in the others. Sizes too far apart to be similar are left out."""
        left, right = [], []
        for d in range(1, FEW):
            i = np.arange(len(self.sig) - d)
            good = (self.place[i + d] >= d) & (self.code[i + d] - self.code[i] <= self.codes) & ((d == 1) | ~self.many[i])
            left.append(i[good])
            right.append(i[good] + d)
        return np.concatenate(left), np.concatenate(right)


NAMES = ["kind", "part", "id", "a", "b", "sig", "size", "bits", "data"]
TYPES = {"id": pa.int64(), "a": pa.binary(), "b": pa.binary(), "sig": pa.int64(), "size": pa.int64(), "bits": pa.list_(pa.int64()), "data": pa.binary()}
SCANNED = "kind int, part int, id long, a binary, b binary, sig long, size long, bits array<long>, data binary"


def _rows(kind: int, part: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    n = len(part)
    rest = [columns[c] if c in columns else pa.nulls(n, t) for c, t in TYPES.items()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(part.astype(np.int32)), *rest], NAMES)


def _links(met: Met, left: np.ndarray, right: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of candidates; the signature is named where it has more pairs than these."""
    for i in range(0, len(left), ROWS):
        x, y = left[i : i + ROWS], right[i : i + ROWS]
        yield _rows(1, part[i : i + ROWS], a=packed(met.name[x]), b=packed(met.name[y]), sig=pa.array(met.sig[x].view(np.int64), mask=~met.many[x]))


def _scan(n: int, percent: int, ranges: int):
    """Documents -> rows of sets, links of a task's own signatures, and signatures packed by range.

    kind 0: (id, a = name, size, bits); kind 1: (a, b, sig), candidates; kind 2: (part = range of signatures, data = signatures
    and their names). Of many sets of a task with one signature, one of each size code is sent on, and FEW + 1 at least, so that
    it has many in its range too; the task itself makes its neighbours candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        width = _U((1 << 64) // ranges + 1)
        # A signature goes on as its range and 32 bits: two that are taken for one only make a candidate more.
        coded = lambda sig: sig // width << _U(32) | sig & _U(0xFFFFFFFF)
        held, names, count, known = [], [], 0, set()

        def flush():
            nonlocal held, names, count
            if not held:
                return
            name = np.repeat(np.array(names, np.uint64), [len(x) for x in held], axis=0)
            met = Met(coded(np.concatenate(held)), name, bands.codes)
            held, names, count = [], [], 0
            known.clear()
            left, right = met.pairs()
            own = met.many[left]
            if own.any():
                yield from _links(met, left[own], right[own], met.sig[left[own]] >> _U(32))
            sent = ~met.many | met.begins | (met.place <= FEW)
            sig, name = met.sig[sent], met.name[sent]
            part = (sig >> _U(32)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(cut[1:], len(sig))
            for k in range(0, len(cut), ROWS):
                data = [sig[i:j].astype("<u4").tobytes() + name[i:j, 0].tobytes() + name[i:j, 1].astype("<u4").tobytes() for i, j in zip(cut[k : k + ROWS], ends[k : k + ROWS], strict=True)]
                yield _rows(2, part[cut[k : k + ROWS]], data=pa.array(data, pa.binary()))

        for batch in pieces(batches):
            found, sizes, bits = [], [], []
            for text in batch.column(1).to_pylist():
                e = shingles(text, n)
                sizes.append(len(e))
                name = name_of(e) if len(e) else (0, 0)
                found.append(name)
                bits.append(sketch(e) if len(e) else np.zeros(0, np.int64))
                if len(e) and name not in known:
                    known.add(name)
                    s = signatures(e, bands)
                    if len(s):
                        held.append(s)
                        names.append(name)
                        count += len(s)
                if count >= HELD:
                    yield from flush()
            size = np.array(sizes, np.int64)
            name = packed(np.array(found, np.uint64)).filter(pa.array(size > 0))
            name = name.take(pa.array(np.cumsum(size > 0) - 1, mask=size == 0))
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in bits])).astype(np.int32)), pa.array(np.concatenate(bits)))
            yield _rows(0, np.arange(len(sizes)) % ranges, id=batch.column(0), a=name, size=pa.array(size), bits=words)
        yield from flush()

    return run


def _meet(percent: int):
    """Rows of _scan, a range after the other -> the same without kind 2; what shares a signature in a range is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Bands(percent).codes
        at, held = None, []

        def close():
            low, head, tail = ([np.frombuffer(x, kind, len(x) // 16, len(x) // 16 * skip) for x in held] for kind, skip in (("<u4", 0), ("<u8", 4), ("<u4", 12)))
            sig = np.concatenate(low).astype(np.uint64) | _U(at << 32)
            name = np.column_stack([np.concatenate(head), np.concatenate(tail).astype(np.uint64)])
            held.clear()
            met = Met(sig, name, codes)
            left, right = met.pairs()
            yield from _links(met, left, right, np.full(len(left), at))

        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds < 2).any():
                yield batch.filter(pa.array(kinds < 2))
            packs = batch.filter(pa.array(kinds == 2))
            for part, data in zip(packs.column(1).to_pylist(), packs.column(8).to_pylist(), strict=True):
                if part != at:
                    if held:
                        yield from close()
                    at = part
                held.append(data)
        if held:
            yield from close()

    return run


def _verify(n: int, percent: int):
    """Pairs with both texts -> pairs and whether they're similar. Pairs of one a follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()

        @lru_cache(maxsize=128)
        def elements(blob: bytes) -> np.ndarray:
            return shingles(unzip.decompress(blob).decode("utf-8", "surrogatepass"), n)

        for x in pieces(batches):
            good = [similar(elements(a), elements(b), percent) for a, b in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def _pack(n: int):
    """(node, name, text) -> compressed texts of nodes, of rows where the text is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor(level=3)
        for x in pieces(batches):
            rows = zip(*(x.column(k).to_pylist() for k in range(3)), strict=True)
            own = [(k, zipped.compress(t.encode("utf-8", "surrogatepass"))) for k, name, t in rows if t and name == np.array(name_of(shingles(t, n)), NAME).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int64()), pa.array([b for _, b in own], pa.binary())], ["node", "blob"])

    return run


def _at(label: DataFrame, name: str) -> DataFrame:
    """Components by a column of nodes."""
    return label.select(F.col("node").alias(name), F.col("component").alias(f"{name}_c"))


def _few(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs the two with the least and greatest hash, on either side."""
    h = F.xxhash64("a", "b")
    ends = [pairs.groupBy(x).agg(F.array(F.min_by(y, h), F.max_by(y, h)).alias("o")).select(F.col(x), F.explode("o").alias(y)).select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
    return ends[0].union(ends[1]).distinct()


def join_groups(ws: Workspace, docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs.

    Documents whose sets of n-word shingles have 100 * intersection >= percent * union are linked; component_id is
    the smallest id that links reach. A document of fewer words has the sequence of all as its one shingle; one
    without words, or with a null text, has none, is linked with nothing and is its own component. Rows of equal
    sets are one node, whatever their number. Null ids and repeated rows each give a row; a null id names no
    component unless it stands alone. Only the two columns are read. An empty table gives no rows.

    One pass over the texts makes the sets and their signatures, in packed ranges: only there are signatures
    shuffled, as bytes, and of many sets of a task with one signature and size one is sent. Sets that share a signature
    with more than FEW others are candidates in chains in order of size, not in all pairs; sizes and sketches drop most that aren't similar, and exact similarity of the whole sets
    decides. Where a candidate fails and its ends aren't joined by other links, the other pairs of
    its signature that sizes and sketches allow are tried too, so no link between components is lost: a common signature
    is dealt into blocks of about BLOCK sets, and each pair of blocks is a join key of its own. No group is held
    by a task: candidates, texts and labels meet in joins that adaptive execution can split.
    """
    spark = ws.spark
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Signatures of a set are some 3 * (1 - s) / s times its elements; a word takes some six characters.
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(RANGES_PER_PARTITION * partitions, int(chars / 6 * 3 * (100 - percent) / percent / RANGE_ROWS))
    scanned = map_batches(rows, _scan(n, percent, ranges), SCANNED)
    met = ws.save(map_batches(scanned.repartition(partitions, "part").sortWithinPartitions("part"), _meet(percent), SCANNED), "met")
    del scanned
    ws.tidy()
    sets = met.where("kind = 0").select("id", F.col("a").alias("name"), "size", "bits")
    tried = met.where("kind = 1").select(F.least("a", "b").alias("a_name"), F.greatest("a", "b").alias("b_name"), "sig")
    classes = sets.where("name is not null").groupBy("name").agg(F.min("id").alias("first"), F.any_value("size").alias("size"), F.any_value("bits").alias("bits"))
    # Numbers of nodes hold from here on, as the table is written once.
    classes = ws.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    candidates = ws.save(tried.select("a_name", "b_name").distinct(), "candidates")
    side = lambda c: classes.select(F.col("name").alias(f"{c}_name"), F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("bits").alias(f"{c}_bits"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """Compressed texts of the pairs' nodes, one each."""
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        chosen = ws.save(classes.where("first is not null").join(wanted, "node").select("node", "name", F.col("first").alias("id")), "chosen")
        texts = rows.join(ws.hinted(chosen, 64), "id").select("node", "name", "text")
        found = ws.save(map_batches(texts, _pack(n), "node long, blob binary").dropDuplicates(["node"]), "texts")
        ws.drop(chosen)
        return found

    def settle(close: DataFrame, label: DataFrame) -> DataFrame:
        """Components after all pairs of close have been compared that join two of them, as far as they're similar.

        All of close lead out of components. A large group has far more pairs than it takes to join it. So twice, each node
        tries a few of its pairs that lead out of its component; then all pairs that still do are tried. Pairs that a round has
        found within a component aren't read again.
        """
        blobs = texts_of(close)
        blob = lambda c: blobs.select(F.col("node").alias(c), F.col("blob").alias(f"{c}_blob"))
        out = close
        for few in (True, True, False):
            if out.isEmpty():
                break
            tried = ws.save(_few(out), "compared") if few else out
            both = tried.join(blob("b"), "b").join(blob("a"), "a").select("a", "b", "a_blob", "b_blob")
            good = ws.save(map_batches(both, _verify(n, percent), "a long, b long, good boolean").where("good").select("a", "b"), "links")
            if not good.isEmpty():
                label = components(ws, label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(good))
            if few:
                ws.drop(tried)
                rest = out.join(_at(label, "a"), "a", "left").join(_at(label, "b"), "b", "left").where("coalesce(a_c, a) <> coalesce(b_c, b)")
                rest = ws.save(rest.select("a", "b"), "out")
                if out is not close:
                    ws.drop(out)
                out = rest
            ws.drop(good)
            ws.tidy()
        if out is not close:
            ws.drop(out)
        ws.drop(blobs)
        return label

    near = may_be_similar(percent, "a", "b").alias("near")
    met_pairs = ws.save(candidates.join(side("b"), "b_name").join(side("a"), "a_name").select("a_name", "b_name", "a", "b", near), "pairs")
    ws.drop(candidates)
    label = settle(met_pairs.where("near").select("a", "b"), spark.createDataFrame([], "node long, component long"))
    # Only pairs within a component come out of these joins; a node without a label is alone in its component.
    joined = met_pairs.join(_at(label, "a"), "a").join(_at(label, "b"), "b").where("a_c = b_c").select("a_name", "b_name")
    # Signatures of few sets have no other pairs, and are null here.
    unsettled = ws.save(tried.where("sig is not null").join(joined, ["a_name", "b_name"], "left_anti").select("sig").distinct(), "open")
    if not unsettled.isEmpty():
        ends = tried.join(unsettled, "sig")
        members = ends.select("sig", F.col("a_name").alias("x_name")).union(ends.select("sig", F.col("b_name").alias("x_name"))).distinct()
        full = members.join(side("x"), "x_name").join(_at(label, "x"), "x", "left").withColumn("x_c", F.coalesce("x_c", "x")).drop("x_name")
        full = ws.save(full, "members")
        blocks = full.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
        blocks = ws.hinted(ws.save(blocks, "blocks"))
        dealt = full.join(blocks, "sig", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("x_block", F.pmod(F.xxhash64("x"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = dealt.withColumnRenamed("other", "y_block").drop("blocks")
        right = dealt.select(F.col("other").alias("x_block"), F.col("x_block").alias("y_block"), "sig", *[F.col(c).alias("y" + c[1:]) for c in ("x", "x_size", "x_bits", "x_c")])
        pairs = left.join(right, ["sig", "x_block", "y_block"]).where((F.col("x") < F.col("y")) & (F.col("x_c") != F.col("y_c")) & may_be_similar(percent, "x", "y"))
        pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        known = met_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = ws.save(pairs.join(known, ["a", "b"], "left_anti"), "close-again")
        if not more.isEmpty():
            label = settle(more, label)
    # The smallest id of each component, then of each node.
    of_node = classes.join(label, "node", "left").select("name", "first", F.coalesce("component", "node").alias("component"))
    least = ws.save(of_node.groupBy("component").agg(F.min("first").alias("least")), "least")
    final = ws.save(of_node.join(least, "component").select("name", "least"), "final")
    out = sets.drop("bits").join(final, "name", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id; five words, similarity 0.8.

    Documents of no group stay, with null or empty texts too. Of rows with equal doc_id and text one stays; rows
    with a null doc_id stay.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    inner = docs.toDF(*names)
    groups = join_groups(Workspace(spark), inner, 5, 80, doc_id, text)
    ws = Workspace(spark)
    gone = groups.where(f"{doc_id} <> component_id").select(doc_id, F.lit(True).alias("__gone"))
    often = inner.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id, F.lit(True).alias("__often"))
    marks = ws.save(gone.distinct().join(often, doc_id, "full"), "marks")
    ws.tidy()
    marked = inner.join(ws.hinted(marks), doc_id, "left").where("__gone is null")
    single, repeated = marked.where("__often is null"), marked.where("__often").dropDuplicates([doc_id, text])
    return single.unionByName(repeated).select(*names).toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by shingles of three words and a similarity of 0.9."""
    return join_groups(Workspace(spark), table(spark, sf_dir, "documents"), 3, 90)
