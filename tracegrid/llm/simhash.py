"""SimHash near-duplicates: fingerprints of word shingles, compared bit-sliced inside buckets.

Two fingerprints that differ in at most ``radius`` bits agree on all bits of at least BLOCKS - radius of BLOCKS
blocks, so on every pair out of some BLOCKS - radius of them: a bucket for each pair of blocks finds every link.
Within a bucket the bits stand vertically, one plane for each position; distances of 64 pairs at once are summed by
carry-save counters, and words of pairs that have all exceeded the radius are abandoned.

``keep_one`` links near copies by the same fingerprints, of sets of five-word shingles, and decides each link by the exact
similarity of the two sets. Fingerprints in reach of buckets miss pairs, so bands of minima then give the candidates
among texts that are not connected yet. Before the sets are compared, a bound from bit parities leaves out most of those
pairs below the similarity, and none at it.

Edge cases: a null text is empty, and texts without words have fingerprint zero; equal fingerprints are one class,
so groups of copies meet as one row; repeated rows stay; rows with a null id get a fingerprint and their class's
component, and count for none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.llm.components import components
from tracegrid.llm.shared import forest, settled

WORDS, RADIUS, BLOCKS = 4, 4, 6
#: Near copies: words of a shingle, bands of so many minima each, and minima that must agree before sets are compared.
SET_WORDS, BANDS, ROWS, GATE = 5, 32, 4, 78
#: Bits that tell a set's members apart: each member flips one.
PARITY = 2048
#: A bucket with more fingerprints is dealt out as pairs of parts of about this size.
PART = 2048
#: Buckets up to this size are compared together, row against shifted row.
SMALL = 32


def shingles(text: bytes, words: int) -> list[bytes]:
    """Word shingles of the text with A-Z in lower case; of fewer words, all of them as one."""
    found = text.lower().split()
    if not found:
        return []
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(1, len(found) - words + 1)].tolist()
    return [line[s:e] for s, e in zip(starts, ends[min(words, len(found)) - 1 :].tolist(), strict=True)]


def majority(digests: np.ndarray) -> np.ndarray:
    """Of digests, a row of bytes each, the bits that are set in over half of them, as little-endian 64-bit values."""
    ones = np.zeros(8 * digests.shape[1], dtype=np.int64)
    for at in range(0, len(digests), 4096):
        ones += np.unpackbits(digests[at : at + 4096], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(digests), bitorder="little").view("<u8")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the text's word shingles, repeats included, by XXH64 with seed 42."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles(text, words)], dtype="<u8")
    return int(majority(hashes.view(np.uint8).reshape(-1, 8))[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(key, fp bigint) for every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                prints = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, fp bigint")


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows of bit planes, 64 values to a word; what fills up the last word is zero."""
    full = np.zeros(-(-len(values) // 64) * 64, dtype="<u8")
    full[: len(values)] = values
    bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(differ, cells: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word): of each cell that has any, a word with a bit for every pair at distance <= radius.

    differ(p, cells) -> the words of plane p's differing bits for the given cells. The counter has as many
    carry-save digits as radius + 1 needs, and a word of pairs whose counter ran over.
    """
    digits = (radius + 1).bit_length()
    live = np.arange(cells)
    count = [np.zeros(cells, dtype="<u8") for _ in range(digits)]
    over = np.zeros(cells, dtype="<u8")

    def beyond() -> np.ndarray:
        """Pairs over the radius: compares the digits with the radius from the highest one down."""
        more, same = np.zeros_like(over), ~np.zeros_like(over)
        for k in reversed(range(digits)):
            if radius >> k & 1:
                same = same & count[k]
            else:
                more, same = more | (same & count[k]), same & ~count[k]
        return over | more

    for p in range(64):
        carry = differ(p, live)
        for k in range(digits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if p % 8 == 7:
            near = ~beyond()
            if not near.all():
                stay = near != 0
                live, over, count = live[stay], over[stay], [c[stay] for c in count]
    return live, ~beyond()


def pairs_of(cell: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, bit) of every bit that is set."""
    bits = np.unpackbits(word.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return cell[at], bit


def close_rows(group: np.ndarray, fp: np.ndarray, radius: int):
    """Links between rows of the same small group, given in order of group: yields (row, row)."""
    for shift in range(1, SMALL):
        same = np.flatnonzero(group[shift:] == group[:-shift])
        if not len(same):
            return
        for at in range(0, len(same), 1 << 16):
            i = same[at : at + (1 << 16)]
            rows = planes(fp[i] ^ fp[i + shift])
            cell, bit = pairs_of(*within(lambda p, live, rows=rows: rows[p][live], rows.shape[1], radius))
            hit = cell * 64 + bit
            hit = i[hit[hit < len(i)]]
            yield hit, hit + shift


def close_parts(left: np.ndarray, right: np.ndarray, radius: int):
    """Links between two parts of a large group: 64 of the right at once against each of the left. Yields (left, right)."""
    rows = planes(right)
    width = rows.shape[1]
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        flip = [-(some >> np.uint64(p) & np.uint64(1)) for p in range(64)]
        cell, bit = pairs_of(*within(lambda p, live, flip=flip: rows[p][live % width] ^ flip[p][live // width], len(some) * width, radius))
        r = cell % width * 64 + bit
        keep = r < len(right)
        yield at + (cell // width)[keep], r[keep]


def _links(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int):
    """Links between rows of the same group, rows in order of group: yields (row, row).

    side: 0 for a whole bucket or a part with itself, else 1 and 2 for the two parts.
    """
    first = begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begins, len(group)))
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    # A small group of two parts lies in order of side as well; links within a part are found again, and harm nothing.
    for i, j in close_rows(group[small], fp[small], radius):
        yield small[i], small[j]
    for f, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = f + np.arange(n)
        left, right = (rows, rows) if not side[rows].any() else (rows[side[rows] == 1], rows[side[rows] == 2])
        for i, j in close_parts(fp[left], fp[right], radius):
            yield left[i], right[j]


def linked(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, part: int = PART) -> DataFrame:
    """Links (a, b) among the nodes of classes (node, fp): not all of them, but enough to connect what is linked.

    Nodes link if their ``fp`` differ in at most ``radius`` bits.
    """
    if radius > blocks - 2:
        raise ValueError("a link must leave two blocks alike")
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    field = lambda k: F.expr(f"(shiftrightunsigned(fp, {edges[k]}) & {(1 << edges[k + 1] - edges[k]) - 1})")
    width = max(b - a for a, b in zip(edges, edges[1:], strict=False))
    keys = [F.lit(n << 2 * width) + F.shiftleft(field(i), width) + field(j) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    banded = classes.select("node", "fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = settled(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = banded.join(sizes, "bucket").withColumns({"parts": parts, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"), "node", "fp")
    met = met.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "side", "node", "fp")

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0))
            if len(last):  # the last group may go on in the next batch
                cut = int(last[-1]) + 1
                yield from compare([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from compare(held)

    def compare(cols):
        group = np.cumsum(np.append(0, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)))
        side, node, fp = cols[3:]
        found = []
        for i, j in _links(group, side, fp.view(np.uint64), radius):
            if len(i):
                found.append(forest(node[i], node[j]))
        if found:
            a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id): the least key whose fingerprint is reachable by links, for every row. A class is named by its fingerprint."""
    prints = settled(fingerprints(docs, key, text, words))
    classes = settled(prints.groupBy("fp").agg(F.min(key).alias("least")).withColumn("node", F.col("fp")))
    of = components(linked(classes, radius)).select("node", F.col("component").alias("root"))
    roots = classes.join(of, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    named = settled(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = settled(roots.join(named, "root").select("fp", "component_id"))
    return prints.join(of_class, "fp").select(key, "fp", "component_id")


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, fp, bands, sig): a hash of the text's set of shingles, its SimHash, a hash for each band of its minima, and the set's sketch.

    A sketch is a byte of each minimum, the PARITY bits, and the number of members in 8 bytes.
    """
    rng = np.random.default_rng(11)
    times, plus = (rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
    times |= np.uint32(1)
    salt = rng.integers(0, 1 << 63, (BANDS, 3), dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                node, fp, least = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64), np.zeros((part.num_rows, BANDS * ROWS), np.uint32)
                rest = []
                for k, t in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    node[k], hashes = shingle_set(t or b"")
                    some = hashes.astype(np.uint32)
                    rest.append(parity(hashes).tobytes() + len(hashes).to_bytes(8, "little"))
                    if len(some):
                        fp[k] = majority(hashes.view(np.uint8).reshape(-1, 8))[0]
                        least[k] = np.min([(some[i : i + 1024, None] * times + plus).min(axis=0) for i in range(0, len(some), 1024)], axis=0)
                x, y = np.ascontiguousarray(least).view("<u8").reshape(len(least), BANDS, 2).transpose(2, 0, 1)
                mixed = (x ^ salt[:, 0]) * (salt[:, 1] | np.uint64(1))
                mixed = ((mixed ^ mixed >> np.uint64(31)) + y) * (salt[:, 2] | np.uint64(1))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(least) * BANDS + 1, BANDS, dtype=np.int32)), pa.array((mixed ^ mixed >> np.uint64(29)).view(np.int64).reshape(-1)))
                sig = [row.tobytes() + more for row, more in zip(least.astype(np.uint8), rest, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), pa.array(fp.view(np.int64)), bands, pa.array(sig, pa.binary())], [key, "node", "fp", "bands", "sig"])

    return docs.select(key, text).mapInArrow(run, f"{key} bigint, node bigint, fp bigint, bands array<bigint>, sig binary")


def shingle_set(text: bytes) -> tuple[int, np.ndarray]:
    """A hash of the text's set of five-word shingles, and the sorted distinct hashes of its members."""
    hashes = np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles(text, SET_WORDS)], dtype="<u8"))
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42), hashes


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits as bytes: whether an odd number of members fall on each. Two sets' bits differ at most where one member is in one set only."""
    at = (hashes >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=PARITY) & 1).astype(bool))


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """(node, members array<bigint>) for every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                found = [shingle_set(t or b"") for t in batch.column(0).slice(at, 1000).cast(pa.binary()).to_pylist()]
                node = np.array([n for n, _ in found], dtype=np.uint64).view(np.int64)
                ends = np.cumsum([0, *(len(h) for _, h in found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([h for _, h in found]).view(np.int64)))], ["node", "members"])

    return docs.select(text).mapInArrow(run, "node bigint, members array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets have a Jaccard similarity of 0.8 or more, counted exactly."""
    one, two = (sets.select(F.col("node").alias(k), F.col("members").alias(f"m{k}")) for k in "ab")
    both, sizes = F.size(F.array_intersect("ma", "mb")), F.size("ma") + F.size("mb")
    return pairs.join(one, "a").join(two, "b").where(9 * both >= 4 * sizes).select("a", "b")


def may_be_near(sig: np.ndarray):
    """Of sketches, a row of bytes each: near(i, j) -> (mask of the pairs of rows that may have a similarity of 0.8 or more, bits in which those differ).

    GATE minima must agree. And at 0.8 or more the members in one set only are at most a ninth of both sets' sizes
    together, and there are at least as many of them as parity bits that differ: no pair at 0.8 fails this bound.
    """
    minima = np.ascontiguousarray(sig[:, : BANDS * ROWS])
    bits, size = (np.ascontiguousarray(x).view("<u8") for x in (sig[:, BANDS * ROWS : -8], sig[:, -8:]))

    def near(i, j):
        i, j = np.broadcast_arrays(i, j)
        mask = (minima[i] == minima[j]).sum(axis=1) >= GATE
        i, j = i[mask], j[mask]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.uint64)
        close = 9 * differ <= size[i, 0] + size[j, 0]
        mask[mask] = close
        return mask, differ[close]

    return near


def alike_rows(group: np.ndarray, side: np.ndarray, root: np.ndarray, sig: np.ndarray, spanning: bool = False):
    """Pairs of rows of the same group and different roots whose sketches may be near: yields (row, row).

    With ``spanning``, of a group with more than SMALL rows only pairs that make a spanning forest of all of them.
    """
    near = may_be_near(sig)
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begins, len(group)))
    small = np.flatnonzero(np.repeat(size <= SMALL, size))
    for shift in range(1, SMALL):
        same = np.flatnonzero((group[small][shift:] == group[small][:-shift]) & (root[small][shift:] != root[small][:-shift]))
        for at in range(0, len(same), 1 << 14):
            i, j = small[same[at : at + (1 << 14)]], small[same[at : at + (1 << 14)] + shift]
            mask, _ = near(i, j)
            yield i[mask], j[mask]
    for f, n in zip(begins[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        rows = f + np.arange(n)
        tree = np.unique(root[rows], return_inverse=True)[1]
        whole = not side[rows].any()
        right = rows if whole else rows[side[rows] == 2]
        for k, i in enumerate((rows if whole else rows[side[rows] == 1]).tolist()):
            j = right[k + 1 :] if whole else right
            j = j[tree[j - f] != tree[i - f]] if spanning else j[root[j] != root[i]]
            mask, differ = near(i, j)
            j = j[mask]
            if spanning and len(j):  # of each tree that it meets, the row that is most alike
                j = j[np.argsort(differ, kind="stable")]
                trees, best = np.unique(tree[j - f], return_index=True)
                j = j[best]
                tree[np.isin(tree, trees)] = tree[i - f]
            yield np.full(len(j), i), j


def met_pairs(members: DataFrame, sketches: DataFrame, part: int = PART, spanning: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of members (bucket, node, root) that share a bucket but no root and may be near copies.

    With ``spanning``, of more than SMALL members that meet only as many pairs as connect what all of them would.
    Members are dealt out first, and take their sketches (node, sig) along only then.
    """
    sizes = settled(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "n"))
    parts = F.ceil(F.col("n") / part).cast("int")
    met = members.join(sizes, "bucket").withColumns({"parts": parts, "own": F.pmod(F.xxhash64("node"), parts).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "root").join(sketches, "node")
    met = met.select("bucket", "i", "j", "side", "node", "root", "sig").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]]
            now.append(np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[:3]], axis=0))
            if len(last):  # the last group may go on in the next batch
                cut = int(last[-1]) + 1
                yield from compare([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from compare(held)

    def compare(cols):
        group = np.cumsum(np.append(0, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)))
        for i, j in alike_rows(group, cols[3], cols[5], cols[6], spanning):
            if len(i):
                a, b = cols[4][i], cols[4][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id) for every row: the least key that is reachable by pairs of a Jaccard similarity of 0.8 or more.

    Texts with the same set of shingles are one node. Nodes whose SimHash differs in at most RADIUS bits are linked first,
    where their sets confirm it. Nodes that agree in a band of minima meet in a bucket; two at 0.8
    miss each other in all bands once in 2e7, and GATE once in 1e7. All pairs of a small bucket that may be near are
    looked at, but of a large one first only a spanning forest of them: where those are near copies, the rest, as many
    as the square of a group, need no look. Then come the pairs of large buckets that are not connected yet.
    """
    told = settled(signatures(docs, key, text))
    classes = settled(told.groupBy("node").agg(F.min(key).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    printed = settled(linked(classes.select("node", "fp")))
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    sizes = settled(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = settled(banded.join(sizes, "bucket").select("bucket", "node", "n"))
    met = members.select("node").unionByName(printed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    some = settled(classes.join(met, "node").select("node", "least", "sig"))
    wanted = some.select(F.col("least").alias(key)).distinct()
    sets = settled(shingle_sets(docs.select(key, text).join(wanted, key, "left_semi"), text).groupBy("node").agg(F.first("members").alias("members")))
    sketches = some.select("node", "sig")
    rooted = lambda some, roots: some.join(roots, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("root"))
    near = settled(verified(printed, sets))
    rest = settled(verified(met_pairs(rooted(members, components(near)), sketches, spanning=True), sets))
    links = near.unionByName(rest)
    roots = components(links)
    large = rooted(members.where(F.col("n") > SMALL), roots)
    more = settled(verified(met_pairs(large, sketches), sets))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    of = classes.join(roots, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    of = settled(of)
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return told.select(key, "node").join(settled(of.join(named, "root").select("node", "component_id")), "node").select(key, "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay when each group of near copies keeps its least key. Rows with a null key stay.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such
    pairs connect. Rows that repeat a key all stay or go together.
    """
    gone = near_groups(docs.where(F.col(key).isNotNull()), key, text).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
