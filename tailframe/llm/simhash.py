"""Near-duplicate groups by SimHash fingerprints and the pigeonring principle.

Let two fingerprints differ in at most t of 64 bits and cut them into m segments on a ring.
Then some segment starts a chain in which the first l segments differ in at most l * t / m
bits together, for every l. With m = 8 and t = 2 the first three segments of that chain are
equal (24 bits), the first seven differ in one bit at most, and all in two. So distinct
fingerprints meet by (start, three equal segments), a meeting is a candidate only if every
prefix of the chain keeps its budget, and candidates get the full Hamming check.

Only distinct fingerprints meet, 8 bytes each, and a meeting place emits a spanning forest of
its links instead of its pairs. A crowded one doesn't compare pairs either: it looks up each
of the differences that the chain allows (325 for the values above), so its work grows with
the number of fingerprints and not with its square.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_join, lower_words, map_texts, ship, stored
from .graph import components, merge_labels

BITS = 64
#: Rows of 64 bits that are summed at once.
BLOCK = 32_768


def shingle_digests(text: str | None, words: int, seed: int) -> list[bytes]:
    """XXH64 (big-endian) of each shingle of the lower-cased text, repeats included."""
    from xxhash import xxh64_digest

    found = lower_words(text)
    if not found:
        return []
    whole = b" ".join(found)
    if len(found) <= words:
        return [xxh64_digest(whole, seed)]
    ends = list(accumulate(len(w) + 1 for w in found))
    return [xxh64_digest(whole[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]


def fingerprints(texts: list[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """One uint64 a text: a bit is set if over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), dtype=np.uint64)
    held: list[tuple[int, int]] = []  # (text, its number of hashes)
    parts: list[bytes] = []
    rows = 0

    def bits(raw: bytes) -> np.ndarray:
        return np.unpackbits(np.frombuffer(raw, dtype=np.uint8)).reshape(-1, BITS)

    def flush():
        nonlocal rows
        if held:
            sizes = np.array([n for _, n in held])
            sums = np.add.reduceat(bits(b"".join(parts)), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
            out[[k for k, _ in held]] = np.packbits(2 * sums > sizes[:, None], axis=1).view(">u8").ravel()
        held.clear()
        parts.clear()
        rows = 0

    for k, text in enumerate(texts):
        digests = shingle_digests(text, words, seed)
        if len(digests) > BLOCK:
            total = sum(bits(b"".join(digests[i : i + BLOCK])).sum(axis=0, dtype=np.int64) for i in range(0, len(digests), BLOCK))
            out[k] = np.packbits(2 * total > len(digests)).view(">u8")[0]
        elif digests:
            held.append((k, len(digests)))
            parts.append(b"".join(digests))
            rows += len(digests)
            if rows >= BLOCK:
                flush()
    flush()
    return out


def rotated(fp: Column, bits: int) -> Column:
    return fp if bits == 0 else F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, BITS - bits))


class Ring:
    """The chain conditions for `distance` bits and `segments` segments of equal width."""

    def __init__(self, distance: int = 2, segments: int = 8, crowded: int = 1024):
        if BITS % segments or not 0 <= distance < segments:
            raise ValueError("segments has to divide 64 and to exceed distance")
        self.distance, self.segments, self.width, self.crowded = distance, segments, BITS // segments, crowded
        self.budget = [length * distance // segments for length in range(segments + 1)]
        self.equal = sum(b == 0 for b in self.budget[1:])  # first segments of a chain that are equal

    def allowed(self) -> np.ndarray:
        """The differences, seen from the chain's start, that keep every budget."""
        free = BITS - self.equal * self.width
        masks = [sum(1 << b for b in c) for n in range(1, self.distance + 1) for c in combinations(range(free), n)]
        masks = np.array(masks, dtype=np.uint64)
        return masks[self.chain_holds(masks)]

    def chain_holds(self, difference: np.ndarray) -> np.ndarray:
        keep = np.ones(difference.shape, dtype=bool)
        for length in range(1, self.segments + 1):
            keep &= np.bitwise_count(difference >> np.uint64(BITS - length * self.width)) <= self.budget[length]
        return keep

    def links(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node, root) of a spanning forest of the links that start their chain here; fps:
        distinct rotated fingerprints."""
        g = len(fps)
        if g <= self.crowded:
            near = self.chain_holds(fps[:, None] ^ fps[None, :])  # its last budget is the full Hamming check
            todo, root = np.ones(g, dtype=bool), np.arange(g)
            for k in range(g):
                if todo[k]:
                    todo[k] = False
                    front = np.array([k])
                    while len(front):
                        front = np.flatnonzero(near[front].any(axis=0) & todo)
                        todo[front] = False
                        root[front] = k
        else:
            fps = np.sort(fps)
            root = np.arange(g)
            pairs = []
            for mask in self.allowed():
                other = fps ^ mask
                at = np.minimum(np.searchsorted(fps, other), g - 1)
                hit = np.flatnonzero((fps[at] == other) & (at > np.arange(g)))
                if len(hit):
                    pairs.append(np.stack([hit, at[hit]]))
                if len(pairs) > 32:
                    root = merge_labels(root, pairs)
                    pairs = []
            root = merge_labels(root, pairs)
        moved = np.flatnonzero(root != np.arange(g))
        return fps[moved], fps[root[moved]]


def _emit(key: int, fps: np.ndarray, ring: Ring) -> list[np.ndarray]:
    start = np.uint64((key >> 40) * ring.width)
    back = lambda x: ((x >> start) | (x << (np.uint64(BITS) - start))) if start else x
    return [back(x).view(np.int64) for x in ring.links(fps)]


def link_edges(fps: DataFrame, ring: Ring) -> DataFrame:
    """fps: distinct `fp` (long). Edges (a, b) that connect exactly what links of at most
    ring.distance bits connect."""
    ship(fps.sparkSession)
    arc = BITS - ring.equal * ring.width
    places = F.explode(
        F.array(
            *(
                F.struct(F.lit(i << 40).bitwiseOR(F.shiftrightunsigned(r, max(arc, 24))).alias("key"), r.alias("turned"))
                for i in range(ring.segments)
                for r in [rotated(F.col("fp"), i * ring.width)]
            )
        )
    )
    met = fps.select(places.alias("p")).select("p.key", "p.turned").repartition("key").sortWithinPartitions("key")

    def run(batches):
        last_key, held = None, []

        def close():
            return _emit(last_key, np.concatenate(held), ring) if sum(map(len, held)) > 1 else [np.empty(0, np.int64)] * 2

        for batch in batches:
            keys = batch.column(0).to_numpy()
            turned = batch.column(1).to_numpy().view(np.uint64)
            found = []
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            for k in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                key, part = keys[cuts[k]], turned[cuts[k] : cuts[k + 1]]
                if key == last_key:
                    held.append(part)
                else:
                    found.append(close())
                    last_key, held = key, [part]
            yield _edges(found)
        if held:
            yield _edges([close()])

    def _edges(found):
        a, b = (np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def fingerprint(df: DataFrame, words: int = 3, seed: int = 42, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with fp (long; the 64 bits as they are). Null and empty texts have the fingerprint 0.
    An input column named fp (in any case) is replaced."""
    make = lambda: lambda cols: [pa.array(fingerprints(cols[0].to_pylist(), words, seed).view(np.int64))]
    return map_texts(df, make, [text_col], [T.StructField("fp", T.LongType())], keep)


def _groups(fps: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """fps: stored fp, least id and number of rows; edges between values of fp. (fp, root, component_id)
    for each fp."""
    placed = stored(fps.join(components(edges), fps.fp == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    return hot_join(placed, smallest.select("root", "component_id"), "root", smallest.select("root", "n"), rows, "fp").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, distance: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, fingerprint (16 hex digits) and component_id, the
    smallest id that links of at most `distance` bits reach.

    Equal fingerprints (exact copies, repeated rows, all empty or null texts) are linked.
    Null ids are ignored by the minimum: a group without any id has a null component_id.
    Other columns of df aren't read, so their names can't clash. An empty table gives an
    empty one. Texts of any length are read whole.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = stored(fingerprint(own, words, seed, "text", ["id"]), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    rows = marked.count()
    groups = _groups(fps, link_edges(fps.select("fp"), Ring(distance)), rows)
    numbered = marked.withColumn("_row", F.monotonically_increasing_id())  # of a stored table: the same in every run
    return hot_join(numbered, groups, "fp", fps.select("fp", "n"), rows, "_row").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For keep_one(): texts are linked if the Jaccard similarity of their sets of GRAM-word shingles is
#: at least SIMILAR (a fraction). Each of the seeds gives BANDS bands of ROWS minima, and texts meet if
#: a band is equal: with two seeds, at a similarity of 0.8, all but 3 of 100,000 pairs do.
GRAM, SIMILAR = 5, (4, 5)
BANDS, ROWS, WIDER_SEEDS = 10, 4, (42, 43)
#: Pairs whose bytes of the minima agree less than this aren't compared exactly where a hub doesn't connect a
#: meeting place: 5.6 standard deviations (of 80 minima) below the similarity asked for, so one pair in 90 million
#: at that similarity is lost. 0 compares all exactly.
LEAST_AGREEMENT = 0.55


def minima(texts: list[str | None], seeds: tuple[int, ...] = WIDER_SEEDS) -> np.ndarray:
    """BANDS * ROWS minima (uint64) a seed of each text's shingles; zeros for texts without words."""
    size = BANDS * ROWS
    out = np.zeros((len(texts), size * len(seeds)), dtype=np.uint64)
    draws = [np.random.default_rng(seed).integers(0, 1 << 63, (2, size), dtype=np.uint64) for seed in seeds]
    times, plus = np.concatenate([np.empty((2, 0), np.uint64), *draws], axis=1)
    times = 2 * times + np.uint64(1)
    held, parts, rows = [], [], 0

    def flush():
        if held:
            hashes = np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64)
            starts = np.concatenate([[0], np.cumsum([n for _, n in held])[:-1]])
            at = [k for k, _ in held]
            for i in range(len(times)):
                out[at, i] = np.minimum.reduceat(hashes * times[i] + plus[i], starts)
        held.clear()
        parts.clear()

    for k, text in enumerate(texts):
        if digests := shingle_digests(text, GRAM, 42):
            held.append((k, len(digests)))
            parts.append(b"".join(digests))
            rows += len(digests)
            if rows >= BLOCK:
                flush()
                rows = 0
    flush()
    return out


def bands(least: np.ndarray) -> np.ndarray:
    """One int64 a band: a hash of its number and minima."""
    n = least.shape[1] // ROWS
    x = least.reshape(len(least), n, ROWS)
    out = np.zeros((len(least), n), dtype=np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ x[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts (node, text) are similar, by their exact sets."""

    def run(batches):
        last, ours = None, frozenset()
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                if (a := batch.column(0)[k].as_py()) != last:
                    last, ours = a, frozenset(shingle_digests(batch.column(2)[k].as_py(), GRAM, 42))
                theirs = set(shingle_digests(batch.column(3)[k].as_py(), GRAM, 42))
                both = len(ours & theirs)
                keep.append(both * SIMILAR[1] >= (len(ours) + len(theirs) - both) * SIMILAR[0])
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    # Of a pair, b is the one that may be anywhere; a hub is the a of many pairs.
    of_a, of_b = (pairs.groupBy(c).agg(F.count("*").alias("n")) for c in ("a", "b"))
    rows = pairs.count()
    whole = hot_join(hot_join(pairs, left, "a", of_a, rows, "b"), right, "b", of_b, rows, "a")
    return whole.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


#: Nodes of a side of one comparison of texts in a meeting place that its hub doesn't connect, and how many
#: such sides are compared at once by sketches and stamps alone, before any text moves: more make fewer seats and
#: larger tasks.
BLOCK_NODES, WIDE = 256, 1
#: Places of a stamp, and the most shingles that are thrown into one of them without thinning; powers of two.
STAMP_BITS, DENSE = 2048, 2048
#: Standard deviations beyond which a stamp rules a pair out: one pair in a billion at the similarity asked for.
DEVIATIONS = 6


def _level(n):
    """How often a text of n shingles is halved until DENSE or fewer are left."""
    return np.ceil(np.log2(np.maximum(n, DENSE) / DENSE)).astype(np.int64)


def stamp(digests: list[bytes]) -> tuple[int, bytes]:
    """The number of distinct shingles, and the parity of those in each of STAMP_BITS places, twice: with the shingles
    halved (by their hashes) _level() times and once more, so that it can be held against texts of the next level."""
    hashes = np.unique(np.frombuffer(b"".join(digests), dtype=">u8")).astype(np.uint64)
    level, out = int(_level(len(hashes))), []
    for halved in (level, level + 1):
        kept = hashes[(hashes // np.uint64(STAMP_BITS)) % np.uint64(1 << halved) == 0]
        out.append(np.packbits(np.bincount((kept % np.uint64(STAMP_BITS)).astype(np.int64), minlength=STAMP_BITS) & 1))
    return len(hashes), np.concatenate(out).tobytes()


def may_be_similar(n: np.ndarray, stamps: np.ndarray, k: int, others: np.ndarray, by_stamp: bool = True) -> np.ndarray:
    """Whether each of the others may be as similar to k as SIMILAR asks. By their sizes alone, which is a proof, and by
    their stamps: similar sets differ in a bounded number of shingles, those put odd numbers into a known number
    of places on average, and what is DEVIATIONS above that rules a pair out.

    stamps: (texts, 2, bytes). A place is odd with the probability (1 - d) / 2 for d = exp(-2m / places) and m shingles
    thrown; the variance is that of independent places, less what is known of m."""
    sizes = n[others]
    sized = SIMILAR[1] * np.minimum(sizes, n[k]) >= SIMILAR[0] * np.maximum(sizes, n[k])
    if not by_stamp:
        return sized
    ours, theirs = _level(n[k]), _level(sizes)
    level = np.maximum(ours, theirs)  # beyond one apart the sizes are too
    odd = np.bitwise_count(stamps[k, np.minimum(level - ours, 1)] ^ stamps[others, np.minimum(level - theirs, 1)]).sum(axis=1)
    share = 0.5**level
    m = (sizes + n[k]) * (SIMILAR[1] - SIMILAR[0]) / (SIMILAR[1] + SIMILAR[0]) * share
    d = np.exp(-2 * m / STAMP_BITS)
    variance = STAMP_BITS / 4 * (1 - d * d) - m * share * d * d
    return sized & (odd <= STAMP_BITS / 2 * (1 - d) + DEVIATIONS * np.sqrt(np.maximum(variance, 0)) + 1)


class _Block:
    """Nodes that meet at a key, those of one side (right is false) to be compared with those of the other."""

    def __init__(self, key: int, table: dict[str, list], least_agreement: float):
        self.key, self.least = key, least_agreement
        self.node, self.label, self.keys, self.n, right = (np.array(table[c]) for c in ("node", "label", "keys", "n", "right"))
        self.sketch = np.array([np.frombuffer(x, np.uint8) for x in table["sketch"]])
        self.stamps = np.array([np.frombuffer(x, np.uint8) for x in table["stamp"]]).reshape(len(right), 2, -1)
        self.left, self.right = np.flatnonzero(~right), np.flatnonzero(right)

    def likely(self, k: int) -> np.ndarray:
        """Positions in `right` of the nodes to be compared with k, the likeliest first: of another label, not met at an
        earlier key, and not ruled out."""
        there = self.right
        agree = (self.sketch[there] == self.sketch[k]).mean(axis=1)
        same = self.keys[there] == self.keys[k]
        first = self.keys[k][same.argmax(axis=1)] == self.key
        at = np.flatnonzero((agree >= self.least) & first & (self.label[there] != self.label[k]))
        at = at[may_be_similar(self.n, self.stamps, k, there[at], self.least > 0)]
        return at[np.argsort(-agree[at], kind="stable")]


def _by_block(rows: DataFrame, names: list[str], compare, schema: str) -> DataFrame:
    """compare(key, columns) for the rows of each (key, i, j); it gives tuples of the schema's fields."""
    fields = T.StructType.fromDDL(schema)
    kinds = [pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() for f in fields]
    at = ["key", "i", "j"]

    def batch(found):
        columns = list(zip(*found, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=fields.fieldNames())

    def run(batches):
        last, held = None, None
        for some in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if row[:3] != last:
                    if last is not None:
                        out += compare(last[0], held)
                    last, held = row[:3], {n: [] for n in names}
                for n, v in zip(names, row[3:], strict=True):
                    held[n].append(v)
            yield batch(out)
        if last is not None:
            yield batch(compare(last[0], held))

    return rows.select(*at, *names).repartition(*at).sortWithinPartitions(*at, "node").mapInArrow(run, schema)


def _stamped(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, keys, sketch, n, stamp of the nodes (node, one row each)."""

    def make():
        def run(cols):
            found = [stamp(shingle_digests(t, GRAM, 42)) for t in cols[0].to_pylist()]
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]

        return run

    fields = [T.StructField("n", T.LongType()), T.StructField("stamp", T.BinaryType())]
    return map_texts(texts.join(nodes, "node", "left_semi"), make, ["text"], fields, ["node", "keys", "sketch"])


def _between(labelled: DataFrame, texts: DataFrame, rows: int, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """labelled: key, node, label (of the component) and rows of it; texts: node, text, keys, sketch. Links (a, b)
    that connect what further links of nodes with a common key would connect.

    Of two nodes with different labels one isn't of the key's most frequent label. So those are
    compared with all others, block by block. Wide blocks of sketches and stamps come first and find which nodes have
    anything to be compared with in which block of about BLOCK_NODES a side; only to those seats a text is
    brought. There, pairs whose labels are connected by then aren't read; the others are compared by their whole sets of
    shingles, likely ones first. With a least_agreement of 0 only sizes, which are a proof, rule pairs out."""
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    keys = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK_NODES)).cast("int")
    keys = stored(keys.select("key", "n", F.col("top.label").alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("top.n")).alias("few_blocks")), "parted")
    at = stored(hot_join(labelled, keys.drop("n"), "key", keys.select("key", "n"), rows, "node"), "unsettled")
    stamped = stored(_stamped(texts, at.select("node").distinct()), "stamped")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    wide = lambda c: F.floor(c / WIDE).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), wide(F.col(n) - 1)))
    few = at.where("label <> main").select("key", "node", "label", of("few_blocks").alias("block"), each("all_blocks").alias("j"), F.lit(False).alias("right")).withColumn("i", wide(F.col("block")))
    every = at.select("key", "node", "label", of("all_blocks").alias("block"), each("few_blocks").alias("i"), F.lit(True).alias("right")).withColumn("j", wide(F.col("block")))
    seats = stored(few.unionByName(every), "seats")
    sizes = lambda s: s.groupBy("node").agg(F.count("*").alias("n"))

    def meet(key, table):
        here, block = _Block(key, table, least_agreement), np.array(table["block"])
        ours, theirs = np.zeros((len(here.left), WIDE), bool), np.zeros((len(here.right), WIDE), bool)
        for row, k in enumerate(here.left):
            likely = here.likely(k)
            theirs[likely, block[k] % WIDE] = True
            ours[row, block[here.right[likely]] % WIDE] = True
        i, j = block[here.left].max(initial=0) // WIDE * WIDE, block[here.right].max(initial=0) // WIDE * WIDE
        seat = lambda x, i, j, right: (key, int(i), int(j), int(here.node[x]), int(here.label[x]), right)
        mine = [seat(here.left[x], block[here.left[x]], j + to, False) for x, to in zip(*np.nonzero(ours), strict=True)]
        return mine + [seat(here.right[x], i + to, block[here.right[x]], True) for x, to in zip(*np.nonzero(theirs), strict=True)]

    def link(key, table):
        here, sets, parent = _Block(key, table, least_agreement), {}, {}

        def shingles(k):
            if k not in sets:
                sets[k] = np.unique(np.frombuffer(b"".join(shingle_digests(table["text"][k], GRAM, 42)), dtype=">u8"))
            return sets[k]

        def root(x):
            while (up := parent.get(x, x)) != x:
                x = up
            return x

        found = []
        for k in here.left:
            for j in here.right[here.likely(k)]:
                x, y = root(here.label[k]), root(here.label[j])
                if x == y:
                    continue
                a, b = shingles(k), shingles(j)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]:
                    parent[x] = y
                    found.append((int(min(here.node[k], here.node[j])), int(max(here.node[k], here.node[j]))))
        return found

    held = ["node", "label", "right", "keys", "sketch", "n", "stamp"]
    met = _by_block(hot_join(seats, stamped, "node", sizes(seats), seats.count(), "key"), [*held, "block"], meet, "key long, i int, j int, node long, label long, right boolean")
    met = stored(met, "met")
    n = met.count()
    whole = hot_join(hot_join(met, stamped, "node", sizes(met), n, "key"), texts.select("node", "text"), "node", sizes(met), n, "key")
    return _by_block(whole, [*held, "text"], link, "a long, b long")


def keep_one(df: DataFrame, distance: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", wider_seeds: tuple[int, ...] = WIDER_SEEDS, least_agreement: float = LEAST_AGREEMENT) -> DataFrame:
    """The rows of df, all columns and no other, less all but one of each group of near
    duplicates. Texts of equal words are one node. Nodes are candidates if their fingerprints
    are linked as in near_duplicates(), or if one of the bands of minima of wider_seeds is equal.
    A candidate is a link only if the exact five-word similarity is SIMILAR or more.

    First all nodes of a meeting place (an equal band) are checked with its hub; then, in places that
    the links found don't connect, the pairs whose ends aren't connected yet; of these, pairs whose sketches agree
    less than least_agreement, or whose stamps differ too much, are passed over (0: none is).
    The row with the group's smallest id stays. If several rows of a group have that id, or if none
    has an id, one of them stays. All null and empty texts (and those of white space alone) are one
    group; texts of fewer than GRAM words have one shingle, their whole. Texts of any length are
    compared whole. An empty table gives an empty one; extra columns of any name stay as they are."""
    from xxhash import xxh64_digest

    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        def run(cols):
            texts = cols[0].to_pylist()
            node = np.frombuffer(b"".join(xxh64_digest(b" ".join(lower_words(t)), seed) for t in texts), dtype=">i8").astype(np.int64)
            least = minima(texts, wider_seeds)
            keys, sketch = bands(least), least.astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            return [pa.array(node), pa.array(fingerprints(texts, words, seed).view(np.int64)), lists, pa.array([s.tobytes() for s in sketch], pa.binary())]

        return run

    fields = [T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    marked = stored(map_texts(row, make, ["text"], fields, ["row", "id"]).withColumn("place", F.monotonically_increasing_id()), "marked")
    nodes = stored(marked.groupBy("node").agg(F.min("place").alias("place"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("fp", "keys", "sketch"))), "nodes")
    rows = marked.count()

    met = nodes.select("node", F.explode("keys").alias("key"))
    hub = F.min(F.struct(F.xxhash64("node", "key"), "node"))["node"]  # another one for each key, so that nodes meet many
    hubs = met.groupBy("key").agg(hub.alias("hub"), F.count("*").alias("n")).where("n > 1")
    hubs = stored(hubs, "hubs")
    met = stored(hot_join(met, hubs.select("key", "hub"), "key", hubs.select("key", "n"), rows, "node"), "met")
    stands = stored(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n")), "stands")
    by_print = hot_join(nodes.select("fp", "node"), stands.select("fp", "least"), "fp", stands.select("fp", "n"), rows, "node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = link_edges(stands.select("fp"), Ring(distance))
    left, right = (stands.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in ("a", "b"))
    near = near.join(left, "a").join(right, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    proposed = met.select(F.col("hub").alias("a"), F.col("node").alias("b")).union(by_print).union(near).where("a <> b")
    first = stored(proposed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    asked = met.select("node").union(first.select("a")).union(first.select("b")).distinct()
    asked = nodes.select("node", "place", "keys", "sketch").join(asked, "node")
    texts = stored(marked.select("place", F.col(f"row.`{text_col}`").alias("text")).join(asked, "place").select("node", "text", "keys", "sketch"), "texts")
    links = stored(_similar(first, texts), "links")
    found = components(links)
    labelled = met.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    second = stored(_between(labelled, texts, rows, least_agreement), "links")
    if not second.isEmpty():
        found = components(links.union(second))

    of = hot_join(marked.select("id", "node", "place"), found, "node", nodes.select("node", "n"), rows, "place", "left").select("id", "place", F.coalesce("root", "node").alias("root"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "place"))
    stays = of.groupBy("root").agg(best.alias("best")).select(F.col("best.place").alias("place"))
    return marked.join(stays, "place", "left_semi").select("row.*")
