"""Near duplicates by b-bit MinHash.

Each text becomes a set of word shingles and K minima. Band keys (of whole minima) bring candidates
together; the low bits of the minima, packed into longs, give a collision-corrected estimate of
the similarity by bit counts, which sifts the candidates; links are confirmed on whole shingle sets.

No bucket is expanded into its pairs. Texts with one shingle set are one class. In each bucket all
classes are compared with one hub, the class that meets most others over all its buckets (in a group of
copies of one text: that text). What a hub's group then still holds in other components than the hub's is compared
with the rest of the group, block by block inside tasks: first the signatures alone, and whole sets only of the classes for which
a block's estimates allow a link; a block gives links that connect it, not all its links. Of g classes of a group that are not linked to its
hub, 2 g^2 / BLOCK signatures enter tasks, and as many sets at worst, where every estimate allows a link; rows that leave tasks grow with g.

Keys, hubs and components of very many classes are dealt over several tasks. Components come from alternating star contractions, each
step written to the shared folder.

Nulls and empty texts have no shingles and are linked with nothing. Rows that repeat a doc_id give a row
each; a row without doc_id has component_id null and is kept. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.shared import HOT_ROWS, cut, hinted, in_arrow, met_by_key, mix64, pieces_of, scratch, shingles, spread

K, BITS, BANDS, ROWS = 128, 4, 32, 4
LONGS = K * BITS // 64
#: The estimate's standard deviation near the threshold is 0.033; six of them.
MARGIN = 0.2
#: Classes on a side of a block that is compared inside one task, and the shingles that they hold together at most (8 bytes each), if one class doesn't.
BLOCK, BLOCK_SHINGLES = 128, 1 << 21
#: Members of a hub that are confirmed against one copy of its set; a hub of more is dealt over several.
STAR = 256
#: Classes whose texts are looked up by a broadcast of their ids.
BROADCAST_ROWS = 500_000
_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 64, K, dtype=np.uint64)
_ROW = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 64, BANDS, dtype=np.uint64)
_PLACE = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, :]


def minima(hashes: np.ndarray) -> np.ndarray:
    """The K minima of a set, its elements taken in blocks so that memory stays bounded."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[a : a + 2048, None] * _MUL + _ADD).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    return mix64((mix64(least).reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ _BAND).view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint64((1 << BITS) - 1)).reshape(LONGS, 64 // BITS)
    return np.bitwise_or.reduce(low << _PLACE, axis=1).view(np.int64)


def set_id(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def similarity_estimate(a: str, b: str) -> Column:
    """Of two packed signatures (array columns): positions that agree in all bits, less those that agree by chance."""
    ones = int("1" * (64 // BITS), 16) if BITS == 4 else sum(1 << i for i in range(0, 64, BITS))
    differing = F.lit(0)
    for i in range(LONGS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        fold = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        differing = differing + F.bit_count(fold.bitwiseAND(F.lit(ones)))
    chance = 1 / (1 << BITS)
    return (1 - differing / K - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, rank, n, sid, sig, keys) for each row (id, rank, text); sid names the shingle set and is null for an empty one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces_of(batches):
            sets = shingles(texts, words)
            least = [minima(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([None if m is None else packed(m) for m in least], pa.list_(pa.int64())),
                    pa.array([None if m is None else band_keys(m) for m in least], pa.list_(pa.int64())),
                ],
                names=["id", "rank", "n", "sid", "sig", "keys"],
            )

    return in_arrow(docs, work, "id long, rank long, n long, sid binary, sig array<long>, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, set) of the classes wanted (sid, id: a row that has the set): sorted hashes of its shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in pieces_of(batches):
            sets = [s for s in shingles(raw, words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([f(s) for s in sets], pa.binary()) for f in (set_id, np.ndarray.tobytes)], names=["sid", "set"])

    texts = docs.select("id", "text").join(hinted(wanted.select("id").distinct(), BROADCAST_ROWS), "id", "left_semi")
    found = in_arrow(texts, work, "sid binary, set binary").join(hinted(wanted.select("sid"), BROADCAST_ROWS), "sid", "left_semi")
    return cut(found.dropDuplicates(["sid"]), "sets")


def is_link(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _confirmed(pairs: DataFrame, stars: DataFrame, sets: DataFrame, percent: int, star: int) -> DataFrame:
    """Those of (a, b) whose whole shingle sets are linked; stars is (b, n). A task meets the set of b once, then streams those of its members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for a, raw in zip(batch.column(0), batch.column(2)):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if a.is_valid:
                    good.append(is_link(len(np.intersect1d(own, hub, assume_unique=True)), len(own), len(hub), percent))
                else:
                    hub = own.copy()
                    good.append(False)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = spread(pairs, stars, "b", most=STAR, top=star)
    members = left.join(sets.withColumnRenamed("sid", "a"), "a").select("a", "b", "set", "_salt")
    hubs = right.join(sets.withColumnRenamed("sid", "b"), "b").select(F.lit(None).cast("binary").alias("a"), "b", "set", "_salt")
    ordered = members.unionByName(hubs).repartition("b", "_salt").sortWithinPartitions("b", "_salt", F.asc_nulls_first("a"))
    return in_arrow(ordered, work, "a binary, b binary")


def likely_matrix(left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of the packed signatures of two blocks may be linked, by their estimates."""
    differing = np.zeros((len(left), len(right)), np.int32)
    for i in range(LONGS):
        x = (left[:, None, i] ^ right[None, :, i]).view(np.uint64)
        fold = x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)
        differing += np.bitwise_count(fold & np.uint64(0x1111111111111111))
    chance = 1 / (1 << BITS)
    return (1 - differing / K - chance) / (1 - chance) >= percent / 100 - MARGIN


def linked_matrix(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the whole sets of two blocks are linked. Intersections are sums of products of 0-1 matrices, each over few enough shingles to be exact."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        both += (_marks(left, part) @ _marks(right, part).T).astype(np.int64)
    sizes = [np.array([len(x) for x in some], np.int64) for some in (left, right)]
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def connecting(linked: np.ndarray, left: list[tuple[bytes, bytes]], right: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
    """Links (sid, sid) that join the components of two blocks of (sid, root) as far as all the links do."""
    group: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while group.setdefault(x, x) != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        (a, own), (b, other) = left[i], right[j]
        x, y = top(own), top(other)
        if x != y:
            group[x] = y
            out.append((a, b))
    return out


def _marks(sets: list[np.ndarray], shingle_hashes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(shingle_hashes)), np.float32)
    for row, x in zip(out, sets):
        place = np.searchsorted(shingle_hashes, x)
        inside = place < len(shingle_hashes)
        row[place[inside][shingle_hashes[place[inside]] == x[inside]]] = 1
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node that it reaches.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the edges stay as they are. Where there are more edges than one task
    takes of a node, the least neighbours are written first, with their numbers, so that nodes of very many edges are dealt over several tasks.
    """

    def counted(edges: DataFrame) -> tuple[int, object]:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def lowered(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
        met = met_by_key(edges, cut(least, "least"), "a") if many else edges.join(least, "a")
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, counted(edges)
    while before != now and now[0]:
        many = 2 * now[0] > HOT_ROWS
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = lowered(both.where("b > a"), least, many).distinct()
        large = cut(large, "large") if many else large
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        edges = cut(lowered(large, down, many).unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, counted(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def grouped(docs: DataFrame, words: int, percent: int, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (id, rank, text): (id, n, sid) of each row, and of each class (sid, copies, root, rank, id), the last two of its first row by rank, nulls last."""
    rows = cut(signatures(docs, words), "signatures")
    with scratch(docs.sparkSession):
        first = F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", "id")).alias("f")
        own = [F.first(c).alias(c) for c in ("n", "sig", "keys")]  # the same in all rows of a class
        classes = cut(rows.where("sid is not null and id is not null").groupBy("sid").agg(first, *own, F.count("*").alias("copies")).select("sid", "f.rank", "f.id", "n", "sig", "keys", "copies"), "classes")
        found = _linked(docs, classes, words, percent, BLOCK if block is None else block)
        named = classes.join(found.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "copies", F.coalesce("root", "sid").alias("root"), "rank", "id")
        return rows.select("id", "n", "sid"), cut(named, "named", keep=True)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs; links have 100 * intersection >= percent * union of word shingles."""
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[id_col].cast("long").alias("rank"), docs[text_col].cast("string").alias("text"))
    rows, classes = grouped(docs, words, percent, block)
    with scratch(docs.sparkSession):
        least = cut(classes.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
        labels = cut(met_by_key(classes.select("sid", "copies", "root"), least, "root").select("sid", "copies", "component_id"), "labels", keep=True)
    apart = F.expr("sid is null or id is null")
    out = met_by_key(rows.where(~apart), labels, "sid", "copies").select("id", "n", "component_id")
    out = out.unionByName(rows.where(apart).select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def superfluous(docs: DataFrame, key_col: str, rank_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key) of all rows but the first of each group of near duplicates, by rank, nulls last, then by key; key_col numbers the rows uniquely."""
    docs = docs.select(docs[key_col].cast("long").alias("id"), docs[rank_col].cast("long").alias("rank"), docs[text_col].cast("string").alias("text"))
    rows, classes = grouped(docs, words, percent)
    firsts = classes.groupBy("root").agg(F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", "id")).alias("f")).select(F.col("f.id").alias("id"))
    return rows.where("sid is not null").join(firsts, "id", "left_anti").select(F.col("id").alias("key"))


def _linked(docs: DataFrame, classes: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """(node, root) of all classes that links connect."""
    keys = classes.select("sid", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    bucket = shared.agg(F.max("n")).first()[0] or 0
    star = BANDS * bucket  # no hub has more members
    members = cut(met_by_key(keys, shared, "key", top=bucket), "members")
    weight = members.groupBy("sid").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "sid").groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("hub"), F.count("*").alias("n"))
    hubs = cut(hubs.select("key", F.col("hub.sid").alias("hub"), "n"), "hubs")
    met = cut(met_by_key(members.select("key", "sid"), hubs, "key", top=bucket).where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct(), "met")
    stars = met.groupBy("b").agg(F.count("*").alias("n"))
    one, two = (classes.select(F.col("sid").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab")
    stars = cut(stars.join(two, "b"), "stars")
    likely = (similarity_estimate("sig_a", "sig_b") >= percent / 100 - MARGIN) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = cut(met_by_key(met.join(one, "a"), stars, "b", top=star).where(likely).select("a", "b"), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(classes.select("sid", "id"), "sid")
    links = cut(_confirmed(pairs, stars.select("b", "n"), _sets(docs, cut(wanted, "wanted"), words), percent, star), "links")
    found = components(links)
    more = _links_left_over(docs, met, stars, classes, found, words, percent, block, star)
    return found if more is None else components(more.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _links_left_over(docs: DataFrame, met: DataFrame, stars: DataFrame, classes: DataFrame, found: DataFrame, words: int, percent: int, block: int, star: int) -> DataFrame | None:
    """Links inside the hubs' groups (a: member, b: hub) between classes that links don't connect yet; None if every group is connected."""
    mains = cut(stars.select("b", "n").join(found.select(F.col("node").alias("b"), F.col("root").alias("main")), "b", "left").select("b", "n", F.coalesce("main", "b").alias("main")), "mains")
    roots = met.join(found.select(F.col("node").alias("a"), "root"), "a", "left").join(classes.select(F.col("sid").alias("a"), F.col("n").alias("size")), "a")
    group = met_by_key(roots, mains, "b", top=star).select(F.col("b").alias("hub"), F.col("a").alias("sid"), "size", F.coalesce("root", "a").alias("root"), "main")
    group = cut(group, "group")
    held = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_SHINGLES) / F.max("size"))))  # classes of a block
    outside = F.count(F.when(F.col("root") != F.col("main"), 1))
    mixed = group.groupBy("hub").agg(F.ceil(outside / held).cast("int").alias("lefts"), F.ceil(F.count("*") / held).cast("int").alias("rights"), F.count("*").alias("n")).where("lefts > 0 and n > 1")
    mixed = cut(mixed, "mixed")
    if mixed.isEmpty():
        return None
    rest = cut(met_by_key(group, mixed, "hub", top=star).join(classes.select("sid", "sig"), "sid"), "rest")
    share = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rest.where("root <> main").select("hub", share("lefts", 1).alias("l"), every("rights").alias("r"), F.lit(True).alias("is_left"), "sid", "root", "size", "sig")
    right = rest.select("hub", every("lefts").alias("l"), share("rights", 2).alias("r"), F.lit(False).alias("is_left"), "sid", "root", "size", "sig")

    def sides(table: pa.Table) -> tuple[pa.Table, pa.Table]:
        mask = table.column("is_left")
        return table.filter(mask), table.filter(pc.invert(mask))

    def sift(table: pa.Table) -> pa.Table:
        """The rows of a block that may have a link with another component, without their signatures."""
        parts = sides(table)
        if not all(p.num_rows for p in parts):
            return table.slice(0, 0).drop_columns(["size", "sig"])
        signs, sizes, roots = ([np.array(p.column(c).to_pylist(), t) for p in parts] for c, t in (("sig", np.int64), ("size", np.int64), ("root", object)))
        likely = likely_matrix(*signs, percent) & (roots[0][:, None] != roots[1][None, :])
        a, b = sizes[0][:, None], sizes[1][None, :]
        likely &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        return pa.concat_tables([p.filter(pa.array(likely.any(axis=k))) for k, p in zip((1, 0), parts)]).drop_columns(["size", "sig"])

    def compare(table: pa.Table) -> pa.Table:
        parts = sides(table)
        out = []
        if all(p.num_rows for p in parts):
            sets = [[np.frombuffer(x, np.uint64) for x in p.column("set").to_pylist()] for p in parts]
            names = [list(zip(p.column("sid").to_pylist(), p.column("root").to_pylist())) for p in parts]
            out = connecting(linked_matrix(*sets, percent), *names)
        return pa.table({k: pa.array([x[i] for x in out], pa.binary()) for i, k in enumerate("ab")})

    hopeful = cut(left.unionByName(right).groupBy("hub", "l", "r").applyInArrow(sift, "hub binary, l int, r int, is_left boolean, sid binary, root binary"), "hopeful")
    wanted = cut(hopeful.select("sid").distinct().join(classes.select("sid", "id"), "sid"), "wanted")
    whole = hopeful.join(_sets(docs, wanted, words), "sid")
    return cut(whole.groupBy("hub", "l", "r").applyInArrow(compare, "a binary, b binary"), "links")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words split at ASCII white space, three to a shingle, links at 85 of 100."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
