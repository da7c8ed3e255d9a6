"""Near-duplicates by b-bit MinHash.

Signatures keep some bits of a mix of the minima, packed into 64-bit words; the share
of equal lanes, corrected for chance equality, estimates the similarity. Bands
over the full minima give candidates. Every link is confirmed on full sets.

Work stays linear in a bucket: copies with equal sets are one class from the
start, every class is compared with its best few bucket leaders, and after the
components of those links are known only pairs across components are left.
For those a second, wider signature of one bit a lane narrows the estimate, and
a pair is named in the first bucket that it shares and in no other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows, materialise

SHINGLE = 5
BANDS, ROWS = 32, 4
BITS = 4
#: How far an estimate may lie below the threshold before a pair is not confirmed; over five standard deviations.
SLACK = 0.2
#: Bucket leaders that a class is compared with in a round, and rounds.
LEADERS, LEADER_ROUNDS = 2, 3
#: Lanes of one bit for pairs that leaders did not settle, and the slack that goes with them; 4.8 standard deviations.
WIDE_LANES, WIDE_SLACK = 2048, 0.07
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


#: Bytes that a task's table of hashed words holds at most, about.
WORD_BYTES = 32 << 20


class WordHashes(dict):
    """word -> 64-bit hash; begins anew when it holds ``most`` bytes."""

    def __init__(self, most: int = WORD_BYTES) -> None:
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        self.held += 150 + len(word)
        if self.held > self.most:
            self.clear()
            self.held = 0
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, n: int = SHINGLE, known: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``n`` words.

    A-Z are lower-cased and words parted by ASCII white space, as bytes.lower
    and bytes.split do. Fewer words than ``n`` make one shingle; none, no shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map((WordHashes() if known is None else known).__getitem__, words)), np.uint64)
    m = min(n, len(words))
    out = np.full(len(h) - m + 1, np.uint64(m))
    for k in range(m):
        out += _mixed(h[k : len(h) - m + 1 + k] ^ _FACTORS[k % len(_FACTORS)]) * _FACTORS[k % len(_FACTORS)]
    return np.unique(_mixed(out))


def parameters(lanes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 1 << 32, lanes, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, lanes, np.uint32)


def minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set of 64-bit hashes (not empty)."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        low = np.minimum(low, (x[i : i + 2048, None] * a + b).min(axis=0))
    return low


def lane_bits(low: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of a mix of each whole minimum.

    The low bits of x * a + b depend on those of x alone, whatever the lane, so they are no draws of their own.
    """
    return _mixed(low.astype(np.uint64)) >> np.uint64(64 - bits)


def fingerprint(sets: np.ndarray) -> bytes | None:
    """16 bytes that name a set; None for the empty set."""
    return xxhash.xxh3_128_digest(sets.tobytes()) if len(sets) else None


def signature(df: DataFrame, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """Append n_shingles, fp (16 bytes that name the set), sig (array of packed longs) and bands (array of longs).

    Texts without words get n_shingles 0 and nulls. Columns of these names are replaced. No shuffle.
    """
    at, lanes = df.columns.index(text), BANDS * ROWS
    per = 64 // BITS

    def make():
        a, b = parameters(lanes)
        shift = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
        salt = np.arange(1, BANDS + 1, dtype=np.uint64)
        known = WordHashes()

        def fn(batch: pa.RecordBatch):
            sizes, prints, sigs, bands = [], [], [], []
            for t in batch.column(at).to_pylist():
                s = shingles(t, n, known)
                sizes.append(len(s))
                prints.append(fingerprint(s))
                if not len(s):
                    sigs.append(None), bands.append(None)
                    continue
                low = minima(s, a, b)
                packed = (lane_bits(low, BITS).reshape(-1, per) << shift).sum(axis=1, dtype=np.uint64)
                sigs.append(packed.view(np.int64))
                h = salt
                for row in low.reshape(BANDS, ROWS).T:
                    h = _mixed(h * _FACTORS[0] + row)
                bands.append(h.view(np.int64))
            return [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]

        return fn

    longs = T.ArrayType(T.LongType())
    return map_rows(df, make, [field("n_shingles", T.LongType()), field("fp", T.BinaryType()), field("sig", longs), field("bands", longs)], text)


def similarity(x: Column, y: Column) -> Column:
    """Estimated similarity of two packed signatures: equal lanes, corrected for equality by chance."""
    words, per = BANDS * ROWS * BITS // 64, 64 // BITS
    ones = sum(1 << (BITS * i) for i in range(per))
    ones -= (1 << 64) if ones >= 1 << 63 else 0
    different = None
    for k in range(words):
        d = x[k].bitwiseXOR(y[k])
        step = 1
        while step < BITS:
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
            step *= 2
        n = F.bit_count(d.bitwiseAND(F.lit(ones)))
        different = n if different is None else different + n
    equal = 1 - different / (words * per)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _wide(sets: DataFrame) -> DataFrame:
    """Append w0, w1, ...: a bit of each of WIDE_LANES minima of the sets ``s``, 64 to a column."""
    at = sets.columns.index("s")

    def make():
        a, b = parameters(WIDE_LANES)

        def fn(batch: pa.RecordBatch):
            low = [lane_bits(minima(np.frombuffer(x.as_py(), np.uint64), a, b), 1).astype(np.uint8) for x in batch.column(at)]
            packed = np.packbits(np.array(low, np.uint8).reshape(-1, WIDE_LANES), axis=1).view(np.int64)
            return [pa.array(np.ascontiguousarray(column)) for column in packed.T]

        return fn

    return map_rows(sets, make, [field(w, T.LongType()) for w in WIDE_WORDS], "s")


WIDE_WORDS = [f"w{i}" for i in range(WIDE_LANES // 64)]


def _wide_similarity(x: DataFrame, y: DataFrame) -> Column:
    """Estimated similarity of two wide signatures: equal bits, corrected for equality by chance."""
    different = None
    for w in WIDE_WORDS:
        n = F.bit_count(x[w].bitwiseXOR(y[f"{w}b"]))
        different = n if different is None else different + n
    return 1 - 2 * different / WIDE_LANES


#: Members of a bucket that one step of the pairwise comparison holds on a side; larger buckets are cut into blocks.
BLOCK = 4096


def _open_pairs(split: DataFrame, wide: DataFrame, least: float) -> DataFrame:
    """(a, b) of every two ids that share a bucket, lie in different components and have an estimate of ``least`` or more.

    ``split``: id, h, c; ``wide``: id and the words of its signature. All buckets
    of an id travel with its rows, so that the smallest common bucket alone names a pair.
    A bucket is dealt into blocks of about BLOCK ids, and every two blocks meet under a key of their own,
    so a hot bucket is the work of many tasks.
    """
    words = [F.coalesce(w, F.lit(0)).alias(w) for w in WIDE_WORDS]
    buckets = split.groupBy("id").agg(F.sort_array(F.collect_set("h")).alias("all"))
    sizes = materialise(split.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    placed = split.join(sizes, "h").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = placed.join(buckets.join(wide, "id").select("id", "all", *words), "id").select("id", "h", "c", "i", "blocks", "all", *WIDE_WORDS)
    left = rows.withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1))).drop("blocks")
    right = rows.withColumn("j", F.col("i")).withColumn("i", F.explode(F.sequence(F.lit(0), "j"))).drop("blocks")
    right = right.select(*[F.col(c).alias(f"{c}b") for c in right.columns])
    met = (left["h"] == right["hb"]) & (left["i"] == right["ib"]) & (left["j"] == right["jb"]) & (left["c"] != right["cb"])
    once = (left["i"] < left["j"]) | (left["id"] < right["idb"])
    near = left.join(right, met & once & (_wide_similarity(left, right) >= least) & (F.array_min(F.array_intersect(left["all"], right["allb"])) == left["h"]))
    return near.select(F.least("id", "idb").alias("a"), F.greatest("id", "idb").alias("b"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. ``sets``: id, s (sorted hashes, binary)."""
    joined = pairs.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def smallest_reachable(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b): the smallest id that is reachable.

    Each round every node takes the smallest label around it and then the label
    of its label, so long chains shorten by halves. Rounds are cut by
    written tables; only the number of changed labels comes to the driver.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both)
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "id"))
    for _ in range(most):
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy("a").agg(F.min("c").alias("m")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", "c", F.least("c", "m").alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("c").alias("j"))
        after = materialise(hooked.join(jump, "m", "left").select("id", F.least("m", F.coalesce("j", "m")).alias("n"), "c"))
        labels = after.select("id", F.col("n").alias("c"))
        if after.where(F.col("n") != F.col("c")).isEmpty():
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")


def _unsettled(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows (id, h, c) of the buckets that hold more than one component ``c``.

    Buckets are summed up and written before they are joined back, here and below: a written table of known size is broadcast
    where it is small, and beyond that both sides come straight from a shuffle, so that AQE can split a hot bucket.
    """
    named = shared.withColumn("c", F.col("id")) if labels is None else shared.join(labels, "id", "left").select("id", "h", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
    return named.join(materialise(mixed), "h")


def _with_leaders(rows: DataFrame, signs: DataFrame, likely: float) -> DataFrame:
    """Pairs (a, b) of each member with leaders of its buckets in other components: the LEADERS likeliest for each member.

    A bucket's leader is the member that meets most others over all its buckets,
    so a text that many copies were made from leads nearly all of theirs. ``signs``: id, sig.
    """
    rows = materialise(rows)
    sized = materialise(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    degree = rows.join(sized, "h").groupBy("id").agg(F.sum("n").alias("degree"))
    lead = rows.join(degree, "id").groupBy("h").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), F.col("c").alias("lc"))).alias("lead"))
    met = rows.join(materialise(lead), "h").where(F.col("c") != F.col("lead.lc")).select("id", (-F.col("lead.minus")).alias("to")).distinct()
    signed = met.join(signs, "id").join(signs.select(F.col("id").alias("to"), F.col("sig").alias("lead_sig")), "to")
    pairs = signed.select("id", "to", similarity(F.col("sig"), F.col("lead_sig")).alias("est")).where(F.col("est") >= likely)
    best = W.partitionBy("id").orderBy(F.desc("est"), "to")  # BANDS rows at most
    chosen = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LEADERS)
    return chosen.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(id, component) after ``edges`` (a, b) joined more ids or components."""
    if labels is None:
        return smallest_reachable(edges)
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct()
    moved = smallest_reachable(ends).select(F.col("id").alias("component"), F.col("component").alias("final"))
    all_ids = labels.unionByName(moved.select(F.col("component").alias("id"), "component").join(labels, "id", "left_anti"))
    return materialise(all_ids.join(moved, "component", "left").select("id", F.coalesce("final", "component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 75, text: str = "text", n: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, group_id of every row, and the columns in ``carry``.

    Rows whose shingle sets have a similarity of ``percent`` % or more are linked; group_id names the rows
    that are reachable over links, and component_id is the smallest doc_id among them, itself included. Texts that are null,
    empty or without words link with nothing: they keep their own doc_id and have a null group_id.
    Every row is a document of its own: rows that repeat a doc_id are linked by their texts alone, and rows with a null doc_id
    take part (component_id is null where no member has an id). Other columns of ``docs`` are ignored. All pairs that
    share a band bucket and are not yet connected are decided exactly.
    """
    spark = docs.sparkSession
    signed = materialise(signature(docs.select("doc_id", text, *carry), text, n).drop(text))
    # one row per set, copies summed up where they lie; a set's number is written once, so it stays
    with_words = signed.where("fp is not null")
    classes = with_words.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    heads = materialise(classes.withColumn("id", F.monotonically_increasing_id()))
    signs = heads.select("id", "sig")
    rows = heads.select("id", F.posexplode("bands").alias("k", "band")).select("id", F.xxhash64("k", "band").alias("h"))
    several = rows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    shared = materialise(rows.join(materialise(several), "h").select("id", "h"))
    likely = percent / 100 - SLACK

    def pack(texts: DataFrame) -> DataFrame:
        def make():
            known = WordHashes()

            def fn(batch: pa.RecordBatch):
                sets = [shingles(t, n, known) for t in batch.column(1).to_pylist()]
                return [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([fingerprint(x) for x in sets], pa.binary())]

            return fn

        return map_rows(texts.select("doc_id", text), make, [field("s", T.BinaryType()), field("fp", T.BinaryType())], text, (text,))

    def sets_named(ids: DataFrame) -> DataFrame:
        """Full sets of the ids, made again from the texts of one document each."""
        wanted = materialise(heads.select("id", "fp", F.col("doc_id").alias("d")).join(ids.distinct(), "id", "left_semi"))
        texts = docs.select("doc_id", text)
        texts = texts.join(wanted.select("d").distinct(), texts["doc_id"].eqNullSafe(F.col("d")), "left_semi")
        return pack(texts).select("fp", "s").join(wanted.select("id", "fp"), "fp").dropDuplicates(["id"]).select("id", "s")

    labels, tested = None, None
    for _ in range(LEADER_ROUNDS):
        star = _with_leaders(_unsettled(shared, labels), signs, likely)
        star = materialise((star if tested is None else star.join(tested, ["a", "b"], "left_anti")))
        if star.isEmpty():
            break
        tested = star if tested is None else tested.unionByName(star)
        labels = _merged(labels, materialise(confirm(star, materialise(sets_named(star.select(F.explode(F.array("a", "b")).alias("id")))), percent)))

    # what is left: pairs of one bucket that are in different components and were not compared
    split = materialise(_unsettled(shared, labels).distinct())
    if not split.isEmpty():
        sets = materialise(_wide(sets_named(split.select("id"))))
        rest = _open_pairs(split, sets.drop("s"), percent / 100 - WIDE_SLACK).distinct()
        rest = materialise((rest if tested is None else rest.join(tested, ["a", "b"], "left_anti")))
        if not rest.isEmpty():
            labels = _merged(labels, materialise(confirm(rest, sets.select("id", "s"), percent)))
    found = labels if labels is not None else spark.createDataFrame([], "id long, component long")
    grouped = heads.select("id", "fp", "doc_id").join(found, "id", "left").withColumn("group_id", F.coalesce("component", "id"))
    smallest = grouped.groupBy("group_id").agg(F.min("doc_id").alias("component_id"))
    named = grouped.select("fp", "group_id").join(materialise(smallest), "group_id")  # a large group is no one task's work
    out = signed.select("doc_id", "n_shingles", "fp", *carry).join(named, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "group_id", *carry)
