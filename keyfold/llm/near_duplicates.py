"""Near duplicates by MinHash bands and sequential Bayesian verification.

1. A document's set of word shingles gives a signature of ``BANDS * ROWS`` least hashes. Equal
   sets are one node from here on.
2. Nodes that agree in all rows of a band share a bucket. A bucket elects the member that
   has most company over all its buckets, most often the original of a group of copies, and the
   others are compared with that one: one pair for each member, not one for each two.
3. A pair's signatures are compared a batch at a time. After each batch the posterior of
   its similarity, from a flat prior, is a beta distribution; the pair is dropped once
   the chance that it reaches the threshold is under ``MISS``. What is left is compared
   on the full sets.
4. Links give components. Members of one bucket that are in different ones may still link.
   Similarity's complement is a metric: a member *far* from the elected one, at over twice
   the threshold's distance, cannot link to one that is linked to it. Others, *near* ones,
   are known by what they lack of the elected set and what they add to it. If a set y lacks R
   and adds A, a set x that is not linked to the elected one can link to y only if both
   share over ``(100 R + p A) / (100 + p)`` of these differences, so one at least of any
   ``R + A`` less that many of y's. These, added ones first, are looked up among all
   differences of x. Far members are compared with the free members of their bucket; where
   more than ``CROWD`` are far, with those of them that share a second band; a pair at the
   threshold shares two of 40 but for three chances in a million.

A pair at the threshold shares no bucket with a chance of (1 - 0.8**5)**40, about 1.3e-7.

Defined results: a null text is an empty one, without shingles, and links with nothing. A
text of fewer words than a shingle is one shingle. Rows with the same id and text are
one document, all with its result; rows with one id and different texts are different
nodes, and so are rows without an id; these come after all others, so that an id, if
there is one, names the component. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components
from .frames import SPACES, flat_bytes, flat_words, materialize, numbered, own_names, per_worker, renamed, slices, small_batches, table
from .suffix_dedup import packed

BANDS, ROWS = 40, 5
BATCH = 20  # values of a signature compared at a time
MISS = 1e-8
CROWD = 64
PARTS = 64  # of the rows of one set
MAP_BITS = 1 << 22  # 65,536 rows of 64 bits
_HASHES = BANDS * ROWS


def _salts() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 32, _HASHES, dtype=np.uint32), rng.integers(0, 1 << 31, _HASHES, dtype=np.uint32) * 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same everywhere."""
    coded = words.dictionary_encode()
    different = coded.dictionary
    _, offsets, data = different.buffers()
    if not len(different):
        return np.empty(0, np.uint64)
    bounds = np.frombuffer(offsets, np.int32)[different.offset : different.offset + len(different) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]].astype(np.uint64)
    lengths = np.diff(bounds)
    place = np.arange(len(raw)) - np.repeat(bounds[:-1] - bounds[0], lengths)
    letter = _mixed((raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    sums = np.append(np.uint64(0), np.cumsum(letter))
    return _mixed(sums[bounds[1:] - bounds[0]] - sums[bounds[:-1] - bounds[0]] + lengths.astype(np.uint64))[coded.indices.to_numpy()]


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, ascending, in a row; and each text's bounds."""
    words, cut = flat_words(*flat_bytes(texts), SPACES)
    hashes = _word_hashes(words)
    counts = np.diff(cut)
    first = counts >= n
    sizes = np.where(first, counts - n + 1, np.minimum(counts, 1))
    ends = np.cumsum(sizes)
    at = np.repeat(cut[:-1] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    whole = np.repeat(first, sizes)
    left = np.repeat(cut[1:], sizes) - at
    value = np.zeros(len(at), np.uint64)
    for k in range(n):
        used = k < left
        value = np.where(used, _mixed(value * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] + np.uint64(k)), value)
    value = np.where(whole, value, _mixed(value + left.astype(np.uint64)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(sizes) + 1))


def signatures(texts: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, content, bands, signature) of each text (id, text). ``content`` is a hash of the
    whole set; a text without shingles has no bands. Bands are made of all bits of the least hashes; the
    signature keeps the low byte of each: values that differ agree in it once in 256 times, which can
    only make a pair survive."""
    schema = pa.schema([
        ("id", pa.int64()), ("n_shingles", pa.int64()), ("content", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary()),
    ])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, factor = _salts()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets, bounds = shingle_sets(part["text"], n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                least = np.zeros((len(full), _HASHES), np.uint32)
                content = np.zeros(len(sizes), np.uint64)
                if len(full):
                    heads = bounds[full]
                    short = (sets >> np.uint64(32)).astype(np.uint32)
                    for i in range(_HASHES):
                        least[:, i] = np.minimum.reduceat((short ^ xor[i]) * factor[i], heads)
                    content[full] = _mixed(np.add.reduceat(_mixed(sets), heads) + sizes[full].astype(np.uint64))
                mixed = np.zeros((len(full), BANDS), np.uint64)
                for k in range(ROWS):
                    mixed = _mixed(mixed * np.uint64(31) + least.reshape(-1, BANDS, ROWS)[:, :, k] + np.arange(BANDS, dtype=np.uint64))
                bands: list = [None] * len(sizes)
                raw: list = [None] * len(sizes)
                for j, i in enumerate(full):
                    bands[i], raw[i] = mixed[j].view(np.int64), least[j].astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(sizes), pa.array(content.view(np.int64)), pa.array(bands, schema.field("bands").type), pa.array(raw, pa.binary())], schema=schema
                )

    return small_batches(texts).mapInArrow(sign, "id long, n_shingles long, content long, bands array<long>, signature binary")


def chance(matches: int, compared: int, similarity: float) -> float:
    """The posterior chance that the similarity is at least this, from a flat prior: a beta
    distribution's upper tail, which is a binomial's lower one."""
    n = compared + 1
    return sum(math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k) for k in range(matches + 1))


def least_matches(compared: int, similarity: float) -> int:
    """Fewer matches than this and the pair is dropped."""
    found = lambda: next((m for m in range(compared + 1) if chance(m, compared, similarity) >= MISS), compared + 1)
    return per_worker(("matches", compared, similarity, MISS), found)


def compare(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signatures: which survive all batches, and which may be so near that a
    third node links to both. A pair is compared until it can be neither."""
    wide = max(0.0, 1 - 2 * (1 - similarity))
    alive, matched = np.arange(len(a)), np.zeros(len(a), np.int64)
    survive, near = np.ones(len(a), bool), np.zeros(len(a), bool)
    for end in range(BATCH, _HASHES + 1, BATCH):
        matched = matched + (a[alive, end - BATCH : end] == b[alive, end - BATCH : end]).sum(1)
        survive[alive[matched < least_matches(end, similarity)]] = False
        good = matched >= least_matches(end, wide)
        alive, matched = alive[good], matched[good]
    near[alive] = True
    return survive & near, near


def compared(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) with ``survive`` and ``near``."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("survive", pa.bool_()), ("near", pa.bool_())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint8).reshape(-1, _HASHES) for k in ("one", "two"))
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *map(pa.array, compare(one, two, similarity))], schema=schema)

    own = materialize(among(signed.select("id", "signature"), ends(pairs)), "signatures")
    one = own.select(F.col("id").alias("a"), F.col("signature").alias("one"))
    two = own.select(F.col("id").alias("b"), F.col("signature").alias("two"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return both.mapInArrow(check, "a long, b long, survive boolean, near boolean")


def ends(pairs: DataFrame) -> DataFrame:
    """The ids that stand in pairs, as often as they do."""
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows whose id is one of ``ids``, and few others: by a map of ``MAP_BITS`` bits, which is
    all that goes to the tasks. What is not wanted is left out before it is shuffled."""
    place = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    words = ids.select(place.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("__word")).agg(F.bit_or(bit(F.col("at"))).alias("__bits"))
    held = rows.join(F.broadcast(materialize(words, "map")), F.floor(place / 64) == F.col("__word"))
    return held.where(F.col("__bits").bitwiseAND(bit(place)) != 0).drop("__word", "__bits")


def _paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, one, two): pairs with both texts, packed."""
    small = materialize(packed(among(texts, ends(pairs))), "packed")
    one = small.select(F.col("id").alias("a"), F.col("z").alias("one"))
    two = small.select(F.col("id").alias("b"), F.col("z").alias("two"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "one", "two")


_EXACT = pa.schema([
    ("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("some", pa.list_(pa.int64())), ("all", pa.list_(pa.int64())),
    ("size", pa.int64()), ("lacked", pa.int64()), ("added", pa.int64()),
])


def exact(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) compared on the full sets: ``linked``, and the differences of a from b:
    ``some``, of which a free node must share one to link to a, and ``all``; the size
    of b, and how much a lacks of it and adds to it."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()

        def shingles(z: pa.Scalar) -> np.ndarray:
            return shingle_sets(pa.array([press.decompress(z.as_py()).decode()]), n)[0]

        last, theirs = None, np.empty(0, np.uint64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            every, needs = [], []
            names = batch["b"].to_pylist()
            for i, b in enumerate(names):
                if b != last:
                    last, theirs = b, shingles(batch["two"][i])
                own = shingles(batch["one"][i])
                known = np.isin(own, theirs, assume_unique=True)
                common = int(known.sum())
                linked = 100 * common >= percent * (len(own) + len(theirs) - common)
                added, lacked = own[~known], ~theirs[~np.isin(theirs, own, assume_unique=True)]
                both = np.concatenate([added, lacked]).view(np.int64)
                every.append(both)
                needs.append((100 * len(lacked) + percent * len(added)) // (100 + percent))
                out[0].append(linked)
                out[2].append(both)
                for column, count in zip(out[3:], (len(theirs), len(lacked), len(added))):
                    column.append(count)
            # Of the differences that are enough, those that fewest neighbours in this batch share.
            for _, star in itertools.groupby(range(len(names)), names.__getitem__):
                star = list(star)
                value, place, times = np.unique(np.concatenate([every[i] for i in star]), return_inverse=True, return_counts=True)
                for i, often in zip(star, np.split(times[place], np.cumsum([len(every[i]) for i in star])[:-1])):
                    out[1].append(every[i][np.argsort(often, kind="stable")[: len(every[i]) - needs[i]]])
            columns = [pa.array(c, f.type) for c, f in zip(out, list(_EXACT)[2:])]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *columns], schema=_EXACT)

    return _paired(pairs, texts).mapInArrow(check, "a long, b long, linked boolean, some array<long>, all array<long>, size long, lacked long, added long")


def related(found: DataFrame, company: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share differences from one elected node, and that may be
    at the threshold by their counts: they have at most all of it but what one of them lacks in
    common, and of what they add the smaller part.

    A node's first star is that of the elected node with most company that it is near to.
    Two nodes with the same first star meet there, and in no other star that both are in.
    """
    name = lambda k: labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    first = found.join(company.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.max(F.struct("company", "b")).alias("m"))
    known = materialize(found.join(first.select("a", F.col("m.b").alias("star")), "a"), "stars")
    rank = F.struct(F.size("some"), "a")
    free = known.where("not linked").select(F.col("a").alias("x"), "b", F.col("star").alias("sx"), rank.alias("rx"), F.struct("size", "lacked", "added").alias("wx"), F.explode("all").alias("d"))
    # Two free nodes meet once: by the differences of the one that has fewer to be looked up.
    ry = F.when(~F.col("linked"), rank).alias("ry")
    each = known.select(F.col("a").alias("y"), "b", F.col("star").alias("sy"), ry, F.struct("lacked", "added").alias("wy"), F.explode("some").alias("d"))
    common = F.expr("wx.size - greatest(wx.lacked, wy.lacked) + least(wx.added, wy.added)")
    both = F.expr("2 * wx.size - wx.lacked + wx.added - wy.lacked + wy.added")
    met = F.expr("x <> y and (sx <> sy or sx = b) and (ry is null or ry < rx)")
    here = free.join(each, ["b", "d"]).where(met & (100 * common >= percent * (both - common))).groupBy("x", "y").agg(F.min("b").alias("star"))
    pairs = here.join(name("x"), "x", "left").join(name("y"), "y", "left")
    apart = F.coalesce("cx", "x") != F.coalesce("cy", "y")
    return pairs.where(apart).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), "star")


def exact_by_star(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, star) that link. Both sets are known in full: the star's, without what
    is lacked and with what is added; what both lack or both add they have in common."""
    names = ("lacked", "added", "all")
    one, two = (found.select(F.col("a").alias(k), F.col("b").alias("star"), "size", F.struct(*names).alias(f"of_{k}")) for k in "ab")
    both = pairs.join(one, ["a", "star"]).join(two.drop("size"), ["b", "star"])
    common = F.expr("size - of_a.lacked - of_b.lacked + size(array_intersect(of_a.all, of_b.all))")
    total = F.expr("2 * size - of_a.lacked + of_a.added - of_b.lacked + of_b.added")
    return both.where(100 * common >= percent * (total - common)).select("a", "b")


def far_pairs(members: DataFrame, labels: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one bucket of which one is far from its elected node."""
    how = stars.select(F.col("a").alias("id"), F.col("b").alias("pivot"), "linked", "near")
    free = members.join(how, ["id", "pivot"]).where("not linked").join(labels, "id", "left")
    free = free.select("bucket", "id", "n_shingles", F.coalesce("component", "id").alias("component"), (~F.col("near")).alias("far"))
    some = free.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("far").cast("int")).alias("n_far")).where("n_far > 0 and n > 1")
    rows = materialize(free.join(some, "bucket"), "far")
    few = rows.where(f"n_far <= {CROWD}")
    second = members.select("id", F.col("bucket").alias("other"))
    many = rows.where(f"n_far > {CROWD}").join(second, "id").where("other <> bucket").withColumn("bucket", F.xxhash64("bucket", "other"))

    def pairs(rows: DataFrame) -> DataFrame:
        x, y = (rows.select("bucket", *(F.col(c).alias(c + k) for c in ("id", "component", "n_shingles", "far"))) for k in "xy")
        far = x.where("farx").join(y, "bucket").where("(idx > idy or not fary) and componentx <> componenty")
        fits = far.where(f"100 * least(n_shinglesx, n_shinglesy) >= {percent} * greatest(n_shinglesx, n_shinglesy)")
        return fits.select(F.greatest("idx", "idy").alias("a"), F.least("idx", "idy").alias("b"))

    return pairs(few).unionByName(pairs(many))


def nodes(sets: DataFrame) -> DataFrame:
    """(id, n_shingles, node): the smallest id with the same set, by parts, as one set may have
    any number of rows; a text without shingles is a node of its own."""
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")
    full = sets.where("n_shingles > 0").select("id", "content", "n_shingles", part)
    parts = full.groupBy("content", "n_shingles", "part").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    whole = parts.groupBy("content", "n_shingles").agg(F.min("least").alias("node"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    several = parts.join(whole, ["content", "n_shingles"]).select("content", "n_shingles", "part", "node")
    rows = sets.select("id", "n_shingles", "content", part)
    return rows.join(several, ["content", "n_shingles", "part"], "left").select("id", "n_shingles", F.coalesce("node", "id").alias("node"))


def linked_components(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n_shingles, component) of every text (id, text); ids are unique and not null."""
    similarity = percent / 100
    signed = materialize(signatures(texts, n), "signatures")
    node = materialize(nodes(signed.select("id", "n_shingles", "content")), "nodes")
    own = node.where("id = node and n_shingles > 0").select("id")
    signed = materialize(signed.join(own, "id", "left_semi").select("id", "n_shingles", "bands", "signature"), "sets")
    spread = signed.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(spread.join(shared, "bucket"), "members")
    company = materialize(members.groupBy("id").agg(F.sum("n").alias("company")), "company")
    elected = members.join(company, "id").groupBy("bucket").agg(F.max(F.struct("company", "id")).alias("e"))
    members = materialize(members.join(elected.select("bucket", F.col("e.id").alias("pivot")), "bucket"), "members")
    stars = members.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    checked = materialize(compared(stars, signed, similarity), "compared")
    found = materialize(exact(checked.where("near"), texts, n, percent), "exact")
    labels = components(found.where("linked"))
    status = checked.join(found.where("linked").select("a", "b", "linked"), ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    far = far_pairs(members, labels, status, percent).withColumn("star", F.lit(None).cast("long"))
    more = materialize(related(found, company, labels, percent).unionByName(far).groupBy("a", "b").agg(F.min("star").alias("star")), "more")
    again = materialize(compared(more, signed, similarity).where("survive").select("a", "b"), "compared")
    if again.take(1):
        again = materialize(again.join(more, ["a", "b"]), "again")
        late = exact(again.where("star is null").select("a", "b"), texts, n, percent).where("linked").select("a", "b")
        late = late.unionByName(exact_by_star(again.where("star is not null"), found, percent))
        labels = components(found.where("linked").select("a", "b").unionByName(late))
    named = labels.select(F.col("id").alias("node"), "component")
    return node.join(named, "node", "left").select("id", "n_shingles", F.coalesce("component", "node").alias("component"))


def near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Every document with n_shingles, component_id, the smallest id that it can reach over
    links, and ``kept``: whether that is its own."""
    texts, numbers = numbered(documents)
    if numbers is not None:
        texts = materialize(texts, "texts")
    found = linked_components(texts, shingle_words, percent)
    if numbers is None:
        found = found.withColumn("component_id", F.col("component"))
        kept = F.col("id") == F.col("component")
    else:
        names = numbers.select(F.col("id").alias("component"), F.col("doc_id").alias("component_id"))
        found = found.join(names, "component")
        kept = F.col("id") == F.col("component")
    return renamed(documents, found.select("id", "n_shingles", "component_id", kept.alias("kept")), numbers)


@own_names
def without_near_duplicates(documents: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns."""
    texts, numbers = numbered(documents)
    if numbers is None:
        kept = linked_components(texts, shingle_words, percent).where("id = component").select("id")
        return documents.join(kept, documents["doc_id"].cast("long") == kept["id"], "left_semi")
    kept = linked_components(materialize(texts, "texts"), shingle_words, percent).where("id = component").select("id")
    kept = kept.join(numbers, "id").select(F.col("doc_id").alias("__doc"), F.col("hash").alias("__hash"))
    text = F.col("text").cast("string")
    keyed = documents.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(text, F.length(text))})
    found = keyed.join(kept, F.col("__id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__hash")), "left_semi")
    return found.dropDuplicates(["__id", "__key"]).drop("__id", "__key")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by sets of two-word shingles that are alike by at least 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")
