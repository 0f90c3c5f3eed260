"""Exact Jaccard self-join on word shingles by partitioned universes and the pigeonhole principle.

Similar sets (100 * intersection >= percent * union) of sizes up to u differ in at most H(u) members. Sizes fall into bands. A
band's scheme hashes the universe of shingles into m = H + 1 segments, so two similar sets agree on all of some segment. A set
is indexed under its own band's scheme and probes that scheme and, if its size allows, the next band's.

Where they agree on a segment with next to no members, that says little, so the principle is taken further: with the segments
in a ring, some segment agrees and the one after it differs in at most one member. For such segments the signature holds the
next segment as well, in a one-deletion neighbourhood: the next segment, and the next segment less any one member. A cost
model allocates neighbourhoods: a segment of few members is shared by many sets, a neighbourhood costs a row a member of the
next segment; both sides decide alike, since they agree on the segment. Where nothing is left of the next segment either, the one
after it joins in, less up to two members (three segments in a row differ in at most two).

From there on no step emits all pairs of a group:
* equal sets are one class, by a 128-bit key; classes with their least id, size and parity sketch are a written table;
* one part of the universe says how far a class is from all others: a shingle there that no other class has is in no
  intersection, so a class with too many of them is similar to none and is done with;
* every task keeps, for each signature, one row of its batch as a hub and turns others into (signature, member, hub) rows, so
  a frequent signature reaches its owner as one row a batch; the owner makes stars of those in the same way, in one pass.
  Rows name a class by the first 64 bits of its key: should two classes share those, both are looked at, and compared;
* (member, hub) pairs are dropped where the sketches differ in more bits than similar sets can; of the others, first one pair
  a member, then those between different components, are compared shingle by shingle;
* signatures whose members are still in several components are finished pair by pair where they have up to ``DIRECT_ROWS``
  members. Classes under larger ones go through the same steps again under an independent partition of the universe, where
  what was shared by chance is not;
* what is left after ``LEVELS`` partitions is dense, and finished by blocks of ``BLOCK_ROWS`` classes in order of region: each
  two blocks that share a signature are compared once, by sketch, and survivors by shingles.
So each two classes that share a signature are in one component or have been compared: no link between different texts is lost.

Shingles are compared as 64-bit hashes. Defined results: null and empty texts have no shingles and are linked with nothing;
rows with equal text are linked whatever their ids; a null id is greater than all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.shared import emptied, shuffles_end, small, written
from lodestone.llm.shingles import U, each_text, key_of, mix, shingle_set, sketch_of

BLOCK_ROWS = 128
DIRECT_ROWS = 64
SIGNED_ROWS = 500_000  #: signatures that a task combines at a time
EXPECTED, SHRINK, NEXT = 100.0, 64.0, 6.0  #: cost model: rows that sharing an empty segment costs; a member more divides by SHRINK; members of a next segment
LEVELS = 2


class Bands:
    """Size bands of a threshold in percent, and their schemes. Made up to a size when that is met first."""

    def __init__(self, percent: int, seed: int = 0):
        self.percent = percent
        self.seed = 100 * seed  #: of the partition of the universe
        self.width = 3 if percent >= 90 else 2  #: wide bands need fewer probes, but smaller segments
        self.lows = [self.smallest()]
        self.made: dict[int, int] = {}
        self.tags: dict[int, np.ndarray] = {}

    def overlap(self, total: int) -> int:
        """The least intersection of similar sets with that sum of sizes: (100 + p) * i >= p * total."""
        return -(-self.percent * total // (100 + self.percent))

    def apart(self, a: int, b: int) -> int:
        """Most members in which similar sets of these sizes differ; negative if such sets can't be similar."""
        i = self.overlap(a + b)
        return a + b - 2 * i if i <= min(a, b) else -1

    def smallest(self) -> int:
        """Below this size, similar sets are equal."""
        n = 1
        while self.apart(n, n + 1) < 0:
            n += 1
        return n

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            low, top = self.lows[-1], self.lows[-1]
            for _ in range(self.width):
                top = top * 100 // self.percent + 1
            self.lows.append(max(low + 1, top))
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def scheme(self, band: int) -> int:
        """The number of segments."""
        if band not in self.made:
            most = 2 * (self.band_low(band + 1) - 1)
            self.made[band] = 1 + max(s - 2 * self.overlap(s) for s in range(max(2, most - 40), most + 1))
        return self.made[band]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Signatures of a set under its own band's scheme and, if larger similar sets may be in the next band, under that one's."""
        n = len(s)
        if n < self.lows[0]:
            return np.zeros(0, np.int64)
        own = self.band(n)
        place, value = mix(s, 21 + self.seed), mix(s, 22)
        out = [self._of(place, value, own)]
        if self.apart(n, max(n, self.band_low(own + 1))) >= 0:
            out.append(self._of(place, value, own + 1))
        return np.concatenate(out)

    def band_low(self, band: int) -> int:
        while len(self.lows) < band + 2:
            self.band(self.lows[-1])
        return self.lows[band]

    def _of(self, place: np.ndarray, value: np.ndarray, band: int) -> np.ndarray:
        m = self.scheme(band)
        if band not in self.tags:
            self.tags[band] = mix(np.arange(m, dtype=np.uint64) + U(band << 32), 23)
        tag = self.tags[band]
        place = (place % U(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        value = value[order]
        count = np.bincount(place, minlength=m)
        upto = np.r_[U(0), np.cumsum(value, dtype=np.uint64)]
        stop = np.cumsum(count)
        sums = upto[stop] - upto[stop - count]
        thin = (EXPECTED / SHRINK ** np.minimum(count, 9.0) > NEXT) & (m > 4)
        out = [mix(sums[~thin] + tag[~thin], 24)]
        i = np.flatnonzero(thin)
        j, root = (i + 1) % m, mix(sums[i] + tag[i], 25)
        more = count[j] > 1
        c, whole = count[j[more]], sums[j[more]]
        members = np.repeat(stop[j[more]] - np.cumsum(c), c) + np.arange(c.sum())
        out.append(mix(whole ^ root[more], 26))
        out.append(mix((np.repeat(whole, c) - value[members]) ^ np.repeat(root[more], c), 26))
        for x, r in zip(j[~more], root[~more, None], strict=True):
            # what is left of the next segment may be empty: the one after that joins in, where the two differ in at most two members
            k = (x + 1) % m
            one = value[stop[k] - count[k] : stop[k]]
            two = (one[:, None] + one)[two_of(int(count[k]))]
            out.append(mix((sums[k] - np.r_[U(0), one, two]) ^ mix(r, 27), 28))
            out.append(mix(sums[x : x + 1] ^ r, 26)[: count[x]])
        return np.concatenate(out).view(np.int64)


@lru_cache(64)
def two_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _rows(cols: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n, k1, k2, sketch of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, sketch = [], [], [], []
            for data in each_text(b, 1):
                s = shingle_set(data, words)
                key = key_of(s)
                n.append(len(s)), k1.append(key[0]), k2.append(key[1]), sketch.append(sketch_of(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketch, pa.binary())], ["id", "n", "k1", "k2", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n long, k1 long, k2 long, sketch binary")


def stars(found: DataFrame, words: int, percent: int, seed: int = 0) -> DataFrame:
    """Rows (sig, k, h): class k and hub h, by their labels, share a signature. ``found`` is of ``Texts.found``."""
    names, schema = ["sig", "k", "h"], "sig long, k long, h long"

    def combined(sig: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        """A batch's rows, distinct; where a signature repeats, the first row stays (its hub is 0) and others become members of it."""
        order = np.lexsort((k, sig))
        sig, k = sig[order], k[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])]
        sig, k = sig[new], k[new]
        member = np.r_[False, sig[1:] == sig[:-1]]
        hub = np.maximum.accumulate(np.where(member, 0, np.arange(len(sig))))
        return _rows([sig, k, np.where(member, k[hub], 0)], names)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, seed)
        held: list[np.ndarray] = []
        labels: list[int] = []
        rows = 0
        for b in batches:
            keys = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            for data, key in zip(each_text(b, 0), keys, strict=True):
                s = shingle_set(data, words)
                if key_of(s) == key and len(sigs := bands.signatures(s)):
                    held.append(sigs), labels.append(key[0])
                    rows += len(sigs)
                if rows > SIGNED_ROWS:
                    yield combined(np.concatenate(held), np.repeat(np.array(labels, np.int64), [len(x) for x in held]))
                    held, labels, rows = [], [], 0
        if held:
            yield combined(np.concatenate(held), np.repeat(np.array(labels, np.int64), [len(x) for x in held]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by signature; only the current signature's first row is kept."""
        at, h = None, 0
        for b in batches:
            sig, k, a = (b.column(i).to_numpy() for i in range(3))
            done = a != 0
            if done.any():
                yield _rows([sig[done], k[done], a[done]], names)
            sig, k = sig[~done], k[~done]
            if not len(sig):
                continue
            first = np.r_[at is None or sig[0] != at, sig[1:] != sig[:-1]]
            hub = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            g = np.where(hub >= 0, k[hub], h)
            out = k != g
            if out.any():
                yield _rows([sig[out], k[out], g[out]], names)
            at, h = sig[-1], int(g[-1])

    signed = found.select("text", "k1", "k2").mapInArrow(sign, schema)
    return signed.repartition("sig").sortWithinPartitions("sig", "k").mapInArrow(gather, schema)


def _close(bands: Bands, n1: np.ndarray, n2: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes whose sketches differ in so many bits may be similar."""
    total = n1 + n2
    least = -(-bands.percent * total // (100 + bands.percent))
    return (least <= np.minimum(n1, n2)) & (bits <= total - 2 * least)


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the larger one is folded to the size of the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketch_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, an, bn, asketch, bsketch) to (a, b, bits, maybe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, an, bn = (batch.column(i).to_numpy() for i in range(4))
            bits = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            yield _rows([a, b, bits, _close(bands, an, bn, bits)], ["a", "b", "bits", "maybe"])

    return pairs.mapInArrow(run, "a long, b long, bits long, maybe boolean")


def verified(pairs: DataFrame, texts: Texts) -> DataFrame:
    """Of the pairs (a, b) of classes, a written table, those that are similar, as another one."""
    words, percent = texts.words, texts.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(each_text(batch, 2), each_text(batch, 3), strict=True):
                s, t = shingle_set(x, words), shingle_set(y, words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    found = written(texts.of(pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()), "shingle-texts")
    side = lambda c: found.select(F.col("cid").alias(c), F.col("text").alias(f"{c}text"))
    out = written(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "atext", "btext").mapInArrow(run, "a long, b long"), "shingle-links")
    emptied(found)
    return out


class Texts:
    """The texts of classes, found among the documents by their least id, and told from rows with the same id by their key."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int):
        self.docs, self.classes, self.words, self.percent = docs, classes, words, percent

    def found(self, cids: DataFrame) -> DataFrame:
        """(cid, k1, k2, text) of the rows with the least id of each class of the table ``cids``; some may have another key."""
        wanted = self.classes.join(cids, "cid").select("cid", "k1", "k2", F.col("least").alias("__least"))
        return self.docs.join(small(wanted), F.col("id").eqNullSafe(F.col("__least"))).select("cid", "k1", "k2", "text")

    def of(self, cids: DataFrame) -> DataFrame:
        """(cid, text) of each class of the table ``cids``."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
                keep = [key_of(shingle_set(t, words)) == k for t, k in zip(each_text(b, 3), keys, strict=True)]
                yield b.select([0, 3]).filter(pa.array(keep, pa.bool_()))

        return self.found(cids).mapInArrow(run, "cid long, text string").dropDuplicates(["cid"])


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, tables: list[DataFrame] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_size, component_id (the least id reachable by links).

    ``tables`` gets the written tables that the result depends on, for ``emptied``."""
    prints = written(fingerprints(docs, id_col, text_col, words), "shingle-prints")
    classes = prints.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.count("*").alias("class_size"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "shingle-classes")
    texts = Texts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), classes, words, percent)
    able = written(sharing(docs, classes, text_col, words, percent), "shingle-sharing")
    star = written(stars(texts.found(able), words, percent), "shingle-stars")
    emptied(able)
    links = at = None
    for level in range(LEVELS):
        pairs = written(hub_pairs(star, classes, percent, level == 0), "shingle-pairs")
        maybe = pairs.where("maybe")
        if links is None:
            one = written(maybe.groupBy("a").agg(F.min(F.struct("bits", "b")).alias("x")).select("a", "x.b"), "shingle-one")
            links = verified(one, texts)
            at = components(links)
            maybe = maybe.join(one, ["a", "b"], "left_anti")
        known = links
        links = linked(links, across(maybe, at), texts)
        members = unfinished(across(pairs, at), star, classes)
        emptied(star)
        links = linked(links, few_members(members.where(F.col("size") <= DIRECT_ROWS), classes, at, percent), texts)
        if links is not known:
            at = components(links)
        many = members.where(F.col("size") > DIRECT_ROWS).select("sig", "cid")
        if many.isEmpty():
            break
        if level == LEVELS - 1:
            known, links = links, linked(links, many_members(many, pairs, classes, at, percent), texts)
            if links is not known:
                at = components(links)
        else:
            star = written(stars(texts.found(many.select("cid").distinct()), words, percent, level + 1), "shingle-stars")
            emptied(members, pairs)
    if tables is not None:
        tables += [prints, classes, pairs]

    groups = classes.join(at, F.col("cid") == F.col("node"), "left").select("k1", "k2", "least", "class_size", F.coalesce("component", "cid").alias("component"))
    groups = groups.join(groups.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("k1", "k2", "class_size", "component_id")
    none = prints.where("n = 0").select("id", "n", F.lit(1).cast("long").alias("class_size"), F.col("id").alias("component_id"))
    out = prints.where("n > 0").select("id", "n", "k1", "k2").join(groups, ["k1", "k2"]).select("id", "n", "class_size", "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_size", "component_id")


def sharing(docs: DataFrame, classes: DataFrame, text_col: str, words: int, percent: int) -> DataFrame:
    """The classes (cid) that may share enough of their shingles with another one to be similar to it.

    The part of the universe that is looked at is so large that a class with two fifths of its shingles to itself goes, about."""
    below = U(min(2**64 - 1, 2**64 * (100 - percent) * 5 // 200))

    def ends(s: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        """Of each shingle, the least and the greatest label of a batch: two at most tell whether it has one owner."""
        order = np.lexsort((k, s))
        s, k = s[order], k[order]
        new, last = np.r_[True, s[1:] != s[:-1]], np.r_[s[1:] != s[:-1], True]
        keep = new | (last & (k != k[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]))
        return _rows([s[keep], k[keep]], ["s", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                found, labels = [], []
                for data in each_text(whole.slice(at, 512), 0):
                    s = shingle_set(data, words)
                    labels.append(key_of(s)[0])
                    found.append(s[mix(s, 31) <= below])
                s = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
                if len(s):
                    yield ends(s, np.repeat(np.array(labels, np.int64), [len(x) for x in found]))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shingle: labels of shingles that have one, and how many; the last shingle waits for the next batch."""
        s, k = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            s, k = np.r_[s, b.column(0).to_numpy()], np.r_[k, b.column(1).to_numpy()]
            if not len(s):
                continue
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            low, high = np.minimum.reduceat(k, new), np.maximum.reduceat(k, new)
            owner, n = np.unique(low[:-1][low[:-1] == high[:-1]], return_counts=True)
            yield _rows([owner, n], ["k", "n"])
            s, k = s[-1:].repeat(2), np.array([low[-1], high[-1]])
        if len(s) and k.min() == k.max():
            yield _rows([k[:1], np.ones(1, np.int64)], ["k", "n"])

    held = docs.select(text_col).mapInArrow(run, "s long, k long").repartition("s").sortWithinPartitions("s")
    alone = held.mapInArrow(single, "k long, n long").groupBy("k").agg(F.sum("n").alias("alone"))
    # classes that share a label stay, as their shingles can't be told apart here
    label = classes.groupBy("k1").agg(F.count("*").alias("twins")).join(alone.withColumnRenamed("k", "k1"), "k1", "left")
    able = classes.select("k1", "cid", "n").join(label, "k1")
    return able.where((F.col("twins") > 1) | (100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= percent * F.col("n"))).select("cid")


def hub_pairs(star: DataFrame, classes: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs (a, b, bits, maybe) of members and hubs; the first time also of classes that share a label."""
    side = lambda c, k: classes.select(F.col("k1").alias(k), F.col("cid").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}sketch"))
    names = ["a", "b", "an", "bn", "asketch", "bsketch"]
    pairs = star.select("k", "h").distinct().join(side("a", "k"), "k").join(side("b", "h"), "h").select(names)
    if first:
        shared = classes.groupBy("k1").agg(F.count("*").alias("x")).where("x > 1").select(F.col("k1").alias("k"))
        twins = shared.join(side("a", "k"), "k").join(side("b", "k"), "k").where("a > b").select(names)
        with shuffles_end(classes.sparkSession):
            if not shared.isEmpty():  # two keys that agree in 64 bits
                pairs = pairs.unionByName(twins)
    return sketch_pairs(pairs, percent)


def across(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    of = lambda c: at.select(F.col("node").alias(c), F.col("component").alias(f"{c}at"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("aat", "a") != F.coalesce("bat", "b")).select(*pairs.columns)


def linked(links: DataFrame, pairs: DataFrame, texts: Texts) -> DataFrame:
    """The links with those among ``pairs``; the same table if there are none."""
    pairs = written(pairs, "shingle-compared")
    if pairs.isEmpty():
        return links
    more = verified(pairs, texts)
    emptied(pairs)
    return links if more.isEmpty() else links.unionByName(more)


def unfinished(bad: DataFrame, star: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, cid, size): members of signatures with a pair across components; two members alone have been compared."""
    of = lambda c, k: classes.select(F.col("k1").alias(k), F.col("cid").alias(c))
    known = written(star.join(of("a", "k"), "k").join(of("b", "h"), "h").select("sig", "a", "b"), "shingle-known")
    sigs = known.join(bad.select("a", "b"), ["a", "b"], "left_semi").select("sig").distinct()
    members = known.join(sigs, "sig").select("sig", F.explode(F.array("a", "b")).alias("cid")).distinct()
    sizes = members.groupBy("sig").agg(F.count("*").alias("size")).where("size > 2")
    out = written(members.join(sizes, "sig"), "shingle-members")
    emptied(known)
    return out


def few_members(members: DataFrame, classes: DataFrame, at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components under signatures with few members whose sketches are close.

    A signature's members, ``DIRECT_ROWS`` at most, come together with their sketches, and only close pairs become rows."""
    few = members.select("sig", "cid").join(at, F.col("cid") == F.col("node"), "left").select("sig", "cid", F.coalesce("component", "cid").alias("at"))
    several = few.groupBy("sig").agg(F.countDistinct("at").alias("x")).where("x > 1").select("sig")
    few = few.join(several, "sig").join(classes.select("cid", "n", "sketch"), "cid")
    rows = few.groupBy("sig").agg(F.collect_list(F.struct("cid", "at", "n", "sketch")).alias("rows")).select("rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column(0)[r].values
                yield close_pairs(bands, own, own)

    return rows.mapInArrow(run, "a long, b long").distinct()


def close_pairs(bands: Bands, x: pa.StructArray, y: pa.StructArray) -> pa.RecordBatch:
    """Pairs (a, b), a > b, of rows (cid, at, n, sketch) in different components whose sizes and sketches allow them to be similar."""
    cid, comp, n = ([s.field(k).to_numpy() for s in (x, y)] for k in range(3))
    sk = [s.field(3).to_pylist() for s in (x, y)]
    a, b = [], []
    for i in range(len(cid[0])):
        # sizes and components first: few pairs are left for their sketches
        near = np.flatnonzero((comp[1] != comp[0][i]) & _close(bands, np.full(len(n[1]), n[0][i]), n[1], np.zeros(len(n[1]), np.int64)))
        if x is y:
            near = near[near > i]
        bits = np.array([differing(sk[0][i], sk[1][j]) for j in near], np.int64)
        hit = near[_close(bands, np.full(len(near), n[0][i]), n[1][near], bits)]
        a += [cid[0][i]] * len(hit)
        b += cid[1][hit].tolist()
    return _rows([np.maximum(np.array(a, np.int64), np.array(b, np.int64)), np.minimum(np.array(a, np.int64), np.array(b, np.int64))], ["a", "b"])


def many_members(members: DataFrame, pairs: DataFrame, classes: DataFrame, at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components under signatures with many members whose sketches are close, by blocks of classes."""
    # near classes follow each other in order of region (joined by hubs) and hub, and the order is cut into blocks
    hub = pairs.groupBy("a").agg(F.min("b").alias("hub"))
    near = members.select("cid").distinct().join(hub.withColumnRenamed("a", "cid"), "cid", "left").withColumn("hub", F.coalesce("hub", "cid"))
    region = components(near.select(F.col("cid").alias("a"), F.col("hub").alias("b")))
    near = written(near.join(region, F.col("cid") == F.col("node"), "left").select("cid", "hub", F.coalesce("component", "cid").alias("region")), "shingle-near")
    place = near.repartitionByRange("region", "hub", "cid").sortWithinPartitions("region", "hub", "cid").select("cid", F.monotonically_increasing_id().alias("at"))
    place = written(place, "shingle-order").withColumn("part", F.shiftright("at", 33))
    sizes = place.groupBy("part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))  # one row a partition
    sizes = sizes.withColumn("before", F.sum("rows").over(W.orderBy("part")) - F.col("rows"))
    block = place.join(F.broadcast(sizes), "part").select("cid", F.floor((F.col("at") - F.col("first") + F.col("before")) / BLOCK_ROWS).alias("block"))
    block = written(block, "shingle-blocks")
    seen = members.join(block, "cid").select("sig", "block").distinct()
    two = seen.select("sig", F.col("block").alias("x")).join(seen.select("sig", F.col("block").alias("y")), "sig").where("x <= y").select("x", "y").distinct()
    full = classes.join(block, "cid").join(at, F.col("cid") == F.col("node"), "left").select("block", F.struct("cid", F.coalesce("component", "cid").alias("at"), "n", "sketch").alias("c"))
    full = full.groupBy("block").agg(F.collect_list("c").alias("rows"))  # BLOCK_ROWS at most
    of = lambda c: full.select(F.col("block").alias(c), F.col("rows").alias(f"{c}rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(i)[r].values for i in (0, 1))
                yield close_pairs(bands, x, y)

    return two.join(of("x"), "x").join(of("y"), "y").select("xrows", "yrows").mapInArrow(run, "a long, b long").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component and every row without shingles. Of a component, the row with the least id stays
    (null last), and of different texts with that id the one with the least digest. Rows that repeat id and text are one, if
    they have shingles."""
    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
    # id and text name a row; the id alone does not, as it may be null or shared by different texts
    row = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), digest.alias("sha"))
    tables: list[DataFrame] = []
    groups = similar_components(docs.select(row.alias("__row"), text_col), "__row", text_col, words, percent, tables)
    kept = groups.where(F.col("__row") == F.col("component_id")).groupBy("__row").agg(((F.max("n_shingles") > 0) & (F.count("*") > 1)).alias("__again"))
    kept = written(kept.select(F.col("__row.id").alias("__id"), F.col("__row.sha").alias("__ksha"), "__again"), "shingle-kept")
    emptied(*tables)
    out = docs.withColumn("__sha", digest).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__ksha")))
    if not kept.where("__again").isEmpty():
        out = out.where("NOT __again").unionByName(out.where("__again").dropDuplicates([id_col, "__sha"]))
    return out.select(*docs.columns)
