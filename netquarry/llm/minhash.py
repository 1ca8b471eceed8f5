"""Near-duplicate documents by b-bit MinHash.

Plan: one pass over the texts yields per document the size and digest of its
shingle set, 32 band keys of four minima each, and the low two bits of all 128
minima as two bit planes. Equal sets fold into one class before any join. Within
a band, every class meets the band's smallest class only (a star), which links
a group of copies in rows linear in its size; the collision-corrected estimate
from the packed bits drops unlikely pairs, and the rest are confirmed on their
full shingle sets. Bands that still hold several components then compare classes
of different components by bit counts and confirm the likely ones; large bands
are split into blocks that meet pairwise, and only links that join components
leave a block. So no group is gathered, no pair list of a group is emitted, and
no candidate is dropped by a cap.

A pair at the threshold of 0.75 shares no band with probability
(1 - 0.75**4)**32 = 5e-6, and is turned away by the estimate with less than 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions.storage import materialize
from netquarry.llm.text import WordHashes, mixed, pieces, sequence_hash, signed, text_key, utf8, window_hashes, without
from netquarry.operators.density import connected_components

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
LOW_BITS = 2
MIN_ESTIMATE = 0.5  # five standard errors of the estimate below the threshold
BLOCK = 500  # classes of a band in one block; two blocks meet in one group
_PLANES = ["lo0", "lo1", "hi0", "hi1"]


def shingle_set(h: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter sequence is one shingle; no words, none."""
    if 0 < len(h) < width:
        return np.array([sequence_hash(h)], np.uint64)
    return np.unique(window_hashes(h, width))


def _lowered(text: bytes) -> list[bytes]:
    return text.lower().split()


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        part = x[start : start + 2048, None] * a
        part += b
        np.minimum(out, part.min(axis=0), out=out)
    return out


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    draw = np.random.default_rng(20240601)
    a = draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
    b = draw.integers(0, 1 << 32, HASHES, np.uint32)
    words = WordHashes()
    for batch in pieces(batches, 2000):
        sizes, digests, bands, planes = [], [], [], []
        for text in utf8(batch.column("text")):
            found = shingle_set(words.of(_lowered(text)))
            sizes.append(len(found))
            if not len(found):
                digests.append(0)
                bands.append([])
                planes.append((0, 0, 0, 0))
                continue
            digests.append(signed(xxhash.xxh64_intdigest(found.tobytes(), seed=len(found))))
            low = _minima(found, a, b)
            bands.append([signed(xxhash.xxh64_intdigest(low[k : k + ROWS].tobytes(), seed=k)) for k in range(0, HASHES, ROWS)])
            kept = mixed(low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            bits = [np.packbits(((kept >> np.uint64(i)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for i in range(LOW_BITS)]
            planes.append((*map(int, bits[0]), *map(int, bits[1])))
        columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                   pa.array(bands, pa.list_(pa.int64()))]
        columns += [pa.array([p[i] for p in planes], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "v", "bands", *_PLANES])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_shingles, class v of its shingle set, bands, bit planes."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    schema = "doc_id bigint, text_key bigint, n_shingles bigint, v bigint, bands array<bigint>, " + ", ".join(f"{p} bigint" for p in _PLANES)
    return rows.mapInArrow(_signatures, schema)


def estimate(left: str, right: str) -> Column:
    """Similarity from the share of equal low bits, corrected for chance collisions."""
    differ = None
    for lo, hi in (("lo0", "hi0"), ("lo1", "hi1")):
        unlike = F.col(f"{left}.{lo}").bitwiseXOR(F.col(f"{right}.{lo}")).bitwiseOR(F.col(f"{left}.{hi}").bitwiseXOR(F.col(f"{right}.{hi}")))
        differ = F.bit_count(unlike) if differ is None else differ + F.bit_count(unlike)
    chance = 1 / (1 << LOW_BITS)
    return ((1 - differ / F.lit(float(HASHES))) - chance) / (1 - chance)


def _confirmed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        keep, last, p = [], None, np.empty(0, np.uint64)
        for x, y in zip(utf8(batch.column("text_a")), utf8(batch.column("text_b"))):
            if x != last:  # rows of one hub mostly follow each other
                last, p = x, shingle_set(words.of(_lowered(x)))
            q = shingle_set(words.of(_lowered(y)))
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""
    left = texts.select(F.col("v").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(_confirmed, "a bigint, b bigint")


def _with_texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text per wanted class (v, text)."""
    at = classes.join(wanted, "v").select("v", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), text_key(F.col("text")).alias("text_key"))
    hit = rows.join(at, (rows["text_key"] == at["_key"]) & rows["doc_id"].eqNullSafe(at["_id"]))
    return hit.groupBy("v").agg(F.first("text").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked when 100 * |A and B| >= 75 * |A or B| over their
    distinct five-word shingles (words lower-cased in A-Z). component_id is the
    smallest doc_id reachable over links, the document's own included; kept
    tells whether it is the document itself.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated rows keep one row each and agree in all columns. A null doc_id takes
    part in links but names no component unless nothing else is linked; its
    ``kept`` is then true. Other columns of ``docs`` are not read. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    sig = materialize(signatures(docs), "minhash")
    filled = sig.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    classes = materialize(filled.groupBy("v").agg(first).select("v", "first.doc_id", "first.text_key"), "minhash-classes")
    chosen = filled.join(classes.select("v", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "v").filter(
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    )
    chosen = materialize(chosen.select("v", "bands", *_PLANES), "minhash-chosen")
    members = chosen.select("v", F.explode("bands").alias("band"), *_PLANES)
    bands = members.groupBy("band").agg(F.min("v").alias("hub"), F.max("v").alias("top"))
    shared = materialize(
        members.join(bands.filter("hub <> top"), "band").select("band", "v", "hub", "top", *_PLANES).distinct(), "minhash-bands"
    )
    texts = materialize(_with_texts(docs, classes, shared.select("v").distinct()), "minhash-texts")
    components = materialize(shared.select("v", F.col("v").alias("comp")).distinct(), "minhash-components")

    # Stars: in each band, every class meets the smallest and the largest.
    star = shared.select("v", F.explode(F.array("hub", "top")).alias("hub"), *_PLANES).filter("v <> hub").distinct()
    planes = shared.select("v", *_PLANES).distinct()
    likely = star.alias("l").join(planes.alias("r"), F.col("l.hub") == F.col("r.v")).filter(estimate("l", "r") >= MIN_ESTIMATE)
    x, y = F.col("l.v"), F.col("l.hub")
    pairs = likely.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    components = _merged(components, materialize(_confirm(pairs, texts), "minhash-links"))

    # What stars can't tell: bands that hold several components still.
    placed = shared.select("band", "v").join(components, "v")
    several = placed.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("band")
    profiles = chosen.dropDuplicates(["v"]).join(texts, "v")
    open_rows = materialize(placed.join(several, "band"), "minhash-open")
    components = _merged(components, materialize(_links_across(open_rows, profiles), "minhash-links"))

    named = classes.join(components, "v").select("v", "comp", "doc_id")
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("first_id"))
    by_class = classes.join(named.join(smallest, "comp").select("v", "first_id"), "v", "left").select(
        F.col("v").alias("class"), F.coalesce("first_id", "doc_id").alias("first_id")
    )
    out = sig.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("v")).alias("class"))
    out = out.join(by_class, "class", "left")
    component = F.coalesce(F.col("first_id"), F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def _ordered_pairs(joined: DataFrame, x: Column, y: Column) -> DataFrame:
    return joined.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (v, comp) after further links (a, b); works on the components the links touch."""
    at = components.select(F.col("v").alias("a"), F.col("comp").alias("p"))
    to = components.select(F.col("v").alias("b"), F.col("comp").alias("q"))
    edges = materialize(links.join(at, "a").join(to, "b").filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "minhash-edges")
    ends = materialize(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "minhash-ends")
    joined = connected_components(ends, edges).select(F.col("v").alias("comp"), F.col("comp").alias("into"))
    return materialize(components.join(joined, "comp", "left").select("v", F.coalesce("into", "comp").alias("comp")), "minhash-components")


def _links_across(open_rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Links of one band between different components, found block against block.

    Members of a band's largest component need not meet each other, so its blocks
    meet only those of the others: a large group with a few strangers in its band
    costs rows linear in the group.
    """
    per_component = open_rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = per_component.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("total"))
    plan = largest.select(
        "band", F.col("most.comp").alias("major"), F.ceil((F.col("total") - F.col("most.n")) / BLOCK).cast("int").alias("others"),
        F.ceil(F.col("most.n") / BLOCK).cast("int").alias("majors"),
    )
    rows = open_rows.join(plan, "band").withColumn("is_major", F.col("comp") == F.col("major"))
    slot = F.xxhash64("v")
    block = F.when(F.col("is_major"), F.col("others") + F.pmod(slot, F.col("majors"))).otherwise(F.pmod(slot, F.col("others"))).cast("int")
    last = F.when(F.col("is_major"), F.col("others")).otherwise(F.col("others") + F.col("majors")) - 1
    met = rows.withColumn("block", block).select("band", "v", "comp", "block", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    met = met.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "v", "comp")
    return met.join(profiles, "v").groupBy("band", "i", "j").applyInArrow(_band_links, "a bigint, b bigint")


def _band_links(rows: pa.Table) -> pa.Table:
    """Confirmed links that join components within one block pair; at most one per merge."""
    one = lambda name: rows.column(name).to_numpy()
    v, comp, block, band = one("v"), one("comp"), one("block"), rows.column("band")[0].as_py()
    bands = np.array(rows.column("bands").to_pylist(), np.int64)
    bits = [one(p).view(np.uint64) for p in _PLANES]
    right = np.flatnonzero(block == rows.column("j")[0].as_py())
    same_block = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
    left = right if same_block else np.flatnonzero(block == rows.column("i")[0].as_py())
    words, texts, sets, parent = WordHashes(), rows.column("text"), {}, {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def shingles(k: int) -> np.ndarray:
        if k not in sets:
            sets[k] = shingle_set(words.of(_lowered(texts[k].as_py().encode())))
        return sets[k]

    links = []
    for k in left.tolist():
        to = right[(right > k) & (comp[right] != comp[k])] if same_block else right[comp[right] != comp[k]]
        unlike = np.zeros(len(to), np.int64)
        for lo, hi in ((0, 2), (1, 3)):
            unlike += np.bitwise_count((bits[lo][to] ^ bits[lo][k]) | (bits[hi][to] ^ bits[hi][k]))
        chance = 1 / (1 << LOW_BITS)
        guess = ((1 - unlike / HASHES) - chance) / (1 - chance)
        to, guess = to[guess >= MIN_ESTIMATE], guess[guess >= MIN_ESTIMATE]
        equal = bands[to] == bands[k]
        first = bands[k][equal.argmax(axis=1)] == band  # pairs of several bands are looked at in the first
        for t in to[first][np.argsort(-guess[first], kind="stable")].tolist():
            p, q = root(int(comp[k])), root(int(comp[t]))
            if p == q:
                continue
            x, y = shingles(k), shingles(t)
            if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= PERCENT * (len(x) + len(y) - both):
                parent[p] = q
                links.append((int(v[k]), int(v[t])))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without the near copies of an earlier document; columns unchanged."""
    return without(docs, near_duplicates(docs).filter(~F.col("kept")))
