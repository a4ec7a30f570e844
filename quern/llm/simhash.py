"""SimHash near-duplicates, searched by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two 23-bit segments, each a word of the
perfect binary Golay code, and an 18-bit rest. Decoding a segment gives the
index of the one codeword within three bits; decoding all its neighbours at
one bit gives one or six indices, and two words at one bit share the index of
the one with an index of the other, two words at two bits share an index.

Three differing bits are dealt over (first, second, rest) by the pigeonhole:

* rest equal: the first or the second segment differs in one bit at most, so
  the index of one is among the nearby indices of the other;
* first equal, rest not: the second differs in two bits at most, so the nearby
  indices meet; the same with first and second exchanged;
* all differ: in one bit each, so a half of each is equal.

Every case is an equality of a key of 30 bits or more.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, grouped, split_words, text_blocks, written
from .components import components

SEED = 42
DISTANCE = 3
#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed).
GENERATOR = 0b110001110101
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> Iterator[bytes]:
    """Space-joined runs of `width` lower-cased words (A-Z only), repeats included; fewer words: the whole sequence."""
    words = [w.translate(_LOWER) for w in split_words(text)]
    if not words:
        return
    line = b" ".join(words)
    if len(words) <= width:
        yield line
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True):
        yield line[s:e]


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is in over half the hashes; no words: zero."""
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles(text, width)), np.uint64)
    return majority(h)


def majority(h: np.ndarray) -> int:
    """64 bits, each set if it is in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id_col, fp long): the fingerprint of every whole text, as signed 64 bits. Null texts have no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text"):
            fps = np.array([fingerprint(t, width, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, fp long")


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword of every 23-bit word, and the coset pattern of every syndrome."""
    patterns = [0] + [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)] + [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    fix = np.zeros(2048, np.uint32)
    words = np.array(patterns, np.uint32)
    fix[syndrome(words)] = words
    return fix, words


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder by GENERATOR: zero for codewords, one of 2048 values for the patterns of up to three bits."""
    rest = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return rest


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within three bits of each 23-bit word."""
    fix, _ = golay_tables()
    return (words ^ fix[syndrome(words)]) >> np.uint32(11)


def nearby(words: np.ndarray) -> np.ndarray:
    """len x 24 indices: of each word and of its 23 neighbours at one bit; one or six of them are distinct."""
    flips = np.concatenate((np.zeros(1, np.uint32), np.uint32(1) << np.arange(23, dtype=np.uint32)))
    return decode((words[:, None] ^ flips[None, :]).reshape(-1)).reshape(len(words), 24)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of unsigned fingerprints, each key of a row once.

    A key holds its family in the upper bits, so families never mix.
    """
    a, b, c = ((fps >> np.uint64(41)).astype(np.uint32), (fps >> np.uint64(18) & np.uint64((1 << 23) - 1)).astype(np.uint32), (fps & np.uint64((1 << 18) - 1)).astype(np.uint64))
    rows = np.arange(len(fps))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for family, (segment, other) in enumerate(((a, b), (b, a))):
        near = np.sort(nearby(segment), axis=1)
        first = np.concatenate((np.ones((len(fps), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
        at, index = np.repeat(rows, first.sum(axis=1)), near[first].astype(np.uint64)
        for kind, base in ((family, c), (family + 2, other.astype(np.uint64))):  # rest equal; other segment equal
            out.append((at, np.uint64(kind) << np.uint64(56) | base[at] << np.uint64(12) | index))
    halves = [((x >> np.uint32(12)).astype(np.uint64), (x & np.uint32(0xFFF)).astype(np.uint64)) for x in (a, b)] + [(c >> np.uint64(9), c & np.uint64(511))]
    for pick in range(8):
        x, y, z = (halves[i][pick >> i & 1] for i in range(3))
        out.append((rows, np.uint64(4 + pick) << np.uint64(56) | x << np.uint64(24) | y << np.uint64(12) | z))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def key_table(distinct: DataFrame) -> DataFrame:
    """(fp, key) of a table of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                fps = batch.column(0).slice(at, 8192).to_numpy(zero_copy_only=False)
                row, key = keys(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(fps[row]), pa.array(key.view(np.int64))], names=["fp", "key"])

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def _close(x: str, y: str, most: int) -> Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= most


def shared_keys(distinct: DataFrame) -> DataFrame:
    """(fp, key, least, prev): the keys that several fingerprints share, with the least one and the one before; a written table."""
    by_key = Window.partitionBy("key")
    marked = key_table(distinct).withColumns({"n": F.count("*").over(by_key), "least": F.min("fp").over(by_key), "prev": F.lag("fp").over(by_key.orderBy("fp"))})
    return written(marked.where("n > 1").select("fp", "key", "least", "prev"), "simhash-keys")


def side_by_side(shared: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) of fingerprints at `most` bits or fewer: each with the least one and with the one before of its keys."""
    stars = shared.where(_close("fp", "least", most)).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    chain = shared.where(F.col("prev").isNotNull() & _close("fp", "prev", most)).select(F.col("fp").alias("a"), F.col("prev").alias("b"))
    return stars.unionByName(chain).where("a <> b")


def link_components(distinct: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(fp, component): least fingerprint reachable over links of at most `most` (3 or fewer) differing bits.

    A key's fingerprints are first compared with the least one and with their
    neighbour in order, which joins large groups of near copies without
    comparing all pairs; then only fingerprints of a key that still lie in
    different components are compared, all of them. Fingerprints without a
    link are not returned.
    """
    if not 0 <= most <= DISTANCE:
        raise ValueError("the codes cover up to three differing bits")
    by_key = Window.partitionBy("key")
    shared = shared_keys(distinct)
    first = written(side_by_side(shared, most).distinct(), "simhash-links")
    groups = components(first)
    named = shared.select("fp", "key").join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    mixed = written(named.withColumns({"lo": F.min("component").over(by_key), "hi": F.max("component").over(by_key)}).where("lo <> hi").select("fp", "key", "component"), "simhash-mixed")
    x, y = mixed.select("key", F.col("fp").alias("a"), F.col("component").alias("ca")), mixed.select("key", F.col("fp").alias("b"), F.col("component").alias("cb"))
    more = x.join(y, "key").where((F.col("ca") < F.col("cb")) & _close("a", "b", most)).select("a", "b")
    late = written(more.distinct(), "simhash-links")
    found = groups if late.isEmpty() else components(first.unionByName(late))
    for t in (shared, mixed):
        drop_written(t)
    return found.select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = DISTANCE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp, component_id): fingerprint and least id reachable over links, one row for each row of docs.

    Links are lost for no pair of different fingerprints; equal fingerprints
    (all texts without a word among them) are one node. Null ids never become
    a component's name unless all its ids are null. An empty table gives an
    empty result.
    """
    held = written(fingerprints(docs, width, text, id_col), "fingerprints")
    nodes = held.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    linked = written(link_components(nodes), "simhash-components")
    named = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id")
    return held.join(of_fp, "fp", "left").select(id_col, "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for documents."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: similar_documents() compares sets of shingles of this many words.
JUDGE_WIDTH = 5
#: Share of a set that its prefix holds beyond what the similarity asks for: pairs then have several keys in common, not one.
SPARE = 0.1
#: Keys of a text by which neighbours are compared first; all keys count in the pass after it.
NEAR_KEYS = 3
#: Keys of more texts are compared tile against tile, in blocks of about so many texts.
PAIR_TEXTS, BLOCK = 32, 512
#: Buckets of each of the two count tables that tell common shingles.
SKETCH = 1 << 16
#: Bits of the map by which tasks pass over texts that are no candidates, whatever the input.
MARKS = 1 << 23
_NO_ID = (1 << 63) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int = JUDGE_WIDTH) -> list[np.ndarray]:
    """Of each text the ascending 64-bit hashes of its different shingles, made of its words' hashes; no words: none."""
    out = []
    for t in texts:
        words = t.encode().translate(_LOWER).split() if t else []
        v = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        take = min(width, len(v))
        h = np.full(len(v) - take + 1 if take else 0, take, np.uint64)
        for k in range(take):
            h = h * np.uint64(0x9E3779B97F4A7C15) + v[k : len(v) - take + 1 + k]
        out.append(np.unique(_mixed(h)))
    return out


def _named(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(doc, th, text): id and text hash name a row; null ids count as the largest."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(whole).alias("th"), whole.alias("text"))


def signatures(named: DataFrame) -> DataFrame:
    """(row, doc, th, n, digest, fp, counts): size, digest and SimHash of each text's set of shingles.

    One more row of each task, with nothing but counts, holds how often each
    bucket of a count sketch was met by its sets: two tables of SKETCH counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros((2, SKETCH), np.int32), ["row", "doc", "th", "n", "digest", "fp", "counts"]
        for b in text_blocks(batches, "text"):
            sets = shingle_sets(b.column(3).to_pylist())
            for table, at in zip(seen, _buckets(np.concatenate(sets)), strict=True):
                table += np.bincount(at, minlength=SKETCH).astype(np.int32)
            cols = [
                *(b.column(i) for i in range(3)), pa.array([len(g) for g in sets], pa.int32()), pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()),
                pa.array(np.array([majority(g) for g in sets], np.uint64).view(np.int64)), pa.nulls(b.num_rows, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if seen.any():
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary())], names=names)

    return named.select(F.monotonically_increasing_id().alias("row"), "doc", "th", "text").mapInArrow(run, "row long, doc long, th long, n int, digest binary, fp long, counts binary")


def common_shingles(counts: DataFrame) -> np.ndarray:
    """2 x SKETCH counts of texts: a bucket's count where it stands out, else zero. The driver gets only those that do."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2 * SKETCH, np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                seen += np.frombuffer(zlib.decompress(packed), np.int32)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["bucket", "n"])

    merged = written(counts.mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")), "sketch")
    mean = (merged.agg(F.sum("n")).first()[0] or 0) / (2 * SKETCH)
    found = merged.where(F.col("n") > mean + 8 * mean**0.5 + 8).toArrow()  # 2 x SKETCH rows at most, whatever the input
    out = np.zeros(2 * SKETCH, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    drop_written(merged)
    return out.reshape(2, SKETCH)


def _buckets(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (grams & np.uint64(SKETCH - 1)).astype(np.int64), (grams >> np.uint64(24) & np.uint64(SKETCH - 1)).astype(np.int64)


def prefix_keys(named: DataFrame, similarity: float, counts: np.ndarray) -> DataFrame:
    """(doc, th, keys): the first shingles of each set in one order for all sets, as many as a similar set can lack, one, and SPARE of the set.

    Common shingles come last, which keeps one that most texts have out of nearly all prefixes.
    """
    sent = named.sparkSession.sparkContext.broadcast(counts)  # 2 x SKETCH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text"):
            keys = []
            for g in shingle_sets(b.column(2).to_pylist()):
                first, second = _buckets(g)
                order = np.lexsort((g, np.minimum(sent.value[0, first], sent.value[1, second])))
                keys.append(g[order[: len(g) - int(np.ceil(similarity * len(g) - 1e-9)) + 1 + int(SPARE * len(g))]].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc", "th", "keys"])

    return named.mapInArrow(run, "doc long, th long, keys array<long>")


def prefix_table(named: DataFrame, nodes: DataFrame, similarity: float, counts: np.ndarray) -> DataFrame:
    """(at, n, key): keys of nodes (at, doc, th, n) such that two sets at the similarity have one in common.

    In the common order of prefix_keys(), the prefix whose last shingle comes
    first lies, but for what the other set lacks, in the other's prefix. A set
    A of n shingles lacks at most n - ceil(similarity * n) of them, so the two
    prefixes share 1 + SPARE * |A| keys or more, and |A| is at least similarity
    times the size of either. Keys that only one text has are left out, and of
    a text's other keys, rarest first, all but the last ones that are fewer
    than the shared ones: the rarest shared key stays in both.
    """
    arrays = prefix_keys(named, similarity, counts).dropDuplicates(["doc", "th"])
    rows = arrays.join(nodes.select("doc", "th", "at"), ["doc", "th"]).select("at", F.explode("keys").alias("key"))
    often = rows.withColumn("texts", F.count("*").over(Window.partitionBy("key"))).where("texts > 1")
    of_text = Window.partitionBy("at")
    held = often.join(nodes.select("at", "n"), "at").withColumns({"r": F.row_number().over(of_text.orderBy("texts", "key")), "all": F.count("*").over(of_text)})
    smaller = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    shared = F.least(1 + F.floor(F.lit(SPARE) * smaller), F.ceil(F.lit(similarity) * smaller - 1e-9))
    return held.where(F.col("r") <= F.col("all") - shared + 1).select("at", "n", "key")


def marks(table: DataFrame) -> np.ndarray:
    """Bits, MARKS in all, that the names (doc, th) of a table fall on."""
    bit = F.pmod(F.xxhash64("doc", "th"), F.lit(MARKS))
    words = table.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    found = words.toArrow()  # MARKS / 64 rows at most
    out = np.zeros(MARKS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def candidate_sets(named: DataFrame, asked: DataFrame) -> DataFrame:
    """(at, n, parity, grams) of the texts asked for (at, doc, th): the set and its parities, which bound the difference of two sets from below.

    Tasks pass over texts whose name is not among the marks; of the rest only
    those that are asked for stay. A parity bit is set if an odd number of
    hashes fall on it; there are at least four bits for each of them.
    """
    sent = named.sparkSession.sparkContext.broadcast(marks(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_blocks(batches, "text"):
            bit = b.column(3).to_numpy()
            b = b.filter(pa.array((sent.value[bit >> 6] >> (bit & 63) & 1) == 1))
            if not b.num_rows:
                continue
            sets = shingle_sets(b.column(2).to_pylist())
            sizes = [len(g) for g in sets]
            odd = []
            for g in sets:
                bits = 1 << max(6, (4 * len(g)).bit_length())
                odd.append(np.packbits((np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes())
            grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(odd, pa.binary()), grams], names=["doc", "th", "n", "parity", "grams"])

    marked = named.select("doc", "th", "text", F.pmod(F.xxhash64("doc", "th"), F.lit(MARKS)).alias("bit"))
    return marked.mapInArrow(run, "doc long, th long, n int, parity binary, grams array<long>").join(asked.select("at", "doc", "th"), ["doc", "th"]).dropDuplicates(["at"]).select("at", "n", "parity", "grams")


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ, the longer one folded: at most the number of elements that one set has and the other lacks."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def jaccard_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets, in sets (at, n, parity, grams), have at least this Jaccard similarity.

    Pairs whose parities differ in more bits than the similarity allows are
    surely less similar; the sets themselves judge the rest.
    """
    px, py = (sets.select(F.col("at").alias(i), F.col("n").alias(f"n{i}"), F.col("parity").alias(f"p{i}")) for i in "ab")

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - similarity) * (b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()) + 1e-6
            far = [(1 + similarity) * parity_distance(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(np.array(far) <= most))

    pairs = written(pairs.join(px, "a").join(py, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(may, "a long, b long"), "pairs")
    x, y = (sets.select(F.col("at").alias(i), F.col("n").alias(f"n{i}"), F.col("grams").alias(f"g{i}")) for i in "ab")
    both = F.size(F.array_intersect("ga", "gb"))
    links = written(pairs.join(x, "a").join(y, "b").where((1 + similarity) * both >= similarity * (F.col("na") + F.col("nb")) - 1e-6).select("a", "b"), "judged")
    drop_written(pairs)
    return links


def crowd_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts that share a key of apart (key, at, n, texts, component), lie in different components and may be similar by their parities.

    The texts of a key are dealt into blocks of about BLOCK, every block is
    compared with every other in a task of its own, and only pairs that may be
    similar come out, each under the least of the keys that both texts have.
    """
    keys_of = apart.groupBy("at").agg(F.collect_set("key").alias("keys"))  # fewer than a text's prefix has
    blocks = F.ceil(F.col("texts") / BLOCK).cast("int")
    dealt = apart.withColumns({"block": F.pmod(F.xxhash64("at", "key"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    tiles = dealt.select("at", "component", "key", "block", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    columns = ["at", "component", "key", "block", "i", "j", "n", "parity", "keys"]

    def compare(_: int, rows: dict[str, list]) -> Iterator[tuple]:
        at, component, key, block, i, j, n = (np.array(rows[c], np.int64) for c in columns[:-2])
        keys = list(map(set, rows["keys"]))
        parity = [np.frombuffer(p, np.uint64) for p in rows["parity"]]
        width = np.array(list(map(len, parity)))
        for w in np.unique(width):  # sizes that the similarity allows have parities of one width, or of that and its double
            near = np.flatnonzero((width == w) | (width == 2 * w))
            bits = np.stack([p if len(p) == w else p[:w] ^ p[w:] for p in (parity[r] for r in near)])
            for r in range(len(near)):
                if width[near[r]] != w:
                    continue
                rest = np.flatnonzero((width[near] > w) | (np.arange(len(near)) > r))
                x, y = near[r], near[rest]
                ok = (component[y] != component[x]) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]) - 1e-9)
                ok &= (i[x] == j[x]) | (block[y] != block[x])
                rest, y = rest[ok], y[ok]
                far = np.bitwise_count(bits[rest] ^ bits[r]).sum(axis=1, dtype=np.int64)
                y = y[(1 + similarity) * far <= (1 - similarity) * (n[x] + n[y]) + 1e-6]
                y = y[np.array([min(keys[x] & keys[other]) == key[x] for other in y], bool)]
                if len(y):
                    yield np.minimum(at[x], at[y]), np.maximum(at[x], at[y])

    return grouped(tiles.join(sets.select("at", "n", "parity"), "at").join(keys_of, "at"), "tile", columns, compare, "a long, b long", ["a", "b"])


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (at, fp) that Golay keys put side by side: texts of one fingerprint, and fingerprints of a key at three bits or fewer from its least or its next one."""
    reps = nodes.groupBy("fp").agg(F.min("at").alias("rep"))
    same = nodes.join(reps, "fp").where("at <> rep").select(F.col("at").alias("a"), F.col("rep").alias("b"))
    shared = shared_keys(reps)
    pairs = side_by_side(shared, DISTANCE).distinct()
    x, y = (reps.select(F.col("fp").alias(i), F.col("rep").alias(f"r{i}")) for i in "ab")
    out = written(pairs.join(x, "a").join(y, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionByName(same), "near-fingerprints")
    drop_written(shared)
    return out


def link_by_keys(shared: DataFrame, sets: DataFrame, similarity: float, judge: Callable[[DataFrame], DataFrame], near: DataFrame | None = None) -> DataFrame:
    """(node, component) over the links that judge keeps of all pairs (a, b) that share a key of a written table (at, n, key).

    n: size of a text; pairs whose sizes alone forbid the similarity are not
    judged. The pairs `near`, and the texts of a key with their neighbours in
    an order that differs from key to key, by NEAR_KEYS keys a text, are
    compared first, which joins large groups of near copies without comparing
    all pairs; then, by all keys, all pairs of a key that still lie in
    different components are compared, so that no link between components is
    lost. Of the keys that the same texts share, the second pass reads one.
    Keys of more than PAIR_TEXTS texts are compared tile against tile by the
    parities of sets (at, n, parity, grams), see crowd_pairs().
    """
    mixed = Window.partitionBy("key").orderBy(F.xxhash64("key", "at"), "at")
    sizes_allow = F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9
    few = shared.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("key"), "key"))).where(f"r <= {NEAR_KEYS}")
    beside = few.withColumns({"prev": F.lag("at").over(mixed), "np": F.lag("n").over(mixed)}).where("prev is not null")
    first = beside.select(F.least("at", "prev").alias("a"), F.greatest("at", "prev").alias("b"), F.col("n").alias("na"), F.col("np").alias("nb")).where(sizes_allow).select("a", "b")
    if near is not None:
        first = first.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    first = judge(first.distinct())
    groups = components(first)
    named = shared.select("at", "n", "key").join(groups.withColumnRenamed("node", "at"), "at", "left").withColumn("component", F.coalesce("component", "at"))
    texts_of = [F.count("*"), F.min("at"), F.max("at"), F.bit_xor(F.xxhash64("at")), F.bit_xor(F.xxhash64("at", F.lit(1)))]
    crowds = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), *(c.alias(f"t{i}") for i, c in enumerate(texts_of))).where("lo <> hi")
    crowds = crowds.groupBy(*(f"t{i}" for i in range(len(texts_of)))).agg(F.min("key").alias("key"))
    crowds = written(crowds.select("key", F.col("t0").alias("texts")), "crowds")
    apart = written(named.join(crowds, "key"), "apart")
    few_texts = apart.where(F.col("texts") <= PAIR_TEXTS)
    x, y = (few_texts.select("key", F.col("at").alias(i), F.col("n").alias(f"n{i}"), F.col("component").alias(f"c{i}")) for i in "ab")
    pairs = x.join(y, "key").where((F.col("ca") < F.col("cb")) & sizes_allow).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = judge(pairs.unionByName(crowd_pairs(apart.where(F.col("texts") > PAIR_TEXTS), sets, similarity)).distinct())
    found = groups if late.isEmpty() else components(first.unionByName(late))
    for t in (crowds, apart):
        drop_written(t)
    return found


def similar_documents(docs: DataFrame, similarity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, th, component): id, text hash and least id of the group of every distinct (id, text).

    Texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least `similarity`; equal sets are one node, texts without
    a word among them. SimHash fingerprints of the sets that Golay keys bring
    together are compared first. At 0.8 most pairs differ in more bits than
    the keys cover, so all pairs that share a key of prefix_table(), which
    every such pair does, follow: see link_by_keys(). Null ids count as the
    largest; an empty table gives an empty result.
    """
    named = _named(docs, text, id_col)
    held = written(signatures(named), "signatures")
    counts = common_shingles(held.where("counts is not null").select("counts"))
    rows = held.where("counts is null").drop("counts")
    nodes = written(rows.groupBy("digest").agg(F.min(F.struct("doc", "th", "row", "n", "fp")).alias("least")).select("digest", F.col("least.row").alias("at"), "least.doc", "least.th", "least.n", "least.fp"), "texts")
    shared = written(prefix_table(named, nodes, similarity, counts), "shared-keys")
    asked = written(nodes.join(shared.select("at").distinct(), "at", "left_semi").select("at", "doc", "th", "fp"), "asked")
    sets = written(candidate_sets(named, asked), "sets")
    found = link_by_keys(shared, sets, similarity, lambda pairs: jaccard_links(pairs, sets, similarity), near_fingerprints(nodes.select("at", "fp")))
    group = nodes.join(found.withColumnRenamed("node", "at"), "at", "left").withColumn("component", F.coalesce("component", "at"))
    least = group.groupBy("component").agg(F.min("doc").alias("least"))
    of_set = group.join(least, "component").select("digest", F.col("least").alias("component"))
    out = written(rows.select("doc", "th", "digest").join(of_set, "digest").select("doc", "th", "component").distinct(), "groups")
    for t in (shared, asked, sets, nodes, held):
        drop_written(t)
    return out


def keep_one(docs: DataFrame, similarity: float = 0.8, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without all but one row of each group of similar_documents(): the row of least id stays, one of equal rows too.

    Columns and an empty table stay as they are.
    """
    best = similar_documents(docs, similarity, text, id_col).groupBy("component").agg(F.min(F.struct("doc", "th")).alias("best")).select(F.col("best.doc").alias("__doc"), F.col("best.th").alias("__th"))
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return keyed.join(best, ["__doc", "__th"], "left_semi").dropDuplicates(["__doc", "__th"]).select(docs.columns)
