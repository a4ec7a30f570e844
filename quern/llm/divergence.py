"""Divergence of the sources of a language from each other, by an inverted index with a corrected baseline.

Each pair of sources starts at V times the value of a term that neither has.
What a source's own terms change against a source without them follows from
its distribution of counts; the postings of a term add what pairs of sources
that both have it differ by. Terms of a source are ranked by windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_blocks, written

#: Shares are counted in units of 1 / SCALE.
SCALE = 1_000_000_000
#: A term is kept if so many documents of its language hold it.
LEAST_DOCUMENTS = 3
#: Terms listed for each source.
TERM_RANKS = 200
#: Entries of a task's partial counts before they are put out.
HELD = 400_000
#: Pairs of a block of postings that are worked on at once.
PAIRS = 1_000_000
#: Ways in which a language's sources are dealt when its pairs are made.
SALTS = 32
_TERM_BYTES = bytes(32 if b < 0x41 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of A-Z, a-z and characters beyond ASCII, as UTF-8, A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group and documents that hold it; a row of null term for each group.

    Tasks put out partial counts, in pieces of bounded size. One exchange by
    (lang, term) serves their sum and the window over a term's postings.
    """
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, held) in seen.items():
                names = list(times)
                rows = len(names) + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang], pa.string()).take(pa.array(np.zeros(rows, np.int32))), pa.array([source], pa.string()).take(pa.array(np.zeros(rows, np.int32))),
                    pa.array([None, *names], pa.binary()).cast(pa.string()), pa.array([0, *times.values()], pa.int64()), pa.array([0, *(held[t] for t in names)], pa.int64()),
                ], names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        for b in batches:
            for block in text_blocks(iter([b])):
                for lang, source, text in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    times, held = seen.setdefault((lang, source), (Counter(), Counter()))
                    found = terms(text)
                    times.update(found)
                    held.update(set(found))
                if sum(len(times) for times, _ in seen.values()) > HELD:
                    yield from flush()
        yield from flush()

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.col("text"))
    found = groups.mapInArrow(count, schema).repartition("lang", "term")
    return found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str) -> str:
    """1 + floor(SCALE * (count + 1) / total) in SQL of longs: long division in base 1000, exact for totals below 9e15."""
    rest, out = f"(({count} + 1) % ({total}))", f"1 + (({count} + 1) div ({total})) * {SCALE}L"
    for unit in (SCALE // 1000, SCALE // 1_000_000, 1):
        out += f" + ({rest} * 1000L div ({total})) * {unit}L"
        rest = f"({rest} * 1000L % ({total}))"
    return out


def excess(p: str, q: str) -> str:
    """floor((p - q)**2 / q) in SQL of longs."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, in_lang, nth) of kept terms, nth 1 once a term, and a row of null term for each group."""
    of = Window.partitionBy("lang", "term")
    found = counts(docs).withColumns({
        "in_docs": F.sum("docs").over(of), "in_lang": F.sum("n").over(of), "nth": F.row_number().over(of.orderBy("source")),
    })
    return found.where(F.col("term").isNull() | (F.col("in_docs") >= LEAST_DOCUMENTS)).drop("docs", "in_docs")


def group_totals(posts: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, v, zero) of every group: its and its language's counts and kept terms, the share of a term it doesn't have."""
    sums = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if((F.col("nth") == 1) & F.col("term").isNotNull()).alias("firsts"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("firsts").alias("v"))
    return sums.drop("firsts").join(langs, "lang").withColumn("zero", F.expr(f"IF(v = 0, 1L, {share('0L', 'total + v')})"))


def _others(totals: DataFrame) -> DataFrame:
    """Each group under every salt of its language: the side that partners are joined from."""
    return totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))


def _partners(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows of a source with each other source of its language; a language's rows are dealt by a salt of the source."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("source <> item").drop("salt")


def baseline(totals: DataFrame, others: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair: V times the value of a term that neither has."""
    return _partners(totals, others).select("lang", "source", "item", F.expr(f"v * {excess('zero', 'item_zero')}").alias("value"))


def single_corrections(shares: DataFrame, others: DataFrame) -> DataFrame:
    """What a source's terms change in its pairs, as if the partner had none of them; terms of one share are one row."""
    alike = shares.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))
    both = _partners(alike, others).select("lang", F.expr(
        f"explode(array(struct(source, item, terms * ({excess('p', 'item_zero')} - {excess('zero', 'item_zero')}) AS value), struct(item AS source, source AS item, terms * ({excess('item_zero', 'p')} - {excess('item_zero', 'zero')}) AS value)))"
    ).alias("x"))
    return both.select("lang", "x.*")


def shared_corrections(shares: DataFrame) -> DataFrame:
    """What pairs of sources that both have a term differ by from their single corrections.

    Postings travel once, by term. A task works on whole terms, PAIRS pairs at
    a time, and puts out a sum for each pair of a block.
    """
    schema = "lang string, source string, item string, value long"

    def work(langs: pa.Array, lang: np.ndarray, names: pa.Array, source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        sizes = np.diff(np.append(starts, len(term)))
        start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        upto = np.cumsum(size)
        at = 0
        while at < len(term):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            m = size[at:end]
            left = np.repeat(np.arange(at, end), m)
            right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(start[at:end], m)
            other = left != right
            left, right = left[other], right[other]
            at = end
            if not len(left):
                continue
            f = lambda a, b: (a - b) * (a - b) // b
            pl, pr, zl, zr = p[left], p[right], zero[left], zero[right]
            value = f(pl, pr) - f(pl, zr) - f(zl, pr) + f(zl, zr)
            pairs, place = np.unique((lang[left] * len(names) + source[left]) * len(names) + source[right], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, place, value)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(pairs // len(names) ** 2)), names.take(pa.array(pairs // len(names) % len(names))), names.take(pa.array(pairs % len(names))), pa.array(sums)], names=["lang", "source", "item", "value"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key = _runs(table)
            last = int(np.searchsorted(key, key[-1]))  # the last term may go on in the next batch
            rest = table.slice(last)
            if last:
                yield from split(table.slice(0, last), key[:last])
        if rest is not None and rest.num_rows:
            yield from split(rest, _runs(rest))

    def _runs(table: pa.Table) -> np.ndarray:
        """Numbers of the runs of equal (lang, term), ascending."""
        new = np.zeros(table.num_rows, bool)
        for c in ("lang", "term"):
            codes = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(new)

    def split(table: pa.Table, term: np.ndarray) -> Iterator[pa.RecordBatch]:
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        yield from work(
            lang.dictionary, lang.indices.to_numpy().astype(np.int64), source.dictionary, source.indices.to_numpy().astype(np.int64), term, table.column("p").to_numpy(), table.column("zero").to_numpy(),
        )

    ordered = shares.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, schema)


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one, and its own leading terms.

    Null text, lang and source are read as ''. A language keeps terms of at
    least LEAST_DOCUMENTS of its documents. Part `pair`: value sums, over all
    kept terms, floor((p-q)**2/q) of the shares p of the source and q of the
    item, all ranks; 0 without kept terms. Part `term`: kept terms that the
    source has with a share above its language's, TERM_RANKS ranks. Ties rank
    by item. A language with one source has no pairs. Equal rows count
    each; other columns of docs are not read. An empty table gives an empty
    result.
    """
    posts = written(postings(docs), "postings")
    totals = written(group_totals(posts), "sources")  # small: Spark sees its size and may broadcast it
    shares = posts.where(F.col("term").isNotNull()).join(totals, ["lang", "source"]).withColumn("p", F.expr(share("n", "total + v")))
    others = _others(totals)
    moved = baseline(totals, others).unionByName(single_corrections(shares, others)).unionByName(shared_corrections(shares))
    pairs = moved.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    own = shares.withColumn("q", F.expr(share("in_lang", "lang_total + v"))).where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(excess("p", "q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TERM_RANKS)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(listed).select("lang", "source", "part", "item", "value", "rank")
