"""How far the sources of a language differ in their words: divergences and telling terms.

Sort-based streaming. A task scans its own documents first: for each block of documents
it gives one partial run per (lang, term, source), with the term's occurrences and the
number of the block's documents that have it. Blocks share no document, so both add up.
Partial runs are dealt by (lang, term) and sorted by (lang, term, source, block); a
run-length scan adds them up in order and holds three rows at most. It gives a row per
source and, when a term ends, one with the language's total, of terms in at least
``least`` documents. A term that all documents share sends one row per block and source.

Totals per group turn counts into probabilities, in whole billionths:
``1 + floor(10^9 * (count + 1) / (N + V))``. Kept rows are then dealt and sorted once
more, and a second scan gives the terms that a source has more often than its language,
and partial sums for pairs of sources that both have a term. The divergence of a pair
is taken over all kept terms, but only terms that both sources have are looked at pair
by pair: where one or both have none, their probabilities depend on counts alone, and
sums over a table of (source, count, number of terms) give the rest.

All arithmetic is whole-numbered and exact: products are below 10^19 in 128-bit
decimals, or below 2^63.

Edge cases: null text, lang and source are empty strings; a row is a document, also where
doc_ids repeat; empty texts count for their group, which is listed like others; a language
without kept terms has pairs of value 0; equal values rank by item in order of UTF-8;
texts of any length are read whole, and a text without separators is one term; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Distinct (source, term) that a task holds before it gives a block's runs, and bytes of text a block.
BLOCK_TERMS = 400_000
BLOCK_BYTES = 64 << 20
#: Rows a batch of results.
BATCH = 1 << 16
#: Pairs that are summed at once, and sums that a task holds.
PAIRS = 1 << 21
#: Probabilities are in whole parts of this.
WHOLE = 1_000_000_000
#: Bytes that belong to terms, as themselves or lower case; all others become blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_runs(documents: DataFrame) -> DataFrame:
    """lang, term, source, block, n, df: partial runs of each task's blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        block, size = TaskContext.get().partitionId() << 32, 0

        def runs() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = list(n)
                for at in range(0, len(terms), BATCH):
                    some = terms[at : at + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()),
                            pa.array(some, pa.binary()).cast(pa.string()),
                            pa.array([source] * len(some), pa.string()),
                            pa.array([block] * len(some), pa.int64()),
                            pa.array(map(n.__getitem__, some), pa.int64(), size=len(some)),
                            pa.array(map(df.__getitem__, some), pa.int64(), size=len(some)),
                        ],
                        ["lang", "term", "source", "block", "n", "df"],
                    )

        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                text = text.as_py()
                before = len(n)
                words = text.translate(_TERM_BYTES).split()
                n.update(words)
                df.update(set(words))
                size += len(text) + BLOCK_BYTES // BLOCK_TERMS * (len(n) - before)
                if size > BLOCK_BYTES:
                    yield from runs()
                    held.clear()
                    block, size = block + 1, 0
        yield from runs()

    plain = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(run, "lang string, term string, source string, block long, n long, df long")


def _starts(*columns: pa.Array) -> np.ndarray:
    """Whether each row differs from the one before in one of the columns."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _sorted_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Kept terms' counts by source, and their totals with a null source, from sorted partial runs."""
    held, out_n, out_df = None, 0, 0
    batches = iter(batches)
    final = False
    while not final:
        batch = next(batches, None)
        final = batch is None
        parts = [b.select(["lang", "term", "source", "n", "df"]) for b in (held, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        rows = pa.concat_batches(parts)
        lang, term, source, n, df = rows.columns
        n, df = n.to_numpy(), df.to_numpy()
        new_term = _starts(lang, term)
        at = np.flatnonzero(new_term | _starts(source))
        term_at = np.flatnonzero(new_term)
        run_n, run_df = np.add.reduceat(n, at), np.add.reduceat(df, at)
        term_n, term_df = np.add.reduceat(n, term_at), np.add.reduceat(df, term_at)
        term_n[0] += out_n
        term_df[0] += out_df
        of = np.searchsorted(term_at, at, "right") - 1
        keep = term_df >= least
        ready, whole = keep[of], keep.copy()
        held, out_n, out_df = None, 0, 0
        if not final:
            # The last term may go on: if it is sure to be kept, all but its last source can go now.
            own = np.flatnonzero(of == len(term_at) - 1)
            left = own[-1:] if keep[-1] else own
            ready[left] = whole[-1] = False
            if keep[-1]:
                out_n, out_df = int(term_n[-1] - run_n[left[0]]), int(term_df[-1] - run_df[left[0]])
            held = rows.take(pa.array(at[left]))
            held = held.set_column(3, "n", pa.array(run_n[left])).set_column(4, "df", pa.array(run_df[left]))
        by_source, by_term = pa.array(at[ready]), pa.array(term_at[whole])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([lang.take(by_source), lang.take(by_term)]),
                pa.concat_arrays([term.take(by_source), term.take(by_term)]),
                pa.concat_arrays([source.take(by_source), pa.nulls(len(by_term), pa.string())]),
                pa.array(np.concatenate((run_n[ready], term_n[whole]))),
            ],
            ["lang", "term", "source", "n"],
        )


def kept_counts(documents: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, source, n of terms in at least ``least`` documents of the language; a null source has the language's total."""
    dealt = term_runs(documents).repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "block")
    return dealt.mapInArrow(lambda b: _sorted_runs(b, least), "lang string, term string, source string, n long")


def _gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (lang, term, source, p, none) in order of term, the total first: terms above their language, and sums of pairs."""
    names: list[tuple[str, str]] = []
    codes: dict[tuple[str, str], int] = {}
    keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
    held = None
    final = False
    batches = iter(batches)

    def rows(lang, source, item, value, is_term: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [lang, source, item, pa.array(value), pa.array(np.full(len(value), is_term))], ["lang", "source", "item", "value", "is_term"]
        )

    def pairs() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(keys), BATCH):
            a, b = (keys[at : at + BATCH] >> 32).tolist(), (keys[at : at + BATCH] & 0xFFFFFFFF).tolist()
            lang, source, item = ([names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b])
            yield rows(pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), sums[at : at + BATCH], False)

    while not final:
        batch = next(batches, None)
        final = batch is None
        parts = [b for b in (held, batch) if b is not None and b.num_rows]
        if not parts:
            continue
        all_rows = pa.concat_batches(parts)
        begins = np.flatnonzero(_starts(all_rows.column("lang"), all_rows.column("term")))
        # The last term may go on in the next batch.
        whole = all_rows.num_rows if final else int(begins[-1])
        held = None if final else all_rows.slice(whole)
        if not whole:
            continue
        lang, term, source, p, none = all_rows.slice(0, whole).columns
        p, none = p.to_numpy(), none.to_numpy()
        begins = begins[begins < whole]
        sizes = np.diff(begins, append=whole) - 1
        own = np.ones(whole, bool)
        own[begins] = False
        own = np.flatnonzero(own)
        q = np.repeat(p[begins], sizes)
        above = own[p[own] > q]
        if len(above):
            take = pa.array(above)
            yield rows(lang.take(take), source.take(take), term.take(take), _gain(p[above], q[p[own] > q]), True)
        code = np.empty(len(own), np.int64)
        for i, name in enumerate(zip(lang.take(pa.array(own)).to_pylist(), source.take(pa.array(own)).to_pylist())):
            if name not in codes:
                codes[name] = len(names)
                names.append(name)
            code[i] = codes[name]
        p, none = p[own], none[own]
        first, many = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
        # A row meets the rows of its term; as many rows at a time as make PAIRS pairs.
        until = np.cumsum(many)
        at = 0
        while at < len(own):
            stop = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + PAIRS, "right")))
            k = many[at:stop]
            a = np.repeat(np.arange(at, stop), k)
            b = np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[at:stop], k)
            other = a != b
            a, b = a[other], b[other]
            found = _gain(p[a], p[b]) - _gain(p[a], none[b]) - _gain(none[a], p[b]) + _gain(none[a], none[b])
            keys, sums = np.concatenate((keys, (code[a] << 32) | code[b])), np.concatenate((sums, found))
            order = np.argsort(keys, kind="stable")
            keys, sums = keys[order], sums[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            if len(new):
                keys, sums = keys[new], np.add.reduceat(sums, new)
            if len(keys) > PAIRS:
                yield from pairs()
                keys, sums = keys[:0], sums[:0]
            at = stop
    yield from pairs()


def _share(count: str) -> Column:
    """The probability of a count among ``total`` occurrences of ``vocabulary`` terms."""
    return F.expr(f"1 + ({WHOLE}BD * ({count} + 1)) div (total + vocabulary)")


def _far(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def divergence(documents: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair`` has each other source of the language with the divergence from it, part
    ``term`` the ``top`` terms that the source has more often than its language.
    """
    space = Workspace(documents.sparkSession, "source-divergence")
    kept = space.write(kept_counts(documents, least), "kept")
    is_source = F.col("source").isNotNull()
    languages = kept.where(~is_source).groupBy("lang").agg(F.sum("n").alias("all_terms"), F.count("*").alias("vocabulary"))
    totals = kept.where(is_source).groupBy("lang", "source").agg(F.sum("n").alias("own_terms"))
    groups = (
        documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")])
        .distinct()
        .join(totals, ["lang", "source"], "left")
        .join(languages, "lang", "left")
        .select("lang", "source", F.coalesce("own_terms", F.lit(0)).alias("total"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"))
    )
    groups = space.write(groups, "groups")
    none = F.when(F.col("vocabulary") > 0, _share("0"))
    shares = kept.join(groups, ["lang", "source"]).select("lang", "term", "source", _share("n").alias("p"), none.alias("none"))
    language = languages.withColumnRenamed("all_terms", "total")
    whole = kept.where(~is_source).join(language, "lang").select("lang", "term", "source", _share("n").alias("p"), F.lit(0).cast("long").alias("none"))
    dealt = shares.unionByName(whole).repartition("lang", "term").sortWithinPartitions("lang", "term", F.col("source").asc_nulls_first())
    compared = dealt.mapInArrow(_compared, "lang string, source string, item string, value long, is_term boolean")
    compared = space.write(compared, "compared")

    # Beside terms of both sources: those that x alone has, by count, and those that neither has.
    with_none = groups.withColumn("none", none)
    other = with_none.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    counts = kept.where(is_source).groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    counts = counts.join(groups, ["lang", "source"]).withColumns({"p": _share("n"), "none": none})
    met = counts.join(other, "lang").where("source <> item")
    exact = lambda text: F.expr(text).cast("decimal(38,0)")
    forth = exact(f"cast(terms as decimal(19,0)) * (({_far('p', 'other')}) - ({_far('none', 'other')}))")
    back = exact(f"cast(terms as decimal(19,0)) * (({_far('other', 'p')}) - ({_far('other', 'none')}))")
    alone = met.select("lang", "source", "item", forth.alias("forth"), back.alias("back")).groupBy("lang", "source", "item").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back"))
    side = lambda a, b, value: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(value).alias("value"))
    sides = F.inline(F.array(side("source", "item", "forth"), side("item", "source", "back")))
    neither = with_none.join(other, "lang").where("source <> item")
    neither = neither.select("lang", "source", "item", F.coalesce(exact(f"cast(vocabulary as decimal(19,0)) * ({_far('none', 'other')})"), F.lit(0)).alias("value"))
    both = compared.where("NOT is_term").select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    pairs = alone.select("lang", sides).unionByName(neither).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = compared.where("is_term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
