"""Source divergence audit: a three-dimensional cube of (group block, group block, term block) cells.

A group is a (lang, source) pair.  Each language keeps the terms that ``least_docs`` of its
documents hold; a group gives each kept term the smoothed share
p = 1 + floor(SCALE * (count + 5) / (N + 5 V)), in whole numbers.  The divergence of two groups of a
language is the sum over all its kept terms of |p - q|.

The groups of a language are dealt to blocks of ``group_block``, its terms by their hash to blocks of about
``term_block``.  A cell owns two group blocks and one term block and gets the slices of counts of its two
blocks; what is sent is each count once per group block of its language.  Inside, the slices are dense
matrices, also for groups without a term there, and the cell gives the partial divergence of each
pair of its groups.  A sum along the term axis ends it.

Defined cases: null text, lang and source read as ''; a group without terms and one of a language without kept
terms still occur (value 0); a language with one source has no pairs; repeated rows count each; equal values go by
the item's UTF-8 bytes; sums and shares are whole numbers throughout, for counts below 9e15.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SCALE = 1_000_000_000
EXTRA = 5
#: Entries a task counts together before it hands them on.
HELD = 400_000

#: ASCII letters in lower case and bytes of other characters stay, all else parts terms.
_FOLD = bytes(b if b > 127 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                     ("docs", pa.int64())])
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(raw: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: maximal stretches of ASCII letters (lower-cased) and non-ASCII characters."""
    return raw.translate(_FOLD).split()


class _Held:
    """Counts of a task not yet handed on: occurrences and documents of each term by group."""

    def __init__(self):
        self.n: dict[tuple, Counter] = defaultdict(Counter)
        self.docs: dict[tuple, Counter] = defaultdict(Counter)
        self.size = 0

    def add(self, group: tuple, terms: list[bytes]):
        n = self.n[group]
        before = len(n)
        n.update(terms)
        self.docs[group].update(set(terms))
        self.size += len(n) - before

    def batch(self) -> pa.RecordBatch:
        """Everything held, and a row without a term for each group; nothing is held afterwards."""
        columns: list[list] = [[], [], [], [], []]
        for (lang, source), n in self.n.items():
            rows = len(n) + 1
            docs = self.docs[lang, source]
            columns[0] += [lang] * rows
            columns[1] += [source] * rows
            columns[2] += [None, *n]
            columns[3] += [0, *n.values()]
            columns[4] += [0, *(docs[t] for t in n)]
        self.__init__()
        arrays = [pa.array(c, pa.binary()).view(pa.string()) for c in columns[:3]]
        return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.int64()) for c in columns[3:]], schema=_COUNTS)


def _count(batches):
    held = _Held()
    for batch in batches:
        rows = ([b"" if v is None else v for v in batch.column(c).cast(pa.binary()).to_pylist()]
                for c in ("lang", "source", "text"))
        for lang, source, raw in zip(*rows):
            held.add((lang, source), terms_of(raw))
            if held.size >= HELD:
                yield held.batch()
    if held.n:
        yield held.batch()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; one row with a null term per group."""
    narrow = docs.select(*(F.col(c).cast("string").alias(a) for c, a in ((text, "text"), (lang, "lang"), (source, "source"))))
    return (narrow.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term")
            .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 kept)) by long division in steps of a thousand: no product overflows."""
    rest, size = f"({count} + {EXTRA})", f"({total} + {EXTRA} * {kept})"
    digits = []
    for _ in range(3):
        digits.append(f"({rest} * 1000) div {size}")
        rest = f"(({rest} * 1000) % {size})"
    return F.expr(f"1 + (({digits[0]}) * 1000 + ({digits[1]})) * 1000 + ({digits[2]})")


class Shares:
    """The written tables of an audit: kept ``counts`` with both shares, and ``groups``."""

    def __init__(self, docs: DataFrame, least_docs: int, group_block: int, term_block: int):
        counts = materialise(term_counts(docs), "divergence-counts")
        terms = materialise(counts.where("term is not null").groupBy("lang", "term")
                            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
                            .where(F.col("docs") >= least_docs).drop("docs"), "divergence-terms")
        kept = materialise(counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"),
                           "divergence-kept")
        langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        place = Window.partitionBy("lang").orderBy(F.xxhash64("source"), "source")
        self.groups = materialise(
            counts.where("term is null").select("lang", "source")
            .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
            .na.fill(0, ["total", "v", "lang_total"])
            .withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "v")))
            .withColumn("block", F.floor((F.row_number().over(place) - 1) / group_block).cast("int"))
            .withColumn("slices", F.ceil(F.col("v") / term_block).cast("int")), "divergence-groups")
        self.terms = terms
        self.counts = kept.join(self.groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))


def _slice_of(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.col("slices")).cast("int")


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell: ``row`` 0 is a group, 1 a count, 2 the number of kept terms."""
    kind = table.column("row").to_numpy()
    key = {c: table.column(c)[0].as_py() for c in ("lang", "a", "b")}
    side = table.column("side").to_numpy()
    source = table.column("source").cast(pa.binary())
    v = int(table.column("n").filter(pa.array(kind == 2))[0].as_py())
    sums, names = [], []
    term = table.column("term").cast(pa.binary()).filter(pa.array(kind == 1)).combine_chunks().dictionary_encode()
    codes, present = term.indices.to_numpy(), len(term.dictionary)
    count_side, count_source = side[kind == 1], source.filter(pa.array(kind == 1)).combine_chunks()
    count_p = table.column("n").to_numpy()[kind == 1]
    for block in (key["a"], key["b"]):
        of = (kind == 0) & (side == block)
        own = source.filter(pa.array(of)).combine_chunks()
        zero = table.column("n").to_numpy()[of]
        order = np.argsort(np.array(own.to_pylist(), object), kind="stable")
        own, zero = own.take(pa.array(order)), zero[order]
        # every kept term of the slice that no group of the cell holds adds the same: |zero - zero|
        matrix = np.repeat(zero[:, None], present, axis=1)
        mine = count_side == block
        row = pa.compute.index_in(count_source.filter(pa.array(mine)), value_set=own).to_numpy(zero_copy_only=False)
        matrix[row.astype(np.int64), codes[mine]] = count_p[mine]
        sums.append((matrix, zero))
        names.append(own.to_pylist())
    (one, one_zero), (two, two_zero) = sums
    out_a, out_b, values = [], [], []
    for i, name in enumerate(names[0]):
        value = np.abs(two - one[i]).sum(axis=1) + (v - present) * np.abs(two_zero - one_zero[i])
        for j, other in enumerate(names[1]):
            if key["a"] != key["b"] or name < other:
                out_a.append(name)
                out_b.append(other)
                values.append(int(value[j]))
    return pa.table({"lang": pa.array([key["lang"]] * len(values), pa.string()),
                     "source": pa.array(out_a, pa.binary()).view(pa.string()),
                     "item": pa.array(out_b, pa.binary()).view(pa.string()), "value": pa.array(values, pa.int64())})


def pair_divergences(shares: Shares) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of different sources of a language."""
    groups, blocks = shares.groups, F.col("blocks")
    last = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.max("slices").alias("slices"),
                                      F.max("v").alias("v"))
    # each block meets every block of its language: (a, b) with a <= b, the own block on either side
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    cell = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), F.col("block").alias("side")]
    members = (groups.where("v > 0").select("lang", "source", "zero", "block", "slices")
               .join(last.select("lang", "blocks"), "lang").select("*", other)
               .select("lang", *cell, F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("t"), F.lit(0).alias("row"),
                       "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("n")))
    counts = (shares.counts.select("lang", "source", "term", "p", "block", "slices")
              .join(last.select("lang", "blocks"), "lang").withColumn("t", _slice_of()).select("*", other)
              .select("lang", *cell, "t", F.lit(1).alias("row"), "source", "term", F.col("p").alias("n")))
    sizes = (shares.terms.join(last, "lang").withColumn("t", _slice_of())
             .groupBy("lang", "t", "blocks").agg(F.count("*").alias("n"))
             .select("lang", "t", "n", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), "blocks")
             .select("lang", "a", F.explode(F.expr("sequence(a, blocks - 1)")).alias("b"), F.col("a").alias("side"), "t",
                     F.lit(2).alias("row"), F.lit("").alias("source"), F.lit(None).cast("string").alias("term"), "n"))
    partial = (members.unionByName(counts).unionByName(sizes).groupBy("lang", "a", "b", "t")
               .applyInArrow(_cell_or_none, "lang string, source string, item string, value long"))
    found = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = found.select("lang", F.explode(F.array(
        F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    bare = groups.where("v = 0").select("lang", "source")
    nothing = (bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
               .select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    return found.select("lang", "x.source", "x.item", "value").unionByName(nothing)


def _cell_or_none(table: pa.Table) -> pa.Table:
    """A slice without kept terms has groups only and adds nothing."""
    if not (table.column("row").to_numpy() == 2).any():
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()),
                         "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    return _cell(table)


def term_divergences(shares: Shares) -> DataFrame:
    """(lang, source, item, value) for each kept term whose share in a group is above that in its language."""
    return (shares.counts.withColumn("q", share("lang_n", "lang_total", "v")).where("n > 0 and p > q")
            .select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))


def audit_sources(docs: DataFrame, least_docs: int = 30, top: int = 50, group_block: int = 8,
                  term_block: int = 4096) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs, and the ``top`` terms of each group.

    A cell holds at most 2 ``group_block`` groups times about ``term_block`` terms; a count is sent
    once per group block of its language.  Larger group blocks send less and need more memory.
    """
    shares = Shares(docs, least_docs, group_block, term_block)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pair_divergences(shares).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = (term_divergences(shares).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
             .withColumn("part", F.lit("term")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
