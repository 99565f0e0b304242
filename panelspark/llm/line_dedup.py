"""Line dedup: an exact set-similarity join of lines removes each line that resembles an earlier one.

The tokens of a line are its distinct runs of ``width`` words (a shorter line is one run). Single words won't do as
tokens: the rarest words of a line recur in a share of all lines, so their lists, and the pairs to try, grow with the
square of the corpus, and the contract for word shingles asks for runs of five. Tokens are ordered by rarity, the number
of lines that hold them, and lines matched by prefix, positional and length filters, then verified: a line goes if any
earlier line, by (doc_id, place in the text), has a Jaccard of at least ``percent``%, whether or not that one stays
itself. First occurrences of everything stay. Lines of fewer than ``least_words`` words are never compared and always
stay; with the default only lines without a word do.

Within a block of documents equal lines fall to the first at once. Only lines that share a token with another block's
or line's go on to the join, so ordinary lines cost no row outside their block.

A text keeps its other lines, their ends and their order. A null text stays null and an empty one empty; a text of which
every line goes is empty. Rows of a null doc_id come after all others. Rows that repeat id and text are one document.
Very long texts and lines are read whole; an empty table gives an empty result. Ties in rarity are settled by the
tokens' hashes. All other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import counting, set_join
from panelspark.llm.shared import BLOCK_BYTES, block_count, blocked_table, dealt, forget, tidy, written
from panelspark.llm.tokens import follow, mix, run_hashes, text_buffer, word_hashes, word_spans

WIDTH, PERCENT, LEAST_WORDS = 5, 80, 1
_LONG, _INTS = pa.int64(), pa.list_(pa.int32())
_RECORD = pa.schema(
    [("block", pa.int32()), ("doc", _LONG), ("row", _LONG), ("gone", _INTS), ("line", pa.int32()), ("d1", _LONG), ("d2", _LONG), ("n", pa.int32())]
    + [(f"sig{k}", _LONG) for k in range(1, 5)]
    + [("shared", pa.binary()), ("token", pa.list_(_LONG)), ("place", _INTS), ("parts", _INTS)]
)
_RECORD_SQL = "block int, doc long, row long, gone array<int>, line int, d1 long, d2 long, n int, sig1 long, sig2 long, sig3 long, sig4 long, shared binary, token array<long>, place array<int>, parts array<int>"
_LAST = np.int64(2**63 - 1)


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each line begins and which text it belongs to: a text's lines are what its line ends close, and what follows the last."""
    begin = counting.distinct(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    begin = begin[begin < len(data)]
    return begin, np.searchsorted(offsets, begin, side="right") - 1


class Lines:
    """The compared lines of a block: their sets, and which of them come first among equals."""

    def __init__(self, docs: pa.Table, width: int, least_words: int):
        data, offsets = text_buffer(docs.column("__text"))
        begin, doc = line_starts(data, offsets)
        bounds = np.append(begin, len(data))
        self.doc_of_line = doc
        self.number = np.arange(len(begin)) - np.searchsorted(begin, offsets)[doc]
        starts, ends, counts = word_spans(data, bounds)
        words = word_hashes(data, starts, ends)
        size = np.diff(counts)
        n = np.where(size >= max(width, least_words), size - width + 1, 0)
        runs = run_hashes(words, width)
        self.lines = np.flatnonzero(n)
        self.n = n[self.lines]
        self.at = np.cumsum(self.n) - self.n
        total = int(self.n.sum())
        self.value = runs[np.repeat(counts[self.lines] - self.at, self.n) + np.arange(total)] if total else runs[:0]
        self._drop_repeats()
        if least_words < width:
            self._add_short(words, counts, size, least_words, width)
        self.d1 = np.add.reduceat(self.value, self.at) if len(self.at) else np.zeros(0, np.uint64)
        self.d2 = np.add.reduceat(mix(self.value + np.uint64(0x632BE59BD9B4E019)), self.at) if len(self.at) else np.zeros(0, np.uint64)
        ids = docs.column("__doc").combine_chunks().to_numpy(zero_copy_only=False)
        rows = docs.column("__row").combine_chunks().to_numpy(zero_copy_only=False)
        self.doc, self.row = ids[doc[self.lines]], rows[doc[self.lines]]
        number = self.number[self.lines]
        order = np.lexsort((number, self.row, self.doc, self.n, self.d2, self.d1))
        d1, d2, n = self.d1[order], self.d2[order], self.n[order]
        lead = np.flatnonzero(np.r_[True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]) | (n[1:] != n[:-1])]) if len(order) else np.zeros(0, np.int64)
        head = np.repeat(order[lead], np.diff(np.append(lead, len(order))))  # each line's first equal, in this order
        self.first = np.zeros(len(order), bool)  # also true for the same line of a repeated row
        self.first[order] = (self.row[order] == self.row[head]) & (number[order] == number[head]) & (self.doc[order] == self.doc[head])
        self.lead = np.zeros(len(order), bool)
        self.lead[order[lead]] = True

    def _drop_repeats(self) -> None:
        """Keeps one of equal tokens of a line."""
        line = np.repeat(np.arange(len(self.n), dtype=np.uint64), self.n)
        own = self.value + line * np.uint64(0x9E3779B97F4A7C15)
        ranked = np.sort(own)
        twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if not len(twice):
            return
        some = counting.among(own, twice)[0]
        keep = np.ones(len(own), bool)
        order = some[np.lexsort((some, self.value[some], line[some]))]
        keep[order[1:][(self.value[order][1:] == self.value[order][:-1]) & (line[order][1:] == line[order][:-1])]] = False
        self.value = self.value[keep]
        self.n = np.bincount(line[keep].astype(np.int64), minlength=len(self.n))
        self.at = np.cumsum(self.n) - self.n

    def _add_short(self, words: np.ndarray, counts: np.ndarray, size: np.ndarray, least_words: int, width: int) -> None:
        """Lines of fewer words than a run are one token."""
        short = np.flatnonzero((size >= max(1, least_words)) & (size < width))
        if not len(short):
            return
        extra = np.zeros(len(short), np.uint64)
        for k in np.unique(size[short]).tolist():
            some = size[short] == k
            at = counts[:-1][short[some]]
            h = words[at]
            for j in range(1, k):
                h = follow(h, words[at + j])
            extra[some] = mix(h + np.uint64(k))
        lines, n = np.concatenate([self.lines, short]), np.concatenate([self.n, np.ones(len(short), np.int64)])
        value, begin = np.concatenate([self.value, extra]), np.concatenate([self.at, len(self.value) + np.arange(len(short))])
        order = np.argsort(lines, kind="stable")
        self.lines, self.n = lines[order], n[order]
        self.at = np.cumsum(self.n) - self.n
        self.value = value[np.repeat(begin[order] - self.at, self.n) + np.arange(len(value))]


def _ask(buckets: int, bits: int, width: int, least_words: int):
    def run(docs: pa.Table) -> pa.Table:
        x = Lines(docs, width, least_words)
        held, counts = np.unique(x.value[np.repeat(x.lead, x.n)] >> np.uint64(64 - bits), return_counts=True)
        return counting.ask(docs.column("__block")[0].as_py(), held, counts, buckets, bits)

    return run


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _table(rows: int, **columns) -> pa.Table:
    """Rows of _RECORD; what isn't given is null."""
    return pa.Table.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _RECORD], schema=_RECORD)


def _repeats(x: Lines, block: int) -> pa.Table:
    """A row for each document with lines that an equal one of its block precedes."""
    gone = np.flatnonzero(~x.first)
    if not len(gone):
        return _RECORD.empty_table()
    doc = x.doc_of_line[x.lines[gone]]
    start = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    lists = _lists(x.number[x.lines[gone]].astype(np.int32), np.diff(np.append(start, len(gone))))
    return _table(len(start), block=pa.array(np.full(len(start), block)), doc=pa.array(x.doc[gone[start]]), row=pa.array(x.row[gone[start]]), gone=lists)


def _records(bits: int, width: int, percent: int, least_words: int):
    """Of each line that comes first in its block and could have a match elsewhere, what it posts and its shared tokens;
    of each document the lines that are gone already."""

    def run(key, docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _RECORD.empty_table()
        x, block = Lines(docs, width, least_words), docs.column("__block")[0].as_py()
        places, totals = counting.shared_of(told)
        mine = np.flatnonzero(np.repeat(x.lead, x.n))
        value = x.value[mine]
        where, at = counting.among(value >> np.uint64(64 - bits), counting.distinct(value >> np.uint64(64 - bits))[places])
        value, df = value[where], totals[at]
        line = np.searchsorted(x.at, mine[where], side="right") - 1
        alone = x.n - np.bincount(line, minlength=len(x.n))  # tokens that no other line holds come first in the order
        prefix = set_join.prefix_length(x.n, 1, percent)
        live = (alone < prefix)[line]
        value, line, df = value[live], line[live], df[live]
        if not len(line):
            return _repeats(x, block)
        order = np.lexsort((value, df, line))
        value, line, df = value[order], line[order], df[order]
        first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
        size = np.diff(np.append(first, len(line)))
        place = alone[line] + np.arange(len(line)) - np.repeat(first, size)
        post = place < prefix[line]
        posts = np.add.reduceat(post.astype(np.int64), first)
        chosen = line[first]
        whole = np.repeat(x.at[chosen] - (np.cumsum(x.n[chosen]) - x.n[chosen]), x.n[chosen]) + np.arange(int(x.n[chosen].sum()))
        sigs = set_join.signature(x.value[whole], np.cumsum(x.n[chosen]) - x.n[chosen])
        sets = value[np.lexsort((value, line))].view("V8")
        ends = np.append(first, len(line)) * 8
        shared = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(sets))])
        plain = dict(block=np.full(len(first), block), doc=x.doc[chosen], row=x.row[chosen], line=x.number[x.lines[chosen]], d1=x.d1[chosen].view(np.int64), d2=x.d2[chosen].view(np.int64), n=x.n[chosen], **{f"sig{k + 1}": sigs[:, k] for k in range(4)})
        lists = dict(token=_lists(value[post].view(np.int64), posts), place=_lists(place[post].astype(np.int32), posts), parts=_lists(set_join.list_parts(df[post]), posts))
        return pa.concat_tables([_table(len(first), **{k: pa.array(np.ascontiguousarray(v)) for k, v in plain.items()}, shared=shared, **lists), _repeats(x, block)])

    return run


def _cleaned(key, docs: pa.Table, gone: pa.Table) -> pa.Table:
    """The texts of a block without the lines listed; only texts that lose some are taken apart."""
    data, offsets = text_buffer(docs.column("__text"))
    begin, doc = line_starts(data, offsets)
    total = np.bincount(doc, minlength=docs.num_rows)
    removed = np.zeros(docs.num_rows, np.int64)
    listed: dict[int, set] = {}
    for row, lines in zip(gone.column("row").to_pylist(), gone.column("lines").to_pylist()):
        listed.setdefault(row, set()).update(lines)
    texts = docs.column("__text").combine_chunks()
    if listed and docs.num_rows:
        rows = docs.column("__row").combine_chunks().to_numpy(zero_copy_only=False)
        hit = np.flatnonzero(np.isin(rows, np.fromiter(listed, np.int64, len(listed))))
        new, old = [], texts
        for d in hit.tolist():
            drop = listed[int(rows[d])]
            # a text that ends with a line end has an empty piece behind it, which is no line; without its last line
            # the one before gives its end up
            lines = old[d].as_py().split("\n")
            new.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
            removed[d] = len(drop)
        if len(hit):
            mask = np.zeros(docs.num_rows, bool)
            mask[hit] = True
            texts = pc.replace_with_mask(old, pa.array(mask), pa.array(new, old.type))
    kept = docs.set_column(docs.column_names.index("__text"), "__text", texts).drop_columns(["__block", "__doc", "__row"])
    return kept.append_column("__lines", pa.array(total, pa.int64())).append_column("__removed", pa.array(removed, pa.int64()))


def _gone(records: DataFrame, percent: int) -> DataFrame:
    """``block, row, lines`` that an earlier line resembles. Deletes ``records``."""
    same = ["d1", "d2", "n"]
    lines = records.where("gone is null").drop("gone")
    where = F.struct("doc", "row", "line", "block")
    firsts = lines.groupBy(*same).agg(F.min(where).alias("f"))
    packed = written(records.where("gone is not null").select("block", "row", F.col("gone").alias("lines")), "repeats-in-blocks")
    known = written(lines.join(firsts, same).withColumn("key", F.xxhash64(*same)).withColumn("again", F.expr("not (doc = f.doc and row = f.row and line = f.line)")).withColumn("leads", where == F.col("f")).drop("f"), "lines")
    forget(records)
    leading = known.where("leads").withColumn("level", F.lit(1)).withColumn("vertex", F.col("key"))
    found = set_join.links(leading, percent, ["doc", "row", "line"], later_only=True)
    later = written(found.select(F.col("b").alias("key")).distinct(), "resembling")
    one = lambda df: df.select("block", "row", F.array("line").alias("lines"))
    out = packed.unionByName(one(known.where("again"))).unionByName(one(known.where("not again").join(later, "key", "left_semi")))
    out = written(out, "lines-to-remove")
    forget(packed, known, found, later)
    return out


def dedup_lines(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, least_words: int = LEAST_WORDS, report: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (columns doc_id, text and any others) with the repeated lines gone from text; with ``report`` also n_lines and n_removed of each row."""
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    doc, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    plain = plain.withColumn("__text", F.col(text).cast("string")).drop(text).withColumn("__doc", F.coalesce(F.col(doc).cast("long"), F.lit(int(_LAST))))
    blocks = block_count(plain, "__text", block_bytes)
    bits = counting.bits_for(blocks * block_bytes)
    table = blocked_table(dealt(plain, doc, "__text", blocks), "__block", blocks)
    thin = table.select("__block", "__doc", "__row", "__text")
    asked = thin.groupBy("__block").applyInArrow(tidy(_ask(blocks, bits, width, least_words)), counting.ASKED)
    answers = written(counting.shared_items(asked), "line-token-counts")
    records = written(thin.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(tidy(_records(bits, width, percent, least_words)), _RECORD_SQL), "line-records")
    forget(answers)
    gone = _gone(records, percent)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name not in ("__block", "__doc", "__row")) + ", __lines long, __removed long"
    clean = table.groupBy("__block").cogroup(gone.groupBy("block")).applyInArrow(tidy(_cleaned), schema)
    out = [F.col("__text" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(names)]
    return clean.select(*out, *([F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed")] if report else []))
