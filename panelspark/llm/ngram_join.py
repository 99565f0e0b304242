"""N-gram Jaccard join: documents whose sets of word shingles overlap, by adaptive multi-match prefixes.

A document's set holds its distinct runs of ``width`` words. Documents of equal sets are one class, which takes part
once. Each class orders its shingles by how many classes hold them. It may demand L shared shingles instead of one, if
it lengthens its prefix by L - 1: each class takes the L for which its lists, plus the checks that they lead to, are
expected to be cheapest. Of two classes the smaller L holds. Classes that post a common shingle meet under the list's
hub (``set_join``), where pairs with enough matches in their prefixes are verified on their whole sets.

Null, empty and word-less texts have n_shingles 0 and are linked with nothing, as their own component. Rows with a null
doc_id get their n_shingles and a null component_id. Rows that repeat a doc_id are one vertex, whether their texts are
equal or not. Very long texts are read whole. An empty table gives an empty result. Ties in rarity are settled by the
shingles' hashes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import counting, set_join
from panelspark.llm.graph import components
from panelspark.llm.shared import BLOCK_BYTES, block_count, blocked_table, bounded, dealt, forget, tidy, written
from panelspark.llm.tokens import mix, pieces, shingle_sets

WIDTH, PERCENT, MOST_MATCHES = 5, 80, 6
#: Cost of verifying a candidate, in postings read.
CHECK_COST = 40
_DIGEST = "block int, row long, doc_id long, n_shingles long, d1 long, d2 long"
_RECORD = "key long, vertex long, n int, level int, sig1 long, sig2 long, sig3 long, sig4 long, shared binary, token array<long>, place array<int>, parts array<int>"


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in pieces(batch, "text"):
                rows = []
                for s in shingle_sets(t.column("text"), width):
                    other = mix(s + np.uint64(0x632BE59BD9B4E019))
                    rows.append((len(s), s.sum(dtype=np.uint64), other.sum(dtype=np.uint64)))
                yield pa.RecordBatch.from_arrays([t.column("__block"), t.column("__row"), t.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *(pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in (1, 2))], names=["block", "row", "doc_id", "n_shingles", "d1", "d2"])

    return run


def _sets(docs: pa.Table, wanted: pa.Table, width: int) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Keys, vertices and sets of the classes that a row of this block stands for."""
    named = dict(zip(wanted.column("row").to_pylist(), zip(wanted.column("key").to_pylist(), wanted.column("rep").to_pylist())))
    docs = docs.filter(pc.is_in(docs.column("__row"), value_set=pa.array(list(named), pa.int64())))
    rows = docs.column("__row").to_pylist()
    if len(set(rows)) < len(rows):  # repeated rows of a block stand once
        docs = docs.take(pa.array(sorted({r: k for k, r in reversed(list(enumerate(rows)))}.values())))
    keys, reps, sets = [], [], []
    for t in pieces(docs, "text"):
        for row in t.column("__row").to_pylist():
            keys.append(named[row][0]), reps.append(named[row][1])
        sets += shingle_sets(t.column("text"), width)
    return keys, reps, sets


def _distinct(sets: list[np.ndarray], bits: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - bits)


def _ask(buckets: int, bits: int, width: int):
    def run(key, docs: pa.Table, reps: pa.Table) -> pa.Table:
        _, _, sets = _sets(docs, reps, width)
        distinct, counts = np.unique(_distinct(sets, bits), return_counts=True)
        return counting.ask(key[0].as_py(), distinct, counts, buckets, bits)

    return run


def choose_level(df: np.ndarray, n: int, percent: int, most: int = MOST_MATCHES) -> int:
    """Matches to demand, by the ascending counts of the shingles that other classes hold too: the L from 1 to ``most`` of least postings of the longer prefix plus checks, of which L matches leave one in L."""
    alone = n - len(df)
    lists = np.cumsum(df - 1)
    best, level = None, 1
    for at in range(1, min(most, max(1, (percent * n + 99) // 100)) + 1):
        posted = min(set_join.prefix_length(n, at, percent), n) - alone
        read = lists[posted - 1] if posted > 0 else 0
        cost = read + CHECK_COST * read / at
        if best is None or cost < best:
            best, level = cost, at
    return level


def _records(bits: int, width: int, percent: int):
    def run(key, docs: pa.Table, side: pa.Table) -> pa.Table:
        keys, reps, sets = _sets(docs, side.filter(pc.is_valid(side.column("key"))), width)
        rows: dict[str, list] = {f.split()[0]: [] for f in _RECORD.split(", ")}
        places, totals = counting.shared_of(side.filter(pc.is_valid(side.column("bucket"))))
        items = _distinct(sets, bits)
        held = counting.distinct(items)[places]
        where, at = counting.among(items, held)  # hashes are cut to spare traffic: counts are never too low
        ends = np.cumsum([len(s) for s in sets])
        cuts = np.searchsorted(where, ends) if len(sets) else ends
        for k, (s, e, a, b) in enumerate(zip(sets, ends.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist())):
            n = len(s)
            alone = n - (b - a)  # shingles that no other class holds come first in the order
            if a == b or alone >= set_join.prefix_length(n, MOST_MATCHES, percent):
                continue
            mine, df = s[where[a:b] - (e - n)], totals[at[a:b]]
            order = np.lexsort((mine, df))
            level = choose_level(df[order], n, percent)
            post = order[: max(set_join.prefix_length(n, level, percent) - alone, 0)]
            if not len(post):
                continue
            sigs = set_join.signature(s, np.zeros(1, np.int64))[0].tolist()
            values = (keys[k], reps[k], n, level, *sigs, mine.tobytes(), mine[post].view(np.int64), np.arange(alone, alone + len(post), dtype=np.int32), set_join.list_parts(df[post]))
            for column, v in zip(rows.values(), values):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    return run


def ngram_join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's ``doc_id, n_shingles, component_id`` from its ``doc_id`` and ``text``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = block_count(docs, block_bytes=block_bytes)
    bits = counting.bits_for(blocks * block_bytes)
    table = blocked_table(dealt(docs, "doc_id", "text", blocks), "__block", blocks)
    digests = written(bounded(table).mapInArrow(tidy(_digests(width)), _DIGEST), "digests")
    same = ["d1", "d2", "n_shingles"]
    known = digests.where("doc_id is not null")
    found = known.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "block", "row")).alias("first"), F.count(F.lit(1)).alias("members"))
    classes = written(found.select(*same, "members", F.col("first.doc_id").alias("rep"), "first.block", "first.row", F.monotonically_increasing_id().alias("key")), "classes")
    reps = classes.select("block", "row", "rep", "key")
    thin = table.where("doc_id is not null").select("__block", "__row", "text")
    asked = thin.groupBy("__block").cogroup(reps.groupBy("block")).applyInArrow(tidy(_ask(blocks, bits, width)), counting.ASKED)
    answers = written(counting.shared_items(asked), "shared-shingles")
    side = answers.unionByName(reps, allowMissingColumns=True)
    records = written(thin.groupBy("__block").cogroup(side.groupBy("block")).applyInArrow(tidy(_records(bits, width, percent)), _RECORD), "records")
    forget(answers, table)
    edges = set_join.links(records, percent, ["vertex", "key"], later_only=False)
    # a doc_id with several texts ties their classes together
    several = written(known.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo <> hi").select("doc_id"), "ids-of-several-texts")
    tied = known.join(several, "doc_id").join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = written(components(edges.unionByName(tied)), "components")
    forget(records, edges)
    named = classes.join(whole.withColumnRenamed("node", "rep"), "rep", "left").where("members > 1 or component <> rep")
    changed = written(named.select(*same, F.coalesce("component", "rep").alias("component")), "classes-of-several")
    bare = several.join(whole.withColumnRenamed("node", "doc_id"), "doc_id").select("doc_id", F.col("component").alias("bare"), F.lit(0).cast("long").alias("n_shingles"))
    out = digests.join(changed, same, "left").join(bare, ["doc_id", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "bare", "doc_id")).alias("component_id"))
