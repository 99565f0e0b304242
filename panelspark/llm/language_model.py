"""LM scoring: a word n-gram model smoothed towards its lower orders, walked as a weighted backoff automaton.

States are histories: the empty one, the start of a text, and each word seen in training. An arc reads one word and
carries its log10 probability; a state without an arc for the next word takes its failure arc, which costs its backoff
weight, to the next shorter history. One traversal from left to right carries the state of each text and adds up.

With c the training counts, N all tokens, V the distinct ones and m the prior weight:
    P(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1)), one share standing for every unseen word;
    P(w | v) = (c(v w) + m P(w)) / (c(v) + m), so the failure arc of v weighs m / (c(v) + m).
Both are proper distributions. m is fitted to the training documents alone: of the steps of ``PRIORS`` the one under
which they are most probable when each is scored by the counts of the others (its own taken off all of c(v w), c(v), c(w)
and N). Held-out documents have no say in it.

The counts cover all training documents and are exact. Each block of documents asks only for the counts of its own
n-grams (see ``counting``), builds the automaton over them and scores its documents, so no worker ever needs the whole
model. Null, empty and word-less texts are one end token. Rows with a null id are scored and learned from as others are
(``held_out`` is then false). Repeated rows are scored and counted each. Columns other than the two named are ignored.
Without a training document m is the largest step; of equally good steps the largest is taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import counting
from panelspark.llm.shared import BLOCK_BYTES, block_count, blocked_table, dealt, tidy
from panelspark.llm.tokens import follow, text_buffer, word_hashes, word_spans

END, START = np.uint64(0x9AE16A3B2F90404E), np.uint64(0xC2B2AE3D27D4EB4E)
#: What the weight of the lower order against a history's own counts is chosen from, a quarter of a decade a step.
PRIORS = tuple(float(round(10 ** (k / 4), 3)) for k in range(25))
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_log double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_log", pa.float64()), ("score", pa.float64())])
_FITS = pa.schema([("prior", pa.float64()), ("fit", pa.float64())])


def _tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text closed by END, and where each text begins (one more at the end)."""
    data, offsets = text_buffer(texts)
    starts, ends, counts = word_spans(data, offsets)
    at = counts + np.arange(len(counts))
    out = np.full(at[-1], END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[at[1:] - 1] = False
    out[inner] = word_hashes(data, starts, ends)
    return out, at


def _ngrams(table: pa.Table) -> tuple:
    """Distinct words and word pairs of a block, each token's place among them, and the bounds of the texts."""
    words, at = _tokens(table.column("text"))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[at[:-1]] = START
    learned = np.repeat(~np.asarray(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(at))
    one = np.uint64(1)
    items = np.concatenate([words & ~one, follow(before, words) | one])  # words are even, pairs odd
    distinct, place = np.unique(items, return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([learned, learned]), minlength=len(distinct))
    return distinct, counts, place[: len(words)], place[len(words) :], at


def _ask(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        distinct, counts, _, _, _ = _ngrams(table)
        return counting.ask(table.column("__block")[0].as_py(), distinct, counts, buckets)

    return run


def traverse(arc: np.ndarray, weight: np.ndarray, plain: np.ndarray, node: np.ndarray, backoff: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Walks all texts side by side, one token a step, each with its own state; returns the sum of the arcs' weights.

    For token i: ``arc[i]`` tells if its predecessor's state has an arc for it and ``weight[i]`` what that weighs,
    ``plain[i]`` is the weight of the arc from the empty history, ``node[i]`` the state that reading it leads to (0: the
    empty history). ``backoff`` is each state's failure weight; state 1 is the start of a text.
    """
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = at[:-1][order], lengths[order]
    total = np.zeros(len(order))
    state = np.ones(len(order), np.int64)
    live = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1 if len(lengths) else 1), side="right")
    step = 0
    while step < len(live) and live[step] > 6:
        n = live[step]
        i = first[:n] + step
        at_node = state[:n]
        matched = arc[i] & (at_node > 0)
        total[:n] += np.where(matched, weight[i], backoff[at_node] + plain[i])
        state[:n] = node[i]
        step += 1
    for k in range(int(live[step]) if step < len(live) else 0):
        a, b, s, sum_ = int(first[k]) + step, int(first[k] + lengths[k]), int(state[k]), 0.0
        for hit, w, p, to, back in zip(arc[a:b].tolist(), weight[a:b].tolist(), plain[a:b].tolist(), node[a:b].tolist(), np.concatenate([backoff[[s]], backoff[node[a : b - 1]]]).tolist()):
            sum_ += w if hit and s else back + p
            s = to
        total[k] += sum_
    out = np.empty(len(order))
    out[order] = total
    return out


def _own(place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each token's item stands in its own text."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, inverse, counts = np.unique(place + text * (int(place.max()) + 1), return_inverse=True, return_counts=True)
    return counts[inverse]


def _totals(answers: pa.Table, distinct: np.ndarray) -> np.ndarray:
    totals = counting.totals_of(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist()))
    assert len(totals) == len(distinct), "each distinct item has an answer"
    return totals


def _fit(n_train: int, n_distinct: int):
    """The log10 probability of a block's training texts under each of PRIORS, each text by the counts of all others."""

    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _FITS.empty_table()
        distinct, _, word, pair, at = _ngrams(docs)
        totals = _totals(answers, distinct)
        learned = np.repeat(~np.asarray(docs.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(at))
        length = np.repeat(np.diff(at), np.diff(at))
        c = totals[word] - _own(word, at)
        plain = (c + 0.1) / (n_train - length + 0.1 * (n_distinct + 1))
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[at[:-1]] = totals[np.searchsorted(distinct, END)] - 1
        both = totals[pair] - _own(pair, at)
        plain, before, both = plain[learned], before[learned], both[learned]
        sums = [float(np.log10((both + m * plain) / (before + m)).sum()) for m in PRIORS]
        return pa.Table.from_arrays([pa.array(PRIORS), pa.array(sums)], schema=_FITS)

    return run


def _score(n_train: int, n_distinct: int, prior: float):
    def run(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORES.empty_table()
        distinct, _, word, pair, at = _ngrams(docs)
        totals = _totals(answers, distinct)
        c = totals[word]
        n_starts = totals[np.searchsorted(distinct, END)]  # each training text has one end
        plain_p = (c + 0.1) / (n_train + 0.1 * (n_distinct + 1))
        before = np.empty_like(c)
        before[1:] = c[:-1]
        before[at[:-1]] = n_starts
        both = totals[pair]
        weight = np.log10((both + prior * plain_p) / (before + prior))
        known = c > 0
        node = np.where(known, word + 2, 0)
        backoff = np.zeros(len(distinct) + 2)
        backoff[1] = np.log10(prior / (n_starts + prior))
        backoff[2:] = np.log10(prior / (totals + prior))
        score = traverse(both > 0, weight, np.log10(plain_p), node, backoff, at)
        sums = np.add.reduceat(np.log10(c + 0.1), at[:-1])
        return pa.Table.from_arrays([docs.column("doc_id").cast(pa.int64()), docs.column("held_out"), pa.array(np.diff(at)), pa.array(np.add.reduceat(known.astype(np.int64), at[:-1])), pa.array(sums), pa.array(score)], schema=_SCORES)

    return run


def score_documents(docs: DataFrame, modulus: int = 10, prior: float | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, prior`` from its ``doc_id`` and ``text``.

    Learns from the documents whose crc32 of the id's decimal form leaves a remainder of ``modulus`` other than 0, and fits
    ``prior`` to them where none is given.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    blocks = block_count(docs, block_bytes=block_bytes)
    docs = blocked_table(dealt(docs, "doc_id", "text", blocks), "__block", blocks).drop("__row")
    # both passes read the answers beside the documents of their block, without a shuffle of their own
    answers = blocked_table(counting.told(docs.groupBy("__block").applyInArrow(tidy(_ask(blocks)), counting.ASKED)), "block", blocks)
    n_distinct, n_train = (int(x or 0) for x in answers.agg(F.sum("seen_distinct"), F.sum("seen_total")).first())
    if prior is None:
        fits = docs.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(tidy(_fit(n_train, n_distinct)), "prior double, fit double")
        best = fits.groupBy("prior").agg(F.sum("fit").alias("fit")).agg(F.max_by("prior", F.struct("fit", "prior"))).first()[0]
        prior = float(best) if best is not None else PRIORS[-1]
    scores = docs.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(tidy(_score(n_train, n_distinct, prior)), SCORES)
    base = F.col("base_log") - F.col("n_tokens") * F.log10(F.lit(n_train + 0.1 * (n_distinct + 1)))
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score", F.lit(prior).alias("prior"))
