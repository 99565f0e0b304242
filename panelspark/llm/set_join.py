"""Exact Jaccard joins of token sets of any number, the shared part of the n-gram join and of line dedup.

A *set* is a key, the number n of its tokens and its tokens in one global order, rarest first (ties by hash). Two sets
of at least ``percent``% Jaccard share at least A = ceil(percent (n1 + n2) / (100 + percent)) tokens. So of the first
n - A + L tokens of each they share at least L, for any L up to A (else the rest could not reach A). A set posts the
tokens of its prefix, except those that no other set holds.

The smallest key of a token's list is the list's *hub*. Sets that post a common token meet under its hub, with all that
they post there, so their common prefix tokens are counted in one place and only links leave it: no pair that merely
shares a token becomes a row. A set has few hubs, as the members of a group of copies share theirs. A list or a hub's
members too large for a task are dealt out by pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.shared import bounded, forget, tidy, written

#: Postings of one token that a task holds at most; a longer list is dealt to tasks by pairs of its parts.
LIST_PART = 20_000
#: Postings for each group of lists handled together.
GROUP_ROWS = 150_000
#: Bytes of sets under one hub that a task holds, twice at most; more are dealt to tasks by pairs of parts.
HUB_BYTES = 32 << 20
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def required(n1, n2, percent: int):
    """Tokens that two sets of these sizes must share."""
    return (percent * (n1 + n2) + 99 + percent) // (100 + percent)


def at_least(n, percent: int):
    """Tokens that a set of n shares with any partner at least."""
    return (percent * n + 99) // 100


def prefix_length(n, level, percent: int):
    """Tokens of a set's prefix for ``level`` shared tokens with the smallest partner; a larger partner must share more of them."""
    return n - at_least(n, percent) + level


def signature(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """256 parities of each set's tokens (a row of four numbers a set): sets that differ in d tokens differ in d bits at most."""
    bits = np.left_shift(np.uint64(1), (tokens >> np.uint64(50)) & np.uint64(63))
    word = (tokens >> np.uint64(56)) & np.uint64(3)
    return np.stack([np.bitwise_xor.reduceat(np.where(word == k, bits, np.uint64(0)), starts) for k in range(4)], axis=1).view(np.int64)


def list_parts(df: np.ndarray) -> np.ndarray:
    """Parts in which to deal the list of a token that so many sets hold at most."""
    return np.maximum(-(-df // LIST_PART), 1).astype(np.int32)


def _in_parts(rows: DataFrame, parts: str, key: str) -> DataFrame:
    """Adds ``own``, ``part1``, ``part2``: each row to all pairs of parts that hold its own."""
    own = F.pmod(F.xxhash64(key), F.col(parts)).cast("int")
    out = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
    return out.withColumn("part1", F.least("own", "other")).withColumn("part2", F.greatest("own", "other")).drop("other")


def _hubs(t: pa.Table) -> pa.Table:
    """Distinct (hub, key) of the lists with several keys."""
    token, p1, p2, key = (t.column(c).to_numpy() for c in ("token", "part1", "part2", "key"))
    order = np.lexsort((key, p2, p1, token))
    token, p1, p2, key = token[order], p1[order], p2[order], key[order]
    first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])]) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    hub = np.repeat(key[first], size)
    several = np.repeat(key[first] != key[first + size - 1], size) if len(first) else np.zeros(0, bool)
    hub, key = hub[several], key[several]
    order = np.lexsort((key, hub))
    hub, key = hub[order], key[order]
    new = np.r_[True, (hub[1:] != hub[:-1]) | (key[1:] != key[:-1])] if len(hub) else np.zeros(0, bool)
    return pa.Table.from_arrays([pa.array(hub[new], pa.int64()), pa.array(key[new], pa.int64())], names=["hub", "key"])


class _Sorted:
    """Members of many hubs, sorted by hub, parts and order, as flat arrays."""

    def __init__(self, t: pa.Table, order: list[str]):
        by = ["hub", "part1", "part2"]
        t = t.combine_chunks().sort_by([(c, "ascending") for c in (*by, *order)]).combine_chunks()
        self.key = [t.column(c).to_numpy() for c in by]
        self.vertex = t.column("vertex").to_numpy()
        self.n, self.level, self.own = (t.column(c).to_numpy().astype(np.int64) for c in ("n", "level", "own"))
        self.sigs = np.stack([t.column(f"sig{k}").to_numpy().view(np.uint64) for k in range(1, 5)])
        self.sets = t.column("shared").chunk(0)
        token, place = t.column("token").chunk(0), t.column("place").chunk(0)
        self.at = token.offsets.to_numpy() - token.offsets[0].as_py()
        self.token, self.place = token.flatten().to_numpy(), place.flatten().to_numpy().astype(np.int64)

    def groups(self) -> Iterator[tuple[int, int]]:
        new = np.zeros(len(self.n) - 1, bool)
        for k in self.key:
            new |= k[1:] != k[:-1]
        cuts = (np.flatnonzero(new) + 1).tolist()
        return ((a, b) for a, b in zip([0, *cuts], [*cuts, len(self.n)]) if b - a > 1)


class _Members:
    """The sets that meet under one hub (or one pair of its parts), in order."""

    def __init__(self, s: _Sorted, begin: int, end: int, percent: int):
        self.percent, self.m = percent, end - begin
        self.n, self.level, self.own, self.sigs = s.n[begin:end], s.level[begin:end], s.own[begin:end], s.sigs[:, begin:end]
        self.across = s.key[1][begin] != s.key[2][begin]
        self.sets = [np.frombuffer(s.sets[k].as_buffer(), np.uint64) for k in range(begin, end)]
        token, place = s.token[s.at[begin] : s.at[end]], s.place[s.at[begin] : s.at[end]]
        member = np.repeat(np.arange(self.m), np.diff(s.at[begin : end + 1]))
        by = np.argsort(token, kind="stable")  # members stay ascending within a list
        token, self.place, self.member = token[by], place[by], member[by]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        self.end = np.repeat(np.append(start[1:], len(token)), np.diff(np.append(start, len(token))))
        self.of_member = np.argsort(self.member, kind="stable")
        self.count = s.at[begin : end + 1] - s.at[begin]

    def partners(self, x: int, open_: np.ndarray) -> np.ndarray:
        """The later members among ``open_`` that share enough of their prefix with ``x`` for a link, by all filters."""
        mine = self.of_member[self.count[x] : self.count[x + 1]]
        left = self.end[mine] - mine - 1
        if not left.any():
            return np.zeros(0, np.int64)
        at = np.repeat(mine + 1 - (np.cumsum(left) - left), left) + np.arange(int(left.sum()))
        y, here = self.member[at], np.repeat(self.place[mine], left)
        ok = open_[y]
        y, here, there = y[ok], here[ok], self.place[at[ok]]
        n, other = int(self.n[x]), self.n[y]
        need = required(n, other, self.percent)
        # both prefixes reach as far as this many matches need
        most = np.minimum(self.level[x] - at_least(n, self.percent), self.level[y] - at_least(other, self.percent)) + need
        ok = (n - here > need - most) & (other - there > need - most) & (np.minimum(n, other) >= need)
        y, wanted = y[ok], most[ok]
        if not len(y):
            return y
        found = np.bincount(y, minlength=self.m)
        least = np.zeros(self.m, np.int64)
        least[y] = wanted
        y = np.flatnonzero((found >= least) & (found > 0))
        apart = np.bitwise_count(self.sigs[:, y] ^ self.sigs[:, x : x + 1]).sum(axis=0, dtype=np.int64)
        return y[apart <= n + self.n[y] - 2 * required(n, self.n[y], self.percent)]

    def linked(self, x: int, y: int) -> bool:
        """Whether the Jaccard of two members reaches the percentage, from their whole sets."""
        u, v = self.sets[x], self.sets[y]
        if len(u) > len(v):
            u, v = v, u
        if not len(u):
            return False
        at = np.minimum(np.searchsorted(v, u), len(v) - 1)
        both = int(np.count_nonzero(v[at] == u))
        return 100 * both >= self.percent * (int(self.n[x]) + int(self.n[y]) - both)

    def links(self, later_only: bool) -> Iterator[tuple[int, int]]:
        """Links between members; with ``later_only`` one for each member that an earlier one resembles, else as many as
        join what links join here."""
        label = np.arange(self.m)
        for x in range(self.m - 1):
            open_ = label == np.arange(self.m) if later_only else label != label[x]
            if self.across:
                open_ = open_ & (self.own != self.own[x])
            if not open_[x + 1 :].any():
                continue
            for y in self.partners(x, open_).tolist():
                if later_only:
                    if self.linked(x, y):
                        label[y] = x
                        yield x, y
                elif label[y] != label[x] and self.linked(x, y):
                    label[label == label[y]] = label[x]
                    yield x, y


def _under_hubs(order: list[str], percent: int, later_only: bool):
    def run(t: pa.Table) -> pa.Table:
        a, b = [], []
        s = _Sorted(t, order)
        for begin, end in s.groups():
            for x, y in _Members(s, begin, end, percent).links(later_only):
                a.append(int(s.vertex[begin + x])), b.append(int(s.vertex[begin + y]))
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)

    return run


def links(records: DataFrame, percent: int, order: list[str], later_only: bool) -> DataFrame:
    """Links a, b (vertices; a comes first by ``order``) between sets of at least ``percent``% Jaccard.

    ``records``, a written table: key (unique), vertex, the columns of ``order`` (unique together), n, level,
    sig1 to sig4, shared (sorted tokens that other sets hold too), token and place (what it posts) and parts
    (``list_parts`` of each posted token). All links are found that join something: without ``later_only`` the
    components of the result are those of all links, with it each b that has an earlier partner is there.
    """
    posted = records.agg(F.sum(F.size("token"))).first()[0] or 0
    buckets = max(1, -(-int(posted) // GROUP_ROWS))
    posts = records.select("key", F.explode(F.arrays_zip("token", "parts")).alias("t")).select("key", F.col("t.token").alias("token"), F.col("t.parts").alias("parts"))
    dealt = _in_parts(posts, "parts", "key").select("token", "key", "part1", "part2", F.pmod(F.xxhash64("token", "part1", "part2"), F.lit(buckets)).cast("int").alias("bucket"))
    met = written(dealt.groupBy("bucket").applyInArrow(tidy(_hubs), "hub long, key long").distinct(), "hubs")
    bytes_ = records.select("key", (F.octet_length("shared") + 12 * F.size("token") + 100).cast("long").alias("bytes"))
    weighed = met.join(bytes_, "key")
    sums = written(weighed.groupBy("hub").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("members")), "hub-sizes")
    groups = max(1, -(-int(sums.agg(F.sum("bytes")).first()[0] or 0) // (HUB_BYTES // 2)))
    parts = sums.where("members > 1").select("hub", F.ceil(F.col("bytes") / HUB_BYTES).cast("int").alias("parts"))
    members = _in_parts(met.join(parts, "hub"), "parts", "key").withColumn("bucket", F.pmod(F.xxhash64("hub", "part1", "part2"), F.lit(groups)).cast("int"))
    whole = members.join(records.select(*dict.fromkeys(["key", "vertex", *order, "n", "level", "sig1", "sig2", "sig3", "sig4", "shared", "token", "place"])), "key")
    found = written(bounded(whole).groupBy("bucket").applyInArrow(tidy(_under_hubs(order, percent, later_only)), "a long, b long"), "links")
    forget(met, sums)
    return found
