"""Exact n-gram Jaccard join by T-occurrence search, and its connected components.

1. Each text becomes the set of the 64-bit hashes of its five-word shingles. Texts with equal sets are one class from here on.
2. A pair at the threshold t shares ``COMMON`` tokens among the first n - ceil(t * n) + ``COMMON`` of either set, in any order that
   all sets share. (Different sets at the threshold share four at least.) The order here puts tokens that a bounded sample shows to
   be frequent last (DivideSkip: long lists are not merged, they are probed), the rest by hash. Only this order depends on the
   sample; the result does not.
3. Inverted lists over those tokens, packed into buckets of tokens. Lists of one class are dropped. Pairs pass bounds of size and
   position, and one by bitmap (all exact): those of lists up to ``PAIRED`` are counted over all lists and, from ``COMMON`` on, meet
   their bitmaps once; the postings of longer lists carry bitmaps. What is left joins its classes into clusters. All classes of a
   list beyond ``SHORT`` join one cluster.
4. Within a cluster, cut into blocks, DivideSkip finds every pair that reaches its required overlap: the short lists of a
   query's tokens are merged (by a sort that merges ascending runs) and counted, the long ones probed by binary search. Each block reports a spanning forest of its links.
5. Connected components of the links.

Copies are never expanded into pairs; a block's report is at most its number of classes. No pair is dropped: every step
before 4 only rules out pairs that cannot reach the threshold.

Defined results: a null text counts as empty, an empty set links with nothing (its component is its own id); a text of fewer
words than a shingle is one shingle; repeated rows give repeated results; a null id keeps its row, with a null component; ids are
whole numbers; an empty table gives an empty table; other columns are left out (``one_of_each`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common
from polyloom.llm.components import components

K = 5
#: The threshold as a fraction: 100 * intersection >= 80 * union.
NUMERATOR, DENOMINATOR = 80, 100
#: Documents whose shingles show which tokens are frequent (only for the order): one in ``ONE_IN``, between the two bounds; in how many of them a token is, and how many are kept.
SAMPLE, MOST_SAMPLE, ONE_IN, FREQUENT, MOST_FREQUENT = 8000, 800_000, 25, 3, 1_000_000
#: Bits of the largest bitmap.
MOST_BITS = 1 << 15
#: Tokens that the prefixes of a pair share, 4 at most.
COMMON = 3
#: Lists up to ``PAIRED`` give out their pairs; those up to ``SHORT`` are searched pair by pair with bitmaps.
PAIRED, SHORT = 16, 256
#: Postings of a bucket.
BUCKET = 400_000
#: Ids that are sent to the Python workers as a sorted array, 8 bytes each, so that no text is shuffled.
SORTED_IDS = 4_000_000
#: Parts that a long list is dealt into.
SALTS = 32
#: Classes and tokens of a block.
BLOCK, BLOCK_TOKENS = 256, 1 << 20

def least_overlap(a, b):
    """Shared tokens that sets of a and b tokens need: the least o with o / (a + b - o) >= t."""
    return -(-NUMERATOR * (a + b) // (DENOMINATOR + NUMERATOR))


def prefix_length(n):
    """No set of under four tokens links with another."""
    return np.where(n < 4, 0, n - -(-NUMERATOR * n // DENOMINATOR) + COMMON)


def shingle_sets(column: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, at = common.raw(column)
    start, end, rows = common.spans(data, at, common.NOT_SPACE)
    words = common.word_hashes(data, start, end)
    grams = common.windows(words, k)
    out = []
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = np.array([np.uint64(b - a)])
            for w in words[a:b]:
                whole = common.mix(whole ^ w)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens at each place; a bit or more for a token, a power of two in all, ``MOST_BITS`` at most. A token that only one set has changes one bit, so the bound holds for any size."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(6, int(len(tokens) - 1).bit_length()))
    bits = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    if not len(tokens):
        return 0, 0
    with np.errstate(over="ignore"):
        a = np.sum(common.mix(tokens + np.uint64(0x1234567)), dtype=np.uint64)
        b = np.sum(common.mix(tokens ^ np.uint64(0x5DEECE66D00000)) * np.uint64(0x2545F4914F6CDD1D), dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted tokens that stand in several documents of a bounded sample; at most MOST_FREQUENT, 8 bytes each."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = {signature(s): s for s in shingle_sets(common.texts(batch), k)}
            token, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

        return work

    chosen = common.bounded_sample(docs.where("text is not null"), "doc_id", lambda n: min(MOST_SAMPLE, max(SAMPLE, n // ONE_IN)))
    rows = common.map_arrow(chosen, make, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    rows = rows.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def prepared(docs: DataFrame, frequent: np.ndarray, k: int) -> DataFrame:
    """doc_id, n, signature, the prefix in the shared order, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        hot = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(common.texts(batch), k)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            at = np.searchsorted(hot, flat)
            is_hot = hot[np.minimum(at, len(hot) - 1)] == flat if len(hot) else np.zeros(len(flat), bool)
            first, prefixes = 0, []
            for s in sets:
                n = len(s)
                if n:
                    flag = is_hot[first : first + n]
                    p = int(prefix_length(n))
                    cold = s[~flag][:p]
                    prefixes.append(cold if len(cold) == p else np.concatenate([cold, s[flag][: p - len(cold)]]))
                first += n
            sizes = np.array([len(s) for s in sets], np.int64)
            rows = np.concatenate([[0], np.cumsum(prefix_length(sizes))])
            sig = [signature(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [
                    common.column(batch, "doc_id"),
                    pa.array(sizes.astype(np.int32)),
                    pa.array([x[0] for x in sig], pa.int64()),
                    pa.array([x[1] for x in sig], pa.int64()),
                    common.lists(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64), rows, pa.int64()),
                    pa.array([bitmap(s) if len(s) else b"" for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "s1", "s2", "prefix", "bits"],
            )

        return work

    return common.map_arrow(docs, make, "doc_id bigint, n int, s1 bigint, s2 bigint, prefix array<bigint>, bits binary")


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of rows with equal keys, from rows that are sorted by them, and where each run starts (one more than runs)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = changes(batch, keys)
        if held and all(held[-1].column(k)[len(held[-1]) - 1] == batch.column(k)[0] for k in keys):
            if not len(cut):
                held.append(batch)
                continue
            held.append(batch.slice(0, cut[-1]))
        else:
            if held:
                yield whole(held, keys)
                held = []
            if len(cut):
                held.append(batch.slice(0, cut[-1]))
        if held:
            yield whole(held, keys)
        held = [batch.slice(cut[-1] if len(cut) else 0)]
    if held:
        yield whole(held, keys)


def changes(batch, keys: list[str]) -> np.ndarray:
    """Rows that begin another run than the row before."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()
        out |= v[1:] != v[:-1]
    return np.flatnonzero(out) + 1


def whole(held: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    return t, np.concatenate([[0], changes(t, keys), [t.num_rows]])


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def folded(flat: np.ndarray, first: np.ndarray, words: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
    """The bitmaps of ``rows`` folded to ``to`` 64-bit words; a fold is the exclusive disjunction of the halves."""
    out = np.zeros((len(rows), to), np.uint64)
    for w in np.unique(words[rows]):
        own = np.flatnonzero(words[rows] == w)
        x = flat[first[rows[own]][:, None] + np.arange(w)]
        while x.shape[1] > to:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        out[own] = x
    return out


def placed(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which pairs of postings size and position allow to reach the threshold."""
    a, b = n[i], n[j]
    return (DENOMINATOR * np.minimum(a, b) >= NUMERATOR * np.maximum(a, b)) & (np.minimum(pos[i], pos[j]) + np.minimum(a - pos[i], b - pos[j]) >= least_overlap(a, b))


def possible(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, flat: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which pairs of postings size, position and bitmap allow to reach the threshold."""
    a, b = n[i], n[j]
    need = least_overlap(a, b)
    ok = placed(i, j, n, pos)
    left = np.flatnonzero(ok)
    to = np.minimum(words[i[left]], words[j[left]])
    for w in np.unique(to):
        own = left[to == w]
        step = max(1, (1 << 21) // int(w))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            apart = np.bitwise_count(folded(flat, first, words, i[part], int(w)) ^ folded(flat, first, words, j[part], int(w))).sum(1)
            ok[part] = apart <= a[part] + b[part] - 2 * need[part]
    return ok


def packed(buckets: int):
    """From prefixes (rep, n, prefix): the postings of a batch in each bucket, as columns of bytes. A bucket is told by a token's upper 24 bits, and the lower 40 tell its tokens apart: two that fall together only make a list longer."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        prefix = common.column(batch, "prefix")
        size = prefix.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        token = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        bucket = ((token >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        rep = common.column(batch, "rep").to_numpy()
        least = int(rep.min()) if len(rep) else 0
        narrow = lambda x: x.astype(next(t for t in (np.uint16, np.uint32, np.uint64) if not len(x) or int(x.max()) <= np.iinfo(t).max))
        values = [(token & np.uint64(0xFFFFFFFF)).astype(np.uint32), (token >> np.uint64(32)).astype(np.uint8), narrow((rep.view(np.uint64) - np.int64(least).view(np.uint64)))[row], narrow(common.column(batch, "n").to_numpy())[row], narrow(pos)]
        ends = np.append(at, len(order))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[order[at]]), pa.array(np.full(len(at), least), pa.int64()), *(_bytes(v[order], ends) for v in values)],
            names=["bucket", "least", "low", "high", "rep", "n", "pos"],
        )

    return work


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the values between the ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
    """token (the lower 40 bits), rep, n, pos of a bucket's rows."""
    out: dict[str, list] = {c: [] for c in ("token", "rep", "n", "pos")}
    for least, low, high, *rest in zip(*(t.column(c).to_pylist() for c in ("least", "low", "high", "rep", "n", "pos")), strict=True):
        count = len(high)
        out["token"].append(np.frombuffer(low, np.uint32) | (np.frombuffer(high, np.uint8).astype(np.int64) << 32))
        rep, n, pos = (np.frombuffer(x, f"u{len(x) // count}") for x in rest)
        out["rep"].append((rep.astype(np.uint64) + np.int64(least).view(np.uint64)).view(np.int64))
        out["n"].append(n.astype(np.int64))
        out["pos"].append(pos.astype(np.int64))
    return tuple(np.concatenate(x) for x in out.values())


LISTED = "kind int, x bigint, y bigint, c int, n int, pos int"


def listed(paired: int, short: int):
    """From packed postings sorted by bucket: (0, a, b, lists) for the pairs of lists up to ``paired`` long that size and position allow, and
    (1, token, rep, length, n, pos) for the postings of longer lists; up to ``short`` only for those with a partner by size and position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, runs in sorted_runs(batches, ["bucket"]):
            for x, y in zip(runs[:-1], runs[1:], strict=True):
                part = t.slice(x, y - x)
                bucket = int(part.column("bucket")[0].as_py())
                token, rep, n, pos = unpacked(part)
                order = np.argsort(token, kind="stable")
                token, rep, n, pos = token[order], rep[order], n[order], pos[order]
                start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
                size = np.diff(np.append(start, len(token)))
                keys, keep = [], np.repeat(size > short, size)
                for m in np.unique(size[(size > 1) & (size <= short)]):
                    own = start[size == m]
                    i0, j0 = np.triu_indices(int(m), 1)
                    step = max(1, 400_000 // len(i0))
                    for k in range(0, len(own), step):
                        i, j = (own[k : k + step, None] + i0).ravel(), (own[k : k + step, None] + j0).ravel()
                        ok = (rep[i] != rep[j]) & placed(i, j, n, pos)
                        i, j = i[ok], j[ok]
                        if m <= paired:
                            keys.append(np.stack([np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])], 1))
                        else:
                            keep[i] = keep[j] = True
                pair = np.concatenate([*keys, np.zeros((0, 2), np.int64)])
                pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]).any(1))) if len(pair) else np.zeros(0, np.int64)
                count = np.diff(np.append(first, len(pair)))
                none = np.zeros(len(first), np.int32)
                yield _listed(0, pair[first, 0], pair[first, 1], count, none, none)
                yield _listed(1, token[keep] | (np.int64(bucket) << 40), rep[keep], np.repeat(size, size)[keep], n[keep], pos[keep])

    return work


def _listed(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["kind", "x", "y", "c", "n", "pos"])


def met(batch: pa.RecordBatch) -> pa.RecordBatch:
    """From pairs (a, b, na, nb, bits_a, bits_b): those that the bitmaps allow to reach the threshold."""
    m = batch.num_rows
    n = np.concatenate([common.column(batch, c).to_numpy() for c in ("na", "nb")]).astype(np.int64)
    data, at = _binary(pa.chunked_array([common.column(batch, "bits_a"), common.column(batch, "bits_b")]))
    ok = possible(np.arange(m), np.arange(m, 2 * m), n, np.zeros(2 * m, np.int64), data.view(np.uint64), at[:-1] // 8, np.diff(at) // 8)
    return pa.RecordBatch.from_arrays([common.column(batch, c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings (token, rep, n, pos, bits) sorted by token: for each list a spanning forest of the pairs that are possible."""
    for t, runs in sorted_runs(batches, ["token"]):
        rep, n, pos = (t.column(c).to_numpy().astype(np.int64) for c in ("rep", "n", "pos"))
        data, at = _binary(t.column("bits"))
        flat, first, words = data.view(np.uint64), at[:-1] // 8, np.diff(at) // 8
        size = np.diff(runs)
        out_a, out_b = [], []
        for m in np.unique(size[size > 1]):
            own = runs[:-1][size == m]
            x, y = np.triu_indices(int(m), 1)
            step = max(1, 400_000 // len(x))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                i, j = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
                different = rep[i] != rep[j]
                i, j = i[different], j[different]
                ok = possible(i, j, n, pos, flat, first, words)
                i, j = i[ok], j[ok]
                if m > 2 and len(i):
                    forest: dict[int, Forest] = {}
                    keep = np.zeros(len(i), bool)
                    base = part[np.searchsorted(part, i, "right") - 1]
                    for z, (p, q, r) in enumerate(zip(i.tolist(), j.tolist(), base.tolist(), strict=True)):
                        keep[z] = forest.setdefault(r, Forest(int(m))).join(p - r, q - r)
                    i, j = i[keep], j[keep]
                out_a.append(rep[i])
                out_b.append(rep[j])
        a, b = np.concatenate([*out_a, np.zeros(0, np.int64)]), np.concatenate([*out_b, np.zeros(0, np.int64)])
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and where each value starts."""
    wide = pa.concat_arrays(column.chunks).cast(pa.large_binary())
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].copy(), at - at[0]


def merged(entries: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """From ascending lists one after the other: the entries that stand in ``least`` of them or more, and in how many. A stable sort merges ascending runs, as a heap would, a vector at a time."""
    entries = np.sort(entries, kind="stable")
    start = np.flatnonzero(np.append(True, entries[1:] != entries[:-1]))
    count = np.diff(np.append(start, len(entries)))
    keep = count >= least
    return entries[start[keep]], count[keep]


def linked(sets: list[np.ndarray], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at the threshold, found by DivideSkip; with ``side``, only pairs of different sides."""
    n = np.array([len(s) for s in sets], np.int64)
    m = len(sets)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    token, count = np.unique(flat[order], return_counts=True)
    lists_at = np.concatenate([[0], np.cumsum(count)])
    members = who[order]  # of each list, ascending
    list_of = np.empty(len(flat), np.int64)
    list_of[order] = np.repeat(np.arange(len(token)), count)
    rows = np.concatenate([[0], np.cumsum(n)])
    forest, out = Forest(m), []
    for q in range(1, m):
        own = list_of[rows[q] : rows[q + 1]]
        own = own[count[own] > 1]
        t = -(-NUMERATOR * int(n[q]) // DENOMINATOR)
        if len(own) < t:
            continue
        own = own[np.argsort(count[own], kind="stable")]
        long = min(t - 1, int(t / (0.1 * np.log2(1 + int(count[own[-1]])) + 1)))
        short, probed = own[: len(own) - long], own[len(own) - long :]
        size = count[short]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1])) - np.repeat(ends - size, size) + np.repeat(lists_at[short], size)
        able, total = merged(members[at], t - long)
        ok = (able < q) & (DENOMINATOR * np.minimum(n[able], n[q]) >= NUMERATOR * np.maximum(n[able], n[q]))
        if side is not None:
            ok &= side[able] != side[q]
        able, total = able[ok], total[ok]
        if not len(able):
            continue
        for x in probed.tolist():
            entries = members[lists_at[x] : lists_at[x + 1]]
            place = np.searchsorted(entries, able)
            total += entries[np.minimum(place, len(entries) - 1)] == able
        hit = able[DENOMINATOR * total >= NUMERATOR * (n[able] + n[q] - total)]
        out += [(int(h), q) for h in hit if forest.join(int(h), q)]
    return out


def block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From classes (group, rep, tokens, side) sorted by group: the links of each group."""
    for t, runs in sorted_runs(batches, ["group"]):
        rep, side = t.column("rep").to_numpy(), t.column("side").to_numpy()
        data, at = _binary(t.column("tokens"))
        flat, at = data.view(np.uint64), at // 8
        a, b = [], []
        for x, y in zip(runs[:-1], runs[1:], strict=True):
            if y - x < 2:
                continue
            own = side[x:y] if (side[x:y] >= 0).any() else None
            for p, q in linked([flat[at[i] : at[i + 1]] for i in range(x, y)], own):
                a.append(int(rep[x + p]))
                b.append(int(rep[x + q]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def blocks(members: DataFrame) -> DataFrame:
    """Each class (cluster, rep, n) with every group it is compared in. A small cluster is one group. A large one is cut by
    size (pairs at the threshold are of one size class or of neighbouring ones) and then by hash into blocks; a group is a pair of blocks."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("classes"), F.sum("n").alias("tokens"))
    small = (F.col("classes") <= BLOCK) & (F.col("tokens") <= BLOCK_TOKENS)
    m = members.join(sizes, "cluster")
    whole = m.where(small).select("rep", F.xxhash64("cluster").alias("group"), F.lit(-1).alias("side"))
    ratio = float(np.log(DENOMINATOR / NUMERATOR)) * (1 + 1e-9)  # a little wide, against rounding
    large = m.where(~small).select("cluster", "rep", "n", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int").alias("level"))
    count = large.groupBy("cluster", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("own"))
    near = lambda by, name: count.select("cluster", (F.col("level") + by).alias("level"), F.col("own").alias(name))
    large = large.join(count, ["cluster", "level"]).join(near(-1, "above"), ["cluster", "level"], "left").join(near(1, "below"), ["cluster", "level"], "left")
    b = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int").alias("b")
    large = large.select("cluster", "rep", "level", "own", "above", "below", b)
    pair = lambda level, kind, x, y, side: F.struct(F.xxhash64("cluster", level, F.lit(kind), x, y).alias("group"), side.cast("int").alias("side"))
    same = F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda o: pair(F.col("level"), 0, F.least(o, F.col("b")), F.greatest(o, F.col("b")), F.when(F.col("own") == 1, -1).when(o == F.col("b"), -1).otherwise(F.when(F.col("b") < o, 0).otherwise(1))))
    # a block meets itself in the group (b, b) alone, so groups of two blocks look at pairs across them only
    up = F.when(F.col("above").isNull(), F.array().cast("array<struct<group:bigint,side:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda o: pair(F.col("level"), 1, F.col("b"), o, F.lit(0))))
    down = F.when(F.col("below").isNull(), F.array().cast("array<struct<group:bigint,side:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda o: pair(F.col("level") - 1, 1, o, F.col("b"), F.lit(1))))
    return whole.unionByName(large.select("rep", F.explode(F.concat(same, up, down)).alias("g")).select("rep", "g.group", "g.side"))


def token_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """rep and its tokens (8 bytes each) for the documents of ``ids``. Few ids are sent to all executors, more of them as a sorted array; only beyond ``SORTED_IDS`` texts are shuffled."""
    number, chosen, shared = ids.count(), docs, None
    if number <= common.SMALL_IDS:
        chosen = docs.join(F.broadcast(ids), docs["doc_id"] == ids["rep"], "left_semi")
    elif number <= SORTED_IDS:
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("rep").to_numpy()))
        chosen = docs.where("doc_id is not null")
    else:
        chosen = docs.join(ids, docs["doc_id"] == ids["rep"], "left_semi")

    def make():
        wanted = shared.value if shared else None

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            if wanted is not None:
                own = common.column(batch, "doc_id").to_numpy()
                batch = batch.filter(pa.array(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own))
            return pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array([s.tobytes() for s in shingle_sets(common.texts(batch), k)], pa.binary())], names=["rep", "tokens"])

        return work

    return common.map_arrow(chosen, make, "rep bigint, tokens binary")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    base = common.materialise(prepared(docs, frequent_tokens(docs, k), k))
    classes = base.where("n > 0 and doc_id is not null").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = base.select("doc_id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("rep"))
    sets = base.where("n >= 4 and doc_id is not null").select(F.col("doc_id").alias("rep"), "n", "prefix")
    total = base.agg(F.sum(F.col("n").cast("bigint"))).first()[0] or 0
    buckets = 1 + total * (DENOMINATOR - NUMERATOR) // (DENOMINATOR * BUCKET)
    postings = common.map_arrow(common.without(sets, copies, "rep"), lambda: packed(buckets), "bucket int, least bigint, low binary, high binary, rep binary, n binary, pos binary", by=None)
    lists = common.materialise(postings.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(listed(min(PAIRED, SHORT), SHORT), LISTED))
    bits = base.select(F.col("doc_id").alias("rep"), "n", "bits")
    close = lists.where("kind = 0").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON).drop("c")
    close = close.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b")
    close = common.map_arrow(close, lambda: met, "a bigint, b bigint", by=None)
    active = lists.where("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("rep"), F.col("c").alias("length"), "n", "pos")
    short = active.where(F.col("length") <= SHORT).join(bits.select("rep", "bits"), "rep").select("token", "rep", "n", "pos", "bits")
    found = short.repartition(parts, "token").sortWithinPartitions("token").mapInArrow(candidates, "a bigint, b bigint").unionByName(close)
    long = active.where(F.col("length") > SHORT).select("token", "rep", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"))
    hubs = long.groupBy("token", "salt").agg(F.min("rep").alias("hub"))  # each part of a list has a hub of its own, and the hubs are linked
    stars = long.join(hubs, ["token", "salt"]).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    stars = stars.unionByName(hubs.join(hubs.groupBy("token").agg(F.min("hub").alias("a")), "token").select("a", F.col("hub").alias("b")))
    clusters = components(found.unionByName(stars)).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = clusters.join(classes.select("rep", "n"), "rep").checkpoint()
    sets = token_sets(docs, members.select("rep"), k)
    grouped = blocks(members).join(sets, "rep").select("group", "rep", "side", "tokens")
    links = grouped.repartition(parts, "group").sortWithinPartitions("group").mapInArrow(block_links, "a bigint, b bigint")
    joined = components(links)
    component = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", "n", F.coalesce("component", "rep").alias("component_id"))
    rows = base.select("doc_id", "n", "s1", "s2").join(component, ["s1", "s2", "n"], "left")
    own_id = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own_id.alias("component_id"))


#: Names a row where ids do not.
ROW = "_polyloom_row"


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """The documents of ``docs``, of each component only the one with the smallest id; all columns as they are. Where ids are null or repeat, every row is a document of its own, and a row with an id is kept before one without."""
    if not docs.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        found = near_duplicates(docs, id_col=id_col, text_col=text_col, k=k)
        return common.without(docs, found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)), id_col)
    rows = common.materialise(docs.withColumn(ROW, F.monotonically_increasing_id()))
    found = near_duplicates(rows, id_col=ROW, text_col=text_col, k=k).select(F.col("doc_id").alias(ROW), "component_id")
    own = common.materialise(rows.select(ROW, F.col(id_col).alias("own_id")).join(found, ROW))
    kept = own.groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", ROW)).alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = own.join(kept, "component_id").where(F.col(ROW) != F.col(f"kept.{ROW}")).select(ROW)
    return common.without(rows, gone, ROW).drop(ROW)
