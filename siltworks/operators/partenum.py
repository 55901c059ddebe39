"""Similar texts by PartEnum signatures.

Every text becomes the set of hashes of its five-word sequences.  Sets are put into size bands of
ratio ``1/threshold``; a similar partner lies in the same or a neighbouring band, so each set signs
for two band instances.  For an instance whose largest sets may differ in at most ``k`` elements,
the hash domain is cut into ``n1`` parts of ``n2`` subparts; some part then holds at most ``k2`` of
the differences, and so at least ``n2 - k2`` of its subparts agree exactly.  Every choice of
``n2 - k2`` subparts of every part is one signature: sets within the threshold share one for sure.

Signatures travel in blocks (one row per batch and hash range: ids, counts, 32-bit remainders), so
the shuffle moves about six bytes a signature; candidates pass an exact upper bound from 64-cell
count sketches and then the exact Jaccard test.  The pairs of a signature that more than ``FEW`` texts
share, as those of common phrases do, grow with the square of the texts; they are not listed but held
against sizes and sketches where the texts of the signature meet.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltworks.functions.normalize import TokenWords, mix64, shingle_sets
from siltworks.session import durable

N = 5
THRESHOLD = 0.8
N2, K2 = 4, 2
CELLS = 64
#: Bits of a document's number within a block, and most bits of a hash range.
_WHO, MAX_BITS = 13, 18
#: Bytes of text a hash range stands for, and signatures or pairs that a task sorts at once.
RANGE_BYTES, AT_ONCE = 1 << 22, 1 << 22
#: Texts of one signature whose pairs are listed as they are, and rows of more frequent signatures in a task.
FEW, HOT_ROWS = 8, 1 << 19
#: Rows of a batch of sets, places of a bitmap of ids, and places in one row of it.
SET_ROWS, PLACES, PLACES_A_ROW = 1024, 1 << 24, 1 << 15
_COMBOS = list(itertools.combinations(range(N2), N2 - K2))


def bands(threshold: float, top: int = 1 << 26) -> np.ndarray:
    """Least sizes of the bands; each ends where a similar partner's size could first exceed it."""
    lo = [1]
    while lo[-1] < top:
        lo.append(int(np.floor(lo[-1] / threshold + 1e-9)) + 1)
    return np.array(lo)


def signatures(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Signature hashes and the index of the set that each belongs to, for non-empty sets."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _signed(np.concatenate(sets), sizes, threshold)


@lru_cache(maxsize=64)
def _twos(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _signed(flat: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`signatures` of sets that lie end to end."""
    lo = bands(threshold, int(sizes.max() / threshold**2) + 2)
    band = np.searchsorted(lo, sizes, side="right") - 1
    value = mix64(flat ^ np.uint64(0xABCDEF12345))
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    gap = 2 * (1 - threshold) / (1 + threshold)
    out, who = [], []
    for step in (0, 1):
        inst = band + step
        k = np.floor(gap * (lo[inst + 1] - 1) + 1e-9).astype(np.int64)
        n1 = np.maximum(1, -(-(k + 1) // (K2 + 1)))
        base = np.concatenate([[0], np.cumsum(n1 * N2)])
        seed = (inst.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        # The upper half of the hash, scaled to the number of subparts.
        part = ((mix64(flat + np.repeat(seed, sizes)) >> np.uint64(32)) * np.repeat((n1 * N2).astype(np.uint64), sizes) >> np.uint64(32)).astype(np.int64) + np.repeat(base[:-1], sizes)
        m = int(base[-1])
        # Sums of the two halves are exact in doubles for any set below 2**21 elements a cell.
        tot = np.bincount(part, weights=low, minlength=m).astype(np.uint64) + (np.bincount(part, weights=high, minlength=m).astype(np.uint64) << np.uint64(32))
        tot = tot.reshape(-1, N2)
        of = np.repeat(np.arange(len(sizes)), n1)
        row = (np.arange(len(of)) - np.repeat(base[:-1] // N2, n1)).astype(np.uint64)
        place = mix64(row * np.uint64(0xC2B2AE3D27D4EB4F) + seed[of])
        keyed = mix64(tot + np.arange(1, N2 + 1, dtype=np.uint64)[None, :] * np.uint64(0x165667B19E3779F9))
        cnt = np.bincount(part, minlength=m).reshape(-1, N2)
        cells, filled = keyed.T.copy(), cnt.T > 0
        bare = np.zeros(len(of), dtype=bool)
        for j, c in enumerate(_COMBOS):
            full = filled[list(c)].any(axis=0)
            bare |= ~full
            x = mix64(cells[list(c)].sum(axis=0) + place + np.uint64(j))
            out.append(x[full])
            who.append(of[full])
        # An empty projection says nothing, so its part is signed by what is left of its other
        # elements after every deletion of at most k2 of them: again equal for some choice.
        if bare.any():
            here = bare[part // N2]
            order = np.argsort(part[here], kind="stable")
            sp, sv = part[here][order], value[here][order]
            rows = np.flatnonzero(bare)
            first = np.searchsorted(sp, rows * N2)
            last = np.searchsorted(sp, rows * N2 + N2)
            for r, f, l in zip(rows.tolist(), first.tolist(), last.tolist()):
                d = min(K2, int(k[of[r]]))
                v = sv[f:l]
                total = v.sum(dtype=np.uint64)
                subs = [np.array([total])]
                if d >= 1:
                    subs.append(total - v)
                if d >= 2 and len(v) > 1:
                    i, j2 = _twos(len(v))
                    subs.append(total - v[i] - v[j2])
                x = mix64(np.concatenate(subs) + place[r] + np.uint64(0x51ED270B))
                out.append(x)
                who.append(np.full(len(x), of[r]))
    return np.concatenate(out), np.concatenate(who)


def sketches(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the sets' elements in ``CELLS`` cells, and the sets' sizes; counts above 255 void a
    sketch, whose size is then negative."""
    cell = (flat >> np.uint64(57)).astype(np.int64) * CELLS // 128 + np.repeat(np.arange(len(sizes)) * CELLS, sizes)
    c = np.bincount(cell, minlength=CELLS * len(sizes)).reshape(-1, CELLS)
    void = (c > 255).any(axis=1)
    c[void] = 255
    return c.astype(np.uint8), np.where(void, -sizes, sizes).astype(np.int32)


_BLOCK = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("sigs", pa.binary()), ("sketches", pa.binary()), ("sizes", pa.binary())])
_BLOCK_DDL = "bucket int, ids binary, counts binary, sigs binary, sketches binary, sizes binary"


def _blocks(bits: int, threshold: float, words: int = N):
    # With more hash ranges, more documents go into a block, so that its rows stay of a good size.
    size = min(1 << _WHO, 512 << max(0, bits - 7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenWords()
        for b in batches:
            for at in range(0, b.num_rows, size):
                x = b.slice(at, size)
                flat, sizes = shingle_sets(x.column(1).to_pylist(), known, words)
                if not len(flat):
                    continue
                idv = x.column(0).to_numpy(zero_copy_only=False)[sizes > 0].astype(np.int64)
                sizes = sizes[sizes > 0]
                sig, who = _signed(flat, sizes, threshold)
                cells, held = sketches(flat, sizes)
                bucket = (sig >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(sig), np.int32)
                rest = (sig >> np.uint64(32 - bits)).astype(np.uint32)
                # Hash range, set and remainder in one number, sorted at once.
                key = np.sort((bucket.astype(np.uint64) << np.uint64(32 + _WHO)) | (who.astype(np.uint64) << np.uint64(32)) | rest.astype(np.uint64))
                bucket, who, rest = (key >> np.uint64(32 + _WHO)).astype(np.int32), ((key >> np.uint64(32)) & np.uint64((1 << _WHO) - 1)).astype(np.int64), key.astype(np.uint32)
                home = (mix64(idv.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(idv), np.int32)
                cols: list[list] = [[], [], [], [], [], []]
                by_home = np.argsort(home, kind="stable")
                # Only the ranges that hold something, however many there are.
                ranges = np.union1d(bucket, home)
                edges, ends = np.searchsorted(bucket, ranges), np.searchsorted(bucket, ranges, side="right")
                froms, tos = np.searchsorted(home[by_home], ranges), np.searchsorted(home[by_home], ranges, side="right")
                for k, a, e, f, g in zip(ranges.tolist(), edges.tolist(), ends.tolist(), froms.tolist(), tos.tolist()):
                    mine = by_home[f:g]
                    w = who[a:e]
                    first = np.flatnonzero(np.diff(w, prepend=-1))
                    u, n = w[first], np.diff(first, append=len(w))
                    cols[0].append(k)
                    # Ids with a sketch follow those with signatures.
                    cols[1].append(np.concatenate([idv[u], idv[mine]]).tobytes())
                    cols[2].append(n.astype(np.uint32).tobytes())
                    cols[3].append(rest[a:e].tobytes())
                    cols[4].append(cells[mine].tobytes())
                    cols[5].append(held[mine].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _BLOCK)], schema=_BLOCK)

    return run


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("sk", pa.binary()), ("sig", pa.int64())])


def _by_signature(own: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by the signature; it and the row in one number sort faster than rows by signatures."""
    key = np.sort((sig.astype(np.uint64) << np.uint64(32)) | np.arange(len(sig), dtype=np.uint64))
    return own[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], (key >> np.uint64(32)).astype(np.uint32)


def _agreeing(own: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Distinct pairs of owners of one signature."""
    own, sig = _by_signature(own, sig)
    cut = np.flatnonzero(np.diff(sig)) + 1
    st, en = np.concatenate([[0], cut]), np.concatenate([cut, [len(sig)]])
    n = en - st
    done = np.zeros((0, 2), np.int64)
    found: list[np.ndarray] = []
    held = 0
    # Neighbours at distance d within a group, for all groups longer than d at once.
    live = np.flatnonzero(n > 1)
    d = 1
    while len(live):
        lens = n[live] - d
        pos = np.repeat(st[live], lens) + (np.arange(lens.sum()) - np.repeat(np.concatenate([[0], np.cumsum(lens)[:-1]]), lens))
        a, b = own[pos], own[pos + d]
        keep = a != b
        found.append(np.stack([a[keep], b[keep]], axis=1))
        held += len(found[-1])
        if held > AT_ONCE:
            done, found, held = np.unique(np.concatenate([done, *found]), axis=0), [], 0
        d += 1
        live = live[n[live] > d]
    return np.concatenate([done, *found])


def _frequent(own: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows belong to signatures of more than ``FEW`` rows, and the owners and signatures of those,
    once for signatures of the same owners.  ``sig`` is sorted."""
    st = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    n = np.diff(st, append=len(sig))
    hot = np.repeat(n > FEW, n)
    o, s = own[hot], sig[hot]
    if not len(o):
        return hot, o, s
    n = n[n > FEW]
    owners = np.add.reduceat(mix64(o.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.cumsum(n) - n) + n.astype(np.uint64)
    once = np.zeros(len(n), dtype=bool)
    once[np.unique(owners, return_index=True)[1]] = True
    once = np.repeat(once, n)
    return hot, o[once], s[once]


def _candidates(t: pa.Table) -> pa.Table:
    """Pairs of ids that share a signature in this hash range (``n`` and ``sig`` null), the sketches that
    live here (``b`` and ``sig`` null), and the ids of signatures of more than ``FEW`` (``sig`` set)."""
    ids, sigs, sk_id, sk_n, sk = [], [], [], [], []
    for i, c, s, k, n in zip(*(t.column(x).to_pylist() for x in ("ids", "counts", "sigs", "sketches", "sizes"))):
        idv = np.frombuffer(i, np.int64)
        cnt = np.frombuffer(c, np.uint32)
        ids.append(np.repeat(idv[: len(cnt)], cnt))
        sigs.append(np.frombuffer(s, np.uint32))
        sk_id.append(idv[len(cnt) :])
        sk_n.append(np.frombuffer(n, np.int32))
        sk += [k[j : j + CELLS] for j in range(0, len(k), CELLS)]
    own, sig = np.concatenate(ids), np.concatenate(sigs)
    p = np.zeros((0, 2), np.int64)
    hot_id, hot_sig = [], []
    # Slices by signature, so that what is sorted at once stays bounded.
    slices = max(1, -(-len(sig) // AT_ONCE))
    for k in range(slices):
        here = (sig.astype(np.uint64) * np.uint64(slices) >> np.uint64(32)) == k if slices > 1 else slice(None)
        o, s = _by_signature(own[here], sig[here])
        hot, ho, hs = _frequent(o, s)
        hot_id.append(ho)
        hot_sig.append(hs)
        p = np.unique(np.concatenate([p, _agreeing(o[~hot], s[~hot])]), axis=0)
    si, sn, hi = np.concatenate(sk_id), np.concatenate(sk_n), np.concatenate(hot_id)
    # Signatures of different ranges may have equal remainders.
    hs = np.concatenate(hot_sig).astype(np.int64) | np.int64(t.column("bucket")[0].as_py() << 32)
    kind = np.repeat([0, 1, 2], [len(p), len(si), len(hi)])
    blank = np.zeros(len(hi), np.int64)
    return pa.table(
        [
            pa.array(np.concatenate([p.min(1), si, hi])),
            pa.array(np.concatenate([p.max(1), np.zeros(len(si), np.int64), blank]), mask=kind > 0),
            pa.array(np.concatenate([np.zeros(len(p), np.int32), sn, blank.astype(np.int32)]), mask=kind != 1),
            pa.array([None] * len(p) + sk + [None] * len(hi), type=pa.binary()),
            pa.array(np.concatenate([np.zeros(len(p) + len(si), np.int64), hs]), mask=kind < 2),
        ],
        schema=_OUT,
    )


def _shared_cells(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of the lesser counts of the sketches ``x`` and ``y``, eight cells to a number."""
    v = np.minimum(x.view(np.uint8), y.view(np.uint8)).view(np.uint64)
    low = np.uint64(0x00FF00FF00FF00FF)
    s = ((v & low) + ((v >> np.uint64(8)) & low)).sum(axis=1)
    return ((s * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _hot_pairs(threshold: float):
    """Pairs that share a signature and whose sizes and sketches leave a Jaccard similarity of
    ``threshold`` possible."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        i, g, n = (t.column(c).to_numpy() for c in ("id", "sig", "n"))
        size = np.abs(n).astype(np.int64)
        order = np.lexsort((size, g))
        i, g, n, size = i[order], g[order], n[order], size[order]
        cells = np.frombuffer(b"".join(t.column("sk").to_pylist()), np.uint64).reshape(-1, CELLS // 8)[order]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        end = np.repeat(np.append(first[1:], len(g)), np.diff(first, append=len(g)))
        done, found, held = np.zeros((0, 2), np.int64), [], 0
        pos, d = np.arange(len(g)), 1
        while len(pos):
            # Sizes ascend within a signature, so that a row whose partner is too large is done.
            pos = pos[pos + d < end[pos]]
            pos = pos[size[pos] >= threshold * size[pos + d] - 1e-9]
            for at in range(0, len(pos), 1 << 16):
                a = pos[at : at + (1 << 16)]
                b = a + d
                most = np.where((n[a] < 0) | (n[b] < 0), size[a], np.minimum(_shared_cells(cells[a], cells[b]), size[a]))
                k = (most >= threshold * (size[a] + size[b] - most) - 1e-9) & (i[a] != i[b])
                x, y = i[a[k]], i[b[k]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                held += len(x)
            if held > AT_ONCE:
                done, found, held = np.unique(np.concatenate([done, *found]), axis=0), [], 0
            d += 1
        p = np.unique(np.concatenate([done, *found]), axis=0)
        return pa.table([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return run


def _bound(threshold: float):
    """Pairs whose sketches leave a Jaccard similarity of ``threshold`` possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (np.abs(b.column(i).to_numpy()).astype(np.int64) for i in (2, 4))
            void = (b.column(2).to_numpy() < 0) | (b.column(4).to_numpy() < 0)
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, CELLS) for i in (3, 5))
            inter = _shared_cells(x, y)
            inter = np.where(void, np.minimum(na, nb), np.minimum(inter, np.minimum(na, nb)))
            keep = inter >= threshold * (na + nb - inter) - 1e-9
            k = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(1).filter(k)], schema=schema)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = TokenWords(), pa.schema([("id", pa.int64()), ("s", pa.binary())])
        for b in batches:
            for at in range(0, b.num_rows, SET_ROWS):
                x = b.slice(at, SET_ROWS)
                flat, sizes = shingle_sets(x.column(1).to_pylist(), known, n)
                sets = [flat[e - k : e].tobytes() for e, k in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sets, pa.binary())], schema=schema)

    return run


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
    for b in batches:
        js = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            i = len(np.intersect1d(s, t, assume_unique=True))
            js.append(i / (len(s) + len(t) - i))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(js, pa.float64())], schema=schema)


def hash_ranges(texts: DataFrame) -> tuple[int, int]:
    """Hash ranges (a power of two) and the tasks they are spread over, by the bytes of all texts, so that
    a task's share does not grow with the data."""
    size = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    bits = min(MAX_BITS, max(6, int(np.ceil(np.log2(max(1.0, size / RANGE_BYTES))))))
    return 1 << bits, min(1 << bits, max(16, size // (3 * RANGE_BYTES)))


def _marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """``df`` and whether its ``id`` may be among ``ids``, by a bitmap of a fixed size; it never denies one
    that is."""
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    row, bit = F.floor(place / PLACES_A_ROW), F.pmod(place, F.lit(PLACES_A_ROW))
    maps = ids.select(row.alias("_row"), bit.alias("_bit")).groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = df.withColumn("_row", row).join(F.broadcast(maps), "_row", "left")
    return marked.select(*df.columns, F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False)).alias("_may"))


def among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is among ``ids``; only rows that a bitmap cannot tell from them are shuffled."""
    return _marked(df, ids).where("_may").drop("_may").join(ids, "id", "left_semi")


def not_among(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose ``id`` is not among ``ids``; as :func:`among`, the others are not shuffled."""
    m = _marked(df, ids)
    return m.where("NOT _may").drop("_may").unionByName(m.where("_may").drop("_may").join(ids, "id", "left_anti"))


def pairs_of(texts: DataFrame, signed: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Pairs ``a < b, jaccard`` between the texts of ``signed``, which are some of ``texts``; both are
    ``id, t``, without nulls."""
    ranges, tasks = hash_ranges(texts)
    bits = int(np.log2(ranges))
    blocks = signed.mapInArrow(_blocks(bits, threshold, n), _BLOCK_DDL).repartition(tasks, "bucket")
    found = durable(blocks.groupBy("bucket").applyInArrow(_candidates, "a long, b long, n int, sk binary, sig long"), free=True)
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    sk = found.where("n IS NOT NULL").select(F.col("a").alias("id"), "n", "sk").dropDuplicates(["id"])
    hot = found.where("sig IS NOT NULL").select(F.col("a").alias("id"), "sig")
    lots = max(1, -(-hot.count() // HOT_ROWS))
    met = hot.join(sk, "id").withColumn("lot", F.pmod(F.xxhash64("sig"), F.lit(lots))).repartition(lots, "lot").groupBy("lot").applyInArrow(_hot_pairs(threshold), "a long, b long")
    near = durable(
        pairs.join(sk.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sk").alias("ska")), "a")
        .join(sk.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sk").alias("skb")), "b")
        .select("a", "b", "na", "ska", "nb", "skb")
        .mapInArrow(_bound(threshold), "a long, b long")
        .unionByName(met)
        .distinct(),
        free=True,
    )
    wanted = durable(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    sets = durable(among(texts, wanted).dropDuplicates(["id"]).select("id", "t").mapInArrow(_sets(n), "id long, s binary"), free=True)
    return (
        near.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_jaccard, "a long, b long, jaccard double")
        .where(F.col("jaccard") >= threshold)
    )
