"""Suffix-array dedup: a common-prefix-aware distributed merge sort over sampled suffixes.

A byte window of ``length`` goes where an earlier place holds the same bytes. Sorting all
suffixes would cost many times the text, so suffixes are sampled by content: every window
has one anchor, the leftmost least hash among its ``gram``-byte strings, and equal windows
have their anchors at equal offsets. An anchor stands for a run of window starts, and the
string it sorts by is the text from the anchor to the end of its last window, a
terminator, and the text before it back to its first window, reversed.

1. Parts of the corpus send their anchors' distinct gram hashes; buckets answer which
   occur twice anywhere, and which are hot. Text that repeats nowhere goes no further. The windows of a hot gram's anchor are cut
   by their offset into pieces of ``STEP``: windows of one piece share all but ``STEP`` bytes, so pieces are dealt by those bytes, and a line that
   stands in unlike surroundings is spread over all buckets.
2. Parts sort the distinct strings of the anchors that are left into runs, one for each
   bucket, front coded: shared prefix length and rest. A bucket combines its runs with a
   loser tree whose nodes hold prefix lengths: heads with different shared prefixes to the
   last output are ordered by those alone, and bytes are compared only beyond a known
   prefix, so no byte of a known prefix is compared again.
3. The merged order with its prefix lengths gives, for each window offset, the classes of
   equal windows; all but a class's first place are repeats. Parts take out what they cover.

Defined cases: null texts are empty; texts under ``length`` bytes lose nothing; matches
never cross documents; null doc_ids order last, among each other by a hash of their texts;
rows that share a doc_id are separate documents in the order of their texts; an empty table gives an empty result. Text may hold
any character; what is kept is bytes, since a cut may fall inside a character.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus, textops

LENGTH = 100
GRAM = 48
KEY_SHIFT = np.uint64(24)
END = b"\xff"  # in no UTF-8 text
NONE = 255
#: A gram that stands in more places than this is hot: its windows are dealt by what surrounds it, this many offsets together.
HOT, STEP = 256, 13
OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, the first and last window start each stands for, and the hash of its gram."""
    none = np.zeros(0, np.int64)
    n = len(data) - gram + 1
    width = length - gram + 1
    valid = np.ones(max(0, len(data) - length + 1), bool)
    for end in offsets[1:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    prefix = textops.prefix_hash(data)
    h = prefix[gram:] - prefix[:-gram]
    h *= textops.powers(textops._INVERSE, len(prefix))[:n]
    h = textops.mix(h)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(at)) - 1
    return at[head], starts[head], starts[last], h[at[head]]


class _Part:
    def __init__(self, t: pa.Table, length: int, gram: int):
        self.length, self.ids = length, t.column("doc_id")
        self.step = max(1, min(STEP, length // 4))
        self.data, self.offsets = textops.flat(t.column("text"))
        cols = [[], [], [], []]
        for a, b in textops.blocks(self.offsets, textops.BLOCK_BYTES):
            lo = self.offsets[a]
            found = anchors(self.data[lo : self.offsets[b]], self.offsets[a : b + 1] - lo, length, gram)
            for c, x, shift in zip(cols, found, (lo, lo, lo, 0), strict=True):
                c.append(x + shift if shift else x)
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.at, self.first, self.last = (cat(c, np.int64) for c in cols[:3])
        self.hash = cat(cols[3], np.uint64)
        self.keys = self.hash >> KEY_SHIFT << KEY_SHIFT

    def entries(self, replies: bytes, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Distinct strings by bucket and order, their buckets, the first place of each, all repeated places (anchor, first and last window start), and which string each has."""
        at, first, last, key = self._places(replies)
        raw, length = self.data.tobytes(), self.length
        seen: dict[tuple, int] = {}  # equal strings may lie in two buckets, as pieces and whole
        which = [seen.setdefault((k, raw[a : z + length] + END + raw[f:a][::-1]), len(seen)) for a, f, z, k in zip(at.tolist(), first.tolist(), last.tolist(), key.tolist(), strict=True)]
        strings, which = [x[1] for x in seen], np.array(which, np.int64)
        place = np.zeros(len(strings), np.int64)
        place[which[::-1]] = np.arange(len(at))[::-1]
        bucket = (textops.mix(key[place] ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)
        order = sorted(range(len(strings)), key=strings.__getitem__)
        order = np.array(order, np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return [strings[i] for i in order.tolist()], bucket[order], place[order], (at, first, last), rank[which] if len(which) else which

    def _places(self, replies: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first and last window start and dealing key of each repeated anchor, hot ones by pieces; in order of the text."""
        if not len(self.keys):
            return self.at, self.first, self.last, self.hash
        _, inverse = np.unique(self.keys, return_inverse=True)
        flag = np.frombuffer(replies, np.uint8)[inverse]
        again = np.flatnonzero(flag > 0)
        at, first, last, hot = self.at[again], self.first[again], self.last[again], flag[again] > 1
        step = self.step
        low, top = (at - last) // step, (at - first) // step  # an anchor's pieces
        n = np.where(hot, top - low + 1, 1)
        which = np.repeat(np.arange(len(at)), n)
        piece = top[which] - (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
        a, hot, key = at[which], hot[which], self.hash[again][which].copy()
        first = np.where(hot, np.maximum(first[which], a - piece * step - (step - 1)), first[which])
        last = np.where(hot, np.minimum(last[which], a - piece * step), last[which])
        # what all windows of a piece hold: from its least offset before the anchor to the end of its window of the greatest offset
        h, j = np.flatnonzero(hot), piece[hot]
        around = textops.word_hashes(self.data, a[h] - j * step, a[h] + self.length - j * step - (step - 1)) if len(h) else key[:0]
        key[h] = textops.mix(around + j.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return a, first, last, key

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1


def shared_prefixes(strings: list[bytes]) -> np.ndarray:
    """Length of the prefix each string shares with the one before it; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    for a in range(0, len(strings), 8192):
        part = strings[max(0, a - 1) : a + 8192]
        size = np.array([len(s) for s in part])
        wide = int(size.max())
        m = np.frombuffer(b"".join([s.ljust(wide, b"\xfe") for s in part]), np.uint8).reshape(len(part), wide)
        differ = m[1:] != m[:-1]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        n = np.minimum(n, np.minimum(size[1:], size[:-1]))
        out[a + (a == 0) : a + 8192] = n
    return out


def write_run(strings: list[bytes]) -> bytes:
    """A sorted run, front coded: shared prefix lengths, rest lengths, rests."""
    shared = shared_prefixes(strings)
    rests = [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]
    return struct.pack("<I", len(strings)) + shared.astype("<u2").tobytes() + np.array([len(r) for r in rests], "<u2").tobytes() + b"".join(rests)


def read_run(raw: bytes) -> tuple[list[bytes], list[int]]:
    """The strings of a run and the prefix each shares with the one before it."""
    (n,) = struct.unpack_from("<I", raw)
    shared = np.frombuffer(raw, "<u2", n, 4).tolist()
    ends = (np.cumsum(np.frombuffer(raw, "<u2", n, 4 + 2 * n), dtype=np.int64) + 4 + 4 * n).tolist()
    out, at, s = [], 4 + 4 * n, b""
    for k, e in zip(shared, ends, strict=True):
        s = s[:k] + raw[at:e]
        out.append(s)
        at = e
    return out, shared


def _beyond(a: bytes, b: bytes, k: int) -> int:
    """The common prefix of two strings that share their first ``k`` bytes."""
    end = min(len(a), len(b))
    while k < end:
        x, y = a[k : k + 16], b[k : k + 16]
        if x != y:
            n = min(len(x), len(y))
            d = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
            return k + n - (d.bit_length() + 7) // 8 if d else k + n
        k += 16
    return end


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merge sorted runs: run and place of each string in order, and the prefix it shares with the one before it.

    A loser tree; each head and each loser carries the prefix length it shares with the
    string that beat it last. Equal strings come in the order of their runs.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    place = [0] * k
    head: list[bytes | None] = [s[0] if s else None for s in strings]
    known = [0] * k  # of each run's head with the last output, or with what beat it
    loser = [-1] * k

    def play(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        a, b = head[x], head[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        p, q = known[x], known[y]
        if p > q:
            return x, y
        if q > p:
            return y, x
        h = _beyond(a, b, p)
        if h == len(a) == len(b):
            won, lost = (x, y) if x < y else (y, x)
        elif h == len(a) or h < len(b) and a[h] < b[h]:
            won, lost = x, y
        else:
            won, lost = y, x
        known[lost] = h
        return won, lost

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, lost = play(build(2 * node), build(2 * node + 1))
        loser[node] = lost
        return won

    winner = build(1) if k > 1 else 0
    out_run, out_place, out_shared = [], [], []
    while head[winner] is not None:
        i = place[winner]
        out_run.append(winner)
        out_place.append(i)
        out_shared.append(known[winner])
        i += 1
        place[winner] = i
        if i < len(strings[winner]):
            head[winner] = strings[winner][i]
            known[winner] = shared[winner][i]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2
    return out_run, out_place, out_shared


def repeats(strings: list[bytes], shared: np.ndarray, rank: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For merged strings, the least and greatest window offset at which each repeats an earlier place; NONE for none."""
    n = len(strings)
    lo, hi = np.full(n, NONE, np.uint8), np.full(n, NONE, np.uint8)
    if not n:
        return lo, hi
    size = np.array([len(s) for s in strings])
    right = np.array([s.index(END) for s in strings])
    least, most = length - right, size - right - 1
    # equal strings: all but the first place repeat wholly
    same = np.zeros(n, bool)
    same[1:] = (shared[1:] == size[1:]) & (size[1:] == size[:-1])
    klass = np.cumsum(~same) - 1
    heads = np.flatnonzero(~same)
    best = np.minimum.reduceat(rank, heads)
    again = rank != best[klass]
    lo[again], hi[again] = least[again], most[again]
    chosen = np.flatnonzero(~again)  # one a distinct string, in order
    # groups of distinct strings with the same gram, of two or more
    group = np.cumsum(np.append(True, shared[heads][1:] < gram))
    many = np.bincount(group)[group] > 1
    if not many.any():
        return lo, hi
    # prefix that a chosen distinct string shares with the previous one, which has the same text as its class
    near = shared[heads]
    pick = np.flatnonzero(many)
    at, near, group = chosen[pick], near[pick], group[pick]
    near = np.where(np.append(True, group[1:] != group[:-1]), 0, near)
    left = int(most[at].max())
    back = np.zeros((len(at), left), np.uint8)
    for i, j in enumerate(at.tolist()):
        b = strings[j][right[j] + 1 :]
        back[i, : len(b)] = np.frombuffer(b, np.uint8)
    r, low, top = rank[at], least[at], most[at]
    h = np.zeros(len(at), np.uint64)
    new_lo, new_hi = lo[at], hi[at]
    for o in range(left + 1):
        if o:
            h = (h + back[:, o - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        use = np.flatnonzero((low <= o) & (o <= top))
        if len(use) < 2:
            continue
        cut = np.cumsum(near < length - o)[use]
        key = textops.mix(h[use] + cut.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        by = np.lexsort((r[use], key))
        same = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        hit, other = use[by[1:][same]], use[by[:-1][same]]
        if o:  # the text before the anchor decides by its bytes
            hit = hit[(back[hit, :o] == back[other, :o]).all(axis=1)]
        new_lo[hit] = np.minimum(new_lo[hit], o)
        new_hi[hit] = o
    lo[at], hi[at] = new_lo, new_hi
    return lo, hi


def _gram_request(length: int, gram: int, buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        p = _Part(corpus.by_id(t), length, gram)
        distinct, count = np.unique(p.keys, return_counts=True)
        flags = np.minimum(count, 255).astype(np.uint8)
        return corpus.request_table(list(corpus.requests(key[0].as_py(), distinct, buckets, lambda c: flags[c].tobytes())))

    return run


def _gram_reply(hot: int):
    """1 for a gram that stands in two places or more, 2 for a hot one."""

    def reply(lists, extras):
        keys = np.concatenate(lists)
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in extras])
        distinct, inverse = np.unique(keys, return_inverse=True)
        places = np.bincount(inverse, flags, len(distinct))
        return [x.tobytes() for x in corpus.split_like(((places > 1).astype(np.uint8) + (places > max(1, hot)))[inverse], lists)]

    return reply


def _run_request(length: int, gram: int, buckets: int):
    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return corpus.request_table([])
        p = _Part(corpus.by_id(t), length, gram)
        strings, bucket, place, (anchor, _, _), _ = p.entries(corpus.replied(replies, 0), buckets)
        ids = p.ids.combine_chunks() if isinstance(p.ids, pa.ChunkedArray) else p.ids
        ids = ids.cast(pa.int64()).fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        anchor = anchor[place]
        doc = ids[p.documents(anchor)]
        edge = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            x, y = int(edge[b]), int(edge[b + 1])
            if y > x:
                out.append((b, key[0].as_py(), write_run(strings[x:y]), textops.planes(doc[x:y]) + textops.planes(anchor[x:y].astype(np.uint64))))
        return corpus.request_table(out)

    return run


def _merge(length: int, gram: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        runs = [read_run(x) for x in t.column("body").to_pylist()]
        sizes = [len(r[0]) for r in runs]
        doc, at = [], []
        for x in t.column("extra").to_pylist():
            doc.append(textops.unplanes(x[: len(x) // 2]))
            at.append(textops.unplanes(x[len(x) // 2 :]))
        part = np.repeat(np.arange(len(runs)), sizes)
        order = np.lexsort((np.concatenate(at), part, np.concatenate(doc)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, place, shared = merge_runs(runs)
        strings = [runs[r][0][i] for r, i in zip(which, place, strict=True)]
        base = np.concatenate([[0], np.cumsum(sizes)])
        flat = base[np.array(which, np.int64)] + np.array(place, np.int64)
        lo, hi = repeats(strings, np.array(shared, np.int64), rank[flat], length, gram)
        reply = np.empty((len(flat), 2), np.uint8)
        reply[flat, 0], reply[flat, 1] = lo, hi
        return corpus.reply_table([(p, 1, key[0].as_py(), reply[base[i] : base[i + 1]].tobytes()) for i, p in enumerate(t.column("part").to_pylist())])

    return run


def _remove(length: int, gram: int, buckets: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(key: tuple, t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return schema.empty_table()
        p = _Part(corpus.by_id(t), length, gram)
        _, _, place, (at, first, last), which = p.entries(corpus.replied(replies, 0), buckets)
        limits = np.frombuffer(corpus.replied(replies, 1), np.uint8).reshape(-1, 2)
        lo, hi = at - last, at - first
        mine = place[which] == np.arange(len(at)) if len(at) else np.zeros(0, bool)
        lo[mine], hi[mine] = limits[which[mine], 0], limits[which[mine], 1]
        some = ~mine | (hi != NONE)
        d = np.zeros(len(p.data) + 1, np.int32)
        np.add.at(d, at[some] - hi[some], 1)
        np.add.at(d, at[some] - lo[some] + length, -1)
        gone = np.cumsum(d[:-1]) > 0
        # documents as sums over their bytes
        upto = lambda m: np.concatenate([[0], np.cumsum(m)])[p.offsets]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        cut = p.offsets[1:-1]
        cut = cut[cut < len(gone)]
        edge[cut] = gone[cut]
        kept = upto(~gone)
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kept) - 1, [None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(p.data[~gone]))]).cast(pa.binary())
        return pa.table([p.ids.cast(pa.int64()), np.diff(p.offsets), np.diff(upto(gone)), np.diff(upto(edge)), body], schema=schema)

    return run


def sorted_runs(split: DataFrame, buckets: int, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The answers about grams, and the parts' sorted runs for each bucket."""
    grams = split.groupBy("part").applyInArrow(_gram_request(length, gram, buckets), corpus.REQUEST_SCHEMA)
    hits = corpus.answer(grams, 0, _gram_reply(hot))
    return hits, split.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(_run_request(length, gram, buckets), corpus.REQUEST_SCHEMA)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part_bytes: int = corpus.PART_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (remaining bytes)."""
    if not 0 < gram <= length <= 254:
        raise ValueError("gram must not exceed length, nor length 254")
    split, parts = corpus.parted(docs.select("doc_id", "text"), part_bytes)
    buckets = 2 * parts
    hits, runs = sorted_runs(split, buckets, length, gram, hot)
    merged = runs.groupBy("bucket").applyInArrow(_merge(length, gram), corpus.REPLY_SCHEMA)
    replies = hits.unionByName(merged)
    return split.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_remove(length, gram, buckets), OUT_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
