"""Removal of repeated passages by a sparse enhanced suffix array with its common-prefix interval tree.

A byte is removed if a string of `length` bytes that covers it also starts earlier: in a document of smaller key, or
earlier in the same document. Strings are judged on the input; overlaps count; matches never cross documents.

1. Each window of `length` bytes has an anchor: the place of the least hash among its GRAM-byte strings (leftmost of equal
   ones). It depends on the window's content only, so equal windows have their anchors at the same offset. Neighbouring
   windows share anchors, so about one place in 35 is one. Anchors are dealt out by the hash of their GRAM bytes, packed.
2. Anchors whose hash no other place has cannot lie in a repeat. Of anchors whose windows, all those they stand for, are
   the same bytes (two 64-bit hashes agree, of the gram and of all bytes), all but the first are repeats as a whole; only
   the first, if others share its hash, goes on. A batch of documents keeps its own first one before anchors are dealt out,
   so a hash that very many places have costs its group one row a batch, and one for each other surrounding.
3. For these the bytes around them are fetched. The suffixes that start at anchors of one hash are sorted (suffix array),
   with the longest common prefixes of neighbours; a scan with a stack gives the intervals of the common-prefix tree. In
   each interval the members are split by what precedes them, in the same way from right to left; where the left
   extensions differ and left and right together reach `length`, the members are a maximal repeat with all occurrences.
4. Each occurrence but a group's earliest is removed. Spans meet the documents again, by packed rows, and are merged.

Null texts are empty. Rows with null keys, and keys that are no whole numbers, come after all others. Rows with the same key and text are one document, and
each gets its result; rows that share only the key are ordered by a hash of key and text.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaxis.llm.common import partitions, written
from tessaxis.llm.shingles import mix, range_of

LENGTH, GRAM = 100, 32
SEGMENT, BATCH_ANCHORS, BATCH_DOCS, GROUP_BYTES = 1 << 19, 300_000, 60_000, 16 << 20
_PLACE = np.uint64((1 << 20) - 1)

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = max(_powers, default=0)
    if size < n:
        size = max(n, 1 << 16)
        _powers.clear()
        grow = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)], dtype=np.uint64)
        _powers[size] = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
    return _powers[size]


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, segment: int = SEGMENT) -> np.ndarray:
    """Rows (place, first window, last window, hash of the gram, hash of all bytes of the windows) of a document's anchors."""
    out = [np.zeros((5, 0), np.uint64)]
    for begin in range(0, len(data) - length + 1, segment):
        b = data[begin : begin + segment + length - 1]
        n = len(b)
        power, inverse = _power(n)
        sums = np.r_[np.uint64(0), np.cumsum(_TABLE[b] * inverse[:n], dtype=np.uint64)]
        h = mix((sums[gram:] - sums[:-gram]) * power[: n - gram + 1])
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        width, left = 1, length - gram + 1
        while 2 * width <= left:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if left > width:
            least = np.minimum(least[: len(least) - (left - width)], least[left - width :])
        first = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        last = np.r_[first[1:] - 1, len(least) - 1]
        place = (least[first] & _PLACE).astype(np.int64)
        whole = mix(mix((sums[last + length] - sums[first]) * power[first]) + mix((place - first).astype(np.uint64) * np.uint64(1024) + (last - first).astype(np.uint64)))
        found = np.stack([(place + begin).astype(np.uint64), (first + begin).astype(np.uint64), (last + begin).astype(np.uint64), h[place], whole])
        if out[-1].shape[1] and found[0, 0] == out[-1][0, -1]:
            # one anchor on both sides of the border: its windows are one run
            found[1, 0], found[4, 0] = out[-1][1, -1], mix(found[4, :1] + mix(out[-1][4, -1:]))[0]
            out[-1] = out[-1][:, :-1]
        out.append(found)
    return np.concatenate(out, axis=1)


def sure_repeats(h: np.ndarray, whole: np.ndarray, k: np.ndarray, d: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which anchors have the windows of another one that is earlier in the order of keys, documents and places."""
    order = np.lexsort((place, d, k, whole, h))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (whole[order][1:] == whole[order][:-1])] if len(h) else np.array([], bool)
    out = np.empty(len(h), bool)
    out[order] = same
    return out


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """(common prefix, first, last member) of the common-prefix intervals of `least` or more; lcp[i] is of members i-1 and i, lcp[0] unused."""
    found, stack = [], []
    for i in range(1, len(lcp) + 1):
        x = lcp[i] if i < len(lcp) else 0
        start = i - 1
        while stack and stack[-1][0] > x:
            value, start = stack.pop()
            found.append((value, start, i - 1))
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, start))
    return found


def _sorted_with_lcp(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (bytes, `size` of them valid) within groups, and the common prefixes of neighbours (0 between groups)."""
    width = rows.shape[1]
    keys = np.ascontiguousarray(np.hstack([group.astype(">u8").view(np.uint8).reshape(-1, 8), rows, size.astype(np.uint8)[:, None]]))
    order = _byte_order(keys)
    a = rows[order]
    same = a[1:] == a[:-1]
    common = np.where(same.all(1), width, same.argmin(1))
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = 0
    return order, np.r_[0, common]


def _byte_order(keys: np.ndarray) -> np.ndarray:
    """The lexicographic order of rows of bytes, by big-endian words from the last to the first."""
    pad = -keys.shape[1] % 8
    words = np.ascontiguousarray(np.pad(keys, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    return np.lexsort(words.T[::-1])


def maximal_repeats(group: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, length: int = LENGTH):
    """Yields (left extension, right extension, members): repeats of `length` bytes or more around anchors of one group.

    right holds the bytes from each anchor on, left those before it, nearest first; n_right and n_left of them are valid.
    A repeat's members share its bytes, and both extensions are the longest that all of them share.
    """
    order, lcp = _sorted_with_lcp(group, right, n_right)
    a, b = left[order[:-1]], left[order[1:]]
    same = a == b
    before = np.minimum(np.where(same.all(1), left.shape[1], same.argmin(1)), np.minimum(n_left[order[:-1]], n_left[order[1:]]))
    for r, i, j in intervals(lcp.tolist(), max(1, length - left.shape[1])):
        need = length - r
        if j == i + 1:
            if before[i] >= need:
                yield int(before[i]), r, order[i : j + 1]
            continue
        members = order[i : j + 1]
        members = members[n_left[members] >= need]
        if len(members) > 1:
            if need <= 0:
                need = 0
            own, common = _sorted_with_lcp(np.zeros(len(members), np.uint64), left[members], n_left[members])
            if need == 0:
                common = np.r_[0, common[1:] + 1]  # an empty left extension is common to all
                for x, k, m in intervals(common.tolist(), 1):
                    yield x - 1, r, members[own[k : m + 1]]
            else:
                for x, k, m in intervals(common.tolist(), need):
                    yield x, r, members[own[k : m + 1]]


def _read(pdf: pd.DataFrame, column: str, kind) -> np.ndarray:
    return np.concatenate([np.array([], kind), *(np.frombuffer(x, kind) for x in pdf[column])])


def _split(values: np.ndarray, n: int):
    """(part, its rows) for values in 0..n-1."""
    order = np.argsort(values, kind="stable")
    cuts = np.searchsorted(values[order], np.arange(n + 1))
    for i in range(n):
        if cuts[i] < cuts[i + 1]:
            yield i, order[cuts[i] : cuts[i + 1]]


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, segment: int = SEGMENT) -> DataFrame:
    """One row per row of df: key, n_bytes, starts and ends (the removed runs, half-open, in bytes) and kept (binary). Anchors are found in segments of a document."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4 * max(4, partitions(df)), -(-size // GROUP_BYTES))
    bucket_of = lambda doc: doc % parts
    docs = df.select(F.coalesce(F.col(key).try_cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.col(key).alias("key"), F.xxhash64(key, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def deal(batches):
        keys, names, rows, held = [], [], [], 0

        def flush():
            x = np.concatenate(rows, axis=1)
            own = np.repeat(np.arange(len(rows)), [r.shape[1] for r in rows])
            order = np.argsort(x[3], kind="stable")
            x, own = x[:, order], own[order]
            k, d = np.array(keys, np.int64), np.array(names, np.int64)
            out = []
            # copies inside a batch need not meet others: only the first of them goes to its hash's group; repeated rows are one
            gone = sure_repeats(x[3], x[4], k[own], d[own], x[0])
            again = np.zeros(len(own), bool)
            fresh = np.lexsort((x[4], x[0], d[own]))
            again[fresh[1:]] = (d[own][fresh][1:] == d[own][fresh][:-1]) & (x[0][fresh][1:] == x[0][fresh][:-1])
            sure = np.flatnonzero(gone & ~again)
            none = b""
            for b, at in _split(bucket_of(d[own[sure]]), parts):
                at = sure[at]
                out.append((parts + b, none, d[own[at]].tobytes(), none, none, x[1, at].astype(np.uint32).tobytes(), (x[2, at] + np.uint64(length)).astype(np.uint32).tobytes(), none))
            x, own = x[:, ~gone], own[~gone]
            for r, at in _split(range_of(x[3], parts).astype(np.int64), parts):
                used, at_doc = np.unique(own[at], return_inverse=True)
                place = x[0, at]
                step = np.diff(x[3, at], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
                near = np.stack([place - x[1, at], x[2, at] - x[1, at]]).astype(np.uint8)
                out.append((r, k[used].tobytes(), d[used].tobytes(), at_doc.astype(np.uint16).tobytes(), step.tobytes(), x[4, at].tobytes(), place.astype(np.uint32).tobytes(), near.tobytes()))
            return pd.DataFrame(out, columns=["r", "keys", "docs", "own", "hashes", "whole", "place", "near"])

        for pdf in batches:
            for k, d, data in zip(pdf["k"], pdf["doc"], pdf["data"], strict=True):
                x = anchors(np.frombuffer(data, np.uint8), length, GRAM, segment)
                if x.shape[1]:
                    keys.append(k), names.append(d), rows.append(x)
                    held += x.shape[1]
                    if held >= BATCH_ANCHORS or len(rows) >= BATCH_DOCS:
                        yield flush()
                        keys, names, rows, held = [], [], [], 0
        if rows:
            yield flush()

    def meet(group: tuple[int], pdf: pd.DataFrame) -> pd.DataFrame:
        cat = np.concatenate
        if group[0] >= parts:  # spans that are sure: they go with their documents
            return pd.DataFrame([(group[0] - parts, b"".join(pdf["docs"]), b"".join(pdf["whole"]), b"".join(pdf["place"]), b"", b"", b"", b"")], columns=["b", "docs", "starts", "ends", "asked", "hashes", "places", "near"])
        h = cat([np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) for x in pdf["hashes"]])
        own = [np.frombuffer(x, np.uint16) for x in pdf["own"]]
        k = cat([np.frombuffer(x, np.int64)[o] for x, o in zip(pdf["keys"], own, strict=True)])
        d = cat([np.frombuffer(x, np.int64)[o] for x, o in zip(pdf["docs"], own, strict=True)])
        whole, place = _read(pdf, "whole", np.uint64), _read(pdf, "place", np.uint32).astype(np.int64)
        near = cat([np.frombuffer(x, np.uint8).reshape(2, -1) for x in pdf["near"]], axis=1).astype(np.int64)
        order = np.argsort(h, kind="stable")
        s = h[order]
        equal = s[1:] == s[:-1]
        order = order[np.r_[False, equal] | np.r_[equal, False]]
        h, k, d, whole, place, near = h[order], k[order], d[order], whole[order], place[order], near[:, order]
        order = np.lexsort((place, d, k, whole, h))
        h, k, d, whole, place, near = h[order], k[order], d[order], whole[order], place[order], near[:, order]
        # rows of one document that came twice are one
        fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (place[1:] != place[:-1])] if len(h) else np.array([], bool)
        h, k, d, whole, place, near = h[fresh], k[fresh], d[fresh], whole[fresh], place[fresh], near[:, fresh]
        if not len(h):
            return pd.DataFrame(columns=["b", "docs", "starts", "ends", "asked", "hashes", "places", "near"])
        new = np.r_[True, (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])]
        _, inverse = np.unique(h, return_inverse=True)
        kinds = np.bincount(inverse, weights=new)[inverse]
        start, end = place - near[0], place - near[0] + near[1] + length
        ask = new & (kinds > 1)
        bucket = bucket_of(d)
        rows = []
        for b, at in _split(np.where(~new | ask, bucket, parts), parts):
            f, q = at[~new[at]], at[ask[at]]
            rows.append((b, d[f].tobytes(), start[f].astype(np.uint32).tobytes(), end[f].astype(np.uint32).tobytes(), d[q].tobytes(), h[q].tobytes(), place[q].astype(np.uint32).tobytes(), near[:, q].astype(np.uint8).tobytes()))
        return pd.DataFrame(rows, columns=["b", "docs", "starts", "ends", "asked", "hashes", "places", "near"])

    def fetch(_, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["r", "hashes", "keys", "docs", "places", "sizes", "right", "left"]
        if not len(found) or not len(own):
            return pd.DataFrame(columns=columns)
        d, h, place = _read(found, "asked", np.int64), _read(found, "hashes", np.uint64), _read(found, "places", np.uint32).astype(np.int64)
        near = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in found["near"]], axis=1).astype(np.int64)
        data = {x: (k, np.frombuffer(v, np.uint8)) for x, k, v in zip(own["doc"], own["k"], own["data"], strict=True)}
        right, left, keys = np.zeros((len(d), length), np.uint8), np.zeros((len(d), length - GRAM), np.uint8), np.zeros(len(d), np.int64)
        n_left, n_right = near[0], near[1] - near[0] + length
        order = np.argsort(d, kind="stable")
        cuts = np.flatnonzero(np.r_[True, d[order][1:] != d[order][:-1]]) if len(d) else np.array([], int)
        for a, z in zip(cuts, [*cuts[1:], len(d)], strict=True):
            at = order[a:z]
            keys[at], bytes_ = data[d[at[0]]]
            i = np.arange(length)
            ahead = np.minimum(place[at, None] + i, len(bytes_) - 1)
            right[at] = np.where(i < n_right[at, None], bytes_[ahead], 0)
            i = np.arange(length - GRAM)
            behind = np.maximum(place[at, None] - 1 - i, 0)
            left[at] = np.where(i < n_left[at, None], bytes_[behind], 0)
        sizes = np.stack([n_right, n_left]).astype(np.uint8)
        rows = [(r, h[at].tobytes(), keys[at].tobytes(), d[at].tobytes(), place[at].astype(np.uint32).tobytes(), sizes[:, at].tobytes(), right[at].tobytes(), left[at].tobytes()) for r, at in _split(range_of(h, parts).astype(np.int64), parts)]
        return pd.DataFrame(rows, columns=columns)

    def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
        h, k, d, place = _read(pdf, "hashes", np.uint64), _read(pdf, "keys", np.int64), _read(pdf, "docs", np.int64), _read(pdf, "places", np.uint32).astype(np.int64)
        sizes = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in pdf["sizes"]], axis=1).astype(np.int64)
        right, left = _read(pdf, "right", np.uint8).reshape(-1, length), _read(pdf, "left", np.uint8).reshape(-1, length - GRAM)
        # a rank by document and place, so that a group's earliest occurrence is its least
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((place, d, k))] = np.arange(len(h))
        who, start, end = [np.array([], np.int64)], [np.array([], np.int64)], [np.array([], np.int64)]
        for l, r, members in maximal_repeats(h, right, sizes[0], left, sizes[1], length):
            # occurrences before the earliest one's shifted copy keep their order: all are shifted alike
            later = members[rank[members] != rank[members].min()]
            who.append(d[later])
            start.append(place[later] - l)
            end.append(place[later] + r)
        d, a, z = np.concatenate(who), np.concatenate(start), np.concatenate(end)
        rows = [(b, d[at].tobytes(), a[at].astype(np.uint32).tobytes(), z[at].astype(np.uint32).tobytes()) for b, at in _split(bucket_of(d), parts)]
        return pd.DataFrame(rows, columns=["b", "docs", "starts", "ends"])

    kind = df.schema[key].dataType.simpleString()

    def cut(_, own: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        d, a, z = (_read(spans, c, t) for c, t in (("docs", np.int64), ("starts", np.uint32), ("ends", np.uint32)))
        order = np.lexsort((a, d))
        d, a, z = d[order], a[order].astype(np.int64), z[order].astype(np.int64)
        rows = []
        for name, key_, data in zip(own["doc"], own["key"], own["data"], strict=True):
            i, j = np.searchsorted(d, name), np.searchsorted(d, name, "right")
            b, e = a[i:j], z[i:j]
            if len(b):
                e = np.maximum.accumulate(e)
                new = np.r_[True, b[1:] > e[:-1]]
                b, e = b[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(e) - 1]]
            keep = np.r_[0, e], np.r_[b, len(data)]
            rows.append((key_, len(data), b, e, b"".join(data[x:y] for x, y in zip(*keep, strict=True))))
        return pd.DataFrame(rows, columns=["key", "n_bytes", "starts", "ends", "kept"]).astype({"key": "object"})

    dealt = docs.select("k", "doc", "data").mapInPandas(deal, "r int, keys binary, docs binary, own binary, hashes binary, whole binary, place binary, near binary")
    found = written(dealt.groupBy("r").applyInPandas(meet, "b int, docs binary, starts binary, ends binary, asked binary, hashes binary, places binary, near binary"))
    del dealt
    by_bucket = docs.withColumn("b", F.pmod("doc", F.lit(parts)).cast("int"))
    asked = found.where(F.octet_length("asked") > 0).select("b", "asked", "hashes", "places", "near")
    around = by_bucket.groupBy("b").cogroup(asked.groupBy("b")).applyInPandas(fetch, "r int, hashes binary, keys binary, docs binary, places binary, sizes binary, right binary, left binary")
    more = written(around.groupBy("r").applyInPandas(repeats, "b int, docs binary, starts binary, ends binary"))
    del around
    spans = found.where(F.octet_length("docs") > 0).select("b", "docs", "starts", "ends").unionByName(more)
    done = by_bucket.groupBy("b").cogroup(spans.groupBy("b")).applyInPandas(cut, f"key {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")
    return done.withColumnRenamed("key", key)

