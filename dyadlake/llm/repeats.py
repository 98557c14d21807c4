"""Removal of byte strings that an earlier document holds, by a hash-compared suffix sort.

A byte goes if it lies in a WIDTH-byte string that also starts in a document with a smaller doc_id. All
WIDTH-byte windows of all documents count, but most are never shuffled:

1. Every window has an anchor, its least K-byte substring by hash; equal windows have equal anchors at
   equal offsets. Neighbouring windows with one anchor form a context, which its bytes determine. Only
   (anchor, context, doc) triples are shuffled, about one for 15 bytes, and read in sorted order
   with constant memory (of equal contexts of a batch, one travels under its key): a context that a smaller document has is gone as a whole; the first document
   of a context is checked window by window if its anchor occurs in another context too.
2. Contexts to check travel with their bytes, about 65, to the task of their anchor, since equal windows
   have equal anchors. There the windows of many anchors are sorted as suffixes: a mergesort whose
   comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes,
   after which neighbours that agree on WIDTH bytes are verified byte by byte. An anchor of more contexts
   than a lot is sorted lot by lot; what is not settled in one lot meets by its bytes in sorted order.
3. Marks are joined back to the texts, which gives the spans and what is left.

Defined results: null texts are empty; rows with a null doc_id neither lose bytes nor take any from
others; rows that repeat a doc_id are not smaller than each other (their texts are told apart by 26 bits); texts under WIDTH bytes stay whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.hashing import Prefixes, mix, pieces, utf8

WIDTH, K = 50, 20
LOT = 500_000  # contexts that a task looks at together
SORTED = 20_000  # contexts whose windows a task sorts together, 31 windows each at most
TAG = 26


def suffix_order(p: Prefixes, starts: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """The order of suffixes by their first most bytes (stable): runs by 24 bytes, then a hash-compared mergesort."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64)
    word = lambda k: np.ascontiguousarray(p.buf[starts[:, None] + np.arange(8 * k, 8 * k + 8)]).view(">u8")[:, 0].astype(np.uint64)
    keys = [word(k) for k in range(3)] if most >= 24 else []
    order = np.lexsort(keys[::-1]) if keys else np.arange(n)
    new = np.ones(n, bool)
    if keys:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    else:
        new[1:] = False
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    begin, length = np.repeat(first, size), np.repeat(size, size)  # of each place's block
    width = 1
    while width < size.max():
        at = np.flatnonzero(length > width)
        off = at - begin[at]
        run = off // width
        left = run % 2 == 0
        other = np.where(left, run + 1, run - 1) * width  # the partner run within the block
        lo = np.minimum(other, length[at])
        hi = np.minimum(lo + width, length[at])
        base, top = lo.copy(), hi.copy()
        mine = starts[order[at]]
        while (open_ := base < top).any():
            mid = (base + top) >> 1
            their = starts[order[begin[at] + np.minimum(mid, length[at] - 1)]]
            # elements of the right run come after equal ones of the left
            n_same = p.common(mine, their, most)
            diff = np.minimum(n_same, most - 1)
            before = np.where(n_same == most, ~left, p.buf[their + diff] < p.buf[mine + diff])
            base = np.where(open_ & before, mid + 1, base)
            top = np.where(open_ & ~before, mid, top)
        to = begin[at] + run // 2 * 2 * width + off % width + (base - lo)
        merged = order.copy()
        merged[to] = order[at]
        order = merged
        width *= 2
    return order


def contexts(p: Prefixes, size: np.ndarray, width: int = WIDTH, k: int = K):
    """(document, first window, last window, anchor hash, context hash) of every context.

    size has the lengths of the documents that the buffer holds one after the other.
    """
    n, span = len(p.buf), width - k + 1
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = p.hash(np.arange(n - k + 1), k)
    low = np.uint64(0xFFFFFFFF)
    least, wide = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    m = n - width + 1
    at = (np.minimum(least[:m], least[span - wide : span - wide + m]) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(owner[:m] == owner[width - 1 :])
    if not len(inside):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = at[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[inside[1:]] != owner[inside[:-1]])
    first = np.flatnonzero(new)
    lo, hi = inside[first], inside[np.append(first[1:], len(at)) - 1]
    doc = owner[lo]
    anchor = at[first]
    whole = mix(p.hash(lo, hi + width - lo) + (anchor - lo).astype(np.uint64))
    return doc, lo, hi, h[anchor], whole


def _tag(blob: bytes) -> int:
    """Tells texts that share a doc_id apart."""
    return zlib.crc32(blob) & ((1 << TAG) - 1)


def _slices(pdf: pd.DataFrame):
    """(rows, blobs, prefixes, lengths, begins) of slices of a batch."""
    blobs = [utf8(t) for t in pdf["text"]]
    for lo, hi in pieces(blobs, 1 << 19):
        part = blobs[lo:hi]
        size = np.array([len(b) for b in part], np.int64)
        yield pdf.iloc[lo:hi], part, Prefixes(np.frombuffer(b"".join(part), np.uint8)), size, np.cumsum(size) - size


def _anchors(batches):
    """Texts to (a, c, doc_id, at), at being the place in the text, the windows but one and the tag; at < 0 where a smaller document near by has the context already."""

    def settled(parts):
        a, c, d, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(c, kind="stable")
        first = np.flatnonzero(np.append(True, c[order][1:] != c[order][:-1]))[: len(c)]
        low = np.empty_like(d)
        if len(c):
            low[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(np.append(first, len(c))))
        gone = d > low
        # settled rows carry no key any more: they are spread, so a frequent context is a row for each lot
        a[gone] = mix((d[gone] ^ at[gone]).astype(np.uint64)).astype(np.int64)
        at[gone] = ~at[gone]
        return pd.DataFrame({"a": a, "c": c, "doc_id": d, "at": at})

    parts, n = [], 0
    for pdf in batches:
        for rows, part, p, size, begin in _slices(pdf):
            doc, lo, hi, a, c = contexts(p, size)
            at = ((lo - begin[doc]) << 5) | (hi - lo)
            tags = np.array([_tag(b) for b in part], np.int64)
            parts.append((a.astype(np.int64), c.astype(np.int64), rows["doc_id"].to_numpy(np.int64)[doc], (at << TAG) | tags[doc]))
            n += len(doc)
            if n >= LOT:
                yield settled(parts)
                parts, n = [], 0
    if parts:
        yield settled(parts)


def _shared_contexts(batches):
    """Rows sorted by (a, c, doc_id) to marks: at * 2 + 1 if a smaller document has the context, at * 2, with a, if its windows need a check."""
    last, held = None, []  # last: anchor, context, its smallest doc, whether the anchor has two contexts
    for pdf in batches:
        if not len(pdf):
            continue
        a, c, d, at = (pdf[x].to_numpy(np.int64) for x in ("a", "c", "doc_id", "at"))
        goes = last is not None and a[0] == last[0]
        same = goes and c[0] == last[1]
        new_a = np.append(not goes, a[1:] != a[:-1])
        new_c = new_a | np.append(not same, c[1:] != c[:-1])
        group = np.cumsum(new_c)  # 0 is what goes on from the batch before
        low = np.append([last[2] if same else 0], d[new_c])[group]
        kin = np.cumsum(new_a)
        count = np.bincount(kin, weights=new_c, minlength=kin[-1] + 1)
        if goes:
            count[0] += 2 if last[3] else 1
        two = count > 1
        if goes and two[0] and held:
            yield from held
            held = []
        if kin[-1] > 0 or not goes:
            held = [] if kin[-1] > 0 else held
        settled = at < 0
        at = np.where(settled, ~at, at)
        gone, check = (d > low) | settled, (d == low) & two[kin] & ~settled
        mark = np.concatenate([at[gone] * 2 + 1, at[check] * 2])
        yield pd.DataFrame({"doc_id": np.concatenate([d[gone], d[check]]), "mark": mark, "a": np.concatenate([np.zeros(gone.sum(), np.int64), a[check]])})
        wait = (kin == kin[-1]) & (d == low) & ~settled
        if not two[kin[-1]] and wait.any():
            held.append(pd.DataFrame({"doc_id": d[wait], "mark": at[wait] * 2, "a": a[wait]}))
        last = (a[-1], c[-1], low[-1], bool(two[kin[-1]]))


def _decoded(marks, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows that marks name in a text of that size."""
    at = np.asarray(marks, np.int64) >> (TAG + 1)
    lo, hi = at >> 5, (at >> 5) + (at & 31)
    fits = hi + WIDTH <= size  # but for texts of one doc_id with one tag, always
    return lo[fits], hi[fits]


def _asked(batches):
    """Texts with marks and anchors to (a, doc_id, place, context), place being the tag and the first window."""
    for pdf in batches:
        out = []
        for key, text, marks, anchors in zip(pdf["doc_id"], pdf["text"], pdf["marks"], pdf["anchors"], strict=True):
            blob = utf8(text)
            tag = _tag(blob)
            mine = (np.asarray(marks, np.int64) >> 1 & ((1 << TAG) - 1)) == tag
            at = np.asarray(marks, np.int64)[mine] >> (TAG + 1)
            for a, lo, more in zip(np.asarray(anchors, np.int64)[mine].tolist(), (at >> 5).tolist(), (at & 31).tolist(), strict=True):
                if lo + more + WIDTH <= len(blob):
                    out.append((a, key, lo | tag << 31, blob[lo : lo + more + WIDTH]))
        yield pd.DataFrame(out, columns=["a", "doc_id", "place", "context"])


def _lots(batches):
    """Rows sorted by a in lots, and which of them have an anchor that other lots have too."""
    held, n, open_ = [], 0, None  # open_: an anchor of which a lot has gone out
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n < SORTED:
            continue
        rows = pd.concat(held, ignore_index=True)
        a = rows["a"].to_numpy(np.int64)
        last = int(np.searchsorted(a, a[-1]))
        if last:
            yield rows.iloc[:last], a[:last] == open_ if open_ is not None else np.zeros(last, bool)
            held, n, open_ = [rows.iloc[last:]], len(a) - last, None
        else:
            yield rows, np.ones(len(a), bool)
            held, n, open_ = [], 0, a[0]
    if n:
        rows = pd.concat(held, ignore_index=True)
        yield rows, rows["a"].to_numpy(np.int64) == open_ if open_ is not None else np.zeros(n, bool)


def _sorted_windows(batches):
    """Contexts sorted by anchor to (doc_id, place) of windows that a smaller document has.

    Rows with a window's bytes are open: smallest in their lot, but their anchor has further lots.
    """
    for rows, open_ in _lots(batches):
        blobs = rows["context"].tolist()
        size = np.array([len(b) for b in blobs], np.int64)
        p = Prefixes(np.frombuffer(b"".join(blobs), np.uint8))
        n = size - WIDTH + 1
        row = np.repeat(np.arange(len(blobs)), n)
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = (np.cumsum(size) - size)[row] + off
        order = suffix_order(p, start)
        start, row, off = start[order], row[order], off[order]
        ids = rows["doc_id"].to_numpy(np.int64)[row]
        place = rows["place"].to_numpy(np.int64)[row] + off
        equal = np.zeros(len(start), bool)
        equal[1:] = p.common(start[1:], start[:-1], WIDTH) == WIDTH
        at = np.flatnonzero(equal)  # verified on the bytes
        equal[at] = (p.buf[start[at][:, None] + np.arange(WIDTH)] == p.buf[start[at - 1][:, None] + np.arange(WIDTH)]).all(axis=1)
        first = np.flatnonzero(~equal)
        gone = ids > np.repeat(np.minimum.reduceat(ids, first), np.diff(np.append(first, len(ids))))
        yield pd.DataFrame({"doc_id": ids[gone], "place": place[gone]}).assign(window=None)
        wait = np.flatnonzero(open_[row] & ~gone)
        if len(wait):
            yield pd.DataFrame({"doc_id": ids[wait], "place": place[wait], "window": [p.buf[i : i + WIDTH].tobytes() for i in start[wait].tolist()]})


def _shared_windows(batches):
    """Rows sorted by (window, doc_id) to the places that a smaller document also has."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        w, d, place = pdf["window"].to_numpy(object), pdf["doc_id"].to_numpy(np.int64), pdf["place"].to_numpy(np.int64)
        same = last is not None and w[0] == last[0]
        new = np.append(not same, (w[1:] != w[:-1]).astype(bool))
        low = np.append([last[1] if same else 0], d[new])[np.cumsum(new)]
        gone = d > low
        yield pd.DataFrame({"doc_id": d[gone], "place": place[gone]})
        last = (w[-1], low[-1])


def _cleaned(batches):
    for pdf in batches:
        out = []
        for text, marks, places in zip(pdf["text"], pdf["marks"], pdf["places"], strict=True):
            blob = utf8(text)
            m, at = (np.asarray(x if x is not None else [], np.int64) for x in (marks, places))
            if len(m) or len(at):
                tag = _tag(blob)
                m, at = m[(m >> 1 & ((1 << TAG) - 1)) == tag], at[at >> 31 == tag] & 0x7FFFFFFF
            if not len(m) and not len(at):
                out.append((len(blob), 0, 0, hashlib.sha256(blob).hexdigest(), blob))
                continue
            lo, hi = _decoded(m, len(blob))
            at = at[at + WIDTH <= len(blob)]
            edge = np.bincount(np.append(lo, at), minlength=len(blob) + 1) - np.bincount(np.append(hi, at) + WIDTH, minlength=len(blob) + 1)
            hit = np.cumsum(edge)[:-1] > 0
            left = np.frombuffer(blob, np.uint8)[~hit].tobytes()
            out.append((len(blob), int(hit.sum()), int((hit & ~np.append(False, hit[:-1])).sum()), hashlib.sha256(left).hexdigest(), left))
        yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).assign(doc_id=pdf["doc_id"].astype("Int64").to_numpy())


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept has the remaining bytes."""
    docs = docs.select("doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("doc_id is not null and octet_length(text) >= %d" % WIDTH)
    found = known.mapInPandas(_anchors, "a long, c long, doc_id long, at long")
    marks = found.repartition(n, "a").sortWithinPartitions("a", "c", "doc_id").mapInPandas(_shared_contexts, "doc_id long, mark long, a long")
    marks = common.cut(marks)
    # bounded by a document's own anchors
    per_doc = marks.where("mark % 2 = 1").groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    asked = marks.where("mark % 2 = 0").groupBy("doc_id").agg(F.collect_list(F.struct("mark", "a")).alias("asked"))
    asked = asked.select("doc_id", F.col("asked.mark").alias("marks"), F.col("asked.a").alias("anchors"))
    unsure = known.join(asked, "doc_id").select("doc_id", "text", "marks", "anchors").mapInPandas(_asked, "a long, doc_id long, place long, context binary")
    order = unsure.repartition(n, "a").sortWithinPartitions("a")
    settled = common.cut(order.mapInPandas(_sorted_windows, "doc_id long, place long, window binary"))
    hot = settled.where("window is not null").repartition(n, "window").sortWithinPartitions("window", "doc_id")
    places = settled.where("window is null").select("doc_id", "place").unionByName(hot.mapInPandas(_shared_windows, "doc_id long, place long"))
    places = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    both = docs.join(per_doc.join(places, "doc_id", "full"), "doc_id", "left")
    return both.select("doc_id", "text", "marks", "places").mapInPandas(_cleaned, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, doc_id long")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
