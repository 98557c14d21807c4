"""Token ids in directly addressable codes.

Texts are encoded with a public byte-level BPE file and written in ascending key order as segments of
whole documents. A segment holds its ids as directly addressable codes: an id is split into 8-bit chunks,
the lowest on level 0; a bitmap on each level marks the ids that continue on the next, and a directory of
ranks (one count for every 512 bits) finds an id's place there. Any token is read by a few look-ups,
without decoding a block.

Texts are encoded where they are read; what is shuffled is their ids, two bytes each where the vocabulary allows it.

Segments are binary cells of a Parquet table in the shared folder, so Spark's own writer commits them (a
retried task leaves no half file) to whatever store the cluster uses.

Defined results: a null text is empty and has the end id alone; null keys come first; repeated keys
keep a row each, in the order of their texts' hashes; empty tables give no segment; other columns are not read. A
document is encoded whole and lies in one segment.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from codecs import charmap_decode

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.hashing import Prefixes, mix, pieces

END = 2
SEGMENT = 1 << 16
_WORD, _BLOCK = 8, 64
_LONGEST = 48  # bytes of a part that is kept
_LETTER, _SPACE, _MARK, _PRINT, _LEAD = 1, 2, 4, 8, 16
_kept: dict = {}


def _kinds() -> np.ndarray:
    """What each byte may be: a Latin letter, white space, a mark, printable, or the start of a longer white space."""
    k = np.zeros(256, np.uint8)
    k[0x21:0x7F] = _PRINT
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B)):
        k[lo:hi] |= _LETTER
    k[[ord(c) for c in ",.;:!?"]] |= _MARK
    k[[9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = _SPACE
    k[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD
    return k


_KINDS = _kinds()


def pack(ids: np.ndarray) -> bytes:
    """The codes of an array of non-negative ids below 2^32."""
    rest, out = ids.astype(np.uint32), []
    while True:
        more = rest >= 256
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % _BLOCK, np.uint8)])
        ranks = np.cumsum(np.concatenate([[0], np.bitwise_count(bits).reshape(-1, _BLOCK).sum(axis=1, dtype=np.int64)]))[:-1] if len(bits) else np.zeros(0)
        out.append(struct.pack("<QII", len(rest), len(bits), len(ranks)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    return b"DAC1" + struct.pack("<I", len(out)) + b"".join(out)


class Codes:
    """Random access to packed ids."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<I", blob, 4)[0]):
            n, b, r = struct.unpack_from("<QII", blob, at)
            at += 16
            self.levels.append((np.frombuffer(blob, np.uint8, n, at), np.frombuffer(blob, np.uint8, b, at + n), np.frombuffer(blob, "<u4", r, at + n + b)))
            at += n + b + 4 * r
        self.n = len(self.levels[0][0])

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        return int(self.take(np.array([range(self.n)[i]]))[0])

    def take(self, where: np.ndarray) -> np.ndarray:
        """The ids at the given places, each by rank look-ups on its own path."""
        out, at, live = np.zeros(len(where), np.uint32), np.asarray(where, np.int64), np.arange(len(where))
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[live] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[at >> 3] >> (at & 7)) & 1 == 1
            live, at = live[on], at[on]
            if not len(live):
                break
            block = at // (8 * _BLOCK)
            inside = np.bitwise_count(bits.reshape(-1, _BLOCK)[block])
            byte = (at >> 3) % _BLOCK
            inside[np.arange(_BLOCK)[None, :] >= byte[:, None]] = 0
            own = np.bitwise_count(bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8))
            at = ranks[block].astype(np.int64) + inside.sum(axis=1, dtype=np.int64) + own
        return out

    def all(self) -> np.ndarray:
        """All ids in order, level by level."""
        rest = None
        for chunk, bits, _ in reversed(self.levels):
            mine = chunk.astype(np.uint32)
            if rest is not None:
                on = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
                mine[on] |= rest << np.uint32(8)
            rest = mine
        return rest


def _mapped() -> dict[int, str]:
    """The character that byte-level files write for each byte: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def parts_of(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of parts that byte-level BPE encodes independently of each other.

    Its pre-tokens always end before a blank with something after it, between a Latin letter and a mark, and
    after a single line end; where it isn't certain, no part starts.
    """
    k = _KINDS[buf]
    solid = (k & (_SPACE | _LEAD)) == 0
    at = np.zeros(len(buf), bool)
    at[:-1] = (buf[:-1] == 0x20) & solid[1:]
    at[ends - 1] = False  # what follows is another text
    at[1:] |= ((k[1:] & _MARK) > 0) & ((k[:-1] & _LETTER) > 0)
    at[2:] |= (buf[1:-1] == 10) & ((k[:-2] & _PRINT) > 0) & solid[2:]
    at[begins] = True
    return np.flatnonzero(at)


class Encoder:
    """Ids of many texts: each distinct part goes through the tokenizers library once and is kept by its hash.

    The table is open-addressed and holds at most `most` parts (about 60 bytes each); a full one starts anew. Parts
    over 48 bytes are encoded each time. Two parts of one table with equal 64-bit hashes would be
    taken for each other: a chance of 2^-64 for each pair.
    """

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        told = json.loads(self.tok.to_str())
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        # the rules of parts hold for a plain byte-level file only; others are encoded text by text
        self.parted = pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space")
        self.parted &= not told.get("normalizer") and not told.get("post_processor") and told["model"]["type"] == "BPE"
        self.parted &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["content"].isascii() or set(t["content"]) & set(" \n,.;:!?") for t in added)
        self.words = Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([])
        self.map = _mapped()
        self.chars = "".join(self.map[b] for b in range(256))
        self.stop = self.tok.token_to_id(self.map[10])
        self.parted &= self.stop is not None
        self.most, self.bits = most, 1 + int(np.ceil(np.log2(most + 1)))
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.size = np.zeros(1 << self.bits, np.uint16)
        self.ids = np.zeros(1 << 20, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes, -1 where there is none."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out, live = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(live):
            key = self.keys[slot]
            hit = key == h[live]
            out[live[hit]] = slot[hit]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _put(self, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Distinct new hashes with where their ids are."""
        live, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(live):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[live[free]]  # of those that want one slot, the last gets it
            got = self.keys[slot] == h[live]
            self.at[slot[got]], self.size[slot[got]] = at[live[got]], size[live[got]]
            live, slot = live[~got], (slot[~got] + 1) & (len(self.keys) - 1)
        self.n += len(h)

    def _keep(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _library(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where they start and how many they are for each part).

        Parts of letters alone go in one list; a line end, which none of them holds, tells them apart.
        """
        texts = [x.decode("utf-8", "replace") for x in parts]
        easy = np.array([t[1:].isalpha() and (t[0] == " " or t[0].isalpha()) if len(t) > 1 else t.isalpha() for t in texts], bool)
        lead, line = self.map[0x20], self.map[10]
        spelled = [t.replace(" ", lead) if t.isascii() else charmap_decode(x, "strict", self.chars)[0] for t, x, e in zip(texts, parts, easy.tolist(), strict=True) if e]
        words = [line] * (2 * len(spelled))
        words[::2] = spelled
        lists = self.words.encode_batch_fast([words[i : i + 4000] for i in range(0, len(words), 4000)], is_pretokenized=True, add_special_tokens=False)
        rest = self.tok.encode_batch_fast([t for t, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False)
        flat = [np.array(r.ids, np.uint32) for r in lists] + [np.array([i for r in rest for i in r.ids], np.uint32)]
        ends = np.flatnonzero(np.concatenate(flat[:-1] or [np.zeros(0, np.uint32)]) == self.stop)
        n, at = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        n[easy], at[easy] = np.diff(ends, prepend=-1) - 1, np.append(-1, ends[:-1])[: len(ends)] + 1
        n[~easy] = [len(r) for r in rest]
        at[~easy] = sum(map(len, flat[:-1])) + np.cumsum(n[~easy]) - n[~easy]
        return np.concatenate(flat), at, n

    def encode(self, blobs: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        if not self.parted:
            return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([b.decode("utf-8", "replace") for b in blobs], add_special_tokens=False)]
        out: list[np.ndarray] = []
        for lo, hi in pieces(blobs):
            out += self._slice(blobs[lo:hi])
        return out

    def _slice(self, blobs: list[bytes]) -> list[np.ndarray]:
        lens = np.array([len(b) for b in blobs], np.int64)
        whole = b"".join(blobs)
        if not whole:
            return [np.zeros(0, np.uint32)] * len(blobs)
        if self.n > self.most // 2 and self.n + len(whole) // 2 > self.most:
            self.clear()
        buf, stop = np.frombuffer(whole, np.uint8), np.cumsum(lens)
        full = lens > 0
        start = parts_of(buf, (stop - lens)[full], stop[full])
        end = np.append(start[1:], len(buf))
        size = end - start
        h = Prefixes(buf).hash(start, size) | np.uint64(1)
        short = size <= _LONGEST
        slot = np.full(len(h), -1, np.int64)
        slot[short] = self.find(h[short])
        new, first = np.unique(h[short & (slot < 0)], return_index=True)
        if len(new):
            which = np.flatnonzero(short & (slot < 0))
            ids, at, n = self._library([whole[start[i] : end[i]] for i in which[first]])
            self._put(new, self.used + at, n)
            self._keep(ids)
            slot[which] = self.find(h[which])
        at, n = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        mark = self.used
        long = np.flatnonzero(~short)
        if len(long):
            ids, where, m = self._library([whole[start[i] : end[i]] for i in long])
            at[long], n[long] = self.used + where, m
            self._keep(ids)
        ids = self.ids[np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        self.used = mark
        count = np.zeros(len(blobs), np.int64)
        np.add.at(count, np.searchsorted(stop, start, "right"), n)
        return np.split(ids, np.cumsum(count)[:-1])


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Encoder(path)
    return _kept[path]


def write_segments(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Encode docs, write the segments and return the written table.

    Columns: shard and seq (their order is the order of keys), n_tokens, doc_ids and sizes (packed
    64-bit integers) and codes.
    """

    def encoded(batches):
        work = encoder(tokenizer)
        for pdf in batches:
            blobs = [b"" if t is None else bytes(t) for t in pdf["text"]]
            for lo, hi in pieces(blobs, 1 << 22):
                rows = pdf.iloc[lo:hi]
                ids = [np.append(x, np.uint32(end)) for x in work.encode(blobs[lo:hi])]
                wide = [x.max() > 0xFFFF for x in ids]
                yield rows[["shard", "doc_id", "tie"]].assign(wide=wide, ids=[x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)])

    def packed(batches):
        shard, seq, keys, nulls, parts, size = None, 0, [], [], [], 0

        def row():
            lens = np.array([len(p) for p in parts], "<i8")
            return pd.DataFrame({"shard": [shard], "seq": [seq], "n_tokens": [size], "doc_ids": [np.array(keys, "<i8").tobytes()], "no_id": [np.packbits(nulls).tobytes()], "sizes": [lens.tobytes()], "codes": [pack(np.concatenate(parts))]})

        for pdf in batches:
            for r in pdf.itertuples():
                if parts and (r.shard != shard or size >= SEGMENT):
                    yield row()
                    seq, keys, nulls, parts, size = seq + 1, [], [], [], 0
                if r.shard != shard:
                    shard, seq = r.shard, 0
                parts.append(np.frombuffer(r.ids, "<u4" if r.wide else "<u2"))
                nulls.append(pd.isna(r.doc_id))
                keys.append(0 if nulls[-1] else int(r.doc_id))
                size += len(parts[-1])
        if parts:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges from the keys alone, so that the texts are read once; equal keys share a range
    cuts = [x for x in docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []]
    shard = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    keyed = docs.select(shard.cast("int").alias("shard"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), F.col("text").cast("binary").alias("text"))
    ids = keyed.mapInPandas(encoded, "shard int, doc_id long, tie long, wide boolean, ids binary")
    placed = ids.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie")
    return common.cut(placed.mapInPandas(packed, "shard int, seq int, n_tokens long, doc_ids binary, no_id binary, sizes binary, codes binary"))


def read_segments(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written segments."""
    meta = table.select("shard", "seq", "n_tokens")
    # as many rows as there are shards
    shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("shard").orderBy("seq")) - F.col("n_tokens")
    # written, so that its size is known when the plan of the join is chosen
    starts = common.cut(meta.withColumn("own", own).join(shards, "shard").select("shard", "seq", (F.col("before") + F.col("own")).alias("base")))

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ids, size = Codes(r.codes).all().astype("<u4"), np.frombuffer(r.sizes, "<i8")
                stop = np.cumsum(size)
                key = pd.array(np.frombuffer(r.doc_ids, "<i8"), "Int64")
                key[np.unpackbits(np.frombuffer(r.no_id, np.uint8), count=len(size)).astype(bool)] = pd.NA
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for n, b in zip(size, stop, strict=True)]
                yield pd.DataFrame({"doc_id": key, "start": r.base + stop - size, "n_tokens": size, "ids_crc32": crc})

    return table.join(starts, ["shard", "seq"]).select("base", "doc_ids", "no_id", "sizes", "codes").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_segments(write_segments(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
