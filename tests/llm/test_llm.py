"""Document operators against brute force, exact round trips and held-out accuracy; edge cases of each."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dyadlake.llm import common, decontaminate, language, minhash, perplexity, quality, quotes, repeats, secrets, segmentations, tokens

SF = "/root/testdata/sf0.001"
needs = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "null key text here"), (5, "a b"), (5, "a b"), (6, "é 😀 " * 400), (7, "word " * 3000)]


def odd(spark, *more):
    """Rows with nulls, empty and long texts, repeats, and columns with clashing names."""
    rows = [(*r, i, "x", "y") for i, r in enumerate([*ODD, *more])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, key string, rank string")


def empty(spark):
    return odd(spark).where("false")


def test_secrets(spark):
    rows = [(10, "token=secret:abcdefgh; password = 'Abcdefgh1'"), (11, "AKIA" + "A1" * 8 + " " + "ab12" * 9), (12, "😀 api-key: x api_key:zzzzzzzzz gh ghp_" + "a" * 40)]
    got = {r.doc_id: r for r in secrets.scan(odd(spark, *rows)).select("doc_id", "rank", secrets.listed(F.col("secrets")).alias("s"), secrets.redacted(F.col("text"), F.col("secrets")).alias("t")).collect()}
    for key, text in rows:
        want = sorted((m.start(), i, m.end()) for i, r in enumerate(secrets.RULES) for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
        assert got[key].s == ",".join(f"{secrets.RULES[i].kind}:{a}:{b}" for a, i, b in want)
    assert got[1].s == "" and got[1].t is None and secrets.scan(empty(spark)).count() == 0


def test_names_of_the_input_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1", 1, 2, 3, 4, 5)], "doc_id long, text string, _rules int, _key int, secrets int, row int, body int")
    out = secrets.scan(docs).first()
    assert (out._rules, out._key, out.row, out.body, len(out.secrets)) == (1, 2, 4, 5, 1)
    talk = spark.createDataFrame([(1, 0, "user", "hi there", 7, 8, 9, 10, 11), (1, 1, "bot", "> hi there\nyes", 7, 8, 9, 10, 11)], "conv_id long, turn int, role string, text string, mark int, conv int, n int, root int, hops int")
    got = {r.turn: r for r in quotes.link(talk).collect()}
    assert got[1].parent == 0 and (got[1].mark, got[1].conv, got[1].n, got[1].root, got[1].hops) == (7, 8, 9, 10, 11)


def _threads(messages):
    """(parent, thread, depth, quotes) of each message by brute force."""
    import regex

    norm = lambda t: regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip(" ")
    own, out = {}, {}
    for (conv, turn), text in sorted(messages.items()):
        lines = text.split("\n")
        runs, last = [], 0
        for line in lines:
            m = re.match(r"[ \t]*(>[> \t]*)", line)
            level = m[1].count(">") if m else 0
            if level and level != last:
                runs.append((level, []))
            if level and norm(line[m.end() :]):
                runs[-1][1].append(norm(line[m.end() :]))
            last = level
        body = [x for x in lines if not re.match(r"[ \t]*>", x)]
        text = "\n".join(body).strip()
        runs = [r for r in runs if r[1]]
        best = None
        for part in (0, 1):
            for i, (level, said) in enumerate(runs):
                for s in [" ".join(said)] if part == 0 else said:
                    origin = own.get((conv, s))
                    if origin is not None and origin < turn:
                        best = min(best or (9, 9, 9, 9), (level, part, i, origin))
        for s in {norm(x) for x in [*text.split("\n"), text]} - {""}:
            own.setdefault((conv, s), turn)
        up = best and best[3]
        out[conv, turn] = (up, out[conv, up][1], out[conv, up][2] + 1, len(runs)) if best else (None, turn, 0, len(runs))
    return out


def test_generated_threads(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["alpha", "Beta", "gamma?", "delta", "eta!", "theta"]
    messages = {}
    for conv in range(60):
        for turn in range(int(rng.integers(1, 9))):
            lines = [" ".join(rng.choice(vocabulary, rng.integers(2, 5))) for _ in range(rng.integers(1, 3))]
            if turn and rng.random() < 0.7:
                said = messages[conv, int(rng.integers(turn))].split("\n")
                lines = [("> " if rng.random() < 0.5 else ">") + x for x in said[: int(rng.integers(1, len(said) + 1))]] + lines
            messages[conv, turn] = "\n".join(lines)
    rows = [(c, t, "user", x) for (c, t), x in messages.items()]
    got = {(r.conv_id, r.turn): (r.parent, r.thread, r.depth, r.n_quotes) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == _threads(messages) and sum(v[2] > 1 for v in got.values()) > 20


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") == [] and secrets.trigram_query("AKIA[A-Z]+") == [frozenset({"aki", "kia"})]


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog and then it runs far away from here today"
    changed = item.replace("today", "now") + " tail"
    items = spark.createDataFrame([(1, item), (2, None), (3, " "), (4, "only three words")], "item_id long, text string")
    docs = odd(spark, (20, "before words " + item.upper() + " after"), (21, "x " + changed), (22, "quick brown fox jumps over a fence"), (23, "see only three words"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert got == {(20, 1), (21, 1), (23, 4)}
    twice = spark.createDataFrame([(1, item, "x"), (1, changed, "y"), (1, item, "z")], "doc_id long, text string, mark string")
    assert [(r.item_id, r.start, r.similarity) for r in decontaminate.leaks(twice, items).collect()] == [(1, 0, 1.0)]
    assert [r.item_id for r in decontaminate.leaks(twice.where("text like '%now%'").union(twice.where("mark = 'z'").withColumn("text", F.lit("other words"))), items).collect()] == [1]
    assert decontaminate.leaks(empty(spark), items).count() == 0 and decontaminate.leaks(docs, items.where("false")).count() == 0


def _components(rows, n=3, num=85, den=100):
    sets = {}
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def _linked(texts, n=3, num=85, den=100):
    """The least index that each text reaches, by overlaps of all pairs in blocks."""
    sets = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in texts)]
    held = {}
    for s in sets:
        for g in s:
            held[g] = held.get(g, 0) + 1
    column = {g: i for i, g in enumerate(g for g, c in held.items() if c > 1)}
    m = np.zeros((len(texts), len(column)), np.float32)
    for i, s in enumerate(sets):
        m[i, [column[g] for g in s if g in column]] = 1
    size, best = np.array([len(s) for s in sets]), np.arange(len(texts))
    both = (m @ m.T).astype(np.int64)
    link = (den * both >= num * (size[:, None] + size - both)) | np.eye(len(texts), dtype=bool)
    while True:
        new = np.array([best[link[i]].min() for i in range(len(texts))])
        if (new == best).all():
            return best
        best = new


def test_families_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(2000):  # four to twelve words of one text replaced, so most copies lie near the threshold
        w = list(base)
        for at in rng.choice(len(w), rng.integers(4, 13), replace=False):
            w[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(w))
    texts += [" ".join(t.split()[: 160 - i % 30]) for i, t in enumerate(texts[:300])]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    want = _linked(texts)
    assert len(set(want)) > 20 and [got[i] for i in range(len(texts))] == list(want)


def test_near_duplicates(spark):
    rng = np.random.default_rng(5)
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One TWO"), (5, "alpha")]
    base = [str(x) for x in rng.integers(0, 10**6, 120)]
    for i in range(6, 60):
        w = list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 7))):
            w[j] = str(i)
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(str(x) for x in rng.integers(0, 10**6, 50))) for i in range(60, 90)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows)
    assert minhash.near_duplicates(odd(spark)).count() == len(ODD) and minhash.near_duplicates(empty(spark)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (2, 1), (3, 3), (None, 4)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1} | {i: 100 for i in range(100, 141)}


@needs
def test_quality_held_out(spark):
    got = quality.op4_quality_embeddings(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_classifiers_on_odd_rows(spark):
    model = quality.fit(odd(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scored(odd(spark), model).count() == len(ODD) and quality.scored(empty(spark), model).count() == 0
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predicted(docs, language.fit(docs)).collect()} == {"und"}


def test_long_keys_keep_their_digits(spark):
    """Keys above 2^53 beside null ones."""
    keys = [None, 2**53 + 1, 2**62 + 7, None]
    docs = spark.createDataFrame([(k, f"some words {i}", "en") for i, k in enumerate(keys)], "doc_id long, text string, lang string").coalesce(1)
    found = [
        quality.scored(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))),
        language.predicted(docs, language.fit(docs)),
        perplexity.judged(docs),
    ]
    for rows in found:
        assert sorted(r.doc_id or 0 for r in rows.select("doc_id").collect()) == [0, 0, 2**53 + 1, 2**62 + 7]


@needs
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = language.op7_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97


def test_perplexity_rules(spark):
    docs = odd(spark, (30, "same line here\n" * 12 + "other words")).withColumn("lang", F.lit("en"))
    got = {r.doc_id: r for r in perplexity.judged(docs).collect()}
    assert (got[30].n_words, got[30].n_dup_lines, got[30].base_failed) == (38, 11, True) and got[1].n_words == 0 and not got[1].kept
    assert perplexity.judged(docs.where("false")).count() == 0


def test_language_model_is_kneser_ney_of_each_language(spark):
    """Against brute force over sequences of code points, counted by the other documents that hold them."""
    # en and ro had one model when languages were dealt to 64 slots by crc32
    texts = [("en", "the cat sat on the mat"), ("en", "The cat; the mat"), ("en", "the the the hat"), ("ro", "pisica şade pe covor"), ("ro", "pisica şi covorul 漢字 𠀀"), ("ro", "漢字 𠀀 pe"), (None, "the cat")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts)], "doc_id long, text string, lang string")
    n = perplexity.ORDER

    def grams(t):
        t = " " * (n - 1) + t
        return [t[i : i + n] for i in range(len(t) - n + 1)]

    want = {}
    for lang in ("en", "ro", None):
        own = [t for x, t in texts if x == lang]
        level = {g: sum(g in grams(t) for t in own) - 1 for t in own for g in grams(t)}
        levels = [level]
        while len(levels) < n:
            below = {}
            for g, c in levels[-1].items():
                below[g[1:]] = below.get(g[1:], 0) + (c > 0)
            levels.append(below)
        low = {"": 1 / (1 + len(levels[-1]))}
        for level in reversed(levels):
            k = [max(1, sum(c == i for c in level.values())) for i in range(1, 5)]
            y = k[0] / (k[0] + 2 * k[1])
            d = [0.0, *(max(min(i - (i + 1) * y * k[i] / k[i - 1], i - 0.1), 0.1) for i in (1, 2, 3))]
            now = {}
            for g, c in level.items():
                near = [v for x, v in level.items() if x[:-1] == g[:-1]]
                total, taken = sum(near), sum(d[min(v, 3)] for v in near)
                now[g] = (c - d[min(c, 3)] + taken * low[g[1:]]) / total if total else low[g[1:]]
            low = now
        want |= {i: np.exp(-np.mean([np.log(low[g]) for g in grams(t)])) for i, (x, t) in enumerate(texts) if x == lang}
    got = {r.doc_id: r.perplexity for r in perplexity.judged(docs).collect()}
    assert got == pytest.approx(want, rel=1e-5)
    # a model sent in many parts gives the same
    assert {r.doc_id: r.perplexity for r in perplexity.judged(docs, piece=30).collect()} == pytest.approx(want, rel=1e-5)


def test_band_rejects_planted_noise(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(300)]
    follow = rng.integers(0, 300, (300, 3))

    def prose(n=500):
        out, at, first = [], int(rng.integers(300)), True
        for i in range(n):
            last = i % 10 == 9
            out.append((vocabulary[at].capitalize() if first else vocabulary[at]) + "." * last)
            at, first = int(follow[at, rng.integers(3)]), last
        return out

    clean = [prose() for _ in range(60)]
    shuffled = [list(rng.permutation(prose())) for _ in range(3)]
    symbols = [[w + "#$%&"[i % 4] * 3 for i, w in enumerate(prose())] for _ in range(3)]
    repetitive = [prose(20) * 25 for _ in range(3)]
    texts = [" ".join(w) for w in clean + shuffled + symbols + repetitive]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in perplexity.judged(docs).collect() if r.kept}
    assert not kept & set(range(60, 69)) and len(kept & set(range(60))) >= 58


def test_codes_round_trip():
    for x in (np.array([], int), np.array([0, 255, 256, 70000, 2**32 - 1]), np.random.default_rng(1).integers(0, 60000, 5000)):
        c = tokens.Codes(tokens.pack(x))
        assert (c.all() == x).all() and (c.take(np.arange(len(x))) == x).all()


def test_parts_equal_the_library():
    import random

    import public_tokenizers

    work = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), most=300)  # small, so that it starts anew
    assert work.parted
    pick = random.Random(4)
    bits = ["a", "b", "Zed", " ", "  ", "\n", "\n\n", ",", ".", "!?", "'s", "é", "漢", "\xa0", "\u3000", "😀", "1", "23", "<|endoftext|>", "\t", " \n", "\r\n", "_", "“", "\x85", "\u2028", "x" * 60]
    texts = ["".join(pick.choices(bits, k=pick.randrange(30))) for _ in range(4000)]
    want = [e.ids for e in work.tok.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x.tolist() for i in range(0, 4000, 50) for x in work.encode([t.encode() for t in texts[i : i + 50]])]
    assert got == want


def test_token_codes(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, at = Tokenizer.from_file(path), 0
    rows = [(k, t) for k, t in ODD if k is not None and k != 5] + [(8, "a  b \t c\n\n d   "), (9, "it's")]
    got = {r.doc_id: r for r in tokens.read_segments(tokens.write_segments(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()}
    for key, text in sorted(rows):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.read_segments(tokens.write_segments(odd(spark), path)).count() == len(ODD)


def test_suffix_order():
    rng = np.random.default_rng(3)
    buf = np.frombuffer(rng.integers(97, 99, 1500).astype(np.uint8).tobytes() + b"abcd" * 80 + b"z" * 50, np.uint8)
    starts = rng.permutation(len(buf) - 50)
    for depth in (50, 20):
        got = [buf[i : i + depth].tobytes() for i in starts[repeats.suffix_order(repeats.Prefixes(buf), starts, depth)]]
        assert got == sorted(got)


def test_repeats(spark):
    rng, rows = np.random.default_rng(4), [(1000, None), (-5, "zz" * 200), (3, "é" * 60), (4, "xé" + "é" * 59)]
    for i in range(10, 40):
        rows.append((i, "".join(rng.choice(list("ab"), int(rng.integers(0, 300)))) + "a passage that many documents share word for word, and more " * int(i % 3)))
    first = {}
    for key, text in sorted(rows):
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], key)
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for key, text in rows:
        b = (text or "").encode()
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key:
                hit[i : i + 50] = True
        r = got[key]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(hit.sum()), int((hit & ~np.append(False, hit[:-1])).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())
    assert repeats.without_repeats(odd(spark)).count() == len(ODD) and repeats.without_repeats(empty(spark)).count() == 0


def test_repeats_of_hot_anchors(monkeypatch):
    """Lots that cut an anchor's contexts give the windows that all of them at once give."""
    rng = np.random.default_rng(8)
    rows, side = [], lambda words, n: "".join(rng.choice(words, n))
    for i, a in enumerate(rng.integers(0, 3, 400) // 2):
        text = side(["ab", "ba"], int(rng.integers(6, 9))) + f"one anchor {a} for all the contexts  " + side(["a", "b"], 4)
        if len(text) >= 50:
            rows.append((int(a), i, 7 << 31, text.encode()))
    pdf = pd.DataFrame(rows, columns=["a", "doc_id", "place", "context"]).sort_values("a", kind="stable", ignore_index=True)
    first, want = {}, set()
    for a, key, _, b in rows:
        for j in range(len(b) - 49):
            if first.setdefault((a, b[j : j + 50]), key) < key:
                want.add((key, j))
    for lot in (20, 90, 1000):
        monkeypatch.setattr(repeats, "SORTED", lot)
        out = pd.concat(list(repeats._sorted_windows(pdf.iloc[i : i + 15] for i in range(0, len(pdf), 15))))
        hot = out[out["window"].notna()].sort_values(["window", "doc_id"], ignore_index=True)
        assert (len(hot) > 0) == (lot < 1000)
        more = list(repeats._shared_windows(hot.iloc[i : i + 7] for i in range(0, len(hot), 7)))
        got = pd.concat([out[out["window"].isna()][["doc_id", "place"]], *more])
        assert {(int(d), int(p) & 0x7FFFFFFF) for d, p in got.itertuples(index=False)} == want and len(want) > 50


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?\nFine day"), (1, 1, "assistant", "> How are you?\nGood."), (1, 2, "user", ">> How are you?\n> Good.\nNice"), (1, 3, None, None), (None, 0, "user", "> x"), (1, 1, "assistant", "> How are you?\nGood.")]
    got = sorted(((r.conv_id, r.turn, r.thread, r.parent, r.depth, r.n_quotes, r.body) for r in quotes.link(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int")).collect()), key=str)
    assert (1, 2, 0, 1, 2, 2, "Nice") in got and (1, 1, 0, 0, 1, 1, "Good.") in got and (1, 3, 3, None, 0, 0, "") in got and (None, 0, 0, None, 0, 1, "") in got and len(got) == 6


def _samples(texts, keys, lat, k, seed):
    """(ids, log probability, inclusion) of each text's samples."""
    out = [[] for _ in texts]
    for who, size, ids, lp, _, inclusion in segmentations.sample([t.encode() for t in texts], keys, lat, k, seed):
        for t, x, p, i in zip(who, np.split(ids, np.cumsum(size)[:-1]), lp, inclusion, strict=True):
            out[t].append((tuple(x.tolist()), p, i))
    return out


def _paths(text, v):
    """Every segmentation of a text by the rules of the lattice, with its probability."""
    weight = {v.pieces[i]: v.weights[i] for i in np.flatnonzero(v.weights)}
    text = "▁" + text.replace(" ", "▁")

    def walk(at):
        if at == len(text):
            yield (), 0.0
        for n in range(1, segmentations.LONGEST + 1):
            if at + n <= len(text) and text[at : at + n] in weight:
                for rest, w in walk(at + n):
                    yield (text[at : at + n], *rest), w + weight[text[at : at + n]]

    found = list(walk(0))
    total = np.logaddexp.reduce([w for _, w in found])
    return {p: float(np.exp(w - total)) for p, w in found}


def test_sampled_segmentations(spark):
    lat = segmentations.Lattices(segmentations.Vocabulary(segmentations.model_path()))
    texts = ["", "a", " a  b\nc é 😀 *** the*** 12", "hello   world \n\n y", "the on", "漢字かな交じり文テスト" * 200, "x" * 5000]
    for text, got in zip(texts, _samples(texts, np.arange(7), lat, 3, 1), strict=True):
        assert got and all(segmentations.decode(s[0], lat.v) == text for s in got) and len({s[0] for s in got}) == len(got)
    many = _samples(["the on"] * 3000, np.arange(3000), lat, 2, 5)
    assert abs(np.mean([sum(np.exp(s[1]) / s[2] for s in r) for r in many]) - 1) < 0.02
    rows = segmentations.encoded(odd(spark), segmentations.model_path(), text_too=True)
    rows = segmentations.decoded(rows.withColumnRenamed("decoded", "spelled"), segmentations.model_path())
    assert rows.where("decoded <> spelled").count() == 0
    assert rows.join(odd(spark).dropDuplicates(["doc_id"]), "doc_id").where("decoded <> text").count() == 0 and segmentations.encoded(empty(spark), segmentations.model_path()).count() == 0


def test_all_segmentations_come_out():
    """As many distinct samples as a text has segmentations, however unlikely some are."""
    lat = segmentations.Lattices(segmentations.Vocabulary(segmentations.model_path()))
    for text in ("the", "cat", "hello", "on it"):
        want = _paths(text, lat.v)
        for got in _samples([text] * 40, np.arange(40), lat, 100, 3):
            assert len(got) == len(want) and {tuple(lat.v.pieces[i] for i in s[0]) for s in got} == set(want)


def test_sampling_probabilities():
    """First samples and ordered pairs of samples against the law of drawing without replacement."""
    lat = segmentations.Lattices(segmentations.Vocabulary(segmentations.model_path()))
    want, n = _paths("on it", lat.v), 40_000
    got = _samples(["on it"] * n, np.arange(n), lat, 2, 9)
    first, both = {}, {}
    for (a, p, _), (b, _, _) in got:
        a, b = (tuple(lat.v.pieces[i] for i in x) for x in (a, b))
        assert abs(np.exp(p) - want[a]) < 1e-4
        first[a] = first.get(a, 0) + 1
        both[a, b] = both.get((a, b), 0) + 1
    for a, p in want.items():
        assert abs(first.get(a, 0) / n - p) < 5 * (p / n) ** 0.5 + 1e-4
        for b, q in want.items():
            if a != b:
                r = p * q / (1 - p)
                assert abs(both.get((a, b), 0) / n - r) < 5 * (r / n) ** 0.5 + 1e-4


@needs
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count() and ids <= {r.doc_id for r in docs.select("doc_id").collect()}


def test_near_duplicate_stage_keeps_one_row_of_a_group(spark):
    import corpus_pipeline

    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(4, a, "p"), (4, a, "p"), (4, b, "q"), (9, a + " more", "r"), (None, a, "s"), (None, a, "s"), (5, None, "t"), (6, "", "u"), (3, b, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted(((r.doc_id, r.mark) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, "p"), (None, "s"), (None, "s"), (5, "t"), (6, "u"), (3, "v")], key=str)
