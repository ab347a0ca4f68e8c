"""Each operator against a plain computation, over rows that hold the awkward cases."""

import gzip
import hashlib
import io
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm import components, compression, crc, encoding, kneser_ney, lines, mixing, packing, pairwise, records, shared, simhash, sketch, textstats, warc, words

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("bucket", T.StringType())])


def prose(seed, n=40):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", *("".join(r.choice("aeiounrst") for _ in range(r.randint(2, 9))) for _ in range(60))]
    return " ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def rows():
    """Nulls in any column, empty, blank and long texts, exact and near copies, repeated rows, an extra column with a used name."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, "Word"), (8, "two words"), (9, prose(9, 30_000)), (10, "A  b\nA b c\n\nA  b\n" + base), (12, "ÉÀ ñ Straße ü x"), (12, "ÉÀ ñ Straße ü x"), (13, "tie one"), (13, "tie two"), (None, "no id here at all, none"), (14, "x" * 5000), (15, "an <|endoftext|> end")]
    out += [(100 + i, prose(100 + i, 10 + 7 * i % 90)) for i in range(60)]
    return [(i, t, None if i == 7 else "en", None if i in (8, 12) else f"s{(i or 0) % 4}", None if t is None else len(t), "b") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def texts():
    return [(r[0], r[1] or "") for r in rows()]


def ascii_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def key(r):
    return tuple((x is None, x) if not isinstance(x, float) else (False, round(x, 9)) for x in r)


# --- shared parts -----------------------------------------------------------------


def test_word_hashes_agree_with_words_across_pieces():
    ts = [t for _, t in texts()]
    seen = {}
    data = pa.array(ts)
    old, words.PIECE = words.PIECE, 700
    try:
        parts = []
        d, off = words.buffers(data)
        for i, j, lo, hi in words.pieces(d, off, 700):
            parts.append((i, j, lo, hi))
        assert parts[-1][3] == off[-1] and all(a[3] == b[2] for a, b in zip(parts, parts[1:]))
    finally:
        words.PIECE = old
    at, h = (np.concatenate(x) for x in zip(*words.hashed(data, lower=False)))
    flat = [(i, w) for i, t in enumerate(ts) for w in ascii_words(t)]
    assert at.tolist() == [i for i, _ in flat]
    for (_, w), x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components_of_random_graphs(spark):
    for seed in range(2):
        r = random.Random(seed)
        edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        for n in {x for e in edges for x in e}:
            assert got.get(n, n) == find(n)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_checkpoint_folder_comes_from_the_session(spark):
    assert shared.root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


# --- 1 ------------------------------------------------------------------------------


def test_kneser_ney_equals_plain_counting(docs, monkeypatch):
    for k, v in (("WORD_SHARD", 1 << 16), ("PAIR_SHARD", 1 << 15), ("PAIRS_PER_CONTEXT", 2), ("TOKENS", 5000)):
        monkeypatch.setattr(kneser_ney, k, v)
    end, begin = "</s> ", "<s> "
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, bi = Counter(), Counter()
    for i, t in texts():
        if not held(i):
            w = [low(x) for x in ascii_words(t)] + [end]
            uni.update(w)
            bi.update(zip([begin, *w], w))
    n, v = sum(uni.values()), len(uni)
    d = (0, *kneser_ney.discounts([Counter(bi.values())[k] for k in (1, 2, 3, 4)]))
    before = Counter(w for _, w in bi)
    e = (0, *kneser_ney.discounts([Counter(before.values())[k] for k in (1, 2, 3, 4)]))
    a, g = len(bi), sum(e[min(3, c)] for c in before.values()) / len(bi)
    total, lost = Counter(), defaultdict(float)
    for (u, _), c in bi.items():
        total[u] += c
        lost[u] += d[min(3, c)]

    def p(u, w):
        one = (before[w] - e[min(3, before[w])]) / a + g / (v + 1)
        return one if not total[u] else (max(0, bi[u, w] - d[min(3, bi[u, w])]) + lost[u] * one) / total[u]

    assert abs(sum(p("the", w) for w in uni) + p("the", "unseen word") - 1) < 1e-9
    want = []
    for i, t in texts():
        w = [low(x) for x in ascii_words(t)] + [end]
        want.append((i, held(i), len(w), sum(x in uni for x in w), n, round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), 5), round(sum(math.log10(p(x, y)) for x, y in zip([begin, *w], w)), 5)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in kneser_ney.op1_kneser_ney(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_kneser_ney_parts():
    r = np.random.default_rng(1)
    for half in (1, 2, 5, 21, 33, 63):
        u, v = (r.integers(0, 1 << half, 500).astype(np.uint64) for _ in range(2))
        a, b = kneser_ney.scattered(u, v, half)
        assert max(a.max(), b.max()) < 1 << half and all((x == y).all() for x, y in zip(kneser_ney.collected(a, b, half), (u, v)))
    every = kneser_ney.scattered(*(x.ravel().astype(np.uint64) for x in np.meshgrid(np.arange(64), np.arange(64))), 6)
    assert len(set(zip(*(x.tolist() for x in every)))) == 4096
    for bits in (1, 7, 30, 46, 64):
        x = r.integers(0, 1 << 63, 3000).astype(np.uint64) >> np.uint64(64 - bits)
        for k in (np.unique(x), x[:1], np.unique(np.array([0, (1 << bits) - 1], np.uint64))):
            assert (kneser_ney.unpacked(kneser_ney.packed(k, bits)) == k).all()
            data = np.frombuffer(b"".join(kneser_ney._array(k, bits)), np.uint8)
            assert (kneser_ney._all(data) == k).all() and (kneser_ney._places(data, k) == np.arange(len(k))).all()
            other = np.setdiff1d(np.unique(np.concatenate([k ^ np.uint64(1), np.array([0, (1 << bits) - 1], np.uint64)])), k)
            assert (kneser_ney._places(data, other) == -1).all()
    for n in (0, 1, 7, 1000):
        c = r.integers(0, 40, n)
        data = np.frombuffer(kneser_ney._small(c), np.uint8)
        at = np.unique(r.integers(0, max(1, n), 50)) if n else np.zeros(0, np.int64)
        assert (kneser_ney._counts(data) == c).all() and (kneser_ney._counts(data, at) == c[at]).all()
    wide = kneser_ney.Space(20, 60, 40)
    u, v = (r.integers(0, 1 << 40, 900).astype(np.uint64) for _ in range(2))
    shard, rest = wide.split(np.tile(u, 2), np.tile(v, 2))
    a, b, n = kneser_ney.add_up(shard, rest, wide)
    assert n.tolist() == [2] * 900 and wide.steps() == [16, 20]
    back = [wide.pair(x, np.array([y])) for x, y in zip(a.tolist(), b)]
    assert {(int(x[0]), int(y[0])) for x, y in back} == set(zip(u.tolist(), v.tolist()))


def test_kneser_ney_deals_blocks_in_passes_and_misses_no_shard(docs, monkeypatch, spark):
    want = {(r.doc_id, round(r.score, 6)) for r in kneser_ney.op1_kneser_ney(docs, 3).collect()}
    for k, v in (("WORD_SHARD", 1 << 12), ("PAIR_SHARD", 1 << 11), ("PAIRS_PER_CONTEXT", 1), ("GRAMS_PER_CONTEXT", 1), ("TOKENS", 3000), ("FAN_BITS", 2)):
        monkeypatch.setattr(kneser_ney, k, v)
    uri = shared.folder(spark, "kneser-ney-test")
    m = kneser_ney.train(docs.where(f"not {kneser_ney.HELD_OUT}").select("text"), uri, 3)
    assert len(m.space(3).steps()) > 1 and len(kneser_ney._spans(m, 2)) > 1
    assert {(r.doc_id, round(r.score, 6)) for r in kneser_ney.op1_kneser_ney(docs, 3).collect()} == want
    store = shared.Store(uri)
    text = pa.array([t for _, t in texts()])
    kneser_ney.score(m, text)
    for name in (kneser_ney._gram_file(3, 0), "context2-0000000"):
        kneser_ney._mapped.cache_clear()
        store.delete(name)
        with pytest.raises(FileNotFoundError):
            kneser_ney.score(m, text)


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_of_higher_orders_equals_plain_counting(docs, monkeypatch, order):
    for k, v in (("WORD_SHARD", 1 << 16), ("PAIR_SHARD", 1 << 15), ("PAIRS_PER_CONTEXT", 2), ("GRAMS_PER_CONTEXT", 2), ("TOKENS", 5000)):
        monkeypatch.setattr(kneser_ney, k, v)
    end, begin = "</s> ", "<s> "
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [begin] * (order - 1) + [low(x) for x in ascii_words(t)] + [end]
    c = {order: Counter()}
    for i, t in texts():
        if not held(i):
            w = tokens(t)
            c[order].update(tuple(w[j - order + 1 : j + 1]) for j in range(order - 1, len(w)))
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    d = {k: (0, *kneser_ney.discounts([Counter(c[k].values())[i] for i in (1, 2, 3, 4)])) for k in c}
    total, lost = Counter(), defaultdict(float)
    for k in c:
        for g, x in c[k].items():
            total[k, g[:-1]] += x
            lost[k, g[:-1]] += d[k][min(3, x)]

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / (len(c[1]) + 1)
        x = c[k][g]
        return (x - d[k][min(3, x)] + lost[k, g[:-1]] * below) / total[k, g[:-1]] if total[k, g[:-1]] else below

    seen = max(c[order], key=c[order].get)[:-1]
    assert abs(sum(p((*seen, *w)) for w in c[1]) + p((*seen, "unseen word")) - 1) < 1e-9
    want = []
    for i, t in texts():
        w = tokens(t)
        want.append((i, len(w) - order + 1, round(sum(math.log10(p(tuple(w[j - order + 1 : j + 1]))) for j in range(order - 1, len(w))), 5)))
    got = [(r.doc_id, r.n_tokens, round(r.score, 5)) for r in kneser_ney.op1_kneser_ney(docs, order).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_kneser_ney_is_registered_with_longer_contexts(spark, tmp_path):
    from termloom.llm import queries

    rows_ = [(i, "a b c a b c x b d x b d") for i in range(40)] + [(100 + i, t) for i in range(50) for t in ("a b c", "a b d")]
    spark.createDataFrame(rows_, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.score for r in queries.QUERIES["op1_kneser_ney"](spark, str(tmp_path)).collect()}
    two = {r.doc_id: r.score for r in kneser_ney.op1_kneser_ney(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert all(got[i] > two[i] for i in range(40))


def test_kneser_ney_of_nothing(none):
    assert kneser_ney.op1_kneser_ney(none).count() == 0


# --- 2 ------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = [low(x) for x in ascii_words(t)]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_all_pairs(docs):
    for crowd in (32, 1):
        got = simhash.near_duplicates(docs, crowd).collect()
        fp = {i: plain_fingerprint(t) for i, t in texts() if i not in (13,)}
        assert all(r.fp % 2**64 == fp[r.doc_id] for r in got if r.doc_id in fp)
        every = sorted({r.fp % 2**64 for r in got})
        root = {x: x for x in every}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, x in enumerate(every):
            for y in every[:i]:
                if (x ^ y).bit_count() <= 2:
                    root[find(x)] = find(y)
        least = {}
        for r in got:
            if r.doc_id is not None:
                k = find(r.fp % 2**64)
                least[k] = min(least.get(k, r.doc_id), r.doc_id)
        assert len(got) == len(rows()) and all(r.component_id == least.get(find(r.fp % 2**64)) for r in got)


def test_simhash_links_at_two_bits_even_in_a_crowd(spark):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(3)]
    fps = {c ^ (1 << a) ^ (1 << b) for c in centre for a in range(0, 64, 5) for b in range(a, 64, 7)} | {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    for crowd in (3, 32):
        got = {(x.node % 2**64): x.root for x in components.components(simhash.links(df, crowd)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(got.get(x, x if x < 2**63 else x - 2**64), set()).add(x)
        left, want = set(fps), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                x = todo.pop()
                seen.add(x)
                near = {y for y in left if (x ^ y).bit_count() <= 2}
                left -= near
                todo += near
            want.append(seen)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want))


def test_no_simhash_join_goes_through_the_driver(spark, docs, monkeypatch):
    # Spark thinks that 64 variants take no more room than their fingerprint, and so would broadcast far more than its limit
    plans = []
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared.cut(df)
    for module in (simhash, components):
        monkeypatch.setattr(module, "cut", noted)
    for of in (simhash.near_duplicates, simhash.one_of_each):
        plans.append(of(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


def test_one_of_each_keeps_one_row_for_a_group(docs, none):
    kept = simhash.one_of_each(docs).collect()
    assert list(kept[0].asDict()) == docs.columns
    named = [r.doc_id for r in kept if r.doc_id not in (None, 13)]  # the two texts of 13 are no near-duplicates
    assert {r.text for r in kept if r.doc_id == 13} == {"tie one", "tie two"}
    assert len(named) == len(set(named)) and 1 in named and 2 not in named and named.count(12) == 1 and 4 in named and 5 not in named
    assert simhash.one_of_each(none).count() == 0
    three = docs.sparkSession.createDataFrame([(1, "a b c d"), (None, "a b c d"), (None, "a b c d"), (7, "quite other words"), (7, "and not like these at all"), (None, "alone"), (None, "alone")], "doc_id long, text string")
    assert Counter(tuple(r) for r in simhash.one_of_each(three).collect()) == Counter([(1, "a b c d"), (7, "quite other words"), (7, "and not like these at all"), (None, "alone")])


# --- 3 ------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, digest string"


def test_warc_round_trip(spark):
    long, longer = "é" * 60, "<p>" + prose(3, 9000)
    pages = [(1, "http://a/ b", long, "x"), (2, None, long, "x"), (3, "u", "short", None), (4, "u", "short", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (0, "u", longer, "x"), (9, "u", longer, "x"), (9, "u", longer, "x"), (None, "u", longer, "x"), (0, "again", longer, "x"), (11, "u", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9, "x")]
    uri = shared.folder(spark, "warc-test")
    shards = warc.archive(spark.createDataFrame(pages, PAGE).repartition(2), uri, rows_per_shard=5)
    got = [tuple(r) for r in warc.read(shards, uri).collect()]
    first = {}
    for i, _, h, _ in pages:
        h = (h or "").encode()
        if len(h) >= 100 and i is not None:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h, _ in pages:
        h = (h or "").encode()
        again = h in first and (i is None or i > first[h])
        want.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert warc.op3_warc(spark.createDataFrame([], PAGE)).count() == 0


def test_normaliser_of_any_members(tmp_path):
    recs = [warc.record("response", i, f"http://h/{i}", "d", 3, prose(i, 400 * (i % 3)).encode(), None) for i in range(12)]
    for whole in (gzip.compress(b"".join(recs)), b"".join(gzip.compress(r) for r in recs), gzip.compress(b"".join(recs[:5])) + gzip.compress(b"".join(recs[5:]))):
        index = []
        out = b"".join(warc.normalise(io.BytesIO(whole), index.append))
        assert [gzip.decompress(out[x["offset"] : x["offset"] + x["length"]]) for x in index] == recs
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(gzip.compress(b"".join(recs))[:-900]), lambda x: None))


# --- 4 ------------------------------------------------------------------------------


def plain_units(text):
    """(start, end, words) of lines, and of sentences where a line has several, short ones with their neighbours; by character."""

    def parts(a, z, ends):
        out, at = [], a
        k = a
        while k < z:
            k += 1
            if ends(text[a:z], k - a):
                out.append((at, k))
                at = k
        return out + ([(at, z)] if at < z else [])

    def whole(pieces, i):
        words = lambda a, b: text[pieces[a][0] : pieces[b][1]].lower().split()
        j = k = i
        while len(words(j, k)) < 5 and k + 1 < len(pieces):
            k += 1
        while len(words(j, k)) < 5 and j:
            j -= 1
        return j, k, words(j, k)

    line = lambda t, k: t[k - 1] == "\n" and t[k : k + 1] != "\n"

    def sentence(t, k):  # after a run of marks, what clings to it, and white space
        m = re.search(r"[.!?][^\s.!?]*\s*$", t[:k])
        return bool(m) and t[k : k + 1] not in (".", "!", "?") and not (t[k : k + 1] and (t[k].isspace() or not t[k - 1].isspace()))

    pieces = parts(0, len(text), line)
    for i, (a, z) in enumerate(pieces):
        if len(text[a:z].split()) < 5:
            j, k, words = whole(pieces, i)
            if text[a:z].split() and len(words) >= 5:
                yield pieces[j][0], pieces[k][1], tuple(words)
            continue
        yield a, z, tuple(text[a:z].lower().split())
        inner = parts(a, z, sentence)
        for n in range(len(inner)):
            j, k, words = whole(inner, n)
            if k - j + 1 < len(inner):
                yield inner[j][0], inner[k][1], tuple(words)


def test_units_equal_plain_ones():
    r = random.Random(12)
    for seed in range(300):
        t = "".join(r.choice([" ", " ", ". ", "! ", ".) ", "\n", "\n\n", "?! ", ", ", ". \n"]) + r.choice(["a", "bb", "Cc c", "d's", "e-e", "f"]) for _ in range(r.randint(0, 60)))
        got = [(a, z, " ".join(w)) for a, z, w in plain_units(t)]
        assert [(a, z, xxhash.xxh3_128_digest(w)) for a, z, w in got] == list(lines.units(t)), t


def test_lines_equal_a_plain_pass(docs, spark, none):
    passage = prose(77, 60)
    extra = [(200, f"{prose(200, 12)}\n{passage}\n{prose(201, 12)}"), (201, f"{prose(202, 12)}\n{passage.upper()}\nend of it here now"), (202, f"Some words come before it here. {passage}. And some come after it here.")]
    df = docs.select("doc_id", "text").where("doc_id is not null").unionAll(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {(r.doc_id, r.removed_chars, r.text) for r in lines.op4_lines(df).collect()}
    seen, want = {}, set()
    every = sorted({(r.doc_id, spark_hash, r.text) for r, spark_hash in ((r, r.h) for r in df.withColumn("h", F.xxhash64("text")).collect())}, key=lambda x: x[:2])
    for i, h, t in every:
        gone = set()
        for a, z, d in plain_units(t or ""):
            first = seen.setdefault(d, (i, h, a, z))
            if first[:2] != (i, h) or a >= first[3]:
                gone.update(range(a, z))
        kept = "".join(c for k, c in enumerate(t) if k not in gone) if t is not None else None
        want.add((i, len(t or "") - len(kept or ""), kept))
    assert got == want
    by = {i: t for i, _, t in got}
    assert passage.lower()[:200] not in by[201].lower() and passage in by[200] and len(by[202]) < 150 and "Some words come before" in by[202]
    assert lines.op4_lines(none).count() == 0
    assert lines.deduplicate(docs).columns == docs.columns and lines.deduplicate(docs).count() == docs.count()


def test_passages_in_short_lines_are_found(spark):
    verse = "".join(f"{a} {b}\n" for a, b in zip(prose(61, 40).split(), prose(62, 40).split()))
    over = "by to.\n" * 40
    rows_ = [(1, "A line of five words.\n" + verse), (2, "Some other words come first here.\n" + verse + "And other words come after it.\n"), (3, over), (4, "no\nno"), (5, "And quite other words stand here.\n" + over)]
    got = {r.doc_id: r.text for r in lines.op4_lines(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got[1] == rows_[0][1] and got[2] == "Some other words come first here.\nAnd other words come after it.\n"
    assert got[3] == "by to.\n" * 3 and got[4] == "no\nno" and got[5] == "And quite other words stand here.\n"


# --- 5 and 6 ---------------------------------------------------------------------------


def hard_texts():
    r = random.Random(3)
    some = ["", " ", "\n\na", "a\n", "it's 'tis don''t", "  a　b", "é ́x", "ΑΣ ΣΑΣ\nΣ", "1234 5,6.7!?\t\tz ", "<|endoftext|> a", "b<|startoftext|><|EndOfText|>c", "İ ǅ ß", "a\x1cb\x0bc\x0cd\r\ne", "日本語。 テ", "😀😀 😀", "x" * 500 + " y", "foo. Bar, (baz)*** 'LL", "×÷ À×à ÿÞþ ªº", "a\n \n  b   ", "\x00a \x7f", "ab c\n\n" * 300 + "é" * 700 + " x" * 200, " " * 900 + "x"]
    return some + ["".join(r.choice("ab'’ \n\t.,s1é́ΣA<|>\r#*") for _ in range(r.randint(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(file, monkeypatch):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path(file)), encoding.Encoder(public_tokenizers.path(file))
    want = [x.ids for x in t.encode_batch(hard_texts(), add_special_tokens=False)]
    for part, cache in ((1 << 20, 600_000), (300, 60)):
        monkeypatch.setattr(encoding, "PART", part)
        monkeypatch.setattr(encoding, "CACHE", cache)
        assert e.joined and [np.frombuffer(x, "<u2").tolist() for x in e.encode(hard_texts())] == want
    assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(pa.array([None, *hard_texts()])[7:])] == want[6:]
    t.encode_special_tokens = True
    text = encoding.Encoder(public_tokenizers.path(file), special_as_text=True)
    assert [np.frombuffer(x, "<u2").tolist() for x in text.encode(hard_texts())] == [x.ids for x in t.encode_batch(hard_texts(), add_special_tokens=False)]


def ids_of(file, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(file))
    return [(i, np.array([*t.encode(x, add_special_tokens=False).ids, end], "<u4")) for i, x in texts()]


def test_crc32c():
    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c = _step(c ^ x)
        return c ^ 0xFFFFFFFF

    items = [b"123456789", b"", b"a", *(random.Random(i).randbytes(n) for i, n in enumerate((7, 8, 9, 4095, 4096, 4097, 13_000)))]
    size = np.array([len(x) for x in items])
    got = crc.crc32c(np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size)
    assert got[0] == 0xE3069283 and got.tolist() == [slow(x) for x in items]


def _step(c):
    for _ in range(8):
        c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    return c


def test_records_round_trip(docs, spark, none):
    uri, path = shared.folder(spark, "records-test"), public_tokenizers.path("byte_bpe_50k.json")
    manifest = records.write(docs, uri, path, rows_per_shard=20)
    got = sorted((tuple(r) for r in records.digests(spark, manifest, uri).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in texts()), key=lambda i: (i is not None, i or 0))
    want = Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids_of("byte_bpe_50k.json", 0))
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    name = manifest.orderBy("shard").first().shard
    one = list(records.read_shard(uri, name))
    i, x = records.read_one(uri, name, 3)
    assert i == one[3][0] and x.tolist() == one[3][1].tolist()
    with pytest.raises(ValueError):
        records.unframe(b"".join(records.frame([b"abc"])).replace(b"abc", b"abd"), [0])
    assert records.op5_records(none, path).count() == 0


def test_first_fit_decreasing_equals_a_plain_search():
    for seed in range(60):
        r = random.Random(seed)
        sizes, bins = [r.choice([r.randint(1, 64), 33, 20]) for _ in range(r.randint(0, 70))], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            at = next((b for b in bins if sum(sizes[x] for x in b) + sizes[i] <= 64), None)
            if at is None:
                bins.append(at := [])
            at.append(i)
        assert packing.first_fit_decreasing(sizes, 64) == bins


def test_rows_alike_are_spread_over_groups(spark):
    same = spark.createDataFrame([(None, "one and the same")] * 400, "doc_id long, text string").repartition(2)
    got = packing.packed(same, public_tokenizers.path("word_bpe_49k.json"), per_group=50).collect()
    groups = Counter(r.sequence_id >> 32 for r in got)
    assert sum(r.length for r in got) == 400 * got[0].doc_tokens and len(groups) == 8 and max(groups.values()) < 150


def test_packing_loses_nothing(docs, none):
    for seed in range(80):
        r = random.Random(seed)
        cap = r.choice([16, 64, 4096])
        sizes = [r.randint(1, cap - 1) for _ in range(r.randint(0, 60))] if seed % 3 else [cap // 2 + 1] * r.randint(1, 40)
        bins, parts = packing.pack(sizes, cap), defaultdict(list)
        fill = [sum(x[2] for x in b) for b in bins]
        assert max(fill, default=0) <= cap and sum(cap - f for f in fill if f & (f - 1)) <= cap / 32 * max(1, len(bins))
        for b in bins:
            for i, a, n in b:
                parts[i].append((a, n))
        for i, n in enumerate(sizes):
            assert sum(x for _, x in parts[i]) == n and all(a + x == b for (a, x), (b, _) in zip(sorted(parts[i]), sorted(parts[i])[1:]))
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(docs, path, per_group=25).collect()
    ids = defaultdict(list)
    for i, x in ids_of("word_bpe_49k.json", 2):
        ids[i].append(x)
    assert sum(r.length for r in got) == sum(len(x) for v in ids.values() for x in v)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 4096 and [a for a, _ in sorted(s)] == np.cumsum([0, *(n for _, n in sorted(s))])[:-1].tolist() for s in seq.values())
    assert packing.op6_packing(none, path).count() == 0


def test_packing_yields_whole_sequences(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = defaultdict(list)
    for i, x in ids_of("word_bpe_49k.json", 2):
        ids[i].append(x)
    seq = {r.sequence_id: r for r in packing.sequences(docs, path, per_group=25).collect()}
    full, held = 0, Counter()
    for r in seq.values():
        x = np.frombuffer(r.ids, "<u4")
        assert len(x) == sum(p.length for p in r.pieces) <= packing.CAPACITY
        full += len(x) == packing.CAPACITY and len(r.pieces) == 1
        for p in r.pieces:
            assert any(len(y) == p.doc_tokens and (y[p.start : p.start + p.length] == x[p.offset : p.offset + p.length]).all() for y in ids[p.doc_id])
            held[p.doc_id] += p.length
    assert full > 1 and held == {i: sum(map(len, v)) for i, v in ids.items()}
    for r in packing.packed(docs, path, per_group=25, tokens=True).collect():
        own = seq[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)]
        assert bytes(r.ids) == own and r.ids_crc32 == zlib.crc32(own)


# --- 7 ------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and rest * weight[s] / heavy > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in full else rest * weight[s] / heavy for s in names}
        full |= more


def test_targets_and_mix(docs, none, spark):
    for seed in range(6):
        r = random.Random(seed)
        sizes = {(None if i == 3 else f"s{i}"): r.choice([0, 1, 10, 500, 10_000]) for i in range(r.randint(1, 12))}
        got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        if sum(sizes.values()):
            want = plain_targets(sizes)
            assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
    got = [tuple(r) for r in mixing.op7_mixing(docs, 16).collect()]
    assert sorted(got, key=key) == sorted((tuple(r) for r in mixing.op7_mixing(docs.repartition(5), 16).collect()), key=key)
    assert Counter((r[0], r[1]) for r in got) == Counter((i, len(ascii_words(t))) for i, t in texts())
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    by = {}
    for i, size, full, target, taken in got:
        by[full, target] = by.get((full, target), 0) + taken
    assert all(abs(t - target) <= 64 + 0.1 * target for (_, target), t in by.items())
    mix = mixing.mixed(docs, 16)
    assert mix.columns == docs.columns
    assert sum(len(ascii_words(r.text)) for r in mix.collect()) == sum(r[4] for r in got)
    assert mixing.op7_mixing(none).count() == 0 and mixing.mixed(none).count() == 0


def test_only_tables_by_source_of_a_mix_go_through_the_driver(docs, monkeypatch):
    # Spark takes documents' parts and cells for no longer than what they are exploded from, and so would broadcast far more than its limit
    want, plans = Counter(map(repr, mixing.op7_mixing(docs, 16).collect())), []
    noted = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or shared.cut(df)
    monkeypatch.setattr(mixing, "cut", noted)
    monkeypatch.setattr(mixing, "HEADS", 0, raising=False)  # as if there were more sources than are broadcast
    made = [f(docs) for f in (lambda d: mixing.op7_mixing(d, 16), mixing.mixed, mixing.sharded)]
    plans += [m._jdf.queryExecution().executedPlan().toString() for m in made]
    assert sum(p.count("SortMergeJoin") for p in plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)
    assert max(p.count("Exchange") for p in plans) < 40, [p.count("Exchange") for p in plans]  # the driver plans the rest anew after each
    assert Counter(map(repr, made[0].collect())) == want


def chained(*values):
    """Spark's xxhash64 of values: longs, ints as (n,), strings; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), h)
    return h


def plain_image(x, n, seed):
    key = chained(seed, (20,))
    bits = max(1, (n - 1).bit_length())
    mask, half = (1 << bits) - 1, max(1, bits // 2)
    while True:
        for k in range(3):
            x = ((x * (key >> 20 * k & 1048575 | 1)) & mask) ^ (key >> 7 + 11 * k & mask)
            x ^= x >> half
        if x < n:
            return x


def plain_taken(docs, block):
    """(doc_id, size, taken) of each document, by loops over slots and words."""
    rows_ = [(i, s, len(ascii_words(t)), signed(chained(i, s, t))) for i, s, t in docs]
    sizes = Counter()
    for _, s, n, _ in rows_:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, quota, blocks = plain_targets(sizes), {}, {}
    for s in names:
        blocks[s] = -(-sizes[s] // block)
        quota[s] = min(math.floor(target[s] / sizes[s] * blocks[s] + 0.5), 3 * blocks[s]) if sizes[s] else 0
    total = sum(quota.values())
    slots = {s: [] for s in names}
    for i in range(total):
        r = signed(chained(i, (20,))) % total
        for s in names:
            if r < quota[s]:
                slots[s].append(i)
                break
            r -= quota[s]
    chunks, taken = -(-len(rows_) // 512), Counter()
    for sid, s in enumerate(names, 1):
        uses = Counter()
        for j in range(quota[s]):  # more draws go elsewhere, fewer are made up for
            uses[plain_image(j % blocks[s], blocks[s], signed(chained((sid,), j // blocks[s])))] += 1
        stream = [x for x in sorted((x for x in rows_ if x[1] == s), key=lambda x: (x[3] % chunks, x[3], x[0] is not None, x[0] or 0)) for _ in range(x[2])]
        for k, x in enumerate(stream):
            taken[x] += uses[k // block]
    out = Counter()
    for x in set(rows_):
        out[x[0], x[2], taken[x]] += 1
    return out, {s: len(v) for s, v in slots.items()}, quota


def test_mix_equals_a_plain_one(spark):
    docs_ = [(i, None if i % 7 == 0 else f"s{i % 4}", prose(i, 3 + 5 * i % 70)) for i in range(90)] + [(None, "s1", "no id"), (200, "s9", ""), (201, "s2", None)]
    df = spark.createDataFrame(docs_, "doc_id long, source string, text string")
    want, drawn, quota = plain_taken([(i, s, t or "") for i, s, t in docs_], 16)
    assert Counter((r.doc_id, r["size"], r.taken) for r in mixing.op7_mixing(df, 16).collect()) == want
    assert drawn != quota and sum(drawn.values()) == sum(quota.values())
    mix = mixing.sharded(df, 16, 8).collect()
    assert sorted(r.slot for r in mix) == list(range(sum(quota.values()))) and all(r.shard == r.slot // 8 for r in mix)
    of = Counter(r.sid for r in mix)
    names = sorted(quota, key=lambda s: (s is None, s or ""))
    assert {s: of[k] for k, s in enumerate(names, 1)} == quota
    assert sum(len(ascii_words(r.text)) for r in mix) == sum(n * k for (_, _, n), k in want.items())
    told = Counter(w for (i, s, t) in docs_ for w in ascii_words(t or ""))
    assert {w for r in mix for w in ascii_words(r.text)} <= set(told)
    assert mixing.sharded(df.limit(0)).count() == 0


def test_permutation(spark):
    x = spark.createDataFrame([(n, s) for n in (1, 2, 3, 7, 8, 100, 1000) for s in (1, 2)], "n long, seed long").withColumn("x", F.explode(F.expr("sequence(0L, n - 1)")))
    got = defaultdict(list)
    for r in mixing.permuted(x).collect():
        got[r.n, r.seed].append(r.block)
    assert all(sorted(v) == list(range(n)) for (n, _), v in got.items()) and got[1000, 1] != got[1000, 2]


# --- 8 ------------------------------------------------------------------------------


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def signed(x):
    return x - 2**64 if x >> 63 else x


def plain_sketch(t):
    w = [xxhash.xxh64_intdigest(x, 42) for x in re.split(r"[\x20\x09-\x0D]+", t.lower().strip(" \t\n\x0b\f\r")) if x]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        out.add(signed(h))
    return sorted(out)[:256]


def hexed(s):
    return "".join(f"{x % 2**64:016x}" for x in s)


def plain_likeness(a, b):
    if not (a and b):
        return float(not a and not b)
    both = sorted({*a, *b})[:256]
    return len([x for x in both if x in a and x in b]) / len(both)


def test_sketches(docs, none, spark):
    other = [(5, f"five {i}") for i in range(40)] + [(None, f"none {i % 30} here") for i in range(60)] + [(-(2**63), "least"), (2**63 - 1, "greatest of all"), (2**62, "")]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(other, "doc_id long, text string"))
    have = sorted(texts() + other, key=lambda x: (x[0] is None, -(x[0] or 0), xxhash.xxh64_intdigest(x[1], 42) >> 2, x[1]))
    want = Counter()
    for k, (i, t) in enumerate(have):
        after, cut = have[(k + 1) % len(have)][1], len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)] += 1
        for near, x, y in ((plain_likeness(a, b), t, edited), (plain_likeness(a, c), t, after)):
            a_, b_ = shingles(x), shingles(y)
            assert abs(near - (len(a_ & b_) / len(a_ | b_) if a_ | b_ else 1.0)) < 0.15
    for per in (1, 7, 4096):
        got = sketch.op8_sketch(df, rows_per_bucket=per)
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got.collect()) == want
    buckets = sketch.with_next(df, 7)
    assert buckets.where("not ghost").groupBy("bucket").count().agg(F.max("count")).first()[0] < 20
    assert {tuple(r) for r in sketch.with_next(df, 7, heads=0).collect()} == {tuple(r) for r in buckets.collect()}
    assert sketch.op8_sketch(none).count() == 0
    assert sketch.op8_sketch(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first().edited_sha256 == hashlib.sha256(b"a b a").hexdigest()


def test_sketches_merge(spark):
    a, b = prose(1, 900), prose(2, 900)
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, "")], "g int, t string").withColumn("s", sketch.sketch(F.col("t")))
    merged = {r.g: r.s for r in sketch.merge_all(df, ["g"], "s").collect()}
    each = [r.s for r in df.collect()]
    assert merged[1] == sorted(set(each[0]) | set(each[1]))[: sketch.K] and merged[2] == each[0] and 3 not in merged
    one = spark.createDataFrame([(a, a + " " + b)], "x string, y string").select(sketch.sketch(F.col("x")).alias("x"), sketch.sketch(F.col("y")).alias("y"))
    r = one.select(sketch.containment(F.col("x"), F.col("y")).alias("c"), sketch.distinct(F.col("y")).alias("n")).first()
    assert r.c > 0.85 and abs(r.n - len(shingles(a + " " + b))) < 0.2 * r.n


# --- 9 and 10 ---------------------------------------------------------------------------


def test_pairwise_tells_labels_apart(spark, docs, none):
    r = random.Random(2)
    bad = lambda s: " ".join(w + r.choice(["***", "%%%", "###"]) for w in prose(s, 50).split())
    made = [(i, prose(1000 + i, 40 + i % 50), 1) if i % 3 else (i, bad(1000 + i) if i % 2 else "again " * (30 + i % 40), 0) for i in range(300)]
    d = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made] + [(1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    want = {i: q for i, _, q in made}
    got = pairwise.op9_pairwise(d, labels).collect()
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {i for i in want if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([x.predicted == want[x.doc_id] for x in held]) > 0.95 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    model = pairwise.train(d, labels)
    assert {x.doc_id for x in pairwise.accepted(d, model).collect()} == {x.doc_id for x in pairwise.scores(d, model).collect() if x.score >= 0.5}
    assert {x.predicted for x in pairwise.op9_pairwise(docs, labels.limit(0)).collect()} == {1}
    assert pairwise.op9_pairwise(docs, labels).count() == docs.count() and pairwise.op9_pairwise(none, labels).count() == 0
    assert pairwise.accepted(docs, model).columns == docs.columns


def test_pairwise_fit_is_the_least_loss():
    r = np.random.default_rng(3)
    x, good = r.normal(size=(160, 4)), r.random(160) < 0.6
    x[good] += [1.0, 0.5, 0, 0]
    m = pairwise.fit(x, good, pairs=6, seed=1)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    up, down = [i for i in range(160) if good[i]], [i for i in range(160) if not good[i]]
    n, rng = 6 * min(len(up), len(down)), np.random.default_rng(1)
    a, b = (rng.permutation([v[k % len(v)] for k in range(n)]) for v in (up, down))

    def loss(w):
        return sum(math.log1p(math.exp(-float((z[i] - z[j]) @ w))) for i, j in zip(a, b)) / n + pairwise.RIDGE / 2 * float(w @ w)

    for k in range(4):
        step = np.eye(4)[k] * 1e-4
        assert abs(loss(m.weights + step) - loss(m.weights - step)) / 2e-4 < 1e-6
    s = m.strength(x)
    right = lambda t: float(np.mean((s >= t) == good))
    assert right(m.threshold) >= max(right(np.quantile(s, q)) for q in np.linspace(0, 1, 1001)) - 1e-12


def test_compression_judges_what_is_left_after_full_chunks():
    import base64

    good = prose(500, 2000)[: compression.CHUNK]
    junk = base64.b64encode(np.random.default_rng(7).bytes(3000)).decode()
    for tail in (3990, 3600):
        _, _, ratio, _, parts = compression.measures(pa.array([good + junk[:tail]]))
        assert ratio[0] > 1.5 and parts[0][0] > 1.5 > parts[0][1]
    sizes = textstats.packed_sizes(pa.array([good, good + "a", good * 2, good[:-1]]), chunk=compression.CHUNK)[1]
    assert [len(x) for x in sizes] == [1, 2, 2, 0]


def plain_bands(every):
    """kept by the bands, ratio and share of chunks outside of each text, one at a time."""
    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b))

    def expected(n):
        x, at = math.log2(n), [(math.log2(a), math.log2(b)) for a, b in compression.EXPECTED]
        for (a, y), (b, z) in zip(at, at[1:]):
            if x <= b:
                return y if x <= a else y + (z - y) * (x - a) / (b - a)
        return at[-1][1]

    facts = {}
    for text in set(every):
        b = text.encode()
        cuts = [b[k : k + 4096] for k in range(0, len(b) - 4095, 4096)]
        cuts += [b[-4096:]] if cuts and len(b) % 4096 else []
        ratio = len(b) / size(b) if b else 0.0
        facts[text] = (len(b), math.floor(4 * math.log2(max(1, len(b)))), ratio, math.log2(ratio) - expected(len(b)) if b else 0.0, [4096 / size(c) for c in cuts])

    def fences(values):
        v = sorted(math.floor(x * 256) for x in values)
        q1, q3 = ((v[math.ceil(share * len(v)) - 1] + 0.5) / 256 for share in (0.25, 0.75))
        return q1 - 2.5 * max(0.04, q3 - q1), q3 + 2.5 * max(0.04, q3 - q1)

    def around(of):
        reach = 2
        while True:
            near = [f for f in facts.values() if f[0] and abs(f[1] - of) <= reach]
            if len(near) >= 200 or len(near) == sum(f[0] > 0 for f in facts.values()):
                return fences(f[3] for f in near)
            reach += 1

    chunks = [math.log2(c) for f in facts.values() for c in f[4]]
    low, high = (2.0**x for x in fences(chunks)) if chunks else (0, 99)
    low, high = max(low, 1.5), min(high, 3.8)
    out = []
    for text in every:
        n, of, ratio, excess, parts = facts[text]
        outside = sum(not low <= c <= high for c in parts) / len(parts) if parts else 0.0
        fixed = [b for b in compression.BANDS if n >= b[0]][-1]
        a, z = around(of) if n else (0, 0)
        out.append(((n == 0 or (a <= excess <= z and fixed[1] <= ratio <= fixed[2])) and outside <= 0.2, round(ratio, 9), round(outside, 9)))
    return out


def test_compression_counts_and_bands(docs, spark, none):
    r = random.Random(4)
    long = prose(305, 6000)
    odd = [(300, "again and again it says so. " * 60), (301, "".join(chr(r.randint(33, 126)) for _ in range(6000))), (302, prose(302, 400)), (303, prose(303, 60)), (304, " ".join(r.choice(["understood", "remembered", "throughout", "everything", "government", "particular", "themselves", "television"]) for _ in range(300)))]
    odd += [(305, long), (306, long[:12000] + " ".join(r.choice(["red", "blue", "green"]) for _ in range(4000))), (307, "ok"), (308, "x" * 40), (309, " ".join("".join(chr(r.randint(48, 122)) for _ in range(9)) for _ in range(300)))]
    odd += [(400 + i, prose(400 + i, 20 + 9 * i)) for i in range(150)] + [(600 + i, odd[4][1]) for i in range(90)]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string"))
    got = compression.op10_compression(df).collect()
    want, every = Counter(), texts() + odd
    for (i, t), (kept, ratio, out) in zip(every, plain_bands([t for _, t in every])):
        w = ascii_words(t)
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n, covered, seen, dup = Counter(win), set(), set(), 0
        for k, x in enumerate(win):
            if n[x] > 1:
                covered.update(range(k, k + 5))
        for x in t.split("\n"):
            if ascii_words(x):
                dup += x in seen
                seen.add(x)
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered), failed, kept and not failed, ratio, out] += 1
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept, round(x.ratio, 9), round(x.chunks_out, 9)) for x in got) == want
    by = {x.doc_id: x for x in got}
    assert not any(by[i].kept for i in (300, 301, 304, 306, 309)) and by[302].kept and by[303].kept and by[305].kept and not any(x.kept and x.base_failed for x in got)
    assert not any(by[i].base_failed for i in (304, 309))  # the bands alone reject these
    assert compression.op10_compression(none).count() == 0
    assert list(textstats.slices(iter([]))) == []


# --- columns of any name ----------------------------------------------------------------


def test_columns_of_any_name_pass_through(docs, none):
    names = ["__n", "__spans", "a.b", "row", "h", "id", "__id", "spans", "n", "none", "x`y", "k", "parts", "m", "t", "c0"]
    wide, empty = (d.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names]) for d in (docs, none))
    model = pairwise.Model(np.zeros(len(pairwise.FEATURES)), np.ones(len(pairwise.FEATURES)), np.ones(len(pairwise.FEATURES)), 0.0)
    for run in (simhash.one_of_each, lines.deduplicate, lambda d: mixing.mixed(d, 16), lambda d: pairwise.accepted(d, model), lambda d: lines.deduplicate(d, spans="spans")):
        plain, got = run(docs), run(wide)
        assert [c for c in got.columns if c != "spans"] == [c for c in wide.columns if c != "spans"]
        rows_ = got.collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows_) == Counter((r["doc_id"], r["text"]) for r in plain.collect()) and len(rows_)
        assert all(r["a.b"] == (None if r["doc_id"] is None else f"a.b{r['doc_id']}") for r in rows_)
        assert run(empty).count() == 0
    for op in (simhash.op2_simhash, mixing.op7_mixing, sketch.op8_sketch, compression.op10_compression, lines.op4_lines):
        assert op(wide.repartition(2)).count() == len(rows()) and op(empty).count() == 0


def test_running_sums(spark):
    r = random.Random(6)
    at = [(g, k, r.randint(0, 9)) for g in (1, 2) for k in r.sample(range(5000), 900)]
    got = {(x.g, x.k): x.s for x in shared.running(spark.createDataFrame(at, "g int, k long, v long"), ["g"], "k", "v", "s", 64).collect()}
    assert got == {(g, k): sum(v for a, b, v in at if a == g and b < k) for g, k, _ in at}
