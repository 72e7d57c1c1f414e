"""Every corpus operator against brute force, a round trip or held-out accuracy, with nulls, empty and long texts,
ties, repeated rows, empty tables and columns whose names clash."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weirflow.llm import audio, jaccard, langid, mixing, packing, quality, suffix, tokenids, topk, toxicity
from weirflow.llm.ftrl import Ftrl, temperature
from weirflow.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASH = "doc_id long, text string, h string, bucket string, score string, size int, unit string, slot string, key string"


def docs(spark, rows, extra=True):
    """(id, text) rows with further columns named like those that operators make."""
    if extra:
        return spark.createDataFrame([(i, t, "x", "y", "z", 1, "u", "s", "k") for i, t in rows], CLASH)
    return spark.createDataFrame(rows, "doc_id long, text string")


def words(n, seed, vocab=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}" for _ in range(n)]


def corpus(seed=1):
    r = random.Random(seed)
    rows = [(None, "null id text that is long enough to be seen"), (900, None), (901, ""), (902, "!!! ..."), (903, "one"), (904, "one"), (905, "one two"), (906, "One, TWO"), (907, "one two three")]
    for i in range(12):
        base = words(80 + 30 * (i % 4), i)
        rows.append((i * 10, " ".join(base)))
        for c in range(1, 4):
            w = list(base)
            for k in r.sample(range(len(w)), c * len(w) // 40):
                w[k] = f"edit{r.random()}"
            rows.append((i * 10 + c, " ".join(w)))
        rows.append((i * 10 + 5, ". ".join(base).upper()))
    shared = words(70, 77)
    for i in range(8):
        rows.append((500 + i, " ".join(words(40, 300 + i) + shared[: 40 + 5 * i] + words(30, 400 + i))))
    rows.append((700, " ".join(words(20_000, 5))))
    rows.append((700, rows[-1][1]))
    rows.append((701, "ab " * 3000))
    r.shuffle(rows)
    return rows


# --- 1 ----------------------------------------------------------------------


def gram_set(t):
    w = WORD.findall(t.lower())
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute_links(rows):
    """Links between distinct (id, text) documents."""
    given = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = {d: gram_set(d[1]) for d in given}
    out = {d: set() for d in given}
    for a, b in itertools.combinations(given, 2):
        k = len(sets[a] & sets[b])
        if k and 5 * k >= 3 * len(sets[a] | sets[b]):
            out[a].add(b)
            out[b].add(a)
    return out


def brute_classes(rows):
    """{(id, text): all documents connected with it}."""
    links, out = brute_links(rows), {}
    for d in links:
        if d not in out:
            seen, todo = {d}, [d]
            while todo:
                new = links[todo.pop()] - seen
                seen |= new
                todo += new
            out.update(dict.fromkeys(seen, seen))
    return out


def brute_join(rows):
    links, classes = brute_links(rows), brute_classes(rows)
    return sorted((d[0], min(x[0] for x in classes[d]), len(links[d])) for d in links)


def joined(df):
    return sorted((r.doc_id, r.class_id, r.links) for r in jaccard.join(df).collect())


def corpus_of_copies(seed=1):
    """Further rows: two texts under one id, copies of one text, repeated rows of a near copy."""
    rows = corpus(seed)
    text = words(90, 1234)
    rows += [(2000 + i, " ".join(text)) for i in range(30)] + [(2100 + i % 3, " ".join([*text[:40], f"x{i % 3}", *text[40:]])) for i in range(12)]
    return rows + [(2200, " ".join(text)), (2200, " ".join(words(50, 4321))), (2200, " ".join(words(50, 4321)) + " z")]


def test_jaccard_join_loses_no_link(spark):
    rows = corpus_of_copies()
    got = joined(docs(spark, rows))
    assert got == brute_join(rows) and sum(r[2] > 0 for r in got) > 60


def test_jaccard_order_places_and_buckets_change_nothing(spark, monkeypatch):
    rows = corpus_of_copies(2)
    for name, x in (("frequent", lambda d: ((np.zeros(0, np.uint64), np.zeros(0, np.uint64)), 10_000)), ("BLOCK_PAIRS", 3), ("HELD", 50), ("SHARE", 1000)):
        monkeypatch.setattr(jaccard, name, x)
    assert joined(docs(spark, rows)) == brute_join(rows)


def test_jaccard_of_nothing(spark):
    d = docs(spark, [])
    assert joined(d) == [] and jaccard.distinct(d).count() == 0
    assert joined(docs(spark, [(1, None), (2, ""), (3, "!"), (None, "a b c")])) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]


def test_distinct_keeps_one_document_of_each_class(spark):
    rows = corpus_of_copies()
    d = docs(spark, rows)
    got = jaccard.distinct(d)
    assert got.columns == d.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    for c in {frozenset(c) for x, c in brute_classes(rows).items() if gram_set(x[1])}:
        kept = [x for x in left if x in c]
        assert len(kept) == 1 and kept[0][0] == min(c)[0]
    odd = lambda x: x[0] is None or not gram_set(x[1] or "")
    assert sorted(map(str, filter(odd, left))) == sorted(map(str, filter(odd, rows)))


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "u long, v long")
    got = {r.v: r.root for r in jaccard.components(e).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_bitmap_filter_never_drops_a_match():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 2000):
        for _ in range(30):
            x = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            k = rng.integers(0, n + 1)
            y = np.concatenate([x[:k], rng.integers(0, 1 << 62, rng.integers(0, n + 1), dtype=np.uint64)])
            if not len(y):
                continue
            same = len(np.intersect1d(x, y))
            key = np.concatenate([x, y])
            b = jaccard.bitmaps(key, np.array([0, len(x), len(key)]))
            on = jaccard.may_match(np.array([len(x), len(y)]), b, np.array([0, 1]), np.array([1, 0]), 8)
            assert on[0] == on[1] and (on[0] or 5 * same < 3 * (len(x) + len(y) - same))
            bits = [np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little") for m in b]
            short = min(map(len, bits))
            differ = np.count_nonzero(np.bitwise_xor.reduce(bits[0].reshape(-1, short)) ^ np.bitwise_xor.reduce(bits[1].reshape(-1, short)))
            need = -(-3 * (len(x) + len(y)) // 8)
            assert on[0] == (min(len(x), len(y)) >= need and differ <= len(x) + len(y) - 2 * need)


# --- 2 ----------------------------------------------------------------------


def test_token_ids_round_trip(spark, tmp_path):
    rows = corpus() + [(-5, "Zoë ☃ <|endoftext|>")]
    out = str(tmp_path / "ids")
    got = tokenids.write(docs(spark, rows), out).collect()
    enc = tokenids.encoder()
    texts = {i: t or "" for i, t in rows if i is not None}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for b in {r.bucket for r in got}:
        own = sorted(r.slot for r in got if r.bucket == b)
        assert own == list(range(len(own)))  # minimal and perfect
    reader = tokenids.Reader(out)
    for i, t in texts.items():
        assert enc.decode(reader.get(i).tolist()) == t
    assert reader.get(123456789) is None


def test_perfect_hash_of_many_keys_and_refusal_of_others():
    keys = np.random.default_rng(1).choice(1 << 40, 50_000, replace=False)
    h = tokenids.PerfectHash.build(keys)
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    fp = np.zeros(len(keys), np.uint32)
    fp[h.slots(keys)] = tokenids.fingerprint(keys)
    other = np.arange(1 << 41, (1 << 41) + 20_000)
    s = h.slots(other)
    assert np.count_nonzero((s >= 0) & (fp[s] == tokenids.fingerprint(other))) == 0


def test_token_ids_of_long_texts(spark, tmp_path, monkeypatch):
    """No text is too long, and one that is cut where words end has the ids that it has in one piece."""
    enc = tokenids.encoder()
    rows = [(1, " " * 2_000_000), (2, "a" * 300_000), (3, "word " * 100_000), (4, ("x" * 70_000 + "\n") * 4), (5, "first"), (5, "second text")]
    tokenids.write(docs(spark, rows).coalesce(1), str(tmp_path / "ids")).collect()
    reader = tokenids.Reader(str(tmp_path / "ids"))
    for i, t in rows[:4]:
        assert enc.decode(reader.get(i).tolist()) == t
    assert enc.decode(reader.get(5).tolist()) == "first"  # of the least offset
    monkeypatch.setattr(tokenids, "STRETCH", 40)
    monkeypatch.setattr(tokenids, "LONG", 200)
    r = random.Random(4)
    text = "".join(r.choice(["word", "It's", " ", "  ", "\n", "\n\n", "12", "é", "!?", "\t ", "\u00a0", "\x1c", "<|x|>"]) for _ in range(4000))
    assert len(list(tokenids.stretches(text))) > 50 and "".join(tokenids.stretches(text)) == text
    assert tokenids.encoded(enc, text).tolist() == enc.encode(text, disallowed_special=())


def test_token_ids_refuse_a_large_vocabulary(tmp_path):
    import base64

    (tmp_path / "v").write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i if i else 65536}\n" for i in range(256)))
    with pytest.raises(ValueError, match="16 bits"):
        tokenids.encoder(str(tmp_path / "v"))


def test_token_ids_of_nothing(spark, tmp_path):
    assert tokenids.write(docs(spark, []), str(tmp_path / "x")).count() == 0
    assert tokenids.Reader(str(tmp_path / "x")).get(1) is None


# --- 3 ----------------------------------------------------------------------


def brute_top(rows, k):
    v = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e):
            v[i] = min(v.get(i, e), e)
    ids = np.array(sorted(v))
    m = np.array([v[i] for i in ids], np.float32).astype(float) if len(ids) else np.zeros((0, 1))
    out = {}
    for a, i in enumerate(ids):
        d = np.sqrt(((m - m[a]) ** 2).sum(1))
        best = [(round(float(d[b]), 6), int(ids[b])) for b in np.lexsort((ids, d)) if b != a][:k]
        out.update({(int(i), r + 1): (n, x) for r, (x, n) in enumerate(best)})
    return out


@pytest.mark.parametrize("block, group, asked", [(16, 8, "true"), (16, 4096, "vec_id % 3 = 0"), (4096, 4096, None)])
def test_top_k_is_exact(spark, monkeypatch, block, group, asked):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "AT_ONCE", 5)
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 4, (6, 20))
    rows = [(int(i), [float(x) for x in centre[i % 6] + rng.normal(0, 1, 20)]) for i in range(150)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (5, rows[5][1]), (None, rows[1][1]), (300, None), (301, []), (302, [float("nan")] * 20), (303, [None] * 20)]
    df = spark.createDataFrame([(i, e, "x", 1.0) for i, e in rows], "vec_id long, embedding array<float>, block string, most double")
    got = {(r.vec_id, r.rank): (r.neighbor_id, r.distance) for r in topk.top_k(df, 7, asked and F.expr(asked)).collect()}
    step = {"true": 1, None: topk.EVERY}.get(asked, 3)
    want = {key: x for key, x in brute_top([(i, e) for i, e in rows], 7).items() if key[0] % step == 0}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in got)


def test_top_k_of_few_and_none(spark):
    s = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], s)).count() == 0
    few = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], s)
    got = topk.top_k(few, queries=F.lit(True)).collect()
    assert sorted((r.vec_id, r.neighbor_id, r.distance) for r in got) == [(1, 2, 5.0), (2, 1, 5.0)]
    assert topk.top_k(few).count() == 0


def test_top_k_refuses_vectors_of_different_lengths(spark):
    rows = [(i, [float(i)] * 4) for i in range(6)] + [(6, [1.0, 2.0]), (7, [1.0] * 6)]
    with pytest.raises(Exception, match="different lengths"):
        topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3, F.lit(True)).collect()


def test_top_k_keeps_double_precision(spark):
    rows = [(i, [1e8 + i / 4, 0.0]) for i in range(20)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, F.lit(True)).collect()
    assert {(r.vec_id, r.rank): r.distance for r in got}[10, 1] == 0.25


# --- 4 ----------------------------------------------------------------------


def brute_spans(rows):
    ws = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    from collections import defaultdict

    at = defaultdict(list)
    for n, (i, t) in enumerate(ws):
        w = WORD.findall(t.lower())
        for p in range(len(w) - 49):
            at[tuple(w[p : p + 50])].append((i, n, p))
    state = defaultdict(dict)
    for occ in at.values():
        if len(occ) > 1:
            for k, (i, n, p) in enumerate(sorted(occ)):
                for x in range(p, p + 50):
                    state[n][x] = state[n].get(x, False) or k > 0
    out = []
    for n, s in state.items():
        xs = sorted(s)
        start = xs[0]
        for a, b in zip(xs, xs[1:] + [None]):
            if b != a + 1 or s[b] != s[a]:
                out.append((ws[n][0], start, a + 1, s[a]))
                start = b
    return sorted(out)


def test_repeated_passages_are_exact(spark):
    rows = corpus()
    r = random.Random(9)
    text = words(400, 88, 60)
    for i in range(40):  # overlapping cuts of one text, so that windows share anchors with other surroundings
        a = r.randrange(0, 300)
        rows.append((2000 + i, " ".join(words(r.randrange(30), 900 + i) + text[a : a + r.randrange(20, 100)] + words(5, 950 + i))))
    rows.append((3000, " ".join(text[:60] + ["x"] + text[:60])))
    got = sorted((x.doc_id, x.start_word, x.end_word, x.removed) for x in suffix.spans(docs(spark, rows)).collect())
    assert got == brute_spans(rows) and sum(x[3] for x in got) > 20


def test_repeated_passages_however_they_are_spread(spark, monkeypatch):
    """One passage in many documents, whole copies, repeated rows in several tasks; small batches, buckets and chunks."""
    p = words(70, 31)
    rows = [(i, " ".join(words(30, 7000 + i) + p[i % 3 : 60 + i % 7] + words(20, 8000 + i))) for i in range(60)]
    rows += [(100 + i, " ".join(words(20, 1) + p + words(20, 2))) for i in range(30)] + [(130, rows[-1][1])] * 6 + [(100, " ".join(words(120, 5)))] * 2 + [(101, " ".join(p))]
    for name, x in (("HELD", 20), ("SHARE", 1000), ("CHUNK", 2)):
        monkeypatch.setattr(suffix, name, x)
    got = sorted((x.doc_id, x.start_word, x.end_word, x.removed) for x in suffix.spans(docs(spark, rows).repartition(5)).collect())
    assert got == brute_spans(rows) and sum(x[3] for x in got) > 80


def test_repeated_passages_of_nothing(spark):
    assert suffix.spans(docs(spark, [])).count() == 0 and suffix.removed(docs(spark, [])).count() == 0
    assert suffix.spans(docs(spark, [(1, None), (None, " ".join(words(60, 1))), (2, "")])).count() == 0


def test_deep_shallow_sort_groups_equal_windows():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 3, 4000).astype(np.uint32)
    for _ in range(12):  # long repeats among a few words
        a, b, n = rng.integers(0, 3800), rng.integers(0, 3800), rng.integers(40, 150)
        code[b : b + n] = code[a : a + n][: len(code[b : b + n])]
    at = rng.permutation(3900)[:2500]
    g = suffix.equal_windows(code, at, np.zeros(len(at), np.int64))
    seen = {}
    for k, s in enumerate(at):
        seen.setdefault(code[s : s + 50].tobytes(), []).append(k)
    want = {tuple(v) for v in seen.values()}
    got = {}
    for k, x in enumerate(g):
        got.setdefault(x, []).append(k)
    assert {tuple(v) for v in got.values()} == want and max(map(len, want)) > 2


def test_blind_trie_orders_suffixes():
    rng = np.random.default_rng(6)
    code = rng.integers(0, 2, 600).astype(np.uint32)
    t = suffix.BlindTrie(code)
    for s in rng.permutation(500).tolist():
        t.insert(s)
    order = [s for g in t.groups() for s in g[:1]]
    keys = [tuple(code[s : s + 50]) for s in order]
    assert keys == sorted(set(map(tuple, (code[s : s + 50] for s in range(500)))))


def test_removed_cuts_what_came_before(spark):
    p = words(60, 1)
    a = " ".join(["Alpha!", *words(5, 2), *p, "Omega."])
    b = " ".join(["Béta,", *words(5, 3), *(w.upper() for w in p), "end;"])
    rows = [(1, a), (2, b), (3, " ".join(p)), (None, a), (4, None), (5, ""), (6, "...")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string")
    got = {r.doc_id: r for r in suffix.removed(d).collect()}
    assert 3 not in got and got[1].text == a and got[None].text == a and got[4].text is None and got[6].text == "..."
    assert WORD.findall(got[2].text) == ["éta", *words(5, 3), "end"] and got[2].n_chars == len(got[2].text) and got[2].h == "c"


# --- 5, 9 --------------------------------------------------------------------


def source_docs(spark, n=300):
    r = random.Random(3)
    rows = [(i, " ".join(words(r.randrange(0, 400), i)), None if i % 50 == 0 else "hot" if i % 2 else f"s{i % 6}", "x") for i in range(n)]
    rows += [(None, "a b", "hot", "x"), (9000, None, "hot", "x"), (9001, " \n ", "hot", "x"), (7, rows[7][1], "hot", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, block string")


def test_blocks_hold_every_token_once(spark):
    rows, df = source_docs(spark)
    parts, per = mixing.pieces(mixing.placed(df), 64)
    got = {}
    for p in sorted(parts.collect(), key=lambda p: (p.source, p.block, p.at)):
        got.setdefault(p.source, []).append(p)
    for s, ps in got.items():
        at = 0
        for p in ps:
            assert p.block * 64 + p.at == at and p.n == sum(len(t.split()) for t in p.texts) and len(p.ids) == len(p.texts)
            at += p.n
        want = sorted(w for i, t, x, _ in rows if i is not None and t and (x or "") == s for w in t.split())
        assert sorted(w for p in ps for t in p.texts for w in t.split()) == want
    assert {r.source: r.tokens for r in per.collect()} == {s: sum(p.n for p in ps) for s, ps in got.items()}


def test_mixture_follows_weights_and_reads_blocks_evenly(spark):
    rows, df = source_docs(spark)
    w = {"hot": 1.0, "s0": 3.0, "s2": 0.0}
    got = mixing.mix_sources(df, w, block=16, shard=256).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    share = sum(r.source == "s0" for r in got) / len(got)
    assert {r.source for r in got} == {"hot", "s0"} and abs(share - 0.75) < 0.03
    for s in ("hot", "s0"):
        n = 1 + max(r.block for r in got if r.source == s)
        uses = {}
        for r in got:
            if r.source == s:
                uses[r.block] = uses.get(r.block, 0) + 1
        full = sum(r.source == s for r in got) // n
        assert all(full <= uses.get(b, 0) <= full + 1 for b in range(n))
    again = mixing.mix_sources(df.repartition(3), w, block=16, shard=256).collect()
    assert {(r.slot, r.source, r.block, r.text) for r in again} == {(r.slot, r.source, r.block, r.text) for r in got}
    assert mixing.mix_sources(df.limit(0)).count() == 0
    out = mixing.mixed_documents(df, block=16)
    assert out.columns == df.columns
    own = {}
    for i, t, *_ in rows:
        own.setdefault(i, []).append(" ".join((t or "").split()))
    out = out.collect()
    assert all(any(" ".join(r.text.split()) in t for t in own[r.doc_id]) for r in out)
    assert sum(len(r.text.split()) for r in out) == sum(r.n_tokens for r in mixing.mix_sources(df, block=16).collect())


def test_mixture_of_nothing(spark):
    d = docs(spark, []).withColumn("source", F.lit("s"))
    assert mixing.mix_sources(d).count() == 0 and mixing.mixed_documents(d).count() == 0


def brute_feistel(x, n, key):
    """One value at a time, in Python's integers."""
    m64 = (1 << 64) - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m64
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m64
        return h ^ h >> 31

    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for k in range(4):
            left, right = right, left ^ mix(right + key + (k + 1) * 0x9E3779B97F4A7C15 & m64) & mask
        x = left << half | right
        if x < n:
            return x


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.feistel(np.arange(n), n, np.full(n, 9, np.uint64))
        assert sorted(got) == list(range(n)) and got.tolist() == [brute_feistel(x, n, 9) for x in range(n)]


def brute_mixture(rows, weights, block, shard, seed):
    """(slot, source, pass, block, tokens) by the definition: blocks source by source, a draw a shard, a loop over slots."""
    tokens = {}
    for i, t, s, *_ in rows:
        if i is not None and t is not None:
            tokens[s or ""] = tokens.get(s or "", 0) + len(t.split())
    tokens = {s: n for s, n in tokens.items() if n}
    n_blocks = {s: -(-n // block) for s, n in tokens.items()}
    names = sorted(s for s in n_blocks if weights.get(s, 0) > 0)
    w = np.array([weights[s] for s in names])
    count, out, before = sum(n_blocks.values()), [], dict.fromkeys(names, 0)
    for k in range(-(-count // shard)):
        size, at = min(shard, count - k * shard), 0
        drawn = np.random.default_rng(mixing.seed_of(seed, k)).multinomial(size, w / w.sum())
        for s, n in zip(names, drawn):
            m = n_blocks[s]
            for r in range(before[s], before[s] + int(n)):
                slot = k * shard + brute_feistel(at, size, mixing.seed_of(seed, "place", k))
                b = brute_feistel(r % m, m, mixing.seed_of(seed, s, r // m))
                out.append((slot, s, r // m, b, min(block, tokens[s] - b * block)))
                at += 1
            before[s] += int(n)
    return sorted(out)


def test_mixture_is_drawn_numbered_and_joined_as_defined(spark):
    rows, df = source_docs(spark)
    w = {"hot": 1.0, "s0": 3.0, "s2": 2.0, "": 0.5}
    for shard in (64, 1 << 20):
        got = mixing.mix_sources(df, w, block=16, shard=shard, seed=3).collect()
        assert sorted((r.slot, r.source, r["pass"], r.block, r.n_tokens) for r in got) == brute_mixture(rows, w, 16, shard, 3)
        assert all(len(r.text.split()) == r.n_tokens and r.shard == r.slot // shard for r in got)
    parts, _ = mixing.pieces(mixing.placed(df), 16)
    held = {}
    for p in sorted(parts.collect(), key=lambda p: (p.source, p.block, p.at)):
        held.setdefault((p.source, p.block), []).extend(w for t in p.texts for w in t.split())
    assert all(r.text.split() == held[r.source, r.block] for r in got)


def test_mixing_of_long_texts_and_clashing_columns(spark):
    rows = [(i, t, "s", 5, 6, 7) for i, t in [(1, "w " * 200_000), (2, "a b"), (None, "c"), (3, None)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, bucket int, begin int, block int")
    got = mixing.mix_sources(df, block=1000).collect()
    assert len(got) == 201 and sorted(r.n_tokens for r in got)[:2] == [2, 1000]
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and sum(r.bucket is not None for r in out.collect()) == 0


def brute_best_fit(lengths, window):
    rooms = []
    full = sum(n // window for n in lengths)
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(window - n)
    return full + len(rooms)


@pytest.mark.parametrize("window", [5, 16, 100])
def test_packing_is_best_fit_decreasing(window):
    rng = np.random.default_rng(window)
    for _ in range(40):
        n = rng.integers(1, 3 * window, rng.integers(0, 80))
        win, off, row, start, m = packing.pack(np.arange(len(n)), n, window)
        assert (np.bincount(row, m, len(n)) == n).all() and len(set(win)) == brute_best_fit(n.tolist(), window)
        used = {}
        for w, o, k in sorted(zip(win, off, m)):
            assert used.get(w, 0) == o
            used[w] = o + k
            assert used[w] <= window


def test_packing_ties():
    """Equal lengths go in order of id; of windows with equal room the one opened last is taken."""
    win, off, row, start, m = packing.pack(np.array([3, 1, 2, 4, 5]), np.array([6, 6, 6, 4, 4]), 10)
    assert [(int(r), int(w), int(o)) for r, w, o in zip(row, win, off)] == [(1, 0, 0), (2, 1, 0), (0, 2, 0), (3, 2, 6), (4, 1, 6)]


def test_packing_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 7, "w", 9), (1, "a b c", 7, "w", 9), (2, "x " * 5000, 7, "w", 9)], "doc_id long, text string, unit int, window string, n int")
    got = packing.packed(df, 2048).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in got) == [(1, 0, 3), (1, 0, 3), (2, 0, 2048), (2, 2048, 2048), (2, 4096, 904)]


def test_packed_documents(spark):
    rows, df = source_docs(spark)
    rows = rows + [(77, "copy of a row", "hot", "x")] * 200  # one id in all units
    df = df.union(spark.createDataFrame(rows[-200:], df.schema))
    got = packing.packed(df, 128, 50).collect()
    assert len({r.unit for r in got if r.doc_id == 77}) > 3
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    want = {}
    for i, t, *_ in rows:
        if i is not None and t and t.split():
            want[i] = want.get(i, 0) + len(t.split())
    assert total == want and packing.packed(df.limit(0)).count() == 0
    windows = {(r.unit, r.window) for r in got}
    assert sum(want.values()) / (128 * len(windows)) > 0.9


# --- 6, 7, 10 ----------------------------------------------------------------


def test_language_id_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(d.where("doc_id % 4 <> 0"))
    held = d.where("doc_id % 4 = 0 AND n_chars > 60")
    got = {r.doc_id: r for r in langid.identify(held, model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert np.mean([got[i].lang == x for i, x in want.items()]) >= 0.95
    rows = [(None, "the of and"), (1, None), (2, ""), (2, "")]
    got = langid.identify(docs(spark, rows), model).collect()
    assert sorted(r.lang for r in got)[-3:] == ["und"] * 3 and len(got) == 4
    assert langid.identify(docs(spark, []), model).count() == 0


def test_document_frequency_counts_all(spark):
    rows = [(1, "ab"), (2, "abc"), (3, None), (4, "b")]
    df, n = langid.document_frequency(docs(spark, rows, False))
    idx, _, _ = langid.sparse(pa.array(["b"]))
    assert n == 4 and len(idx) == 1 and df[idx[0]] == 3


def brute_sparse(t):
    """Counts of all runs of 1 to 3 characters, by the hash of each alone."""
    out = {}
    for n in (1, 2, 3):
        for a in range(len(t) - n + 1):
            h = 1
            for c in t[a : a + n]:
                h = (h * 0x01000193 + ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            k = ((h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - langid.BITS
            out[k] = out.get(k, 0) + 1
    return out


def test_language_id_scores_are_tf_idf_products():
    """Features, scaling and scores against a dense computation, one text at a time."""
    rng = np.random.default_rng(1)
    texts = ["", "a", "ab", "Zoë liest ☃☃☃ 本", None, "the cat and the hat " * 40, "x" * 5000, "", "é"]
    idf, w, bias = rng.uniform(1, 5, 1 << langid.BITS), rng.normal(0, 1, (1 << langid.BITS, 3)), rng.normal(0, 1, 3)
    model = langid.Model(["de", "en", "fr"], idf, w, bias, 0.7)
    i, c, off = langid.sparse(pa.array(texts))
    for r, t in enumerate(texts):
        want = brute_sparse((t or "").lower())
        assert dict(zip(i[off[r] : off[r + 1]].tolist(), c[off[r] : off[r + 1]].tolist())) == want
        dense = np.zeros(1 << langid.BITS)
        dense[list(want)] = list(want.values())
        x = dense * idf
        raw = x @ w / (np.sqrt(x @ x) or 1) + bias
        assert np.allclose(model.scores(pa.array(texts))[r], raw, rtol=0, atol=1e-9)
        p = np.exp(raw / 0.7 - (raw / 0.7).max())
        label, conf = (x[r] for x in model.label(pa.array(texts)))
        assert (label, conf) == ("und", 0) if not t else label == model.langs[p.argmax()] and abs(conf - p.max() / p.sum()) < 1e-9


def test_language_id_odd_tables(spark):
    """Training on nothing, ties between languages, a very long text."""
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(none, langid.train(none)).count() == 0
    model = langid.Model(["de", "en"], np.ones(1 << langid.BITS), np.zeros((1 << langid.BITS, 2)), np.zeros(2), 1.0)
    got = langid.identify(docs(spark, [(1, "tie"), (2, "long text " * 300_000)]), model).collect()
    assert [(r.lang, r.confidence) for r in got] == [("de", 0.5)] * 2


def test_ftrl_is_the_published_update():
    """Sparse steps against a scalar loop over all coordinates; temperature against a fine grid."""
    rng = np.random.default_rng(8)
    rows = [(np.sort(rng.choice(6, rng.integers(0, 5), replace=False)), None) for _ in range(60)]
    rows = [(i, rng.normal(0, 1, len(i))) for i, _ in rows]
    for classes in (1, 3):
        y = rng.integers(0, 2 if classes == 1 else classes, len(rows))
        m = Ftrl(6, classes, alpha=0.4, beta=1.0, l1=0.3, l2=0.2).fit(rows, y, 2, seed=5)
        z, n = [[0.0] * classes for _ in range(7)], [[0.0] * classes for _ in range(7)]

        def weight(i, k):
            if abs(z[i][k]) <= 0.3:
                return 0.0
            return -(z[i][k] - (0.3 if z[i][k] > 0 else -0.3)) / ((1.0 + n[i][k] ** 0.5) / 0.4 + 0.2)

        order = np.random.default_rng(5)
        for _ in range(2):
            for r in order.permutation(len(rows)):
                x = {6: 1.0, **dict(zip(rows[r][0].tolist(), rows[r][1].tolist()))}
                w = {(i, k): weight(i, k) for i in x for k in range(classes)}
                s = [sum(v * w[i, k] for i, v in x.items()) for k in range(classes)]
                p = [1 / (1 + np.exp(-s[0]))] if classes == 1 else [np.exp(a) / sum(np.exp(b) for b in s) for a in s]
                for i, v in x.items():
                    for k in range(classes):
                        g = v * (p[k] - (float(y[r]) if classes == 1 else float(y[r] == k)))
                        z[i][k] += g - ((n[i][k] + g * g) ** 0.5 - n[i][k] ** 0.5) / 0.4 * w[i, k]
                        n[i][k] += g * g
        assert np.allclose(m.weights(), [[weight(i, k) for k in range(classes)] for i in range(7)], rtol=0, atol=1e-9)
    raw, y = rng.normal(0, 3, (200, 3)), rng.integers(0, 3, 200)
    loss = lambda t: -np.mean([s[k] / t - np.log(np.exp(s / t).sum()) for s, k in zip(raw, y)])
    t = temperature(raw, y)
    assert loss(t) <= min(loss(x) for x in np.exp(np.linspace(np.log(0.02), np.log(20), 2000))) * 1.001


def test_language_id_without_labels(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(d, langid.train(d)).first().lang == "und"


def toxic_rows(n=1200, seed=1):
    """An insult is toxic only where a group is named too."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(r.randrange(3, 40), seed * 10_000 + i, 300)
        insult, group = r.random() < 0.5, r.random() < 0.5
        for on, bag in ((insult, ["vile", "scum"]), (group, ["martians", "venusians"])):
            if on:
                w.insert(r.randrange(len(w)), r.choice(bag))
        rows.append((i, " ".join(w), int(insult and group)))
    return rows


def test_toxicity_learns_pairs(spark):
    rows = toxic_rows()
    d, la = docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(d, la)
    test = toxic_rows(400, 2)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs(spark, [r[:2] for r in test]), model).collect()}
    tp = sum(got[i] and y for i, _, y in test)
    assert tp / sum(y for *_, y in test) >= 0.95 and tp / sum(got.values()) >= 0.9
    odd = docs(spark, [(None, "vile martians"), (1, None), (2, ""), (3, "vile martians"), (3, "vile martians")])
    kept = toxicity.keep(odd, model)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_toxicity_scores_every_pair_of_terms():
    """The score against the sum over all pairs, one by one."""
    rng = np.random.default_rng(6)
    texts = ["", None, "Vile scum!", "a bb ccc dddddd ddddddx", "nothing known", "a a a bb", " ".join(words(300, 5))]
    idx, _, off = toxicity.terms(pa.array([t or "" for t in texts[:4] + texts[5:]]))
    on = np.unique(idx)
    m = toxicity.FactorizationMachine(-0.4, on, rng.normal(0, 0.2, len(on)), rng.normal(0, 0.2, (len(on), toxicity.FACTORS)).astype(np.float32))
    p, toxic = m.scorer()(pa.array(texts))
    for r, t in enumerate(texts):
        i, _, _ = toxicity.terms(pa.array([t or ""]))
        k = [int(np.searchsorted(on, x)) for x in i if x in on]
        s = m.bias + sum(float(m.w[a]) for a in k) + sum(float(m.v[a].astype(float) @ m.v[b].astype(float)) for a, b in itertools.combinations(k, 2))
        assert abs(p[r] - 1 / (1 + np.exp(-s))) < 1e-9 and toxic[r] == (bool(k) and p[r] >= toxicity.THRESHOLD)


def test_toxicity_where_most_labels_are_toxic(spark):
    rows = [(i, " ".join(words(30, 50_000 + i, 200)) + (" grobian" if i % 5 else ""), int(i % 5 > 0)) for i in range(100)]
    model = toxicity.train(docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    odd = docs(spark, [(1, None), (2, ""), (3, "?!"), (4, "grobian " * 400_000)])
    assert sorted((r.doc_id, r.toxic) for r in toxicity.score(odd, model).collect()) == [(1, False), (2, False), (3, False), (4, True)]
    assert sorted(r.doc_id for r in toxicity.keep(odd, model).collect()) == [1, 2, 3]


def test_toxicity_terms_of_few_labels(spark):
    """A term of five labelled rows is learned, however few they are beside the rest."""
    rows = [(i, " ".join(words(30, 70_000 + i)) + (" grobian" if i < 5 else ""), int(i < 5)) for i in range(90)]
    model = toxicity.train(docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    seen = set(toxicity.terms(pa.array([t for _, t, _ in rows]))[0].tolist())
    assert set(model.terms.tolist()) == seen and np.all(np.abs(model.v).sum(1) > 0)
    test = [(i, " ".join(words(30, 80_000 + i)) + (" grobian" if i % 2 else "")) for i in range(40)]
    got = {r.doc_id: r.toxic for r in toxicity.score(docs(spark, test), model).collect()}
    assert all(got[i] == bool(i % 2) for i in range(40))


def test_toxicity_supplied_labels(spark, sf):
    d, la = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.toxic for r in toxicity.score(d, toxicity.train(d, la)).collect()}
    insult = {r.doc_id for r in d.collect() if set(WORD.findall((r.text or "").lower())) & set("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())}
    label = {r.doc_id: r.toxic for r in la.collect()}
    named = [i for i in got if i in insult and label.get(i) == 1]
    clean = [i for i in got if label.get(i) == 0]
    assert named and all(got[i] for i in named) and sum(got[i] for i in clean) <= 0.02 * len(clean)


def test_toxicity_rejects_no_text_without_terms(spark):
    rows = [(i, " ".join(words(30, 60_000 + i, 200)) + (" grobian" if i % 2 else ""), i % 2) for i in range(80)]
    model = toxicity.train(docs(spark, [r[:2] for r in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    model.bias = 0.0  # more than the threshold, as where half the labels are toxic
    odd = docs(spark, [(1, None), (2, ""), (3, "!!! ..."), (4, "zzyzx qqfoo"), (None, None), (5, "grobian"), (5, "grobian")])
    got = [(r.doc_id, r.score, r.toxic) for r in toxicity.score(odd, model).collect()]
    assert sorted(x for x in got if x[0] and x[0] < 5) == [(i, 0.5, False) for i in range(1, 5)] and [x[2] for x in got if x[0] == 5] == [True, True]
    assert sorted(r.doc_id or 0 for r in toxicity.keep(odd, model).collect()) == [0, 1, 2, 3, 4]


def test_toxicity_query_returns_every_row(spark, sf):
    got = QUERIES["op7_toxicity"](spark, sf)
    assert got.columns == ["doc_id", "score", "toxic"] and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_without_labels(spark):
    model = toxicity.train(docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not toxicity.score(docs(spark, [(1, "a b"), (2, None)]), model).where("toxic").count()


def test_quality_held_out(spark):
    r = random.Random(2)
    rows = []
    for i in range(800):
        w = words(r.randrange(10, 60), i)
        good = i % 3 > 0
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [x + r.choice(["$$$", "###"]) for x in w]
        rows.append((i, " ".join(w), int(good)))
    la = spark.createDataFrame([(i, y) for i, _, y in rows[:600]], "doc_id long, quality int")
    weights = quality.train(docs(spark, [x[:2] for x in rows]), la)
    got = {x.doc_id: x.keep for x in quality.score(docs(spark, [x[:2] for x in rows[600:]]), weights).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in rows[600:]]) >= 0.97
    odd = quality.score(docs(spark, [(None, "a b c"), (1, None), (2, ""), (3, " ")]), weights).collect()
    assert [x.keep for x in odd if x.doc_id] == [False] * 3 and quality.score(docs(spark, []), weights).count() == 0


def brute_quality(t, w):
    """Features of each word one by one, hashed as the module hashes bytes, and a dense product."""
    from weirflow.llm.textkit import mix, span_hash

    def h(b):
        raw = np.frombuffer(b, np.uint8)
        return span_hash(raw)(np.array([0]), np.array([len(raw)]))[0]

    ws = [x.encode() for x in re.split("[ \t\n\r\x0b\x0c]+", t) if x]
    if not ws:
        return 0.0
    kind = lambda c: 65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 else 48 if 48 <= c <= 57 else 117 if c > 127 else c
    shape = [bytes(k for k, _ in itertools.groupby(map(kind, x))) for x in ws]
    dense = np.zeros(1 << quality.BITS)
    one = lambda x: np.array([x], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(len(ws)):
            last = k + 1 == len(ws)
            a, s = h(ws[k]), h(shape[k]) ^ np.uint64(0x5A)
            f = [a, s]
            f.append(np.uint64(1) if last else mix(one(a) * quality._MUL + h(ws[k + 1]))[0])
            f.append(np.uint64(2) if last else mix(one(s) * quality._MUL + (h(shape[k + 1]) ^ np.uint64(0x5A)))[0])
            f.append(mix(one(3 if last else 4 if ws[k] == ws[k + 1] else 5))[0])
            for x in f:
                dense[int(x) >> 64 - quality.BITS] += 1
    return round(1 / (1 + np.exp(-(dense * (quality.SCALE / len(ws)) @ w[:-1] + w[-1]))), 6)


def test_quality_scores_are_sparse_dot_products(spark):
    w = np.random.default_rng(3).normal(0, 0.5, (1 << quality.BITS) + 1)
    texts = ["", "one", "One TWO two two", "é!! 12ab  x\n\ty", None, " ".join(words(200, 3)), "same " * 30]
    got = {r.doc_id: r.score for r in quality.score(docs(spark, list(enumerate(texts))), w).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - brute_quality(t or "", w)) < 2e-6
    f, v, off = quality.rows(pa.array([texts[2]]))
    assert abs(v @ w[f] + w[-1] - np.log(got[2] / (1 - got[2]))) < 1e-4


def test_quality_without_labels_and_of_long_texts(spark):
    w = quality.train(docs(spark, [(1, "a b")]), spark.createDataFrame([], "doc_id long, quality int"))
    got = {r.doc_id: (r.score, r.keep) for r in quality.score(docs(spark, [(1, "a b"), (2, "long " * 500_000), (3, None), (4, " ")]), w).collect()}
    assert got == {1: (0.5, True), 2: (0.5, True), 3: (0.0, False), 4: (0.0, False)}


# --- 8 -----------------------------------------------------------------------


def test_g711_tables():
    assert audio.MULAW[0xFF] == 0 and audio.MULAW[0x00] == -32124 and audio.MULAW[0x80] == 32124
    assert audio.ALAW[0xD5] == 8 and audio.ALAW[0x55] == -8 and audio.ALAW[0xAA] == 32256 and audio.ALAW[0x2A] == -32256
    assert len(set(audio.MULAW.tolist())) == 255 and len(set(audio.ALAW.tolist())) == 256


def brute_adpcm(p, block):
    out = []
    for b in range(0, len(p), block):
        c = p[b : b + block]
        if len(c) < 4:
            break
        v, i = int.from_bytes(c[:2], "little", signed=True), min(c[2], 88)
        out.append(v)
        for n in [x for y in c[4:] for x in (y & 15, y >> 4)]:
            s = int(audio.STEPS[i])
            d = (s >> 3) + (s if n & 4 else 0) + (s >> 1 if n & 2 else 0) + (s >> 2 if n & 1 else 0)
            v = max(-32768, min(32767, v - d if n & 8 else v + d))
            i = max(0, min(88, i + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(v)
    return out


def test_adpcm_blocks():
    rng = np.random.default_rng(2)
    data = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 3, 4, 5, 255, 256, 257, 260, 1000, 5000)]
    for p, s in zip(data, audio.adpcm(data)):
        assert s.tolist() == brute_adpcm(p, 256)


def test_resampling_keeps_a_tone():
    t = np.arange(4000) / 8000
    for rate in (16000, 11025, 8000, 4000):
        y = audio.resample((8000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16), 8000, rate)
        assert len(y) == -(-4000 * rate // 8000)
        u = np.arange(len(y)) / rate
        m = slice(100, -100)
        assert np.abs(y[m] - 8000 * np.sin(2 * np.pi * 440 * u[m])).max() < 80


def brute_resample(x, up, down):
    """Each output on its own: the sum over the inputs around it."""
    taps, out = audio._taps(up, down), []
    for j in range(-(-len(x) * up // down)):
        t, acc = j * down, 0.0
        for k in range(2 * audio.REACH):
            at = t // up + 1 + k - audio.REACH
            if 0 <= at < len(x):
                acc += taps[t % up, k] * float(x[at])
        out.append(max(-32768, min(32767, int(np.rint(acc)))))
    return out


def test_resampling_is_the_filter_of_each_signal_alone():
    rng = np.random.default_rng(7)
    signals = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (0, 1, 2, 17, 100, 333)]
    for rate, up, down in ((16000, 2, 1), (8000, 1, 1), (4000, 1, 2), (12000, 3, 2)):
        got = audio.resampled(signals, 8000, rate)
        assert [g.tolist() for g in got] == [brute_resample(x, up, down) for x in signals]
    assert audio.resampled([]) == []


def test_audio_rows(spark):
    rows = [(1, "mulaw", b"\x00\xff"), (2, "alaw", b"\xd5"), (3, "ima_adpcm", b"\x01\x00\x00\x00\x11"), (4, "opus", b"x"), (5, None, b"x"), (6, "mulaw", None), (7, "alaw", b""), (1, "mulaw", b"\x00\xff"), (None, "alaw", b"\xd5")]
    d = spark.createDataFrame(rows, "pcm int, codec string, k0 binary")
    out = audio.decode(d, ["pcm", "codec"], F.col("codec"), F.col("k0"))
    assert out.columns == ["key_pcm", "key_codec", "codec", "sample_rate", "n_samples", "pcm"]
    got = out.collect()
    assert sorted(((r.key_pcm, r.n_samples) for r in got), key=str) == [(1, 4), (1, 4), (2, 2), (3, 6), (4, None), (5, None), (6, None), (7, 0), (None, 2)]
    for r in got:
        x = None if r.n_samples is None else {"mulaw": lambda p: audio.MULAW[list(p)], "alaw": lambda p: audio.ALAW[list(p)], "ima_adpcm": lambda p: np.array(brute_adpcm(p, 256))}[r.codec](next(p for i, c, p in rows if (i, c) == (r.key_pcm, r.key_codec)))
        assert r.pcm is None if x is None else np.frombuffer(r.pcm, "<i2").tolist() == brute_resample(x, 2, 1)
    assert audio.decode(d.limit(0), ["pcm"], F.col("codec"), F.col("k0")).count() == 0


def test_audio_query_is_brute_force_of_every_turn(spark, tmp_path):
    rows = [(c, t, "user", x) for c, t, x in [(0, 0, "some words of it"), (1, 0, "ADPCM " * 60), (1, 1, ""), (2, 1, None), (None, 2, "n"), (0, 2, "é" * 200)]]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): (r.codec, r.pcm and np.frombuffer(r.pcm, "<i2").tolist()) for r in QUERIES["op8_telephony_audio"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for c, t, _, x in rows:
        kind = ("mulaw", "alaw", "ima_adpcm")[((c or 0) + (t or 0)) % 3]
        p = None if x is None else x.encode()
        want = None if p is None else brute_resample({"mulaw": audio.MULAW, "alaw": audio.ALAW}[kind][list(p)] if kind != "ima_adpcm" else np.array(brute_adpcm(p, 256)), 2, 1)
        assert got[c, t][0] == kind and (got[c, t][1] or None) == (want or None)


# --- all ---------------------------------------------------------------------


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", q).group(1)) for q in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["op2_token_id_index", "op5_source_mixing", "op6_language_id", "op8_telephony_audio", "op9_packing", "op10_quality_classifier"])
def test_query_covers_its_table(spark, sf, name):
    got = QUERIES[name](spark, sf)
    table = "conversations" if name.startswith("op8") else "documents"
    source = spark.read.parquet(f"{sf}/{table}.parquet")
    if name == "op5_source_mixing":
        blocks = sum(-(-n // 1024) for n in [r.n for r in source.selectExpr("source", "size(filter(split(text, '\\\\s+'), x -> x <> '')) n").groupBy("source").sum("n").toDF("source", "n").collect()])
        assert got.count() == blocks
    elif name == "op8_telephony_audio":
        assert got.count() == source.count()
    else:
        assert got.select("doc_id").distinct().count() == source.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), c.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in d[cols].itertuples(index=False))
    assert rows(got) == rows(want)
