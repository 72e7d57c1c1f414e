"""The pipeline stage by stage against brute force on a small corpus of documents."""

import random

import pytest
from pyspark.sql import functions as F
from test_ops import WORD, brute_best_fit, brute_classes, brute_mixture, brute_spans, words

import corpus_pipeline as P
from weirflow.llm import mixing

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(1)
    rows = []
    for i in range(150):
        w = words(r.randrange(20, 120), i)
        if i % 7 == 0:
            w[3:3] = ["scumbag"] * 2
        rows.append((i, " ".join(w)))
    for i in range(20):
        rows.append((200 + i, rows[i + 1][1].replace(".", "") + " tail"))
    p = words(70, 999)
    rows += [(300 + i, " ".join(words(60, 700 + i) + p + words(50, 800 + i))) for i in range(6)]
    rows += [(None, "no id"), (400, None), (401, ""), (3, rows[3][1])]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "hot" if (i or 0) % 2 else "cold", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int("scumbag" in t)) for i, t in rows[:150]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_copies", "repeated_passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {}
    for k, (name, f) in enumerate(P.STAGES):
        out = f(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == COLS
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = [tuple(r) for r in before.collect()], [tuple(r) for r in docs.collect()]
    key = lambda r: (str(r[0]), r[1] or "")
    old, new = rows["toxicity"]
    assert sorted(map(key, new)) == sorted(key(r) for r in old if "scumbag" not in (r[1] or ""))
    old, new = rows["near_copies"]
    classes = brute_classes([r[:2] for r in old])
    stay = {min(c) for c in classes.values()}
    want = [r for r in old if r[0] is None or not WORD.search(r[1] or "")] + [r for r in {r[:2]: r for r in old if r[0] is not None and WORD.search(r[1] or "")}.values() if r[:2] in stay]
    assert len(old) - len(want) >= 15 and sorted(map(key, new)) == sorted(map(key, want))
    old, new = rows["repeated_passages"]
    cut = {}
    for i, a, b, out in brute_spans([r[:2] for r in old]):
        if out:
            cut.setdefault(i, set()).update(range(a, b))
    want = {i: [w for k, w in enumerate(WORD.findall(t)) if k not in cut.get(i, ())] for i, t, *_ in old if i is not None and t}
    assert len(cut) == 5 and {r[0]: WORD.findall(r[1]) for r in new if r[0] is not None and r[1]} == {i: w for i, w in want.items() if w or i not in cut}
    old, new = rows["mixing"]
    tokens = {s: sum(len(r[1].split()) for r in old if r[0] is not None and r[1] and r[3] == s) for s in ("hot", "cold")}
    weights = mixing.target({s: n for s, n in tokens.items() if n})
    slots = brute_mixture([(r[0], r[1], r[3]) for r in old], weights, mixing.BLOCK, mixing.SHARD, mixing.SEED)
    assert sum(len(r[1].split()) for r in new) == sum(s[4] for s in slots) and all(r[4] == len(r[1]) for r in new)
    given = {}
    for r in old:
        given.setdefault(r[0], []).append(" ".join((r[1] or "").split()))
    assert all(any(" ".join(r[1].split()) in t for t in given[r[0]]) for r in new) and len(new) > len(slots)
    old, new = rows["packing"]
    assert sum(r[5] for r in new) == sum(len(r[1].split()) for r in old)
    assert len({(r[0], r[1]) for r in new}) == brute_best_fit([len(r[1].split()) for r in old], 2048)


def test_run_leaves_its_result_only(spark, sf_dir):
    from pathlib import Path

    from weirflow.session import shared_dir

    held = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file://")).glob("t-*")}
    before = held()
    got = P.run(spark, sf_dir)
    assert got.columns == ["unit", "window", "offset", "doc_id", "start", "n_tokens"] and got.count() > 0
    assert len(held() - before) == 1


def test_stages_keep_columns_of_clashing_names(spark, sf_dir):
    names = ["h", "bucket", "cls", "size", "unit", "window", "block", "slot", "at", "times", "gone", "keeper"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for name, f in P.STAGES:
        got = f(spark, more, sf_dir)
        if name != "packing":
            assert got.columns == more.columns
        assert got.count() == f(spark, docs, sf_dir).count()


def test_empty_tables(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
