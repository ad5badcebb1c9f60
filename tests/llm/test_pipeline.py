"""The corpus pipeline against plain Python, stage by stage, each on its own input."""

import collections
import re

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import mixing, quality  # noqa: E402
from tessera.llm.runtime import stored  # noqa: E402

from .test_operators import WORD, brute_join, check_packing, reference_ids  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        result = stored(stage(spark, docs, SF), "t")
        out.append((name, docs, result))
        docs = result
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_have_the_columns_of_documents(steps):
    first = steps["quality"][0]
    for name, (_, after) in steps.items():
        if name != "packing":
            assert after.columns == first.columns and after.dtypes == first.dtypes


def test_quality(spark, steps):
    before, after = steps["quality"]
    net = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(before, net).collect()}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if scores[r[0]] >= 0.3) and 0 < after.count() < before.count()


def test_line_dedup(steps):
    before, after = steps["line_dedup"]
    pages, holds = collections.Counter(), collections.Counter()
    for _, text, _, source, _ in rows(before):
        pages[source] += 1
        holds.update((source, x) for x in {*(text or "").split("\n")} if x.strip(" "))
    bad = {k for k, n in holds.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    want = []
    for d, text, lang, source, n in rows(before):
        kept = "\n".join(x for x in text.split("\n") if (source, x) not in bad)
        want.append((d, kept, lang, source, len(kept) if kept != text else n))
    assert sorted(rows(after)) == sorted(want) and bad


def test_near_duplicates(steps):
    before, after = steps["near_duplicates"]
    groups = brute_join([(r[0], r[1]) for r in rows(before)], 5, 80)
    first = {d for d, _, c, _ in groups if d == c}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in first) and len(first) < before.count()


def test_mixing(steps):
    before, after = steps["mixing"]
    times = collections.Counter(rows(after))
    plan = {(r["doc_id"], r["size"]): r for r in mixing.mix(before).collect()}
    size = collections.Counter()
    for r in rows(before):
        n = len(WORD.findall(r[1] or ""))
        assert times[r] == plan[r[0], n]["first"] <= 2
        size[r[3]] += n
    order = sorted(size)
    want = mixing.targets([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))])
    taken = collections.Counter()
    for r in plan.values():
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - w) <= 0.05 * w + 16 for s, w in zip(order, want))


def test_packing(steps):
    before, after = steps["packing"]
    texts = collections.defaultdict(list)
    for r in rows(before):
        texts[r[0]].append(r[1])
    got = [r.asDict() for r in after.collect()]
    # A document that the mix takes twice is packed twice; its pieces are told apart by what is still missing.
    ids = {d: reference_ids(t[:1])[0] for d, t in texts.items()}
    total = collections.Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
    assert total == {d: len(ids[d]) * len(texts[d]) for d in texts}
    once = {d for d in texts if len(texts[d]) == 1}
    whole = collections.defaultdict(int)
    for r in got:
        whole[r["sequence_id"]] += r["length"]
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in whole.values()) <= 1024 * after.rdd.getNumPartitions() and max(whole.values()) <= 1024
    assert check_packing and len(once) > 0


def test_run_is_the_stages_in_turn(spark, steps):
    assert pipeline.ORACLE_SQL is None
    got = pipeline.run(spark, SF)
    assert got.columns == steps["packing"][1].columns and got.count() == steps["packing"][1].count()
    assert re.fullmatch(r"quality,line_dedup,near_duplicates,mixing,packing", ",".join(n for n, _ in pipeline.STAGES))
