"""The pipeline's stages against brute force, and the queries' registration."""

import os
import re
import subprocess
import sys
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark import cloudpickle
from lodestone.llm import filters, quality_classifier, weak_rules
from lodestone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        now = {r.doc_id: r for r in docs.collect()}
        assert all(now[i] == before[i] for i in now)
        gone = [before[i].text for i in before if i not in now]
        if name == "quality_classifier":
            scores = {r.doc_id: r.score for r in quality_classifier.score(spark.read.parquet(f"{SF}/documents.parquet"), model).collect()}
            assert set(now) == {i for i, s in scores.items() if s >= 0.5}
        if name == "quality_rules":
            judged = {r.doc_id: r.kept for r in weak_rules.judged(weak_rules.counts(spark.createDataFrame(list(before.values()), docs.schema))).collect()}
            assert set(now) == {i for i, k in judged.items() if k}
        if name == "simhash_near_dedup":
            shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
            sets = {i: shingles(r.text) for i, r in now.items()}
            like = lambda a, b: len(a & b) / len(a | b)
            ids = sorted(sets)
            assert not any(like(sets[a], sets[b]) >= 0.8 for k, a in enumerate(ids) for b in ids[:k])
            assert all(max(like(shingles(t), s) for s in sets.values()) > 0.4 for t in gone)
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(before)


def test_odd_rows_pass_all_stages(spark, odd, nothing, tmp_path):
    """Nulls in every column, copies, repeated ids, very long texts, clashing names, no rows at all."""
    wide = " ".join(f"word{k % 7919}" for k in range(150_000)) + "."
    more = spark.createDataFrame([(50, wide, None, None, None, "b", 1, "f", "w", None)] * 2, odd.schema)
    for name, docs in (("odd", odd.unionByName(more)), ("nothing", nothing)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{name}{k}"))
            before, docs = docs, spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == before.columns and docs.exceptAll(before).isEmpty()
        assert {"doc_id", "sequence_id", "offset", "length"} <= set(docs.columns)
        assert (docs.count() == 0) == before.isEmpty()


def exact_classes(texts: dict) -> set:
    """The smallest ids of the classes under similarity 0.8 of five-word shingles, from all pairs."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: frozenset(filters.shingles(t).tolist()) for i, t in texts.items()}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    for k, b in enumerate(ids):
        for a in reversed(ids[:k]):
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            if find(a) != find(b) and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in texts}


def test_candidate_search_against_all_pairs(spark):
    """Tiles are keyed by a search that could miss: on this table it misses nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = exact_classes({r.doc_id: r.text or "" for r in docs.collect()})
    got = {r.doc_id for r in filters.one_of_each_class(docs).select("doc_id").collect()}
    assert got == want and len(want) < docs.count()


class _Taken(Exception):
    """Stands for a table; what is to run over its batches is kept instead of run."""

    schema = None

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        raise self


#: Megabytes that a worker of its own takes at most, and at the end, for many new words.
_MEASURE = """
import pickle, random, re, sys
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(3)
    for k in range(4):
        text = [" ".join("%s%s." % (w[:5], w[5:]) for w in ("".join(rng.choices("etaoinshrdlu", k=9)) for _ in range(300))) for _ in range(700)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(700)), "text": text})
        del text

run = pickle.load(open(sys.argv[1], "rb"))
for _ in batches():
    pass
start, most = held(), 0
for _ in run(batches()):
    most = max(most, held())
print(most - start, held() - start)
"""


def test_a_workers_memory_is_bounded(spark, tmp_path):
    """Earlier stages' workers and a full heap stand beside the encoder's memos: together they took over 3,000 MB."""
    taken = []
    model = (np.zeros(quality_classifier.BUCKETS, np.float32), 0.0)
    for use in (lambda docs: corpus_pipeline.pack(spark, docs, SF), lambda docs: quality_classifier.keep_good(docs, model)):
        with pytest.raises(_Taken) as got:
            use(_Taken())
        (tmp_path / "run").write_bytes(cloudpickle.dumps(got.value.run))
        said = subprocess.run([sys.executable, "-c", _MEASURE, str(tmp_path / "run")], capture_output=True, text=True, check=True, cwd=os.path.dirname(corpus_pipeline.__file__))
        taken.append([float(x) for x in said.stdout.split()])
    assert taken[0][0] < 140  # the encoder is 35 of them
    assert taken[1][1] < 60  # nothing is kept after a partition


def test_the_drivers_memory_goes_back(spark, monkeypatch):
    """What training took stood beside the later stages' plans: with a full heap over 1,500 MB together."""
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
    kept = []

    def rows(*_):
        made = [np.ones(1000) for _ in range(40_000)]  # 320 MB in small pieces; some stay, so that the ends of the heap do
        kept.extend(made[1999::2000])
        return [(x, x) for x in made], [1] * len(made)

    monkeypatch.setattr(quality_classifier, "training_rows", rows)
    monkeypatch.setattr(quality_classifier, "train", lambda docs, labels: (np.zeros(len(docs) and quality_classifier.BUCKETS, np.float32), 0.0))
    start = held()
    quality_classifier.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert held() - start < 100
    # training itself holds its input and the model, no second copy of the features
    docs = [(np.arange(5000, dtype=np.int32) + k, np.ones(5000, np.int32)) for k in range(1000)]
    monkeypatch.undo()
    tracemalloc.start()
    quality_classifier.train(docs, [k % 2 for k in range(1000)], epochs=1)
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert most < 25  # 40 more before
