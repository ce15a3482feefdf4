"""The pipeline on planted cases, and that the rest of the library does not need it."""

import random
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from shelfcast.llm.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[2]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def planted(spark, folder):
    """Documents with known toxic ones, copies and passages; labels; a benchmark."""
    rng = random.Random(6)
    make = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    rude = lambda n: " ".join(rng.choice(["idiot", "scum", "moron"]) if k % 6 == 0 else f"w{rng.randrange(2000)}" for k in range(n))
    texts = {i: make(rng.randrange(20, 120)) for i in range(300)}
    toxic = {i: rude(60) for i in range(1000, 1150)}
    items = [(k, make(30)) for k in range(5)]
    leaks = {2000 + k: make(20) + " " + items[k % 5][1] + " " + make(20) for k in range(15)}
    copies = {3000 + k: texts[k] for k in range(20)} | {3100 + k: texts[k] + " more" for k in range(20, 30) if len(texts[k].split()) > 40}
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in (texts | toxic | leaks | copies).items()] + [(4000, None, None, None, None), (4001, "", "en", "s1", 0)]
    labels = [(i, 1, 0) for i in range(0, 300)] + [(i, 1, 1) for i in toxic if i % 3]
    spark.createDataFrame(docs, DOCS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, leaks, copies


def test_stages_on_planted_documents(spark, tmp_path):
    texts, toxic, leaks, copies = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns
        result.write.parquet(f"{tmp_path}/stage{number}")
        docs = spark.read.parquet(f"{tmp_path}/stage{number}")
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    everything = {*texts, *toxic, *leaks, *copies, 4000, 4001}
    assert set(kept["toxicity"]) == everything - {*toxic}
    assert sorted(kept["ngram_jaccard_join"]) == sorted(everything - {*toxic} - {*copies})
    assert sorted(kept["decontamination"]) == sorted(everything - {*toxic} - {*copies} - {*leaks})
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert max(kept["mixing"].count(i) for i in set(kept["mixing"])) <= 3
    assert sorted(kept["sharding"]) == sorted(kept["mixing"])


def test_run_applies_the_stages(spark, tmp_path):
    planted(spark, tmp_path)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.columns[-2:] == ["shard", "slot"]
    shards = [r["count"] for r in rows.groupBy("shard").count().collect()]
    assert len(shards) == 24 and max(shards) - min(shards) <= 1


def test_stages_survive_empty_documents(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, str(tmp_path))
        assert result.count() == 0
        docs = result.select([c for c in result.columns if c not in ("shard", "slot")])


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_the_rest_imports_without_the_operators(tmp_path):
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['shelfcast.llm'] = None; import __spark_entry__ as e; "
        "assert e.queries() and not [q for q in e.queries() if q == 'pipeline' or q[:2] == 'op' and '_' in q and q[2].isdigit()]")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "shelfcast").rglob("*.py"):
        if "llm" not in path.parts:
            assert "shelfcast.llm" not in path.read_text(), path
