"""The pipeline's stages take effect, keep columns, and equal their operators."""

import re

from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as p
from shellgauge.llm import decontamination, near_dup, quality_rules, secrets
from shellgauge.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    columns = docs.columns
    kept = {r["doc_id"] for r in quality_rules.judge(docs, quality_rules.learn(docs, labels)).collect() if r["kept"]}
    done = [p.STAGES[0][1](spark, docs, SF)]
    assert {r["doc_id"] for r in done[0].collect()} == kept and len(kept) < docs.count()
    done.append(p.STAGES[1][1](spark, done[0], SF))
    classes = {r["class_id"] for r in near_dup.near_duplicates(done[0]).collect()}
    assert sorted(r["doc_id"] for r in done[1].collect()) == sorted(classes)
    done.append(p.STAGES[2][1](spark, done[1], SF))
    bad = {r["doc_id"] for r in decontamination.contaminated(done[1], items).collect()}
    assert {r["doc_id"] for r in done[2].collect()} == classes - bad
    done.append(p.STAGES[3][1](spark, done[2], SF))
    spans = {r["doc_id"]: r["spans"] for r in secrets.find(done[2]).collect()}
    for a, b in zip(sorted(done[2].collect(), key=lambda r: r["doc_id"]), sorted(done[3].collect(), key=lambda r: r["doc_id"])):
        assert a["doc_id"] == b["doc_id"] and (a["text"] == b["text"]) == (not spans[a["doc_id"]]) and b["n_chars"] == len(b["text"])
        assert not re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", b["text"])
    assert all(d.columns == columns for d in done)
    library = Tokenizer.from_file(TOKENIZER)
    last = {r["doc_id"]: list(r["ids"]) for r in p.STAGES[4][1](spark, done[3], SF).collect()}
    assert last == {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in done[3].collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in p.run(spark, SF).collect()} == last


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert len(p.STAGES) == 5
