"""The stages one after the other, against brute force on what each of them gets."""

from pathlib import Path

import pytest
from test_dedup import components, drop_lines
from test_texts import base_counts

import __spark_entry__ as contract
import corpus_pipeline
from netquarry.functions.storage import materialize
from netquarry.llm import packing, queries

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@needs_tables
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    done = {"input": docs}
    for name, stage in list(stages.items())[:-1]:
        done[name] = materialize(stage(spark, list(done.values())[-1], SF), name)
        assert done[name].columns == COLUMNS
    good = rows_of(done["quality_rules"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    failed = {r[0] for r in rows_of(docs) if base_counts(r[1])[-1]}
    left = {r[0] for r in good}
    assert not left & failed
    assert all((d in left) == (q == 1) for d, q in labels.items() if d not in failed)
    gone = drop_lines(good)
    want = {}
    for r in good:
        drop = {int(x) for x in gone.get((False, r[0], r[1]), "").split(",") if x}
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in drop)
        if not drop or text.encode().split():
            want[r[0]] = text
    lined = rows_of(done["line_dedup"])
    assert {r[0]: r[1] for r in lined} == want
    assert {r[0] for r in rows_of(done["near_dedup"])} == {c[0] for c in components(lined) if c[3]}
    items = [" ".join(r["text"].split()).lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows_of(done["near_dedup"]), {r[0] for r in rows_of(done["decontamination"])}
    holding = {r[0] for r in before if any(x in " ".join(r[1].split()).lower() for x in items)}
    assert holding and not holding & after and after == {r[0] for r in before} - holding
    ids = packing.WordIds(packing.TOKENIZER)
    total = sum(len(ids.of(r[1].encode())) // 2 + 1 for r in rows_of(done["decontamination"]))
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.agg({"length": "sum"}).first()[0] == total


def test_registered():
    names = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.CHECKS) <= set(contract.oracle_sql())
    assert sorted(n.split("_")[0] for n in queries.QUERIES) == sorted(f"op{k}" for k in range(1, 14))
