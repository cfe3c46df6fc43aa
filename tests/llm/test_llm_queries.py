"""The subpackage's queries against DuckDB where SQL can express them, and the pipeline stage by stage."""

import glob
import hashlib
import os
import struct
import subprocess
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontam, dedup, secrets
from tidemark.llm.common import table
from tidemark.llm.queries import ORACLE_SQL, QUERIES

AT = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{AT}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = QUERIES[name](spark, AT)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == Counter(want.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = table(spark, AT, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, AT)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(before)
        if name == "bpe":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert set(rows) == set(before)
            for i, r in rows.items():
                ids = library.encode(before[i].text, add_special_tokens=False).ids
                assert bytes(r.ids_le) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
            break
        assert out.columns == columns
        changed = {i for i, r in rows.items() if r.text != before[i].text}
        if name in ("toxicity", "minhash_dedup"):
            assert not changed
        if name == "minhash_dedup":
            assert set(rows) == {r.doc_id for r in dedup.near_duplicates(docs).collect() if r.kept}
        if name == "decontamination":
            machine = decontam.Automaton([(str(r.item_id), r.text) for r in table(spark, AT, "benchmark").collect()])
            hit = {i for i, r in before.items() if machine.search(decontam.words_of(r.text))[0]}
            assert changed | (set(before) - set(rows)) == hit
            assert not any(machine.search(decontam.words_of(r.text))[0] for r in rows.values())
        if name == "secret_scans":
            assert set(rows) == set(before)
            found = {r.doc_id for r in secrets.scan(docs, secrets.train(docs)).where("size(found) > 0").collect()}
            assert changed == found
        assert all(r.n_chars == (len(r.text) if i in changed else before[i].n_chars) for i, r in rows.items())
        docs, before = out, rows
    again = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, AT).collect()}
    assert again == {(i, r.ids_sha256) for i, r in rows.items()}


def test_pipeline_leaves_extra_columns_alone(spark):
    """Columns with the names that operators use, odd names, types of their own, nulls and repeated rows."""
    extra = ["score", "predicted", "items", "spans", "base", "found", "row", "t", "low", "rest", "clean", "clean_text", "stays", "n_words", "id", "set_key", "_one", "_set_key", "_rest", "kept", "label", "rank", "a b", "_number"]
    plain = table(spark, AT, "documents")
    docs = plain.select("*", *(F.lit(f"mine {c}").alias(c) for c in extra), F.array("doc_id").alias("own list"))
    odd = [(None, None), (None, ""), (None, "one two"), (None, "one two"), (-1, None), (-1, None), (-2, " . "), (-3, "password=abcdefgh12")]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    for (name, stage), without in zip(corpus_pipeline.STAGES[:-1], (plain.unionByName(more, allowMissingColumns=True),) * 4):
        out = stage(spark, docs, AT)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.collect()
        assert all(r[c] in (f"mine {c}", None) and (r[c] is not None or r.doc_id is None or r.doc_id < 0) for r in rows for c in extra), name
        assert all(r["own list"] in (None, [r.doc_id]) for r in rows)
        assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == Counter((r.doc_id, r.text, r.n_chars) for r in stage(spark, without, AT).collect()), name
        assert stage(spark, docs.limit(0), AT).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, AT).count() == docs.count()


def test_workers_need_no_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tidemark.llm.queries import QUERIES
for n in ("op2_quality_rules", "op3_language_id", "op6_decontamination", "op8_token_counts"):
    assert QUERIES[n](spark, {AT!r}).count()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_queries_show_what_their_method_finds(spark):
    texts = {r.doc_id: r.text for r in table(spark, AT, "documents").collect()}
    for r in QUERIES["op3_language_id"](spark, AT).collect():
        bits = {k: float(v) for k, v in (x.split(":") for x in r.code_bits.split(",") if x)}
        if r.lang_pred != "und":
            assert bits[r.lang_pred] == min(bits.values()) and len(bits) > 1
    toxic = [r for r in QUERIES["op7_toxicity"](spark, AT).collect() if r.sentences]
    for r in toxic:
        for begin, end, score in (s.split(":") for s in r.sentences.split(",")):
            assert 0 <= int(begin) < int(end) <= len(texts[r.doc_id]) and 0.5 <= float(score) <= 1
        assert r.predicted == 1
    for r in QUERIES["op6_decontamination"](spark, AT).collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        assert sum(e - b for b, e in spans) == r.n_hit and (r.longest >= 1) == bool(spans)
