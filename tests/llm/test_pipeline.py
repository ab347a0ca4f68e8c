"""The pipeline's stages in turn, each against a plain computation on what the one before kept."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_llm import ascii_words, plain_fingerprint, prose

import corpus_pipeline
from termloom.llm import lines, mixing, pairwise


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, at = random.Random(8), tmp_path_factory.mktemp("sf")
    shared = prose(900, 30)
    docs = []
    for i in range(240):
        t = prose(2000 + i, 30 + i % 60)
        if i % 4 == 1:
            t = " ".join(w + r.choice(["***", "###"]) for w in t.split()) if i % 8 == 1 else "again " * (40 + i)
        elif i % 12 == 2:
            t = docs[i - 2][1]
        elif i % 12 == 6:
            t = f"{t}\n{shared}\n"
        docs.append((i, t, "en", f"s{i % 5}", len(t)))
    docs += [(300, None, None, None, None), (301, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0 if i % 4 == 1 else 1, 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_against_plain_code(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before.collect(), docs.collect()
        assert name == "pack" or docs.columns == columns

    had, got = kept["quality"]
    model = pairwise.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in pairwise.scores(spark.read.parquet(f"{folder}/documents.parquet"), model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in got} == good and len(good & {i for i in range(240) if i % 4 != 1}) > 175 and len(good & {i for i in range(240) if i % 4 == 1}) < 5

    had, got = kept["near_duplicates"]
    fp = {r.doc_id: plain_fingerprint(r.text or "") for r in had}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(fp):
        for j in fp:
            if j < i and (fp[i] ^ fp[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(r.doc_id for r in got) == sorted({find(i) for i in fp})

    had, got = kept["substrings"]
    seen, want = {}, {}
    for r in sorted(had, key=lambda r: r.doc_id):
        gone = []
        for a, z, d in lines.units(r.text or ""):
            if seen.setdefault(d, (r.doc_id, a)) != (r.doc_id, a):
                gone.append((a, z))
        want[r.doc_id] = lines.without(r.text, gone) if r.text is not None else None
    assert {r.doc_id: r.text for r in got} == want and all(r.text is None or r.n_chars == len(r.text) for r in got)

    had, got = kept["mix"]
    taken = {r.doc_id: r.taken for r in mixing.op7_mixing(spark.read.parquet(f"{tmp_path}/substrings")).collect()}
    words = Counter()
    for r in got:
        words[r.doc_id] += len(ascii_words(r.text))
    assert {i: n for i, n in taken.items() if n} == dict(words)

    had, got = kept["pack"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    ids = [(r.doc_id, np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4")) for r in had]
    assert sum(r.length for r in got) == sum(len(x) for _, x in ids)
    have = {(i, zlib.crc32(x.tobytes())) for i, x in ids}
    assert all((r.doc_id, r.ids_crc32) in have for r in got if r.length == r.doc_tokens)
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096


def test_run_returns_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('op7_mixing' in e.queries(), 'op3_warc' in e.oracle_sql(), set(e.oracle_sql()) <= set(e.queries()))"], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True)
    assert said.stdout.split()[-3:] == ["True", "True", "True"], said.stderr
